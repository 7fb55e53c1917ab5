"""Selections and profiles of the long table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import HORIZONS, MAX_HORIZON
from tidecast.functions.expressions import by_frequency, frequency, horizons, max_horizon, metadata_rows, target_id
from tidecast.operators.reference_tables import max_time
from tidecast.operators.sequence import last_rows
from tidecast.sources.bucketed import one_series
from tidecast.sources.tables import shuffled


def in_sample(ts: DataFrame) -> DataFrame:
    """Sample types are in lower case in every loaded table, so the filter reaches the scan."""
    return ts.where(F.col("sample_type") == "in")


def series_extract(ts: DataFrame, sample_type: str, series_id: str | None = None) -> DataFrame:
    """One series, or all of them, in time order. Letter case of the two names is ignored.

    Ids and sample types are in lower case in every loaded table, so both filters reach the scan.
    """
    rows = ts.where(F.col("sample_type") == sample_type.lower())
    if series_id is not None:
        rows = one_series(rows, series_id)
    return rows.select("series_id", "time_index", "tourism").orderBy("series_id", "time_index")


def similarity_profile(
    ts: DataFrame, sample_type: str | None = None, series_type: str | None = None, before: int = 20
) -> DataFrame:
    """Mean and spread across all series of a kind at each early time step, with the band around
    the mean. All kinds come from one pass; the two filters pick one."""
    rows = ts.where(F.col("time_index") < before)
    if sample_type is not None:
        rows = rows.where(F.col("sample_type").like(f"%{sample_type}%"))
    if series_type is not None:
        rows = rows.where(F.lower("series_id").like(f"%{series_type}%"))
    profile = rows.groupBy(
        frequency(F.col("series_id")).alias("series_type"), "sample_type", "time_index"
    ).agg(F.stddev_samp("tourism").alias("tourism_stddev"), F.avg("tourism").alias("tourism_avg"))
    return profile.withColumns(
        {
            "lower": F.col("tourism_avg") - F.col("tourism_stddev"),
            "upper": F.col("tourism_avg") + F.col("tourism_stddev"),
        }
    ).orderBy("series_type", "sample_type", "time_index")


def target_grid(ts: DataFrame) -> DataFrame:
    """Every (series, horizon) to be modelled, with its target id."""
    return (
        ts.select("series_id")
        .distinct()
        .select("series_id", F.explode(horizons(F.col("series_id"))).alias("horizon"))
        .withColumn("target", target_id(F.col("series_id"), F.col("horizon")))
    )


def validation_actuals(ts: DataFrame) -> DataFrame:
    """The last 24 / 8 / 1 in-sample rows with their step (1 = earliest)."""
    tail = last_rows(in_sample(ts).select("series_id", "time_index", "tourism"), MAX_HORIZON)
    limit = max_horizon(F.col("series_id"))
    return tail.where(F.col("rank") <= limit).select(
        "series_id", "time_index", "tourism", (limit - F.col("rank") + 1).alias("step")
    )


def oos_actuals(ts: DataFrame, phase_shift: bool = False) -> DataFrame:
    """Out-of-sample rows with the bounds and numbering of the simple selection.

    With `phase_shift` the first rows are skipped but not re-numbered. Only monthly series have
    their own bounds; quarterly ones fall under the yearly rule.
    """
    monthly = frequency(F.col("series_id")) == "m"
    time = F.col("time_index")
    if phase_shift:
        kept = time > F.when(monthly, 2).otherwise(1)
    else:
        kept = time < F.when(monthly, 24).otherwise(1)
    return (
        ts.where((F.col("sample_type") == "oos") & kept)
        .join(shuffled(max_time(ts)), "series_id")
        .select("series_id", (time + F.col("max_time")).alias("time_index"), "tourism")
    )


def oos_observations(
    ts: DataFrame,
    metadata_kept: bool = True,
    horizon_limits: dict[str, int] = HORIZONS,
) -> DataFrame:
    """Out-of-sample observations on the in-sample axis, with their step.

    Metadata rows are skipped if the table still has them, and the first observation follows
    directly on the last in-sample row.
    """
    skipped = metadata_rows(F.col("series_id")) if metadata_kept else F.lit(0)
    step = F.col("time_index") - skipped + 1
    return (
        ts.where(
            (F.col("sample_type") == "oos")
            & step.between(1, by_frequency(F.col("series_id"), horizon_limits))
        )
        .join(shuffled(max_time(ts)), "series_id")
        .select("series_id", (F.col("max_time") + step).alias("time_index"), "tourism", step.alias("step"))
    )


def paired_by_position(actuals: DataFrame) -> DataFrame:
    """Number each series' actuals 1, 2, ... in time order."""
    by_time = Window.partitionBy("series_id").orderBy("time_index")
    return actuals.withColumn("step", F.row_number().over(by_time))
