"""Reference tables kept up to date when rows are appended, without reading the older rows again.

A state has one small row per series (or per point of a profile). `add_rows` merges a batch into it and
gives the new state, to be stored in place of the old one. Rows of a series must come in the order of the
joined axis: in-sample rows by time, then out-of-sample rows by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import CHUNK_ROWS, SEASON_LAGS
from tidecast.functions.expressions import by_frequency, frequency
from tidecast.operators.sequence import last_rows, with_lags
from tidecast.sources.tables import shuffled

KEPT_VALUES = 12
# Out-of-sample rows follow all in-sample ones on the axis.
OOS_START = 1 << 32

SERIES_STATE = "series_id string, max_time int, axis long, rows long, differences long, total double, recent array<double>"
PROFILE_STATE = "series_type string, sample_type string, time_index int, rows long, mean double, squares double"


def _on_axis(batch: DataFrame) -> DataFrame:
    is_in = F.col("sample_type") == "in"
    axis = F.when(is_in, F.lit(0)).otherwise(F.lit(OOS_START)).cast("long") + F.col("time_index")
    return batch.select(
        "series_id", axis.alias("axis"), "tourism", F.when(is_in, F.col("time_index")).alias("in_time"), F.lit(True).alias("new")
    )


def add_rows(
    state: DataFrame | None, batch: DataFrame, max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The state of all series after a batch of (series_id, sample_type, time_index, tourism).

    A series' last twelve values stand in front of its new rows, so seasonal differences across the seam are
    counted once. Series that are only in the state or only in the batch stay or begin. A row that is not
    later than its series' last one fails the job. An empty batch leaves the state as it is. The state is read
    twice, so it should be a stored table. `max_rows` bounds the new rows of a series and the values in front.
    """
    spark, rows = batch.sparkSession, _on_axis(batch)
    state = spark.createDataFrame([], SERIES_STATE) if state is None else state
    touched = state.join(shuffled(rows.select("series_id").distinct()), "series_id", "left_semi")
    front = touched.select("series_id", F.posexplode("recent").alias("back", "tourism")).select(
        "series_id",
        (-(F.col("back") + 1)).cast("long").alias("axis"),
        "tourism",
        F.lit(None).cast("int").alias("in_time"),
        F.lit(False).alias("new"),
    )
    seen = rows.unionByName(front)
    lagged = with_lags(seen, [12, 4, 1], order="axis", max_rows=max_rows, chunk_rows=chunk_rows).where("new")
    column = {freq: F.get("lags", F.lit([12, 4, 1].index(lag))) for freq, lag in SEASON_LAGS.items()}
    difference = F.abs(F.col("tourism") - by_frequency(F.col("series_id"), column))
    sums = lagged.groupBy("series_id").agg(
        F.max("in_time").alias("max_time"),
        F.min("axis").alias("first"),
        F.max("axis").alias("axis"),
        F.count(F.lit(1)).alias("rows"),
        F.count(difference).alias("differences"),
        F.coalesce(F.sum(difference), F.lit(0.0)).alias("total"),
    )
    newest = F.sort_array(F.collect_list(F.struct("rank", "tourism")))["tourism"]
    recent = last_rows(seen, KEPT_VALUES, order="axis").groupBy("series_id").agg(newest.alias("recent"))
    added = sums.join(shuffled(recent), "series_id").select(
        "series_id", *[F.col(c).alias(f"_{c}") for c in ("max_time", "first", "axis", "rows", "differences", "total", "recent")]
    )
    late = F.col("axis").isNotNull() & F.col("_first").isNotNull() & (F.col("_first") <= F.col("axis"))
    problem = F.concat(F.lit("rows not later than the stored ones of series "), F.col("series_id"))
    axis = F.when(late, F.raise_error(problem).cast("long")).otherwise(F.greatest("axis", "_axis"))

    def both(name, zero):
        return F.coalesce(F.col(name), zero) + F.coalesce(F.col(f"_{name}"), zero)

    return state.join(shuffled(added), "series_id", "full").select(
        "series_id",
        F.greatest("max_time", "_max_time").alias("max_time"),
        axis.alias("axis"),
        both("rows", F.lit(0)).alias("rows"),
        both("differences", F.lit(0)).alias("differences"),
        both("total", F.lit(0.0)).alias("total"),
        F.coalesce("_recent", "recent").alias("recent"),
    )


def max_time_of(state: DataFrame) -> DataFrame:
    """Equal to `max_time` over all rows added so far."""
    return state.where(F.col("max_time").isNotNull()).select("series_id", "max_time")


def scale_factor_of(state: DataFrame) -> DataFrame:
    """Equal to `scale_factor` over all rows added so far."""
    mean = F.try_divide("total", "differences")
    return state.where(F.col("max_time").isNotNull()).select("series_id", mean.alias("error"))


def add_to_profile(state: DataFrame | None, batch: DataFrame, before: int = 20) -> DataFrame:
    """Counts, means and squared deviations of each early time step over all series, after a batch.

    The order of rows does not matter. Means are merged by their distance, so that a small spread on a high
    level is kept. NULL values are left out; a point with no other value has NULL results.
    """
    value = F.col("tourism")
    added = (
        batch.where(F.col("time_index") < before)
        .groupBy(frequency(F.col("series_id")).alias("series_type"), "sample_type", "time_index")
        .agg(F.count(value).alias("rows"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("squares"))
    )
    if state is None:
        return added
    keys = ["series_type", "sample_type", "time_index"]
    other = added.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("rows", "mean", "squares")])
    n, m = F.coalesce("rows", F.lit(0)), F.coalesce("_rows", F.lit(0))
    gap = F.coalesce("_mean", "mean") - F.coalesce("mean", "_mean")
    share = F.try_divide(m, n + m)
    squares = F.coalesce("squares", F.lit(0.0)) + F.coalesce("_squares", F.lit(0.0))
    return state.join(other, keys, "full").select(
        *keys,
        (n + m).alias("rows"),
        (F.coalesce("mean", "_mean") + gap * share).alias("mean"),
        (squares + F.coalesce(gap * gap * n * share, F.lit(0.0))).alias("squares"),
    )


def similarity_profile_of(state: DataFrame) -> DataFrame:
    """Equal to `similarity_profile` over all rows added so far."""
    spread = F.when(F.col("rows") > 1, F.sqrt(F.col("squares") / (F.col("rows") - 1)))
    profile = state.select(
        "series_type", "sample_type", "time_index", spread.alias("tourism_stddev"), F.col("mean").alias("tourism_avg")
    )
    return profile.withColumns(
        {
            "lower": F.col("tourism_avg") - F.col("tourism_stddev"),
            "upper": F.col("tourism_avg") + F.col("tourism_stddev"),
        }
    )
