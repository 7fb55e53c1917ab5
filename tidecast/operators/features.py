"""Lag and month features of every (series, horizon)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import CHUNK_ROWS, HORIZONS, LAG_NAMES, MAX_HORIZON, N_LAGS, TRAIN_FUTURE_ROWS
from tidecast.functions.expressions import by_frequency, horizons, lag_columns, max_horizon, month_flags
from tidecast.operators.selection import in_sample
from tidecast.operators.sequence import last_rows, with_lags


def lagged_rows(ts: DataFrame, max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """In-sample rows, each once, with all lags any horizon needs. Horizons are cut from this."""
    rows = in_sample(ts).select("series_id", "time_index", "tourism")
    return with_lags(rows, range(1, N_LAGS + MAX_HORIZON + 1), max_rows=max_rows, chunk_rows=chunk_rows)


def future_counts(ts: DataFrame, max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number of later rows of the same series and sample."""
    counted = with_lags(
        ts, [], keys=("series_id", "sample_type"), max_rows=max_rows, chunk_rows=chunk_rows
    )
    return counted.select("series_id", "sample_type", "time_index", "future_record_count")


def lag_features(ts: DataFrame, max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For horizon h, lag_k is the value h + k rows earlier; one shuffle serves all horizons."""
    return per_horizon(lagged_rows(ts, max_rows, chunk_rows))


def per_horizon(lagged: DataFrame) -> DataFrame:
    return lagged.select(
        "series_id",
        F.explode(horizons(F.col("series_id"))).alias("horizon"),
        "time_index",
        "tourism",
        "lags",
        "future_record_count",
    ).select(
        "series_id",
        "horizon",
        F.col("time_index").alias("observation_id"),
        F.col("tourism").alias("target"),
        *lag_columns(F.col("lags"), F.col("horizon")),
        *month_flags(F.col("time_index")),
        "future_record_count",
    )


def future_limit(holdout: str) -> Column:
    """Rows a training row must have after it: 24 for all, or 24 / 8 / 1 by frequency."""
    if holdout == "fixed":
        return F.lit(TRAIN_FUTURE_ROWS)
    if holdout == "by_frequency":
        return max_horizon(F.col("series_id"))
    raise ValueError(f"holdout must be 'fixed' or 'by_frequency', not {holdout!r}")


def train_features(
    ts: DataFrame, holdout: str = "fixed", max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows with a full set of lags and enough later rows of the series kept for validation.

    Rows in the validation tail are dropped before the horizons are multiplied out.
    """
    lagged = lagged_rows(ts, max_rows, chunk_rows).where(
        F.col("future_record_count") > future_limit(holdout)
    )
    return per_horizon(lagged).where(F.col(LAG_NAMES[-1]).isNotNull())


def anchors(ts: DataFrame, pred_type: str) -> DataFrame:
    """The row each series is forecast from, with its value and the 12 values before it.

    For `validation` it is the row with 24 / 8 / 1 rows after it, for `oos` the last row. Only the
    last rows of each series are shuffled, and one row per series comes out.
    """
    if pred_type not in ("validation", "oos"):
        raise ValueError(f"pred_type must be 'validation' or 'oos', not {pred_type!r}")
    after = by_frequency(F.col("series_id"), HORIZONS) if pred_type == "validation" else F.lit(0)
    furthest = MAX_HORIZON if pred_type == "validation" else 0
    tail = last_rows(in_sample(ts).select("series_id", "time_index", "tourism"), furthest + N_LAGS + 1)
    distance = F.col("rank") - after - 1

    def value_at(k: int, column: str = "tourism") -> Column:
        return F.max(F.when(distance == k, F.col(column)))

    return (
        tail.groupBy("series_id")
        .agg(
            value_at(0, "time_index").alias("anchor_time"),
            value_at(0).alias("anchor_value"),
            *[value_at(k).alias(name) for k, name in enumerate(LAG_NAMES, start=1)],
        )
        .where(F.col("anchor_time").isNotNull())
        .withColumn("future_record_count", after.cast("long"))
    )


def inference_features(ts: DataFrame, pred_type: str, first_horizon: int = 1) -> DataFrame:
    """One row per (series, horizon) to score, for horizons counted from `first_horizon`.

    `first_horizon=0` counts from the anchor itself, one step behind the model's horizon.
    """
    shift = 1 - first_horizon
    observation_id = F.col("anchor_time") + F.col("horizon")
    return (
        anchors(ts, pred_type)
        .select("*", F.explode(horizons(F.col("series_id"))).alias("model_horizon"))
        .withColumn("horizon", F.col("model_horizon") - shift)
        .select(
            "series_id",
            "horizon",
            observation_id.alias("observation_id"),
            F.col("anchor_value").alias("target"),
            *LAG_NAMES,
            *month_flags(observation_id),
            "future_record_count",
        )
    )
