"""Per-series reference tables: last in-sample index, joined time axis, MASE denominator."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import CHUNK_ROWS, SEASON_LAGS
from tidecast.functions.expressions import by_frequency
from tidecast.operators.sequence import fits_one_task, with_lags
from tidecast.sources.tables import shuffled


def max_time(ts: DataFrame) -> DataFrame:
    return (
        ts.where(F.col("sample_type") == "in").groupBy("series_id").agg(F.max("time_index").alias("max_time"))
    )


def with_max_time(ts: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Add each series' last in-sample index; series without in-sample rows drop out.

    With bounded series this shares the shuffle of the lag windows that follow; otherwise it is a
    join, which Spark can split when one series is far longer than the others.
    """
    if fits_one_task(max_rows):
        in_sample = F.when(F.col("sample_type") == "in", F.col("time_index"))
        return ts.withColumn(
            "max_time", F.max(in_sample).over(Window.partitionBy("series_id"))
        ).where(F.col("max_time").isNotNull())
    return ts.join(shuffled(max_time(ts)), "series_id")


def unified_axis(ts: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Number the out-of-sample rows on from the last in-sample row."""
    new_time_index = F.when(F.col("sample_type") == "in", F.col("time_index")).otherwise(
        F.col("max_time") + F.col("time_index") + 1
    )
    return with_max_time(ts, max_rows).select(
        "series_id", "sample_type", "time_index", new_time_index.alias("new_time_index"), "tourism"
    )


def seasonal_lags(ts: DataFrame, max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    lagged = with_lags(
        unified_axis(ts, max_rows), [12, 4, 1], order="new_time_index", max_rows=max_rows, chunk_rows=chunk_rows
    )
    return lagged.select(
        "series_id",
        "sample_type",
        "new_time_index",
        "tourism",
        F.get("lags", F.lit(0)).alias("lag_12"),
        F.get("lags", F.lit(1)).alias("lag_4"),
        F.get("lags", F.lit(2)).alias("lag_1"),
    )


def scale_factor(
    ts: DataFrame,
    in_sample_only: bool = False,
    max_rows: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean absolute seasonal-naive error per series.

    By default it runs over in-sample and out-of-sample rows together. Only the order on the
    joined axis matters here, and `in` rows come first, so no look-up of max_time is needed.
    """
    is_in = F.col("sample_type") == "in"
    if in_sample_only:
        ts = ts.where(is_in)
    ordered = ts.select(
        "series_id",
        "tourism",
        is_in.alias("is_in"),
        (F.when(is_in, 0).otherwise(1 << 32).cast("long") + F.col("time_index")).alias("axis"),
    )
    lagged = with_lags(ordered, [12, 4, 1], order="axis", max_rows=max_rows, chunk_rows=chunk_rows)
    column = {freq: F.get("lags", F.lit([12, 4, 1].index(lag))) for freq, lag in SEASON_LAGS.items()}
    seasonal = by_frequency(F.col("series_id"), column)
    return (
        lagged.groupBy("series_id")
        .agg(F.avg(F.abs(F.col("tourism") - seasonal)).alias("error"), F.max("is_in").alias("has_in"))
        .where("has_in")
        .select("series_id", "error")
    )
