"""Row-order operators: lags, rows still to come, and the last rows of each series.

A window over a whole series puts that series in one task. That is fine when a bound on the series
length is known, so callers pass it as `max_rows`. Without a bound the series is cut by time into
chunks; each chunk is windowed alone and the values missing at its start are brought in from the
ends of the chunks before it. Both ways give the same result.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import CHUNK_ROWS, WHOLE_SERIES_ROWS
from tidecast.sources.tables import shuffled


def fits_one_task(max_rows: int | None) -> bool:
    return max_rows is not None and max_rows <= WHOLE_SERIES_ROWS


def chunk_of(order: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(order) / F.lit(chunk_rows)).cast("long")


def with_lags(
    df: DataFrame,
    offsets: Sequence[int],
    keys: Sequence[str] = ("series_id",),
    order: str = "time_index",
    value: str = "tourism",
    max_rows: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `lags`, the values `offsets` rows earlier, and `future_record_count`.

    Lags go by row position, so a gap in `order` is not filled. `order` must be unique per key.
    """
    if fits_one_task(max_rows):
        return _whole_series(df, offsets, list(keys), order, value)
    return _chunked(df, offsets, list(keys), order, value, chunk_rows)


def _whole_series(df, offsets, keys, order, value):
    by_time = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns(
        {
            "lags": F.array(*[F.lag(value, k).over(by_time) for k in offsets]),
            "future_record_count": F.count(F.lit(1)).over(Window.partitionBy(*keys))
            - F.row_number().over(by_time),
        }
    )


def _chunked(df, offsets, keys, order, value, chunk_rows):
    depth = max(offsets, default=0)
    chunk_keys = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(order, chunk_rows))

    # One row per chunk: at most 32,768 for a series, whatever its length.
    chunks = rows.groupBy(*chunk_keys).agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*keys)
    in_order = whole.orderBy("_chunk")
    chunks = chunks.withColumns(
        {
            "_total": F.sum("_size").over(whole),
            "_chunks": F.count(F.lit(1)).over(whole),
            "_before": F.sum("_size").over(in_order) - F.col("_size"),
        }
    )

    if depth:
        # Last `depth` values of each chunk, newest first; only series with several chunks need them.
        several = chunks.where("_chunks > 1").select(*chunk_keys)
        newest_first = Window.partitionBy(*chunk_keys).orderBy(F.desc(order))
        tails = (
            rows.join(shuffled(several), chunk_keys, "left_semi")
            .select(*chunk_keys, order, value, F.row_number().over(newest_first).alias("_rank"))
            .where(F.col("_rank") <= depth)
            .groupBy(*chunk_keys)
            .agg(F.sort_array(F.collect_list(F.struct("_rank", value))).alias("_tail"))
        )
        earlier = in_order.rowsBetween(-depth, -1)
        halos = tails.select(
            *chunk_keys,
            F.slice(
                F.flatten(F.reverse(F.collect_list(F.col(f"_tail.{value}")).over(earlier))), 1, depth
            ).alias("_halo"),
        )
        chunks = chunks.join(shuffled(halos), chunk_keys, "left")
    else:
        chunks = chunks.withColumn("_halo", F.lit(None).cast("array<double>"))

    by_time = Window.partitionBy(*chunk_keys).orderBy(order)
    rows = rows.withColumns(
        {
            "_near": F.array(*[F.lag(value, k).over(by_time) for k in range(1, depth + 1)]).cast(
                "array<double>"
            ),
            "_rank": F.row_number().over(by_time),
        }
    ).join(shuffled(chunks), chunk_keys)
    # _rank - 1 lags lie inside the chunk, the further ones in the halo.
    lags = F.when(
        F.col("_halo").isNotNull() & (F.col("_rank") <= depth),
        F.concat(F.slice("_near", 1, F.col("_rank") - 1), "_halo"),
    ).otherwise(F.col("_near"))
    return (
        rows.withColumn("_all", lags)
        .withColumns(
            {
                "lags": F.array(*[F.get("_all", F.lit(k - 1)) for k in offsets]).cast("array<double>"),
                "future_record_count": F.col("_total") - F.col("_before") - F.col("_rank"),
            }
        )
        .select(*df.columns, "lags", "future_record_count")
    )


def last_rows(df: DataFrame, count: int, keys: Sequence[str] = ("series_id",), order: str = "time_index") -> DataFrame:
    """The last `count` rows per key with their `rank` from the end (1 = last).

    Spark drops all but `count` rows per key before the shuffle, so a long series costs no more
    than a short one.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("rank", F.row_number().over(newest_first)).where(F.col("rank") <= count)
