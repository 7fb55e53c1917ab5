"""Monthly-, quarterly- and yearly-like series of supplier sales, derived from `lineitem`."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Days per time step, out-of-sample rows, and the metadata rows heading each out-of-sample part.
LAYOUT = {
    "m": (15, 24, [24.0, 2001.0, 1.0]),
    "q": (45, 8, [8.0, 2001.0, 1.0]),
    "y": (365, 4, [4.0, 2001.0]),
}

# Dates lie between the years 1 and 9999, which bounds the 15-day steps of any one supplier.
MAX_SERIES_ROWS = 3_652_059 // 15 + 1 + 3


ROWS_PER_TASK = 1 << 19
# Line items of one supplier and day are added up in at most so many tasks first.
SPREAD = 16


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Tasks that grow with the rows, so that none of them holds more; all cores for a small table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def sales_series(spark: SparkSession, sf_dir: str, frequencies: str = "mqy") -> DataFrame:
    """The long table. Sales are summed per supplier and day first, in tasks among which a supplier's line
    items are spread, so one with very many line items has a series as short as the others.

    The number of tasks comes from the number of line items, which the files' footers tell.
    """
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    steps = F.array(
        *[
            F.struct(F.lit(freq).alias("freq"), F.floor(F.col("day") / F.lit(LAYOUT[freq][0])).alias("step"))
            for freq in frequencies
        ]
    )
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = tasks_for(spark, items.count())
    sums = (
        items.select("l_suppkey", F.rint(F.col("l_extendedprice") * 100).cast("long").alias("cents"), day.alias("day"))
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        .repartition(tasks, "l_suppkey", "day", "part")
        .groupBy("l_suppkey", "day", "part")
        .agg(F.sum("cents").alias("cents"))
        .repartition(tasks, "l_suppkey")
        .select("l_suppkey", "cents", F.inline(steps))
        .groupBy("l_suppkey", "freq", "step")
        .agg(F.sum("cents").alias("cents"))
        .select(
            F.concat("freq", F.col("l_suppkey").cast("string")).alias("series_id"),
            "freq",
            "step",
            (F.col("cents") / F.lit(100.0)).alias("tourism"),
        )
        .repartition(tasks, "series_id")
    )
    # Placed by series id, so later windows over a series need no further shuffle.
    series = Window.partitionBy("series_id")
    placed = sums.select(
        "series_id",
        "freq",
        "tourism",
        (F.row_number().over(series.orderBy("step")) - 1).alias("pos"),
        F.count(F.lit(1)).over(series).alias("rows"),
    )

    def per_frequency(values):
        chosen = F.lit(None)
        for freq, value in values.items():
            chosen = F.when(F.col("freq") == freq, value).otherwise(chosen)
        return chosen

    oos_rows = per_frequency({f: F.lit(LAYOUT[f][1]) for f in frequencies})
    metadata = per_frequency({f: F.array(*map(F.lit, LAYOUT[f][2])) for f in frequencies})
    oos_pos = F.col("pos") - F.greatest(F.col("rows") - oos_rows, F.lit(0))
    placed = placed.select("series_id", "tourism", "pos", metadata.alias("metadata"), oos_pos.alias("oos_pos"))
    # The first out-of-sample row brings the metadata rows with it.
    own = F.when(F.col("oos_pos") == 0, F.concat("metadata", F.array("tourism"))).otherwise(F.array("tourism"))
    return placed.select(
        "series_id",
        F.when(F.col("oos_pos") < 0, "in").otherwise("oos").alias("sample_type"),
        "pos",
        "oos_pos",
        F.size("metadata").alias("metadata_rows"),
        F.posexplode(own).alias("i", "tourism"),
    ).select(
        "series_id",
        "sample_type",
        F.when(F.col("oos_pos") < 0, F.col("pos"))
        .when(F.col("oos_pos") == 0, F.col("i"))
        .otherwise(F.col("oos_pos") + F.col("metadata_rows"))
        .cast("int")
        .alias("time_index"),
        "tourism",
    )
