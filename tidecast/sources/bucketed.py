"""Tables whose rows lie by series: joins and windows over a series then need no shuffle, and one series is
found in one bucket's files.

A row's bucket is a hash of its series id, so the number of buckets should grow with the table: a bucket
is read by one task. Within a file rows are in order, and a Bloom filter and the ranges of row groups skip
what a filter on the id does not ask for.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = "series_id"
ORDER = ("series_id", "time_index")
BUCKET_ROWS = 1 << 22


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets for a table of so many rows; a power of two, so that tables of different sizes still match."""
    return 1 << max(3, (max(1, rows) // bucket_rows).bit_length())


def co_located_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster and catalog that joins on further columns inside a bucket.

    By default a join on series and time is shuffled by both even where the rows already lie by series.
    """
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session


def write_bucketed(
    rows: DataFrame, path: str, buckets: int, order: Sequence[str] = ORDER, mode: str = "errorifexists"
) -> str:
    """Write rows by series id under `path` and give the name of the table. Each bucket gets one file.

    With mode="append" the rows join a table already there, which must have the same buckets and order.
    """
    name = table_name(path)
    if mode == "append":
        declare_bucketed(rows.sparkSession, path, rows.schema, buckets, order)
    (
        rows.repartition(buckets, KEY)
        .write.format("parquet")
        .mode(mode)
        .bucketBy(buckets, KEY)
        .sortBy(*order)
        .option("path", path)
        .option(f"parquet.bloom.filter.enabled#{KEY}", "true")
        .option("parquet.block.size", str(16 << 20))
        .saveAsTable(name)
    )
    return name


def table_name(path: str) -> str:
    """A table's name follows from its path, so that every session finds it again."""
    return f"tidecast_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def declare_bucketed(
    spark: SparkSession, path: str, schema: StructType, buckets: int, order: Sequence[str] = ORDER
) -> str:
    """Make a bucketed table known to a session that did not write it; its files stay as they are."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        kept = ", ".join(order)
        location = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (`parquet.bloom.filter.enabled#{KEY}` 'true') "
            f"CLUSTERED BY ({KEY}) SORTED BY ({kept}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
    return name


def one_series(rows: DataFrame, series_id: str) -> DataFrame:
    """The rows of one series in any letter case. Ids are stored in lower case, so the filter names a bucket."""
    return rows.where(F.col(KEY) == series_id.lower())
