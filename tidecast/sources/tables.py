"""Stored tables: reading, appending, and staging of intermediate results."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast import schemas


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run a query over DataFrames named in it as `{name}`."""
    return spark.sql(sql, **tables)


def append_time_series(rows: DataFrame, path: str) -> None:
    """Append long rows, one folder per sample type. Rows of a series end up near each other."""
    (
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TIME_SERIES])
        .withColumn("sample_type", F.lower("sample_type"))
        .repartitionByRange("series_id", "sample_type", "time_index")
        .sortWithinPartitions("sample_type", "series_id", "time_index")
        .write.mode("append")
        .partitionBy("sample_type")
        .parquet(path)
    )


def read_time_series(spark: SparkSession, path: str) -> DataFrame:
    columns = [f.name for f in schemas.TIME_SERIES]
    return read_table(spark, path, schemas.TIME_SERIES).select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names, or else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidecast/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged, when its results are no longer read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join of two tables that both grow with the input, so that neither is broadcast.

    Spark judges a stored table by the size of its files. Series ids, counts and coefficients take many times
    that as rows, and the driver would hold all of them.
    """
    return df.hint("merge")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and continue from the stored copy."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
