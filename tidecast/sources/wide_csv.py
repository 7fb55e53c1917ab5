"""Wide CSV files, one column per series and one line per time step, to long rows.

Large files are read in splits. A line's number is the count of lines in the earlier parts and splits
of its file plus its place in its own split, so no file has to pass through one task.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions.expressions import metadata_rows
from tidecast.sources.tables import staged

# `<series type>_<sample type>.csv`, either a file or a folder of part files.
FILE_NAME = r"([^/_]+)_([^/_.]+)\.csv$"


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_number, line) of all non-blank lines; the header is line 0 of its file.

    A folder counts as one file made of its part files in the order of their names. A part that begins
    with the folder's header again continues after it. The lines are stored with their places first,
    since two scans need not number them alike.
    """
    lines = (
        spark.read.text(paths)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .where(F.trim("value") != "")
        .select(
            F.regexp_extract("file_path", r"^(.*?\.csv)(/[^/]*)?$", 1).alias("path"),
            F.col("file_path").alias("part"),
            F.col("file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").alias("line"),
        )
    )
    lines = staged(lines, "lines")
    # One row per split. A split is read by one task in order, so its places are consecutive.
    splits = lines.groupBy("path", "part", "split").agg(
        F.min("place").alias("first_place"), F.count(F.lit(1)).alias("size"), F.min_by("line", "place").alias("first_line")
    )
    in_order = Window.partitionBy("path").orderBy("part", "split")
    first_of_part = F.row_number().over(Window.partitionBy("path", "part").orderBy("split")) == 1
    again = first_of_part & (F.row_number().over(in_order) > 1) & (F.col("first_line") == F.first("first_line").over(in_order))
    splits = splits.withColumn("skipped", again.cast("int"))
    splits = splits.withColumn(
        "lines_before", F.sum(F.col("size") - F.col("skipped")).over(in_order) - F.col("size") + F.col("skipped")
    )
    place = F.col("place") - F.col("first_place") - F.col("skipped")
    return (
        lines.join(splits.drop("first_line", "size"), ["path", "part", "split"])
        .where(place >= 0)
        .select("path", (F.col("lines_before") + place).alias("line_number"), "line")
    )


def read_wide_csv(spark: SparkSession, paths: list[str], metadata: str = "strip") -> DataFrame:
    """Long rows (series_id, sample_type, time_index, tourism) of all files together.

    `metadata="strip"` leaves out the describing rows at the top of each file and numbers the
    observations from 0; `"keep"` loads every row. Empty and NaN cells are left out, the numbering
    keeps their place.
    """
    if metadata not in ("strip", "keep"):
        raise ValueError(f"metadata must be 'strip' or 'keep', not {metadata!r}")
    lines = numbered_lines(spark, paths)
    cells = lines.select(
        "path", "line_number", F.posexplode(F.split("line", ",", -1)).alias("column", "cell")
    )
    header = cells.where("line_number = 0").select(
        "path", "column", F.lower(_unquoted(F.col("cell"))).alias("series_id")
    )
    values = (
        cells.where("line_number > 0")
        .select(
            "path",
            "column",
            (F.col("line_number") - 1).cast("int").alias("time_index"),
            _unquoted(F.col("cell")).try_cast("double").alias("tourism"),
        )
        .where(F.col("tourism").isNotNull() & ~F.isnan("tourism"))
    )
    skipped = metadata_rows(F.col("series_id")) if metadata == "strip" else F.lit(0)
    return (
        values.join(header, ["path", "column"])
        .select(
            "series_id",
            F.lower(F.regexp_extract("path", FILE_NAME, 2)).alias("sample_type"),
            (F.col("time_index") - skipped).cast("int").alias("time_index"),
            "tourism",
        )
        .where("time_index >= 0")
    )


def _unquoted(cell: Column) -> Column:
    return F.btrim(F.trim(cell), F.lit('"'))


def unpivot_wide(wide: DataFrame, time_column: str, sample_type: str) -> DataFrame:
    """Long rows of a wide table already in Spark; NULL and NaN cells are left out."""
    series = [c for c in wide.columns if c != time_column]
    return (
        wide.select(F.col(time_column).cast("int").alias("time_index"), *[F.col(c).cast("double") for c in series])
        .unpivot(["time_index"], series, "series_id", "tourism")
        .where(F.col("tourism").isNotNull() & ~F.isnan("tourism"))
        .select(
            F.lower("series_id").alias("series_id"),
            F.lit(sample_type).alias("sample_type"),
            "time_index",
            "tourism",
        )
    )
