"""Medians from mergeable sketches, for tables where the exact ones cost too much.

A sketch of a group's values has a size that depends on `k` alone. Sketches can be stored and merged, so
appended rows need only their own. The median of a sketch has a rank off by at most RANK_ERROR[k] of the
group's rows, at a confidence of 99 %; a group of at most k values is kept whole and has an exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.sources.tables import shuffled

# Normalised rank errors of KLL sketches of some sizes, as published with them.
RANK_ERROR = {200: 0.0133, 800: 0.0037, 3200: 0.0010}


def _kept(column: str):
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def median_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = 800) -> DataFrame:
    """One row per group with a sketch of each column; NULL and NaN are left out."""
    if k not in RANK_ERROR:
        raise ValueError(f"k must be one of {sorted(RANK_ERROR)}, not {k!r}")
    return df.groupBy(*keys).agg(*[F.kll_sketch_agg_double(_kept(c), F.lit(k)).alias(c) for c in columns])


def merge_sketches(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = 800) -> DataFrame:
    """One row per group from the rows of several sketch tables, as of their rows together."""
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in columns])


def sketched_medians(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The median of each sketch; NULL where a group had no value."""

    def median(column):
        some = F.kll_sketch_get_n_double(column) > 0
        return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(column)), F.lit(0.5))).alias(column)

    return sketches.select(*keys, *[median(c) for c in columns])


def rank_errors(df: DataFrame, medians: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, rows, error): how far the middle rank lies from the ranks that equal a group's median.

    0 where the median is one of the middle values or between them.
    """
    names = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _kept(c).alias("value")) for c in columns]))
    found = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("median")) for c in columns]))
    joined = df.select(*keys, names).where("value is not null").join(
        shuffled(medians.select(*keys, found)), [*keys, "column"]
    )
    ranks = joined.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value") < F.col("median")).alias("below"),
        F.count_if(F.col("value") <= F.col("median")).alias("upto"),
    )
    half = F.col("rows") / 2
    off = F.greatest(F.col("below") - half, half - F.col("upto"), F.lit(0.0))
    return ranks.select(*keys, "column", "rows", (off / F.col("rows")).alias("error"))
