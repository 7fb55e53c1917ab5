"""Replacement of missing predictor values by medians."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.expressions import is_finite, parse_number
from tidecast.sources.tables import shuffled, staged


def impute(
    df: DataFrame,
    keys: Sequence[str],
    predictors: Sequence[str],
    target: str,
    predictor_missing: str = "idk",
    target_missing: str = "-",
    parts: int | None = None,
) -> DataFrame:
    """Parse text columns, drop rows without a target, and fill predictors with their group's median.

    The medians cover all rows of a group, also those whose target is missing. Infinite values
    count towards the median and are then replaced by it, as NULL and NaN are. A predictor that a group
    lacks altogether stays NULL; rows with a NULL key form a group.
    """
    keys = list(keys)
    numbers = staged(df.select(
        *[c for c in df.columns if c not in (*predictors, target)],
        parse_number(F.col(target), target_missing).alias(target),
        *[parse_number(F.col(p), predictor_missing).alias(p) for p in predictors],
    ), "numbers")
    medians = exact_medians(numbers, keys, predictors, parts)
    renamed = medians.select(*keys, *[F.col(p).alias(f"_median_{p}") for p in predictors])
    kept = numbers.where(F.col(target).isNotNull() & ~F.isnan(target))
    return _same(kept, renamed, keys).select(
        *[
            F.when(is_finite(F.col(c)), F.col(c)).otherwise(F.col(f"_median_{c}")).alias(c)
            if c in predictors
            else F.col(c)
            for c in df.columns
        ]
    )


def exact_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Exact median of each column per group, NULL and NaN left out; NULL where nothing is left.

    Equal values of a group are counted first, in each task before the shuffle. The counts are stored in
    order, cut into ranges, so a large group lies in several parts; the middle ranks of a group are
    found from the sizes of its parts and then within one part. `parts` asks for a number of ranges.
    """
    keys, columns = list(keys), list(columns)
    groups = df.select(*keys).distinct()
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    values = df.select(*keys, F.inline(names)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = values.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("copies"))
    order = [*keys, "column", "value"]
    ranges = counted.repartitionByRange(parts, *order) if parts else counted.repartitionByRange(*order)
    counted = staged(ranges.withColumn("part", F.spark_partition_id()), "counts")
    whole = Window.partitionBy(*keys, "column")
    parts = counted.groupBy(*keys, "column", "part").agg(F.sum("copies").alias("size"))
    parts = parts.withColumn("n", F.sum("size").over(whole)).withColumn(
        "before", F.sum("size").over(whole.orderBy("part")) - F.col("size")
    )
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = parts.where((F.col("before") <= high) & (F.col("before") + F.col("size") > low)).drop("size")
    ranked = _same(counted, middle, [*keys, "column", "part"])
    last = F.col("before") + F.sum("copies").over(Window.partitionBy(*keys, "column", "part").orderBy("value")) - 1
    ranked = ranked.withColumn("last", last).withColumn("first", F.col("last") - F.col("copies") + 1)
    low_value = F.max(F.when(low.between(F.col("first"), F.col("last")), F.col("value")))
    high_value = F.max(F.when(high.between(F.col("first"), F.col("last")), F.col("value")))
    medians = ranked.groupBy(*keys, "column").agg(((low_value + high_value) / 2).alias("median"))
    medians = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    )
    return _same(groups, medians, keys, "left")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that takes NULL keys as equal."""
    renamed = shuffled(right.withColumnsRenamed({k: f"_right_{k}" for k in keys}))
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
