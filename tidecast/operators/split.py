"""Assignment of training rows to train / holdout and to cross-validation folds.

It depends on the row's key alone, so it is the same on every run and any number of partitions.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _row_hash(series_id: Column, observation_id: Column) -> Column:
    return F.md5(F.concat_ws("|", series_id, observation_id.cast("string")))


def purpose(series_id: Column, observation_id: Column) -> Column:
    """`validation` for a quarter of the rows, else `train`."""
    held_out = F.substring(_row_hash(series_id, observation_id), 1, 2) >= "c0"
    return F.when(held_out, "validation").otherwise("train")


def fold(series_id: Column, observation_id: Column, folds: int) -> Column:
    """Fold 0..folds-1 of a train row, -1 for a validation row."""
    digits = F.conv(F.substring(_row_hash(series_id, observation_id), 3, 4), 16, 10).cast("int")
    return (
        F.when(purpose(series_id, observation_id) == "validation", -1).otherwise(digits % folds).cast("int")
    )
