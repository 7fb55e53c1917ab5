"""Joins of wide rows with narrow lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.sources.tables import staged

BROADCAST_ROWS = 1 << 20


def checked(narrow: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of keys: marked for broadcast if it has at most `most` rows, else left to a shuffle."""
    return F.broadcast(narrow) if narrow.count() <= most else narrow


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` whose key is not in `dropped`, with their columns. Rows with a null key stay."""
    keys = checked(staged(dropped.select(key).distinct(), "dropped"))
    return docs.join(keys, key, "left_anti").select(*docs.columns)
