"""Joins that a hot key does not hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join with right, one row a key, that tells in `rows` how many rows of left the key has. The keys that hold a HOT-th of all rows, at most HOT of them, are sent to the tasks; the rest is shuffled. Keys are not null."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(rows) * HOT >= total))
    cold = left.join(F.broadcast(right.where(F.col(rows) * HOT >= total).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(cold.join(right.where(F.col(rows) * HOT < total), keys))
