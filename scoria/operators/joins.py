"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, hot_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Inner join of left with right, which has one row per key and, in `weight`, the number of left rows of that key.

    Keys of more than max(hot_rows, total / 1000) left rows are hot. There are fewer than 1,000 of them, whatever the
    size of the data, so their set is broadcast; their left rows are spread over `salts` tasks and only their right
    rows are repeated. Null keys never match. The salt depends on the row alone, so that a lost task repeats exactly.
    """
    total = right.agg(F.sum(weight).alias("n")).scalar()
    hot = F.broadcast(right.where(F.col(weight) > F.greatest(F.lit(hot_rows), total / 1000)).select(F.col(key).alias("__hot")))
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(salts)).cast("int")
    a = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(0))).drop("__hot")
    flagged = right.withColumn("__is_hot", F.col(weight) > F.greatest(F.lit(hot_rows), total / 1000))
    b = flagged.withColumn("__salt", F.explode(F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__is_hot")
    return a.join(b, [key, "__salt"]).drop("__salt")
