"""Running totals within groups of any size, without putting a whole group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of more than a row in so many are spread, so that there are fewer of them than this.
SPREAD = 10_000


def group_prefix_sum(df: DataFrame, keys: list[str], blocks: list[Column], order: list[Column], value: Column, out: str, rows_per_block: int = 20_000) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that come before this one.

    The order within a group is by `blocks` (columns of few values), then by a hash block, then by `order`. Only groups
    of more than max(rows_per_block, rows / 10,000) rows have more than one hash block, about one for so many rows;
    there are fewer than 10,000 such groups whatever the size of the data, so their list is broadcast. Every hash block
    is summed on its own; the totals of the hash blocks of one (group, block), at most 10,000, are summed in order, then
    those of a group's blocks. No step sees a whole group. Null keys form a group of their own; null values count as 0;
    an empty table gives an empty table.
    """
    names = [f"__block_{i}" for i in range(len(blocks))]
    size = max(rows_per_block, -(-df.count() // SPREAD))
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size)
    big = F.broadcast(big.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.ceil(F.col("__n") / size).alias("__salts")))
    same = lambda a, b: reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])
    known = df.join(big, same([df[c] for c in keys], [big[f"__k{i}"] for i in range(len(keys))]), "left").drop(*[f"__k{i}" for i in range(len(keys))])
    salted = known.withColumns(dict(zip(names, blocks, strict=True)) | {"__salt": F.pmod(F.xxhash64(*order), F.coalesce("__salts", F.lit(1))), "__value": F.coalesce(value, F.lit(0))}).drop("__salts")
    level, part = [*keys, *names], [*keys, *names, "__salt"]
    before = lambda by, order_: F.coalesce(F.sum("__total").over(Window.partitionBy(*by).orderBy(*order_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = salted.groupBy(*part).agg(F.sum("__value").alias("__total"))
    starts = totals.withColumn("__inside", before(level, ["__salt"]))
    if names:
        upper = totals.groupBy(*level).agg(F.sum("__total").alias("__total")).withColumn("__start", before(keys, names)).drop("__total")
        upper = upper.select(*[F.col(c).alias(f"__u{i}") for i, c in enumerate(level)], "__start")
        starts = starts.join(upper, same([starts[c] for c in level], [upper[f"__u{i}"] for i in range(len(level))])).withColumn("__inside", F.col("__inside") + F.col("__start"))
    starts = starts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(part)], "__inside")
    inner = F.sum("__value").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    local = salted.withColumn("__local", F.coalesce(inner, F.lit(0)))
    return local.join(starts, same([local[c] for c in part], [starts[f"__s{i}"] for i in range(len(part))])).select(*[local[c] for c in df.columns], (F.col("__inside") + F.col("__local")).alias(out))
