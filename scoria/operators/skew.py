"""Aggregation per key when a few keys hold most rows (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """Lower case without blanks around."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def edge_aggregates(edges: DataFrame) -> DataFrame:
    """(target_symbol_id, edge_kind, edges, sites, max_confidence), one row per pair.

    Map-side combining throughout: the first aggregate folds repeated rows into one state per distinct
    (source, target, kind), whose keys are spread evenly however hot a target is; the second folds these states
    into partial (target, kind) states inside each task, so that a hot pair shuffles one compact row per task.
    Defined cases: rows with a null target count nowhere; null sources and kinds are values of their own; of an
    edge delivered more than once the largest site count and confidence hold, nulls only where all are null; an empty
    table gives no rows.
    """
    clean = edges.select(canonical(F.col("source_symbol_id")).alias("s"), canonical(F.col("target_symbol_id")).alias("t"), canonical(F.col("edge_kind")).alias("k"), "site_count", "confidence").where(F.col("t").isNotNull())
    one = clean.groupBy("s", "t", "k").agg(F.max("site_count").alias("sites"), F.max("confidence").alias("confidence"))
    pairs = one.groupBy("t", "k").agg(F.count(F.lit(1)).alias("edges"), F.sum("sites").alias("sites"), F.max("confidence").alias("max_confidence"))
    return pairs.select(F.col("t").alias("target_symbol_id"), F.col("k").alias("edge_kind"), "edges", "sites", "max_confidence")


def heavy_pairs(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """The rows of edge_aggregates that hold at least `share` of all distinct edges."""
    pairs = edge_aggregates(edges)
    total = pairs.agg(F.sum("edges").alias("n"))
    # The total is a scalar subquery: one row, not a join side that could grow.
    return pairs.where(F.col("edges") / total.scalar() >= F.lit(share))
