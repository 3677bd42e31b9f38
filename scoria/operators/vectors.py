"""Exact vector search over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(c: Column) -> Column:
    """The vector at length 1, null if it is null, has a null or no length."""
    norm = F.sqrt(dot(c, c))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm))


def valid(vectors: DataFrame, dimension: int, column: str = "embedding", unit_within: float | None = None) -> DataFrame:
    """Rows whose vector has the dimension, only finite values, and a length above 0 (or within so much of 1)."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    ok = F.when((F.size(column) == dimension) & finite, norm > 0 if unit_within is None else F.abs(norm - 1) <= unit_within)
    return vectors.where(F.coalesce(ok, F.lit(False)))


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", min_score: float | None = None, query_block: int = 512, base_block: int = 4096) -> DataFrame:
    """(query, neighbour, score, rank): the k most similar rows of base for each query by cosine, the query itself left out.

    Exact, in blocks on both sides: each block of queries meets each block of base once, on the executors, and gives the
    best k of that block per query; the best of these are the result. The base is read once, nothing comes to the
    driver, and a task holds one block of either side. Ties go to the smaller id; vectors without length have no
    neighbours; null keys are left out.
    """
    import numpy as np
    import pandas as pd

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), unit(F.col(column)).alias("u")).where("u IS NOT NULL")
        n = max(1, -(-rows.count() // size))
        held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("u")).alias(f"{name}_vectors"))
        return held, n

    asked, _ = blocks(queries, query_block, "q")
    held, n = blocks(base, base_block, "b")
    pairs = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(held, "b")

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                query_ids, found = np.asarray(row.q_ids), np.asarray(row.b_ids)
                m, other = np.asarray(row.q_vectors).reshape(len(query_ids), -1), np.asarray(row.b_vectors).reshape(len(found), -1)
                scores = m @ other.T
                parts = []
                for j, query in enumerate(query_ids):
                    s = np.where(found == query, -np.inf, scores[j])
                    keep = np.lexsort((found, -np.round(s, 9)))[: k + 1]
                    keep = keep[np.isfinite(s[keep])]
                    parts.append(pd.DataFrame({"query": query, "neighbour": found[keep], "score": s[keep]}))
                yield pd.concat(parts)

    kind = base.schema[key].dataType.simpleString()
    best = pairs.select("q_ids", "q_vectors", "b_ids", "b_vectors").mapInPandas(run, f"query {kind}, neighbour {kind}, score double")
    best = best if min_score is None else best.where(F.col("score") >= min_score)
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_symbols(stored: DataFrame | None, built_for: dict | None, queries: DataFrame, base: DataFrame, k: int, min_score: float, key: str = "vec_id") -> DataFrame:
    """The k nearest of each query from a stored table of neighbours if it was built for as many, as low a score and the same rows, else computed.

    `stored` has (query, neighbour, score, rank); `built_for` says k, min_score and rows of its build.
    """
    fits = stored is not None and built_for is not None and built_for["k"] >= k and built_for["min_score"] <= min_score and built_for["rows"] == base.count()
    if not fits:
        return nearest(queries, base, k, key, min_score=min_score)
    return stored.join(queries.select(F.col(key).alias("query")), "query", "left_semi").where((F.col("score") >= min_score) & (F.col("rank") <= k))
