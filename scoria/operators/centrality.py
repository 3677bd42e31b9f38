"""PageRank, sampled betweenness and connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoria.plans.runtime import checkpointed

#: The damping factor, the number of rounds and the grain that scores are rounded to.
DAMPING, ROUNDS, GRAIN = 0.85, 40, 9


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, write_every: int = 2) -> DataFrame:
    """(node, pagerank) after a fixed number of rounds; scores sum up to 1.

    Repeated edges count as often as they come; a node without outgoing edges spreads its score over all. Edges to or
    from other nodes are left out. Contributions are summed inside each task before they are shuffled.
    """
    nodes = nodes.select("node").where(F.col("node").isNotNull()).distinct()
    inner = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    weights = checkpointed(inner.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))
    out = weights.groupBy(F.col("source").alias("node")).agg(F.sum("n").alias("out"))
    state = checkpointed(nodes.join(out, "node", "left"))
    n = state.count()
    if not n:
        return state.select("node", F.lit(None).cast("double").alias("pagerank"))
    kept, state = state, state.withColumn("score", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        loose = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0)).alias("x")).scalar()
        given = state.where("out IS NOT NULL").select(F.col("node").alias("source"), (F.col("score") / F.col("out")).alias("share")).join(weights, "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col("n")).alias("given"))
        state = state.join(given, "node", "left").select("node", "out", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("given", F.lit(0.0)) + loose / n)).alias("score"))
        if i % write_every == 0 or i == rounds:
            state = checkpointed(state, kept)
            kept = state
    return state.select("node", F.round("score", GRAIN).alias("pagerank"))


#: The seed of the sample of sources, and the constants of the mulberry32 generator.
SAMPLE_SEED, STEP, SHIFTS, MIX = 0xC0DE2026, 0x6D2B79F5, (15, 7, 14), 61


def sample_positions(n: int, k: int, seed: int = SAMPLE_SEED) -> list[int]:
    """k of the positions 0 .. n - 1 by the first k steps of a shuffle, all if k is 0 or n at least; equal for equal arguments."""
    if k == 0 or k >= n:
        return list(range(n))
    word, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    moved: dict[int, int] = {}
    out = []
    for i in range(k):
        state = (state + STEP) & word
        x = ((state ^ state >> SHIFTS[0]) * (state | 1)) & word
        x ^= (x + ((x ^ x >> SHIFTS[1]) * (x | MIX))) & word
        j = i + ((x ^ x >> SHIFTS[2]) * (n - i) >> 32)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def sample_sources(nodes: DataFrame, k: int = 200, seed: int = SAMPLE_SEED) -> DataFrame:
    """(node): the nodes at sample_positions in the order of their ids.

    Ids are sorted in ranges; a node's position is its place in its range and the sizes of the ranges before, so no task
    sees all of them.
    """
    once = nodes.select("node").where(F.col("node").isNotNull()).distinct()
    ranges = checkpointed(once.repartitionByRange("node").withColumn("part", F.spark_partition_id()))
    # One row per partition.
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = ranges.count()
    wanted = nodes.sparkSession.createDataFrame([(p,) for p in sample_positions(total, k, seed)], "at long") if total > k else None
    placed = ranges.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1).join(F.broadcast(before), "part").select("node", (F.col("place") + F.col("before")).alias("at"))
    return placed.select("node") if wanted is None else placed.join(F.broadcast(wanted), "at").select("node")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, betweenness) from shortest paths out of the given sources (column node), scaled to all nodes.

    All sources are walked at once, level by level: path counts are summed forward over (source, node) rows, and
    dependencies backward. With all nodes as sources the result is exact. Two nodes or fewer have 0.
    """
    nodes = checkpointed(nodes.select("node").where(F.col("node").isNotNull()).distinct())
    n, k = nodes.count(), sources.select("node").distinct().count()
    step = checkpointed(edges.select("source", "target").where(F.col("source") != F.col("target")).distinct())
    level = checkpointed(sources.select(F.col("node").alias("s"), "node").distinct().withColumn("paths", F.lit(1.0)))
    # What was reached is one scan over the levels' tables, however many there are.
    together = lambda states: nodes.sparkSession.read.schema(states[0].schema).parquet(*[x._scoria_path for x in states])
    levels = [level]
    while True:
        found = level.join(step, F.col("node") == F.col("source")).groupBy("s", F.col("target").alias("node")).agg(F.sum("paths").alias("paths"))
        level = checkpointed(found.join(together(levels).select("s", "node"), ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    after = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("dep"))
    states = []
    for level in reversed(levels[:-1]):
        part = level.join(step, F.col("node") == F.col("source")).select("s", "node", "paths", "target").alias("a").join(after.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.target") == F.col("b.node"))).groupBy("a.s", "a.node").agg(F.sum(F.col("a.paths") / F.col("b.paths") * (1 + F.col("b.dep"))).alias("dep"))
        after = checkpointed(level.join(part, ["s", "node"], "left").select("s", "node", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")))
        states.append(after)
    if not states or n <= 2:
        return nodes.withColumn("betweenness", F.lit(0.0))
    # The last level passes nothing on; sources don't count for themselves.
    total = together(states)
    scale = n / k / ((n - 1) * (n - 2))
    sums = total.where(F.col("s") != F.col("node")).groupBy("node").agg(F.sum("dep").alias("dep"))
    return nodes.join(sums, "node", "left").select("node", F.round(F.greatest(F.lit(0.0), F.coalesce(F.col("dep") * scale, F.lit(0.0))), GRAIN).alias("betweenness"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node linked to it, directly or through others.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so chains halve;
    neighbours' labels are combined inside each task, so a hub is no bottleneck. Null ends link nothing.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = kept = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = state.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jumped = step.join(state.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        kept = checkpointed(jumped, kept)
        done = kept.where(F.col("old") != F.col("label")).isEmpty()
        state = kept.select("node", "label")
        if done:
            return state.select("node", F.col("label").alias("component"))
