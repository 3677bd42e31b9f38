"""Parent-child links to full hierarchies (problem 2).

All steps are joins and aggregates over (tree, node) keys; no tree is collected into one task. Pointer doubling
separates cycles and sums subtree sizes in log(depth) rounds; the heavy child of each node (largest subtree) links the
nodes into chains, any root path crosses at most log(n) of them, and paths, depths and descendants follow from chain
segments and chain intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.operators.prefix import group_prefix_sum
from scoria.plans.runtime import checkpointed

KEY = ["g", "node"]


def tree_nodes(links: DataFrame, group: str = "project_id", parent: str = "parent", child: str = "child") -> DataFrame:
    """(g, node, par): each name of a link once, with its parent or null.

    A null child or parent names nothing; a null group is ignored; repeated links count once; of several parents the
    smallest name is kept.
    """
    g, p, c = (F.col(x) for x in (group, parent, child))
    both = links.where(g.isNotNull()).select(g.alias("g"), F.explode(F.array(F.struct(c.alias("node"), p.alias("par")), F.struct(p.alias("node"), F.lit(None).cast("string").alias("par")))).alias("x")).select("g", "x.node", "x.par")
    return both.where(F.col("node").isNotNull()).groupBy(*KEY).agg(F.min("par").alias("par"))


def _lookup(left: DataFrame, ptr: str, right: DataFrame, columns: list[str]) -> DataFrame:
    """left with `columns` of right (renamed __x) found at (g, left.ptr); AQE splits a pointer that many rows share."""
    there = right.select(F.col("g").alias("__g"), F.col("node").alias("__n"), *[F.col(c).alias(f"__{c}") for c in columns])
    return left.join(there, (F.col("g") == F.col("__g")) & (F.col(ptr) == F.col("__n")), "left").drop("__g", "__n")


def _sizes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, node, par, size) of the nodes that reach a root, and (g, node, on_cycle) of the others.

    After round k `anc` is the ancestor 2^k steps up (null beyond the root) and `size` counts the descendants nearer
    than 2^k steps. A round that resolves no node leaves those on or below cycles; among them the images of the
    pointers shrink until only the cycles' own nodes are left.
    """
    state = checkpointed(nodes.select(*KEY, "par", F.col("par").alias("anc"), F.lit(1).cast("long").alias("size")))
    left = state.where("anc IS NOT NULL").count()
    while left:
        active = state.where("anc IS NOT NULL")
        sums = active.groupBy("g", "anc").agg(F.sum("size").alias("more")).withColumnRenamed("anc", "node")
        up = _lookup(active.select(*KEY, "anc"), "anc", active, ["anc"]).select(*KEY, F.col("__anc").alias("next"))
        state = checkpointed(state.join(sums, KEY, "left").join(up, KEY, "left").select(*KEY, "par", F.col("next").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), state)
        now = state.where("anc IS NOT NULL").count()
        if now == left:
            break
        left = now
    forest = state.where("anc IS NULL").select(*KEY, "par", "size")
    rest = checkpointed(state.where("anc IS NOT NULL").select(*KEY, "anc"))
    images, before = rest.select("g", F.col("anc").alias("node")).distinct(), -1
    while left and (n := images.count()) != before:
        before = n
        rest = checkpointed(_lookup(rest, "anc", rest, ["anc"]).select(*KEY, F.col("__anc").alias("anc")), rest)
        images = rest.select("g", F.col("anc").alias("node")).distinct()
    cyclic = rest.select(*KEY).join(images.withColumn("hit", F.lit(True)), KEY, "left").select(*KEY, F.col("hit").isNotNull().alias("on_cycle"))
    return forest, cyclic


def _jump(df: DataFrame) -> DataFrame:
    """(g, node, ptr, dist) with ptr moved to the end of its chain of pointers and dist summed on the way.

    A row with ptr = node is an end. A row whose target has arrived arrives with it, so rounds are log(length).
    """
    state = checkpointed(df.withColumn("done", F.col("ptr") == F.col("node")))
    while not state.where(~F.col("done")).isEmpty():
        moved = _lookup(state.where(~F.col("done")), "ptr", state, ["ptr", "dist", "done"])
        moved = moved.select(*KEY, F.col("__ptr").alias("ptr"), (F.col("dist") + F.col("__dist")).alias("dist"), F.col("__done").alias("done"))
        state = checkpointed(state.where("done").unionByName(moved), state)
    return state.drop("done")


@dataclass
class Hierarchy:
    """nodes: (g, node, par, size, heavy, head, off), off being the steps from the chain's head; chains: (g, node, root, base), node being a head and base the depth of it; cyclic: (g, node, on_cycle)."""

    nodes: DataFrame
    chains: DataFrame
    cyclic: DataFrame


def heavy_paths(links: DataFrame, group: str = "project_id", parent: str = "parent", child: str = "child") -> Hierarchy:
    """The heavy-path decomposition of all trees among the links, cycles and what hangs from them set apart."""
    forest, cyclic = _sizes(tree_nodes(links, group, parent, child))
    # Largest subtree first, the smallest name among equals. Aggregates keep a parent of very many children cheap.
    heavy = forest.where("par IS NOT NULL").groupBy("g", "par").agg(F.min(F.struct(-F.col("size"), "node")).alias("x")).select("g", "x.node", F.lit(True).alias("heavy"))
    marked = checkpointed(forest.join(heavy, KEY, "left").select(*KEY, "par", "size", F.coalesce("heavy", F.lit(False)).alias("heavy")))
    tops = _jump(marked.select(*KEY, F.when(F.col("heavy"), F.col("par")).otherwise(F.col("node")).alias("ptr"), F.col("heavy").cast("long").alias("dist")))
    nodes = checkpointed(marked.join(tops, KEY).select(*KEY, "par", "size", "heavy", F.col("ptr").alias("head"), F.col("dist").alias("off")))
    heads = nodes.where(~F.col("heavy")).select(*KEY, "par")
    hung = _lookup(heads, "par", nodes, ["head", "off"]).select(*KEY, F.coalesce("__head", "node").alias("ptr"), F.coalesce(F.col("__off") + 1, F.lit(0)).cast("long").alias("dist"))
    chains = _jump(hung).select(*KEY, F.col("ptr").alias("root"), F.col("dist").alias("base"))
    return Hierarchy(nodes, chains, cyclic)


def roots_and_depths(h: Hierarchy) -> DataFrame:
    """(g, node, root, depth): root '' with depth -1 on a cycle and -2 below one."""
    placed = _lookup(h.nodes, "head", h.chains, ["root", "base"]).select(*KEY, F.col("__root").alias("root"), (F.col("__base") + F.col("off")).cast("int").alias("depth"))
    apart = h.cyclic.select(*KEY, F.lit("").alias("root"), F.when(F.col("on_cycle"), -1).otherwise(-2).cast("int").alias("depth"))
    return placed.unionByName(apart)


def paths(h: Hierarchy) -> DataFrame:
    """(g, node, root, depth, path): path is the array of names from the root to the node, null on or below cycles.

    Chain segments are concatenated level by level (at most log2 of the tree's size levels). A segment is as long as
    the path of its last node, so no row is larger than rows of the result.
    """
    segment = h.nodes.groupBy("g", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "node"))), lambda x: x["node"]).alias("names"))
    tops = _lookup(h.nodes.where(~F.col("heavy")).select(*KEY, "par"), "par", h.nodes, ["head", "off"])
    chain = checkpointed(tops.join(segment.withColumnRenamed("head", "node"), KEY).select(*KEY, F.col("__head").alias("up"), F.col("__off").alias("at"), "names"))
    level = chain.where("up IS NULL").select(*KEY, F.array().cast("array<string>").alias("prefix"), "names")
    whole = level
    rest = chain.where("up IS NOT NULL")
    while not rest.isEmpty():
        found = _lookup(rest, "up", level, ["prefix", "names"]).where("__names IS NOT NULL")
        level = checkpointed(found.select(*KEY, F.concat("__prefix", F.slice("__names", F.lit(1), F.col("at").cast("int") + 1)).alias("prefix"), "names"))
        whole = whole.unionByName(level)
        rest = checkpointed(rest.join(level.select(*KEY), KEY, "left_anti"), rest)
    full = _lookup(h.nodes.select(*KEY, "head", "off"), "head", whole, ["prefix", "names"]).select(*KEY, F.concat("__prefix", F.slice("__names", F.lit(1), F.col("off").cast("int") + 1)).alias("path"))
    return roots_and_depths(h).join(full, KEY, "left")


def intervals(h: Hierarchy) -> DataFrame:
    """(g, node, root, first, last): the descendants of a node are the nodes of its root at places in first..last, itself at first.

    Depth-first order with the heavy child first, so the nodes of a chain are neighbours. Places of light siblings
    come from block-wise running totals: a parent of very many children is never summed in one task. Nodes on or
    below cycles have none.
    """
    light = h.nodes.where(~F.col("heavy") & F.col("par").isNotNull()).select(*KEY, "par", "size")
    shifted = group_prefix_sum(light, ["g", "par"], [], [F.col("node")], F.col("size"), "earlier")
    heavy_size = h.nodes.where("heavy").select("g", F.col("par").alias("node"), F.col("size").alias("heavy_size"))
    start = _lookup(shifted, "par", h.nodes, ["head", "off"])
    start = _lookup(start, "par", heavy_size, ["heavy_size"])
    hung = start.select(*KEY, F.col("__head").alias("ptr"), (F.col("__off") + 1 + F.coalesce("__heavy_size", F.lit(0)) + F.col("earlier")).cast("long").alias("dist"))
    roots = h.nodes.where("par IS NULL").select(*KEY, F.col("node").alias("ptr"), F.lit(0).cast("long").alias("dist"))
    heads = _jump(roots.unionByName(hung))
    placed = _lookup(h.nodes, "head", heads, ["ptr", "dist"])
    first = F.col("__dist") + F.col("off")
    return placed.select(*KEY, F.col("__ptr").alias("root"), first.alias("first"), (first + F.col("size") - 1).alias("last"))


def descendants(h: Hierarchy, stretch: int = 4096) -> DataFrame:
    """(g, node, descendant, distance): every pair of a node and a node below it; as many rows as the result has.

    The descendants of a node are an interval of the places of its root. Intervals are cut into stretches, whose places
    are looked up one by one; a place is asked for once by each node above it, so no place is hotter than the tree is
    deep.
    """
    at = checkpointed(intervals(h).join(roots_and_depths(h).select(*KEY, "depth"), KEY))
    starts = at.where(F.col("last") > F.col("first")).select(*KEY, "root", "last", F.col("depth").alias("__top"), F.explode(F.sequence(F.col("first") + 1, F.col("last"), F.lit(stretch).cast("long"))).alias("from"))
    asked = starts.select(*KEY, "root", "__top", F.explode(F.sequence("from", F.least("last", F.col("from") + stretch - 1))).alias("place"))
    there = at.select("g", "root", F.col("first").alias("place"), F.col("node").alias("descendant"), "depth")
    return asked.join(there, ["g", "root", "place"]).select("g", "node", "descendant", (F.col("depth") - F.col("__top")).alias("distance"))
