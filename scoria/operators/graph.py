"""Generation-fenced scans and graph traversal over symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.operators.skew import canonical
from scoria.operators.snapshots import latest_rows
from scoria.plans.runtime import bounded_broadcast, checkpointed

#: The kinds of edges; all but contains count for impact.
EDGE_KINDS = ("calls", "imports", "references", "implements", "extends", "tests", "type_of", "returns", "instantiates", "overrides", "decorates", "field_access", "def_use", "exports", "contains")
IMPACT_KINDS = EDGE_KINDS[:-1]
SYMBOL_COLUMNS = ["file_id", "symbol_kind", "qualified_name", "signature", "start_line", "end_line", "structural_digest", "visibility", "exported", "declaration_only", "betweenness", "pagerank"]


def current_generations(generations: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """(project_id, generation_id) that reads are fenced to: the current one, or a pinned one per project.

    A pinned generation that isn't published raises ValueError, as a read of a generation that moved must not mix rows.
    """
    published = generations.where(F.col("state").isin("current", "superseded"))
    if pinned is None:
        return published.where(F.col("state") == "current").select("project_id", "generation_id")
    want = generations.sparkSession.createDataFrame([(p, g) for p, g in pinned.items()], "project_id string, generation_id long")
    kept = published.join(F.broadcast(want), ["project_id", "generation_id"]).select("project_id", "generation_id")
    if kept.count() != len(pinned):
        raise ValueError("a pinned generation isn't published")
    return kept


def simple_name(c: Column) -> Column:
    """The last segment of a qualified name, :: and . both being separators."""
    return F.element_at(F.split(F.regexp_replace(c, "::", "."), r"\."), -1)


def symbols_of(symbols: DataFrame, fence: DataFrame) -> DataFrame:
    """The symbols of the fenced generations, of several rows the last delivered; null ids are ignored."""
    here = symbols.where(F.col("symbol_id").isNotNull()).join(bounded_broadcast(fence), ["project_id", "generation_id"])
    return latest_rows(here, ["project_id", "generation_id", "symbol_id"], "delivered_at", SYMBOL_COLUMNS).withColumn("simple_name", simple_name(F.col("qualified_name")))


def merged_edges(edges: DataFrame) -> DataFrame:
    """(source, target, kind, provenance, sites, confidence): equal deliveries count once, the sites of what is left are
    summed and the highest confidence kept; edges without an end are left out."""
    clean = edges.select(canonical(F.col("source_symbol_id")).alias("source"), canonical(F.col("target_symbol_id")).alias("target"), canonical(F.col("edge_kind")).alias("kind"), "provenance", "site_count", "confidence")
    clean = clean.where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()
    return clean.groupBy("source", "target", "kind", "provenance").agg(F.sum("site_count").alias("sites"), F.max("confidence").alias("confidence"))


def arcs(merged: DataFrame, kinds: tuple[str, ...] | None = None, min_confidence: float | None = None) -> DataFrame:
    """(source, target, kind, sites, confidence), one row per arc whatever its provenances."""
    some = merged if kinds is None else merged.where(F.col("kind").isin(list(kinds)))
    out = some.groupBy("source", "target", "kind").agg(F.sum("sites").alias("sites"), F.max("confidence").alias("confidence"))
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def ranked_frontier(origins: DataFrame, edges: DataFrame, per_origin: int, tests: DataFrame | None = None) -> DataFrame:
    """The best arcs out of each origin (column node): confidence, then sites, then kind and target decide.

    Origins are few (a level of a bounded walk); an origin with very many arcs is cut to the best in each task first by
    the window group limit. Targets in `tests` (column node) are left out.
    """
    out = edges.join(bounded_broadcast(origins.select(F.col("node").alias("source"))), "source")
    if tests is not None:
        out = out.join(tests.select(F.col("node").alias("target")), "target", "left_anti")
    w = Window.partitionBy("source").orderBy(F.col("confidence").desc_nulls_last(), F.col("sites").desc_nulls_last(), "kind", "target")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_origin)


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int, direction: str = "out", max_nodes: int | None = None) -> DataFrame:
    """(root, node, depth): the nodes within max_depth steps of each seed (column node), the seed itself at 0.

    Seeds may name their own roots (column root), so that several nodes are walked from as one.

    direction is out, in or both. Each level is one join and one anti join against what was reached; a level is
    written before the next begins. With max_nodes every root gets the same share of the budget: nodes are taken round
    robin over roots, per root by depth, confidence, sites and id.
    """
    step = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence", "sites")
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "confidence", "sites")
    step = {"out": step, "in": back, "both": step.unionByName(back)}[direction]
    step = checkpointed(step.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.sum("sites").alias("sites")))
    level = checkpointed(seeds.select("root" if "root" in seeds.columns else F.col("node").alias("root"), "node").where(F.col("node").isNotNull()).distinct().withColumns({"depth": F.lit(0), "confidence": F.lit(None).cast("float"), "sites": F.lit(None).cast("long")}))
    seen = level
    for depth in range(1, max_depth + 1):
        found = level.select("root", F.col("node").alias("a")).join(step, "a").groupBy("root", F.col("b").alias("node")).agg(F.max("confidence").alias("confidence"), F.max("sites").alias("sites"))
        level = checkpointed(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), "confidence", "sites"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    if max_nodes is not None:
        w = Window.partitionBy("root").orderBy("depth", F.col("confidence").desc_nulls_last(), F.col("sites").desc_nulls_last(), "node")
        seen = seen.withColumn("turn", F.row_number().over(w)).orderBy("turn", "root").limit(max_nodes)
    return seen.select("root", "node", "depth")


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int | None = None, kind: str | None = None) -> list[str]:
    """The nodes of one unweighted shortest path, ties by the smallest id at each step; empty if there is none.

    The search goes on until the target is met or nothing new is reached, or for max_depth steps if that is given.
    """
    spark = edges.sparkSession
    step = checkpointed((edges if kind is None else edges.where(F.col("kind") == kind)).select("source", "target").distinct())
    levels = [checkpointed(spark.createDataFrame([(source, None)], "node string, parent string"))]
    if source == target:
        return [source]
    seen = levels[0].select("node")
    while max_depth is None or len(levels) <= max_depth:
        found = step.join(levels[-1].select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        level = checkpointed(found.join(seen, "node", "left_anti"))
        if level.isEmpty():
            return []
        levels.append(level)
        seen = seen.unionByName(level.select("node"))
        if not level.where(F.col("node") == target).isEmpty():
            path = [target]
            for back in reversed(levels[1:]):
                path.append(back.where(F.col("node") == path[-1]).first()["parent"])
            return path[::-1]
    return []


def affected_tests(reached: DataFrame, symbols: DataFrame, files: DataFrame, test_path: str) -> DataFrame:
    """(root, path, depth, symbol_id): one row per test file reached from a root, the nearest symbol, ties by id."""
    located = reached.join(symbols.select(F.col("symbol_id").alias("node"), "file_id", "symbol_kind"), "node").join(files, "file_id")
    tests = located.where((F.col("symbol_kind") == "test") | F.col("path").rlike(test_path))
    return tests.groupBy("root", "path").agg(F.min(F.struct("depth", "node")).alias("x")).select("root", "path", "x.depth", F.col("x.node").alias("symbol_id"))


def file_test_impact(files: DataFrame, edges: DataFrame, symbols: DataFrame, paths: DataFrame, max_depth: int, test_path: str, barrel_path: str) -> DataFrame:
    """(root, path, depth, symbols, barrel): the test files from which symbols of a file (column file_id) are reached.

    A walk backwards over the edges from all symbols of a file at once; depth is that of the nearest symbol, symbols how
    many of the test file are reached, barrel whether the file only passes on what others hold. Files whose tests stand
    in themselves aren't listed for themselves.
    """
    at = symbols.select("symbol_id", "file_id", "symbol_kind").distinct()
    seeds = at.join(files.select("file_id").distinct(), "file_id", "left_semi").select(F.col("file_id").alias("root"), F.col("symbol_id").alias("node"))
    near = reach(seeds, edges, max_depth, "in").join(at.select(F.col("symbol_id").alias("node"), "file_id", "symbol_kind"), "node").where(F.col("file_id") != F.col("root"))
    located = near.join(paths, "file_id").where((F.col("symbol_kind") == "test") | F.col("path").rlike(test_path))
    barrels = paths.select(F.col("file_id").alias("root"), F.col("path").rlike(barrel_path).alias("barrel"))
    return located.groupBy("root", "path").agg(F.min("depth").alias("depth"), F.count_distinct("node").alias("symbols")).join(barrels, "root").select("root", "path", "depth", "symbols", "barrel")


def file_dependencies(edges: DataFrame, symbols: DataFrame, per_file: int) -> DataFrame:
    """(file_id, direction, other, edges, sites, kinds, rank): arcs between files, both directions, the largest per file."""
    where = symbols.select("symbol_id", "file_id").distinct()
    cross = edges.join(where.select(F.col("symbol_id").alias("source"), F.col("file_id").alias("a")), "source").join(where.select(F.col("symbol_id").alias("target"), F.col("file_id").alias("b")), "target").where(F.col("a") != F.col("b"))
    pairs = cross.groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"), F.sum("sites").alias("sites"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    both = pairs.select(F.col("a").alias("file_id"), F.lit("out").alias("direction"), F.col("b").alias("other"), "edges", "sites", "kinds").unionByName(pairs.select(F.col("b").alias("file_id"), F.lit("in").alias("direction"), F.col("a").alias("other"), "edges", "sites", "kinds"))
    w = Window.partitionBy("file_id", "direction").orderBy(F.col("sites").desc(), F.col("edges").desc(), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_file)


def degrees(edges: DataFrame, population: int) -> DataFrame:
    """(node, in_arcs, in_sites, out_arcs, out_targets, degree_centrality), centrality being incoming sites over the other nodes, 1 at most."""
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_arcs"), F.sum("sites").alias("in_sites"))
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out_arcs"), F.count_distinct("target").alias("out_targets"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = into.join(out, "node", "full_outer").select("node", z("in_arcs"), z("in_sites"), z("out_arcs"), z("out_targets"))
    return both.withColumn("degree_centrality", F.least(F.lit(1.0), F.col("in_sites") / F.lit(max(population - 1, 1))))


#: Groups of edge kinds by what they depend on.
DEPENDENCY_GROUPS = {"calls": ("calls",), "modules": ("imports", "exports"), "types": ("implements", "extends", "type_of", "returns"), "composition": ("instantiates", "decorates"), "data": ("field_access", "def_use")}


def dependency_counts(edges: DataFrame) -> DataFrame:
    """(node, distinct_outgoing, calls, modules, types, composition, data): distinct targets other than itself and what it contains."""
    contained = edges.where(F.col("kind") == "contains").select("source", "target").distinct()
    used = edges.where((F.col("kind") != "contains") & (F.col("source") != F.col("target"))).join(contained, ["source", "target"], "left_anti")
    some = [F.count_distinct(F.when(F.col("kind").isin(list(k)), F.col("target"))).alias(n) for n, k in DEPENDENCY_GROUPS.items()]
    return used.groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("distinct_outgoing"), *some)
