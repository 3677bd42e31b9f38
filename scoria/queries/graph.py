"""Queries of scans, traversal and centrality with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import centrality, graph
from scoria.plans.runtime import checkpointed, table

TEST_PATH = r"(^|/)tests?/"


def fence(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_generations(table(spark, d, "generations"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols_of(table(spark, d, "symbols"), fence(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_edges(table(spark, d, "edges"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("normalized_path").alias("path"))


def _seeds(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The n smallest ids that tests edges go out from; a fixed, small set of starting points."""
    return merged(spark, d).where("kind = 'tests'").groupBy(F.col("source").alias("node")).count().select("node").orderBy("node").limit(n)


def current_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("project_id", "generation_id", "symbol_id", "file_id", "symbol_kind", "qualified_name", "simple_name", "start_line", "end_line", "exported", "visibility")


def edges_merged(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)


def frontier_top(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranked_frontier(_seeds(spark, d, 50), graph.arcs(merged(spark, d)), 3).select("source", "target", "kind", "sites", "confidence", "rank")


def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_seeds(spark, d), graph.arcs(merged(spark, d), graph.IMPACT_KINDS), 3, "out")


def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_seeds(spark, d), graph.arcs(merged(spark, d), ("calls",)), 2, "in")


def tests_affected(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.arcs(merged(spark, d), graph.IMPACT_KINDS)
    seeds = edges.groupBy(F.col("target").alias("node")).count().orderBy(F.col("count").desc(), "node").limit(3)
    return graph.affected_tests(graph.reach(seeds, edges, 2, "in"), symbols(spark, d), paths(spark, d), TEST_PATH)


def file_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_dependencies(graph.arcs(merged(spark, d)), symbols(spark, d), 3)


def degree(spark: SparkSession, d: str) -> DataFrame:
    everyone = symbols(spark, d).select("symbol_id").distinct().count()
    out = graph.degrees(graph.arcs(merged(spark, d)), everyone)
    return out.withColumn("degree_centrality", F.round("degree_centrality", 9))


def dependency_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_counts(graph.arcs(merged(spark, d)))


def containment(spark: SparkSession, d: str) -> DataFrame:
    """Members of each container with their names."""
    s = symbols(spark, d).select("symbol_id", "qualified_name").distinct()
    e = graph.arcs(merged(spark, d), ("contains",))
    return e.join(s.select(F.col("symbol_id").alias("source"), F.col("qualified_name").alias("container")), "source").join(s.select(F.col("symbol_id").alias("target"), F.col("qualified_name").alias("member")), "target").select("source", "target", "container", "member")


def page_rank(spark: SparkSession, d: str) -> DataFrame:
    e = merged(spark, d).where(F.col("kind").isin("calls", "references"))
    nodes = e.select(F.explode(F.array("source", "target")).alias("node"))
    return centrality.pagerank(nodes, e).withColumn("pagerank", F.round("pagerank", 7))


def between(spark: SparkSession, d: str) -> DataFrame:
    """Over calls and references of all symbols, from 200 sources, which is the measure's own bound on its work."""
    e = checkpointed(graph.arcs(merged(spark, d), ("calls", "references")))
    nodes = e.select(F.explode(F.array("source", "target")).alias("node"))
    return centrality.betweenness(nodes, e, centrality.sample_sources(nodes))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components of the clone graph: documents of one text, and search documents' code of one shape, each linked to the first of its group."""
    docs = table(spark, d, "documents").where("text <> ''").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("h"))
    words = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z]+", " "), r"^ | $", "")
    loose = table(spark, d, "documents").where("text <> ''").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.sha2(words, 256).alias("h"), words.alias("w")).where("length(w) > 20").drop("w")
    both = docs.unionByName(loose)
    first = both.groupBy("h").agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).where("n > 1")
    return centrality.components(both.join(first, "h").select(F.col("id").alias("a"), F.col("first").alias("b")))


def names_exact(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by exact name: one without separators is looked for among simple names, others among qualified ones."""
    wanted = ["flush_handler", "build_trace", "grade::TransientCallback::encrypt_fixture"]
    s = symbols(spark, d)
    hit = F.lit(False)
    for n in wanted:
        hit = hit | ((F.col("qualified_name") == n) if "::" in n or "." in n else (F.col("simple_name") == n))
    return s.where(hit).select("project_id", "symbol_id", "qualified_name", "start_line")


def at_range(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that overlap lines 100 to 140 of their file, innermost first."""
    from pyspark.sql import Window

    s = symbols(spark, d).where("end_line >= 100 AND start_line <= 140")
    w = Window.partitionBy("project_id", "file_id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "end_line", "symbol_id")
    return s.withColumn("rank", F.row_number().over(w)).select("project_id", "file_id", "symbol_id", "rank")


def qualified_search(spark: SparkSession, d: str) -> DataFrame:
    """kind:function|method name:trace depends-on a library symbol, with low or unknown centrality."""
    s = symbols(spark, d).where(F.col("symbol_kind").isin("function", "method") & F.lower("qualified_name").contains("trace") & (F.col("pagerank").isNull() | (F.col("pagerank") <= 0.001)))
    lib = graph.arcs(merged(spark, d), graph.IMPACT_KINDS).join(table(spark, d, "library_symbols").select(F.col("symbol_id").alias("target")), "target", "left_semi")
    return s.join(lib.select(F.col("source").alias("symbol_id")), "symbol_id", "left_semi").select("project_id", "symbol_id", "qualified_name", "pagerank")


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Exported symbols that nothing uses from outside themselves, by bucket of their kind."""
    used = graph.arcs(merged(spark, d), graph.IMPACT_KINDS).where("source <> target").select(F.col("target").alias("symbol_id")).distinct()
    return symbols(spark, d).where("exported").join(used, "symbol_id", "left_anti").groupBy("project_id", "symbol_kind").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("first_id"))


_E = """
WITH gen AS (SELECT project_id, generation_id FROM generations WHERE state = 'current'),
sym AS (
  SELECT *, list_extract(string_split(replace(qualified_name, '::', '.'), '.'), -1) AS simple_name FROM (
    SELECT DISTINCT ON (project_id, generation_id, symbol_id) * FROM symbols JOIN gen USING (project_id, generation_id)
    ORDER BY project_id, generation_id, symbol_id, delivered_at DESC NULLS LAST, file_id DESC NULLS LAST, symbol_kind DESC NULLS LAST, qualified_name DESC NULLS LAST,
      signature DESC NULLS LAST, start_line DESC NULLS LAST, end_line DESC NULLS LAST, structural_digest DESC NULLS LAST, visibility DESC NULLS LAST, exported DESC NULLS LAST, declaration_only DESC NULLS LAST, betweenness DESC NULLS LAST, pagerank DESC NULLS LAST)),
fil AS (SELECT file_id, max(normalized_path) AS path FROM files WHERE file_id IS NOT NULL GROUP BY 1),
raw AS (
  SELECT DISTINCT lower(regexp_replace(source_symbol_id, '^\\s+|\\s+$', '', 'g')) AS source, lower(regexp_replace(target_symbol_id, '^\\s+|\\s+$', '', 'g')) AS target,
    lower(regexp_replace(edge_kind, '^\\s+|\\s+$', '', 'g')) AS kind, provenance, site_count, confidence
  FROM edges WHERE source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL),
e AS (SELECT source, target, kind, provenance, sum(site_count)::BIGINT AS sites, max(confidence) AS confidence FROM raw GROUP BY ALL),
arc AS (SELECT source, target, kind, sum(sites)::BIGINT AS sites, max(confidence) AS confidence FROM e GROUP BY ALL),
seed AS (SELECT DISTINCT source AS node FROM e WHERE kind = 'tests')
"""
_R = _E.replace("WITH gen", "WITH RECURSIVE gen", 1)


def _walk(seeds: str, kinds: str, depth: int, back: bool) -> str:
    a, b = ("target", "source") if back else ("source", "target")
    return _R + f""", s AS ({seeds}), st AS (SELECT DISTINCT {a} AS a, {b} AS b FROM arc WHERE {kinds} AND source <> target),
    w AS (SELECT node AS root, node, 0 AS depth FROM s UNION SELECT w.root, st.b, w.depth + 1 FROM w JOIN st ON st.a = w.node WHERE w.depth < {depth}),
    r AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY ALL)
    """


_PR = _R + """, pe AS (SELECT source, target, count(*)::DOUBLE AS n FROM e WHERE kind IN ('calls', 'references') GROUP BY ALL),
  pn AS (SELECT DISTINCT node FROM (SELECT source AS node FROM pe UNION ALL SELECT target FROM pe)), pc AS (SELECT count(*)::DOUBLE AS c FROM pn),
  po AS (SELECT source, sum(n) AS o FROM pe GROUP BY 1),
  pr AS (
    SELECT 0 AS i, node, 1 / c AS score FROM pn, pc
    UNION ALL
    (WITH cur AS (SELECT * FROM pr), giv AS (SELECT pe.target AS node, sum(cur.score / po.o * pe.n) AS g FROM cur JOIN pe ON pe.source = cur.node JOIN po ON po.source = cur.node GROUP BY 1),
      loose AS (SELECT coalesce(sum(score), 0) AS l FROM cur WHERE node NOT IN (SELECT source FROM po))
    SELECT cur.i + 1, cur.node, 0.15 / c + 0.85 * (coalesce(g, 0) + l / c) FROM cur LEFT JOIN giv USING (node), pc, loose WHERE cur.i < 40))
"""
_IMPACT = "kind <> 'contains'"

QUERIES = {
    "s1_current_symbols": current_symbols, "a2_edges_merged": edges_merged, "g1_frontier": frontier_top, "g3_impact": impact, "g3_callers": callers, "g5_affected_tests": tests_affected,
    "g12_file_dependencies": file_links, "g13_degree": degree, "g11_dependency_counts": dependency_groups, "g14_containment": containment, "g7_pagerank": page_rank, "g8_betweenness": between, "g10_components": clusters,
    "q2_exact_names": names_exact, "q4_at_range": at_range, "q8_qualified": qualified_search, "q7_entry_points": entry_points,
}

SQL = {
    "s1_current_symbols": _E + "SELECT project_id, generation_id, symbol_id, file_id, symbol_kind, qualified_name, simple_name, start_line, end_line, exported, visibility FROM sym",
    "a2_edges_merged": _E + "SELECT * FROM e",
    "g1_frontier": _E + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC NULLS LAST, sites DESC NULLS LAST, kind, target) AS rank FROM arc WHERE source IN (SELECT node FROM seed ORDER BY 1 LIMIT 50)) WHERE rank <= 3",
    "g3_impact": _walk("SELECT node FROM seed ORDER BY 1 LIMIT 5", _IMPACT, 3, False) + "SELECT * FROM r",
    "g3_callers": _walk("SELECT node FROM seed ORDER BY 1 LIMIT 5", "kind = 'calls'", 2, True) + "SELECT * FROM r",
    "g5_affected_tests": _walk(f"SELECT target AS node FROM arc WHERE {_IMPACT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3", _IMPACT, 2, True) + "SELECT DISTINCT ON (root, path) root, path, depth, symbol_id FROM r JOIN sym ON sym.symbol_id = r.node JOIN fil USING (file_id) WHERE symbol_kind = 'test' OR regexp_matches(path, '(^|/)tests?/') ORDER BY root, path, depth, symbol_id",
    "g12_file_dependencies": _E + """, wh AS (SELECT DISTINCT symbol_id, file_id FROM sym),
        p AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS edges, sum(sites)::BIGINT AS sites, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM arc JOIN wh a ON a.symbol_id = source JOIN wh b ON b.symbol_id = target WHERE a.file_id <> b.file_id GROUP BY 1, 2),
        u AS (SELECT a AS file_id, 'out' AS direction, b AS other, edges, sites, kinds FROM p UNION ALL SELECT b, 'in', a, edges, sites, kinds FROM p)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, direction ORDER BY sites DESC, edges DESC, other) AS rank FROM u) WHERE rank <= 3""",
    "g13_degree": _E + """, i AS (SELECT target AS node, count(*) AS in_arcs, sum(sites)::BIGINT AS in_sites FROM arc GROUP BY 1), o AS (SELECT source AS node, count(*) AS out_arcs, count(DISTINCT target) AS out_targets FROM arc GROUP BY 1)
        SELECT node, coalesce(in_arcs, 0) AS in_arcs, coalesce(in_sites, 0) AS in_sites, coalesce(out_arcs, 0) AS out_arcs, coalesce(out_targets, 0) AS out_targets, round(least(1.0, coalesce(in_sites, 0) / (SELECT greatest(count(DISTINCT symbol_id) - 1, 1) FROM sym)::DOUBLE), 9) AS degree_centrality FROM i FULL JOIN o USING (node)""",
    "g11_dependency_counts": _E + """, c AS (SELECT DISTINCT source, target FROM arc WHERE kind = 'contains')
        SELECT source AS node, count(DISTINCT target) AS distinct_outgoing, count(DISTINCT target) FILTER (kind = 'calls') AS calls, count(DISTINCT target) FILTER (kind IN ('imports', 'exports')) AS modules,
          count(DISTINCT target) FILTER (kind IN ('type_of', 'returns', 'implements', 'extends')) AS types, count(DISTINCT target) FILTER (kind IN ('instantiates', 'decorates')) AS composition, count(DISTINCT target) FILTER (kind IN ('field_access', 'def_use')) AS data
        FROM arc ANTI JOIN c USING (source, target) WHERE kind <> 'contains' AND source <> target GROUP BY 1""",
    "g14_containment": _E + "SELECT source, target, a.qualified_name AS container, b.qualified_name AS member FROM arc JOIN (SELECT DISTINCT symbol_id, qualified_name FROM sym) a ON a.symbol_id = source JOIN (SELECT DISTINCT symbol_id, qualified_name FROM sym) b ON b.symbol_id = target WHERE kind = 'contains'",
    "g7_pagerank": _PR + "SELECT node, round(round(score, 9), 7) AS pagerank FROM pr WHERE i = 40",
    "g10_components": r"""WITH RECURSIVE x AS (SELECT 'd' || doc_id AS id, text, regexp_replace(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), '^ | $', '', 'g') AS w FROM documents WHERE text <> ''),
        g AS (SELECT id, sha256(text) AS h FROM x UNION SELECT id, sha256(w) FROM x WHERE len(w) > 20), f AS (SELECT h, min(id) AS first FROM g GROUP BY 1 HAVING count(DISTINCT id) > 1), l AS (SELECT id AS a, first AS b FROM g JOIN f USING (h) UNION SELECT first, id FROM g JOIN f USING (h)),
        k AS (SELECT DISTINCT a AS node, a AS other FROM l UNION SELECT k.node, l.b FROM k JOIN l ON l.a = k.other) SELECT node, min(other) AS component FROM k GROUP BY 1""",
    "q2_exact_names": _E + "SELECT project_id, symbol_id, qualified_name, start_line FROM sym WHERE simple_name IN ('flush_handler', 'build_trace') OR qualified_name = 'grade::TransientCallback::encrypt_fixture'",
    "q4_at_range": _E + "SELECT project_id, file_id, symbol_id, row_number() OVER (PARTITION BY project_id, file_id ORDER BY end_line - start_line, start_line, end_line, symbol_id) AS rank FROM sym WHERE end_line >= 100 AND start_line <= 140",
    "q8_qualified": _E + f"SELECT project_id, symbol_id, qualified_name, pagerank FROM sym WHERE symbol_kind IN ('function', 'method') AND contains(lower(qualified_name), 'trace') AND (pagerank IS NULL OR pagerank <= 0.001) AND symbol_id IN (SELECT source FROM arc WHERE {_IMPACT} AND target IN (SELECT symbol_id FROM library_symbols))",
    "q7_entry_points": _E + f"SELECT project_id, symbol_kind, count(*) AS n, min(symbol_id) AS first_id FROM sym WHERE exported AND symbol_id NOT IN (SELECT target FROM arc WHERE {_IMPACT} AND source <> target) GROUP BY 1, 2",
}
