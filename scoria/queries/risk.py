"""Queries of risk reports with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import graph, insights, risk
from scoria.operators.skew import canonical
from scoria.plans.runtime import table
from scoria.queries.graph import _E, merged, paths, symbols
from scoria.queries.lookup import _LIB, _located


def _history(spark: SparkSession, d: str) -> DataFrame:
    """A history of files as their symbols' deliveries give it: generations as commits, rows as insertions, nulls in digests as deletions."""
    s = table(spark, d, "symbols").groupBy("file_id").agg(F.count_distinct("generation_id").alias("commits"), F.count(F.lit(1)).alias("insertions"), F.sum(F.col("structural_digest").isNull().cast("long")).alias("deletions"))
    return paths(spark, d).join(s, "file_id").groupBy("path").agg(F.sum("commits").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("target_symbol_id IS NULL").select(canonical(F.col("source_symbol_id")).alias("symbol_id"), canonical(F.col("edge_kind")).alias("k"), "provenance", F.col("site_count").alias("sites"), "confidence").distinct()
    return risk.file_risk(paths(spark, d), symbols(spark, d), graph.arcs(merged(spark, d)), e.select("symbol_id", "sites"), _history(spark, d))


def file_risk(spark: SparkSession, d: str) -> DataFrame:
    out = _scored(spark, d)
    return out.select("file_id", "symbols", "dependents", "structural_risk", "composite", *[F.round(c, 9).alias(c) for c in ("pressure", "churn", "risk", "maintenance", "brittle")])


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty of each category."""
    out = None
    for category in ("risk", "maintenance", "brittle"):
        c = risk.ranked_hotspots(_scored(spark, d), category, most=20).select(F.lit(category).alias("category"), "place", "path")
        out = c if out is None else out.unionByName(c)
    return out


def unused(spark: SparkSession, d: str) -> DataFrame:
    return risk.unused_code(_located(spark, d), graph.arcs(merged(spark, d)), 25)


def coverage_need(spark: SparkSession, d: str) -> DataFrame:
    """Two made sources of coverage, from the symbols' lines: the better one counts."""
    s = _located(spark, d)
    found = s.select("symbol_id", (F.col("end_line") - F.col("start_line") + 1).alias("found"), (F.col("start_line") % 7).alias("a"), (F.col("end_line") % 5).alias("b"))
    cov = found.groupBy("symbol_id").agg(F.max("found").alias("found"), F.max("a").alias("a"), F.max("b").alias("b"))
    rows = cov.select("symbol_id", F.lit("unit").alias("label"), "found", "a", (F.col("a") / 7).alias("fraction")).toDF("symbol_id", "label", "found", "hit", "fraction").unionByName(cov.select("symbol_id", F.lit("system").alias("label"), "found", F.col("b").alias("hit"), (F.col("b") / 5).alias("fraction")))
    n = symbols(spark, d).select("symbol_id").distinct().count()
    return risk.coverage_ranking(rows, s, graph.arcs(merged(spark, d)), n).withColumns({"fraction": F.round("fraction", 9), "centrality": F.round("centrality", 9)})


def near_clones(spark: SparkSession, d: str) -> DataFrame:
    """Source files of one shape whose texts differ."""
    f = table(spark, d, "files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("source_text").alias("text"))
    return risk.shape_clones(f, "file_id", F.col("text"), insights.shape(F.col("text")), 3)


def repeated_generations(spark: SparkSession, d: str) -> DataFrame:
    """Generations with as many symbols of each kind as an older one of their project."""
    counts = table(spark, d, "symbols").groupBy("project_id", "generation_id").agg(F.count_distinct("symbol_kind").cast("string").alias("digest"))
    return risk.duplicate_generations(table(spark, d, "generations"), counts)


def prunable(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generations")
    return risk.prunable(g, 1, {"superseded": 20, "failed": 7, "staging": 3}, F.lit("2024-06-01").cast("date"))


_USES, _REMOVABLE, _CONTRACTS = (", ".join(f"'{x}'" for x in xs) for xs in (risk.USES, risk.REMOVABLE, risk.CONTRACTS))
_RISK = _E + """, at AS MATERIALIZED (SELECT DISTINCT symbol_id, file_id FROM sym),
  ow AS (SELECT file_id, count(DISTINCT symbol_id) AS symbols, count(DISTINCT CASE WHEN symbol_kind = 'route' THEN symbol_id END) AS routes, coalesce(max(pagerank), 0) AS centrality FROM sym GROUP BY 1),
  inw AS (SELECT b.file_id, sum(sites) AS incoming, count(DISTINCT CASE WHEN a.file_id <> b.file_id THEN a.file_id END) AS dependents FROM arc JOIN loc0 b ON b.symbol_id = target JOIN loc0 a ON a.symbol_id = source WHERE kind <> 'contains' GROUP BY 1),
  outw AS (SELECT a.file_id, sum(sites) AS outgoing FROM arc JOIN loc0 a ON a.symbol_id = source WHERE kind <> 'contains' GROUP BY 1),
  opn AS (SELECT file_id, sum(site_count) AS unresolved FROM (SELECT DISTINCT lower(regexp_replace(source_symbol_id, '^\\s+|\\s+$', '', 'g')) AS symbol_id, lower(regexp_replace(edge_kind, '^\\s+|\\s+$', '', 'g')) AS k, provenance, site_count, confidence FROM edges WHERE target_symbol_id IS NULL) JOIN loc0 USING (symbol_id) GROUP BY 1),
  his AS (SELECT path, sum(c) AS commits, sum(n) AS insertions, sum(z) AS deletions FROM fil JOIN (SELECT file_id, count(DISTINCT generation_id) AS c, count(*) AS n, sum((structural_digest IS NULL)::INT) AS z FROM symbols GROUP BY 1) USING (file_id) GROUP BY 1),
  b0 AS (SELECT file_id, path, coalesce(centrality, 0.0) AS centrality, coalesce(symbols, 0) AS symbols, coalesce(dependents, 0) AS dependents, coalesce(commits, 0) AS commits, coalesce(insertions, 0) AS ins, coalesce(deletions, 0) AS del,
    (3 * coalesce(incoming, 0) + 2 * coalesce(outgoing, 0) + coalesce(unresolved, 0) + 4 * coalesce(routes, 0))::BIGINT AS structural_risk FROM fil LEFT JOIN ow USING (file_id) LEFT JOIN inw USING (file_id) LEFT JOIN outw USING (file_id) LEFT JOIN opn USING (file_id) LEFT JOIN his USING (path)),
  b1 AS (SELECT *, structural_risk / max(structural_risk) OVER ()::DOUBLE AS pressure, (commits * 10 + ins + del) / (max(commits * 10 + ins + del) OVER ())::DOUBLE AS churn, (structural_risk * 100 + least(commits, 1000) * 10 + least(floor((ins + del) / 10), 1000))::BIGINT AS composite FROM b0),
  b2 AS (SELECT *, (centrality * 0.7::DOUBLE + pressure * 0.3::DOUBLE) * churn AS risk, churn * (1 - centrality) AS maintenance, (centrality * 0.7::DOUBLE + pressure * 0.3::DOUBLE) / (1 + churn) AS brittle FROM b1)
""".replace("loc0", "at_").replace(", at AS MATERIALIZED", ", at_ AS MATERIALIZED")

QUERIES = {"i6_file_risk": file_risk, "i6_categories": hotspots, "i5_unused": unused, "i13_coverage_need": coverage_need, "i2_near_clones": near_clones, "i29_duplicates": repeated_generations, "i29_prunable": prunable}

SQL = {
    "i6_file_risk": _RISK + "SELECT file_id, symbols, dependents, structural_risk, composite, round(pressure, 9) AS pressure, round(churn, 9) AS churn, round(risk, 9) AS risk, round(maintenance, 9) AS maintenance, round(brittle, 9) AS brittle FROM b2",
    "i6_categories": _RISK + """SELECT * FROM (SELECT 'risk' AS category, row_number() OVER (ORDER BY round(risk, 12) DESC, round(centrality, 12) DESC, path) AS place, path FROM b2 UNION ALL SELECT 'maintenance', row_number() OVER (ORDER BY round(maintenance, 12) DESC, round(churn, 12) DESC, path), path FROM b2
        UNION ALL SELECT 'brittle', row_number() OVER (ORDER BY round(brittle, 12) DESC, round(centrality, 12) DESC, path), path FROM b2 WHERE dependents > 0) WHERE place <= 20""",
    "i5_unused": _E + _LIB + f""", us AS (SELECT DISTINCT target FROM arc WHERE kind IN ({_USES}) AND source <> target), ho AS (SELECT DISTINCT source, target FROM arc WHERE kind = 'contains'),
        pu AS (SELECT DISTINCT p.project_id, target AS symbol_id FROM ho JOIN loc p ON p.symbol_id = source WHERE p.exported AND p.symbol_kind IN ({_CONTRACTS})),
        fr AS (SELECT * FROM loc WHERE symbol_kind IN ({_REMOVABLE}) AND NOT coalesce(exported, false) AND symbol_id NOT IN (FROM us) AND NOT regexp_matches(path, '{risk.AUXILIARY}') AND NOT regexp_matches(path, '{risk.FIXTURES}')
          AND NOT coalesce(language = 'rust' AND regexp_matches(qualified_name, '(^|::|[.#/$])main$') AND regexp_matches(path, '(^|/)(build|main)\\.rs$|(^|/)bin/[^/]+\\.rs$'), false)
          AND NOT (symbol_kind = 'method' AND coalesce(visibility, 'public') NOT IN ('private', 'protected') AND (project_id, symbol_id) IN (SELECT (project_id, symbol_id) FROM pu))),
        fi AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pagerank DESC NULLS LAST, path, start_line, symbol_id) AS place FROM fr QUALIFY place <= 25)
        SELECT project_id, symbol_id, path, coalesce(o.n, 0) AS outgoing, symbol_id IN (SELECT target FROM ho WHERE source IN (SELECT source FROM arc WHERE kind IN ('implements', 'extends'))) AS dispatch_risk, place FROM fi LEFT JOIN (SELECT source AS symbol_id, count(*) AS n FROM arc WHERE kind NOT IN ('contains', 'def_use') GROUP BY 1) o USING (symbol_id)""",
    "i13_coverage_need": _E + _LIB + f""", c AS (SELECT symbol_id, max(start_line % 7) / 7 AS u, max(end_line % 5) / 5 AS s FROM loc GROUP BY 1), b AS (SELECT symbol_id, CASE WHEN s >= u THEN 'system' ELSE 'unit' END AS label, greatest(s, u) AS fraction FROM c),
        a AS (SELECT DISTINCT symbol_id, file_id, path FROM loc), i AS (SELECT target AS symbol_id, sum(sites)::BIGINT AS incoming FROM arc WHERE kind <> 'contains' GROUP BY 1), t AS (SELECT target AS symbol_id, count(DISTINCT file_id) AS test_files FROM arc JOIN a ON a.symbol_id = source WHERE regexp_matches(path, '{risk.TESTS}') GROUP BY 1)
        SELECT symbol_id, label, round(fraction, 9) AS fraction, coalesce(incoming, 0) AS incoming, coalesce(test_files, 0) AS test_files, round(least(1.0, coalesce(incoming, 0) / (SELECT greatest(count(DISTINCT symbol_id) - 1, 1) FROM sym)::DOUBLE), 9) AS centrality FROM b LEFT JOIN i USING (symbol_id) LEFT JOIN t USING (symbol_id) WHERE symbol_id IN (SELECT symbol_id FROM a WHERE NOT regexp_matches(path, '{risk.TESTS}'))""",
    "i2_near_clones": r"""WITH f AS (SELECT file_id AS k, max(source_text) AS t FROM files WHERE file_id IS NOT NULL GROUP BY 1), s AS (SELECT k, sha256(regexp_replace(regexp_replace(regexp_replace(t, '[A-Za-z_]+', 'a', 'g'), '[0-9]+', '9', 'g'), '\s+', ' ', 'g')) AS shape, sha256(t) AS text FROM f WHERE len(t) - len(replace(t, chr(10), '')) >= 2 AND len(array_to_string(regexp_extract_all(t, '"[^"\n]*"|''[^''\n]*''|[0-9]+'), '')) <= 0.6 * len(t))
        SELECT shape, count(DISTINCT k) AS members, count(DISTINCT text) AS structures, min(k) AS representative FROM s GROUP BY 1 HAVING count(DISTINCT text) > 1""",
    "i29_duplicates": "WITH c AS (SELECT project_id, generation_id, count(DISTINCT symbol_kind) AS d FROM symbols GROUP BY 1, 2), x AS (SELECT project_id, generation_id, first_value(generation_id) OVER (PARTITION BY project_id, d ORDER BY staged_at NULLS FIRST, generation_id) AS same_as FROM generations JOIN c USING (project_id, generation_id)) SELECT * FROM x WHERE same_as <> generation_id",
    "i29_prunable": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY project_id, state ORDER BY staged_at DESC NULLS LAST, generation_id DESC) AS age, CASE state WHEN 'superseded' THEN 20 WHEN 'failed' THEN 7 WHEN 'staging' THEN 3 END AS floor_ FROM generations) SELECT project_id, generation_id, state FROM a WHERE state <> 'current' AND age > 1 AND date_diff('day', staged_at::DATE, DATE '2024-06-01') > floor_",
}
