"""Queries p1, p2 and p7 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import hierarchy, skew, snapshots
from scoria.plans.runtime import table


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generations").where(F.col("state").isin("current", "superseded")).select("project_id", "generation_id", "published_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "symbols"), _versions(spark, d), content=snapshots.hex_number(F.col("structural_digest")))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "managed_expected").select("project_id", F.explode("containments").alias("c")).select("project_id", "c.parent", "c.child")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots_and_depths(hierarchy.heavy_paths(_links(spark, d))).withColumnRenamed("g", "project_id")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of each node; the path joined by an unlikely separator."""
    p = hierarchy.paths(hierarchy.heavy_paths(_links(spark, d)))
    return p.select(F.col("g").alias("project_id"), "node", "root", "depth", F.array_join("path", " / ").alias("path"))


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The number of descendants of each node; they are the nodes at places first + 1 .. last of its root."""
    i = hierarchy.intervals(hierarchy.heavy_paths(_links(spark, d)))
    return i.select(F.col("g").alias("project_id"), "node", "root", "first", "last", (F.col("last") - F.col("first")).alias("descendants"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.heavy_paths(_links(spark, d))).withColumnRenamed("g", "project_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_pairs(table(spark, d, "edges")).select("target_symbol_id", "edge_kind")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges, sites and highest confidence of every (target, kind)."""
    return skew.edge_aggregates(table(spark, d, "edges"))


_HEX = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(structural_digest)), '^.*:', ''), '^\\s*0x', ''), '[^0-9a-f]', '', 'g'), '^0+(.)', '\\1')"

_P1 = f"""
WITH chain AS (
  SELECT project_id, generation_id, lead(generation_id) OVER w AS nxt, lag(generation_id) OVER w AS prev
  FROM generations WHERE state IN ('current', 'superseded')
  WINDOW w AS (PARTITION BY project_id ORDER BY published_at, generation_id)),
s AS (
  SELECT DISTINCT ON (project_id, generation_id, symbol_id) project_id, generation_id, symbol_id, {_HEX} AS d
  FROM symbols ORDER BY project_id, generation_id, symbol_id, delivered_at DESC, d DESC),
a AS (SELECT project_id, c.generation_id, symbol_id, d FROM s JOIN chain c USING (project_id, generation_id) WHERE prev IS NOT NULL),
b AS (SELECT project_id, nxt AS generation_id, symbol_id, d FROM s JOIN chain c USING (project_id, generation_id) WHERE nxt IS NOT NULL)
SELECT project_id, generation_id, symbol_id,
  CASE WHEN b.symbol_id IS NULL THEN 'added' WHEN a.symbol_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b USING (project_id, generation_id, symbol_id)
WHERE a.symbol_id IS NULL OR b.symbol_id IS NULL OR a.d IS DISTINCT FROM b.d
"""

_TREE = """
WITH RECURSIVE l AS (SELECT project_id, unnest(containments) AS c FROM managed_expected),
n AS (
  SELECT project_id, node, min(par) AS par FROM (
    SELECT project_id, c.child AS node, c.parent AS par FROM l UNION ALL SELECT project_id, c.parent, NULL FROM l)
  WHERE node IS NOT NULL AND project_id IS NOT NULL GROUP BY ALL),
t AS (
  SELECT project_id, node, node AS root, 0 AS depth, node AS path FROM n WHERE par IS NULL
  UNION ALL
  SELECT n.project_id, n.node, t.root, t.depth + 1, t.path || ' / ' || n.node FROM n JOIN t ON n.project_id = t.project_id AND n.par = t.node),
loose AS (SELECT project_id, node, par FROM n ANTI JOIN t USING (project_id, node)),
walk AS (
  SELECT project_id, node AS start, par AS here FROM loose
  UNION
  SELECT walk.project_id, walk.start, loose.par FROM walk JOIN loose ON walk.project_id = loose.project_id AND walk.here = loose.node),
cyc AS (SELECT DISTINCT project_id, start AS node FROM walk WHERE start = here),
anc AS (
  SELECT project_id, node AS descendant, par AS node, 1 AS distance FROM n JOIN t USING (project_id, node) WHERE par IS NOT NULL
  UNION ALL
  SELECT anc.project_id, anc.descendant, n.par, anc.distance + 1 FROM anc JOIN n ON anc.project_id = n.project_id AND anc.node = n.node WHERE n.par IS NOT NULL)
"""

#: Places in depth-first order, the heavy child (largest subtree, then smallest name) first, other children by name.
_PLACES = _TREE + """,
sz AS (SELECT project_id, node, 1 + count(descendant) AS size FROM t LEFT JOIN anc USING (project_id, node) GROUP BY ALL),
kid AS (SELECT n.project_id, n.node, n.par, size, row_number() OVER (PARTITION BY n.project_id, n.par ORDER BY size DESC, n.node) = 1 AS heavy FROM n JOIN sz USING (project_id, node) WHERE par IS NOT NULL),
off AS (
  SELECT project_id, node, par, CASE WHEN heavy THEN 0 ELSE max(CASE WHEN heavy THEN size END) OVER (PARTITION BY project_id, par)
    + coalesce(sum(CASE WHEN heavy THEN 0 ELSE size END) OVER (PARTITION BY project_id, par ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS skip FROM kid),
place AS (
  SELECT project_id, node, node AS root, 0::BIGINT AS first FROM n WHERE par IS NULL
  UNION ALL
  SELECT off.project_id, off.node, place.root, (place.first + 1 + skip)::BIGINT FROM off JOIN place ON off.project_id = place.project_id AND off.par = place.node)
SELECT project_id, node, root, first, first + size - 1 AS last, size - 1 AS descendants FROM place JOIN sz USING (project_id, node)
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_paths": p2_paths, "p2_intervals": p2_intervals, "p2_descendants": p2_descendants, "p7_found": p7_found, "p7_pairs": p7_pairs}

_CLEAN = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_P7 = f"""
WITH e AS (
  SELECT {_CLEAN.format('source_symbol_id')} AS s, {_CLEAN.format('target_symbol_id')} AS target_symbol_id, {_CLEAN.format('edge_kind')} AS edge_kind,
    max(site_count) AS sites, max(confidence) AS confidence FROM edges WHERE target_symbol_id IS NOT NULL GROUP BY ALL),
p AS (SELECT target_symbol_id, edge_kind, count(*) AS edges, sum(sites)::BIGINT AS sites, max(confidence) AS max_confidence FROM e GROUP BY ALL)
"""

SQL = {
    "p1_found": _P1,
    "p2_found": _TREE + "SELECT project_id, node, root, depth FROM t UNION ALL SELECT project_id, node, '', CASE WHEN cyc.node IS NULL THEN -2 ELSE -1 END FROM loose LEFT JOIN cyc USING (project_id, node)",
    "p2_paths": _TREE + "SELECT project_id, node, root, depth, path FROM t UNION ALL SELECT project_id, node, '', CASE WHEN cyc.node IS NULL THEN -2 ELSE -1 END, NULL FROM loose LEFT JOIN cyc USING (project_id, node)",
    "p2_intervals": _PLACES,
    "p2_descendants": _TREE + "SELECT project_id, node, descendant, distance FROM anc",
    "p7_found": _P7 + "SELECT target_symbol_id, edge_kind FROM p WHERE edges >= 0.01 * (SELECT sum(edges) FROM p)",
    "p7_pairs": _P7 + "SELECT * FROM p",
}
