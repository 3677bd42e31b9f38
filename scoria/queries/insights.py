"""Queries of retrieval, findings, rollups and reports with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import graph, insights, search, vectors
from scoria.operators.snapshots import hex_number
from scoria.plans.runtime import table
from scoria.queries.graph import _E, _R, fence, merged, paths, symbols
from scoria.queries.problems import _HEX, _P1

TERMS = ["scanner", "rollback", "budget", "jahofoze", "trace"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_documents")


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    docs = _docs(spark, d)
    return search.postings(docs), docs.select("document_id").distinct().count()


def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    index, n = _index(spark, d)
    return search.bm25(index, TERMS, n).withColumn("score", F.round("score", 6))


def bm25_names(spark: SparkSession, d: str) -> DataFrame:
    index, n = _index(spark, d)
    return search.bm25(index.where("field = 'qualified_name'"), TERMS, n).withColumn("score", F.round("score", 6))


def bm25_intent(spark: SparkSession, d: str) -> DataFrame:
    index, n = _index(spark, d)
    return search.bm25(index.where("field = 'natural_text'"), TERMS, n).withColumn("score", F.round("score", 6))


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_terms(search.postings(_docs(spark, d), ("qualified_name",)), "flush", 2)


def fused(spark: SparkSession, d: str) -> DataFrame:
    """The lexical channels fused; rankings are rounded first so that equal scores stay equal."""
    index, n = _index(spark, d)
    channels = None
    for name, some in (("all", index), ("names", index.where("field = 'qualified_name'")), ("text", index.where("field = 'natural_text'"))):
        scores = search.bm25(some, TERMS, n).withColumn("score", F.round("score", 6))
        c = search.ranked(scores, 20).select(F.lit(name).alias("channel"), "doc", "rank")
        channels = c if channels is None else channels.unionByName(c)
    kinds = _docs(spark, d).groupBy(F.col("document_id").alias("doc")).agg(F.max("document_kind").alias("kind"), F.max("path").alias("path"))
    tiers = kinds.select("doc", search.preference_tier(F.col("kind"), F.col("path"), F.lit(None).cast("string")).alias("tier"))
    return search.fuse(channels, tiers).withColumn("score", F.round("score", 9))


def similar(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50, against all."""
    v = table(spark, d, "embeddings")
    return vectors.nearest(v.where("vec_id % 50 = 0"), v, 5).withColumn("score", F.round("score", 5)).select("query", "neighbour", "score", "rank")


def vectors_valid(spark: SparkSession, d: str) -> DataFrame:
    return vectors.valid(table(spark, d, "embeddings"), 64, unit_within=1e-3).select("vec_id")


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text no other document of a smaller id has, without a vector of their id."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    return insights.findings(insights.health(_docs(spark, d))).withColumn("metric", F.round("metric", 6))


def stats(spark: SparkSession, d: str) -> DataFrame:
    measures = insights.health(_docs(spark, d))
    return insights.finding_stats(insights.findings(measures), measures.count()).withColumn("health", F.round("health", 6))


def worst_per_detector(spark: SparkSession, d: str) -> DataFrame:
    found = insights.findings(insights.health(_docs(spark, d)))
    return insights.top_per_group(found, ["finding"], [F.col("metric").desc(), F.col("document_id")], 3).select("finding", "document_id", "rank", "total")


def clones(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the same text."""
    return insights.clone_groups(table(spark, d, "documents"), "doc_id", F.sha2("text", 256), F.length("text"), 1)


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Code of the same shape among search documents."""
    return insights.clone_groups(_docs(spark, d), "document_id", F.sha2(insights.shape(F.col("code")), 256), F.length("code"), 20)


def dead(spark: SparkSession, d: str) -> DataFrame:
    out = insights.dead_code(symbols(spark, d), graph.arcs(merged(spark, d)), ["calls", "references", "imports", "extends", "implements", "instantiates", "overrides", "tests", "decorates"], ["function", "method", "class"], 10)
    return out.select("project_id", "symbol_id", "qualified_name", "rank", "total")


def hot(spark: SparkSession, d: str) -> DataFrame:
    return insights.hotspots(graph.arcs(merged(spark, d)), symbols(spark, d)).withColumn("pressure", F.round("pressure", 9))


def rollup(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("normalized_path").alias("path"), F.max("byte_size").alias("bytes"))
    return insights.directory_rollup(files, "path", {"files": F.count(F.lit(1)), "bytes": F.sum("bytes")})


def languages(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes by spelled-out language and parse status."""
    lang = F.coalesce(F.lower(F.trim("language")), F.lit("unknown"))
    long = F.create_map(*[F.lit(x) for kv in {"rs": "rust", "ts": "typescript", "js": "javascript", "py": "python", "cs": "csharp", "golang": "go"}.items() for x in kv])
    f = table(spark, d, "files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.coalesce(long[lang], lang)).alias("language"), F.max("parse_status").alias("status"), F.max("byte_size").alias("bytes"))
    return f.groupBy("language", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def reference_coverage(spark: SparkSession, d: str) -> DataFrame:
    """References by kind: resolved, unresolved, and distinct sources."""
    e = table(spark, d, "edges").select(F.lower(F.trim("edge_kind")).alias("kind"), "target_symbol_id", "source_symbol_id").distinct()
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("target_symbol_id").isNull().cast("long")).alias("unresolved"), F.count_distinct("source_symbol_id").alias("sources"))


def test_reach(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol: distinct sources that use it and test files that test it directly."""
    e = graph.arcs(merged(spark, d), graph.IMPACT_KINDS)
    at = symbols(spark, d).select("symbol_id", "file_id").distinct()
    by = e.join(at, F.col("source") == F.col("symbol_id"), "left")
    return by.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("users"), F.count_distinct(F.when(F.col("kind") == "tests", F.col("file_id"))).alias("test_files"))


def path_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).join(paths(spark, d), "file_id").withColumn("top", F.substring_index("path", "/", 1))
    return insights.top_per_group(s, ["top"], [F.col("pagerank").desc_nulls_last(), F.col("project_id"), F.col("symbol_id")], 3).select("top", "project_id", "symbol_id", "rank", "total")


def cochange(spark: SparkSession, d: str) -> DataFrame:
    """Files whose symbols changed in the same generations, generations being the commits."""
    from scoria.queries.problems import p1_found

    where = table(spark, d, "symbols").groupBy("project_id", "generation_id", "symbol_id").agg(F.max("file_id").alias("file_id"))
    c = p1_found(spark, d).where("change_kind <> 'removed'").join(where, ["project_id", "generation_id", "symbol_id"]).select(F.concat_ws("@", "project_id", "generation_id").alias("commit"), "file_id")
    return insights.cochanges(c, "commit", "file_id", 512, 2).withColumn("jaccard", F.round("jaccard", 9))


def part_cochange(spark: SparkSession, d: str) -> DataFrame:
    """Parts ordered together, orders being the commits."""
    return insights.cochanges(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 8, 2).withColumn("jaccard", F.round("jaccard", 9))


def edge_facets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(F.lower(F.trim("edge_kind")).alias("edge_kind"), "provenance", F.col("confidence").isNull().alias("unsure"))
    return insights.facets(e, ["edge_kind", "provenance", "unsure"], 5)


def call_usage(spark: SparkSession, d: str) -> DataFrame:
    return insights.usage(table(spark, d, "events"), "event_type", "value", F.col("value") < 1)


def symbol_diff(spark: SparkSession, d: str) -> DataFrame:
    """Modified symbols of each project between its current generation and the newest superseded one."""
    g = table(spark, d, "generations").where("published_at IS NOT NULL")
    newest = g.where("state = 'superseded'").groupBy("project_id").agg(F.max(F.struct("published_at", "generation_id")).alias("x")).select("project_id", F.col("x.generation_id").alias("generation_id"))
    digest = lambda s: s.withColumn("digest", hex_number(F.col("structural_digest")))
    old, new = digest(graph.symbols_of(table(spark, d, "symbols"), newest)), digest(symbols(spark, d))
    return insights.compare_symbols(old, new, ["project_id", "qualified_name", "symbol_kind"]).select("project_id", "qualified_name", "symbol_kind", "ordinal", "change", "reasons")


def path_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift between two tables made of the files' deliveries, taken as index and disk: a third of the paths is only on either side."""
    f = table(spark, d, "files").where("normalized_path IS NOT NULL")
    half = F.pmod(F.conv(F.substring(F.md5("normalized_path"), 1, 4), 16, 10).cast("int"), F.lit(3))
    old = f.where(half != 0).groupBy(F.col("normalized_path").alias("path")).agg(F.max("content_hash").alias("content_hash"))
    new = f.where(half != 1).groupBy(F.col("normalized_path").alias("path")).agg(F.max(F.when(half == 2, F.reverse("content_hash")).otherwise(F.col("content_hash"))).alias("content_hash"))
    return insights.drift(old, new)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of current symbols by a line report that is made from the files' ids: every third line is executed."""
    s = symbols(spark, d)
    lines = s.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(1), F.lit(1200), F.lit(3))).alias("line")).select("file_id", "line", (F.col("line") % 2).alias("hits"))
    return insights.line_coverage(lines, s.withColumn("symbol_id", F.concat_ws("@", "project_id", "symbol_id"))).withColumn("fraction", F.round("fraction", 9))


def kept_generations(spark: SparkSession, d: str) -> DataFrame:
    return insights.retention(table(spark, d, "generations"), 2)


def missing_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges that are no symbol of a current generation nor of the library."""
    known = symbols(spark, d).select("symbol_id").unionByName(table(spark, d, "library_symbols").select("symbol_id"))
    return insights.missing_keys(merged(spark, d), ["source", "target"], known, "symbol_id")


def digests(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("project_id", "generation_id", "symbol_id", "qualified_name", "start_line")
    return insights.logical_digest(s, ["symbol_id", "qualified_name", "start_line"], ["project_id", "generation_id"])


def reduced(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that were delivered with contradicting rows in a generation."""
    return insights.canonical_rows(table(spark, d, "symbols"), ["project_id", "generation_id", "symbol_id"], ["structural_digest", "start_line", "end_line"], "delivered_at")[1]


def carried(spark: SparkSession, d: str) -> DataFrame:
    """Scores that symbols of the current generation may keep from the newest superseded one, their structure being the same."""
    g = table(spark, d, "generations").where("published_at IS NOT NULL AND state = 'superseded'")
    newest = g.groupBy("project_id").agg(F.max(F.struct("published_at", "generation_id")).alias("x")).select("project_id", F.col("x.generation_id").alias("generation_id"))
    digest = lambda s: s.withColumn("digest", hex_number(F.col("structural_digest")))
    return insights.carried_forward(digest(graph.symbols_of(table(spark, d, "symbols"), newest)), digest(symbols(spark, d)), ["project_id", "symbol_id"], "digest", ["pagerank"])


_BM = r"""
WITH d AS (SELECT document_id AS doc, max(struct_pack(qualified_name := coalesce(qualified_name, ''), code := coalesce(code, ''), natural_text := coalesce(natural_text, ''))) AS r FROM search_documents WHERE document_id IS NOT NULL GROUP BY 1),
f AS (SELECT doc, 'qualified_name' AS field, r.qualified_name AS x FROM d UNION ALL SELECT doc, 'code', r.code FROM d UNION ALL SELECT doc, 'natural_text', r.natural_text FROM d),
w AS (SELECT doc, field, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM f),
i AS (SELECT doc, field, len(t) AS length, unnest(t) AS term FROM w),
p AS (SELECT doc, field, length, term, count(*) AS tf FROM i GROUP BY ALL),
l AS (SELECT field, sum(length) / count(*) AS average FROM (SELECT DISTINCT doc, field, length FROM p) GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
h AS (SELECT * FROM p WHERE term IN ('scanner', 'rollback', 'budget', 'jahofoze', 'trace')),
df AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT doc, field, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) AS x FROM h JOIN df USING (field, term) JOIN l USING (field), n)
"""
_HEALTH = r"""
WITH o AS (
  SELECT document_id, max(struct_pack(path := path, code := code, lines := json_extract_string(metadata, '$.health.lines')::DOUBLE, cyclomatic := json_extract_string(metadata, '$.health.cyclomatic')::DOUBLE, nesting := json_extract_string(metadata, '$.health.nesting')::DOUBLE)) AS r
  FROM search_documents WHERE document_id IS NOT NULL GROUP BY 1),
m AS (
  SELECT document_id, r.path AS path, r.lines AS lines, r.cyclomatic AS cyclomatic, r.nesting AS nesting,
    CASE WHEN r.lines >= 50 AND r.cyclomatic >= 8 THEN r.lines / 100 * r.cyclomatic / 10 * greatest(1.0, r.nesting / 3) ELSE 0 END AS brain,
    len(regexp_extract_all(coalesce(r.code, ''), 'TODO|FIXME|XXX')) AS markers, len(regexp_extract_all(coalesce(r.code, ''), '[^A-Za-z0-9_][0-9]{2,}')) AS numbers, len(regexp_extract_all(coalesce(r.code, ''), 'https?://')) AS urls FROM o),
k(finding, metric, info, warning, error) AS (VALUES ('large_method', 'lines', 100, 100, 200), ('complex_method', 'cyclomatic', 15, 15, 25), ('nested_complexity', 'nesting', 5, 5, 7), ('brain_method', 'brain', 5, 10, 20), ('incomplete_marker', 'markers', 1, 5, 50), ('magic_number', 'numbers', 3, 5, 8), ('hardcoded_url', 'urls', 1, 2, 3)),
u AS (SELECT document_id, path, k.finding, info, warning, error, CASE k.metric WHEN 'lines' THEN lines WHEN 'cyclomatic' THEN cyclomatic WHEN 'nesting' THEN nesting WHEN 'brain' THEN brain WHEN 'markers' THEN markers WHEN 'numbers' THEN numbers ELSE urls END AS v FROM m, k),
f AS (SELECT document_id, path, finding, v AS metric, CASE WHEN v >= error THEN 'error' WHEN v >= warning THEN 'warning' ELSE 'info' END AS severity FROM u WHERE v >= info)
"""
_PREV = _E + ", prev AS (SELECT DISTINCT ON (project_id) project_id, generation_id FROM generations WHERE published_at IS NOT NULL AND state = 'superseded' ORDER BY project_id, published_at DESC, generation_id DESC)"
_OLD = _PREV + ", olds AS (" + _E[_E.index("    SELECT DISTINCT ON (project_id, generation_id, symbol_id)") : _E.index("),\nfil")].rstrip(")").replace("JOIN gen USING", "JOIN prev USING") + ")"
_FUSED = _BM + """,
c AS (SELECT 'all' AS channel, doc, round(sum(x), 6) AS score FROM s GROUP BY 2 UNION ALL SELECT 'names', doc, round(sum(x), 6) FROM s WHERE field = 'qualified_name' GROUP BY 2 UNION ALL SELECT 'text', doc, round(sum(x), 6) FROM s WHERE field = 'natural_text' GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, doc) AS rank FROM c),
z AS (SELECT doc, sum(1.0 / (60 + rank)) AS score, min(rank) AS best_rank FROM r WHERE rank <= 20 GROUP BY 1),
t AS (SELECT document_id AS doc, CASE WHEN max(document_kind) = 'test' OR regexp_matches(max(path), '(^|/)tests?/') THEN 3 WHEN regexp_matches(max(path), '(?i)(^|/)(bench|benches|examples?|fixtures?|docs)/') THEN 2 ELSE 0 END AS tier FROM search_documents GROUP BY 1)
SELECT doc, round(score, 9) AS score, best_rank, tier, row_number() OVER (ORDER BY tier, score DESC, best_rank, doc) AS place FROM z JOIN t USING (doc)"""

QUERIES = {
    "r2_bm25": bm25_all, "r3_bm25_names": bm25_names, "r4_bm25_intent": bm25_intent, "r5_fuzzy": fuzzy_names, "r12_fused": fused, "r6_similar": similar, "r11_valid_vectors": vectors_valid, "r10_pending": pending,
    "i1_findings": all_findings, "i4_finding_stats": stats, "i4_worst": worst_per_detector, "i2_clones": clones, "i2_shapes": shapes, "i5_dead_code": dead, "i6_hotspots": hot, "a12_directories": rollup, "i14_languages": languages,
    "i9_reference_coverage": reference_coverage, "i12_test_reach": test_reach, "i15_path_symbols": path_symbols, "i17_cochange": cochange, "i17_part_cochange": part_cochange, "a11_facets": edge_facets,
    "i28_usage": call_usage, "i22_symbol_diff": symbol_diff, "i21_drift": path_drift, "i13_coverage": coverage, "i29_retention": kept_generations, "i31_missing": missing_ends, "i32_digests": digests, "i30_conflicts": reduced, "i33_carried": carried,
}

SQL = {
    "r2_bm25": _BM + "SELECT doc, round(sum(x), 6) AS score, string_agg(DISTINCT field, ',' ORDER BY field) AS matched FROM s GROUP BY 1",
    "r3_bm25_names": _BM + "SELECT doc, round(sum(x), 6) AS score, string_agg(DISTINCT field, ',' ORDER BY field) AS matched FROM s WHERE field = 'qualified_name' GROUP BY 1",
    "r4_bm25_intent": _BM + "SELECT doc, round(sum(x), 6) AS score, string_agg(DISTINCT field, ',' ORDER BY field) AS matched FROM s WHERE field = 'natural_text' GROUP BY 1",
    "r5_fuzzy": _BM + "SELECT DISTINCT term, levenshtein(term, 'flush') AS edits FROM p WHERE field = 'qualified_name' AND levenshtein(term, 'flush') <= 2",
    "r12_fused": _FUSED,
    "r6_similar": "SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5",
    "r11_valid_vectors": "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001",
    "r10_pending": "SELECT doc_id FROM (SELECT min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY text) WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "i1_findings": _HEALTH + "SELECT document_id, path, finding, round(metric, 6) AS metric, severity FROM f",
    "i4_finding_stats": _HEALTH + ", g AS (SELECT finding, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM f GROUP BY 1) SELECT *, round(greatest(0.0, 100 - (4 * errors + 2 * warnings + infos) * 100 / (SELECT count(*) FROM m)), 6) AS health FROM g",
    "i4_worst": _HEALTH + "SELECT finding, document_id, row_number() OVER (PARTITION BY finding ORDER BY metric DESC, document_id) AS rank, count(*) OVER (PARTITION BY finding) AS total FROM f QUALIFY rank <= 3",
    "i2_clones": "SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS members, min(doc_id) AS representative FROM documents WHERE len(text) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "i2_shapes": "SELECT sha256(regexp_replace(regexp_replace(regexp_replace(code, '[A-Za-z_]+', 'a', 'g'), '[0-9]+', '9', 'g'), '\\s+', ' ', 'g')) AS digest, count(DISTINCT document_id) AS members, min(document_id) AS representative FROM search_documents WHERE len(code) >= 20 AND document_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT document_id) > 1",
    "i5_dead_code": _E + "SELECT project_id, symbol_id, qualified_name, row_number() OVER (PARTITION BY project_id ORDER BY pagerank DESC NULLS LAST, symbol_id) AS rank, count(*) OVER (PARTITION BY project_id) AS total FROM sym WHERE symbol_kind IN ('function', 'method', 'class') AND NOT coalesce(exported, false) AND symbol_id NOT IN (SELECT target FROM arc WHERE source <> target AND kind IN ('calls', 'references', 'imports', 'extends', 'implements', 'instantiates', 'overrides', 'tests', 'decorates')) QUALIFY rank <= 10",
    "i6_hotspots": _E + """, wh AS (SELECT DISTINCT symbol_id, file_id FROM sym), i AS (SELECT file_id, count(*) AS inbound FROM arc JOIN wh ON symbol_id = target GROUP BY 1), o AS (SELECT file_id, count(*) AS outbound, count(*) FILTER (confidence < 0.5) AS unresolved FROM arc JOIN wh ON symbol_id = source GROUP BY 1),
        x AS (SELECT file_id, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(unresolved, 0) AS unresolved, 3 * coalesce(inbound, 0) + 2 * coalesce(outbound, 0) + coalesce(unresolved, 0) AS structural_risk FROM i FULL JOIN o USING (file_id))
        SELECT *, round(structural_risk / (SELECT max(structural_risk) FROM x), 9) AS pressure FROM x""",
    "a12_directories": "WITH f AS (SELECT file_id, string_split(max(normalized_path), '/') AS p, max(byte_size) AS b FROM files WHERE file_id IS NOT NULL GROUP BY 1), x AS (SELECT unnest(CASE WHEN len(p) < 2 THEN ['.'] ELSE list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/')) END) AS directory, b FROM f) SELECT directory, count(*) AS files, sum(b)::BIGINT AS bytes, CASE WHEN directory = '.' THEN 0 ELSE len(string_split(directory, '/')) END AS depth FROM x GROUP BY 1",
    "i14_languages": "WITH f AS (SELECT file_id, max(CASE lower(trim(language)) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'cs' THEN 'csharp' WHEN 'golang' THEN 'go' ELSE coalesce(lower(trim(language)), 'unknown') END) AS language, max(parse_status) AS status, max(byte_size) AS bytes FROM files WHERE file_id IS NOT NULL GROUP BY 1) SELECT language, status, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f GROUP BY 1, 2",
    "i9_reference_coverage": "SELECT kind, count(*) AS n, count(*) FILTER (t IS NULL) AS unresolved, count(DISTINCT s) AS sources FROM (SELECT DISTINCT lower(trim(edge_kind)) AS kind, target_symbol_id AS t, source_symbol_id AS s FROM edges) GROUP BY 1",
    "i12_test_reach": _E + "SELECT target AS node, count(DISTINCT source) AS users, count(DISTINCT CASE WHEN kind = 'tests' THEN file_id END) AS test_files FROM arc LEFT JOIN (SELECT DISTINCT symbol_id, file_id FROM sym) ON symbol_id = source WHERE kind <> 'contains' GROUP BY 1",
    "i15_path_symbols": _E + "SELECT string_split(path, '/')[1] AS top, project_id, symbol_id, row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY pagerank DESC NULLS LAST, project_id, symbol_id) AS rank, count(*) OVER (PARTITION BY string_split(path, '/')[1]) AS total FROM sym JOIN fil USING (file_id) QUALIFY rank <= 3",
    "i17_part_cochange": "WITH o AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS x FROM lineitem), n AS (SELECT x, count(*) AS n FROM o GROUP BY 1), k AS (SELECT c FROM o GROUP BY 1 HAVING count(*) <= 8), s AS (SELECT * FROM o JOIN k USING (c)), p AS (SELECT a.x AS a, b.x AS b, count(*) AS shared FROM s a JOIN s b ON a.c = b.c AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, shared, na.n AS commits_a, nb.n AS commits_b, round(shared / (na.n + nb.n - shared), 9) AS jaccard FROM p JOIN n na ON na.x = a JOIN n nb ON nb.x = b",
    "a11_facets": "WITH e AS (SELECT lower(trim(edge_kind)) AS k, provenance AS p, (confidence IS NULL)::VARCHAR AS u FROM edges), x AS (SELECT 'edge_kind' AS dimension, coalesce(k, 'none_observed') AS value FROM e UNION ALL SELECT 'provenance', coalesce(p, 'none_observed') FROM e UNION ALL SELECT 'unsure', u FROM e), n AS (SELECT dimension, value, count(*) AS n FROM x GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value = 'none_observed', value) AS rank FROM n QUALIFY rank <= 5",
    "i28_usage": "SELECT event_type, count(*) AS calls, count(*) FILTER (value < 1) AS failures, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS longest FROM events GROUP BY 1",
    "i22_symbol_diff": _OLD + f""",
        a AS (SELECT project_id, qualified_name, symbol_kind, row_number() OVER (PARTITION BY project_id, qualified_name, symbol_kind ORDER BY start_line, symbol_id) AS ordinal, file_id, signature, {_HEX} AS digest, visibility, exported, declaration_only FROM olds),
        b AS (SELECT project_id, qualified_name, symbol_kind, row_number() OVER (PARTITION BY project_id, qualified_name, symbol_kind ORDER BY start_line, symbol_id) AS ordinal, file_id, signature, {_HEX} AS digest, visibility, exported, declaration_only FROM sym),
        x AS (SELECT project_id, qualified_name, symbol_kind, ordinal, CASE WHEN a.file_id IS NULL THEN 'added' WHEN b.file_id IS NULL THEN 'removed' ELSE 'modified' END AS change,
          CASE WHEN a.file_id IS NULL OR b.file_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.file_id IS DISTINCT FROM b.file_id THEN 'moved_file' END, CASE WHEN a.signature IS DISTINCT FROM b.signature THEN 'signature' END, CASE WHEN a.digest IS DISTINCT FROM b.digest THEN 'structure' END, CASE WHEN a.visibility IS DISTINCT FROM b.visibility THEN 'visibility' END, CASE WHEN a.exported IS DISTINCT FROM b.exported THEN 'exported' END, CASE WHEN a.declaration_only IS DISTINCT FROM b.declaration_only THEN 'declaration' END) END AS reasons
          FROM a FULL JOIN b USING (project_id, qualified_name, symbol_kind, ordinal))
        SELECT * FROM x WHERE change <> 'modified' OR reasons <> ''""",
    "i13_coverage": _E + "SELECT project_id || '@' || symbol_id AS symbol_id, count(*) AS found, sum(l.n % 2)::BIGINT AS hit, round(sum(l.n % 2) / count(*), 9) AS fraction FROM sym JOIN (SELECT range AS n FROM range(1, 1201, 3)) l ON l.n BETWEEN start_line AND end_line WHERE file_id IS NOT NULL GROUP BY 1",
    "i29_retention": "SELECT project_id, generation_id, state, row_number() OVER (PARTITION BY project_id, state ORDER BY staged_at DESC NULLS LAST, generation_id DESC) AS age, state = 'current' OR age <= 2 AS kept FROM generations",
    "i31_missing": _E + ", k AS (SELECT symbol_id FROM sym UNION SELECT symbol_id FROM library_symbols) SELECT 'source' AS relation, source AS missing FROM (SELECT source FROM e EXCEPT SELECT symbol_id FROM k) UNION ALL SELECT 'target', target FROM (SELECT target FROM e EXCEPT SELECT symbol_id FROM k)",
    "i32_digests": "WITH h AS (SELECT DISTINCT project_id, generation_id, sha256(concat(" + ", ".join(f"coalesce(len({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("symbol_id", "qualified_name", "start_line")) + ")) AS h FROM symbols) SELECT project_id, generation_id, count(*) AS rows, concat_ws('-', " + ", ".join(f"sum(('0x' || h[{1 + 12 * i}:{12 + 12 * i}])::BIGINT)::VARCHAR" for i in range(4)) + ") AS digest FROM h GROUP BY 1, 2",
    "i21_drift": "WITH f AS (SELECT normalized_path AS path, content_hash AS h, ('0x' || md5(normalized_path)[1:4])::INT % 3 AS k FROM files WHERE normalized_path IS NOT NULL), a AS (SELECT path, max(h) AS was FROM f WHERE k <> 0 GROUP BY 1), b AS (SELECT path, max(CASE WHEN k = 2 THEN reverse(h) ELSE h END) AS now FROM f WHERE k <> 1 GROUP BY 1), x AS (SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN was IS DISTINCT FROM now THEN 'modified' END AS change FROM a FULL JOIN b USING (path)) SELECT * FROM x WHERE change IS NOT NULL",
    "i17_cochange": "WITH ch AS (" + _P1 + "), w AS (SELECT project_id, generation_id, symbol_id, max(file_id) AS file_id FROM symbols GROUP BY ALL), o AS (SELECT DISTINCT project_id || '@' || generation_id AS c, file_id AS x FROM ch JOIN w USING (project_id, generation_id, symbol_id) WHERE change_kind <> 'removed' AND file_id IS NOT NULL), n AS (SELECT x, count(*) AS n FROM o GROUP BY 1), k AS (SELECT c FROM o GROUP BY 1 HAVING count(*) <= 512), s AS (SELECT * FROM o JOIN k USING (c)), p AS (SELECT a.x AS a, b.x AS b, count(*) AS shared FROM s a JOIN s b ON a.c = b.c AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, shared, na.n AS commits_a, nb.n AS commits_b, round(shared / (na.n + nb.n - shared), 9) AS jaccard FROM p JOIN n na ON na.x = a JOIN n nb ON nb.x = b",
    "i30_conflicts": "SELECT project_id, generation_id, symbol_id, count(DISTINCT (coalesce(structural_digest, 'null') || '|' || start_line || '|' || end_line)) AS variants FROM symbols GROUP BY 1, 2, 3 HAVING variants > 1",
    "i33_carried": _OLD + f"SELECT s.project_id, s.symbol_id, {_HEX.replace('structural_digest', 's.structural_digest')} AS digest, o.pagerank AS pagerank FROM sym s JOIN olds o ON o.project_id = s.project_id AND o.symbol_id = s.symbol_id AND {_HEX.replace('structural_digest', 's.structural_digest')} = {_HEX.replace('structural_digest', 'o.structural_digest')}",
}
