"""Queries of lookups, detectors, packets and histories with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.operators import context, detectors, graph, history, lookup, search
from scoria.operators.skew import canonical
from scoria.operators.snapshots import hex_number
from scoria.plans.runtime import table
from scoria.queries.graph import _E, _R, TEST_PATH, fence, merged, paths, symbols
from scoria.queries.insights import _BM, _PREV
from scoria.queries.problems import _HEX

NAMES = ["flush_handler", "build_trace"]
TASK = "Fix how the budget scanner rolls back a trace, see `build_trace` and tests"
PATH = "src/"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files")


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Current symbols with path and spelled language of their file."""
    lang = _files(spark, d).where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.lower(F.trim("language"))).alias("language"), F.max("normalized_path").alias("path"))
    return symbols(spark, d).join(lang, "file_id")


def _named(spark: SparkSession, d: str) -> DataFrame:
    lib = table(spark, d, "library_symbols").select("symbol_id", "qualified_name").withColumn("simple_name", graph.simple_name(F.col("qualified_name")))
    return symbols(spark, d).select("symbol_id", "qualified_name", "simple_name").unionByName(lib).distinct()


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return lookup.reference_sites(table(spark, d, "edges"), symbols(spark, d), table(spark, d, "library_symbols"))


def files_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Files at three paths: the first by name, the last, and one there is none of."""
    known = _files(spark, d).where("normalized_path IS NOT NULL").agg(F.min("normalized_path").alias("a"), F.max("normalized_path").alias("b")).first()
    return lookup.files_at(_files(spark, d), [known["a"], known["b"], "no/such/file"]).select("file_id", "normalized_path", "content_hash")


def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of all test files, in the order of their lines."""
    tests = paths(spark, d).where(F.col("path").rlike(TEST_PATH))
    return lookup.symbols_in(symbols(spark, d), tests)


def symbols_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = [r["symbol_id"] for r in symbols(spark, d).select("symbol_id").distinct().orderBy("symbol_id").limit(5).collect()]
    return lookup.symbols_by_id(symbols(spark, d), [*ids[::-1], "no such id", *ids[:1]])


def references_named(spark: SparkSession, d: str) -> DataFrame:
    return lookup.references_by_name(_sites(spark, d), NAMES).select("name", "file_id", "line", "owner", "kind", "target", "place")


def entries(spark: SparkSession, d: str) -> DataFrame:
    used = graph.arcs(merged(spark, d), graph.IMPACT_KINDS).where("source <> target").select(F.col("target").alias("symbol_id"))
    return lookup.entry_points(_located(spark, d), used, 20)


def qualified_query(spark: SparkSession, d: str) -> DataFrame:
    return lookup.qualified(_located(spark, d), graph.arcs(merged(spark, d)), _named(spark, d), "kind:function kind:method path:src/ name:trace centrality:<=0.01")


def qualified_calls(spark: SparkSession, d: str) -> DataFrame:
    """The callers of what has most callers, by name."""
    top = graph.arcs(merged(spark, d), ("calls",)).join(_named(spark, d).select(F.col("symbol_id").alias("target"), "qualified_name"), "target").groupBy("qualified_name").agg(F.count_distinct("source").alias("n")).orderBy(F.col("n").desc(), "qualified_name").first()["qualified_name"]
    return lookup.qualified(_located(spark, d), graph.arcs(merged(spark, d)), _named(spark, d), f'callers-of:"{top}" sort:name')


def imports_between(spark: SparkSession, d: str) -> DataFrame:
    return lookup.import_evidence(graph.arcs(merged(spark, d)), symbols(spark, d), paths(spark, d))


def packages(spark: SparkSession, d: str) -> DataFrame:
    texts = _files(spark, d).where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("normalized_path").alias("path"), F.max("source_text").alias("text"))
    lang = F.when(F.col("path").endswith(".ts"), "typescript").when(F.col("path").endswith(".js"), "javascript")
    return lookup.external_imports(texts.withColumn("language", lang))


def rename(spark: SparkSession, d: str) -> DataFrame:
    """What renaming the most referenced function would touch."""
    top = _sites(spark, d).where("name IS NOT NULL").groupBy("target", "name").agg(F.count_distinct("file_id").alias("n")).orderBy(F.col("n").desc(), "target").first()
    texts = _files(spark, d).where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("source_text").alias("text"))
    return lookup.rename_plan(_sites(spark, d), texts, top["target"], top["name"])


def same_names(spark: SparkSession, d: str) -> DataFrame:
    return lookup.same_names_elsewhere(symbols(spark, d), ["method"])


def scip_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Edges where those of sources that an index covers come from the index alone."""
    e = merged(spark, d)
    index = e.where("provenance = 'scip'")
    return lookup.overlay(e.where("provenance <> 'scip'"), index, index, "source").select("source", "target", "kind", "provenance")


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percent rank of symbols by incoming sites, over all of them."""
    n = graph.arcs(merged(spark, d)).groupBy(F.col("target").alias("symbol_id")).agg(F.sum("sites").alias("sites"))
    s = symbols(spark, d).select("project_id", "symbol_id").join(n, "symbol_id", "left").withColumn("sites", F.coalesce("sites", F.lit(0)))
    return lookup.percent_ranks(s, ["project_id", "symbol_id"], "sites").withColumn("percentile", F.round("percentile", 9))


def test_impact(spark: SparkSession, d: str) -> DataFrame:
    """The tests that a change of any file below src could break, two steps away at most."""
    files = paths(spark, d).where(F.col("path").startswith(PATH))
    return graph.file_test_impact(files, graph.arcs(merged(spark, d), graph.IMPACT_KINDS), symbols(spark, d), paths(spark, d), 2, TEST_PATH, lookup.PATH_CLASSES["barrel"])


def _previous(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generations").where("published_at IS NOT NULL AND state = 'superseded'")
    newest = g.groupBy("project_id").agg(F.max(F.struct("published_at", "generation_id")).alias("x")).select("project_id", F.col("x.generation_id").alias("generation_id"), F.col("x.published_at").alias("published_at"))
    return graph.symbols_of(table(spark, d, "symbols"), newest.select("project_id", "generation_id")).join(F.broadcast(newest.select("project_id", "published_at")), "project_id")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(canonical(F.col("source_symbol_id")).alias("source"), canonical(F.col("target_symbol_id")).alias("target"), canonical(F.col("edge_kind")).alias("kind"), "provenance", F.col("site_count").alias("sites"), "confidence").distinct()
    current = symbols(spark, d).withColumn("digest", hex_number(F.col("structural_digest")))
    # Coverage as reports would give it: from the symbols' scores, for want of a report.
    coverage = current.groupBy("symbol_id").agg(F.max(F.col("pagerank") * 100).alias("fraction"))
    return detectors.symbol_measures(current, graph.arcs(merged(spark, d)), e, table(spark, d, "search_documents"), _previous(spark, d), paths(spark, d), coverage)


def symbol_findings(spark: SparkSession, d: str) -> DataFrame:
    return detectors.symbol_findings(_measures(spark, d)).withColumn("metric", F.round("metric", 6))


def text_findings(spark: SparkSession, d: str) -> DataFrame:
    return detectors.text_findings(_files(spark, d), "file_id", "source_text")


def copies_detail(spark: SparkSession, d: str) -> DataFrame:
    """The members of each group of documents with one text, ten at most, and their number."""
    docs = table(spark, d, "documents").where("text <> ''").select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("member"))
    many = docs.groupBy("key").agg(F.count_distinct("member").alias("k")).where("k > 1")
    return detectors.finding_details(many, docs)


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generations").where("state = 'current'").select("project_id", F.col("generation_id").alias("now"))
    before = table(spark, d, "generations").where("state = 'superseded'").groupBy("project_id").agg(F.max("generation_id").alias("prior"))
    return detectors.findings_fingerprint(g.join(before, "project_id", "left"), ["project_id", "now", "prior"]).select("project_id", "fingerprint")


def edit_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_documents").where("document_id IS NOT NULL")
    return context.edit_candidates(docs, context.task_terms(TASK.replace("`build_trace`", "")), [])


def packet_states(spark: SparkSession, d: str) -> DataFrame:
    """What became of each channel of a task that names code, without vectors."""
    states = context.context_packet(TASK, table(spark, d, "search_documents")).states
    return spark.createDataFrame(sorted(states.items()), "channel string, state string")


def packet_evidence(spark: SparkSession, d: str) -> DataFrame:
    return context.context_packet(TASK, table(spark, d, "search_documents")).evidence.withColumn("score", F.round("score", 9))


def packet_tests(spark: SparkSession, d: str) -> DataFrame:
    return context.context_packet(TASK, table(spark, d, "search_documents")).tests


def supplier_peers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share orders, orders of more than four suppliers left out."""
    return history.peers(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 4, 3).withColumn("jaccard", F.round("jaccard", 9))


def order_peers(spark: SparkSession, d: str) -> DataFrame:
    return history.commit_peers(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", [7, 3, 99, 3], 2)


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Current symbols whose structure has changed since the generation before, for which summaries were made."""
    digest = lambda s: s.withColumn("digest", hex_number(F.col("structural_digest"))).where("digest IS NOT NULL").select("project_id", "symbol_id", "digest", "pagerank")
    return history.pending_summaries(digest(symbols(spark, d)), digest(_previous(spark, d)), ["project_id", "symbol_id"], "digest", [F.col("pagerank").desc_nulls_last(), F.col("symbol_id")], 25)


def queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue of the symbols with incoming calls after one more hit of those whose names have a word of the task."""
    old = graph.arcs(merged(spark, d), ("calls",)).groupBy(F.col("target").alias("symbol_id")).agg(F.count(F.lit(1)).cast("int").alias("priority"))
    hits = symbols(spark, d).where(F.lower("simple_name").rlike("trace|budget"))
    return history.enqueue(old, hits, 5)


def embedding_readiness(spark: SparkSession, d: str) -> DataFrame:
    return history.readiness(table(spark, d, "documents"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", 64)


def fuzzy_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_ranked(search.postings(table(spark, d, "search_documents"), ("qualified_name",)), "flush", 2).withColumn("score", F.round("score", 9))


def next_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten of the current symbols by kind, name and id."""
    s = symbols(spark, d).select("symbol_kind", "qualified_name", "symbol_id", "project_id")
    order = ["symbol_kind", "qualified_name", "symbol_id", "project_id"]
    first = lookup.page_after(s, order, None, 10).collect()
    return lookup.page_after(s, order, tuple(first[9]), 10)


def exchanged(spark: SparkSession, d: str) -> DataFrame:
    files = paths(spark, d)
    return lookup.interchange(files, symbols(spark, d), merged(spark, d), _sites(spark, d).where("line IS NOT NULL")).groupBy("relation", "block").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))


def symbol_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per project: the names of its first symbols in order, and the number of each kind as text."""
    s = symbols(spark, d).select("project_id", "symbol_kind", "symbol_id")
    kinds = s.groupBy("project_id", "symbol_kind").agg(F.count(F.lit(1)).alias("n")).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol_kind", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    from pyspark.sql import Window

    first = s.withColumn("at", F.row_number().over(Window.partitionBy("project_id").orderBy("symbol_id"))).where("at <= 5").groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol_id"))), lambda x: x["symbol_id"]), ",").alias("first"))
    return kinds.select("project_id", text.alias("kinds")).join(first, "project_id")


_LIB = """, lib AS (SELECT symbol_id, list_extract(string_split(replace(qualified_name, '::', '.'), '.'), -1) AS simple_name, qualified_name FROM library_symbols),
  nam AS (SELECT DISTINCT symbol_id, qualified_name, simple_name FROM sym UNION SELECT symbol_id, qualified_name, simple_name FROM lib),
  loc AS (SELECT sym.*, path, language FROM sym JOIN (SELECT file_id, max(normalized_path) AS path, max(lower(trim(language))) AS language FROM files WHERE file_id IS NOT NULL GROUP BY 1) USING (file_id)),
  allraw AS (SELECT DISTINCT lower(regexp_replace(source_symbol_id, '^\\s+|\\s+$', '', 'g')) AS source, lower(regexp_replace(target_symbol_id, '^\\s+|\\s+$', '', 'g')) AS target, lower(regexp_replace(edge_kind, '^\\s+|\\s+$', '', 'g')) AS kind, provenance, site_count, confidence FROM edges),
  site AS (SELECT DISTINCT file_id, start_line AS line, symbol_id AS owner, r.target, name, kind, confidence, provenance, site_count AS sites FROM (SELECT * FROM allraw) r JOIN (SELECT DISTINCT symbol_id, file_id, start_line FROM sym) o ON o.symbol_id = source LEFT JOIN (SELECT symbol_id AS target, min(simple_name) AS name FROM nam GROUP BY 1) n ON n.target = r.target)
"""
_TERMS = ", ".join(f"'{t}'" for t in context.task_terms(TASK.replace("`build_trace`", "")))
_TOKENS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
_SPAN = "end_line - start_line + 1"
_BASE = _PREV + f""",
  cur AS (SELECT *, {_HEX} AS digest, {_SPAN} AS span FROM sym),
  old AS (SELECT DISTINCT ON (project_id, symbol_id) s.*, g.published_at FROM symbols s JOIN prev USING (project_id, generation_id) JOIN generations g USING (project_id, generation_id) ORDER BY project_id, symbol_id, delivered_at DESC NULLS LAST, file_id DESC NULLS LAST, symbol_kind DESC NULLS LAST, qualified_name DESC NULLS LAST, signature DESC NULLS LAST, start_line DESC NULLS LAST, end_line DESC NULLS LAST),
  loci AS (SELECT DISTINCT symbol_id, file_id FROM sym),
  hea AS (SELECT symbol_id, max(json_extract_string(metadata, '$.health.lines')::DOUBLE) AS lines, max(json_extract_string(metadata, '$.health.cyclomatic')::DOUBLE) AS cyclomatic, max(json_extract_string(metadata, '$.health.nesting')::DOUBLE) AS nesting FROM search_documents WHERE symbol_id IS NOT NULL GROUP BY 1),
  cont AS (SELECT DISTINCT source, target FROM arc WHERE kind = 'contains'),
  outg AS (SELECT source AS symbol_id, count(DISTINCT target) AS outgoing FROM arc ANTI JOIN cont USING (source, target) WHERE kind <> 'contains' AND source <> target GROUP BY 1),
  unre AS (SELECT s AS symbol_id, sum(site_count) AS unresolved FROM (SELECT DISTINCT lower(regexp_replace(source_symbol_id, '^\\s+|\\s+$', '', 'g')) AS s, lower(regexp_replace(edge_kind, '^\\s+|\\s+$', '', 'g')) AS k, provenance, site_count, confidence FROM edges WHERE target_symbol_id IS NULL) GROUP BY 1),
  inc AS (SELECT target AS symbol_id, count(*) AS incoming FROM arc JOIN loci a ON a.symbol_id = source JOIN loci b ON b.symbol_id = target WHERE kind <> 'contains' AND source <> target AND a.file_id <> b.file_id GROUP BY 1),
  mem AS (SELECT source AS symbol_id, sum((member_span >= 5)::INT) AS behaviour, sum((cyclomatic >= 3)::INT) AS complex FROM cont JOIN (SELECT symbol_id AS target, max(span) AS member_span FROM cur WHERE symbol_kind IN ('function', 'method', 'component') GROUP BY 1) m USING (target) LEFT JOIN hea ON hea.symbol_id = target GROUP BY 1),
  rds AS (SELECT r.source AS symbol_id, o.source AS of_, w.source AS own FROM (SELECT DISTINCT source, target FROM arc WHERE kind = 'field_access') r JOIN cont o ON o.target = r.target LEFT JOIN cont w ON w.target = r.source),
  env AS (SELECT symbol_id, sum((of_ IS DISTINCT FROM own)::INT) AS foreign_, count(DISTINCT CASE WHEN of_ IS DISTINCT FROM own THEN of_ END) AS providers, count(*) AS reads FROM rds GROUP BY 1),
  cop AS (SELECT project_id, symbol_id, max(n) AS copies FROM (SELECT project_id, count(DISTINCT symbol_id) AS n, min(symbol_id) AS symbol_id FROM cur WHERE digest IS NOT NULL AND span >= 6 AND symbol_kind IN ('function', 'method', 'component') GROUP BY project_id, digest HAVING count(DISTINCT symbol_id) > 1) GROUP BY 1, 2),
  cov AS (SELECT symbol_id, max(pagerank * 100) AS fraction FROM sym GROUP BY 1),
  bas AS (SELECT cur.project_id, cur.symbol_id, cur.symbol_kind AS k, cur.symbol_kind IN ('function', 'method', 'component') AS x, cur.symbol_kind IN ('class', 'struct', 'module') AS c, span, cur.signature, cur.exported, coalesce(cur.declaration_only, false) AS decl, path, lines, cyclomatic, nesting, outgoing, unresolved, coalesce(incoming, 0) AS incoming, behaviour, complex, foreign_, providers, reads, copies, old.end_line - old.start_line + 1 AS prior, old.published_at, (SELECT max(published_at) FROM old) AS latest, fraction,
      trim(regexp_replace(regexp_extract(coalesce(cur.signature, ''), '\\(((?:[^()]|\\([^()]*\\))*)\\)', 1), '\\([^()]*\\)|\\[[^\\[\\]]*\\]|\\{{[^{{}}]*\\}}|<[^<>]*>', '', 'g'), ' ') AS pars
    FROM cur LEFT JOIN fil USING (file_id) LEFT JOIN hea USING (symbol_id) LEFT JOIN outg USING (symbol_id) LEFT JOIN unre USING (symbol_id) LEFT JOIN inc USING (symbol_id) LEFT JOIN mem USING (symbol_id) LEFT JOIN env USING (symbol_id) LEFT JOIN cop USING (project_id, symbol_id) LEFT JOIN cov USING (symbol_id) LEFT JOIN old USING (project_id, symbol_id)),
  det(finding, info, warning, error) AS (VALUES {', '.join(f"('{n}', {i}, {w}, {e})" for n, (_, i, w, e, _) in detectors.DETECTORS.items())}),
  val AS (SELECT project_id, symbol_id, det.*, CASE finding
    WHEN 'large_method' THEN CASE WHEN x THEN lines END WHEN 'complex_method' THEN CASE WHEN x THEN cyclomatic END WHEN 'nested_complexity' THEN CASE WHEN x THEN nesting END
    WHEN 'long_parameter_list' THEN CASE WHEN x AND NOT decl THEN CASE WHEN pars = '' THEN 0 ELSE len(pars) - len(replace(pars, ',', '')) + 1 END END
    WHEN 'brain_method' THEN CASE WHEN x AND lines >= 50 AND cyclomatic >= 8 THEN lines / 100 * cyclomatic / 10 * greatest(1.0, coalesce(nesting, 0) / 3) END
    WHEN 'recently_grew' THEN CASE WHEN x AND prior >= 20 AND span > 1.5 * prior AND date_diff('day', published_at::DATE, latest::DATE) <= 30 THEN span * 100 / prior END
    WHEN 'god_class' THEN CASE WHEN c AND complex >= 5 THEN behaviour END WHEN 'feature_envy' THEN CASE WHEN k = 'method' AND providers <= 2 AND (reads - foreign_) * 3 < reads THEN foreign_ END
    WHEN 'unused_export' THEN CASE WHEN exported AND NOT regexp_matches(path, '(^|/)tests?/') AND NOT ends_with(path, '.py') AND NOT ends_with(path, '.d.ts') THEN (incoming = 0)::INT END
    WHEN 'low_coverage' THEN CASE WHEN x AND fraction <= 0.5 THEN (1 - fraction) * 100 END WHEN 'duplicate_code' THEN CASE WHEN x THEN copies END
    WHEN 'high_fan_out' THEN CASE WHEN x OR c THEN outgoing END WHEN 'unresolved_reference_pressure' THEN unresolved END::DOUBLE AS metric FROM bas, det)
"""
_quote = lambda p: p.replace("'", "''")
_COUNTS = " ".join(f"WHEN '{n}' THEN len(regexp_extract_all(code, '{_quote(p)}'))" + (f" - len(regexp_extract_all(code, '{_quote(detectors.EXCEPT[n])}'))" if n in detectors.EXCEPT else "") for n, (p, *_) in detectors.TEXT_DETECTORS.items())
_LEVELS = ", ".join(f"('{n}', {i}, {w}, {e})" for n, (_, i, w, e) in detectors.TEXT_DETECTORS.items())

#: The packet's channels, ranks and fused places.
_PACKET = _BM.replace("('scanner', 'rollback', 'budget', 'jahofoze', 'trace')", "(" + ", ".join(f"'{t}'" for t in context.task_terms(TASK)) + ")") + """,
x AS (SELECT DISTINCT document_id AS doc FROM search_documents WHERE document_id IS NOT NULL AND (qualified_name IN ({0}) OR path IN ({0}) OR list_extract(string_split(replace(qualified_name, '::', '.'), '.'), -1) IN ({0}))),
c AS (SELECT 'exact' AS channel, doc, 1.0 AS score FROM x UNION ALL SELECT 'all', doc, round(sum(x), 6) FROM s GROUP BY 2 UNION ALL SELECT 'names', doc, round(sum(x), 6) FROM s WHERE field = 'qualified_name' GROUP BY 2 UNION ALL SELECT 'text', doc, round(sum(x), 6) FROM s WHERE field = 'natural_text' GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, doc) AS rank FROM c),
z AS (SELECT doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank FROM r WHERE rank <= 20 GROUP BY 1),
t AS (SELECT document_id AS doc, CASE WHEN max(document_kind) = 'test' OR regexp_matches(max(path), '(^|/)tests?/') THEN 3 WHEN regexp_matches(max(path), '(?i)(^|/)(bench|benches|examples?|fixtures?|docs)/') THEN 2 ELSE 0 END AS tier FROM search_documents GROUP BY 1),
ev AS (SELECT doc, score, best_rank, tier, row_number() OVER (ORDER BY tier, score DESC, best_rank, doc) AS place FROM z JOIN t USING (doc))
""".replace("{0}", ", ".join(f"'{a}'" for a in context.anchors(TASK)))

QUERIES = {
    "q1_files_at": files_by_path, "q3_file_symbols": file_symbols, "q5_symbols_by_id": symbols_by_id, "q6_references": references_named, "q7_entry_buckets": entries, "q9_qualified": qualified_query, "q9_callers_of": qualified_calls,
    "i7_imports": imports_between, "i8_packages": packages, "i11_rename": rename, "j13_same_names": same_names, "s11_overlay": scip_overlay, "w_percentiles": percentiles, "g6_test_impact": test_impact,
    "i1_symbol_findings": symbol_findings, "i1_text_findings": text_findings, "i1_details": copies_detail, "i3_fingerprints": fingerprints, "r16_edit_files": edit_files, "r14_states": packet_states, "r16_evidence": packet_evidence, "r16_tests": packet_tests,
    "i18_peers": supplier_peers, "i19_commit_peers": order_peers, "i26_pending": pending, "i27_queue": queue, "r7_readiness": embedding_readiness, "r5_fuzzy_documents": fuzzy_documents, "l_next_page": next_page, "s13_interchange": exchanged, "a6_lists": symbol_lists,
}

SQL = {
    "q1_files_at": "WITH f AS (SELECT DISTINCT ON (file_id) * FROM files WHERE file_id IS NOT NULL ORDER BY file_id, delivered_at DESC NULLS LAST, normalized_path DESC NULLS LAST, language DESC NULLS LAST, content_hash DESC NULLS LAST) SELECT file_id, normalized_path, content_hash FROM f WHERE normalized_path IN (SELECT min(normalized_path) FROM files UNION SELECT max(normalized_path) FROM files)",
    "q3_file_symbols": _E + "SELECT project_id, file_id, symbol_id, qualified_name, row_number() OVER (PARTITION BY project_id, file_id ORDER BY start_line, end_line, symbol_id) AS place FROM sym WHERE file_id IN (SELECT file_id FROM fil WHERE regexp_matches(path, '(^|/)tests?/'))",
    "q5_symbols_by_id": _E + ", k AS (SELECT DISTINCT symbol_id FROM sym ORDER BY 1 LIMIT 5), a AS (SELECT row_number() OVER (ORDER BY symbol_id DESC) AS ordinal, symbol_id FROM k UNION ALL SELECT 6, 'no such id' UNION ALL SELECT 7, min(symbol_id) FROM k) SELECT ordinal, symbol_id, project_id, qualified_name FROM a LEFT JOIN sym USING (symbol_id)",
    "q6_references": _E + _LIB + "SELECT name, file_id, line, owner, kind, target, row_number() OVER (PARTITION BY name ORDER BY file_id, line, owner, kind, target, provenance) AS place FROM site WHERE name IN ('flush_handler', 'build_trace')",
    "q7_entry_buckets": _E + _LIB + """, b AS (SELECT 'public_exports' AS bucket, * FROM loc WHERE exported AND symbol_id NOT IN (SELECT target FROM arc WHERE kind <> 'contains' AND source <> target)
        UNION ALL SELECT 'cli_files', * FROM loc WHERE regexp_matches(path, '(^|/)(bin|cli|cmd)/') AND symbol_kind IN ('function', 'method')
        UNION ALL SELECT 'tools', * FROM loc WHERE symbol_kind IN ('constant', 'variable') AND regexp_matches(simple_name, '^[A-Z][A-Z0-9_]*_TOOL$')
        UNION ALL SELECT CASE WHEN starts_with(qualified_name, 'cmd ') THEN 'cli_commands' ELSE 'routes' END, * FROM loc WHERE symbol_kind = 'route')
        SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY path, qualified_name, project_id, symbol_id) AS place, project_id, symbol_id, qualified_name, count(*) OVER (PARTITION BY bucket) AS total FROM b QUALIFY place <= 20""",
    "q9_qualified": _E + _LIB + "SELECT project_id, symbol_id, qualified_name, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(pagerank, 0) DESC, symbol_id) AS place FROM loc WHERE symbol_kind IN ('function', 'method') AND starts_with(path, 'src/') AND contains(lower(qualified_name), 'trace') AND coalesce(pagerank, 0) <= 0.01",
    "q9_callers_of": _E + _LIB + """, t AS (SELECT n.qualified_name, count(DISTINCT source) AS n FROM arc JOIN nam n ON n.symbol_id = target WHERE kind = 'calls' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1), g AS (SELECT symbol_id FROM nam WHERE qualified_name IN (SELECT qualified_name FROM t) OR simple_name IN (SELECT qualified_name FROM t))
        SELECT project_id, symbol_id, qualified_name, row_number() OVER (PARTITION BY project_id ORDER BY qualified_name, symbol_id) AS place FROM loc WHERE symbol_id IN (SELECT source FROM arc WHERE kind = 'calls' AND target IN (FROM g))""",
    "i7_imports": _E + ", w AS (SELECT DISTINCT symbol_id, path FROM sym JOIN fil USING (file_id)) SELECT a.path AS importer, b.path AS imported, count(DISTINCT target) AS symbols, sum(sites)::BIGINT AS sites FROM arc JOIN w a ON a.symbol_id = source JOIN w b ON b.symbol_id = target WHERE kind = 'imports' AND a.path <> b.path GROUP BY 1, 2",
    "i8_packages": r"""WITH t AS (SELECT max(normalized_path) AS path, max(source_text) AS text FROM files WHERE file_id IS NOT NULL GROUP BY file_id), f AS (SELECT path, CASE WHEN ends_with(path, '.ts') THEN 'typescript' ELSE 'javascript' END AS language, unnest(regexp_extract_all(text, '(?m)^\s*(?:import|export)\b[^;''"\n]*?(?:from\s*)?[''"]([^''"\n]+)[''"]', 1)) AS s FROM t WHERE ends_with(path, '.ts') OR ends_with(path, '.js'))
        SELECT CASE WHEN starts_with(s, '@') THEN regexp_extract(s, '^(@[^/]+/[^/]+|.*)', 1) ELSE string_split(s, '/')[1] END AS name, language, count(DISTINCT path) AS files, count(*) AS statements FROM f WHERE NOT regexp_matches(s, '^[./]') GROUP BY 1, 2""",
    "i11_rename": _E + _LIB + r""", t AS (SELECT target, name, count(DISTINCT file_id) AS n FROM site WHERE name IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 1), k AS (SELECT file_id, sum(sites)::BIGINT AS n FROM site WHERE target IN (SELECT target FROM t) GROUP BY 1),
        m AS (SELECT file_id, count(*) FILTER (w = (SELECT name FROM t)) AS n FROM (SELECT file_id, unnest(string_split_regex(max(source_text), '[^\p{L}\p{N}_]')) AS w FROM files WHERE file_id IS NOT NULL GROUP BY 1) GROUP BY 1)
        SELECT file_id, coalesce(k.n, 0) AS reference_sites, coalesce(m.n, 0) AS mentions FROM k FULL JOIN (SELECT * FROM m WHERE n > 0) m USING (file_id)""",
    "j13_same_names": _E + ", m AS (SELECT * FROM sym WHERE symbol_kind = 'method' AND file_id IS NOT NULL) SELECT project_id, symbol_id, count(*) OVER (PARTITION BY project_id, simple_name) - count(*) OVER (PARTITION BY project_id, simple_name, file_id) AS elsewhere FROM m",
    "s11_overlay": _E + "SELECT source, target, kind, provenance FROM e WHERE provenance = 'scip' OR source NOT IN (SELECT source FROM e WHERE provenance = 'scip')",
    "w_percentiles": _E + "SELECT project_id, symbol_id, round(percent_rank() OVER (ORDER BY coalesce(n, 0)), 9) AS percentile FROM sym LEFT JOIN (SELECT target AS symbol_id, sum(sites) AS n FROM arc GROUP BY 1) USING (symbol_id)",
    "g6_test_impact": _R + """, w AS (SELECT DISTINCT symbol_id, file_id, symbol_kind FROM sym), st AS (SELECT DISTINCT target AS a, source AS b FROM arc WHERE kind <> 'contains' AND source <> target),
        r AS (SELECT file_id AS root, symbol_id AS node, 0 AS depth FROM w JOIN fil USING (file_id) WHERE starts_with(path, 'src/') UNION SELECT r.root, st.b, r.depth + 1 FROM r JOIN st ON st.a = r.node WHERE r.depth < 2)
        SELECT root, fil.path, min(depth) AS depth, count(DISTINCT node) AS symbols, regexp_matches(any_value(f2.path), '(?i)(^|/)(index\\.[cm]?[jt]sx?|__init__\\.py|mod\\.rs)$') AS barrel FROM (SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2) r JOIN w ON w.symbol_id = node JOIN fil ON fil.file_id = w.file_id JOIN fil f2 ON f2.file_id = root
        WHERE w.file_id <> root AND (symbol_kind = 'test' OR regexp_matches(fil.path, '(^|/)tests?/')) GROUP BY 1, 2""",
    "i1_symbol_findings": _BASE + "SELECT project_id, symbol_id, finding, round(metric, 6) AS metric, CASE WHEN metric >= error THEN 'error' WHEN metric >= warning THEN 'warning' ELSE 'info' END AS severity FROM val WHERE metric >= info",
    "i1_text_findings": f"""WITH c AS (SELECT file_id, max(coalesce(source_text, '')) AS code FROM files WHERE file_id IS NOT NULL GROUP BY 1), k(finding, info, warning, error) AS (VALUES {_LEVELS}),
        v AS (SELECT file_id, k.*, CASE finding {_COUNTS} END AS metric FROM c, k WHERE len(code) - len(replace(code, chr(10), '')) >= 4)
        SELECT file_id, finding, metric, CASE WHEN metric >= error THEN 'error' WHEN metric >= warning THEN 'warning' ELSE 'info' END AS severity FROM v WHERE metric >= info""",
    "i1_details": "WITH d AS (SELECT DISTINCT sha256(text) AS key, doc_id AS member FROM documents WHERE text <> ''), r AS (SELECT key, member, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY member) AS i FROM d) SELECT key, n, '[' || string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (i <= 10) || ']' AS detail FROM r WHERE n > 1 GROUP BY 1, 2",
    "i3_fingerprints": "SELECT project_id, sha256(concat_ws('|', project_id, generation_id::VARCHAR, coalesce(prior::VARCHAR, '-'))) AS fingerprint FROM generations LEFT JOIN (SELECT project_id, max(generation_id) AS prior FROM generations WHERE state = 'superseded' GROUP BY 1) USING (project_id) WHERE state = 'current'",
    "r16_edit_files": f"""WITH o AS (SELECT DISTINCT path, coalesce(qualified_name, '') AS name FROM search_documents WHERE path IS NOT NULL AND document_kind <> 'test' AND document_id IS NOT NULL),
        h AS (SELECT path, name, len(list_intersect(list_distinct({_TOKENS.format('name')} || {_TOKENS.format('path')}), [{_TERMS}])) AS n FROM o), f AS (SELECT path, max(n) AS terms FROM h GROUP BY 1), t AS (SELECT path, terms, row_number() OVER (ORDER BY path) AS place FROM f WHERE terms = (SELECT max(terms) FROM f) AND terms > 0 ORDER BY path LIMIT 16),
        s AS (SELECT path, name FROM h JOIN t USING (path) WHERE n = terms AND name <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY name) <= 5)
        SELECT t.path, terms, false AS exact, coalesce(x.names, '') AS names, place FROM t LEFT JOIN (SELECT path, string_agg(name, ',' ORDER BY name) AS names FROM s GROUP BY 1) x USING (path)""",
    "r16_evidence": _PACKET + "SELECT doc, round(score, 9) AS score, best_rank, tier, place FROM ev",
    "r16_tests": _PACKET + "SELECT DISTINCT ON (path) d.path, doc, 0 AS distance FROM ev JOIN (SELECT document_id AS doc, max(path) AS path FROM search_documents WHERE document_kind = 'test' GROUP BY 1) d USING (doc) ORDER BY path, place",
    "r14_states": _PACKET + ", chn AS (SELECT unnest(['exact', 'all', 'names', 'text']) AS channel), k AS (SELECT channel, CASE WHEN count(doc) > 0 THEN 'used' ELSE 'empty' END AS state FROM chn LEFT JOIN c USING (channel) GROUP BY 1) SELECT * FROM k UNION ALL SELECT 'semantic', 'unavailable' UNION ALL SELECT 'packet', CASE WHEN bool_or(state = 'used') THEN 'ok' ELSE 'no_relevant_evidence' END FROM k",
    "i18_peers": """WITH o AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS x FROM lineitem), n AS (SELECT x, count(*) AS n FROM o GROUP BY 1), k AS (SELECT c FROM o GROUP BY 1 HAVING count(*) <= 4), s AS (SELECT * FROM o JOIN k USING (c)), p AS (SELECT a.x AS item, b.x AS peer, count(*) AS shared FROM s a JOIN s b ON a.c = b.c AND a.x <> b.x GROUP BY 1, 2),
        q AS (SELECT item, peer, shared, round(shared / (na.n + nb.n - shared), 9) AS jaccard FROM p JOIN n na ON na.x = item JOIN n nb ON nb.x = peer) SELECT *, row_number() OVER (PARTITION BY item ORDER BY shared DESC, jaccard DESC, peer) AS place FROM q QUALIFY place <= 3""",
    "i19_commit_peers": "WITH o AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS x FROM lineitem), n AS (SELECT x, count(*) AS commits FROM o GROUP BY 1), a(ordinal, c) AS (VALUES (1, 7), (2, 3), (3, 99), (4, 3)) SELECT ordinal, c AS commit, x AS item, commits, row_number() OVER (PARTITION BY ordinal ORDER BY commits DESC, x) AS place FROM a JOIN o USING (c) JOIN n USING (x) QUALIFY place <= 2",
    "i26_pending": _BASE[: _BASE.index("  loci AS (")].rstrip().rstrip(",") + f", od AS (SELECT DISTINCT project_id, symbol_id, {_HEX} AS digest FROM old WHERE structural_digest IS NOT NULL) SELECT project_id, symbol_id, digest, CASE WHEN (project_id, symbol_id) IN (SELECT (project_id, symbol_id) FROM od) THEN 'stale' ELSE 'missing' END AS why, row_number() OVER (PARTITION BY project_id ORDER BY pagerank DESC NULLS LAST, symbol_id) AS place FROM cur WHERE digest IS NOT NULL AND (project_id, symbol_id, digest) NOT IN (SELECT (project_id, symbol_id, digest) FROM od) QUALIFY place <= 25",
    "i27_queue": _E + ", q AS (SELECT target AS symbol_id, count(*) AS p FROM arc WHERE kind = 'calls' GROUP BY 1), h AS (SELECT DISTINCT symbol_id FROM sym WHERE regexp_matches(lower(simple_name), 'trace|budget')) SELECT symbol_id, least(coalesce(p, 0) + (h.symbol_id IS NOT NULL)::INT, 5)::INT AS priority FROM q FULL JOIN h USING (symbol_id)",
    "r7_readiness": "WITH v AS (SELECT vec_id AS doc_id, max((len(embedding) = 64)::INT) AS fits FROM embeddings GROUP BY 1), b AS (SELECT doc_id, fits FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN v USING (doc_id)) SELECT count(*) AS documents, count(fits) AS embedded, count(*) - count(fits) AS missing, count(*) FILTER (fits = 0) AS wrong_dimension, count(*) > 0 AND count(*) = count(fits) AND count(*) FILTER (fits = 0) = 0 AS ready FROM b",
    "r5_fuzzy_documents": _BM + "SELECT doc, round(sum(tf / (1.0 + levenshtein(term, 'flush'))), 9) AS score, min(levenshtein(term, 'flush')) AS best_edits FROM p WHERE field = 'qualified_name' AND levenshtein(term, 'flush') <= 2 GROUP BY 1",
    "l_next_page": _E + "SELECT symbol_kind, qualified_name, symbol_id, project_id FROM sym ORDER BY ALL LIMIT 11 OFFSET 10",
    "s13_interchange": _E + _LIB + ", k AS (SELECT 'files' AS relation, file_id AS x FROM fil UNION ALL SELECT 'symbols', project_id FROM sym UNION ALL SELECT 'edges', source FROM e UNION ALL SELECT 'references', owner FROM site WHERE line IS NOT NULL) SELECT relation, md5(x)[1:2] AS block, count(*) AS n, count(*) AS last FROM k GROUP BY 1, 2",
    "a6_lists": _E + ", k AS (SELECT project_id, symbol_kind || ':' || count(*) AS x, symbol_kind FROM sym GROUP BY project_id, symbol_kind), f AS (SELECT project_id, symbol_id FROM sym QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY symbol_id) <= 5) SELECT project_id, kinds, first FROM (SELECT project_id, string_agg(x, ',' ORDER BY symbol_kind) AS kinds FROM k GROUP BY 1) JOIN (SELECT project_id, string_agg(symbol_id, ',' ORDER BY symbol_id) AS first FROM f GROUP BY 1) USING (project_id)",
}
