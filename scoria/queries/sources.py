"""Queries of sources, exports, ad-hoc SQL, reviews and windows with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.functions import adhoc
from scoria.operators import graph, review
from scoria.plans.runtime import table
from scoria.queries.graph import _E, merged, paths, symbols
from scoria.sources import reports, sinks
from scoria.streaming import windows


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("source_text").alias("text"), F.max("normalized_path").alias("path"))


def content(spark: SparkSession, d: str) -> DataFrame:
    return reports.content_search(_texts(spark, d), symbols(spark, d), r"return .* \+ 9[0-9]")


def parsed_python(spark: SparkSession, d: str) -> DataFrame:
    return reports.python_symbols(_texts(spark, d).where(F.col("path").endswith(".py")))


def issues(spark: SparkSession, d: str) -> DataFrame:
    return reports.issue_numbers(table(spark, d, "documents").where("source = 'changelog'").select(F.col("doc_id").alias("commit"), F.col("text").alias("message")))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """The edges of an export of at most 1,000 functions and methods below src."""
    s = symbols(spark, d).join(paths(spark, d), "file_id")
    return sinks.graph_export(s, graph.arcs(merged(spark, d)), 1000, ["function", "method"], "src")[1].select("source", "target", "kind")


def sql_report(spark: SparkSession, d: str) -> DataFrame:
    out = adhoc.run(spark, "WITH k AS (SELECT symbol_kind, count(*) AS n FROM symbols GROUP BY symbol_kind) SELECT symbol_kind, n FROM k WHERE n > 10 ORDER BY symbol_kind", {"symbols": symbols(spark, d)})
    return out


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling_usage(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "grp", "calls", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(table(spark, d, "events"), gap="6 hours")
    return out.select("usr", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Links between files that would break a rule that lib must not use tests and cmd may use only lib."""
    where = symbols(spark, d).join(paths(spark, d), "file_id").select("symbol_id", "path").distinct()
    links = graph.arcs(merged(spark, d), ("calls", "imports")).join(where.select(F.col("symbol_id").alias("source"), F.col("path").alias("a")), "source").join(where.select(F.col("symbol_id").alias("target"), F.col("path").alias("b")), "target").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
    return review.layer_violations(links, [{"name": "lib", "paths": ["lib"], "cannotImport": ["tests"]}, {"name": "cmd", "paths": ["cmd"], "canImport": ["lib"]}, {"name": "tests", "paths": ["tests"]}])


def imports(spark: SparkSession, d: str) -> DataFrame:
    """Relative and bare imports of scripts, resolved among the known paths."""
    f = _texts(spark, d).where(F.col("path").rlike(r"\.(ts|js)$"))
    found = f.select(F.col("path").alias("importer"), F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^import [^;\n]* from "([^"\n]+)";'), F.lit(1))).alias("specifier"))
    return review.audit_imports(found, f.select("path"))


QUERIES = {"s16_content": content, "s3_python_symbols": parsed_python, "s10_issues": issues, "s14_export": exported, "sql_report": sql_report, "st_windows": windowed, "st_sessions": user_sessions, "i1_illegal_imports": layers, "q16_imports": imports}

SQL = {
    "s16_content": _E + """, h AS (SELECT file_id, i::INT AS line, l AS text FROM (SELECT file_id, unnest(t) AS l, generate_subscripts(t, 1) AS i FROM (SELECT file_id, string_split_regex(max(source_text), '\\r\\n|\\r|\\n') AS t FROM files WHERE file_id IS NOT NULL GROUP BY 1)) WHERE regexp_matches(l, 'return .* \\+ 9[0-9]'))
        SELECT DISTINCT ON (h.file_id, line, text) h.file_id, line, text, symbol_id FROM h LEFT JOIN sym ON sym.file_id = h.file_id AND line BETWEEN start_line AND end_line ORDER BY h.file_id, line, text, end_line - start_line, start_line, symbol_id""",
    "s10_issues": "SELECT DISTINCT doc_id AS commit, unnest(regexp_extract_all(text, '(?:^|[\\s(])#(\\d{1,9})\\b', 1))::BIGINT AS issue FROM documents WHERE source = 'changelog'",
    "s14_export": _E + ", n AS (SELECT symbol_id FROM sym JOIN fil USING (file_id) WHERE symbol_kind IN ('function', 'method') AND (path = 'src' OR starts_with(path, 'src/')) ORDER BY path, start_line, symbol_kind, qualified_name, symbol_id LIMIT 1000) SELECT source, target, kind FROM arc WHERE source IN (FROM n) AND target IN (FROM n)",
    "sql_report": _E + """SELECT '{"symbol_kind":"' || symbol_kind || '","n":' || count(*) || '}' AS row FROM sym GROUP BY symbol_kind HAVING count(*) > 10""",
    "st_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type AS grp, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "st_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id AS usr, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls FROM s GROUP BY user_id, k",
    "i1_illegal_imports": _E + """, w AS (SELECT DISTINCT symbol_id, path, CASE WHEN starts_with(path, 'lib/') THEN 'lib' WHEN starts_with(path, 'cmd/') THEN 'cmd' WHEN starts_with(path, 'tests/') THEN 'tests' END AS layer FROM sym JOIN fil USING (file_id))
        SELECT DISTINCT a.path AS source, b.path AS target, a.layer AS source_layer, b.layer AS target_layer FROM arc JOIN w a ON a.symbol_id = arc.source JOIN w b ON b.symbol_id = arc.target WHERE kind IN ('calls', 'imports') AND ((a.layer = 'lib' AND b.layer = 'tests') OR (a.layer = 'cmd' AND b.layer = 'tests'))""",
}
