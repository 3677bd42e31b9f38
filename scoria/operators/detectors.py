"""Code-health detectors over symbols, edges, documents and the generation before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoria.operators.graph import dependency_counts

CALLABLE = ("function", "method", "component")
CONTAINER = ("class", "struct", "module")
#: Each detector's metric, thresholds for info, warning and error, and the condition under which it holds.
DETECTORS = {
    "large_method": ("lines", 100, 100, 200, "callable"), "complex_method": ("cyclomatic", 15, 15, 25, "callable"), "nested_complexity": ("nesting", 5, 5, 7, "callable"),
    "complex_conditional": ("operands", 6, 6, 8, "callable"), "long_parameter_list": ("parameters", 4, 5, 7, "declared"), "brain_method": ("brain", 5, 10, 20, "brainy"),
    "recently_grew": ("growth", 150, 200, 300, "grown"), "god_class": ("behaviour", 15, 40, 60, "godlike"), "feature_envy": ("foreign", 6, 12, 999, "envious"), "unused_export": ("unused", 1, 1, 2, "exportable"),
    "low_coverage": ("uncovered", 50, 50, 80, "central"), "duplicate_code": ("copies", 2, 2, 999, "copied"), "high_fan_out": ("outgoing", 25, 50, 100, "fanned"), "unresolved_reference_pressure": ("unresolved", 15, 40, 100, "always"),
}
#: Detectors that count what matches in a callable's code, with thresholds.
TEXT_DETECTORS = {
    "magic_number": (r"[^A-Za-z0-9_.][0-9]{2,}", 3, 5, 8), "hardcoded_url": (r"https?://", 1, 2, 3), "incomplete_marker": (r"TODO|FIXME|XXX", 1, 5, 50),
    "empty_catch": (r"catch\s*(?:\([^)]*\))?\s*\{\s*\}|except[^:\n]*:\s*pass", 1, 1, 3), "insecure_hash": (r"(?i)(?:md5|sha1)\s*\(|createHash\(['\"](?:md5|sha1)", 1, 1, 3),
    "unsafe_json_parse": (r"JSON\.parse\(", 1, 1, 3), "env_no_validation": (r"process\.env\.[A-Z_]+|os\.environ\[", 1, 1, 3), "ts_ignore_suppression": (r"@ts-(?:ignore|nocheck)", 1, 1, 3), "ts_any_cast": (r"\bas any\b|<any>", 2, 3, 5),
    "agent_debug_log": (r"console\.log\(|\bdbg!\(|\bprint\(['\"]DEBUG", 1, 1, 5), "dynamic_eval": (r"\beval\(|new Function\(|\bexec\(", 1, 1, 1), "random_for_security": (r"(?i)(?:token|secret|password)\w*\s*=\s*[^;\n]*random", 1, 1, 1),
    "sql_string_concat": (r"(?i)['\"](?:select|insert|update|delete)\s[^'\"]*['\"]\s*\+", 1, 1, 2), "forof_await": (r"for\s*\([^)]*\bof\b[^)]*\)\s*\{[^}]*\bawait\b", 1, 2, 5), "http_no_timeout": (r"requests\.(?:get|post)\([^)]*\)", 1, 1, 3),
    "empty_function_body": (r"\)\s*(?:->\s*\w+\s*)?\{\s*\}", 1, 999, 999), "sync_io_in_async": (r"async[^{]*\{[^}]*(?:readFileSync|writeFileSync|time\.sleep)", 1, 1, 3),
}
#: What of the matches isn't meant, by detector.
EXCEPT = {"http_no_timeout": r"requests\.(?:get|post)\([^)]*timeout[^)]*\)"}


def parameter_count(signature: Column) -> Column:
    """The parameters in the first brackets of a signature: commas outside inner brackets and one more, 0 if they are empty."""
    inner = F.regexp_extract(F.coalesce(signature, F.lit("")), r"\(((?:[^()]|\([^()]*\))*)\)", 1)
    flat = F.regexp_replace(inner, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    return F.when(F.trim(flat) == "", 0).otherwise(F.regexp_count(flat, F.lit(",")) + 1).cast("int")


def text_findings(texts: DataFrame, key: str = "document_id", code: str = "code", detectors: dict = TEXT_DETECTORS, least_lines: int = 5) -> DataFrame:
    """(key, finding, metric, severity) of the texts of at least so many lines.

    Of several texts of one key the greatest counts; null keys and texts find nothing. All patterns are counted in one
    scan.
    """
    one = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(code, F.lit(""))).alias("__code"))
    some = one.where(F.regexp_count("__code", F.lit("\n")) + 1 >= least_lines)
    count = lambda p: F.regexp_count("__code", F.lit(p))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), (count(p) - count(EXCEPT[n]) if n in EXCEPT else count(p)).alias("metric"), *[F.lit(x).alias(t) for x, t in zip(levels, ("info", "warning", "error"), strict=True)]) for n, (p, *levels) in detectors.items()]))
    return _severe(some.select(key, rows.alias("d")).select(key, "d.*"), [key])


def _severe(rows: DataFrame, keys: list[str]) -> DataFrame:
    severity = F.when(F.col("metric") >= F.col("error"), "error").when(F.col("metric") >= F.col("warning"), "warning").otherwise("info")
    return rows.where(F.col("metric") >= F.col("info")).select(*keys, "finding", "metric", severity.alias("severity"))


def symbol_measures(symbols: DataFrame, arcs: DataFrame, references: DataFrame, docs: DataFrame, previous: DataFrame, paths: DataFrame, coverage: DataFrame | None = None, days: int = 30) -> DataFrame:
    """One row per current symbol (project_id, symbol_id) with the metrics of DETECTORS and the conditions they need.

    `symbols` are the current ones with a column digest; `previous` (project_id, symbol_id, start_line, end_line,
    published_at) those of the generation before; `references` (source, target, sites) has null targets for unresolved
    sites; `coverage` (symbol_id, fraction) may be left out. Every part is an aggregate per symbol joined by its key;
    missing parts count as 0 and enable nothing.
    """
    keys = ["project_id", "symbol_id"]
    known = symbols.select(*keys, "file_id", "symbol_kind", "signature", "exported", "declaration_only", "digest", "qualified_name", (F.col("end_line") - F.col("start_line") + 1).alias("span"))
    at = known.select("symbol_id", "file_id", "symbol_kind").distinct()
    health = docs.where(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(*[F.max(F.get_json_object("metadata", f"$.health.{m}").cast("double")).alias(m) for m in ("lines", "cyclomatic", "nesting", "operands")])
    out = dependency_counts(arcs).select(F.col("node").alias("symbol_id"), F.col("distinct_outgoing").alias("outgoing"))
    open_ = references.where(F.col("target").isNull()).groupBy(F.col("source").alias("symbol_id")).agg(F.sum("sites").alias("unresolved"))
    ends = arcs.where((F.col("kind") != "contains") & (F.col("source") != F.col("target"))).join(at.select(F.col("symbol_id").alias("source"), F.col("file_id").alias("a")), "source").join(at.select(F.col("symbol_id").alias("target"), F.col("file_id").alias("b")), "target")
    used = ends.where(F.col("a") != F.col("b")).groupBy(F.col("target").alias("symbol_id")).agg(F.count(F.lit(1)).alias("incoming"))
    holds = arcs.where(F.col("kind") == "contains").select(F.col("source").alias("owner"), F.col("target").alias("member")).distinct()
    members = holds.join(known.select(F.col("symbol_id").alias("member"), F.col("span").alias("member_span"), "symbol_kind").where(F.col("symbol_kind").isin(list(CALLABLE))).groupBy("member").agg(F.max("member_span").alias("member_span")), "member")
    members = members.join(health.select(F.col("symbol_id").alias("member"), "cyclomatic"), "member", "left")
    owners = members.groupBy(F.col("owner").alias("symbol_id")).agg(F.sum((F.col("member_span") >= 5).cast("long")).alias("behaviour"), F.sum((F.col("cyclomatic") >= 3).cast("long")).alias("complex"))
    # What a method reads: fields by their owner, its own one against the others.
    reads = arcs.where(F.col("kind") == "field_access").select(F.col("source").alias("symbol_id"), F.col("target").alias("member")).distinct()
    owned = reads.join(holds.select("member", F.col("owner").alias("of")), "member").join(holds.select(F.col("member").alias("symbol_id"), F.col("owner").alias("own")), "symbol_id", "left")
    envy = owned.groupBy("symbol_id").agg(F.sum((~F.col("of").eqNullSafe(F.col("own"))).cast("long")).alias("foreign"), F.count_distinct(F.when(~F.col("of").eqNullSafe(F.col("own")), F.col("of"))).alias("providers"), F.count(F.lit(1)).alias("reads"))
    sizes = known.where(F.col("digest").isNotNull() & (F.col("span") >= 6) & F.col("symbol_kind").isin(list(CALLABLE)))
    copies = sizes.groupBy("project_id", "digest").agg(F.count_distinct("symbol_id").alias("copies"), F.min("symbol_id").alias("symbol_id")).where("copies > 1").drop("digest").groupBy(*keys).agg(F.max("copies").alias("copies"))
    before = previous.select(*keys, (F.col("end_line") - F.col("start_line") + 1).alias("prior"), "published_at")
    latest = previous.agg(F.max("published_at").alias("t")).scalar()
    base = known.join(paths, "file_id", "left")
    for part, on in ((health, "symbol_id"), (out, "symbol_id"), (open_, "symbol_id"), (used, "symbol_id"), (owners, "symbol_id"), (envy, "symbol_id"), (copies, keys), (before, keys)):
        base = base.join(part, on, "left")
    base = base.join(coverage.select("symbol_id", "fraction"), "symbol_id", "left") if coverage is not None else base.withColumn("fraction", F.lit(None).cast("double"))
    callable_ = F.col("symbol_kind").isin(list(CALLABLE))
    factor = F.greatest(F.lit(1.0), F.coalesce("nesting", F.lit(0.0)) / 3) * F.greatest(F.lit(1.0), F.coalesce("operands", F.lit(0.0)) / 4)
    test = F.col("path").rlike(r"(^|/)tests?/")
    conditions = {
        "callable": callable_, "declared": callable_ & ~F.coalesce("declaration_only", F.lit(False)), "brainy": callable_ & (F.col("lines") >= 50) & (F.col("cyclomatic") >= 8),
        "grown": callable_ & (F.col("prior") >= 20) & (F.col("span") > 1.5 * F.col("prior")) & (F.datediff(latest, "published_at") <= days), "godlike": F.col("symbol_kind").isin(list(CONTAINER)) & (F.col("complex") >= 5),
        "envious": (F.col("symbol_kind") == "method") & (F.col("providers") <= 2) & ((F.col("reads") - F.col("foreign")) * 3 < F.col("reads")), "exportable": F.col("exported") & ~test & ~F.col("path").endswith(".py") & ~F.col("path").endswith(".d.ts"),
        "central": callable_ & (F.col("fraction") <= 0.5), "copied": callable_, "fanned": callable_ | F.col("symbol_kind").isin(list(CONTAINER)), "always": F.lit(True),
    }
    metrics = {
        "lines": F.col("lines"), "cyclomatic": F.col("cyclomatic"), "nesting": F.col("nesting"), "operands": F.col("operands"), "parameters": parameter_count(F.col("signature")), "brain": F.col("lines") / 100 * F.col("cyclomatic") / 10 * factor,
        "growth": F.col("span") * 100 / F.col("prior"), "behaviour": F.col("behaviour"), "foreign": F.col("foreign"), "unused": F.when(F.coalesce("incoming", F.lit(0)) == 0, 1).otherwise(0), "uncovered": (1 - F.col("fraction")) * 100,
        "copies": F.col("copies"), "outgoing": F.col("outgoing"), "unresolved": F.col("unresolved"),
    }
    return base.select(*keys, "path", *[c.cast("double").alias(n) for n, c in metrics.items()], *[F.coalesce(c, F.lit(False)).alias(f"is_{n}") for n, c in conditions.items()])


def symbol_findings(measures: DataFrame, detectors: dict = DETECTORS) -> DataFrame:
    """(project_id, symbol_id, finding, metric, severity): one row per detector that is enabled and reaches its first threshold, all unpivoted from one scan."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.when(F.col(f"is_{condition}"), F.col(m)).alias("metric"), *[F.lit(float(x)).alias(t) for x, t in zip(levels, ("info", "warning", "error"), strict=True)]) for n, (m, *levels, condition) in detectors.items()]))
    return _severe(measures.select("project_id", "symbol_id", rows.alias("d")).select("project_id", "symbol_id", "d.*"), ["project_id", "symbol_id"])


def filter_findings(found: DataFrame, names: list[str] | None = None, severity: str = "info", metric: tuple[float | None, float | None] = (None, None), include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Findings of some detectors, from a severity up, within bounds of the metric, below a path prefix and not below another (column path)."""
    rank = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    out = found.where(rank >= {"info": 1, "warning": 2, "error": 3}[severity])
    out = out if names is None else out.where(F.col("finding").isin(names))
    out = out if metric[0] is None else out.where(F.col("metric") >= metric[0])
    out = out if metric[1] is None else out.where(F.col("metric") <= metric[1])
    out = out if include is None else out.where(F.col("path").startswith(include))
    return out if exclude is None else out.where(~F.coalesce(F.col("path").startswith(exclude), F.lit(False)))


def finding_details(found: DataFrame, members: DataFrame, most: int = 10) -> DataFrame:
    """(key, n, detail): for each key the JSON list of its first members (columns key, member) and their exact number.

    The list is cut in each task before it is put together, so a key of any number of members is no bottleneck.
    """
    from pyspark.sql import Window

    some = members.join(found.select("key").distinct(), "key", "left_semi").distinct()
    counts = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    first = some.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("member"))).where(F.col("at") <= most)
    lists = first.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list("member"))).alias("detail"))
    return counts.join(lists, "key")


def findings_fingerprint(parts: DataFrame, columns: list[str]) -> DataFrame:
    """parts with `fingerprint`: the digest of everything that findings depend on; as long as it is the same, stored ones hold."""
    return parts.withColumn("fingerprint", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256))
