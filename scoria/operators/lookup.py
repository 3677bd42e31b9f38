"""Retrieval of files, symbols and reference sites by name, path, id and qualified query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.operators.graph import IMPACT_KINDS, simple_name
from scoria.operators.search import parse_qualified
from scoria.operators.skew import canonical
from scoria.operators.snapshots import latest_rows

#: Classes of paths, each told by one pattern.
PATH_CLASSES = {
    "test": r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|[._-](test|spec)\.[a-z]+$",
    "fixture": r"(?i)(^|/)(fixtures?|testdata|snapshots?)/",
    "bench": r"(?i)(^|/)(bench|benches|benchmarks?|examples?)/",
    "generated": r"(?i)(^|/)(generated|gen|dist|build)/|\.(generated|pb|g)\.[a-z]+$",
    "script": r"(?i)(^|/)(build\.rs|setup\.py|makefile|[^/]*\.config\.[cm]?[jt]s)$",
    "barrel": r"(?i)(^|/)(index\.[cm]?[jt]sx?|__init__\.py|mod\.rs)$",
}


def path_class(path: Column, name: str) -> Column:
    return F.coalesce(path.rlike(PATH_CLASSES[name]), F.lit(False))


def files_at(files: DataFrame, paths: list[str]) -> DataFrame:
    """The last delivered row of each file whose path is one of those asked for."""
    kept = ["normalized_path", "language", "content_hash", "byte_size", "parse_status"]
    return latest_rows(files.where(F.col("file_id").isNotNull()), ["file_id"], "delivered_at", kept).where(F.col("normalized_path").isin(paths))


def symbols_in(symbols: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(project_id, file_id, symbol_id, qualified_name, place): the symbols of some files (column file_id) in the order of their lines."""
    w = Window.partitionBy("project_id", "file_id").orderBy("start_line", "end_line", "symbol_id")
    return symbols.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").withColumn("place", F.row_number().over(w)).select("project_id", "file_id", "symbol_id", "qualified_name", "place")


def symbols_by_id(symbols: DataFrame, ids: list[str]) -> DataFrame:
    """(ordinal, symbol_id, project_id, qualified_name): the ids in the order asked for, from 1; unknown ones with nulls, repeated ones each time."""
    asked = symbols.sparkSession.createDataFrame([(ids,)], "ids array<string>").select(F.posexplode("ids").alias("ordinal", "symbol_id")).withColumn("ordinal", F.col("ordinal") + 1)
    # The ids are a list of the caller's.
    return F.broadcast(asked).join(symbols.where(F.col("symbol_id").isin(ids)).select("symbol_id", "project_id", "qualified_name"), "symbol_id", "left").select("ordinal", "symbol_id", "project_id", "qualified_name")


def reference_sites(edges: DataFrame, symbols: DataFrame, library: DataFrame) -> DataFrame:
    """(file_id, line, owner, target, name, kind, confidence, provenance, sites): where symbols refer to others.

    Equal deliveries count once. name is the last part of the target's name, null where the target is unresolved.
    Sources that are no current symbol have no site.
    """
    clean = edges.select(canonical(F.col("source_symbol_id")).alias("owner"), canonical(F.col("target_symbol_id")).alias("target"), canonical(F.col("edge_kind")).alias("kind"), "confidence", "provenance", F.col("site_count").alias("sites")).distinct()
    at = symbols.select(F.col("symbol_id").alias("owner"), "file_id", F.col("start_line").alias("line")).distinct()
    names = symbols.select(F.col("symbol_id").alias("target"), "simple_name").unionByName(library.select(F.col("symbol_id").alias("target"), simple_name(F.col("qualified_name")).alias("simple_name"))).groupBy("target").agg(F.min("simple_name").alias("name"))
    return clean.join(at, "owner").join(names, "target", "left").select("file_id", "line", "owner", "target", "name", "kind", "confidence", "provenance", "sites")


def references_by_name(sites: DataFrame, names: list[str]) -> DataFrame:
    """The sites that refer to a name, with their place by file, line and owner per name."""
    w = Window.partitionBy("name").orderBy("file_id", "line", "owner", "kind", "target", "provenance")
    return sites.where(F.col("name").isin(names)).withColumn("place", F.row_number().over(w))


def entry_points(symbols: DataFrame, used: DataFrame, per_bucket: int) -> DataFrame:
    """(bucket, place, project_id, symbol_id, qualified_name, total): what runs or is called from outside, per bucket.

    `symbols` has a path; `used` (column symbol_id) are those with an incoming use. Buckets: routes, cli_commands
    (routes named 'cmd ...'), tools (constants named X_TOOL), cli_files, public_exports (exported and unused). total is
    exact, the rows are the first per_bucket by path and name.
    """
    route = F.col("symbol_kind") == "route"
    command = F.col("qualified_name").startswith("cmd ")
    rows = symbols.join(used.select("symbol_id", F.lit(True).alias("in_use")).distinct(), "symbol_id", "left")
    hits = {
        "routes": route & ~command, "cli_commands": route & command, "tools": F.col("symbol_kind").isin("constant", "variable") & F.col("simple_name").rlike("^[A-Z][A-Z0-9_]*_TOOL$"),
        "cli_files": F.col("path").rlike(r"(^|/)(bin|cli|cmd)/") & F.col("symbol_kind").isin("function", "method"), "public_exports": F.col("exported") & F.col("in_use").isNull(),
    }
    buckets = rows.withColumn("bucket", F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]))))
    totals = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("bucket").orderBy("path", "qualified_name", "project_id", "symbol_id")
    first = buckets.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_bucket)
    # One total per bucket, of which there are five.
    return first.join(F.broadcast(totals), "bucket").select("bucket", "place", "project_id", "symbol_id", "qualified_name", "total")


def _any(c: Column, values: list[str], test) -> Column:
    hit = F.lit(False)
    for v in values:
        hit = hit | test(c, v)
    return hit


def qualified(symbols: DataFrame, arcs: DataFrame, names: DataFrame, query: str) -> DataFrame:
    """(project_id, symbol_id, qualified_name, place): the symbols that a qualified query asks for.

    `symbols` has path and language, `names` (symbol_id, qualified_name, simple_name) all symbols that may be named.
    Values of one qualifier are alternatives, qualifiers and free words must all hold. kind and lang are equal, path is
    a prefix, name and sig are parts; callers-of, callees-of and depends-on follow the arcs of a name; centrality
    compares PageRank, unknown scores being 0; sort is by name, path or, by default, falling centrality.
    """
    q = parse_qualified(query)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = symbols
    tests = {"kind": ("symbol_kind", lambda c, v: low(c) == v.lower()), "lang": ("language", lambda c, v: low(c) == v.lower()), "path": ("path", lambda c, v: c.startswith(v)), "name": ("qualified_name", lambda c, v: low(c).contains(v.lower())), "sig": ("signature", lambda c, v: low(c).contains(v.lower()))}
    for name, (column, test) in tests.items():
        if name in q:
            out = out.where(_any(F.col(column), q[name], test))
    for word in q["text"]:
        out = out.where(low(F.col("qualified_name")).contains(word.lower()))
    score = F.coalesce("pagerank", F.lit(0.0))
    for bound in q.get("centrality", []):
        op = bound[:2] if bound[1:2] == "=" else bound[:1]
        value = F.lit(float(bound[len(op) :]))
        out = out.where({">=": score >= value, "<=": score <= value, ">": score > value, "<": score < value}[op])
    for name, kinds, asked, given in (("callers-of", ("calls",), "target", "source"), ("callees-of", ("calls",), "source", "target"), ("depends-on", IMPACT_KINDS, "target", "source")):
        if name in q:
            ids = names.where(_any(F.col("qualified_name"), q[name], lambda c, v: c == v) | _any(F.col("simple_name"), q[name], lambda c, v: c == v)).select(F.col("symbol_id").alias(asked)).distinct()
            out = out.join(arcs.where(F.col("kind").isin(list(kinds))).join(ids, asked, "left_semi").select(F.col(given).alias("symbol_id")), "symbol_id", "left_semi")
    order = {"name": [F.col("qualified_name")], "path": [F.col("path"), F.col("start_line")]}.get(q.get("sort", ["centrality"])[0], [score.desc()])
    # The place is among what was found; a search narrow enough to be read is small.
    w = Window.partitionBy("project_id").orderBy(*order, "symbol_id")
    return out.withColumn("place", F.row_number().over(w)).select("project_id", "symbol_id", "qualified_name", "place")


def import_evidence(arcs: DataFrame, symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """(importer, imported, symbols, sites): which files import which, by how many symbols and sites."""
    at = symbols.select("symbol_id", "file_id").distinct().join(paths, "file_id").select("symbol_id", "path")
    both = arcs.where(F.col("kind") == "imports").join(at.select(F.col("symbol_id").alias("source"), F.col("path").alias("importer")), "source").join(at.select(F.col("symbol_id").alias("target"), F.col("path").alias("imported")), "target")
    return both.where(F.col("importer") != F.col("imported")).groupBy("importer", "imported").agg(F.count_distinct("target").alias("symbols"), F.sum("sites").alias("sites"))


def external_imports(texts: DataFrame) -> DataFrame:
    """(name, language, files, statements): packages that JavaScript and TypeScript texts (path, language, text) import from outside.

    A package's name is the first part of the specifier, two parts for a scope; relative ones are inside.
    """
    pattern = r"""(?m)^\s*(?:import|export)\b[^;'"\n]*?(?:from\s*)?['"]([^'"\n]+)['"]"""
    found = texts.where(F.col("language").isin("javascript", "typescript")).select("path", "language", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("specifier")).where(~F.col("specifier").rlike(r"^[./]"))
    name = F.when(F.col("specifier").startswith("@"), F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|.*)", 1)).otherwise(F.substring_index("specifier", "/", 1))
    return found.groupBy(name.alias("name"), "language").agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("statements"))


def rename_plan(sites: DataFrame, texts: DataFrame, symbol_id: str, name: str) -> DataFrame:
    """(file_id, reference_sites, mentions): per file the resolved sites of a symbol and the whole-word mentions of its name in the text.

    Files with mentions but no site need a look by hand.
    """
    known = sites.where(F.col("target") == symbol_id).groupBy("file_id").agg(F.sum("sites").alias("reference_sites"))
    word = r"(?<![\p{L}\p{N}_])\Q" + name.replace("\\E", "") + r"\E(?![\p{L}\p{N}_])"
    said = texts.select("file_id", F.regexp_count("text", F.lit(word)).alias("mentions")).where("mentions > 0")
    both = known.join(said, "file_id", "full_outer")
    return both.select("file_id", F.coalesce("reference_sites", F.lit(0)).alias("reference_sites"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


def same_names_elsewhere(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """(project_id, symbol_id, elsewhere): symbols of a kind with the same simple name in other files of the project.

    Counted from totals per name and per name and file; names that very many symbols share make no pairs.
    """
    some = symbols.where(F.col("symbol_kind").isin(kinds))
    per_file = some.groupBy("project_id", "simple_name", "file_id").agg(F.count(F.lit(1)).alias("here"))
    per_name = per_file.groupBy("project_id", "simple_name").agg(F.sum("here").alias("all"))
    return some.join(per_file, ["project_id", "simple_name", "file_id"]).join(per_name, ["project_id", "simple_name"]).select("project_id", "symbol_id", (F.col("all") - F.col("here")).alias("elsewhere"))


def percent_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, percentile): the share of the other rows with a smaller value, over all rows.

    Ranks come from the counts of the distinct values. Values are non-negative whole numbers, so their distinct ones are
    at most about the root of twice their sum: few even where the rows are very many.
    """
    counts = rows.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    below = counts.select("__v", F.coalesce(F.sum("__n").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"))
    others = F.lit(max(rows.count() - 1, 1))
    return rows.join(below, F.col(value) == F.col("__v")).select(*keys, (F.col("__below") / others).alias("percentile"))


def overlay(native: DataFrame, imported: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """The native rows but for those whose key is covered, and the imported rows in their place."""
    return native.join(covered.select(key).distinct(), key, "left_anti").unionByName(imported.select(native.columns))


def page_after(rows: DataFrame, order: list[str], last: tuple | None, size: int) -> DataFrame:
    """The next `size` rows in rising order of some columns after the key `last` of the page before, and one more if there is one.

    The key itself is the bookmark: no rows before it are counted or skipped. Nulls come first.
    """
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, last, strict=True):
            after = F.col(c).isNotNull() if v is None else F.col(c) > F.lit(v)
            beyond, equal = beyond | (equal & after), equal & F.col(c).eqNullSafe(F.lit(v))
        rows = rows.where(beyond)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size + 1)


def interchange(files: DataFrame, symbols: DataFrame, edges: DataFrame, sites: DataFrame) -> DataFrame:
    """(relation, place, row): the rows of a generation's relations as JSON, each relation in the order of its keys.

    place is the position within a block of keys (the first two letters of the digest of the first key), so that no
    relation is numbered in one task; blocks and places together are the order of an export.
    """
    keys = {"files": (files, ["file_id"]), "symbols": (symbols, ["project_id", "symbol_id"]), "edges": (edges, ["source", "target", "kind", "provenance"]), "references": (sites, ["owner", "kind", "target", "provenance", "line"])}
    out = None
    for name, (df, key) in keys.items():
        w = Window.partitionBy("block").orderBy(*key)
        rows = df.withColumn("block", F.substring(F.md5(F.coalesce(F.col(key[0]).cast("string"), F.lit(""))), 1, 2))
        one = rows.select(F.lit(name).alias("relation"), "block", F.row_number().over(w).alias("place"), F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out
