"""Reviews of changes: diff hunks to symbols, import and dependency audits, layer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hunks(diff: DataFrame) -> DataFrame:
    """(path, old_start, old_count, new_start, new_count) from the lines (n, text) of a unified diff per review (column review)."""
    from pyspark.sql import Window

    w = Window.partitionBy("review").orderBy("n")
    at = diff.withColumn("path", F.last(F.when(F.col("text").startswith("+++ "), F.regexp_replace(F.substring("text", 5, 1 << 20), r"^b/", "")), ignorenulls=True).over(w))
    part = lambda i: F.regexp_extract("text", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    number = lambda i: F.when(part(i) == "", 1).otherwise(part(i)).cast("int")
    return at.where(F.col("text").startswith("@@ ")).select("review", "path", number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"))


def touched(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(review, symbol_id, lines): the symbols (path, start_line, end_line) that hunks overlap and how many changed lines they hold."""
    last = F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1
    both = changes.withColumn("last", last).join(symbols, "path").where((F.col("end_line") >= F.col("new_start")) & (F.col("start_line") <= F.col("last")))
    lines = F.least("last", "end_line") - F.greatest("new_start", "start_line") + 1
    return both.groupBy("review", "symbol_id").agg(F.sum(lines).alias("lines"))


def cochange_warnings(touched_paths: DataFrame, pairs: DataFrame, least_shared: int = 2, jaccard: float = 0.4, ratio: float = 0.3, most: int = 3) -> DataFrame:
    """(review, path, partner, shared, jaccard, rank): partners of touched files that usually change with them but aren't in the review."""
    from pyspark.sql import Window

    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("partner"), "shared", F.col("commits_a").alias("own"), "jaccard").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("partner"), "shared", F.col("commits_b").alias("own"), "jaccard"))
    near = touched_paths.join(both, "path").where((F.col("shared") >= least_shared) & ((F.col("jaccard") >= jaccard) | (F.col("shared") / F.col("own") >= ratio)))
    out = near.join(touched_paths.select("review", F.col("path").alias("partner")), ["review", "partner"], "left_anti")
    w = Window.partitionBy("review", "path").orderBy(F.col("jaccard").desc(), F.col("shared").desc(), "partner")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("review", "path", "partner", "shared", "jaccard", "rank")


#: Extensions tried for an import without one, in order.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".rs", ".java", ".cs")


def audit_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, specifier, outcome, resolved) of imports (importer, specifier): file, directory, bare or unresolvable.

    Relative specifiers are looked up as they are, with another extension, with an appended one, as index file of a
    directory, and as directory, in that order; others are bare.
    """
    base = F.regexp_replace("importer", r"/?[^/]*$", "")
    joined = F.filter(F.split(F.concat_ws("/", F.when(base != "", base), "specifier"), "/"), lambda p: (p != ".") & (p != ""))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    at = F.array_join(F.aggregate(joined, F.array().cast("array<string>"), step), "/")
    known = files.select("path").distinct()
    some = imports.distinct().withColumn("relative", F.col("specifier").startswith("."))
    exact = [(0, at)] + [(1, F.regexp_replace(at, r"\.[mc]?jsx?$", e)) for e in (".ts", ".tsx")] + [(2, F.concat(at, F.lit(e))) for e in EXTENSIONS] + [(3, F.concat(at, F.lit("/index" + e))) for e in EXTENSIONS]
    tries = some.where("relative").select("importer", "specifier", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), p.alias("path")) for n, p in exact])).alias("x")).select("importer", "specifier", "x.n", "x.path")
    hit = tries.join(known, "path").groupBy("importer", "specifier").agg(F.min(F.struct("n", "path")).alias("x"))
    folders = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("folder")).distinct()
    inside = some.where("relative").select("importer", "specifier", at.alias("folder")).join(folders, "folder", "left_semi").withColumn("is_folder", F.lit(True))
    out = some.join(hit, ["importer", "specifier"], "left").join(inside.select("importer", "specifier", "is_folder"), ["importer", "specifier"], "left")
    outcome = F.when(~F.col("relative"), "bare").when(F.col("x.n") < 3, "file").when(F.col("x.n") == 3, "directory").when(F.col("is_folder"), "directory").otherwise("unresolvable")
    return out.select("importer", "specifier", outcome.alias("outcome"), F.col("x.path").alias("resolved"))


def audit_dependencies(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(name, status): unused where only declared, undeclared where only used."""
    both = declared.select("name", F.lit(True).alias("d")).distinct().join(used.select("name", F.lit(True).alias("u")).distinct(), "name", "full_outer")
    return both.select("name", F.when(F.col("u").isNull(), "unused").when(F.col("d").isNull(), "undeclared").alias("status")).where("status IS NOT NULL")


def layer_violations(links: DataFrame, layers: list[dict], exceptions: list[dict] | None = None) -> DataFrame:
    """(source, target, source_layer, target_layer) of links between paths that the layers forbid.

    A path is in the first layer with a matching prefix. cannotImport wins over canImport; a layer without canImport may
    import all others; exceptions name files that may import a layer. Paths outside all layers break no rule.
    """
    def layer(c):
        out = None
        for x in layers:
            hit = F.lit(False)
            for p in x["paths"]:
                hit = hit | (c == p) | c.startswith(p.rstrip("/") + "/")
            out = F.when(hit, x["name"]) if out is None else out.when(hit, x["name"])
        return out if out is not None else F.lit(None).cast("string")

    known = links.withColumns({"source_layer": layer(F.col("source")), "target_layer": layer(F.col("target"))}).where(F.col("source_layer").isNotNull() & F.col("target_layer").isNotNull() & (F.col("source_layer") != F.col("target_layer")))
    bad = F.lit(False)
    for x in layers:
        own = F.col("source_layer") == x["name"]
        bad = bad | (own & F.col("target_layer").isin(x.get("cannotImport") or [""]))
        if x.get("canImport") is not None:
            bad = bad | (own & ~F.col("target_layer").isin(x["canImport"] or [""]))
    for x in exceptions or []:
        bad = bad & ~((F.col("source") == x["file"]) & F.col("target_layer").isin(x["canImport"]))
    return known.where(bad).select("source", "target", "source_layer", "target_layer")
