"""Code-health findings, rollups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.operators.snapshots import latest_rows

#: Detectors on a document's health metrics, as (metric, info, warning, error).
DETECTORS = {
    "large_method": ("lines", 100, 100, 200), "complex_method": ("cyclomatic", 15, 15, 25), "nested_complexity": ("nesting", 5, 5, 7),
    "brain_method": ("brain", 5, 10, 20), "incomplete_marker": ("markers", 1, 5, 50), "magic_number": ("numbers", 3, 5, 8), "hardcoded_url": ("urls", 1, 2, 3),
}


def health(docs: DataFrame) -> DataFrame:
    """(document_id, file_id, symbol_id, path, lines, cyclomatic, nesting, brain, markers, numbers, urls), each document once."""
    one = docs.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max(F.struct("file_id", "symbol_id", "path", "code", F.get_json_object("metadata", "$.health.lines").cast("double").alias("lines"), F.get_json_object("metadata", "$.health.cyclomatic").cast("double").alias("cyclomatic"), F.get_json_object("metadata", "$.health.nesting").cast("double").alias("nesting"))).alias("r")).select("document_id", "r.*")
    code = F.coalesce("code", F.lit(""))
    brain = F.when((F.col("lines") >= 50) & (F.col("cyclomatic") >= 8), F.col("lines") / 100 * F.col("cyclomatic") / 10 * F.greatest(F.lit(1.0), F.col("nesting") / 3)).otherwise(F.lit(0.0))
    count = lambda p: F.regexp_count(code, F.lit(p)).cast("double")
    return one.select("document_id", "file_id", "symbol_id", "path", "lines", "cyclomatic", "nesting", brain.alias("brain"), count("TODO|FIXME|XXX").alias("markers"), count(r"[^A-Za-z0-9_][0-9]{2,}").alias("numbers"), count("https?://").alias("urls"))


def findings(measures: DataFrame, detectors: dict = DETECTORS) -> DataFrame:
    """(document_id, path, finding, metric, severity): one row per detector whose metric reaches its first threshold.

    All detectors are unpivoted from one scan. A null metric finds nothing.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(m).alias("metric"), *[F.lit(float(x)).alias(t) for x, t in zip(levels, ("info", "warning", "error"), strict=True)]) for n, (m, *levels) in detectors.items()]))
    open_ = measures.select("document_id", "path", rows.alias("d")).select("document_id", "path", "d.*").where(F.col("metric") >= F.col("info"))
    severity = F.when(F.col("metric") >= F.col("error"), "error").when(F.col("metric") >= F.col("warning"), "warning").otherwise("info")
    return open_.select("document_id", "path", "finding", "metric", severity.alias("severity"))


def finding_stats(found: DataFrame, population: int) -> DataFrame:
    """(finding, errors, warnings, infos, health): health is 100 less the weighted findings per hundred symbols, 0 at least."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    out = found.groupBy("finding").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    return out.withColumn("health", F.greatest(F.lit(0.0), 100 - (4 * F.col("errors") + 2 * F.col("warnings") + F.col("infos")) * 100 / max(population, 1)))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with rank and the group's exact total."""
    w = Window.partitionBy(*group)
    return df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "total": F.count(F.lit(1)).over(w)}).where(F.col("rank") <= n)


def directory_rollup(files: DataFrame, path: str, measures: dict[str, Column]) -> DataFrame:
    """(directory, depth, measures): every file counted under each of its directories, those of the top level under '.'."""
    parts = F.split(F.col(path), "/")
    above = F.when(F.size(parts) < 2, F.array(F.lit("."))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return files.withColumn("directory", F.explode(above)).groupBy("directory").agg(*[c.alias(n) for n, c in measures.items()]).withColumn("depth", F.when(F.col("directory") == ".", 0).otherwise(F.size(F.split("directory", "/"))))


def shape(c: Column) -> Column:
    """Text with every run of letters, of digits and of blanks as one sign, so that copies with other names are equal."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[A-Za-z_]+", "a"), r"[0-9]+", "9"), r"\s+", " ")


def clone_groups(rows: DataFrame, key: str, digest: Column, size: Column, least: int) -> DataFrame:
    """(digest, members, representative): rows of at least the least size whose digests are equal, the smallest key first.

    Members aren't listed pairwise: a class of any size is one row.
    """
    big = rows.where(size >= least).select(F.col(key).alias("k"), digest.alias("digest")).where("digest IS NOT NULL")
    return big.groupBy("digest").agg(F.count_distinct("k").alias("members"), F.min("k").alias("representative")).where("members > 1")


def dead_code(symbols: DataFrame, edges: DataFrame, used_by: list[str], kinds: list[str], top: int) -> DataFrame:
    """The unexported symbols of some kinds that no other symbol uses, the `top` of each project by PageRank."""
    used = edges.where(F.col("kind").isin(used_by) & (F.col("source") != F.col("target"))).select(F.col("target").alias("symbol_id")).distinct()
    free = symbols.where(F.col("symbol_kind").isin(kinds) & ~F.coalesce("exported", F.lit(False))).join(used, "symbol_id", "left_anti")
    return top_per_group(free, ["project_id"], [F.col("pagerank").desc_nulls_last(), F.col("symbol_id")], top)


def hotspots(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, inbound, outbound, unresolved, structural_risk, pressure): 3 per inbound arc, 2 per outbound, 1 per unresolved; pressure is relative to the riskiest file."""
    where = symbols.select("symbol_id", "file_id").distinct()
    into = edges.join(where, edges["target"] == where["symbol_id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("inbound"))
    out = edges.join(where, edges["source"] == where["symbol_id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("outbound"), F.sum((F.col("confidence") < 0.5).cast("long")).alias("unresolved"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_ = into.join(out, "file_id", "full_outer").select("file_id", z("inbound"), z("outbound"), z("unresolved")).withColumn("structural_risk", 3 * F.col("inbound") + 2 * F.col("outbound") + F.col("unresolved"))
    most = all_.agg(F.max("structural_risk").alias("m")).scalar()
    return all_.withColumn("pressure", F.col("structural_risk") / most)


def cochanges(changes: DataFrame, commit: str, item: str, max_items: int, least_shared: int = 1) -> DataFrame:
    """(a, b, shared, commits_a, commits_b, jaccard): pairs changed in the same commits, a before b.

    Commits of more than max_items items count for each item but make no pairs; that limit, a rule of the measure,
    bounds what one commit can give.
    """
    once = changes.select(F.col(commit).alias("c"), F.col(item).alias("x")).where("c IS NOT NULL AND x IS NOT NULL").distinct()
    churn = once.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    lists = once.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_items).select("c")
    some = once.join(lists, "c")
    pairs = some.select("c", F.col("x").alias("a")).join(some.select("c", F.col("x").alias("b")), "c").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
    out = pairs.join(churn.select(F.col("x").alias("a"), F.col("n").alias("commits_a")), "a").join(churn.select(F.col("x").alias("b"), F.col("n").alias("commits_b")), "b")
    return out.withColumn("jaccard", F.col("shared") / (F.col("commits_a") + F.col("commits_b") - F.col("shared")))


def facets(df: DataFrame, dimensions: list[str], top: int) -> DataFrame:
    """(dimension, value, n, rank): counts of each dimension's values in one pass; nulls are the value 'none_observed', last among equals."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("none_observed")).alias("value")) for c in dimensions])).alias("x")).select("x.*")
    n = rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dimension").orderBy(F.col("n").desc(), (F.col("value") == "none_observed").cast("int"), "value")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def usage(calls: DataFrame, group: str, value: str, failed: Column) -> DataFrame:
    """(group, calls, failures, p50, p95, longest) of a call log, percentiles being values that occur."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")
    return calls.groupBy(group).agg(F.count(F.lit(1)).alias("calls"), F.sum(failed.cast("long")).alias("failures"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(value).alias("longest"))


#: The reasons for which a symbol counts as modified, with the columns compared.
MODIFIED = {"moved_file": "file_id", "kind": "symbol_kind", "signature": "signature", "structure": "digest", "visibility": "visibility", "exported": "exported", "declaration": "declaration_only", "lines": "start_line"}


def compare_symbols(old: DataFrame, new: DataFrame, keys: list[str], ignore_lines: bool = True) -> DataFrame:
    """(keys, ordinal, change, reasons): added, removed and modified symbols of two snapshots.

    Symbols of one key are paired by their order in the file. Reasons name each attribute that differs, nulls being
    equal to nulls; with ignore_lines a mere move within the file is no change.
    """
    w = Window.partitionBy(*keys).orderBy("start_line", "symbol_id")
    a, b = (s.select(*keys, *MODIFIED.values(), F.row_number().over(w).alias("ordinal")) for s in (old, new))
    a = a.select(*keys, "ordinal", F.struct(*MODIFIED.values()).alias("was"))
    b = b.select(*keys, "ordinal", F.struct(*MODIFIED.values()).alias("now"))
    differs = {r: ~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")) for r, c in MODIFIED.items() if not (ignore_lines and r == "lines")}
    reasons = F.array_compact(F.array(*[F.when(x, F.lit(r)) for r, x in differs.items()]))
    both = a.join(b, [*keys, "ordinal"], "full_outer").withColumn("reasons", F.when(F.col("was").isNotNull() & F.col("now").isNotNull(), F.array_join(reasons, ",")).otherwise(F.lit("")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("reasons") != "", "modified")
    return both.select(*keys, "ordinal", change.alias("change"), "reasons").where("change IS NOT NULL")


def drift(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """(path, change): paths added, modified or deleted between two tables of (path, content_hash)."""
    both = indexed.select("path", F.col("content_hash").alias("was"), F.lit(True).alias("in_old")).join(live.select("path", F.col("content_hash").alias("now"), F.lit(True).alias("in_new")), "path", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def line_coverage(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, found, hit, fraction) of executed lines (file_id, line, hits) inside symbols' spans; of a line reported twice the most hits count.

    A file's lines are folded, 64 to a word with a bit for each, before they are sorted and joined; a span cuts its part
    out of each word. Lines whose hits are null are found and count neither way; a span of only such has no fraction.
    The join always sorts and merges: lines exploded from a short list of files have that list's size as statistics, by
    which all of them would be broadcast through the driver.
    """
    line, word = F.col("line").cast("long"), F.col("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), line.bitwiseAND(63).cast("int"))
    words = lines.groupBy("file_id", F.shiftright(line, 6).alias("word")).agg(*[F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long"))).alias(n) for n, c in (("there", F.lit(True)), ("known", F.col("hits").isNotNull()), ("run", F.col("hits") > 0))])
    first, last = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    low, high = F.greatest(first - word * 64, F.lit(0)).cast("int"), F.least(last - word * 64, F.lit(63)).cast("int")
    span = F.call_function("shiftleft", F.lit(-1).cast("long"), low).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - high))
    met = symbols.select("symbol_id", "file_id", "start_line", "end_line").join(words.hint("merge"), "file_id").where(word.between(F.shiftright(first, 6), F.shiftright(last, 6)))
    inside = met.select("symbol_id", *[F.col(c).bitwiseAND(span).alias(c) for c in ("there", "known", "run")]).where("there <> 0")
    out = inside.groupBy("symbol_id").agg(F.sum(F.bit_count("there").cast("long")).alias("found"), F.sum(F.when(F.col("known") != 0, F.bit_count("run").cast("long"))).alias("hit"))
    return out.withColumn("fraction", F.when(F.col("found") > 0, F.col("hit") / F.col("found")))


def retention(generations: DataFrame, keep: int) -> DataFrame:
    """(project_id, generation_id, state, age, kept): per project and state the newest `keep` stay, the current one always."""
    w = Window.partitionBy("project_id", "state").orderBy(F.col("staged_at").desc_nulls_last(), F.col("generation_id").desc())
    aged = generations.withColumn("age", F.row_number().over(w))
    return aged.select("project_id", "generation_id", "state", "age", ((F.col("state") == "current") | (F.col("age") <= keep)).alias("kept"))


def missing_keys(rows: DataFrame, columns: list[str], keys: DataFrame, key: str) -> DataFrame:
    """(relation, missing): the values of each column that aren't among the keys; nulls refer to nothing."""
    used = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("relation"), F.col(c).cast("string").alias("missing")) for c in columns])).alias("x")).select("x.*").where("missing IS NOT NULL").distinct()
    return used.join(keys.select(F.col(key).cast("string").alias("missing")).distinct(), "missing", "left_anti").select("relation", "missing")


def logical_digest(rows: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """(group, rows, digest): a digest of the distinct rows of each group that doesn't depend on their order.

    Hashes are added up in parts that can't overflow, so a group of any size is combined inside each task.
    """
    # Each value with its length before it, so that no two rows are written alike.
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    once = rows.select(*group, F.sha2(F.concat(*[text(c) for c in columns]), 256).alias("h")).distinct()
    sums = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return once.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[s.cast("string") for s in sums]).alias("digest"))


def canonical_rows(batches: DataFrame, key: list[str], payload: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """The first delivered row of each key, and (key, variants) of the keys whose rows contradict each other."""
    h = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    conflicts = batches.groupBy(*key).agg(F.count_distinct(h).alias("variants")).where("variants > 1")
    flipped = batches.withColumn("__at", -F.unix_micros(F.col(at).cast("timestamp")))
    return latest_rows(flipped, key, "__at", payload), conflicts


def carried_forward(old: DataFrame, new: DataFrame, keys: list[str], digest: str, values: list[str]) -> DataFrame:
    """The old values of rows whose key and digest are unchanged in the new generation."""
    return new.select(*keys, digest).join(old.select(*keys, digest, *values), [*keys, digest])
