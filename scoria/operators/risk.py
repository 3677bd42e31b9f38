"""Files and symbols at risk: hotspots with history, unused code with its exemptions, coverage rankings, near clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as use of a symbol, what may be unused at all, which paths are apart, and the weights of risk.
USES = ("calls", "references", "instantiates", "tests", "exports", "implements", "extends", "overrides", "decorates")
REMOVABLE = ("function", "method", "class", "struct", "component", "resource")
CONTRACTS = ("class", "struct", "trait", "protocol", "interface")
AUXILIARY = r"(?i)(^|/)(__tests__|tests?|specs?|scripts?|bench(es|marks?)?|examples?|samples?|demos?)(/|$)|(\.|_)(test|spec)\."
FIXTURES = r"(?i)(^|/)(fixtures?|test-beds?|__mocks__|mocks?)(/|$)"
TESTS = r"(?i)(^|/)(__tests__|tests?|specs?)(/|$)|(\.|_)(test|spec)\."
WEIGHTS = {"incoming": 3, "outgoing": 2, "unresolved": 1, "routes": 4}


def file_risk(paths: DataFrame, symbols: DataFrame, arcs: DataFrame, open_sites: DataFrame, history: DataFrame, least_commits: int = 0) -> DataFrame:
    """One row per file (file_id, path) with its structure, history and scores.

    structural_risk weighs sites in, sites out, unresolved ones and routes; pressure and churn are relative to the
    greatest among the files considered; centrality is that of the file's most central symbol. risk is central or
    pressed files that change much, maintenance plain files that change much, brittle central ones that hardly do.
    composite has structure in hundreds and the capped history in units. `open_sites` is (symbol_id, sites), `history`
    (path, commits, insertions, deletions). Files without any are all 0; the two maxima are scalar subqueries.
    """
    at = symbols.select("symbol_id", "file_id").distinct()
    own = symbols.groupBy("file_id").agg(F.count_distinct("symbol_id").alias("symbols"), F.count_distinct(F.when(F.col("symbol_kind") == "route", F.col("symbol_id"))).alias("routes"), F.coalesce(F.max("pagerank"), F.lit(0.0)).alias("centrality"))
    used = arcs.where(F.col("kind") != "contains")
    ends = used.join(at.select(F.col("symbol_id").alias("target"), F.col("file_id").alias("into")), "target").join(at.select(F.col("symbol_id").alias("source"), F.col("file_id").alias("out_of")), "source", "left")
    inward = ends.where("out_of IS NOT NULL").groupBy(F.col("into").alias("file_id")).agg(F.sum("sites").alias("incoming"), F.count_distinct(F.when(F.col("out_of") != F.col("into"), F.col("out_of"))).alias("dependents"))
    outward = used.join(at.select(F.col("symbol_id").alias("source"), "file_id"), "source").groupBy("file_id").agg(F.sum("sites").alias("outgoing"))
    loose = open_sites.join(at, "symbol_id").groupBy("file_id").agg(F.sum("sites").alias("unresolved"))
    base = paths
    for part, on in ((own, "file_id"), (inward, "file_id"), (outward, "file_id"), (loose, "file_id"), (history.select("path", "commits", "insertions", "deletions"), "path")):
        base = base.join(part, on, "left")
    counts = ["symbols", "routes", "incoming", "dependents", "outgoing", "unresolved", "commits", "insertions", "deletions"]
    base = base.select("file_id", "path", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts]).where(F.col("commits") >= least_commits)
    structure = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0)).cast("long")
    change = F.col("commits") * 10 + F.col("insertions") + F.col("deletions")
    base = base.withColumns({"structural_risk": structure, "__change": change})
    most = base.agg(F.max("structural_risk").alias("risk"), F.max("__change").alias("change"))
    share = lambda c, top: F.when(top > 0, F.col(c) / top).otherwise(F.lit(0.0))
    out = base.withColumns({"pressure": share("structural_risk", most.select("risk").scalar()), "churn": share("__change", most.select("change").scalar())}).drop("__change")
    weight = F.col("centrality") * 0.7 + F.col("pressure") * 0.3
    composite = F.col("structural_risk") * 100 + F.least(F.col("commits"), F.lit(1000)) * 10 + F.least(F.floor((F.col("insertions") + F.col("deletions")) / 10), F.lit(1000))
    return out.withColumns({"composite": composite.cast("long"), "risk": weight * F.col("churn"), "maintenance": F.col("churn") * (1 - F.col("centrality")), "brittle": weight / (1 + F.col("churn"))})


def ranked_hotspots(scored: DataFrame, category: str = "risk", sort: str = "risk", most: int = 50) -> DataFrame:
    """The first `most` files of a category (risk, maintenance or brittle) with their place; risk may be sorted by centrality or churn too. Only files that others depend on are brittle."""
    order = {"maintenance": ["maintenance", "churn"], "brittle": ["brittle", "centrality"]}.get(category) or {"risk": ["risk", "centrality"], "centrality": ["centrality", "risk"], "churn": ["churn", "risk"]}[sort]
    some = scored.where("dependents > 0") if category == "brittle" else scored
    keys = [F.round(c, 12).desc() for c in order] + [F.col("path")]
    # A report of a fixed size; rows are cut in each task before they meet.
    return some.orderBy(*keys).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def unused_code(symbols: DataFrame, arcs: DataFrame, most: int, auxiliary: bool = False, fixtures: bool = False) -> DataFrame:
    """(project_id, symbol_id, path, outgoing, dispatch_risk, place): unexported symbols without a use from others.

    `symbols` has path and language. Left out are: paths of tests, scripts, benches and examples unless `auxiliary`,
    fixtures unless `fixtures`, main functions of Rust programs, and methods that aren't private or protected of an
    exported class, struct or interface, which may be called through it. The first `most` of a project by PageRank are
    taken before anything is added to them. dispatch_risk marks members of what implements or extends another.
    """
    used = arcs.where(F.col("kind").isin(list(USES)) & (F.col("source") != F.col("target"))).select(F.col("target").alias("symbol_id")).distinct()
    holds = arcs.where(F.col("kind") == "contains").select("source", F.col("target").alias("symbol_id")).distinct()
    public = symbols.where(F.col("exported") & F.col("symbol_kind").isin(list(CONTRACTS))).select("project_id", F.col("symbol_id").alias("source")).distinct()
    reachable = holds.join(public, "source").select("project_id", "symbol_id").distinct().withColumn("in_public", F.lit(True))
    free = symbols.where(F.col("symbol_kind").isin(list(REMOVABLE)) & ~F.coalesce("exported", F.lit(False))).join(used, "symbol_id", "left_anti").join(reachable, ["project_id", "symbol_id"], "left")
    main = (F.col("language") == "rust") & F.col("qualified_name").rlike(r"(^|::|[.#/$])main$") & F.col("path").rlike(r"(^|/)(build|main)\.rs$|(^|/)bin/[^/]+\.rs$")
    open_method = (F.col("symbol_kind") == "method") & ~F.coalesce("visibility", F.lit("public")).isin("private", "protected") & F.col("in_public").isNotNull()
    keep = ~F.coalesce(main, F.lit(False)) & ~open_method
    keep = keep if auxiliary else keep & ~F.col("path").rlike(AUXILIARY)
    keep = keep if fixtures else keep & ~F.col("path").rlike(FIXTURES)
    w = Window.partitionBy("project_id").orderBy(F.col("pagerank").desc_nulls_last(), "path", "start_line", "symbol_id")
    first = free.where(keep).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    out = arcs.where(~F.col("kind").isin("contains", "def_use")).join(first.select(F.col("symbol_id").alias("source")).distinct(), "source", "left_semi").groupBy(F.col("source").alias("symbol_id")).agg(F.count(F.lit(1)).alias("outgoing"))
    bound = arcs.where(F.col("kind").isin("implements", "extends")).select("source").distinct()
    risky = holds.join(bound, "source", "left_semi").select("symbol_id").distinct().withColumn("risky", F.lit(True))
    return first.join(out, "symbol_id", "left").join(risky, "symbol_id", "left").select("project_id", "symbol_id", "path", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("risky", F.lit(False)).alias("dispatch_risk"), "place")


def coverage_ranking(coverage: DataFrame, symbols: DataFrame, arcs: DataFrame, population: int, label: str | None = None, tests: bool = False) -> DataFrame:
    """(symbol_id, label, fraction, incoming, test_files, centrality): the best source of each covered symbol, with what depends on it.

    `coverage` is (symbol_id, label, found, hit, fraction); of several sources the greatest fraction counts, ties by
    label. `symbols` has a path; symbols of tests are left out unless `tests`. The ranking is by falling need: nulls
    first, then rising fraction, falling centrality and id.
    """
    some = coverage if label is None else coverage.where(F.col("label") == label)
    key = F.struct(F.coalesce(-F.col("fraction"), F.lit(1.0)).alias("k"), "label", "fraction")
    best = some.groupBy("symbol_id").agg(F.min(key).alias("b")).select("symbol_id", "b.label", "b.fraction")
    used = arcs.where(F.col("kind") != "contains")
    into = used.groupBy(F.col("target").alias("symbol_id")).agg(F.sum("sites").alias("incoming"))
    at = symbols.select("symbol_id", "file_id", "path").distinct()
    pressure = arcs.join(at.where(F.col("path").rlike(TESTS)).select(F.col("symbol_id").alias("source"), "file_id"), "source").groupBy(F.col("target").alias("symbol_id")).agg(F.count_distinct("file_id").alias("test_files"))
    known = at if tests else at.where(~F.col("path").rlike(TESTS))
    out = best.join(known.select("symbol_id").distinct(), "symbol_id", "left_semi").join(into, "symbol_id", "left").join(pressure, "symbol_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("symbol_id", "label", "fraction", z("incoming"), z("test_files"), F.least(F.lit(1.0), F.coalesce("incoming", F.lit(0)) / F.lit(max(population - 1, 1))).alias("centrality"))


def shape_clones(rows: DataFrame, key: str, code: Column, shape: Column, least_lines: int = 12, literals: float = 0.6) -> DataFrame:
    """(shape, members, structures, representative): rows of one shape but not all of one text.

    Rows of fewer lines or with a greater share of literals are no evidence. A class of any size is one row, its
    smallest key the representative.
    """
    literal = F.length(F.array_join(F.regexp_extract_all(code, F.lit(r"\"[^\"\n]*\"|'[^'\n]*'|[0-9]+"), F.lit(0)), ""))
    some = rows.where(F.col(key).isNotNull() & (F.regexp_count(code, F.lit("\n")) + 1 >= least_lines) & (literal <= literals * F.length(code)))
    groups = some.select(F.col(key).alias("k"), F.sha2(shape, 256).alias("shape"), F.sha2(code, 256).alias("text")).groupBy("shape")
    return groups.agg(F.count_distinct("k").alias("members"), F.count_distinct("text").alias("structures"), F.min("k").alias("representative")).where("structures > 1")


def duplicate_generations(generations: DataFrame, digests: DataFrame) -> DataFrame:
    """(project_id, generation_id, same_as): generations whose contents an older one of the project has already, and the oldest of those.

    `digests` is (project_id, generation_id, digest).
    """
    known = generations.select("project_id", "generation_id", "staged_at").join(digests, ["project_id", "generation_id"])
    w = Window.partitionBy("project_id", "digest").orderBy(F.col("staged_at").asc_nulls_first(), "generation_id")
    out = known.withColumn("same_as", F.first("generation_id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("same_as") != F.col("generation_id")).select("project_id", "generation_id", "same_as")


def prunable(generations: DataFrame, keep: int, days: dict[str, int], now: Column) -> DataFrame:
    """(project_id, generation_id, state): generations beyond the newest `keep` of their state that are older than its floor in days; current ones never, states without a floor never."""
    w = Window.partitionBy("project_id", "state").orderBy(F.col("staged_at").desc_nulls_last(), F.col("generation_id").desc())
    floor = F.create_map(*[F.lit(x) for kv in days.items() for x in kv])[F.col("state")]
    aged = generations.withColumns({"age": F.row_number().over(w), "floor": floor})
    return aged.where((F.col("state") != "current") & (F.col("age") > keep) & (F.datediff(now, F.col("staged_at")) > F.col("floor"))).select("project_id", "generation_id", "state")
