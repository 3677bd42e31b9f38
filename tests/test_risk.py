from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoria.operators import insights, risk

SYMBOLS = "project_id string, symbol_id string, file_id string, symbol_kind string, qualified_name string, visibility string, exported boolean, pagerank double, start_line int, path string, language string, name string"
ARCS = "source string, target string, kind string, sites long"


def symbol(id_, file="f1", kind="function", exported=False, rank=None, path="src/a.ts", lang="typescript", visibility=None, name=None):
    return ("p", id_, file, kind, name or id_, visibility, exported, rank, 1, path, lang, "clash")


def test_file_risk_and_categories(spark):
    symbols = spark.createDataFrame([symbol("a", rank=0.5), symbol("b", "f2"), symbol("r", "f2", "route")], SYMBOLS)
    arcs = spark.createDataFrame([("b", "a", "calls", 4), ("a", "a", "calls", 1), ("a", "b", "contains", 9), ("gone", "a", "calls", 7)], ARCS)
    paths = spark.createDataFrame([("f1", "src/a"), ("f2", "src/b"), ("f3", "src/c")], "file_id string, path string")
    open_sites = spark.createDataFrame([("b", 5), ("x", 9)], "symbol_id string, sites long")
    history = spark.createDataFrame([("src/b", 3, 50, 20)], "path string, commits long, insertions long, deletions long")
    scored = risk.file_risk(paths, symbols, arcs, open_sites, history)
    got = {r.file_id: r for r in scored.collect()}
    assert {k: (r.incoming, r.outgoing, r.unresolved, r.routes, r.structural_risk, r.dependents) for k, r in got.items()} == {"f1": (5, 1, 0, 0, 17, 1), "f2": (0, 4, 5, 1, 17, 0), "f3": (0, 0, 0, 0, 0, 0)}
    assert got["f2"].churn == 1 and got["f2"].composite == 1737 and got["f2"].maintenance == 1 and got["f2"].risk == pytest.approx(0.3)
    assert got["f1"].risk == 0 and got["f1"].brittle == pytest.approx(0.65) and got["f3"].pressure == 0
    assert [r.file_id for r in risk.ranked_hotspots(scored, "risk").orderBy("place").collect()] == ["f2", "f1", "f3"]
    assert [r.file_id for r in risk.ranked_hotspots(scored, "brittle").collect()] == ["f1"]
    assert [r.file_id for r in risk.ranked_hotspots(scored, sort="centrality", most=1).collect()] == ["f1"]
    assert risk.file_risk(paths, symbols, arcs, open_sites, history, least_commits=1).count() == 1
    assert {r.risk for r in risk.file_risk(paths, symbols.limit(0), arcs.limit(0), open_sites, history.limit(0)).collect()} == {0.0}


def test_unused_code_and_its_exemptions(spark):
    rows = [
        symbol("free", rank=0.1), symbol("risky", kind="method", rank=0.9, visibility="private"), symbol("used"), symbol("self"), symbol("out", exported=True), symbol("t", path="tests/x.ts"), symbol("fix", path="mocks/x.ts"),
        symbol("main", path="src/main.rs", lang="rust"), symbol("main2", path="src/lib.rs", lang="rust", name="a::main"), symbol("C", kind="class", exported=True), symbol("open", kind="method"), symbol("closed", kind="method", visibility="private"), symbol("v", kind="variable"),
    ]
    arcs = spark.createDataFrame([("x", "used", "calls", 1), ("self", "self", "calls", 1), ("C", "open", "contains", 1), ("C", "closed", "contains", 1), ("D", "risky", "contains", 1), ("D", "I", "implements", 1), ("free", "used", "calls", 1), ("free", "z", "def_use", 1), (None, "free", "calls", 1)], ARCS)
    out = risk.unused_code(spark.createDataFrame(rows, SYMBOLS), arcs, 9)
    got = {r.symbol_id: (r.outgoing, r.dispatch_risk) for r in out.collect()}
    assert got == {"free": (1, False), "risky": (0, True), "self": (1, False), "main2": (0, False), "closed": (0, False)}
    assert [r.symbol_id for r in out.where("place <= 2").orderBy("place").collect()] == ["risky", "free"]
    more = risk.unused_code(spark.createDataFrame(rows, SYMBOLS), arcs, 99, auxiliary=True, fixtures=True)
    assert {r.symbol_id for r in more.collect()} - set(got) == {"t", "fix"}
    assert risk.unused_code(spark.createDataFrame([], SYMBOLS), arcs, 9).count() == 0


def test_best_source_of_coverage(spark):
    rows = [("a", "unit", 4, 1, 0.25), ("a", "system", 4, 2, 0.5), ("a", "late", 4, 2, 0.5), ("b", "unit", 0, 0, None), ("t", "unit", 1, 1, 1.0), ("gone", "unit", 1, 1, 1.0)]
    coverage = spark.createDataFrame(rows, "symbol_id string, label string, found int, hit int, fraction double")
    symbols = spark.createDataFrame([symbol("a"), symbol("b"), symbol("t", "f2", path="tests/t.ts")], SYMBOLS)
    arcs = spark.createDataFrame([("t", "a", "tests", 3), ("b", "a", "calls", 1)], ARCS)
    got = {r.symbol_id: (r.label, r.fraction, r.incoming, r.test_files, r.centrality) for r in risk.coverage_ranking(coverage, symbols, arcs, 9).collect()}
    assert got == {"a": ("late", 0.5, 4, 1, 0.5), "b": ("unit", None, 0, 0, 0.0)}
    assert risk.coverage_ranking(coverage, symbols, arcs, 9, "unit", True).where("symbol_id = 'a'").first().fraction == 0.25
    assert risk.coverage_ranking(coverage.limit(0), symbols, arcs, 0).count() == 0


def test_near_clones(spark):
    body = "def {0}(x):\n    y = x + {1}\n    return y\n"
    rows = [("a", body.format("f", 1)), ("b", body.format("g", 2)), ("c", body.format("f", 1)), ("d", "short"), ("e", None), (None, body.format("h", 3)), ("lit", "\n\n\n'" + "x" * 99 + "'"), ("lit2", "\n\n\n'" + "z" * 99 + "'")]
    df = spark.createDataFrame(rows, "k string, code string")
    (r,) = risk.shape_clones(df, "k", F.col("code"), insights.shape(F.col("code")), 3).collect()
    assert (r.members, r.structures, r.representative) == (3, 2, "a")
    assert risk.shape_clones(df.where("k IN ('a', 'c')"), "k", F.col("code"), insights.shape(F.col("code")), 3).count() == 0


def test_generations_to_prune(spark):
    day = lambda i: datetime(2024, 1, i)
    rows = [("p", 1, "superseded", day(1)), ("p", 2, "superseded", day(5)), ("p", 3, "superseded", None), ("p", 4, "current", day(2)), ("p", 5, "failed", day(1)), ("p", 6, "failed", day(1)), ("p", 7, "odd", day(1)), ("p", 8, "odd", day(1))]
    g = spark.createDataFrame(rows, "project_id string, generation_id long, state string, staged_at timestamp_ntz")
    got = {r.generation_id for r in risk.prunable(g, 1, {"superseded": 10, "failed": 99}, F.lit("2024-01-20").cast("date")).collect()}
    assert got == {1}
    digests = spark.createDataFrame([("p", i, d) for i, d in ((1, "x"), (2, "x"), (3, "y"), (4, "x"))], "project_id string, generation_id long, digest string")
    assert {(r.generation_id, r.same_as) for r in risk.duplicate_generations(g, digests).collect()} == {(2, 1), (4, 1)}
