from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoria.operators import context, detectors, graph, history, lookup, search
from scoria.plans import runtime
from scoria.sources import reports, sinks

SYMBOLS = "project_id string, symbol_id string, file_id string, symbol_kind string, qualified_name string, simple_name string, signature string, start_line int, end_line int, exported boolean, declaration_only boolean, pagerank double, path string, language string, digest string, name string"


def symbol(id_, file="f1", kind="function", name=None, line=1, end=9, exported=False, rank=None, path="src/a.ts", lang="typescript", digest=None, signature="()"):
    name = name or f"m::{id_}"
    return ("p", id_, file, kind, name, name.split("::")[-1], signature, line, end, exported, False, rank, path, lang, digest, "clash")


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        symbol("a", line=5, rank=0.5, exported=True), symbol("b", line=1, rank=0.1), symbol("c", file="f2", path="cmd/run.py", lang="python", name="m::Trace"), symbol("r", file="f2", kind="route", name="GET /x", path="cmd/run.py"),
        symbol("k", kind="route", name="cmd list"), symbol("t", file="f3", kind="test", path="tests/t.py"), symbol("T", kind="constant", name="SCAN_TOOL"), symbol("m1", kind="method", name="A::run"), symbol("m2", file="f2", kind="method", name="B::run", path="cmd/run.py"), symbol("m3", file="f2", kind="method", name="C::run", path="cmd/run.py"),
    ]
    return spark.createDataFrame(rows, SYMBOLS)


@pytest.fixture(scope="module")
def arcs(spark):
    rows = [("a", "b", "calls", 2, 1.0), ("c", "a", "calls", 1, 1.0), ("t", "b", "tests", 1, 0.5), ("a", "c", "imports", 3, 1.0), ("b", "b", "calls", 1, 1.0)]
    return spark.createDataFrame(rows, "source string, target string, kind string, sites long, confidence double")


def test_lookups_by_id_file_and_path(spark, symbols):
    got = [(r.ordinal, r.symbol_id, r.project_id) for r in lookup.symbols_by_id(symbols, ["b", "no", "a", "b"]).orderBy("ordinal").collect()]
    assert got == [(1, "b", "p"), (2, "no", None), (3, "a", "p"), (4, "b", "p")]
    assert lookup.symbols_by_id(symbols, []).count() == 0
    files = spark.createDataFrame([("f1",), ("f1",), (None,)], "file_id string")
    assert [(r.symbol_id, r.place) for r in lookup.symbols_in(symbols, files).where("file_id = 'f1' AND place <= 2").orderBy("place").collect()] == [("T", 1), ("b", 2)]
    rows = [("f1", "x", "py", "h1", 1, "ok", datetime(2024, 1, 1)), ("f1", "y", "py", "h2", 1, "ok", datetime(2024, 1, 2)), ("f2", None, None, None, None, None, None), (None, "y", "", "", 1, "", None)]
    stored = spark.createDataFrame(rows, "file_id string, normalized_path string, language string, content_hash string, byte_size long, parse_status string, delivered_at timestamp_ntz")
    assert [r.content_hash for r in lookup.files_at(stored, ["x", "y"]).collect()] == ["h2"]


def test_reference_sites_and_rename(spark, symbols):
    rows = [(" A", "B ", "Calls", 0.5, "x", 2), ("a", "b", "calls", 0.5, "x", 2), ("a", None, "calls", None, "x", 1), ("gone", "b", "calls", 1.0, "x", 1), ("c", "lib", "references", 1.0, "y", 4)]
    edges = spark.createDataFrame(rows, "source_symbol_id string, target_symbol_id string, edge_kind string, confidence double, provenance string, site_count long")
    library = spark.createDataFrame([("lib", "std::sort", "rust")], "symbol_id string, qualified_name string, language string")
    sites = lookup.reference_sites(edges, symbols, library)
    assert sorted((r.owner, r.target, r.name, r.sites) for r in sites.where("target IS NOT NULL").collect()) == [("a", "b", "b", 2), ("c", "lib", "sort", 4)]
    assert sites.where("name IS NULL").count() == 1
    assert [r.place for r in lookup.references_by_name(sites, ["sort"]).collect()] == [1]
    texts = spark.createDataFrame([("f1", "b(b) bb _b"), ("f9", "b.b"), ("f8", "nothing"), ("f7", None)], "file_id string, text string")
    assert sorted(tuple(r) for r in lookup.rename_plan(sites, texts, "b", "b").collect()) == [("f1", 2, 2), ("f9", 0, 2)]


def test_entry_buckets(symbols, arcs):
    used = arcs.where("source <> target").select(F.col("target").alias("symbol_id"))
    got = {(r.bucket, r.symbol_id, r.total) for r in lookup.entry_points(symbols, used, 5).collect()}
    assert got == {("routes", "r", 1), ("cli_commands", "k", 1), ("tools", "T", 1), ("cli_files", "c", 3), ("cli_files", "m2", 3), ("cli_files", "m3", 3)}
    assert lookup.entry_points(symbols, used.limit(0), 5).where("bucket = 'public_exports'").count() == 1
    assert lookup.entry_points(symbols.limit(0), used, 5).count() == 0


def test_qualified_queries(symbols, arcs):
    names = symbols.select("symbol_id", "qualified_name", "simple_name")
    ask = lambda q: [r.symbol_id for r in lookup.qualified(symbols, arcs, names, q).orderBy("place").collect()]
    assert ask("kind:function lang:TypeScript") == ["a", "b"] and ask("kind:function sort:name")[0] == "c"
    assert ask("callers-of:b") == ["a", "b"] and ask('callees-of:"m::Trace"') == ["a"] and ask("depends-on:Trace") == ["a"] and ask("callers-of:nothing") == []
    assert ask("centrality:0.3") == ["a"] and ask("centrality:<0.05 kind:test") == ["t"] and ask("trace path:cmd/") == ["c"] and ask("path:tests") == ["t"]


def test_names_percentiles_imports(spark, symbols, arcs):
    assert {(r.symbol_id, r.elsewhere) for r in lookup.same_names_elsewhere(symbols, ["method"]).collect()} == {("m1", 2), ("m2", 1), ("m3", 1)}
    rows = spark.createDataFrame([("x", 0), ("y", 0), ("z", 5), ("w", 9)], "k string, v long")
    assert {r.k: r.percentile for r in lookup.percent_ranks(rows, ["k"], "v").collect()} == {"x": 0.0, "y": 0.0, "z": 2 / 3, "w": 1.0}
    assert lookup.percent_ranks(rows.limit(0), ["k"], "v").count() == 0
    at = symbols.groupBy("file_id").agg(F.min("path").alias("path"))
    assert [tuple(r) for r in lookup.import_evidence(arcs, symbols, at).collect()] == [("src/a.ts", "cmd/run.py", 1, 3)]
    texts = spark.createDataFrame([("a.ts", "typescript", 'import x from "react/dom";\nimport "@a/b/c";\nexport { y } from "./z";\n'), ("b.py", "python", 'import "react"'), ("c.js", "javascript", None)], "path string, language string, text string")
    assert {tuple(r) for r in lookup.external_imports(texts).collect()} == {("react", "typescript", 1, 1), ("@a/b", "typescript", 1, 1)}


def test_overlay(spark):
    rows = lambda x: spark.createDataFrame(x, "source string, v int")
    assert sorted(tuple(r) for r in lookup.overlay(rows([("a", 1), ("b", 1), (None, 1)]), rows([("a", 2), ("a", 3)]), rows([("a", 2)]), "source").collect() if r.source) == [("a", 2), ("a", 3), ("b", 1)]


def test_file_test_impact(spark, symbols, arcs):
    at = symbols.groupBy("file_id").agg(F.min("path").alias("path"))
    got = {(r.root, r.path): (r.depth, r.symbols, r.barrel) for r in graph.file_test_impact(at.where("file_id = 'f1'"), arcs, symbols, at, 2, r"(^|/)tests?/", lookup.PATH_CLASSES["barrel"]).collect()}
    assert got == {("f1", "tests/t.py"): (1, 1, False)}


def test_parameter_counts(spark):
    df = spark.createDataFrame([("()",), ("(a, b: Map<X, Y>)",), ("fn f(&self, g: Fn(u8, u8)) -> (A, B)",), ("",), (None,), ("(x = [1, 2], {a, b})",)], "s string")
    assert [r[0] for r in df.select(detectors.parameter_count(F.col("s"))).collect()] == [0, 2, 2, 0, 0, 2]


def test_symbol_findings(spark):
    rows = [symbol("big", end=120, signature="(a, b, c, d, e, f, g)", digest="x"), symbol("copy", end=120, file="f2", digest="x"), symbol("grown", end=60), symbol("exp", exported=True), symbol("used", exported=True), symbol("far", file="f2"), symbol("K", kind="class")] + [symbol(f"k{i}", kind="method", end=6) for i in range(16)]
    current = spark.createDataFrame(rows, SYMBOLS).drop("path")
    arcs = spark.createDataFrame([("far", "used", "calls", 1, 1.0)] + [("K", f"k{i}", "contains", 1, 1.0) for i in range(16)] + [("big", f"n{i}", "calls", 1, 1.0) for i in range(30)], "source string, target string, kind string, sites long, confidence double")
    open_ = spark.createDataFrame([("far", None, 20), ("far", "x", 99)], "source string, target string, sites long")
    docs = spark.createDataFrame([("big", '{"health": {"lines": 120, "cyclomatic": 30, "nesting": 6, "operands": 8}}')] + [(f"k{i}", '{"health": {"cyclomatic": 3}}') for i in range(6)], "symbol_id string, metadata string")
    previous = spark.createDataFrame([("p", "grown", 1, 30, datetime(2024, 5, 1)), ("p", "big", 1, 119, datetime(2024, 5, 1))], "project_id string, symbol_id string, start_line int, end_line int, published_at timestamp_ntz")
    paths = spark.createDataFrame([("f1", "src/a.ts"), ("f2", "src/b.ts")], "file_id string, path string")
    coverage = spark.createDataFrame([("far", 0.1)], "symbol_id string, fraction double")
    measures = detectors.symbol_measures(current, arcs, open_, docs, previous, paths, coverage)
    got = {(r.symbol_id, r.finding): (r.metric, r.severity) for r in detectors.symbol_findings(measures).collect()}
    assert got == {
        ("big", "large_method"): (120, "warning"), ("big", "complex_method"): (30, "error"), ("big", "nested_complexity"): (6, "warning"), ("big", "complex_conditional"): (8, "error"), ("big", "long_parameter_list"): (7, "error"),
        ("big", "brain_method"): (pytest.approx(14.4), "warning"), ("big", "high_fan_out"): (30, "info"), ("big", "duplicate_code"): (2, "warning"), ("grown", "recently_grew"): (200, "warning"), ("exp", "unused_export"): (1, "warning"),
        ("K", "god_class"): (16, "info"), ("far", "unresolved_reference_pressure"): (20, "info"), ("far", "low_coverage"): (90, "error"),
    }
    assert detectors.symbol_findings(detectors.symbol_measures(current.limit(0), arcs, open_, docs, previous.limit(0), paths)).count() == 0


def test_text_findings_and_filters(spark):
    code = "try {\n} catch (e) {}\nconst a = JSON.parse(x);\nrequests.get(u, timeout=3)\nrequests.get(u)\neval(y)\n"
    docs = spark.createDataFrame([("d", code, "src/a"), ("d", None, "src/a"), (None, code, ""), ("short", "eval(x)", ""), ("none", None, "")], "document_id string, code string, path string")
    found = detectors.text_findings(docs).join(docs.select("document_id", "path").where("path <> ''").distinct(), "document_id")
    assert {(r.finding, r.metric) for r in found.where("finding <> 'empty_function_body'").collect()} == {("empty_catch", 1), ("unsafe_json_parse", 1), ("http_no_timeout", 1), ("dynamic_eval", 1)}
    assert [r.finding for r in detectors.filter_findings(found, severity="error", include="src/", exclude="src/b").collect()] == ["dynamic_eval"]
    assert detectors.filter_findings(found, ["empty_catch"], metric=(2, None)).count() == 0
    members = spark.createDataFrame([("k", i) for i in range(30)] + [("j", 1)], "key string, member int")
    (row,) = detectors.finding_details(spark.createDataFrame([("k",)], "key string"), members).collect()
    assert row.n == 30 and row.detail == "[" + ",".join(map(str, range(10))) + "]"


DOCS = "document_id string, file_id string, symbol_id string, path string, language string, document_kind string, qualified_name string, code string, natural_text string"


def test_context_packets(spark):
    rows = [("d1", "f", "s1", "src/scan.py", "python", "symbol", "scan::runScanner", "scanner scanner", "walks"), ("d2", "f", "s2", "src/scan.py", "python", "symbol", "scan::stop", "x", "the scanner stops"), ("d3", "g", None, "tests/scan_test.py", "python", "test", "scan_test::works", "scanner", ""), ("d4", "h", "s4", "src/other.py", "python", "symbol", "other::thing", None, None), (None, "", "", "", "", "", "scanner", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    p = context.context_packet("Change the scanner run", docs)
    assert p.states == {"exact": "unavailable", "all": "used", "names": "used", "text": "used", "semantic": "unavailable", "packet": "ok"}
    order = [r.doc for r in p.evidence.orderBy("place").collect()]
    assert order[0] == "d1" and order[-1] == "d3" and "d4" not in order
    assert [(r.path, r.terms, r.exact, r.names) for r in p.edits.collect()] == [("src/scan.py", 2, False, "scan::runScanner")]
    assert [tuple(r) for r in p.tests.collect()] == [("tests/scan_test.py", "d3", 0)]
    named = context.context_packet("Rename `other::thing`, please", docs)
    assert named.states["exact"] == "used" and [(r.path, r.exact) for r in named.edits.collect()] == [("src/other.py", True)]
    assert context.context_packet("zzzz", docs).states["packet"] == "no_relevant_evidence"
    assert context.context_packet("?", docs).states["packet"] == "no_usable_channel"
    # A question about tests doesn't put them last.
    assert [r.tier for r in context.context_packet("which tests cover the scanner", docs).evidence.where("doc = 'd3'").collect()] == [0]
    edges = spark.createDataFrame([("s1", "q", "calls", 1, 1.0)], "source string, target string, kind string, sites long, confidence double")
    assert ("s1", "q", 1) in {tuple(r) for r in context.expand(p, docs, edges).collect()}
    assert context.context_packet("scanner", docs.limit(0)).evidence.count() == 0


def test_review_packet(spark, symbols, arcs):
    at = symbols.groupBy("file_id").agg(F.min("path").alias("path"))
    own, impact, tests = context.review_packet(spark.createDataFrame([("src/a.ts",)], "path string"), symbols.drop("path"), arcs, at, r"(^|/)tests?/")
    assert {r.symbol_id for r in own.collect()} >= {"a", "b"}
    assert {(r.node, r.depth) for r in impact.collect()} == {("c", 1), ("t", 1)}
    assert [(r.path, r.symbol_id) for r in tests.collect()] == [("tests/t.py", "t")]


def test_git_logs(spark):
    text = ["noise", "abcdef1\t1700000000\ta@x", "", "3\t1\tsrc/{a => b}/c.py", "-\t-\tlogo.png", "0\t0\told.py => new.py", "abcdef2\t1700000100\tb@x", "1\t0\tsrc/b/c.py"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "log string, n int, text string")
    commits, changes = history.parse_git_log(lines)
    assert sorted((r.commit, r.author, r["at"].timestamp()) for r in commits.collect()) == [("abcdef1", "a@x", 1700000000.0), ("abcdef2", "b@x", 1700000100.0)]
    assert sorted(tuple(r) for r in changes.collect() if r.old_path is None) == [("abcdef1", "logo.png", None, 0, 0), ("abcdef2", "src/b/c.py", None, 1, 0)]
    assert sorted(tuple(r) for r in changes.collect() if r.old_path) == [("abcdef1", "new.py", "old.py", 0, 0), ("abcdef1", "src/b/c.py", "src/a/c.py", 3, 1)]


def test_peers_queues_and_pending(spark):
    rows = [(c, x) for c, xs in {"c1": "ab", "c2": "ab", "c3": "ac", "c4": "abcdefgh"}.items() for x in xs] + [(None, "a"), ("c1", None), ("c1", "a")]
    changes = spark.createDataFrame(rows, "commit string, item string")
    assert [(r.peer, r.shared) for r in history.peers(changes, "commit", "item", 3, 2).where("item = 'a'").orderBy("place").collect()] == [("b", 2), ("c", 1)]
    assert [(r.ordinal, r.item, r.commits) for r in history.commit_peers(changes, "commit", "item", ["c3", "no", "c1"], 1).orderBy("ordinal").collect()] == [(1, "a", 4), (3, "a", 4)]
    queue = spark.createDataFrame([("a", 5), ("b", 1), ("b", 2)], "symbol_id string, priority int")
    hits = spark.createDataFrame([("a",), ("c",), ("c",)], "symbol_id string")
    assert {tuple(r) for r in history.enqueue(queue, hits, 5).collect()} == {("a", 5), ("b", 2), ("c", 1)}
    now = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project_id string, symbol_id string, digest string")
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "9")], "project_id string, symbol_id string, digest string")
    assert {(r.symbol_id, r.why) for r in history.pending_summaries(now, old, ["project_id", "symbol_id"], "digest", [F.col("symbol_id")], 9).collect()} == {("b", "stale"), ("c", "missing")}
    frames = history.stack_frames(spark.createDataFrame([("t", 'at f (src/a.ts:12:3)\nFile "lib/b.py", line 7, in g'), ("u", None)], "trace string, text string"))
    assert [(r.path, r.line) for r in frames.orderBy("place").collect()] == [("src/a.ts", 12), ("lib/b.py", 7)]
    titles = history.test_titles(spark.createDataFrame([("a.ts", "it('adds', () => {\n  test.only(\"no\")"), ("b.py", "def test_x():"), ("c", None)], "path string, text string"))
    assert {tuple(r) for r in titles.collect()} == {("a.ts", 1, "adds"), ("a.ts", 2, "no"), ("b.py", 1, "test_x")}
    docs = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0])], "doc_id long, embedding array<double>")
    assert tuple(history.readiness(docs, vectors, "doc_id", 2).first()) == (2, 1, 1, 0, False)
    assert tuple(history.readiness(docs.limit(0), vectors, "doc_id", 2).first()) == (0, 0, 0, 0, False)


def test_publishing_keeps_a_pointer_at_all_times(spark, tmp_path):
    root = str(tmp_path / "g")
    assert sinks.current(spark, root) is None
    sinks.publish(spark, root, 7, 1)
    sinks.publish(spark, root, 9, 2)
    assert sinks.current(spark, root) == {"generation": 9, "sequence": 2}
    for stale in (1, 2):
        with pytest.raises(ValueError):
            sinks.publish(spark, root, 8, stale)
    assert sinks.current(spark, root) == {"generation": 9, "sequence": 2}


def test_states_are_freed_and_need_a_shared_folder(spark, monkeypatch):
    first = runtime.checkpointed(spark.range(3))
    second = runtime.checkpointed(first.withColumn("x", F.lit(1)), first)
    place, fs = runtime._place(spark, first._scoria_path)
    assert not fs.exists(place) and second.count() == 3
    runtime.release(second, None)

    class Unset:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Unset(), {}

    with pytest.raises(ValueError):
        runtime.ensure_checkpoint_dir(Session())


def test_pages_by_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 1), ("b", None), ("b", 3)], "k string, n int")
    seen, last = [], None
    while rows := lookup.page_after(df.distinct(), ["k", "n"], last, 2).collect():
        seen += [tuple(r) for r in rows[:2]]
        last = seen[-1]
    assert seen == [(None, 1), (None, 2), ("a", 1), ("b", None), ("b", 3)]


def test_index_is_stored_and_verified(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "flushBuffer", "", ""), ("d2", "flish_other", "x flush", ""), (None, "flush", "", "")], "document_id string, qualified_name string, code string, natural_text string")
    index = search.postings(docs)
    search.persist_index(index, str(tmp_path / "i"), 8)
    stored = search.read_index(spark, str(tmp_path / "i"), buckets=8)
    assert search.index_differences(index, stored).isEmpty()
    assert {r.side for r in search.index_differences(index, stored.where("doc <> 'd1'")).collect()} == {"missing"}
    assert {r.doc for r in search.read_index(spark, str(tmp_path / "i"), ["flush"], 8).collect()} == {"d1", "d2"}
    names = index.where("field = 'qualified_name'")
    assert {(r.doc, r.score, r.best_edits) for r in search.fuzzy_ranked(names, "flush", 1).collect()} == {("d1", 1.0, 0), ("d2", 0.5, 1)}


def test_source_trees_follow_ignore_rules(spark, tmp_path):
    for p, t in {"a.py": "x", "lib/b.py": "y", "lib/keep.log": "k", "lib/c.log": "l", "node_modules/d.py": "z", "big.py": "x" * 99}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    tree = lambda **k: {r.path for r in reports.source_tree(spark, str(tmp_path), **k).collect()}
    assert tree(exclude=["# comment", "*.log", "!keep.log", "node_modules/"]) == {"a.py", "lib/b.py", "lib/keep.log", "big.py"}
    assert tree(pattern="*.py", allow=["lib/**"]) == {"lib/b.py"} and tree(largest=50, exclude=["lib", "node_modules"]) == {"a.py"}
