import itertools
import random

import pytest
from pyspark.sql import functions as F

from scoria.functions import adhoc
from scoria.operators import insights, joins, review, search, vectors
from scoria.sources import reports, sinks
from scoria.streaming import windows


def test_code_tokens(spark):
    df = spark.createDataFrame([("cartSearch snake_case 42",), ("parseHTTPResponse",), ("",)], "x string")
    assert [r[0] for r in df.select(search.code_tokens(F.col("x"))).collect()] == [["cart", "search", "snake", "case", "42"], ["parse", "http", "response"], []]


def test_fusion_for_every_permutation(spark):
    for order in itertools.permutations("abcd"):
        rows = [("x", d, i + 1) for i, d in enumerate("abcd")] + [("y", d, i + 1) for i, d in enumerate(order)]
        got = [r.doc for r in search.fuse(spark.createDataFrame(rows, "channel string, doc string, rank int")).orderBy("place").collect()]
        score = {d: 1 / (61 + "abcd".index(d)) + 1 / (61 + order.index(d)) for d in "abcd"}
        assert got == sorted("abcd", key=lambda d: (-score[d], min("abcd".index(d), order.index(d)), d))


def test_intents_and_qualifiers():
    assert [search.intent(x) for x in ("why does it crash", "which tests cover x", "read the docs", "how is y wired", "callers of z", "rename it", "hello", "a regression")] == ["error", "test", "documentation", "implementation", "trace", "change", "change", "error"]
    assert search.parse_qualified('kind:function name:"a b" centrality:0.5 foo odd:x') == {"text": ["foo", "odd:x"], "kind": ["function"], "name": ["a b"], "centrality": [">=0.5"]}


def test_nearest_against_brute_force(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, [0.0] * 8), (91, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query"], r["rank"]): r.neighbour for r in vectors.nearest(df.where("vec_id % 20 = 0"), df, 3, query_block=2, base_block=7).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-s)[:3])
    assert vectors.nearest(df.limit(0), df, 3).count() == 0


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(400)] + [(None, 9)], "k string, i int")
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, joins.salted_join(left, right, "k", "n", hot_rows=50, salts=4).select("k", "i", "n").collect())) == want
    assert joins.salted_join(left.limit(0), right.limit(0), "k", "n").count() == 0


def test_adhoc_sql(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = adhoc.run(spark, "WITH k AS (SELECT a, b FROM symbols) SELECT a, b FROM k ORDER BY a;", {"symbols": df}).collect()
    assert [r.row for r in rows] == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    for bad in ("DROP TABLE symbols", "SELECT * FROM secret", "SELECT 1; SELECT 2", 'SELECT "a" FROM symbols', "SELECT * FROM symbols, other", "SELECT * FROM default.symbols", "SELECT * FROM symbols -- x", "WITH x AS (DELETE FROM symbols) SELECT 1", "SELECT reflect('a') FROM symbols", "SELECT * FROM symbols WHERE a IN (SELECT a FROM hidden)", "INSERT INTO symbols VALUES (1, 'x')", "CREATE TABLE t AS SELECT 1", "SET a = 1", "SELECT * FROM parquet.files", "SELECT (SELECT max(a) FROM hidden)", "WITH k AS (SELECT * FROM hidden) SELECT 1", "SELECT * FROM symbols s JOIN LATERAL (SELECT * FROM hidden) h", "SELECT java_method('a', 'b')", "SELECT '", "nonsense", "", "SELECT 1 UNION SELECT a FROM hidden", "TRUNCATE TABLE symbols", "SELECT * FROM read_files('x')"):
        with pytest.raises(adhoc.QueryRefused):
            adhoc.validate(spark, bad)
    for good in ("SELECT 'it''s; -- fine' AS x", "SELECT s.a, count(*) OVER (PARTITION BY b) FROM symbols s LEFT JOIN files f ON s.a = f.a WHERE s.a > (SELECT min(a) FROM edges) GROUP BY ALL HAVING count(*) > 1 ORDER BY 1 LIMIT 3", "EXPLAIN SELECT * FROM symbols", "SELECT * FROM VALUES (1), (2) AS t(x) UNION ALL SELECT a FROM symbols", "SELECT x FROM symbols LATERAL VIEW explode(array(1, 2)) t AS x"):
        assert adhoc.validate(spark, good + ";") == good


def test_lcov(spark):
    text = ["SF:src/a.py", "DA:1,0", "DA:1,3", "DA:2,0", "end_of_record", "SF:other/b.py", "DA:1,1", "end_of_record"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "report string, n int, text string")
    assert sorted(map(tuple, reports.lcov(lines, "src/").collect())) == [("src/a.py", 1, 3), ("src/a.py", 2, 0)]
    with pytest.raises(Exception, match="DA before SF"):
        reports.lcov(spark.createDataFrame([("r", 0, "DA:1,1")], "report string, n int, text string")).collect()


def test_coverage_takes_most_hits(spark):
    lines = spark.createDataFrame([("f", 2, 0), ("f", 2, 5), ("f", 3, 0), ("f", 9, 1)], "file_id string, line int, hits long")
    symbols = spark.createDataFrame([("s", "f", 1, 4), ("t", "g", 1, 4)], "symbol_id string, file_id string, start_line int, end_line int")
    assert [tuple(r) for r in insights.line_coverage(lines, symbols).collect()] == [("s", 2, 1, 0.5)]


def test_coverage_against_counting_line_by_line(spark):
    rnd = random.Random(3)
    lines = [(rnd.choice(["f", "g", None]), rnd.choice([None, *range(-70, 200)]), rnd.choice([None, 0, 0, 1, 7])) for _ in range(500)]
    lines += [("h", n, h) for n, h in ((63, 1), (64, 0), (127, None), (128, 2), (2**31 - 1, 1), (-(2**31), 0))]
    ends = [None, -(2**31), -65, -64, -1, 0, 1, 62, 63, 64, 65, 127, 128, 191, 2**31 - 1]
    symbols = [(f"{f}{a}{b}", f, a, b) for f in ("f", "g", "h", "none", None) for a in ends for b in ends] + [("twice", "f", 1, 70), ("twice", "g", 60, 64), ("twice", "g", 60, 64)]
    most = {}
    for f, n, h in lines:
        if f is not None and n is not None:
            most[f, n] = max((x for x in (most.get((f, n)), h) if x is not None), default=None)
    want = {}
    for s, f, a, b in symbols:
        inside = [h for (g, n), h in most.items() if g == f and a is not None and b is not None and a <= n <= b]
        want[s] = want.get(s, []) + inside
    want = {s: (len(x), sum(h > 0 for h in known) if (known := [h for h in x if h is not None]) else None) for s, x in want.items() if x}
    out = insights.line_coverage(spark.createDataFrame(lines, "file_id string, line int, hits long"), spark.createDataFrame(symbols, "symbol_id string, file_id string, start_line int, end_line int"))
    assert [t for _, t in out.dtypes] == ["string", "bigint", "bigint", "double"]
    assert {r.symbol_id: (r.found, r.hit) for r in out.collect()} == want and None in {hit for _, hit in want.values()}
    assert all((r.fraction is None) if r.hit is None else abs(r.fraction - r.hit / r.found) < 1e-12 for r in out.collect())


def test_coverage_does_not_broadcast_lines_of_few_files(spark):
    """The list of files is small enough to be broadcast, its lines need not be; the plan is that which ran."""
    symbols = spark.range(0, 600, numPartitions=3).selectExpr("concat('s', id) AS symbol_id", "concat('f', id % 300) AS file_id", "10 AS start_line", "19 AS end_line")
    lines = symbols.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("line")).withColumn("hits", F.col("line") % 2)
    out = insights.line_coverage(lines, symbols)
    rows = out.collect()
    assert len(rows) == 600 and {tuple(r)[1:] for r in rows} == {(10, 5, 0.5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in final and "BroadcastExchange" not in final


def test_cochange_skips_pairs_of_large_commits_only(spark):
    rows = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "b"), ("c3", "a"), ("c3", "b"), ("c3", "c"), (None, "a")]
    got = insights.cochanges(spark.createDataFrame(rows, "c string, x string"), "c", "x", 2).collect()
    assert [(r.a, r.b, r.shared, r.commits_a, r.commits_b) for r in got] == [("a", "b", 2, 3, 3)]


def test_digest_ignores_order_and_repeats(spark):
    rows = [("g", i % 5, f"v{i % 5}") for i in range(15)]
    a = insights.logical_digest(spark.createDataFrame(rows, "g string, i int, v string"), ["i", "v"], ["g"]).first()
    b = insights.logical_digest(spark.createDataFrame(rows[::-1][:7] + rows[:5], "g string, i int, v string").repartition(3), ["i", "v"], ["g"]).first()
    assert a == b and a["rows"] == 5


def test_reviews(spark):
    diff = ["--- a/x.py", "+++ b/x.py", "@@ -1,2 +10,3 @@ def f", "@@ -9 +30 @@"]
    h = review.hunks(spark.createDataFrame([("r", i, t) for i, t in enumerate(diff)], "review string, n int, text string"))
    symbols = spark.createDataFrame([("s", "x.py", 5, 11), ("t", "x.py", 30, 31), ("u", "x.py", 13, 29)], "symbol_id string, path string, start_line int, end_line int")
    assert sorted(tuple(r) for r in review.touched(h, symbols).collect()) == [("r", "s", 2), ("r", "t", 1)]
    found = review.audit_imports(spark.createDataFrame([("src/a.ts", s) for s in ("./b", "./b.js", "../lib/u", "./d", "react", "./nope", "./e")], "importer string, specifier string"), spark.createDataFrame([("src/b.ts",), ("lib/u.js",), ("src/d/index.ts",), ("src/e/x.txt",)], "path string"))
    assert {r.specifier: (r.outcome, r.resolved) for r in found.collect()} == {"./b": ("file", "src/b.ts"), "./b.js": ("file", "src/b.ts"), "../lib/u": ("file", "lib/u.js"), "./d": ("directory", "src/d/index.ts"), "react": ("bare", None), "./nope": ("unresolvable", None), "./e": ("directory", None)}
    deps = review.audit_dependencies(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("b",), ("c",)], "name string"))
    assert {r.name: r.status for r in deps.collect()} == {"a": "unused", "c": "undeclared"}
    pairs = spark.createDataFrame([("x.py", "y.py", 3, 4, 5, 0.5)], "a string, b string, shared long, commits_a long, commits_b long, jaccard double")
    assert [r.partner for r in review.cochange_warnings(spark.createDataFrame([("r", "x.py")], "review string, path string"), pairs).collect()] == ["y.py"]


def test_publish_and_export(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1,)], "a int")
    for g in (1, 2):
        sinks.write_generation(df.withColumn("a", F.lit(g)), root, "files", g)
    assert sinks.current(spark, root) is None
    sinks.publish(spark, root, 1, 5)
    assert sinks.read_current(spark, root, "files").first()["a"] == 1
    with pytest.raises(ValueError):
        sinks.publish(spark, root, 2, 5)
    sinks.publish(spark, root, 2, 6)
    assert sinks.read_current(spark, root, "files").first()["a"] == 2
    nodes = spark.createDataFrame([("a", 'q"', "p", 1, "function"), ("b", "r", "p", 2, "class")], "symbol_id string, qualified_name string, path string, start_line int, symbol_kind string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "z", "calls")], "source string, target string, kind string")
    n, e = sinks.graph_export(nodes, edges, 10)
    assert [r.line for r in sinks.as_dot(n, e).collect()][-2:] == ['  "a" -> "b" [label="calls"];', "}"] and e.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", u, "view", 1.0) for m in range(0, 60, 7) for u in (1, 2)] + [("2024-01-01 05:00:00", 1, "view", 1.0)]
    df = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling_usage(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), size="10 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage_windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("usage_windows").collect())) == sorted(map(tuple, windows.tumbling_usage(df, size="10 minutes").collect()))


def test_landing_builds_generations(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "store")
    q = windows.on_landing(spark, str(tmp_path / "in"), df.schema, lambda rows, batch: sinks.write_generation(rows, out, "files", batch), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{out}/files/generation_id=0").count() == 2


def test_python_symbols_and_search(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self, x):\n        return x\n\ndef g():\n    pass\n"), ("bad.py", "def ("), ("n.py", None)], "path string, text string")
    got = sorted(tuple(r)[1:] for r in reports.python_symbols(files).collect())
    assert got == [("class", "A", "A", 1, 3, 0), ("function", "g", "g", 5, 6, 0), ("method", "f", "A::f", 2, 3, 2)]
    symbols = spark.createDataFrame([("f", "s1", 1, 9), ("f", "s2", 2, 3)], "file_id string, symbol_id string, start_line int, end_line int")
    hits = reports.content_search(spark.createDataFrame([("f", "a\r\nreturn 1\rb")], "file_id string, text string"), symbols, "return")
    assert [tuple(r) for r in hits.collect()] == [("f", 2, "return 1", "s2")]
