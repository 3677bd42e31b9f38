import pytest

from scoria.operators import centrality, graph

#: a..f in two files and a test file, with a cycle and a contains edge that must be ignored.
EDGES = [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("d", "a", "calls"), ("e", "a", "tests"), ("f", "c", "calls"), ("a", "c", "references"), ("a", "f", "contains")]


@pytest.fixture(scope="module")
def arcs(spark):
    return spark.createDataFrame([(s, t, k, 1, 1.0) for s, t, k in EDGES], "source string, target string, kind string, sites long, confidence float").cache()


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_impact_and_callers(spark, arcs):
    used = arcs.where("kind <> 'contains'")
    got = {(r.node, r.depth) for r in graph.reach(seeds(spark, "a"), used, 1, "in").collect()}
    assert got == {("a", 0), ("d", 1), ("e", 1)}
    assert {(r.node, r.depth) for r in graph.reach(seeds(spark, "a"), used, 9, "out").collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert graph.reach(seeds(spark).limit(0), used, 3).count() == 0


def test_budget_is_shared_by_roots(spark, arcs):
    got = graph.reach(seeds(spark, "a", "f"), arcs.where("kind <> 'contains'"), 5, "out", max_nodes=4).collect()
    assert sorted(r.root for r in got) == ["a", "a", "f", "f"]


def test_shortest_path(spark, arcs):
    assert graph.shortest_path(arcs, "a", "d") == ["a", "c", "d"]
    assert graph.shortest_path(arcs, "a", "d", kind="calls") == ["a", "b", "c", "d"]
    assert graph.shortest_path(arcs, "d", "e") == [] and graph.shortest_path(arcs, "a", "a") == ["a"]


def test_affected_tests_are_one_per_file(spark, arcs):
    symbols = spark.createDataFrame([("a", "f1", "function"), ("e", "t1", "test"), ("f", "t1", "function"), ("c", "f2", "function")], "symbol_id string, file_id string, symbol_kind string")
    files = spark.createDataFrame([("f1", "src/a"), ("f2", "src/c"), ("t1", "tests/t")], "file_id string, path string")
    reached = graph.reach(seeds(spark, "c"), arcs.where("kind <> 'contains'"), 3, "in")
    assert [(r.path, r.depth, r.symbol_id) for r in graph.affected_tests(reached, symbols, files, "(^|/)tests/").collect()] == [("tests/t", 1, "f")]


def test_fence_ignores_other_generations(spark):
    g = spark.createDataFrame([("p", 1, "superseded"), ("p", 2, "current"), ("p", 3, "staging")], "project_id string, generation_id long, state string")
    assert [r.generation_id for r in graph.current_generations(g).collect()] == [2]
    assert [r.generation_id for r in graph.current_generations(g, {"p": 1}).collect()] == [1]
    with pytest.raises(ValueError):
        graph.current_generations(g, {"p": 3})


def brute_betweenness(nodes, edges):
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, order, queue = {s: 0}, {s: 1.0}, [], [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for a, w in edges:
                if a == v:
                    if w not in dist:
                        dist[w], count[w] = dist[v] + 1, 0.0
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        count[w] += count[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for a, b in edges:
                if b == w and a in dist and dist[w] == dist[a] + 1:
                    dep[a] += count[a] / count[w] * (1 + dep[w])
            if w != s:
                out[w] += dep[w]
    n = len(nodes)
    return {v: round(x / ((n - 1) * (n - 2)), 9) for v, x in out.items()}


def test_betweenness_against_brute_force(spark, arcs):
    edges = arcs.where("kind <> 'contains'")
    nodes = seeds(spark, *"abcdef")
    got = {r.node: r.betweenness for r in centrality.betweenness(nodes, edges, nodes).collect()}
    assert got == pytest.approx(brute_betweenness("abcdef", sorted({(s, t) for s, t, k in EDGES if k != "contains"})))


def test_pagerank_sums_to_one(spark, arcs):
    got = centrality.pagerank(seeds(spark, *"abcdefz"), arcs).collect()
    assert sum(r.pagerank for r in got) == pytest.approx(1, abs=1e-6) and len(got) == 7
    assert centrality.pagerank(seeds(spark).limit(0), arcs).count() == 0


def test_components(spark):
    links = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "x"), (None, "x"), ("z", "z")]
    got = {r.node: r.component for r in centrality.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"c{i:02}": "c00" for i in range(21)} | {"x": "x", "y": "x", "z": "z"}


def test_sample_of_sources(spark):
    assert centrality.sample_positions(5, 9) == [0, 1, 2, 3, 4] and centrality.sample_positions(0, 3) == []
    drawn = centrality.sample_positions(1000, 200)
    assert len(set(drawn)) == 200 and set(drawn) <= set(range(1000)) and drawn == centrality.sample_positions(1000, 200) != centrality.sample_positions(1000, 200, 1)
    # The whole shuffle is a permutation that begins alike.
    assert sorted(centrality.sample_positions(1000, 999)) == sorted(set(centrality.sample_positions(1000, 999))) and centrality.sample_positions(1000, 999)[:200] == drawn
    nodes = spark.createDataFrame([(f"n{i:04d}",) for i in range(1000)] + [("n0000",), (None,)], "node string").repartition(7)
    assert {r.node for r in centrality.sample_sources(nodes).collect()} == {f"n{i:04d}" for i in drawn}
    assert centrality.sample_sources(nodes.where("node < 'n0005'")).count() == 5 and centrality.sample_sources(nodes.limit(0)).count() == 0
