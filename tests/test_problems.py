import random
from datetime import datetime

from scoria.operators import hierarchy, skew, snapshots
from scoria.operators.prefix import group_prefix_sum
from pyspark.sql import functions as F

T = [datetime(2024, 1, i + 1) for i in range(9)]
SYMBOLS = "project_id string, generation_id long, symbol_id string, structural_digest string, delivered_at timestamp_ntz, g string, v string"
VERSIONS = "project_id string, generation_id long, published_at timestamp_ntz"


def changes(spark, rows, versions):
    out = snapshots.snapshot_changes(spark.createDataFrame([(*r, "x", "y") for r in rows], SYMBOLS), spark.createDataFrame(versions, VERSIONS), content=snapshots.hex_number(F.col("structural_digest")))
    return sorted(tuple(r) for r in out.collect())


def test_snapshot_changes(spark):
    versions = [("p", 9, T[0]), ("p", 2, T[1]), ("p", 5, T[2]), ("q", 1, T[0])]
    rows = [
        ("p", 9, "same", "0x00AB", T[0]), ("p", 2, "same", "blake3:ab", T[1]),
        ("p", 9, "null", None, T[0]), ("p", 2, "null", None, T[1]),
        ("p", 9, "to_null", "1", T[0]), ("p", 2, "to_null", None, T[1]),
        ("p", 9, "fixed", "1", T[0]), ("p", 2, "fixed", "2", T[1]), ("p", 2, "fixed", "1", T[3]), ("p", 2, "fixed", "1", T[3]),
        ("p", 9, "gone", "1", T[0]), ("p", 2, "new", "1", T[1]), ("p", 3, "failed", "1", T[1]),
        ("q", 1, "first", "1", T[0]), ("p", 2, None, "1", T[1]), (None, 2, "x", "1", T[1]), ("p", None, "x", "1", T[1]),
    ]
    got = changes(spark, rows, versions)
    second = [("p", 2, "gone", "removed"), ("p", 2, "new", "added"), ("p", 2, "to_null", "changed")]
    emptied = [("p", 5, s, "removed") for s in ("fixed", "new", "null", "same", "to_null")]
    assert got == sorted(second + emptied)


def test_snapshot_changes_of_nothing(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [("p", 1, "a", "1", T[0])], []) == []


def test_hex_number(spark):
    df = spark.createDataFrame([("BLAKE3:00Ff",), (" 0xff ",), ("000",), ("f-f",), (None,)], "d string")
    assert [r[0] for r in df.select(snapshots.hex_number(F.col("d"))).collect()] == ["ff", "ff", "0", "ff", None]


def brute_hierarchy(links):
    par, nodes = {}, set()
    for g, p, c in links:
        if g is None:
            continue
        nodes |= {(g, x) for x in (p, c) if x is not None}
        if p is not None and c is not None:
            par[g, c] = (g, p)
    out = {}
    for n in nodes:
        seen, path, at = set(), [n], n
        while at in par and at not in seen:
            seen.add(at)
            at = par[at]
            path.append(at)
        if at not in par:
            out[n] = (path[-1][1], len(path) - 1, [x[1] for x in path[::-1]])
        else:
            walk, on = par[n], False
            for _ in range(len(nodes)):
                on |= walk == n
                walk = par[walk]
            out[n] = ("", -1 if on else -2, None)
    return out


def check_tree(spark, links):
    df = spark.createDataFrame(links, "project_id string, parent string, child string")
    h = hierarchy.heavy_paths(df)
    want = brute_hierarchy(links)
    got = {(r.g, r.node): (r.root, r.depth, r.path) for r in hierarchy.paths(h).collect()}
    assert got == want
    assert {(r.g, r.node): (r.root, r.depth) for r in hierarchy.roots_and_depths(h).collect()} == {k: v[:2] for k, v in want.items()}
    return h, want


def test_hierarchy_cases(spark):
    links = [("p", "a", "b"), ("p", "a", "b"), ("p", "b", "c"), ("p", None, "r"), ("p", "lone", None), ("p", "", "e"), ("p", "A", "s"), ("p", "x", "x"), ("p", "x", "y"), ("p", "y", "z"), ("p", "u", "v"), ("p", "v", "u"), ("q", "b", "a"), (None, "a", "b"), ("p", None, None)]
    check_tree(spark, links)


def test_hierarchy_random_with_intervals(spark):
    rnd = random.Random(3)
    links = [("p", f"n{rnd.randrange(max(0, i - 4), i)}", f"n{i}") for i in range(1, 60)] + [("p", "hub", f"h{i}") for i in range(30)] + [("q", f"d{i}", f"d{i + 1}") for i in range(25)]
    h, want = check_tree(spark, links)
    place = {(r.g, r.node): (r.root, r.first, r["last"]) for r in hierarchy.intervals(h).collect()}
    below = {k: {m for m, v in want.items() if m[0] == k[0] and k[1] in v[2]} for k in want}
    for k, (root, first, last) in place.items():
        assert {m for m, (r, f, _) in place.items() if m[0] == k[0] and r == root and first <= f <= last} == below[k]
    pairs = {((r.g, r.node), (r.g, r.descendant)) for r in hierarchy.descendants(h).collect()}
    assert pairs == {(k, m) for k, ms in below.items() for m in ms if m != k}


def test_hierarchy_of_nothing(spark):
    check_tree(spark, [])


def test_edges_per_pair(spark):
    schema = "source_symbol_id string, target_symbol_id string, edge_kind string, site_count long, confidence float, s string, t string, k string"
    rows = [("a", "T", "Calls", 1, 0.5), (" A", "t ", "calls", 3, None), ("b", "t", "calls", None, 0.75), (None, "t", "calls", 1, None), ("a", None, "calls", 9, 1.0), ("a", "u", None, None, None)]
    df = spark.createDataFrame([(*r, "1", "2", "3") for r in rows], schema)
    got = {(r.target_symbol_id, r.edge_kind): (r.edges, r.sites, r.max_confidence) for r in skew.edge_aggregates(df).collect()}
    assert got == {("t", "calls"): (3, 4, 0.75), ("u", None): (1, None, None)}
    assert {r.target_symbol_id for r in skew.heavy_pairs(df, 0.75).collect()} == {"t"}
    assert skew.heavy_pairs(df.limit(0)).count() == 0


def test_heavy_pairs_at_the_threshold(spark):
    rows = [(f"s{i}", "hot" if i < 2 else f"t{i}", "calls", 1, 1.0, "", "", "") for i in range(200)]
    df = spark.createDataFrame(rows, "source_symbol_id string, target_symbol_id string, edge_kind string, site_count long, confidence float, s string, t string, k string")
    assert [r.target_symbol_id for r in skew.heavy_pairs(df).collect()] == ["hot"]


def test_prefix_sums_in_blocks(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, x long")
    got = group_prefix_sum(df, ["g"], [F.col("i") % 3], [F.col("i")], F.col("x"), "before", rows_per_block=20).collect()
    assert len(got) == 300
    for g in ("a", "b", None):
        mine = sorted((r.before, r.x or 0) for r in got if r.g == g)
        total = sum(x for _, x in mine)
        assert {b + x for b, x in mine} | {0} == {b for b, _ in mine} | {total}
