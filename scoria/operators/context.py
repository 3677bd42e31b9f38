"""Hybrid retrieval: channels fused into a packet of evidence for a task."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoria.operators import search

#: How many files a packet proposes for editing and names a file shows, and how many roots are walked from.
EDIT_FILES, FILE_NAMES, ROOTS = 16, 5, 32
#: Words of a task that tell nothing about code.
COMMON = frozenset("a an and are as at be by do does for from how in is it of on or that the this to what when where which why with".split())


def task_terms(task: str) -> list[str]:
    """The distinct words of a task that may name code, in order: three letters or more, split like names in code."""
    humps = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", task))
    return list(dict.fromkeys(w for w in re.findall(r"[a-z0-9]+", humps.lower()) if len(w) > 2 and w not in COMMON))


def anchors(task: str) -> list[str]:
    """What a task names literally: text in backticks, paths, names with separators, camel case or underscores."""
    quoted = re.findall(r"`([^`]+)`", task)
    bare = re.findall(r"[\w./:-]*(?:::|/|_)[\w./:-]*\w|\b[a-z]+(?:[A-Z]\w*)+|\b[A-Z][a-z0-9]+(?:[A-Z]\w*)+", re.sub(r"`[^`]*`", " ", task))
    return list(dict.fromkeys(quoted + bare))


@dataclass
class Packet:
    """evidence: (doc, score, best_rank, tier, place); edits: (path, terms, exact, names, place); tests: (path, doc, distance); states: channel to what became of it."""

    evidence: DataFrame
    edits: DataFrame
    tests: DataFrame
    states: dict[str, str] = field(default_factory=dict)


def channel_states(counts: dict[str, int | None]) -> dict[str, str]:
    """Each channel's state from its number of hits (None where it couldn't be asked), and `packet` for all of them.

    A channel is used, empty or unavailable; the packet is ok, no_relevant_evidence if channels answered without hits, or
    no_usable_channel if none could be asked.
    """
    states = {name: "unavailable" if n is None else "used" if n else "empty" for name, n in counts.items()}
    packet = "ok" if "used" in states.values() else "no_relevant_evidence" if "empty" in states.values() else "no_usable_channel"
    return states | {"packet": packet}


def edit_candidates(docs: DataFrame, terms: list[str], exact: list[str]) -> DataFrame:
    """(path, terms, exact, names, place): the files to edit, at most EDIT_FILES.

    Files that hold an exactly named symbol win. Otherwise a document counts the distinct terms in its qualified name
    and path, a file has the count of its best document, and only files tied for the strongest stay.
    """
    one = docs.where(F.col("path").isNotNull() & (F.col("document_kind") != "test")).select("path", F.coalesce("qualified_name", F.lit("")).alias("name")).distinct()
    words = F.array_distinct(F.concat(search.code_tokens(F.col("name")), search.code_tokens(F.col("path"))))
    hits = one.select("path", "name", F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))).alias("n") if terms else F.lit(0).alias("n"), F.col("name").isin(exact).alias("exact") | F.col("path").isin(exact))
    hits = hits.toDF("path", "name", "n", "exact")
    files = hits.groupBy("path").agg(F.max("n").alias("terms"), F.max("exact").alias("exact"))
    best = files.agg(F.max("exact").alias("any"), F.max("terms").alias("most"))
    some = files.where(F.when(best.select("any").scalar(), F.col("exact")).otherwise((F.col("terms") == best.select("most").scalar()) & (F.col("terms") > 0)))
    # A packet is a report of a fixed size.
    top = some.orderBy("path").limit(EDIT_FILES).withColumn("place", F.row_number().over(Window.orderBy("path")))
    strong = hits.join(F.broadcast(top.select("path", "terms", F.col("exact").alias("file_exact"), "place")), "path").where(F.when(F.col("file_exact"), F.col("exact")).otherwise(F.col("n") == F.col("terms")) & (F.col("name") != ""))
    named = strong.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("name"))).where(F.col("at") <= FILE_NAMES).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return top.join(named, "path", "left").select("path", "terms", "exact", F.coalesce("names", F.lit("")).alias("names"), "place")


def direct_tests(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, doc, distance): the test documents among the evidence, one per file, the best placed; their distance is 0."""
    tests = docs.where(F.col("document_kind") == "test").groupBy(F.col("document_id").alias("doc")).agg(F.max("path").alias("path"))
    return evidence.join(tests, "doc").groupBy("path").agg(F.min(F.struct("place", "doc")).alias("x")).select("path", "x.doc", F.lit(0).alias("distance"))


def context_packet(task: str, docs: DataFrame, per_channel: int = 20, semantic: DataFrame | None = None) -> Packet:
    """The evidence for a task: exact anchors, words of all fields, names and text, and a semantic ranking (doc, rank) if there is one.

    Each channel gives its best documents; reciprocal ranks are fused, preferred kinds first unless the task is about
    tests or documentation. A channel without a way to answer or without hits is named in the states.
    """
    wanted, terms = search.intent(task), task_terms(task)
    exact = anchors(task)
    named = docs.where(F.col("document_id").isNotNull())
    index, n = search.postings(named), named.select("document_id").distinct().count()
    channels: dict[str, DataFrame] = {}
    if exact:
        simple = F.element_at(F.split(F.regexp_replace("qualified_name", "::", "."), r"\."), -1)
        hit = named.where(F.col("qualified_name").isin(exact) | F.col("path").isin(exact) | simple.isin(exact)).select(F.col("document_id").alias("doc"), F.lit(1.0).alias("score")).distinct()
        channels["exact"] = search.ranked(hit, per_channel).select("doc", "rank")
    if terms:
        for name, some in (("all", index), ("names", index.where("field = 'qualified_name'")), ("text", index.where("field = 'natural_text'"))):
            channels[name] = search.ranked(search.bm25(some, terms, n).withColumn("score", F.round("score", 6)), per_channel).select("doc", "rank")
    if semantic is not None:
        channels["semantic"] = semantic.select("doc", "rank").where(F.col("rank") <= per_channel)
    counts = {name: channels[name].count() if name in channels else None for name in ("exact", "all", "names", "text", "semantic")}
    rows = None
    for name, c in channels.items():
        c = c.select(F.lit(name).alias("channel"), "doc", "rank")
        rows = c if rows is None else rows.unionByName(c)
    if rows is None:
        rows = named.select(F.lit("none").alias("channel"), F.col("document_id").alias("doc"), F.lit(1).alias("rank")).limit(0)
    kinds = named.groupBy(F.col("document_id").alias("doc")).agg(F.max("document_kind").alias("kind"), F.max("path").alias("path"))
    neutral = wanted in ("test", "documentation")
    tier = F.lit(0) if neutral else search.preference_tier(F.col("kind"), F.col("path"), F.lit(None).cast("string"))
    evidence = search.fuse(rows, kinds.select("doc", tier.alias("tier")))
    return Packet(evidence, edit_candidates(named, terms, exact), direct_tests(evidence, named), channel_states(counts))


def expand(packet: Packet, docs: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "both", roots: int = ROOTS) -> DataFrame:
    """(root, node, depth): the symbols around the best placed evidence that has a symbol, walked from at most `roots` of them."""
    from scoria.operators.graph import reach

    at = docs.where(F.col("symbol_id").isNotNull()).groupBy(F.col("document_id").alias("doc")).agg(F.max("symbol_id").alias("node"))
    seeds = packet.evidence.join(at, "doc").orderBy("place").limit(roots).select("node").distinct()
    return reach(seeds, edges, depth, direction)


def review_packet(changed: DataFrame, symbols: DataFrame, edges: DataFrame, paths: DataFrame, test_path: str, depth: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, impact, tests) of changed files (column path): their symbols, what depends on them, and the test files among that."""
    from scoria.operators.graph import affected_tests, reach

    own = symbols.join(paths.join(changed.select("path").distinct(), "path", "left_semi"), "file_id").select("symbol_id", "path").distinct()
    impact = reach(own.select(F.col("path").alias("root"), F.col("symbol_id").alias("node")), edges, depth, "in")
    return own, impact.where("depth > 0"), affected_tests(impact, symbols, paths, test_path)
