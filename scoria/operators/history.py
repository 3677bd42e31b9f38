"""Histories: git logs, peers of commits and issues, queues of work, stored summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.operators.insights import cochanges


def parse_git_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commit, author, at) and (commit, path, old_path, insertions, deletions) from the lines (log, n, text) of logs.

    A log is what `git log --find-renames --numstat --format=%H%x09%ct%x09%ae` prints. Binary files count 0 lines; of
    renames, `a/{b => c}/d` or `a => b`, path is the new name and old_path the other. Lines before any commit are left
    out. Logs may be many; each is ordered on its own.
    """
    head = r"^([0-9a-f]{7,64})\t(\d+)\t(.*)$"
    is_head = F.col("text").rlike(head)
    w = Window.partitionBy("log").orderBy("n")
    at = lines.withColumn("commit", F.last(F.when(is_head, F.regexp_extract("text", head, 1)), ignorenulls=True).over(w))
    commits = at.where(is_head).select("commit", F.regexp_extract("text", head, 3).alias("author"), F.timestamp_seconds(F.regexp_extract("text", head, 2).cast("long")).alias("at")).distinct()
    change = r"^(\d+|-)\t(\d+|-)\t(.*)$"
    rows = at.where(F.col("text").rlike(change) & ~is_head & F.col("commit").isNotNull())
    number = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(text, '{change}', {i}) AS bigint)".replace("\\", "\\\\")), F.lit(0))
    name = F.regexp_extract("text", change, 3)
    whole = lambda part: F.regexp_replace(F.when(name.rlike(r"\{.* => .*\}"), F.regexp_replace(name, r"\{(.*) => (.*)\}", part)).when(name.contains(" => "), F.regexp_replace(name, r"^(.*) => (.*)$", part)).otherwise(name), "//", "/")
    out = rows.select("commit", whole("$2").alias("path"), whole("$1").alias("old_path"), number(1).alias("insertions"), number(2).alias("deletions"))
    return commits, out.withColumn("old_path", F.when(F.col("old_path") != F.col("path"), F.col("old_path")))


def peers(changes: DataFrame, commit: str, item: str, max_items: int, most: int) -> DataFrame:
    """(item, peer, shared, jaccard, place): per item the peers that change with it most often.

    Commits of more than max_items items make no pairs, which bounds what one commit gives.
    """
    pairs = cochanges(changes, commit, item, max_items)
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("peer"), "shared", "jaccard").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("peer"), "shared", "jaccard"))
    w = Window.partitionBy("item").orderBy(F.col("shared").desc(), F.round("jaccard", 9).desc(), "peer")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def commit_peers(changes: DataFrame, commit: str, item: str, asked: list, most: int) -> DataFrame:
    """(ordinal, commit, item, commits, place): for the commits asked for, in that order, the items that changed most often overall."""
    once = changes.select(F.col(commit).alias("commit"), F.col(item).alias("item")).where("commit IS NOT NULL AND item IS NOT NULL").distinct()
    kind = changes.schema[commit].dataType.simpleString()
    want = changes.sparkSession.createDataFrame([(asked,)], f"c array<{kind}>").select(F.posexplode("c").alias("ordinal", "commit")).withColumn("ordinal", F.col("ordinal") + 1)
    mine = once.join(F.broadcast(want), "commit")
    total = once.join(mine.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("commits"))
    w = Window.partitionBy("ordinal").orderBy(F.col("commits").desc(), "item")
    return mine.join(total, "item").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("ordinal", "commit", "item", "commits", "place")


def pending_summaries(subjects: DataFrame, stored: DataFrame, key: list[str], digest: str, order: list[Column], most: int) -> DataFrame:
    """(key, digest, why, place): subjects without a stored summary of their present digest, `missing` or `stale`, the first `most` per project."""
    old = stored.select(*key, F.col(digest).alias("__was")).distinct()
    known = old.groupBy(*key).agg(F.lit(True).alias("__has"))
    open_ = subjects.join(old.withColumnRenamed("__was", digest).distinct(), [*key, digest], "left_anti").join(known, key, "left")
    w = Window.partitionBy("project_id").orderBy(*order)
    return open_.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*key, digest, F.when(F.col("__has"), "stale").otherwise("missing").alias("why"), "place")


def enqueue(queue: DataFrame, hits: DataFrame, cap: int) -> DataFrame:
    """(symbol_id, priority): the queue after one more hit of each symbol hit, priorities going up to `cap`."""
    both = queue.groupBy("symbol_id").agg(F.max("priority").alias("priority")).join(hits.select("symbol_id", F.lit(1).alias("hit")).distinct(), "symbol_id", "full_outer")
    return both.select("symbol_id", F.least(F.coalesce("priority", F.lit(0)) + F.coalesce("hit", F.lit(0)), F.lit(cap)).alias("priority"))


def test_titles(texts: DataFrame) -> DataFrame:
    """(path, line, title): the titles under which test files (path, text) name their cases, told without running them."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line_text"))
    title = F.coalesce(*[F.nullif(F.regexp_extract("line_text", p, 1), F.lit("")) for p in (r"^\s*(?:it|test|describe)(?:\.\w+)?\(\s*['\"`]([^'\"`]+)['\"`]", r"^\s*(?:async\s+)?def (test\w*)\(", r"^\s*func (Test\w+)\(", r"^\s*(?:async )?fn (\w*test\w*)\(", r"^\s*(?:public )?void (test\w*|\w+Test)\(")])
    return lines.select("path", (F.col("at") + 1).alias("line"), title.alias("title")).where("title IS NOT NULL")


def stack_frames(traces: DataFrame) -> DataFrame:
    """(trace, place, path, line) of the frames in the texts (trace, text) of stack traces, innermost as printed."""
    found = F.expr(r"regexp_extract_all(text, '([\\w./@-]+\\.[A-Za-z]+)(?::|\", line )(\\d+)', 0)")
    rows = traces.select("trace", F.posexplode(found).alias("at", "frame"))
    return rows.select("trace", (F.col("at") + 1).alias("place"), F.regexp_extract("frame", r"^([\w./@-]+\.[A-Za-z]+)", 1).alias("path"), F.regexp_extract("frame", r"(\d+)$", 1).cast("int").alias("line"))


def readiness(documents: DataFrame, vectors: DataFrame, key: str, dimension: int, column: str = "embedding") -> DataFrame:
    """(documents, embedded, missing, wrong_dimension, ready): whether every document has a vector of the dimension."""
    have = vectors.groupBy(key).agg(F.max((F.size(column) == dimension).cast("int")).alias("fits"))
    both = documents.select(key).where(F.col(key).isNotNull()).distinct().join(have, key, "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.agg(F.count(F.lit(1)).alias("documents"), n(F.col("fits").isNotNull()).alias("embedded"), n(F.col("fits").isNull()).alias("missing"), n(F.col("fits") == 0).alias("wrong_dimension"))
    return out.withColumn("ready", (F.col("documents") > 0) & (F.col("missing") == 0) & (F.col("wrong_dimension") == 0))
