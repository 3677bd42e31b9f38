"""Sources: LCOV reports, git logs with issue numbers, source trees, symbols of Python files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lcov(lines: DataFrame, root: str = "") -> DataFrame:
    """(path, line, hits) from the lines (report, n, text) of LCOV reports; of a line reported twice the most hits count.

    Within a report the last SF before a DA names its file; files outside `root` are left out. A DA without SF raises
    when the rows are read. Reports may be many; each is ordered on its own.
    """
    w = Window.partitionBy("report").orderBy("n")
    part = F.sum((F.col("text") == "end_of_record").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("record", F.coalesce(part, F.lit(0)))
    v = Window.partitionBy("report", "record").orderBy("n")
    named = rows.withColumn("path", F.last(F.when(F.col("text").startswith("SF:"), F.substring("text", 4, 1 << 20)), ignorenulls=True).over(v)).where(F.col("text").startswith("DA:"))
    found = named.select(F.when(F.col("path").isNull(), F.raise_error(F.lit("DA before SF"))).otherwise(F.col("path")).alias("path"), F.regexp_extract("text", r"^DA:(\d+),(-?\d+)", 1).cast("int").alias("line"), F.regexp_extract("text", r"^DA:(\d+),(-?\d+)", 2).cast("long").alias("hits"))
    return found.where(F.col("path").startswith(root)).groupBy("path", "line").agg(F.max("hits").alias("hits"))


def file_history(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, commits, authors, insertions, deletions, last_touched) from commits (commit, author, at) and changes (commit, path, insertions, deletions)."""
    return changes.join(commits, "commit").groupBy("path").agg(F.count_distinct("commit").alias("commits"), F.count_distinct(F.lower("author")).alias("authors"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.max("at").alias("last_touched"))


def issue_numbers(commits: DataFrame) -> DataFrame:
    """(commit, issue) for each issue number a message (column message) mentions."""
    return commits.select("commit", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"(?:^|[\s(])#(\d{1,9})\b"), F.lit(1)))).alias("issue")).withColumn("issue", F.col("issue").cast("long"))


def glob_regex(glob: str) -> str:
    """The regular expression of a path pattern: * and ? stay within a part, ** crosses parts, a last / means all below."""
    out, i = "", 0
    glob = glob + "**" if glob.endswith("/") else glob
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"(?:^|/){out}(?:/.*)?$" if "/" not in glob.rstrip("/*") else f"^{out}(?:/.*)?$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a path is ignored by the lines of an ignore file: the last rule that fits decides, one with ! takes back."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            back = rule.startswith("!")
            out = F.when(path.rlike(glob_regex(rule.lstrip("!").lstrip("/"))), F.lit(not back)).otherwise(out)
    return out


def source_tree(spark: SparkSession, root: str, pattern: str = "*", exclude: list[str] | None = None, allow: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """(path, bytes, modified, text) of the files below a directory whose names match.

    path is relative to root. `exclude` has the rules of an ignore file; with `allow` only paths that fit one of its
    patterns stay; files above `largest` bytes are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.withColumn("path", F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", ""))
    files = files.where(~ignored(F.col("path"), exclude)) if exclude else files
    if allow:
        hit = F.lit(False)
        for glob in allow:
            hit = hit | F.col("path").rlike(glob_regex(glob))
        files = files.where(hit)
    files = files if largest is None else files.where(F.col("length") <= largest)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, qualified_name, start_line, end_line, parameters) of the classes, functions and methods of Python texts (path, text); files that don't parse have none."""

    def walk(path: str, node: ast.AST, inside: tuple[str, ...], in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                n = 0 if kind == "class" else len(child.args.args) + len(child.args.kwonlyargs)
                yield path, kind, child.name, "::".join((*inside, child.name)), child.lineno, child.end_lineno, n
                yield from walk(path, child, (*inside, child.name), kind == "class")
            else:
                yield from walk(path, child, inside, in_class)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    rows += walk(path, ast.parse((text or "").lstrip("﻿")), (), False)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "qualified_name", "start_line", "end_line", "parameters"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, qualified_name string, start_line int, end_line int, parameters int")


def content_search(files: DataFrame, symbols: DataFrame, pattern: str) -> DataFrame:
    """(file_id, line, text, symbol_id) of the lines (file_id, text) that match, with the innermost symbol around each."""
    lines = files.select("file_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line_text")).where(F.col("line_text").rlike(pattern)).select("file_id", (F.col("at") + 1).alias("line"), F.col("line_text").alias("text"))
    spans = symbols.select(F.col("file_id").alias("f"), "symbol_id", "start_line", "end_line")
    hits = lines.join(spans, (F.col("file_id") == F.col("f")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    inner = F.min(F.when(F.col("symbol_id").isNotNull(), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "symbol_id"))).alias("x")
    return hits.groupBy("file_id", "line", "text").agg(inner).select("file_id", "line", "text", F.col("x.symbol_id").alias("symbol_id"))
