"""Sinks: generation-partitioned tables with a pointer to the published one, graph exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_generation(df: DataFrame, root: str, relation: str, generation: int) -> None:
    """Write one relation of a generation; readers see it only after publish()."""
    df.write.mode("overwrite").parquet(f"{root}/{relation}/generation_id={generation}")


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict | None:
    """The published pointer {generation, sequence}, or None: the pointer file of the greatest sequence."""
    path, fs = _file_system(spark, root)
    found = [str(x.getPath().toString()) for x in (fs.listStatus(path) if fs.exists(path) else []) if str(x.getPath().getName()).startswith("pointer-")]
    return json.loads(spark.read.text(max(found)).first()[0]) if found else None


def publish(spark: SparkSession, root: str, generation: int, sequence: int) -> None:
    """Point readers to a generation; a sequence that isn't newer than the published one is refused.

    Each sequence has a pointer file of its own, written aside and renamed into place: a reader sees the old pointer or
    the new one, never none, and of two writers with one sequence the second fails.
    """
    now = current(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer-{sequence:020d}.json")
    draft, fs = _file_system(spark, f"{root}/.draft-{uuid.uuid4().hex}")
    if now and sequence <= now["sequence"]:
        raise ValueError(f"sequence {sequence} is stale: {now['sequence']} is published")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"generation": generation, "sequence": sequence}).encode()))
    out.close()
    if fs.exists(path) or not fs.rename(draft, path):
        fs.delete(draft, False)
        raise ValueError(f"sequence {sequence} is stale: another writer has published it")


def read_current(spark: SparkSession, root: str, relation: str) -> DataFrame:
    at = current(spark, root)
    if at is None:
        raise ValueError("nothing is published")
    return spark.read.parquet(f"{root}/{relation}/generation_id={at['generation']}")


def unparsed(files: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """The files whose contents the parse cache doesn't hold, each content once."""
    return files.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def graph_export(symbols: DataFrame, edges: DataFrame, limit: int, kinds: list[str] | None = None, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """At most `limit` symbols by path, line and name, and the edges both of whose ends are exported."""
    s = symbols if kinds is None else symbols.where(F.col("symbol_kind").isin(kinds))
    s = s if prefix is None else s.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))
    nodes = s.orderBy("path", "start_line", "symbol_kind", "qualified_name", "symbol_id").limit(limit)
    ids = nodes.select("symbol_id")
    kept = edges.join(ids.withColumnRenamed("symbol_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("symbol_id", "target"), "target", "left_semi")
    return nodes, kept


def as_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a DOT graph, in order of column n; names are quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    a = nodes.select(F.lit(1).alias("n"), F.concat(F.lit("  "), quoted(F.col("symbol_id")), F.lit(" [label="), quoted(F.col("qualified_name")), F.lit("];")).alias("line"))
    b = edges.select(F.lit(2).alias("n"), F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(" [label="), quoted(F.col("kind")), F.lit("];")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph g {"), (3, "}")], "n int, line string")
    return ends.unionByName(a).unionByName(b).orderBy("n", "line")


