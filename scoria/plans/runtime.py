"""Session-level helpers: table loading, states in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder which the cluster names in spark.checkpoint.dir.

    Where none is set a folder of this machine serves, but only if driver and executors are this one process; a cluster
    without the setting raises ValueError, as its machines share no temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scoria-checkpoint-"))


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which is deleted when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/scoria-{uuid.uuid4().hex}"
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    return path


def checkpointed(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows of df, written once as a table in the shared folder; cuts the lineage.

    A table, unlike a checkpoint, has the size of its files as statistics; those of repeated joins over checkpoints
    multiply from round to round until the planner can't hold them. With `instead_of`, an earlier result of this
    function, that table is deleted once the new one is written: the caller must not read it any more. The others are
    deleted when the session's JVM ends, or by release().
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scoria_path = path
    release(instead_of)
    return out


def release(*states: DataFrame | None) -> None:
    """Delete the tables of results of checkpointed() that nothing reads any more."""
    for state in states:
        path = getattr(state, "_scoria_path", None)
        if path:
            place, fs = _place(state.sparkSession, path)
            fs.delete(place, True)
            fs.cancelDeleteOnExit(place)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else df as it is (the join then shuffles).

    Only for rows of a few short columns: the limit bounds rows, and with them bytes.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, *names: str) -> str:
    """A column name that df doesn't have yet (names are tried in turn, then numbered)."""
    have = {c.lower() for c in df.columns}
    for n in names:
        if n.lower() not in have:
            return n
    i = 1
    while f"{names[0]}_{i}".lower() in have:
        i += 1
    return f"{names[0]}_{i}"
