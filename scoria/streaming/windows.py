"""Windows over call logs, and generations built from files as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tumbling_usage(calls: DataFrame, at: str = "ts", group: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, group, calls, total) per window; on a stream a window closes once the watermark has passed it."""
    timed = calls.withColumn("__at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("__at", late) if calls.isStreaming else timed
    return timed.groupBy(F.window("__at", size).alias("w"), F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "grp", "calls", "total")


def sessions(calls: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, calls) of runs of calls with no gap as long as `gap`."""
    timed = calls.withColumn("__at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("__at", late) if calls.isStreaming else timed
    return timed.groupBy(F.session_window("__at", gap).alias("w"), F.col(user).alias("usr")).agg(F.count(F.lit(1)).alias("calls")).select("usr", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def on_landing(spark: SparkSession, directory: str, schema: StructType, build: Callable[[DataFrame, int], None], checkpoint: str, every: str = "750 milliseconds"):
    """Call build(rows, batch) for the rows of each group of Parquet files that lands in the directory.

    A batch is handed over at least once; build should write under the batch's number so that a repeat replaces.
    """
    return spark.readStream.schema(schema).parquet(directory).writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
