"""What changed between consecutive full snapshots of a keyed table (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.plans.runtime import bounded_broadcast, checkpointed


def hex_number(c: Column) -> Column:
    """A hexadecimal number in one spelling: no algorithm prefix, 0x, separators, leading zeros or capitals."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^.*:", ""), r"^\s*0x", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^0-9a-f]", ""), r"^0+(?=.)", "")


def consecutive(versions: DataFrame, group: str, version: str, order: str) -> DataFrame:
    """(group, version, next_version, is_first) for the versions of each group in order; ties go by version."""
    w = Window.partitionBy(group).orderBy(F.col(order).asc_nulls_first(), F.col(version))
    return versions.select(group, version, F.lead(version).over(w).alias("next_version"), F.lag(version).over(w).isNull().alias("is_first"))


def latest_rows(df: DataFrame, keys: list[str], at: str, payload: list[str]) -> DataFrame:
    """Of several rows of one key the last delivered; equal times go to the greatest payload, null times come first."""
    best = F.max(F.struct(F.col(at), *payload)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{p}").alias(p) for p in payload])


def snapshot_changes(rows: DataFrame, versions: DataFrame, *, group: str = "project_id", version: str = "generation_id", key: str = "symbol_id", content: Column | None = None, at: str = "delivered_at", order: str = "published_at") -> DataFrame:
    """(group, version, key, change_kind): added, removed or changed against the version before.

    `versions` holds the versions to compare, at most one row each. EXCEPT ALL in both directions removes the rows
    that both snapshots hold alike; a full join of the residues by key tells additions, removals and changes apart.
    Defined cases: rows of versions not listed don't count; rows with a null group, version or key are ignored;
    null content equals null content only; repeated rows count once and the last delivered correction holds; a
    version without rows removes all of the one before; no rows or no versions give no changes. Other columns of the
    input aren't read, whatever their names.
    """
    content = F.col("structural_digest") if content is None else content
    chain = consecutive(versions.where(F.col(group).isNotNull() & F.col(version).isNotNull()), group, version, order)
    chain = chain.select(F.col(group).alias("__g"), F.col(version).alias("__v"), F.col("next_version").alias("__next"), F.col("is_first").alias("__first"))
    picked = rows.select(F.col(group).alias("g"), F.col(version).alias("v"), F.col(key).alias("k"), content.alias("c"), F.col(at).alias("at"))
    picked = picked.where(F.col("k").isNotNull()).join(bounded_broadcast(chain), (F.col("g") == F.col("__g")) & (F.col("v") == F.col("__v")))
    # Corrections are settled once; both set differences read the result.
    state = checkpointed(picked.groupBy("g", "k", "v", "__next", "__first").agg(F.max(F.struct("at", "c")).alias("best")).select("g", "k", "v", "__next", "__first", F.col("best.c").alias("c")))
    now = state.where(~F.col("__first")).select("g", "v", "k", "c")
    before = state.where(F.col("__next").isNotNull()).select("g", F.col("__next").alias("v"), "k", "c")
    gained = now.exceptAll(before).withColumn("in_new", F.lit(True))
    lost = before.exceptAll(now).withColumn("in_old", F.lit(True)).withColumnRenamed("c", "c_old")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return gained.join(lost, ["g", "v", "k"], "full_outer").select(F.col("g").alias(group), F.col("v").alias(version), F.col("k").alias(key), kind.alias("change_kind"))
