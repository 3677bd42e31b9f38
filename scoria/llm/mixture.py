"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.operators.prefix import group_prefix_sum
from scoria.plans.runtime import bounded_broadcast, checkpointed


def plan_mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, available, target_tokens, copies), one row per source of `targets`.

    The mix is planned for `total_tokens`, by default for as many as the usable sources hold: those with documents, a
    positive share and repeats. target_tokens is a source's share of that total, shares being taken relative to those of
    the usable sources; copies is the expected number of uses of each of its documents, at most max_repeats. A source
    at its cap falls short and the mix is smaller by that; with `exact` the total is the largest at which none does, so
    that a source of few tokens limits all others.

    Targets with a null source or a share that is null or not positive, and sources without documents, have 0 copies; a
    null or negative max_repeats counts as 0 and its source as without documents. Repeated targets count once (the
    greatest row).
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", F.coalesce("x.target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("x.max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    # There is one row per source of the targets, a fixed small table.
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    m = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    sums = m.where(usable).agg(F.sum("target_share").alias("all"), F.sum("available").cast("double").alias("held"), F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("most"))
    per_share = sums.select("most").scalar() if exact else (sums.select("held").scalar() if total_tokens is None else F.lit(float(total_tokens))) / sums.select("all").scalar()
    wanted = F.when(usable, F.col("target_share") * per_share).otherwise(F.lit(0.0))
    copies = F.when(usable, F.least(F.col("target_share") * per_share / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return m.withColumns({"target_tokens": wanted, "copies": copies})


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies) of each document used, and the plan.

    Systematic sampling per source: with the expected copies summed up in order of size, a document is used once for
    each whole number crossed by its stretch, after one random offset for the source. As all documents of a source
    have equal expected copies and lie in order of size, the tokens drawn differ from those planned by at most about one
    document per block of the order. A document of null source, of a source without a target, or without tokens
    isn't used. Sums run over blocks of bounded size, so a source that holds most documents is no bottleneck.
    """
    sizes = checkpointed(sizes)
    plan = checkpointed(plan_mixture(sizes, targets, total_tokens, exact))
    offset = (F.conv(F.substring(F.md5(F.concat("source", F.lit(f"#{seed}"))), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))).alias("offset")
    drawn = sizes.where(F.col("n_tokens") > 0).join(bounded_broadcast(plan.where("copies > 0").select("source", "copies", offset)), "source")
    octave = F.floor(F.log2(F.col("n_tokens").cast("double")) * 8)
    ranked = group_prefix_sum(drawn, ["source"], [octave], [F.col("n_tokens"), F.col("doc_id")], F.lit(1), "rank")
    upto = lambda r: F.floor(r * F.col("copies") + F.col("offset"))
    used = ranked.withColumn("uses", (upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("int")).where("uses > 0")
    return used.select("doc_id", "source", "n_tokens", F.col("uses").alias("copies")), plan


def mixture_report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, target_tokens, mixed, short, actual_share, gap) for each target source.

    short is what a source at its cap lacks of its target_tokens, gap the target share less the actual one.
    """
    got = used.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"))
    total = got.agg(F.sum("mixed").alias("n")).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", "available", zero("documents"), "target_tokens", zero("mixed"), "copies", F.coalesce(F.col("mixed") / total, F.lit(0.0)).alias("actual_share"))
    capped = F.when(F.col("copies") >= F.col("max_repeats"), F.greatest(F.col("target_tokens") - F.col("mixed"), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumns({"short": capped, "gap": F.col("target_share") - F.col("actual_share")}).drop("copies")
