"""How distinctive a term is of a record (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.operators.joins import salted_join
from scoria.plans.runtime import checkpointed

#: Runs of capitals up to the last one before a small letter, else a word with or without a capital.
WORD = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"


def term_scores(docs: DataFrame, key: str = "document_id", fields: tuple[str, ...] = ("qualified_name", "code", "natural_text"), min_letters: int = 3) -> DataFrame:
    """(key, term, tf, df, score) for each term of each record.

    The score is the adjusted residual of the record x term contingency table: observed minus expected count, over
    the root of the expected count times the shares left over by the record's and the term's margins. Terms common
    everywhere score near 0, terms that few records share score high.

    Defined cases: a null key is no record; repeated rows of a record count once (of differing rows the greatest
    holds); null fields are empty; fields never join to one word; records without terms give no rows; where the
    variance is 0 (a single record or a single term) the score is 0. Other columns aren't read.
    """
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields])).alias("r"))
    words = F.transform(F.regexp_extract_all(F.concat_ws(" ", *[F.col(f"r.{f}") for f in fields]), F.lit(WORD), F.lit(0)), F.lower)
    bags = one.select("k", F.filter(words, lambda w: F.length(w) >= min_letters).alias("w"))
    # Still partitioned by record: the counts need no further shuffle. Texts are split once, the table of counts is read
    # again for the margins.
    tf = checkpointed(bags.select("k", F.size("w").cast("long").alias("n_doc"), F.explode("w").alias("term")).groupBy("k", "n_doc", "term").agg(F.count(F.lit(1)).alias("tf")))
    terms = checkpointed(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n_term")))
    total = terms.agg(F.sum("n_term").cast("double").alias("n")).scalar()
    expected = F.col("n_doc") * F.col("n_term") / total
    variance = expected * (1 - F.col("n_doc") / total) * (1 - F.col("n_term") / total)
    score = F.when(variance > 0, (F.col("tf") - expected) / F.sqrt(variance)).otherwise(F.lit(0.0))
    return salted_join(tf, terms, "term", "df").select(F.col("k").alias(key), "term", "tf", "df", score.alias("score"))


def distinctive_terms(docs: DataFrame, min_tf: int = 3, min_df: int = 2, max_df: int = 12) -> DataFrame:
    """The scores of terms that a record uses often and few other records use, the most characteristic first."""
    return term_scores(docs).where((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df)).orderBy(F.col("score").desc(), "document_id", "term")
