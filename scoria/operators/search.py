"""Lexical retrieval: code tokens, BM25, fuzzy names, rank fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoria.operators.joins import salted_join

#: BM25's usual parameters and the constant of reciprocal-rank fusion.
K1, B, RRF = 1.2, 0.75, 60
FIELDS = ("qualified_name", "code", "natural_text")


def code_tokens(c: Column) -> Column:
    """Lower-case words of names and text: split at camel case, acronyms, underscores and signs; digits are kept."""
    humps = F.regexp_replace(F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), r"[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "document_id") -> DataFrame:
    """(doc, field, term, tf, length): the inverted index of the documents, each document id once."""
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(F.max(F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields])).alias("r"))
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), code_tokens(F.col(f"r.{f}")).alias("terms")) for f in fields]))
    rows = one.select("doc", sides.alias("x")).select("doc", "x.field", F.size("x.terms").cast("long").alias("length"), F.explode("x.terms").alias("term"))
    return rows.groupBy("doc", "field", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, terms: list[str], documents: int, k1: float = K1, b: float = B) -> DataFrame:
    """(doc, score, matched) of the documents that hold any of the terms; scores of fields add up.

    A field's average length is over the documents that have it. Document frequencies are counted over the whole index;
    only rows of the asked terms take part in the join.
    """
    lengths = index.groupBy("doc", "field").agg(F.max("length").alias("length")).groupBy("field").agg((F.sum("length") / F.count(F.lit(1))).alias("average"))
    hits = index.where(F.col("term").isin(sorted(set(terms))))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # One row per field and asked term: bounded by the query, not by the data.
    both = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(lengths), "field")
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return both.groupBy("doc").agg(F.sum(part).alias("score"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("matched"))


def ranked(scores: DataFrame, k: int, score: str = "score", doc: str = "doc") -> DataFrame:
    """The k best with their ranks: score, then id. A top-k report; rows are cut in each task before they meet."""
    top = scores.orderBy(F.col(score).desc(), doc).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), doc)))


def fuzzy_terms(index: DataFrame, token: str, distance: int) -> DataFrame:
    """(term, edits): the index's terms within so many edits of the token."""
    return index.select("term").distinct().withColumn("edits", F.levenshtein(F.col("term"), F.lit(token), distance)).where(F.col("edits") >= 0)


def fuzzy_ranked(index: DataFrame, token: str, distance: int) -> DataFrame:
    """(doc, score, best_edits): documents by their terms near the token; each such term counts its uses over one more than its edits."""
    near = fuzzy_terms(index, token, distance)
    # Levenshtein runs over distinct terms; postings join by term.
    return index.join(near, "term").groupBy("doc").agg(F.sum(F.col("tf") / (1 + F.col("edits"))).alias("score"), F.min("edits").alias("best_edits"))


def persist_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Write an index as a table partitioned by a hash of the term, so that a query reads only its terms' parts."""
    index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """A persisted index, or the parts of it that hold the terms."""
    index = spark.read.parquet(path)
    if terms is None:
        return index.drop("bucket")
    hashes = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct()
    return index.where(F.col("bucket").isin([b for (b,) in hashes.collect()]) & F.col("term").isin(terms)).drop("bucket")


def index_differences(index: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc, field, term, tf, length, side): postings that only one of two indexes has; none if the stored one is whole."""
    columns = ["doc", "field", "term", "tf", "length"]
    a, b = index.select(columns), stored.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("stale")))


def fuse(channels: DataFrame, tiers: DataFrame | None = None, constant: int = RRF) -> DataFrame:
    """(doc, score, best_rank, tier, place): reciprocal-rank fusion of rows (channel, doc, rank).

    Order: preference tier, score, best rank, id. Documents without a tier are in tier 0; of a document ranked twice by
    a channel the better rank counts.
    """
    once = channels.groupBy("channel", "doc").agg(F.min("rank").alias("rank"))
    score = once.groupBy("doc").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    score = score.join(tiers, "doc", "left").withColumn("tier", F.coalesce("tier", F.lit(0))) if tiers is not None else score.withColumn("tier", F.lit(0))
    # Channels are top-k lists, so what is fused is as small as they are.
    return score.withColumn("place", F.row_number().over(Window.orderBy("tier", F.col("score").desc(), "best_rank", "doc")))


def preference_tier(kind: Column, path: Column, symbol_kind: Column) -> Column:
    """3 for tests, 2 for auxiliary paths and minor kinds, 1 for members, else 0."""
    auxiliary = path.rlike(r"(?i)(^|/)(bench|benches|examples?|fixtures?|docs)/")
    return F.when((kind == "test") | path.rlike(r"(^|/)tests?/"), 3).when(auxiliary | symbol_kind.isin("parameter", "import"), 2).when(symbol_kind.isin("property", "field", "variable", "enum_member", "export"), 1).otherwise(0)


#: The words that tell what a question wants, in the order in which they are tried.
INTENTS = [
    ("error", "bug crash debug diagnose error exception fail failing failure panic stuck"),
    ("documentation", "doc docs documentation example examples guide readme"),
    ("architecture", "architecture boundary boundaries dependency dependencies design overview subsystem subsystems"),
    ("trace", "caller callers called calls callee callees flow implementation trace used uses work working works"),
    ("change", "add change correct edit fix implement improve modify optimize reduce refactor remove rename replace"),
    ("symbol", "class declaration define defined file find function locate method symbol type where"),
    ("test", "test tests coverage verify verification"),
]


def intent(task: str) -> str:
    """What a task asks for; change planning if no word tells."""
    words = re.findall(r"[a-z]+", task.lower())
    for i, (name, terms) in enumerate(INTENTS):
        if set(words) & set(terms.split()):
            return name
        if i == 0 and re.search(r"\b(which|what|select) tests?\b", task.lower()):
            return "test"
        if name == "architecture" and re.match(r"how (are|does|is)\b", task.lower()):
            return "implementation"
    return "error" if "regression" in words else "change"


QUALIFIERS = ("kind", "lang", "path", "name", "sig", "callers-of", "callees-of", "depends-on", "centrality", "sort")


def parse_qualified(query: str) -> dict:
    """Qualifiers of a query as {name: [values]}, other words under "text"; quotes keep blanks together."""
    out: dict[str, list[str]] = {"text": []}
    for m in re.finditer(r'([a-z-]+):("[^"]*"|\S+)|("[^"]*"|\S+)', query):
        name, value, word = m.groups()
        if name in QUALIFIERS:
            value = value.strip('"')
            out.setdefault(name, []).append(value if name != "centrality" or value[:1] in "<>" else f">={value}")
        else:
            out["text"].append((word or m.group(0)).strip('"'))
    return out


def term_weights(index: DataFrame) -> DataFrame:
    """(doc, field, term, tf, df) over the whole index; terms that most documents share are spread over tasks."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return salted_join(index, df, "term", "df")
