"""Queries p3-p6 and p8-p10 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoria.llm import bpe, docs, mixture, provenance, spam, syntax, terms
from scoria.plans.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docs.documented(table(spark, d, "files"), table(spark, d, "expected")).select("file_id", "start_line")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docs.code_pairs(table(spark, d, "files"), table(spark, d, "expected"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_costs(table(spark, d, "files"), table(spark, d, "expected"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_files(spark, d).where("cost > 0").select("file_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(p4_files(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "files")).select("file_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctive_terms(table(spark, d, "search_documents")).select("document_id", "term")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_scores(table(spark, d, "search_documents")).withColumn("score", F.round("score", 6))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their sizes; the source goes through the tokenizer inside the key, which saves a join."""
    keyed = table(spark, d, "documents").select(F.struct("doc_id", "source").alias("k"), "text")
    return bpe.encode_texts(keyed, "k", "text", counts_only=True).select("k.doc_id", "k.source", "n_tokens")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids."""
    return bpe.decode_ids(p8_ids(spark, d), "doc_id", "ids")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_sizes(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture_report(*mixture.mix_sources(_sizes(spark, d), table(spark, d, "mix_targets")))


def _characters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))


def p9_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mix with sizes in characters, which SQL can count."""
    return mixture.mix_sources(_characters(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    out = mixture.mixture_report(*mixture.mix_sources(_characters(spark, d), table(spark, d, "mix_targets")))
    return out.withColumns({c: F.round(c, 6) for c in ("target_tokens", "short", "actual_share", "gap")})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id")


_WORDS = """
WITH d AS (
  SELECT document_id, max(struct_pack(q := coalesce(qualified_name, ''), c := coalesce(code, ''), n := coalesce(natural_text, ''))) AS r
  FROM search_documents WHERE document_id IS NOT NULL GROUP BY 1),
w AS (
  SELECT document_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(r.q || ' ' || r.c || ' ' || r.n, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Za-z]+'))) AS term FROM d),
tf AS (SELECT document_id, term, count(*) AS tf FROM w WHERE len(term) >= 3 GROUP BY ALL),
t AS (SELECT term, count(*) AS df, sum(tf) AS nt FROM tf GROUP BY 1),
m AS (SELECT document_id, sum(tf) AS nd FROM tf GROUP BY 1),
x AS (SELECT document_id, term, tf, df, nd / n AS a, nt / n AS b, nd * nt / n AS e FROM tf JOIN t USING (term) JOIN m USING (document_id), (SELECT sum(tf)::DOUBLE AS n FROM tf))
"""

_MIX = """
WITH s AS (SELECT doc_id, source, len(coalesce(text, ''))::BIGINT AS n FROM documents),
t AS (SELECT source, max(struct_pack(a := target_share, b := max_repeats)) AS x FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
m AS (SELECT t.source, coalesce(x.a, 0.0) AS share, greatest(coalesce(x.b, 0), 0) AS reps, coalesce(h.n, 0)::BIGINT AS have FROM t LEFT JOIN (SELECT source, sum(n) AS n FROM s GROUP BY 1) h USING (source)),
u AS (SELECT *, have > 0 AND share > 0 AND reps > 0 AS ok FROM m),
k AS (SELECT sum(have)::DOUBLE / sum(share) AS per FROM u WHERE ok),
p AS (SELECT *, CASE WHEN ok THEN share * per ELSE 0.0 END AS wanted, CASE WHEN ok THEN least(share * per / have, reps::DOUBLE) ELSE 0.0 END AS copies, ('0x' || md5(source || '#0')[1:7])::BIGINT / 268435456.0::DOUBLE AS offs FROM u, k),
d AS (SELECT doc_id, s.source, n, copies, offs, row_number() OVER (PARTITION BY s.source ORDER BY n, doc_id) - 1 AS r FROM s JOIN p ON p.source = s.source WHERE n > 0 AND copies > 0),
used AS (SELECT doc_id, source, n AS n_tokens, (floor((r + 1) * copies + offs) - floor(r * copies + offs))::INT AS copies FROM d)
"""

QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_files": p4_files, "p4_rates": p4_rates, "p5_found": p5_found, "p5_reasons": p5_reasons, "p6_found": p6_found, "p6_scores": p6_scores, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_mix_chars": p9_mix_chars, "p9_shares_chars": p9_shares_chars, "p10_found": p10_found}

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_mix_chars": _MIX + "SELECT * FROM used WHERE copies > 0",
    "p9_shares_chars": _MIX + """, g AS (SELECT source, count(*) AS documents, sum(n_tokens * copies)::BIGINT AS mixed FROM used WHERE copies > 0 GROUP BY 1), a AS (SELECT sum(mixed) AS total FROM g)
        SELECT source, share AS target_share, reps AS max_repeats, have AS available, coalesce(documents, 0) AS documents, round(wanted, 6) AS target_tokens, coalesce(mixed, 0) AS mixed,
          round(CASE WHEN copies >= reps THEN greatest(wanted - coalesce(mixed, 0), 0.0) ELSE 0.0 END, 6) AS short, round(coalesce(mixed / total, 0.0), 6) AS actual_share, round(share - coalesce(mixed / total, 0.0), 6) AS gap FROM p LEFT JOIN g USING (source), a""",
    "p6_found": _WORDS + "SELECT document_id, term FROM x WHERE tf >= 3 AND df BETWEEN 2 AND 12",
    "p6_scores": _WORDS + "SELECT document_id, term, tf, df, round(CASE WHEN e * (1 - a) * (1 - b) > 0 THEN (tf - e) / sqrt(e * (1 - a) * (1 - b)) ELSE 0 END, 6) AS score FROM x",
}
