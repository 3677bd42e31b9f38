"""Encoding of a corpus by a byte-level BPE vocabulary (problem 8), with the merges done by DuckDB.

Texts are split into words by the vocabulary's public pattern; the distinct words of a chunk become token-position
rows which a recursive query joins to the merge table until no pair is left. Words already encoded by the same worker
are looked up.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before merging (public vocabulary's README).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Largest vocabulary file that is sent to the executors; such files have a few MB however large the corpus.
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters tokenized at once, and words remembered by a worker.
CHUNK_CHARS, CACHE_WORDS = 3_000_000, 300_000


@dataclass(frozen=True)
class Vocabulary:
    """byte_ids: the id of each byte; left, right, result: the merges in order of rank; spelled: the bytes of each id; odd: see odd_characters."""

    name: str
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    result: np.ndarray
    spelled: list[bytes]
    odd: frozenset[str]


def byte_letters() -> dict[str, int]:
    """The letters which stand for bytes in byte-level vocabulary files: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    if Path(path).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    ids, letters = model["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right = (np.array([ids[p[i]] for p in pairs], dtype=np.int32) for i in (0, 1))
    result = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
    byte_ids = np.zeros(256, dtype=np.int32)
    for ch, b in letters.items():
        byte_ids[b] = ids[ch]
    # Contracting all places of a pair at once needs that no pair outranks the merges which make its parts.
    made = {int(t): i for i, t in enumerate(result)}
    if any(max(made.get(int(a), -1), made.get(int(b), -1)) >= i for i, (a, b) in enumerate(zip(left, right, strict=True))):
        raise ValueError("a merge comes before the merges that make its parts")
    spelled = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
    return Vocabulary(path, byte_ids, left, right, result, spelled, odd_characters())


#: One round: each live word's pair of lowest rank is contracted wherever it stands, left to right; in a run of
#: equal tokens every other place. Words without a pair to merge stay as they were in their last round.
MERGE_SQL = """
WITH RECURSIVE t(w, p, tok, round) AS (
  SELECT w, p, tok, 0 FROM start
  UNION ALL
  SELECT w, p, tok, round FROM (
    WITH x AS (
      SELECT w, p, tok, round, lead(tok) OVER along AS follower, lead(p) OVER along AS next_p, row_number() OVER along AS i
      FROM t WINDOW along AS (PARTITION BY w ORDER BY p)),
    pairs AS (
      SELECT x.w, p, next_p, i, m.rank, m.res, m.l = m.r AS twin, min(m.rank) OVER (PARTITION BY x.w) AS best
      FROM x JOIN merges m ON tok = m.l AND follower = m.r),
    best AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM pairs WHERE rank = best),
    picked AS (
      SELECT w, p, next_p, res FROM best
      QUALIFY NOT twin OR (row_number() OVER (PARTITION BY w, run ORDER BY i)) % 2 = 1)
    SELECT x.w, x.p, coalesce(a.res, x.tok) AS tok, x.round + 1 AS round
    FROM x SEMI JOIN picked live ON live.w = x.w
    LEFT JOIN picked a ON a.w = x.w AND a.p = x.p
    ANTI JOIN picked b ON b.w = x.w AND b.next_p = x.p
    WHERE x.round < ?))
"""
LAST_SQL = MERGE_SQL + "SELECT w, p, tok, round FROM (SELECT *, max(round) OVER (PARTITION BY w) AS last FROM t) WHERE round = last ORDER BY w, p"
#: Rounds of one recursive query. Its rounds are kept until it ends, so longer words go on in a next query.
ROUNDS = 48


#: White space as PATTERN has it, and expressions of the standard library that are twice as fast as PATTERN. They have
#: no class for letters or numbers and go wrong for odd_characters(); texts that have some take PATTERN itself.
WHITE, LETTER, DIGIT = r"[^\S\x1c-\x1f]", r"[^\W\d_]", r"\d"
QUICK = rf" ?{LETTER}+| ?{DIGIT}+|'(?:[stmd]|re|ve|ll)| ?(?:[^\w\s]|[_\x1c-\x1f])+|{WHITE}+(?![\S\x1c-\x1f])|{WHITE}+"


def odd_characters() -> frozenset[str]:
    """The characters that QUICK and PATTERN class differently, mostly numbers that aren't decimal digits."""
    import regex

    letter, number = regex.compile(r"\p{L}").fullmatch, regex.compile(r"\p{N}").fullmatch
    quick_letter, quick_digit = re.compile(LETTER).fullmatch, re.compile(DIGIT).fullmatch
    return frozenset(c for c in map(chr, range(0x110000)) if bool(quick_letter(c)) != bool(letter(c)) or bool(quick_digit(c)) != bool(number(c)))


def splitter(odd: frozenset[str]) -> Callable[[str], list[str]]:
    """Splits a text as PATTERN does."""
    import regex

    quick, exact = re.compile(QUICK).findall, regex.compile(PATTERN).findall
    return lambda t: quick(t) if t.isascii() or odd.isdisjoint(t) else exact(t)


class Encoder:
    """Encodes words; lives as long as its worker process."""

    def __init__(self, v: Vocabulary):
        import duckdb

        self.v, self.split = v, splitter(v.odd)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table({"l": v.left, "r": v.right, "rank": np.arange(len(v.left), dtype=np.int32), "res": v.result})
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the words, one after the other."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        w = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        p = np.arange(len(w), dtype=np.int64)
        tok = self.v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        done = []
        while len(w):
            self.con.register("start", pa.table({"w": w, "p": p, "tok": tok}))
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                got = self.con.execute(LAST_SQL, [ROUNDS]).to_arrow_table()
            self.con.unregister("start")
            w, p, tok, r = (got.column(i).to_numpy() for i in range(4))
            open_ = r == ROUNDS
            done.append((w[~open_], p[~open_], tok[~open_]))
            w, p, tok = w[open_], p[open_], tok[open_]
        w, p, tok = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.argsort(p, kind="stable") if len(done) > 1 else slice(None)
        return np.bincount(w, minlength=len(words)), tok[order].astype(np.int32)

    def learn(self, words: list[str]) -> None:
        """Add words not yet known, in groups of bounded size."""
        group: list[str] = []
        size = 0
        for x in [*words, None]:
            if x is None or size > 1_000_000:
                if group:
                    lengths, flat = self._merge([g.encode("utf-8", "surrogatepass") for g in group])
                    for g in group:
                        self.index[g] = len(self.index)
                    self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])
                group, size = [], 0
            if x is not None:
                group.append(x)
                size += len(x) ** 1.5  # rounds grow with a word's length
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the texts, one after the other."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        split = [self.split(t) for t in texts]
        index = self.index
        unknown: set[str] = set()
        for s in split:
            unknown.update(s)
        self.learn([w for w in unknown if w not in index])
        counts = np.array([len(s) for s in split], dtype=np.int64)
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        if not len(at):
            return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int32)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.diff(np.concatenate([[0], upto])), ids


_encoders: dict[str, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    if v.name not in _encoders:
        _encoders.clear()
        _encoders[v.name] = Encoder(v)
    return _encoders[v.name]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) if only counts are wanted, one row per input row.

    No special tokens: their strings in a text are ordinary text. An empty or null text has the empty list. Texts of
    any length are encoded whole; keys may repeat or be null. Other columns aren't read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                lengths, ids = encoder.encode([t or "" for t in texts[a:b]])
                made = pa.array(lengths, pa.int64()) if counts_only else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], names=[key, "n_tokens" if counts_only else "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the text which the ids spell, put together by ordered aggregation; null ids give null, none give ''.

    Bytes that aren't valid UTF-8, as a cut id list may leave them, become the replacement character.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.register("given", pa.table({"id": np.arange(len(shared.value.spelled), dtype=np.int32), "hex": [b.hex() for b in shared.value.spelled]}))
        con.execute("CREATE TABLE spelled AS SELECT * FROM given")
        for batch in batches:
            lists = batch.column(1)
            con.register("rows", pa.table({"n": np.arange(batch.num_rows, dtype=np.int64), "ids": lists}))
            got = con.execute("SELECT n, string_agg(hex, '' ORDER BY i) FROM (SELECT n, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM rows) JOIN spelled USING (id) GROUP BY n").fetchall()
            con.unregister("rows")
            text = {n: bytes.fromhex(h).decode("utf-8", "replace") for n, h in got}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text.get(n, "") if lists[n].is_valid else None for n in range(batch.num_rows)], pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
