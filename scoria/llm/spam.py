"""Keyword-stuffed and link-list pages (problem 10)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.plans.runtime import bounded_broadcast, checkpointed

WORD = re.compile(r"[^\W\d_]+").findall
LABEL = re.compile(r"\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$")
#: Scripts written without blanks between words: a run of letters is no word there. Hiragana carries grammar.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
#: Letters of Korean stand for syllables, so that two make a word of content.
HANGUL = re.compile(r"[\uac00-\ud7af]")
HIRAGANA, KANA = re.compile(r"[\u3041-\u309f]"), re.compile(r"[\u3040-\u30ff]")
FENCE = re.compile(r"```.*?```", re.S)
#: Lines of machines: time stamps of logs, frames of stack traces, lists of links within the page.
MACHINE = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T\s]\s*\d\d:\d\d|at \S+ ?\(|Traceback |File \"|[-*] \[[^\]]*\]\(#)").match
#: Lines beside the text of an honest page: headings, a label with a few words or links, or with none.
BESIDE = re.compile(r"^\s*(?:#{1,6} |[^\W\d_][\w ]{0,30}:\s*$)").match
LINK_LETTERS = 12
LABELLED, LABELLED_WORDS = re.compile(r"^\s*[^\W\d_][\w ]{0,20}: ").match, 12
#: Top-level domains by which a bare host name is told from a file or field name.
DOMAINS = "com|org|net|info|biz|edu|gov|io|app|dev|shop|site|online|store|xyz|club|top|link|live|pro|blog|example|test|invalid|de|fr|es|nl|pl|ru|jp|cn|kr|br|eu|ch|se|fi|dk|cz|pt|tr|uk|au|ca"
LINK = re.compile(rf"\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>.*?</a>|(?:https?://|www\.)[^\s)>\]]+|\b(?:[a-z0-9-]{{1,63}}\.){{1,8}}(?:{DOMAINS})\b(?:/[^\s)>\]]*)?", re.I)
#: A text without any of these has no link.
LINKED = re.compile(rf"://|www\.|\]\(|<a\s|\.(?:{DOMAINS})\b", re.I).search
SEPARATOR = re.compile(r"[,;|»›•·#/*~、，；｜・]|(?<=\s)[-–—>](?=\s)")
SENTENCE_END = re.compile(r"(?<=[.!?।؟])\s+|(?<=[。！？])")
ENDED = re.compile(r"[.!?。！？।؟…][\"'»”’)\]*_]*\s*$").search

#: A word is hot if it makes up that share of all words of a page and occurs so often; a sentence with that share of hot
#: words isn't prose.
HOT_SHARE, HOT_COUNT, HOT_IN_SENTENCE, SENTENCE_WORDS = 0.1, 6, 0.25, 4
#: A function word is overused at that many times its usual share; a sentence has at most so many separators a word.
OVERUSED, SEPARATED = 4.0, 0.4
#: Where a language's function words aren't known, a sentence is told by its end, length, variety and few separators.
SHAPE_WORDS, SHAPE_VARIETY, SHAPE_SEPARATORS = 5, 0.6, 0.25
#: A run of letters that is no keyword in an unspaced script, and how often a repeated line still counts as prose.
RUN_LETTERS, LINE_COPIES = 7, 3
#: A run of more letters is no word.
WORD_LETTERS = 40

FEATURES = "page_lang string, evidence int, prose double, function_share double, top_share double, pair_share double, bigram_share double, duplicate_lines double, link_share double, separators double"
#: Shares from which on a page without prose is spam, with the reason told: links, words, bigrams, lines, separators.
MOSTLY_PROSE = 0.6
SIGNALS = {"link_share": (0.4, "links"), "duplicate_lines": (0.5, "repeated lines"), "pair_share": (0.2, "keywords"), "bigram_share": (0.1, "keywords"), "top_share": (0.1, "keywords"), "separators": (0.25, "tags")}


@dataclass(frozen=True)
class Language:
    """What the corpus tells of a language: its function words with their shares of all words, its usual words, and the least share of function words in a sentence."""

    function: dict[str, float]
    usual: frozenset[str]
    least: float


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(label, word, documents, uses) over all documents, counted in each task before anything is shuffled.

    label is the language code of two or three letters that a document claims; others count nowhere. The word '' counts
    the documents and words of the label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: dict[str, Counter] = {}
        uses: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            keys = [(label, w) for label, words in documents.items() for w in words]
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([documents[k][w] for k, w in keys], pa.int64()), pa.array([uses[k][w] for k, w in keys], pa.int64())], names=["label", "word", "documents", "uses"])
            documents.clear(), uses.clear()
            return made

        for batch in batches:
            for t, claimed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = LABEL.match(claimed or "")
                if not m or not t or (label := m.group(1).lower()) == "und":
                    continue
                words = WORD(t.lower())
                some = documents.setdefault(label, Counter())
                some.update({"", *words})
                total = uses.setdefault(label, Counter())
                total.update(words)
                total[""] += len(words)
            if sum(map(len, documents.values())) > 500_000:
                yield out()
        yield out()

    partial = docs.select(F.col(text), F.col(lang).cast("string")).mapInArrow(run, "label string, word string, documents long, uses long")
    return partial.groupBy("label", "word").agg(F.sum("documents").alias("documents"), F.sum("uses").alias("uses"))


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", function_share: float = 0.25, usual_share: float = 0.002, prior: int = 50) -> dict[str, Language]:
    """The languages of a corpus by label.

    A word is usual in a language if at least `usual_share` of its documents have it, and a function word at
    `function_share`. `prior` documents without any word are added to each language, so what a few documents say counts
    little and a language of very few has no function words. At most (distinct words a document has on average) /
    usual_share words of a language come to the driver, whatever the size of the corpus. A sentence needs two fifths of
    the share of function words that the language's documents have on average.
    """
    counts = checkpointed(word_counts(docs, text, lang))
    # One row per label of two or three letters.
    totals = counts.where("word = ''").select("label", F.col("documents").alias("all"), F.col("uses").alias("words"))
    share = F.col("documents") / (F.col("all") + prior)
    rows = counts.where("word <> ''").join(bounded_broadcast(totals), "label").where(share >= usual_share).select("label", "word", share.alias("share"), (F.col("uses") / F.col("words")).alias("part")).collect()
    found: dict[str, list] = {}
    for r in rows:
        words = found.setdefault(r["label"], [{}, set()])
        words[1].add(r["word"])
        if r["share"] >= function_share:
            words[0][r["word"]] = r["part"]
    return {label: Language(f, frozenset(u), 0.4 * sum(f.values())) for label, (f, u) in found.items() if f}


def _page_lines(text: str) -> list[tuple[str, str, int]]:
    """(line, line without its links, number of links) of the lines that count.

    Lines beside the text don't, unless they hold more than twice as much as the rest.
    """
    linked = LINKED(text) is not None
    body, beside, sizes = [], [], [0, 0]
    for line in (FENCE.sub("\n", text) if "```" in text else text).split("\n"):
        if not line or line.isspace() or MACHINE(line):
            continue
        bare, n = LINK.subn(" ", line) if linked and LINKED(line) else (line, 0)
        size = len(bare) + LINK_LETTERS * n
        aside = BESIDE(line) is not None or n <= 8 and ": " in line[:30] and LABELLED(line) is not None and len(WORD(bare)) + 2 * n <= LABELLED_WORDS
        (beside if aside else body).append((line, bare, n))
        sizes[aside] += size
    return body if sizes[1] <= 2 * sizes[0] else body + beside


def page_features(text: str, languages: dict[str, Language]) -> tuple:
    """The values of FEATURES for one text. Fenced code, logs and stack traces are neither prose nor spam.

    function_share is that of function words in what isn't prose. The shares of bigrams and separators only tell kinds of spam apart; for pages mostly of prose they are null.

    page_lang is the learned language whose function words the page has most of, 'unspaced' where letters of scripts
    without blanks prevail, or 'other' if less than half of the words are usual in any learned language.
    """
    rows = _page_lines(text)
    chars = sum(len(line) for line, _, _ in rows)
    links = sum(n for _, _, n in rows)
    link_chars = sum(len(line) - len(bare) for line, bare, n in rows if n)
    times: Counter = Counter()
    sentences: list[tuple[list[str], bool, str]] = []
    foreign = not text.isascii() and UNSPACED.search(text) is not None
    for _, bare, _ in rows:
        low = bare.lower()
        times[low] += 1
        kept = times[low] <= LINE_COPIES
        for part in SENTENCE_END.split(low):
            if s := WORD(part):
                sentences.append((s, kept, part))
    words = [w for s, _, _ in sentences for w in s]
    counts = Counter(words)
    if blobs := {w for w in counts if len(w) > WORD_LETTERS and not (foreign and UNSPACED.match(w))}:
        sentences = [([w for w in s if w not in blobs], kept, part) for s, kept, part in sentences]
        words = [w for w in words if w not in blobs]
        counts = Counter(words)
    n = len(words)
    runs = {w for w in counts if len(UNSPACED.findall(w)) * 2 > len(w)} if foreign else frozenset()
    unspaced = bool(runs) and sum(len(w) * counts[w] for w in runs) * 2 > sum(map(len, words))
    lang, known = "other", None
    if n and not unspaced:
        shares = {}
        for label, x in languages.items():
            # Function words are usual ones too.
            hits = x.usual.intersection(counts)
            shares[label] = (sum([counts[w] for w in hits if w in x.function]), sum([counts[w] for w in hits]), label)
        if max((u for _, u, _ in shares.values()), default=0) * 2 >= n:
            lang = max(shares.values())[2]
            known = languages[lang]
    function = known.function if known else {}
    if unspaced:
        lang = "unspaced"
    weight = n + sum((len(w) // 2 - 1) * counts[w] for w in runs)
    # What recurs is hot; short words may be function words where those aren't known.
    # A function word counts as content where a page has it several times as often as the language.
    content = {w for w, k in counts.items() if w not in function or k >= OVERUSED * function[w] * n} if known else {w for w in counts if w in runs or len(w) > 3 or len(w) > 1 and HANGUL.match(w)}
    top = nlargest(2, map(counts.__getitem__, content))
    bar = max(HOT_COUNT, HOT_SHARE * n)
    hot = {w for w in content if counts[w] >= bar and (w not in runs or len(w) < RUN_LETTERS)} if top and top[0] >= bar else frozenset()
    kana = bool(runs) and KANA.search(text) is not None
    prose = total = functions = rest = 0
    for s, kept, part in sentences:
        size = sum(map(len, s))
        total += size
        f = sum(map(function.__contains__, s)) if function else 0
        if not kept or hot and sum(map(hot.__contains__, s)) >= HOT_IN_SENTENCE * len(s):
            running = False
        elif runs and sum(len(w) for w in s if w in runs) * 2 > size:
            running = sum(len(w) for w in s if w in runs and len(w) >= RUN_LETTERS and (not kana or HIRAGANA.search(w))) * 2 >= size
        elif known:
            # There are no more separators than signs that are neither letters nor blanks.
            running = len(s) >= SENTENCE_WORDS and f >= known.least * len(s) and (len(part) - size - part.count(" ") <= SEPARATED * len(s) or len(SEPARATOR.findall(part)) <= SEPARATED * len(s))
        else:
            running = len(s) >= SHAPE_WORDS and ENDED(part) is not None and len(set(s)) >= SHAPE_VARIETY * len(s) and len(SEPARATOR.findall(part)) <= SHAPE_SEPARATORS * len(s)
        if running:
            prose += size
        else:
            functions += f
            rest += len(s)
    share = prose / max(1, total + link_chars)
    bigram = separators = None
    if share < MOSTLY_PROSE:
        pairs = max(Counter(zip(words, words[1:], strict=False)).values(), default=0)
        bigram, separators = pairs / n if pairs > 1 else 0.0, sum(len(SEPARATOR.findall(bare)) for _, bare, _ in rows) / max(1, weight)
    repeated = 1 - len(times) / len(rows) if rows else 0.0
    return (lang, weight + 2 * links, share, functions / max(1, rest) if known else None, top[0] / n if top else 0.0, sum(top) / max(1, n), bigram, repeated, link_chars / max(1, chars), separators)


def document_features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, dict[str, Language]]:
    """((key, FEATURES), languages), one row per document; null texts count as empty. Whole texts are read."""
    languages = learn_languages(docs, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast(languages)
    kind = docs.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*[page_features(t or "", sent.value) for t in batch.column(1).to_pylist()], strict=True)) or [()] * len(names)
            types = [pa.string(), pa.int32(), *[pa.float64()] * 8]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(values, types, strict=True)]], names=[key, *names])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {FEATURES}"), languages


def language_thresholds(features: DataFrame, low: float = 0.2, high: float = 0.4, usual: float = 0.3, inertia: int = 20) -> DataFrame:
    """(page_lang, threshold): the share of prose below which a page of the language isn't made of sentences.

    Pages fall into two groups, almost none or almost all prose. The threshold is the middle of the emptiest stretch
    between low and high over all pages of the language. A step of 0.05 away from `usual` must be worth `inertia` pages,
    so few pages move it nowhere and no number of pages switches the rule. One row per language.
    """
    step = 0.05
    spots = [round(low + i * step, 2) for i in range(round((high - low) / step) + 1)]
    near = [F.sum((F.abs(F.col("prose") - t) <= step).cast("long")).alias(f"n{i}") for i, t in enumerate(spots)]
    counts = features.groupBy("page_lang").agg(*near)
    best = F.array_min(F.array(*[F.struct((F.col(f"n{i}") + round(abs(t - usual) / step) * inertia).alias("n"), F.lit(t).alias("t")) for i, t in enumerate(spots)]))
    return counts.select("page_lang", best["t"].alias("threshold"))


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", evidence: int = 15) -> DataFrame:
    """(key, reason and the features) of the documents that consist mainly of keywords, links or tags.

    A page is spam if little of it is running prose and something else prevails: one of SIGNALS, or words of a language
    whose function words are known with hardly any of them. What prose is in a language is learned from all documents
    of the corpus; pages in languages the corpus hardly has are judged by the shape of their sentences, so that honest
    text of any language is none.

    Defined cases: null, empty and blank texts, and those with fewer words and links than `evidence`, are no spam; equal
    texts are judged alike; keys may repeat or be null; a null or wrong `lang` only leaves the document out of its
    language's word counts. Tables without rows give none. Other columns aren't read.
    """
    found, languages = document_features(docs, key, text, lang)
    features = checkpointed(found)
    # A row per learned language and two more.
    limits = bounded_broadcast(language_thresholds(features))
    few = F.lit(None).cast("double")
    for label, x in languages.items():
        few = F.when(F.col("page_lang") == label, F.lit(x.least / 2)).otherwise(few)
    missing = F.coalesce((F.col("function_share") < few) & (F.col("evidence") >= 3 * evidence), F.lit(False))
    reason = F.lit(None).cast("string")
    for name, (least, what) in reversed(SIGNALS.items()):
        reason = F.when(F.col(name) >= least, what).otherwise(reason)
    reason = F.coalesce(reason, F.when(missing, "no function words"))
    pages = features.join(limits, "page_lang").where((F.col("evidence") >= evidence) & (F.col("prose") < F.col("threshold")))
    return pages.withColumn("reason", reason).where("reason IS NOT NULL")
