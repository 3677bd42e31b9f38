"""Functions paired with their documentation (problem 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.llm.lexer import COMMENTS, STRINGS
from scoria.operators.snapshots import latest_rows
from scoria.plans.runtime import checkpointed

#: A line that holds nothing but an attribute or decorator.
ATTRIBUTE = {
    "java": r"@[\w.]+\s*(?:\(.*\))?\s*", "typescript": r"@[\w.]+\s*(?:\(.*\))?\s*", "javascript": r"@[\w.]+\s*(?:\(.*\))?\s*",
    "csharp": r"\[.*\]\s*", "rust": r"#!?\[.*\]\s*", "python": r"@.*", "go": r"(?!)",
}
DOC_ATTRIBUTE = re.compile(r'#\[doc\s*=\s*(?:r#*)?"((?:[^"\\]|\\.)*)"#*\]')
OPENERS = {"java": "@", "typescript": "@", "javascript": "@", "csharp": "[", "rust": "#", "python": "@"}
#: How an attribute begins that may go on over several lines, up to its bracket's end.
BRACKETED = {language: re.compile(pattern).match for language, pattern in {"java": r"@[\w.]+\s*\(", "typescript": r"@[\w.]+\s*\(", "javascript": r"@[\w.]+\s*\(", "csharp": r"\[", "rust": r"#!?\["}.items()}
DEFINES = re.compile(r"(?:async(?:\s|\\\n)+)?def\b").match


@cache
def _matcher(language: str):
    template = r"`(?:[^`\\]|\\[\s\S])*`" if language in ("javascript", "typescript") else r"(?!)"
    regex = r"(?<=[=(,:\[!&|?{};])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/" if language in ("javascript", "typescript") else r"(?!)"
    plain = r"[\w.,;:=+<>!?|&-]+" if language not in ("python", "rust", "csharp") else r"(?!)"
    # Names and operators in one go; only what can't begin a comment, string or bracket.
    return re.compile(rf"(?P<n>\n)|(?P<w>[ \t\f\r﻿]+)|(?P<c>{COMMENTS[language]})|(?P<s>{STRINGS[language]}|{template})|(?P<r>{regex})|(?P<o>[({{\[])|(?P<e>[)}}\]])|(?P<x>\w+|{plain}|[\s\S])").match


def lexed_rows(language: str, text: str, starts: frozenset[int] | None = None) -> list[tuple]:
    """(line, end_line, kind, delta, braces, text) per lexed stretch of a line, in order.

    kind is comment (alone on its lines), attribute, string (a Python string that stands as a statement) or code; delta
    is the change of depth within the stretch: of brackets, in Python of indentation; braces counts the opening ones.
    Comments after code on the same line have no row; an attribute is one row up to the end of its bracket. Text is kept
    for comments and strings; for code it is null but in Python, where it is 'def' or empty. With `starts`, the lines at
    which something is declared, other stretches of code that change no depth are one row as long as nothing else comes.
    """
    match, n = _matcher(language), len(text)
    rows: list[tuple] = []
    pos, line, python = 0, 1, language == "python"
    start, depth, delta, text_from, first_string, heads, solid = 0, 0, 0, 0, None, None, ""
    indents = [0]
    bracketed, opened = BRACKETED.get(language), 0

    def flush(end_line: int, end: int) -> None:
        nonlocal start, delta, first_string, heads
        if not start:
            return
        raw = text[text_from:end].strip()
        kind, words = "code", None
        opener = OPENERS.get(language)
        if opener and raw.startswith(opener) and re.fullmatch(ATTRIBUTE[language], raw, re.S):
            kind = "attribute"
            found = DOC_ATTRIBUTE.fullmatch(raw) if language == "rust" else None
            if found:
                kind, words = "comment", "/// " + found.group(1).replace("\\n", "\n/// ")
        elif first_string is not None and first_string == raw:
            kind, words = "string", raw
        if python:
            words = words if kind == "string" else "def" if DEFINES(raw) else ""
        braces = 0 if python else raw.count("{")
        if starts is not None and rows and kind == "code" and not delta and not braces and not words and heads is None and start not in starts:
            before = rows[-1]
            if before[2] == "code" and not before[3] and not before[4] and not before[5] and before[0] not in starts:
                rows[-1] = (before[0], end_line, *before[2:])
                start, first_string = 0, None
                return
        rows.append((start, end_line, kind, delta, braces, words))
        if python and kind == "code" and heads is not None:
            rows.append((heads[0], heads[1], "string", 0, 0, heads[2]))
        start, delta, first_string, heads = 0, 0, None, None

    while pos < n:
        m = match(text, pos)
        kind, end = m.lastgroup, m.end()
        if kind == "n":
            if (not python or depth <= 0) and not (start and opened > 0 and bracketed and bracketed(text, text_from)):
                flush(line, pos)
                depth = max(depth, 0) if python else depth
            line += 1
            pos = end
            continue
        if kind == "w":
            pos = end
            continue
        if python and text[pos] == "\\" and text[pos + 1 : pos + 2] == "\n":
            line, pos = line + 1, pos + 2
            continue
        body = m.group()
        breaks = body.count("\n") if kind in "csr" else 0
        if kind == "c":
            if not start:
                rows.append((line, line + breaks, "comment", 0, 0, body))
            line, pos = line + breaks, end
            continue
        if not start:
            start, text_from, delta, opened = line, pos, 0, 0
            if python:
                bol = text.rfind("\n", 0, pos) + 1
                indent = len(text[bol:pos].replace("﻿", "").expandtabs())
                while indents[-1] > indent:
                    indents.pop()
                    delta -= 1
                if indents[-1] < indent:
                    indents.append(indent)
                    delta += 1
            if kind == "s" and python and depth == 0:
                first_string = body
        elif python and kind == "s" and depth == 0 and solid == ":" and heads is None:
            heads = (line, line + breaks, body)
        if kind == "o":
            depth += 1
            delta += 0 if python else 1
            opened += 1 if opened >= 0 else 0
        elif kind == "e":
            depth -= 1
            delta -= 0 if python else 1
            if opened > 0:
                # Below 0 once the first bracket of the row is closed.
                opened = opened - 1 or -1
                if opened < 0 and line > start and bracketed and bracketed(text, text_from):
                    flush(line, end)
                    pos, solid = end, body
                    continue
        if text.startswith(("/*", '"""', "'''"), pos) and kind == "x":
            flush(line, n)
            break
        line += breaks
        pos = end
        solid = body[-1:]
    flush(line, n)
    return rows


#: Words that add nothing to what a name says, metadata tags, and what stands in for documentation.
FILLERS = frozenset("a an the this that these of to for in on with and or by from its it is be as at will does do did performs perform implementation implements implementing method function procedure routine class object helper utility returns return returning takes take taking result results value values given specified some our all new here just simply used using".split())
BARE_TAGS = frozenset("since author version override public private protected internal static final abstract async readonly api category package module namespace memberof ignore hidden inheritdoc export default constructor generated beta alpha experimental todo see link seealso sample ts-ignore ts-expect-error ts-nocheck nullable nonnull suppress suppresswarnings type typedef group".split())
STAND_IN = re.compile(r"(?i)^[\W_]*+(?:todo|fixme|xxx+|tbd|hack|wip|n/?a|none|nothing|undocumented|no (?:docs?|documentation|description|comment)\b.*|docs? (?:pending|missing|needed)|documentation (?:pending|missing|needed|goes here|to follow)|(?:method|function|class)? ?description(?: goes)?(?: here)?|(?:insert|add|write|enter) (?:a |the )?(?:description|docs?|documentation|comment)s?(?: here)?|(?:helper|utility|internal|private|convenience)(?: (?:function|method|class|routine))?|self[- ]explanatory|obvious|placeholder|stub|(?:auto-?)?generated (?:method |function )?stub\b.*|created by (?:the )?ide|inherited|lorem ipsum\b.*|\{@?inheritdoc\}|inheritdoc|ditto|idem|\S+ (?:app|build|bundle))[\W_]*$")
TO_DO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd)\b")
POINTER = re.compile(r"(?i)^\W*(?:see|same as|as above|cf|refer to|compare|siehe|voir|ver|véase)\b\W*+(?:[\w.#()/:@-]++\W*+){0,4}$")
TOOL = re.compile(r"(?i)^\W*(?:nolint|noqa|nosonar|nosec|noinspection|pylint|flake8|ruff|isort|black|mypy|pyright|type: ?ignore|fmt: ?(?:off|on|skip)|yapf|pragma|eslint|tslint|jshint|jslint|prettier|biome|istanbul|c8 ignore|v8 ignore|@ts-|@formatter|checkstyle|spotless|resharper|stylecop|clang-format|rustfmt|clippy|golangci|lint:|go:|\+build|cspell|spell-?checker|sourcery|coverage:|codecov|webpack|@jsx|@flow|region\b|endregion\b|#?(?:end)?region|nullable\b|if\b [A-Z_]+$|endif\b|\{\{\{|\}\}\}|vim:|-\*-|coding[:=])")
LICENCE = re.compile(r"(?i)licen[cs]ed under|all rights reserved|spdx-|copyright\b|\(c\) ?\d{4}|permission is hereby|without warrant|redistribution and use|apache license|mit license|gnu (?:general|lesser)")
RULER = re.compile(r"([\W_]*+)((?:\w+(?:\s\w+)?)?+)([\W_]*+)$")
RULES = frozenset("-=~*#_+<>/.")
CODE = re.compile(r"^(?:[\w.$\[\]]+(?:\s+[\w$]+)?\s*(?::=|[-+*/|&]?=(?!=))\s*\S.*|return\b[^.]*;|return(?: [\w.]+)?|[\w.$:]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?|(?:if|for|while|switch|else|elif|try|catch|def|func|fn|let|var|const)\b.*[{:;]|[})\]]+;?|import .*;?|.*[;{}])$")
PROSE_END = re.compile(r"[.!?。:;]\W*$")
MARKS = re.compile(r"^(?://[/!]?|/\*+!?|\*(?!/)|#+!?)\s?")
TAG = re.compile(r"^(?:[@\\]([\w-]+)|:(\w+)(?:\s+([^:]*))?:|<(\w+)(?:\s[^>]*)?>)\s*(.*)$", re.S)
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
ANY_WORD = re.compile(r"[^\W\d_]+")


def comment_lines(text: str) -> list[str]:
    """The lines of a comment or docstring without its marks."""
    text = re.sub(r"^\s*(?i:[rbuf]{0,2})(\"\"\"|\'\'\'|\"|\')(.*?)\1\s*$", r"\2", text, flags=re.S) if text.lstrip()[:4].strip("rRbBuUfF")[:1] in "\"'" else text
    lines = []
    for raw in text.split("\n"):
        line = MARKS.sub("", raw.strip())
        line = re.sub(r"\s*\*+/\s*$", "", line)
        lines.append(line.strip())
    return lines


def is_ruler(line: str) -> bool:
    """Whether a line is nothing but signs, or at most two words beside a row of them."""
    m = RULER.match(line)
    if not m:
        return False
    lead, words, tail = m.groups()
    if not words:
        return True
    ruled = tail.strip()
    before = lead.rstrip()[-3:]
    return len(before) == 3 and RULES.issuperset(before) and RULES.issuperset(ruled) or not lead and len(ruled) >= 4 and (RULES - {"."}).issuperset(ruled)


def _known(word: str, names: list[str]) -> bool:
    """Whether a word is, but for its ending, one of the names."""
    w = word.lower()
    if w in FILLERS:
        return True
    for n in names:
        k = min(len(w), len(n))
        same = next((i for i in range(k) if w[i] != n[i]), k)
        if same >= max(3, k - 1) and abs(len(w) - len(n)) <= 3 or w == n or same >= 3 and same >= k - 1 and w[same:] in ("s", "es", "ies", "ed", "ing"):
            return True
        if len(n) > 2 and w.startswith(n[:-1]) and w[len(n) - 1 :] in ("ies", "ied", "ying", "es", "ing", "ed"):
            return True
    return False


def _says(text: str, names: list[str]) -> bool:
    """Whether words are left that neither the names nor fillers have."""
    return any(not _known(w, names) for part in ANY_WORD.findall(text) for w in (NAME_WORD.findall(part) or [part]))


def says_something(text: str | None, name: str | None, signature: str | None) -> bool:
    """Whether documentation tells a reader anything that name and signature don't."""
    if not text or not text.strip():
        return False
    names = [w.lower() for w in NAME_WORD.findall(name or "")] + [(name or "").lower()]
    names += [w.lower() for w in NAME_WORD.findall(signature or "")]
    units: list[str] = []
    joined = False
    for line in comment_lines(text):
        if not line:
            joined = False
            continue
        if is_ruler(line) or CODE.match(line) or TOOL.match(line) or STAND_IN.match(line):
            joined = False
            continue
        if joined and not TAG.match(line):
            units[-1] += " " + line
        else:
            units.append(line)
        joined = not PROSE_END.search(line)
    return any(_unit_says(u, names) for u in units)


def _unit_says(unit: str, names: list[str]) -> bool:
    unit = unit.strip()
    m = TAG.match(unit)
    if m:
        at, colon, argument, xml, rest = m.groups()
        if xml:
            if xml.lower() in ("inheritdoc", "see", "seealso"):
                return False
            rest = re.sub(r"<[^>]*>", " ", rest)
            return bool(rest.strip()) and _unit_says(rest.strip(), names)
        tag = (at or colon).lower()
        if tag in BARE_TAGS:
            return False
        if at and tag in ("param", "arg", "argument", "parameter", "throws", "exception", "raises", "property", "prop", "template", "typeparam"):
            rest = re.sub(r"^\s*(?:\{[^}]*\}\s*)?\S+\s*[-:]?\s*", "", rest, count=1)
        elif at:
            rest = re.sub(r"^\s*\{[^}]*\}\s*", "", rest)
        if tag == "deprecated" and len(ANY_WORD.findall(rest)) < 3:
            return False
        return bool(rest.strip()) and not POINTER.match(rest) and not STAND_IN.match(rest) and _says(rest, names + ([w.lower() for w in NAME_WORD.findall(argument)] if argument else []))
    unit = re.sub(r"</?\w+(?:\s[^<>]*)?/?>", " ", unit).strip()
    if not unit or TO_DO.match(unit) or TOOL.match(unit) or LICENCE.search(unit) or STAND_IN.match(unit) or POINTER.match(unit) or is_ruler(unit) or CODE.match(unit) or re.fullmatch(r"\{@?\w+\}", unit):
        return False
    return _says(unit, names)


ROWS = "file_id string, pos int, line int, end_line int, kind string, delta int, braces int, text string, leads boolean, declared boolean"


def telling_rows(rows: list[tuple], starts: frozenset[int], python: bool) -> Iterator[tuple]:
    """(pos, row, leads, declared) of the lexed rows that comments, bodies or docstrings can depend on.

    leads: code right behind a comment or attribute; declared: code at a line where something is declared. Code that
    neither leads nor is declared, changes no depth, and stands beside no such row decides nothing.
    """
    code = [i for i, r in enumerate(rows) if r[2] in ("code", "string")]
    needed = set(code[-1:])
    for k, i in enumerate(code):
        if rows[i][3] or rows[i][2] == "string" or rows[i][0] in starts:
            needed.add(i)
            if python and rows[i][3] < 0 and k:
                needed.add(code[k - 1])
            if rows[i][0] in starts and k + 1 < len(code):
                needed.add(code[k + 1])
    for i, r in enumerate(rows):
        leads = r[2] == "code" and i > 0 and rows[i - 1][2] in ("comment", "attribute")
        if leads or i in needed or r[2] not in ("code", "string"):
            yield i, r, leads, r[2] == "code" and r[0] in starts


def lexed_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """ROWS of every file whose language has comments, those that tell something; the last delivered row of a file counts."""
    one = latest_rows(files.where(F.col("file_id").isNotNull()), ["file_id"], "delivered_at", ["source_text"])
    declared = F.flatten(F.collect_list(F.transform("symbols", lambda x: x["start_line"])))
    languages = expected.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max("language").alias("language"), declared.alias("starts"))
    inputs = one.join(languages, "file_id").where(F.col("language").isin(list(ATTRIBUTE)) & F.col("source_text").isNotNull()).select("file_id", "language", "source_text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *[pa.int32()] * 3, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        names = [f.split()[0] for f in ROWS.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for file_id, language, text, starts in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                at = frozenset(starts)
                out += [(file_id, i, *r, leads, declared) for i, r, leads, declared in telling_rows(lexed_rows(language, text, at), at, language == "python")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return inputs.mapInArrow(run, ROWS)


def declarations(expected: DataFrame) -> DataFrame:
    """(file_id, start_line, name, signature): one row per line on which functions or methods are declared; of several on one line the first by name."""
    s = expected.where(F.col("file_id").isNotNull()).select("file_id", F.explode("symbols").alias("s")).where(F.col("s.kind").isin("function", "method") & F.col("s.start_line").isNotNull())
    return s.groupBy("file_id", F.col("s.start_line").alias("start_line")).agg(F.min(F.struct("s.name", "s.signature")).alias("x")).select("file_id", "start_line", "x.name", "x.signature")


def comments_above(rows: DataFrame) -> DataFrame:
    """(file_id, start_line, comment): the comment at each line of code that has one.

    Islands are runs of lines of one kind without a gap. The comment island that ends right above a code island, or
    above the attributes right above it, belongs to the island's first line; lag windows over islands find it.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    same = (F.lag("kind").over(w) == F.col("kind")) & (F.col("line") <= F.lag("end_line").over(w) + 1)
    some = rows.where(F.col("kind").isin("comment", "attribute") | F.col("leads")).select("file_id", "pos", "line", "end_line", "kind", F.when(F.col("kind") == "comment", F.col("text")).alias("text"))
    numbered = some.withColumn("gap", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("gap").over(w))
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "comment", F.struct("pos", "text"))))
    islands = numbered.groupBy("file_id", "island", "kind").agg(F.min("line").alias("first"), F.max("end_line").alias("last"), F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"))
    v = Window.partitionBy("file_id").orderBy("island")
    back = lambda c, n: F.lag(c, n).over(v)
    touching = [back("last", 1) == F.col("first") - 1, back("last", 2) == back("first", 1) - 1, back("last", 3) == back("first", 2) - 1]
    comment, attribute = [back("kind", n) == "comment" for n in (1, 2, 3)], [back("kind", n) == "attribute" for n in (1, 2)]
    near = F.when(touching[0] & comment[0], back("text", 1))
    # An attribute over several lines may end on the declaration's own line.
    beyond = F.when((touching[0] | (back("last", 1) == F.col("first"))) & attribute[0] & touching[1] & comment[1], back("text", 2)).when(touching[0] & comment[0] & touching[1] & attribute[1] & touching[2] & comment[2], back("text", 3))
    return islands.select("file_id", F.col("first").alias("start_line"), "kind", F.concat_ws("\n", beyond, near).alias("comment")).where((F.col("kind") == "code") & (F.col("comment") != "")).drop("kind")


def bodies(rows: DataFrame) -> DataFrame:
    """(file_id, start_line, end_line, docstring) of what each declared line of code opens.

    A body goes up to the row at which the depth, summed up over the file, falls back to that before the line: the
    nearest later row that closes the same level, found by one window per file and level. The docstring is the Python
    string that stands as a statement right behind a `def` row, inside its body.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    code = rows.where(F.col("kind").isin("code", "string")).select("file_id", "pos", "line", "end_line", "kind", "delta", "braces", "declared", F.when(F.col("kind") == "string", F.col("text")).alias("string"), F.when(F.col("kind") == "code", F.col("text")).alias("head"))
    # Rows without a level of their own are gone after the explode below, so the file's last line is told here.
    deep = code.withColumns({"last_line": F.max("end_line").over(Window.partitionBy("file_id")), "after": F.sum("delta").over(w), "next_delta": F.lead("delta").over(w), "previous_end": F.lag("end_line").over(w), "next_string": F.when(F.lead("kind").over(w) == "string", F.lead("string").over(w))})
    deep = deep.withColumn("before", F.col("after") - F.col("delta"))
    python = F.col("head").isNotNull() | F.col("string").isNotNull()
    # A Python row that steps back ends the blocks before it: they close on the line of the row before.
    close = F.when(python, F.col("previous_end")).otherwise(F.col("end_line"))
    closes = F.when(F.col("delta") < 0, F.transform(F.sequence("after", F.col("before") - 1), lambda level: F.struct(level.alias("level"), close.alias("close")))).otherwise(F.array().cast("array<struct<level: bigint, close: int>>"))
    opens = F.when(F.col("declared"), F.array(F.struct(F.when(python, F.col("after")).otherwise(F.col("before")).alias("level"), F.lit(None).cast("int").alias("close")))).otherwise(F.array().cast("array<struct<level: bigint, close: int>>"))
    inline = F.when(python, F.coalesce("next_delta", F.lit(0)) <= 0).otherwise((F.col("delta") == 0) & (F.col("braces") > 0))
    docstring = F.when(F.col("head") == "def", F.col("next_string"))
    levels = deep.select("file_id", "pos", F.col("line").alias("start_line"), F.col("end_line").alias("own_end"), inline.alias("inline"), docstring.alias("docstring"), "last_line", F.explode(F.concat(closes, opens)).alias("x")).select("*", "x.level", "x.close").drop("x")
    behind = Window.partitionBy("file_id", "level").orderBy(F.col("pos").desc(), F.col("close").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # In falling order the last close seen is the nearest one behind; what a row closes itself comes after what it opens.
    found = levels.withColumn("found", F.last("close", ignorenulls=True).over(behind)).where(F.col("close").isNull())
    return found.select("file_id", "start_line", F.when(F.col("inline"), F.col("own_end")).otherwise(F.greatest("own_end", F.coalesce("found", "last_line"))).alias("end_line"), "docstring")


def documented(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(file_id, start_line, end_line, name, signature, documentation) of the functions and methods whose documentation says something.

    The lexed rows are written once; depth windows delimit what each declaration opens, lag windows attach the comment
    above it, and a docstring belongs to it if it stands inside. Defined cases: null texts, unknown languages, JSON and
    files without an expected row have none; null or empty symbols have none; rows delivered repeatedly count once; a
    declaration line without code on it or beyond the text's end has none; any kind of line end and a byte order mark
    are taken. Kept docstrings of `expected` aren't trusted or read.
    """
    rows = checkpointed(lexed_files(files, expected))
    spans = declarations(expected).join(bodies(rows).groupBy("file_id", "start_line").agg(F.max(F.struct("end_line", "docstring")).alias("b")), ["file_id", "start_line"])
    pairs = spans.join(comments_above(rows), ["file_id", "start_line"], "left").select("file_id", "start_line", "b.end_line", "name", "signature", "comment", "b.docstring").where("comment IS NOT NULL OR docstring IS NOT NULL")
    schema = "file_id string, start_line int, end_line int, name string, signature string, documentation string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, signatures, *parts = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            keep = pa.array([says_something(a, n, s) or says_something(b, n, s) for n, s, a, b in zip(names, signatures, *parts, strict=True)], pa.bool_())
            texts = pa.array(["\n\n".join(x for x in both if x) for both in zip(*parts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(keep) for i in range(5)], texts.filter(keep)], names=[f.split()[0] for f in schema.split(", ")])

    return pairs.mapInArrow(run, schema)


def code_pairs(files: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of documented() with the code from declaration to the end of the body."""
    one = latest_rows(files.where(F.col("file_id").isNotNull()), ["file_id"], "delivered_at", ["source_text"])
    lines = F.split(F.regexp_replace("source_text", r"\r\n?", "\n"), "\n")
    return documented(files, expected).join(one, "file_id").select("file_id", "start_line", "end_line", "name", "signature", F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("code"), "documentation")
