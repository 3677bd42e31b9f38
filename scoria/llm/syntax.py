"""Source files that do not parse (problem 4)."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.llm.chart import Grammar
from scoria.llm.grammars import FIRST_ITEMS, LAST_ITEMS, LISTS, SEMICOLON_LISTS, SEQUENCES, TOPS, WHOLES, grammar
from scoria.llm.lexer import BINARY, CLOSERS, LANGUAGES, OPERATORS, RUN, SAME, lex, tables
from scoria.operators.snapshots import latest_rows

#: What may come after a bracket in braces so that the statement goes on.
CONTINUES = frozenset(["else", "catch", "finally", "while", "~while", "op", "pm", "*", "&", "<", ">", "=", "asg", "?", ":", ".", ",", ";", "=>", "?.", "as", "~as", "in", "instanceof", "is", "inc", "where", "~where", "from", "~from", "!", "~get", "~set", "->"])
HEADS = frozenset(["if", "for", "switch"])
#: The classes of brackets, and the kinds of token that they make with their contents.
BRACKETS, KINDS = frozenset("()[]{}"), {"(": "P", "[": "B", "{": "C"}
#: How the lines begin that a merge leaves.
MARKS = frozenset(c * 7 for c in "<=>|")
#: A repetition counts as so many copies at most when a stretch is matched: no rule of the grammars counts further.
COPIES, PERIODS = 3, (1, 2, 3, 4)
#: Shorter stretches are matched as quickly as they are condensed.
WORTH = 48


def condensed(part: tuple) -> tuple:
    """A stretch in which no run of up to four tokens comes more than three times in a row.

    It derives from a nonterminal if and only if the stretch as it is does; chains of operators, calls and else-ifs of
    any length become short. Costs are never taken from it.
    """
    if len(part) < WORTH:
        return part
    out: list = []
    for t in part:
        out.append(t)
        for p in PERIODS:
            if len(out) > COPIES * p and t == out[-1 - p] and t == out[-1 - COPIES * p] and out[-COPIES * p :] == out[-(COPIES + 1) * p : -p]:
                del out[-p:]
                break
    return tuple(out) if len(out) < len(part) else part


def _chunks(tokens: list, ends: frozenset[str], headers: bool = False) -> Iterator[tuple[int, int]]:
    """Stretches that end with a separator, or with braces after which nothing goes on.

    With headers, as in Go, a semicolon between a keyword like `if` and its braces ends nothing.
    """
    start, header = 0, False
    for i, t in enumerate(tokens):
        following = tokens[i + 1] if i + 1 < len(tokens) else None
        if isinstance(t, str):
            header = headers and (t in HEADS or header)
            cut = t in ends and not header and following != "else" and not (following == "while" and tokens[start] == "do")
        else:
            header = header and t[0] != "C"
            cut = t[0] == "C" and following is not None and not (isinstance(following, str) and following in CONTINUES) and not (not isinstance(following, str) and following[0] in "PB")
        if cut:
            yield start, i + 1
            start = i + 1
    if start < len(tokens):
        yield start, len(tokens)


class Repair(NamedTuple):
    """Cost, lines to edit, whether the text breaks off at its end, lines of brackets that close nothing, and whether a merge left its markers."""

    cost: int
    spots: list[int]
    open_end: bool
    loose: list[int]
    conflict: bool


class Checker:
    """Repair costs of one language's token lists, each distinct stretch being parsed once."""

    def __init__(self, language: str):
        self.language, self.grammar = language, grammar(language)
        self.everything = frozenset([label for lists in LISTS[language].values() for label, _ in lists] + [label for label, _ in SEQUENCES[language]] + [x for xs in WHOLES[language].values() for x in xs] + ["Empty"])
        self.semicolons, self.headers = language in ("javascript", "typescript", "go"), language == "go"
        firsts, lasts = FIRST_ITEMS.get(language, {}), LAST_ITEMS.get(language, {})
        #: Per sequence its label, what its first stretch, those between and its last one must derive from, and what ends one.
        self.sequences = [(label, firsts.get(label), item + "*", lasts.get(label), frozenset(";,") if label == "Arms" else frozenset(";")) for label, item in SEQUENCES[language]]
        wholes = {x for xs in WHOLES[language].values() for x in xs}
        self.of_empty = self.everything - wholes if language != "python" else frozenset(["Empty", "Args", "Params"])
        self.seen: dict = {}
        self.known: dict[tuple, dict[str, bool]] = {}
        self.types: dict[str, int] = {}

    def _closed(self, tokens: tuple) -> tuple:
        """The last statement before a closing brace may lack its semicolon in some languages."""
        return (*tokens, ";") if self.semicolons and tokens and tokens[-1] != ";" else tokens

    def derives(self, item: str, part: tuple) -> bool:
        """Whether a stretch derives from an item without any edit."""
        known = self.known.get(part)
        if known is None:
            if len(self.known) > 100_000:
                self.known.clear()
            known = self.known[part] = {}
        found = known.get(item)
        if found is None:
            found = self.grammar.can_begin(item, part)
            if found:
                short = condensed(part)
                # Only what several stretches come down to is worth keeping twice.
                found = self.grammar._earley(item, part) if short is part else self.grammar.matches(item, short)
            known[item] = found
        return found

    def pieces(self, sequence: tuple, tokens: list) -> Iterator[tuple[str, int, int]]:
        """The stretches of a sequence with the nonterminal that each must derive from; the first and last may have their own."""
        _, first, item, last, ends = sequence
        for a, b in _chunks(tokens, ends, self.headers):
            yield first if first and not a else last if last and b == len(tokens) else item, a, b

    def fits_all(self, sequence: tuple, parts: list[tuple]) -> bool:
        """Whether all stretches of a sequence derive from what they must."""
        _, first, item, last, _ = sequence
        end = len(parts) - 1
        for k, part in enumerate(parts):
            what = first if first and not k else last if last and k == end else item
            if not self.derives(what, part) and not (self.semicolons and part[-1] != ";" and self.derives(what, (*part, ";"))):
                return False
        return True

    def separated(self, item: str, tokens: list) -> bool:
        """Whether the tokens are items with one semicolon between each two."""
        at = 0
        for i in [*(i for i, t in enumerate(tokens) if t == ";"), len(tokens)]:
            if not self.derives(item, tuple(tokens[at:i])):
                return False
            at = i + 1
        return True

    def faults(self, types: str) -> int:
        """Edits that a list of types in angle brackets needs; none may be written at all in some places."""
        if types not in self.types:
            if len(self.types) > 100_000:
                self.types.clear()
            classes, lines, errors = lex(self.language, types, self.faults)
            cost, tokens, _, _ = self.brackets(classes, lines, [], [])
            parts, at = [], 0
            for i in [*(i for i, t in enumerate(tokens) if t == ","), len(tokens)]:
                parts.append(tuple(tokens[at:i]))
                at = i + 1
            if any(parts) and self.language in ("rust", "typescript") and not parts[-1]:
                parts.pop()
            blank = not any(parts) and (self.language != "typescript")
            self.types[types] = cost + len(errors) + (0 if blank else sum(0 if self.derives("TA", p) else self.grammar.cost("TA", p) for p in parts))
        return self.types[types]

    def labels(self, kind: str, tokens: list) -> frozenset[str]:
        """The nonterminals that the contents of a bracket derive from."""
        if not tokens:
            return self.of_empty
        key = (kind, *tokens)
        result = self.seen.get(key)
        if result is not None:
            return result
        found = set()
        parts, at = [], 0
        plain = tokens[:-1] if tokens[-1] == ";" and self.semicolons else tokens
        for i, t in enumerate(plain):
            if t == ",":
                parts.append(tuple(plain[at:i]))
                at = i + 1
        rest = tuple(plain[at:])
        parts += [rest] if rest else []
        for label, item in LISTS[self.language].get(kind, ()):
            if self.language == "json" and not rest:
                continue
            if all(self.derives(item, p) if p else self.semicolons and kind == "B" for p in parts):
                found.add(label)
        for label in WHOLES[self.language].get(kind, ()):
            item = SEMICOLON_LISTS.get(self.language, {}).get(label)
            if self.separated(item, plain) if item else self.derives(label, tuple(tokens)) or plain is not tokens and self.derives(label, tuple(plain)):
                found.add(label)
        if kind == "C":
            stretches: dict[frozenset[str], list[tuple]] = {}
            for sequence in self.sequences:
                ends = sequence[-1]
                if ends not in stretches:
                    stretches[ends] = [tuple(tokens[a:b]) for a, b in _chunks(tokens, ends, self.headers)]
                if self.fits_all(sequence, stretches[ends]):
                    found.add(sequence[0])
        result = frozenset(found)
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen[key] = result
        return result

    def repair(self, kind: str, tokens: list, lines: list[int], spots: list[int]) -> int:
        """The least cost of making contents fit; the lines of the stretches to edit are added to spots."""
        options: list[tuple] = [("", None, item, None, frozenset(",")) for _, item in LISTS[self.language].get(kind, ())]
        if kind == "C":
            options += self.sequences
        tried = []
        for option in options:
            bad = []
            commas = not option[0]
            for what, a, b in self.pieces(option, tokens):
                part = tuple(x for x in tokens[a:b] if x != ",") if commas and tokens[b - 1] == "," else tuple(tokens[a:b])
                if part and not self.derives(what, part) and not self.derives(what, self._closed(part)):
                    bad.append((what, part, lines[a]))
            tried.append(bad)
        if not tried:
            # The language has no such bracket: it is dropped with its contents, as one token.
            return 1
        # Each bad stretch needs an edit at least: once an option has as many as the best one costs, none can be better.
        least, found = 1 << 30, []
        for bad in sorted(tried, key=len):
            if len(bad) >= least:
                break
            total = 0
            for k, (what, part, _) in enumerate(bad):
                others = total + len(bad) - k - 1
                total += self.cost(what, part, least - others)
                if total + len(bad) - k - 1 >= least:
                    break
            else:
                least, found = total, bad
        spots += [at for _, _, at in found]
        return max(1, least)

    def cost(self, item: str, part: tuple, below: int = 1 << 30) -> int:
        least = self.grammar.cost(item, part, below)
        closed = self._closed(part)
        return least if closed is part else min(least, self.grammar.cost(item, closed, least))

    def brackets(self, classes: list[str], lines: list[int], spots: list[int], loose: list[int]) -> tuple[int, list, list[int], int]:
        """Cost, tokens and lines of the outermost level with brackets folded, and the number still open at the end.

        A closer that fits an outer bracket ends those inside it at one insertion each; one that fits none is dropped and
        its line added to loose.
        """
        cost, stack = 0, []
        tokens: list = []
        at: list[int] = []

        def close() -> None:
            nonlocal tokens, at, cost
            kind = KINDS[stack[-1][0]]
            labels = self.labels(kind, tokens)
            if not labels:
                cost += self.repair(kind, tokens, at, spots)
                labels = self.everything
            _, outer, outer_at, line = stack.pop()
            outer.append((kind, labels))
            outer_at.append(line)
            tokens, at = outer, outer_at

        for c, line in zip(classes, lines, strict=True):
            if c not in BRACKETS:
                tokens.append(c)
                at.append(line)
            elif c in CLOSERS:
                stack.append((c, tokens, at, line))
                tokens, at = [], []
            elif stack and CLOSERS[stack[-1][0]] == c:
                close()
            else:
                fit = next((k for k in range(len(stack) - 1, -1, -1) if CLOSERS[stack[k][0]] == c), None)
                if fit is None:
                    cost += 1
                    spots.append(line)
                    loose.append(line)
                    continue
                while len(stack) > fit + 1:
                    cost += 1
                    spots.append(line)
                    close()
                close()
        unclosed = len(stack)
        while stack:
            cost += 1
            spots.append(lines[-1])
            close()
        return cost, tokens, at, unclosed

    def check(self, text: str) -> Repair:
        if self.language == "python":
            return self._python(text)
        classes, lines, errors = lex(self.language, text, self.faults)
        spots = [line for line, _ in errors]
        loose: list[int] = []
        cost, tokens, at, unclosed = self.brackets(classes, lines, spots, loose)
        cost += len(errors)
        start = TOPS[self.language]
        whole = [(start, 0, len(tokens))] if self.language == "json" else [(start + "*", a, b) for a, b in _chunks(tokens, frozenset(";"), self.headers)]
        for what, a, b in whole:
            part = tuple(tokens[a:b])
            if not self.derives(what, part) and not self.derives(what, self._closed(part)):
                cost += self.cost(what, part)
                spots.append(at[a] if at else 1)
        return Repair(cost, spots, unclosed > 0 or any(what == "unterminated" for _, what in errors), loose, any(what == "conflict" for _, what in errors))

    def _python(self, text: str) -> Repair:
        """Logical lines are parsed one by one; indentation must open after each head and close to an outer level, and
        mean the same whatever the width of a tab."""
        classes, lines, starts, indents, errors = _python_lines(text)
        loose: list[int] = []
        spots = [line for line, _ in errors]
        cost, open_end = len(errors), any(what == "unterminated" for _, what in errors)
        levels, narrow, expect, before = [0], [0], False, {}
        for tokens, at, start, (indent, thin) in zip(classes, lines, starts, indents, strict=True):
            c, folded, _, unclosed = self.brackets(tokens, at, spots, loose)
            open_end |= unclosed > 0
            part = tuple(folded)
            if not self.derives("Line", part):
                c += self.cost("Line", part)
                spots.append(start)
            if indent > levels[-1]:
                if not expect:
                    c += 1
                    spots.append(start)
                if thin <= narrow[-1]:
                    c += 1
                    spots.append(start)
                levels.append(indent)
                narrow.append(thin)
                before.pop(indent, None)
            else:
                if expect:
                    c += 1
                    spots.append(start)
                while levels[-1] > indent:
                    before.pop(levels.pop(), None)
                    narrow.pop()
                if levels[-1] != indent:
                    levels.append(indent)
                    narrow.append(-1)
                if narrow[-1] != thin:
                    c += 1
                    spots.append(start)
                    narrow[-1] = thin
            first = tokens[1] if tokens[0] == "async" and len(tokens) > 1 else tokens[0]
            allowed = {"else": ("if", "elif", "for", "while", "try", "except"), "elif": ("if", "elif"), "except": ("try", "except"), "finally": ("try", "except", "else")}
            prior = before.get(indent)
            if first in allowed and prior not in allowed[first] or prior == "try" and first not in ("except", "finally") or prior == "@" and first not in ("@", "def", "class"):
                c += 1
                spots.append(start)
            before[indent] = first
            expect = part[-1:] == (":",)
            cost += c
        if expect or "@" in before.values() or "try" in before.values():
            cost, open_end = cost + 1, True
            spots.append(starts[-1])
        return Repair(cost, spots, open_end, loose, any(what == "conflict" for _, what in errors))


@cache
def _python_operators() -> dict[str, str]:
    """Operators with their classes in Python; those of other languages are foreign words."""
    foreign = {"!", "?", "#", "::", "=>", "&&", "||", "===", "!==", "<=>", "??", "?.", "<-"}
    return {op: OPERATORS.get(op, "op") for op in [*OPERATORS, *BINARY]} | {"**": "**", "++": "pm", "--": "pm", "/": "/"} | dict.fromkeys(foreign, "kw")


def _python_lines(text: str) -> tuple[list, list, list, list, list]:
    """Classes and lines of each logical line, where it starts and how far it is indented, at tabs of eight and of one;
    lexical errors as lex() has them."""
    match, words, _ = tables("python")
    operators = _python_operators()
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    tokens: list[str] = []
    at: list[int] = []
    pos, n, line, depth, begin, indent = 0, len(text), 1, 0, True, (0, 0)

    def end() -> None:
        nonlocal tokens, at
        if tokens:
            out[0].append(tokens)
            out[1].append(at)
            out[2].append(at[0])
            out[3].append(indent)
        tokens, at = [], []

    while pos < n:
        if begin and not tokens:
            stop = pos
            while stop < n and text[stop] in " \t\f﻿":
                stop += 1
            blanks = text[pos:stop].replace("﻿", "")
            indent, begin = (len(blanks.expandtabs()), len(blanks)), False
            if text[stop : stop + 7] not in MARKS:
                pos = stop
        m = match(text, pos)
        kind = m.lastgroup if m else None
        if m:
            pos, past = m.span(kind)
            kind = SAME.get(kind, kind)
        else:
            past = pos
            while pos < n and text[pos] in " \t\f\r\ufeff":
                pos += 1
            if pos == n:
                break
        if kind == "c":
            pos = past
            continue
        if kind == "g":
            # A line that a merge left isn't part of any logical line.
            out[4].append((line, "conflict"))
            pos = past
            continue
        if kind == "n":
            pos, line = pos + 1, line + 1
            if depth <= 0:
                end()
                begin, depth = True, 0
            continue
        if kind == "i":
            cls = words.get(text[pos:past], "i")
            if tokens and (tokens[-1], cls) in (("not", "in"), ("is", "not")):
                tokens[-1] = "not in" if cls == "in" else "is not"
            else:
                tokens.append(cls)
                at.append(line)
            pos = past
            continue
        if text[pos] == "\\" and text[pos + 1 : pos + 3].lstrip("\r").startswith("\n"):
            pos, line = text.index("\n", pos) + 1, line + 1
            continue
        if kind is None or kind == "o" and text[pos] in "\"'\\$`":
            out[4].append((line, "unterminated" if text[pos] in "\"'" else "character"))
            stop = n if text.startswith(('"""', "'''"), pos) else text.find("\n", pos)
            stop = n if stop < 0 else stop if text[pos] in "\"'" else max(pos + 1, RUN(text, pos).end() if text[pos].isdigit() else 0)
            line += text.count("\n", pos, stop)
            pos = stop
            continue
        if kind == "o":
            word = text[pos:past]
            cls = operators.get(word, "op")
            depth += (word in "([{") - (word in ")]}") if len(word) == 1 else 0
        else:
            cls = "v"
        tokens.append(cls)
        at.append(line)
        if kind == "s":
            line += text.count("\n", pos, past)
        pos = past
    end()
    return out


@cache
def checker(language: str) -> Checker:
    return Checker(language)


def own_parser(language: str, text: str) -> int | None:
    """0 if the language's parser in the standard library takes the text, the line of its complaint if it doesn't, None
    if there is no parser or it gives up."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            json.loads(text, parse_constant=lambda _: 1 / 0)
        else:
            return None
    except (RecursionError, MemoryError):
        return None
    except SyntaxError as e:
        return e.lineno or 1
    except (ValueError, ZeroDivisionError) as e:
        return getattr(e, "lineno", 1)
    return 0


def check_file(language: str | None, text: str | None) -> tuple[int, str | None, list[int]]:
    """Repair cost (0 for a valid file), kind of damage, and the lines to edit.

    A null text or an unknown language has no cost; an empty text is valid outside JSON.
    """
    language = (language or "").strip().lower()
    if text is None or language not in LANGUAGES:
        return 0, None, []
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        return int(language == "json"), "truncated" if language == "json" else None, []
    # The chart is laxer or stricter than the language in some places; where its own parser is at hand, that decides.
    exact = own_parser(language, text)
    if exact == 0:
        return 0, None, []
    r = checker(language).check(text)
    cost = r.cost
    if exact is None and not cost:
        return 0, None, []
    if exact and not cost:
        cost, r = 1, Repair(1, [exact], False, [], False)
    total = text.count("\n") + 1
    edits = sorted(set(r.spots))
    if r.conflict:
        kind = "conflict"
    elif len(edits) >= 4 and len(edits) * 8 >= total or len(edits) > 1 and edits[0] <= 2 and not r.open_end and not r.loose:
        kind = "mismatch"
    elif r.open_end or r.loose and edits[0] <= 2 and r.loose[0] > edits[0]:
        # Broken off at the end, or at the beginning, so that brackets close further down that nothing opens.
        kind = "truncated"
    else:
        kind = "other"
    return cost, kind, edits


def _inputs(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(file_id, repo, language, text): the last delivered row of each file with the language it is to be read as."""
    one = latest_rows(files.where(F.col("file_id").isNotNull()), ["file_id"], "delivered_at", ["repo", "source_text"])
    languages = expected.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max("language").alias("language"))
    return one.join(languages, "file_id").select("file_id", "repo", "language", F.col("source_text").alias("text"))


def syntax_costs(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(file_id, repo, language, cost, damage, edits), one row per file that has a text.

    cost is the least number of tokens to insert, drop or replace, found by error-correcting chart parsing bracket by
    bracket and statement by statement, a bracket with its contents being one token outside it; 0 means valid. damage
    tells truncation, merge conflict, wrong language and other faults apart by where the edits are. For Python and JSON
    the standard library's parser has the last word whether a file is valid; one it alone rejects costs 1.

    Defined cases: a null text is no case and gives no row; a null or unknown language costs 0; an empty text is valid
    outside JSON; byte order marks and any kind of line end are no fault; files delivered repeatedly count once; a file
    without an expected row gives none. Texts are read whole. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check_file(lang, text) for lang, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int32()))], names=["file_id", "repo", "language", "cost", "damage", "edits"])

    return _inputs(files, expected).where(F.col("text").isNotNull()).mapInArrow(run, "file_id string, repo string, language string, cost int, damage string, edits array<int>")


def syntax_rates(costs: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) over the files with a text."""
    bad = F.sum((F.col("cost") > 0).cast("long"))
    return costs.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
