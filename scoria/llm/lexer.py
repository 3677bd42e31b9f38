"""Lexing of source files into token classes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from scoria.llm.grammars import GRAMMARS, grammar

LANGUAGES = frozenset(GRAMMARS)

#: Each language's reserved words, its words reserved only in some places, and its modifiers.
RESERVED = {
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp switch synchronized throw throws transient try volatile while",
    "csharp": "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw try typeof unchecked unsafe using virtual volatile while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while",
    "javascript": "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with let yield static package private protected public interface implements",
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "json": "",
}
RESERVED["typescript"] = RESERVED["javascript"]
IN_PLACES = {
    "java": "record permits yield sealed",
    "csharp": "await get set where when record yield not global async partial file required",
    "go": "", "rust": "union default", "python": "match case type _", "json": "",
    "javascript": "async await get set of from as static let yield package private protected public interface implements",
    "typescript": "async await get set of from as static let yield package private protected public interface implements type declare readonly abstract override namespace module keyof unique is asserts satisfies infer",
}
MODIFIERS = {
    "java": "public private protected static final abstract native synchronized transient volatile strictfp sealed",
    "csharp": "public private protected internal static readonly sealed abstract virtual override extern unsafe volatile const out params in async partial file required explicit implicit",
    "typescript": "public private protected abstract override",
}
#: Reserved words that stand like a name or like another word.
ALIKE = {"csharp": {"base": "i", "typeof": "i", "sizeof": "i", "unchecked": "checked"}}
LITERAL_WORDS = {"java": "true false null", "csharp": "true false null", "javascript": "true false null", "typescript": "true false null", "rust": "true false", "python": "True False None", "go": ""}

DOUBLE, SINGLE, BACK = r'"[^"\\\n]*(?:\\(?:\r\n|[\s\S])[^"\\\n]*)*"', r"'[^'\\\n]*(?:\\(?:\r\n|[\s\S])[^'\\\n]*)*'", r"`[^`]*`"
CHAR = r"'(?:[^'\\\n]|\\(?:[^u]|u\{?[0-9A-Fa-f]+\}?)[0-9a-fA-F]*)'"
SLASHES, STARS = r"//[^\n]*", r"/\*[\s\S]*?\*/"
DIGITS = r"\d(?:_?\d|_(?=_))*"
#: How each language writes numbers. Longer runs of letters and digits are no number.
EXPONENT = rf"(?:[eE][+-]?{DIGITS})?"
#: A decimal number; a point without digits after it needs other than a name or point to follow.
DECIMAL = rf"(?:{DIGITS}(?:\.(?![.\w])|\.{DIGITS})?|\.{DIGITS}){EXPONENT}"
NUMBERS = {
    "java": rf"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|{DECIMAL}[lLfFdD]?",
    "csharp": rf"0[xX][\da-fA-F_]+[uUlL]{{0,2}}|0[bB][01_]+[uUlL]{{0,2}}|{DECIMAL}(?:[fFdDmM]|[uUlL]{{1,2}})?",
    "go": rf"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:{DIGITS}(?:\.(?!\.)(?:{DIGITS})?)?|\.{DIGITS}){EXPONENT}i?",
    "rust": rf"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?",
    "javascript": rf"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:0|[1-9](?:_?\d)*)n|{DECIMAL}",
    "python": rf"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:{DIGITS}\.(?:{DIGITS})?|{DIGITS}|\.{DIGITS})(?:[eE][+-]?{DIGITS})?[jJ]?",
    "json": r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?",
}
NUMBERS["typescript"] = NUMBERS["javascript"]
OPERATOR = r">>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|\.\.\.|\.\.=|===|!==|<=>|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||\?\?|->|=>|::|:=|<-|\+\+|--|\.\.|\?\.(?!\d)|\*\*|<<|//|[^\w\s]"
COMMENTS = {
    "java": f"{SLASHES}|{STARS}", "csharp": rf"{SLASHES}|{STARS}|(?m:^[ \t]*#[^\n]*)", "go": f"{SLASHES}|{STARS}", "rust": rf"{SLASHES}|{STARS}",
    "javascript": f"{SLASHES}|{STARS}", "typescript": f"{SLASHES}|{STARS}", "python": r"#[^\n]*", "json": r"(?!)",
}
STRINGS = {
    "java": rf'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{DOUBLE}|{CHAR}',
    "csharp": rf'\$*"""(?:[^"]|"(?!""))*"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?{DOUBLE}|{CHAR}',
    "go": rf"{DOUBLE}|{BACK}|{CHAR}",
    "rust": rf'b?r(?P<h>#*)"[\s\S]*?"(?P=h)|b?"(?:[^"\\]|\\[\s\S])*"|b?{CHAR}',
    "javascript": rf"{DOUBLE}|{SINGLE}", "typescript": rf"{DOUBLE}|{SINGLE}",
    "python": r"(?i:[rbuft]{0,2})(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')",
    "json": r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"',
}
WORDS = {"java": r"[^\W\d][\w]*|[$_][\w$]*", "csharp": r"@?[^\W\d]\w*", "go": r"[^\W\d]\w*", "rust": r"(?:r#)?[^\W\d]\w*", "javascript": r"[#@]?[^\W\d][\w$]*|#?\$[\w$]*", "python": r"[^\W\d]\w*", "json": r"[^\W\d]\w*"}
WORDS["javascript"] = r"#?(?:[^\W\d]|\$)[\w$]*"
WORDS["typescript"] = WORDS["javascript"]
#: Most words, which are tried first: those that nothing precedes or follows which could make them part of something else.
PLAIN_WORDS = {language: r"(?>[^\W\d]\w*)" for language in ("java", "csharp", "go", "json")} | {language: r"(?>(?:[^\W\d]|\$)[\w$]*)" for language in ("javascript", "typescript")} | {language: r"(?>[^\W\d]\w*)(?![\"'#])" for language in ("rust", "python")}
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
LIFETIME, BARS = re.compile(r"'[^\W\d]\w*(?!')").match, re.compile(r"\|[^|\n;{]*\|").match
RUN = re.compile(r"\w+").match
#: What follows a comparison, not a list of types, in TypeScript.
COMPARED = re.compile(r"\s*(?!(?:extends|implements|as|satisfies|in|of|is|from)\b)[\w$\"'-]").match
CLOSERS = {"(": ")", "[": "]", "{": "}"}
#: Classes of operators; those not named are binary ones.
OPERATORS = {o: o for o in "* & < > ! ~ ? : . , ; @ # = ( ) [ ] { } -> => :: ... .. ?. :=".split()} | {"+": "pm", "-": "pm", "++": "inc", "--": "inc", "..=": "..", "<-": "arrow"} | {o: "asg" for o in ">>>= <<= >>= **= &&= ||= ??= += -= *= /= %= &= |= ^=".split()}
BINARY = frozenset("=== !== <=> == != <= >= && || ?? ** << // / % | ^".split())


@cache
def tables(language: str) -> tuple:
    g = grammar(language)
    used = {s for _, body in g.rules for s in body if s not in g.by}
    soft = set(IN_PLACES[language].split())
    hard = set(RESERVED[language].split()) - soft
    words = {w: w if w in used else "kw" for w in hard} | {w: f"~{w}" for w in soft} | {w: "v" for w in LITERAL_WORDS.get(language, "").split()}
    words |= ALIKE.get(language, {})
    for w in MODIFIERS.get(language, "").split():
        words[w] = "~mod" if w in soft else "mod"
    pattern = re.compile(rf"[ \t\f\r﻿]*(?:(?P<w>{PLAIN_WORDS[language]})|(?P<p>[()\[\]{{}},;])|(?P<n>\n)|(?P<g>(?m:^(?:<{{7}}|={{7}}|>{{7}}|\|{{7}})(?:[ \t][^\n]*)?$))|(?P<c>{COMMENTS[language]})|(?P<s>{STRINGS[language]})|(?P<d>(?:{NUMBERS[language]})(?!\w))|(?P<i>{WORDS[language]})|(?P<o>{OPERATOR}))")
    return pattern.match, words, used


@cache
def plain_operators(language: str) -> dict[str, str]:
    """Operators that are always what they look like, with their classes."""
    other = {"/", "//", "`", "'", '"', "\\", "$"} | ({"<"} if language in ANGLES else set()) | ({"|", "&&", "?."} if language == "rust" else set())
    return {op: OPERATORS.get(op, "op") for op in [*OPERATORS, *BINARY] if op not in other}


#: Languages with lists of types in angle brackets, and words that stand in none of them.
ANGLES = frozenset(["java", "csharp", "rust", "typescript"])
NOT_IN_TYPES = frozenset("return if else while do switch case break continue throw try catch var let function class import package".split())
PLAIN_ANGLES = re.compile(r"<[\w\s,.?\[\]:']*>").match
#: Groups of the pattern that only say that something is told quickly.
SAME = {"w": "i", "p": "o"}
BEFORE_BRACES = frozenset("< , | & = : ( [ ; { => extends keyof".split())


def _angles(language: str, text: str, at: int) -> int:
    """The place after a list of types in angle brackets that begins at `at`, or 0 if it is none.

    Strings, comments and brackets inside are passed over whole; whatever no type has ends the search.
    """
    if at + 1 >= len(text) or text[at + 1].isspace():
        return 0
    plain = PLAIN_ANGLES(text, at)
    if plain:
        return plain.end()
    match, words, _ = tables(language)
    inside, pos, before = [], at, ""
    while pos < len(text):
        m = match(text, pos)
        if not m:
            return 0
        kind = m.lastgroup
        token, start, pos = m.group(kind), m.start(kind), m.end()
        kind = SAME.get(kind, kind)
        if kind == "n" or kind == "c":
            continue
        if kind == "g" or kind == "i" and token in NOT_IN_TYPES:
            return 0
        if kind == "o":
            if token == "'" and language == "rust" or token == "`" and language == "typescript":
                lifetime = LIFETIME(text, start) if token == "'" else None
                pos, before = lifetime.end() if lifetime else _template(text, start) if token == "`" else 0, token
                if not pos:
                    return 0
                continue
            if token == "<":
                inside.append(">")
            elif token[0] == ">":
                if not inside or inside.pop() != ">":
                    return 0
                pos = start + 1
                if not inside:
                    return pos
            elif token in ("(", "["):
                inside.append(CLOSERS[token])
            elif token == "{":
                if not (language == "typescript" and before in BEFORE_BRACES or language == "rust" and before in ("<", ",", "=")):
                    return 0
                inside.append("}")
            elif token in (")", "]", "}"):
                if not inside or inside.pop() != token:
                    return 0
            elif token == ";" and inside[-1] not in ("}", "]") or token in ("&&", "||", "==", "!=", "<=", "++", "--", "===", "!==", '"', "\\", "<<"):
                return 0
        before = token
    return 0


def _template(text: str, at: int) -> int:
    """The place after the template literal that begins at `at`, or 0 if it doesn't end."""
    i, n = at + 1, len(text)
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "`":
            return i + 1
        if text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                if text[i] == "`":
                    i = _template(text, i) or n
                    continue
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
            continue
        i += 1
    return 0


#: What can end a statement, and what can't begin one, where line ends may end statements.
ENDS_GO = frozenset(["i", "q", "v", "inc", ")", "]", "}", "break", "continue", "fallthrough", "return"])
ENDS_SCRIPT = frozenset(["i", "q", "v", "inc", ")", "]", "}", "this", "super", "break", "continue", "return", "debugger", "yield"])
GOES_ON = frozenset(["op", "pm", "*", "&", "<", ">", "=", "asg", "?", ":", ".", ",", ";", "=>", "?.", "(", "[", "in", "instanceof", "else", "catch", "finally", ")", "]", "{", "~as", "~satisfies", "~of", "..."])


def lex(language: str, text: str, faults: Callable[[str], int] = lambda types: 0) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """Classes, lines (from 1), and lexical errors as (line, what); an error's character has no class.

    Lists of types in angle brackets have no class either; `faults` tells how many edits one needs. A line that a merge
    left as its marker is one error.
    """
    match, words, _ = tables(language)
    plain = plain_operators(language)
    script, go, rust, angled = language in ("javascript", "typescript"), language == "go", language == "rust", language in ANGLES
    line_ends, worded = script or go, language != "json"
    # After these a word may be something else, or part of a name with dots.
    joining = frozenset([".", "::", "?.", "{", ","] if script else [".", "::", "?."])
    classes: list[str] = []
    lines: list[int] = []
    errors: list[tuple[int, str]] = []
    pos, n, line, fresh = 0, len(text), 1, False
    if text.startswith("#!") and not text.startswith("#!["):
        pos = text.find("\n") if "\n" in text else n
    conditions: list[bool] = []
    after_condition = False
    while pos < n:
        m = match(text, pos)
        if m:
            kind = m.lastgroup
            pos, stop = m.span(kind)
        else:
            kind, stop = None, 0
            while pos < n and text[pos] in " \t\f\r\ufeff":
                pos += 1
            if pos == n:
                break
        if kind == "n":
            pos, line, fresh = stop, line + 1, True
            continue
        last = classes[-1] if classes else ""
        if not fresh or not line_ends:
            # Brackets, separators and words are most of what there is, and here no line end counts.
            if kind == "p" and (not script or text[pos] in ",;"):
                classes.append(text[pos])
                lines.append(line)
                pos = stop
                continue
            if kind == "w" and worded and last not in joining:
                classes.append(words.get(text[pos:stop], "i"))
                lines.append(line)
                pos = stop
                continue
        if kind == "g":
            errors.append((line, "conflict"))
            pos = stop
            continue
        if kind == "c":
            k = text.count("\n", pos, stop)
            line, fresh, pos = line + k, fresh or k > 0, stop
            continue
        ch = text[pos]
        cls, end, start = "", 0, line
        if kind == "p":
            end, cls = stop, ch
        elif kind == "w" or kind == "i":
            end, word = stop, text[pos:stop]
            if language == "json":
                cls = "v" if word in ("true", "false", "null") else "kw"
            else:
                cls = words.get(word, "i") if last not in (".", "?.") or rust and word == "await" else "i"
                if script and last in ("{", ",") and word != "default" and text[end : end + 2].lstrip().startswith(":"):
                    cls = "i"
        elif kind == "o" and (known := plain.get(text[pos:stop])):
            end, cls = stop, known
        elif ch == "`" and script:
            end, cls = _template(text, pos), "v"
        elif ch == "/" and script and last not in ("i", "q", "v", ")", "]", "}", "this", "super", "inc") and last[:1] != "~":
            r = REGEX.match(text, pos)
            end, cls = (r.end(), "v") if r else (pos + 1, "op")
        elif kind == "s":
            end, cls = stop, "s" if language == "json" else "v"
        elif kind == "d":
            end, cls = stop, "v"
        elif rust and ch == "'" and (m2 := LIFETIME(text, pos)):
            end, cls = m2.end(), "lt"
        elif rust and ch == "|" and last not in ("i", "q", "v", ")", "]", "}", "?", "..") and not text.startswith("||", pos) and (m2 := BARS(text, pos)) and last != "op" and last != "=>":
            end, cls = m2.end(), "bars"
        elif ch == "<" and angled and ((last in ("i", "q", "impl", "fn", "for", "~default", "function", "class") or last[:1] == "~") and (pos and not text[pos - 1].isspace() or last in ("mod", "~mod")) or last in ("::", "mod", "~mod") or language == "java" and last in ("{", "}", ";", ".") or language == "typescript" and last in ("=", "(", ",", "=>", "return", ":", "~async", "?", "op")):
            end = _angles(language, text, pos)
            if end and not (language == "typescript" and COMPARED(text, end)):
                errors += [(line, "types")] * faults(text[pos + 1 : end - 1])
                line += text.count("\n", pos, end)
                pos = end
                if last == "::":
                    classes.pop(), lines.pop()
                continue
            end, cls = stop, OPERATORS.get(text[pos:stop], "op")
        elif kind == "o":
            op = text[pos:stop]
            if op == "//" and language != "python" or ch in "\"'`\\" or ch in "$" or not (op in OPERATORS or op in BINARY):
                cls = ""
            else:
                cls, end = OPERATORS.get(op, "op"), stop
            if rust and op in ("&&", "?."):
                cls, end = op[0], pos + 1
        if not cls or not end:
            quote = ch in "\"'`" or text.startswith("/*", pos)
            errors.append((line, "unterminated" if quote else "character"))
            if ch.isdigit():
                # A number with letters that belong to none is one fault and stands as a number.
                pos = RUN(text, pos).end()
                classes.append("v"), lines.append(line)
                fresh = False
                continue
            stop = text.find("\n", pos) if ch in "\"'" and not text.startswith(('"""', "'''"), pos) and not rust else n if quote else pos + 1
            pos = n if stop < 0 else stop
            continue
        if cls == "v" and kind != "d":
            line += text.count("\n", pos, end)
        if line_ends:
            if fresh and classes and (go and last in ENDS_GO or script and (last in ENDS_SCRIPT or last[:1] == "~" or last == "!" and classes[-2:-1] and classes[-2] in ENDS_SCRIPT) and (cls not in GOES_ON or cls == "else" and last not in ("}", ";")) and cls != "inc" and not (last == ")" and after_condition)) and not (script and cls == "while" and last == "}"):
                classes.append(";")
                lines.append(start)
            if script and cls in ("(", "[", "{"):
                conditions.append(cls == "(" and last in ("if", "for", "while", "with", "~await"))
            elif script and cls in (")", "]", "}"):
                after_condition = conditions.pop() if conditions else False
            fresh = False
        pos = end
        if cls == "i" and last in (".", "::") and len(classes) > 1 and classes[-1] == last and (classes[-2] in "iq" or classes[-2][:1] == "~") and language != "python":
            classes.pop(), lines.pop()
            classes[-1] = "q"
            continue
        classes.append(cls)
        lines.append(start)
    if go and fresh and classes and classes[-1] in ENDS_GO:
        classes.append(";")
        lines.append(line)
    return classes, lines, errors
