import itertools
import random

import pytest

from scoria.llm import docs, provenance, syntax
from scoria.llm.chart import Grammar
from scoria.llm.docs import says_something

FILES = "file_id string, repo string, normalized_path string, language string, source_text string, delivered_at timestamp_ntz, text string, kind string"

VALID = {
    "python": ["", "x = 1\n", "def f(a, *b, c: int = 2, **d) -> list[int]:\n    '''doc'''\n    return [i for i in a if i]\n", "try:\n    pass\nexcept (A, B) as e:\n    raise\nelse:\n    x = {1: 2, **y}\nfinally:\n    del x\n", "@a.b(1)\nasync def g():\n    async with x as y, z:\n        await q\n", "if a: b = 1; c = lambda x, y=2: x\n", "print(f'{a!r}', x[1:2, ...])\nmatch = 3\n", "\ufeffx = '''\n<<<<<<< a\n'''\r\n"],
    "json": ['{"a": [1, -2.5e3, null, true, {}], "b": "\\u00e9"}', "[]", "3", ' "x" '],
    "java": ["package a.b;\nimport java.util.*;\n@X(1) public final class A<T extends B> extends C<T> implements D, E {\n  private int[] x = {1, 2};\n  A() throws Q { this(1); }\n  <V> List<V> f(final int a, String... b) { for (int i = 0; i < 3; i++) { x[i] += 1; } for (var y : b) g(y); return a > 1 ? (int) b : new A<>() { }; }\n  enum K { A, B(2) { }; }\n}\n", "interface I { default void f() { Runnable r = () -> { }; switch (x) { case 1: break; default: g(A::new); } } }", "class A { void f() { try (var r = g()) { } catch (A | B e) { } finally { } if (x instanceof String s && !s.isEmpty()) return; else throw e; } }"],
    "csharp": ["using System;\nnamespace A.B { [X(1)] public class C<T> : D, E where T : new() { public int P { get; private set; } = 3; int Q => 1; void F(ref int a, out int b, string c = \"x\") { foreach (var x in y) { z ??= x?.Y; } var q = new C<int> { P = 1 }; using (var s = T()) { } lock (a) { } } } }", "class A { async Task F() { await G(); var f = (int a) => a + 1; if (x is null) return; switch (y) { case 1: break; default: throw new E(); } } }"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T struct {\n\ta int\n\tb []string\n}\n\nfunc (t *T) F(a, b int, c ...string) (int, error) {\n\tfor i, v := range c {\n\t\tif x := g(v); x != nil {\n\t\t\treturn i, x\n\t\t} else if y {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch a {\n\tcase 1, 2:\n\t\tb++\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\treturn a + b, T{a: 1, b: []string{`x`}}.err\n}\n"],
    "rust": ["use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a, T: X> { pub x: &'a str, y: Vec<T> }\nimpl<'a, T> S<'a, T> {\n    pub fn f(&self, mut a: u32) -> Option<&str> {\n        let x = match a { 1 | 2 => Some(1), n if n > 3 => { None } _ => return None };\n        if let Some(y) = x { println!(\"{}\", y); } else { for i in 0..10 { a += i as u32; } }\n        let c = |q| q + 1;\n        self.g(c)?.h::<u8>()\n    }\n}\nenum E { A, B(u8), C { x: i32 } }\nfn main() { let s = r#\"=======\"#; let t = 'x'; }\n"],
    "javascript": ["import a, { b as c } from './x.js'\nexport default class A extends B {\n  static #x = 1\n  get y() { return this.#x }\n  async *f(a, { b, ...c } = {}, [d]) { for (const x of y) await x }\n}\nconst r = /[({]+/g, t = `a ${b ? `c` : d} e`\nlet o = { a, b: 1, 'c'() { }, [d]: x => ({ y }), export: 2 }\nif (a) b()\nelse c()\nlabel: for (;;) { break label }\n", "!function(a){return a?.b??c}(1);var x=function(){};do{}while(0)", "switch (a) { case 1: { b } default: c }\ntry { x } catch { y }\n"],
    "typescript": ["interface A<T> extends B { readonly x?: number; f(a: string): void }\ntype U = 'a' | { [k: string]: number } | ((x: number) => string[])\nexport abstract class C implements A<string> {\n  private static async f<T>(a: T, b?: number, ...c: string[]): Promise<T> { return a as unknown as T }\n  constructor(private readonly x: number) { super() }\n}\nenum E { A = 1, B }\nconst f = (a: number): number => a!\ndeclare module 'x' { }\nfunction g(this: Window, x = <any>1) { }".replace("<any>1", "1")],
}
INVALID = {
    "python": ["def f(:\n", "x = 1\n  y = 2\n", "if a:\n", "class A {\n}\n", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", "x = 'a\n", "'''open\n", "    return 1\n", "try:\n    pass\nx = 1\n", "use a::b;\n"],
    "json": ["", " \n", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", '{"a" 1}', "[NaN]", "[01]", '"a\nb"', "// x\n{}"],
    "java": ["class A { void f() { int x = ; } }", "class A { void f() {", "using A.B;\nclass C { }", "class A { } }", "class A { /* x", "class A { void f() { return a\n=======\nreturn b; } }", "fn f() -> u8 { 1 }", "[... 3 lines omitted ...]"],
    "csharp": ["class A { void F() { for (int x : y) { } } }", "class A { int f(", "package a.b;\nclass A { }", "def f():\n    pass", "class A { void F() { \"open } }"],
    "go": ["package a\nfunc f() {", "package a\nfunc f() { x := }", "public class A { }", "package a\n>>>>>>> b\n", "package a\nvar x = `open"],
    "rust": ["fn f( {", "fn f() { let = 1; }", "package a\nfunc f() { }", "using A;", "fn f() { return x;\n=======\nreturn y; }", "fn f() -> u8 { 1 } }"],
    "javascript": ["function f(", "let x = ;", "function f(a: number) { }", "use crate::x;", "<!DOCTYPE html>\n<p>a b c</p>", "const a = `open", "class A { f( { } }", "a b c d"],
    "typescript": ["function f(a: ) { }", "class A {", "use crate::x;", "let x: number = ;", "# Notes\nSome plain text here.", "package a\nfunc f() int { }"],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_files_cost_nothing(language):
    for text in VALID[language]:
        assert syntax.check_file(language, text) == (0, None, []), text


@pytest.mark.parametrize("language", sorted(INVALID))
def test_invalid_files_cost_something(language):
    for text in INVALID[language]:
        assert syntax.check_file(language, text)[0] > 0, text


def test_kinds_of_damage():
    body = "".join(f"def f{i}(a):\n    x = a + {i}\n    return x\n\n" for i in range(6))
    assert syntax.check_file("python", body + "def g(")[1] == "truncated"
    assert syntax.check_file("python", body + "<<<<<<< a\nx = 1\n=======\nx = 2\n>>>>>>> b\n")[1] == "conflict"
    assert syntax.check_file("python", VALID["javascript"][0] * 3)[1] == "mismatch"


def test_long_texts_are_read_whole():
    assert syntax.check_file("javascript", "x = " + " + ".join(["'a'"] * 30_000) + ";")[0] == 0
    assert syntax.check_file("python", "x = [" + "1, " * 50_000 + "]\n" + "y = (\n")[0] > 0
    assert syntax.check_file("json", "[" + "1," * 99_999 + "1]")[0] == 0


def test_long_go_groups_parse():
    groups = ["const (\n" + "".join(f"\tA{i} = {i}\n" for i in range(400)) + ")\n", "const (\n\tA = iota\n" + "".join(f"\tB{i}\n" for i in range(400)) + ")\n", "import (\n" + "".join(f'\t"a/b{i}"\n' for i in range(400)) + ")\n", "var (\n" + "".join(f"\tv{i}, w{i} []int = f({i}), nil\n" for i in range(200)) + ")\n", "type (\n" + "".join(f"\tT{i} struct {{ a int }}\n" for i in range(200)) + ")\n"]
    for text in groups:
        assert syntax.check_file("go", "package a\n\n" + text) == (0, None, []), text[:40]
        assert syntax.check_file("go", "package a\n\n" + text[:-2] + "\t1 = 1 = 1\n)\n")[0] > 0, text[:40]
    assert syntax.check_file("python", "x = f(a" + " + b.c(1)" * 300 + " for a in y)\n") == (0, None, [])
    assert syntax.check_file("javascript", "for (let " + ", ".join(f"a{i} = f({i})" for i in range(200)) + "; a1 < 3; a1++) { b(a1) }\n") == (0, None, [])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(
    "rules,start,alphabet",
    [("S: a S b | a b | S S | x T y\nT: c | T , c", "S", "abxyc,"), ("E: U | E o U\nU: v | p U | ( E )", "E", "vop()"), ("L: I*\nI: i ; | k i E? ;\nE: = v", "L", "ik;=v"), ("S: a S b | c", "S", "abc")],
)
def test_repair_costs_are_least(rules, start, alphabet):
    g, rnd = Grammar(rules), random.Random(2)
    language = [w for n in range(7) for w in itertools.product(alphabet, repeat=n) if g.matches(start, w)]
    for _ in range(150):
        w = tuple(rnd.choice(alphabet) for _ in range(rnd.randrange(4)))
        want = min(edit_distance(w, x) for x in language)
        assert g.cost(start, w) == want, w
        assert g.cost(start, (*w, "foreign")) >= 1 and Grammar(rules).cost(start, w, want) >= want


def test_what_the_own_parser_takes_is_not_charted(monkeypatch):
    charted = []
    check = syntax.Checker.check
    monkeypatch.setattr(syntax.Checker, "check", lambda self, text: charted.append(text) or check(self, text))
    assert syntax.check_file("python", "x = f(1)\n") == (0, None, []) and syntax.check_file("json", "[1, {}]") == (0, None, []) and not charted
    assert syntax.check_file("python", "x = f(1\n") == (1, "truncated", [1]) and syntax.check_file("json", "[1, {]")[0] == 1 and len(charted) == 2


def test_states_with_the_same_rest_are_one():
    g = Grammar("S: a T c | d T c | T\nT: b | x? b")
    assert len(g._states()[1]) == 11
    for w in itertools.chain.from_iterable(itertools.product("abcdx", repeat=n) for n in range(5)):
        middle = w[1:-1] if w[:1] in (("a",), ("d",)) and w[-1:] == ("c",) else w
        assert g.matches("S", w) == (middle in (("b",), ("x", "b"))), w


def test_long_valid_files_cost_nothing():
    sum_ = " + ".join(f"g({i})" for i in range(150))
    for language, text in [
        ("java", f"class A {{ void f() {{ for (int i = 0; i < g(x) + {sum_}; i++) {{ h(); }} }} }}"),
        ("javascript", f"for (let i = 0; i < g(x) + {sum_}; i++) {{ h(); }}"),
        ("java", "class A { void f() { if (a) { b(); } " + "else if (c(1)) { d(); } " * 5000 + "} }"),
        ("javascript", "let x = " + " + ".join(f"f({i})" for i in range(20_000)) + ";"),
        ("java", "class A { int x = " + "(a)" * 3000 + "b; }"),
    ]:
        assert syntax.check_file(language, text) == (0, None, []), text[:60]


def test_faults_that_need_more_than_brackets():
    for text in ["f() = 1\n", "1 = x\n", "f(a=1, 2)\n", "f(**k, *a)\n", "if x:\n\ty = 1\n        z = 2\n", "if x:\n        y = 1\n\tz = 2\n"]:
        assert syntax.check_file("python", text)[0] > 0, text
    for language, text in [("rust", "fn main() { let x = 1 let y = 2; }"), ("java", "class A { void f() { 1 + 2; } }"), ("javascript", "let x = 08n;"), ("java", "class A { List<A,,> x; }"), ("java", "enum E { A B }"), ("go", "package a\nvar x = 08\n\nvar y = 1z\n"), ("json", "(1)")]:
        assert syntax.check_file(language, text)[0] > 0, text
    assert syntax.check_file("java", "int x = 1 }")[1] == "other"


def test_types_in_angle_brackets():
    for language, text in [
        ("typescript", 'let x: Pick<T, "id"> = y; let p: Promise<{ a: string; b: number }> = q\nfunction f<T extends keyof U, U = {}>(x: T): Array<T | null> { return g<T>(x) }'),
        ("typescript", "const x = a < b; if (i<n && j>m) { f(a<b, c>d) }"),
        ("typescript", "type M = Map<string, " + "Array<" * 200 + "string" + ">" * 200 + ">\n"),
        ("java", "class A<T extends Comparable<T> & Foo> { Map<String, List<? super T[]>> m = new HashMap<>(); <U> U f(List<?> x) { return this.<U>g(x); } }"),
        ("rust", "impl<'a, T: Foo<Item = u8> + 'a, const N: usize> Bar<'a, [T; N]> for Baz<T> { }"),
        ("csharp", "class A<T> where T : new() { Dictionary<string, List<(int a, string b)>> d = new(); Type t = typeof(Dictionary<,>); }"),
    ]:
        assert syntax.check_file(language, text) == (0, None, []), text


def test_syntax_table(spark):
    rows = [("a", "r", "p", "js", "def f(", None), ("a", "r", "p", None, "x = 1\n", None), ("b", "r", "p", None, None, None), ("c", "r", "p", None, "x = (", None), ("d", None, "p", None, "(", None), ("e", "r", "p", None, "(", None), (None, "r", "p", None, "(", None)]
    files = spark.createDataFrame([(*r, "t", "k") for r in rows], FILES)
    expected = spark.createDataFrame([("a", "python"), ("b", "python"), ("c", "python"), ("c", "python"), ("d", None), (None, "python"), ("z", "go")], "file_id string, language string")
    costs = syntax.syntax_costs(files, expected)
    assert {r.file_id: r.cost > 0 for r in costs.collect()} == {"a": False, "c": True, "d": False}
    assert {(r.repo, r.language): (r.files, r.invalid) for r in syntax.syntax_rates(costs).collect()} == {("r", "python"): (2, 1), (None, None): (1, 0)}
    assert syntax.syntax_costs(files.limit(0), expected).count() == 0


def test_files_not_written_by_hand(spark):
    body = "".join(f"def work_{c}(a):\n    return a * {ord(c)} + later(a)\n\n" for c in "abcdefghij")
    accessor = "package p\n\n" + "".join(f"func (m *T) GetX{i}() int {{ return m.f[{i}] }}\n\n" for i in range(9))
    table = "DATA = [\n" + "".join(f'    "{i}|pump|local|0.{i}",\n' for i in range(60)) + "]\n"
    packed = "".join(f"function f{i}(a,b){{var c=a+{i};return c>2?b(c):b[0]}}" for i in range(40))
    found = {
        "banner": ("src/a.py", "# Licensed under X\n\n# @generated by tool\nx = 1\n"), "go": ("src/a.go", "// Code generated by x 1.2. DO NOT EDIT.\n\npackage a\n"), "german": ("src/b.py", "# Automatisch erzeugt aus a.xml, nicht von Hand ändern!\nx = 1\n"),
        "slots": ("src/c.go", accessor), "rows": ("src/d.py", table), "blob": ("src/e.py", 'B = "' + "QUJD" * 300 + '"\n'), "packed": ("src/f.js", packed), "min": ("src/g.min.js", "x()"),
        "vendor": ("vendor/lib/a.py", body + "# 1\n"), "modules": ("x/node_modules/lib/a.js", "f()\n"), "copied": ("src/h.py", "# Copied from lib 3.2.5, see there\n" + body), "notice": ("src/i.py", "# lib v4.1 | (c) the authors | MIT\nx = 2\n"), "null_vendor": ("deps/lib/x.py", None),
    }
    kept = {
        "hand": ("src/j.py", body + "# 2\n"), "speaks": ("src/k.py", "from a import b\n\n# reads @generated marks of other files\n\ndef f():\n    pass\n"), "stub": ("src/l.py", "# Auto-generated method stub\ndef f():\n    pass\n"), "place": ("src/vendor_portal/third_party_payment.py", body + "# 3\n"),
        "json": ("src/m.json", "[" + "1, " * 900 + "1]"), "list": ("src/n.py", "X = [\n    1,  # Holds the lock.\n    2,  # Rounds half to even.\n]\n\n" + body + "# 4\n"), "empty": ("src/o.py", ""), "null": ("src/p.py", None), "writes": ("src/q.py", "# writes the 'DO NOT EDIT' banner into what it generates\nx = 1\n"),
    }
    rows = [(k, "r", p, "json" if p.endswith("json") else None, t, None, "t", "k") for k, (p, t) in {**found, **kept}.items()]
    shared = body.replace("later", "other")
    rows += [("s1", "r1", "lib/x.py", None, "# Licensed\n" + shared, None, "", ""), ("s2", "r2", "a/b/y.py", None, shared.replace("\n", "\r\n"), None, "", ""), ("s2", "r2", "a/b/y.py", None, shared.replace("\n", "\r\n"), None, "", "")]
    files = spark.createDataFrame(rows, FILES)
    got = {r.file_id: r.reason for r in provenance.not_handwritten(files).collect()}
    assert set(got) == {*found, "s1", "s2"}
    assert got["slots"] == "generated" and got["rows"] == "data" and got["packed"] == "minified" and got["s1"] == "vendored"
    assert provenance.not_handwritten(files.limit(0)).count() == 0


def test_shared_directory_of_small_files(spark):
    rows = [(r, f"{d}/{n}.py", f"h{n}", 90) for r, d in (("r1", "a/lib"), ("r2", "b/c")) for n in "xyz"] + [("r1", "a/own.py", "q", 90), ("r3", "solo/x.py", "hx", 90)]
    got = {tuple(r) for r in provenance.shared_subtrees(spark.createDataFrame(rows, "repo string, path string, leaf string, size long")).collect()}
    assert got == {("r1", "a/lib"), ("r2", "b/c"), ("r2", "b")} - {("r2", "b")} | ({("r2", "b")} & got)


def test_forks_are_no_vendored_copies(spark):
    body = lambda i: f"def f{i}(a):\n    # keeps the order\n" + "".join(f"    a += {i} * {k}\n" for k in range(20)) + "    return a\n"
    fork = [(f"{repo}{i}", repo, f"src/core/m{i}.py", body(i)) for repo in ("one/tool", "two/tool") for i in range(3)]
    copied = [(f"lib{repo}{k}", repo, f"{place}/m{k}.py", body(50 + k)) for repo, place in (("one/tool", "a/lib"), ("far/app", "x/y")) for k in range(2)]
    own = [(f"own{i}", "far/app", f"src/n{i}.py", body(100 + i)) for i in range(3)]
    files = spark.createDataFrame([(k, repo, p, None, t, None, "", "") for k, repo, p, t in fork + copied + own], FILES)
    assert {r.file_id for r in provenance.not_handwritten(files).collect()} == {k for k, *_ in copied}
    leaves = spark.createDataFrame([(repo, p, t, 500) for _, repo, p, t in fork + copied + own], "repo string, path string, leaf string, size long")
    assert {tuple(r) for r in provenance.families(leaves).collect()} == {("one/tool", "one/tool"), ("two/tool", "one/tool")}


def test_merkle_tree_of_deep_paths(spark):
    deep = "/".join(f"d{i}" for i in range(12))
    rows = [("r1", f"{deep}/x.py", "h", 500), ("r2", f"q/{deep}/y.py", "h", 500), ("r2", "top.py", "t", 500)]
    tree = {(r.repo, r.node): r.hash for r in provenance.merkle_tree(spark.createDataFrame(rows, "repo string, path string, leaf string, size long")).collect()}
    assert tree["r1", deep] == tree["r2", f"q/{deep}"] and len(tree) == 13 + 14 + 1
    assert provenance.merkle_tree(spark.createDataFrame([], "repo string, path string, leaf string, size long")).count() == 0


TRIVIAL = ["", "// ", "/** */", "// TODO", "/* TODO: document */", "// sort locale", "/** Sorts the locale. */", "// This method sorts the locale.", "# nolint", "// eslint-disable-next-line", "/**\n * @param count\n * @returns\n */", "// ---------- helpers ----------", "// see above", "/** {@inheritDoc} */", "// @since 1.5", "/// <summary>Todo.</summary>", "// x = sort(y);\n// return x;", "// Licensed under the terms of X.\n// All rights reserved.", '"""n/a"""', "'''Helper.'''", "// Takes count and returns the result.", "// sortLocale()", "/// <param name=\"count\"></param>"]
TELLING = ["// Not thread-safe.", "# Panics if empty.", "/** @param count how many to keep, or zero for all */", "/// <returns>the age in days</returns>", "// 負の値は期限切れを意味するので注意してください。", '"""Sorts the locale.\n\n:return: what was left over\n"""', "// TODO\n// Ties are broken by the smaller id.", "# Ist die Liste leer, bleibt der alte Wert gültig.", "// sortLocale runs in linear time, except when most are fresh."]


def test_trivial_and_telling_documentation():
    for text in TRIVIAL:
        assert not says_something(text, "sortLocale", "(count: number)"), text
    for text in TELLING:
        assert says_something(text, "sortLocale", "(count: number)"), text
    assert not says_something(None, None, None) and says_something("# Costs one round trip per row.", None, None)


SOURCE = '''# Rounds half to even, as asked.
@traced
def above(a):
    return a

def inside(a,
           b):
    # why
    """Doubles the waiting time after each failure."""
    x = "# no comment"
    return x


# Unrelated, a blank line follows.

def none(a): return a

class A:
    # tbd
    async def trivial(self):
        pass
    def short(self): """Never blocks the caller."""
'''
CURLY = '''/** Keeps at most four entries; older ones go first. */
#[inline]
pub fn one() -> u8 {
    if x { y(); }
    1
}

#[doc = "Panics when the list is empty."]
fn two()
{
    let s = "}";
}
let q = 1; // trailing remark about q
fn three() { }
'''


def test_pairs(spark):
    rows = [("p", "r", "a.py", None, "\ufeff" + SOURCE.replace("\n", "\r\n"), None), ("p", "r", "a.py", None, "\ufeff" + SOURCE.replace("\n", "\r\n"), None), ("c", "r", "a.rs", None, CURLY, None), ("n", "r", "n.py", None, None, None), ("j", "r", "j.json", None, "{}", None)]
    files = spark.createDataFrame([(*r, "t", "k") for r in rows], FILES)
    entry = "array<struct<kind: string, name: string, start_line: int, signature: string, docstring: string>>"
    f = lambda n, line, kind="function": (kind, n, line, "(a)", "untrue")
    expected = spark.createDataFrame([("p", "python", [f("above", 3), f("inside", 6), f("none", 16), f("A", 18, "class"), f("trivial", 20, "method"), f("short", 22, "method"), f("far", 999), f("above", 3)]), ("c", "rust", [f("one", 3), f("two", 9), f("three", 14), f("nowhere", None)]), ("n", "python", [f("x", 1)]), ("j", "json", [f("x", 1)]), ("z", "go", None), ("y", None, [])], f"file_id string, language string, symbols {entry}")
    got = {(r.file_id, r.start_line): (r.end_line, r.code) for r in docs.code_pairs(files, expected).collect()}
    assert {k: v[0] for k, v in got.items()} == {("p", 3): 4, ("p", 6): 11, ("p", 22): 22, ("c", 3): 6, ("c", 9): 12}
    assert got["c", 9][1] == 'fn two()\n{\n    let s = "}";\n}' and got["p", 3][1] == "def above(a):\n    return a"
    assert docs.documented(files.limit(0), expected).count() == 0 and docs.documented(files, expected.limit(0)).count() == 0


def test_attributes_over_several_lines(spark):
    java = "class A {\n    // Retries once, then gives up for good.\n    @Foo(\n        a = 1,  // unused\n        b = {2, 3}\n    )\n    @Bar\n    void f() {\n    }\n\n    // Closes the socket after ten idle seconds.\n    @Foo(\n        1\n    ) void g() {\n    }\n}\n"
    rust = "/// Only built where threads exist.\n#[cfg(\n    all(unix, threads)\n)]\nfn f() {\n}\n"
    sharp = "class A {\n    /// <summary>Keeps the oldest entry when full.</summary>\n    [Attr(\n        1)]\n    void F() {\n    }\n}\n"
    texts = {"j": ("java", java, [("f", 8), ("g", 14)]), "r": ("rust", rust, [("f", 5)]), "s": ("csharp", sharp, [("F", 5)])}
    files = spark.createDataFrame([(k, "r", "p", None, t, None, "t", "k") for k, (_, t, _) in texts.items()], FILES)
    expected = spark.createDataFrame([(k, lang, [("function", n, line, "()", None) for n, line in at]) for k, (lang, _, at) in texts.items()], "file_id string, language string, symbols array<struct<kind: string, name: string, start_line: int, signature: string, docstring: string>>")
    got = {(r.file_id, r.start_line): r.end_line for r in docs.documented(files, expected).collect()}
    assert got == {("j", 8): 9, ("j", 14): 15, ("r", 5): 6, ("s", 5): 6}


def test_long_lines_are_judged_whole():
    code = "x = sort(y, " + "value, " * 200 + "z);"
    assert not says_something("// " + code, "f", "()") and not says_something("# " + "-" * 5000 + " helpers " + "-" * 5000, "f", "()")
    assert says_something("// " + "Waits until the slowest of the workers has answered. " * 40, "f", "()")
    assert not says_something("# " + "-" * 20000 + "x", "x", "()") and not says_something("// see " + "a.b " * 4, "f", "()")
