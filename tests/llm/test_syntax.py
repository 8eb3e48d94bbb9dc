import pytest

from stratalens.llm import chart, lexers, repair, syntax

GOOD = {
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (n int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if b == 2 {\n\t\tfor i := range xs {\n\t\t\tfmt.Println(i)\n\t\t}\n\t}\n\tswitch x := y.(type) {\n\tcase int, *S[int]:\n\t\tgo f(func() { defer g() }())\n\tdefault:\n\t}\n\tch <- 1\n\tz := []map[string]T{{\"a\": T{1, 2}}, {}}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\tfor ; ; i++ {\n\t}\nL:\n\tfor {\n\t\tbreak L\n\t}\n\treturn\n}\n",
        "package a\n// only\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\n@Ann(x = 1, y = {\"a\", \"b\"})\npublic final class A<T extends Comparable<T> & B> extends C<Map<String, List<T>>> implements D {\n  private static final int[] X = {1, 2,}, Y[] = {{1}};\n  static { f(); }\n  A(int... a) throws E { this.a = (int) a[0]; }\n  <R> R m(final List<? super R> q) { for (var i : q) { if (i instanceof String s && !s.isEmpty()) continue; } return switch (x) { case 1, 2 -> 3; default -> { yield (a < b) ? c : d; } }; }\n  enum E { P(1) { void f() {} }, Q; int z; }\n  record R(int a, String b) { R { } }\n  void t() { try (var r = open()) { x += 1; } catch (A | B e) { throw e; } finally { } Runnable r = () -> { }; g(String::valueOf, (a, b) -> a + b, int[]::new); do { i++; } while (i < 3); String s = \"\"\"\n    hi \"there\"\n    \"\"\"; long l = 0xFFL >>> 2; new Object() { int q; }; synchronized (this) { } outer: while (true) break outer; }\n}\n",
    ],
    "javascript": [
        "import a, { b as c } from \"x\";\nimport * as ns from 'y'\nexport default class A extends B { #p = 1; static s; get x() { return this.#p } async *gen() { yield* f() } constructor(...r) { super(...r) } static { init() } }\nconst {q, r: [s, , t = 1], ...u} = o, f = async (x) => { await x }\nlet re = /[/\"]+/g, v = `a${b + `c${d}`}e`\nif (a) b(); else c()\nfor (const [k, w] of Object.entries(m)) { label: for (;;) { continue label } }\nswitch (z) { case 1: case 2: break; default: g?.h?.[1]?.(2) ?? 3 }\ntry { x() } catch { y() } finally { }\nvar g2 = function* () {}, h = x => ({ a: 1, [k]: 2, m() {}, get p() { return 1 }, ...rest })\nreturn_ = a ? b : c\nexport { f as default, v }\na = b\n++c\ndo x++; while (x < 5)\nnew (foo())(1)\nthrow new Error('x')\n",
    ],
    "typescript": [
        "import type { A } from './a';\nexport interface I<T = {}> extends J<T> { readonly a?: string; [k: string]: any; m<U>(x: U): void; new (x: number): I; get p(): string }\ntype M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\nexport abstract class C<T> implements I { private readonly x: number = 1; constructor(public a: string, protected b?: number) { super(); } abstract m(): void; static async f<T>(this: C<T>, ...xs: T[]): Promise<Array<Array<T>>> { return xs as unknown as any; } declare y: string; z!: number }\nenum E { A = 1, B, 'c' = 2 }\ndeclare module 'm' { export function f(x: number): string; }\nnamespace N.O { export const a = <T,>(x: T): x is T => x!; }\nlet u: A | B & (C | (() => void))[] = f<string>(1)!, t: [a: string, b?: number, ...rest: any[]];\nfunction g(x: string): void;\nfunction g(x: any) { const o = x satisfies object; for (const k in o) { } }\nconst v: typeof import('x') = y as const;\n@dec() export class D { @prop({ a: 1 }) q: string; }\n",
    ],
    "rust": [
        "#![allow(x)]\nuse std::{fmt, io::{self, Read as R}};\npub(crate) struct S<'a, T: Clone + 'a, const N: usize> where T: Fn(i32) -> u8 { pub a: &'a mut [T; N], b: Box<dyn Fn(&str) -> Option<Vec<Vec<u8>>> + Send> }\nstruct P(pub i32, f64);\n#[derive(Debug)] enum E { A, B(u8), C { x: i32 } = 3 }\nimpl<'a, T> fmt::Display for S<'a, T, 3> { const K: u8 = b'a'; type O = T; fn f(&mut self, mut a: i32, (b, c): (u8, u8)) -> Result<(), Box<dyn E>> { let x = if let Some(v) = m.get(&k) { v } else { return Err(\"x\".into()); }; match y { 1..=5 | 7 if a > 2 => {} Some(ref z) => g(z)?, E::C { x, .. } => (), _ => unreachable!(\"{}\", 1), } for i in 0..10 { v[i] += 1; } 'l: loop { break 'l; } let f = move |a: i32, b| -> i32 { a + b }; let w = x as u64 >> 3; unsafe { *p = 1.0e-3_f64; } vec![1, 2; 3]; println!(\"{:?}\", a); let Some(q) = r else { return Ok(()) }; s.iter().map(|x| x.0.1).collect::<Vec<_>>(); Ok(()) } }\nmacro_rules! mm { ($a:expr) => { $a + 1 }; }\npub trait Tr: A + B { fn g(&self) -> Self where Self: Sized; }\npub static X: &[&str] = &[\"a\", r#\"b\"c\"#];\n",
    ],
    "json": ["{\"a\": [1, -2.5e3, true, null, \"\\u00e9\\n\"], \"b\": {}}", "3"],
    "yaml": [
        "a: 1\nb:\n  - x\n  - y: 1\n    z: \"q: r\"\n  -\n    - deep\nc: |\n  any: thing [\n  more\nd: {e: [1, 2], f: 'g'}\n# note\n---\n- k: &anchor v\n- *anchor\n- long plain\n  text goes on\n",
        "{\"a\": [1, {\"b\": null}],\n \"c\": \"d\"}\n", "k: \"two\n  lines\"\nj: >-\n  folded\n", "just text\n", "a:\n- b\n- c\nd: !!str x\n",
    ],
    "python": ["def f(a, *, b: int = 1, **k) -> int:\n    match a:\n        case {'x': [y, *_]} if y:\n            return (yield)\n    return {i: j for i, j in z if j}\n", "x = 1 if a else lambda: 2\n\n\nclass A(B, m=C):\n    '''doc'''\n\n    @d\n    async def f(self):\n        async with a as b, c:\n            await b[1:2, ...]\n        return f\"{a!r:>{w}}\" \"b\"\n"],
}
BAD = {
    "go": ["package a\nfunc f() {\n\tif x {\n", "package a\n<<<<<<< HEAD\n", "package a\nvar x = \"abc\n", "func f() {}\n", "package a\nfunc f() { x := }\n", "package a\nvar x = 'ab'\n", "package a\nvar x = \"\\q\"\n"],
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { g(; } }", "class A { x + 1; }", "def f(): pass", "class A {", "class A { String s = 'ab'; }"],
    "javascript": ["function f( {", "let x = ;", "const a: number = 1;", "a b", "if (x) { ", "import x from y;", "let s = 'a\nb';", "x = `a${`;", "return }", "var a = 1..;x y"],
    "typescript": ["interface A { a: ; }", "def f(x):\n    return x\n", "const x: = 1;", "let a = (1;", "package x"],
    "rust": ["fn f() { let x = ; }", "fn f( {}", "fn f() { g(1)) }", "package main", "fn f() { let s = \"abc; }", "let x = 1;"],
    "json": ["{\"a\": 1,}", "{'a': 1}", "[1 2]", "{\"a\": 01}", "// c\n{}", "\"a\tb\"", "", "[NaN]"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "a: 'b\n", "a: 1\n b: 2\n", "\ta: 1\n", "a: @x\n", "- a\nb: 1\n", "{% if x %}\na: 1\n", "a: \"b\" c\n", "<<<<<<< HEAD\na: 1\n=======\n"],
    "python": ["def f(:\n  pass\n", "x = (1\n", "print 'a'\n", "if x:\npass\n", " x = 1\n", "a\x00b\n"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_and_broken(lang):
    for text in GOOD[lang]:
        one = lexers.language(lang)
        p = syntax.prepared(text, lang)
        at = one.run(one.codes(p))
        assert at < 0, (lang, text[(one.placed(p)[1] + [len(text)])[at] :][:40])
        assert one.placed(p)[0] == one.codes(p)
    for text in BAD[lang]:
        assert syntax.cost_is_nonzero(text, lang), (lang, text)
        cost, line, kind, edits = syntax.diagnose(text, lang)
        assert cost > 0 and line > 0 and edits and kind in ("truncation", "conflict", "mismatch", "error")


def test_byte_order_mark_and_shebang():
    assert not syntax.cost_is_nonzero("﻿#!/usr/bin/env node\nlet a = 1\n", "javascript")
    assert not syntax.cost_is_nonzero("#!/usr/bin/env python3\nx = 1\n", "python")
    assert syntax.cost_is_nonzero("package a\n\nfunc f() {\n}\n}\n", "go")


@pytest.mark.parametrize("text", ["f() = 1\n", "for 1 in x:\n    pass\n", "-a = 2\n", "f(a=1, b)\n", "def f(a=1, b): pass\n", "def f(*): pass\n", 'x = b"a" "c"\n', 'x = f"{a b}"\n', 'x = """a"" "\n', 'x = "\\x1"\n', 'x =# "a"\n'])
def test_the_python_chart_itself_rejects(text):
    one = lexers.language("python")
    assert one.run(one.codes(text)) >= 0 and syntax.cost_is_nonzero(text, "python")
    assert syntax.diagnose(text, "python")[1] == 1


def test_the_python_chart_itself_takes():
    one = lexers.language("python")
    for text in ('x#= "a"\n', "match x:\n    case a.b | 3+4j: pass\n", "a, (b.c, *d[0]), [e] = f\n", "def f(a, b=1, /, c=2, *, d, **k): pass\n", "f(*a, b, c=1, *d, **e)\n", 'f"{a!r:>{w}} {{}} {b[\'c\']:%Y-%m} {x=}"\n'):
        assert one.run(one.codes(text)) < 0, text


def test_the_python_chart_agrees_with_the_interpreter():
    import ast
    import random

    rnd = random.Random(3)
    for text in GOOD["python"]:
        for _ in range(150):
            i, j = sorted(rnd.randrange(len(text)) for _ in range(2))
            t = text[:i] + rnd.choice(["", "(", ":", " ", text[i : i + 3]]) + text[min(j, i + 3) :]
            try:
                ast.parse(t)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert ok or syntax.cost_is_nonzero(t, "python"), t


@pytest.mark.parametrize("lang", ["go", "java", "javascript", "typescript", "rust", "json"])
def test_one_edit_is_undone_by_one(lang):
    import random

    rnd = random.Random(5)
    one = lexers.language(lang)
    codes = one.codes(GOOD[lang][0])
    used: list[str] = []
    assert one.run(codes, used) < 0
    alphabet = [c for c in sorted(set(used))]
    for _ in range(12):
        i = rnd.randrange(len(used))
        t = [*used[:i], *([] if rnd.random() < 0.5 else [rnd.choice(alphabet)]), *used[i + (rnd.random() < 0.5) :]]
        if one.chart.run("".join(t)) < 0:
            continue
        s = repair.Search(one.chart, "".join(t), list(range(1, len(t) + 1)), plain=True)
        got = s.upto(2)
        assert got is not None and got[0] <= 2, (i, t)


def test_cost_without_a_lower_bound_is_the_same():
    one = lexers.language("go")
    text = "package a\nfunc f() {\n\tx := g(1, 2))\n\ty := (3\n\treturn x + y\n}\nfunc g() {\n}\n"
    codes, at = one.placed(text)
    lines = [text.count("\n", 0, i) + 1 for i in at]
    a = repair.Search(one.chart, codes, lines, plain=True)
    b = repair.Search(one.chart, codes, lines, plain=True)
    b._stretches = lambda: [len(codes)]
    assert a.upto(5)[0] == b.upto(5)[0] == 2


def test_yaml_is_read_in_linear_time():
    import time

    def took(n):
        text = "".join(f'k{i}: "v{i}"\nl{i}: [a, "b"]\n' for i in range(n))
        t = time.time()
        assert not syntax.cost_is_nonzero(text, "yaml")
        return time.time() - t, len(text)

    took(100)
    small, _ = took(6_000)
    large, size = took(36_000)
    assert size > 1_000_000 and large < 12 * small + 1


def test_kinds():
    assert syntax.diagnose("package a\n\nfunc f() {\n\tx := g(1,", "go")[::2] == (1, "truncation")
    assert syntax.diagnose("def f(a):\n    if a > 1:\n        return \"x", "python")[::2] == (1, "truncation")
    assert syntax.diagnose("  x := 1;\n  return x\n}\n\nfunc g() {\n}\n", "go")[2] == "truncation"
    assert syntax.diagnose("let a = 1;\n<<<<<<< HEAD\nlet b = 2;\n=======\nlet c = 3;\n>>>>>>> x\n", "javascript")[::2] == (1, "conflict")
    assert syntax.diagnose("def f(x):\n    return x\n", "typescript")[::2] == (1, "mismatch")
    assert syntax.diagnose("a: 1\nb:\n  - c\n", "go")[::2] == (1, "mismatch")
    assert syntax.diagnose("let a = f(1));\nlet b = 2;\n", "javascript") == (1, 1, "error", "delete:1")
    assert syntax.diagnose("def f(a):\n    x = g(a, 1\n    y = 2\n    return x\n", "python") == (1, 2, "error", "insert:2")
    assert syntax.diagnose("package a\n\n{% if x %}\nfunc f() {\n}\n", "go") == (2, 3, "error", "line:3")


def test_many_errors_have_their_cost():
    text = "".join(f"let a{i} = f({i}));\n" for i in range(2)) + "let b = 1;\n"
    assert syntax.diagnose(text, "javascript")[0] == 2
    text = "".join(f"let a{i} = f({i}));\nlet b{i} = ;\n" for i in range(8))
    assert syntax.diagnose(text, "javascript")[::2] == (3, "error")  # one run of lines


def test_least_cost_against_brute_force():
    g = chart.Grammar("s: '(' s ')' s | A s | ''\n".replace("| ''", "|"), "s")
    c = chart.Chart(g)
    code = {"(": g.code("("), ")": g.code(")"), "a": g.code("A")}

    def cost(t):
        from functools import lru_cache

        @lru_cache(None)
        def best(i, j):
            if i >= j:
                return 0
            v = best(i + 1, j) + (0 if t[i] == "a" else 1)
            for k in range(i + 1, j):
                pair = (t[i] != "(") + (t[k] != ")")
                v = min(v, pair + best(i + 1, k) + best(k + 1, j))
            return v

        return best(0, len(t))

    import itertools

    for n in range(1, 7):
        for t in itertools.product("()a", repeat=n):
            got, _ = repair.Search(c, "".join(code[x] for x in t), list(range(n)), plain=True).upto(9)
            assert got == cost(t), t


def test_rows(spark):
    rows = [(1, "r", "a.py", "Python", "x = 1\n"), (2, "r", "a.go", None, "pack"), (2, "r", "a.go", None, "pack"), (3, "r", "b.json", " JSON ", ""), (4, "r", "c.json", "json", None), (5, None, "d.zig", None, "x"), (6, "r", "e.rs", "", "fn")]
    d = spark.createDataFrame(rows, "file_id long, repository_id string, path string, language string, content string")
    from pyspark.sql import functions as F

    src = d.select("file_id", "repository_id", syntax.language_of(F.col("language"), F.col("path")).alias("language"), "content")
    got = {(r.file_id, r.language, r.edit_cost > 0) for r in syntax.repairs(src).collect()}
    assert got == {(1, "python", False), (2, "go", True), (6, "rust", True)}
    assert syntax.repairs(src.limit(0)).count() == 0
