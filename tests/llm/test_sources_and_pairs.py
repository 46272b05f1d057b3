"""Lexers on good and bad sources; pair counts and their null model against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import cooccurrence as co
from loamgraph.llm import queries
from loamgraph.llm.lexers import fault
from loamgraph.llm.source_validity import fault_rates, file_faults

GOOD = {
    "java": ["", "// only a comment\n", 'package a.b;\nimport java.util.*;\n@Ann(x = {1, 2})\npublic final class A<T extends B & C> extends D<T> implements E, F<Map<String, List<T>>> {\n  private int[] a = {1, 2}, b;\n  static { x(); }\n  enum K { A, B("x") { void f() {} }; K() {} }\n  record P(int x, String y) {}\n  A(int x) throws E { this.a = x > 1 ? null : -x; }\n  <R> R f(T... t) { for (int i = 0; i < 3; i++) { a[i] += i; } label: while (true) break label; return (R) t; }\n  int s(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; }\n  Runnable r = () -> { if (a instanceof Integer i && i > 0) return; };\n  String t = """\n    it\'s " fine {\n    """; char c = \'\\\'\'; }\n'],
    "kotlin": ['@file:JvmName("x")\npackage a.b\n\nimport c.d.*\nimport e.f as g\n\n/* outer /* inner */ { */\ndata class P(val a: Int = 1, private var b: String?) : Q<P>(a), R by s {\n    val c: Int get() = a + 1\n    companion object { const val X = "${a + "${1}"} $b" }\n    fun <T> f(x: (Int) -> Unit, vararg y: T): List<T>? = y.filter { it != null }.map { z -> z to 1 }\n    override fun g() {\n        for (i in 0 until 10) { x += i }\n        val t = when (a) { 1, 2 -> "x"; in 3..4 -> "y"; else -> """raw " ${a}"""\n        }\n        return@g\n    }\n}\nfun P.ext(): Int? = this.b?.length ?: throw E("x")\nval `odd name` = 1\n'],
    "go": ['package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype T[K comparable] struct {\n\tA int `json:"a"`\n\tB map[string][]*T\n}\n\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tfor i := 0; i < 3; i++ {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch v := t.(type) {\n\tcase int, string:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\ts := `raw\n<<<<<<< HEAD\n`\n\tr := \'\\\'\'\n\tif x := f(); x != nil && !y {\n\t\tdefer g()\n\t}\n\treturn\n}\n\nconst (\n\tA = iota\n\tB\n)\n\nvar _ = fmt.Sprint("x")\n'],
    "rust": ['#![allow(x)]\nuse std::{a::B, c};\n\n/* a /* b */ c } */\n#[derive(Debug)]\npub struct S<\'a, T: Clone + \'a> where T: X {\n    a: &\'a str,\n    b: Vec<Option<T>>,\n}\n\nimpl<\'a> S<\'a> {\n    pub fn f(&self, x: i32) -> Result<String, E> {\n        let y = |z: i32| z + 1;\n        for i in 0..10 { v.push(i); }\n        match x { 1 | 2 => a(), n if n > 3 => { b()? } _ => c, }\n        let s = r#"raw " {"#; let c = \'{\'; let l = "multi\n line";\n        println!("{} {}", x, y(1));\n        if let Some(q) = w { return Err(q.into()); }\n        Ok(s.to_string())\n    }\n}\nmod m { pub const X: u8 = b\'a\'; }\nenum E { A(i32), B { x: u8 } }\n'],
    "typescript": ["", 'import a, { b as c } from "d";\nexport interface I<T> extends J { x?: number; f(a: T): void; readonly [k: string]: any }\ntype U = { a: 1 } | "b" | (() => void);\nenum E { A = 1, B }\n@Dec()\nexport abstract class C<T> extends D<T> implements I<T> {\n  private readonly x: number = 1;\n  static y?: Map<string, Array<T>>;\n  constructor(private a: string, b?: number) { super(); }\n  get z(): string { return `a ${this.x + `${1}`} {`; }\n  async f<K extends keyof T>(a: K, ...r: unknown[]): Promise<void> {\n    const { p, q = 2 } = a as any;\n    for (const k of [1, 2]) { if (k! > 1) continue; }\n    const re = /[{(]+\\/"/g.test("x") ? 1 : 2;\n    return r.map((v): number => v?.w ?? 0).filter(Boolean)\n  }\n}\nconst g = <T,>(x: T) => x\nexport default g\n'],
    "javascript": ["", "import { a } from './a.js';\nexport class A extends B {\n  #p = 1;\n  static s = { x: 1, 'y': 2, [z]: 3 };\n  f(a, b = 2, ...c) { return a / b / 2 }\n  async *g() { yield* this.f() }\n}\nlet x = y\nlabel: for (;;) { break label }\nconst h = async ({ a, b: [c] }) => { await a?.b?.[c] }\nif (a) b(); else { c() }\nswitch (a) { case 'x': d(); break; default: }\nvar t = a ? { b: 1 } : c;\n"],
    "python": ["", 'import os\n\n\nclass A:\n    """it\'s (fine"""\n\n    def f(self, *a, **k) -> "x":\n        return f"{a[\'x\']} {{" if a else [\n            1,\n        ]\n# <<<<<<< quoted\nx = """\n<<<<<<< HEAD\n"""\nmatch x:\n    case {"a": 1}:\n        pass\n'],
}
BAD_EVERYWHERE = ["<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "<!doctype html>\n<html><body><h1>Hi</h1></body></html>\n", "The ribbon has to merge before the window closes.\nSee also:\n* how to merge\n", "@@ -1,2 +1,3 @@\n", "%% lost %% block\n", "....\n", '{\n  "name": "a",\n  "n": 1\n}\n']
BREAK = {
    "java": ["class A { String s = \"open; }\n", "class A { void f() { int x = 1 } }\n", "class A { void f() { x = ; } }\n", "class A { void f( { } }\n", "class A { int x\n", "import os\nclass A:\n    pass\n", "package a\nclass A\n", "/* open"],
    "kotlin": ['fun f() { val s = "open\n}\n', "fun f() { x = (1 }\n", "public class A { public String f(String a, int b) { return a; } }\n", "const a = require('b');\n", "fun f() {\n"],
    "go": ["", "func f() {}\n", "package a\nfunc f() { x := \"open\n}\n", "package a\nfunc f() { return 1\n", "package a;\nimport java.util.List;\npublic class A {}\n", "package a\n}\n"],
    "rust": ["fn f() { let x = 1; \n", "fn f() { let c = \"open; }\n", "package a\n\nimport (\n)\n", "class A: pass\n", "fn f() {}\n}\n"],
    "typescript": ["class A { f( { } }\n", "const x = 'open;\n", "package a.b;\nimport java.util.List;\n", "import os\ndef f():\n    pass\n", "let a = `x ${1 + 2\n", "# comment\n"],
    "javascript": ["class A { private x: number = 1; }\n", "export interface I { x: number }\n", "f(a: string) {}\n", "let a = 1 2\n", "package main\n"],
    "python": ["def f(:\n    pass\n", "if x:\npass\n", "print 'x'\n", "x = 'open\n", "class A {\n}\n", "  x = 1\n y = 2\n", "return 1\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_good_sources(language):
    for text in GOOD[language]:
        for t in (text, text.replace("\n", "\r\n")):
            assert fault(t, language) is None, t


@pytest.mark.parametrize("language", sorted(BREAK))
def test_bad_sources(language):
    for text in BREAK[language]:
        assert fault(text, language) is not None, text
    for text in BAD_EVERYWHERE:
        if not (language == "python" and text.startswith("{")):
            assert fault(text, language) is not None, text


@pytest.mark.parametrize("language", sorted(set(GOOD) - {"python"}))
def test_every_cut_inside_brackets_is_found(language):
    text = GOOD[language][-1]
    last = text.rindex("{")
    assert fault(text[: last + 1], language) is not None


def test_file_faults_of_odd_rows(spark):
    rows = [(1, "r", "a.java", None), (2, "r", None, "x"), (3, "r", "a.TXT", "x"), (4, "r", "A.PY", "x = ("), (5, None, "b.go", "package a\n" + "// long\n" * 50_000), (5, None, "b.go", ""), (6, "r", "x.rs", "(" * 5000 + ")" * 5000)]
    df = spark.createDataFrame(rows, "file_no long, repo string, path string, content string").withColumns({"language": F.lit(0), "fault": F.lit(0)})
    got = Counter((r["file_no"], r["language"], r["fault"] is not None) for r in file_faults(df).collect())
    assert got[(4, "python", True)] == 1 and got[(1, "java", False)] == 1 and got[(2, None, False)] == 1 and got[(3, None, False)] == 1
    assert got[(5, "go", False)] == 1 and got[(5, "go", True)] == 1
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in fault_rates(file_faults(df)).collect()}
    assert rates[(None, "go")] == (2, 1) and file_faults(df.limit(0)).count() == 0


def pairs_by_force(rows, least):
    by = {}
    for s, b, i in rows:
        if None not in (s, b, i):
            by.setdefault((s, b), set()).add(i)
    c = Counter((s, *p) for (s, _), xs in by.items() for p in itertools.combinations(sorted(xs), 2))
    return {(*k, v) for k, v in c.items() if v >= least}


@pytest.mark.parametrize("large_baskets", [3, 8])
def test_pair_counts(spark, large_baskets):
    rnd = random.Random(large_baskets)
    rows = []
    for s in "ab":
        for b in range(25):
            many = 20 if b < (2 if s == "a" else large_baskets) else rnd.randint(1, 5)
            rows += [(s, f"{s}{b}", f"i{i:02d}") for i in rnd.sample(range(30), many)]
    rows += rows[:40] + [(None, "x", "y"), ("a", None, "y"), ("a", "x", None)]
    m = co.memberships(spark.createDataFrame(rows, "s string, b string, i string"), "b", "i", F.col("s"))
    from loamgraph.sources.tables import Scratch

    for least in (2, 5):
        assert {tuple(r) for r in co.pair_counts(m, least, Scratch(spark), large=8).collect()} == pairs_by_force(rows, least)


def test_poisson_binomial_tail():
    rnd = np.random.default_rng(0)
    p, n = rnd.random(4) * 0.4, np.array([3, 1, 4, 2])
    pmf = np.ones(1)
    for q, k in zip(p, n):
        for _ in range(k):
            pmf = np.convolve(pmf, [1 - q, q])
    for least in range(12):
        assert math.isclose(co.tail(p, n, least), pmf[least:].sum() if least < len(pmf) else 0.0, rel_tol=1e-9, abs_tol=1e-12)
    assert 0 < co.tail(np.array([1e-6]), np.array([1000]), 5) < 1e-15


def test_null_model_keeps_degrees():
    d, c, s, t = np.array([1, 2, 5]), np.array([10, 4, 2]), np.array([1, 3, 4]), np.array([9, 3, 3])
    x, y = co.fit_null(d, c, s, t)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (c * d).sum() == 28 and np.allclose((p * t).sum(1) / d, (p * t).sum() and ((p * t).sum(1) / d).mean(), rtol=0.2)


def test_surprise(spark):
    rnd = random.Random(2)
    rows = [("w", f"b{i}", f"x{rnd.randrange(20)}") for i in range(300) for _ in range(2)] + [("w", f"t{i}", x) for i in range(12) for x in ("p", "q")]
    m = co.memberships(spark.createDataFrame(rows, "s string, b string, i string"), "b", "i", F.col("s"))
    got = {(r["item_a"], r["item_b"]): r for r in co.surprising_pairs(m).collect()}
    best = min(got.values(), key=lambda r: r["p_value"])
    assert (best["item_a"], best["item_b"]) == ("p", "q") and best["q_value"] < 1e-6 and best["n_ab"] == 12
    ps = sorted((r["p_value"], r["q_value"]) for r in got.values())
    assert all(q >= p for p, q in ps) and [q for _, q in ps] == sorted(q for _, q in ps)
    assert co.surprising_pairs(m.limit(0)).count() == 0


def test_surprise_of_every_pair(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(f"c{i}", f"r/f{rnd.randrange(12)}") for i in range(60) for _ in range(3)] + [(f"o{i}", f"r/{x}{i}") for i in range(40) for x in "ab"] + [(f"c{i}", "r/f0") for i in range(30)]
    spark.createDataFrame([("MODIFIES", a, b) for a, b in rows], "kind string, src string, dst string").write.parquet(str(tmp_path / "edges.parquet"))
    got = {(r["item_a"], r["item_b"]): r for r in queries.p2_surprise(spark, str(tmp_path)).collect()}
    baskets = {}
    for c, f in rows:
        baskets.setdefault(c, set()).add(f)
    want = Counter(p for fs in baskets.values() for p in itertools.combinations(sorted(fs), 2))
    assert {k: r["n_ab"] for k, r in got.items()} == want and 1 in want.values()
    n = len({f for _, f in rows})
    ordered = sorted(r["p_value"] for r in got.values())
    least, q = 1.0, {}
    for p in sorted(set(ordered), reverse=True):
        least = q[p] = min(least, p * n * (n - 1) / 2 / sum(x <= p for x in ordered))
    assert all(math.isclose(r["q_value"], q[r["p_value"]], rel_tol=1e-9) for r in got.values())
