"""Operators against plain Python, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.functions import imports as script_imports
from corvid.functions import paths, text, vectors
from corvid.operators import cache, filters, graph, incremental, intervals, ranking, vector
from corvid.plans.query import Filters, parse
from corvid.sources import chunker
from corvid.sources import parse as parsing
from corvid.sources.files import IgnoreRules


def test_capped_merge_is_the_sequential_fold(spark):
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(30)}", s := rng.randrange(200), s + rng.randrange(40), float(rng.randrange(100)), rng.choice([[], ["x"]])) for _ in range(600)]
    df = spark.createDataFrame([(f, s, e, v, v, f"{s}-{e}", None, None, None, d) for f, s, e, v, d in rows], "file string, line_start int, line_end int, score double, rank double, content string, symbol string, symbol_fqn string, symbol_kind string, duplicates array<string>")
    got = sorted((r.file, r.line_start, r.line_end, r.score, tuple(r.duplicates)) for r in intervals.merged_capped(df, ["file"]).collect())
    want = []
    for f in {r[0] for r in rows}:
        out = []
        for _, s, e, v, d in sorted((r for r in rows if r[0] == f), key=lambda r: (r[1], r[2], r[3], r[3], f"{r[1]}-{r[2]}", r[4])):
            if out and s <= out[-1][1] + 2 and d == out[-1][3] and max(e, out[-1][1]) - out[-1][0] + 1 <= 60:
                a = out[-1]
                out[-1] = [a[0], max(a[1], e), max(a[2], v), d]
            else:
                out.append([s, e, v, d])
        want += [(f, s, e, v, tuple(d)) for s, e, v, d in out]
    assert got == sorted(want)


def test_capped_merge_appends_what_does_not_overlap(spark):
    df = spark.createDataFrame([("a", 1, 3, 1.0, 1.0, "1\n2\n3", None, "f", None, []), ("a", 3, 5, 2.0, 0.5, "3\n4\n5", "s", "g", "k", [])], "file string, line_start int, line_end int, score double, rank double, content string, symbol string, symbol_fqn string, symbol_kind string, duplicates array<string>")
    (r,) = intervals.merged_capped(df, ["file"]).collect()
    assert (r.line_start, r.line_end, r.score, r.rank, r.content, r.symbol, r.symbol_fqn) == (1, 5, 2.0, 1.0, "1\n2\n3\n4\n5", "s", "f")


def test_weighted_merge_keeps_raw_scores_and_lists_copies(spark):
    rows = [("b.py", 1, 2, 0.9, "same\ntext"), ("a.py", 1, 2, 0.9, "same  \r\ntext"), ("c.py", 5, 9, 0.5, "other"), ("c.py", 6, 7, 0.4, "inner")]
    df = spark.createDataFrame([(f, s, e, v, c, None, None, None) for f, s, e, v, c in rows], "file string, line_start int, line_end int, score double, content string, symbol string, symbol_fqn string, symbol_kind string")
    got = [(r.file, r.line_start, r.line_end, r.score, r.duplicates) for r in ranking.weighted_merge(df, 10, F.when(F.col("file") == "c.py", 2.0).otherwise(1.0)).collect()]
    assert got == [("c.py", 5, 9, 0.5, []), ("a.py", 1, 2, 0.9, ["b.py"])]


def test_class_weights(spark):
    rows = [("/r/a.css", ".x {}"), ("/r/src/x.test.ts", "jest.mock('a')"), ("/r/i.ts", "import a from 'b'\n"), ("/r/i.ts", "foo()"), ("/r/__mocks__/m.js", "x()")]
    df = spark.createDataFrame(rows, "file string, content string")
    got = lambda q: [r[0] for r in df.select(ranking.class_weight(F.col("file"), F.col("content"), [q], Filters(), ["/r"])).collect()]
    assert got("how") == [0.9, 0.9, 0.85, 1.0, 0.9]
    assert got("CSS tests") == [1.0, 1.0, 0.85, 1.0, 1.0]


@pytest.mark.parametrize(("source", "want"), [("import a from 'b'", True), ("import {a} from \"x\";\n// c\nexport * from 'y'", True), ("import a from 'b'; f()", False), ("", False), ("'use strict'", False), ("const x = require('y')", True)])
def test_import_only(source, want):
    assert script_imports.is_import_only(source) is want


def test_parse_merges_external_filters():
    q = parse("find kind:class scope:docs", Filters(paths=["src/"], scope="code"))
    assert (q.text, q.filters.kinds, q.filters.paths, q.filters.scope) == ("find", ["class"], ["src/"], "code")
    assert parse("scope::resolve x").text == "scope::resolve x"
    assert parse('name:"open').filters.names == ["open"]


def test_names_pass_without_symbol_and_go_fuzzy_only_without_any(spark):
    df = spark.createDataFrame([("parse_file",), ("parse_fil",), (None,)], "symbol string")
    assert {r[0] for r in filters.named(df, ["parse_file"]).collect()} == {"parse_file", None}
    assert {r[0] for r in filters.named(df.where("symbol is not null"), ["parze_file"]).collect()} == {"parse_file", "parse_fil"}
    assert filters.named(df.limit(0), ["x"]).collect() == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0],), ([],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.normalised(F.col("v"))).collect()][:2] == [[0.6, 0.8], [0.0, 0.0]]
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("v"), [3.0, 4.0])).collect()] == [1.0, 0.0, 0.0, 0.0]
    q = df.select(vectors.quantised(vectors.normalised(F.col("v"))).alias("q"))
    assert q.first()[0] == [76, 102]
    assert vector.top_k(df.limit(0), [1.0], 3, ["v"], "v").count() == 0


def test_lines_and_keys(spark):
    df = spark.createDataFrame([("a\r\nb \n",), ("",), ("  \n\t",), ("x\u00a0\ny",), (None,)], "t string")
    got = df.select(text.lines(F.col("t")), text.content_key(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "b "], [], ["  ", "\t"], ["x\u00a0", "y"], None]
    assert [r[1] for r in got] == ["a\nb", None, None, "x\ny", None]
    assert df.limit(1).select(text.numbered(F.col("t"), 2, 9)).first()[0] == "2: b "
    long = spark.createDataFrame([("\n".join(map(str, range(200))),)], "t string").select(text.middle_cut(F.col("t"))).first()[0].split("\n")
    assert len(long) == 101 and long[0] == "0" and long[-1] == "199"


def test_repo_paths(spark):
    df = spark.createDataFrame([("/Foo/bar/a.py",), ("/foobar/a.py",), ("/foo/bar/test/b.py",)], "f string")
    assert [r[0] for r in df.select(paths.in_repo(F.col("f"), "/foo/")).collect()] == [False, False, True]
    assert [r[0] for r in df.select(paths.repo_relative(F.col("f"), ["/foo", "/foo/bar"])).collect()] == ["a.py", "a.py", "test/b.py"]
    assert df.limit(1).select(paths.ancestors(F.col("f"))).first()[0] == ["/Foo/bar", "/Foo", ""]


def test_expand_does_not_go_through_seeds_or_nodes_without_a_chunk(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a"), ("e", "d"), ("a", "a")], "in_fqn string, out_fqn string")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, score double")
    got = {r.node: round(r.score, 4) for r in graph.expand(seeds, calls).collect()}
    assert got == {"d": 0.6, "b": 0.5, "e": 0.36, "c": 0.25}
    only = spark.createDataFrame([("c",), ("d",)], "node string")
    assert {r.node for r in graph.expand(seeds, calls, allowed=only).collect()} == {"d"}


def test_increment_equals_full(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    world = lambda: [(f"f{i}::{n}", n, f"f{i}", k, k + 5) for i in range(10) for k, n in enumerate(rng.sample(names, 4))]
    s_schema = "fqn string, name string, file string, line_start int, line_end int"
    for _ in range(3):
        before = world()
        edges = [(i, f"f{rng.randrange(10)}", None, rng.choice(names), 1, None) for i in range(120)]
        edges = [(i, f, f"{f}::x{i}", t, n, p) for i, f, _, t, n, p in edges]
        touched = {f"f{rng.randrange(10)}" for _ in range(2)}
        after = [r for r in before if r[2] not in touched] + [r for r in world() if r[2] in touched]
        raw = spark.createDataFrame(edges, "edge_id long, from_file string, from_fqn string, to_name string, line int, import_path string")
        b, a = spark.createDataFrame(before, s_schema), spark.createDataFrame(after, s_schema)
        cols = ["in_fqn", "out_fqn", "line", "in_file", "out_file"]
        old = graph.resolve(raw, b).select(*cols)
        delta = incremental.surface_delta(b, a)
        radius = incremental.blast_radius(spark.createDataFrame([(f,) for f in touched], "file string"), delta, old, raw)
        assert sorted(incremental.re_resolved(old, radius, raw, a).collect()) == sorted(graph.resolve(raw, a).select(*cols).collect())


def test_scope_of_an_update():
    assert incremental.scoped(63, 1) and incremental.scoped(64, 512) and not incremental.scoped(64, 511)
    assert [incremental.backoff(n) for n in (1, 2, 6, 9)] == [60, 120, 1800, 1800]


def test_rerank_never_fails(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, t string")
    order = lambda f: [r.t for r in ranking.rerank(df, "q", f).orderBy("pos").collect()]
    assert order(lambda q, rows: [0.1, 0.9, 0.1]) == ["b", "a", "c"]
    assert order(None) == order(lambda q, rows: [1.0]) == order(lambda q, rows: 1 / 0) == ["a", "b", "c"]


def test_pruned_rows(spark):
    df = spark.createDataFrame([("a", 1, 10, [(2, 3)]), ("b", 1, 30, [(2, 3), (9, 9)]), ("c", 1, 30, None)], "f string, line_start int, line_end int, ranges array<struct<start:int,end:int>>")
    assert sorted((r.f, r.line_start, r.line_end) for r in ranking.pruned_rows(df).collect()) == [("a", 1, 10), ("b", 2, 3), ("b", 9, 9), ("c", 1, 30)]


def test_blocks_join_and_keep_the_busiest_callers(spark):
    df = spark.createDataFrame([(0, "a", 1, 5, 2, 1, ["x"]), (3, "a", 6, 9, 7, 2, ["y"]), (1, "a", 20, 21, None, None, None)], "pos int, file string, line_start int, line_end int, callers int, caller_files int, caller_names array<string>")
    assert sorted((r.pos, r.line_start, r.line_end, r.callers) for r in ranking.merged_blocks(df).collect()) == [(0, 1, 9, 7), (1, 20, 21, None)]


def test_text_batches():
    assert [len(b) for b in cache.batches(["x"] * 300)] == [128, 128, 44]
    assert [b for b in cache.batches(["aaaa", "b", "c" * 20], 10, 5)] == [["aaaa", "b"], ["c" * 20]]


def test_vectors_come_from_the_cache_first(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, content string")
    known = spark.createDataFrame([("0cc175b9c0f1b6a831c399e269772661", [9.0])], "key string, embedding array<float>")
    got = {r.id: r.embedding for r in cache.with_vectors(texts, known, lambda t: [[float(len(t))]] * len(t)).collect()}
    assert got[1] == [9.0] and got[2] == got[3] != [9.0]


def test_windows_cover_without_overlap():
    rng = random.Random(5)
    for _ in range(200):
        lines = ["x" * rng.randrange(60) for _ in range(rng.randrange(40))]
        out = chunker.windows("\n".join(lines) + "\n" * rng.randrange(2), 80)
        assert [n for a, b in out for n in range(a, b + 1)] == list(range(1, (out[-1][1] if out else 0) + 1))
        assert all(b > a for a, b in out[:-1])
    assert chunker.windows("\n".join(["x" * 800] * 5)) == [(1, 2), (3, 4), (5, 5)]


@pytest.mark.parametrize(
    ("file", "source", "symbols", "edges"),
    [
        ("a.py", "class A:\n    def f(self):\n        g(1); self.h()\n\ndef g(x):\n    return x\ng(2)\n", {("class", "A"), ("method", "A::f"), ("function", "g")}, {("f", "g"), ("f", "self.h")}),
        ("a.rs", "struct S { a: u8 }\nimpl S {\n  fn new() -> S { helper(1) }\n}\nfn helper(x: u8) -> S { a::b(x) }\n", {("struct", "S"), ("impl", "impl_S"), ("method", "impl_S::new"), ("function", "helper")}, {("new", "helper"), ("helper", "a::b")}),
        ("a.go", "package a\ntype T struct { x int }\nfunc (t *T) Run() { t.x = foo(1) }\nfunc foo(a int) int { return a }\n", {("struct", "T"), ("method", "Run"), ("function", "foo")}, {("Run", "foo")}),
        ("A.java", "public class A {\n  public List<String> run(int a) {\n    foo.bar(a);\n    return x;\n  }\n}\n", {("class", "A"), ("method", "A::run")}, {("run", "bar")}),
        ("a.ts", "export class A {\n  run(a: number): void {\n    this.go(a);\n  }\n}\nexport const f = (x) => {\n  g(x);\n};\n", {("class", "A"), ("function", "f")}, {("A", "this.go"), ("f", "g")}),
        ("a.cpp", "namespace n {\nclass B {\n  void f() { g(); }\n};\n}\n", {("module", "n"), ("class", "n::B"), ("method", "n::B::f")}, {("f", "g")}),
        ("a.rb", "class A\n  def run(x)\n    foo(x)\n  end\nend\n", {("class", "A"), ("method", "A::run")}, {("run", "foo")}),
        ("a.lua", "local function f(x)\n  return g(x)\nend\n", {("function", "f")}, {("f", "g")}),
        ("a.php", "<?php\nclass A {\n  function f() { $this->g(); }\n}\n", {("class", "A"), ("method", "A::f")}, {("f", "g")}),
        ("a.cs", "namespace N {\n  class A {\n    public int Run(int x) { return Foo(x); }\n  }\n}\n", {("module", "N"), ("class", "N::A"), ("method", "N::A::Run")}, {("Run", "Foo")}),
        ("a.kt", "class A {\n  fun run() { foo() }\n}\n", {("class", "A"), ("method", "A::run")}, {("run", "foo")}),
        ("a.swift", "struct S {\n  func run() { foo() }\n}\n", {("struct", "S"), ("method", "S::run")}, {("run", "foo")}),
        ("x.svelte", "<h1>f()</h1>\n<script>\nfunction f() { g(); }\n</script>\n", {("function", "f")}, {("f", "g")}),
        ("bad.py", "def f(:\n", set(), set()),
        ("a.unknown", "f()", set(), set()),
    ],
)
def test_parsers(file, source, symbols, edges):
    s, e = parsing.parse(file, source)
    assert {(x.kind, x.fqn.removeprefix(file + "::")) for x in s} == symbols
    assert {(x.from_name, x.to_name) for x in e} == edges


def test_files_that_cannot_be_parsed_have_a_status(spark):
    files = spark.createDataFrame([("a.py", b"x = 1\n"), ("b.py", b"\xff\xfe"), ("c.py", b"a\0b"), ("d.py", None)], "path string, content binary")
    got = {r.path: r.status for r in parsing.parsed(files).where("kind = 'file'").collect()}
    assert got == {"a.py": "ok", "b.py": "binary", "c.py": "binary", "d.py": "unreadable"}


def test_ignore_rules():
    r = IgnoreRules([("", "build.log\n*.tmp.py\n/top/\n!keep.tmp.py\na/**/z.py"), ("sub", "x.py")])
    assert [r.ignores(p) for p in ("src/z.tmp.py", "q/build.log", "top/a.py", "s/top/a.py", "keep.tmp.py", "a/b/c/z.py", "sub/x.py", "x.py")] == [True, True, True, False, False, True, True, False]
