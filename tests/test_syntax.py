"""Definitions and calls of brace languages."""

import time

import pytest

from corvid.sources.parse import parse

CPP = """#include "net/Agent.h"
#include <list.h>
#define X(a) \\
  foo(a) {
namespace ns { namespace inner {
template <typename T,
          class U = std::vector<T>>
static inline std::map<int, std::vector<T>>
make_map(const T& a,
         int b = f(3)) const noexcept
{
  if (a) { run<T>(b); }
  Agent::start(1); list(2); obj->go(3); Foo x(4); auto y = new Foo(5);
  char c = '{'; const char* s = "}"; /* } */
  return static_cast<int>(b);
}
class Widget final : public Base<int> {
 public:
  Widget(int a) : Base(a), m_{a}, v(g(a)) { init(); }
  ~Widget() { stop(); }
  void decl();
  enum class K { A, B };
  struct Inner { int z() { return 1; } };
};
}}
int Widget::Inner::run(int a) { return helper(a); }
struct S;
struct S *fn(struct S *p) { return p; }
extern "C" { int cfun(void) { return cfun2(); } }
"""
TS = """import {x} from './x';
export async function load<T extends {a: string}>(u: string): Promise<{a: T}> { const r = await fetch(u); return r.json(); }
export default class Foo<T> extends Bar<T> { private m = 1; go(a: number): void { this.run(a); helper(`a}`); } }
const a = 1, arrow = async (x: number): Promise<void> => { await sleep(x); }, short = x => f(x);
export const plain = function () { return g(); };
function outer() { function inner() { return /a{2}"/.test(s); } const z = () => q(); return new Thing(w()); }
app.get('/x', () => h(1));
"""
RUST = """use std::fmt;
#[derive(Debug, Clone)]
pub struct P<T> { a: T }
pub(crate) struct Unit;
impl<T: fmt::Display> fmt::Display for P<T> where T: Copy {
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "{}", self.a())?; self.a.fmt(f) }
}
trait Tr { fn sig(&self); fn dflt(&self) -> impl Fn(u8) -> u8 { helper::<u8>(1); |x| x } }
mod m { pub async fn go() { let c = '{'; Some(crate::x::y(c)); } }
fn main() { let s = r#"fn no() {}"#; m::go().await; }
"""
GO = """package a
type T struct { x int }
type I interface { F() }
type (
	A []int
	B map[string]int
)
type Al = int
func (t *T) Run(a interface{}) (r int, err error) { fmt.Println(a); go func() { work(a) }(); return t.x, nil }
func Gen[K comparable](m map[K]int) []K {
	return keys(m)
}
"""
JAVA = """package a;
/** doc { */
@Ann(value = "x{")
public class A<T extends Comparable<T>> extends B implements C {
  private final Map<String, List<T>> m = new HashMap<>();
  public A(int x) { super(x); init(); }
  @Override
  public <K> Map<K, T> go(K k, List<? super T> l) throws E {
    this.m.get(k).run(); Runnable r = new Runnable() { public void run() { deep(); } };
    return Util.<K>of(k);
  }
  abstract int nobody(int a); @Override public void last() { end(); }
  enum Q { X(1), Y(2); Q(int a) { setup(); } }
  interface I { void f(); }
}
"""


CSHARP = """using System;
#region x {
namespace N.M {
  [Attr(typeof(X))]
  public sealed class A<T> : B, I<T> where T : class, new() {
    private readonly Dictionary<string, List<T>> m = new Dictionary<string, List<T>>();
    public A(int x) : base(Make(x)) { Init($"}{x}"); }
    public int P { get { return Get(); } set; }
    public async Task<List<T>> Run<K>(K k, int[] a) where K : struct { await this.m.Go(k); return Util.Of<T>(k); }
    public int Short(int a) => Twice(a);
    protected abstract void None(int a);
    enum Q { X, Y }
  }
  public record R(int A, string B);
  struct S { void F() { var s = @"{"; new Thing(W()); } }
  interface J { int G(); }
}
"""


KOTLIN = """package a
data class P(val a: Int, val b: List<Pair<Int, Int>>) : Base(a), I

@Ann("x{")
public abstract class A<T : Any>(x: Int) : B(x) {
    private val m = make()
    init { setup() }
    override suspend fun <K> run(k: K, f: (K) -> Unit): Map<K, List<T>> { this.m.go(k); return helper<T>(k) }
    fun short(a: Int) = twice(a)
    abstract fun none(a: Int): Int
    companion object { fun of() = A(1) }
    enum class Q { X, Y }
}
interface J { fun g(): Int }
object Single { val s = "}" }
fun String?.ext(): Int {
    return length()
}
"""
SWIFT = """import x
public final class A<T: Equatable>: B, C where T: D {
    private let m = make()
    required init?(x: Int) { super.init(); setup() }
    @discardableResult
    static func run<K>(_ k: K, f: @escaping (K) -> Void) async throws -> [String: [T]] where K: E { self.m.go(k); return helper(k) }
    class var z: Int { get { return value() } }
    struct S { func f() {} }
}
extension A.S: P { func g() { f() } }
protocol J { func h() -> Int }
enum E { case a(Int); func i() { let s = "{" ; log(s) } }
func top() { A(x: 1) }
"""


def of(file, text):
    symbols, edges = parse(file, text)
    at = len(file) + 2
    return [(s.kind, s.fqn[at:], s.first, s.last) for s in symbols], [(e.from_fqn[at:], e.to_name, e.line, e.import_path) for e in edges]


def test_cpp():
    symbols, edges = of("a.cpp", CPP)
    assert symbols == [
        ("module", "ns", 5, 25), ("module", "ns::inner", 5, 25), ("function", "ns::inner::make_map", 8, 16), ("class", "ns::inner::Widget", 17, 24), ("method", "ns::inner::Widget::Widget", 19, 19),
        ("method", "ns::inner::Widget::~Widget", 20, 20), ("struct", "ns::inner::Widget::Inner", 23, 23), ("method", "ns::inner::Widget::Inner::z", 23, 23), ("method", "Widget::Inner::run", 26, 26), ("function", "fn", 28, 28), ("function", "cfun", 29, 29),
    ]
    make = "ns::inner::make_map"
    assert edges == [(make, "run", 12, None), (make, "start", 13, "net/Agent.h"), (make, "list", 13, "list.h"), (make, "go", 13, None), ("ns::inner::Widget::Widget", "init", 19, None), ("ns::inner::Widget::~Widget", "stop", 20, None), ("Widget::Inner::run", "helper", 26, None), ("cfun", "cfun2", 29, None)]


def test_typescript():
    symbols, edges = of("a.ts", TS)
    assert symbols == [("function", "load", 2, 2), ("class", "Foo", 3, 3), ("function", "arrow", 4, 4), ("function", "short", 4, 4), ("function", "plain", 5, 5), ("function", "outer", 6, 6), ("method", "outer::inner", 6, 6)]
    assert [e[:2] for e in edges] == [("load", "fetch"), ("load", "r.json"), ("Foo", "this.run"), ("Foo", "helper"), ("arrow", "sleep"), ("short", "f"), ("plain", "g"), ("outer::inner", '/a{2}"/.test'), ("outer", "q"), ("outer", "w")]


def test_rust():
    symbols, edges = of("a.rs", RUST)
    assert symbols == [("struct", "P", 3, 3), ("struct", "Unit", 4, 4), ("impl", "impl_P<T>", 5, 7), ("method", "impl_P<T>::fmt", 6, 6), ("trait", "Tr", 8, 8), ("function", "Tr::dflt", 8, 8), ("module", "m", 9, 9), ("function", "m::go", 9, 9), ("function", "main", 10, 10)]
    assert [e[:2] for e in edges] == [("impl_P<T>::fmt", "self.a.fmt"), ("Tr::dflt", "helper::<u8>"), ("m::go", "Some"), ("m::go", "crate::x::y"), ("main", "m::go")]


def test_go():
    symbols, edges = of("a.go", GO)
    assert symbols == [("struct", "T", 2, 2), ("struct", "I", 3, 3), ("struct", "A", 5, 5), ("struct", "B", 6, 6), ("method", "Run", 9, 9), ("function", "Gen", 10, 12)]
    assert [e[:2] for e in edges] == [("Run", "fmt.Println"), ("Run", "work"), ("Gen", "keys")]


def test_java():
    symbols, edges = of("A.java", JAVA)
    assert symbols == [("class", "A", 3, 15), ("method", "A::A", 6, 6), ("method", "A::go", 7, 11), ("method", "A::go::run", 9, 9), ("method", "A::nobody", 12, 12), ("method", "A::last", 12, 12), ("method", "A::Q", 13, 13), ("interface", "A::I", 14, 14), ("method", "A::I::f", 14, 14)]
    assert [e[:2] for e in edges] == [("A::A", "init"), ("A::go", "get"), ("A::go", "run"), ("A::go::run", "deep"), ("A::go", "of"), ("A::last", "end"), ("A::Q", "setup")]


def test_csharp():
    symbols, edges = of("a.cs", CSHARP)
    a = "N.M::A"
    assert symbols == [
        ("module", "N.M", 3, 17), ("class", a, 4, 13), ("method", f"{a}::A", 7, 7), ("method", f"{a}::Run", 9, 9), ("method", f"{a}::Short", 10, 10), ("method", f"{a}::None", 11, 11), ("enum", f"{a}::Q", 12, 12),
        ("class", "N.M::R", 14, 14), ("struct", "N.M::S", 15, 15), ("method", "N.M::S::F", 15, 15), ("interface", "N.M::J", 16, 16), ("method", "N.M::J::G", 16, 16),
    ]
    assert [e[:2] for e in edges] == [(f"{a}::A", "Init"), (a, "Get"), (f"{a}::Run", "this.m.Go"), (f"{a}::Run", "Util.Of<T>"), (f"{a}::Short", "Twice"), ("N.M::S::F", "W")]


def test_kotlin():
    symbols, edges = of("a.kt", KOTLIN)
    assert symbols == [
        ("class", "P", 2, 2), ("class", "A", 4, 13), ("method", "A::run", 8, 8), ("method", "A::short", 9, 9), ("method", "A::none", 10, 10), ("method", "A::of", 11, 11),
        ("enum", "A::Q", 12, 12), ("interface", "J", 14, 14), ("method", "J::g", 14, 14), ("class", "Single", 15, 15), ("function", "ext", 16, 18),
    ]
    assert [e[:2] for e in edges] == [("A", "make"), ("A", "setup"), ("A::run", "this.m.go"), ("A::run", "helper<T>"), ("A::short", "twice"), ("A::of", "A"), ("ext", "length")]


def test_swift():
    symbols, edges = of("a.swift", SWIFT)
    assert symbols == [
        ("class", "A", 2, 9), ("method", "A::init", 4, 4), ("method", "A::run", 5, 6), ("struct", "A::S", 8, 8), ("method", "A::S::f", 8, 8), ("extension", "A.S", 10, 10), ("method", "A.S::g", 10, 10),
        ("interface", "J", 11, 11), ("enum", "E", 12, 12), ("method", "E::i", 12, 12), ("function", "top", 13, 13),
    ]
    assert [e[:2] for e in edges] == [("A", "make"), ("A::init", "super.init"), ("A::init", "setup"), ("A::run", "self.m.go"), ("A::run", "helper"), ("A", "value"), ("A.S::g", "f"), ("E::i", "log"), ("top", "A")]


def test_a_page_is_read_by_its_script_and_broken_python_by_the_rest():
    assert of("a.svelte", "<p>f()</p>\n<script>\nfunction f() { g(); }\n</script>\n") == ([("function", "f", 3, 3)], [("f", "g", 3, None)])
    symbols, edges = of("a.py", "def a():\n    b()\n\ndef broken(:\n    c()\n\ndef d():\n    e()\n")
    assert [s[1] for s in symbols] == ["a", "d"] and [e[1] for e in edges] == ["b", "e"]


@pytest.mark.parametrize("text", ["(" * 20_000, "}" * 20_000, "a<" * 5_000, "f(a).b" * 10_000, "x, " * 20_000, "int a = b;\n" * 10_000, "v = 1\n" * 10_000, "'" * 20_001, "/*" * 20_000])
@pytest.mark.parametrize("file", ["a.cpp", "a.js", "a.rs", "a.go", "A.java", "a.cs", "a.kt", "a.swift"])
def test_odd_texts_end(file, text):
    began = time.process_time()
    parse(file, text)
    parse(file, "class A { void f() { " + text + " } }")
    assert time.process_time() - began < 30


def test_an_include_resolves_at_level_one(spark, tmp_path):
    from corvid.engine import Engine

    repo = tmp_path / "repo"
    for name, text in {"src/net/Agent.h": "class Agent { public: static void start() { boot(); } };\n", "lib/Agent.h": "class Other { void start() { } };\n", "app/main.cpp": '#include "net/Agent.h"\nint main() { Agent::start(); }\n'}.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(str(repo))
    (call,) = engine.store.read("calls").where("in_fqn like '%::main'").collect()
    assert call.out_fqn.endswith("src/net/Agent.h::Agent::start")
    assert engine.store.read("raw_edge").where("import_path = 'net/Agent.h'").count() == 1


def test_an_import_resolves_at_level_zero(spark, tmp_path):
    from corvid.engine import Engine

    repo = tmp_path / "repo"
    for name, text in {"go.mod": "module example.org/m\nrequire github.com/gin-gonic/gin v1\n", "main.go": 'package main\nfunc Routes(r *gin.Engine) {\n\tr.GET("/u", handlers.List)\n}\n', "handlers/z.go": "package handlers\nfunc List() {\n}\n", "a/a.go": "package a\nfunc List() {\n}\n"}.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(str(repo))
    assert [r.out_fqn for r in engine.store.read("calls").where("out_fqn like '%::List'").collect()] == [f"{repo}/handlers/z.go::List"]
    (repo / "main.go").write_text((repo / "main.go").read_text() + "// more\n")
    engine.update(str(repo))
    assert [r.out_fqn for r in engine.store.read("calls").where("out_fqn like '%::List'").collect()] == [f"{repo}/handlers/z.go::List"]
