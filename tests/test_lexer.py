"""What the token parser finds in each language, one line or many, and what it must leave alone."""

import pytest

from tessera.operators import lexer, parsers


def of(language, text):
    rows = lexer.rows(text, language)
    defs = {(r[2], r[1]): r for r in rows if r[0] == "def"}
    calls = {(r[2], r[7]) for r in rows if r[0] == "ref" and r[1] == "calls"}
    types = {r[2] for r in rows if r[0] == "ref" and r[1] == "references"}
    impls = {(r[5], r[2]) for r in rows if r[0] == "impl"}
    return defs, calls, types, impls


RUST = '''
#[derive(Clone, Debug)]
pub struct Foo<T> { inner: Vec<T> }
pub trait Show { fn show(&self); fn twice(&self) { self.show(); } }
type Result<T> = std::result::Result<T, ()>;
pub(crate) enum Command { #[x] DoSomething { arg: String }, Other(Bar), Last }
impl<T: Clone> Show for Foo<T>
where
    T: Send,
{
    fn show(&self) {
        /* fn not_this() { /* nested? */
        let s = "fn nor_this() { call() }"; let c = '{'; let r = r#"fn raw() { "quoted" }"#;
        helper(s);
        Foo::<T>::build(c);
    }
}
impl Foo<u8> { fn new() -> Self { Foo { inner: Vec::new() } } fn get_one<T>(&self) {} }
pub async fn long_signature(
    first: Bar,
    second: &'static str,
) -> Result<Foo<u8>> {
    first.get_one::<u8>(); println!("{}", x); one(Two::three(4))
}
'''


def test_rust():
    defs, calls, types, impls = of("rust", RUST)
    assert set(defs) == {("Foo", "struct"), ("Show", "trait"), ("twice", "function"), ("Result", "type_alias"), ("Command", "enum"), ("DoSomething", "struct"), ("Other", "struct"), ("Last", "struct"), ("show", "method"), ("new", "method"), ("get_one", "method"), ("long_signature", "function")}
    d = defs["long_signature", "function"]
    assert (d[3], d[4], d[6]) == (19, 24, "pub async fn long_signature(") and defs["show", "method"][3:5] == (11, 16)
    assert defs["Foo", "struct"][6] == "pub struct Foo<T> { inner: Vec<T> }"
    assert {("helper", None), ("build", None), ("get_one", None), ("one", None), ("three", "Two"), ("new", "Vec"), ("show", None)} == calls
    assert impls == {("Foo", "Show"), ("Foo", None)} and {"Foo", "Bar", "Vec", "Two", "Send", "Clone"} <= types
    defs, calls, types, _ = of("rust", "pub fn add(a: i32, b: i32) -> i32 { a + b }\npub fn run() { let _ = add(1, 2); helper(); }\nfn helper() {}\n")
    assert set(defs) == {("add", "function"), ("run", "function"), ("helper", "function")} and calls == {("add", None), ("helper", None)}
    assert of("rust", "enum E { A, B(u8) }\nfn f() -> impl Fn(u8) -> u8 { make() }")[3] == set()


JAVA = '''
package a.b; import java.util.List;
/* class Commented { */
@Entity(name = "x")
public final class Foo<T extends Base> extends Bar<T> implements Runnable, java.util.Comparable<Foo> {
  private static final List<String> NAMES = List.of("class Inner { void no() {} }");
  enum Color { RED(1), GREEN(2); Color(int v) { set(v); } }
  record Point(int x, int y) {}
  public Foo(int a) { super(a); this.a = a; }
  @Override
  public <R> Map<String, List<R>>
      convert(List<R> in,
              int n) throws IOException, OtherException
  {
    String s = """
      void text() { block(); }
      """;
    if (n > 0) { return helper(new Thing(n)); }
    for (Item i : items()) Util.log(i);
    return null;
  }
  abstract int size();
  void one() { two(); } void two() { }
}
interface Shape extends Other { double area(); }
'''


def test_java():
    defs, calls, types, impls = of("java", JAVA)
    assert set(defs) == {("Foo", "class"), ("Color", "enum"), ("Color", "method"), ("Point", "class"), ("Foo", "method"), ("convert", "method"), ("size", "method"), ("one", "method"), ("two", "method"), ("Shape", "trait"), ("area", "method")}
    assert defs["Foo", "class"][3:5] == (4, 24) and defs["convert", "method"][3:5] == (10, 21)
    assert calls == {("of", "List"), ("set", None), ("helper", None), ("items", None), ("log", "Util"), ("two", None)}
    assert impls == {("Foo", "Bar"), ("Foo", "Runnable"), ("Foo", "Comparable")} and {"Bar", "Base", "Thing", "Item", "IOException", "Map"} <= types and "Util" not in types
    defs, calls, _, impls = of("java", "class Bar {}\ninterface Runnable {}\nclass Foo extends Bar implements Runnable {\n  void helper() {}\n  void run() { helper(); }\n}\n")
    assert {("Foo", "class"), ("Runnable", "trait"), ("helper", "method"), ("run", "method")} <= set(defs) and impls == {("Foo", "Bar"), ("Foo", "Runnable")} and calls == {("helper", None)}


def test_csharp():
    text = '''
using System;
#region class Nothing { }
namespace A.B {
  [Serializable]
  public class Foo<T> : Bar<T>, IRun where T : class, new() {
    public int Size { get; set; }
    public Foo(int x) : base(x) { Init(); }
    void Helper() {}
    public async Task<int> Run(
        Thing t) => await Other.Helper(t, @"verbatim ""void no() {}""", $"{t}");
    int Twice(int a) { var x = new Widget(a); return Helper2<int>(x); }
  }
  public struct Vec { public double Length() { return Math.Sqrt(1); } }
  interface IRun { void Go(); }
  enum Kind { One, Two }
  public record Person(string Name);
}
'''
    defs, calls, types, impls = of("csharp", text)
    assert set(defs) == {("Foo", "class"), ("Foo", "method"), ("Helper", "method"), ("Run", "method"), ("Twice", "method"), ("Vec", "struct"), ("Length", "method"), ("IRun", "trait"), ("Go", "method"), ("Kind", "enum"), ("Person", "class")}
    assert defs["Foo", "class"][3:5] == (5, 13) and defs["Run", "method"][3:5] == (10, 11)
    assert {("Init", None), ("Helper", "Other"), ("Sqrt", "Math")} <= calls and impls == {("Foo", "Bar"), ("Foo", "IRun")} and {"Thing", "Widget"} <= types
    defs, calls, _, impls = of("csharp", "class Bar {}\ninterface IRun {}\nclass Foo : Bar, IRun {\n  void Helper() {}\n  void Run() { Helper(); }\n}\n")
    assert impls == {("Foo", "Bar"), ("Foo", "IRun")} and calls == {("Helper", None)} and ("Run", "method") in defs


def test_javascript_and_typescript():
    text = '''
// class No {}
export default class Foo extends lib.Bar { #x = 1; method() { this.x(); } static async *gen(a, b = {c: 1}) { yield other(`text ${a} function no() {}`); } get size() { return 1; } }
class Bar {}
function* numbers() { yield 1; }
export async function load(
  url, {a, b}
) {
  if (url) { return fetch(url).then((r) => r.json()); }
  for (const x of list()) { new Thing(x); }
  const re = /function\\s+no\\(/g; return Util.call(re);
}
const o = { inner(a) { return a; }, arrow: (b) => b };
'''
    defs, calls, types, impls = of("javascript", text)
    assert set(defs) == {("Foo", "class"), ("method", "method"), ("gen", "method"), ("size", "method"), ("Bar", "class"), ("numbers", "function"), ("load", "function"), ("inner", "method")}
    assert defs["load", "function"][3:5] == (6, 12) and impls == {("Foo", "Bar")} and types == set()
    assert calls == {("x", None), ("other", None), ("fetch", None), ("then", None), ("json", None), ("list", None), ("call", "Util")}
    ts = "abstract class Foo<T> extends Bar<T> implements Runs {\n  private x: Item<T>[] = [];\n  constructor(private a: Dep) { super(); }\n  abstract size(): number;\n  run<K extends Key>(k: K): Promise<Out> {\n    return this.helper(k as Other);\n  }\n}\nexport function go(a: In): void { Foo.make(a); }\n"
    for language in ("typescript", "tsx"):
        defs, calls, types, impls = of(language, ts)
        assert set(defs) == {("Foo", "class"), ("constructor", "method"), ("run", "method"), ("go", "function")} and defs["run", "method"][3:5] == (5, 7)
        assert calls == {("helper", None), ("make", "Foo")} and impls == {("Foo", "Bar")} and {"Bar", "Runs", "Item", "Dep", "Key", "Promise", "Out", "Other", "In"} <= types
    assert of("javascript", "class Foo extends Bar { method() { this.x(); } }\nclass Bar {}\n")[3] == {("Foo", "Bar")}


def test_go():
    text = "package p\ntype Point struct { X int }\ntype (\n\tPair[T any] struct {\n\t\tA T\n\t}\n\tAlias = int\n)\ntype Shape interface { Area() float64 }\nfunc helper() int { return 1 }\nfunc (p *Point) Move(\n\tdx int,\n) (int, error) {\n\ts := `func no() { call() }`\n\treturn helper(), fmt.Errorf(s)\n}\nfunc Map[T any](f func(T) T) { f(1) }\n"
    defs, calls, types, impls = of("go", text)
    assert set(defs) == {("Point", "struct"), ("Pair", "struct"), ("helper", "function"), ("Move", "method"), ("Map", "function")} and defs["Move", "method"][3:5] == (11, 16)
    assert calls == {("helper", None), ("Errorf", None), ("f", None)} and types == impls == set()


def test_c_and_cpp():
    text = '''
#include "util.h"
#define MAKE(x) void x() { \\
  no(x); }
struct Point { int x; };
typedef struct node { struct node *next; } node_t;
enum color { RED, GREEN };
union both { int i; float f; };
static int counter = 0, *other = NULL;
int add(int a, int b) { return a + b; }
extern char *
name_of(struct Point *p,
        const char *s);
int run(void) { int x = add(1, 2); Point q; for (;;) { if (x) break; } return p->call(x); }
'''
    defs, calls, types, _ = of("c", text)
    assert set(defs) == {("Point", "struct"), ("node", "struct"), ("node_t", "type_alias"), ("color", "enum"), ("both", "struct"), ("add", "function"), ("name_of", "function"), ("run", "function")}
    assert defs["name_of", "function"][3:5] == (11, 13) and calls == {("add", None), ("call", None)} and "Point" in types
    text = '''
namespace a { template <typename T> class Bar {}; }
class Foo final : public a::Bar<int>, private virtual Base {
public:
  Foo(int x) : x_(x) { init(); }
  ~Foo();
  void helper();
  template <class U> std::vector<U> all() const noexcept override { return make<U>(x_); }
  enum class Kind { A, B };
};
void Foo::helper() { R"x(void no() { )x"; }
using Alias = std::map<int, Foo>;
void run(Foo* f) { f->helper(); Foo g(1); Util::go(); auto l = [&](int a) { return inner(a); }; }
'''
    defs, calls, types, impls = of("cpp", text)
    assert set(defs) == {("Bar", "class"), ("Foo", "class"), ("Foo", "method"), ("helper", "method"), ("all", "method"), ("Kind", "enum"), ("Alias", "type_alias"), ("run", "function")}
    assert impls == {("Foo", "Bar"), ("Foo", "Base")} and {("helper", None), ("go", "Util"), ("init", None), ("inner", None)} <= calls and "Foo" in types and ("g", None) not in calls
    defs, calls, types, impls = of("cpp", "class Bar {};\nclass Foo : public Bar {\npublic:\n  void helper();\n};\nvoid Foo::helper() {}\nvoid run(Foo* f) { f->helper(); }\n")
    assert {("Foo", "class"), ("helper", "method")} <= set(defs) and impls == {("Foo", "Bar")} and ("helper", None) in calls and "Foo" in types


@pytest.mark.parametrize("language", sorted(lexer.LANGUAGES))
def test_broken_text_ends(language):
    for text in ("", "{", "}", "class", "fn (", "class A {", 'x = "open', "/* open", "((((", "}{)(", "a<b<c<d", "fn f<T", "é ü 日本(", "\\", "#", "@", "func (", "typedef", "enum E { A,", "impl", "class X : ", "'", "`", "record", "type ("):
        assert isinstance(parsers.parse(text, language), list)
    deep = "{(" * 2000 + ")}" * 2000
    assert parsers.parse(deep, language) == []
