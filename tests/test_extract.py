from __future__ import annotations

import ast
import time

import pytest
from pyspark.sql import functions as F

from symloom.functions import versions
from symloom.sources import extract
from symloom.sources.extract import braces

from .extract_facts import FACTS, SOURCES

TS = """import { a } from './dep';
export * from "../up";
// Says hello.
export function hello(name: string): string { return format(name); }
const add = (x: number) => x + 1;
export class User extends Base implements Named {
  private id: number;
  constructor(id: number) { this.id = id; }
  save(): void { store("{ not a brace }"); }
}
interface Named { name: string }
enum Color { Red }
type Alias = string;
const limit = 3;
"""
GO = """package main
import (
  "fmt"
  "os"
)
type User struct {
  Name string
}
type Saver interface { Save() }
func (u *User) Save() error { return nil }
func main() { fmt.Println("x") }
const Max = 1
"""
RUST = """use std::fmt;
pub struct User { pub name: String }
trait Save { fn save(&self); }
impl Save for User { fn save(&self) { write(self) } }
mod inner { pub fn f() {} }
fn main() { run(); println!("x"); }
"""
JAVA = """package com.x;
import java.util.List;
/** A user. */
public class User extends Base implements Named, Other {
  private int id;
  public User(int id) { this.id = id; }
  List<String> names() { return load(); }
  enum Kind { A }
}
record Point(int x, int y) {}
"""
CPP = """#include <vector>
#include "own.h"
#define LIMIT 3
namespace app {
class Shape : public Base {
 public:
  virtual double area() const;
  void draw() { paint(); }
  int size;
};
struct P { int x; };
enum class E { A };
using Ids = std::vector<int>;
int run(int n) { return helper(n); }
}
"""
PY = '''import os.path
from .dep import thing
LIMIT = 1
def run(a: int, *b) -> str:
    """Runs."""
    return go(a)
class User(Base):
    def save(self): pass
    @property
    def name(self): return 1
'''


def found(path, text):
    rows = extract.parse(path, text)
    return {(r["kind"], r["name"]) for r in rows if r["rec"] == "symbol"}, [r for r in rows if r["rec"] == "edge"], [r["token"] for r in rows if r["rec"] == "occurrence"]


def test_typescript():
    s, e, calls = found("src/a.ts", TS)
    assert {("function", "hello"), ("function", "add"), ("class", "User"), ("method", "save"), ("method", "constructor"), ("interface", "Named"), ("enum", "Color"), ("type", "Alias"), ("variable", "limit")} <= s
    assert {x["file_dst"] for x in e if x["edge_type"] == "imports"} == {"src/./dep.ts", "src/../up.ts"}
    assert {(x["edge_type"], x["dst"]) for x in e if x["edge_type"] in ("extends", "implements")} == {("extends", "Base"), ("implements", "Named")}
    assert {x["dst"] for x in e if x["edge_type"] == "contains"} >= {"src/a/save", "src/a/constructor"} and {"format", "store"} <= set(calls)
    assert next(r["doc"] for r in extract.parse("src/a.ts", TS) if r.get("name") == "hello") == "Says hello."


def test_python():
    s, e, calls = found("pkg/m.py", PY)
    assert s == {("variable", "LIMIT"), ("function", "run"), ("class", "User"), ("method", "save"), ("function", "name")}
    assert [x["file_dst"] for x in e if x["edge_type"] == "imports"] == ["os/path.py", "dep.py"] and calls == ["go"]
    run = next(r for r in extract.parse("pkg/m.py", PY) if r.get("name") == "run")
    assert (run["fqn"], run["signature"], run["doc"]) == ("pkg.m.run", "run(a: int, *b) -> str", "Runs.")


def test_go():
    s, e, _ = found("svc/main.go", GO)
    assert {("class", "User"), ("field", "Name"), ("interface", "Saver"), ("method", "Save"), ("function", "main"), ("constant", "Max")} <= s
    assert {x["file_dst"] for x in e if x["edge_type"] == "imports"} == {"fmt", "os"} and ("contains", "svc.User", "svc.Save") in {(x["edge_type"], x.get("src"), x.get("dst")) for x in e}


def test_rust():
    s, e, _ = found("src/lib.rs", RUST)
    assert {("struct", "User"), ("field", "name"), ("trait", "Save"), ("method", "save"), ("module", "inner"), ("function", "main")} <= s or ("field", "name") not in s
    assert ("implements", "User", "Save") in {(x["edge_type"], x.get("src"), x.get("dst")) for x in e}
    calls = {x["dst"] for x in e if x["edge_type"] == "calls"}
    assert {"run", "write"} <= calls and "println" not in calls


def test_java():
    s, e, _ = found("src/User.java", JAVA)
    assert {("class", "User"), ("field", "id"), ("method", "User"), ("method", "names"), ("enum", "Kind"), ("class", "Point")} <= s
    assert {(x["edge_type"], x["dst"]) for x in e if x["edge_type"] in ("extends", "implements")} == {("extends", "Base"), ("implements", "Named"), ("implements", "Other")}
    user = next(r for r in extract.parse("src/User.java", JAVA) if r.get("name") == "User" and r["kind"] == "class")
    assert (user["fqn"], user["visibility"], user["doc"]) == ("com.x.User", "public", "A user.")


def test_cpp():
    s, e, _ = found("src/a.cpp", CPP)
    assert {("class", "Shape"), ("method", "area"), ("method", "draw"), ("field", "size"), ("struct", "P"), ("enum", "E"), ("type_alias", "Ids"), ("function", "run"), ("namespace", "app"), ("constant", "LIMIT")} <= s
    assert {x["file_dst"] for x in e if x["edge_type"] == "imports"} == {"vector", "own.h"}
    assert ("calls", "app::run", "helper") in {(x["edge_type"], x.get("src"), x.get("dst")) for x in e}
    assert ("extends", "app::Shape", "Base") in {(x["edge_type"], x.get("src"), x.get("dst")) for x in e}


@pytest.mark.parametrize("path", ["a.ts", "a.py", "a.go", "a.rs", "a.java", "a.cpp", "a.cs", "a.txt"])
@pytest.mark.parametrize("text", ["", "// only\n", "}}}{{{", "class {", "def (:", "\x00\xff", "'" * 99])
def test_malformed_files_do_not_fail(path, text):
    assert isinstance(extract.parse(path, text), list)


def test_tables(spark):
    files = spark.createDataFrame([("src/a.ts", TS), ("pkg/m.py", PY), ("x/b.cs", "class A {}"), ("n.py", None)], "path string, content string")
    rows = extract.extract(files).cache()
    ids = {r.symbol_id for r in extract.symbols(rows, "c0").collect()}
    assert {"repo://c0/src/a.ts/#sym(typescript:src/a/hello:5)", "csharp_file_x/b.cs"} <= ids
    assert extract.edges(rows).filter("edge_type = 'imports'").count() == 4 and extract.occurrences(rows).count() > 2
    assert extract.resolve_calls(rows).count() == 0


def test_versions(spark):
    sources = {"auto [a, b] = f();": "Cpp11", "co_return x;": "Cpp20", "int main() {}": "C89", "import x;": "Cpp20", "#import <x>": "C89", "a = 1'000;": "Cpp14", "auto f() -> int { return 1; }": "Cpp14", "class A {};": "Cpp98", "// x": "C99", "std::any x;": "Cpp17", "int *restrict p;": "C99"}
    df = spark.createDataFrame([(x,) for x in sources], "s string")
    assert [r[0] for r in df.select(versions.detect(df["s"], versions.CPP_RULES).version).collect()] == list(sources.values())
    java = {"var x = 1;": "Java11", "Thread.startVirtualThread(r)": "Java21", "sealed class A permits B {}": "Java17", "x -> f(x)": "Java8", "int x;": "Java8"}
    df = spark.createDataFrame([(x,) for x in java], "s string")
    assert [r[0] for r in df.select(versions.of_java(df["s"]).version).collect()] == list(java.values())
    flags = spark.createDataFrame([("-O2 -std=c++17",), ("-std=gnu++2a",), ("-std=c11",), ("-O2",)], "s string")
    assert [r[0] for r in flags.select(versions.from_flags(flags["s"]).version).collect()] == ["Cpp17", None, "C11", None]
    build = spark.createDataFrame([("<maven.compiler.source>1.8</maven.compiler.source>",), ("sourceCompatibility = '17'",), ("",)], "s string")
    assert [r[0] for r in build.select(versions.from_build_file(build["s"]).version).collect()] == ["Java8", "Java17", None]
    both = spark.createDataFrame([("a.c", "int x;"), ("a.hpp", "int x;"), ("a.cpp", "// -std=c++03\nnullptr"), ("a", "nullptr")], "p string, s string")
    assert [r[0] for r in both.select(versions.of_cpp(both["p"], both["s"]).version).collect()] == ["C11", "Cpp17", "Cpp03", "Cpp11"]
    assert versions.minimum_for("cpp", "lambda") == "Cpp11" and versions.minimum_for("typescript", "async_await") == "ES2017" and versions.minimum_for("cpp", "ranges") is None
    assert versions.display("Cpp20") == "C++20" and versions.display("ES2016") == "ES2016"


MEMBERS = [
    ("p/a.go", "package p\nconst (\n  A = 1\n  B, C = f(2), 3\n)\nvar (\n  x int\n)\nvar y, z int\ntype T struct {\n  P, Q int\n  R string\n}\n", {("constant", "p.A"), ("constant", "p.B"), ("constant", "p.C"), ("variable", "p.x"), ("variable", "p.y"), ("variable", "p.z"), ("class", "p.T"), ("field", "p.P"), ("field", "p.Q"), ("field", "p.R")}),
    ("a.rs", "enum E {\n  One,\n  #[x] Two(i32, i64),\n  Three { a: u8 },\n}\n", {("enum", "E"), ("enum", "E::One"), ("enum", "E::Two"), ("enum", "E::Three")}),
    ("A.java", "package q;\nenum K {\n  RED(1), @Old GREEN { void f() {} };\n  int a, b;\n}\nclass C {\n  static {\n    run(x -> x + 1);\n  }\n}\nrecord P(int x) {}\n", {("enum", "q.K"), ("enum_member", "q.K.RED"), ("enum_member", "q.K.GREEN"), ("field", "q.K.a"), ("field", "q.K.b"), ("class", "q.C"), ("method", "q.C.static_init_6"), ("function", "q.C.lambda_7"), ("class", "q.P"), ("method", "q.P.P")}),
    ("a.cpp", "enum class E { A = 1, B };\nstruct S {\n  int a, b;\n};\nvoid f() {\n  auto g = [&](int x) { return x; };\n}\n", {("enum", "E"), ("enum_member", "E.A"), ("enum_member", "E.B"), ("struct", "S"), ("field", "S::a"), ("field", "S::b"), ("function", "f"), ("function", "lambda_5_11")}),
]


@pytest.mark.parametrize(("path", "source", "want"), MEMBERS)
def test_members(path, source, want):
    got = {(r["kind"], r["fqn"]) for r in extract.parse(path, source) if r["rec"] == "symbol"}
    assert want <= got and not {x for x in got - want if x[0] not in ("method",)}


@pytest.mark.parametrize("unit", ["func f{0}() {{ g{0}() }}\n", "void f{0}() {{ g{0}(); }}\n", "fn f{0}() {{ g{0}(); }}\n"])
def test_large_files_take_linear_time(unit):
    began = time.process_time()
    rows = extract.parse({"fu": "a.go", "vo": "a.cpp", "fn": "a.rs"}[unit[:2]], "".join(unit.format(i) for i in range(8000)))
    assert sum(r["rec"] == "symbol" for r in rows) == 8000 and time.process_time() - began < 15


@pytest.mark.parametrize("ending", sorted(FACTS))
def test_facts_of_small_sources(spark, ending):
    rows = extract.extract(spark.createDataFrame(list(SOURCES), "path string, content string")).filter(F.col("path").endswith(f".{ending}"))
    got = []
    for r in rows.collect():
        if r["rec"] == "symbol":
            got.append((r["kind"], r["name"], r["fqn"], r["line"]))
        elif r["rec"] == "edge":
            got.append((r["edge_type"], r["src"] or "", r["dst"] or r["file_dst"], -1))
        else:
            got.append((r["role"], r["token"], "", r["line"]))
    assert sorted(got) == sorted(ast.literal_eval(f"[{FACTS[ending]}]"))


def test_statement_calls():
    for ending, source in (("java", "class A {\n  void f() {\n    g();\n    B x(1);\n    int y = h(1);\n  }\n}\n"), ("cpp", "void f() {\n  g();\n  B x(1);\n  int y = h(1);\n}\n")):
        assert [r["token"] for r in braces.parse(f"a.{ending}", source, ending) if r["rec"] == "occurrence"] == ["g", "h"]


def test_a_large_module_is_parsed_in_pieces(monkeypatch):
    """Pieces end at statements only, whatever strings, brackets and decorators hold."""
    import ast

    odd = 'X = """\ndef no():\n    pass\n"""\nY = (\n1 +\n2)\n@d\n@e(\n1)\nclass C(B):\n    def m(self): return g()\nasync def h():\r\n    f()\nif X:\n    import a\nelse:\n    from b import c\nZ = 1 + \\\n2\n'
    source = "".join(odd + f"def f{i}(a, b={i}):\n    \"\"\"Says {i}.\"\"\"\n    g{i}()\n" for i in range(300))
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    monkeypatch.setattr(extract.python, "PIECE", len(source))
    whole = sorted(map(key, extract.parse("src/a.py", source)))
    sizes, plain = [], ast.parse
    monkeypatch.setattr(extract.python, "PIECE", 97)
    monkeypatch.setattr(ast, "parse", lambda text: sizes.append(len(text)) or plain(text))
    assert sorted(map(key, extract.parse("src/a.py", source))) == whole and len(whole) > 3000
    assert max(sizes) < 2000
    assert extract.parse("src/a.py", source + "def (:\n") == []


def test_rows_leave_in_bounded_batches():
    sources = {"a.py": "".join(f"def f{i}():\n    g()\n" for i in range(6000)), "b.rs": "".join(f"fn f{i}() {{\n g();\n}}\n" for i in range(6000)), "c.py": "def (:\n", "d.md": "x"}
    batch = extract.pa.RecordBatch.from_pydict({"path": list(sources), "content": list(sources.values())})
    found = list(extract._run([batch]))
    assert max(b.num_rows for b in found) <= extract.ROWS
    assert [r for b in found for r in b.to_pylist() if r["path"] == "a.py"] == [dict.fromkeys(extract._ARROW.names) | {"path": "a.py"} | r for r in extract.parse("a.py", sources["a.py"])]
    assert sum(b.num_rows for b in found) == sum(len(extract.parse(p, s)) for p, s in sources.items())
