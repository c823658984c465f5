import pytest

from skarn.operators import braces, chunking, graph

PHP = """<p><?php
namespace Shop;
use Shop\\Tools\\Map; use Shop\\{Log as L, Cache};
// function no() {}
/** class Nope {} */
abstract class Desk extends \\Lib\\Base implements Runs, Stops {
  use Helps;
  public static function m(array $a = [1, 2]) { Map::draw(1); $x->y->z(); parent::b($a); return new Map($this->h(), self::s(2)); "call()"; if (f($a)) { return \\A\\g(1); } }
  abstract function later();
  function h() { $f = function () { inner(); }; }
}
interface Runs { function go(); }
function free($x) { echo <<<EOT
function nope() {}
EOT;
  return m($x); }
"""


def test_php():
    facts = braces.read(PHP, "svc.php", "php")
    assert {f["ns"] for f in facts} == {"Shop"}
    assert {(f["alias"], f["fqn"]) for f in facts if f["fact"] == "import"} == {("Map", "Shop\\Tools\\Map"), ("L", "Shop\\Log"), ("Cache", "Shop\\Cache")}
    defs = {f["qname"]: f for f in facts if f["fact"] == "def"}
    assert {q: d["kind"] for q, d in defs.items()} == {"Desk": "class", "Desk.m": "method", "Desk.later": "method", "Desk.h": "method", "Runs": "interface", "Runs.go": "method", "free": "function"}
    assert defs["Desk"]["bases"] == ["Base", "Runs", "Stops", "Helps"]
    assert (defs["Desk"]["start_line"], defs["Desk"]["end_line"], defs["Desk.m"]["end_line"], defs["free"]["end_line"]) == (6, 11, 8, 16)
    calls = {(f["caller"], f["callee"], f["rkind"], f["rclass"]) for f in facts if f["fact"] == "call"}
    assert calls == {("Desk.m", "h", "this", ""), ("Desk.m", "s", "self", ""), ("Desk.m", "b", "parent", ""), ("Desk.m", "draw", "static", "Map"), ("Desk.m", "__construct", "new", "Map"), ("Desk.m", "z", "member", ""), ("Desk.m", "f", "free", ""), ("Desk.m", "g", "free", ""), ("Desk.h", "inner", "free", ""), ("free", "m", "free", "")}
    assert {f["class"] for f in facts if f["fact"] == "call" and f["caller"].startswith("Desk")} == {"Desk"}


TS = """import Def, { A, B as C } from './lib/x'
import { other } from 'pkg'
export abstract class Box<T> extends Base<T> implements Shape {
  private v = /a{2}"/.test('x')
  async load(id: number): Promise<void> { this.save(id); super.load(id); await C(id); new Thing(id) }
  get size(): number { return this.items.length() }
}
export function make(a, b) { const f = (x) => run(x); return { go() { stop() } } }
const v = function hidden() { deep() }
interface Shape { draw(): void }
make(1)
"""


def test_typescript():
    facts = braces.read(TS, "src/a.ts", "ts")
    assert {(f["alias"], f["name"], f["rel"]) for f in facts if f["fact"] == "import"} == {("Def", "default", "src/lib/x"), ("A", "A", "src/lib/x"), ("C", "B", "src/lib/x")}
    defs = {f["qname"]: f["kind"] for f in facts if f["fact"] == "def"}
    assert defs == {"Box": "class", "Box.load": "method", "Box.size": "method", "make": "function", "make.go": "method", "Shape": "interface"}
    assert next(f["bases"] for f in facts if f.get("qname") == "Box") == ["Base", "Shape"]
    calls = {(f["caller"], f["callee"], f["rkind"], f["rclass"]) for f in facts if f["fact"] == "call"}
    assert {("Box.load", "save", "this", ""), ("Box.load", "load", "member", ""), ("Box.load", "C", "free", ""), ("Box.load", "__construct", "new", "Thing"), ("Box.size", "length", "member", ""), ("make", "run", "free", ""), ("make.go", "stop", "free", ""), ("", "make", "free", "")} <= calls


@pytest.mark.parametrize("lang", ["php", "ts", "js"])
def test_broken_sources_give_what_can_be_read(lang):
    for text in ("", "<?php", "<?php function (", "class", "class A {", "'", "/* x", "}}}", "<?php use", "import {", "new", "a(", "<?php <<<X\nno end"):
        assert isinstance(braces.read(text, "x", lang), list) and isinstance(braces.top_level(text, lang), list)


def edges(spark, *files):
    nodes, out = graph.resolve(graph.extract(spark.createDataFrame([("r", *f) for f in files], "repo string, path string, lang string, text string")))
    names = {r.id: r.fqn for r in nodes.collect()}
    return {(names[e.src], names[e.dst], e.conf) for e in out.collect()}


def test_cascade_over_php(spark):
    got = edges(
        spark,
        ("geo.php", "php", "<?php\nnamespace Shop\\Tools;\nclass Map { function draw() {} }\n"),
        ("other.php", "php", "<?php\nnamespace Other;\nclass Map { function draw() {} }\n"),
        ("svc.php", "php", "<?php\nnamespace Shop;\nuse Shop\\Tools\\Map;\nclass Root { function common() {} }\nclass Desk extends Root { function run() { $this->common(); Map::draw(); new Map(); only(); } }\n"),
        ("fn.php", "php", "<?php\nnamespace Shop;\nfunction only() {}\n"),
        ("dup1.php", "php", "<?php\nfunction dup() {}\n"), ("dup2.php", "php", "<?php\nfunction dup() {}\n"), ("caller.php", "php", "<?php\nfunction caller() { return dup(); }\n"),
    )
    run = "Shop\\Desk.run"
    assert {(d, c) for s, d, c in got if s == run} == {("Shop\\Root.common", 0.95), ("Shop\\Tools\\Map.draw", 0.90), ("Shop\\Tools\\Map", 0.90), ("Shop\\only", 0.90)}
    assert [(d, c) for s, d, c in got if s == "caller"] == [("dup", 0.35)]


def test_cascade_over_typescript(spark):
    got = edges(
        spark,
        ("a.ts", "ts", "import { help as h } from './lib/b'\nclass A extends B { m() { this.up(); h(); new C() } }\n"),
        ("lib/b.ts", "ts", "export function help() {}\nexport class B { up() {} }\nclass C { }\n"),
    )
    assert got == {("A.m", "B.up", 0.95), ("A.m", "help", 0.95), ("A.m", "C", 0.90)}


def test_class_of_two_repositories(spark):
    src = "class Base:\n    def up(self): pass\n"
    files = [("r1", "b.py", "python", src), ("r2", "b.py", "python", src), ("r1", "a.py", "python", "class A(Base):\n    def m(self):\n        self.up()\n")]
    nodes, out = graph.resolve(graph.extract(spark.createDataFrame(files, "repo string, path string, lang string, text string")))
    assert [(e.dst, e.conf) for e in out.collect()] == [("r2/b.py:2:Base.up", 0.95)]


def test_definition_chunks():
    php = "<?php\nnamespace A;\n\n// about f\nfunction f() {\n  return 1;\n}\n\nclass B {\n}\n$x = f();\n"
    assert [(c.start_line, c.end_line) for c in chunking.definitions(php, "php")] == [(1, 2), (3, 7), (8, 10), (11, 12)]
    ts = "import x from './x'\nexport const y = {\n  a: 1\n}\nexport function z() {\n  return 2\n}\n"
    assert [(c.start_line, c.end_line) for c in chunking.definitions(ts, "ts")] == [(1, 1), (2, 4), (5, 7)]
    assert [c.text for c in chunking.definitions("a = 1", "ncl")] == ["a = 1"]
