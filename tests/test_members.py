"""Members of script types by bracket depth."""

import time

from corpuslens.operators.members import imports_of_text, members_of_text, type_members

CODE = '''// class Hidden { x: number; }
export abstract class Store<K, V extends Map<string, K>>
  extends Base
  implements Shape, Other {
  private readonly cache: Map<string, T[]> = new Map();
  #own = 3;
  constructor(private a: string,
    b = { c: 1 }) {
    if (a) { this.go({ x: a }); }
  }
  @Input({ a: 1 }) protected async load<R>(key: K, /* { */ more?: (x: R) => void): Promise<R> {
    class Inner { deep: { x: number }; }
    return "};" as any;
  }
  static handler = async (e: Event) => {
    await e;
  };
}
const plain = { not: 1, a: { member: 2 } };
interface Node extends Root {
  kind:
    | "a;b"
    | "c"
  meta?: { deep: { deeper: string }; other: number },
  visit(fn: (n: Node) => void): { done: boolean };
  [key: string]: unknown
  (call: string): void
}
type Pair = { x: number, y?: Pair<A, B> };
enum Level { Low = 1, High = "x,y", }
export default class extends Base { lost: string }
interface Open { a: string'''


def test_members_of_every_form():
    got = [(r[0], r[2], r[3], r[4], r[5]) for r in members_of_text(CODE)]
    assert got == [
        ("Store", 5, "property", "cache", "Map<string, T[]>"),
        ("Store", 6, "property", "#own", None),
        ("Store", 7, "method", "constructor", "(private a: string, b = { c: 1 })"),
        ("Inner", 12, "property", "deep", "{ x: number }"),
        ("Store", 11, "method", "load", "<R>(key: K, more?: (x: R) => void): Promise<R>"),
        ("Store", 15, "property", "handler", None),
        ("Node", 21, "property", "kind", '| "a;b" | "c"'),
        ("Node", 24, "property", "meta", "{ deep: { deeper: string }; other: number }"),
        ("Node", 25, "method", "visit", "(fn: (n: Node) => void): { done: boolean }"),
        ("Node", 26, "property", "[key: string]", "unknown"),
        ("Pair", 29, "property", "x", "number"),
        ("Pair", 29, "property", "y", "Pair<A, B>"),
        ("Level", 30, "value", "Low", None),
        ("Level", 30, "value", "High", None),
        ("Open", 32, "property", "a", "string"),
    ]
    flags = {r[4]: r[6:] for r in members_of_text(CODE)}
    assert flags["load"] == (False, "protected", False, True, False)
    assert flags["cache"] == (False, "private", False, False, True)
    assert flags["meta"][0] and flags["handler"][2] and flags["#own"][1] == "private"


def test_time_grows_with_the_text_only():
    hard = ["<a " * 300_000, "{" * 500_000, "}" * 500_000, "class x " * 100_000 + "= {", "interface A { " * 20_000,
            "class A {" + "a: { b: <c> };\n" * 50_000, "`" + "x" * 1_000_000, "(" * 200_000 + "class A {", "\n" * 500_000, "= \n" * 300_000]
    for text in hard:
        began = time.time()
        list(members_of_text(text))
        assert time.time() - began < 20


def test_use_trees_of_any_depth_over_lines():
    code = """use std::{
    io::{self, Read as R, fs::{File, /* x, */ Open}},
    fmt, // y
};
pub(crate) use a::b;
// use no::way;
use c::*; use d as e;
let s = "
use in::literal;";
fn f<'a>(x: &'a str, q: char) { let q = '"'; use g::{h}; }
use never::{closed"""
    assert list(imports_of_text(code)) == [
        (1, "io", None, "std", False), (1, "Read", "R", "std::io", False), (1, "File", None, "std::io::fs", False),
        (1, "Open", None, "std::io::fs", False), (1, "fmt", None, "std", False), (5, "b", None, "a", True),
        (7, "*", None, "c", False), (7, "d", "e", "", False), (10, "h", None, "g", False), (11, "closed", None, "never", False),
    ]
    for text in ["use a::" + "{b::" * 2_000 + "c", "use " * 200_000, "pub " * 200_000, "use a::{" + "b, " * 200_000, "'" * 500_000, "\n" * 500_000]:
        began = time.time()
        list(imports_of_text(text))
        assert time.time() - began < 20


def test_null_empty_and_repeated_files(spark):
    schema = "repo string, path string, content string, owner int"
    one = (None, "a.ts", "class A { x: number }", 1)
    rows = [one, one, ("r", "b.ts", None, 1), ("r", "c.ts", "", 1)]
    got = type_members(spark.createDataFrame(rows, schema)).select("repo", "path", "owner", "name").collect()
    assert [tuple(r) for r in got] == [(None, "a.ts", "A", "x")] * 2
    assert type_members(spark.createDataFrame([], schema)).count() == 0


def test_rows_leave_a_few_texts_at_a_time(spark):
    """A worker holds the objects of a few texts, however many rows a batch has; symbols, members and imports share the step."""
    from corpuslens.functions.batches import AT_ONCE
    from corpuslens.operators.symbols import python_symbols

    schema = "repo string, path string, content string"
    rows = [("r", f"f{i}", None if i == 7 else f"interface A{i} {{ a: string; b: number }}") for i in range(1000)]
    found = type_members(spark.createDataFrame(rows, schema).coalesce(1))
    assert found.groupBy("path").count().count() == 999 and found.count() == 2 * 999
    code = [("r", f"f{i}", "def f(a):\n    pass\nimport os") for i in range(300)]
    symbols = python_symbols(spark.createDataFrame(code, schema).coalesce(1))
    assert symbols.count() == 600 and {r.ordinal for r in symbols.collect()} == {0, 1}

    def size(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows]})

    sizes = [r.n for r in symbols.mapInArrow(size, "n long").collect()]
    assert sum(sizes) == 600 and AT_ONCE < 300
