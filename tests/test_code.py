"""Symbols, import resolution, graph walks and rankers."""

import random

from pyspark.sql import functions as F

from corpuslens.functions.code_text import plain_code
from corpuslens.operators import graph as G
from corpuslens.operators import ranking as R
from corpuslens.operators import symbols as Y

FILES = "repo string, path string, content string"


def test_import_priority(spark):
    files = spark.createDataFrame(
        [("r", p, "") for p in ("src/a.ts", "src/a.js", "src/b/index.tsx", "src/c", "src/c.ts", "lib/d.py", "src/e.go")], FILES
    )
    asked = {
        ("src/x/y.ts", "../a.js"): "src/a.ts", ("src/x.ts", "./b"): "src/b/index.tsx", ("src/x.ts", "./c"): "src/c",
        ("src/x.ts", "@/src/a"): "src/a.ts", ("lib/x.py", "./d"): "lib/d.py", ("src/x.ts", "./nope"): None, ("src/x.py", "./a"): None,
        ("x.ts", "./src/./x/../a"): "src/a.ts", ("src/x.ts", "react"): None,
    }
    df = spark.createDataFrame([("r", p, i) for p, i in asked], "repo string, path string, imported string")
    assert {(r.path, r.imported): r.resolved for r in G.resolve_imports(df, files).collect()} == asked


def test_extractors(spark):
    code = """import a, { b as c } from './x';
import './side';
const q = require("./y"); const z = import('./z'); import './side';
export { m as n, o };
export default function main(p: A<T>): Promise<void> { }
export const f = async (x) => x;
class K<T> extends B implements I, J {
"""
    row = spark.createDataFrame([("r", "p", code)], FILES).select(
        Y.imports_js(F.col("content")).alias("i"), Y.exports_js(F.col("content")).alias("e"), Y.signatures_js(F.col("content")).alias("s")
    ).first()
    assert row.i == ["./x", "./side", "./y", "./z"]
    assert row.e == ["m", "o", "f", "default"]
    assert row.s == ["function main(p: A<T>): Promise<void>", "async const f = (x) =>", "class K<T> extends B implements I, J "]


def test_symbols_of_unknown_language(spark):
    assert Y.symbol_rows(spark.createDataFrame([("r", "a.rb", "class A; end")], FILES), "ruby").count() == 0


def test_python_symbols(spark):
    code = "import os as o\nfrom .a import b as c, d\n__all__ = ['f']\nclass E(Enum):\n  x = 1\nasync def f(a, *, b=1): pass\ndef g(): pass\nMAX = 1\nclass K:\n  def __m(self): pass\n"
    rows = Y.symbol_rows(spark.createDataFrame([("r", "a.py", code), ("r", "bad.py", "def (")], FILES), "python").collect()
    got = {(r.line, r.kind, r.name, r.alias, r.exported, r.is_async) for r in rows}
    assert got >= {
        (1, "import", "os", "o", False, False), (2, "import", "b", "c", False, False), (2, "import", "d", None, False, False),
        (4, "enum", "E", None, False, False), (6, "function", "f", None, True, True), (7, "function", "g", None, False, False),
        (9, "class", "K", None, False, False), (10, "method", "K.__m", "private", False, False),
    }
    assert {r.path for r in rows} == {"a.py"}


def test_definitions_close_together(spark):
    code = "export function a(x) { return 1 }\nexport type T = 1;\nconst a = 2;\nenum E {}"
    got = {r.name: r.snippet for r in Y.definitions(spark.createDataFrame([("r", "p", code)], FILES)).collect()}
    assert set(got) == {"a", "T", "E"} and got["a"].startswith("export function a(x) {") and got["T"].startswith("export type T = 1;")


def test_reach_is_least_depth(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)} | {(i, 0) for i in range(40)}  # node 0 is a hub
    other = [("s", i, i + 1) for i in range(40)]  # another repository with the same names
    df = spark.createDataFrame([("r", *e) for e in edges] + other, "repo string, src long, dst long")
    roots = spark.range(40).select(F.lit("r").alias("repo"), F.col("id").alias("root"))
    got = {(r.root, r.node): r.depth for r in G.upstream(df, roots, 3).collect()}
    want = {}
    for root in range(40):
        seen, level = {root}, {root}
        for depth in (1, 2, 3):
            level = {d for s, d in edges if s in level} - seen
            seen |= level
            want.update({(root, n): depth for n in level})
    assert got == want


def test_related_tests(spark):
    src = spark.createDataFrame([("r", "a/b.ts", "")], FILES)
    files = spark.createDataFrame(
        [("r", "a/b.test.ts", "describe('s', () => { it('one'); test(`two`) })"), ("r", "a/__tests__/b.spec.tsx", ""), ("r", "a/c.test.ts", "")], FILES
    )
    got = {r.test_path: r.tests for r in G.related_tests(src, files).collect()}
    assert got == {"a/b.test.ts": ["one", "two", "[Suite] s"], "a/__tests__/b.spec.tsx": []}


def test_other_languages(spark):
    files = spark.createDataFrame(
        [("r", p) for p in ("app/foo/bar.py", "app/baz/__init__.py", "svc/util/z.go", "svc/util/a.go", "src/m.rs", "src/n/mod.rs", "src/k/o.rs")], "repo string, path string"
    )
    asked = {
        ("x.py", "foo.bar"): "app/foo/bar.py", ("x.py", "app.baz"): "app/baz/__init__.py", ("x.py", "os"): None,
        ("svc/main.go", "example.org/r/util"): "svc/util/a.go", ("svc/main.go", "./util"): "svc/util/a.go",
        ("src/k/p.rs", "crate::m"): "src/m.rs", ("src/k/p.rs", "crate::n"): "src/n/mod.rs", ("src/k/p.rs", "super::m"): "src/m.rs", ("src/k/p.rs", "self::o"): "src/k/o.rs",
    }
    df = spark.createDataFrame([("r", *k) for k in asked], "repo string, path string, imported string")
    assert {(r.path, r.imported): r.resolved for r in G.language_candidates(df, files).collect()} == asked


def test_rank_scores(spark):
    uses = spark.createDataFrame([("r", "f", "./config", ["a"], 4, 2), ("r", "f", "./x", ["b"], 1, 0)], "repo string, file string, import_path string, names array<string>, uses int, mentions int")
    rows = R.keep_best(R.score_imports(uses), "import").collect()
    assert [(r.item_key, r.score, r.reason) for r in rows] == [("./config", 1.0, "used 2 times, 4 direct references, critical import, heavily used")]
    pats = spark.createDataFrame([("r", "a/x.ts", "a/y.ts", 0.5, 1, "c"), ("r", "a/x.ts", "b/z.ts", 0.96, 0, "c"), ("r", "a/x.ts", "b/q.ts", 0.3, 0, "c")], "repo string, file string, file_path string, similarity double, concepts long, code string")
    got = {r.item_key: r.score for r in R.keep_best(R.score_patterns(pats), "pattern").collect()}
    assert got == {"a/y.ts": 0.8, "b/z.ts": 0.672}
    deps = spark.createDataFrame([("r", "f", "u", "upstream", 1), ("r", "f", "d", "downstream", 4), ("r", "f", "d1", "downstream", 1)], "repo string, file string, node string, relation string, depth int")
    assert {r.item_key: r.score for r in R.keep_best(R.score_dependencies(deps), "dependency").collect()} == {"u": 1.0, "d1": 0.8}


def test_semantic_query_and_comments(spark):
    cases = {
        "// function no\nconst go = 1": "go function", "class A {}": "A class", "a\n  telling line here": "telling line here", "// x": "// x",
    }
    df = spark.createDataFrame(list(cases.items()), "code string, want string")
    for r in df.withColumn("got", Y.semantic_query(F.col("code"))).collect():
        assert r.got == r.want
    assert spark.range(1).select(Y.strip_comments(F.lit("a # b\n<!x\ny!>c"), "#", "<!", "!>")).first()[0] == "a \nc"


def test_repositories_with_the_same_paths_stay_apart(spark):
    edges = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c")], "repo string, src string, dst string")
    roots = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r2", "b")], "repo string, root string")
    assert {tuple(r) for r in G.upstream(edges, roots, 3).collect()} == {("r1", "a", "b", 1), ("r2", "b", "c", 1)}
    deps = spark.createDataFrame(
        [(f"r{i % 2}", "f", f"n{i}", "upstream", 1) for i in range(8)], "repo string, file string, node string, relation string, depth int"
    )
    best = R.keep_best(R.score_dependencies(deps), "dependency", 3)
    assert {r["repo"]: r["count"] for r in best.groupBy("repo").count().collect()} == {"r0": 3, "r1": 3}
    assert R.keep_best(R.score_dependencies(deps), "dependency", 0).count() == 0


def test_register_language(spark):
    Y.register_language("shout", lambda line: Y._maybe(line.startswith("DEF "), Y._symbol("function", F.substring(line, 5, 100))))
    try:
        files = spark.createDataFrame([("r", "p", "DEF one\nx\nDEF two")], FILES)
        assert [(r.line, r.name) for r in Y.symbol_rows(files, "shout").orderBy("line").collect()] == [(1, "one"), (3, "two")]
    finally:
        del Y.LINE_RULES["shout"]


def test_type_rendering(spark):
    code = (
        "interface Box<T, U> extends Base, Other { a: T; b?: U }\nexport class Car<W> extends Auto implements Fast, Red { }\n"
        "interface Api { get(id: string): Item; put(x: Item): void }\ntype P = { " + "; ".join(f"p{i}: T{i}" for i in range(12)) + " }"
    )
    files = spark.createDataFrame([("r", "p", code)], FILES)
    got = [r.rendered for r in Y.type_definitions(files).orderBy("ordinal").collect()]
    assert got[:3] == [
        "interface Box<T, U> extends Base, Other { a: T, b?: U }", "class Car<W> extends Auto implements Fast, Red",
        "interface Api { get(id: string): Item; put(x: Item): void }",
    ]
    assert got[3].endswith("p9: T9, ... (2 more) }")
    all_of_it = Y.type_definitions(files).select(
        Y.render_type(*[F.col(c) for c in ("kind", "name", "extends", "properties")], shown_properties=None).alias("r")
    )
    assert any(r.r.endswith("p11: T11 }") for r in all_of_it.collect())


def test_limits_are_arguments(spark):
    code = "\n".join(f"function f{i}(a) {{ return {i} }}" for i in range(30))
    df = spark.createDataFrame([(code,)], "c string")
    assert len(df.select(Y.signatures_js(F.col("c"))).first()[0]) == 20
    assert len(df.select(Y.signatures_js(F.col("c"), None, None)).first()[0]) == 30
    files = spark.createDataFrame([("r", "p", "enum E {" + "x, " * 400 + "}")], FILES)
    whole = Y.definitions(files, [(form, None) for form, _ in Y.DEFINITION_FORMS]).first()
    assert whole.snippet.endswith("}") and not Y.definitions(files).first().snippet.endswith("}")


def test_literals_and_comments_are_told_apart(spark):
    cases = {
        'a = "http://x"; // gone': 'a = "http://x"; ',
        "b = 'it\\'s // in'; /* ' */ c": "b = 'it\\'s // in';  c",
        "`a // b\n /* c */`/* d\n */e": "`a // b\n /* c */`e",
        "x // \"open\ny = 'z": "x \ny = 'z",
        "f /* never closed\n g": "f ",
        "'line end\n// gone": "'line end\n",
        "": "",
    }
    df = spark.createDataFrame([*cases.items(), (None, None)], "code string, want string")
    for r in df.withColumn("got", Y.strip_comments(F.col("code"))).collect():
        assert r.got == r.want
    plain = {
        'if (a) { b("if (c) {") }': 'if (a) { b("") }',
        "a /* if ( */ b // while (\nc /* open\nif (d)": "a  b \nc \nif (d)",
        "`x ${y}\nif (z) `w": '""\nif (z) ""',
        "/***/a/* ** b *** */c": "ac",
    }
    df = spark.createDataFrame(list(plain.items()), "code string, want string")
    for r in df.withColumn("got", plain_code(F.col("code"))).collect():
        assert r.got == r.want


def test_million_characters_of_one_literal_or_comment(spark):
    texts = ['"' + "\\n" * 500_000 + '" // x', "`" + "\\`" * 500_000, "/*" + "/* " * 300_000, "/" * 1_000_000, "'\n/*\n" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", F.length(Y.strip_comments(F.col("t"))).alias("a"), F.length(plain_code(F.col("t"))).alias("b")).collect()}
    assert got == {0: (1_000_003, 3), 1: (1_000_001, 2), 2: (0, 0), 3: (0, 0), 4: (2, 800_000)}
