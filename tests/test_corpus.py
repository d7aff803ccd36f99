"""Chunking, ignore rules, scanning and index maintenance."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.windows import position_in_group
from corpuslens.operators import chunks as C
from corpuslens.operators import ignore as G
from corpuslens.operators import indexing as X
from corpuslens.sources.files import read_index, read_tree, write_index


def fold_chunks(text, size=2000, back=4):
    """The chunk rules as a plain loop."""
    lines, out, held, start = text.split("\n"), [], "", 0
    for i, line in enumerate(lines):
        longer = held + "\n" + line if held else line
        if len(longer) > size and held:
            out.append((start, i - 1, held))
            start = max(0, i - back)
            held = "\n".join(lines[start : i + 1])
        else:
            held = longer
    if held.strip():
        out.append((start, len(lines) - 1, held))
    return out


def test_chunks_match_the_fold(spark):
    rng = random.Random(3)
    texts = [
        "a", "\n\n\nfirst", "x" * 2500, "x" * 2000, "x" * 2001 + "\ny", "\n".join(["y" * 300] * 30),
        "one\n" + "z" * 5000 + "\ntwo\nthree", "tail\n\n\n", "   \n  ", "\n" * 2100, "a\n" + "\n" * 2100,
    ]
    texts += ["\n".join("w" * rng.choice([0, 1, 40, 400, 1900, 2500]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    files = spark.createDataFrame([("r", f"p{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    got = {}
    for r in C.chunk_files(files).orderBy("file_path", "chunk_index").collect():
        got.setdefault(r["file_path"], []).append((r["line_start"], r["line_end"], r["text"]))
        assert r["chunk_id"] == f"{r['file_path']}::chunk-{r['chunk_index']}"
    for i, t in enumerate(texts):
        assert got.get(f"p{i}", []) == fold_chunks(t), repr(t[:60])


def test_every_line_is_in_a_chunk(spark):
    text = "\n".join(f"line {i} " + "p" * (i % 90) for i in range(400))
    rows = C.chunk_files(spark.createDataFrame([("r", "p", text)], "repo string, path string, content string")).collect()
    covered = {i for r in rows for i in range(r["line_start"], r["line_end"] + 1)}
    assert covered == set(range(400))


def test_ignore_rules(spark):
    rules = G.patterns_for(["nodejs", "python", "rust", "general"])
    cases = {
        "src/node_modules/a.ts": True, "node_modules": True, "a/my_node_modules/b.ts": False, "yarn.lock": True,
        "x/yarn.lock": True, "yarn.lock.ts": False, "x/app.min.js": True, "app.min.jsx": False, "a/b.log": True,
        "src/x.rs.bk": True, "x.rs.bk": False, "pkg.egg-info/x": False, ".env.dev.local": True, "win\\dist\\a.js": True,
    }
    df = spark.createDataFrame(list(cases.items()), "path string, want boolean")
    for r in df.withColumn("got", G.is_ignored(F.col("path"), rules)).collect():
        assert r["got"] == r["want"], r["path"]


def test_stacks(spark):
    files = spark.createDataFrame(
        [("a", "package.json"), ("a", "sub/go.mod"), ("b", "pom.xml"), ("b", "setup.py"), ("c", "x.txt")], "repo string, path string"
    )
    got = {(r.repo, r.stack) for r in G.detect_stacks(files).collect()}
    assert got == {("a", "nodejs"), ("a", "general"), ("b", "java"), ("b", "python"), ("b", "general"), ("c", "general")}


def test_read_tree_and_index_store(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/a.ts": "one\ntwo", "dist/b.ts": "no", "c.txt": "no", "big.py": "x" * 200_000, "d.py": "p"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = read_tree(spark, str(root), "r1")
    assert {(r.path, r.content) for r in files.collect()} == {("src/a.ts", "one\ntwo"), ("d.py", "p")}
    store = str(tmp_path / "index")
    write_index(C.chunk_files(files), store)
    write_index(C.chunk_files(files.withColumn("repo", F.lit("r2"))), store)
    write_index(C.chunk_files(files.filter("path = 'd.py'")), store)
    got = {(r.repo, r.file_path) for r in read_index(spark, store).collect()}
    assert got == {("r1", "d.py"), ("r2", "src/a.ts"), ("r2", "d.py")}


def test_incremental_equals_full(spark):
    old = [("r", f"f{i}", "line\n" * (i * 90 + 1)) for i in range(8)]
    new = [("r", f"f{i}", ("line\n" if i % 3 else "less\n") * (i * 40 + 1 if i % 3 == 0 else i * 90 + 1)) for i in range(2, 10)]
    new.append(("r", "empty", ""))
    schema = "repo string, path string, content string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    manifest = X.build_manifest(a)
    chunks, updated = X.update_index(C.chunk_files(a), manifest, b, X.missing_files(manifest, b))
    key = lambda r: (r["chunk_id"], r["text"])
    assert sorted(map(key, chunks.collect())) == sorted(map(key, C.chunk_files(X.with_content(b)).collect()))
    assert {(r.path, r.hash, tuple(r.chunk_ids)) for r in updated.collect()} == {
        (r.path, r.hash, tuple(r.chunk_ids)) for r in X.build_manifest(b).collect()
    }


def test_position_in_one_hot_group(spark):
    """One group of most rows, another of null keys; the order holds distinct values, nulls and hashed ids."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 3 == 2, None).alias("g"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 5000) / 5000).alias("s"),
        F.xxhash64("id").alias("id"),
    )
    placed = position_in_group(df, ["g"], [F.col("s").desc_nulls_last(), F.col("id")], "pos")
    got = placed.collect()
    want = {}
    for g in ("hot", None):
        rows = sorted((r.s is None, -(r.s or 0), r.id) for r in got if r.g == g)
        want.update({(g, row[-1]): n + 1 for n, row in enumerate(rows)})
    assert all(want[r.g, r.id] == r.pos for r in got) and len(got) == 5000


def test_paths(spark):
    row = spark.range(1).select(
        P.normalize(F.lit("a/./b/../c//d")).alias("n"), P.normalize(F.lit("../x")).alias("up"),
        P.extension(F.lit("a/.env")).alias("dot"), P.extension(F.lit("a/b.test.ts")).alias("ext"),
        P.language_of(F.lit("X.TSX")).alias("lang"), P.dirname(F.lit("a/b/c")).alias("dir"),
        P.related(F.lit("a/x.test.ts"), F.lit("b/x.spec.js")).alias("rel"),
    ).first()
    assert tuple(row) == ("a/c/d", "../x", "", ".ts", "typescript", "a/b", True)


def test_bytes_that_are_not_utf8_do_not_fail_the_read(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.ts").write_text("ok")
    got = {r.path: r.content for r in read_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"a.ts": "caf\ufffd", "b.ts": "ok"}
    df = spark.createDataFrame([(None, "Y2Fm6Q=="), ("", "!not base64!"), ("x", None)], "content string, b string")
    assert [r.c for r in df.select(X.decode_content(F.col("content"), F.col("b")).alias("c")).collect()] == ["caf\ufffd", "", "x"]


def test_null_repositories_in_diffs_and_updates(spark):
    kind = "repo string, path string, content string"
    old = spark.createDataFrame([(None, "a", "one\n" * 900), (None, "b", "two"), (None, "c", "three"), ("r", "a", "four")], kind)
    new = spark.createDataFrame([(None, "a", "one"), (None, "b", "two"), (None, "d", "five"), ("r", "a", "four")], kind)
    manifest = X.build_manifest(old)
    change = {(r.repo, r.path): r.change for r in X.index_diff(manifest, new).collect()}
    assert change == {(None, "a"): "changed", (None, "b"): "unchanged", (None, "c"): "deleted", (None, "d"): "added", ("r", "a"): "unchanged"}
    gone = X.missing_files(manifest, new)
    assert [(r.repo, r.path) for r in gone.collect()] == [(None, "c")]
    chunks, after = X.update_index(C.chunk_files(old), manifest, new, gone)
    assert {(r.repo, r.file_path, r.text) for r in chunks.collect()} == {
        (None, "a", "one"), (None, "b", "two"), (None, "d", "five"), ("r", "a", "four")
    }
    assert sorted(map(repr, ((r.repo, r.path, r.hash) for r in after.collect()))) == sorted(
        map(repr, ((r.repo, r.path, r.hash) for r in X.build_manifest(new).collect()))
    )
    report = {r.repo: (r.files_processed, r.chunks_added) for r in X.update_report(manifest, new).collect()}
    assert report[None] == (2, 2) and report["r"] == (0, 0)
    assert {r.repo: r.files_in_manifest for r in X.index_report(old, manifest).collect()} == {None: 3, "r": 1}
