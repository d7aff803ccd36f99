"""Vector and text search against brute force."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpuslens.operators import search as S


def vectors(spark, n=400, d=16):
    rng = np.random.default_rng(1)
    # a third of all rows in one repository
    rows = [("hot" if i % 3 == 0 else f"r{i % 5}", i, f"f{i}.{['ts', 'py'][i % 2]}", rng.normal(size=d).astype("float32").tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "repo string, chunk_id long, file_path string, embedding array<float>").repartition(5)


def brute(rows, queries, k, per_repo):
    out = {}
    for q, e in queries:
        e = np.asarray(e, dtype=float)
        scored = []
        for repo, c, _, v in rows:
            v = np.asarray(v, dtype=float)
            scored.append((-round(float(v @ e / np.linalg.norm(v) / np.linalg.norm(e)), 6), c, repo))
        for repo in {r[0] for r in rows} if per_repo else {None}:
            best = sorted(s for s in scored if repo in (None, s[2]))[:k]
            out.setdefault(q, set()).update(c for _, c, _ in best)
    return out


def test_top_k_and_large_query_path(spark):
    rows, df = vectors(spark)
    queries = [(i, rows[i * 7][3]) for i in range(12)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = S.search(df, q, 5).groupBy("query_id").agg(F.collect_set("chunk_id").alias("c")).collect()
    want = brute(rows, queries, 5, False)
    assert {r.query_id: set(r.c) for r in got} == want
    each = S.search_each_repo(df, q, 2).groupBy("query_id").agg(F.collect_set("chunk_id").alias("c")).collect()
    assert {r.query_id: set(r.c) for r in each} == brute(rows, queries, 2, True)
    prepared = S._prepared(df, ["repo", "chunk_id", "file_path"]), S._prepared(q.withColumn("current_file", F.lit(None).cast("string")), ["query_id", "current_file"])
    by_bucket = S.score_by_bucket(*prepared, 5, buckets=3, blocks=2)
    top = S.top_per_group(by_bucket, ["query_id"], S.best_first(), 5).groupBy("query_id").agg(F.collect_set("chunk_id").alias("c"))
    assert {r.query_id: set(r.c) for r in top.collect()} == want


def test_no_queries(spark):
    _, df = vectors(spark, 10)
    assert S.search(df, spark.createDataFrame([], "query_id long, embedding array<float>")).count() == 0


def test_candidates_are_bounded_by_tasks(spark):
    """What leaves a task depends on queries and k, not on how many repositories there are."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i % 1000}", i, f"f{i}.ts", rng.normal(size=8).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "repo string, chunk_id long, file_path string, embedding array<float>").repartition(6)
    q = spark.createDataFrame([(i, rows[i][3]) for i in range(20)], "query_id long, embedding array<float>")
    assert S.score_vectors(df, q, 10).count() <= 6 * 20 * 10


def test_unusable_vectors_take_no_part(spark):
    rows = [("r", 1, "a.ts", [1.0, 0.0]), ("r", 2, "b.ts", None), ("r", 3, "c.ts", [1.0, 0.0, 0.0]), ("r", 4, "d.ts", [None, 1.0]), ("r", 5, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "repo string, chunk_id long, file_path string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.chunk_id) for r in S.search(df, q).orderBy("query_id", F.desc("score")).collect()] == [(1, 1), (1, 5)]


def test_similar_patterns_gives_k_whenever_there_are_k(spark):
    """The queried file has the best chunks; they take no places."""
    rows = [("r", i, "own.ts" if i < 12 else f"other{i}.ts", [1.0, i / 100]) for i in range(40)]
    df = spark.createDataFrame(rows, "repo string, chunk_id long, file_path string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], "own.ts", "typescript")], "query_id long, embedding array<float>, current_file string, language string")
    assert sorted(r.chunk_id for r in S.similar_patterns(df, q, 5).collect()) == [12, 13, 14, 15, 16]


def test_lexical_search_by_repository_and_any_id(spark):
    texts = [" ".join(["apple"] * (i % 3) + ["pear"] * (i % 4) + [f"w{i // 2}", "the"]) for i in range(40)]
    queries = spark.createDataFrame([(1, "Apple pear"), (2, "w7 the"), (3, "absent"), (4, None)], "query_id long, query string")
    docs = [t.split() for t in texts]
    want = {}
    for q, words in ((1, ["apple", "pear"]), (2, ["w7", "the"])):
        df = {w: sum(w in d for d in docs) for w in words}
        score = {i: round(sum(d.count(w) * np.log(1 + 40 / df[w]) ** 2 for w in words) / np.sqrt(len(d)), 6) for i, d in enumerate(docs) if set(words) & set(d)}
        want[q] = [(i // 2, f"r{i % 2}", s) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0] // 2, x[0] % 2))[:5]]
    for kind, make in (("long", int), ("string", str)):
        rows = [(f"r{i % 2}", make(i // 2), t) for i, t in enumerate(texts)]  # both repositories have the same ids
        chunks = spark.createDataFrame(rows, f"repo string, chunk_id {kind}, text string")
        got = S.lexical_search(chunks, queries, 5).collect()
        assert {r.query_id for r in got} == {1, 2}
        for q in (1, 2):
            rows = sorted((r for r in got if r.query_id == q), key=lambda r: (-r.score, int(r.chunk_id), r.repo))
            assert [r.score for r in rows] == [s for _, _, s in want[q]]
            if kind == "long":
                assert [(r.chunk_id, r.repo) for r in rows] == [(c, r) for c, r, _ in want[q]]


def test_broadcast_check_changes_no_result(spark):
    words = spark.range(30).selectExpr("cast(id as string) as word")
    assert sorted(S.checked_broadcast(words, 5).collect()) == sorted(S.checked_broadcast(words, 50).collect())


def test_tally(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "x array<string>").select(S.tally(F.col("x")).alias("t")).collect()
    assert [[tuple(e) for e in r.t] for r in got] == [[("a", 1), ("b", 2)], [], []]


def test_usages_and_callers(spark):
    chunks = spark.createDataFrame(
        [("r", "a", "function foo() {}\nfoo(); foo (1); foobar()"), ("r", "b", "let x = foo;"), ("r", "c", "function foo(){}"), ("s", "a", "foo()")],
        "repo string, chunk_id string, text string",
    )
    names = spark.createDataFrame([("foo",), (None,)], "name string")
    assert {(r.repo, r.chunk_id, r.n) for r in S.find_usages(chunks, names).collect()} == {("r", "a", 2), ("r", "b", 1), ("s", "a", 1)}
    assert {(r.repo, r.chunk_id, r.n) for r in S.find_callers(chunks, names).collect()} == {("r", "a", 2), ("s", "a", 1)}


def test_words_nobody_asks_for_stay_in_their_task(spark, monkeypatch):
    """Whatever the number of names: a large set is not broadcast, and the words of all chunks do not move for it."""
    texts = [(f"r{i % 2}", f"c{i}", " ".join(f"w{j}" for j in range(i, i + 60)) + f" f{i} f{i}() class f{i}") for i in range(80)]
    chunks = spark.createDataFrame(texts, "repo string, chunk_id string, text string")
    names = spark.createDataFrame([(f"f{i}",) for i in range(0, 400, 2)], "name string")
    held, used = [], S.counted_words

    def seen(*args):
        found = used(*args)
        held.append(found.filter("word is not null").count())
        return found

    monkeypatch.setattr(S, "counted_words", seen)
    monkeypatch.setattr(S, "checked_broadcast", lambda words, most=0: words)
    got = sorted((r.name, r.repo, r.chunk_id, r.n) for r in S.find_usages(chunks, names).collect())
    assert got == sorted((f"f{i}", "r0", f"c{i}", 2) for i in range(0, 80, 2))
    assert 40 <= held[0] < 80 * 61 / 4
    queries = spark.createDataFrame([(1, "F2 w70"), (2, "w3")], "query_id long, query string")
    assert {r.query_id for r in S.lexical_search(chunks, queries, 5).collect()} == {1, 2} and len(held) == 2


def test_names_beside_letters_that_are_not_ascii(spark):
    """A word start is where neither a letter nor its mark stands before; words themselves are ASCII."""
    text = "\u00e9foo( \u00e9 foo( function\u2003foo( e\u0301foo( \u00b2foo( function\nfoo(\u00e9) \u65e5foo("
    chunks = spark.createDataFrame([("r", "a", text), ("r", "b", None), (None, "c", "foo(")], "repo string, chunk_id string, text string")
    names = spark.createDataFrame([("foo",)], "name string")
    found, less = F.regexp_extract_all(F.lit(text), F.lit(S.CALL), F.lit(1)), F.regexp_extract_all(F.lit(text), F.lit(S.FUNCTION_DEFINITION), F.lit(1))
    n = spark.range(1).select(F.size(found) - F.size(less)).first()[0]
    assert n > 0 and {(r.repo, r.chunk_id, r.n) for r in S.find_callers(chunks, names).collect()} == {("r", "a", n), (None, "c", 1)}
    all_words = spark.range(1).select(F.size(F.regexp_extract_all(F.lit(text), F.lit(r"\w+"), F.lit(0)))).first()[0]
    assert all_words == len(S.finder(r"\w+", 0)(text))


def test_fuzzy_score(spark):
    cases = {"rvcmd": None, "src": 900, "review": 796, "src/review-cmd.ts": 1000, "zz": None, "scrw": 1 * 4 + 9}
    for q, want in cases.items():
        got = spark.range(1).select(S.fuzzy_score(F.lit("src/review-cmd.ts"), q)).first()[0]
        if q == "rvcmd":
            assert got and got > 0
        elif q == "scrw":
            # s at 0 counts 10; r is not consecutive ... checked against a plain walk
            assert got == plain_fuzzy("scrw", "src/review-cmd.ts")
        else:
            assert got == want, q


def plain_fuzzy(q, t):
    score, at, last = 0, 0, -1
    for i, ch in enumerate(t):
        if at < len(q) and ch == q[at]:
            score += 10 if last == i - 1 else 1
            last, at = i, at + 1
    return score if at == len(q) else None


def test_preview_and_keys(spark):
    text = "\n".join(["a" * 100, "b" * 150, "c" * 60, "d"])
    row = spark.range(1).select(S.preview(F.lit(text)).alias("p"), S.truncate_text(F.lit("abcdef"), 3, "!").alias("t")).first()
    assert row.p == "a" * 100 + "\n" + "b" * 150 and row.t == "abc!"
    df = spark.createDataFrame([(" Q ", ["b", "a"]), ("q", ["a", "b"])], "q string, r array<string>")
    keys = df.select(S.search_key(F.col("q"), F.col("r"), F.lit(None).cast("array<string>"), F.lit(0))).distinct().count()
    assert keys == 1


def test_related_files(spark):
    df = spark.createDataFrame([("r", p) for p in ("d/a.ts", "d/b.ts", "d/c.tsx", "d/e.py", "x/f.ts")], "repo string, path string")
    got = {(r.path, r.related) for r in S.related_files(df).collect()}
    assert got == {("d/a.ts", "d/b.ts"), ("d/a.ts", "d/c.tsx"), ("d/b.ts", "d/a.ts"), ("d/b.ts", "d/c.tsx")}


def test_related_files_with_odd_names_and_arguments(spark):
    df = spark.createDataFrame([("r", p) for p in ("d/y.(bak", "d/x.(bak", "d/a.ts", "e/b.test.ts", "e/c.ts")], "repo string, path string")
    pairs = {("d/y.(bak", "d/x.(bak"), ("e/b.test.ts", "e/c.ts")}
    assert {(r.path, r.related) for r in S.related_files(df).collect()} == pairs | {(b, a) for a, b in pairs}
    got = S.related_files(df, directory="e", pattern="*.test.*").collect()
    assert {(r.path, r.related) for r in got} == {(p, "e/b.test.ts") for p in ("d/y.(bak", "d/x.(bak", "d/a.ts", "e/c.ts")}


def test_lexical_search_is_the_same_by_weights_and_by_joins(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "hot"]
    data = [(rng.choice(["a", "b", None]), f"c{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(700)]
    data += [("a", f"same{i}", "hot w1 w2") for i in range(40)] + [("b", "same3", "hot w1 w2"), ("a", "none", None)]
    chunks = spark.createDataFrame(data, "repo string, chunk_id string, text string").repartition(7)
    asked = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(30)] + [(90, "hot W1"), (91, ""), (92, None), (93, "unknown"), (94, "é é")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    scored, joined = S.lexical_search(chunks, queries, 5), S.lexical_search(chunks, queries, 5, cells=0)
    rows_ = lambda df: sorted((r.query_id, -r.score, r.chunk_id, repr(r.repo)) for r in df.collect())
    assert rows_(scored) == rows_(joined) and len(rows_(scored)) > 150
    assert S.lexical_search(chunks, queries.limit(0), 5).count() == 0


def test_lexical_search_moves_words_only_where_a_chunk_comes_twice(spark, monkeypatch):
    """The words of a chunk lie together as they are counted; they are dealt anew only if chunks share a name."""
    dealt, used = [], S._in_pieces
    monkeypatch.setattr(S, "_in_pieces", lambda tf: dealt.append(1) or used(tf))
    rows = [(f"r{i % 2}" if i % 5 else None, i, f"w{i % 7} w{i % 3} hot x{i}") for i in range(600)]
    queries = spark.createDataFrame([(1, "w1 hot"), (2, "x17 w5")], "query_id long, query string")
    hits = lambda data, **how: sorted((r.query_id, -r.score, r.chunk_id, repr(r.repo)) for r in S.lexical_search(spark.createDataFrame(data, "repo string, chunk_id long, text string").repartition(3), queries, 5, **how).collect())
    assert hits(rows) == hits(rows, cells=0) and dealt == []
    twice = hits(rows + rows[:9])
    assert dealt == [1] and len({h[0::2] for h in twice}) == len(twice) == 10


def test_top_texts_hold_no_more_than_they_need():
    rng = np.random.default_rng(3)
    weights = rng.random((6, 20))
    top, names, cells = S.TopTexts(weights, 3), [], []
    for batch in range(50):
        here = [("r", f"c{batch:02d}{i:02d}") for i in range(30)]
        chunk, word = np.divmod(np.arange(600), 20)
        value = rng.integers(0, 3, 600).astype(float)
        top.add(here, chunk, word, value)
        names += here
        cells.append(value.reshape(30, 20))
        assert len(top.names) <= 8 * 3 * 6 + 30 * 2
    scores = np.round(weights @ np.concatenate(cells).T, 6)
    query, at, score = top.cut()
    for q in range(6):
        want = sorted((-s, n[1]) for s, n in zip(scores[q], names, strict=True))[:3]
        assert [(-s, top.names[a][1]) for a, s in zip(at[query == q], score[query == q], strict=True)] == want
