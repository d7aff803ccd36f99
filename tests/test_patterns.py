"""Similar code of every file against brute force."""

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpuslens.operators import search as S
from corpuslens.plans import ranking
from corpuslens.plans.derived import table

SF = "/root/testdata/sf0.001"


def test_patterns_of_every_file_equal_brute_force(spark):
    vectors = {r.chunk_id: r for r in table(spark, SF, "vectors").collect()}
    paths = {r.doc_id: r.path for r in table(spark, SF, "code_files").select("doc_id", "path").collect()}
    both = sorted(vectors.keys() & paths.keys())
    unit = np.array([vectors[c].embedding for c in both], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = {}
    for i, chunk in enumerate(both):
        of = defaultdict(list)
        for j, other in enumerate(both):
            if paths[other] != paths[chunk]:
                of[vectors[other].repo].append((-scores[i, j], other))
        want |= {(paths[chunk], paths[c]): -s for found in of.values() for s, c in sorted(found)[:3]}
    got = ranking._patterns(spark, SF).select("repo", "file", "file_path", "similarity").collect()
    assert {(r.file, r.file_path) for r in got} == want.keys() and len(got) == len(want)
    assert all(abs(r.similarity - want[r.file, r.file_path]) < 2e-6 for r in got)
    assert {r.file for r in got} == {paths[c] for c in both} and len(both) > 100


def test_kept_hits_stay_bounded_over_batches():
    """A task that sees many batches holds the best of each query and repository, not of each batch."""
    rng = np.random.default_rng(1)
    frame = lambda n, at: pd.DataFrame(
        {"repo": [f"r{i % 3}" for i in range(n)], "chunk_id": range(at, at + n), "file_path": "f", "embedding": list(rng.normal(size=(n, 4))), "kind": "4:"}
    )
    asked = pd.DataFrame({"query_id": range(5), "current_file": None, "embedding": list(rng.normal(size=(5, 4))), "kind": "4:"})
    batches = [frame(30, 30 * i) for i in range(60)]
    top, whole = S.TopHits(asked, 2, True), S.TopHits(asked, 2, True)
    for pdf in batches:
        top.add(pdf)
        assert len(top.best) <= 8 * 2 * 5
    whole.add(pd.concat(batches, ignore_index=True))
    order = lambda df: df.sort_values(["query_id", "repo", "chunk_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(top.cut()), order(whole.cut()))


def test_large_query_sets_may_be_the_searched_rows(spark, monkeypatch):
    """All rows ask all rows, in buckets of whole and of split repositories, as the small path finds them."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(5000, 6)).round(1)  # copies, so ties
    repo = lambda i: "hot" if i % 2 else (None, "r3", f"s{i % 40}")[i % 3]
    rows = [(repo(i), i, f"f{i % 900}.ts", v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "repo string, chunk_id long, file_path string, embedding array<double>").repartition(3)
    asked = df.filter("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), F.col("file_path").alias("current_file"), "embedding")
    found = lambda: sorted((r.query_id, r.repo or "", -r.score, r.chunk_id) for r in S.search_each_repo(df, asked, 3).collect())
    small = found()
    monkeypatch.setattr(S, "SMALL_QUERY_BYTES", 0)
    assert found() == small and len({r[1] for r in small}) > 3
    one = S.search(df, asked, 4).count()
    assert one == 4 * asked.count()


def test_hits_are_exact_where_copies_and_own_rows_fill_the_best_places():
    """Blocks and groups are passed over by single precision; ties go to the lower chunk, and k come back if there are k."""
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(size=(700, 5)), 10, axis=0)
    left = pd.DataFrame({"repo": "r", "chunk_id": rng.permutation(7000), "file_path": [f"own{i // 100}" for i in range(7000)], "embedding": list(m), "kind": "5:"})
    asked = pd.DataFrame({"query_id": range(70), "current_file": [f"own{i}" for i in range(70)], "embedding": list(m[::100]), "kind": "5:"})
    for per_repo in (True, False):
        top = S.TopHits(asked, 25, per_repo)
        top.add(left)
        got = top.cut()
        unit = S._unit(left["embedding"])
        for i in range(70):
            free = ~left["file_path"].str.contains(f"own{i}")
            want = sorted((-s, c) for s, c in zip(np.round(unit[free] @ unit[100 * i], 6), left["chunk_id"][free], strict=True))[:25]
            mine = got[got["query_id"] == i]
            assert sorted(zip(-mine["score"], mine["chunk_id"], strict=True)) == want
