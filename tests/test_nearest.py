"""The coarse index: recall against the exact search, cells of any size, odd rows."""

import numpy as np
import pytest

from corpuslens.operators import nearest as N
from corpuslens.operators import search as S

SCHEMA = "repo string, chunk_id long, file_path string, embedding array<float>"


def table(spark, vectors, repo="r"):
    rows = [(repo if i % 5 else None, i, f"f{i}.ts", v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def asked(df, step=50):
    return df.filter(f"chunk_id % {step} = 0").selectExpr("chunk_id as query_id", "embedding")


def hits(df):
    return {(r.query_id, r.repo, r.chunk_id, r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors around 40 points; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(1)
    points = rng.normal(size=(40, 16))
    vectors = points[rng.integers(40, size=2000)] + 0.15 * rng.normal(size=(2000, 16))
    every = np.vstack([vectors, np.repeat(vectors[:1], 1000, axis=0)])
    return table(spark, every[rng.permutation(len(every))]).cache()


def test_recall_and_share_of_clustered_vectors(spark, clustered):
    index = N.build_index(clustered)
    got = N.ann_search(index, asked(clustered, 20))
    want = hits(S.search(clustered, asked(clustered, 20)))
    found = hits(got)
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.9
    alone = [r.rows_read / r.n_rows for r in got.filter("score < 0.99999").collect()]
    assert np.median(alone) < 0.25  # most queries read few cells


def test_all_cells_give_the_exact_hits_by_either_way(spark, clustered):
    index, queries = N.build_index(clustered), asked(clustered, 100)
    want = hits(S.search(clustered, queries))
    assert hits(N.ann_search(index, queries, probes=10**6)) == want
    assert hits(N.ann_search(index, queries, probes=10**6, scan_pairs=0)) == want


def test_buckets_and_blocks_change_nothing(spark, clustered):
    """The cell of the copies meets its queries in many groups."""
    index = N.build_index(clustered)
    visits = N.route(index, asked(clustered, 10), 4)
    best = lambda df: {(r.query_id, r.row) for r in N.top_per_group(df, ["query_id"], [N.F.col("near").desc(), N.F.col("chunk_id")], 40).collect()}
    assert best(N.meet(index, visits, 40, bucket_rows=50, block_queries=7)) == best(N.scan(index, visits, 40))


def test_recall_of_vectors_without_clusters(spark):
    rng = np.random.default_rng(2)
    df = table(spark, rng.normal(size=(1500, 24))).cache()
    want = hits(S.search(df, asked(df, 20)))
    assert len(hits(N.ann_search(N.build_index(df), asked(df, 20))) & want) / len(want) >= 0.9


def test_a_written_index_gives_the_same_hits(spark, clustered, tmp_path):
    index = N.build_index(clustered)
    N.save_index(index, str(tmp_path / "index"))
    again = N.load_index(spark, str(tmp_path / "index"))
    assert again.probes == index.probes
    assert hits(N.ann_search(again, asked(clustered))) == hits(N.ann_search(index, asked(clustered)))


def test_odd_vectors_repeated_rows_and_empty_tables(spark):
    good = [[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0]]
    odd = [None, [], [1, None, 0], [float("nan"), 0, 0], [float("inf"), 0, 0], [1, 0]]
    df = table(spark, good + odd)
    twice = df.unionByName(df).unionByName(df.limit(1).withColumn("chunk_id", N.F.lit(None).cast("long")))
    index = N.build_index(twice)
    assert index.rows.count() == 10
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = N.ann_search(index, queries, k=4, probes=99).collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, -r.score, r.chunk_id))] == [
        (1, 0, 1.0), (1, 0, 1.0), (1, 1, 0.993884), (1, 1, 0.993884), (4, 0, 0.0), (4, 0, 0.0), (4, 1, 0.0), (4, 1, 0.0)
    ]
    assert N.ann_search(index, queries.limit(0)).collect() == []
    assert N.ann_search(N.build_index(df.limit(0)), queries).collect() == []
