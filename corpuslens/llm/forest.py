"""Approximate nearest neighbours with a forest of hash prefixes.

Every tree labels a vector with a string of ``LABEL_BITS`` bits, each the side of a random plane. A shard of
the index keeps, for each tree, its labels in a sorted array. A query descends in every tree at once to the
longest prefixes that any label shares with it; then all trees ascend together, one bit at a time, until
enough labels lie below the common depth. What lies there are the candidates; their distances to the original
vectors are exact.

The index is split by a hash of the vector into shards of bounded size, and queries meet shards in blocks, so
neither side has to fit into one task. Equal vectors are one entry, with as many of their ids as an answer can
use, so a vector that a third of all rows share is not a hot spot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import one_row, written

TREES = 64
LABEL_BITS = 24
SHARE = 0.9  # labels below the common depth, as a share of the shard, all trees together
SHARD_VECTORS = 8_192
QUERY_BLOCK = 2_048
SEED = 20_011


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not empty and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.exists(vector, lambda x: x != 0) & ~bad


class Forest:
    """The sorted label arrays of one shard. Planes follow from the seed, so all shards use the same."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.trees, self.bits = trees, bits
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((vectors.shape[1], trees * bits))
        self.centre = vectors.mean(axis=0)
        labels = self.labels(vectors)
        self.order = [np.argsort(row, kind="stable") for row in labels]
        self.sorted = [row[order] for row, order in zip(labels, self.order, strict=True)]

    def labels(self, vectors: np.ndarray) -> np.ndarray:
        """One row of integer labels a tree; the first bit of the string is the highest."""
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        found = np.empty((self.trees, len(vectors)), np.int64)
        for start in range(0, len(vectors), 4096):
            side = (vectors[start : start + 4096] - self.centre) @ self.planes > 0
            found[:, start : start + 4096] = (side.reshape(len(side), self.trees, self.bits) @ weights).T
        return found

    def ranges(self, labels: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, where the labels with the query's first ``depth`` bits begin and end."""
        drop = self.bits - depth
        first = (labels >> drop) << drop
        low = np.array([np.searchsorted(s, f) for s, f in zip(self.sorted, first, strict=True)])
        high = np.array([np.searchsorted(s, f + (1 << drop)) for s, f in zip(self.sorted, first, strict=True)])
        return low, high

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, the entries below the depth at which all trees together hold ``least`` labels."""
        labels = self.labels(queries)
        low = np.zeros(labels.shape, np.int64)
        high = low.copy()
        waiting = np.arange(len(queries))
        for depth in range(self.bits, -1, -1):  # descend to the longest prefixes, then ascend together
            if not len(waiting):
                break
            a, b = self.ranges(labels[:, waiting], depth)
            enough = ((b - a).sum(axis=0) >= least) | (depth == 0)
            done = waiting[enough]
            low[:, done], high[:, done] = a[:, enough], b[:, enough]
            waiting = waiting[~enough]
        for q in range(len(queries)):
            mark = np.zeros(len(self.order[0]), bool)
            for t in range(self.trees):
                mark[self.order[t][low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(mark)


def nearest_in_shard(shard: pd.DataFrame, queries: pd.DataFrame, k: int, trees: int, share: float) -> pd.DataFrame:
    """The ``k`` best candidates of the shard for every query of the block."""
    columns = ["query_id", "vec_id", "score"]
    if shard.empty or queries.empty:
        return pd.DataFrame({c: [] for c in columns}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    shard = shard.reset_index(drop=True)
    vectors = np.stack(shard["vector"].to_numpy()).astype(np.float64)
    points = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    forest = Forest(vectors, trees, LABEL_BITS, SEED)
    least = max(trees * k, int(np.ceil(share * len(vectors))))  # k a tree at least, so small shards are searched whole
    ids = shard["ids"].to_numpy()
    lengths = np.array([len(x) for x in ids])
    flat, starts = np.concatenate(ids), np.cumsum(lengths) - lengths
    parts = []
    for q, found in enumerate(forest.candidates(points, least)):
        score = np.sqrt(((vectors[found] - points[q]) ** 2).sum(axis=1))
        if len(found) > k + 1:  # entries no farther than the k + 1 nearest, ties included
            keep = score <= np.partition(score, k)[k]
            found, score = found[keep], score[keep]
        n = lengths[found]
        each = np.repeat(starts[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        vec, score = flat[each], np.repeat(score, n)
        own = vec != queries["query_id"].iat[q]
        vec, score = vec[own], score[own]
        best = np.lexsort((vec, score))[:k]
        parts.append(pd.DataFrame({"query_id": queries["query_id"].iat[q], "vec_id": vec[best], "score": score[best]}))
    return pd.concat(parts)[columns]


def blocks(df: DataFrame, most: int) -> int:
    return max(1, -(-one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"] // most))


def search(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found for each query.

    ``vectors``: (vec_id, embedding). A query's own id is no candidate; ties go to the smaller vec_id. Null
    ids and vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors
    meet only those of their own length. Repeated rows count once; an empty table gives an empty table.
    """
    rows = (
        vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        .withColumn("asks", F.coalesce(is_query, F.lit(False)))
        .distinct()
    )
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = written(
        rows.withColumn("_n", first)
        .filter(F.col("_n") <= k + 1)
        .groupBy("vector")
        .agg(F.collect_list("vec_id").alias("ids")),
        "forest-entries",
    )
    queries = written(rows.filter("asks").select(F.col("vec_id").alias("query_id"), "vector"), "forest-queries")
    n_shards, n_blocks = blocks(entries, SHARD_VECTORS), blocks(queries, QUERY_BLOCK)
    dealt = entries.select(
        F.size("vector").alias("width"),
        F.pmod(F.xxhash64("vector"), F.lit(n_shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        "vector",
        "ids",
    )
    asked = queries.select(
        F.size("vector").alias("width"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
        "query_id",
        "vector",
    )
    keys = ["width", "shard", "block"]
    found = (
        dealt.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(
            lambda shard, block: nearest_in_shard(shard, block, k, trees, share),
            "query_id long, vec_id long, score double",
        )
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
