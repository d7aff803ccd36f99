"""Approximate search over chunk vectors: a coarse index of cells with byte codes, scored exactly at the end.

``build_index`` fits the centres of the cells on a bounded sample and assigns every usable vector to its nearest
centre. A row keeps its vector and the byte code of what is left after the centre is taken off. ``ann_search``
sends a query to the cells nearest to it, shortlists their rows by the codes, and orders the shortlist by the exact
cosine. How many cells a query visits is measured on the sample when the index is built, not guessed.

Vectors of one length are indexed, the most common one unless it is named; others, and null ones or ones with
null or non-finite entries, and chunks without an id, take no part. A vector of zeros has the score 0. Query ids
are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.windows import top_per_group
from corpuslens.operators.search import DEFAULT_K, SCORE_DIGITS, best_first, checked_broadcast
from corpuslens.session import cut_lineage

SAMPLE_ROWS = 32_768  # the centres are fitted on so many rows at most
MOST_CELLS = 4_096
ROUNDS = 12
ASKED_ROWS = 256  # sample rows that try out how many cells are enough
TARGET = 0.95  # of the neighbours within the sample
SHORTLIST = 4  # rows kept by code for each hit asked for
SCAN_PAIRS = 1 << 18  # (query, cell) pairs that may travel to every task; more are met by a shuffle
BUCKET_ROWS = 1 << 17  # rows of a cell in one group
BLOCK_QUERIES = 1 << 11  # queries of a cell in one group
CELLS_AT_ONCE = 1 << 22  # scores held at once

ROWS = "cell int, repo string, chunk_id long, file_path string, embedding array<float>, scale float, code binary"
FOUND = "query_id long, row long, chunk_id long, repo string, near double"
PLACES = "query_id long, unit array<float>, place int, cell int"


@dataclass
class Index:
    """``rows`` hold ROWS and a fixed number ``row``; ``centres`` are unit vectors; ``probes`` cells are visited by default."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def usable(dims: int) -> Column:
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & ~odd


def unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norm == 0, 1.0, norm)).astype(np.float32)


def nearest_centre(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS_AT_ONCE // len(centres))
    parts = [(units[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(units), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a cell that loses all its rows starts again at the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    cells = min(cells, len(distinct))
    centres = distinct[np.sort(rng.choice(len(distinct), cells, replace=False))]
    for _ in range(rounds):
        own = nearest_centre(sample, centres)
        sums = np.zeros(centres.shape)
        np.add.at(sums, own, sample)
        fit = np.einsum("ij,ij->i", sample, centres[own])
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm == 0, centres, sums / np.where(norm == 0, 1.0, norm)).astype(np.float32)
    return centres


def enough_probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float, asked: int = ASKED_ROWS) -> int:
    """The least number of cells that hold ``target`` of the k nearest sample rows of sample rows.

    The sample is thinner than the table, so its neighbours are farther and the number errs on the high side.
    """
    own = nearest_centre(sample, centres)
    step = max(1, len(sample) // asked)
    places = []
    for at in range(0, len(sample), step):
        score = sample @ sample[at]
        score[at] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        order = np.argsort(-(centres @ sample[at]), kind="stable")
        place = np.empty(len(centres), np.int64)
        place[order] = np.arange(1, len(centres) + 1)
        places.append(place[own[near]])
    every = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return int(every[int(np.ceil(target * len(every))) - 1]) if len(every) else 1


def common_length(vectors: DataFrame) -> int:
    """The most frequent vector length, the larger one of two; 0 without vectors."""
    lengths = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
    first = lengths.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return first["d"] if first else 0


def bounded_sample(vectors: DataFrame, rows: int, total: int) -> np.ndarray:
    """Unit vectors of about ``rows`` rows and no more, chosen by a hash of their key, so reruns agree."""
    drawn = F.xxhash64("repo", "chunk_id")
    if total > rows:
        vectors = vectors.filter(F.pmod(drawn, F.lit(1 << 40)) < int((1 << 40) * rows / total))
    taken = vectors.select("embedding", drawn.alias("_drawn")).orderBy("_drawn").limit(rows).toPandas()
    return unit_rows(taken["embedding"])


def build_index(
    vectors: DataFrame, cells: int | None = None, dims: int | None = None, k: int = DEFAULT_K, target: float = TARGET,
    sample_rows: int = SAMPLE_ROWS,
) -> Index:
    """Index of (repo, chunk_id, file_path, embedding); about as many cells as the square root of the rows.

    The rows are range-partitioned by cell and a hash, so a cell that holds most rows fills many partitions, and
    a scan for some cells skips the other row groups. They are written to the checkpoint folder.
    """
    dims = dims or common_length(vectors)
    held = vectors.filter(usable(dims) & F.col("chunk_id").isNotNull())
    fit = held.select("repo", "chunk_id", "file_path", F.col("embedding").cast("array<float>").alias("embedding"))
    total = fit.count()
    if total == 0:
        empty = vectors.sparkSession.createDataFrame([], ROWS + ", row long")
        return Index(empty, np.zeros((0, dims), np.float32), 0)
    sample = bounded_sample(fit, sample_rows, total)
    if not len(sample):  # nearly all rows share one key, whose hash was not drawn
        sample = unit_rows(fit.limit(1).toPandas()["embedding"])
    centres = fit_centres(sample, cells or max(1, min(MOST_CELLS, round(total**0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = unit_rows(pdf["embedding"])
                own = nearest_centre(units, centres)
                rest = units - centres[own]
                scale = np.abs(rest).max(axis=1) / 127
                codes = np.rint(rest / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
                yield pdf.assign(cell=own.astype(np.int32), scale=scale, code=[c.tobytes() for c in codes])[
                    [c.split()[0] for c in ROWS.split(", ")]
                ]

    placed = fit.mapInPandas(assign, ROWS)
    dealt = placed.repartitionByRange("cell", F.xxhash64("repo", "chunk_id")).sortWithinPartitions("cell")
    rows = cut_lineage(dealt.withColumn("row", F.monotonically_increasing_id()))
    return Index(rows, centres, enough_probes(sample, centres, k, target))


def save_index(index: Index, location: str) -> None:
    """Write the rows and the centres (4,096 of them at most) to a new folder that all executors share."""
    spark = index.rows.sparkSession
    index.rows.write.parquet(f"{location}/rows")
    centres = [(i, c.tolist(), index.probes) for i, c in enumerate(index.centres)]
    spark.createDataFrame(centres, "cell int, centre array<float>, probes int").coalesce(1).write.parquet(f"{location}/centres")


def load_index(spark: SparkSession, location: str) -> Index:
    held = spark.read.parquet(f"{location}/centres").orderBy("cell").toPandas()
    centres = np.stack([np.asarray(c, np.float32) for c in held["centre"]]) if len(held) else np.zeros((0, 0), np.float32)
    return Index(spark.read.parquet(f"{location}/rows"), centres, int(held["probes"].max()) if len(held) else 0)


class Shortlist:
    """The rows nearest to each query by their codes, over all batches of a task; ties to the lower chunk and repository."""

    def __init__(self, keep: int):
        self.keep = keep
        self.best: pd.DataFrame | None = None
        self.most = 0

    def add(self, rows: pd.DataFrame, centre: np.ndarray, query_id: np.ndarray, units: np.ndarray) -> None:
        codes = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1).astype(np.float32)
        scale, chunk = rows["scale"].to_numpy(np.float32)[:, None], rows["chunk_id"].to_numpy()
        at, asked, score = [], [], []
        step = max(1, CELLS_AT_ONCE // len(rows))
        for lo in range(0, len(units), step):
            some = units[lo : lo + step]
            near = some @ centre + scale * (codes @ some.T)
            for j in range(near.shape[1]):
                column = near[:, j]
                if len(column) > self.keep:
                    least = np.partition(column, len(column) - self.keep)[len(column) - self.keep]
                    picks = np.flatnonzero(column >= least)
                else:
                    picks = np.arange(len(column))
                at.append(picks[np.lexsort((chunk[picks], -column[picks]))])
                asked.append(np.full(len(picks), query_id[lo + j]))
                score.append(column[at[-1]])
        found = rows.iloc[np.concatenate(at)][["row", "chunk_id", "repo"]]
        found = found.assign(query_id=np.concatenate(asked), near=np.concatenate(score).astype(np.float64))
        self.best = found if self.best is None else pd.concat([self.best, found], ignore_index=True)
        if len(self.best) > self.most:
            self.best = self.cut()
            self.most = 4 * len(self.best) + 4096

    def cut(self) -> pd.DataFrame:
        order = self.best.sort_values(["near", "chunk_id", "repo"], ascending=[False, True, True], kind="stable")
        kept = order.groupby("query_id", sort=False).head(self.keep)
        return kept[[c.split()[0] for c in FOUND.split(", ")]]


def route(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """The cells each query (query_id, embedding) visits, nearest first."""
    centres = index.centres

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, CELLS_AT_ONCE // len(centres))
            for lo in range(0, len(pdf), step):
                some = pdf[lo : lo + step]
                units = unit_rows(some["embedding"])
                order = np.argsort(-(units @ centres.T), axis=1, kind="stable")[:, :probes]
                n = order.shape[1]
                yield pd.DataFrame({
                    "query_id": np.repeat(some["query_id"].to_numpy(), n), "unit": [u for u in units for _ in range(n)],
                    "place": np.tile(np.arange(n), len(some)), "cell": order.ravel(),
                })

    asked = queries.filter(usable(centres.shape[1])).select("query_id", "embedding")
    return asked.mapInPandas(places, PLACES)


def scan(index: Index, visits: DataFrame, keep: int) -> DataFrame:
    """Shortlists of a counted small set of visits: every task reads its rows of the visited cells once."""
    held = visits.select("query_id", "unit", "cell").toPandas()
    asked = {c: (g["query_id"].to_numpy(), np.stack(g["unit"].to_list())) for c, g in held.groupby("cell")}
    centres = index.centres

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = Shortlist(keep)
        for pdf in batches:
            for cell, rows in pdf.groupby("cell"):
                short.add(rows, centres[cell], *asked[cell])
        if short.best is not None:
            yield short.cut()

    columns = index.rows.select("cell", "row", "repo", "chunk_id", "scale", "code")
    return columns.filter(F.col("cell").isin([int(c) for c in asked])).mapInPandas(walk, FOUND)


def meet(index: Index, visits: DataFrame, keep: int, bucket_rows: int = BUCKET_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Shortlists of any number of visits: buckets of a cell's rows meet blocks of the queries that visit it.

    Buckets and blocks are cut by hash from counted sizes, so a cell with most rows or most visits has many.
    """
    one = F.lit(1)
    parts = F.ceil(F.count(one) / bucket_rows).alias("_buckets")
    blocks = F.ceil(F.count(one) / block_queries).alias("_blocks")
    # one row a cell, MOST_CELLS at most
    plan = F.broadcast(index.rows.groupBy("cell").agg(parts).join(visits.groupBy("cell").agg(blocks), "cell"))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    rows = index.rows.select("cell", "row", "repo", "chunk_id", "scale", "code").join(plan, "cell")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.col("_buckets"))).withColumn("_block", every("_blocks"))
    rows = rows.drop("_buckets", "_blocks")
    asked = visits.join(plan, "cell").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")))
    asked = asked.withColumn("_bucket", every("_buckets")).drop("_buckets", "_blocks")
    centres = index.centres

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        short = Shortlist(keep)
        short.add(left, centres[left["cell"].iloc[0]], right["query_id"].to_numpy(), np.stack(right["unit"].to_list()))
        return short.cut()

    keys = ["cell", "_bucket", "_block"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda a, b: score(a, b), FOUND)


def cosine(a: str, b: str) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b)))
    return F.round(F.coalesce(F.try_divide(dot(F.col(a), F.col(b)), norms), F.lit(0.0)), SCORE_DIGITS)


def ann_search(
    index: Index, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None, scan_pairs: int = SCAN_PAIRS
) -> DataFrame:
    """About the k best chunks of each query (query_id, embedding) by cosine, with exact scores.

    ``rows_read`` and ``n_rows`` say how many of the index's rows lie in the cells the query visited. With
    ``probes`` of all cells the codes of all rows are looked at. Rows of a cell come from the index by its code
    alone; vectors are read for the shortlist, ``SHORTLIST`` times k rows a query.
    """
    schema = "query_id long, repo string, chunk_id long, file_path string, score double, rows_read long, n_rows long"
    cells = len(index.centres)
    if not cells:
        return queries.sparkSession.createDataFrame([], schema)
    probes = min(cells, probes or index.probes)
    visits = cut_lineage(route(index, queries, probes))
    met = scan if visits.count() <= scan_pairs else meet
    found = met(index, visits, SHORTLIST * k)
    order = [F.col("near").desc(), F.col("chunk_id"), F.col("repo").asc_nulls_last()]
    short = top_per_group(found, ["query_id"], order, SHORTLIST * k).select("query_id", "row")
    asked = queries.filter(usable(index.centres.shape[1])).select("query_id", F.col("embedding").alias("_asked"))
    exact = index.rows.select("row", "repo", "chunk_id", "file_path", "embedding").join(checked_broadcast(short), "row")
    scored = exact.join(asked, "query_id").withColumn("score", cosine("embedding", "_asked"))
    hits = top_per_group(scored, ["query_id"], best_first(), k)
    sizes = index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    read = visits.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("rows_read"))
    hits = hits.join(read, "query_id").withColumn("n_rows", F.lit(index.rows.count()))
    return hits.select(*[c.split()[0] for c in schema.split(", ")])
