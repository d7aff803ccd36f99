"""Best-fit packing of documents into fixed-size sequences under conflicts.

Two pieces of one source, or of one cluster of duplicates, never share a bin. Bins are kept in the order of
what is left in them and carry bitmaps of the sources and clusters inside; a piece takes the fullest bin that
it fits into, and where that conflicts the search goes on to the next fuller-to-emptier bin until one is
compatible. Pieces come largest first.

Documents are dealt by a hash into packing groups of bounded size, and every group is packed on its own in one
task, so a hot source or cluster is spread evenly over the groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import one_row, text_key, word_count, written

CAPACITY = 2048
GROUP_PIECES = 8_192
OUT = "doc_id long, row long, piece int, start long, size long, source string, cluster long, bin string, offset long, filled long"


class Bins:
    """Bins of one group, ordered by what is left; each holds bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (left, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest compatible bin; a new one if there is none."""
        order, sources, clusters = self.order, self.sources, self.clusters
        for at in range(bisect_left(order, (size, -1)), len(order)):
            left, bin_ = order[at]
            if not (sources[bin_] & source or clusters[bin_] & cluster):
                del order[at]
                break
        else:
            bin_, left = len(self.used), self.capacity
            sources.append(0)
            clusters.append(0)
            self.used.append(0)
        offset = self.used[bin_]
        sources[bin_] |= source
        clusters[bin_] |= cluster
        self.used[bin_] += size
        if left > size:
            insort(order, (left - size, bin_))
        return bin_, offset


def bits_of(values: list, only_repeated: bool) -> list[int]:
    """One bit per distinct value; no bit for null, and none for a value seen once if ``only_repeated``."""
    seen = Counter(values)
    shown = [v for v in dict.fromkeys(values) if v is not None and not (only_repeated and seen[v] == 1)]
    bits = {value: 1 << k for k, value in enumerate(shown)}
    return [bits.get(value, 0) for value in values]


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pieces = pieces.sort_values(
        ["size", "doc_id", "cluster", "row", "piece"], ascending=[False, True, True, True, True], na_position="last"
    ).reset_index(drop=True)
    bins = Bins(capacity)
    null_free = lambda c: [None if v is None or v != v else v for v in pieces[c].tolist()]
    sources, clusters = bits_of(null_free("source"), False), bits_of(null_free("cluster"), True)
    placed = [bins.place(*piece) for piece in zip(pieces["size"].tolist(), sources, clusters, strict=True)]
    numbers = np.array([b for b, _ in placed], np.int64)
    group = pieces["group"].iat[0]
    pieces["bin"] = [f"{group}-{b}" for b in numbers]
    pieces["offset"] = [o for _, o in placed]
    pieces["filled"] = np.array(bins.used, np.int64)[numbers]
    return pieces.drop(columns="group")


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece of every item with its bin, its offset there and how far the bin is filled.

    ``items``: (doc_id, row, size, source, cluster), where row is unique. An item larger than ``capacity`` is cut into pieces of
    that size and a rest, each with its start; nothing is dropped. Size 0 makes one piece of size 0. A null
    source or cluster conflicts with nothing; an empty table gives an empty table.
    """
    count = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    pieces = items.select(
        "doc_id", "row", "source", "cluster", F.col("size").alias("_size"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")
    ).select(
        "doc_id",
        "row",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.col("_size") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("long").alias("size"),
        "source",
        "cluster",
    )
    total = one_row(items.agg(F.sum(count).alias("n")))["n"] or 0
    groups = max(1, -(-total // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(lambda pdf: pack_group(pdf, capacity), OUT)


def packable(docs: DataFrame, cluster: Column | None = None) -> DataFrame:
    """Items of documents: size in words, cluster of equal texts unless another is given.

    Copies of one document are rows of their own and conflict like other duplicates.
    """
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        (text_key(F.col("text")) if cluster is None else cluster).alias("cluster"),
    )
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "packing-items")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(packable(docs), capacity)
