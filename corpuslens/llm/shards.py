"""Contiguous shards of equal size: the smallest capacity that fits, found by binary search.

Documents of one text form a group that is never split. Groups stand in the order of their 64-bit key, a
hash of the text, so a shard is a range of keys and a document knows its shard from its own text.

The search needs prefix sums over all groups. It reads them from a radix tree over the keys whose nodes
hold (size, number of groups, largest group). Only the nodes that a cut may still fall into are opened,
``FAN_BITS`` key bits deeper each time, so the driver holds at most some hundred nodes times
``2 ** FAN_BITS`` however many groups there are. Expressions only, no Python code on the executors.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import position_in_group, text_key, whole_text, written

FAN_BITS = 8
KEY_BITS = 64
SLOT_BUCKETS = 4096  # slots are counted per (shard, bucket), then numbered inside it


def unsigned_order(key: Column) -> Column:
    """The key with its sign bit flipped, as non-negative pieces compare: used only to cut off high bits."""
    return key.bitwiseXOR(F.lit(-(2**63)))


def node_of(key: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a key, in the order of the signed keys."""
    return F.shiftrightunsigned(unsigned_order(key), KEY_BITS - bits)


class Nodes:
    """Leaves of the opened tree in key order, with prefix sums; positions are sizes before a point."""

    def __init__(self, leaves: list[tuple]):
        self.leaves = sorted(leaves)  # (first key as an unsigned offset, bits, size, groups, largest)
        self.starts = [0]
        for leaf in self.leaves:
            self.starts.append(self.starts[-1] + leaf[2])
        self.total = self.starts[-1]
        self.largest = max((leaf[4] for leaf in self.leaves), default=0)

    def leaf_at(self, position: int) -> int:
        """The leaf that holds the unit after ``position``."""
        return min(bisect_right(self.starts, position) - 1, len(self.leaves) - 1)

    def floor(self, low: int, high: int) -> tuple[int, int]:
        """Bounds of the last group boundary at or before a point known to lie in [low, high]."""
        return self._floor(low)[0], self._floor(high)[1]

    def _floor(self, at: int) -> tuple[int, int]:
        if at >= self.total:
            return self.total, self.total
        k = self.leaf_at(at)
        start, (_, _, _, groups, largest) = self.starts[k], self.leaves[k]
        if at == start or groups == 1:
            return start, start
        return max(start, at - largest + 1), at

    def ceil(self, low: int, high: int) -> tuple[int, int]:
        """Bounds of the first group boundary at or after a point known to lie in [low, high]."""
        return self._ceil(low)[0], self._ceil(high)[1]

    def _ceil(self, at: int) -> tuple[int, int]:
        if at <= 0:
            return 0, 0
        if at >= self.total:
            return self.total, self.total
        k = self.leaf_at(at)
        start, end, (_, _, _, groups, largest) = self.starts[k], self.starts[k + 1], self.leaves[k]
        if at == start:
            return start, start
        if groups == 1:
            return end, end
        return at, min(end, at + largest - 1)

    def reach(self, capacity: int, shards: int) -> tuple[int, int]:
        """Bounds of what greedy filling with ``capacity`` covers."""
        low = high = 0
        for _ in range(shards):
            low, high = self.floor(low + capacity, high + capacity)
        return low, high

    def capacities(self, shards: int) -> tuple[int, int]:
        """Bounds of the smallest feasible capacity, by binary search with a greedy check."""

        def smallest(fits: Callable[[int], bool]) -> int:
            low, high = max(self.largest, -(-self.total // shards)), max(self.total, self.largest)
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if fits(middle) else (middle + 1, high)
            return low

        return (
            smallest(lambda c: self.reach(c, shards)[1] >= self.total),
            smallest(lambda c: self.reach(c, shards)[0] >= self.total),
        )

    def cuts(self, shards: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Bounds of the cut after each shard, and the leaves that must be opened to know them.

        Within the smallest capacity a shard takes its equal part of what is left, but never so little
        that the rest would not fit.
        """
        least, most = self.capacities(shards)
        need = [(self.total, self.total)]  # earliest cuts that let the rest fit, from the end
        for _ in range(shards - 1):
            low, high = need[-1]
            need.append(self.ceil(low - most, high - least))
        need.reverse()
        found, opened = [], set()
        low = high = 0
        for k in range(shards - 1):
            left = shards - k
            share = (low + (self.total - low) // left, high + (self.total - high) // left)
            near = self.floor(*share)
            after = self.ceil(low + 1, high + 1)
            new_low, new_high = (max(a, b, c) for a, b, c in zip(near, after, need[k], strict=True))
            probes = [share, need[k], (low + 1, high + 1), (need[k + 1][0] - most, need[k + 1][1] - least), (new_low, new_high)]
            for a, b in probes:
                opened |= set(range(self.leaf_at(max(a, 0)), self.leaf_at(max(b, 0)) + 1))
            low, high = min(new_low, self.total), min(new_high, self.total)
            found.append((low, high))
        known = set(self.starts)
        exact = least == most and all(a == b and a in known for a, b in found)
        return found, set() if exact else {k for k in opened if self.leaves[k][3] > 1}


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """First key of each shard but the first, from groups (key, size); keys are ordered as unsigned offsets."""

    def summed(rows: DataFrame, bits: int) -> list[tuple]:
        node = node_of(F.col("key"), bits)
        table = rows.groupBy(node.alias("node")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")
        )
        return [((r.node % 2**64) << (KEY_BITS - bits), bits, r.size, r.n, r.largest) for r in table.collect()]

    leaves = summed(groups, FAN_BITS)
    while True:
        tree = Nodes(leaves)
        found, opened = tree.cuts(shards)
        if not opened:
            break
        leaves = [leaf for k, leaf in enumerate(tree.leaves) if k not in opened]
        by_bits: dict[int, list[int]] = {}
        for k in opened:
            first, bits = tree.leaves[k][:2]
            by_bits.setdefault(bits, []).append(first >> (KEY_BITS - bits))
        for bits, nodes in by_bits.items():
            picked = F.array_contains(F.lit(nodes), node_of(F.col("key"), bits))
            leaves += summed(groups.filter(picked), bits + FAN_BITS)
    at = dict(zip(tree.starts, [leaf[0] for leaf in tree.leaves], strict=False))
    return [at.get(position, 2**64) for position, _ in found]


def shard_of(key: Column, firsts: list[int]) -> Column:
    """Number of cuts at or before the key."""
    shard = F.lit(0)
    for first in firsts:
        if first < 2**64:
            shard = shard + (key >= F.lit(first - 2**63)).cast("int")
    return shard


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, key, size, _row, ...) with shard and slot; rows of one key share a shard. ``_row`` is unique.

    Slots count from 0 in each shard without gaps, in the order of a hash of the id.
    """
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    firsts = cut_keys(groups, shards) if shards > 1 else []
    placed = rows.withColumn("shard", shard_of(F.col("key"), firsts))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS))
    return position_in_group(placed, ["shard"], bucket, ["doc_id", "key", "_row"], "slot").drop("_row")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Size is the number of UTF-8 bytes of the text plus 1, so a null or empty text has size 1 and the
    checksum 0. Equal texts share a shard; where one group is larger than an equal part, its shard is as
    large as the group and the others share the rest. Repeated rows and null ids are placed like others.
    With fewer groups than shards, the last shards are empty; an empty table gives an empty table.
    """
    text = whole_text(F.col("text"))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(F.col("text")).alias("key"),
            F.monotonically_increasing_id().alias("_row"),  # tells repeated rows apart; written, so it stays
        ),
        "shard-rows",
    )
    return assign(rows, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
