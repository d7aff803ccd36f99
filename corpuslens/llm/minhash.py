"""Near-duplicate documents: one-permutation hashing, banded buckets and star-shaped candidate edges.

1. Words become 64-bit shingle hashes. Documents with equal shingle sets form a class; later steps see one
   node a class, so exact copies cost nothing more.
2. One hash splits the shingles of a node into ``BINS`` bins; the least value of each bin is its minimum, and
   an empty bin borrows from a bin that a fixed hash of (bin, attempt) picks (optimal densification).
3. ``BANDS`` bands of the minima are bucket keys. A pair with similarity s shares a bucket with probability
   1 - (1 - s**4)**32: at 0.8 all but 5 in 10**8.
4. In each bucket the smallest node is the star centre: only (centre, member) pairs are made. They are
   confirmed on the full shingle sets. First each member meets its most frequent centre, then the others
   unless both are in one component by then.
5. A member that is not in its centre's component may still be near another member. Where the other members
   of a bucket lie in several components, they are cut into blocks that meet pairwise, and compared there: first
   by short marks, which for small sets bound the intersection from above, then on the full sets. A pair is
   looked at in the first bucket it shares only; no row per pair is made, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.windows import first_per_group
from corpuslens.llm.common import text_key, written
from corpuslens.llm.components import merge_labels

SHINGLE_WORDS = 5
PERCENT = 80
BIN_BITS = 7
BINS = 1 << BIN_BITS
BANDS = 32
ROWS = BINS // BANDS

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words than a shingle make one of all of them.

    bytes.lower and bytes.split know ASCII only: A-Z and the six white-space characters.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mixed(total * _ODD + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(total)


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
_BIN_IDS = np.arange(BINS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of each bin; an empty bin borrows the value of the bin that its own probes reach first."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.append(at[1:], len(shingles)) > at
    values = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    attempt = 1
    while len(empty):
        probe = (_mixed(_BIN_IDS[empty] * _ODD + np.uint64(attempt)) >> np.uint64(64 - BIN_BITS)).astype(np.intp)
        hit = full[probe]
        values[empty[hit]] = shingles[at[probe[hit]]]
        empty = empty[~hit]
        attempt += 1
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """Bucket keys, one row a document: the band's number and its ``ROWS`` minima in one 64-bit value."""
    parts = values.reshape(len(values), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS))
    for k in range(ROWS):
        keys = _mixed(keys * _ODD + parts[:, :, k])
    return keys


SMALL = 2 * BINS  # sets of fewer shingles are compared by a byte of every shingle, others by one of each minimum
# A pair at 0.8 has 102 of 128 marks in common, with a standard deviation of 4.5 in sets of SMALL shingles or
# more: 72 is 6.7 deviations less.
LEAST_MARKS = 72


def marks_of(shingles: np.ndarray, values: np.ndarray, percent: int) -> bytes:
    """What ``possible`` compares: a byte of each minimum, and a byte of each shingle where the partner may be small."""
    n = len(shingles)
    of_bins = _mixed(values).astype(np.uint8).tobytes() if n >= SMALL else b""
    return of_bins + (_mixed(shingles).astype(np.uint8).tobytes() if percent * n < 100 * SMALL else b"")


def sketches(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row_key, n_shingles, k1, k2, bands, marks) of every document; no shuffle.

    (k1, k2) names the shingle set. An empty set has no name, no bands and no marks.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, rows, found = [], [], [], []
            marks: list[bytes | None] = [None] * batch.num_rows
            for i, text in enumerate(batch.column("text").to_pylist()):
                shingles = shingle_set(text, size)
                n.append(len(shingles))
                if len(shingles):
                    name = xxhash.xxh128_intdigest(shingles.tobytes())
                    names.append((name >> 64, name & (2**64 - 1)))
                    rows.append(i)
                    found.append(minima(shingles))
                    marks[i] = marks_of(shingles, found[-1], percent)
            keys = band_keys(np.array(found)) if found else np.empty((0, BANDS), np.uint64)
            has = np.zeros(batch.num_rows, bool)
            has[rows] = True
            k = np.zeros((batch.num_rows, 2), np.uint64)
            if names:
                k[rows] = np.array(names, np.uint64)
            offsets = np.append(0, np.cumsum(has * BANDS)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            k = k.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"), pa.array(n, pa.int64()),
                    pa.array(k[:, 0], mask=~has), pa.array(k[:, 1], mask=~has), bands,
                    pa.array(marks, pa.binary()),
                ],
                names=["doc_id", "row_key", "n_shingles", "k1", "k2", "bands", "marks"],
            )

    plain = docs.select("doc_id", text_key(F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return plain.mapInArrow(
        walk, f"doc_id {kind}, row_key long, n_shingles long, k1 long, k2 long, bands array<long>, marks binary"
    )


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(ca, cb): the components that pairs (a, b) join whose full shingle sets are similar enough.

    Pairs in one component already, and those whose sizes alone rule them out, are dropped before any text
    moves. ``nodes``: (node, n, comp); ``texts``: (node, text).
    """
    of = lambda side: nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "comp")])
    fitting = (
        pairs.join(of("a"), F.col("a") == F.col("node_a"))
        .join(of("b"), F.col("b") == F.col("node_b"))
        .filter("comp_a <> comp_b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb"))
    )
    with_b = fitting.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None  # a join by a brings the rows of one centre together
        for batch in batches:
            a = batch.column("a").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i] != known:
                    known, own = a[i], shingle_set(ta[i].as_py(), size)
                other = shingle_set(tb[i].as_py(), size)
                common = len(np.intersect1d(own, other, assume_unique=True))
                good[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["ca", "cb"]).filter(pa.array(good))

    return both.select("a", "ta", "tb", "ca", "cb").mapInArrow(walk, "ca long, cb long")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per shingle set: node, k1, k2, n, the smallest doc_id, and one row that holds the text."""
    grouped = (
        rows.filter(F.col("k1").isNotNull())
        .groupBy("k1", "k2")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.max("n_shingles").alias("n"),
            F.min(F.struct("row_key", "doc_id")).alias("holder"),
            F.first("bands").alias("bands"),
            F.first("marks").alias("marks"),
        )
    )
    return written(grouped.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets that hold two nodes or more."""
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return written(spread.join(shared, "bucket"), "shared-buckets")


BLOCK_NODES = 512  # nodes of a bucket in one block
HOLDER_ROWS = 500_000  # up to so many class representatives are broadcast to find their texts: 12 MB of keys


def link(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, comp) of every node that shares a bucket with another."""
    buckets = shared_buckets(classes)
    shared = buckets.select("node").distinct()
    holders = written(classes.join(shared, "node").select("node", "n", "holder", "bands", "marks"), "candidates")
    nodes = holders.select("node", "n", F.col("node").alias("comp"))
    texts = texts_of(holders, docs)

    centres = buckets.groupBy("bucket").agg(F.min("node").alias("a"))
    stars = buckets.withColumnRenamed("node", "b").join(centres, "bucket").filter("a <> b")
    counted = stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    ranked = written(counted.withColumn("turn", F.row_number().over(best)), "star-edges")
    for turn in ("turn = 1", "turn > 1"):
        nodes = merge_labels(nodes, confirm(ranked.filter(turn).select("a", "b"), nodes, texts, size, percent))

    marks = holders.select("node", "bands", "marks")
    return merge_labels(nodes, compare_rest(buckets, nodes, marks, texts, size, percent)).select("node", "comp")


def texts_of(holders: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of every class representative.

    The representatives are a part of the documents, named by numbers: up to ``HOLDER_ROWS`` of them go to all
    tasks and only their texts move, beyond that the texts of all documents are shuffled once.
    """
    at = lambda key, doc_id: F.xxhash64(key, doc_id)
    wanted = holders.select("node", F.col("holder.doc_id").alias("_id"), F.col("holder.row_key").alias("_key"))
    wanted = wanted.withColumn("_at", at(F.col("_key"), F.col("_id")))
    if holders.count() <= HOLDER_ROWS:
        wanted = F.broadcast(wanted)
    named = docs.select("doc_id", "text", text_key(F.col("text")).alias("_row"))
    named = named.withColumn("_row_at", at(F.col("_row"), F.col("doc_id")))
    same = (F.col("_row_at") == F.col("_at")) & (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = named.join(wanted, same)
    return written(found.groupBy("node").agg(F.first(F.col("text").cast("binary")).alias("text")), "candidate-texts")


CELL = ["bucket", "x", "y"]


def compare_rest(
    buckets: DataFrame, nodes: DataFrame, marks: DataFrame, texts: DataFrame, size: int, percent: int
) -> DataFrame:
    """(ca, cb): links among the nodes of a bucket that are not its centre and lie in several components.

    Such a bucket is cut into blocks by a hash, and every two blocks meet in one task, so what moves is nodes
    times blocks and never a row per pair. A pair is compared in the first bucket that its nodes share, and
    only while the two are in different components there. Buckets that the stars have settled take no part.
    The blocks meet twice: first with the marks alone (see ``possible``), then with the texts of the nodes that
    still have a partner.
    """
    now = buckets.join(nodes, "node")
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("centre"))
    others = now.join(centres, "bucket").filter("node <> centre")
    open_ones = (
        others.groupBy("bucket")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
        .filter("lo <> hi")
        .select("bucket", F.ceil(F.col("members") / BLOCK_NODES).cast("int").alias("blocks"))
    )
    rest = written(
        others.join(open_ones, "bucket").select(
            "bucket", "node", "n", "comp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
        ),
        "unsettled-buckets",
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    known = marks.join(rest.select("node").distinct(), "node", "left_semi")
    cells = (
        rest.join(known, "node")
        .select("bucket", "node", "n", "comp", "block", "bands", "marks", every.alias("other"))
        .withColumn("x", F.least("block", "other"))
        .withColumn("y", F.greatest("block", "other"))
        .select("bucket", "x", "y", "block", "node", "n", "comp", "bands", "marks")
    )
    kinds = "bucket long, x int, y int, block int, node long, n long, comp long, bands array<long>, marks binary"
    left = written(in_cells(cells, lambda cell: with_partner(cell, percent), kinds), "near-by-marks")
    return in_cells(left.join(texts, "node"), lambda cell: compare_blocks(cell, size, percent), "ca long, cb long")


def in_cells(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of every (bucket, x, y), which have two blocks at most."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in CELL]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if held and any(held[-1].column(c)[0].as_py() != k[0] for c, k in zip(CELL, keys, strict=True)):
                yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()
                held = []
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                held.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()
                    held = []
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(walk, schema)


class Cell:
    """The nodes of two blocks of a bucket (or of one), as arrays."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.n, self.comp = rows.column("n").to_numpy(), rows.column("comp").to_numpy()
        self.bands = np.array(rows.column("bands").combine_chunks().flatten()).reshape(len(rows), BANDS)
        self.band = int(np.flatnonzero(self.bands[0] == rows.column("bucket")[0].as_py())[0])
        marks = rows.column("marks").to_pylist()
        self.minima = np.zeros((len(rows), BINS), np.uint8)
        self.shingles = np.zeros((len(rows), 256), np.uint16)
        for i, own in enumerate(marks):
            large = BINS if self.n[i] >= SMALL else 0
            if large:
                self.minima[i] = np.frombuffer(own, np.uint8, BINS)
            self.shingles[i] = np.bincount(np.frombuffer(own, np.uint8, offset=large), minlength=256)
        block, x, y = rows.column("block").to_numpy(), rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        self.left, self.right, self.one = np.flatnonzero(block == x), np.flatnonzero(block == y), x == y

    def partners(self, i: int) -> np.ndarray:
        return self.possible(i, self.right[self.right > i] if self.one else self.right)

    def possible(self, i: int, near: np.ndarray) -> np.ndarray:
        """Which of the rows ``near`` may be linked with row i, in this bucket.

        They are in another component, of a fitting size, and share no earlier bucket. Where one of the two has
        fewer than ``SMALL`` shingles, the bytes that both have, with multiplicity, are at least as many as the
        shingles that both have, so no link is lost; else ``LEAST_MARKS`` of the minima are equal.
        """
        n, percent = self.n, self.percent
        near = near[(self.comp[near] != self.comp[i]) & (100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i]))]
        if len(near):
            near = near[(self.bands[near] == self.bands[i]).argmax(axis=1) == self.band]
        if not len(near):
            return near
        small = np.minimum(n[near], n[i]) < SMALL
        good = np.zeros(len(near), bool)
        few = near[small]
        most = np.minimum(self.shingles[few], self.shingles[i]).sum(axis=1, dtype=np.int64)
        good[small] = (100 + percent) * most >= percent * (n[few] + n[i])
        good[~small] = (self.minima[near[~small]] == self.minima[i]).sum(axis=1) >= LEAST_MARKS * percent // 80
        return near[good]


def with_partner(rows: pa.Table, percent: int) -> pa.Table:
    """The rows that may be linked with a row of the other block in this bucket."""
    cell = Cell(rows, percent)
    keep = np.zeros(len(rows), bool)
    for i in cell.left:
        partners = cell.partners(i)
        keep[partners] = True
        keep[i] |= len(partners) > 0
    return rows.filter(pa.array(keep)).select(["bucket", "x", "y", "block", "node", "n", "comp", "bands", "marks"])


def compare_blocks(rows: pa.Table, size: int, percent: int) -> pa.Table:
    """Links between two blocks of a bucket (or within one), at most one for each two components joined here."""
    cell = Cell(rows, percent)
    texts, sets = rows.column("text"), {}
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[int(i)].as_py(), size)
        return sets[i]

    found = []
    for i in cell.left:
        for j in cell.partners(i):
            a, b = root(int(cell.comp[i])), root(int(cell.comp[j]))
            if a == b:
                continue
            one, two = shingles(i), shingles(j)
            common = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common >= percent * (len(one) + len(two) - common):
                parent[b] = a
                found.append((int(cell.comp[i]), int(cell.comp[j])))
    return pa.table({"ca": pa.array([f[0] for f in found], pa.int64()), "cb": pa.array([f[1] for f in found], pa.int64())})


def with_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept and comp, a number of the component; null without shingles."""
    rows = written(sketches(docs, size, percent), "sketches")
    classes = classes_of(rows)
    labels = link(classes, docs, size, percent).withColumnRenamed("node", "_node")
    named = classes.join(labels, F.col("node") == F.col("_node"), "left").select(
        "k1", "k2", "least_id", F.coalesce("comp", "node").alias("comp")
    )
    least = named.groupBy("comp").agg(F.min("least_id").alias("component"))
    ids = named.join(least, "comp").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "component", "comp")
    joined = rows.drop("bands", "marks").join(ids, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id",
        "row_key",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "comp",
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and kept of every document.

    Two documents are linked if the intersection of their shingle sets has at least ``percent`` % of the
    size of the union; component_id is the smallest doc_id reachable. A null, empty or blank text has no
    shingles and is linked with nothing; shorter texts than a shingle are one shingle. Repeated rows have
    one result each, the same; a null doc_id is never the smallest unless the component has no other.
    """
    return with_components(docs, size, percent).drop("comp")


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, with the columns it came with.

    It is one with the kept id, of several texts with that id the one with the smallest key, of rows repeated with
    id and text any one. Texts without shingles are in no group: all of their rows stay.
    """
    found = written(with_components(docs.select("doc_id", "text"), size, percent).filter("kept"), "kept-documents")
    alone = found.filter("comp is null").select("doc_id", "row_key").distinct()
    rows = found.filter("comp is not null").groupBy("comp", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    chosen = rows.groupBy("comp").agg(F.min(F.struct("row_key", "doc_id", "copies")).alias("c"))
    chosen = written(chosen.select("c.doc_id", "c.row_key", "c.copies"), "chosen-documents")
    single = alone.union(chosen.filter("copies = 1").select("doc_id", "row_key"))
    repeated = chosen.filter("copies > 1").select("doc_id", "row_key")

    def of(keys: DataFrame) -> DataFrame:
        named = keys.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key"))
        return docs.join(named, same, "left_semi")

    copies = of(repeated).withColumn("_key", text_key(F.col("text")))
    return of(single).unionByName(first_per_group(copies, ["doc_id", "_key"], [F.col("_key")]).drop("_key"))
