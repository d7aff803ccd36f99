"""A graph of the nearest neighbours of every vector, grown by asking the neighbours of neighbours.

Each round looks at a vector's list of neighbours from the other side: whatever meets in one list is compared, and
better neighbours replace worse ones, until few lists change. Work grows with the rows times the square of the
list length, never with rows times rows. Equal vectors are one node; ``members`` says which rows a node stands for.

Lists start with rows that are close by a random projection and with random ones, so copies, clusters and lone
vectors all find a way in. The result is approximate: its recall is tested against all pairs.

Nodes are dealt by their number to parts of a bounded size. What a part sends to another in a step is one row of
packed arrays, and a vector goes to a part once however many of its lists name it, so a round costs rows in the
square of the parts and Python calls in the parts, not in the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.windows import top_per_group  # noqa: F401 - for lists that callers cut themselves
from corpuslens.operators.nearest import common_length, unit_rows, usable
from corpuslens.operators.search import SCORE_DIGITS
from corpuslens.session import cut_lineage

LIST = 24  # neighbours kept while the graph grows
START = 8  # neighbours on either side in each of the start orders
ORDERS = 3  # start orders by a projection
OFFERS = 8  # new neighbours that one list offers to one of its members in a round
MOST_ROUNDS = 12
FEW_CHANGES = 0.01  # of all list entries: then the graph is done
JOIN_BYTES = 4 << 20  # of vectors in one list: longer vectors make shorter lists
PART_BYTES = 64 << 20  # of vectors that the lists of a part name, if none is named twice
LEAST_NODES = 64  # of a part, on average
PARTS_A_CORE = 2  # at least, where there are nodes enough
COMPARED_AT_ONCE = 1 << 18  # scores of lists that are compared together
PACKED_AT_ONCE = 32 << 20  # bytes of rows

EDGE = "node long, other long, score double"
DIGITS = SCORE_DIGITS
UNIT = 10**DIGITS  # scores are held in parts, as whole numbers
NOWHERE = -2 * UNIT  # below every score

# Rows of a part; all but ``part`` and counts are packed arrays, whose types TYPES names.
STATE = "part int, n long, new long, node binary, unit binary, size binary, other binary, score binary, fresh binary"
NAMED = "part int, node binary, other binary, fresh binary"
MEMBERS = "part int, node binary, unit binary, last binary, asker binary, at binary, fresh binary"
OFFERED = "part int, node binary, other binary, score binary"
TYPES = {
    "node": np.int64, "other": np.int64, "asker": np.int64, "at": np.int64, "size": np.int64, "score": np.int64,
    "last": np.int64, "fresh": np.bool_, "unit": np.float32,
}


def nodes_of(vectors: DataFrame, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (node, unit) and the membership (repo, chunk_id, file_path, node).

    A node's number is a hash of its vector's values. Vectors of another length than the common one, null ones and
    ones with null or non-finite entries take no part; zeros have no direction and take none either.
    """
    dims = dims or common_length(vectors)
    some = F.exists("embedding", lambda x: x != 0)
    held = vectors.filter(usable(dims) & some).withColumn("node", F.xxhash64(F.col("embedding").cast("array<float>")))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"node": pdf["node"], "unit": list(unit_rows(pdf["embedding"]))})

    each = held.select("node", "embedding").groupBy("node").agg(F.first("embedding").alias("embedding"))
    return each.mapInPandas(scale, "node long, unit array<float>"), held.select("repo", "chunk_id", "file_path", "node")


def by_score(other: str = "other") -> list[Column]:
    return [F.col("score").desc(), F.col(other)]


def dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.round(F.aggregate(products, F.lit(0.0), lambda s, v: s + v), DIGITS)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def start_lists(nodes: DataFrame, dims: int, seed: int) -> DataFrame:
    """Neighbours in orders along random directions and in one random order: (node, other, score), some of them twice."""
    lines = np.random.default_rng(seed).normal(size=(ORDERS, dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = matrix(batch.column("unit"), dims).astype(np.float64) @ lines.T
            bounds = pa.array(np.arange(0, along.size + 1, ORDERS), pa.int32())
            yield batch.append_column("along", pa.ListArray.from_arrays(bounds, pa.array(along.ravel())))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = np.zeros(0, np.int64), np.zeros((0, dims))
        for batch in batches:
            fresh = len(ids)
            ids = np.concatenate([ids, batch.column("node").to_numpy()])
            units = np.concatenate([units, matrix(batch.column("unit"), dims)])
            for step in range(1, START + 1):
                lo = max(0, fresh - step)
                hi = max(lo, len(ids) - step)
                a, b = ids[lo:hi], ids[lo + step :]
                score = np.round(np.einsum("ij,ij->i", units[lo:hi], units[lo + step :]), DIGITS)
                yield pa.RecordBatch.from_pydict({"node": np.append(a, b), "other": np.append(b, a), "score": np.append(score, score)})
            ids, units = ids[-START:], units[-START:]

    placed = cut_lineage(nodes.select("node", "unit").mapInArrow(place, "node long, unit array<float>, along array<double>"))
    parts = []
    for turn in range(ORDERS + 1):
        order = F.col("along")[turn] if turn < ORDERS else F.xxhash64("node", F.lit(seed)).cast("double")
        # rows are cut into ranges of the order; lists do not reach over a cut
        ranged = placed.select("node", "unit", order.alias("_place")).repartitionByRange("_place").sortWithinPartitions("_place", "node")
        parts.append(ranged.select("node", "unit").mapInArrow(walk, EDGE))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def spark_hash(columns: list[np.ndarray], turn: int) -> np.ndarray:
    """What ``F.xxhash64(*columns, F.lit(turn))`` gives for long columns."""
    p1, p2, p3, p4, p5 = (
        np.uint64(p)
        for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    h = np.full(len(columns[0]), 42, np.uint64)
    for column in columns:
        h = h + p5 + np.uint64(8)
        h = h ^ (turned(column.view(np.uint64) * p2, 31) * p1)
        h = mixed(turned(h, 27) * p1 + p4)
    h = h + p5 + np.uint64(4)
    h = h ^ (np.full(len(h), turn, np.uint64) * p1)
    return mixed(turned(h, 23) * p2 + p3).view(np.int64)


def packed(bounds: np.ndarray, column: np.ndarray) -> pa.Array:
    """Rows between ``bounds`` as one binary value each."""
    wide = column.itemsize * int(np.prod(column.shape[1:], dtype=np.int64))
    held = pa.py_buffer(np.ascontiguousarray(column).reshape(-1).view(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * wide).astype(np.int32)), held])


def table_of(part: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """A row for each part; a column is its rows in the order of the parts and the bounds of the parts in them."""
    return pa.table({"part": pa.array(part, pa.int32()), **{name: packed(*c) for name, c in columns.items()}})


def starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    n = len(sorted_by[0])
    differs = np.ones(n, bool)
    differs[1:] = np.any([c[1:] != c[:-1] for c in sorted_by], axis=0) if n else False
    return np.flatnonzero(differs)


def dealt(to: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Rows by the part they go to."""
    order = np.argsort(to, kind="stable")
    first = starts(to[order])
    bounds = np.append(first, len(to))
    return table_of(to[order][first], {name: (bounds, c[order]) for name, c in columns.items()})


def unpacked(held: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A packed column over all rows, and how many values each row has."""
    kind, parts, sizes = TYPES[name], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    column = held.column(name)
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            _, bounds, values = chunk.cast(pa.binary()).buffers()
            bounds = np.frombuffer(bounds, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
            if values is not None:
                parts.append(np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]])
            sizes.append(np.diff(bounds) // np.dtype(kind).itemsize)
    return np.concatenate(parts).view(kind), np.concatenate(sizes)


def values(held: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [unpacked(held, name)[0] for name in names]


def part_of(node: np.ndarray, parts: int) -> np.ndarray:
    """Nodes are hashes, so parts are even."""
    return (node.view(np.uint64) % np.uint64(parts)).astype(np.int32)


def places(first: np.ndarray, n: int) -> np.ndarray:
    """The place of every one of ``n`` rows in its run, if runs begin at ``first``."""
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def best_of(node: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` distinct others of each node in the order of ``by_score``; what comes twice is fresh if all of it is."""
    # by node, from high to low scores, by other
    order = np.argsort(other)
    order = order[np.argsort(((node << 22) | (2 * UNIT - score))[order], kind="stable")]
    columns = [c[order] for c in (node, other, score, fresh)]
    first = starts(*columns[:3])
    if len(first):
        columns = [*[c[first] for c in columns[:3]], np.logical_and.reduceat(columns[3], first)]
    kept = places(starts(columns[0]), len(first)) < 2 * length
    node, other, score, fresh = [c[kept] for c in columns]
    marks = np.sort(other.view(np.uint64) ^ (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    if np.any(marks[1:] == marks[:-1]):  # two lists may round the score of a pair differently
        order = np.lexsort((-score, other, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
        first = starts(node, other)
        fresh = np.logical_and.reduceat(fresh, first)
        node, other, score = node[first], other[first], score[first]
        order = np.lexsort((other, -score, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
    kept = places(starts(node), len(node)) < length
    return [node[kept], other[kept], score[kept], fresh[kept]]


def batches_of(held: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from held.to_batches(max_chunksize=64)


class Parts:
    """The steps of a round over nodes of ``dims`` dimensions that are dealt to ``n`` parts, with lists of ``length``.

    What beats a node's last neighbour is sent on; of more than a list could take, its best.
    """

    def __init__(self, n: int, dims: int, length: int):
        self.n, self.dims, self.length = n, dims, length

    def by_part(self, rows: DataFrame) -> DataFrame:
        """Each part a task: by their bytes alone, few parts would be put into one."""
        return rows.repartitionById(self.n, "part")

    def rows_dealt(self, rows: DataFrame, columns: list[str], schema: str) -> DataFrame:
        n, dims = self.n, self.dims

        def column(batch: pa.Table, name: str) -> np.ndarray:
            held = batch.column(name).combine_chunks()
            if name == "unit":
                return matrix(held, dims)
            if name == "score":
                return np.rint(held.to_numpy() * UNIT).astype(np.int64)
            return held.to_numpy(zero_copy_only=False)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def sent() -> Iterator[pa.RecordBatch]:
                rows = pa.Table.from_batches(held)
                yield from batches_of(dealt(part_of(column(rows, "node"), n), **{c: column(rows, c) for c in columns}))

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size >= PACKED_AT_ONCE:
                    yield from sent()
                    held, size = [], 0
            if held:
                yield from sent()

        return rows.select(*columns).mapInArrow(deal, schema)

    def listed(self, node: np.ndarray, unit: np.ndarray, at: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray) -> pa.Table:
        """The row of a part; ``at`` is the place of a list's node among the part's nodes."""
        if not len(node):
            return schema_of(STATE).empty_table()
        one = {
            "node": node, "unit": unit, "size": np.bincount(at, minlength=len(node)), "other": other, "score": score, "fresh": fresh,
        }
        row = table_of(part_of(node[:1], self.n), {name: (np.array([0, len(c)]), c) for name, c in one.items()})
        counts = {"n": pa.array([len(other)]), "new": pa.array([int(fresh.sum())])}
        return pa.table({c: counts[c] if c in counts else row[c] for c in schema_of(STATE).names})

    def held(self, nodes: DataFrame, lists: DataFrame) -> DataFrame:
        """STATE of nodes (node, unit) and lists (node, other, score, fresh): a row for each part."""
        length, dims = self.length, self.dims

        def together(nodes: pa.Table, lists: pa.Table) -> pa.Table:
            node, unit = values(nodes, "node", "unit")
            order = np.argsort(node)
            node, unit = node[order], unit.reshape(-1, dims)[order]
            own, other, score, fresh = values(lists, "node", "other", "score", "fresh")
            return self.listed(node, unit, *best_of(np.searchsorted(node, own), other, score, fresh, length))

        left = self.by_part(self.rows_dealt(nodes, ["node", "unit"], "part int, node binary, unit binary"))
        right = self.by_part(self.rows_dealt(lists, ["node", "other", "score", "fresh"], OFFERED + ", fresh binary"))
        return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(lambda a, b: together(a, b), STATE)

    def offers(self, state: DataFrame, turn: int) -> DataFrame:
        """Compare what meets in a list; OFFERED holds the pairs that beat the node's last neighbour.

        A list is a node's neighbours and as many of the nodes that name it, taken by a hash that changes with the
        round, since a node may be named by very many. Only pairs with a new edge are compared, and a list offers its
        best ``OFFERS`` to each member, so what is sent on is bounded by rows times list length times that.
        """
        n, dims, length = self.n, self.dims, self.length

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    node, size, other, fresh = values(batch.slice(i, 1), "node", "size", "other", "fresh")
                    yield from batches_of(dealt(part_of(other, n), node=other, other=np.repeat(node, size), fresh=fresh))

        def draw(named: pa.Table) -> pa.Table:
            """Who is asked for by whom: every named node by those who name it, and some of those by it."""
            node, other, fresh = values(named, "node", "other", "fresh")
            order = np.lexsort((other, spark_hash([node, other], turn), ~fresh, node))
            drawn = order[places(starts(node[order]), len(node)) < length]
            member, asker = np.concatenate([node, other[drawn]]), np.concatenate([other, node[drawn]])
            return dealt(part_of(member, n), node=member, other=asker, fresh=np.concatenate([fresh, fresh[drawn]]))

        def send(asked: pa.Table, state: pa.Table) -> pa.Table:
            """Members go to the parts of those who ask for them, once each."""
            member, asker, fresh = values(asked, "node", "other", "fresh")
            node, unit, size, score = values(state, "node", "unit", "size", "score")
            last = np.full(len(node), NOWHERE)
            full = size >= length
            if full.any():
                last[full] = score[np.cumsum(size)[full] - 1]
            at, to = np.searchsorted(node, member), part_of(asker, n)
            order = np.lexsort((~fresh, asker, at, to))
            order = order[starts(at[order], asker[order])]
            at, to, asker, fresh = at[order], to[order], asker[order], fresh[order]
            parts, one = starts(to), starts(to, at)
            place = np.repeat(np.arange(len(one)), np.diff(np.append(one, len(at))))
            before = place[parts]
            pairs, members = np.append(parts, len(at)), np.append(before, len(one))
            taken = at[one]
            return table_of(to[parts], {
                "node": (members, node[taken]), "unit": (members, unit.reshape(-1, dims)[taken]), "last": (members, last[taken]),
                "asker": (pairs, asker), "at": (pairs, place - np.repeat(before, np.diff(pairs))), "fresh": (pairs, fresh),
            })

        def compare(met: pa.Table) -> pa.Table:
            node, members = unpacked(met, "node")
            unit, last = values(met, "unit", "last")
            unit = unit.reshape(-1, dims)
            asker, pairs = unpacked(met, "asker")
            at, fresh = values(met, "at", "fresh")
            at = at + np.repeat(np.cumsum(members) - members, pairs)
            order = np.lexsort((node[at], asker))
            at, fresh, first = at[order], fresh[order], starts(asker[order])
            size = np.diff(np.append(first, len(at)))
            some = np.flatnonzero(np.logical_or.reduceat(fresh, first)) if len(first) else first
            some = some[np.argsort(-size[some], kind="stable")]  # wide lists first, as the first of a batch sets its width
            found, done = [], 0
            while done < len(some):
                step = max(1, COMPARED_AT_ONCE // int(size[some[done]]) ** 2)
                lists = some[done : done + step]
                done += len(lists)
                found.append(self.met(first[lists], size[lists], at, fresh, node, unit, last))
            a, b, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            often = np.bincount(a, minlength=len(node))[a] > 2 * length
            if often.any():  # more offers than the node's list could take
                most = best_of(a[often], b[often], score[often], np.ones(int(often.sum()), bool), length)
                a, b, score = (np.concatenate([c[~often], m]) for c, m in zip((a, b, score), most[:3], strict=True))
            return dealt(part_of(node[a], n), node=node[a], other=node[b], score=score)

        named = self.by_part(state.mapInArrow(name, NAMED)).groupBy("part").applyInArrow(lambda t: draw(t), NAMED)
        asked, known = self.by_part(named), self.by_part(state)
        met = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(lambda a, b: send(a, b), MEMBERS)
        return self.by_part(met).groupBy("part").applyInArrow(lambda t: compare(t), OFFERED)

    def met(
        self, first: np.ndarray, size: np.ndarray, at: np.ndarray, fresh: np.ndarray, node: np.ndarray, unit: np.ndarray, last: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What some lists offer: (for whom, whom, score); their members are ``at[first : first + size]``, by node."""
        wide = int(size.max())
        column = np.arange(wide)
        there = column < size[:, None]
        place = np.where(there, first[:, None] + column, 0)
        member, new = at[place], fresh[place]
        units = unit[member].astype(np.float64)
        score = np.rint(np.matmul(units, units.transpose(0, 2, 1)) * UNIT)
        wanted = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (score > last[member][:, :, None])
        wanted[:, column, column] = False
        if wide > OFFERS:  # a member is offered the best of the list; ties to the lower node
            rank = np.where(wanted, score * wide - column, -np.inf)
            wanted &= rank >= np.partition(rank, wide - OFFERS, axis=2)[:, :, wide - OFFERS, None]
        i, a, b = np.nonzero(wanted)
        return member[i, a], member[i, b], score[i, a, b].astype(np.int64)

    def merged(self, state: DataFrame, offers: DataFrame) -> DataFrame:
        """Better neighbours replace worse ones."""
        dims, length = self.dims, self.length

        def merge(state: pa.Table, offers: pa.Table) -> pa.Table:
            node, unit, size, other, score, fresh = values(state, "node", "unit", "size", "other", "score", "fresh")
            own, offered, better = values(offers, "node", "other", "score")
            lists = best_of(
                np.concatenate([np.repeat(np.arange(len(node)), size), np.searchsorted(node, own)]), np.concatenate([other, offered]),
                np.concatenate([score, better]), np.arange(len(other) + len(offered)) >= len(other), length,
            )
            return self.listed(node, unit.reshape(-1, dims), *lists)

        left, right = self.by_part(state).groupBy("part"), self.by_part(offers).groupBy("part")
        return left.cogroup(right).applyInArrow(lambda a, b: merge(a, b), STATE)


def schema_of(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def rows_of(offers: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, other, score = values(batch.slice(i, 1), "node", "other", "score")
                yield pa.RecordBatch.from_pydict({"node": node, "other": other, "score": score / UNIT})

    return offers.mapInArrow(rows, EDGE)


def parts_for(nodes: DataFrame, total: int, dims: int, length: int) -> Parts:
    """As many parts as bound the vectors that one holds, and some for every core."""
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    bounded = -(-total * 2 * length * 4 * max(1, dims) // PART_BYTES)
    return Parts(max(1, bounded, min(PARTS_A_CORE * cores, total // LEAST_NODES)), dims, length)


def grow(lists: DataFrame, nodes: DataFrame, length: int, turn: int) -> DataFrame:
    """What a round finds for lists (node, other, score, fresh) of nodes (node, unit): (node, other, score)."""
    total, dims = nodes.agg(F.count(F.lit(1)), F.max(F.size("unit"))).first()
    parts = parts_for(nodes, total, dims or 0, length)
    return rows_of(parts.offers(parts.held(nodes, lists), turn))


def neighbour_graph(
    vectors: DataFrame, k: int = 10, length: int = LIST, dims: int | None = None, seed: int = 11, most_rounds: int = MOST_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """The graph (node, other, score, rank), about the ``k`` nearest by cosine, and the membership of its nodes.

    Ties go to the lower node. Rounds end when at most ``FEW_CHANGES`` of the entries are new. Every round is
    written to the checkpoint folder, so a lost executor costs a part of one round.
    """
    dims = dims or common_length(vectors)
    nodes, members = nodes_of(vectors, dims)
    nodes = cut_lineage(nodes)
    length = max(k, min(length, JOIN_BYTES // max(1, 8 * 2 * dims)))
    if dims == 0:
        empty = nodes.sparkSession.createDataFrame([], EDGE)
        return empty.withColumn("rank", F.lit(0)), members
    parts = parts_for(nodes, nodes.count(), dims, length)
    state = cut_lineage(parts.held(nodes, start_lists(nodes, dims, seed).withColumn("fresh", F.lit(True))))
    for turn in range(most_rounds):
        state = cut_lineage(parts.merged(state, parts.offers(state, turn)))
        size = state.agg(F.sum("n").alias("n"), F.sum("new").alias("new")).first()
        nodes.sparkSession.sparkContext._jvm.System.gc()  # the round's shuffle files go with the plans that name them
        if (size["new"] or 0) <= FEW_CHANGES * (size["n"] or 0):
            break

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, size, other, score = values(batch.slice(i, 1), "node", "size", "other", "score")
                rank = places(np.cumsum(size) - size, len(other)) + 1
                kept = rank <= k
                yield pa.RecordBatch.from_pydict({
                    "node": np.repeat(node, size)[kept], "other": other[kept], "score": score[kept] / UNIT, "rank": rank[kept].astype(np.int32),
                })

    return state.mapInArrow(ranked, EDGE + ", rank int"), members


def similar_code(vectors: DataFrame, k: int = 3) -> DataFrame:
    """About the ``k`` most similar other texts of every chunk: repo, chunk_id, rank, score, and one chunk that has the text.

    Chunks with equal vectors are one text; ``n_equal`` counts them, the asking one included. A text is named by its
    chunk of the lowest id, then repository.
    """
    graph, members = neighbour_graph(vectors, k)
    name = F.min(F.struct("chunk_id", F.coalesce("repo", F.lit("")).alias("_by"), "repo", "file_path")).alias("name")
    texts = members.groupBy("node").agg(name, F.count(F.lit(1)).alias("n_equal"))
    named = texts.select(
        F.col("node").alias("other"), F.col("name.repo").alias("similar_repo"), F.col("name.chunk_id").alias("similar_id"),
        F.col("name.file_path").alias("similar_path"),
    )
    found = graph.join(named, "other").join(texts.select("node", "n_equal"), "node")
    return members.join(found, "node").select(
        "repo", "chunk_id", "file_path", "n_equal", "rank", "score", "similar_repo", "similar_id", "similar_path"
    )
