"""Merkle manifest of a table: every row with the proof that leads from its leaf to the root of the dataset.

The leaves of a group (a language) are ordered and cut into aligned blocks of FANOUT ** LEVELS; a block is what one
task hashes. What lies above the blocks is exchanged like a butterfly: in each round the blocks whose numbers
differ in one digit (base FANOUT) swap the roots of the subtrees they know, and all of them hash the same
parent. So after each round every block knows one level more of its own path, with the siblings that the
proof needs, and nothing has to travel down again. The subroots of the groups are the leaves of a last tree.

A block whose partner would lie beyond the last block meets an empty stand-in: the slots are filled up to a
multiple of the last round's stride, which at most doubles them, and a stand-in without any subtree has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.windows import position_in_group
from corpuslens.llm.common import lower_ascii, one_row, written

FANOUT = 8
LEVELS = 4  # of a block, which has FANOUT ** LEVELS leaves
PROOF = "array<struct<before:string,after:string>>"


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of a text."""
    return F.sha2(parts, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda own, p: digest(F.concat(p["before"], own, p["after"])))


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _subtree(leaves: list[str], block: int, levels_of_block: int) -> list[list[str]]:
    """The levels of a block from its leaves to its root; the only block of a group stops at one node."""
    levels = [leaves]
    while len(levels) <= levels_of_block and (block > 0 or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([_hash("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return levels


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by("_pos")


def _block_roots(leaves: DataFrame, levels: int) -> DataFrame:
    """(grp, slot, root) of every block."""

    def build(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        slot = rows.column("slot")[0].as_py()
        root = _subtree(rows.column("leaf").to_pylist(), slot, levels)[-1][0]
        return pa.table({"grp": rows.column("grp").slice(0, 1), "slot": pa.array([slot], pa.int64()), "root": pa.array([root])})

    narrow = leaves.select("grp", "slot", "_pos", "leaf")
    return written(narrow.groupBy("grp", "slot").applyInArrow(build, "grp string, slot long, root string"), "merkle-blocks")


def _power(value: Column, top: int) -> Column:
    """The least number of rounds after which FANOUT ** rounds reaches a count."""
    found = F.lit(0)
    for k in range(top):
        found = found + F.when(value > FANOUT**k, 1).otherwise(0)
    return found


def _exchange(blocks: DataFrame) -> DataFrame:
    """(grp, slot, root, proof) of every block: the group's root and the siblings from the block up to it."""
    sizes = blocks.groupBy("grp").agg(F.count(F.lit(1)).alias("_blocks"))
    most = one_row(sizes.agg(F.max("_blocks").alias("n")))["n"] or 0
    rounds = 0
    while FANOUT**rounds < most:
        rounds += 1
    named = sizes.withColumnRenamed("grp", "_g").withColumn("_rounds", _power(F.col("_blocks"), rounds))
    stride = F.pow(F.lit(FANOUT), F.greatest(F.col("_rounds") - 1, F.lit(0))).cast("long")
    filled = named.withColumn("_slots", F.ceil(F.col("_blocks") / stride) * stride)
    real = blocks.join(filled, F.col("grp") == F.col("_g")).drop("_g")
    # fewer stand-ins than blocks, so each block brings at most one
    stand_in = F.when(F.col("slot") + F.col("_blocks") < F.col("_slots"), F.col("slot") + F.col("_blocks"))
    both = F.array(
        F.struct(F.col("slot").alias("slot"), F.col("root").alias("root")),
        F.struct(stand_in.alias("slot"), F.lit(None).cast("string").alias("root")),
    )
    slots = (
        real.withColumn("_s", F.explode(both))
        .filter(F.col("_s.slot").isNotNull())
        .select("grp", F.col("_s.slot").alias("slot"), F.col("_s.root").alias("root"), "_blocks", "_rounds")
        .withColumn("proof", F.array().cast(PROOF))
    )
    done = []
    for k in range(rounds):
        done.append(slots.filter(F.col("_rounds") <= k))
        slots = _swap(slots.filter(F.col("_rounds") > k), FANOUT**k)
    for part in done:
        slots = slots.unionByName(part)
    return slots.filter(F.col("slot") < F.col("_blocks")).select("grp", "slot", "root", "proof")


def _swap(slots: DataFrame, stride: int) -> DataFrame:
    """One round: the slots that differ in the digit of ``stride`` see each other's roots and hash their parent."""
    partners = Window.partitionBy("grp", F.expr(f"slot div {stride * FANOUT}"), F.col("slot") % stride)
    run = F.array_sort(F.collect_list(F.when(F.col("root").isNotNull(), F.struct("slot", "root"))).over(partners))

    def text(keep) -> Column:
        return F.array_join(F.transform(F.filter("_run", keep), lambda p: p["root"]), "")

    level = F.struct(text(lambda p: p["slot"] < F.col("slot")).alias("before"), text(lambda p: p["slot"] > F.col("slot")).alias("after"))
    parent = F.when(F.size("_run") > 0, digest(F.array_join(F.transform("_run", lambda p: p["root"]), "")))
    return (
        slots.withColumn("_run", run)
        .withColumn("proof", F.concat("proof", F.array(level)))
        .withColumn("root", parent)
        .drop("_run")
    )


def _prove(leaves: DataFrame, slots: DataFrame, tops: list[str], levels: int) -> DataFrame:
    """The leaves with ``tops`` of their block's row and ``proof``: inside the block, then the block's own."""
    payload = [c for c in leaves.columns if c not in ("grp", "slot", "_pos", "leaf")]
    kept = ["grp", *payload, "leaf"]
    types = dict(leaves.dtypes) | dict(slots.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in [*kept, *tops]], f"proof {PROOF}"])

    def build(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        n = len(rows)
        tree = _subtree(rows.column("leaf").to_pylist(), block.column("slot")[0].as_py(), levels)
        upper = block.column("proof")[0].as_py()
        before, after = [], []
        around = []  # for each level below the root, what stands before and after each node in its run
        for nodes in tree[:-1]:
            runs = [nodes[k : k + FANOUT] for k in range(0, len(nodes), FANOUT)]
            around.append([("".join(r[:i]), "".join(r[i + 1 :])) for r in runs for i in range(len(r))])
        for k in range(n):
            at = k
            for sides in around:
                before.append(sides[at][0])
                after.append(sides[at][1])
                at //= FANOUT
            before += [p["before"] for p in upper]
            after += [p["after"] for p in upper]
        steps = len(around) + len(upper)
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * steps), pairs)
        columns = {c: rows.column(c) for c in kept}
        columns |= {t: pa.array([block.column(t)[0].as_py()] * n, pa.string()) for t in tops}
        return pa.table(columns | {"proof": proof})

    return leaves.groupBy("grp", "slot").cogroup(slots.groupBy("grp", "slot")).applyInArrow(build, schema)


def _placed(leaves: DataFrame, order: list[Column], levels: int) -> DataFrame:
    """The leaves with their place in the group and the number of their block."""
    ranked = position_in_group(leaves, ["grp"], order, "_pos")
    return ranked.withColumn("slot", F.expr(f"(_pos - 1) div {FANOUT**levels}"))


def manifest(leaves: DataFrame, order: str, payload: list[str], levels: int = LEVELS) -> DataFrame:
    """``payload``, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row of ``leaves`` (grp, leaf, order, payload).

    Inside a group leaves ascend by ``order`` (null first), then by the leaf, so that repeated rows are leaves of
    their own; groups ascend bytewise, the null group first. While more than one node remains, every FANOUT
    consecutive ones become one; a lone leaf is its group's subroot and a lone subroot the root. ``proof``: for
    each level up to the root the digests of the run before and after the own one. An empty table has no rows. ``levels``: of a block,
    which changes the work and not the result.
    """
    own = list(dict.fromkeys([order, *payload]))
    named = F.when(F.col("grp").isNull(), "-").otherwise(F.concat(F.lit("="), "grp")).alias("grp")
    fixed = written(leaves.select(named, "leaf", *own), "merkle-leaves")
    placed = _placed(fixed, [F.col(order).asc(), F.col("leaf").asc()], levels)
    slots = written(_exchange(_block_roots(placed, levels)), "merkle-slots")
    groups = slots.filter("slot = 0").select(F.lit("").alias("grp"), F.col("grp").alias("_group"), F.col("root").alias("leaf"))
    over = _placed(groups, [F.encode("_group", "utf-8").asc()], levels)
    upper = _prove(over, _exchange(_block_roots(over, levels)), ["root"], levels)
    tops = upper.select("_group", F.col("leaf").alias("subroot"), F.col("root").alias("_root"), F.col("proof").alias("_upper"))
    known = slots.join(tops, F.col("grp") == F.col("_group")).select(
        "grp", "slot", "subroot", F.col("_root").alias("root"), F.concat("proof", "_upper").alias("proof")
    )
    return _prove(placed, known, ["subroot", "root"], levels).select(*payload, "leaf", "subroot", "root", "proof")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_leaves(docs: DataFrame) -> DataFrame:
    """grp (the language), doc_id, the leaf of each document and the leaf that it has after tampering.

    Tampering lower-cases A-Z of the text where 3 divides the CRC-32 of the decimal doc_id; elsewhere, and for a
    null doc_id, ``tampered`` is the leaf itself.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.col("lang").alias("grp"),
        "doc_id",
        leaf_of(fields).alias("leaf"),
        F.when(hit, leaf_of(changed)).otherwise(leaf_of(fields)).alias("tampered"),
    )


def verify_documents(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    proved = manifest(document_leaves(docs), "doc_id", ["doc_id", "tampered"], levels)
    folded = proved.withColumn("folded_root", fold(F.col("tampered"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
