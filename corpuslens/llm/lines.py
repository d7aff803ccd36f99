"""Line deduplication that returns compressed keep bitmaps.

Long lines become 128-bit keys of their normalised text. (key, document, position) rows are range-partitioned
and sorted by key, document (largest first) and position, so a stream over a partition meets every key's
documents one after the other and keeps the first. The document is part of the range, so a line that a third
of all documents share is spread over many partitions. Inside a partition only the first and the last key can
go on elsewhere: for these two the stream returns its counts, and the few rows that depend on them are settled
by a join with the sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import SPACES, lower_ascii, text_key, whole_text, written

MIN_LINE_CHARS = 40
MIN_DOCS = 5
STREAM_SCHEMA = "kind string, h long, g long, doc_id long, row_key long, pos int, n_docs long"


def line_key(line: Column) -> Column:
    """What makes two lines equal: stripped of white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def long_lines(docs: DataFrame, min_chars: int = MIN_LINE_CHARS) -> DataFrame:
    """(h, g, doc_id, row_key, pos) of every line whose key has ``min_chars`` characters or more.

    The length is tested on the line first, so that the key is built for long lines only.
    """
    lines = F.split(whole_text(F.col("text")), "\n")
    long = docs.select(
        "doc_id", text_key(F.col("text")).alias("row_key"), F.posexplode(lines).alias("pos", "line")
    ).filter(F.length("line") >= min_chars)
    keyed = long.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    return keyed.select(
        F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"), "doc_id", "row_key", "pos"
    )


class RunStream:
    """Walks sorted rows batch by batch; holds the rows of at most ``min_docs - 1`` documents of the open key."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key = None  # of the open run
        self.first_run = True
        self.n_docs = 0
        self.last_doc = None
        self.top_doc = None
        self.held: list[np.ndarray] = []

    def batch(self, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """``rows``: a structured array with h, g, doc, null (no id), row_key, pos in sorted order."""
        change = np.ones(len(rows), bool)
        change[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(rows))
        doc_change = change.copy()
        doc_change[1:] |= (rows["doc"][1:] != rows["doc"][:-1]) | (rows["null"][1:] != rows["null"][:-1])
        doc_counts = np.add.reduceat(doc_change.astype(np.int64), starts)
        last = len(starts) - 1
        run = rows[: ends[0]]
        if self.key == self._key_of(run):
            yield from self._extend(run, int(doc_counts[0]) - self._same_doc(run[0]))
        else:
            if self.key is not None:
                yield from self._close()
            self._open(self._key_of(run))
            yield from self._extend(run, int(doc_counts[0]))
        if last == 0:
            return
        yield from self._close()
        inner = slice(starts[1], starts[last])  # runs that begin and end in this batch
        run_of = (np.cumsum(change) - 1)[inner]
        common = doc_counts[run_of] >= self.min_docs
        top, own = rows[starts[run_of]], rows[inner]
        yield "drop", own[common & ((own["doc"] != top["doc"]) | (own["null"] != top["null"]))]
        run = rows[starts[last] :]
        self._open(self._key_of(run))
        yield from self._extend(run, int(doc_counts[last]))

    @staticmethod
    def _key_of(run: np.ndarray) -> tuple[int, int]:
        return int(run["h"][0]), int(run["g"][0])

    def _same_doc(self, row) -> bool:
        return self.last_doc == (int(row["doc"]), int(row["null"]))

    def _open(self, key: tuple[int, int]) -> None:
        self.key, self.n_docs, self.last_doc, self.top_doc, self.held = key, 0, None, None, []

    def _extend(self, run: np.ndarray, new_docs: int) -> Iterator[tuple[str, np.ndarray]]:
        if self.top_doc is None:
            self.top_doc = (int(run["doc"][0]), int(run["null"][0]))
        self.n_docs += new_docs
        self.last_doc = (int(run["doc"][-1]), int(run["null"][-1]))
        if self.first_run:  # may have begun in an earlier partition: a later join decides
            yield "open", run
            return
        self.held.append(run)
        if self.n_docs >= self.min_docs:
            yield from self._drop_held()

    def _drop_held(self) -> Iterator[tuple[str, np.ndarray]]:
        for run in self.held:
            yield "drop", run[(run["doc"] != self.top_doc[0]) | (run["null"] != self.top_doc[1])]
        self.held = []

    def _summary(self) -> tuple[str, tuple]:
        return "sum", (*self.key, self.top_doc, self.n_docs)

    def _close(self) -> Iterator[tuple]:
        """The open run ends inside the partition."""
        if self.first_run:
            yield self._summary()
        self.held, self.key, self.first_run = [], None, False

    def end(self) -> Iterator[tuple]:
        """The partition ends; the open run may go on in the next."""
        if self.key is not None:
            yield self._summary()
            for run in self.held:
                yield "open", run
            self.held, self.key = [], None


ROW = np.dtype([("h", "i8"), ("g", "i8"), ("doc", "i8"), ("null", "i8"), ("row_key", "i8"), ("pos", "i4")])


def _as_rows(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.empty(batch.num_rows, ROW)
    for name in ("h", "g", "row_key", "pos"):
        rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
    doc = batch.column("doc_id")
    rows["null"] = doc.is_null().to_numpy(zero_copy_only=False)
    rows["doc"] = doc.fill_null(0).to_numpy(zero_copy_only=False)
    return rows


def _as_batch(kind: str, found) -> pa.RecordBatch:
    if kind == "sum":
        h, g, (doc, null), n = found
        columns = [[kind], [h], [g], [None if null else doc], [None], [None], [n]]
        columns = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
    else:
        doc = pa.array(found["doc"], mask=found["null"].astype(bool))
        columns = [
            pa.array([kind] * len(found)), pa.array(found["h"]), pa.array(found["g"]), doc,
            pa.array(found["row_key"]), pa.array(found["pos"]), pa.nulls(len(found), pa.int64()),
        ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


_NAMES = ["kind", "h", "g", "doc_id", "row_key", "pos", "n_docs"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def stream_runs(sorted_lines: DataFrame, min_docs: int) -> DataFrame:
    """Rows of kind drop (settled), open (depend on other partitions) and sum (documents of a key at an edge)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = RunStream(min_docs)
        for batch in batches:
            if batch.num_rows:
                for kind, found in stream.batch(_as_rows(batch)):
                    if kind == "sum" or len(found):
                        yield _as_batch(kind, found)
        for kind, found in stream.end():
            yield _as_batch(kind, found)

    return sorted_lines.mapInArrow(walk, STREAM_SCHEMA)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_LINE_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_key, pos) of every line that goes."""
    order = [F.col("h"), F.col("g"), F.col("doc_id").desc_nulls_last()]
    lines = written(long_lines(docs, min_chars), "long-lines")  # else the sampling of ranges reads the texts again
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row_key", "pos")
    found = written(stream_runs(dealt, min_docs), "line-runs")
    sums = (
        found.filter("kind = 'sum'")
        .groupBy("h", "g")
        .agg(F.sum("n_docs").alias("n_docs"), F.max("doc_id").alias("top_doc"))
        .filter(F.col("n_docs") >= min_docs)
    )
    settled = found.filter("kind = 'drop'").select("doc_id", "row_key", "pos")
    opened = (
        found.filter("kind = 'open'")
        .drop("n_docs")
        .join(F.broadcast(sums), ["h", "g"])  # at most two rows a partition of the stream
        .filter(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
    )
    return settled.unionByName(opened.select("doc_id", "row_key", "pos"))


def pack_bitmap(n_lines: int, dropped) -> bytes:
    """One bit a line, 1 for keep, compressed; lines beyond the bitmap are kept."""
    bits = np.ones(-(-n_lines // 8) * 8, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)
    return np.append(bits, np.ones(n_lines - len(bits), bool))


@F.pandas_udf(T.BinaryType())
def keep_bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([pack_bitmap(n, d) for n, d in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines whose bit is set; null where there is no bitmap."""

    def one(t, b):
        if b is None or t is None:
            return None
        lines = t.split("\n")
        return "\n".join([x for x, k in zip(lines, unpack_bitmap(b, len(lines)), strict=True) if k])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_LINE_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, bitmap) of the documents that lose lines; others keep all theirs.

    Keys of at least ``min_chars`` characters found in at least ``min_docs`` documents stay only in the
    largest doc_id that holds them, there on every line. ``row_key`` is the key of the text: rows with one
    id but different texts have bitmaps of their own and count as one document; equal rows share one. A
    null id is a document smaller than all others. A null or empty text is one empty line.
    """
    lost = dropped_lines(docs, min_chars, min_docs)
    per_row = lost.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("dropped"))
    # the highest lost position bounds the bitmap; lines beyond it stay, so no line count has to be carried
    size = F.array_max("dropped") + 1
    return per_row.select(
        "doc_id",
        "row_key",
        F.size("dropped").cast("long").alias("n_dropped"),
        size.alias("n_bits"),
        keep_bitmap(size, F.col("dropped")).alias("bitmap"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with n_lines (before), n_dropped and the kept lines as text.

    Texts move once, by id and text key. Only texts that lose lines go through Python.
    """
    named = bitmaps.select(
        F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("n_dropped").alias("_lost"), F.col("bitmap").alias("_bitmap")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key"))
    joined = docs.drop("n_lines", "n_dropped").join(named, same, "left")
    changed = F.when(F.col("_bitmap").isNotNull(), F.col("text"))
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.withColumn("_kept", kept_text(changed, F.col("_bitmap"))).select(
        *columns,
        F.size(F.split(whole_text(F.col("text")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("_lost", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_bitmap").isNull(), F.col("text")).otherwise(F.col("_kept")).alias("text"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines, with the columns they came with."""
    others = [c for c in docs.columns if c != "text"]
    hidden = docs.select(*[F.col(c).alias(f"in_{c}") for c in others], "doc_id", "text")
    done = apply_bitmaps(hidden, keep_bitmaps(docs))
    return done.select(*[F.col(c if c == "text" else f"in_{c}").alias(c) for c in docs.columns])
