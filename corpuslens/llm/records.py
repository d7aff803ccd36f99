"""Token ids in length-delimited binary record files with an offset index.

A record is framed as

    length (8 bytes) | masked CRC-32C of the length (4) | payload | masked CRC-32C of the payload (4)

all little-endian, as TFRecord readers expect. The payload is one flag word (1: the id is null), the doc_id
and the ids as unsigned integers of 2 bytes, or 4 if the vocabulary needs them; the manifest names the width. Beside each shard file stands its index, one fixed-size entry a
record (byte offset, length, flag, doc_id, ids before it in the shard, number of ids), so records can be read
in any order.

A task writes its shard under a name of its own and moves it into place, so a repeated task leaves one whole
file. The folder lies in the shared folder of the cluster.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.checksums import crc32c, masked
from corpuslens.llm.common import new_folder, text_key, written
from corpuslens.llm.tokens import byte_letters

CACHE_CHUNKS = 500_000  # of one worker, twice at most
HEAD = 16  # bytes of a payload before the ids
FRAME = 16  # bytes of a frame around a payload
INDEX_ENTRY = np.dtype(
    [("offset", "<i8"), ("length", "<i8"), ("flag", "<i8"), ("doc_id", "<i8"), ("start", "<i8"), ("n_ids", "<i8")]
)
MANIFEST = "shard int, data string, entries string, n_records long, n_ids long, n_bytes long, width int"
LAST_LATIN = "\u024f"
MARKS = string.punctuation.replace("'", "")  # after a word they are one piece


class ChunkEncoder:
    """Ids of texts by a vocabulary that drops white space, so that the chunks between spaces stand alone.

    A chunk is encoded by the tokenizer library once and kept in a bounded cache. For a Latin word with
    ASCII marks after it, the library's normalizing and splitting is known (one lower-case word, one run of
    punctuation), so its model encodes the two pieces directly; any other chunk takes the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_pieces: dict[str, bytes] = {"": b""}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.young_pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
                found = np.array([t.id for t in self.model.tokenize(letters)], self.kind).tobytes()
            if len(self.young_pieces) >= CACHE_CHUNKS:
                self.old_pieces, self.young_pieces = self.young_pieces, {"": b""}
            self.young_pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
            word = low.rstrip(MARKS)
            if not word or (word.isalpha() and max(word) <= LAST_LATIN):
                found = self._piece(word) + self._piece(low[len(word) :])
            else:
                found = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()
        if len(self.young) >= CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        self.young[chunk] = found
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            chunks = text.replace("\n", " ").split(" ")
            found = list(map(self.young.get, chunks))
            if None in found:
                found = [self.young.get(c) or self._chunk(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
            out.append(b"".join(found))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The framed records, and the size of each with its frame."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    heads = lengths.astype("<u8")
    head_sums = masked(crc32c(heads.view(np.uint8), np.full(len(heads), 8))).astype("<u4")
    sums = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), lengths)).astype("<u4")
    parts = []
    for k, payload in enumerate(payloads):
        parts += [heads[k].tobytes(), head_sums[k].tobytes(), payload, sums[k].tobytes()]
    return b"".join(parts), lengths + FRAME


def unframe(block: bytes, offsets: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Payloads of the records at ``offsets`` of a block; a wrong length or checksum is an error."""
    payloads = [block[o + 12 : o + n - 4] for o, n in zip(offsets, lengths, strict=True)]
    own, expected = frame(payloads)
    if not np.array_equal(expected, lengths) or own != b"".join([block[o : o + n] for o, n in zip(offsets, lengths, strict=True)]):
        raise ValueError("a record does not match its length or checksums")
    return payloads


def _batches(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of records of about ``most`` bytes."""
    start = 0
    while start < len(sizes):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, "right")))
        yield slice(start, end)
        start = end


READ_BYTES = 8 << 20


def write_records(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Writes all documents in ascending doc_id order (null last, then by text key); returns the manifest.

    One shard a task, in the order of the ids. A null or empty text has the end id only.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        last, width = np.array([end_id], own.kind).tobytes(), np.dtype(own.kind).itemsize
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}"
        mine = f"{name}.{task.taskAttemptId()}"
        offset = start = 0
        index = []
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{mine}.rec.tmp") as out:
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
                for part in _batches(sizes, READ_BYTES):
                    ids = [found + last for found in own.ids([t or "" for t in texts[part]])]
                    heads = [np.array([d is None, d or 0], "<i8").tobytes() for d in doc_ids[part]]
                    block, lengths = frame([h + i for h, i in zip(heads, ids, strict=True)])
                    out.write(block)
                    entries = np.zeros(len(ids), INDEX_ENTRY)
                    entries["length"], entries["n_ids"] = lengths, [len(i) // width for i in ids]
                    entries["offset"] = offset + np.cumsum(lengths) - lengths
                    entries["start"] = start + np.cumsum(entries["n_ids"]) - entries["n_ids"]
                    entries["flag"], entries["doc_id"] = [d is None for d in doc_ids[part]], [d or 0 for d in doc_ids[part]]
                    index.append(entries)
                    offset, start = offset + len(block), start + int(entries["n_ids"].sum())
        entries = np.concatenate([*index, np.zeros(0, INDEX_ENTRY)])
        with fs.open_output_stream(f"{mine}.idx.tmp") as out:
            out.write(entries.tobytes())
        for ending in ("rec", "idx"):
            fs.move(f"{mine}.{ending}.tmp", f"{name}.{ending}")
        row = [task.partitionId(), f"{name}.rec", f"{name}.idx", len(entries), start, offset, width]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
            names=["shard", "data", "entries", "n_records", "n_ids", "n_bytes", "width"],
        )

    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order, text_key(F.col("text")))
    return written(dealt.mapInArrow(walk, MANIFEST), "record-manifest").filter("n_records > 0")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (bytes) of every record, read from the files of a manifest."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with fs.open_input_stream(shard["entries"]) as source:
                    index = np.frombuffer(source.read(), INDEX_ENTRY)
                with fs.open_input_file(shard["data"]) as source:
                    for part in _batches(index["length"], READ_BYTES):
                        yield _rows(source, index[part], shard["base"], shard["width"])

    dealt = placed.repartition(F.col("shard"))
    return dealt.mapInArrow(walk, "doc_id long, start long, n_tokens long, ids binary")


def _rows(source, entries: np.ndarray, base: int, width: int) -> pa.RecordBatch:
    """Rows of consecutive index entries; ids come as 32-bit integers whatever their width in the file."""
    first = int(entries["offset"][0])
    block = source.read_at(int(entries["length"].sum()), first)
    payloads = unframe(block, entries["offset"] - first, entries["length"])
    heads = np.frombuffer(b"".join([p[:HEAD] for p in payloads]), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(heads[:, 1], mask=heads[:, 0] == 1),
            pa.array(entries["start"] + base),
            pa.array([(len(p) - HEAD) // width for p in payloads], pa.int64()),
            pa.array([np.frombuffer(p, f"<u{width}", offset=HEAD).astype("<u4").tobytes() for p in payloads], pa.binary()),
        ],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


def read_at(folder: str, data: str, entries: str, picks: list[int], width: int) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of some records of a shard, in the order asked for: one small read a record."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(entries) as source:
        index = np.frombuffer(source.read(), INDEX_ENTRY)
    found = []
    with fs.open_input_file(data) as source:
        for k in picks:
            offset, length = int(index["offset"][k]), int(index["length"][k])
            (payload,) = unframe(source.read_at(length, offset), np.array([0]), np.array([length]))
            flag, doc_id = np.frombuffer(payload[:HEAD], "<i8")
            found.append((None if flag else int(doc_id), np.frombuffer(payload[HEAD:], f"<u{width}").astype("<u4")))
    return found


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read back.

    start: ids of all documents before it in the file order. Repeated rows are records of their own; an
    empty table gives no files and no rows.
    """
    folder = new_folder(spark, "token-records")
    rows = read_records(write_records(docs, path, end_id, folder), folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
