"""Token counts of every prefix of a text, by dynamic programming over byte-pair encodings.

A piece is encoded from left to right: the encoding of a prefix ends in a token t such that the encoding of
what stands before t is the stored one and t may follow its last token. Two tokens may follow each other
exactly if encoding their joined bytes gives the two again, so the last token, and with it the count, of
every prefix follows from shorter prefixes. The counts answer truncation and budget questions without
encoding again.

Texts are cut into units: a run of white space and the piece after it. A unit's counts do not depend on its
neighbours, so they are worked out once and kept in a bounded cache of each Python worker.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_UNITS = 300_000  # of one worker, twice at most
PIECE = regex.compile(public_tokenizers.PATTERN)
# A unit: white space, then a contraction (never after a space), letters, digits or other characters.
UNIT = regex.compile(r"\s*(?:(?<! )'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
# The same units for most chunks: a space and ASCII letters, then ASCII signs but the apostrophe.
WORD = re.compile(r"( [A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
TAIL = 3  # bytes at the end of a token by which its possible lengths are looked up


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(sorted(set(range(256)) - set(plain))):
        letters[chr(256 + k)] = b
    return letters


class PrefixCounter:
    """Counts of one vocabulary file (byte-level, ranks by id). One object a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        special = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_at = regex.compile(f"({special})") if special else None
        ranks = {token: rank for token, rank in ranks.items() if token.decode("latin-1") not in self.special}
        self.ranks = ranks
        self.encoding = tiktoken.Encoding("prefix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # a token whose own bytes are encoded otherwise never occurs
        encode = self.encoding._encode_single_piece
        self.tokens = {token: rank for token, rank in ranks.items() if encode(token) == [rank]}
        self.bytes_of = {rank: token for token, rank in self.tokens.items()}
        sizes: dict[bytes, set[int]] = {}
        for token in self.tokens:
            if len(token) >= TAIL:
                sizes.setdefault(token[-TAIL:], set()).add(len(token))
        self.tail_sizes = sizes
        self.sizes: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.blanks: dict[str, list[int]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_chunks: dict[str, bytes | None] = {}
        self.old_chunks: dict[str, bytes | None] = {}

    def _sizes(self, tail: bytes) -> tuple[int, ...]:
        """Lengths of the tokens that may end in ``tail``, the longest first."""
        if len(self.sizes) > CACHE_UNITS:
            self.sizes.clear()
        short = {n for n in range(1, min(TAIL, len(tail) + 1)) if tail[-n:] in self.tokens}
        found = self.sizes[tail] = tuple(sorted(short | self.tail_sizes.get(tail, set()), reverse=True))
        return found

    def _fits(self, key: int, before: int, token: bytes) -> bool:
        if len(self.pairs) > 2 * CACHE_UNITS:
            self.pairs.clear()
        encoded = self.encoding._encode_single_piece(self.bytes_of[before] + token)
        found = self.pairs[key] = encoded == [before, self.tokens[token]]
        return found

    def piece_counts(self, piece: bytes) -> list[int]:
        """Number of tokens of piece[:i] for i = 0, 1, ..., len(piece)."""
        last, counts = [0], [0]  # of each prefix: its last token, how many there are
        number_of, sizes_of, known = self.tokens.get, self.sizes.get, self.pairs.get
        for end in range(1, len(piece) + 1):
            tail = piece[max(0, end - TAIL) : end]
            for size in sizes_of(tail) or self._sizes(tail):
                start = end - size
                if start < 0:
                    continue
                token = piece[start:end]
                number = number_of(token)
                if number is None:
                    continue
                if start:
                    before = last[start]
                    key = before << 32 | number
                    fits = known(key)
                    if fits is None:
                        fits = self._fits(key, before, token)
                    if not fits:
                        continue
                last.append(number)
                counts.append(counts[start] + 1)
                break
        return counts

    def _blank_counts(self, blank: str) -> list[int]:
        """Counts after each character of a run of white space."""
        found = self.blanks.get(blank)
        if found is None:
            if len(self.blanks) > 1000:
                self.blanks.clear()
            counts = self.piece_counts(blank.encode())
            found = self.blanks[blank] = [counts[k] for k in _char_ends(blank)]
        return found

    def unit_steps(self, unit: str) -> bytes:
        """For each character of a unit, by how much it changes the count, as signed bytes.

        Cutting a unit inside its white space or contraction changes its pieces, so these (short or of one
        kind of character) are counted per prefix; the last piece is counted by one pass.
        """
        found = self.young.get(unit)
        if found is None:
            found = self.old.get(unit)
            if found is None:
                found = self._count_unit(unit)
            if len(self.young) >= CACHE_UNITS:
                self.old, self.young = self.young, {}
            self.young[unit] = found
        return found

    def _count_unit(self, unit: str) -> bytes:
        body = unit.lstrip()
        blank = len(unit) - len(body)
        if blank == 1 and body and unit[0] != " ":  # a piece of its own
            return bytes([self._blank_counts(unit[0])[-1]]) + self.unit_steps(body)
        if blank < 2 and body.isalpha():  # one piece
            counts = self.piece_counts(unit.encode())
            if len(counts) <= len(unit) + 1:
                return bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])
            ends = [counts[k] for k in _char_ends(unit)]
            return bytes([b - a & 255 for a, b in zip([0, *ends], ends, strict=False)])
        counts = [0]
        if blank:  # a run of white space is one piece until another character follows
            counts += self._blank_counts(unit[:blank])
        if body:
            pieces = [unit] if blank == 1 and unit[0] == " " else PIECE.findall(unit)
            before = sum(self.piece_counts(p.encode())[-1] for p in pieces[:-1])
            tail = pieces[-1]
            inner = self.piece_counts(tail.encode())
            ends = inner[1:] if tail.isascii() else [inner[k] for k in _char_ends(tail)]
            shown = [before + n for n in ends[-len(body) :]]
            if body[0] == "'" and 2 <= len(body) <= 3 and tail == body:  # a contraction: its prefixes are other pieces
                shown[: len(body) - 1] = [
                    before + sum(self.piece_counts(p.encode())[-1] for p in PIECE.findall(body[:k]))
                    for k in range(1, len(body))
                ]
            counts += shown
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def _chunk_steps(self, chunk: str) -> bytes | None:
        """Steps of a chunk that begins with a space and has no other; None if the next one depends on it."""
        word = WORD.fullmatch(chunk)
        if word:
            return self.unit_steps(word[1]) + self.unit_steps(word[2]) if word[2] else self.unit_steps(chunk)
        if len(chunk) == 1 or chunk[-1].isspace():
            return None
        return b"".join(map(self.unit_steps, UNIT.findall(chunk)))

    def steps(self, text: str) -> bytes:
        """For each character, by how much it changes the number of tokens; the sum is the count of the text."""
        if self.special_at is not None and any(s in text for s in self.special):
            found = []
            for k, part in enumerate(self.special_at.split(text)):
                found.append(b"\x01" + bytes(len(part) - 1) if k % 2 else self._plain_steps(part))
            return b"".join(found)
        return self._plain_steps(text)

    def _plain_steps(self, text: str) -> bytes:
        chunks = text.split(" ")
        if len(chunks) > 1 and chunks[0] and not chunks[0][-1].isspace():
            young, old = self.young_chunks, self.old_chunks
            found = [b"".join(map(self.unit_steps, UNIT.findall(chunks[0])))]
            for chunk in chunks[1:]:
                steps = young.get(chunk)
                if steps is None:
                    steps = old.get(chunk)
                    if steps is None:
                        steps = self._chunk_steps(" " + chunk)
                        if steps is None:
                            break
                    if len(young) >= CACHE_UNITS:
                        old = young
                        young = {}
                    young[chunk] = steps
                found.append(steps)
            self.young_chunks, self.old_chunks = young, old
            if len(found) == len(chunks):
                return b"".join(found)
        return b"".join(map(self.unit_steps, UNIT.findall(text)))


def _char_ends(text: str) -> list[int]:
    """Byte offset after each character."""
    if text.isascii():
        return list(range(1, len(text) + 1))
    return list(accumulate([1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text]))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(steps: bytes) -> np.ndarray:
    """Exact number of tokens of text[:i] for i = 0, 1, ..., len(text)."""
    return np.append(0, np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64))


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix with at most ``budget`` tokens (a longer prefix can have fewer tokens)."""
    return int(np.flatnonzero(counts <= budget)[-1])


def count_table(docs: DataFrame, path: str, limit: int, budgets: list[int], table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_at and, if ``table``, the stored counts of every document.

    ``cut_at``: for each budget the number of characters of the longest prefix within it. ``prefix_table``:
    the compressed steps that ``prefix_counts`` turns into the count of every prefix. A null or empty text
    has 0 tokens; repeated rows have a result each; the row order is that of the input and nothing moves.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean, cut_at array<int>"
    schema += ", prefix_table binary" if table else ""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n_bytes, n_tokens, cuts, tables = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                steps = own.steps(text)
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                counts = prefix_counts(steps)
                n_tokens.append(int(counts[-1]))
                cuts.append([longest_prefix(counts, b) for b in budgets])
                if table:
                    tables.append(zlib.compress(steps))
            columns = [
                batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(cuts, pa.list_(pa.int32())),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_at"]
            if table:
                columns.append(pa.array(tables, pa.binary()))
                names.append("prefix_table")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(walk, schema)


def truncate(docs: DataFrame, counted: DataFrame, budget_index: int = 0) -> DataFrame:
    """doc_id and the text cut to one of the budgets of ``count_table``; ids must be unique."""
    cut = counted.select("doc_id", F.get("cut_at", F.lit(budget_index)).alias("_cut"))
    return docs.join(cut, "doc_id").withColumn("text", F.expr("substring(text, 1, _cut)")).drop("_cut")
