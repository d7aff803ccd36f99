"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The automaton reads sequences of tokens and accepts exactly those that byte-pair encoding writes. It starts as
one state on which every symbol loops. Each merge (u, v) -> w, in order of rank, puts in one gadget:

* beside every arc u an arc w, which leads where v leads after u;
* the state that the arcs u lead to is split: the new one has no arc v (and no arc w where u = v), since u
  followed by v is written w from now on.

All arcs with one label lead to one state, so a merge adds one state and the automaton stays deterministic. A
state is not copied when it is split: it holds the arcs taken away by its own gadgets, with their ranks, and
points to the state it was split from as of the rank of the split. A merge whose two tokens can no longer meet
gets no gadget and its token no arc.

A word is encoded by table-driven transitions: the tokens that begin at a position are read off a trie, and
the longest that leaves the automaton's state as an arc is taken; a position from which no arc leads on is
left for good. Every prefix of a word has one encoding, so a position has one state, is entered once, and the
walk is linear in the word. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tokens import byte_letters

NEVER = 1 << 40  # a rank after all merges
TOKEN = -1  # key of a trie node for its token
CACHE_ARCS = 1_000_000  # of one worker
CACHE_CHUNKS = 300_000  # of one worker, twice at most, and as many words
LONGEST_CACHED = 200  # characters of a chunk that is kept
MARKS = ".,;:!?()"
LAST_LATIN = 0x24F
BATCH_BYTES = 4 << 20  # of the texts or ids that are worked on at a time


class MergeAutomaton:
    """The automaton of a list of merges. ``ids`` numbers the tokens; symbols are those that no merge makes."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        size = max(ids.values(), default=-1) + 1
        self.size = size
        self.left, self.right = [-1] * size, [-1] * size  # the two tokens that a merge joined
        self.made = [-1] * size  # rank of the merge that made the token, -1 for a symbol
        self.live = [False] * size  # tokens that are the label of an arc
        self.taken: dict[int, int] = {}  # (token that leads to a state, label of an arc taken away) -> rank
        self.arcs: dict[int, bool] = {}
        produced = {u + v for u, v in merges}
        if len(produced) != len(merges):
            raise ValueError("two merges make the same token")
        for token, k in ids.items():
            self.live[k] = token not in produced
        for rank, (first, second) in enumerate(merges):
            self._gadget(rank, ids[first], ids[second], ids[first + second])
        self._read_labels({k: token for token, k in ids.items()})

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if (self.made[u] < 0 and not self.live[u]) or (self.made[v] < 0 and not self.live[v]):
            raise ValueError("a merge uses a token that is not made yet")
        self.left[w], self.right[w], self.made[w] = u, v, rank
        self.live[w] = self.live[u] and self.live[v] and self._leaves(u, v)
        if self.live[w]:
            self.taken[u * self.size + v] = rank

    def _leaves(self, u: int, x: int) -> bool:
        """Whether an arc x leaves the state that the arcs u lead to."""
        taken, size, made = self.taken, self.size, self.made
        before = NEVER  # the state was split off at this rank, later gadgets of its origin do not count
        while u >= 0:
            label, after = x, NEVER  # an arc goes with its first token's, unless it was put in earlier
            while label >= 0:
                rank = taken.get(u * size + label)
                if rank is not None and rank < before and rank <= after:
                    return False
                after, label = made[label], self.left[label]
            before, u = made[u], self.right[u]
        return True

    def arc(self, u: int, x: int) -> bool:
        """``_leaves`` kept in a bounded table."""
        key = u * self.size + x
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._leaves(u, x)
        return found

    def _read_labels(self, names: dict[int, str]) -> None:
        """The trie of the live tokens, spelled in symbols."""
        spelled: dict[int, tuple[int, ...]] = {}
        for k in sorted(names, key=self.made.__getitem__):
            spelled[k] = (k,) if self.left[k] < 0 else spelled[self.left[k]] + spelled[self.right[k]]
        self.lengths = [0] * self.size
        self.trie: dict = {}  # symbol -> node; under TOKEN the token that ends at the node
        for k, symbols in spelled.items():
            self.lengths[k] = len(symbols)
            if self.live[k]:
                node = self.trie
                for s in symbols:
                    node = node.setdefault(s, {})
                node[TOKEN] = k

    def encode(self, symbols: list[int]) -> list[int]:
        """Tokens of a word given in symbols."""
        n, at, last = len(symbols), 0, -1
        lengths, arc = self.lengths, self.arc
        path: list[int] = []
        open_arcs: list[list[int]] = []  # for each token of the path the shorter ones that begin there
        dead = set()  # positions that cannot reach the end
        options = self._begin(symbols, 0)
        while at < n:
            while options:
                token = options.pop()
                if (last < 0 or arc(last, token)) and at + lengths[token] not in dead:
                    path.append(token)
                    open_arcs.append(options)
                    at, last = at + lengths[token], token
                    options = self._begin(symbols, at) if at < n else []
                    break
            else:
                dead.add(at)
                at -= lengths[path.pop()]
                last = path[-1] if path else -1
                options = open_arcs.pop()
        return path

    def _begin(self, symbols: list[int], at: int) -> list[int]:
        """The tokens that begin at a position, the longest last."""
        node, found = self.trie, []
        for k in range(at, len(symbols)):
            node = node.get(symbols[k])
            if node is None:
                break
            token = node.get(TOKEN)
            if token is not None:
                found.append(token)
        return found


class Codec:
    """Encoding and decoding by one vocabulary file; normalizing and splitting are the file's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-pair vocabulary")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ends = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have rules of their own")
        strings = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_at = regex.compile(f"({strings})") if strings else None
        ids = {t: k for t, k in model["vocab"].items() if t not in self.special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(ids, merges)
        self.symbols = {t: k for t, k in ids.items() if self.automaton.made[k] < 0}
        self.by_blanks = _drops_blanks(spec)
        self.plain = self._plain_chunks() if self.by_blanks else None
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError("unknown decoder")
        names = ids | self.special
        self.labels: list[str | bytes | None] = [None] * (max(names.values()) + 1)
        letters = byte_letters()
        for token, k in names.items():
            self.labels[k] = token if kind is None or token in self.special else bytes(letters[c] for c in token)
        self.joined = kind is None  # labels are joined by blanks, else their bytes are strung together
        self.label_table = pa.array([x.encode() if isinstance(x, str) else x for x in self.labels], pa.binary())
        self.letter_of = {byte: letter for letter, byte in letters.items()}
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.young_pieces: dict[str, bytes] = {"": b""}
        self.old_pieces: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """The words of a text, normalized, in byte letters."""
        whole = self.normalizer.normalize_str(text) if self.normalizer else text
        return [letters for letters, _ in self.splitter.pre_tokenize_str(whole)]

    def _plain_chunks(self) -> regex.Pattern | None:
        """A pattern of chunks that are one word and one run of marks: Latin letters and marks that the file's own
        normalizing and splitting, asked for each of them, treats so."""
        in_bytes = {byte: letter for letter, byte in byte_letters().items()}
        spelled = lambda word: "".join(map(in_bytes.__getitem__, word.encode()))
        letters = [c for c in map(chr, range(LAST_LATIN + 1)) if c.isalpha() and self._split(f"a{c}{c}a") == [spelled(f"a{c}{c}a".lower())]]
        marks = [c for c in MARKS if self._split(f"a{c}{c}") == ["a", c + c] and self._split(f"{c}{c}") == [c + c]]
        if not letters or not marks:
            return None
        return regex.compile(f"([{''.join(letters)}]+)([{regex.escape(''.join(marks))}]*)")

    def _word(self, letters: str) -> list[int]:
        symbols = list(map(self.symbols.__getitem__, letters[:-1]))
        symbols.append(self.symbols[letters[-1] + self.ends])
        return self.automaton.encode(symbols)

    def _piece(self, piece: str) -> bytes:
        """Ids of one lower-case word or run of marks."""
        found = self.young_pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                letters = piece if piece.isascii() else "".join(map(self.letter_of.__getitem__, piece.encode()))
                found = np.array(self._word(letters), "<u4").tobytes()
            if len(piece) <= LONGEST_CACHED:
                if len(self.young_pieces) >= CACHE_CHUNKS:
                    self.old_pieces, self.young_pieces = self.young_pieces, {"": b""}
                self.young_pieces[piece] = found
        return found

    def _text(self, text: str) -> bytes:
        ids: list[int] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for letters in self._split(part):
                    ids += self._word(letters)
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            plain = self.plain.fullmatch(chunk) if self.plain else None
            if plain:
                found = self._piece(plain[1].lower()) + self._piece(plain[2])
            else:
                found = self._text(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self.young) >= CACHE_CHUNKS:
                self.old, self.young = self.young, {"": b""}
            self.young[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.by_blanks:
            return self._text(text)
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(self.young.get, chunks))
        if None in found:
            found = [self._chunk(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return b"".join(found)

    def decode(self, batch: pa.Array) -> pa.Array:
        """The labels of each row of ids; unknown ids have none, a null row is empty. What is no UTF-8 is replaced."""
        rows = pc.fill_null(batch, b"")
        sizes = pc.binary_length(rows).to_numpy(zero_copy_only=False) // 4
        ids = np.frombuffer(b"".join(rows.to_pylist()), "<u4")
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        known = ids < len(self.labels)
        labels = self.label_table.take(pa.array(np.where(known, ids, 0), mask=~known))
        if labels.null_count:
            here = labels.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(here))[offsets].astype(np.int32)
            labels = labels.drop_null()
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), labels), b" " if self.joined else b"")
        if self.joined:
            return texts.cast(pa.string())
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _drops_blanks(spec: dict) -> bool:
    """Whether chunks between blanks are encoded alone: only matches of a pattern without looking around stay,
    none of which holds white space, and the normalizer knows single characters and their marks only."""
    rules = spec["pre_tokenizer"] or {}
    rules = rules.get("pretokenizers", [rules])
    first = rules[0] if rules else {}
    pattern = first.get("pattern", {}).get("Regex", "(?")
    steps = spec["normalizer"] or {}
    kinds = {s["type"] for s in steps.get("normalizers", [steps] if steps else [])}
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and "(?" not in pattern and not regex.search(pattern, " \n") and kinds <= {"NFC", "Replace", "Lowercase"}
        and all(r.get("add_prefix_space", False) is False for r in rules)
    )


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One object a worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about BATCH_BYTES, one row at least."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > BATCH_BYTES:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _mapped(df: DataFrame, column: str, name: str, kind: str, work: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with ``name``: what ``work`` makes of ``column``, in slices so that a batch stays small."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], f"`{name}` {kind}"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            for part in _parts(sizes):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, work(rows.column(column))], names=[*batch.schema.names, name])

    return df.mapInArrow(walk, schema)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit integers) of every whole text.

    As the tokenizer library encodes without added tokens; special strings inside a text are special tokens.
    A null or empty text has no ids; repeated rows have a result each; nothing moves between tasks.
    """

    def work(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.encode(t or "") for t in texts.to_pylist()], pa.binary())

    return _mapped(docs.select("doc_id", "text"), "text", "ids", "binary", work).select("doc_id", "ids")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text that the ids stand for; null ids are none."""
    return _mapped(encoded, "ids", "decoded", "string", lambda ids: codec(path).decode(ids))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    done = decode_ids(encode_texts(docs, path), path)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
