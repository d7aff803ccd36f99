"""Merkle manifest, whitening and the merge automaton against plain Python, numpy and the tokenizer library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import docs, rows
from tokenizers import Tokenizer

from corpuslens.llm import automaton, merkle, whitening
from pyspark.sql import functions as F

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", " ", "  ", "\n", "'", "'s", "'LL", "1", "!", "日", "😀", "\t", "the", "ing", "\xa0", "́", "Σ", "İ", "ﬁ", ".", "--"]
PARTS += ["<|endoftext|>", "<|start", "th", "an", "in", "er", "==", "\x00", "\r\n"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(data):
    groups = {}
    for doc_id, text, lang, source, n_chars in data:
        leaf = tampered = sha("".join(map(field, (doc_id, source, lang, n_chars, text))))
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            tampered = sha("".join(map(field, (doc_id, source, lang, n_chars, text.translate(LOWER)))))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, tampered, doc_id))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(groups[lang], key=lambda x: x[:3])]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for j, lang in enumerate(langs):
        for i, (_, _, leaf, own, doc_id) in enumerate(sorted(groups[lang], key=lambda x: x[:3])):
            proof = ""
            for levels, at in ((trees[lang], i), (top, j)):
                for nodes in levels[:-1]:
                    run, k = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += "".join(run[:k] + run[k + 1 :])
                    own = sha("".join([*run[:k], own, *run[k + 1 :]]))
                    at //= 8
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], sha(proof), own, own == top[-1][0]))
    return sorted(out, key=repr)


def many(n, lang):
    rng = random.Random(n)
    return [(k, " ".join(rng.choice(["Aa", "b", "c"]) for _ in range(5)), lang, "s", k) for k in range(n)]


def test_manifest_of_awkward_rows_and_incomplete_groups(spark):
    """Blocks of eight leaves; languages that end anywhere in a group, so that stand-ins serve on every level, and
    more languages than a run holds."""
    sizes = [1, 2, 8, 9, 64, 65, 73, 513, 577, 600]
    data = rows() + [row for n in sizes for row in many(n, f"size {n:04d}")] + [(None, None, "Ä", "s", 1)]
    got = merkle.verify_documents(docs(spark, data), 1).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(data)


def test_manifest_of_whole_blocks(spark):
    data = rows() + many(4200, "hot")
    got = merkle.verify_documents(docs(spark, data)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(data)


def test_manifest_of_no_rows_and_clashing_columns(spark):
    assert merkle.verify_documents(docs(spark, [])).count() == 0
    data = many(20, "en")
    extra = docs(spark, data)
    for name in ("leaf", "root", "grp", "slot", "_pos", "proof", "before"):
        extra = extra.withColumn(name, F.lit("x"))
    got = merkle.verify_documents(extra, 1).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(data)


def test_a_proof_holds_for_its_leaf_only(spark):
    proved = merkle.manifest(merkle.document_leaves(docs(spark, many(100, "en"))), "doc_id", ["doc_id"], 1)
    folded = proved.select(
        (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"),
        (merkle.fold(F.lit(sha("other")), F.col("proof")) == F.col("root")).alias("other"),
    ).collect()
    assert all(r.own and not r.other for r in folded)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=80, d=6, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.array([3, 2, 1.5, 1, 0.5, 0.2])[:d]
    out = [(k, [float(np.float32(v)) for v in row], k % 3) for k, row in enumerate(base)]
    out += [(1000 + k, out[7][1], 0) for k in range(60)]  # one vector many times
    out += [(2000, None, 1), (2001, [float("nan")] + [0.0] * (d - 1), 1), (2002, [float("inf")] + [0.0] * (d - 1), 1)]
    out += [(2003, [None] + [0.0] * (d - 1), 1), (2004, [0.0] * d, 1), (2005, [-0.0] * d, 1), (2006, [], 1), (2007, [1.0], 1)]
    return out + [(None, [1.0] * d, None), (3, out[3][1], 0)]


def brute_whitening(data, d, components):
    sound = [(i, v) for i, v, _ in data if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([np.float32(v) for _, v in sound]).astype(float) * 256).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, frame = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    white = (x - sums / n) @ frame[:, order] / np.sqrt(values[order])
    return [i for i, _ in sound], n, ((n * x - sums) ** 2).sum(axis=1), white, values[order] / values.sum()


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 60)  # ten rows a block
    data = vectors()
    frame = spark.createDataFrame(data, VECTORS).repartition(5)
    for name in ("n", "whitened", "_index", "index", "vector", "_x", "deviation"):
        frame = frame.withColumn(name, F.lit("x"))
    got = whitening.by_component(whitening.whiten(frame, "embedding", ["vec_id"], 4), ["vec_id"]).collect()
    ids, n, deviation, white, explained = brute_whitening(data, 6, 4)
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for c in range(4):
        want = sorted((repr(i), int(v), float(w)) for i, v, w in zip(ids, deviation, white[:, c], strict=True))
        mine = [r for r in got if r.component == c + 1]
        assert all(abs(r.explained - explained[c]) < 1e-12 for r in mine)
        close = []
        for sign in (1, -1):
            own = sorted((repr(r.vec_id), r.deviation, sign * r.whitened) for r in mine)
            close.append(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(own, want, strict=True)))
        assert any(close)


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(5)], VECTORS)
    got = whitening.whiten(same, "embedding", ["vec_id"], 4).collect()
    assert len(got) == 5 and all(r.whitened == [None, None] and r.explained == [None, None] and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(k, [float(k), 2.0], 0) for k in range(5)], VECTORS)
    got = whitening.whiten(line, "embedding", ["vec_id"], 4).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in got)
    for data in ([], [(1, None, 0)], [(1, [None], 0)]):
        none = whitening.whiten(spark.createDataFrame(data, VECTORS), "embedding", ["vec_id"], 4)
        assert whitening.by_component(none, ["vec_id"]).count() == 0


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghinorstuy") for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return words + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_the_automaton_encodes_and_decodes_as_the_library(path):
    library, own = Tokenizer.from_file(path), automaton.Codec(path)
    latin = [chr(k) for k in range(0x250)]
    pairs = [a + b + c for a in latin for b, c in (("", "."), ("a", ",;"), ("É", "'s"), ("\u0301", "!"))]
    for text in [*texts(2000, 9), *pairs, "", "a" * 3000, "ab" * 1500, "#" * 999]:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert own.decode(pa.array([ids]))[0].as_py() == library.decode(want, skip_special_tokens=False), repr(text)


def brute_merges(word, merges):
    """The first merge that applies anywhere, from left to right, until none does."""
    word = list(word)
    for u, v in merges:
        k = 0
        while k < len(word) - 1:
            if word[k] == u and word[k + 1] == v:
                word[k : k + 2] = [u + v]
            k += 1
    return word


def test_gadgets_of_small_vocabularies():
    """Random merge lists, with doubled tokens and merges that can no longer meet, over all short words."""
    rng = random.Random(2)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        for _ in range(9):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        ids = {t: k for k, t in enumerate(tokens)}
        own = automaton.MergeAutomaton(ids, merges)
        for n in range(1, 9):
            for bits in range(2**n):
                word = "".join("ab"[bits >> k & 1] for k in range(n))
                assert [tokens[t] for t in own.encode([ids[c] for c in word])] == brute_merges(word, merges), (merges, word)


def test_merges_that_the_automaton_refuses():
    ids = {t: k for k, t in enumerate(["a", "b", "ab", "aba", "ba"])}
    with pytest.raises(ValueError, match="same token"):
        automaton.MergeAutomaton(ids, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])
    with pytest.raises(ValueError, match="not made yet"):
        automaton.MergeAutomaton({t: k for k, t in enumerate(["a", "b", "ab", "aba"])}, [("ab", "a"), ("a", "b")])


def test_small_caches_change_nothing(monkeypatch):
    large = automaton.Codec(WORDS)
    want = [large.encode(t) for t in texts(300, 4)]
    for name in ("CACHE_ARCS", "CACHE_CHUNKS", "LONGEST_CACHED"):
        monkeypatch.setattr(automaton, name, 3)
    own = automaton.Codec(WORDS)
    assert [own.encode(t) for t in texts(300, 4)] == want
    assert len(own.young) <= 4 and len(own.young_pieces) <= 4 and len(own.automaton.arcs) <= 3


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_rows_of_ids_are_decoded_apart(path):
    library, own = Tokenizer.from_file(path), automaton.Codec(path)
    lists = [[5, 300], [], [70_000, 1, 2, 4_000_000_000], [70_000], list(range(256)), [49_407, 3]]
    got = own.decode(pa.array([*(np.array(ids, "<u4").tobytes() for ids in lists), None])).to_pylist()
    known = [[k for k in ids if library.id_to_token(k) is not None] for ids in lists]
    assert got == [library.decode(ids, skip_special_tokens=False) for ids in known] + [""]


def test_digests_of_awkward_rows(spark):
    library = Tokenizer.from_file(WORDS)
    frame = docs(spark, [*rows(), (9000, "long" * 250_000, "en", "a", 0)])
    for name in ("ids", "decoded", "n_tokens"):
        frame = frame.withColumn(name, F.lit("x"))
    want = []
    for doc_id, text, *_ in [*rows(), (9000, "long" * 250_000)]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(decoded)))
    got = [tuple(r) for r in automaton.digests(frame, WORDS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert automaton.digests(docs(spark, []), WORDS).count() == 0


def test_round_trip_of_bytes(spark):
    """A byte-level vocabulary gives every text back."""
    done = automaton.decode_ids(automaton.encode_texts(docs(spark), BYTES), BYTES).select("doc_id", "decoded").collect()
    assert sorted(map(repr, ((r[0], r[1]) for r in done))) == sorted(repr((r[0], r[1] or "")) for r in rows())
