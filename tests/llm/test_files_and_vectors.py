"""Token counts, record files, archive records and the prefix forest."""

import gzip
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import docs, rows
from tokenizers import Tokenizer

from corpuslens.llm import forest, records, tokens, warc
from corpuslens.llm.checksums import crc32c, masked
from corpuslens.llm.common import new_folder
from pyspark.sql import functions as F

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", " ", "  ", "\n", "'", "'s", "'LL", "'ll", "ll", "1", "!", "日", "😀", "\t", "re", "The", "it's", "\xa0", "́", "."]


def texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(15))) for _ in range(n)]


def test_every_prefix_count_is_the_librarys():
    library, own = Tokenizer.from_file(BYTES), tokens.counter(BYTES)
    for text in [*texts(500), "a" * 300, "ab" * 150, "x \n\n  y", "it're ve 'llama", "12345 678"]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert tokens.prefix_counts(own.steps(text)).tolist() == want, repr(text)


def test_special_strings_count_as_the_library_does():
    library, own = Tokenizer.from_file(BYTES), tokens.counter(BYTES)
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext| >"):
        assert tokens.prefix_counts(own.steps(text))[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_count_table(spark):
    library = Tokenizer.from_file(BYTES)
    got = tokens.count_table(docs(spark), BYTES, 1024, [3, 50], table=True).collect()
    text = {r[0]: r[1] or "" for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        t = text[r.doc_id]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
        counts = tokens.prefix_counts(zlib.decompress(r.prefix_table))
        assert len(counts) == len(t) + 1 and counts[-1] == n
        for budget, cut in zip([3, 50], r.cut_at, strict=True):
            assert len(library.encode(t[:cut], add_special_tokens=False).ids) <= budget
    one = docs(spark).filter("doc_id = 5")
    cut = tokens.truncate(one, tokens.count_table(one, BYTES, 1024, [7])).collect()[0].text
    assert text[5].startswith(cut) and len(library.encode(cut, add_special_tokens=False).ids) <= 7
    assert tokens.count_table(docs(spark, []), BYTES, 9, [1]).count() == 0


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    monkeypatch.setattr(records, "CACHE_CHUNKS", 50)
    counter, encoder = tokens.PrefixCounter(BYTES), records.ChunkEncoder(WORDS)
    many = [f"w{i} x{i % 9}y, z" for i in range(400)]
    assert [sum(np.frombuffer(counter.steps(t), np.int8)) for t in many] == [
        len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(many, add_special_tokens=False)
    ]
    assert max(map(len, (counter.young, counter.old, counter.young_chunks, counter.old_chunks))) <= 50
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(WORDS).encode_batch(many, add_special_tokens=False)]
    assert [encoder.ids([t])[0] for t in many] == want and len(encoder.young) <= 50


def test_chunk_ids_equal_the_library():
    found = [*texts(800, 9), "<|endoftext|> x", "a<|startoftext|>", "ΣΑΣ Σ", "İ I"]
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(WORDS).encode_batch(found, add_special_tokens=False)]
    assert records.encoder(WORDS).ids(found) == want


def test_checksums():
    assert crc32c(np.frombuffer(b"123456789", np.uint8), [9])[0] == 0xE3069283  # published check value
    assert crc32c(np.zeros(32, np.uint8), [32])[0] == 0x8A9136AA  # published: 32 zero bytes
    parts = [bytes([k]) * n for k, n in enumerate((0, 1, 63, 64, 65, 1000, 4097))]
    each = [crc32c(np.frombuffer(p, np.uint8), [len(p)])[0] for p in parts]
    both = crc32c(np.frombuffer(b"".join(parts), np.uint8), [len(p) for p in parts])
    assert both.tolist() == each
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_record_files_round_trip(spark):
    folder = new_folder(spark, "records-test")
    manifest = records.write_records(docs(spark), WORDS, 1, folder)
    got = sorted(records.read_records(manifest, folder).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(WORDS)
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    start = 0
    for r, (_, text, *_) in zip(got, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    shard = manifest.orderBy(F.desc("n_records")).first()
    picks = [shard.n_records - 1, 0, shard.n_records // 2]
    base = sum(r.n_records for r in manifest.collect() if r.shard < shard.shard)
    for k, (doc_id, ids) in zip(picks, records.read_at(folder, shard.data, shard["entries"], picks, shard.width), strict=True):
        assert doc_id == got[base + k].doc_id and ids.tobytes() == got[base + k].ids
    empty = records.round_trip(spark, docs(spark, []), WORDS)
    assert empty.count() == 0


def test_damaged_records_are_refused():
    block, lengths = records.frame([b"one", b"", b"three three"])
    offsets = np.cumsum(lengths) - lengths
    assert records.unframe(block, offsets, lengths) == [b"one", b"", b"three three"]
    for at in (0, 9, 13, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), offsets, lengths)


PAGES = [
    (1, "http://a.example/x", "<html lang='de'><head><title> A &amp; B\n</title><style>p{}</style></head><body><!-- no -->"
     "<p>One &#228;&#x41; two<br>three</p><script>var x='<p>';</script><a href=\"/y?a=1&amp;b=2\">link</a> &bogus; 5 < 6</body></html>"),
    (2, None, None), (3, "http://a.example/\r\nInjected: 1", ""), (4, "u", "no tags at all"), (4, "u", "no tags at all"),
]


def test_archive_records(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit("own"))
    made = warc.derive(warc.responses_of(pages), ["page_id"])
    got = made.collect()
    assert len(got) == 2 * len(PAGES)
    by = {(r.page_id, r.warc_type): r for r in got}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text.block == "One äA two\nthree\nlink &bogus; 5 < 6"
    assert "title: A & B\r\nlanguage: de\r\n" in meta.block and "outlink: /y?a=1&b=2\r\n" in meta.block
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta.block
    assert text.refers_to == meta.refers_to and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    assert text.source_digest == meta.source_digest and by[2, "conversion"].block == ""
    assert by[3, "metadata"].target_uri == "http://a.example/Injected: 1"
    warc.write_archive(made, str(tmp_path / "w"))
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        record_id = fields[b"WARC-Record-ID"].decode()
        assert rest[:n].decode() in {r.block for r in got if r.record_id == record_id} and rest[n : n + 4] == b"\r\n\r\n"
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", record_id) and fields[b"WARC-Refers-To"]
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == len(got)
    assert warc.derive(warc.responses_of(pages.limit(0)), []).count() == 0


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def test_forest_finds_most_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = forest.search(df, F.col("vec_id") % 20 == 0, 10).collect()
    table = df.toPandas()
    points, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    hit = 0
    for q, answers in found.items():
        d = np.sqrt(((points - points[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & {v for _, v in answers.values()})
        assert [answers[k] for k in sorted(answers)] == sorted(answers.values()) and sorted(answers) == list(range(1, 11))
    assert len(found) == 100 and hit / 1000 >= 0.9


def test_forest_odd_vectors(spark):
    rng = np.random.default_rng(6)
    data = [(i, rng.standard_normal(8).tolist(), 0) for i in range(30)]
    data += [(100 + i, [1.0] * 8, 0) for i in range(40)]  # one vector of many
    data += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [None] + [1.0] * 7, 0), (204, [], 0)]
    data += [(205, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (206, [float("inf")] * 8, 0), data[3], data[31]]
    got = forest.search(vectors(spark, data).withColumn("rank", F.lit("own")), F.lit(True), 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(by) == {*range(30), *range(100, 140)}
    assert by[120] == [(0.0, 100 + i) for i in range(5)] and by[102] == [(0.0, i) for i in (100, 101, 103, 104, 105)]
    points = {i: np.array(v, np.float32).astype(float) for i, v, _ in data[:70]}
    for q in range(30):  # fewer than a shard's least candidates: the answer is exact
        want = sorted((float(np.sqrt(((points[q] - p) ** 2).sum())), i) for i, p in points.items() if i != q)[:5]
        assert [i for _, i in by[q]] == [i for _, i in want]
    assert forest.search(vectors(spark, []), F.lit(True)).count() == 0
