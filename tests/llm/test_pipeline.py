"""The pipeline's stages against plain Python, each on its own input, and the registry."""

import hashlib
from collections import Counter

from helpers import docs, rows

import __spark_entry__
import brute
import corpus_pipeline
from corpuslens.llm import queries
from corpuslens.llm.common import written


def test_stages_in_order_on_odd_rows(spark):
    table = docs(spark)
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, table, ""), "stage-test")
        outputs.append((table.collect(), after.collect(), after.columns))
        table = after
    for before, after, columns in outputs[:-1]:
        assert columns == docs(spark).columns and len(after) > 0 and len(before) > 0
    (_, good, _), (lines_in, lines_out, _), (near_in, near_out, _), (mix_in, mix_out, _), (pack_in, packed, _) = outputs
    assert all(brute.counts(r.text)["n_words"] >= 10 for r in good)
    shorter = brute.kept_lines([(r.doc_id, r.text) for r in lines_in])
    assert len(lines_out) == len(lines_in)
    sha = lambda r: hashlib.sha256((r.text or "").encode()).hexdigest()
    assert Counter((d, digest) for d, _, _, digest in shorter) == Counter((r.doc_id, sha(r)) for r in lines_out)
    assert all(r.n_chars == len(r.text) for r in lines_out)
    kept = Counter(d for d, _, _, k in brute.components([(r.doc_id, r.text) for r in near_in], 5) if k)
    several = {d for d, n in Counter(r.doc_id for r in near_in if r.text and r.text.split()).items() if n > 1 and d is not None}
    assert Counter(r.doc_id for r in near_out) == Counter({d: 1 if d in several else n for d, n in kept.items()})
    assert set(mix_out) <= set(mix_in) and max(Counter(mix_out).values()) <= 3
    words = lambda rows_: Counter({r.doc_id: 0 for r in rows_})
    want, got = words(pack_in), words(packed)
    for r in pack_in:
        want[r.doc_id] += len(brute.WORD.findall(r.text or ""))
    for r in packed:
        got[r.doc_id] += r.size
    assert want == got


def test_empty_input(spark):
    table = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        table = written(stage(spark, table, ""), "stage-test")
    assert table.count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES) and len(rows()) > 50
