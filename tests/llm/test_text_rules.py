"""Quality rules and line dedup against plain Python."""

from collections import Counter

from helpers import SCHEMA, docs, rows

import brute
from corpuslens.llm import lines, quality
from pyspark.sql import functions as F


def test_counts_equal_brute_force(spark):
    got = quality.judge(docs(spark), ["doc_id", "text"]).collect()
    assert len(got) == len(rows())
    for r in got:
        assert {k: r[k] for k in brute.counts(r.text)} == brute.counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_fences_drop_outliers_and_keep_the_rest(spark):
    data = [(i, " ".join(f"word{i}x{j}" for j in range(40)), "en", "s", 0) for i in range(200)]
    data += [(900, " ".join(f"w{j}***###" for j in range(40)), "en", "s", 0)]
    data += [(901, " ".join(f"LOUD{j}WORDS" for j in range(40)), "en", "s", 0)]
    data += [(902, " ".join(f"lone{j}word" for j in range(40)), "xx", None, 0)]  # too few of its kind: judged with all
    kept = {r.doc_id: r.kept for r in quality.judge(docs(spark, data)).collect()}
    assert [d for d, k in kept.items() if not k] == [900, 901]


def test_sources_with_much_junk_do_not_set_their_own_fence(spark):
    good = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    junk = lambda i: " ".join(f"$$${i}%%%{j}###" for j in range(40))
    marked = lambda i: " ".join(f"|cell{i}x{j}" if j % 5 < 3 else f"word{j}" for j in range(40))
    data = [(i, good(i), "en", "clean", 0) for i in range(110)]
    data += [(1000 + i, junk(i) if i % 3 == 0 else good(i), "en", "a third", 0) for i in range(90)]
    data += [(2000 + i, junk(i), "en", "all", 0) for i in range(60)]
    data += [(3000 + i, junk(i), "en", "few", 0) for i in range(20)]  # too few for a fence of their own
    data += [(4000 + i, marked(i), "en", "tables", 0) for i in range(60)]  # another kind of text, but no junk
    gone = {r.doc_id for r in quality.judge(docs(spark, data)).filter("not kept").collect()}
    assert gone == {d for d, text, *_ in data if text.startswith("$")}


def test_no_size_of_a_group_changes_the_rule(spark):
    plain = [(i, " ".join(f"word{i}x{j}" for j in range(40)), "en", "plain", 0) for i in range(400)]
    marked = lambda i: " ".join(["######", *(f"word{i}x{j}" for j in range(39))])
    verdicts = []
    for n in (48, 49, 50, 51):
        data = plain + [(1000 + i, marked(i), "en", "other", 0) for i in range(n)]
        kept = quality.judge(docs(spark, data)).filter("kept").groupBy("source").count().collect()
        verdicts.append({r["source"]: r["count"] for r in kept})
    assert verdicts == [{"plain": 400, "other": n} for n in (48, 49, 50, 51)]


def test_blended_shares_equal_plain_python(spark):
    counted = quality.sketch(quality.text_counts(docs(spark), ["doc_id", "lang", "source"]))
    seen = Counter()
    for r in counted.collect():
        for key in ((r.rate,), (r.lang, r.rate), (r.lang, r.source, r.rate)):
            seen[(*key, r.bucket)] += r.n
    total = Counter()
    for key, n in seen.items():
        total[key[:-1]] += n
    share = lambda key, b: seen[(*key, b)] / total[key]
    mixed = lambda own, n, prior: (own * n + quality.PRIOR_DOCS * prior) / (n + quality.PRIOR_DOCS)
    cut = quality.written(counted, "test")
    whole = quality.merge(cut, []).withColumn("w", F.col("n").cast("decimal(38,0)"))
    sums = whole.groupBy(F.col("rate").alias("r")).agg(F.sum("n").cast("decimal(38,0)").alias("total"))
    whole = whole.join(sums, F.col("rate") == F.col("r")).select("rate", "bucket", "w", "total")
    by_lang = quality.blend(cut, ["lang"], whole, [])
    for r in quality.blend(cut, ["lang", "source"], by_lang, ["lang"]).collect():
        lang = mixed(share((r.lang, r.rate), r.bucket), total[r.lang, r.rate], share((r.rate,), r.bucket))
        key = (r.lang, r.source, r.rate)
        assert abs(float(r.w) / float(r.total) - mixed(share(key, r.bucket), total[key], lang)) < 1e-12


def test_sketches_merge_by_adding(spark):
    counts = quality.text_counts(docs(spark), ["doc_id", "lang", "source"])
    halves = [quality.sketch(counts.filter(f"coalesce(doc_id, 0) % 2 = {k}")) for k in (0, 1)]
    keys = ["lang", "source"]
    merged = quality.merge(halves[0].union(halves[1]), keys)
    whole = quality.merge(quality.sketch(counts), keys)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_sketch_buckets_are_close(spark):
    values = [0, 1, 63, 64, 65, 127, 1000, 123456, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket_of(F.col("v")).alias("b"))
    for r in df.collect():
        assert r.b <= r.v and r.v - r.b <= r.v / 32


def test_keep_good_keeps_columns_even_with_clashing_names(spark):
    table = docs(spark).withColumn("n_words", F.lit("own")).withColumn("kept", F.lit(7)).withColumn("_text", F.lit(1))
    out = quality.keep_good(table)
    assert out.columns == table.columns and {(r.n_words, r.kept, r["_text"]) for r in out.collect()} == {("own", 7, 1)}
    good = Counter(r.doc_id for r in quality.judge(docs(spark)).filter("kept").collect())
    assert good == Counter(r.doc_id for r in out.collect())


def test_empty_tables(spark):
    none = docs(spark, [])
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    assert lines.drop_repeated_lines(none).count() == 0


def digest_rows(df):
    done = lines.apply_bitmaps(df, lines.keep_bitmaps(df))
    out = done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    return Counter(map(tuple, out.collect()))


def test_line_bitmaps_equal_brute_force(spark):
    want = Counter(brute.kept_lines([(r[0], r[1]) for r in rows()]))
    assert digest_rows(docs(spark).select("doc_id", "text")) == want
    assert sum(k[2] for k in want) > 5


def test_common_line_over_many_partitions(spark):
    line = "a line of more than forty characters that every document has"
    data = [(i, f"{line}\nown {i}\n{line}" if i % 3 else f"{line} {i % 7}\nx", None, None, 0) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = digest_rows(docs(spark, data).select("doc_id", "text"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == Counter(brute.kept_lines([(r[0], r[1]) for r in data]))


def test_stream_in_small_batches(spark):
    line = "another line of more than forty characters shared by all"
    data = [(i // 2, "\n".join([line] * (i % 4)), None, None, 0) for i in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = digest_rows(docs(spark, data).select("doc_id", "text"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter(brute.kept_lines([(r[0], r[1]) for r in data]))


def test_bitmap_round_trip():
    for n, gone in ((1, [0]), (9, [8]), (9, [3]), (40, [0, 39]), (17, list(range(17)))):
        bits = lines.unpack_bitmap(lines.pack_bitmap(n, gone), n + 5)
        assert [i for i, b in enumerate(bits) if not b] == gone


def test_drop_repeated_lines_keeps_columns(spark):
    table = docs(spark).withColumn("n_lines", F.lit("own")).withColumn("row_key", F.lit(1))
    out = lines.drop_repeated_lines(table)
    assert out.columns == table.columns and out.count() == table.count() and SCHEMA
    assert {r.n_lines for r in out.collect()} == {"own"}
