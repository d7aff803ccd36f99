"""Quality rules whose cutoffs adapt to each language and source.

Counts per text become integer rates. The rates of every (lang, source) are summarised in quantile
sketches, from which a fence per rate is read; documents outside a fence, and those that fail two fixed
base rules, are rejected. Expressions only, no Python code on the executors.

The sketch is a log-linear histogram: a rate falls into the bucket made of its leading ``SKETCH_BITS``
bits, so a quantile is off by less than one part in ``2 ** (SKETCH_BITS - 1)``. Sketches are rows
(lang, source, rate, bucket, n); two sketches merge by adding ``n``, in any order, with the same result.

A group is judged by a blend: its own documents and ``PRIOR_DOCS`` more that are spread like its language's, as
a language's are blended with ``PRIOR_DOCS`` spread like all documents'. So a small group leans on its language
and a large one on itself, without a size at which the rule changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.let import let
from corpuslens.functions.windows import join_null_safe
from corpuslens.llm.common import SPACES, whole_text, words_of, written

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SKETCH_BITS = 6
# Rate -> least distance of its fence from the median, in thousandths.
LEAST_SPREAD = {
    "symbol_rate": 100,  # symbols a word
    "length_rate": 2500,  # characters a word
    "dup_line_rate": 500,  # repeated lines a line
    "repeat_rate": 150,  # repeated words a word
    "upper_rate": 250,  # capital letters a character of a word
}
FENCE_WIDTH = 4  # interquartile ranges beyond the upper quartile
# LEAST_SPREADs above the median (and twice FENCE_WIDTH lower half ranges) that no fence passes: one symbol a word,
# 25 characters a word; the other rates cannot get there.
MOST_SPREADS = 10
PRIOR_DOCS = 50  # so many documents of the language's distribution count with those of each of its sources
BASE_COUNTS = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(grams: Column, size: int = WINDOW_WORDS) -> Column:
    """How many words lie in a window that occurs twice or more; ``grams`` holds the key of each window."""
    found = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = let(found, lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    reach = let(
        starts,
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))),
            F.lit(0),
            lambda total, n: total + n,
        ),
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(reach)


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of each whole text; a null text counts as empty. No shuffle.

    Counts: n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words,
    n_upper (capital letters). A count has the type long.
    """
    text = F.col("_text")
    cut = docs.select(*keep, whole_text(F.col("text")).alias("_text")).select(
        *keep,
        words_of(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
    )
    gram = lambda word, i: F.xxhash64(word, *[F.get("_words", i + j) for j in range(1, WINDOW_WORDS)])
    n = F.size("_words")
    grams = F.when(
        n >= WINDOW_WORDS,
        F.slice(F.transform("_words", gram), F.lit(1), F.greatest(n - (WINDOW_WORDS - 1), F.lit(0))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = cut.select(
        *keep,
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        grams.alias("_grams"),
    )
    longs = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper"]
    return counted.select(
        *keep,
        *[F.col(c).cast("long").alias(c) for c in longs],
        repeated_words(F.col("_grams")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Integer rates in thousandths; null where there is nothing to divide by."""
    per = lambda part, whole: F.expr(f"1000 * {part} div nullif({whole}, 0)")
    return {
        "symbol_rate": per("n_symbols", "n_words"),
        "length_rate": per("word_chars", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
    }


def bucket_of(value: Column) -> Column:
    """Least value of the sketch bucket that ``value`` falls into."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    scale = F.pow(F.lit(2.0), drop).cast("long")
    return value - value % scale


def sketch(counts: DataFrame) -> DataFrame:
    """Rows (lang, source, rate, bucket, n), added up before they are shuffled."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in rates().items()])
    return (
        counts.select("lang", "source", F.explode(pairs).alias("p"))
        .select("lang", "source", "p.rate", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("lang", "source", "rate", bucket_of(F.col("value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to coarser ``keys``."""
    return sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def blend(sketches: DataFrame, keys: list[str], prior: DataFrame, shared: list[str]) -> DataFrame:
    """(keys, rate, bucket, w, total): the shares w / total of each group, blended with those of ``prior``.

    ``prior`` has w and total by ``shared`` keys, rate and bucket. Shares are kept as whole numbers, so that the
    result does not depend on the order of any sum.
    """
    own = merge(sketches, keys)
    groups = own.groupBy(*keys, "rate").agg(F.sum("n").cast("decimal(38,0)").alias("docs"))
    every = join_null_safe(groups, prior, [*shared, "rate"])
    counted = join_null_safe(every, own, [*keys, "rate", "bucket"], "left")
    weight = F.coalesce("n", F.lit(0)).cast("decimal(38,0)") * F.col("total") + PRIOR_DOCS * F.col("w")
    return counted.select(
        *keys, "rate", "bucket", weight.cast("decimal(38,0)").alias("w"),
        (F.col("total") * (F.col("docs") + PRIOR_DOCS)).cast("decimal(38,0)").alias("total"),
    )


def fences(shares: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: the fence and the bound of each rate, from (keys, rate, bucket, w, total).

    A fence lies ``FENCE_WIDTH`` interquartile ranges above the upper quartile, and at least
    ``LEAST_SPREAD`` above the median. The bound is made of the median and the range below it only, so it holds
    while less than half of the group is junk.
    """
    upto = Window.partitionBy(*keys, "rate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = shares.withColumn("upto", F.sum("w").over(upto))
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("total"), F.col("bucket")))
    quarters = ranked.groupBy(*keys, "rate").agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    spread = F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair])[F.col("rate")]
    spread = spread.cast("long")
    bound = F.col("q2") + 2 * FENCE_WIDTH * (F.col("q2") - F.col("q1")) + MOST_SPREADS * spread
    fence = F.greatest(F.col("q3") + FENCE_WIDTH * (F.col("q3") - F.col("q1")), F.col("q2") + spread)
    return (
        quarters.withColumn("fence", fence).withColumn("bound", bound)
        .groupBy(*keys)
        .agg(
            *[F.max(F.when(F.col("rate") == k, F.col("fence"))).alias(f"max_{k}") for k in LEAST_SPREAD],
            *[F.max(F.when(F.col("rate") == k, F.col("bound"))).alias(f"bound_{k}") for k in LEAST_SPREAD],
        )
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """Fences of each (lang, source), within the bound of the language, so that a source of junk does not set its
    own rule."""
    merged = merge(sketches, [])
    totals = merged.groupBy(F.col("rate").alias("_rate")).agg(F.sum("n").cast("decimal(38,0)").alias("total"))
    whole = merged.join(totals, F.col("rate") == F.col("_rate")).select(
        "rate", "bucket", F.col("n").cast("decimal(38,0)").alias("w"), "total"
    )
    by_lang = written(blend(sketches, ["lang"], whole, []), "quality-languages")
    own = fences(blend(sketches, ["lang", "source"], by_lang, ["lang"]), ["lang", "source"])
    wide = fences(by_lang, ["lang"]).select(
        F.col("lang").alias("_lang"), *[F.col(f"bound_{k}").alias(f"limit_{k}") for k in LEAST_SPREAD]
    )
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    return both.select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        *[F.least(f"max_{k}", f"limit_{k}").alias(f"max_{k}") for k in LEAST_SPREAD],
    )


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), the counts, base_failed and kept.

    The counts are made once and written to the shared folder; sketches and verdicts read them there.
    The thresholds are a written table too, so that the join broadcasts them only if their measured size
    is under the session's limit; otherwise they are joined by (lang, source).

    Null texts count as empty and fail the base rules; null languages and sources are groups of their
    own; repeated rows are judged alike, each stays a row; an empty table gives an empty table; columns
    named like a count are replaced by it.
    """
    made = ["n_words", *BASE_COUNTS, "n_lines", "n_upper", "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and not c.startswith("_")]
    need = list(dict.fromkeys([*keep, "lang", "source"]))
    counts = written(text_counts(docs, need), "text-counts")
    cutoffs = written(thresholds(written(sketch(counts), "quality-sketches")), "quality-cutoffs")
    inside = F.lit(True)
    for name, rate in rates().items():
        inside = inside & F.coalesce(rate <= F.col(f"max_{name}"), F.lit(True))
    joined = counts.join(
        cutoffs,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    return joined.withColumn("base_failed", base_failed()).select(
        *keep,
        "n_words",
        *BASE_COUNTS,
        "n_lines",
        "n_upper",
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    hidden = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns], "lang", "source", "text")
    judged = judge(hidden, [f"in_{c}" for c in docs.columns]).filter("kept")
    return judged.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
