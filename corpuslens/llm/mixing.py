"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``MAX_COPIES`` that give every source its target of words, the
rates closest in entropy to "each document once" are an exponential tilt of the document size,

    rate / (MAX_COPIES - rate) = exp(lambda * size / mean size) / (MAX_COPIES - 1),

with one multiplier a source. The multipliers solve a convex dual; Newton steps, kept inside a bracket,
find them. A step is one aggregation over rows (source, size, number of documents), which are far fewer
than documents and are dealt by source once. Expressions only, no Python code on the executors.

Rates become copies by error diffusion over the sizes of a source, and the small rest that rounding leaves
is made up with single documents, the largest that fit first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import windows
from corpuslens.llm.common import one_row, position_in_group, text_key, word_count, written
from corpuslens.operators.search import checked_broadcast
from corpuslens.session import cut_lineage

MAX_COPIES = 3
TOLERANCE = 1e-7  # of a source's target
MAX_STEPS = 60
RANK_ROWS = 100_000  # documents of one (source, size) ranked in one task
REPEATED_ROWS = 100_000  # of equal rows that one task writes out
MENDS = 5  # passes that make up the rest of rounding


def cycled_weights(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh ``weights``, repeating.

    One row per source goes through one task.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.lit(None).cast("double")
    for k, weight in enumerate(weights):
        choice = F.when(turn % len(weights) == k, F.lit(float(weight))).otherwise(choice)
    return totals.select("source", choice.alias("weight"))


def targets(totals: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size) and (source, weight).

    The targets share the sum of all sizes by weight. Where one is above ``MAX_COPIES`` times its source's
    size it stops there, and the excess is shared again among the others; a source without weight gets 0.
    """
    named = weights.select(F.col("source").alias("_source"), "weight")
    table = (
        totals.join(named, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select(
            "source",
            "source_size",
            F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"),
            (F.col("source_size") * MAX_COPIES).cast("double").alias("most"),
            F.lit(False).alias("full"),
        )
        .transform(lambda df: written(df, "mix-sources"))
    )
    while True:
        now = one_row(
            table.agg(
                F.sum("source_size").alias("size"),
                F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0.0)).alias("used"),
                F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)).alias("weight"),
                F.count(F.when(F.col("full"), 1)).alias("n_full"),
            )
        )
        unit = ((now["size"] or 0) - now["used"]) / now["weight"] if now["weight"] else 0.0
        above = F.col("full") | (F.col("weight") * unit > F.col("most"))
        if one_row(table.agg(F.count(F.when(above, 1)).alias("n")))["n"] == now["n_full"]:
            break
        table = cut_lineage(table.withColumn("full", above))
    share = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * unit)
    return table.select("source", "source_size", share.alias("target"), "full")


def rate(tilt: Column, scaled: Column) -> Column:
    return MAX_COPIES / (1 + (MAX_COPIES - 1) * F.exp(-tilt * scaled))


def solve(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, tilt): Newton steps on the dual, all sources in each step.

    ``sizes``: (source, size, n); ``goals``: (source, source_size, target, full). A source that is full has
    no finite tilt and is left out, as is one without words.
    """
    docs_of = sizes.groupBy("source").agg(F.sum("n").alias("docs"))
    named = docs_of.select(F.col("source").alias("_source"), "docs")
    open_goals = goals.filter(~F.col("full") & (F.col("source_size") > 0) & (F.col("target") > 0))
    odds = (MAX_COPIES - 1) * F.col("ratio") / (MAX_COPIES - F.col("ratio"))
    state = cut_lineage(
        open_goals.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("ratio", F.col("target") / F.col("source_size"))
        .select(
            F.coalesce("source", F.lit("")).alias("name"),
            F.col("source").isNull().alias("no_name"),
            "target",
            (F.col("source_size") / F.col("docs")).alias("mean_size"),
            F.log(odds).alias("tilt"),
            F.lit(float("-inf")).alias("low"),
            F.lit(float("inf")).alias("high"),
            F.lit(1.0).alias("error"),
        )
        .repartition("name", "no_name")
    )
    dealt = cut_lineage(
        sizes.filter("size > 0")
        .select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "size", "n")
        .repartition("name", "no_name")
    )
    keys = ["name", "no_name"]
    for _ in range(MAX_STEPS):
        scaled = F.col("size") / F.col("mean_size")
        r = rate(F.col("tilt"), scaled)
        words = F.col("n") * F.col("size")
        sums = (
            dealt.join(state, keys)
            .groupBy(*keys)
            .agg(
                *[F.first(c).alias(c) for c in ("target", "mean_size", "tilt", "low", "high")],
                F.sum(words * r).alias("got"),
                F.sum(words * scaled * r * (1 - r / MAX_COPIES)).alias("slope"),
            )
        )
        over = F.col("got") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.col("slope")
        reach = F.greatest(F.abs(F.col("tilt")), F.lit(1.0))
        inside = (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 4 * reach)
        middle = (
            F.when(low == float("-inf"), F.col("tilt") - 2 * reach)
            .when(high == float("inf"), F.col("tilt") + 2 * reach)
            .otherwise((low + high) / 2)
        )
        error = F.abs(F.col("got") / F.col("target") - 1)
        state = cut_lineage(
            sums.select(
                *keys,
                "target",
                "mean_size",
                F.when(error <= TOLERANCE, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
                low.alias("low"),
                high.alias("high"),
                error.alias("error"),
            )
        )
        worst = one_row(state.agg(F.max("error").alias("error")))["error"]
        if worst is None or worst <= TOLERANCE:
            break
    name = F.when(~F.col("no_name"), F.col("name"))
    return state.select(name.alias("source"), "mean_size", "tilt")


def copy_plan(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, n, copies, more): each document ``copies`` times, and ``more`` of the n once more."""
    tilts = solve(sizes, goals).select(F.col("source").alias("_s1"), "mean_size", "tilt")
    goal = goals.select(F.col("source").alias("_s2"), "target", "full")
    rated = (
        sizes.join(goal, F.col("source").eqNullSafe(F.col("_s2")))
        .join(tilts, F.col("source").eqNullSafe(F.col("_s1")), "left")
        .withColumn(
            "rate",
            F.when(F.col("size") == 0, F.lit(1.0))
            .when(F.col("full"), F.lit(float(MAX_COPIES)))
            .when(F.col("tilt").isNull(), F.lit(0.0))
            .otherwise(rate(F.col("tilt"), F.col("size") / F.col("mean_size"))),
        )
        .withColumn("copies", F.least(F.floor("rate"), F.lit(MAX_COPIES)))
        .withColumn("wanted", F.col("n") * (F.col("rate") - F.col("copies")))
    )
    falling = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    upto = F.sum("wanted").over(falling)
    rounded = rated.withColumn("upto", upto).withColumn(
        "more", (F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("wanted") + 0.5))
    )
    rounded = rounded.withColumn("more", F.least(F.greatest("more", F.lit(0)), F.col("n")).cast("long"))
    for _ in range(MENDS):
        rounded = mend(rounded)
    return rounded.select("source", "size", "n", F.col("copies").cast("long").alias("copies"), "more")


def mend(plan: DataFrame) -> DataFrame:
    """``plan`` with the rest to the target made up by sizes that fit into it, the largest first.

    The size at which the rest runs out leaves less than itself; the next pass goes on with smaller sizes.
    """
    taken = F.col("size") * (F.col("n") * F.col("copies") + F.col("more"))
    open_plan = plan.withColumn("rest", F.col("target") - F.sum(taken).over(Window.partitionBy("source")))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest"))
    spare = F.when(F.col("copies") < MAX_COPIES, F.col("n") - F.col("more")).otherwise(F.lit(0))
    room = F.when(fits, F.when(F.col("rest") > 0, spare).otherwise(F.col("more"))).otherwise(F.lit(0))
    falling = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    open_plan = open_plan.withColumn("room", room.cast("long"))
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(falling), F.lit(0))
    units = F.floor((F.abs("rest") - before) / F.greatest("size", F.lit(1))).cast("long")
    moved = F.least(F.greatest(units, F.lit(0)), F.col("room")) * F.signum("rest").cast("long")
    return open_plan.withColumn("more", F.col("more") + moved).drop("rest", "room")


KEYS = ["doc_id", "key", "source", "size"]


def decide(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, source, size) of ``rows``, each once, with source_size, target, m, copies and extra.

    m equal rows are taken ``copies`` times each, and ``extra`` of them once more. Which of the documents of one
    source and size get one copy more is decided by a hash of id and key, so reruns agree.
    """
    once = written(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("m")), "mix-documents")
    sizes = written(once.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    totals = written(totals, "mix-totals")
    goals = written(targets(totals, cycled_weights(totals) if weights is None else weights), "mix-goals")
    plan = copy_plan(sizes, goals).select(
        F.col("source").alias("_ps"), F.col("size").alias("_pz"), F.col("n").alias("_n"), "copies", F.col("more").alias("_more")
    )
    goal = goals.select(F.col("source").alias("_gs"), "source_size", "target")
    plan = written(
        plan.join(goal, F.col("_ps").eqNullSafe(F.col("_gs"))).drop("_gs"), "mix-plan"
    )
    joined = once.join(plan, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("size") == F.col("_pz"))).drop("_ps", "_pz")
    joined = joined.withColumn("_draw", F.xxhash64("doc_id", "key"))
    bucket = F.pmod("_draw", F.ceil(F.col("_n") / RANK_ROWS))
    placed = position_in_group(joined, ["source", "size"], bucket, ["_draw", "doc_id", "key"], "_place", F.col("m"))
    extra = F.least(F.greatest(F.col("_more") - F.col("_place"), F.lit(0)), F.col("m"))
    return placed.withColumn("extra", extra.cast("long")).drop("_n", "_more", "_draw", "_place")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "source", word_count(F.col("text")).alias("size"))


def mix_report(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of all copies) of every document.

    A null or empty text has size 0 and takes nothing; a null source is a source of its own; of repeated rows each
    is decided for itself; an empty table gives an empty table.
    """
    decided = written(decide(written(sized(docs), "mix-rows"), weights), "mix-decisions")
    single = decided.filter("m = 1").withColumn("copies", F.col("copies") + F.col("extra"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATED_ROWS))
    dealt = decided.filter("m > 1").withColumn("_part", F.explode(parts)).repartition("doc_id", "key", "_part")
    first = F.col("_part") * REPEATED_ROWS
    turns = F.sequence(first, F.least(first + REPEATED_ROWS, F.col("m")) - 1)
    repeated = dealt.withColumn("_turn", F.explode(turns))
    repeated = repeated.withColumn("copies", F.col("copies") + (F.col("_turn") < F.col("extra")).cast("long"))
    return single.unionByName(repeated.drop("_part", "_turn")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns they came with.

    The texts move once, to meet their number of copies by id and key; rows repeated with id, text and source are
    numbered in the order of a hash of all their columns.
    """
    decided = written(decide(written(sized(docs), "mix-rows"), weights), "mix-decisions")
    taken = decided.filter("copies + extra > 0").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("source").alias("_src"), "m",
        F.col("copies").alias("_copies"), F.col("extra").alias("_extra"),
    )

    def of(choice: DataFrame) -> DataFrame:
        same = (
            F.col("doc_id").eqNullSafe(F.col("_id"))
            & (text_key(F.col("text")) == F.col("_key"))
            & F.col("source").eqNullSafe(F.col("_src"))
        )
        return hidden.join(choice, same)

    names = [f"_in{k}" for k in range(len(docs.columns))]
    own = [F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]
    hidden = docs.select(*own, "doc_id", "text", "source")
    # only where some of m equal rows are taken once more than the others must the rows be told apart
    some = (F.col("_extra") > 0) & (F.col("_extra") < F.col("m"))
    alike = taken.filter(~some).withColumn("_copies", F.col("_copies") + (F.col("_extra") > 0).cast("long"))
    copied = of(alike.select("_id", "_key", "_src", "_copies")).select(*names, "_copies")
    told = checked_broadcast(taken.filter(some).drop("m"))
    if not told.isEmpty():
        several = of(told).withColumn("_hash", F.xxhash64(*names))
        several = windows.position_in_group(several, ["_id", "_key", "_src"], [F.col("_hash")], "_turn")
        several = several.withColumn("_copies", F.col("_copies") + (F.col("_turn") <= F.col("_extra")).cast("long"))
        copied = copied.unionByName(several.select(*names, "_copies"))
    copied = copied.filter("_copies > 0")
    copied = copied.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return copied.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
