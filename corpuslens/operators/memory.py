"""Review memory: retention, feedback, acceptance, learned patterns, similar findings; tool-call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.windows import join_null_safe, top_per_group

RETAINED = 1000
# Feedback that counts as accepted, rates without feedback, bounds of confidence.
ACCEPTED = ["accepted", "fixed"]
NEUTRAL_RATE = 0.5
MAX_CONFIDENCE = 0.95
# Calls allowed per tool and reviewed file.
TOOL_BUDGETS = {"search": 5, "test": 3, "related": 3, "usages": 3, "callers": 2}
CACHE_MINUTES = 30


def retain(memory: DataFrame, n: int = RETAINED) -> DataFrame:
    """The latest ``n`` entries of each repository."""
    return top_per_group(memory, ["repo"], [F.col("ts").desc(), F.col("issue_id").desc()], n)


def apply_feedback(memory: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set each entry's feedback to the last one given (by time, then sequence)."""
    last = feedback.groupBy("issue_id").agg(F.max_by("feedback", F.struct("ts", "seq")).alias("_new"))
    return memory.join(last, "issue_id", "left").withColumn("feedback", F.coalesce("_new", "feedback")).drop("_new")


def _accepted() -> Column:
    return F.col("feedback").isin(ACCEPTED)


def _rate(none: float) -> Column:
    given = F.count("feedback")
    return F.round(F.coalesce(F.try_divide(F.count_if(_accepted()), given), F.lit(none)), 6)


def acceptance_rate(memory: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of accepted or fixed among entries with feedback, 0.5 when there are none."""
    return memory.groupBy(*(by or ["type", "severity"])).agg(
        F.count("feedback").alias("with_feedback"), _rate(NEUTRAL_RATE).alias("acceptance_rate")
    )


def memory_stats(memory: DataFrame) -> DataFrame:
    """Entries, entries with feedback and the acceptance rate (0 when there is no feedback)."""
    return memory.agg(
        F.count(F.lit(1)).alias("total_reviews"), F.count("feedback").alias("with_feedback"),
        _rate(0.0).alias("acceptance_rate"),
    )


def top_issue_types(memory: DataFrame, n: int = 5) -> DataFrame:
    return memory.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(n)


def learned_patterns(memory: DataFrame, feedback: DataFrame, by_repo: bool = False) -> DataFrame:
    """Per ``type:severity``: feedback events, acceptance, confidence and time last seen.

    The running mean over events is their plain mean, so one aggregation gives it.
    """
    keys = ["repo", "pattern"] if by_repo else ["pattern"]
    entries = memory.select("issue_id", "repo", F.concat_ws(":", "type", "severity").alias("pattern"))
    seen = feedback.select("issue_id", "feedback", "ts").join(entries, "issue_id")
    rate = F.round(F.avg(_accepted().cast("double")), 6)
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"), rate.alias("acceptance_rate"), F.max("ts").alias("last_seen")
    ).withColumn("confidence", F.round(F.least(F.lit(MAX_CONFIDENCE), F.col("acceptance_rate") * 0.9 + 0.1), 6))


def memory_export(memory: DataFrame, patterns: DataFrame) -> DataFrame:
    """One JSON row with statistics and patterns; both are bounded by the number of types and severities."""
    stats = memory_stats(memory).withColumn("_one", F.lit(1))
    listed = F.array_sort(F.collect_list(F.struct("pattern", "occurrences", "acceptance_rate", "confidence")))
    rows = patterns.agg(listed.alias("patterns")).withColumn("_one", F.lit(1))
    return stats.join(F.broadcast(rows), "_one").select(
        F.to_json(
            F.struct(F.struct("total_reviews", "with_feedback", "acceptance_rate").alias("stats"), "patterns")
        ).alias("export")
    )


def similar_issues(issues: DataFrame, memory: DataFrame, k: int = 5) -> DataFrame:
    """Newest past findings of the same type in files of the same ending and about the same depth.

    Depth may differ by one. Each (type, ending, depth) keeps its newest k once, these are offered to the
    three depths they fit, cut to k again, and met by equality: no finding is compared with all others.
    """
    def shape(file):
        return {"_ext": P.extension(file), "_depth": F.size(F.split(file, "/"))}

    newest = [F.col("past_ts").desc(), F.col("past_id")]
    past = memory.select(
        "type", F.col("issue_id").alias("past_id"), F.col("ts").alias("past_ts"), F.col("file").alias("past_file")
    ).withColumns(shape(F.col("past_file")))
    keys = ["type", "_ext", "_depth"]
    own = top_per_group(past, keys, newest, k)
    offered = own.withColumn(
        "_depth", F.explode(F.array(F.col("_depth") - 1, F.col("_depth"), F.col("_depth") + 1))
    )
    answer = top_per_group(offered, keys, newest, k)
    asked = issues.select("issue_id", "file", "type").withColumns(shape(F.col("file")))
    return asked.join(answer, keys).select("issue_id", "past_id", "past_file", "past_ts")


# ---------------------------------------------------------------- tool-call logs


def _order() -> Column:
    return F.struct("ts", "call_id")


def replay_calls(calls: DataFrame, ttl_minutes: float = CACHE_MINUTES, budgets: dict | None = None) -> DataFrame:
    """Outcome of every tool call: ``hit``, ``miss`` or ``refused``.

    Per session and tool, a call is a miss when its key is new or the session's cache has expired
    (``ttl_minutes`` after its first call, never revived). Only misses use the budget; once it is used up,
    cached keys are refused too. Null sessions, tools and keys are keys like others; a tool without a limit is
    never refused. The call that uses up the budget is found as the n-th miss, so no session
    is replayed row by row.
    """
    limits = budgets or TOOL_BUDGETS
    limit = F.create_map(*[F.lit(x) for item in limits.items() for x in item])[F.col("tool")]
    keys = ["session", "tool"]
    starts = calls.groupBy("session").agg(F.min("ts").alias("_start"))
    firsts = calls.groupBy(*keys, "search_key").agg(F.min(_order()).alias("_first"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))
    marked = (
        join_null_safe(join_null_safe(calls, starts, ["session"]), firsts, [*keys, "search_key"])
        .withColumn("_miss", (_order() == F.col("_first")) | (age > ttl_minutes * 60_000_000))
    )
    last_paid = (
        top_per_group(marked.filter("_miss"), keys, [F.col("ts"), F.col("call_id")], max(limits.values()))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(_order())).alias("_paid"))
        .withColumn("_limit", limit)
        .select(*keys, F.when(F.size("_paid") >= F.col("_limit"), F.try_element_at("_paid", F.col("_limit"))).alias("_last"))
    )
    refused = F.coalesce(_order() > F.col("_last"), F.lit(False))
    outcome = F.when(refused, "refused").when(F.col("_miss"), "miss").otherwise("hit")
    return join_null_safe(marked, last_paid, keys, "left").select(*calls.columns, outcome.alias("outcome"))


def cache_hits(calls: DataFrame, ttl_minutes: float = CACHE_MINUTES) -> DataFrame:
    """Whether each call finds its key in the session's cache, budgets aside."""
    starts = calls.groupBy("session").agg(F.min("ts").alias("_start"))
    firsts = calls.groupBy("session", "search_key").agg(F.min(_order()).alias("_first"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))
    found = join_null_safe(join_null_safe(calls, starts, ["session"]), firsts, ["session", "search_key"])
    hit = (_order() != F.col("_first")) & (age <= ttl_minutes * 60_000_000)
    return found.select(*calls.columns, F.coalesce(hit, F.lit(False)).alias("hit"))


def cache_metrics(replayed: DataFrame) -> DataFrame:
    """Hits, misses, calls made and the duration of the last call made, per session."""
    made = F.col("outcome") == "miss"
    return replayed.groupBy("session").agg(
        F.count_if(F.col("outcome") == "hit").alias("cache_hits"),
        F.count_if(made).alias("cache_misses"),
        F.count_if(made).alias("calls"),
        F.max_by(F.when(made, F.col("duration_ms")), F.when(made, _order())).alias("last_duration_ms"),
    )
