"""Review activity over time: repeated events dropped, tumbling or sliding windows, sessions.

Every function takes a batch or a streaming table of events (event_id, ts and the named columns). On a stream
the watermark bounds the state: an event later than ``delay`` behind the newest one is too late for its window,
and repeats are recognised as long as they come within ``delay``. A batch counts every event.

Events without a time belong to no window. Equal rows without an id are repeats of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


WIDTH = "1 hour"
GAP = "30 minutes"
DELAY = "10 minutes"


def distinct_events(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event once. Of a batch's rows with one id the first in the order of their values stays."""
    columns = events.columns
    whole = F.md5(F.to_json(F.struct(*columns)))
    known = events.filter(F.col("ts").isNotNull()).withColumn(
        "_event", F.coalesce(F.concat(F.lit("id:"), F.col("event_id").cast("string")), whole)
    )
    if events.isStreaming:
        return known.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_event"]).drop("_event")
    first = known.groupBy("_event").agg(F.min(F.struct(*columns)).alias("_row"))
    return first.select("_row.*")


def measures(value: str | None) -> list[Column]:
    """Events and, if a value column is named, its sum in hundredths: whole numbers add up in any order."""
    total = [F.sum(F.round(F.col(value) * 100).cast("long")).alias("total_cents")] if value else []
    return [F.count(F.lit(1)).alias("n_events"), *total]


def activity_windows(
    events: DataFrame, keys: list[str], width: str = WIDTH, slide: str | None = None, value: str | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """One row per key and window with events: keys, window_start, window_end, n_events and total_cents.

    Counts are combined before the shuffle, so a window or key that holds most events is no bottleneck.
    """
    slot = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = distinct_events(events, delay).groupBy(*keys, slot).agg(*measures(value))
    named = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return counted.select(*keys, *named, *[c for c in counted.columns if c not in (*keys, "window")])


def activity_sessions(
    events: DataFrame, keys: list[str], gap: str = GAP, value: str | None = None, delay: str = DELAY
) -> DataFrame:
    """One row per run of events of a key that lie at most ``gap`` apart; ``session_end`` is the last one plus ``gap``.

    A stream uses the session window of the engine. A batch first counts events in slots as wide as the gap:
    events of one slot always share a session, so what a key with most of the rows sends on is bounded by its
    slots, and only those are put in order.
    """
    once = distinct_events(events, delay)
    if events.isStreaming:
        counted = once.groupBy(*keys, F.session_window("ts", gap)).agg(*measures(value))
        named = [F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end")]
        return counted.select(*keys, *named, *[c for c in counted.columns if c not in (*keys, "session_window")])
    length = F.expr(f"interval '{gap}'")
    slots = once.groupBy(*keys, F.window("ts", gap)).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), *measures(value)
    )
    order = Window.partitionBy(*keys).orderBy("_first")
    before = F.lag("_last").over(order)
    marked = slots.withColumn("_new", (before.isNull() | (F.col("_first") > before + length)).cast("long"))
    numbered = marked.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = [F.sum(c).alias(c) for c in ("n_events", "total_cents") if c in slots.columns]
    return (
        numbered.groupBy(*keys, "_session")
        .agg(F.min("_first").alias("session_start"), (F.max("_last") + length).alias("session_end"), *totals)
        .drop("_session")
    )
