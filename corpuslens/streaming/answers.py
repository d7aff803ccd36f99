"""Model answers as streams: text grows with its deltas and is emitted when the answer ends or stalls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslens.operators.deltas import parse_sse_lines, progress_state

OUTPUT = "stream_id long, text string, reasoning string, chunk_count long, finished boolean"
# Joined text up to the first missing line, then what came early; ``done`` answers wait for redelivered lines.
STATE = (
    "following long, text string, reasoning string, n long, done boolean, "
    "seqs array<long>, parts array<long>, types array<string>, deltas array<string>"
)
CONTENT, THOUGHT, STOP, LINE = "content_delta", "reasoning_delta", "message_stop", "line"


def _step(idle_ms: int | None):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, text, reasoning, n, done, *lists = state.get if state.exists else (0, "", "", 0, False, [], [], [], [])
        if done and state.hasTimedOut:
            state.remove()
            return
        early = set(zip(*lists, strict=True)) if lists[0] else set()
        for pdf in batches:
            if not done:
                rows = zip(pdf["seq"].tolist(), pdf["part"].tolist(), pdf["type"].tolist(), pdf["delta"].tolist(), strict=True)
                early |= {row for row in rows if row[0] >= following}
        waiting, texts, thoughts, finished = sorted(early, key=lambda r: r[:2]), [text], [reasoning], False
        used = 0
        for seq, _, kind, delta in waiting:
            if seq > following and not state.hasTimedOut:
                if seq > following + 1 or not used:
                    break
            following = seq
            texts += [delta or ""] if kind == CONTENT else []
            thoughts += [delta or ""] if kind == THOUGHT else []
            n += kind != LINE
            used += 1
            finished |= kind == STOP
        left = waiting[used:]
        following += bool(used)
        text, reasoning = "".join(texts), "".join(thoughts)
        if finished or (state.hasTimedOut and not done):
            yield pd.DataFrame([(key[0], text, reasoning, n, finished)], columns=[c.split()[0] for c in OUTPUT.split(", ")])
            done, text, reasoning, left = True, "", "", []
        state.update((following, text, reasoning, n, done, *[list(c) for c in (zip(*left, strict=True) if left else [[]] * 4)]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return step


def answers(events: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """One row per answer from a stream of parsed events (stream_id, seq, part, type, delta).

    Lines are numbered from 0 without gaps; a line without an event is sent as one of type "line". Text
    grows with the lines in order, whatever the order of arrival, and an answer ends once every line up to
    its stop is there. Repeated lines change nothing, and lines that come after the end make no second
    answer. State is the text so far and the early lines; of an ended answer only a mark stays. With
    ``idle_ms``, an answer that stays silent for so long is emitted unfinished, with the early lines too, and
    marks are dropped after the same time. With ``None`` there is no timer and marks stay: a timer keeps an
    ``availableNow`` query running, so bounded runs go without.
    """
    timer = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return (
        events.select("stream_id", "seq", "part", "type", "delta")
        .groupBy("stream_id")
        .applyInPandasWithState(_step(idle_ms), OUTPUT, STATE, "append", timer)
    )


def answers_from_lines(lines: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """Answers from raw streamed lines (stream_id, seq, raw), numbered from 0."""
    events = parse_sse_lines(lines, "raw", ["stream_id", "seq"]).select("stream_id", "seq", "part", "type", "delta")
    seen = lines.select(
        "stream_id", "seq", F.lit(-1).alias("part"), F.lit(LINE).alias("type"), F.lit(None).cast("string").alias("delta")
    )
    return answers(events.unionByName(seen), idle_ms)


def progress(events: DataFrame) -> DataFrame:
    """Progress of reviews on a stream: the batch aggregation, kept in state and sent in update mode."""
    return progress_state(events)
