"""Token streams of models: parsing of streamed lines, reassembly of answers, progress of a review.

All functions here are plain DataFrame transformations; parsing and progress work on streams as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.let import let

from corpuslens.functions.let import open_array

SEGMENT = 1024
# Kinds of reasoning chunks and of closing chunks.
REASONING_KINDS = ["reasoning-delta", "reasoning", "thinking-delta", "reasoning_delta"]
FINISH_KINDS = ["step-finish", "finish"]

LINE = (
    "choices array<struct<delta:struct<content:string,reasoning:string>,finish_reason:string>>,"
    "type string, delta struct<text:string>, stop_reason string,"
    "usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>, _broken string"
)
BROKEN = {"columnNameOfCorruptRecord": "_broken"}


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def sse_events(data: Column) -> Column:
    """Events of one parsed line: reasoning, content and stop, in that order."""
    first = F.try_element_at(data["choices"], F.lit(1))
    delta = first["delta"]
    ended = (data["type"] == "message_stop") | _filled(first["finish_reason"])
    usage = F.when(F.size(data["choices"]) > 0, data["usage"])

    def event(kind, text, reason=None):
        return F.struct(
            F.lit(kind).alias("type"), text.alias("delta"),
            (reason if reason is not None else F.lit(None).cast("string")).alias("stop_reason"), usage.alias("usage"),
        )

    reason = F.coalesce(
        F.nullif(data["stop_reason"], F.lit("")), F.nullif(first["finish_reason"], F.lit("")), F.lit("end_turn")
    )
    vendor_text = F.when(data["type"] == "content_block_delta", data["delta"]["text"])
    events = F.array_compact(
        F.array(
            F.when(_filled(delta["reasoning"]), event("reasoning_delta", delta["reasoning"])),
            F.when(_filled(delta["content"]), event("content_delta", delta["content"])),
            F.when(_filled(vendor_text), event("content_delta", vendor_text)),
            F.when(ended, event("message_stop", F.lit(""), reason)),
        )
    )
    return F.when(data["_broken"].isNull(), events)


def parse_sse_lines(lines: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Events of single streamed lines (batch or stream); other lines and broken JSON give nothing."""
    line = F.trim(F.regexp_replace(F.col(raw), r"\r$", ""))
    body = F.when(line.startswith("data: ") & (line != "data: [DONE]"), F.substring(line, F.lit(7), F.length(line)))
    opened = lines.select(*keep, F.from_json(body, LINE, BROKEN).alias("_data"))
    return open_array(opened, keep, sse_events(F.col("_data")), "part", "_e").select(*keep, "part", "_e.*")


def parse_sse(streams: DataFrame, body: str = "body", key: str = "stream_id") -> DataFrame:
    """Events of whole streamed texts: (stream_id, seq, part, type, delta, stop_reason, usage)."""
    lines = open_array(streams, [key], F.split(F.col(body), "\n"), "seq", "_raw")
    return parse_sse_lines(lines, "_raw", [key, "seq"])


def parse_json_lines(lines: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Newline-delimited JSON: (delta, done) of each valid line with an answer part or an end mark."""
    data = F.from_json(raw, "response string, done boolean")
    valid = F.try_parse_json(F.col(raw)).isNotNull()
    rows = lines.select(*keep, F.when(valid, data).alias("_d"))
    done = F.coalesce(F.col("_d.done"), F.lit(False))
    return rows.filter(_filled(F.col("_d.response")) | done).select(
        *keep, F.coalesce("_d.response", F.lit("")).alias("delta"), done.alias("done")
    )


def _joined(value: Column, order: list[str]) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda x: x["_v"]), "")


def reassemble(events: DataFrame, key: str = "stream_id") -> DataFrame:
    """Answer text, reasoning, last usage and counts per stream, in sequence order.

    Text is joined per segment of 1024 lines first, so the many deltas of a long stream are spread over
    tasks; only its few segment texts meet in one row. Of the two usage-free sums nothing is collected.
    """
    segment = F.floor(F.col("seq") / SEGMENT)
    content = F.when(F.col("type") == "content_delta", F.col("delta"))
    thought = F.when(F.col("type") == "reasoning_delta", F.col("delta"))
    at = F.struct("seq", "part")
    parts = events.groupBy(key, segment.alias("_segment")).agg(
        _joined(content, ["seq", "part"]).alias("_text"),
        _joined(thought, ["seq", "part"]).alias("_reasoning"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), at)).alias("_usage"),
        F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), at)).alias("_stop"),
        F.count(F.lit(1)).alias("_n"),
        F.collect_set("type").alias("_kinds"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_segment")))
    return parts.groupBy(key).agg(
        _joined(F.col("_text"), ["_segment"]).alias("text"),
        _joined(F.col("_reasoning"), ["_segment"]).alias("reasoning"),
        last("_usage").alias("usage"),
        last("_stop").alias("stop_reason"),
        F.sum("_n").alias("chunk_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_kinds")))).alias("chunk_types"),
    )


def fold_reasoning(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """Full reasoning of agent chunks (stream_id, seq, type, delta, reasoning): reasoning deltas in order,
    and a closing summary only if the text so far does not contain it.

    The containment test needs the text so far, so the reasoning of one answer meets in one row; all other
    chunk kinds are dropped before the shuffle. Pieces between two closings are joined at once, so the text is
    copied once per closing and not once per piece.
    """
    closing = F.col("type").isin(FINISH_KINDS)
    piece = (
        F.when(F.col("type").isin(REASONING_KINDS), F.coalesce("delta", "reasoning"))
        .when((F.col("type") == "text-delta") | closing, F.col("reasoning"))
    )
    rows = chunks.select(key, "seq", piece.alias("_piece"), closing.alias("_closing")).filter(_filled(F.col("_piece")))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "_piece", "_closing")))

    def fold(pieces):
        n = F.size(pieces)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(pieces, i - 1)["_closing"])

        def close(state, i):
            between = F.transform(F.slice(pieces, state["start"], i - state["start"]), lambda x: x["_piece"])
            last = F.when(i <= n, F.get(pieces, i - 1)["_piece"])
            text = F.concat(state["text"], F.array_join(between, ""))
            whole = let(text, lambda t: F.when(last.isNull() | F.contains(t, last), t).otherwise(F.concat(t, last)))
            return F.struct(whole.alias("text"), (i + 1).alias("start"))

        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("start"))
        return F.aggregate(F.concat(ends, F.array(n + 1)), start, close, lambda s: s["text"])

    return rows.groupBy(key).agg(ordered.alias("_pieces")).select(key, let(F.col("_pieces"), fold).alias("reasoning"))


def progress_state(events: DataFrame, by: str = "session") -> DataFrame:
    """State of each review after its events (session, seq, type, agent, file_name, content).

    Last values by sequence and counts: one aggregation with map-side combine, which also runs on a stream
    in update mode.
    """
    kind, seq = F.col("type"), F.col("seq")

    def last(value, *kinds):
        return F.max_by(value, F.when(kind.isin(*kinds), seq))

    starts = ("agent-start", "file-start")
    shown = {
        "thinking_content": F.when(kind == "thinking", F.col("content")).otherwise(F.lit("")),
        "review_content": F.when(kind == "text", F.col("content")).otherwise(F.lit("")),
    }
    return events.groupBy(by).agg(
        last("file_name", *starts).alias("current_file"),
        last("agent", *starts).alias("current_agent"),
        F.coalesce(last(shown["thinking_content"], "thinking", "agent-start"), F.lit("")).alias("thinking_content"),
        F.coalesce(last(shown["review_content"], "text", "agent-start"), F.lit("")).alias("review_content"),
        F.coalesce(last(kind == "thinking", "thinking", "text", "agent-start", "agent-complete"), F.lit(False)).alias("is_thinking"),
        F.max(F.coalesce(kind == "complete", F.lit(False))).alias("is_complete"),
        F.count_if(kind == "file-complete").alias("files_processed"),
    )
