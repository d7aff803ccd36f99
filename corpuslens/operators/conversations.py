"""Model conversations: rendering, token usage, finish reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Finish codes of model services by common name; anything else is a stop.
FINISH_REASONS = {
    "end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "STOP": "stop", "MAX_TOKENS": "length",
    "SAFETY": "content_filter", "stop": "stop", "length": "length", "content_filter": "content_filter",
    "tool_calls": "tool_calls",
}
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def _joined(value: Column, order: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), "\n\n")


def render_conversation(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(conversation, turn, rendered): one ``Role: text`` block a turn, to be read in turn order.

    The shape is the same for a conversation of any length. A turn without a known role is its text alone.
    """
    name = _lookup(F.col("role"), ROLES)
    block = F.when(name.isNotNull(), F.concat(name, F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return turns.select(by, "turn", F.coalesce(block, F.lit("")).alias("rendered"))


def joined_conversation(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """One text a conversation, its blocks joined; a conversation then has to fit into one row."""
    return render_conversation(turns, by).groupBy(by).agg(
        _joined(F.col("rendered"), "turn").alias("rendered"), F.count(F.lit(1)).alias("turns")
    )


def split_system(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(conversation, role, turn, text): the turns of the system prompt, and the others as user or assistant.

    Every turn stays a row; a role that is not system or user, also a null one, is assistant.
    """
    role = F.when(F.col("role").isin("system", "user"), F.col("role")).otherwise("assistant")
    return turns.select(by, role.alias("role"), "turn", "text")


def first_nonzero(*values: Column) -> Column:
    """The first value that is present and not zero, else 0."""
    zero = F.lit(0).cast("long")
    return F.coalesce(*[F.nullif(v.cast("long"), zero) for v in values], zero)


USAGE = "struct<inputTokens:long,outputTokens:long,promptTokens:long,completionTokens:long,totalTokens:long>"
SOURCES = f"stream {USAGE}, captured {USAGE}, final {USAGE}"


def usage_normalize(records: DataFrame, json: str) -> DataFrame:
    """Token counts from up to three sources under two naming schemes; a zero falls through."""
    u = F.from_json(json, SOURCES)
    opened = records.withColumn("_u", u)
    s, c, f = (F.col(f"_u.{n}") for n in ("stream", "captured", "final"))
    return opened.withColumns(
        {
            "prompt_tokens": first_nonzero(
                s["inputTokens"], s["promptTokens"], c["promptTokens"], f["promptTokens"], f["inputTokens"]
            ),
            "completion_tokens": first_nonzero(
                s["outputTokens"], s["completionTokens"], c["completionTokens"], f["completionTokens"], f["outputTokens"]
            ),
            "total_tokens": first_nonzero(s["totalTokens"], c["totalTokens"], f["totalTokens"]),
        }
    ).drop("_u")


def finish_reason(code: Column) -> Column:
    return F.coalesce(_lookup(code, FINISH_REASONS), F.lit("stop"))
