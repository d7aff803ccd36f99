"""Overlapping line chunks of text files.

A chunk grows line by line up to ``size`` characters. The line that would overflow closes the chunk and
opens the next one, which starts up to four lines earlier. Line numbers are 0-based.

Only line lengths are folded: the fold yields line ranges, and the text of each range is cut from the line
array afterwards, inside the JVM. Files are independent, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.let import let, open_array

CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
CHARS_PER_LINE = 50
MAX_OVERLAP_LINES = 5

RANGE = "struct<start:int,first:int,last:int>"


def overlap_lines(overlap: int) -> int:
    return min(MAX_OVERLAP_LINES, overlap // CHARS_PER_LINE)


def chunk_ranges(lines: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    return let(F.transform(lines, F.length), lambda lengths: fold_lengths(lengths, size, overlap))


def fold_lengths(lengths: Column, size: int, overlap: int) -> Column:
    """Line ranges ``(start, first, last)`` of the chunks; ``first`` is the first line kept in the text.

    ``first`` differs from ``start`` only while a file opens with blank lines: they are not in the text but
    still count for the line number.
    """
    back = overlap_lines(overlap)
    none = F.array().cast(f"array<{RANGE}>")
    zero = F.lit(0)
    start_state = F.struct(
        zero.alias("i"), zero.alias("start"), zero.alias("first"), zero.alias("len"), none.alias("done")
    )

    def range_of(start, first, last):
        return F.struct(start.alias("start"), first.alias("first"), last.alias("last"))

    def step(state, length):
        i, start, first, held = state["i"], state["start"], state["first"], state["len"]
        longer = F.when(held == 0, length).otherwise(held + 1 + length)
        overflow = (held > 0) & (longer > size)
        from_line = F.greatest(zero, i - back)
        reopened = F.aggregate(
            F.slice(lengths, from_line + 1, i - from_line + 1), F.lit(0), lambda a, x: a + x
        ) + (i - from_line)
        skipped_blank = (held == 0) & (length == 0)
        return F.struct(
            (i + 1).alias("i"),
            F.when(overflow, from_line).otherwise(start).alias("start"),
            F.when(overflow, from_line).when(skipped_blank, i + 1).otherwise(first).alias("first"),
            F.when(overflow, reopened).otherwise(longer).alias("len"),
            F.when(overflow, F.concat(state["done"], F.array(range_of(start, first, i - 1))))
            .otherwise(state["done"])
            .alias("done"),
        )

    def close(state):
        tail = range_of(state["start"], state["first"], state["i"] - 1)
        return F.when(state["len"] > 0, F.concat(state["done"], F.array(tail))).otherwise(state["done"])

    return F.aggregate(lengths, start_state, step, close)


def chunks_of(content: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of ``(line_start, line_end, text)``; a last chunk of white space only is dropped."""

    def cut(lines):
        return F.transform(
            chunk_ranges(lines, size, overlap),
            lambda r: F.struct(
                r["start"].alias("line_start"),
                r["last"].alias("line_end"),
                F.array_join(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), "\n").alias("text"),
            ),
        )

    def drop_blank_tail(chunks):
        n = F.size(chunks)
        blank = (n > 0) & ~F.coalesce(F.try_element_at(chunks, F.lit(-1))["text"].rlike(r"\S"), F.lit(True))
        return F.when(blank, F.slice(chunks, 1, F.greatest(n - 1, F.lit(0)))).otherwise(chunks)

    return let(let(F.split(content, "\n"), cut), drop_blank_tail)


def chunk_count(content: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of chunks of a text, from the line lengths alone: no chunk text is built."""

    def count(lines):
        def without_blank_tail(ranges):
            n = F.size(ranges)
            last = F.get(ranges, n - 1)
            tail = F.slice(lines, last["first"] + 1, last["last"] - last["first"] + 1)
            return n - F.when((n > 0) & ~F.exists(tail, lambda x: x.rlike(r"\S")), 1).otherwise(0)

        return let(chunk_ranges(lines, size, overlap), without_blank_tail)

    return let(F.split(content, "\n"), count)


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("::chunk-"), index.cast("string"))


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: repo, file_path, chunk_index, chunk_id, line_start, line_end, text."""
    rows = open_array(
        files, ["repo", F.col("path").alias("file_path")], chunks_of(F.col("content"), size, overlap), "chunk_index", "_c"
    )
    return rows.select(
        "repo",
        "file_path",
        "chunk_index",
        chunk_id(F.col("file_path"), F.col("chunk_index")).alias("chunk_id"),
        "_c.line_start",
        "_c.line_end",
        "_c.text",
    )
