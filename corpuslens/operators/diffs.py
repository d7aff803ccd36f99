"""Unified diffs as tables of files, hunks and lines.

The three levels are cut by nested splits of the text inside its own row: blocks at ``diff --git``, hunks at
``@@``, lines at line ends. Line numbers come from prefix counts over a one-character-per-line signature of
the hunk. So parsing is one narrow stage without any shuffle, whatever the size of single diffs.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.let import let, open_array
from corpuslens.functions.paths import language_of

# The marks of a unified diff. Flags: m = at line starts, d = only \n ends a line.
FILE_START = r"(?md)^(?=diff --git )"
HUNK_START = r"(?md)^(?=@@ -\d+(?:,\d*)? \+\d+(?:,\d*)? @@)"
HUNK_HEAD = r"(?d)^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)"
PATHS = r"(?d)^diff --git a/(.*?) b/(.*)"


def _rest_after_line(text: Column) -> Column:
    """The text without its first line."""
    at = F.locate("\n", text)
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")


def diff_files(diffs: DataFrame, key: str = "diff_id", text: str = "diff_text") -> DataFrame:
    """One row per changed file: path, old_path (renames), status, language and its block of the diff."""
    blocks = F.filter(F.split(F.col(text), FILE_START), lambda b: b.startswith("diff --git "))
    rows = open_array(diffs, [key], blocks, "file_no", "block")
    block = F.col("block")
    old, new = F.regexp_extract(block, PATHS, 1), F.regexp_extract(block, PATHS, 2)
    status = (
        F.when(block.rlike(r"(?md)^new file mode"), "added")
        .when(block.rlike(r"(?md)^deleted file mode"), "deleted")
        .when(old != new, "renamed")
        .otherwise("modified")
    )
    return rows.filter(block.rlike(PATHS)).select(
        key,
        "file_no",
        new.alias("path"),
        F.when(old != new, old).alias("old_path"),
        status.alias("status"),
        language_of(new).alias("language"),
        "block",
    )


def hunk_texts(block: Column) -> Column:
    return F.filter(F.split(block, HUNK_START), lambda h: h.startswith("@@ "))


def body_lines(hunk: Column) -> Column:
    """Marked lines of a hunk: context, added and removed."""
    return F.filter(F.split(_rest_after_line(hunk), "\n"), lambda x: x.rlike(r"^[-+ ]"))


def signature(lines: Column) -> Column:
    """First characters of all lines, as one string."""
    return F.array_join(F.transform(lines, lambda x: F.left(x, F.lit(1))), "")


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def diff_hunks(files: DataFrame, key: str = "diff_id") -> DataFrame:
    """One row per hunk: its ranges, its heading and its marked lines (``lines``, with ``marks``)."""
    rows = open_array(files, [key, "file_no", "path", "status"], hunk_texts(F.col("block")), "hunk_no", "hunk")

    def part(i):
        return F.regexp_extract("hunk", HUNK_HEAD, i)

    def count_or_one(i):
        return F.when(part(i) == "", F.lit(1)).otherwise(part(i).cast("int"))

    cut = rows.select(
        key, "file_no", "path", "status", "hunk_no",
        part(1).cast("int").alias("old_start"), count_or_one(2).alias("old_lines"),
        part(3).cast("int").alias("new_start"), count_or_one(4).alias("new_lines"),
        F.trim(part(5)).alias("heading"),
        body_lines(F.col("hunk")).alias("lines"),
    )
    return cut.withColumn("marks", signature(F.col("lines"))).withColumns(
        {"added": _occurrences(F.col("marks"), "+"), "removed": _occurrences(F.col("marks"), "-")}
    )


BLOCK_LINES = 256


def numbered(lines: Column, marks: Column, old_start: Column, new_start: Column) -> Column:
    """Lines as structs (line_type, content, old_no, new_no).

    Marks before a line are counted per block of lines once, and inside the line's own block only, so the
    work is linear in the number of lines.
    """

    def running(blocks: Column, char: str) -> Column:
        add = lambda sums, text: F.concat(sums, F.array(F.element_at(sums, -1) + _occurrences(text, char)))
        return F.aggregate(blocks, F.array(F.lit(0)), add)

    def cut(blocks: Column) -> Column:
        return let(
            running(blocks, "+"),
            lambda plus: let(running(blocks, "-"), lambda minus: F.transform(lines, one(blocks, plus, minus))),
        )

    def one(blocks: Column, plus: Column, minus: Column):
        def line_at(line: Column, i: Column) -> Column:
            at = F.floor(i / BLOCK_LINES).cast("int")
            before = F.substring(F.get(blocks, at), F.lit(1), i % BLOCK_LINES)
            mark = F.left(line, F.lit(1))
            old_no = old_start + i - F.get(plus, at) - _occurrences(before, "+")
            new_no = new_start + i - F.get(minus, at) - _occurrences(before, "-")
            return F.struct(
                F.when(mark == "+", "added").when(mark == "-", "removed").otherwise("context").alias("line_type"),
                F.substring(line, F.lit(2), F.length(line)).alias("content"),
                F.when(mark != "+", old_no).alias("old_no"),
                F.when(mark != "-", new_no).alias("new_no"),
            )

        return line_at

    first = F.sequence(F.lit(0), F.floor(F.length(marks) / BLOCK_LINES).cast("int"))
    blocks = F.transform(first, lambda b: F.substring(marks, b * BLOCK_LINES + 1, F.lit(BLOCK_LINES)))
    return let(blocks, cut)


def diff_lines(hunks: DataFrame, key: str = "diff_id") -> DataFrame:
    """One row per line of every hunk, with old and new line numbers."""
    lines = numbered(F.col("lines"), F.col("marks"), F.col("old_start"), F.col("new_start"))
    rows = open_array(hunks, [key, "file_no", "path", "status", "hunk_no"], lines, "line_no", "_l")
    return rows.select(key, "file_no", "path", "status", "hunk_no", "line_no", "_l.*")


def parse_diff(diffs: DataFrame, key: str = "diff_id", text: str = "diff_text") -> DataFrame:
    return diff_lines(diff_hunks(diff_files(diffs, key, text), key), key)


def diff_stats(diffs: DataFrame, key: str = "diff_id", text: str = "diff_text") -> DataFrame:
    """Files, added lines and removed lines per diff (a diff without files counts zero)."""
    hunks = diff_hunks(diff_files(diffs, key, text), key)
    per = hunks.groupBy(key).agg(F.sum("added").alias("additions"), F.sum("removed").alias("deletions"))
    n = F.size(F.filter(F.split(F.col(text), FILE_START), lambda b: b.rlike(PATHS)))
    return diffs.select(key, n.alias("files_changed")).join(per, key, "left").fillna(
        0, ["additions", "deletions"]
    )


def marked_text(block: Column, marks: str) -> Column:
    """Lines with one of the marks, over all hunks of a file, without the mark, joined by line ends."""
    lines = F.flatten(F.transform(hunk_texts(block), body_lines))
    picked = F.filter(lines, lambda x: x.rlike(f"^[{marks}]"))
    return F.array_join(F.transform(picked, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")


def changed_code(files: DataFrame, key: str = "diff_id") -> DataFrame:
    """The code a reviewer reads: ``new line number: text`` for context and added lines, headings as comments.

    Built within the row of the file, so nothing is collected across rows.
    """

    def render(hunk):
        def part(i):
            return F.regexp_extract(hunk, HUNK_HEAD, i)

        def body(lines):
            def with_marks(marks):
                rows = numbered(lines, marks, part(1).cast("int"), part(3).cast("int"))
                shown = F.filter(rows, lambda r: r["line_type"] != "removed")
                return F.transform(
                    shown, lambda r: F.concat(r["new_no"].cast("string"), F.lit(": "), r["content"])
                )

            return let(signature(lines), with_marks)

        head = F.trim(part(5))
        title = F.when(head != "", F.array(F.concat(F.lit("// "), head))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(title, let(body_lines(hunk), body))

    code = F.array_join(F.flatten(F.transform(hunk_texts(F.col("block")), render)), "\n")
    return files.select(key, "file_no", "path", "status", code.alias("code"))


def suggestion_diff(issues: DataFrame, original: str, fixed: str, context: int = 3) -> DataFrame:
    """Unified diff of original and fixed code without file headers; null if equal or one is missing."""

    @F.pandas_udf("string")
    def hunks(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if not x or not y or x == y:
                return None
            lines = difflib.unified_diff(
                x.removesuffix("\n").split("\n"), y.removesuffix("\n").split("\n"), n=context, lineterm=""
            )
            return "\n".join(list(lines)[2:]).strip() or None

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return issues.withColumn("suggestion_diff", hunks(F.col(original), F.col(fixed)))


def suggestion_text(generated: Column, original: Column, fixed: Column, given: Column, code: Column) -> Column:
    """What to show for a suggestion: the generated diff, else the given diff, else the code as additions."""
    blank = F.lit("")
    has_pair = (F.coalesce(original, blank) != "") & (F.coalesce(fixed, blank) != "")
    additions = F.regexp_replace(F.concat(F.lit("+ "), code), "\n", "\n+ ")
    return (
        F.when(has_pair, generated)
        .when(F.trim(F.coalesce(given, blank)) != "", F.trim(given))
        .when(F.coalesce(code, blank) != "", additions)
    )


def changed_paths(*sets: DataFrame) -> DataFrame:
    """Staged, untracked and modified paths as one bag; a path in two sets appears twice."""
    first, *rest = [s.select("repo", "path") for s in sets]
    for s in rest:
        first = first.unionByName(s)
    return first


def file_history(commits: DataFrame, limit: int = 10) -> DataFrame:
    """Latest commits per repository and file."""
    from corpuslens.functions.windows import top_per_group

    return top_per_group(commits, ["repo", "path"], [F.col("ts").desc(), F.col("sha")], limit)
