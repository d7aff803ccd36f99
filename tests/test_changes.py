"""Unified diffs and what they mean."""

from pyspark.sql import functions as F

from corpuslens.operators import changes as A
from corpuslens.operators import diffs as D

DIFF = """diff --git a/old.ts b/new.ts
similarity index 90%
--- a/old.ts
+++ b/new.ts
@@ -3 +3,2 @@ class A
-gone
+diff --git is text here
+@@ -1 +1 @@ not a hunk
\\ No newline at end of file
@@ -20,3 +21,3 @@
 keep
-x
+y
 tail
diff --git a/n.ts b/n.ts
new file mode 100644
@@ -0,0 +1,2 @@
+one
+two
diff --git a/d.ts b/d.ts
deleted file mode 100644
@@ -1 +0,0 @@
-bye"""


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "diff_id long, diff_text string")


def test_files_hunks_and_lines(spark):
    diffs = frame(spark, DIFF, "")
    files = {(r.path, r.old_path, r.status) for r in D.diff_files(diffs).collect()}
    assert files == {("new.ts", "old.ts", "renamed"), ("n.ts", None, "added"), ("d.ts", None, "deleted")}
    lines = [
        (r.line_type, r.content, r.old_no, r.new_no)
        for r in D.parse_diff(diffs).filter("file_no = 0").orderBy("hunk_no", "line_no").collect()
    ]
    assert lines == [
        ("removed", "gone", 3, None), ("added", "diff --git is text here", None, 3), ("added", "@@ -1 +1 @@ not a hunk", None, 4),
        ("context", "keep", 20, 21), ("removed", "x", 21, None), ("added", "y", None, 22), ("context", "tail", 22, 23),
    ]
    first = D.diff_hunks(D.diff_files(diffs)).filter("file_no = 0 and hunk_no = 0").first()
    assert (first.old_lines, first.new_lines, first.heading) == (1, 2, "class A")
    stats = {r.diff_id: (r.files_changed, r.additions, r.deletions) for r in D.diff_stats(diffs).collect()}
    assert stats == {0: (3, 5, 3), 1: (0, 0, 0)}


def test_changed_code(spark):
    row = D.changed_code(D.diff_files(frame(spark, DIFF))).filter("file_no = 0").first()
    assert row.code == "// class A\n3: diff --git is text here\n4: @@ -1 +1 @@ not a hunk\n21: keep\n22: y\n23: tail"


def one_file(path, body, mode=""):
    return f"diff --git a/{path} b/{path}\n{mode}@@ -1,9 +1,9 @@\n{body}"


def test_change_types_and_breaking(spark):
    cases = [
        ("test", False, one_file("src/a.test.ts", "+x")),
        ("docs", False, one_file("README.md", "+x")),
        ("bugfix", True, one_file("a.ts", "-export const a = 1;\n+const a = 1;")),
        ("bugfix", True, one_file("a.ts", "-function f(a) {\n+function f(a, b) {")),
        ("bugfix", False, one_file("a.ts", "-function f(a) {\n+function f(a) {")),
        ("bugfix", True, one_file("a.ts", "-function f(a) {")),
        ("bugfix", False, one_file("a.py", "-function f(a) {")),
        ("feature", False, one_file("n.ts", "+a\n+b", "new file mode 100644\n")),
        ("refactor", False, one_file("r.ts", "\n".join(["+a", "-b"] * 60))),
        ("chore", False, one_file("config.yml", "\n".join(["+a"] * 60))),
        ("test", False, ""),
    ]
    got = {r.diff_id: r for r in A.analyze_changes(frame(spark, *[c[2] for c in cases])).collect()}
    for i, (kind, breaking, text) in enumerate(cases):
        assert (got[i].change_type, got[i].breaking_change) == (kind, breaking), text


def test_scores(spark):
    r = A.analyze_changes(frame(spark, one_file("src/auth/a.ts", "+if (a) {\n+ for (const x of y) { await z(); }"))).first()
    # 5 per file + 2/10 lines + 10 * (1 + 1 + .3) + 30 critical
    assert (r.complexity_score, r.complexity, r.risk_score) == (58.2, "medium", 65)


def test_modules(spark):
    got = {r.module for r in A.affected_modules(D.diff_files(frame(spark, one_file("src/core/auth/login.ts", "+x")))).collect()}
    assert got == {"src", "auth", "authentication"}


def test_suggestions(spark):
    df = spark.createDataFrame(
        [("a\nb\nc", "a\nX\nc", None, None), ("same", "same", None, None), (None, "x", " given ", "c"), (None, None, None, "l1\nl2")],
        "o string, f string, given string, code string",
    )
    out = D.suggestion_diff(df, "o", "f")
    rows = out.withColumn("shown", D.suggestion_text(*[F.col(c) for c in ("suggestion_diff", "o", "f", "given", "code")])).collect()
    assert rows[0].suggestion_diff == "@@ -1,3 +1,3 @@\n a\n-b\n+X\n c"
    assert [r.suggestion_diff for r in rows[1:]] == [None, None, None]
    assert [r.shown for r in rows[1:]] == [None, "given", "+ l1\n+ l2"]


def test_a_hunk_of_many_lines_is_numbered_in_linear_time(spark):
    """Numbers are right across counting blocks, and 200,000 lines take seconds."""
    import time

    marks = [" -+"[i * i % 3] for i in range(200_000)]
    text = "diff --git a/f.ts b/f.ts\n@@ -5,9 +7,9 @@\n" + "\n".join(m + "x" for m in marks)
    df = spark.createDataFrame([(1, text)], "diff_id long, diff_text string")
    began = time.time()
    rows = D.parse_diff(df).select("line_no", "old_no", "new_no").collect()
    assert time.time() - began < 30 and len(rows) == len(marks)
    old, new = 5, 7
    for r, mark in zip(sorted(rows), marks, strict=True):
        assert (r.old_no, r.new_no) == (old if mark != "+" else None, new if mark != "-" else None)
        old, new = old + (mark != "+"), new + (mark != "-")


def test_methods_count_and_statements_do_not(spark):
    code = "class A {\n  async load(x) {\n    if (x) {\n    }\n  }\n  static make(): A {\n  }\n}"
    got = spark.createDataFrame([(code,)], "c string").select(A.complexity_tenths(F.col("c"))).first()[0]
    assert got == 5 + 2 * 5 + 10
