"""What a diff means: type of change, complexity, affected areas, breaking changes and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.code_text import plain_code
from corpuslens.functions.let import let
from corpuslens.operators.diffs import body_lines, diff_files, hunk_texts, marked_text

# Weight in tenths and pattern of each construct that makes code complex.
CONSTRUCTS = [
    (10, r"\bif\s*\("),
    (10, r"\bfor\s*(await\s*)?\("),
    (10, r"\bwhile\s*\("),
    (10, r"\bdo\s*\{"),
    (10, r"\bswitch\s*\("),
    (10, r"\s\?\s[^\n:]*:"),
    (5, r"\bcase\s[^\n:]*:"),
    (5, r"\bfunction\b"),
    (5, r"=>"),
    (10, r"\btry\s*\{"),
    (5, r"\bcatch\s*[({]"),
    (3, r"\bawait\s"),
    (5, r"\bclass\s+\w"),
    (5, r"\binterface\s+\w"),
    # methods: a name, parameters and a body at the start of a line, less the statements of the same form
    (5, r"(?m)^\s*(?:(?:public|private|protected|static|async|get|set)\s+)*[A-Za-z_]\w*\s*\([^)\n]*\)\s*(?::\s*[^{\n]*)?\{"),
    (-5, r"(?m)^\s*(?:if|for|while|switch|catch|with|function)\s*\([^)\n]*\)\s*(?::\s*[^{\n]*)?\{"),
]
# Score limits of the complexity classes and the base risk of each class.
COMPLEXITY_LIMITS = [(20, "trivial"), (50, "low"), (100, "medium"), (200, "high")]
COMPLEXITY_TOP = "critical"
BASE_RISK = {"trivial": 5, "low": 15, "medium": 30, "high": 50, "critical": 70}
# Area of the product by words in a path.
AREAS = [
    ("authentication", ["auth", "login"]),
    ("payments", ["payment", "billing"]),
    ("api", ["api", "endpoint"]),
    ("database", ["database", "db"]),
    ("ui", ["ui", "component"]),
]
SCRIPT_EXTENSIONS = ["ts", "tsx", "js", "jsx"]
FUNCTION_HEAD = r"\bfunction\s*\*?\s*(\w*)\s*(?:<[^>\n]*>)?\s*\(([^)]*)\)\s*(?::\s*([^{\n]*))?"
METHOD_HEAD = r"(?m)^\s*(?:public\s+|static\s+|async\s+)*[A-Za-z_]\w*\s*\([^)\n]*\)\s*(?::\s*[^{\n]*)?\{"


def complexity_tenths(code: Column) -> Column:
    """Weighted count of control flow and definitions, in tenths (an exact integer).

    Words inside literals and comments do not count.
    """

    def count(plain):
        total = F.lit(0)
        for weight, pattern in CONSTRUCTS:
            total = total + F.regexp_count(plain, F.lit(pattern)) * weight
        return total

    return let(plain_code(code), count)


def code_complexity(files: DataFrame, key: str = "diff_id") -> DataFrame:
    """Complexity of the added and removed lines of each file."""
    return files.select(
        key, "file_no", "path", (complexity_tenths(marked_text(F.col("block"), "-+")) / 10).alias("complexity")
    )


def _last_group(code: Column, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(code, F.lit(FUNCTION_HEAD), group), F.lit(-1))


def _squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*,\s*", ","))


def is_breaking(hunk: Column) -> Column:
    """A removed export, a removed public function without replacement, or a last function whose
    parameters or return type differ between the removed and the added code of the hunk."""

    def text(lines, mark):
        picked = F.filter(lines, lambda x: x.startswith(mark))
        return F.array_join(
            F.transform(picked, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x)))), "\n"
        )

    def compare(pair):
        gone, new = pair["gone"], pair["new"]
        public = gone.rlike(FUNCTION_HEAD) | (gone.rlike(r"\bclass\s+\w") & gone.rlike(METHOD_HEAD))
        both = gone.rlike(FUNCTION_HEAD) & new.rlike(FUNCTION_HEAD)
        differs = both & (
            (_squash(_last_group(gone, 2)) != _squash(_last_group(new, 2)))
            | (_return_type(gone) != _return_type(new))
        )
        lost = public & F.when(new == "", F.lit(True)).otherwise(differs)
        return F.coalesce(gone.rlike(r"(?m)^export ") | lost, F.lit(False))

    pair = let(
        body_lines(hunk), lambda v: F.struct(text(v, "-").alias("gone"), text(v, "+").alias("new"))
    )
    return let(pair, compare)


def _return_type(code: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(_last_group(code, 3)), F.lit("")), F.lit("any"))


def file_facts(diffs: DataFrame, key: str = "diff_id", text: str = "diff_text") -> DataFrame:
    """One narrow row per changed file with all that the diff-level measures need.

    Everything is computed inside the row of the diff: no shuffle, one pass over the texts.
    """

    def measure(lines):
        picked = F.filter(lines, lambda x: ~x.startswith(" "))
        code = F.array_join(F.transform(picked, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
        return F.struct(
            F.size(F.filter(picked, lambda x: x.startswith("+"))).alias("added"),
            F.size(F.filter(picked, lambda x: x.startswith("-"))).alias("removed"),
            let(code, complexity_tenths).alias("tenths"),
        )

    files = diff_files(diffs, key, text)
    path = F.col("path")
    script = F.lower(P.last_dot_part(path)).isin(SCRIPT_EXTENSIONS)
    hunks = hunk_texts(F.col("block"))
    return files.select(
        key, "file_no", "path", "status",
        let(F.flatten(F.transform(hunks, body_lines)), measure).alias("_m"),
        ((F.col("status") == "deleted") | (script & F.exists(hunks, is_breaking))).alias("breaking"),
        P.is_test(path).alias("is_test"), P.is_doc(path).alias("is_doc"),
        P.is_critical(path).alias("is_critical"), P.is_config(path).alias("is_config"),
    ).select("*", "_m.*").drop("_m")


def change_type(only_tests, only_docs, has_new, additions, deletions, only_config) -> Column:
    """First rule that holds; a diff without files counts as a test change."""
    total = additions + deletions
    return (
        F.when(only_tests, "test")
        .when(only_docs, "docs")
        .when(has_new & (additions > 2 * deletions), "feature")
        .when((F.abs(additions - deletions) < 50) & (total > 100), "refactor")
        .when((total < 50) & ~has_new, "bugfix")
        .when(only_config, "chore")
        .otherwise("feature")
    )


def complexity_class(score: Column) -> Column:
    out = F.lit(COMPLEXITY_TOP)
    for limit, name in reversed(COMPLEXITY_LIMITS):
        out = F.when(score < limit, name).otherwise(out)
    return out


def analyze_changes(diffs: DataFrame, key: str = "diff_id", text: str = "diff_text") -> DataFrame:
    """One row per diff: type, complexity, risk_score, test_coverage, breaking_change and totals."""
    yes, no = F.lit(True), F.lit(False)
    per = file_facts(diffs, key, text).groupBy(key).agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum("added").alias("lines_added"),
        F.sum("removed").alias("lines_removed"),
        F.sum("tenths").alias("_tenths"),
        F.bool_and("is_test").alias("_tests"),
        F.bool_and("is_doc").alias("_docs"),
        F.bool_and("is_config").alias("_config"),
        F.bool_or(F.col("status") == "added").alias("_new"),
        F.bool_or("is_test").alias("test_coverage"),
        F.bool_or("is_critical").alias("critical_files"),
        F.bool_or("breaking").alias("breaking_change"),
    )
    c = F.col
    full = diffs.select(key).join(per, key, "left").fillna(
        0, ["files_changed", "lines_added", "lines_removed", "_tenths"]
    ).withColumns(
        {n: F.coalesce(c(n), yes) for n in ("_tests", "_docs", "_config")}
        | {n: F.coalesce(c(n), no) for n in ("_new", "test_coverage", "critical_files", "breaking_change")}
    )
    lines = c("lines_added") + c("lines_removed")
    score = (
        c("files_changed") * 5.0
        + F.least(lines / 10, F.lit(50.0))
        + c("_tenths")
        + F.when(c("critical_files"), 30.0).otherwise(0.0)
        + F.when(c("breaking_change"), 40.0).otherwise(0.0)
    )
    scored = full.withColumn("complexity_score", F.round(score, 6)).withColumn(
        "complexity", complexity_class(c("complexity_score"))
    )
    base = F.create_map(*[F.lit(x) for item in BASE_RISK.items() for x in item])[c("complexity")]
    risk = (
        base
        + F.when(c("critical_files"), 20).otherwise(0)
        + F.when(c("breaking_change"), 25).otherwise(0)
        + F.when(c("test_coverage"), 0).otherwise(15)
    )
    kind = change_type(c("_tests"), c("_docs"), c("_new"), c("lines_added"), c("lines_removed"), c("_config"))
    return scored.select(
        key, kind.alias("change_type"), "complexity_score", "complexity",
        F.least(risk, F.lit(100)).alias("risk_score"),
        "critical_files", "test_coverage", "breaking_change", "files_changed", "lines_added", "lines_removed",
    )


def affected_modules(files: DataFrame, key: str = "diff_id") -> DataFrame:
    """(diff, module): top folder, direct parent folder and product areas, each once."""
    path = F.col("path")
    parts = F.split(path, "/")
    n = F.size(parts)
    names = [
        F.when(n > 1, parts[0]),
        F.when(n > 2, F.try_element_at(parts, F.lit(-2))),
        *[F.when(path.rlike(P.any_of(words)), F.lit(area)) for area, words in AREAS],
    ]
    return files.select(key, F.explode(F.array_compact(F.array(*names))).alias("module")).distinct()
