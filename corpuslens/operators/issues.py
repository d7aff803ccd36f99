"""Review findings: parsing, validation, ranking, de-duplication, filters, grouping and counts.

Table ``issues``: issue_id, repo, file, line, type, severity, confidence, title, ... one row per finding.
Severity is ordered critical (0) to info (4); unknown severities come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.let import let, open_array
from corpuslens.functions.windows import first_per_group, position_in_group

# The severities and finding types, each in report order.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
TYPES = ["bug", "security", "performance", "style", "best-practice"]
UNKNOWN_RANK = 5
ISSUE_KEY = ["repo", "file", "line", "type", "title"]
DEFAULT_MIN_CONFIDENCE = 0.5
DEFAULT_MIN_SEVERITY = "low"


def severity_rank(col: Column) -> Column:
    """0 for critical up to 4 for info, 5 for anything else."""
    rank = F.lit(UNKNOWN_RANK)
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(col == name, F.lit(i)).otherwise(rank)
    return rank


def issue_key_id(keys: list[str] = ISSUE_KEY) -> Column:
    """A stable id for a finding: the hash of its identity (null as empty), so that reruns agree."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)


def dedupe_issues(issues: DataFrame, order: str = "issue_id") -> DataFrame:
    """Keep the first finding per repository, file, line, type and title."""
    return first_per_group(issues, ISSUE_KEY, [F.col(order)])


def filter_issues(
    issues: DataFrame,
    min_severity: str = DEFAULT_MIN_SEVERITY,
    min_confidence: float = DEFAULT_MIN_CONFIDENCE,
) -> DataFrame:
    """Findings at least as severe as ``min_severity`` with enough confidence.

    Severity is tested as a membership list, which the scan can push down.
    """
    allowed = SEVERITIES[: SEVERITIES.index(min_severity) + 1]
    return issues.filter(F.col("severity").isin(allowed) & (F.col("confidence") >= min_confidence))


def rank_issues(issues: DataFrame, id_col: str = "issue_id") -> DataFrame:
    """Add ``severity_rank`` and ``rank_in_file``: most severe first, then most confident, then oldest.

    Findings without a file rank among each other, per repository; those without confidence come last.
    """
    ranked = issues.withColumn("severity_rank", severity_rank(F.col("severity")))
    order = [F.col("severity_rank"), F.col("confidence").desc_nulls_last(), F.col(id_col)]
    return position_in_group(ranked, ["repo", "file"], order, "rank_in_file")


def review_findings(
    issues: DataFrame,
    min_severity: str = DEFAULT_MIN_SEVERITY,
    min_confidence: float = DEFAULT_MIN_CONFIDENCE,
) -> DataFrame:
    """What a reviewer should see: de-duplicated, filtered, ranked, with a stable id.

    De-duplication comes first, because the kept (first) copy decides whether a finding passes the filters.
    """
    kept = filter_issues(dedupe_issues(issues), min_severity, min_confidence)
    return rank_issues(kept).withColumn("issue_key", issue_key_id())


def fixable_issues(issues: DataFrame) -> DataFrame:
    """Findings whose suggestion carries replacement code."""
    return issues.filter(F.col("suggestion_code").isNotNull() & (F.col("suggestion_code") != ""))


def group_issues(issues: DataFrame, by: str, dense: list[str] | None = None) -> DataFrame:
    """Size and profile of each group; with ``dense`` every listed key appears, also when empty.

    Members stay in the issue table (``members_of_group``), so no group is ever collected into one row.
    """
    counts = issues.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.max("confidence").alias("max_confidence"),
        F.min("issue_id").alias("first_issue_id"),
    )
    if dense is None:
        return counts
    spark = issues.sparkSession
    keys = spark.createDataFrame(list(enumerate(dense)), f"group_order int, {by} string")
    # the dense key list is a fixed handful of rows
    return F.broadcast(keys).join(counts, by, "left").withColumn(
        "n_issues", F.coalesce("n_issues", F.lit(0).cast("long"))
    )


def members_of_group(issues: DataFrame, by: str, id_col: str = "issue_id") -> DataFrame:
    """Every finding with its group and its position there (input order)."""
    return position_in_group(issues, [by], [F.col(id_col)], "position")


def severity_summary(issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per severity, the critical + high total, and the pass/fail gate."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    grouped = issues.groupBy(*by) if by else issues.groupBy()
    return (
        grouped.agg(*counts, F.count(F.lit(1)).alias("total"))
        .withColumn("blocking", F.col("critical") + F.col("high"))
        .withColumn("passed", F.col("blocking") == 0)
    )


def usage_totals(issues: DataFrame, by: list[str]) -> DataFrame:
    """Token usage and finding count per review."""
    return issues.groupBy(*by).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.count(F.lit(1)).alias("n_issues"),
    )


def review_log(issues: DataFrame, review: list[str]) -> DataFrame:
    """JSON log lines: one header with the totals per review, one line per finding.

    The line grain keeps a very large review spread over many rows; ``severity`` info is logged as low.
    """
    review_id = F.concat_ws("@", *[F.col(c).cast("string") for c in review])
    keyed = issues.withColumn("review_id", review_id)
    heads = (
        usage_totals(keyed, ["review_id"])
        .select(
            "review_id",
            F.lit(0).cast("long").alias("line_no"),
            F.to_json(F.struct("n_issues", "prompt_tokens", "completion_tokens", "total_tokens")).alias("json"),
        )
    )
    logged = F.when(F.col("severity") == "info", "low").otherwise(F.col("severity"))
    body = keyed.select(
        "review_id",
        (F.col("issue_id") + 1).alias("line_no"),
        F.to_json(
            F.struct("type", logged.alias("severity"), "title", "file", "line", "confidence")
        ).alias("json"),
    )
    return heads.unionByName(body)


SUGGESTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("description", "diff", "code", "originalCode", "fixedCode")]
)
LOCATION = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.DoubleType()),
        T.StructField("column", T.DoubleType()),
        T.StructField("endLine", T.DoubleType()),
    ]
)
ISSUE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("suggestion", SUGGESTION),
        T.StructField("rationale", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def _or_default(col: Column, empty: object, default: object) -> Column:
    """An absent, empty or zero value falls back to the default."""
    return F.coalesce(F.nullif(col, F.lit(empty)), F.lit(default))


def _one_document(text: Column) -> Column:
    """The text as a variant, or null unless it is exactly one JSON value.

    The parser stops after the first value; inside an array, anything that follows is an error or a
    second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))

    def only(doc):
        alone = F.try_variant_get(doc, "$[1]", "variant").isNull()
        return F.when(alone, F.try_variant_get(doc, "$[0]", "variant"))

    return let(wrapped, only)


def parse_issues(answers: DataFrame, text: str, file: str, default_confidence: float = 0.7) -> DataFrame:
    """Findings from model answers: a fenced JSON block or the whole text, an array or one object.

    Text that is not valid JSON yields no rows.
    """
    fenced = F.regexp_extract(F.col(text), r"(?s)```json\n(.*?)\n```", 1)
    body = F.trim(F.when(F.col(text).rlike(r"(?s)```json\n.*?\n```"), fenced).otherwise(F.col(text)))
    read = F.col("_body")
    as_array = F.when(read.startswith("["), read).otherwise(F.concat(F.lit("["), read, F.lit("]")))
    valid = _one_document(F.col("_body")).isNotNull() & F.col("_body").rlike(r"^[\[{]")
    parsed = F.when(valid, F.from_json(as_array, T.ArrayType(ISSUE)))
    kept = [c for c in answers.columns if c != text]
    rows = open_array(answers.select(*kept, body.alias("_body")), kept, parsed, "ordinal", "_issue")
    i = F.col("_issue")
    line = _or_default(i["location"]["line"], 0.0, 1.0).cast("int")
    return rows.select(
        *kept,
        "ordinal",
        _or_default(i["type"], "", "bug").alias("type"),
        _or_default(i["severity"], "", "medium").alias("severity"),
        _or_default(i["confidence"], 0.0, default_confidence).alias("confidence"),
        _or_default(i["title"], "", "Untitled Issue").alias("title"),
        F.coalesce(i["description"], F.lit("")).alias("description"),
        F.col(file).alias("issue_file"),
        line.alias("line"),
        i["location"]["column"].cast("int").alias("column"),
        i["location"]["endLine"].cast("int").alias("end_line"),
        i["suggestion"].alias("suggestion"),
        F.coalesce(i["rationale"], F.lit("")).alias("rationale"),
        F.coalesce(i["references"], F.array().cast("array<string>")).alias("references"),
        F.coalesce(i["tags"], F.array().cast("array<string>")).alias("tags"),
    )


def validate_issues(records: DataFrame, json: str, expected_type: str | None = None) -> DataFrame:
    """Check raw finding records against the finding schema; adds ``violations`` and ``valid``.

    ``expected_type`` is the literal type an agent of one kind must report.
    """
    doc = F.col("_doc")

    def is_kind(path: str, kind: str) -> Column:
        value = F.try_variant_get(doc, path, "variant")
        schema = F.schema_of_variant(value)
        if kind == "number":
            return schema.rlike(r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        return schema == kind

    def text(path: str) -> Column:
        return F.try_variant_get(doc, path, "string")

    types = [expected_type] if expected_type else TYPES
    number = F.try_variant_get(doc, "$.confidence", "double")
    checks = {
        "json": doc.isNotNull(),
        "type": is_kind("$.type", "STRING") & text("$.type").isin(types),
        "severity": is_kind("$.severity", "STRING") & text("$.severity").isin(SEVERITIES),
        "title": is_kind("$.title", "STRING"),
        "description": is_kind("$.description", "STRING"),
        "location.file": is_kind("$.location.file", "STRING"),
        "location.line": is_kind("$.location.line", "number"),
        "rationale": is_kind("$.rationale", "STRING"),
        "confidence": is_kind("$.confidence", "number") & number.between(0, 1),
    }
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )
    return (
        records.withColumn("_doc", _one_document(F.col(json)))
        .withColumn("violations", failed)
        .withColumn("valid", F.size("violations") == 0)
        .drop("_doc")
    )
