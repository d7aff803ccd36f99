"""Findings: ranking, de-duplication, parsing and validation."""

from pyspark.sql import functions as F

from corpuslens.operators import issues as I

COLUMNS = "issue_id long, file string, line int, type string, severity string, confidence double, title string"


def sample(spark):
    rows = spark.createDataFrame(
        [
            (1, "a.ts", 1, "best-practice", "low", 0.6, "naming"), (2, "a.ts", 5, "bug", "critical", 0.95, "null"),
            (3, "a.ts", 9, "security", "high", 0.9, "token"), (4, "a.ts", 20, "performance", "medium", 0.8, "loop"),
            (5, "a.ts", 5, "bug", "info", 0.2, "null"), (6, "b.ts", 1, "bug", "info", 0.9, "x"), (7, "b.ts", 2, "bug", "high", 0.4, "y"),
        ],
        COLUMNS,
    )
    return rows.withColumn("repo", F.lit("r"))


def test_review_order(spark):
    rows = I.review_findings(sample(spark)).orderBy("file", "rank_in_file").collect()
    assert [r.issue_id for r in rows] == [2, 3, 4, 1]
    assert [r.rank_in_file for r in rows] == [1, 2, 3, 4]


def test_summary_and_groups(spark):
    r = I.severity_summary(sample(spark)).first()
    assert (r.critical, r.high, r.info, r.blocking, r.passed) == (1, 2, 2, 3, False)
    got = {x.type: x.n_issues for x in I.group_issues(sample(spark), "type", I.TYPES).collect()}
    assert got == {"bug": 4, "security": 1, "performance": 1, "style": 0, "best-practice": 1}


def parse(spark, *texts):
    df = spark.createDataFrame([(i, "f.ts", t) for i, t in enumerate(texts)], "id long, file string, answer string")
    return I.parse_issues(df, "answer", "file").orderBy("id", "ordinal").collect()


def test_parse_issues(spark):
    rows = parse(
        spark, 'Text\n```json\n[{"title":"t","location":{"line":7}},{}]\n```', '{"type":"style","confidence":0}', "none", '[{"a":1}', '{"a":1}}', "",
    )
    assert [(r.id, r.type, r.severity, r.confidence, r.title, r.line) for r in rows] == [
        (0, "bug", "medium", 0.7, "t", 7), (0, "bug", "medium", 0.7, "Untitled Issue", 1), (1, "style", "medium", 0.7, "Untitled Issue", 1),
    ]


def test_validate(spark):
    good = '{"type":"bug","severity":"low","title":"t","description":"d","location":{"file":"f","line":1},"rationale":"r","confidence":1}'
    docs = [good, good.replace('"confidence":1', '"confidence":2'), good.replace('"line":1', '"line":"1"'), "nope", good.replace("bug", "security")]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, record string")
    got = {r.id: (r.valid, list(r.violations)) for r in I.validate_issues(df, "record").collect()}
    assert got[0] == (True, []) and got[4] == (True, [])
    assert got[1] == (False, ["confidence"]) and got[2] == (False, ["location.line"]) and "json" in got[3][1]
    bug_only = {r.id: list(r.violations) for r in I.validate_issues(df, "record", "bug").collect()}
    assert bug_only[4] == ["type"]


def test_repository_is_part_of_the_key_and_nulls_stay(spark):
    one = sample(spark)
    both = one.unionByName(one.withColumn("repo", F.lit("other")).withColumn("issue_id", F.col("issue_id") + 100))
    odd = both.withColumn("file", F.when(F.col("issue_id") != 1, F.col("file"))).withColumn(
        "confidence", F.when(F.col("issue_id") != 3, F.col("confidence"))
    )
    assert I.dedupe_issues(both).count() == 2 * I.dedupe_issues(one).count()
    keys = I.review_findings(both).select("issue_key").distinct().count()
    assert keys == I.review_findings(both).count() == 8
    ranks = {r.issue_id: r.rank_in_file for r in I.rank_issues(odd).collect()}
    assert len(ranks) == 14 and ranks[1] == 1 and ranks[3] == 2 and ranks[103] == 2 and ranks[4] == 3
    assert I.members_of_group(odd, "file").count() == 14


def test_rank_in_a_hot_file_with_hashed_ids(spark):
    df = spark.range(3000).select(
        F.xxhash64("id").alias("issue_id"), F.lit("r").alias("repo"), F.lit("hot.ts").alias("file"),
        F.lit("low").alias("severity"), (F.col("id") * 7919 % 3000 / 3000).alias("confidence"),
    )
    got = I.rank_issues(df).collect()
    assert [r.rank_in_file for r in sorted(got, key=lambda r: -r.confidence)] == list(range(1, 3001))
