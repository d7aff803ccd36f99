"""Queries over review findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import issues as I
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end"

COLUMNS = ["issue_id", "repo", "file", "line", "type", "severity", "confidence", "title"]


def _review_findings(spark, sf):
    return I.review_findings(table(spark, sf, "findings")).select(
        "issue_key", *COLUMNS, "severity_rank", "rank_in_file"
    )


QUERIES["review_findings"] = _review_findings
ORACLE["review_findings"] = with_derived("findings", f"""
with first as (
  select *, {RANK} as severity_rank from (
    select *, row_number() over (partition by repo, file, line, type, title order by issue_id) as rn from findings) s
  where rn = 1),
kept as (select * from first where severity_rank <= 3 and confidence >= 0.5)
select sha256(concat(repo, ':', file, ':', line, ':', type, ':', title)) as issue_key,
  issue_id, repo, file, line, type, severity, confidence, title, severity_rank,
  row_number() over (partition by repo, file order by severity_rank, confidence desc nulls last, issue_id) as rank_in_file
from kept""")

QUERIES["dedupe_issues"] = lambda spark, sf: I.dedupe_issues(table(spark, sf, "findings")).select(*COLUMNS)
ORACLE["dedupe_issues"] = with_derived("findings", """
select issue_id, repo, file, line, type, severity, confidence, title from (
  select *, row_number() over (partition by repo, file, line, type, title order by issue_id) as rn from findings) s
where rn = 1""")

QUERIES["rank_issues"] = lambda spark, sf: I.rank_issues(table(spark, sf, "findings")).select(
    *COLUMNS, "severity_rank", "rank_in_file"
)
ORACLE["rank_issues"] = with_derived("findings", f"""
select issue_id, repo, file, line, type, severity, confidence, title, {RANK} as severity_rank,
  row_number() over (partition by repo, file order by {RANK}, confidence desc nulls last, issue_id) as rank_in_file
from findings""")

QUERIES["issue_filter"] = lambda spark, sf: I.filter_issues(
    table(spark, sf, "issues"), "medium", 0.5
).select(*COLUMNS)
ORACLE["issue_filter"] = with_derived("issues", f"""
select issue_id, repo, file, line, type, severity, confidence, title from issues
where {RANK} <= 2 and confidence >= 0.5""")

QUERIES["fixable_issues"] = lambda spark, sf: I.fixable_issues(table(spark, sf, "issues")).select(
    "issue_id", "file", "suggestion_code"
)
ORACLE["fixable_issues"] = with_derived("issues", """
select issue_id, file, suggestion_code from issues
where suggestion_code is not null and suggestion_code <> ''""")


def _groups(by, dense=None):
    def run(spark, sf):
        return I.group_issues(table(spark, sf, "issues"), by, dense)

    return run


QUERIES["issues_by_severity"] = _groups("severity", I.SEVERITIES)
ORACLE["issues_by_severity"] = with_derived("issues", """
select k.group_order, k.severity, count(i.issue_id) as n_issues, max(i.confidence) as max_confidence,
  min(i.issue_id) as first_issue_id
from (values (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'info')) k(group_order, severity)
left join issues i on i.severity = k.severity
group by 1, 2""")
QUERIES["issues_by_type"] = _groups("type", I.TYPES)
ORACLE["issues_by_type"] = with_derived("issues", """
select k.group_order, k.type, count(i.issue_id) as n_issues, max(i.confidence) as max_confidence,
  min(i.issue_id) as first_issue_id
from (values (0, 'bug'), (1, 'security'), (2, 'performance'), (3, 'style'), (4, 'best-practice')) k(group_order, type)
left join issues i on i.type = k.type
group by 1, 2""")
QUERIES["issues_by_file"] = _groups("file")
ORACLE["issues_by_file"] = with_derived("issues", """
select file, count(*) as n_issues, max(confidence) as max_confidence, min(issue_id) as first_issue_id
from issues group by file""")

QUERIES["issue_group_members"] = lambda spark, sf: I.members_of_group(
    table(spark, sf, "findings"), "file"
).select("severity", "position", "issue_id", "file", "line", "type")
ORACLE["issue_group_members"] = with_derived("findings", """
select severity, row_number() over (partition by file order by issue_id) as position,
  issue_id, file, line, type from findings""")

QUERIES["severity_summary"] = lambda spark, sf: I.severity_summary(table(spark, sf, "issues"), ["file"])
ORACLE["severity_summary"] = with_derived("issues", """
select *, critical + high as blocking, critical + high = 0 as passed from (
  select file, count(*) filter (where severity = 'critical') as critical,
    count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium,
    count(*) filter (where severity = 'low') as low, count(*) filter (where severity = 'info') as info,
    count(*) as total
  from issues group by file) s""")


def _with_day(spark, sf):
    return table(spark, sf, "issues").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


QUERIES["usage_totals"] = lambda spark, sf: I.usage_totals(_with_day(spark, sf), ["file", "day"])
ORACLE["usage_totals"] = with_derived("issues", """
select file, strftime(ts, '%Y-%m-%d') as day, cast(sum(prompt_tokens) as bigint) as prompt_tokens,
  cast(sum(completion_tokens) as bigint) as completion_tokens,
  cast(sum(prompt_tokens + completion_tokens) as bigint) as total_tokens, count(*) as n_issues
from issues group by 1, 2""")

QUERIES["review_log"] = lambda spark, sf: I.review_log(_with_day(spark, sf), ["file", "day"])
ORACLE["review_log"] = with_derived("issues", """
with keyed as (select *, concat(file, '@', strftime(ts, '%Y-%m-%d')) as review_id from issues)
select review_id, cast(0 as bigint) as line_no,
  concat('{"n_issues":', count(*), ',"prompt_tokens":', sum(prompt_tokens), ',"completion_tokens":',
    sum(completion_tokens), ',"total_tokens":', sum(prompt_tokens + completion_tokens), '}') as json
from keyed group by review_id
union all
select review_id, issue_id + 1,
  concat('{"type":"', type, '","severity":"', case severity when 'info' then 'low' else severity end,
    '","title":"', title, '","file":"', file, '","line":', line, ',"confidence":', confidence, '}')
from keyed""")

# Model answers with findings as JSON: fenced array, bare object with missing fields, or unusable text.
ANSWERS = """
select issue_id, file as answer_file,
  case issue_id % 4
    when 0 then concat('Here is what I found:', chr(10), '```json', chr(10), '[{"type":"', type, '","severity":"', severity,
      '","confidence":', cast(confidence as varchar(20)), ',"title":"', title, '","location":{"line":', cast(line as varchar(20)), '}},',
      '{"title":"second ', cast(issue_id as varchar(20)), '","confidence":0}]', chr(10), '```', chr(10), 'Done.')
    when 1 then concat('{"severity":"', severity, '","title":"","description":"about ', title, '","location":{"line":', cast(line + 1 as varchar(20)), ',"column":3}}')
    when 2 then concat('No JSON here for ', title)
    else concat('[{"type":"', type, '","title":"broken ', title, '"') end as answer
from {issues}
"""
VALIDATION = """
select issue_id,
  concat('{"type":"', case issue_id % 7 when 0 then 'smell' else type end, '","severity":"', severity,
    case issue_id % 3 when 0 then '' else concat('","title":"', title) end,
    '","description":"d","rationale":"r","confidence":',
    case issue_id % 5 when 0 then '1.5' when 1 then '"high"' else cast(confidence as varchar(20)) end,
    ',"location":{"file":"', file, '","line":', case issue_id % 11 when 0 then '"x"' else cast(line as varchar(20)) end, '}}',
    case issue_id % 13 when 0 then '}' else '' end) as record
from {issues}
"""


def _parse_issues(spark, sf):
    answers = run_sql(spark, sf, ANSWERS)
    return I.parse_issues(answers, "answer", "answer_file").select(
        "issue_id", "ordinal", "issue_file", "type", "severity", "confidence", "title", "description", "line", "column"
    )


QUERIES["parse_issues"] = _parse_issues
ORACLE["parse_issues"] = with_derived("issues", """
with bodies as (
  select issue_id, answer_file, case when strpos(answer, '```json') > 0
    then regexp_extract(answer, '```json\\n([\\s\\S]*?)\\n```', 1) else answer end as body from answers),
good as (
  select issue_id, answer_file, case when starts_with(body, '[') then body else concat('[', body, ']') end as arr
  from bodies where json_valid(body) and regexp_matches(body, '^[\\[{]')),
items as (
  select issue_id, answer_file, g.ordinal, json_extract(arr, concat('$[', g.ordinal, ']')) as j
  from good, lateral (select unnest(range(cast(json_array_length(arr) as bigint))) as ordinal) g)
select issue_id, cast(ordinal as int) as ordinal, answer_file as issue_file,
  coalesce(nullif(j->>'$.type', ''), 'bug') as type,
  coalesce(nullif(j->>'$.severity', ''), 'medium') as severity,
  coalesce(nullif(cast(j->>'$.confidence' as double), 0), 0.7) as confidence,
  coalesce(nullif(j->>'$.title', ''), 'Untitled Issue') as title,
  coalesce(j->>'$.description', '') as description,
  coalesce(nullif(cast(j->>'$.location.line' as int), 0), 1) as line,
  cast(j->>'$.location.column' as int) as "column"
from items""", answers=ANSWERS)


def _validate_issues(spark, sf):
    records = run_sql(spark, sf, VALIDATION)
    return I.validate_issues(records, "record").select(
        "issue_id", "valid", F.array_join("violations", ",").alias("violations")
    )


QUERIES["validate_issues"] = _validate_issues
ORACLE["validate_issues"] = with_derived("issues", """
with docs as (select issue_id, case when json_valid(record) then cast(record as json) end as j from records),
checked as (
  select issue_id, list_filter([
    case when j is null then 'json' end,
    case when not coalesce(j->>'$.type' in ('bug','security','performance','style','best-practice'), false) then 'type' end,
    case when not coalesce(j->>'$.severity' in ('critical','high','medium','low','info'), false) then 'severity' end,
    case when not coalesce(json_type(j, '$.title') = 'VARCHAR', false) then 'title' end,
    case when not coalesce(json_type(j, '$.description') = 'VARCHAR', false) then 'description' end,
    case when not coalesce(json_type(j, '$.location.file') = 'VARCHAR', false) then 'location.file' end,
    case when not coalesce(json_type(j, '$.location.line') in ('UBIGINT','BIGINT','DOUBLE'), false) then 'location.line' end,
    case when not coalesce(json_type(j, '$.rationale') = 'VARCHAR', false) then 'rationale' end,
    case when not coalesce(json_type(j, '$.confidence') in ('UBIGINT','BIGINT','DOUBLE')
      and try_cast(j->>'$.confidence' as double) between 0 and 1, false) then 'confidence' end
    ], lambda v: v is not null) as v
  from docs)
select issue_id, len(v) = 0 as valid, array_to_string(v, ',') as violations from checked""", records=VALIDATION)
