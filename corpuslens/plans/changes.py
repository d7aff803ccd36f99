"""Queries over unified diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.code_text import LINE_COMMENT, LINE_LITERAL
from corpuslens.operators import changes as A
from corpuslens.operators import diffs as D
from corpuslens.plans.corpus import LANG_SQL
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Line table by windows over the whole diff, an independent way to the same rows.
LINES = r"""
raw as (select diff_id, generate_subscripts(ls, 1) as i, unnest(ls) as l
  from (select diff_id, string_split(diff_text, chr(10)) as ls from diffs) s),
m1 as (select *, sum(case when starts_with(l, 'diff --git ') then 1 else 0 end) over (partition by diff_id order by i) - 1 as file_no,
    regexp_matches(l, '^@@ -\d+(,\d*)? \+\d+(,\d*)? @@') as is_hunk from raw),
m2 as (select *, sum(case when is_hunk then 1 else 0 end) over (partition by diff_id, file_no order by i) - 1 as hunk_no from m1 where file_no >= 0),
df as (select diff_id, file_no, regexp_extract(head, '^diff --git a/(.*?) b/(.*)', 2) as path,
    regexp_extract(head, '^diff --git a/(.*?) b/(.*)', 1) as old_path0,
    case when is_new then 'added' when is_del then 'deleted'
      when regexp_extract(head, '^diff --git a/(.*?) b/(.*)', 1) <> regexp_extract(head, '^diff --git a/(.*?) b/(.*)', 2) then 'renamed' else 'modified' end as status
  from (select diff_id, file_no, arg_min(l, i) as head, bool_or(starts_with(l, 'new file mode')) as is_new,
      bool_or(starts_with(l, 'deleted file mode')) as is_del from m2 group by 1, 2) g),
hunks as (select diff_id, file_no, hunk_no, cast(regexp_extract(l, '^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)', 1) as int) as old_start,
    regexp_extract(l, '^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)', 2) as ol,
    cast(regexp_extract(l, '^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)', 3) as int) as new_start,
    regexp_extract(l, '^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)', 4) as nl,
    trim(regexp_extract(l, '^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)', 5)) as heading from m2 where is_hunk),
ln as (select diff_id, file_no, hunk_no, i, left(l, 1) as mark, substr(l, 2) as content from m2
  where hunk_no >= 0 and not is_hunk and left(l, 1) in ('+', '-', ' ')),
nl as (select ln.*, h.heading, df.path, df.status,
    row_number() over w - 1 as line_no,
    case when mark <> '+' then h.old_start + coalesce(sum(case when mark <> '+' then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) end as old_no,
    case when mark <> '-' then h.new_start + coalesce(sum(case when mark <> '-' then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) end as new_no
  from ln join hunks h using (diff_id, file_no, hunk_no) join df using (diff_id, file_no)
  window w as (partition by diff_id, file_no, hunk_no order by i))"""

QUERIES["parse_diff"] = lambda spark, sf: D.parse_diff(table(spark, sf, "diffs"))
ORACLE["parse_diff"] = with_derived("diffs", f"""
with {LINES}
select diff_id, cast(file_no as int) as file_no, path, status, cast(hunk_no as int) as hunk_no, cast(line_no as int) as line_no,
  case mark when '+' then 'added' when '-' then 'removed' else 'context' end as line_type, content,
  cast(old_no as int) as old_no, cast(new_no as int) as new_no from nl""")

QUERIES["diff_files"] = lambda spark, sf: D.diff_files(table(spark, sf, "diffs")).drop("block")
ORACLE["diff_files"] = with_derived("diffs", f"""
with {LINES}
select diff_id, cast(file_no as int) as file_no, path, case when old_path0 <> path then old_path0 end as old_path, status,
  {LANG_SQL} as language from df""")

QUERIES["diff_hunks"] = lambda spark, sf: D.diff_hunks(D.diff_files(table(spark, sf, "diffs"))).drop("lines", "marks")
ORACLE["diff_hunks"] = with_derived("diffs", f"""
with {LINES}
select h.diff_id, cast(h.file_no as int) as file_no, df.path, df.status, cast(h.hunk_no as int) as hunk_no, old_start,
  case ol when '' then 1 else cast(ol as int) end as old_lines, new_start, case h.nl when '' then 1 else cast(h.nl as int) end as new_lines,
  heading, cast(count(*) filter (where mark = '+') as int) as added, cast(count(*) filter (where mark = '-') as int) as removed
from hunks h join df using (diff_id, file_no) left join ln using (diff_id, file_no, hunk_no)
group by all""")

QUERIES["diff_stats"] = lambda spark, sf: D.diff_stats(table(spark, sf, "diffs"))
ORACLE["diff_stats"] = with_derived("diffs", f"""
with {LINES}
select diff_id, cast((select count(*) from df where df.diff_id = d.diff_id) as int) as files_changed,
  (select count(*) from ln where ln.diff_id = d.diff_id and mark = '+') as additions,
  (select count(*) from ln where ln.diff_id = d.diff_id and mark = '-') as deletions from diffs d""")

QUERIES["changed_code"] = lambda spark, sf: D.changed_code(D.diff_files(table(spark, sf, "diffs")))
ORACLE["changed_code"] = with_derived("diffs", f"""
with {LINES},
parts as (
  select diff_id, file_no, hunk_no, cast(-1 as bigint) as line_no, concat('// ', heading) as t from hunks where heading <> ''
  union all select diff_id, file_no, hunk_no, line_no, concat(cast(new_no as bigint), ': ', content) from nl where mark <> '-')
select df.diff_id, cast(df.file_no as int) as file_no, df.path, df.status,
  coalesce(string_agg(t, chr(10) order by hunk_no, line_no), '') as code
from df left join parts using (diff_id, file_no) group by 1, 2, 3, 4""")

TENTHS_SQL = " + ".join(f"{w} * len(regexp_extract_all(code, '{p}'))" for w, p in A.CONSTRUCTS)
LITERAL, COMMENT = (p.replace("'", "''") for p in (LINE_LITERAL, LINE_COMMENT))
CODE = rf"""
fragment as (select df.diff_id, df.file_no, df.path, df.status,
  coalesce(string_agg(content, chr(10) order by hunk_no, i) filter (where mark <> ' '), '') as code
  from df left join ln using (diff_id, file_no) group by 1, 2, 3, 4),
code as (select diff_id, file_no, path, status,
  regexp_replace(regexp_replace(code, '({LITERAL})|{COMMENT}', '\1', 'g'), '{LITERAL}', '""', 'g') as code from fragment)"""

QUERIES["code_complexity"] = lambda spark, sf: A.code_complexity(D.diff_files(table(spark, sf, "diffs")))
ORACLE["code_complexity"] = with_derived("diffs", f"""
with {LINES}, {CODE}
select diff_id, cast(file_no as int) as file_no, path, ({TENTHS_SQL}) / 10.0::double as complexity from code""")

HEAD = r"\bfunction\s*\*?\s*(\w*)\s*(?:<[^>\n]*>)?\s*\(([^)]*)\)\s*(?::\s*([^{\n]*))?"
METHOD = r"(?m)^\s*(?:public\s+|static\s+|async\s+)*[A-Za-z_]\w*\s*\([^)\n]*\)\s*(?::\s*[^{\n]*)?\{"
BREAKING = rf"""
bh as (select diff_id, file_no, hunk_no,
    coalesce(string_agg(trim(content), chr(10) order by i) filter (where mark = '-'), '') as gone,
    coalesce(string_agg(trim(content), chr(10) order by i) filter (where mark = '+'), '') as new
  from ln group by 1, 2, 3),
bx as (select *, regexp_matches(gone, '{HEAD}') as has_old, regexp_matches(new, '{HEAD}') as has_new,
    trim(regexp_replace(coalesce(regexp_extract_all(gone, '{HEAD}', 2)[-1], ''), '\s*,\s*', ',', 'g')) as p_old,
    trim(regexp_replace(coalesce(regexp_extract_all(new, '{HEAD}', 2)[-1], ''), '\s*,\s*', ',', 'g')) as p_new,
    coalesce(nullif(trim(regexp_extract_all(gone, '{HEAD}', 3)[-1]), ''), 'any') as r_old,
    coalesce(nullif(trim(regexp_extract_all(new, '{HEAD}', 3)[-1]), ''), 'any') as r_new from bh),
bf as (select diff_id, file_no, bool_or(regexp_matches(gone, '(?m)^export ') or
    ((has_old or (regexp_matches(gone, '\bclass\s+\w') and regexp_matches(gone, '{METHOD}'))) and
      case when new = '' then true else has_old and has_new and (p_old <> p_new or r_old <> r_new) end)) as b
  from bx group by 1, 2),
br as (select df.diff_id, df.file_no, df.path, df.status, df.status = 'deleted' or
    (lower(regexp_extract(path, '[^.]*$')) in ('ts', 'tsx', 'js', 'jsx') and coalesce(b, false)) as breaking
  from df left join bf using (diff_id, file_no))"""


def _like_any(words, column="path"):
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


TEST_SQL = _like_any(P.TEST_MARKS)
DOC_SQL = "(" + " or ".join(f"ends_with(path, '{e}')" for e in P.DOC_ENDINGS) + " or contains(path, '/docs/'))"
CRITICAL_SQL = _like_any(P.CRITICAL_WORDS, "lower(path)")
CONFIG_SQL = _like_any(P.CONFIG_MARKS)

QUERIES["breaking_changes"] = lambda spark, sf: A.file_facts(table(spark, sf, "diffs")).select(
    "diff_id", "file_no", "path", "status", "breaking"
)
ORACLE["breaking_changes"] = with_derived("diffs", f"""
with {LINES}, {BREAKING}
select diff_id, cast(file_no as int) as file_no, path, status, breaking from br""")

ANALYSIS = f"""
with {LINES}, {CODE}, {BREAKING},
cx as (select diff_id, file_no, {TENTHS_SQL} as tenths from code),
st as (select diff_id, file_no, count(*) filter (where mark = '+') as a, count(*) filter (where mark = '-') as r from ln group by 1, 2),
agg as (select d.diff_id, count(br.path) as files_changed, cast(coalesce(sum(a), 0) as bigint) as lines_added,
    cast(coalesce(sum(r), 0) as bigint) as lines_removed, coalesce(sum(tenths), 0) as tenths,
    coalesce(bool_and({TEST_SQL}), true) as tests, coalesce(bool_and({DOC_SQL}), true) as docs,
    coalesce(bool_and({CONFIG_SQL}), true) as config, coalesce(bool_or(status = 'added'), false) as new,
    coalesce(bool_or({TEST_SQL}), false) as test_coverage, coalesce(bool_or({CRITICAL_SQL}), false) as critical_files,
    coalesce(bool_or(breaking), false) as breaking_change
  from diffs d left join br using (diff_id) left join cx using (diff_id, file_no) left join st using (diff_id, file_no)
  group by d.diff_id),
sc as (select *, round(files_changed * 5.0::double + least((lines_added + lines_removed) / 10.0::double, 50) + tenths
    + case when critical_files then 30 else 0 end + case when breaking_change then 40 else 0 end, 6) as complexity_score from agg),
cl as (select *, case when complexity_score < 20 then 'trivial' when complexity_score < 50 then 'low' when complexity_score < 100 then 'medium'
    when complexity_score < 200 then 'high' else 'critical' end as complexity,
  case when tests then 'test' when docs then 'docs' when new and lines_added > 2 * lines_removed then 'feature'
    when abs(lines_added - lines_removed) < 50 and lines_added + lines_removed > 100 then 'refactor'
    when lines_added + lines_removed < 50 and not new then 'bugfix' when config then 'chore' else 'feature' end as change_type from sc)
"""
QUERIES["change_complexity"] = lambda spark, sf: A.analyze_changes(table(spark, sf, "diffs")).select(
    "diff_id", "complexity_score", "complexity", "files_changed", "lines_added", "lines_removed"
)
ORACLE["change_complexity"] = with_derived("diffs", ANALYSIS + """
select diff_id, complexity_score, complexity, files_changed, lines_added, lines_removed from cl""")
QUERIES["change_type"] = lambda spark, sf: A.analyze_changes(table(spark, sf, "diffs")).select(
    "diff_id", "change_type", "test_coverage", "breaking_change"
)
ORACLE["change_type"] = with_derived("diffs", ANALYSIS + "select diff_id, change_type, test_coverage, breaking_change from cl")
QUERIES["risk_score"] = lambda spark, sf: A.analyze_changes(table(spark, sf, "diffs")).select(
    "diff_id", "risk_score", "critical_files"
)
ORACLE["risk_score"] = with_derived("diffs", ANALYSIS + """
select diff_id, critical_files, cast(least(100, case complexity when 'trivial' then 5 when 'low' then 15 when 'medium' then 30 when 'high' then 50 else 70 end
  + case when critical_files then 20 else 0 end + case when breaking_change then 25 else 0 end + case when test_coverage then 0 else 15 end) as int) as risk_score from cl""")

QUERIES["affected_modules"] = lambda spark, sf: A.affected_modules(D.diff_files(table(spark, sf, "diffs")))
ORACLE["affected_modules"] = with_derived("diffs", f"""
with {LINES},
parts as (select diff_id, path, string_split(path, '/') as p from df)
select diff_id, p[1] as module from parts where len(p) > 1
union select diff_id, p[-2] from parts where len(p) > 2
union select diff_id, 'authentication' from parts where contains(path, 'auth') or contains(path, 'login')
union select diff_id, 'payments' from parts where contains(path, 'payment') or contains(path, 'billing')
union select diff_id, 'api' from parts where contains(path, 'api') or contains(path, 'endpoint')
union select diff_id, 'database' from parts where contains(path, 'database') or contains(path, 'db')
union select diff_id, 'ui' from parts where contains(path, 'ui') or contains(path, 'component')""")

QUERIES["path_classes"] = lambda spark, sf: D.diff_files(table(spark, sf, "diffs")).select(
    "diff_id", "path", P.is_test(F.col("path")).alias("is_test"), P.is_doc(F.col("path")).alias("is_doc"),
    P.is_critical(F.col("path")).alias("is_critical"), P.is_config(F.col("path")).alias("is_config"),
)
ORACLE["path_classes"] = with_derived("diffs", f"""
with {LINES}
select diff_id, path, {TEST_SQL} as is_test, {DOC_SQL} as is_doc, {CRITICAL_SQL} as is_critical, {CONFIG_SQL} as is_config from df""")

ENDS = lambda words: "(" + " or ".join(f"ends_with(lower(path), '{w}')" for w in words) + ")"
QUERIES["reviewable_files"] = lambda spark, sf: D.diff_files(table(spark, sf, "diffs")).filter(
    P.is_reviewable(F.col("path"), F.col("status"))
).select("diff_id", "file_no", "path", "status")
ORACLE["reviewable_files"] = with_derived("diffs", f"""
with {LINES}
select diff_id, cast(file_no as int) as file_no, path, status from df
where status <> 'deleted' and not {ENDS(P.SKIPPED_ENDINGS)} and {ENDS(P.CODE_ENDINGS)}""")

# Originals and fixes: the same text, a line in front, or a line at the end.
FIXES = """
select doc_id, text as original_code,
  case doc_id % 3 when 0 then text when 1 then concat('// fixed', chr(10), text)
    else concat(text, chr(10), 'tail') end as fixed_code,
  case doc_id % 2 when 0 then '@@ given @@' end as given_diff, lang as code
from {documents}
"""


def _suggestions(spark, sf):
    df = D.suggestion_diff(run_sql(spark, sf, FIXES), "original_code", "fixed_code")
    shown = D.suggestion_text(*[F.col(c) for c in ("suggestion_diff", "original_code", "fixed_code", "given_diff", "code")])
    return df.select("doc_id", "suggestion_diff", shown.alias("shown"))


QUERIES["suggestion_diff"] = _suggestions
RANGE = "case {n} when 1 then cast({at} as varchar) else concat({at}, ',', {n}) end"
ORACLE["suggestion_diff"] = with_derived("", rf"""
with o as (select *, string_split(case when ends_with(original_code, chr(10)) then left(original_code, length(original_code) - 1) else original_code end, chr(10)) as ls from fixes),
c as (select *, len(ls) as n, least(3, len(ls)) as k, case when ends_with(original_code, chr(10)) then 2 else 1 end as added from o),
d as (select doc_id, original_code, given_diff, code, case when original_code = '' or doc_id % 3 = 0 then null
  when doc_id % 3 = 1 then concat('@@ -', {RANGE.format(at="1", n="k")}, ' +', {RANGE.format(at="1", n="(k + 1)")}, ' @@', chr(10), '+// fixed', chr(10),
    array_to_string(list_transform(ls[1:k], lambda x: concat(' ', x)), chr(10)))
  else concat('@@ -', {RANGE.format(at="(n - k + 1)", n="k")}, ' +', {RANGE.format(at="(n - k + 1)", n="(k + added)")}, ' @@', chr(10),
    array_to_string(list_transform(ls[n - k + 1:n], lambda x: concat(' ', x)), chr(10)), chr(10), case added when 2 then concat('+', chr(10)) else '' end, '+tail') end as x from c)
select doc_id, regexp_replace(x, '\s+$', '') as suggestion_diff,
  case when original_code <> '' then regexp_replace(x, '\s+$', '') when given_diff is not null then given_diff else concat('+ ', code) end as shown from d""", fixes=FIXES)

# The three sources of changed paths in a working tree, by key; a path may be in two of them.
WORKTREE = """
select repo, path, 'staged' as state from {files}
union all select repo, case doc_id % 2 when 0 then path else concat(path, '.new') end, 'untracked' from {files}
union all select repo, path, 'modified' from {files}
"""


def _changed_files(spark, sf):
    tree = run_sql(spark, sf, WORKTREE)
    return D.changed_paths(*[tree.filter(F.col("state") == s) for s in ("staged", "untracked", "modified")]).groupBy(
        "repo", "path"
    ).agg(F.count(F.lit(1)).alias("times"))


QUERIES["changed_files"] = _changed_files
ORACLE["changed_files"] = with_derived("files", "select repo, path, count(*) as times from worktree group by 1, 2", worktree=WORKTREE)

COMMITS = """
select concat('r', cast(event_id % 2 as varchar(20))) as repo, concat('file', cast(user_id as varchar(20))) as path, md5(cast(event_id as varchar(20))) as sha, ts,
  event_type as message, cast(user_id % 7 as varchar(20)) as author from {events}
"""
QUERIES["file_history"] = lambda spark, sf: D.file_history(run_sql(spark, sf, COMMITS)).select("repo", "path", "sha", "message", "author")
ORACLE["file_history"] = with_derived("", """
select repo, path, sha, message, author from (
  select *, row_number() over (partition by repo, path order by ts desc, sha) as rn from commits) s where rn <= 10""", commits=COMMITS)
