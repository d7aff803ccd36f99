"""Queries over review memory, tool-call logs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import conversations as V
from corpuslens.operators import memory as M
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def _memory(spark, sf):
    return table(spark, sf, "issues")


QUERIES["memory_retention"] = lambda spark, sf: M.retain(_memory(spark, sf)).select("repo", "issue_id", "type", "severity")
ORACLE["memory_retention"] = with_derived("issues", """
select repo, issue_id, type, severity from (select *, row_number() over (partition by repo order by ts desc, issue_id desc) as rn from issues) s where rn <= 1000""")

QUERIES["apply_feedback"] = lambda spark, sf: M.apply_feedback(_memory(spark, sf), table(spark, sf, "feedback_log")).select(
    "issue_id", "type", "severity", "feedback"
)
ORACLE["apply_feedback"] = with_derived("issues feedback_log", """
with last as (select issue_id, arg_max(feedback, struct_pack(ts := ts, seq := seq)) as f from feedback_log group by issue_id)
select i.issue_id, type, severity, coalesce(f, feedback) as feedback from issues i left join last using (issue_id)""")

QUERIES["acceptance_rate"] = lambda spark, sf: M.acceptance_rate(_memory(spark, sf), ["file", "type", "severity"])
ORACLE["acceptance_rate"] = with_derived("issues", """
select file, type, severity, count(feedback) as with_feedback,
  round(case when count(feedback) = 0 then 0.5 else count(*) filter (where feedback in ('accepted', 'fixed')) / count(feedback)::double end, 6) as acceptance_rate
from issues group by 1, 2, 3""")

QUERIES["memory_stats"] = lambda spark, sf: M.memory_stats(_memory(spark, sf))
ORACLE["memory_stats"] = with_derived("issues", """
select count(*) as total_reviews, count(feedback) as with_feedback,
  round(count(*) filter (where feedback in ('accepted', 'fixed')) / count(feedback)::double, 6) as acceptance_rate from issues""")

QUERIES["top_issue_types"] = lambda spark, sf: M.top_issue_types(_memory(spark, sf), 3)
ORACLE["top_issue_types"] = with_derived("issues", "select type, count(*) as n from issues group by type order by n desc, type limit 3")


def _patterns(spark, sf, by_repo=False):
    return M.learned_patterns(_memory(spark, sf), table(spark, sf, "feedback_log"), by_repo)


LEARNED = """
lp as (select {keys} pattern, count(*) as occurrences, round(avg(case when f.feedback in ('accepted', 'fixed') then 1.0::double else 0 end), 6) as acceptance_rate, max(f.ts) as last_seen
  from feedback_log f join (select issue_id, repo, concat(type, ':', severity) as pattern from issues) i using (issue_id) group by {keys} pattern),
lc as (select *, round(least(0.95::double, acceptance_rate * 0.9::double + 0.1::double), 6) as confidence from lp)"""
QUERIES["learned_patterns"] = lambda spark, sf: _patterns(spark, sf, True).withColumn("last_seen", F.date_format("last_seen", STAMP))
ORACLE["learned_patterns"] = with_derived("issues feedback_log", f"""
with {LEARNED.format(keys='repo,')}
select repo, pattern, occurrences, acceptance_rate, strftime(last_seen, {STAMP_SQL}) as last_seen, confidence from lc""")

QUERIES["memory_export"] = lambda spark, sf: M.memory_export(_memory(spark, sf), _patterns(spark, sf))
ORACLE["memory_export"] = with_derived("issues feedback_log", f"""
with {LEARNED.format(keys='')},
st as (select count(*) as n, count(feedback) as w, round(count(*) filter (where feedback in ('accepted', 'fixed')) / count(feedback)::double, 6) as r from issues)
select concat('{{"stats":{{"total_reviews":', n, ',"with_feedback":', w, ',"acceptance_rate":', r, '}},"patterns":[',
  (select string_agg(concat('{{"pattern":"', pattern, '","occurrences":', occurrences, ',"acceptance_rate":', acceptance_rate, ',"confidence":', confidence, '}}'), ',' order by pattern) from lc), ']}}') as export from st""")

QUERIES["similar_issues"] = lambda spark, sf: M.similar_issues(_memory(spark, sf), _memory(spark, sf), 2).select(
    "issue_id", "past_id", "past_file"
)
ORACLE["similar_issues"] = with_derived("issues", r"""
with m as (select *, regexp_extract(file, '[^/](\.[^./]*)$', 1) as ext, len(string_split(file, '/')) as depth from issues),
g as (select distinct type, ext, depth from m),
best as (select * from (select g.type, g.ext, g.depth, m.issue_id as past_id, m.file as past_file,
    row_number() over (partition by g.type, g.ext, g.depth order by m.ts desc, m.issue_id) as rn
  from g join m on m.type = g.type and m.ext = g.ext and abs(m.depth - g.depth) <= 1) s where rn <= 2)
select m.issue_id, b.past_id, b.past_file from m join best b on b.type = m.type and b.ext = m.ext and b.depth = m.depth""")

TTL = 7 * 24 * 60
QUERIES["tool_budget"] = lambda spark, sf: M.replay_calls(table(spark, sf, "odd_calls"), TTL).select(
    "call_id", "session", "tool", "search_key", "outcome"
)
REPLAY = """
mk as (select *, row_number() over (partition by session, tool, search_key order by ts, call_id) = 1
    or epoch_us(ts) - epoch_us(min(ts) over (partition by session)) > 604800000000 as miss from odd_calls),
pr as (select *, coalesce(sum(case when miss then 1 else 0 end) over (partition by session, tool order by ts, call_id rows between unbounded preceding and 1 preceding), 0) as prior,
    case tool when 'search' then 5 when 'callers' then 2 when 'test' then 3 when 'related' then 3 when 'usages' then 3 end as lim from mk),
rp as (select *, case when prior >= lim then 'refused' when miss then 'miss' else 'hit' end as outcome from pr)"""
ORACLE["tool_budget"] = with_derived("odd_calls", f"with {REPLAY} select call_id, session, tool, search_key, outcome from rp")

QUERIES["cache_metrics"] = lambda spark, sf: M.cache_metrics(M.replay_calls(table(spark, sf, "odd_calls"), TTL))
ORACLE["cache_metrics"] = with_derived("odd_calls", f"""
with {REPLAY}
select session, count(*) filter (where outcome = 'hit') as cache_hits, count(*) filter (where outcome = 'miss') as cache_misses,
  count(*) filter (where outcome = 'miss') as calls, arg_max(duration_ms, struct_pack(ts := ts, call_id := call_id)) filter (where outcome = 'miss') as last_duration_ms
from rp group by session""")

QUERIES["cache_hits"] = lambda spark, sf: M.cache_hits(table(spark, sf, "odd_calls"), TTL).select("call_id", "session", "search_key", "hit")
ORACLE["cache_hits"] = with_derived("odd_calls", """
select call_id, session, search_key, row_number() over (partition by session, search_key order by ts, call_id) > 1
  and epoch_us(ts) - epoch_us(min(ts) over (partition by session)) <= 604800000000 as hit from odd_calls""")

QUERIES["render_conversation"] = lambda spark, sf: V.render_conversation(table(spark, sf, "conversations"))
BLOCK_SQL = """case role when 'system' then concat('System: ', text) when 'user' then concat('User: ', text)
  when 'assistant' then concat('Assistant: ', text) else coalesce(text, '') end"""
ORACLE["render_conversation"] = f"select conv_id, turn, {BLOCK_SQL} as rendered from conversations"
QUERIES["joined_conversation"] = lambda spark, sf: V.joined_conversation(table(spark, sf, "conversations"))
ORACLE["joined_conversation"] = f"""
select conv_id, string_agg({BLOCK_SQL}, concat(chr(10), chr(10)) order by turn) as rendered, count(*) as turns
from conversations group by conv_id"""

# Turns of which some have no role.
TURNS = "select conv_id, turn, case when (conv_id + turn) % 7 = 0 then null else role end as role, text from {conversations}"
QUERIES["split_system"] = lambda spark, sf: V.split_system(run_sql(spark, sf, TURNS))
ORACLE["split_system"] = with_derived("", """
select conv_id, case when role in ('system', 'user') then role else 'assistant' end as role, turn, text from turns""", turns=TURNS)

USAGES = """
select event_id as record_id, concat('{"stream":', case event_id % 3 when 0 then 'null' when 1 then concat('{"inputTokens":', cast(event_id % 5 as varchar(20)), ',"outputTokens":7}') else '{"promptTokens":0,"totalTokens":11}' end,
  ',"captured":', case event_id % 2 when 0 then 'null' else concat('{"promptTokens":', cast(event_id % 4 as varchar(20)), ',"completionTokens":0}') end,
  ',"final":{"inputTokens":', cast(event_id as varchar(20)), ',"completionTokens":9,"totalTokens":', cast(event_id % 2 * 100 as varchar(20)), '}}') as record,
  case event_id % 6 when 0 then 'end_turn' when 1 then 'MAX_TOKENS' when 2 then 'SAFETY' when 3 then 'tool_calls' when 4 then 'odd' end as code
from {events}
"""
QUERIES["usage_normalize"] = lambda spark, sf: V.usage_normalize(run_sql(spark, sf, USAGES), "record").select(
    "record_id", "prompt_tokens", "completion_tokens", "total_tokens", V.finish_reason(F.col("code")).alias("finish_reason")
)
ORACLE["usage_normalize"] = with_derived("", """
with j as (select record_id, code, cast(record as json) as r from usages)
select record_id,
  coalesce(nullif(cast(r->>'$.stream.inputTokens' as bigint), 0), nullif(cast(r->>'$.stream.promptTokens' as bigint), 0), nullif(cast(r->>'$.captured.promptTokens' as bigint), 0),
    nullif(cast(r->>'$.final.promptTokens' as bigint), 0), nullif(cast(r->>'$.final.inputTokens' as bigint), 0), 0) as prompt_tokens,
  coalesce(nullif(cast(r->>'$.stream.outputTokens' as bigint), 0), nullif(cast(r->>'$.stream.completionTokens' as bigint), 0), nullif(cast(r->>'$.captured.completionTokens' as bigint), 0),
    nullif(cast(r->>'$.final.completionTokens' as bigint), 0), nullif(cast(r->>'$.final.outputTokens' as bigint), 0), 0) as completion_tokens,
  coalesce(nullif(cast(r->>'$.stream.totalTokens' as bigint), 0), nullif(cast(r->>'$.captured.totalTokens' as bigint), 0), nullif(cast(r->>'$.final.totalTokens' as bigint), 0), 0) as total_tokens,
  case code when 'MAX_TOKENS' then 'length' when 'SAFETY' then 'content_filter' when 'tool_calls' then 'tool_calls' else 'stop' end as finish_reason from j""", usages=USAGES)
