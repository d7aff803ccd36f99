"""Batch twins of the streaming queries: same functions, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import deltas as D
from corpuslens.operators.chunks import chunk_files
from corpuslens.plans.corpus import chunk_sql
from corpuslens.plans.derived import run_sql, table, with_derived
from corpuslens.streaming.activity import activity_sessions, activity_windows
from corpuslens.streaming.index_stream import changes_after

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _events(spark, sf):
    return D.parse_sse(table(spark, sf, "answer_streams"))


SSE = r"""
rw as (select stream_id, i - 1 as seq, trim(ls[i]) as l from (select stream_id, ls, unnest(range(1, len(ls) + 1)) as i from (select stream_id, string_split(body, chr(10)) as ls from answer_streams) a) b),
js as (select stream_id, seq, cast(substr(l, 7) as json) as j from rw where starts_with(l, 'data: ') and l <> 'data: [DONE]' and json_valid(substr(l, 7))),
ev as (
  select stream_id, seq, 1 as o, 'reasoning_delta' as type, j->>'$.choices[0].delta.reasoning' as delta, null as stop_reason, j from js where j->>'$.choices[0].delta.reasoning' <> ''
  union all select stream_id, seq, 2, 'content_delta', j->>'$.choices[0].delta.content', null, j from js where j->>'$.choices[0].delta.content' <> ''
  union all select stream_id, seq, 3, 'content_delta', j->>'$.delta.text', null, j from js where j->>'$.type' = 'content_block_delta' and j->>'$.delta.text' <> ''
  union all select stream_id, seq, 4, 'message_stop', '', coalesce(nullif(j->>'$.stop_reason', ''), nullif(j->>'$.choices[0].finish_reason', ''), 'end_turn'), j
    from js where j->>'$.type' = 'message_stop' or j->>'$.choices[0].finish_reason' <> ''),
pe as (select stream_id, cast(seq as int) as seq, cast(row_number() over (partition by stream_id, seq order by o) - 1 as int) as part, type, delta, stop_reason,
  cast(j->>'$.usage.total_tokens' as bigint) as total_tokens from ev)"""
QUERIES["parse_sse"] = lambda spark, sf: _events(spark, sf).select(
    "stream_id", "seq", "part", "type", "delta", "stop_reason", F.col("usage.total_tokens").alias("total_tokens")
)
ORACLE["parse_sse"] = with_derived("answer_streams", f"with {SSE} select * from pe")

QUERIES["reassemble_stream"] = lambda spark, sf: D.reassemble(_events(spark, sf)).select(
    "stream_id", "text", "reasoning", F.col("usage.total_tokens").alias("total_tokens"), "stop_reason", "chunk_count",
    F.array_join("chunk_types", ",").alias("chunk_types"),
)
# The answer put together from its parts must be the text it was cut from.
ORACLE["reassemble_stream"] = with_derived("answer_streams", f"""
with {SSE},
n as (select stream_id, count(*) as chunk_count, array_to_string(list_sort(list_distinct(list(type))), ',') as chunk_types, max(total_tokens) as total_tokens, max(stop_reason) as stop_reason,
  coalesce(string_agg(delta, '') filter (where type = 'reasoning_delta'), '') as reasoning from pe group by 1)
select stream_id, a.text, reasoning, total_tokens, stop_reason, chunk_count, chunk_types from n join answer_streams a using (stream_id)""")

LINES = """
select conv_id * 1000 + turn as stream_id, case turn % 4 when 0 then concat('{"response":"r', cast(turn as varchar(20)), '"}') when 1 then '{"response":"","done":true}'
  when 2 then concat('{"response":"cut', cast(conv_id as varchar(20))) else '{"done":false}' end as raw from {conversations}
"""
QUERIES["parse_json_lines"] = lambda spark, sf: D.parse_json_lines(run_sql(spark, sf, LINES), "raw", ["stream_id"])
ORACLE["parse_json_lines"] = with_derived("", """
with j as (select stream_id, case when json_valid(raw) then cast(raw as json) end as d from raw_lines)
select stream_id, coalesce(d->>'$.response', '') as delta, coalesce(cast(d->>'$.done' as boolean), false) as done from j
where d->>'$.response' <> '' or cast(d->>'$.done' as boolean)""", raw_lines=LINES)

# Agent chunks: reasoning in several kinds and a closing summary that may repeat what was said.
CHUNKS = """
select user_id as stream_id, event_id as seq,
  case event_id % 5 when 0 then 'reasoning-delta' when 1 then 'text-delta' when 2 then 'thinking-delta' when 3 then 'finish' else 'object' end as type,
  case event_id % 5 when 1 then 'text' else concat('[', cast(event_id % 7 as varchar(20)), ']') end as delta,
  case event_id % 5 when 1 then case event_id % 2 when 0 then concat('<', cast(event_id % 3 as varchar(20)), '>') end when 3 then concat('[', cast(event_id % 9 as varchar(20)), ']') end as reasoning
from {events}
"""
QUERIES["fold_reasoning"] = lambda spark, sf: D.fold_reasoning(run_sql(spark, sf, CHUNKS))
ORACLE["fold_reasoning"] = with_derived("", """
with recursive p as (select stream_id, row_number() over (partition by stream_id order by seq) as k, piece, closing from (
    select stream_id, seq, case when type in ('reasoning-delta', 'thinking-delta') then delta when type in ('text-delta', 'finish') then reasoning end as piece, type = 'finish' as closing from agent_chunks) s
  where piece <> ''),
f as (select distinct stream_id, 0 as k, '' as t from p
  union all select f.stream_id, p.k, case when p.closing and contains(f.t, p.piece) then f.t else concat(f.t, p.piece) end from f join p on p.stream_id = f.stream_id and p.k = f.k + 1)
select stream_id, arg_max(t, k) as reasoning from f group by 1""", agent_chunks=CHUNKS)

QUERIES["progress_state"] = lambda spark, sf: D.progress_state(table(spark, sf, "progress_events"))
ORACLE["progress_state"] = with_derived("progress_events", """
select session, arg_max(file_name, seq) filter (where type in ('agent-start', 'file-start')) as current_file,
  arg_max(agent, seq) filter (where type in ('agent-start', 'file-start')) as current_agent,
  coalesce(arg_max(case type when 'thinking' then content else '' end, seq) filter (where type in ('thinking', 'agent-start')), '') as thinking_content,
  coalesce(arg_max(case type when 'text' then content else '' end, seq) filter (where type in ('text', 'agent-start')), '') as review_content,
  coalesce(arg_max(type = 'thinking', seq) filter (where type in ('thinking', 'text', 'agent-start', 'agent-complete')), false) as is_thinking,
  bool_or(type = 'complete') as is_complete, count(*) filter (where type = 'file-complete') as files_processed
from progress_events group by session""")

QUERIES["change_event_index"] = lambda spark, sf: chunk_files(changes_after(table(spark, sf, "change_events"))).select(
    "repo", "file_path", "chunk_id", "line_start", "line_end", F.md5("text").alias("text_hash")
)
ORACLE["change_event_index"] = with_derived("change_events", f"""
with recursive last as (select repo, path, arg_max(op, seq) as op, arg_max(content, seq) filter (where op <> 'unlink') as content from change_events group by 1, 2),
kept as (select repo, path, content from last where op <> 'unlink' and content <> ''), {chunk_sql('kept')}
select repo, path as file_path, concat(path, '::chunk-', chunk_index) as chunk_id, line_start, line_end, md5(text) as text_hash from cut""")

# Review activity as it is delivered: every event at least once, an event with an error three times.
DELIVERED = """
select event_id, ts, user_id, event_type, value from {events}
union all select event_id, ts, user_id, event_type, value from {events} where event_type = 'error'
union all select event_id, ts, user_id, event_type, value from {events} where event_type = 'error'
"""
SHOWN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _shown(df, *columns):
    return df.withColumns({c: F.date_format(c, SHOWN) for c in columns})


QUERIES["activity_windows"] = lambda spark, sf: _shown(
    activity_windows(run_sql(spark, sf, DELIVERED), ["event_type"], "6 hours", "2 hours", "value"), "window_start", "window_end"
)
ORACLE["activity_windows"] = with_derived("", """
with once as (select distinct * from delivered where ts is not null),
slots as (select *, unnest([0, 2, 4]) as back from once)
select event_type, strftime(w, '%Y-%m-%d %H:%M:%S.%f') as window_start, strftime(w + interval 6 hour, '%Y-%m-%d %H:%M:%S.%f') as window_end,
  count(*) as n_events, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total_cents
from (select *, time_bucket(interval 2 hour, ts, timestamp '1970-01-01') - to_hours(back) as w from slots) s group by event_type, w""", delivered=DELIVERED)

QUERIES["activity_sessions"] = lambda spark, sf: _shown(
    activity_sessions(run_sql(spark, sf, DELIVERED), ["user_id"], "4 hours", "value"), "session_start", "session_end"
)
ORACLE["activity_sessions"] = with_derived("", """
with once as (select distinct * from delivered where ts is not null),
gaps as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from once),
numbered as (select *, sum(case when before is null or ts > before + interval 4 hour then 1 else 0 end)
  over (partition by user_id order by ts, event_id rows unbounded preceding) as session from gaps)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as session_start, strftime(max(ts) + interval 4 hour, '%Y-%m-%d %H:%M:%S.%f') as session_end,
  count(*) as n_events, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total_cents
from numbered group by user_id, session""", delivered=DELIVERED)
