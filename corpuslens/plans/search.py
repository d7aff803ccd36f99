"""Queries over chunk vectors, chunk text and search responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import nearest as N
from corpuslens.operators import search as S
from corpuslens.operators.chunks import chunk_files
from corpuslens.operators.neighbours import similar_code
from corpuslens.plans.corpus import chunk_sql
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _queries(spark, sf):
    """One query per label: the vector with the lowest id."""
    return table(spark, sf, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id")
    ).select(F.col("label").cast("long").alias("query_id"), "embedding", "vec_id")


QUERY_SQL = "q as (select label as query_id, arg_min(embedding, vec_id) as embedding, min(vec_id) as vec_id from embeddings group by label)"
SCORED = """scored as (select cast(q.query_id as bigint) as query_id, v.repo, v.chunk_id, v.file_path,
    round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 6) as score
  from vectors v cross join q)"""

QUERIES["vector_search"] = lambda spark, sf: S.search(table(spark, sf, "vectors"), _queries(spark, sf))
ORACLE["vector_search"] = with_derived("vectors", f"""
with {QUERY_SQL}, {SCORED}
select query_id, repo, chunk_id, file_path, score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from scored) s where rn <= 10""")

QUERIES["cross_repo_search"] = lambda spark, sf: S.search_each_repo(table(spark, sf, "vectors"), _queries(spark, sf), 3)
ORACLE["cross_repo_search"] = with_derived("vectors", f"""
with {QUERY_SQL}, {SCORED}
select query_id, repo, chunk_id, file_path, score from (
  select *, row_number() over (partition by query_id, repo order by score desc, chunk_id) as rn from scored) s where rn <= 3""")

QUERIES["search_posttype"] = lambda spark, sf: S.search(
    table(spark, sf, "vectors"), _queries(spark, sf), 10, file_types=["ts", "py"], types_before_limit=False
)
ORACLE["search_posttype"] = with_derived("vectors", f"""
with {QUERY_SQL}, {SCORED}
select query_id, repo, chunk_id, file_path, score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from scored) s
where rn <= 10 and regexp_extract(file_path, '[^.]*$') in ('ts', 'py')""")
QUERIES["search_typed"] = lambda spark, sf: S.search(
    table(spark, sf, "vectors"), _queries(spark, sf), 10, file_types=["ts", "py"]
)
ORACLE["search_typed"] = with_derived("vectors", f"""
with {QUERY_SQL}, {SCORED}
select query_id, repo, chunk_id, file_path, score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from scored
  where regexp_extract(file_path, '[^.]*$') in ('ts', 'py')) s where rn <= 10""")



def _ann(spark, sf):
    """Every fiftieth vector asks the whole index; approximate, so it is tested by its recall instead of SQL."""
    vectors = table(spark, sf, "vectors")
    asked = vectors.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return N.ann_search(N.build_index(vectors), asked)


QUERIES["ann_search"] = _ann
# Also approximate: the neighbour graph over all vectors.
QUERIES["similar_code"] = lambda spark, sf: similar_code(table(spark, sf, "vectors"))

# An index has a manifest only for some repositories; the others get their name from the index name.
MANIFESTS = "select distinct repo as index, case when label % 2 = 0 then concat('org/', repo) end as repo_full_name from (select concat('repo', cast(label as varchar(20))) as repo, label from {embeddings}) e"


def _named_hits(spark, sf):
    hits = S.search(table(spark, sf, "vectors"), _queries(spark, sf))
    return S.name_repo(hits, run_sql(spark, sf, MANIFESTS))


QUERIES["hits_by_repo"] = lambda spark, sf: S.hits_by_repo(
    _named_hits(spark, sf).withColumn("repo", F.col("repo_full_name"))
)
ORACLE["hits_by_repo"] = with_derived("vectors", f"""
with {QUERY_SQL}, {SCORED}, top as (select * from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from scored) s where rn <= 10)
select query_id, coalesce(repo_full_name, replace(repo, '_', '/')) as repo, count(*) as total, max(score) as best_score
from top join manifests m on m.index = top.repo group by 1, 2""", manifests=MANIFESTS)

PATTERN_QUERY = """
select vec_id as query_id, embedding, file_path as current_file,
  case when file_path like '%.ts' then 'typescript' when file_path like '%.js' then 'javascript'
    when file_path like '%.py' then 'python' when file_path like '%.go' then 'go'
    when file_path like '%.rs' then 'rust' else 'markdown' end as language
from (select min(chunk_id) as vec_id, min_by(embedding, chunk_id) as embedding, min_by(file_path, chunk_id) as file_path
      from {vectors} group by repo) f
"""
QUERIES["similar_patterns"] = lambda spark, sf: S.similar_patterns(
    table(spark, sf, "vectors"), run_sql(spark, sf, PATTERN_QUERY)
).select("query_id", "repo", "chunk_id", "file_path", "score")
ORACLE["similar_patterns"] = with_derived("vectors", """
with scored as (select q.query_id, q.current_file, v.repo, v.chunk_id, v.file_path,
    round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 6) as score
  from vectors v join pq q on regexp_extract(v.file_path, '[^.]*$') = case q.language when 'typescript' then 'ts'
    when 'javascript' then 'js' when 'python' then 'py' when 'go' then 'go' when 'rust' then 'rs' end),
others as (select * from scored where not contains(file_path, current_file))
select query_id, repo, chunk_id, file_path, score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from others) s where rn <= 5""", pq=PATTERN_QUERY)


def _previews(spark, sf):
    hits = S.search(table(spark, sf, "vectors"), _queries(spark, sf))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    texts = table(spark, sf, "vectors").select("repo", "chunk_id").join(docs, "chunk_id")
    return S.with_snippet(hits, texts).select(
        "query_id", "chunk_id", "snippet", S.preview(F.col("content")).alias("preview"),
        S.token_estimate(F.col("content")).alias("tokens"),
    )


QUERIES["hit_preview"] = _previews
ORACLE["hit_preview"] = with_derived("vectors", f"""
with {QUERY_SQL}, {SCORED}, top as (select * from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from scored) s where rn <= 10),
body as (select query_id, chunk_id, text, string_split(text, chr(10))[1:10] as ls from top join documents on doc_id = chunk_id),
ln as (select query_id, chunk_id, unnest(range(1, len(ls) + 1)) as i, ls from body),
cum as (select query_id, chunk_id, i, ls[i] as l, sum(length(ls[i])) over (partition by query_id, chunk_id order by i) as total from ln),
ok as (select query_id, chunk_id, string_agg(l, chr(10) order by i) as preview from cum where total <= 300 group by 1, 2)
select query_id, chunk_id, substr(text, 1, 300) as snippet, coalesce(preview, '') as preview,
  cast(ceil(length(text) / 4.0) as bigint) as tokens from body left join ok using (query_id, chunk_id)""")

# Search responses in the shapes that services use: list under different names, aliases, numbers as text.
RESPONSES = """
select vec_id as response_id,
  case vec_id % 6
    when 0 then concat('{"results":[{"repo":"r', S, '","file_path":"a/', S, '.ts","line_start":3,"line_end":"9","score":0.5,"content":"c', S, '","highlights":["h1","h', S, '"],"name":"n.ts"}],"total":7,"duration_ms":12}')
    when 1 then concat('{"results":[],"hits":[{"repository":"h', S, '","path":"b/', S, '.py","start_line":"4","end_line":8,"similarity":"0.25","text":"t', S, '","summary":"s","fragments":["f"],"repo_full_name":"o/h"}],"took":"31"}')
    when 2 then concat('{"repo":"fall', S, '","items":[{"file":{"path":"c/', S, '.go"},"startLine":1,"endLine":2,"rank":3,"snippet":"sn"},{"location":"loc', S, '","start":{"line":5},"end":{"line":6},"score_percent":"90","body":"b"}]}')
    when 3 then concat('{"repo_full_name":"o/r', S, '","data":{"results":[],"hits":[{"owner":"own","filename":"f', S, '.rs","range":{"start":10,"end":"20"},"score":"bad","rank":"2"}],"total_count":"5","duration_ms":4},"meta":{"duration_ms":"6"}}')
    when 4 then concat('{"data":{"items":[{"file_path":"z/', S, '.ts","line_start":null,"start_line":7}]},"count":9}')
    else 'not json' end as body
from {embeddings}
""".replace("S,", "cast(vec_id as varchar(20)),")


def _normalized(spark, sf):
    return S.normalize_hits(run_sql(spark, sf, RESPONSES), "body").withColumn("highlights", F.array_join("highlights", "|"))


NORMALIZED = r"""
docs as (select response_id, case when json_valid(body) then cast(body as json) end as j from responses),
lists as (select response_id, j, coalesce(
    case when json_array_length(j, '$.results') > 0 then j->'$.results' end, case when json_array_length(j, '$.hits') > 0 then j->'$.hits' end,
    case when json_array_length(j, '$.items') > 0 then j->'$.items' end, case when json_array_length(j, '$.data.results') > 0 then j->'$.data.results' end,
    case when json_array_length(j, '$.data.hits') > 0 then j->'$.data.hits' end, case when json_array_length(j, '$.data.items') > 0 then j->'$.data.items' end) as hs from docs),
hits as (select response_id, j, hs, ordinal, hs->cast(ordinal as int) as h
  from lists, lateral (select unnest(range(cast(json_array_length(hs) as bigint))) as ordinal) o),
norm as (select response_id, cast(ordinal as int) as ordinal,
  coalesce(h->>'$.repo', h->>'$.repo_full_name', h->>'$.repository', h->>'$.owner', j->>'$.repo', j->>'$.repo_full_name') as repo,
  coalesce(h->>'$.file_path', h->>'$.path', h->>'$.file.path', h->>'$.location', h->>'$.filename') as file_path,
  cast(try_cast(coalesce(h->>'$.line_start', h->>'$.start_line', h->>'$.startLine', h->>'$.start.line', h->>'$.range.start') as double) as bigint) as line_start,
  cast(try_cast(coalesce(h->>'$.line_end', h->>'$.end_line', h->>'$.endLine', h->>'$.end.line', h->>'$.range.end') as double) as bigint) as line_end,
  coalesce(try_cast(h->>'$.score' as double), try_cast(h->>'$.similarity' as double), try_cast(h->>'$.rank' as double), try_cast(h->>'$.score_percent' as double), 0) as score,
  coalesce(h->>'$.content', h->>'$.text', h->>'$.snippet', h->>'$.summary', h->>'$.body', '') as content,
  coalesce(h->>'$.snippet', h->>'$.summary', h->>'$.text', h->>'$.content', '') as snippet,
  array_to_string(cast(coalesce(h->'$.highlights', h->'$.matches', h->'$.fragments') as varchar[]), '|') as highlights,
  coalesce(h->>'$.repo_full_name', h->>'$.repo', h->>'$.repository', h->>'$.owner', j->>'$.repo', j->>'$.repo_full_name') as repo_full_name,
  coalesce(h->>'$.filename', h->>'$.name') as filename, try_cast(h->>'$.similarity' as double) as similarity, h->>'$.summary' as summary,
  coalesce(try_cast(j->>'$.total' as double), try_cast(j->>'$.total_count' as double), try_cast(j->>'$.totalHits' as double), try_cast(j->>'$.count' as double),
    try_cast(j->>'$.data.total' as double), try_cast(j->>'$.data.total_count' as double), json_array_length(hs)) as total,
  coalesce(try_cast(j->>'$.duration_ms' as double), try_cast(j->>'$.duration' as double), try_cast(j->>'$.durationMs' as double),
    try_cast(j->>'$.took' as double), try_cast(j->>'$.meta.duration_ms' as double), try_cast(j->>'$.data.duration_ms' as double)) as duration_ms
  from hits)"""
QUERIES["normalize_hits"] = _normalized
ORACLE["normalize_hits"] = with_derived("", f"with {NORMALIZED} select * from norm", responses=RESPONSES)

QUERIES["build_context"] = lambda spark, sf: S.build_context(_normalized(spark, sf)).select(
    "response_id", "ordinal", "repo", "file_path", "snippet", "score",
    F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end"),
)
ORACLE["build_context"] = with_derived("", f"""
with {NORMALIZED}
select response_id, ordinal, coalesce(repo, '') as repo, coalesce(file_path, '') as file_path, snippet, score,
  case when line_start is not null and line_end is not null then line_start end as range_start,
  case when line_start is not null and line_end is not null then line_end end as range_end from norm""", responses=RESPONSES)

REQUESTS = """
select event_id as request_id, concat(case event_id % 3 when 0 then ' Find ' else 'find ' end, event_type, ' ') as query,
  case event_id % 4 when 0 then cast(null as varchar(9)) when 1 then 'repo-b,repo-a' when 2 then 'repo-a,repo-b' else ' ' end as repos,
  case event_id % 2 when 0 then 'ts,py' else 'py,ts' end as types, cast(event_id % 5 * 5 as int) as max_results
from {events}
"""
QUERIES["search_key"] = lambda spark, sf: run_sql(spark, sf, REQUESTS).select(
    "request_id",
    S.search_key(F.col("query"), F.split("repos", ","), F.split("types", ","), F.col("max_results")).alias("search_key"),
)
ORACLE["search_key"] = with_derived("", """
select request_id, sha256(concat('{"query":"', lower(trim(query)), '","repos":[',
  coalesce(array_to_string(list_transform(list_sort(string_split(repos, ',')), lambda r: concat('"', r, '"')), ','), ''), '],"file_types":["py","ts"],"max_results":',
  case max_results when 0 then 10 else max_results end, '}')) as search_key from requests""", requests=REQUESTS)

QUERIES["default_repo"] = lambda spark, sf: run_sql(spark, sf, REQUESTS).select(
    "request_id", F.array_join(S.default_repo(F.split("repos", ","), "main"), ",").alias("repos")
)
ORACLE["default_repo"] = with_derived("", """
select request_id, case when repos is null or trim(string_split(repos, ',')[1]) = '' then 'main' else repos end as repos from requests""", requests=REQUESTS)

INPUTS = """
select event_id as request_id,
  case event_id % 5 when 0 then concat('{"query":" ', event_type, ' "}') when 1 then '{"query":{"description":" words "}}'
    when 2 then '{"query":"  "}' when 3 then '{"other":1}' else '{"query":{"description":5}}' end as request,
  case event_id % 4 when 0 then 'https://example.org/a' when 1 then 'ftp://example.org' when 2 then 'http://h' else 'example.org' end as url
from {events}
"""
QUERIES["validate_queries"] = lambda spark, sf: S.validate_queries(run_sql(spark, sf, INPUTS), "request").select(
    "request_id", "query", "valid", S.is_web_url(F.col("url")).alias("valid_url")
)
ORACLE["validate_queries"] = with_derived("", r"""
with q as (select request_id, url, trim(case when json_type(request, '$.query') = 'VARCHAR' then request->>'$.query'
  else request->>'$.query.description' end) as query from inputs)
select request_id, query, coalesce(query <> '', false) as valid, regexp_matches(url, '^https?://[^/\s]+') as valid_url from q""", inputs=INPUTS)


def _code_chunks(spark, sf):
    return chunk_files(table(spark, sf, "twin_files"))


def _function_names(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"))


QUERIES["find_usages"] = lambda spark, sf: S.find_usages(_code_chunks(spark, sf), _function_names(spark, sf), 3)
TOKENS = r"""
tok as (select repo, concat(path, '::chunk-', chunk_index) as chunk_id, text, unnest(regexp_extract_all(text, '\w+')) as name from cut),
use as (select name, repo, chunk_id, count(*) as n from tok where name in (select concat('f', doc_id) from documents) group by 1, 2, 3),
def as (select name, repo, chunk_id, count(*) as d from (select repo, concat(path, '::chunk-', chunk_index) as chunk_id,
  unnest(regexp_extract_all(text, '\b(?:function|class|interface|type|enum|const|let|var)\s+(\w+)', 1)) as name from cut) s group by 1, 2, 3)"""
ORACLE["find_usages"] = with_derived("twin_files", f"""
with recursive {chunk_sql('twin_files')}, {TOKENS}
select name, repo, chunk_id, n from (select name, repo, chunk_id, n, row_number() over (partition by name order by n desc, chunk_id, repo) as rn
  from (select name, repo, chunk_id, n - coalesce(d, 0) as n from use left join def using (name, repo, chunk_id)) s where n > 0) t where rn <= 3""")

QUERIES["find_callers"] = lambda spark, sf: S.find_callers(_code_chunks(spark, sf), _function_names(spark, sf), 2)
ORACLE["find_callers"] = with_derived("twin_files", rf"""
with recursive {chunk_sql('twin_files')},
c as (select repo, concat(path, '::chunk-', chunk_index) as chunk_id, text from cut),
use as (select name, repo, chunk_id, count(*) as n from (select repo, chunk_id, unnest(regexp_extract_all(text, '\b(\w+)\s*\(', 1)) as name from c) s
  where name in (select concat('f', doc_id) from documents) group by 1, 2, 3),
def as (select name, repo, chunk_id, count(*) as d from (select repo, chunk_id, unnest(regexp_extract_all(text, '\bfunction\s+(\w+)\s*\(', 1)) as name from c) s group by 1, 2, 3)
select name, repo, chunk_id, n from (select name, repo, chunk_id, n, row_number() over (partition by name order by n desc, chunk_id, repo) as rn
  from (select name, repo, chunk_id, n - coalesce(d, 0) as n from use left join def using (name, repo, chunk_id)) s where n > 0) t where rn <= 2""")

QUERIES["lexical_search"] = lambda spark, sf: S.lexical_search(
    chunk_files(table(spark, sf, "twin_texts")),
    table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")),
)
ORACLE["lexical_search"] = with_derived("twin_texts", rf"""
with recursive {chunk_sql('twin_texts')},
c as (select repo, concat(path, '::chunk-', chunk_index) as chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '') as ws from cut),
q as (select query_id, word, count(*) as qf from (select item_id as query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')) as word from benchmark) s group by 1, 2),
tf as (select repo, chunk_id, len(ws) as n, word, count(*) as tf from (select repo, chunk_id, ws, unnest(ws) as word from c) s where word in (select word from q) group by all),
idf as (select word, ln(1 + (select count(*) from c) / count(*)::double) as idf from tf group by word),
sc as (select query_id, repo, chunk_id, round(sum(qf * idf * idf * tf / sqrt(n)), 6) as score from q join idf using (word) join tf using (word) group by 1, 2, 3)
select query_id, repo, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id, repo) as rn from sc) s where rn <= 10""")

QUERIES["fuzzy_files"] = lambda spark, sf: S.fuzzy_files(table(spark, sf, "files"), "Dc1.T").select("path", "score")
ORACLE["fuzzy_files"] = with_derived("files", """
with recursive walk as (
  select path, lower(path) as t, 0 as i, 0 as q, -1 as last, 0 as score from files
  union all
  select path, t, i + 1, case when hit then q + 1 else q end, case when hit then i else last end,
    score + case when hit and last = i - 1 then 10 when hit then 1 else 0 end
  from (select *, q < 5 and substr(t, i + 1, 1) = substr('dc1.t', q + 1, 1) as hit from walk) w where i < length(t))
select path, case when t = 'dc1.t' then 1000 when starts_with(t, 'dc1.t') then 900 when contains(t, 'dc1.t') then 801 - strpos(t, 'dc1.t') else score end as score
from walk where i = length(t) and (q = 5 or contains(t, 'dc1.t'))""")
QUERIES["fuzzy_substring"] = lambda spark, sf: S.fuzzy_files(table(spark, sf, "files"), "doc1").select("path", "score")
ORACLE["fuzzy_substring"] = with_derived("files", """
with recursive walk as (
  select path, lower(path) as t, 0 as i, 0 as q, -1 as last, 0 as score from files
  union all
  select path, t, i + 1, case when hit then q + 1 else q end, case when hit then i else last end,
    score + case when hit and last = i - 1 then 10 when hit then 1 else 0 end
  from (select *, q < 4 and substr(t, i + 1, 1) = substr('doc1', q + 1, 1) as hit from walk) w where i < length(t))
select path, case when t = 'doc1' then 1000 when starts_with(t, 'doc1') then 900 when contains(t, 'doc1') then 801 - strpos(t, 'doc1') else score end as score
from walk where i = length(t) and (q = 4 or contains(t, 'doc1'))""")

QUERIES["pattern_files"] = lambda spark, sf: S.pattern_files(table(spark, sf, "files"), r"doc\d+5\.(ts|go)$").select("path")
ORACLE["pattern_files"] = with_derived("files", r"""
select path from files where contains(path, 'doc\d+5\.(ts|go)$') or regexp_matches(path, 'doc\d+5\.(ts|go)$')""")

QUERIES["related_files"] = lambda spark, sf: S.related_files(table(spark, sf, "code_files"))
ORACLE["related_files"] = with_derived("code_files", r"""
with f as (select repo, path, regexp_replace(path, '/?[^/]*$', '') as folder, regexp_extract(path, '[^/]*$') as name,
  regexp_extract(path, '[^/](\.[^./]*)$', 1) as ext from code_files)
select repo, path, related from (
  select a.repo, a.path, b.path as related, row_number() over (partition by a.repo, a.path order by b.path) as rn
  from f a join f b on a.repo = b.repo and a.folder = b.folder and a.path <> b.path
    and regexp_matches(b.name, concat('.*', a.ext))) s where rn <= 5""")

QUERIES["truncate_text"] = lambda spark, sf: table(spark, sf, "documents").select(
    "doc_id", S.truncate_text(F.col("text"), 400).alias("cut"), S.token_estimate(F.col("text")).alias("tokens")
)
ORACLE["truncate_text"] = r"""
select doc_id, case when length(text) > 400 then concat(substr(text, 1, 400), chr(10), '// ... truncated ...') else text end as cut,
  cast(ceil(length(text) / 4.0) as bigint) as tokens from documents"""
QUERIES["token_estimate"] = lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(
    F.sum(S.token_estimate(F.col("text"))).alias("tokens")
)
ORACLE["token_estimate"] = "select conv_id, cast(sum(ceil(length(text) / 4.0)) as bigint) as tokens from conversations group by conv_id"
