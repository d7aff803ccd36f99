"""Queries over file corpora and their index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.tables import register_chunks_of
from corpuslens.operators import chunks as C
from corpuslens.operators import ignore as G
from corpuslens.operators import indexing as X
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SCAN_PATTERNS = G.patterns_for(["nodejs", "python", "general"])
EXT = r"regexp_extract(path, '[^/](\.[^./]*)$', 1)"
BASE = r"regexp_extract(path, '[^/]*$')"


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_ignored(patterns) -> str:
    """The ignore rules spelled out rule by rule."""
    folders = [p[:-1] for p in patterns if p.endswith("/")]
    names = [p for p in patterns if not p.endswith("/") and "*" not in p and "/" not in p]
    wild = [p for p in patterns if not p.endswith("/") and "*" in p]
    tests = [f"list_has_any(string_split(path, '/'), {_sql_list(folders)})", f"{BASE} in ({_sql_list(names)[1:-1]})"]
    for p in wild:
        rx = p.replace(".", r"\.").replace("*", "[^/]*")
        tests.append(f"regexp_matches(path, '(^|/){rx}$')")
    return "(" + " or ".join(tests) + ")"


QUERIES["ignore_filter"] = lambda spark, sf: table(spark, sf, "files").select(
    "repo", "path", G.is_ignored(F.col("path"), SCAN_PATTERNS).alias("ignored")
)
ORACLE["ignore_filter"] = with_derived("files", f"select repo, path, {_sql_ignored(SCAN_PATTERNS)} as ignored from files")

QUERIES["scan_files"] = lambda spark, sf: G.scan_files(
    table(spark, sf, "files"), patterns=SCAN_PATTERNS
).select("repo", "path", "size", F.md5("content").alias("hash"))
ORACLE["scan_files"] = with_derived("files", f"""
select repo, path, size, md5(content) as hash from files
where size <= 102400 and {EXT} in ('.ts', '.tsx', '.js', '.jsx', '.py') and not {_sql_ignored(SCAN_PATTERNS)}
  and not list_has_any(string_split(path, '/')[:-2], ['node_modules', 'dist', '.git'])""")

QUERIES["selectable_files"] = lambda spark, sf: G.select_files(table(spark, sf, "files")).select("path")
ORACLE["selectable_files"] = with_derived("files", """
select path from files
where string_split(path, '/')[1] not in ('node_modules', '.git', 'dist', 'build', '.next', 'coverage')""")

QUERIES["walk_source_files"] = lambda spark, sf: G.walk_source_files(
    table(spark, sf, "files"), [".ts", ".tsx", ".js", ".jsx"]
).select("repo", "path")
ORACLE["walk_source_files"] = with_derived("files", """
select repo, path from files
where (path like '%.ts' or path like '%.tsx' or path like '%.js' or path like '%.jsx')
  and not list_contains(string_split(path, '/')[:-2], 'node_modules')
  and len(list_filter(string_split(path, '/')[:-2], lambda s: starts_with(s, '.'))) = 0""")

QUERIES["base64_roundtrip"] = lambda spark, sf: table(spark, sf, "files").withColumn(
    "payload", X.encode_content(F.col("content"))
).select("path", F.md5("payload").alias("payload_hash"), X.decode_content(F.lit(""), F.col("payload")).alias("content"))
ORACLE["base64_roundtrip"] = with_derived("files", """
select path, md5(to_base64(encode(content))) as payload_hash, content from files""")

# Repositories with files at their root: some of them mark a technology stack.
ROOT_FILES = """
select concat(source, '/', cast(doc_id % 17 as varchar(20))) as repo,
  case doc_id % 12 when 0 then 'package.json' when 1 then 'requirements.txt' when 2 then 'Cargo.toml'
    when 3 then 'go.mod' when 4 then 'pom.xml' when 5 then 'sub/setup.py' when 6 then 'build.gradle.kts'
    else concat('doc', cast(doc_id as varchar(20)), '.md') end as path
from {documents}
"""
MARKER_SQL = "(values ('nodejs','package.json'),('python','requirements.txt'),('python','pyproject.toml'),('python','setup.py'),('python','Pipfile'),('rust','Cargo.toml'),('go','go.mod'),('java','pom.xml'),('java','build.gradle'),('java','build.gradle.kts')) m(stack, path)"

QUERIES["detect_stacks"] = lambda spark, sf: G.detect_stacks(run_sql(spark, sf, ROOT_FILES))
ORACLE["detect_stacks"] = with_derived("", f"""
select r.repo, m.stack from root_files r join {MARKER_SQL} on r.path = m.path
union select repo, 'general' from root_files""", root_files=ROOT_FILES)

RULE_SQL = "(values " + ", ".join(f"('{s}', '{p}')" for s, ps in G.IGNORE_PATTERNS.items() for p in ps) + ") p(stack, pattern)"
QUERIES["stack_ignore_rules"] = lambda spark, sf: G.stack_ignore_rules(
    G.detect_stacks(run_sql(spark, sf, ROOT_FILES))
)
ORACLE["stack_ignore_rules"] = with_derived("", f"""
with stacks as (select r.repo, m.stack from root_files r join {MARKER_SQL} on r.path = m.path
  union select repo, 'general' from root_files)
select distinct s.repo, p.pattern from stacks s join {RULE_SQL} on p.stack = s.stack""", root_files=ROOT_FILES)

LANG_SQL = "case lower(regexp_extract(path, '[^.]*$')) " + " ".join(
    f"when '{e}' then '{n}'" for e, n in P.LANGUAGE_BY_EXTENSION.items()
) + " else 'unknown' end"
ALIAS_SQL = "case a " + " ".join(f"when '{e}' then '{n}'" for e, n in P.LANGUAGE_ALIASES.items()) + " else a end"

QUERIES["detect_language"] = lambda spark, sf: table(spark, sf, "files").select(
    "path", P.language_of(F.col("path")).alias("language"),
    P.language_name(F.concat(F.lit("_"), F.upper(P.last_dot_part(F.col("path"))))).alias("language_name"),
)
ORACLE["detect_language"] = with_derived("files", f"""
select path, {LANG_SQL} as language, {ALIAS_SQL} as language_name
from (select path, lower(regexp_extract(path, '[^.]*$')) as a from files) s""")

QUERIES["content_hash"] = lambda spark, sf: table(spark, sf, "files").select(
    "path", X.content_hash(F.col("content")).alias("md5"), F.sha2("content", 256).alias("sha256")
)
ORACLE["content_hash"] = with_derived("files", "select path, md5(content) as md5, sha256(content) as sha256 from files")


def chunk_sql(source: str, name: str = "cut") -> str:
    """Recursive CTE ``name`` (repo, path, chunk_index, line_start, line_end, text) over ``source``."""
    return f"""{name}_l as (select repo, path, string_split(content, chr(10)) as lines from {source} where content <> ''),
{name}_w as (
  select repo, path, 0 as i, 0 as s, 0 as f, cast(0 as bigint) as n,
    cast(null as int) as es, cast(null as int) as ef, cast(null as int) as ee from {name}_l
  union all
  select repo, path, i + 1, case when ov then back else s end,
    case when ov then back when n = 0 and len_i = 0 then i + 1 else f end,
    case when ov then reopened when n = 0 then len_i else n + 1 + len_i end,
    case when ov then s end, case when ov then f end, case when ov then i - 1 end
  from (select w.*, length(l.lines[i + 1]) as len_i, greatest(0, i - 4) as back,
      n > 0 and n + 1 + length(l.lines[i + 1]) > 2000 as ov,
      length(array_to_string(l.lines[greatest(0, i - 4) + 1 : i + 1], chr(10))) as reopened
    from {name}_w w join {name}_l l using (repo, path) where i < len(l.lines)) step),
{name}_e as (
  select repo, path, es as s, ef as f, ee as e, false as tail from {name}_w where ee is not null
  union all
  select repo, path, s, f, i - 1, true from {name}_w w join {name}_l l using (repo, path) where i = len(l.lines) and n > 0),
{name} as (
  select repo, path, cast(row_number() over (partition by repo, path order by e, tail) - 1 as int) as chunk_index,
    s as line_start, e as line_end, txt as text
  from (select x.*, array_to_string(l.lines[f + 1 : e + 1], chr(10)) as txt from {name}_e x join {name}_l l using (repo, path)) y
  where not tail or regexp_matches(txt, '[^\\s]'))"""


QUERIES["chunk_documents"] = lambda spark, sf: C.chunk_files(table(spark, sf, "files"))
ORACLE["chunk_documents"] = with_derived("files", f"""
with recursive {chunk_sql('files')}
select repo, path as file_path, chunk_index, concat(path, '::chunk-', chunk_index) as chunk_id, line_start, line_end, text from cut""")


def _chunks_by_function(spark, sf):
    """The chunks again, asked for in SQL."""
    register_chunks_of(spark)
    return spark.sql(
        """select repo, path as file_path, c.chunk_index, c.line_start, c.line_end, md5(c.text) as text_hash
        from {files}, lateral chunks_of(content, 2000, 4) c""", files=table(spark, sf, "files"))


QUERIES["chunks_function"] = _chunks_by_function
ORACLE["chunks_function"] = with_derived("files", f"""
with recursive {chunk_sql('files')}
select repo, path as file_path, chunk_index, line_start, line_end, md5(text) as text_hash from cut""")


def _manifest(spark, sf, name="files"):
    return X.build_manifest(table(spark, sf, name))


QUERIES["full_index_manifest"] = lambda spark, sf: _manifest(spark, sf).select(
    "repo", "path", "hash", "n_chunks", F.array_join("chunk_ids", ",").alias("chunk_ids")
)
ORACLE["full_index_manifest"] = with_derived("files", f"""
with recursive {chunk_sql('files')}
select f.repo, f.path, md5(any_value(f.content)) as hash, cast(count(c.path) as int) as n_chunks,
  coalesce(string_agg(concat(c.path, '::chunk-', c.chunk_index), ',' order by c.chunk_index), '') as chunk_ids
from files f left join cut c using (repo, path) where f.content <> '' group by f.repo, f.path""")

QUERIES["full_index_report"] = lambda spark, sf: X.index_report(table(spark, sf, "files"), _manifest(spark, sf))
ORACLE["full_index_report"] = with_derived("files", f"""
with recursive {chunk_sql('files')}
select repo, count(*) as files_indexed, count(*) filter (where content <> '') as files_in_manifest,
  cast(coalesce(any_value(n), 0) as bigint) as chunks
from files left join (select repo, count(*) as n from cut group by repo) k using (repo) group by repo""")

QUERIES["index_diff"] = lambda spark, sf: X.index_diff(_manifest(spark, sf, "old_files"), table(spark, sf, "new_files"))
ORACLE["index_diff"] = with_derived("old_files new_files", """
select coalesce(o.repo, n.repo) as repo, coalesce(o.path, n.path) as path, md5(o.content) as old_hash, md5(n.content) as new_hash,
  case when o.path is null then 'added' when n.path is null then 'deleted'
       when md5(o.content) = md5(n.content) then 'unchanged' else 'changed' end as change
from (select * from old_files where content <> '') o
full outer join (select * from new_files where content <> '') n on o.repo = n.repo and o.path = n.path""")


def updated_index(spark, sf):
    old, new = table(spark, sf, "old_files"), table(spark, sf, "new_files")
    manifest = X.build_manifest(old)
    return X.update_index(C.chunk_files(X.with_content(old)), manifest, new, X.missing_files(manifest, new))


QUERIES["incremental_index"] = lambda spark, sf: updated_index(spark, sf)[0].select(
    "repo", "file_path", "chunk_id", "line_start", "line_end", F.md5("text").alias("text_hash")
)
ORACLE["incremental_index"] = with_derived("new_files", f"""
with recursive {chunk_sql('new_files')}
select repo, path as file_path, concat(path, '::chunk-', chunk_index) as chunk_id, line_start, line_end, md5(text) as text_hash from cut""")

QUERIES["incremental_manifest"] = lambda spark, sf: updated_index(spark, sf)[1].select("repo", "path", "hash", "n_chunks")
ORACLE["incremental_manifest"] = with_derived("new_files", f"""
with recursive {chunk_sql('new_files')}
select f.repo, f.path, md5(any_value(f.content)) as hash, cast(count(c.path) as int) as n_chunks
from new_files f left join cut c using (repo, path) where f.content <> '' group by f.repo, f.path""")

QUERIES["incremental_report"] = lambda spark, sf: X.update_report(
    _manifest(spark, sf, "old_files"), table(spark, sf, "new_files")
)
ORACLE["incremental_report"] = with_derived("old_files new_files", f"""
with recursive {chunk_sql('old_files', 'a')}, {chunk_sql('new_files', 'b')},
o as (select f.repo, f.path, md5(any_value(content)) as h, count(a.path) as n from old_files f left join a using (repo, path) where content <> '' group by 1, 2),
w as (select f.repo, f.path, md5(any_value(content)) as h, count(b.path) as n from new_files f left join b using (repo, path) where content <> '' group by 1, 2)
select coalesce(o.repo, w.repo) as repo, count(*) filter (where w.h is not null and o.h is distinct from w.h) as files_processed,
  cast(coalesce(sum(w.n) filter (where o.h is distinct from w.h), 0) as bigint) as chunks_added,
  cast(coalesce(sum(o.n) filter (where o.h is distinct from w.h), 0) as bigint) as chunks_deleted
from o full outer join w on o.repo = w.repo and o.path = w.path group by 1""")


def _first_repos(spark, sf):
    """The repositories asked for: those that hold benchmark items' languages, i.e. one per language."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.min("source").alias("repo"))


QUERIES["indexed_files"] = lambda spark, sf: X.indexed_files(_manifest(spark, sf), _first_repos(spark, sf))
ORACLE["indexed_files"] = with_derived("files", """
select repo, path from files where content <> '' and repo in (select min(source) from documents group by lang)""")

QUERIES["index_status"] = lambda spark, sf: X.index_status(
    _manifest(spark, sf), table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("repo"))
    .union(table(spark, sf, "documents").select("source"))
)
ORACLE["index_status"] = with_derived("files", """
select repo, repo in (select repo from files where content <> '') as indexed
from (select concat(source, '/', lang) as repo from documents union select source from documents) s""")

QUERIES["drop_repo"] = lambda spark, sf: X.drop_repo(_manifest(spark, sf), ["web", "wiki", "forum"]).select("repo", "path", "hash")
ORACLE["drop_repo"] = with_derived("files", """
select repo, path, md5(content) as hash from files where content <> '' and repo not in ('web', 'wiki', 'forum')""")

QUERIES["batches"] = lambda spark, sf: X.batches(table(spark, sf, "files"), 50)
ORACLE["batches"] = with_derived("files", """
select repo, path, cast(floor((row_number() over (partition by repo order by substr(md5(path), 1, 3), path) - 1) / 50) as bigint) as batch,
  count(*) over (partition by repo) as total from files""")

QUERIES["files_as_diff"] = lambda spark, sf: X.files_as_diff(table(spark, sf, "files"))
ORACLE["files_as_diff"] = with_derived("files", f"""
select repo, path, case when lang in ('scala','bash','yaml','json','markdown','sql','html','css','scss','vue','svelte') then 'unknown' else lang end as language,
  cast(n as int) as n_lines, 'modified' as status, 'context' as line_type, cast(i as int) as old_no, cast(i as int) as new_no, lines[i] as content
from (select repo, path, {LANG_SQL} as lang, string_split(content, chr(10)) as lines, len(string_split(content, chr(10))) as n,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from files) s""")
