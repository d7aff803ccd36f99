"""Queries over source code: symbols, import resolution and the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.code_text import LITERAL, comment_pattern
from corpuslens.operators import graph as G
from corpuslens.operators import members as M
from corpuslens.operators import symbols as Y
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ES6, REQUIRE, DYNAMIC = (_q(p) for p in Y.IMPORT_PATTERNS)
IMPORT_LIST = f"list_concat(list_concat(regexp_extract_all(content, {ES6}, 1), regexp_extract_all(content, {REQUIRE}, 1)), regexp_extract_all(content, {DYNAMIC}, 1))"
DISTINCT_IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

QUERIES["extract_imports_js"] = lambda spark, sf: G.import_rows(table(spark, sf, "code_files"), local_only=False)
ORACLE["extract_imports_js"] = with_derived("code_files", f"""
with l as (select repo, path, {IMPORT_LIST} as ls from code_files), d as (select repo, path, {DISTINCT_IN_ORDER.format('ls')} as u from l)
select repo, path, cast(i - 1 as int) as ordinal, u[i] as imported from (select repo, path, u, unnest(range(1, len(u) + 1)) as i from d) s""")

EXPORTS = f"""ex as (select repo, path, list_concat(list_concat(
    flatten(list_transform(regexp_extract_all(content, {_q(Y.EXPORT_LIST)}, 1), lambda x: list_transform(string_split(x, ','), lambda n: regexp_split_to_array(trim(n), '\\s+as\\s+')[1]))),
    regexp_extract_all(content, {_q(Y.EXPORT_DECLARATION)}, 1)), case when regexp_matches(content, 'export\\s+default') then ['default'] else [] end) as ls from code_files)"""
QUERIES["extract_exports_js"] = lambda spark, sf: table(spark, sf, "code_files").select(
    "repo", "path", F.array_join(Y.exports_js(F.col("content")), ",").alias("exports")
)
ORACLE["extract_exports_js"] = with_derived("code_files", f"""
with {EXPORTS}
select repo, path, array_to_string({DISTINCT_IN_ORDER.format('ls')}, ',') as exports from ex""")

QUERIES["extract_signatures"] = lambda spark, sf: table(spark, sf, "code_files").select(
    "repo", "path", F.array_join(Y.signatures_js(F.col("content")), "\n").alias("signatures")
)


def _sig(pattern, body):
    return f"list_transform(regexp_extract_all(content, {_q(pattern)}), lambda m: {body})"


def _g(pattern, i):
    return f"regexp_extract(m, {_q(pattern)}, {i})"


def _pre(before, value, after=""):
    return f"case when {value} <> '' then concat('{before}', {value}, '{after}') else '' end"


SIGNATURES = "list_concat(list_concat(list_concat(list_concat(" + "), ".join([
    _sig(Y.FUNCTION, f"concat(case when regexp_matches(m, '^(export\\s+)?async\\s') then 'async ' else '' end, 'function ', {_g(Y.FUNCTION, 1)}, {_g(Y.FUNCTION, 2)}, '(', {_g(Y.FUNCTION, 3)}, ')', {_pre(': ', 'trim(' + _g(Y.FUNCTION, 4) + ')')})")
    + ", " + _sig(Y.ARROW, f"concat(case when {_g(Y.ARROW, 2)} <> '' then 'async ' else '' end, 'const ', {_g(Y.ARROW, 1)}, ' = (', {_g(Y.ARROW, 3)}, ')', {_pre(': ', 'trim(' + _g(Y.ARROW, 4) + ')')}, ' =>')"),
    _sig(Y.CLASS, f"concat('class ', {_g(Y.CLASS, 1)}, {_pre('<', _g(Y.CLASS, 2), '>')}, {_pre(' extends ', _g(Y.CLASS, 3))}, {_pre(' implements ', _g(Y.CLASS, 4))})"),
    _sig(Y.INTERFACE, f"concat('interface ', {_g(Y.INTERFACE, 1)}, {_pre('<', _g(Y.INTERFACE, 2), '>')}, {_pre(' extends ', _g(Y.INTERFACE, 3))})"),
    _sig(Y.TYPE_ALIAS, f"concat('type ', {_g(Y.TYPE_ALIAS, 1)}, {_pre('<', _g(Y.TYPE_ALIAS, 2), '>')}, ' = ', case when length(trim({_g(Y.TYPE_ALIAS, 3)})) > 100 then concat(substr(trim({_g(Y.TYPE_ALIAS, 3)}), 1, 100), '...') else trim({_g(Y.TYPE_ALIAS, 3)}) end)"),
]) + ")"
ORACLE["extract_signatures"] = with_derived("code_files", f"""
select repo, path, array_to_string({SIGNATURES}[1:20], chr(10)) as signatures from code_files""")

QUERIES["test_counts"] = lambda spark, sf: table(spark, sf, "test_files").select(
    "repo", "path", Y.test_count(F.col("content")).alias("n_tests"),
    F.array_join(Y.test_names(F.col("content")), "|").alias("names"),
)
ORACLE["test_counts"] = with_derived("test_files", f"""
select repo, path, cast(len(regexp_extract_all(content, '\\b(it|test|describe)\\s*\\(')) as int) as n_tests,
  array_to_string(list_concat(regexp_extract_all(content, {_q(Y.TEST_NAME)}, 1),
    list_transform(regexp_extract_all(content, {_q(Y.SUITE_NAME)}, 1), lambda n: concat('[Suite] ', n))), '|') as names from test_files""")

QUERIES["strip_comments"] = lambda spark, sf: table(spark, sf, "script_files").select(
    "path", Y.strip_comments(F.col("content")).alias("code")
)
ORACLE["strip_comments"] = with_derived("script_files", rf"""
select path, regexp_replace(content, {_q(f"({LITERAL})|{comment_pattern()}")}, '\1', 'g') as code from script_files""")

QUERIES["semantic_query"] = lambda spark, sf: run_sql(spark, sf, SNIPPETS).select(
    "doc_id", Y.semantic_query(F.col("code")).alias("query")
)
# Code to search for: functions, classes, telling lines, or comments only.
SNIPPETS = """
select doc_id, case doc_id % 5 when 0 then content when 1 then concat('// class A', chr(10), 'export class K', cast(doc_id as varchar(20)), ' {}')
  when 2 then concat('/* function x() */', chr(10), 'short', chr(10), '  return value', cast(doc_id as varchar(20)), ' + 1;')
  when 3 then '// only words' else concat('a', chr(10), 'b', chr(10), content) end as code
from {code_files}
"""
ORACLE["semantic_query"] = with_derived("code_files", r"""
with b as (select doc_id, code, regexp_replace(code, '/\*[\s\S]*?\*/|//[^\n]*', '', 'g') as bare from snippets),
m as (select *, regexp_extract(bare, '(?:function|const|let|var)\s+(\w+)\s*[=\(]', 1) as f, regexp_extract(bare, 'class\s+(\w+)', 1) as c,
  list_filter(string_split(bare, chr(10)), lambda x: length(trim(x)) > 10) as ls from b)
select doc_id, case when f <> '' then concat(f, ' function') when c <> '' then concat(c, ' class')
  when len(ls) > 0 then substr(trim(ls[1]), 1, 100) else substr(code, 1, 100) end as query from m""", snippets=SNIPPETS)

NAME_ROWS = """
select doc_id, path, content, concat('f', cast(doc_id as varchar(20))) as word, case doc_id % 5 when 0 then '' else concat('HELPER', cast(doc_id % 50 as varchar(20))) end as mention
from {code_files}
"""
QUERIES["count_mentions"] = lambda spark, sf: run_sql(spark, sf, NAME_ROWS).select(
    "path", Y.count_word(F.col("content"), F.col("word")).alias("word_count"),
    Y.count_mentions(F.col("content"), F.col("mention")).alias("mention_count"),
)
ORACLE["count_mentions"] = with_derived("code_files", r"""
select path, cast(len(list_filter(regexp_extract_all(content, '\w+'), lambda w: w = word)) as int) as word_count,
  cast(case when mention = '' then 0 else (length(content) - length(replace(lower(content), lower(mention), ''))) // length(mention) end as int) as mention_count
from name_rows""", name_rows=NAME_ROWS)

# ------------------------------------------------------------ symbols by line

QUERIES["symbols_js"] = lambda spark, sf: Y.symbol_rows(table(spark, sf, "code_files"), "typescript").drop("ordinal")
LINES = """ln as (select repo, path, cast(i as int) as line, ls[i] as l from (
    select repo, path, string_split(content, chr(10)) as ls, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from {0}) s)"""
NM = r"[A-Za-z_$][\w$]*"
SYM = "repo, path, line, {kind} as kind, {name} as name, {alias} as alias, {source} as source, {exported} as exported, {is_async} as is_async from "
ORACLE["symbols_js"] = with_derived("code_files", rf"""
with {LINES.format('code_files')},
im as (select *, regexp_extract(l, '^\s*import\s+(.+?)\s+from\s+[''"]([^''"]+)[''"]', 1) as clause, regexp_extract(l, '^\s*import\s+(.+?)\s+from\s+[''"]([^''"]+)[''"]', 2) as src from ln),
rq as (select *, regexp_extract(l, '^\s*(?:const|let|var)\s+(\{{[^}}]*\}}|{NM})\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1) as b,
  regexp_extract(l, '^\s*(?:const|let|var)\s+(\{{[^}}]*\}}|{NM})\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 2) as src from ln),
kd as (select *, regexp_extract(l, '^\s*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(interface|class|enum)\s+(\w+)', ['e', 'k', 'n']) as m from ln),
ty as (select *, regexp_extract(l, '^\s*(export\s+)?type\s+(\w+)[^=]*=', ['e', 'n']) as m from ln),
fn as (select *, regexp_extract(l, '^\s*(export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*(\w+)', ['e', 'a', 'n']) as m from ln),
ar as (select *, regexp_extract(l, '^\s*(export\s+)?(?:const|let|var)\s+(\w+)[^=]*=\s*(async\s+)?(?:function\b|(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)', ['e', 'n', 'a']) as m from ln),
xl as (select *, trim(unnest(string_split(regexp_extract(l, '^\s*export\s+\{{([^}}]*)\}}', 1), ','))) as it from ln),
ni as (select *, trim(unnest(string_split(regexp_extract(clause, '\{{([^}}]*)\}}', 1), ','))) as it from im),
nr as (select *, trim(unnest(string_split(regexp_extract(b, '^\{{([^}}]*)\}}$', 1), ','))) as it from rq)
select repo, path, line, 'import' as kind, 'default' as name, regexp_extract(clause, '^({NM})', 1) as alias, src as source, false as exported, false as is_async from im where regexp_extract(clause, '^({NM})', 1) <> ''
union all select repo, path, line, 'import', '*', regexp_extract(clause, '\*\s+as\s+({NM})', 1), src, false, false from im where regexp_extract(clause, '\*\s+as\s+({NM})', 1) <> ''
union all select repo, path, line, 'import', regexp_split_to_array(it, '\s+as\s+')[1], regexp_split_to_array(it, '\s+as\s+')[2], src, false, false from ni where it <> ''
union all select repo, path, line, 'import', 'default', b, src, false, false from rq where regexp_matches(b, '^{NM}$')
union all select repo, path, line, 'import', regexp_split_to_array(it, '\s*:\s*')[1], regexp_split_to_array(it, '\s*:\s*')[2], src, false, false from nr where it <> ''
union all select repo, path, line, m.k, m.n, null, null, m.e <> '', false from kd where m.n <> ''
union all select repo, path, line, 'type', m.n, null, null, m.e <> '', false from ty where m.n <> ''
union all select repo, path, line, 'function', m.n, null, null, m.e <> '', m.a <> '' from fn where m.n <> ''
union all select repo, path, line, 'function', m.n, null, null, m.e <> '', m.a <> '' from ar where m.n <> ''
union all select repo, path, line, 'export', regexp_split_to_array(it, '\s+as\s+')[1], regexp_split_to_array(it, '\s+as\s+')[2], null, true, false from xl where it <> ''""")

QUERIES["symbols_go"] = lambda spark, sf: Y.symbol_rows(table(spark, sf, "go_files"), "go").drop("ordinal")
ORACLE["symbols_go"] = with_derived("go_files", rf"""
with {LINES.format('go_files')},
im as (select *, regexp_extract(l, '^(?:import)?\s+(?:([\w.]+)\s+)?"([^"]+)"\s*$', ['a', 's']) as m from ln),
ty as (select *, regexp_extract(l, '^type\s+(\w+)\s+(?:=\s*)?(\w*)', ['n', 'k']) as m from ln),
fn as (select *, regexp_extract(l, '^func\s+(?:\(([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(', ['r', 'n']) as m from ln),
va as (select *, regexp_extract(l, '^(?:var|const)\s+(\w+)', 1) as n from ln)
select repo, path, line, 'import' as kind, regexp_extract(m.s, '[^/]*$') as name, nullif(m.a, '') as alias, m.s as source, false as exported, false as is_async from im where m.s <> ''
union all select repo, path, line, case when m.k in ('struct', 'interface') then m.k else 'type' end, m.n, null, null, regexp_matches(m.n, '^[A-Z_]'), false from ty where m.n <> ''
union all select repo, path, line, case when m.r <> '' then 'method' else 'function' end, m.n, null, nullif(m.r, ''), regexp_matches(m.n, '^[A-Z_]'), false from fn where m.n <> ''
union all select repo, path, line, 'value', n, null, null, regexp_matches(n, '^[A-Z_]'), false from va where n <> ''""")

QUERIES["symbols_rust"] = lambda spark, sf: Y.symbol_rows(table(spark, sf, "rust_files"), "rust").drop("ordinal")
ORACLE["symbols_rust"] = with_derived("rust_files", rf"""
with {LINES.format('rust_files')},
us as (select *, regexp_extract(l, '^\s*(pub(?:\([^)]*\))?\s+)?use\s+([^;{{]+?)(?:::\{{([^}}]*)\}})?\s*;', ['p', 's', 'ls']) as m from ln),
ui as (select *, trim(unnest(string_split(m.ls, ','))) as it from us where m.s <> ''),
ec as (select *, regexp_extract(l, '^\s*extern\s+crate\s+(\w+)(?:\s+as\s+(\w+))?', ['n', 'a']) as m from ln),
ty as (select *, regexp_extract(l, '^\s*(pub(?:\([^)]*\))?\s+)?(struct|enum|trait|type)\s+(\w+)', ['p', 'k', 'n']) as m from ln),
fn as (select *, regexp_extract(l, '^\s*(pub(?:\([^)]*\))?\s+)?(?:const\s+)?(async\s+)?(?:unsafe\s+)?fn\s+(\w+)', ['p', 'a', 'n']) as m from ln),
va as (select *, regexp_extract(l, '^\s*(pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:', ['p', 'n']) as m from ln)
select repo, path, line, 'import' as kind, regexp_extract(m.s, '[^:]*$') as name, cast(null as varchar) as alias, m.s as source,
  m.p <> '' and regexp_extract(m.s, '[^:]*$') <> '*' as exported, false as is_async from us where m.s <> '' and m.ls = ''
union all select repo, path, line, 'import', regexp_split_to_array(it, '\s+as\s+')[1], regexp_split_to_array(it, '\s+as\s+')[2], m.s, m.p <> '', false from ui where it <> ''
union all select repo, path, line, 'import', m.n, nullif(m.a, ''), m.n, false, false from ec where m.n <> ''
union all select repo, path, line, m.k, m.n, null, null, m.p <> '', false from ty where m.n <> ''
union all select repo, path, line, 'function', m.n, null, null, m.p <> '', m.a <> '' from fn where m.n <> ''
union all select repo, path, line, 'value', m.n, null, null, m.p <> '', false from va where m.n <> ''""")

QUERIES["symbols_py"] = lambda spark, sf: Y.symbol_rows(table(spark, sf, "python_files"), "python").drop("ordinal")

ORACLE["symbols_py"] = with_derived("python_files", rf"""
with {LINES.format('python_files')},
shown as (select path, max(regexp_extract(l, '^__all__ = \["(\w+)"\]', 1)) as listed from ln group by path),
im as (select repo, path, line, trim(unnest(string_split(regexp_extract(l, '^import (.+)$', 1), ','))) as it from ln),
fr as (select repo, path, line, regexp_extract(l, '^from (\S+) import (.+)$', 1) as src, trim(unnest(string_split(regexp_extract(l, '^from (\S+) import (.+)$', 2), ','))) as it from ln),
cl as (select repo, path, line, regexp_extract(l, '^class (\w+)\(([^)]*)\):', ['n', 'b']) as m from ln where starts_with(l, 'class ')),
fn as (select repo, path, line, regexp_extract(l, '^(async )?def (\w+)\((.*)\)(?: -> .*)?:$', ['a', 'n', 'p']) as m from ln where regexp_matches(l, '^(async )?def ')),
me as (select repo, path, line, regexp_extract(l, '^    def (\w+)\((.*)\):$', ['n', 'p']) as m from ln where starts_with(l, '    def ')),
va as (select repo, path, line, regexp_extract(l, '^([A-Z][A-Z_0-9]+) = ', 1) as n from ln where regexp_matches(l, '^[A-Z][A-Z_0-9]+ = '))
select repo, path, line, 'import' as kind, string_split(it, ' as ')[1] as name, string_split(it, ' as ')[2] as alias, string_split(it, ' as ')[1] as source, false as exported, false as is_async from im where it <> ''
union all select repo, path, line, 'import', string_split(it, ' as ')[1], string_split(it, ' as ')[2], src, false, false from fr where it <> ''
union all select cl.repo, cl.path, line, case when contains(m.b, 'Enum') then 'enum' else 'class' end, m.n, null, nullif(m.b, ''), case when listed <> '' then m.n = listed else not starts_with(m.n, '_') end, false from cl join shown using (path)
union all select fn.repo, fn.path, line, 'function', m.n, null, nullif(regexp_replace(m.p, '\s*=\s*', '=', 'g'), ''), case when listed <> '' then m.n = listed else not starts_with(m.n, '_') end, m.a <> '' from fn join shown using (path)
union all select me.repo, me.path, me.line, 'method', concat(cl.m.n, '.', me.m.n), 'public', me.m.p, false, false from me join cl on cl.path = me.path
union all select va.repo, va.path, line, 'value', n, null, null, listed = '', false from va join shown using (path)""")

QUERIES["type_kinds"] = lambda spark, sf: Y.type_kinds(Y.symbol_rows(table(spark, sf, "code_files"), "typescript"))
ORACLE["type_kinds"] = with_derived("code_files", rf"""
with {LINES.format('code_files')},
k as (select regexp_extract(l, '^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(interface|class|enum)\s+\w+', 1) as kind from ln
  union all select case when regexp_matches(l, '^\s*(?:export\s+)?type\s+\w+[^=]*=') then 'type' else '' end from ln)
select kind, count(*) as n from k where kind <> '' group by kind""")

QUERIES["render_types"] = lambda spark, sf: Y.type_definitions(table(spark, sf, "code_files")).select(
    "repo", "path", "ordinal", "kind", "name", "rendered"
)
ORACLE["render_types"] = with_derived("code_files", rf"""
with m as (select repo, path, regexp_extract_all(content, {_q(Y.TYPE_BODY)}) as ms from code_files),
t as (select repo, path, i - 1 as ordinal, regexp_extract(ms[i], {_q(Y.TYPE_BODY)}, ['kind', 'name', 'gen', 'ext', 'imp', 'body']) as d from (select *, unnest(range(1, len(ms) + 1)) as i from m) s),
p as (select *, list_transform(regexp_extract_all(regexp_replace(d.body, {_q(Y.METHOD)}, '', 'g'), {_q(Y.PROPERTY)}), lambda x: concat(regexp_extract(x, {_q(Y.PROPERTY)}, 1),
  regexp_extract(x, {_q(Y.PROPERTY)}, 2), ': ', trim(regexp_extract(x, {_q(Y.PROPERTY)}, 3)))) as ps,
  list_transform(regexp_extract_all(d.body, {_q(Y.METHOD)}), lambda x: concat(regexp_extract(x, {_q(Y.METHOD)}, 1), '(', regexp_extract(x, {_q(Y.METHOD)}, 2), '): ', trim(regexp_extract(x, {_q(Y.METHOD)}, 3)))) as ms from t)
select repo, path, cast(ordinal as int) as ordinal, d.kind as kind, d.name as name, concat(d.kind, ' ', d.name, case when trim(d.gen) <> '' then concat('<', trim(d.gen), '>') else '' end,
  case when trim(d.ext) <> '' then concat(' extends ', trim(d.ext)) else '' end, case when trim(d.imp) <> '' then concat(' implements ', trim(d.imp)) else '' end,
  case when len(ps) > 0 then concat(' {{ ', array_to_string(ps[1:10], ', '), case when len(ps) > 10 then concat(', ... (', len(ps) - 10, ' more)') else '' end, ' }}')
    when len(ms) > 0 then concat(' {{ ', array_to_string(ms[1:5], '; '), case when len(ms) > 5 then concat('; ... (', len(ms) - 5, ' more)') else '' end, ' }}') else '' end) as rendered from p""")

# ------------------------------------------------------------ resolution and graph

ENDS = "(js|jsx|ts|tsx|mjs|cjs|py|go|rs|java|kt|swift|rb|php)"
NORMAL = r"""ltrim(list_reduce(string_split({0}, '/'), lambda acc, x: case when x in ('', '.') then acc
  when x = '..' then regexp_replace(acc, '/[^/]*$', '') else concat(acc, '/', x) end, ''), '/')"""
IMPORTED = f"""
il as (select repo, path, {IMPORT_LIST} as ls from code_files),
im as (select distinct repo, path, unnest(ls) as imported from il),
lo as (select * from im where regexp_matches(imported, '^[@./]')),
ba as (select *, case when starts_with(imported, '@/') then regexp_replace(substr(imported, 3), '([^/])\\.{ENDS}$', '\\1')
    when regexp_matches(imported, '^\\.\\.?/') then regexp_replace({NORMAL.format("concat(regexp_replace(path, '/?[^/]*$', ''), '/', imported)")}, '([^/])\\.{ENDS}$', '\\1')
    else imported end as base_path from lo),
ca as (select *, unnest([base_path, concat(base_path, '.ts'), concat(base_path, '.tsx'), concat(base_path, '.js'), concat(base_path, '.jsx'),
    concat(base_path, '/index.ts'), concat(base_path, '/index.tsx'), concat(base_path, '/index.js'), concat(base_path, '/index.jsx')]) as cand, unnest(range(9)) as pr from ba),
re as (select ba.repo, ba.path, ba.imported, ba.base_path, (select arg_min(f.path, ca.pr) from ca join code_files f on f.repo = ca.repo and f.path = ca.cand
    where ca.repo = ba.repo and ca.path = ba.path and ca.imported = ba.imported) as resolved from ba)"""

QUERIES["import_base_path"] = lambda spark, sf: G.import_rows(table(spark, sf, "code_files")).select(
    "repo", "path", "imported", G.base_path(F.col("imported"), F.col("path")).alias("base_path")
)
ORACLE["import_base_path"] = with_derived("code_files", f"with {IMPORTED} select repo, path, imported, base_path from ba")


def _resolved(spark, sf):
    files = table(spark, sf, "code_files")
    return G.resolve_imports(G.import_rows(files), files)


QUERIES["resolve_imports"] = lambda spark, sf: _resolved(spark, sf).select("repo", "path", "imported", "base_path", "resolved")
ORACLE["resolve_imports"] = with_derived("code_files", f"with {IMPORTED} select * from re")
QUERIES["import_edges"] = lambda spark, sf: G.import_edges(table(spark, sf, "code_files"))
ORACLE["import_edges"] = with_derived("code_files", f"with {IMPORTED} select distinct repo, path as src, resolved as dst from re where resolved is not null")
QUERIES["resolution_summary"] = lambda spark, sf: G.resolution_summary(_resolved(spark, sf))
ORACLE["resolution_summary"] = with_derived("code_files", f"""
with {IMPORTED}
select repo, path, count(*) as total, count(resolved) as resolved, count(*) - count(resolved) as failed,
  round(count(resolved) / count(*)::double * 100, 1) as success_rate from re group by 1, 2""")

# Dotted, package and crate imports of the other languages.
OTHER_IMPORTS = """
select 'main' as repo, path, concat('pkg', cast((doc_id * 7 + 1) % (select count(*) from {documents}) % 10 as varchar(20)), '.m', cast((doc_id * 7 + 1) % (select count(*) from {documents}) as varchar(20))) as imported from {python_files}
union all select 'main', path, concat('example.org/x/pkg', cast(doc_id % 12 as varchar(20))) from {go_files}
union all select 'main', path, concat(case doc_id % 2 when 0 then 'crate::m' else 'self::m' end, cast((doc_id * 7 + 1) % (select count(*) from {documents}) as varchar(20))) from {rust_files}
"""
ALL_FILES = "select repo, path from {python_files} union all select repo, path from {go_files} union all select repo, path from {rust_files}"
QUERIES["resolve_other_languages"] = lambda spark, sf: G.language_candidates(
    run_sql(spark, sf, OTHER_IMPORTS), run_sql(spark, sf, ALL_FILES)
).select("path", "imported", "resolved")
ORACLE["resolve_other_languages"] = with_derived("python_files go_files rust_files", """
with py as (select i.path, i.imported, coalesce(
    (select min(f.path) from python_files f where ends_with(concat('/', f.path), concat('/', replace(i.imported, '.', '/'), '.py'))),
    (select min(f.path) from python_files f where ends_with(concat('/', f.path), concat('/', replace(i.imported, '.', '/'), '/__init__.py')))) as resolved
  from other_imports i where i.path like '%.py'),
go as (select i.path, i.imported, (select min(f.path) from go_files f where string_split(f.path, '/')[-2] = regexp_extract(i.imported, '[^/]*$')) as resolved
  from other_imports i where i.path like '%.go'),
rs as (select i.path, i.imported, case when starts_with(i.imported, 'crate::') then coalesce(
    (select f.path from rust_files f where f.path = concat('src/', replace(substr(i.imported, 8), '::', '/'), '.rs')),
    (select f.path from rust_files f where f.path = concat('src/', replace(substr(i.imported, 8), '::', '/'), '/mod.rs')))
    else (select f.path from rust_files f where f.path = concat(regexp_replace(i.path, '/[^/]*$', ''), '/', substr(i.imported, 7), '.rs')) end as resolved
  from other_imports i where i.path like '%.rs')
select * from py union all select * from go union all select * from rs""", other_imports=OTHER_IMPORTS)


def _roots(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("g"), (F.col("doc_id") % 2).cast("string")).alias("repo"), F.col("doc_id").alias("root"))


REACH = """
walk as (select concat('g', doc_id % 2) as repo, doc_id as root, doc_id as node, 0 as depth from documents
  union select w.repo, w.root, e.{to}, w.depth + 1 from walk w join edges e on e.repo = w.repo and e.{fr} = w.node where w.depth < {k})"""
QUERIES["upstream_k"] = lambda spark, sf: G.upstream(table(spark, sf, "edges"), _roots(spark, sf), 3)
ORACLE["upstream_k"] = with_derived("edges", f"""
with recursive {REACH.format(fr='src', to='dst', k=3)}
select repo, root, node, min(depth) as depth from walk group by 1, 2, 3 having min(depth) > 0""")
QUERIES["downstream_k"] = lambda spark, sf: G.downstream(table(spark, sf, "edges"), _roots(spark, sf), 2)
ORACLE["downstream_k"] = with_derived("edges", f"""
with recursive {REACH.format(fr='dst', to='src', k=2)}
select repo, root, node, min(depth) as depth from walk group by 1, 2, 3 having min(depth) > 0""")


def _file_edges(spark, sf):
    return G.import_edges(table(spark, sf, "code_files"))


def _file_roots(spark, sf):
    return table(spark, sf, "code_files").select("repo", F.col("path").alias("root"))


QUERIES["downstream"] = lambda spark, sf: G.downstream(_file_edges(spark, sf), _file_roots(spark, sf), 1, near=True).select("root", "node", "depth")
ORACLE["downstream"] = with_derived("code_files", f"""
with {IMPORTED}
select distinct resolved as root, path as node, 1 as depth from re
where resolved is not null and resolved <> path
  and (regexp_replace(regexp_replace(resolved, '/?[^/]*$', ''), '/?[^/]*$', '') = '' or
    starts_with(path, concat(regexp_replace(regexp_replace(resolved, '/?[^/]*$', ''), '/?[^/]*$', ''), '/')))""")


def _tests(spark, sf):
    return G.related_tests(table(spark, sf, "code_files"), table(spark, sf, "test_files"))


QUERIES["related_tests"] = lambda spark, sf: _tests(spark, sf).select("path", "test_path", F.array_join("tests", "|").alias("tests"))
TESTS = f"""
stem as (select path, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') as st from code_files),
tc as (select path, unnest(list_transform(['.test.ts', '.test.js', '.spec.ts', '.spec.js', '.test.tsx', '.spec.tsx'], lambda s: concat(dir, '/', st, s))) as t from stem
  union select path, unnest(list_transform(['.test.ts', '.test.js', '.spec.ts', '.spec.js', '.test.tsx', '.spec.tsx'], lambda s: concat(dir, '/__tests__/', st, s))) from stem)"""
ORACLE["related_tests"] = with_derived("code_files test_files", f"""
with {TESTS}
select tc.path, t.path as test_path, array_to_string(list_concat(regexp_extract_all(content, {_q(Y.TEST_NAME)}, 1),
    list_transform(regexp_extract_all(content, {_q(Y.SUITE_NAME)}, 1), lambda n: concat('[Suite] ', n))), '|') as tests
from tc join test_files t on t.path = tc.t""")

QUERIES["dependency_bundle"] = lambda spark, sf: G.dependency_bundle(
    _file_edges(spark, sf), _tests(spark, sf), _file_roots(spark, sf), 1
).drop("repo")
ORACLE["dependency_bundle"] = with_derived("code_files test_files", f"""
with {IMPORTED}, {TESTS}
select distinct path as root, 'upstream' as relation, resolved as node, 1 as depth from re where resolved is not null and resolved <> path
union all select distinct resolved, 'downstream', path, 1 from re where resolved is not null and resolved <> path
union all select tc.path, 'test', t.path, 0 from tc join test_files t on t.path = tc.t""")


def _import_definitions(spark, sf):
    """Definitions behind the names that scripts import, looked up in the file each import resolves to."""
    files = table(spark, sf, "code_files")
    names = Y.symbol_rows(files, "typescript").filter("kind = 'import' and name not in ('default', '*')")
    asked = names.select("repo", "path", F.col("source").alias("imported"), "name")
    where = _resolved(spark, sf).select("repo", "path", "imported", "resolved").filter("resolved is not null")
    found = Y.definitions(files).withColumnRenamed("path", "resolved")
    return asked.join(where, ["repo", "path", "imported"]).join(found, ["repo", "resolved", "name"], "left").select(
        "path", "imported", "resolved", "name", "snippet"
    )


QUERIES["import_definitions"] = _import_definitions
FORMS = [
    (r"(?:export\s+)?function\s+", r"\s*\([^)]*\)[^{]*\{[\s\S]{0,500}"), (r"(?:export\s+)?class\s+", r"\s+(?:extends\s+\w+\s+)?\{[\s\S]{0,500}"),
    (r"(?:export\s+)?interface\s+", r"\s+\{[\s\S]{0,500}"), (r"(?:export\s+)?type\s+", r"\s*=[\s\S]{0,300}"),
    (r"(?:export\s+)?const\s+", r"\s*=[\s\S]{0,300}"), (r"(?:export\s+)?enum\s+", r"\s+\{[\s\S]{0,300}"),
]
SNIPPET = ", ".join(f"nullif(regexp_replace(regexp_extract(f.content, concat('{a}', a.name, '{b}')), '^\\s+|\\s+$', '', 'g'), '')" for a, b in FORMS)
ORACLE["import_definitions"] = with_derived("code_files", rf"""
with {IMPORTED}, {LINES.format('code_files')},
im2 as (select *, regexp_extract(l, '^\s*import\s+(.+?)\s+from\s+[''"]([^''"]+)[''"]', 1) as clause, regexp_extract(l, '^\s*import\s+(.+?)\s+from\s+[''"]([^''"]+)[''"]', 2) as src from ln),
rq as (select *, regexp_extract(l, '^\s*(?:const|let|var)\s+\{{([^}}]*)\}}\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1) as b,
  regexp_extract(l, '^\s*(?:const|let|var)\s+\{{([^}}]*)\}}\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 2) as src from ln),
asked as (select path, src as imported, regexp_split_to_array(trim(unnest(string_split(regexp_extract(clause, '\{{([^}}]*)\}}', 1), ','))), '\s+as\s+')[1] as name from im2
  union all select path, src, regexp_split_to_array(trim(unnest(string_split(b, ','))), '\s*:\s*')[1] from rq)
select a.path, a.imported, re.resolved, a.name, coalesce({SNIPPET}) as snippet
from asked a join re on re.path = a.path and re.imported = a.imported join code_files f on f.path = re.resolved where a.name <> ''""")

QUERIES["type_members"] = lambda spark, sf: M.type_members(table(spark, sf, "script_files"))
SQUASHED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
MEMBER_OF = f"regexp_extract(regexp_replace({SQUASHED}, {_q(M.DECORATORS)}, ''), {_q(M.MEMBER)}, ['words', 'name', 'mark', 'rest'])"
ORACLE["type_members"] = with_derived("script_files", rf"""
with tk as (select repo, path, unnest(ts) as t, generate_subscripts(ts, 1) as i
  from (select repo, path, regexp_extract_all(content, {_q(M.TOKEN)}) as ts from script_files) s),
cl as (select *, case when starts_with(t, '//') or starts_with(t, '/*') then '' else t end as c,
  case when t in ('{{', '(', '[') then 1 when t in ('}}', ')', ']') then -1 else 0 end as step from tk),
dp as (select *, sum(step) over w as after, sum(length(t) - length(replace(t, chr(10), ''))) over w - (length(t) - length(replace(t, chr(10), ''))) + 1 as line,
  coalesce(sum(case when t in (';', '{{', '}}') then 1 else 0 end) over (partition by repo, path order by i rows between unbounded preceding and 1 preceding), 0) as seg
  from cl window w as (partition by repo, path order by i)),
hd as (select repo, path, seg, max(i) filter (where t = '{{') as opened, max(after) filter (where t = '{{') as inside,
  regexp_extract(coalesce(string_agg(c, '' order by i) filter (where t not in (';', '{{', '}}')), ''), {_q(M.HEAD)}, ['kind', 'owner', 'rest']) as m from dp group by 1, 2, 3),
bo as (select repo, path, opened, inside, m.kind as owner_kind, m.owner as owner,
  coalesce((select min(i) from dp where dp.repo = hd.repo and dp.path = hd.path and i > opened and after < inside), 2147483647) as closed
  from hd where opened is not null and m.owner not in ('', 'extends') and regexp_matches(m.rest, {_q(M.REST)})
    and regexp_matches(m.rest, '=\s*$') = (m.kind = 'type')),
bt as (select bo.*, i, t, c, line, after = inside and regexp_matches(t, {_q(M.ENDING)}) as ends, t = '{{' and after = inside + 1 as opens
  from bo join dp on dp.repo = bo.repo and dp.path = bo.path and i > opened and i < closed),
bn as (select *, coalesce(sum(case when ends then 1 else 0 end) over (partition by repo, path, opened order by i rows between unbounded preceding and 1 preceding), 0) as no from bt),
bc as (select *, min(case when opens then i end) over (partition by repo, path, opened, no) as cut from bn),
mb as (select repo, path, owner, owner_kind, opened, no, min(line) filter (where not ends and trim(c, concat(' ', chr(9), chr(10), chr(13))) <> '') as line,
  coalesce(string_agg(c, '' order by i) filter (where not ends), '') as whole,
  coalesce(string_agg(c, '' order by i) filter (where not ends and (cut is null or i < cut)), '') as start from bc group by 1, 2, 3, 4, 5, 6),
pa as (select *, {MEMBER_OF.format('whole')} as mw, {MEMBER_OF.format('start')} as ms from mb),
pi as (select *, case when owner_kind = 'class' and (ms.rest like '(%' or ms.rest like '<%') then ms else mw end as m from pa),
ki as (select *, trim(m.rest) as rest, case when owner_kind = 'enum' then 'value' when m.rest like '(%' or m.rest like '<%' then 'method' else 'property' end as kind,
  string_split(m.words, ' ') as ws from pi where m.name <> '')
select repo, path, owner, owner_kind, cast(line as int) as line, kind, m.name as name,
  nullif(case kind when 'method' then rest when 'property' then regexp_extract(rest, {_q(M.TYPE)}, 1) else '' end, '') as type,
  m.mark = '?' as optional, case when list_contains(ws, 'private') or starts_with(m.name, '#') then 'private' when list_contains(ws, 'protected') then 'protected' else 'public' end as visibility,
  list_contains(ws, 'static') as is_static, list_contains(ws, 'async') as is_async, list_contains(ws, 'readonly') as is_readonly from ki""")

QUERIES["rust_imports"] = lambda spark, sf: M.rust_imports(table(spark, sf, "rust_trees")).drop("line")
ORACLE["rust_imports"] = with_derived("rust_trees", rf"""
with us as (select repo, path, unnest(range(1, len(ms) + 1)) as n, unnest(ms) as m from (
  select repo, path, regexp_extract_all(regexp_replace(content, {_q(f"{M.RUST_LITERAL}|{M.COMMENT}")}, '', 'g'), {_q(M.USE)}) as ms from rust_trees) s),
tr as (select repo, path, n, regexp_extract(m, {_q(M.USE)}, 1) <> '' as exported, regexp_extract_all(regexp_extract(m, {_q(M.USE)}, 2), {_q(M.USE_PART)}) as ps from us),
pt as (select repo, path, n, exported, unnest(range(1, len(ps) + 1)) as i, trim(regexp_replace(unnest(ps), '\s+', ' ', 'g')) as p from tr),
dp as (select *, coalesce(lead(p) over w, '') as next, coalesce(lag(p) over w, '') as prev,
  sum(case p when '{{' then 1 when '}}' then -1 else 0 end) over w as after from pt window w as (partition by repo, path, n order by i)),
op as (select *, case when prev in ('', '{{', '}}', ',') then '' else prev end as piece,
  coalesce((select min(k.i) from dp k where k.repo = dp.repo and k.path = dp.path and k.n = dp.n and k.i > dp.i and k.after < dp.after), 2147483647) as closed
  from dp where p = '{{'),
lf as (select d.repo, d.path, d.n, d.i, d.exported, d.p, coalesce(string_agg(piece, '' order by op.i), '') as prefix
  from dp d left join op on op.repo = d.repo and op.path = d.path and op.n = d.n and op.i < d.i and op.closed > d.i
  where d.p not in ('', '{{', '}}', ',') and d.next <> '{{' group by 1, 2, 3, 4, 5, 6),
sp as (select *, regexp_extract(p, ' as (.*)$', 1) as alias,
  list_transform(string_split(concat(prefix, regexp_replace(p, ' as .*$', '')), '::'), lambda x: trim(x)) as steps from lf),
ss as (select *, case when steps[-1] = 'self' and len(steps) > 1 then steps[:-2] else steps end as s from sp)
select repo, path, s[-1] as name, nullif(alias, '') as alias, array_to_string(s[:-2], '::') as source, exported from ss""")
