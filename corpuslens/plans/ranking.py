"""Queries that rank context items and assemble review prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.operators import graph as G
from corpuslens.operators import ignore as N
from corpuslens.operators import ranking as R
from corpuslens.operators import search as S
from corpuslens.operators import symbols as Y
from corpuslens.plans import code as C
from corpuslens.plans.corpus import MARKER_SQL, ROOT_FILES
from corpuslens.plans.derived import run_sql, table, with_derived

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_q = C._q


def _files(spark, sf):
    return table(spark, sf, "code_files")


def _imports(spark, sf):
    return R.import_uses(_files(spark, sf))


USES = f"""
cl as (select path as file, content, regexp_extract_all(content, '\\w+') as ws, regexp_extract_all(content, {_q(R.IMPORT_CLAUSE)}) as ms from code_files),
us as (select file, content, ws, regexp_extract(m, {_q(R.IMPORT_CLAUSE)}, 2) as import_path,
    regexp_extract_all(regexp_replace(regexp_extract(m, {_q(R.IMPORT_CLAUSE)}, 1), '\\w+\\s+as\\s+', '', 'g'), '[A-Za-z_$][\\w$]*') as names
  from (select file, content, ws, unnest(ms) as m from cl) s),
uses as (select file, import_path, names, len(list_filter(ws, lambda w: list_contains(names, w))) as u,
    (length(content) - length(replace(lower(content), lower(regexp_extract(import_path, '[^/]*$')), ''))) // length(regexp_extract(import_path, '[^/]*$')) as m from us),
imr as (select file, import_path as item_key, least(100, least(m * 20, 60) + least(u * 15, 40)
    + case when regexp_matches(lower(import_path), 'config|schema|type|interface|model|api') then 30 else 0 end + case when u > 3 then 20 else 0 end) / 100.0::double as score,
    concat_ws(', ', case when m > 0 then concat('used ', m, ' times') end, case when u > 0 then concat(u, ' direct references') end,
      case when regexp_matches(lower(import_path), 'config|schema|type|interface|model|api') then 'critical import' end, case when u > 3 then 'heavily used' end) as reason,
    array_to_string(names, ', ') as content from uses)"""


def _top(source, least, n, extra=""):
    return f"select file, item_key, score, reason{extra} from (select *, row_number() over (partition by file order by score desc, item_key) as rn from {source} where score >= {least}) t where rn <= {n}"


QUERIES["rank_imports"] = lambda spark, sf: R.keep_best(R.score_imports(_imports(spark, sf)), "import").select(
    "file", "item_key", "score", "reason", "content"
)
ORACLE["rank_imports"] = with_derived("code_files", f"with {USES} {_top('imr', 0.3, 5, ', content')}")


def _code_path(spark, sf):
    """Vectors stand for the code file of the document with the same number."""
    return table(spark, sf, "code_files").select(F.col("doc_id").alias("chunk_id"), F.col("path").alias("code_path"))


def _patterns(spark, sf, chars=None):
    """Similar code of every file that has a vector: the file, the file found, its similarity and text.

    Three of each repository; the file itself is left out while scoring, so three come back where there are three.
    ``chars``: characters of the text that are needed; None: all.
    """
    names = _code_path(spark, sf)
    vectors = (
        table(spark, sf, "vectors").join(names, "chunk_id")
        .select("repo", "chunk_id", F.col("code_path").alias("file_path"), "embedding")
    )
    asked = vectors.select(F.col("chunk_id").alias("query_id"), F.col("file_path").alias("current_file"), "embedding")
    hits = S.search_each_repo(vectors, asked, 3)
    own = names.select(F.col("chunk_id").alias("query_id"), F.lit("main").alias("repo"), F.col("code_path").alias("file"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("code"))
    if chars is not None:
        docs = docs.withColumn("code", F.substring("code", 1, chars))
    return (
        hits.drop("repo").join(own, "query_id").join(docs, "chunk_id")
        .select("repo", "file", "file_path", F.col("score").alias("similarity"), (F.col("chunk_id") % 3).alias("concepts"), "code")
    )


RELATED = r"""(regexp_replace({a}, '/?[^/]*$', '') = regexp_replace({b}, '/?[^/]*$', '') or
  regexp_replace(regexp_extract({a}, '[^/]*$'), '\.(test|spec)\.(ts|js|tsx|jsx)$', '') = regexp_replace(regexp_extract({b}, '[^/]*$'), '\.(test|spec)\.(ts|js|tsx|jsx)$', ''))"""
PATTERNS = f"""
vf as (select v.repo, v.chunk_id, c.path as file, cast(v.embedding as double[]) as embedding from vectors v join code_files c on c.doc_id = v.chunk_id),
each as (select * from (
  select a.file, b.file as file_path, b.chunk_id, round(list_cosine_similarity(b.embedding, a.embedding), 6) as similarity,
    row_number() over (partition by a.chunk_id, b.repo order by round(list_cosine_similarity(b.embedding, a.embedding), 6) desc, b.chunk_id) as rn
  from vf a join vf b on not contains(b.file, a.file)) s where rn <= 3),
pa as (select e.file, e.file_path, e.similarity, e.chunk_id % 3 as concepts, d.text as code from each e join documents d on d.doc_id = e.chunk_id),
ps as (select *, {RELATED.format(a='file', b='file_path')} as near from pa),
pt as (select file, file_path as item_key, code as content, round(least(1.0, case when similarity > 0.95 then 0.7::double else 1 end * (similarity + case when near then 0.2::double else 0 end + concepts * 0.1::double)), 6) as score,
  concat_ws(', ', concat(cast(round(similarity * 100) as int), '% similar'), case when near then 'related location' end,
    case when concepts > 0 then concat(concepts, ' matching concepts') end, case when similarity > 0.95 then 'potential duplicate' end) as reason from ps)"""
QUERIES["rank_patterns"] = lambda spark, sf: R.keep_best(R.score_patterns(_patterns(spark, sf)), "pattern").select(
    "file", "item_key", "score", "reason"
)
ORACLE["rank_patterns"] = with_derived("vectors code_files", f"with {PATTERNS} {_top('pt', 0.4, 3)}")


def _types(spark, sf):
    """Types defined in a file, with the file's code as the changed code."""
    return Y.type_definitions(_files(spark, sf), keep=("content",)).withColumnsRenamed(
        {"content": "changed_code", "path": "file"}
    )


TYPES = f"""
td as (select path as file, content as changed_code, unnest(regexp_extract_all(content, {_q(Y.TYPE_BODY)})) as definition from code_files),
tn as (select *, regexp_extract(definition, {_q(Y.TYPE_BODY)}, 2) as name from td),
tm as (select *, (length(changed_code) - length(replace(lower(changed_code), lower(name), ''))) // length(name) as m,
  len(list_filter(regexp_extract_all(changed_code, '(?:[:<]\\s*|\\bas\\s+)([A-Za-z_]\\w*)', 1), lambda x: contains(x, name))) as refs,
  regexp_matches(definition, '^export\\s') as ex from tn),
ty as (select file, name as item_key, definition as content, least(100, least(m * 25, 70) + case when refs > 0 then 40 else 0 end + case when ex then 20 else 0 end) / 100.0::double as score,
  concat_ws(', ', case when m > 0 then concat('used ', m, ' times') end, case when refs > 0 then concat('type annotation (', refs, ' refs)') end, case when ex then 'exported type' end) as reason from tm)"""
QUERIES["rank_types"] = lambda spark, sf: R.keep_best(R.score_types(_types(spark, sf)), "type").select("file", "item_key", "score", "reason")
ORACLE["rank_types"] = with_derived("code_files", f"with {TYPES} {_top('ty', 0.3, 5)}")


def _tests(spark, sf):
    found = G.related_tests(_files(spark, sf), table(spark, sf, "test_files"))
    return found.select(
        "repo", F.col("path").alias("file"), "test_path", "tests", (F.length("path") * 7 % 101).alias("coverage")
    )


TESTS_SQL = C.TESTS + f""",
tt as (select tc.path as file, t.path as test_path, length(tc.path) * 7 % 101 as coverage, list_concat(regexp_extract_all(content, {_q(Y.TEST_NAME)}, 1),
    list_transform(regexp_extract_all(content, {_q(Y.SUITE_NAME)}, 1), lambda n: concat('[Suite] ', n))) as tests from tc join test_files t on t.path = tc.t),
te as (select file, test_path as item_key, array_to_string(tests, chr(10)) as content, least(100, case when {RELATED.format(a='file', b='test_path')} then 50 else 0 end + least(len(tests) * 10, 30) + case when coverage > 70 then 30 else 0 end) / 100.0::double as score,
  concat_ws(', ', case when {RELATED.format(a='file', b='test_path')} then 'matching path' end, case when len(tests) > 0 then concat(len(tests), ' tests') end, case when coverage > 70 then concat(coverage, '% coverage') end) as reason from tt)"""
QUERIES["rank_tests"] = lambda spark, sf: R.keep_best(R.score_tests(_tests(spark, sf)), "test").select("file", "item_key", "score", "reason")
ORACLE["rank_tests"] = with_derived("code_files test_files", f"with {TESTS_SQL} {_top('te', 0.3, 3)}")


def _deps(spark, sf):
    edges, roots = C._file_edges(spark, sf), C._file_roots(spark, sf)
    up = G.upstream(edges, roots, 2).withColumn("relation", F.lit("upstream"))
    down = G.downstream(edges, roots, 1).withColumn("relation", F.lit("downstream"))
    return up.unionByName(down).withColumnRenamed("root", "file")


DEPS = f"""{C.IMPORTED},
ed as (select distinct path as src, resolved as dst from re where resolved is not null),
wk as (select path as root, path as node, 0 as depth from code_files union select w.root, e.dst, w.depth + 1 from wk w join ed e on e.src = w.node where w.depth < 2),
dp as (select root as file, node, 'upstream' as relation, min(depth) as depth from wk group by 1, 2 having min(depth) > 0
  union all select distinct dst, src, 'downstream', 1 from ed where src <> dst),
de as (select file, node as item_key, relation, greatest(0, 100 - depth * 20 + case relation when 'upstream' then 20 else 0 end) / 100.0::double as score,
  concat('depth ', depth, ', ', case relation when 'upstream' then 'direct dependency' else 'dependent' end) as reason from dp)"""
QUERIES["rank_dependencies"] = lambda spark, sf: R.keep_best(
    R.score_dependencies(_deps(spark, sf)).withColumn("item_key", F.concat_ws(":", "content", "item_key")), "dependency"
).select("file", "item_key", "score", "reason")
ORACLE["rank_dependencies"] = with_derived("code_files", f"""
with recursive {DEPS}, dk as (select file, concat(relation, ':', item_key) as item_key, score, reason from de)
{_top('dk', 0.3, 5)}""")

QUERIES["related_paths"] = lambda spark, sf: C._file_edges(spark, sf).select(
    "src", "dst", P.related(F.col("src"), F.col("dst")).alias("related")
)
ORACLE["related_paths"] = with_derived("code_files", f"""
with {C.IMPORTED}, ed as (select distinct path as src, resolved as dst from re where resolved is not null)
select src, dst, {RELATED.format(a='src', b='dst')} as related from ed""")


def _scored(spark, sf):
    """Scored items of all categories; of similar code, what a prompt shows and one character more."""
    def of(category, scored):
        return scored.filter(F.col("score") >= R.MIN_SCORE.get(category, 0)).withColumn("category", F.lit(category)).select(*R.ITEM)

    uses = _imports(spark, sf)
    deps = R.score_dependencies(_deps(spark, sf))
    # dependencies are not scored by the strategies: nearer first
    plain = deps.withColumn("category", F.col("content")).select(*R.ITEM)
    out = R.score_imports(uses, plain_too=True).filter(F.col("score") >= R.MIN_SCORE["import"]).select(*R.ITEM)
    for category, scored in (("pattern", R.score_patterns(_patterns(spark, sf, max(R.TRUNCATE.values()) + 1))), ("type", R.score_types(_types(spark, sf))), ("test", R.score_tests(_tests(spark, sf)))):
        out = out.unionByName(of(category, scored))
    return out.unionByName(plain)


def _selected(spark, sf):
    return R.select_by_strategy(_scored(spark, sf), R.strategy_limits(spark))


LIMITS_SQL = "(values " + ", ".join(f"('{s}', '{c}', {'null' if m is None else m})" for s, c, m in R.STRATEGY_LIMITS) + ") l(strategy, category, max_items)"
ALL_ITEMS = f"""
{DEPS}, {USES}, {PATTERNS}, {TYPES}, {TESTS_SQL},
ip as (select file, import_path as item_key, least(100, least(m * 20, 60) + case when regexp_matches(lower(import_path), 'config|schema|type|interface|model|api') then 30 else 0 end) / 100.0::double as score,
  array_to_string(names, ', ') as content from uses),
al as (select file, 'import' as category, item_key, score, content from imr where score >= 0.3 union all select file, 'import_plain', item_key, score, content from ip where score >= 0.3
  union all select file, 'pattern', item_key, score, content from pt where score >= 0.4 union all select file, 'type', item_key, score, content from ty where score >= 0.3
  union all select file, 'test', item_key, score, content from te where score >= 0.3 union all select file, relation, item_key, score, relation from de),
nu as (select *, row_number() over (partition by file, category order by score desc, item_key) as rk from al),
se as (select nu.*, l.strategy, l.max_items from nu join {LIMITS_SQL} on l.category = nu.category where l.max_items is null or rk <= l.max_items)"""
QUERIES["strategy_select"] = lambda spark, sf: _selected(spark, sf).select("file", "strategy", "category", "item_key", "score")
ORACLE["strategy_select"] = with_derived("vectors code_files test_files", f"""
with recursive {ALL_ITEMS}
select file, strategy, category, item_key, score from se""")


def _heads(spark, sf):
    return _files(spark, sf).select(
        "repo", F.col("path").alias("file"), P.language_of(F.col("path")).alias("language"), F.col("content").alias("changed_code")
    )


def _parts(spark, sf, strategies):
    return R.context_parts(_selected(spark, sf), _heads(spark, sf), strategies)


PARTS = f"""
pr as (select file, strategy, item_rank, category, case strategy when 'security' then list_position(['import', 'type', 'pattern', 'upstream'], category)
      when 'performance' then list_position(['pattern', 'upstream', 'downstream', 'import_plain'], category)
      else list_position(['type', 'test', 'import', 'upstream', 'downstream', 'pattern'], category) end as section, item_key,
    concat('## ', case category when 'import' then 'Imports' when 'import_plain' then 'Imports' when 'type' then 'Types' when 'pattern' then 'Similar code'
      when 'upstream' then 'Depends on' when 'downstream' then 'Used by' else 'Tests' end, ': ', item_key, chr(10),
      case when category = 'pattern' and length(content) > cut then concat(substr(content, 1, cut), chr(10), '// ... truncated ...') else content end) as part
  from (select *, case when max_items is null then 0 else rk end as item_rank, case strategy when 'security' then 400 when 'performance' then 500 else 300 end as cut from se) s
  union all
  select path, st, 0, '', 0, '', concat(case st when 'security' then 'Look for security problems in this change.' when 'performance' then 'Look for performance problems in this change.'
      when 'logic' then 'Look for logic errors and missed cases in this change.' else 'Look for logic errors, security problems and missed cases in this change.' end,
    chr(10), '# File: ', path, chr(10), 'Language: ', case when path like '%.js' or path like '%.jsx' then 'javascript' else 'typescript' end, chr(10), content)
  from code_files, unnest(['security', 'performance', 'logic', 'code']) t(st))"""
QUERIES["context_parts"] = lambda spark, sf: _parts(spark, sf, list(R.SECTIONS)).select(
    "file", "strategy", "section", "item_rank", "item_key", F.md5("part").alias("part_hash")
)
ORACLE["context_parts"] = with_derived("vectors code_files test_files", f"""
with recursive {ALL_ITEMS}, {PARTS}
select file, strategy, cast(section as int) as section, cast(item_rank as int) as item_rank, item_key, md5(part) as part_hash from pr""")

QUERIES["assemble_context"] = lambda spark, sf: R.assemble_context(_parts(spark, sf, ["security", "performance"])).drop("repo")
ORACLE["assemble_context"] = with_derived("vectors code_files test_files", f"""
with recursive {ALL_ITEMS}, {PARTS}
select file, strategy, string_agg(part, concat(chr(10), chr(10)) order by section, item_rank, item_key) as prompt, count(*) as n_parts
from pr where strategy in ('security', 'performance') group by 1, 2""")

QUERIES["stack_notes"] = lambda spark, sf: R.stack_notes(
    N.detect_stacks(run_sql(spark, sf, ROOT_FILES)), spark.createDataFrame(R.STACK_NOTES, "stack string, agent string, note string")
)
ORACLE["stack_notes"] = with_derived("", f"""
with stacks as (select distinct r.repo, m.stack from root_files r join {MARKER_SQL} on r.path = m.path)
select s.repo, n.agent, s.stack, n.note from stacks s join (values {", ".join(f"('{s}', '{a}', '{t}')" for s, a, t in R.STACK_NOTES)}) n(stack, agent, note) on n.stack = s.stack""", root_files=ROOT_FILES)


def _enriched(spark, sf):
    types = Y.type_definitions(_files(spark, sf)).withColumn("file", F.col("path"))
    bundle = G.dependency_bundle(C._file_edges(spark, sf), C._tests(spark, sf), C._file_roots(spark, sf), 1)
    return R.enrich_context(_imports(spark, sf), types, _patterns(spark, sf).drop("code"), bundle)


QUERIES["enrich_context"] = lambda spark, sf: _enriched(spark, sf).select("file", "category", "item_key")
ORACLE["enrich_context"] = with_derived("vectors code_files test_files", f"""
with {C.IMPORTED}, {USES}, {PATTERNS}, {TYPES}, {C.TESTS}
select file, 'import' as category, import_path as item_key from uses
union all select file, 'type', name from tn union all select file, 'pattern', file_path from pa
union all select distinct path, 'upstream', resolved from re where resolved is not null and resolved <> path
union all select distinct resolved, 'downstream', path from re where resolved is not null and resolved <> path
union all select tc.path, 'test', t.path from tc join test_files t on t.path = tc.t""")
