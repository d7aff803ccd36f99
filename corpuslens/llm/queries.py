"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (
    automaton,
    forest,
    lines,
    merkle,
    minhash,
    mixing,
    packing,
    quality,
    records,
    shards,
    tokens,
    warc,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages")), ["page_id"])


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 16)


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).drop("lang", "source")


def op5_star_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=4, percent=80).drop("row_key")


def op6_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return done.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_table(table(spark, sf_dir, "documents"), path, limit=1024, budgets=[1024])


def op8_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return records.round_trip(spark, table(spark, sf_dir, "documents"), path, end_id=1)


def op9_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], components=4)
    return whitening.by_component(done, ["vec_id"])


def op12_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op13_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_prefix_forest": op2_prefix_forest,
    "op3_minimax_shards": op3_minimax_shards,
    "op4_adaptive_quality": op4_adaptive_quality,
    "op5_star_minhash": op5_star_minhash,
    "op6_line_bitmaps": op6_line_bitmaps,
    "op7_prefix_counts": op7_prefix_counts,
    "op8_record_files": op8_record_files,
    "op9_conflict_packing": op9_conflict_packing,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_block_whitening": op11_block_whitening,
    "op12_butterfly_manifest": op12_butterfly_manifest,
    "op13_merge_automaton": op13_merge_automaton,
}

# White space that the contracts name, as DuckDB text.
SPACES_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {}



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RE = {name: _quoted(getattr(warc, name)) for name in ("UNREAD", "LINE_END", "ANY_TAG", "ENTITY", "TITLE", "LANGUAGE", "HREF")}
_BLANKS = _quoted(warc.BLANK + "+")
_NAMED = "map {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in warc.ENTITIES.items()) + "}"


def _unescaped(text: str) -> str:
    code = (
        "case when n like '#x%' or n like '#X%' then cast('0x' || n[3:] as int)"
        " when n like '#%' then cast(n[2:] as int) end"
    )
    char = f"case when ({code}) between 1 and 55295 or ({code}) between 57344 and 1114111 then chr({code}) end"
    name = f"regexp_extract(p, {_RE['ENTITY']}, 1)"
    found = f"case when n like '#%' then {char} else {_NAMED}[n] end"
    named = f"list_transform([{name}], lambda n: coalesce(({found}) || p[length(n) + 2:], '&' || p))[1]"
    part = f"case when i = 1 then p when {name} = '' then '&' || p else {named} end"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: {part}), '')"


def _one_line(text: str) -> str:
    return f"trim(regexp_replace({text}, {_BLANKS}, ' ', 'g'), {SPACES_SQL})"


def _urn(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    cuts = [f"{h}[{a}:{b}]" for a, b in ((1, 8), (9, 12), (13, 16), (17, 20), (21, 32))]
    return f"'<urn:uuid:' || {" || '-' || ".join(cuts)} || '>'"


ORACLE["op1_warc_derivatives"] = f"""
with response as (
  select page_id, coalesce(html, '') as html, regexp_replace(url, '[\r\n]', '', 'g') as target_uri,
    {_urn("'response'", "cast(page_id as varchar)", "coalesce(url, '')")} as refers_to,
    concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10),
      'Content-Length: ', strlen(coalesce(html, ''))) as headers
  from pages
),
bare as (
  select *, 'sha256:' || sha256(html) as source_digest,
    regexp_replace(regexp_replace(regexp_replace(html, {_RE["UNREAD"]}, '', 'g'), {_BLANKS}, ' ', 'g'),
      {_RE["LINE_END"]}, chr(10), 'g') as lined
  from response
),
read as (
  select *, {_one_line(_unescaped(f"regexp_extract(html, {_RE['TITLE']}, 1)"))} as title,
    regexp_extract(html, {_RE["LANGUAGE"]}, 1) as language,
    list_transform(regexp_extract_all(html, {_RE["HREF"]}, 1), lambda u: {_one_line(_unescaped("u"))}) as links,
    {_unescaped(f"regexp_replace(lined, {_RE['ANY_TAG']}, '', 'g')")} as raw
  from bare
),
text as (
  select *, trim(regexp_replace(regexp_replace(raw, {_quoted(r"[ \t\r\x0B\f]+")}, ' ', 'g'),
      {_quoted(r" ?\n[ \n]*")}, chr(10), 'g'), concat(' ', chr(10))) as conversion,
    {_urn("'metadata'", "refers_to", "source_digest")} as metadata_id,
    {_urn("'conversion'", "refers_to", "source_digest")} as conversion_id
  from read
),
record as (
  select page_id, refers_to, target_uri, source_digest, 'metadata' as warc_type, metadata_id as record_id,
    conversion_id as concurrent_to, 'application/warc-fields' as content_type,
    concat('title: ', title, chr(13), chr(10), 'language: ', language, chr(13), chr(10),
      array_to_string(list_transform(string_split(headers, chr(13) || chr(10)),
        lambda h: 'source-header: ' || h || chr(13) || chr(10)), ''),
      array_to_string(list_transform(links, lambda u: 'outlink: ' || u || chr(13) || chr(10)), '')) as block
  from text
  union all
  select page_id, refers_to, target_uri, source_digest, 'conversion', conversion_id, metadata_id,
    'text/plain; charset=utf-8', conversion
  from text
)
select *, '2024-01-01T00:00:00Z' as date, 'sha256:' || sha256(block) as block_digest,
  cast(strlen(block) as bigint) as content_length
from record
"""

ORACLE["op6_line_bitmaps"] = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
line as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as pos from split),
keyed as (select *, {LOWER_SQL.format(f"trim(line, {SPACES_SQL})")} as k from line),
common as (
  select k, max(doc_id) as top from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
),
marked as (
  select doc_id, line, pos, coalesce(doc_id <> top, false) as gone from keyed left join common using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_RATES = {
    "symbol_rate": ("n_symbols", "n_words"), "length_rate": ("word_chars", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"), "upper_rate": ("n_upper", "word_chars"),
}


_SPREAD = "case rate " + " ".join(f"when '{k}' then {v}" for k, v in quality.LEAST_SPREAD.items()) + " end"


def _same(a: str, b: str, keys: list[str]) -> str:
    return " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in keys)


def _blend(keys: list[str], prior: str, shared: list[str]) -> str:
    """Shares of each group of a sketch table, blended with those of its prior, as DuckDB text."""
    by = ", ".join([*keys, "rate"])
    return f"""(
    select {", ".join(f"g.{k}" for k in [*keys, "rate"])}, p.bucket,
      coalesce(o.n, 0) * p.total + {quality.PRIOR_DOCS} * p.w as w, p.total * (g.docs + {quality.PRIOR_DOCS}) as total
    from (select {by}, cast(sum(n) as hugeint) as docs from sketch group by {by}) g
    join {prior} p on {_same("g", "p", [*shared, "rate"])}
    left join (select {by}, bucket, cast(sum(n) as hugeint) as n from sketch group by {by}, bucket) o
      on {_same("g", "o", [*keys, "rate"])} and o.bucket = p.bucket)"""


def _quarters(shares: str, keys: list[str]) -> str:
    by = ", ".join([*keys, "rate"])
    at = lambda q: f"min(case when 4 * upto >= {q} * total then bucket end)"
    return f"""(select {by}, {at(1)} as q1, {at(2)} as q2, {at(3)} as q3
    from (select *, sum(w) over (partition by {by} order by bucket) as upto from {shares} x) y group by {by})"""


ORACLE["op4_adaptive_quality"] = f"""
with text_of as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as w from documents),
lined as (
  select *, list_filter(string_split(text, chr(10)), lambda x: trim(x, {SPACES_SQL}) <> '') as ls from text_of
),
gram as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from text_of where len(w) >= 5) x
),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as times from gram) x where times > 1),
covered as (
  select doc_id, count(distinct k) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 5)) as k from twice) x group by doc_id
),
counted as (
  select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(ls) as n_lines,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) as n_upper,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from lined left join covered using (doc_id)
),
rated as (
  {" union all ".join(f"select doc_id, lang, source, '{k}' as rate, 1000 * {a} // nullif({b}, 0) as value from counted" for k, (a, b) in _RATES.items())}
),
sketch as (
  select lang, source, rate, value - value % cast(pow(2, greatest(length(bin(value)) - {quality.SKETCH_BITS}, 0)) as bigint) as bucket,
    count(*) as n
  from rated where value is not null group by all
),
whole as (
  select rate, bucket, cast(sum(n) as hugeint) as w, cast(sum(sum(n)) over (partition by rate) as hugeint) as total
  from sketch group by rate, bucket
),
by_lang as {_blend(["lang"], "whole", [])}, by_source as {_blend(["lang", "source"], "by_lang", ["lang"])},
wide as (
  select lang, rate, q2 + {2 * quality.FENCE_WIDTH} * (q2 - q1) + {quality.MOST_SPREADS} * {_SPREAD} as bound
  from {_quarters("by_lang", ["lang"])} q
),
own as (
  select lang, source, rate, greatest(q3 + {quality.FENCE_WIDTH} * (q3 - q1), q2 + {_SPREAD}) as fence
  from {_quarters("by_source", ["lang", "source"])} q
),
outside as (
  select distinct r.doc_id from rated r
  join own o on {_same("o", "r", ["lang", "source", "rate"])}
  join wide w on {_same("w", "r", ["lang", "rate"])}
  where r.value > least(fence, bound)
),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed,
  not base_failed and doc_id not in (select doc_id from outside) as kept
from judged
"""

ORACLE["op5_star_minhash"] = f"""
with recursive word as (
  select doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w
  from documents
),
shingle as (
  select distinct doc_id, unnest(case when len(w) = 0 then cast([] as varchar[])
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from word
),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
edge as (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b
  where 100 * common >= 80 * (x.n + y.n - common)
),
way as (select a, b from edge union all select b, a from edge),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, w.b from reach r join way w on r.b = w.a where w.b < r.a
),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join size using (doc_id) join least using (doc_id)
"""


def _field(value: str) -> str:
    text = f"cast({value} as varchar)"
    return f"case when {value} is null then '-' else strlen({text}) || ':' || {text} end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


# CRC-32 of a decimal number, bit by bit.
_BITS = "list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))"
_DIGITS = "list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))"
_CRC = f"xor(list_reduce([4294967295] || {_DIGITS}, lambda c, b: {_BITS}), 4294967295)"
_UP = "select grp, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i))"

ORACLE["op12_butterfly_manifest"] = f"""
with recursive leaf as (
  select row_number() over () as r, doc_id, lang as grp, {_leaf("text")} as leaf,
    case when {_CRC} % 3 = 0 then {_leaf(LOWER_SQL.format("text"))} else {_leaf("text")} end as tampered
  from documents
),
placed as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by grp) as n
  from leaf
),
node as (
  select grp, 0 as level, i, n, leaf as h from placed
  union all
  {_UP} from node where n > 1 group by grp, level, i // 8, n
),
subroot as (
  select grp as lang, level as steps, h as subroot, row_number() over (order by grp nulls first) - 1 as place, count(*) over () as langs
  from node where n = 1
),
over as (
  select '' as grp, 0 as level, place as i, langs as n, subroot as h from subroot
  union all
  {_UP} from over where n > 1 group by grp, level, i // 8, n
),
run as (select grp, level, i // 8 as run, list(h order by i) as hs from node where n > 1 group by 1, 2, 3),
over_run as (select level, i // 8 as run, list(h order by i) as hs from over where n > 1 group by 1, 2),
step as (
  select p.r, u.level, p.i // cast(pow(8, u.level) as bigint) % 8 as own, hs
  from placed p join run u on u.grp is not distinct from p.grp and u.run = p.i // cast(pow(8, u.level + 1) as bigint)
  union all
  select p.r, s.steps + u.level, s.place // cast(pow(8, u.level) as bigint) % 8, hs
  from placed p join subroot s on s.lang is not distinct from p.grp
  join over_run u on u.run = s.place // cast(pow(8, u.level + 1) as bigint)
),
side as (select r, level, array_to_string(hs[1:own], '') as before, array_to_string(hs[own + 2:], '') as after from step),
folded as (
  select r, 0 as level, tampered as h from placed
  union all
  select f.r, f.level + 1, sha256(before || h || after) from folded f join side s on s.r = f.r and s.level = f.level
),
proof as (select r, sha256(string_agg(before || after, '' order by level)) as proof_sha256 from side group by r),
root as (select h as root from over where n = 1)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = root as verified
from placed p join subroot s on s.lang is not distinct from p.grp cross join root left join proof using (r)
join (select r, arg_max(h, level) as h from folded group by r) f using (r)
"""
