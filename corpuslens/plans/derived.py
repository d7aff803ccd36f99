"""Inputs derived from the driver tables.

Each derivation is one SQL text that Spark and DuckDB both accept. ``{name}`` marks a base table or
another derivation. Every derivation keeps all rows of its base table; ``CASE`` on a key only varies the
shape of a row (file kind, status, path), it never drops one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpuslens.sources.files import read_spread

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED: dict[str, str] = {}

DERIVED["issues"] = """
select event_id as issue_id,
  concat('src/mod', cast(user_id % 10 as varchar(20)), '/file', cast(user_id as varchar(20)),
         case user_id % 3 when 0 then '.ts' when 1 then '.py' else '.js' end) as file,
  cast(event_id % 5 as int) as line,
  case event_type when 'error' then 'bug' when 'signup' then 'security' when 'purchase' then 'performance'
       when 'click' then 'style' else 'best-practice' end as type,
  case when value >= 150 then 'critical' when value >= 100 then 'high' when value >= 50 then 'medium'
       when value >= 20 then 'low' else 'info' end as severity,
  cast(event_id % 101 as double) / 100 as confidence,
  concat('finding ', cast(user_id % 3 as varchar(20))) as title,
  ts,
  concat('repo', cast(user_id % 4 as varchar(20))) as repo,
  case event_id % 5 when 0 then 'accepted' when 1 then 'rejected' when 2 then 'fixed' when 3 then null
       else case user_id % 2 when 0 then 'accepted' end end as feedback,
  case event_id % 4 when 0 then concat('use value ', cast(event_id as varchar(20))) when 1 then '' end
       as suggestion_code,
  cast(event_id % 900 + 100 as bigint) as prompt_tokens,
  cast(event_id % 300 as bigint) as completion_tokens
from {events}
"""

# The same findings in several repositories that share file names, some without file or confidence.
DERIVED["findings"] = """
select issue_id, concat('repo', cast(issue_id % 3 as varchar(20))) as repo,
  case issue_id % 97 when 0 then null else file end as file, line, type, severity,
  case issue_id % 89 when 0 then null else confidence end as confidence, title
from {issues}
"""

DERIVED["files"] = """
select doc_id, source as repo,
  concat(case doc_id % 10 when 0 then 'node_modules/' when 1 then 'dist/' when 2 then '.cache-x/' else '' end,
    lang, '/', source, '/doc', cast(doc_id as varchar(20)),
    case doc_id % 10 when 2 then '.min' when 4 then '.chunk' else '' end,
    case doc_id % 6 when 0 then '.ts' when 1 then '.js' when 2 then '.py' when 3 then '.go'
      when 4 then '.rs' else '.md' end) as path,
  text as content, n_chars as size
from {documents}
"""

# Two versions of the same files. A path that moves is a deletion plus an addition.
DERIVED["old_files"] = """
select repo, case doc_id % 13 when 0 then concat('retired/', path) else path end as path, content
from {files}
"""

DERIVED["new_files"] = """
select repo, case doc_id % 11 when 0 then concat('moved/', path) else path end as path,
  case doc_id % 7 when 0 then concat(content, chr(10), 'rev2') else content end as content
from {files}
"""

DERIVED["vectors"] = """
select concat('repo', cast(label as varchar(20))) as repo, vec_id as chunk_id,
  concat('src/m', cast(vec_id % 7 as varchar(20)), '/chunk', cast(vec_id as varchar(20)),
    case vec_id % 6 when 0 then '.ts' when 1 then '.js' when 2 then '.py' when 3 then '.go'
      when 4 then '.rs' else '.md' end) as file_path,
  embedding
from {embeddings}
"""

# Source files with real import, export, class and require lines; the document text follows as a comment.
DERIVED["code_files"] = """
select doc_id, 'main' as repo,
  concat('src/mod', cast(doc_id % 10 as varchar(20)), '/doc', cast(doc_id as varchar(20)),
    case doc_id % 6 when 0 then '.ts' when 1 then '.js' when 2 then '.tsx' when 3 then '.ts'
      when 4 then '.jsx' else '/index.ts' end) as path,
  concat(
    case doc_id % 4
      when 0 then concat('import { f', cast(t1 as varchar(20)), ', g as h } from ''../mod',
        cast(t1 % 10 as varchar(20)), '/doc', cast(t1 as varchar(20)), '.js'';')
      when 1 then concat('import D from "@/src/mod', cast(t1 % 10 as varchar(20)), '/doc',
        cast(t1 as varchar(20)), '";')
      when 2 then concat('import * as ns from ''./../mod', cast(t1 % 10 as varchar(20)), '/./doc',
        cast(t1 as varchar(20)), ''';')
      else concat('const { q } = require(''../mod', cast(t1 % 10 as varchar(20)), '/doc',
        cast(t1 as varchar(20)), ''');') end, chr(10),
    'import React from ''react'';', chr(10),
    'const lazy = () => import(''../mod', cast(t2 % 10 as varchar(20)), '/doc', cast(t2 as varchar(20)), ''');', chr(10),
    'export async function f', cast(doc_id as varchar(20)), '(a: T', cast(doc_id % 5 as varchar(20)),
    '): Promise<void> {', chr(10), '  if (a) { return await f', cast(t1 as varchar(20)), '(a); }', chr(10), '}', chr(10),
    case doc_id % 3
      when 0 then concat('export class C', cast(doc_id as varchar(20)), ' extends Base implements Shape, Other {', chr(10), '}', chr(10))
      when 1 then concat('export interface T', cast(doc_id % 5 as varchar(20)), ' extends Root {', chr(10), '  id: number;', chr(10), '}', chr(10))
      else concat('export type T', cast(doc_id % 5 as varchar(20)), ' = { id: number, name: string };', chr(10)) end,
    'const helper', cast(doc_id % 50 as varchar(20)), ' = async (x: T', cast(doc_id % 5 as varchar(20)), ') => x ? 1 : 2;', chr(10),
    'export { helper', cast(doc_id % 50 as varchar(20)), ' as helped, lazy };', chr(10),
    case doc_id % 2 when 0 then concat('export default f', cast(doc_id as varchar(20)), ';', chr(10)) else '' end,
    '/* ', replace(text, '*/', '* /'), ' */') as content
from (select d.*, (doc_id * 7 + 1) % (select count(*) from {documents}) as t1,
        (doc_id * 13 + 5) % (select count(*) from {documents}) as t2
      from {documents} d) s
"""

# Each code file with types that have members of every form, marks of comments inside literals and the reverse.
DERIVED["script_files"] = """
select doc_id, repo, path, concat(content, chr(10),
  '// it''s a note: class Hidden { x: number; }', chr(10),
  'const link', cast(doc_id as varchar(20)), ' = "http://host/', cast(doc_id % 7 as varchar(20)), '"; /* "open */', chr(10),
  'const both = `a // b ', chr(10), ' /* c ', cast(doc_id % 3 as varchar(20)), ' */ } {`; // gone', chr(10),
  case doc_id % 3
    when 0 then concat('export abstract class Store', cast(doc_id as varchar(20)), '<K, V extends Map<string, K>>', chr(10), '  extends Base', chr(10), '  implements Shape, Other {', chr(10),
      '  private readonly cache: Map<string, T', cast(doc_id % 5 as varchar(20)), '[]> = new Map();', chr(10), '  static size?: number', chr(10),
      '  constructor(private a: string,', chr(10), '    b = { c: 1 }) {', chr(10), '    if (a) { this.go({ x: a }); }', chr(10), '  }', chr(10),
      '  protected async load<R>(key: K, more?: (x: R) => void): Promise<R> {', chr(10), '    return "};" as any;', chr(10), '  }', chr(10),
      '  handler = async (e: Event) => {', chr(10), '    await e;', chr(10), '  };', chr(10), '}', chr(10))
    when 1 then concat('interface Node', cast(doc_id as varchar(20)), ' extends Root, Other<string> {', chr(10), '  readonly id: number;', chr(10),
      '  kind:', chr(10), '    | "a;b"', chr(10), '    | "c"', chr(10), '  meta?: { deep: { deeper: string }; other: number },', chr(10),
      '  visit(fn: (n: Node', cast(doc_id as varchar(20)), ') => void, depth?: number): void;', chr(10), '  [key: string]: unknown', chr(10), '}', chr(10))
    else concat('type Point', cast(doc_id as varchar(20)), ' = { x: number, y?: Pair<A, B>, at(z: number): Point };', chr(10),
      'export enum Level', cast(doc_id % 9 as varchar(20)), ' { Low = 1, High = "x,y", }', chr(10)) end) as content
from {code_files}
"""

# One test file per document, under one of the names a test may have (or one that matches nothing).
DERIVED["test_files"] = """
select repo,
  concat('src/mod', cast(doc_id % 10 as varchar(20)), '/',
    case doc_id % 5 when 0 then '' when 1 then '' when 2 then '__tests__/' when 3 then '' else 'elsewhere/' end,
    'doc', cast(doc_id as varchar(20)),
    case doc_id % 5 when 0 then '.test.ts' when 1 then '.spec.js' when 2 then '.test.tsx'
      when 3 then '.spec.tsx' else '.test.ts' end) as path,
  concat('describe("suite ', cast(doc_id as varchar(20)), '", () => {', chr(10),
    '  it(''case a', cast(doc_id as varchar(20)), ''', () => {});', chr(10),
    case doc_id % 2 when 0 then concat('  test("case b", () => {});', chr(10)) else '' end,
    '});', chr(10), '// ', replace(content, chr(10), ' ')) as content
from (select doc_id, 'main' as repo, text as content from {documents}) d
"""

DERIVED["python_files"] = """
select doc_id, 'main' as repo, concat('app/pkg', cast(doc_id % 10 as varchar(20)), '/m', cast(doc_id as varchar(20)),
    case doc_id % 4 when 0 then '/__init__.py' else '.py' end) as path,
  concat('import os, pkg', cast(t1 % 10 as varchar(20)), '.m', cast(t1 as varchar(20)), ' as dep', chr(10),
    'from .m', cast(t1 as varchar(20)), ' import f', cast(t1 as varchar(20)), ' as g, h', chr(10),
    case doc_id % 3 when 0 then concat('from typing import *', chr(10)) else '' end,
    'LIMIT = 3', chr(10), '_hidden = 4', chr(10),
    case doc_id % 5 when 0 then concat('__all__ = ["f', cast(doc_id as varchar(20)), '"]', chr(10)) else '' end,
    case doc_id % 2 when 0 then 'async ' else '' end, 'def f', cast(doc_id as varchar(20)), '(a, b: int = 2, *rest) -> str:', chr(10),
    '    return str(a)', chr(10), 'def _private():', chr(10), '    pass', chr(10),
    'class K', cast(doc_id as varchar(20)), case doc_id % 3 when 1 then '(Enum)' else '(Base, Mixin)' end, ':', chr(10),
    '    size: int = 1', chr(10), '    def run(self, x):', chr(10), '        return x', chr(10),
    '# ', replace(replace(text, chr(13), ' '), chr(10), concat(chr(10), '# ')), chr(10)) as content
from (select d.*, (doc_id * 7 + 1) % (select count(*) from {documents}) as t1 from {documents} d) s
"""

DERIVED["go_files"] = """
select doc_id, 'main' as repo, concat('svc/pkg', cast(doc_id % 10 as varchar(20)), '/u', cast(doc_id as varchar(20)), '.go') as path,
  concat('package main', chr(10), 'import "fmt"', chr(10), 'import (', chr(10),
    '    al "example.org/x/pkg', cast(t1 % 10 as varchar(20)), '"', chr(10), '    . "strings"', chr(10), '    _ "embed"', chr(10),
    '    "net/http"', chr(10), ')', chr(10),
    'type S', cast(doc_id as varchar(20)), ' struct {', chr(10), '    Id int', chr(10), '}', chr(10),
    'type reader interface {', chr(10), '}', chr(10), 'type Alias = string', chr(10),
    'func (s *S', cast(doc_id as varchar(20)), ') Run(a int, b string) error {', chr(10), '}', chr(10),
    'func helper', cast(doc_id % 50 as varchar(20)), '() {', chr(10), '}', chr(10),
    'var Top = 1', chr(10), 'const low = 2', chr(10), '// ', replace(text, chr(10), concat(chr(10), '// '))) as content
from (select d.*, (doc_id * 7 + 1) % (select count(*) from {documents}) as t1 from {documents} d) s
"""

DERIVED["rust_files"] = """
select doc_id, 'main' as repo, concat('src/m', cast(doc_id as varchar(20)), case doc_id % 4 when 0 then '/mod.rs' else '.rs' end) as path,
  concat('use crate::m', cast(t1 as varchar(20)), '::{Alpha, beta as gamma};', chr(10), 'pub use super::m', cast(t1 as varchar(20)), ';', chr(10),
    'use std::collections::*;', chr(10), 'extern crate serde as sd;', chr(10),
    'pub struct R', cast(doc_id as varchar(20)), ' {', chr(10), '}', chr(10), 'enum Kind { A, B }', chr(10), 'pub(crate) trait Walk {', chr(10), '}', chr(10),
    'pub type Id = u64;', chr(10), 'pub async fn f', cast(doc_id as varchar(20)), '(a: u32) -> u32 {', chr(10), '    a', chr(10), '}', chr(10),
    'fn inner() {}', chr(10), 'pub const MAX: u32 = 3;', chr(10), '// ', replace(text, chr(10), concat(chr(10), '// '))) as content
from (select d.*, (doc_id * 7 + 1) % (select count(*) from {documents}) as t1 from {documents} d) s
"""

# Each Rust file with use trees of several levels and lines, one per form, and statements in literals and comments.
DERIVED["rust_trees"] = """
select doc_id, repo, path, concat(
  case doc_id % 3
    when 0 then concat('use std::{', chr(10), '    io::{self, Read as R, fs::{File, /* Gone, */ Open', cast(doc_id as varchar(20)), '}},', chr(10), '    fmt, // note', chr(10), '};', chr(10))
    when 1 then concat('pub(crate) use {a', cast(doc_id as varchar(20)), '::{self}, b::*}; use d as e;', chr(10), '// use no::way;', chr(10))
    else concat('let s = "', chr(10), 'use in::literal; ";', chr(10), 'fn f<''a>(x: &''a str) { use g::{h', cast(doc_id as varchar(20)), ', i::{j::{k::{l}}}}; }', chr(10)) end,
  content) as content
from {rust_files}
"""

# Two repositories whose files have the same paths: code, and texts.
DERIVED["twin_files"] = """
select concat('twin', cast(doc_id % 2 as varchar(20))) as repo,
  concat('src/m', cast(doc_id - doc_id % 2 as varchar(20)), '.ts') as path, content
from {code_files}
"""

DERIVED["twin_texts"] = """
select concat('twin', cast(doc_id % 2 as varchar(20))) as repo,
  concat('doc', cast(doc_id - doc_id % 2 as varchar(20))) as path, text as content
from {documents}
"""

DERIVED["edges"] = """
select concat('g', cast(doc_id % 3 % 2 as varchar(20))) as repo, doc_id as src, (doc_id * 7 + 1) % (select count(*) from {documents}) as dst from {documents}
union
select concat('g', cast(doc_id % 2 as varchar(20))) as repo, doc_id as src, (doc_id * 13 + 5) % (select count(*) from {documents}) as dst from {documents}
"""

# One multi-file unified diff per document: two files, the first with two hunks; the text is the new content.
DERIVED["diffs"] = """
select doc_id as diff_id,
  concat('diff --git a/', p1, ' b/', case doc_id % 9 when 5 then concat('renamed/', p1) else p1 end, chr(10),
    case doc_id % 4 when 0 then concat('new file mode 100644', chr(10))
                    when 1 then concat('deleted file mode 100644', chr(10)) else '' end,
    'index 000..111', chr(10), '--- a/', p1, chr(10), '+++ b/', p1, chr(10),
    '@@ -', cast(doc_id % 9 + 1 as varchar(20)), ',3 +', cast(doc_id % 9 + 2 as varchar(20)), ',4 @@ fn', cast(doc_id % 7 as varchar(20)), chr(10),
    ' keep', chr(10),
    case doc_id % 5 when 0 then '-export const gone = 1;' when 1 then '-function work(a: number): string {'
      else concat('-old', cast(doc_id as varchar(20))) end, chr(10),
    case doc_id % 5 when 1 then case doc_id % 2 when 0 then '+function work(a: number): string {' else '+function work(a: number, b: number): string {' end
      else concat('+if (x) { await y', cast(doc_id as varchar(20)), '(); }') end, chr(10),
    '+extra', chr(10), ' tail', chr(10),
    chr(92), ' No newline at end of file', chr(10),
    '@@ -40 +41 @@', chr(10), '-a', chr(10), '+', case doc_id % 3 when 0 then 'const v = x ? 1 : 2;' else 'b' end, chr(10),
    'diff --git a/', p2, ' b/', p2, chr(10),
    'index 222..333', chr(10),
    '@@ -0,0 +1 @@', chr(10),
    '+', replace(text, chr(10), concat(chr(10), '+'))) as diff_text
from (select doc_id, text,
        concat(case doc_id % 6 when 0 then 'src/auth/f' when 1 then 'src/core/tests/f' when 2 then 'docs/db/f'
          when 3 then 'pkg/api/v1/f' when 4 then 'src/ui/f' else 'f' end, cast(doc_id % 50 as varchar(20)),
          case doc_id % 5 when 0 then '.ts' when 1 then '.js' when 2 then '.md' when 3 then '.test.ts' else '.py' end) as p1,
        concat(case doc_id % 6 when 1 then 'src/core/tests/g' when 2 then 'docs/g' else 'lib/billing/g' end, cast(doc_id % 20 as varchar(20)),
          case doc_id % 5 when 2 then '.md' when 3 then '.spec.ts' when 4 then '.png' else '.tsx' end) as p2
      from {documents}) s
"""

# Search tool calls, taken from the event log: one session per reviewed file, five tools.
DERIVED["tool_calls"] = """
select event_id as call_id, concat('file', cast(user_id as varchar(20))) as session,
  case event_type when 'error' then 'search' when 'signup' then 'test' when 'purchase' then 'related'
    when 'click' then 'usages' else 'callers' end as tool,
  concat('q', cast(event_id % 9 as varchar(20))) as search_key, ts, value as duration_ms
from {events}
"""

# Tool calls of which some have no session, tool or key.
DERIVED["odd_calls"] = """
select call_id, case call_id % 83 when 0 then null else session end as session,
  case call_id % 79 when 0 then null else tool end as tool,
  case call_id % 73 when 0 then null else search_key end as search_key, ts, duration_ms
from {tool_calls}
"""

# User feedback on stored findings; an entry may get it several times, the last one counts.
DERIVED["feedback_log"] = """
select event_id as seq, event_id as issue_id, feedback, ts from (select issue_id as event_id, feedback, ts from {issues}) a where feedback is not null
union all
select event_id + 1000000000000, (event_id * 3) % (select count(*) from {events}),
  case event_id % 3 when 0 then 'accepted' when 1 then 'rejected' else 'fixed' end, ts from {events}
"""

# Model answers as server-sent text: one delta per word in one of two vendor shapes, usage, stop and end marks.
DERIVED["answer_streams"] = """
select stream_id, text, case when stream_id % 2 = 0
  then concat('data: {"choices":[{"delta":{"reasoning":"think ', cast(stream_id as varchar(20)), '"}}]}', chr(10), chr(10),
    'data: {"choices":[{"delta":{"content":"', replace(esc, ' ', concat('"}}]}', chr(10), 'data: {"choices":[{"delta":{"content":" ')), '"}}]}', chr(10),
    ': comment', chr(10), 'data: {"choices":[{"delta":', chr(10),
    'data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"prompt_tokens":', cast(stream_id % 97 as varchar(20)), ',"completion_tokens":', cast(length(text) as varchar(20)), ',"total_tokens":', cast(stream_id % 97 + length(text) as varchar(20)), '}}', chr(10),
    'data: [DONE]', chr(10))
  else concat('event: x', chr(10), 'data: {"type":"content_block_delta","delta":{"text":"', replace(esc, ' ', concat('"}}', chr(10), 'data: {"type":"content_block_delta","delta":{"text":" ')), '"}}', chr(10),
    'data: {"type":"message_stop","stop_reason":"max_tokens"}', chr(10)) end as body
from (select conv_id * 1000 + turn as stream_id, text,
    replace(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')) as esc
  from {conversations}) s
"""

# Progress events of reviews: one session per user, in event order.
DERIVED["progress_events"] = """
select concat('s', cast(user_id as varchar(20))) as session, event_id as seq, ts,
  case event_id % 8 when 0 then 'thinking' when 1 then 'text' when 2 then 'agent-start' when 3 then 'agent-complete'
    when 4 then 'file-start' when 5 then 'file-complete' when 6 then 'thinking' else case when event_id % 97 = 0 then 'complete' else 'text' end end as type,
  event_type as agent, concat('f', cast(event_id % 31 as varchar(20))) as file_name, concat('c', cast(event_id as varchar(20))) as content
from {events}
"""

# File changes in time order: every document is added, most are changed or removed later.
DERIVED["change_events"] = """
select repo, path, 'add' as op, content, doc_id as seq from {files}
union all
select repo, path, case doc_id % 3 when 0 then 'change' when 1 then 'unlink' else 'add' end,
  case doc_id % 3 when 1 then null else concat(content, chr(10), 'v2') end, doc_id + 1000000000000 from {files}
"""

def _names(text: str) -> list[str]:
    """Tables a text refers to; other braces are ordinary characters (JSON)."""
    found = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
    return [n for n in found if n in DERIVED or n in BASE]


def _order(name: str, seen: list[str]) -> None:
    for dep in _names(DERIVED[name]):
        if dep in DERIVED and dep not in seen:
            _order(dep, seen)
    if name not in seen:
        seen.append(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derivation of it, as a lazy DataFrame."""
    if name in BASE:
        return read_spread(spark, f"{sf_dir}/{name}.parquet")
    return run_sql(spark, sf_dir, DERIVED[name])


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark result of a text over ``{name}`` tables."""
    names = _names(text)
    escaped = text.replace("{", "{{").replace("}", "}}")
    for n in names:
        escaped = escaped.replace("{{" + n + "}}", "{" + n + "}")
    return spark.sql(escaped, **{n: table(spark, sf_dir, n) for n in names})


def inline(text: str) -> str:
    """DuckDB form of a text over ``{name}`` tables."""
    for n in _names(text):
        text = text.replace("{" + n + "}", n)
    return text.strip()


def with_derived(names: str, body: str, **local: str) -> str:
    """Oracle text: ``body`` with the derivations it needs placed in front as CTEs.

    ``local`` adds texts of the query's own, after the derivations.
    """
    order: list[str] = []
    for name in names.split():
        _order(name, order)
    ctes = [f"{n} as ({inline(DERIVED[n])})" for n in order]
    ctes += [f"{n} as ({inline(text)})" for n, text in local.items()]
    body = body.strip()
    for start, glue in (("with recursive ", ",\n"), ("with ", ",\n")):
        if body.lower().startswith(start):
            return start + glue.join([*ctes, body[len(start):]])
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body
