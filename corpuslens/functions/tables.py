"""Table functions for SQL users, built on the engine's own expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpuslens.operators.chunks import RANGE

# The fold of ``operators.chunks`` over line lengths, as text: state in, state out, once a line.
STEP = """named_struct(
  'i', s.i + 1,
  'start', if({full}, greatest(0, s.i - back), s.start),
  'first', case when {full} then greatest(0, s.i - back) when s.len = 0 and n = 0 then s.i + 1 else s.first end,
  'len', case when {full} then aggregate(slice(lens, greatest(0, s.i - back) + 1, s.i - greatest(0, s.i - back) + 1), 0, (a, x) -> a + x)
      + s.i - greatest(0, s.i - back) when s.len = 0 then n else s.len + 1 + n end,
  'done', if({full}, concat(s.done, array(named_struct('start', s.start, 'first', s.first, 'last', s.i - 1))), s.done))"""

CHUNKS_OF = f"""
create or replace temporary function {{name}}(content string, size int, back int)
returns table (chunk_index int, line_start int, line_end int, text string)
comment 'Overlapping line chunks of a text: up to size characters, reopened up to back lines earlier.'
return select chunk_index, chunk.line_start, chunk.line_end, chunk.text
from (select posexplode(filter(
    transform(array(split(content, '\\n')), lines -> transform(array(transform(lines, l -> length(l))), lens ->
      transform(aggregate(lens,
          named_struct('i', 0, 'start', 0, 'first', 0, 'len', 0, 'done', cast(array() as array<{RANGE}>)),
          (s, n) -> {{step}},
          s -> if(s.len > 0, concat(s.done, array(named_struct('start', s.start, 'first', s.first, 'last', s.i - 1))), s.done)),
        r -> named_struct('line_start', r.start, 'line_end', r.last,
          'text', array_join(slice(lines, r.first + 1, r.last - r.first + 1), '\\n'),
          'tail', r.last = size(lines) - 1)))[0])[0],
    c -> not c.tail or c.text rlike '\\\\S')) as (chunk_index, chunk)) opened
"""


def register_chunks_of(spark: SparkSession, name: str = "chunks_of") -> None:
    """Make ``chunks_of(content, size, back)`` known to the session's SQL, one row a chunk.

    ``select path, c.* from files, lateral chunks_of(content, 2000, 4) c`` gives the chunks of
    ``operators.chunks.chunk_files`` with ``size`` characters and ``back`` lines of overlap. A null or empty
    text has no rows. The function is an expression of the query it stands in: nothing leaves the JVM.
    """
    if not name.isidentifier():
        raise ValueError(f"not a function name: {name}")
    full = "(s.len > 0 and s.len + 1 + n > size)"
    spark.sql(CHUNKS_OF.replace("{name}", name).replace("{step}", STEP.replace("{full}", full)))
