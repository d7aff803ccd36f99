"""Rows that a Python function reads out of texts, a few texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

AT_ONCE = 64  # texts whose rows are held at once
TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def rows_of_texts(files: DataFrame, rows: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """(repo, path, *row) for every row that ``rows`` finds in the content of a file; ``schema`` names string, int and boolean columns.

    Of a batch, ``AT_ONCE`` texts at a time become Python objects, and their rows are sent on before the next, so a
    worker's memory does not grow with the rows of a batch or with what is found in them.
    """
    fields = [c.split() for c in schema.split(", ")]
    types = pa.schema([(name, TYPES[kind]) for name, kind in fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                texts = batch.slice(start, AT_ONCE).to_pydict()
                found = [
                    (repo, path, *row)
                    for repo, path, code in zip(texts["repo"], texts["path"], texts["content"], strict=True)
                    for row in rows(code or "")
                ]
                if found:
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return files.select("repo", "path", "content").mapInArrow(parse, schema)
