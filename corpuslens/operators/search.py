"""Search over chunk vectors and chunk text: exact top-k, merges, filters, response shapes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.let import let
from corpuslens.functions.paths import last_dot_part
from corpuslens.functions.windows import join_null_safe, top_per_group
from corpuslens.session import cut_lineage

DEFAULT_K = 10
SNIPPET_CHARS = 300
PREVIEW_LINES = 10
PREVIEW_CHARS = 300
SCORE_DIGITS = 6
# Queries up to this many bytes of vectors travel to every task; more are paired by shuffle.
SMALL_QUERY_BYTES = 32 << 20
BUCKET_BYTES = 64 << 20  # of vectors, as double precision, in one task's bucket
BLOCK_BYTES = 32 << 20  # of queries
ROW_BLOCK = QUERY_BLOCK = 1 << 11  # rows and queries scored at once
GROUP = 16  # scores of a query whose best one stands for them
EXACT_ROWS = 1 << 16  # pairs scored in double precision at once

HITS = "query_id long, repo string, chunk_id long, file_path string, score double"
HIT_TYPES = {"query_id": "int64", "repo": object, "chunk_id": "int64", "file_path": object, "score": "float64"}
HIT_COLUMNS = list(HIT_TYPES)


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _maxima(scores: np.ndarray) -> np.ndarray:
    """The best of each group of ``GROUP`` entries of a line, ``n // GROUP`` apart; entries at the end may be in none."""
    n = scores.shape[1] // GROUP
    return scores[:, : n * GROUP].reshape(len(scores), GROUP, n).max(axis=1)


def _reached_by(scores: np.ndarray, maxima: np.ndarray, wanted: int) -> np.ndarray:
    """A score that at least ``wanted`` entries of each line reach: of as many maxima, where there are enough."""
    if maxima.shape[1] > 2 * wanted:
        scores = maxima
    n = scores.shape[1]
    return np.partition(scores, n - wanted, axis=1)[:, n - wanted]


def _not_below(scores: np.ndarray, maxima: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the entries that are not below the bar of their line; whole groups are passed over."""
    n = maxima.shape[1]
    line, place = np.nonzero(~(scores[:, n * GROUP :] < bar[:, None]))
    lines, places = [line], [place + n * GROUP]
    if n:
        line, group = np.divmod(np.flatnonzero(~(maxima < bar[:, None]).ravel()), n)
        for start in range(0, len(line), EXACT_ROWS):
            own = line[start : start + EXACT_ROWS, None]
            at = group[start : start + EXACT_ROWS, None] + n * np.arange(GROUP)
            some, which = np.nonzero(~(scores[own, at] < bar[own]))
            lines.append(own[some, 0])
            places.append(at[some, which])
    return np.concatenate(lines), np.concatenate(places)


class TopHits:
    """The k best chunks seen so far of every query, over all batches of a task (and per repository if asked).

    Only rows of equal ``kind`` (match value and vector length) are compared. A chunk whose path contains
    the ``current_file`` of a query is no hit for it.

    A block of rows meets a block of queries in single precision. What may still reach the k best by that, with
    room for its error, is scored again in double precision, so the hits are the exact ones; a query holds k rows.
    """

    def __init__(self, asked: pd.DataFrame, k: int, per_repo: bool):
        self.k, self.per_repo = k, per_repo
        self.groups = {}
        for kind, rows in asked.groupby("kind"):
            self.groups[kind] = (rows["query_id"].to_numpy(), _unit(rows["embedding"]), rows["current_file"].to_numpy())
        self.best: dict[tuple, pd.DataFrame] = {}  # by kind, repository (if asked) and first query of a block
        self.least: dict[tuple, np.ndarray] = {}  # a score that the k-th best of each query reaches already

    def add(self, pdf: pd.DataFrame) -> None:
        for kind, rows in pdf.groupby("kind"):
            if kind not in self.groups:
                continue
            vectors = _unit(rows["embedding"])
            named = rows[["repo", "chunk_id", "file_path"]].reset_index(drop=True)
            code, repos = pd.factorize(named["repo"], use_na_sentinel=False)
            sections = [(r, np.flatnonzero(code == i)) for i, r in enumerate(repos)] if self.per_repo else [(None, np.arange(len(named)))]
            for repo, at in sections:
                for row in range(0, len(at), ROW_BLOCK):
                    part = at[row : row + ROW_BLOCK]
                    self._score(kind, None if pd.isna(repo) else repo, vectors[part], named.iloc[part])

    def cut(self) -> pd.DataFrame:
        found = [b.assign(query_id=self.groups[key[0]][0][b["at"]]) for key, b in self.best.items()]
        every = pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in HIT_COLUMNS})
        return pd.DataFrame({c: pd.Series(every[c].tolist(), dtype=t) for c, t in HIT_TYPES.items()})

    def _score(self, kind: str, repo: str | None, vectors: np.ndarray, named: pd.DataFrame) -> None:
        ids, unit, current = self.groups[kind]
        single = vectors.astype(np.float32)
        chunk, path = named["chunk_id"].to_numpy(), named["file_path"].to_numpy()
        room = (unit.shape[1] + 8) * 1.2e-7 + 10.0**-SCORE_DIGITS
        for lo in range(0, len(ids), QUERY_BLOCK):
            key, asked = (kind, repo, lo), unit[lo : lo + QUERY_BLOCK]
            least = self.least.setdefault(key, np.full(len(asked), -np.inf))
            rough = asked.astype(np.float32) @ single.T
            at, row = self._reaching(rough, least - room, room, path, current[lo : lo + QUERY_BLOCK])
            if not len(at):
                continue
            score = np.empty(len(at))
            for i in range(0, len(at), EXACT_ROWS):
                some = slice(i, i + EXACT_ROWS)
                score[some] = np.einsum("ij,ij->i", vectors[row[some]], asked[at[some]])
            found = named.iloc[row].assign(at=at + lo, score=np.round(score, SCORE_DIGITS))
            held = self.best.get(key)
            found = found if held is None else pd.concat([held, found], ignore_index=True)
            by = [found["chunk_id"].to_numpy(), -found["score"].to_numpy(), found["at"].to_numpy()]
            if not self.per_repo:
                place = pd.factorize(found["repo"], sort=True)[0]
                by = [np.where(place < 0, len(found), place), *by]
            found = found.iloc[np.lexsort(by)]
            own = found["at"].to_numpy()
            rank = np.arange(len(own)) - np.searchsorted(own, own)
            last = rank == self.k - 1
            least[own[last] - lo] = found["score"].to_numpy()[last]
            self.best[key] = found[rank < self.k]

    def _reaching(self, rough: np.ndarray, least: np.ndarray, room: float, path, current) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that may be among the k best; ``least`` is minus infinity where no k are held yet.

        Those queries take a partial selection, widened only while the queried file takes places.
        """
        queries, rows = rough.shape
        pairs, todo, wanted = [], np.arange(queries), 2 * self.k
        while len(todo):
            some = rough if len(todo) == queries else rough[todo]
            maxima, bar = _maxima(some), least[todo]
            new = np.flatnonzero(np.isneginf(bar))
            if len(new) and wanted < rows:
                lines = slice(None) if len(new) == len(some) else new
                bar[new] = _reached_by(some[lines], maxima[lines], wanted).astype(np.float64) - room
            at, row = _not_below(some, maxima, bar.astype(np.float32))
            asked = current[todo]
            free = [c is None or path[r] is None or c not in path[r] for c, r in zip(asked[at], row, strict=True)]
            at, row = at[free], row[free]
            short = np.zeros(len(todo), bool)
            if wanted < rows:
                short[new] = np.bincount(at, minlength=len(todo))[new] < self.k
            done = ~short[at]
            pairs.append((todo[at[done]], row[done]))
            todo, wanted = todo[short], 4 * wanted
        at, row = (np.concatenate(part) for part in zip(*pairs, strict=True))
        return at, row


def _prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a usable vector; ``kind`` is the match value and the length, so only like meets like."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    match = F.coalesce("match", F.lit("")) if "match" in df.columns else F.lit("")
    kind = F.concat_ws(":", F.size("embedding").cast("string"), match)
    return df.filter(usable & (F.size("embedding") > 0)).select(*columns, "embedding", kind.alias("kind"))


def score_vectors(vectors: DataFrame, queries: DataFrame, k: int, per_repo: bool = False) -> DataFrame:
    """Candidates: at least the k best chunks per query (and repository, if ``per_repo``), by cosine.

    A task keeps its k best over all of its batches, so at most k rows per query leave it. A query set
    that is small by its counted size is sent to all tasks. A larger one is paired with balanced hash
    buckets of the vectors by a shuffle. When both sides have a ``match`` column, only rows with equal
    values are compared. With ``per_repo`` the vectors are dealt by repository and a hash of the chunk, so
    that a task sees few repositories. Vectors that are null, empty or hold null values take no part.
    """
    if "match" not in queries.columns:
        vectors = vectors.drop("match")
    if "current_file" not in queries.columns:
        queries = queries.withColumn("current_file", F.lit(None).cast("string"))
    vectors = _prepared(vectors, ["repo", "chunk_id", "file_path"])
    queries = _prepared(queries, ["query_id", "current_file"])
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] == 0:
        return vectors.sparkSession.createDataFrame([], HITS)
    width = 8 * size["d"]
    if size["n"] * width > SMALL_QUERY_BYTES:
        buckets, blocks = -(-vectors.count() * width // BUCKET_BYTES), -(-size["n"] * width // BLOCK_BYTES)
        while buckets * blocks < 3 * vectors.sparkSession.sparkContext.defaultParallelism:  # pairs for all cores
            buckets, blocks = (buckets, 2 * blocks) if blocks < buckets else (2 * max(1, buckets), blocks)
        return score_by_bucket(vectors, queries, k, buckets, blocks, per_repo)
    held = queries.orderBy("query_id").toPandas()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = TopHits(held, k, per_repo)
        for pdf in batches:
            if len(pdf):
                top.add(pdf)
        yield top.cut()

    if per_repo:
        vectors = vectors.repartition(F.col("repo"), F.pmod(F.xxhash64("chunk_id"), F.lit(REPO_SPREAD)))
    return vectors.mapInPandas(scan, HITS)


REPO_SPREAD = 16  # tasks that may share a repository


def score_by_bucket(
    vectors: DataFrame, queries: DataFrame, k: int, buckets: int, blocks: int, per_repo: bool = False
) -> DataFrame:
    """Pair every block of queries with every bucket of vectors; both are cut by hash, so all are even.

    With ``per_repo`` a bucket holds whole repositories, or a part of one that would fill half a bucket or more, so
    that about k rows per query and repository leave the tasks.
    """

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        top = TopHits(right, k, per_repo)
        if len(left) and len(right):
            top.add(left)
        return top.cut()

    buckets, blocks = max(1, buckets), max(1, blocks)

    def spread(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))

    # columns of their own: the queries may be rows of the vectors
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    drawn = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))
    every = vectors.sparkSession.range(1).select(spread(F.lit(buckets)).alias("_bucket"), F.lit("").alias("_own"))
    left = vectors.withColumns({"_own": F.lit(""), "_bucket": drawn})
    if per_repo and buckets > 1:
        n = vectors.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
        most = n.agg(F.sum("_n")).first()[0] / buckets
        large = cut_lineage(  # at most two a bucket
            n.filter(F.col("_n") >= most / 2).select(F.col("repo").alias("_repo"), F.ceil(F.col("_n") / most).alias("_parts"))
        )
        name = F.concat(F.lit("r"), F.coalesce("_repo", F.lit("")), F.when(F.col("_repo").isNull(), "/").otherwise(""))
        split = F.col("_parts").isNotNull()
        left = vectors.join(F.broadcast(large), F.col("repo").eqNullSafe(F.col("_repo")), "left")
        part = F.when(split, F.pmod(F.xxhash64("chunk_id"), F.col("_parts"))).otherwise(F.pmod(F.xxhash64("repo"), F.lit(buckets)))
        left = left.withColumns({"_own": F.when(split, name).otherwise(""), "_bucket": part}).drop("_repo", "_parts")
        every = every.unionByName(large.select(name.alias("_own"), spread(F.col("_parts")).alias("_bucket")))
    left = left.withColumn("_block", spread(F.lit(blocks)))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).crossJoin(F.broadcast(every))
    keys = ["_own", "_bucket", "_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: pair(a, b), HITS)


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("chunk_id"), F.col("repo").asc_nulls_last()]


def search_each_repo(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The k best chunks of every repository for every query."""
    return top_per_group(score_vectors(vectors, queries, k, per_repo=True), ["query_id", "repo"], best_first(), k)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    repos: list[str] | None = None,
    file_types: list[str] | None = None,
    types_before_limit: bool = True,
) -> DataFrame:
    """The k best chunks per query over all (or the named) repositories.

    ``types_before_limit=False`` filters file types after the limit, which may leave fewer than k hits.
    """
    if repos:
        vectors = vectors.filter(F.col("repo").isin(repos))
    wanted = last_dot_part(F.col("file_path")).isin(file_types) if file_types else None
    if wanted is not None and types_before_limit:
        vectors = vectors.filter(wanted)
    hits = top_per_group(score_vectors(vectors, queries, k), ["query_id"], best_first(), k)
    if wanted is not None and not types_before_limit:
        hits = hits.filter(wanted)
    return hits


# File types searched for a language.
TYPES_OF_LANGUAGE = {
    "typescript": ["ts", "tsx"], "javascript": ["js", "jsx"], "python": ["py"], "rust": ["rs"],
    "go": ["go"], "java": ["java"],
}


def similar_patterns(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Similar code elsewhere: same language, never the queried file itself, k per query.

    ``queries`` carries query_id, embedding, current_file and language. The queried file is left out while
    scoring, so k hits come back whenever there are k. All languages are searched in one pass.
    """
    language_of_type = [(t, name) for name, types in TYPES_OF_LANGUAGE.items() for t in types]
    kind = last_dot_part(F.col("file_path"))
    language = F.create_map(*[F.lit(x) for pair in language_of_type for x in pair])
    typed = vectors.withColumn("match", F.coalesce(F.try_element_at(language, kind), kind))
    return search(typed, queries.withColumn("match", F.lower("language")), k)


def name_repo(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full repository name from the manifest (index, repo_full_name), else from the index name."""
    from corpuslens.operators.indexing import repo_of_index

    names = manifest.select(F.col("index").alias("repo"), "repo_full_name")
    return hits.join(names, "repo", "left").withColumn(
        "repo_full_name", F.coalesce("repo_full_name", repo_of_index(F.col("repo")))
    )


def with_snippet(hits: DataFrame, chunks: DataFrame, chars: int | None = SNIPPET_CHARS) -> DataFrame:
    """Attach the chunk text and its first ``chars`` characters (None: all of it).

    Chunks are known by repository and id; hits without a chunk keep a null text.
    """
    texts = chunks.select("repo", "chunk_id", F.col("text").alias("content"))
    snippet = F.col("content") if chars is None else F.substring("content", 1, chars)
    return join_null_safe(hits, texts, ["repo", "chunk_id"], "left").withColumn("snippet", snippet)


def preview(text: Column, max_lines: int | None = PREVIEW_LINES, max_chars: int | None = PREVIEW_CHARS) -> Column:
    """First lines of a hit: at most ``max_lines``, and no line that would pass ``max_chars`` in total.

    None lifts a limit.
    """
    most = 2**31 - 1
    n_lines, n_chars = max_lines if max_lines is not None else most, max_chars if max_chars is not None else most

    def fold(state, line):
        stop = state["stop"] | (state["chars"] + F.length(line) > n_chars)
        return F.struct(
            F.when(stop, state["n"]).otherwise(state["n"] + 1).alias("n"),
            F.when(stop, state["chars"]).otherwise(state["chars"] + F.length(line)).alias("chars"),
            stop.alias("stop"),
        )

    def shown(lines):
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("stop"))
        kept = F.aggregate(lines, start, fold, lambda s: s["n"])
        return F.array_join(F.slice(lines, F.lit(1), kept), "\n")

    return let(F.slice(F.split(text, "\n"), 1, n_lines), shown)


def hits_by_repo(hits: DataFrame) -> DataFrame:
    """Hits and best score per query and repository."""
    return hits.groupBy("query_id", "repo").agg(
        F.count(F.lit(1)).alias("total"), F.max("score").alias("best_score")
    )


def _object(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


# The names under which search services return the same thing.
REPO_NAMES = ["repo", "repo_full_name", "repository", "owner"]
SCORE_NAMES = ["score", "similarity", "rank", "score_percent"]
CONTENT_NAMES = ["content", "text", "snippet", "summary", "body"]
SNIPPET_NAMES = ["snippet", "summary", "text", "content"]
TOTAL_NAMES = ["total", "total_count", "totalHits", "count"]
DURATION_NAMES = ["duration_ms", "duration", "durationMs", "took"]  # letter case of a name does not matter
LIST_NAMES = ["results", "hits", "items"]
HIGHLIGHT_NAMES = ["highlights", "matches", "fragments"]

HIT = T.StructType(
    [
        *_object(
            *REPO_NAMES, *SCORE_NAMES, *CONTENT_NAMES, "file_path", "path", "location", "filename", "name",
            "line_start", "start_line", "startLine", "line_end", "end_line", "endLine",
        ).fields,
        *[T.StructField(n, T.ArrayType(T.StringType())) for n in HIGHLIGHT_NAMES],
        T.StructField("file", _object("path")),
        T.StructField("start", _object("line")),
        T.StructField("end", _object("line")),
        T.StructField("range", _object("start", "end")),
    ]
)
LISTS = [T.StructField(n, T.ArrayType(HIT)) for n in LIST_NAMES]
RESPONSE = T.StructType(
    [
        *LISTS,
        *_object("repo", "repo_full_name", *TOTAL_NAMES, *DURATION_NAMES).fields,
        T.StructField("data", T.StructType([*LISTS, *_object("total", "total_count", "duration_ms").fields])),
        T.StructField("meta", _object("duration_ms")),
    ]
)


def _number(text: Column) -> Column:
    """A finite number, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalize_hits(responses: DataFrame, json: str) -> DataFrame:
    """One row per hit of any known response shape, with common names.

    The first non-empty result list is used; alias groups take the first present name.
    """
    r = F.col("_r")
    lists = [r[n] for n in LIST_NAMES] + [r["data"][n] for n in LIST_NAMES]
    hits = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    fallback = F.coalesce(r["repo"], r["repo_full_name"])
    total = F.coalesce(
        *[_number(r[n]) for n in TOTAL_NAMES],
        *[_number(r["data"][n]) for n in ("total", "total_count")],
        F.size("_hits").cast("double"),
    )
    duration = F.coalesce(
        *[_number(r[n]) for n in DURATION_NAMES], _number(r["meta"]["duration_ms"]), _number(r["data"]["duration_ms"])
    )
    keep = [c for c in responses.columns if c != json]
    opened = (
        responses.withColumn("_r", F.from_json(json, RESPONSE))
        .withColumn("_hits", hits)
        .select(
            *keep, fallback.alias("_repo"), total.alias("total"), duration.alias("duration_ms"),
            F.posexplode("_hits").alias("ordinal", "_h"),
        )
    )
    h = F.col("_h")
    return opened.select(
        *keep,
        "ordinal",
        F.coalesce(*[h[n] for n in REPO_NAMES], F.col("_repo")).alias("repo"),
        F.coalesce(h["file_path"], h["path"], h["file"]["path"], h["location"], h["filename"]).alias("file_path"),
        _number(
            F.coalesce(h["line_start"], h["start_line"], h["startLine"], h["start"]["line"], h["range"]["start"])
        ).cast("long").alias("line_start"),
        _number(
            F.coalesce(h["line_end"], h["end_line"], h["endLine"], h["end"]["line"], h["range"]["end"])
        ).cast("long").alias("line_end"),
        F.coalesce(*[_number(h[n]) for n in SCORE_NAMES], F.lit(0.0)).alias("score"),
        F.coalesce(*[h[n] for n in CONTENT_NAMES], F.lit("")).alias("content"),
        F.coalesce(*[h[n] for n in SNIPPET_NAMES], F.lit("")).alias("snippet"),
        F.coalesce(*[h[n] for n in HIGHLIGHT_NAMES]).alias("highlights"),
        F.coalesce(h["repo_full_name"], *[h[n] for n in REPO_NAMES], F.col("_repo")).alias("repo_full_name"),
        F.coalesce(h["filename"], h["name"]).alias("filename"),
        _number(h["similarity"]).alias("similarity"),
        "_h.summary",
        "total",
        "duration_ms",
    )


def build_context(hits: DataFrame) -> DataFrame:
    """Context items: repo, file_path, snippet, score and a range when both ends are known."""
    both = F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    blank = F.lit("")
    rest = [c for c in hits.columns if c not in {"highlights", "repo_full_name", "filename", "similarity", "summary", "repo", "file_path", "snippet", "content", "score", "line_start", "line_end"}]
    return hits.select(
        *rest,
        F.coalesce("repo", blank).alias("repo"),
        F.coalesce("file_path", blank).alias("file_path"),
        F.coalesce("snippet", "content", blank).alias("snippet"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(both, F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end"))).alias("range"),
    )


def search_key(query: Column, repos: Column, types: Column, max_results: Column) -> Column:
    """Cache key: equal for queries that differ only in case, outer blanks or list order."""
    empty = F.array().cast("array<string>")
    data = F.struct(
        F.lower(F.trim(query)).alias("query"),
        F.array_sort(F.coalesce(repos, empty)).alias("repos"),
        F.array_sort(F.coalesce(types, empty)).alias("file_types"),
        F.coalesce(F.nullif(max_results, F.lit(0)), F.lit(DEFAULT_K)).alias("max_results"),
    )
    return F.sha2(F.to_json(data), 256)


def default_repo(repos: Column, default: str) -> Column:
    """The default repository when none is named or the first name is blank."""
    none = repos.isNull() | (F.size(repos) == 0)
    blank = F.trim(F.coalesce(F.try_element_at(repos, F.lit(1)), F.lit(""))) == ""
    return F.when(none | blank, F.array(F.lit(default))).otherwise(repos)


def validate_queries(requests: DataFrame, json: str) -> DataFrame:
    """Split search requests: the query is a string or an object with ``description``, not blank."""
    doc = F.try_parse_json(F.col(json))
    direct = F.try_variant_get(doc, "$.query", "variant")
    kind = F.schema_of_variant(direct)
    text = F.when(kind == "STRING", F.try_variant_get(doc, "$.query", "string")).otherwise(
        F.try_variant_get(doc, "$.query.description", "string")
    )
    query = F.trim(text)
    return requests.withColumn("query", query).withColumn(
        "valid", F.coalesce(F.col("query") != "", F.lit(False))
    )


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/\s]+"), F.lit(False))


# Forms of a definition, of a call and of a function definition; the name is the group.
DEFINITION = r"\b(?:function|class|interface|type|enum|const|let|var)\s+(\w+)"
CALL = r"\b(\w+)\s*\("
FUNCTION_DEFINITION = r"\bfunction\s+(\w+)\s*\("


def count_names(chunks: DataFrame, names: DataFrame, counted: str, group: int, not_counted: str | None) -> DataFrame:
    """(name, repo, chunk_id, n): matches of one pattern less those of another, for the names asked for.

    Chunks are cut into identifiers once, each chunk counts its own, and the distinct ones are matched by
    equality. The work is linear in the text, and words that nobody asks for do not move.
    """
    taken, dropped = finder(counted, group), finder(not_counted) if not_counted else None

    def count(text: str) -> tuple[int, dict[str, int]]:
        found = Counter(taken(text))
        size = found.total()
        if dropped:
            found.subtract(dropped(text))
        return size, found

    wanted = names.select("name").filter("name is not null").distinct()
    found = counted_words(chunks.select("repo", "chunk_id", "text"), count, wanted).withColumnRenamed("word", "name")
    return found.join(checked_broadcast(wanted), "name").select("name", "repo", "chunk_id", "n").filter("n > 0")


# What ``\b`` before a word means where text is not ASCII: no letter, digit or mark of one stands before it.
WORD_START = r"(?<![\p{L}\p{Nd}_])(?<![\p{L}\p{Nd}]\p{Mn}+)"


def finder(pattern: str, group: int = 1) -> Callable[[str], list[str]]:
    """All matches of a group of a pattern whose words are ASCII ones; ``\\b`` may stand before a word only."""
    ascii_form = re.compile(pattern if group else f"({pattern})", re.ASCII)
    if r"\b" not in pattern:
        return ascii_form.findall
    form = pattern.replace(r"\b", WORD_START).replace(r"\w", "[A-Za-z0-9_]").replace(r"\s", r"[ \t\n\x0b\f\r]")
    any_form = regex.compile(form)
    return lambda text: ascii_form.findall(text) if text.isascii() else any_form.findall(text)


MARK_BITS = 16  # for each word asked for
MOST_MARKS = 1 << 26  # bits: 8 MB
TEXTS_AT_ONCE = 256


def marks(words: DataFrame) -> bytes:
    """A bit set for the checksum of every word of the only column, at most ``MOST_MARKS`` bits however many there are."""
    (name,) = words.columns
    bits = min(MOST_MARKS, max(1 << 12, 1 << (words.count() * MARK_BITS).bit_length()))
    at = words.select((F.crc32(F.col(name).cast("binary")) % bits).alias("at"))
    cells = at.groupBy(F.expr("shiftright(at, 6)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("held"))
    found = cells.toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found["cell"].to_numpy()] = found["held"].to_numpy()
    return out.tobytes()


def counted_words(chunks: DataFrame, count: Callable[[str], tuple[int, dict[str, int]]], wanted: DataFrame) -> DataFrame:
    """(repo, chunk_id, len, word, n, first): the counts that ``count`` gives for a text, and all that it has.

    ``chunks`` are (repo, chunk_id, text). Only words whose mark is set by one of ``wanted`` leave the task; a few of
    them are others, so a join has to follow. The rows of a text are one after the other, ``first`` at its first. A row
    without chunk and word has in ``n`` a number of chunks.
    """
    held = marks(wanted)
    last = 8 * len(held) - 1
    kinds = dict(chunks.dtypes)
    schema = f"repo {kinds['repo']}, chunk_id {kinds['chunk_id']}, len int, word string, n long, first boolean"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                at, sizes, words, numbers = [None], [None], [None], [part.num_rows]
                for i, text in enumerate(part.column("text").to_pylist()):
                    size, found = count(text or "")
                    for word, n in found.items():
                        mark = crc32(word.encode()) & last
                        if held[mark >> 3] >> (mark & 7) & 1:
                            at.append(i)
                            sizes.append(size)
                            words.append(word)
                            numbers.append(n)
                rows = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("repo").take(rows), part.column("chunk_id").take(rows), pa.array(sizes, pa.int32()),
                        pa.array(words, pa.string()), pa.array(numbers, pa.int64()),
                        pa.array([a is not None and a != b for a, b in zip(at, [None, *at], strict=False)], pa.bool_()),
                    ],
                    names=["repo", "chunk_id", "len", "word", "n", "first"],
                )

    return chunks.select("repo", "chunk_id", "text").mapInArrow(walk, schema)


def tally(items: Column) -> Column:
    """The distinct elements of an array with how often each occurs: one sort, then one pass over its runs."""

    def runs(found):
        starts = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: (i == 1) | (F.get(found, i - 1) != F.get(found, i - 2)))
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(found, i - 1).alias("word"),
                    (F.coalesce(F.get(at, k + 1), F.size(found) + 1) - i).alias("n"),
                ),
            ),
        )

    none = F.array().cast("array<struct<word:string,n:int>>")
    return F.when(F.size(items) > 0, let(F.sort_array(items), runs)).otherwise(none)


BROADCAST_ROWS = 200_000  # distinct words that may travel to every task


def checked_broadcast(words: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows, marked for broadcast only if they are counted to be few; the result is the same."""
    return F.broadcast(words) if words.limit(most + 1).count() <= most else words


def find_usages(chunks: DataFrame, names: DataFrame, k: int = DEFAULT_K, definitions: bool = False) -> DataFrame:
    """Chunks that use a name most, definitions not counted unless asked for."""
    used = count_names(chunks, names, r"\w+", 0, None if definitions else DEFINITION)
    return top_per_group(used, ["name"], [F.col("n").desc(), F.col("chunk_id"), F.col("repo").asc_nulls_last()], k)


def find_callers(chunks: DataFrame, names: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Chunks that call a function most (``name(``), its own definition not counted."""
    called = count_names(chunks, names, CALL, 1, FUNCTION_DEFINITION)
    return top_per_group(called, ["name"], [F.col("n").desc(), F.col("chunk_id"), F.col("repo").asc_nulls_last()], k)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


ASCII_WORDS, ANY_WORDS = re.compile(r"\w+", re.ASCII), regex.compile(r"[\p{L}\p{N}_]+")


def count_text_words(text: str) -> tuple[int, dict[str, int]]:
    """How many words a lower-case text has, and how often each of them."""
    found = (ASCII_WORDS if text.isascii() else ANY_WORDS).findall(text)
    return len(found), Counter(found)


WEIGHT_CELLS = 4_000_000  # queries times distinct words whose weights may travel to every task: 32 MB
LEXICAL_HITS = "query_id {}, repo string, chunk_id {}, score double"


class TopTexts:
    """The k best chunks seen so far of every query, by word weights, over all batches of a task."""

    def __init__(self, weights: np.ndarray, k: int):
        self.weights, self.k = weights, k
        self.least = np.zeros(len(weights))  # a score that the k-th best of a query reaches already
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[tuple] = []
        self.held = 0

    def add(self, names: list[tuple], chunk: np.ndarray, word: np.ndarray, value: np.ndarray) -> None:
        """Chunks ``names`` with the values of their words: row ``i`` is word ``word[i]`` of chunk ``chunk[i]``."""
        cells = np.zeros((len(names), self.weights.shape[1]))
        cells[chunk, word] = value
        scores = np.round(self.weights @ cells.T, SCORE_DIGITS)
        query, at = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        used, place = np.unique(at, return_inverse=True)
        self.found.append((query, place + len(self.names), scores[query, at]))
        self.names += [names[i] for i in used]
        self.held += len(query)
        if self.held > 8 * self.k * len(self.weights):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the k best of each query, ties to the lower chunk id and repository, and forgets other chunks."""
        query, at, score = (np.concatenate(part) for part in zip(*self.found, strict=True))
        order = sorted(range(len(self.names)), key=lambda i: (self.names[i][1], self.names[i][0] is None, self.names[i][0] or ""))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[at], -score, query))
        query, at, score = query[by], at[by], score[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = rank == self.k - 1
        self.least[query[full]] = score[full]
        kept = rank < self.k
        used, at = np.unique(at[kept], return_inverse=True)
        self.names = [self.names[i] for i in used]
        self.found = [(query[kept], at, score[kept])]
        self.held = int(kept.sum())
        return self.found[0]


def best_texts(tf: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """At most k rows a query and task from ``tf`` (repo, chunk_id, len, word, tf, first), whose chunks lie in one piece.

    Words without a weight may be among them; the names of a chunk are read at its first row.

    The weights are collected: the caller has counted them to be at most ``WEIGHT_CELLS``.
    """
    asked = weights.toPandas()
    queries, of_query = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    words, of_word = np.unique(asked["word"].to_numpy(str), return_inverse=True)
    matrix = np.zeros((len(queries), len(words)))
    matrix[of_query, of_word] = asked["w"]
    number = {w: i for i, w in enumerate(words.tolist())}
    kinds = dict(tf.dtypes) | dict(weights.dtypes)
    cells = BATCH_CELLS // max(1, len(words))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = TopTexts(matrix, k)
        held: pd.DataFrame | None = None
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            first = np.flatnonzero(rows["first"].to_numpy())
            if len(first) > 1:
                score_rows(top, rows[: first[-1]])
            held = rows[first[-1] :].reset_index(drop=True) if len(first) else rows
        if held is not None and len(held):
            score_rows(top, held)
        if top.found:
            query, at, score = top.cut()
            yield pd.DataFrame(
                {"query_id": queries[query], "repo": [top.names[i][0] for i in at], "chunk_id": [top.names[i][1] for i in at], "score": score}
            )

    def score_rows(top: TopTexts, rows: pd.DataFrame) -> None:
        chunk = np.cumsum(rows["first"].to_numpy()) - 1
        word = rows["word"].map(number).fillna(-1).to_numpy(np.int64)
        value = rows["tf"].to_numpy() / np.sqrt(rows["len"].to_numpy())
        known = word >= 0
        heads = rows[rows["first"].to_numpy()]
        repos = [r if isinstance(r, str) else None for r in heads["repo"]]
        names = list(zip(repos, heads["chunk_id"].tolist(), strict=True))
        chunk, word, value = chunk[known], word[known], value[known]
        for start in range(0, len(names), max(1, cells)):
            end = min(len(names), start + max(1, cells))
            here = slice(*np.searchsorted(chunk, [start, end]))
            top.add(names[start:end], chunk[here] - start, word[here], value[here])

    return tf.mapInPandas(walk, LEXICAL_HITS.format(kinds["query_id"], kinds["chunk_id"]))


BATCH_CELLS = 4_000_000  # chunks times words scored at once


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, cells: int = WEIGHT_CELLS) -> DataFrame:
    """Text search when no vectors are at hand: tf-idf over whole lower-case words, by chunk length.

    Chunks are known by repository and id, of any type. Every chunk counts its own words and sends one row
    per distinct word that is asked for. Scores are rounded, ties go to the lower chunk id, then repository.

    As long as queries times asked words are at most ``cells``, the weights go to the chunks: each task scores
    its own and hands on k a query, so nothing grows with queries times chunks. Beyond that the words are
    joined, with the same result.
    """
    one = F.lit(1)
    asked = (
        queries.select("query_id", F.explode_outer(_words(F.col("query"))).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("query_id", "word")
        .agg(F.count(one).alias("qf"))
    )
    wanted = asked.select("word").distinct()
    lower = chunks.select("repo", "chunk_id", F.lower("text").alias("text"))
    # read three times: for the number of chunks, the chunk frequencies and the scores
    counted = cut_lineage(counted_words(lower, count_text_words, wanted))
    tf = counted.withColumnRenamed("n", "tf").join(checked_broadcast(wanted), "word").select("repo", "chunk_id", "len", "word", "tf")
    idf = tf.groupBy("word").agg(F.count(one).alias("df")).withColumn("_one", one)
    total = counted.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks")).withColumn("_one", one)
    weights = asked.join(idf, "word").join(F.broadcast(total), "_one")  # a single row
    idf2 = F.pow(F.log(1 + F.col("n_chunks") / F.col("df")), 2)
    weights = weights.select("query_id", "word", (F.col("qf") * idf2).alias("w")).filter("query_id is not null")
    size = asked.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("word").alias("w")).first()
    if size["q"] * size["w"] <= cells:
        heads = counted.filter("first").groupBy("repo", "chunk_id").agg(F.count(one).alias("n")).filter("n > 1")
        if heads.isEmpty():  # each chunk lies in one piece already
            kinds = dict(counted.dtypes)  # numbers stay, since with nulls they would be read as floats
            named = [F.when(F.col("first"), F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in ("repo", "chunk_id")]
            pieces = counted.filter("word is not null").select(*named, "len", "word", F.col("n").alias("tf"), "first")
        else:
            pieces = _in_pieces(tf)
        scored = best_texts(pieces, weights, k)
    else:
        scored = (
            tf.join(weights, "word")
            .groupBy("query_id", "repo", "chunk_id")
            .agg(F.round(F.sum(F.col("w") * F.col("tf") / F.sqrt("len")), SCORE_DIGITS).alias("score"))
        )
    return top_per_group(scored, ["query_id"], best_first(), k)


def _in_pieces(tf: DataFrame) -> DataFrame:
    """The rows of each chunk one after the other, ``first`` at its first."""
    own = Window.partitionBy("repo", "chunk_id").orderBy("word")
    return tf.withColumn("first", F.row_number().over(own) == 1)


def fuzzy_score(target: Column, query: str) -> Column:
    """1000 exact, 900 prefix, 800 minus position for a substring; else 10 per consecutive and 1 per other
    matched character; null when the characters do not occur in order."""
    q = query.lower()
    t = F.lower(target)
    at = F.locate(q, t)
    wanted = F.lit(q)

    def fold(state, char):
        hit = char == F.substring(wanted, state["q"] + 1, F.lit(1))
        hit = hit & (state["q"] < len(q))
        return F.struct(
            (state["i"] + 1).alias("i"),
            F.when(hit, state["q"] + 1).otherwise(state["q"]).alias("q"),
            F.when(hit, state["i"]).otherwise(state["last"]).alias("last"),
            F.when(hit & (state["last"] == state["i"] - 1), state["score"] + 10)
            .when(hit, state["score"] + 1)
            .otherwise(state["score"])
            .alias("score"),
        )

    zero = F.lit(0)
    start = F.struct(zero.alias("i"), zero.alias("q"), F.lit(-1).alias("last"), zero.alias("score"))
    in_order = F.aggregate(
        F.split(t, ""), start, fold, lambda s: F.when(s["q"] == len(q), s["score"])
    )
    return (
        F.when(t == q, 1000).when(t.startswith(q), 900).when(at > 0, F.lit(800) - (at - 1)).otherwise(in_order)
    )


def fuzzy_files(files: DataFrame, query: str, path: str = "path") -> DataFrame:
    """Files whose path matches the typed characters, best first."""
    return (
        files.withColumn("score", fuzzy_score(F.col(path), query))
        .filter(F.col("score").isNotNull())
        .orderBy(F.col("score").desc(), path)
    )


def pattern_files(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Files whose path contains the text or matches it as a pattern."""
    return files.filter(F.col(path).contains(pattern) | F.col(path).rlike(pattern))


def related_files(
    files: DataFrame, k: int = 5, directory: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Up to k other files of a folder whose name fits a pattern, for every file.

    By default the folder is the file's own and the pattern ``*<extension>``: any name that holds the
    extension's text after any one character, so ``*.ts`` also takes ``x.tsx``. ``directory`` names one
    folder for all files; in ``pattern`` a star stands for any characters, and everything else for itself.
    Each (folder, extension) keeps its first k + 1 names once; every file then reads those and skips itself.
    """
    from corpuslens.functions.paths import basename, dirname, extension

    path = F.col("path")
    folder = dirname(path) if directory is None else F.lit(directory.rstrip("/"))
    wanted = extension(path) if pattern is None else F.lit("")
    placed = files.select("repo", "path", folder.alias("folder"), wanted.alias("ext"))
    names = files.select("repo", dirname(path).alias("folder"), basename(path).alias("name"), F.col("path").alias("related"))
    kinds = placed.select("repo", "folder", "ext").distinct()
    if pattern is None:
        # the dot of the extension stands for any one character; the rest of it for itself
        fits = F.expr(r"ext = '' or name rlike concat('.\\Q', substring(ext, 2), '\\E')")
    else:
        literal = ".*".join(re.escape(part) for part in pattern.split("*"))
        fits = F.col("name").rlike(literal)
    candidates = join_null_safe(names, kinds, ["repo", "folder"]).filter(fits)
    first = top_per_group(candidates, ["repo", "folder", "ext"], [F.col("name")], k + 1).drop("name")
    pairs = join_null_safe(placed, first, ["repo", "folder", "ext"]).filter(F.col("related") != F.col("path"))
    return top_per_group(pairs.select("repo", "path", "related"), ["repo", "path"], [F.col("related")], k)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def truncate_text(text: Column, limit: int, marker: str = "\n// ... truncated ...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)
