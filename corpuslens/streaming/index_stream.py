"""Keeping a chunk index up to date from a stream of file changes.

The index is append-only. Every batch writes one folder of chunks and one of manifest rows, named by the run
of the query and the batch, so neither a restart nor a new checkpoint overwrites what is there. A manifest row
carries the sequence number of its change, and the highest one of a path is valid: late, repeated and
redelivered changes lose nothing and change nothing. A batch reads the manifest of the repositories it
touches, not the rest.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import extension
from corpuslens.functions.windows import join_null_safe
from corpuslens.operators.chunks import chunk_files
from corpuslens.operators.ignore import DEFAULT_EXTENSIONS
from corpuslens.operators.indexing import build_manifest, with_content

CHANGE = "repo string, path string, op string, content string, seq long"
# ``text_seq``: the change that wrote the valid chunks; a change to equal content writes none.
MANIFEST = "path string, hash string, n_chunks int, chunk_ids array<string>, deleted boolean, seq long, text_seq long, run string, batch long, repo string"
CHUNKS = "file_path string, chunk_index int, chunk_id string, line_start int, line_end int, text string, seq long, run string, batch long, repo string"
OPS = ["add", "change", "unlink"]
PRUNED_REPOS = 1000  # up to so many repositories of a batch are named in the read of the manifest
VERSION = ["hash", "n_chunks", "chunk_ids", "deleted", "seq", "text_seq"]


def _read(spark: SparkSession, location: str, kind: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{location}/{kind}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_changes(changes: DataFrame, extensions: list[str] | None = DEFAULT_EXTENSIONS) -> DataFrame:
    """The last change of each path with its sequence number, for indexed file types only."""
    wanted = changes.filter(F.col("op").isin(OPS))
    if extensions is not None:
        wanted = wanted.filter(extension(F.col("path")).isin(extensions))
    last = F.max_by(F.struct("op", "content", "seq"), "seq").alias("_last")
    return wanted.groupBy("repo", "path").agg(last).select("repo", "path", "_last.*")


def _valid(rows: DataFrame) -> DataFrame:
    """The version with the highest sequence number of each path, marks of removal included."""
    newest = F.max_by(F.struct(*VERSION), F.struct("seq", "text_seq")).alias("_m")
    return rows.groupBy("repo", "path").agg(newest).select("repo", "path", "_m.*")


def current_manifest(spark: SparkSession, location: str) -> DataFrame:
    """Valid manifest rows of files that exist."""
    return _valid(_read(spark, location, "manifest", MANIFEST)).filter(~F.col("deleted")).drop("deleted")


def current_chunks(spark: SparkSession, location: str) -> DataFrame:
    """Chunks of the valid version of every path; a version that was written twice is read once."""
    valid = current_manifest(spark, location).select(
        "repo", F.col("path").alias("file_path"), F.col("text_seq").alias("seq")
    )
    rows = _read(spark, location, "chunks", CHUNKS).drop("run", "batch")
    own = join_null_safe(rows, valid, ["repo", "file_path", "seq"], "left_semi")
    return own.dropDuplicates(["repo", "file_path", "seq", "chunk_index"]).drop("seq")


def write_batch(
    changes: DataFrame, batch: int, location: str, extensions: list[str] | None = DEFAULT_EXTENSIONS, run: str = "direct"
) -> None:
    """Apply one batch of changes.

    A change that is older than the valid version of its path is dropped; equal content moves the sequence
    number on without new chunks; a removal leaves a mark, also for a path that is not known yet, so that an
    older change coming later does not bring the path back. The micro-batch is evaluated once.
    """
    spark = changes.sparkSession
    last = latest_changes(changes, extensions).persist()
    try:
        rows = _read(spark, location, "manifest", MANIFEST)
        repos = [r.repo for r in last.select("repo").distinct().limit(PRUNED_REPOS + 1).collect()]
        if len(repos) <= PRUNED_REPOS:
            named = F.col("repo").isin([r for r in repos if r is not None])
            rows = rows.filter(named | F.col("repo").isNull() if None in repos else named)
        known = _valid(rows).select("repo", "path", *[F.col(c).alias(f"_{c}") for c in VERSION])
        newer = join_null_safe(last, known, ["repo", "path"], "left").filter(F.col("_seq").isNull() | (F.col("seq") > F.col("_seq")))
        gone = newer.filter("op = 'unlink'").select(
            "repo", "path", F.lit(None).cast("string").alias("hash"), F.lit(0).alias("n_chunks"),
            F.array().cast("array<string>").alias("chunk_ids"), F.lit(True).alias("deleted"), "seq", F.col("seq").alias("text_seq"),
        )
        kept = with_content(newer.filter("op <> 'unlink'"))
        equal = F.coalesce(~F.col("_deleted") & (F.md5("content") == F.col("_hash")), F.lit(False))
        same = kept.filter(equal).select(
            "repo", "path", F.col("_hash").alias("hash"), F.col("_n_chunks").alias("n_chunks"),
            F.col("_chunk_ids").alias("chunk_ids"), F.lit(False).alias("deleted"), "seq", F.col("_text_seq").alias("text_seq"),
        )
        fresh = kept.filter(~equal).select("repo", "path", "content", "seq")
        seqs = fresh.select("repo", "path", "seq")
        made = join_null_safe(build_manifest(fresh), seqs, ["repo", "path"]).withColumn("deleted", F.lit(False)).withColumn("text_seq", F.col("seq"))
        chunks = join_null_safe(chunk_files(fresh), seqs.withColumnRenamed("path", "file_path"), ["repo", "file_path"])
        # chunks first: a manifest row never points at chunks that are not there
        for table, kind in ((chunks, "chunks"), (made.unionByName(gone).unionByName(same), "manifest")):
            table.write.mode("overwrite").partitionBy("repo").parquet(f"{location}/{kind}/run={run}/batch={batch}")
    finally:
        last.unpersist()


def ensure_index(files: DataFrame, location: str, extensions: list[str] | None = DEFAULT_EXTENSIONS) -> None:
    """Write the first full index, older than every change, unless there is one."""
    if _read(files.sparkSession, location, "manifest", MANIFEST).isEmpty():
        first = files.select("repo", "path", F.lit("add").alias("op"), "content", F.lit(-1).cast("long").alias("seq"))
        write_batch(first, 0, location, extensions, run="first")


def index_changes(
    changes: DataFrame, location: str, checkpoint: str, extensions: list[str] | None = DEFAULT_EXTENSIONS, **trigger
):
    """Start the streaming query that applies a stream of changes to the index at ``location``."""
    run = uuid.uuid4().hex
    writer = (
        changes.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, location, extensions, run))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def compact(spark: SparkSession, location: str, target: str) -> None:
    """Write the valid versions alone to a new location, to which readers and streams can then change."""
    valid = _valid(_read(spark, location, "manifest", MANIFEST))
    texts = valid.filter(~F.col("deleted")).select("repo", F.col("path").alias("file_path"), F.col("text_seq").alias("seq"))
    rows = _read(spark, location, "chunks", CHUNKS).drop("run", "batch")
    chunks = join_null_safe(rows, texts, ["repo", "file_path", "seq"], "left_semi")
    chunks = chunks.dropDuplicates(["repo", "file_path", "seq", "chunk_index"])
    for table, kind in ((chunks, "chunks"), (valid, "manifest")):
        table.write.partitionBy("repo").parquet(f"{target}/{kind}/run=compact/batch=0")


def changes_after(changes: DataFrame) -> DataFrame:
    """Batch twin of the stream: files (repo, path, content) that remain after all changes."""
    last = latest_changes(changes, None)
    return with_content(last.filter("op <> 'unlink'")).select("repo", "path", "content")
