"""Chunk index and manifest: full build, difference to a new snapshot, incremental update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.let import open_array
from corpuslens.functions.windows import full_join_null_safe, join_null_safe, position_in_group
from corpuslens.operators.chunks import CHUNK_OVERLAP, CHUNK_SIZE, chunk_count, chunk_files, chunk_id

KEY = ["repo", "path"]


def index_name(repo: Column) -> Column:
    return F.translate(repo, "/", "_")


def repo_of_index(index: Column) -> Column:
    return F.translate(index, "_", "/")


def content_hash(content: Column) -> Column:
    return F.md5(content)


def encode_content(content: Column) -> Column:
    """Base64 on one line (the built-in breaks it every 76 characters)."""
    return F.translate(F.base64(content), "\r\n", "")


def valid_text(content: Column) -> Column:
    """Bytes as text; a sequence that is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def decode_content(content: Column, content_base64: Column) -> Column:
    """Plain content, or the decoded base64 payload when there is none; a payload that is not base64 is empty."""
    return F.coalesce(F.nullif(content, F.lit("")), valid_text(F.try_to_binary(content_base64, F.lit("base64"))), F.lit(""))


def with_content(files: DataFrame) -> DataFrame:
    """Files without content are never indexed."""
    return files.filter(F.col("content").isNotNull() & (F.col("content") != ""))


def build_manifest(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per indexed file: its hash and the ids of its chunks, computed within the row."""
    count = chunk_count(F.col("content"), size, overlap)
    ids = F.when(
        F.col("n_chunks") > 0,
        F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda k: chunk_id(F.col("path"), k)),
    ).otherwise(F.array().cast("array<string>"))
    return (
        with_content(files)
        .select(*KEY, content_hash(F.col("content")).alias("hash"), count.alias("n_chunks"))
        .withColumn("chunk_ids", ids)
    )


def index_report(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per repository: files offered (also those without content), files kept and chunks written."""
    offered = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files_indexed"))
    kept = manifest.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files_in_manifest"), F.sum("n_chunks").alias("chunks")
    )
    return join_null_safe(offered, kept, ["repo"], "left").fillna(0, ["files_in_manifest", "chunks"])


def index_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Compare the manifest with a whole new snapshot: added, changed, unchanged or deleted per path."""
    old = manifest.select(*KEY, F.col("hash").alias("old_hash"))
    new = with_content(files).select(*KEY, content_hash(F.col("content")).alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return full_join_null_safe(old, new, KEY).withColumn("change", change)


def update_index(
    chunks: DataFrame,
    manifest: DataFrame,
    files: DataFrame,
    deleted: DataFrame | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """Apply upserts (``files``) and removals (``deleted``: repo, path) to an index.

    Files whose hash is unchanged keep their chunks and are not chunked again. Every other path in the
    update loses all of its old chunks, because a shorter file has fewer of them. Returns the new
    (chunks, manifest).
    """
    offered = with_content(files).select(*KEY, "content", content_hash(F.col("content")).alias("_hash"))
    known = manifest.select(*KEY, F.col("hash").alias("_hash"))
    fresh = join_null_safe(offered, known, [*KEY, "_hash"], "left_anti")
    touched = fresh.select(*KEY)
    if deleted is not None:
        touched = touched.unionByName(deleted.select(*KEY))
    touched = touched.distinct()
    kept_manifest = join_null_safe(manifest, touched, KEY, "left_anti")
    paths = touched.withColumnRenamed("path", "file_path")
    kept_chunks = join_null_safe(chunks, paths, ["repo", "file_path"], "left_anti")
    return (
        kept_chunks.unionByName(chunk_files(fresh, size, overlap)),
        kept_manifest.unionByName(build_manifest(fresh, size, overlap)),
    )


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the manifest that a whole new snapshot no longer has."""
    return join_null_safe(manifest.select(*KEY), files.select(*KEY), KEY, "left_anti")


def update_report(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository: files processed, chunks added and chunks deleted by an update to the snapshot."""
    new = build_manifest(files).select(*KEY, F.col("hash").alias("new_hash"), F.col("n_chunks").alias("new_n"))
    old = manifest.select(*KEY, F.col("hash").alias("old_hash"), F.col("n_chunks").alias("old_n"))
    pairs = full_join_null_safe(old, new, KEY)
    same = F.coalesce(F.col("old_hash") == F.col("new_hash"), F.lit(False))
    zero = F.lit(0)
    return pairs.groupBy("repo").agg(
        F.count_if(~same & F.col("new_hash").isNotNull()).alias("files_processed"),
        F.sum(F.when(~same, F.coalesce("new_n", zero)).otherwise(zero)).alias("chunks_added"),
        F.sum(F.when(~same, F.coalesce("old_n", zero)).otherwise(zero)).alias("chunks_deleted"),
    )


def drop_repo(index: DataFrame, repos: list[str]) -> DataFrame:
    """Index or manifest without the repositories."""
    return index.filter(~F.col("repo").isin(repos))


def indexed_files(manifest: DataFrame, repos: DataFrame) -> DataFrame:
    """Paths indexed for the requested repositories."""
    return manifest.join(repos.select("repo").distinct(), "repo", "left_semi").select(*KEY)


def index_status(manifest: DataFrame, repos: DataFrame) -> DataFrame:
    """Which of the requested repositories have an index."""
    have = manifest.select("repo").distinct().withColumn("_has", F.lit(True))
    asked = repos.select("repo").distinct()
    return asked.join(have, "repo", "left").select("repo", F.coalesce("_has", F.lit(False)).alias("indexed"))


def batches(files: DataFrame, size: int) -> DataFrame:
    """Cut each repository into batches of ``size`` files, with the repository's total.

    Files are ordered by a hash bucket of the path, then the path, so no repository is numbered in one task.
    """
    order = [F.substring(F.md5(F.col("path")), 1, 3), F.col("path")]
    placed = position_in_group(files.select("repo", "path"), ["repo"], order, "position")
    totals = files.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    return join_null_safe(placed, totals, ["repo"]).select(
        "repo", "path", F.floor((F.col("position") - 1) / size).alias("batch"), "total"
    )


def files_as_diff(files: DataFrame) -> DataFrame:
    """A whole file as one hunk of context lines, for reviewing files without a diff."""
    from corpuslens.functions.paths import review_language_of

    lines = F.split(F.col("content"), "\n")
    keep = ["repo", "path", review_language_of(F.col("path")).alias("language"), F.size(lines).alias("n_lines")]
    rows = open_array(files, keep, lines, "_i", "content")
    return rows.select(
        "repo", "path", "language", "n_lines", F.lit("modified").alias("status"), F.lit("context").alias("line_type"),
        (F.col("_i") + 1).alias("old_no"), (F.col("_i") + 1).alias("new_no"), "content",
    )
