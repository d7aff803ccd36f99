"""Reading a tree of source files, and the parquet layout of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import extension
from corpuslens.operators.ignore import DEFAULT_EXCLUDED_FOLDERS, DEFAULT_EXTENSIONS, MAX_FILE_BYTES
from corpuslens.operators.ignore import in_folder, is_ignored


def read_tree(
    spark: SparkSession,
    root: str,
    repo: str,
    extensions: list[str] = DEFAULT_EXTENSIONS,
    patterns: list[str] | None = None,
    folders: list[str] = DEFAULT_EXCLUDED_FOLDERS,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Files below ``root`` as (repo, path, content, size).

    Size, path and extension are tested on the file listing; the size filter reaches the source, so a
    large file is never opened. Bytes that are not UTF-8 become the replacement character.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .filter(F.col("length") <= max_bytes)
    )
    marker = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), marker, -1)
    listed = raw.select(path.alias("path"), F.col("length").alias("size"), "content")
    keep = extension(F.col("path")).isin(extensions) & ~in_folder(F.col("path"), folders)
    if patterns:
        keep &= ~is_ignored(F.col("path"), patterns)
    return listed.filter(keep).select(
        F.lit(repo).alias("repo"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "size"
    )


SMALL_INPUT_BYTES = 256 << 20
TINY_INPUT_BYTES = 128 << 10


def read_spread(spark: SparkSession, location: str) -> DataFrame:
    """Read parquet; a small input is spread over all cores.

    A small table often is one file with one row group, which a single task has to read and then carries
    through every narrow step (cutting, parsing). Only inputs below 256 MB are redistributed; larger ones
    have row groups enough and are read where they lie, without a shuffle.
    """
    df = spark.read.parquet(location)
    if TINY_INPUT_BYTES < stored_bytes(spark, location) < SMALL_INPUT_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


_STORED: dict[str, int] = {}


def stored_bytes(spark: SparkSession, location: str) -> int:
    """Size of the files below a location, from their listing; looked up once a session and place."""
    if location not in _STORED:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
        _STORED[location] = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _STORED[location]


def write_index(table: DataFrame, location: str) -> None:
    """Replace the partitions of the repositories in ``table``; others stay.

    Rows of one repository are written by as many tasks as hold them.
    """
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo")
        .parquet(location)
    )


def read_index(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location)
