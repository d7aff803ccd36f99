"""Words, lines and written tables shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space that separates words, and the run of other characters that is a word.
SPACES = "\t\n\x0b\x0c\r "
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(text: Column) -> Column:
    """The text; a null text is the empty one."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; ASCII text takes the built-in's fast path."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text in order; the empty array for a null, empty or blank text."""
    bare = F.btrim(whole_text(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; a null text has the key of the empty one."""
    return F.xxhash64(whole_text(text))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local master without the setting (tests, bench) gets a folder of its own, named in the session so
    that it is made once; on a cluster a missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpuslens-scratch-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, compressed, safe from lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def position_in_group(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str, weight: Column | None = None
) -> DataFrame:
    """``name``: how many rows of the group come before the row, in the order of bucket, then ``order``.

    Rows are counted per (keys, bucket) and ranked inside a bucket only, so that no task holds a whole hot
    group; rows that are equal in ``order`` get the same position. Keys are compared null-safe. With ``weight``
    a row counts as so many; the rows must then differ in ``order``.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_bucket")
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
        .select(
            *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)],
            F.col("_bucket").alias("_b"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = F.rank().over(inside)
    if weight is not None:
        earlier = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        local = F.coalesce(earlier, F.lit(0)) + 1
    same = F.col("_bucket") == F.col("_b")
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return (
        rows.withColumn("_local", local)
        .join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_local") - 1)
        .drop("_bucket", "_local", "_b", "_start", *own)
    )


def one_row(df: DataFrame) -> dict:
    """The single row of a global aggregate."""
    return df.first().asDict()
