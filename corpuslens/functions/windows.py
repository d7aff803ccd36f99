"""Position and top-k helpers that stay balanced when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import cut_lineage


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group.

    ``row_number`` with a literal bound is planned as a group limit before the shuffle, so each task
    sends at most ``n`` rows of a hot group.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order (deterministic, unlike ``dropDuplicates``)."""
    return top_per_group(df, keys, order, 1)


def same(left: str, right: str) -> Column:
    """Equality of two columns in which null equals null."""
    return F.col(left).eqNullSafe(F.col(right))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which a null key meets a null key; the keys of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & same(k, f"_right_{k}")
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])


def full_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left.join(right, keys, "full_outer")`` in which a null key meets a null key."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & same(k, f"_right_{k}")
    rest = [c for c in [*left.columns, *right.columns] if c not in keys]
    both = left.join(named, condition, "full_outer")
    return both.select(*[F.coalesce(k, f"_right_{k}").alias(k) for k in keys], *rest)


def position_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Exact 1-based position of every row in its group, in the total order of ``order``; null keys are groups.

    The rows are range-partitioned by keys and order and sorted inside the partitions, so a group of any
    size and any distribution of its values lies in evenly filled consecutive partitions. A row's position is
    its place in its partition's run of the group plus the sizes of the group's runs in earlier partitions:
    at most one run a group and partition. The sorted rows are written to the checkpoint folder, which fixes
    the partitions and makes this function eager.
    """
    by = [*[F.col(k).asc() for k in keys], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    fixed = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", 33)
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        fixed.groupBy(*keys, "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        join_null_safe(fixed, runs, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_part", "_first", "_before")
    )
