"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import written
from corpuslens.session import cut_lineage


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (comp, ...) with the components that edges (ca, cb) join given one name, a node of theirs.

    Every component takes the smallest name next to it and then the name of that one, until nothing
    changes. Aggregations combine before the shuffle, and each join has a unique side, so that a component
    of any size is spread. Labels come back unchanged where there is no edge.
    """
    one_way = written(edges.select("ca", "cb").filter("ca <> cb").distinct(), "component-edges")
    if one_way.isEmpty():
        return labels
    both = one_way.select(F.col("ca").alias("u"), F.col("cb").alias("v")).union(one_way.select("cb", "ca"))
    roots = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root"))
    while True:
        roots = cut_lineage(roots.join(jump_of(roots), "root").select("u", F.col("next").alias("root")))
        near = (
            both.join(roots.select(F.col("u").alias("v"), F.col("root").alias("r")), "v")
            .groupBy("u")
            .agg(F.min("r").alias("r"))
        )
        lower = cut_lineage(roots.join(near, "u").select("u", F.least("root", "r").alias("root"), F.col("root").alias("old")))
        roots = lower.select("u", "root")
        if lower.filter("root <> old").isEmpty() and roots.join(jump_of(roots), "root").filter("next <> root").isEmpty():
            break
    moved = roots.select(F.col("u").alias("comp"), "root")
    others = [c for c in labels.columns if c != "comp"]
    return written(
        labels.join(moved, "comp", "left").select(*others, F.coalesce("root", "comp").alias("comp")), "component-labels"
    )


def jump_of(roots: DataFrame) -> DataFrame:
    """The name that each root itself has."""
    return roots.select(F.col("u").alias("root"), F.col("root").alias("next"))
