"""Whitening of embeddings by distributed block matrices.

The distinct vectors are the rows of one matrix, centred and dealt into blocks by a dense row index. The
transposed matrix times the matrix is the scatter, a table of dimensions x dimensions that the driver takes
apart by ``eigh``. The matrix of all rows times the whitening matrix gives the projected rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import written

SCALE = 256
BLOCK_ENTRIES = 1 << 18  # of a block of rows: 2 MB
LEAST_SHARE = 1e-12  # eigenvalues below this share of the greatest are zero to double precision


@dataclass
class Whitening:
    """What the fit found: components are the columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    identity_error: float

    @property
    def matrix(self) -> np.ndarray:
        """Columns scaled to unit variance; a column without variance is zero."""
        floor = LEAST_SHARE * max(float(self.eigenvalues[0]), 0.0)
        scale = [1 / np.sqrt(e) if e > floor else 0.0 for e in self.eigenvalues]
        return self.components * np.array(scale)


def integer_vectors(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """``rows`` with ``name``: floor(256 * entry) as longs. Unusable vectors take no part.

    Those are null or empty ones, ones with a null or non-finite entry, and ones of another length than most
    (the longer one of two equally frequent lengths).
    """
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    sound = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)
    made = sound.withColumn(name, F.transform(values, lambda c: F.floor(c * SCALE).cast("long")))
    lengths = made.groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.filter(F.size(name) == (lengths["d"] if lengths else 0))


def _indexed(rows: DataFrame, label: str) -> DataFrame:
    """The rows with ``_index`` 0, 1, 2 ... in the order of a written table, so that it never changes."""
    fixed = written(rows.withColumn("_at", F.monotonically_increasing_id()), label)
    fixed = fixed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    first = F.col("_at").bitwiseAND((1 << 33) - 1)
    return fixed.join(F.broadcast(starts), "_part").withColumn("_index", F.col("_start") + first).drop("_at", "_part", "_start")


def _centred(x: str, sums: list[int], n: int) -> Column:
    means = F.array(*[F.lit(s / n) for s in sums])
    return F.zip_with(F.col(x), means, lambda a, m: a.cast("double") - m)


def _blocks(rows: DataFrame, index: str, values: Column, n: int, d: int) -> BlockMatrix:
    vectors = rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector"))
    old = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(old, n, d).toBlockMatrix(max(1, BLOCK_ENTRIES // d), d)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix: one small block, summed over as many tasks as there are row blocks."""
    splits = max(1, -(-matrix.numRows() // matrix.rowsPerBlock))
    turned = matrix.transpose()
    # the Python method lacks the number of splits of the middle dimension, without which one task has all rows
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    found = BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


def _times(matrix: BlockMatrix, right: np.ndarray, spark) -> BlockMatrix:
    block = Matrices.dense(right.shape[0], right.shape[1], right.flatten(order="F").tolist())
    other = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), right.shape[0], right.shape[1])
    return matrix.multiply(other)


def fit(vectors: DataFrame, x: str, components: int) -> Whitening | None:
    """Whitening by the distinct vectors in column ``x``; None if there is none."""
    spark = vectors.sparkSession
    listed = _indexed(vectors.groupBy(x).agg(F.count(F.lit(1)).alias("_copies")).select(x), "whitening-fit")
    sums = listed.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    total = [int(r["s"]) for r in sums.orderBy("i").collect()]  # one number a dimension
    n, d = listed.count(), len(total)
    if n == 0:
        return None
    matrix = _blocks(listed, "_index", _centred(x, total, n), n, d)
    variance, vectors_of = np.linalg.eigh(_scatter(matrix) / n)
    order = np.argsort(-variance, kind="stable")[:components]
    trace = float(variance.sum())
    explained = [float(variance[k]) / trace if trace > 0 else None for k in order]
    found = Whitening(n, total, vectors_of[:, order], variance[order], explained, 0.0)
    used = found.matrix[:, found.matrix.any(axis=0)]
    if used.shape[1]:
        measured = _scatter(_times(matrix, used, spark)) / n
        found.identity_error = float(np.abs(measured - np.eye(used.shape[1])).max())
    return found


def project(rows: DataFrame, x: str, fitted: Whitening) -> DataFrame:
    """``rows`` with ``whitened``, an array of one value a component; null for a component without variance."""
    spark = rows.sparkSession
    listed = _indexed(rows, "whitening-rows")
    n, d = listed.count(), len(fitted.sums)
    matrix = _blocks(listed, "_index", _centred(x, fitted.sums, fitted.n), n, d)
    product = _times(matrix, fitted.matrix, spark).toIndexedRowMatrix()
    # the frame behind IndexedRowMatrix.rows, without a way through Python
    frame = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    flat = F.array(*[F.lit(bool(c.any())) for c in fitted.matrix.T])
    values = F.zip_with(vector_to_array("vector"), flat, lambda v, used: F.when(used, v))
    found = frame.select(F.col("index").alias("_index"), values.alias("whitened"))
    return listed.join(found, "_index").drop("_index")


def whiten(embeddings: DataFrame, vector: str, keep: list[str], components: int) -> DataFrame:
    """``keep``, n, deviation, whitened, explained and identity_error of every usable row.

    n: distinct vectors. deviation: the sum over the dimensions of (n * x - S) ** 2, S the sums over the distinct
    vectors, as an exact decimal. whitened and explained hold one value a component, as many as ``components``
    and the dimensions allow; both are null where the vectors do not vary. Rows with the same vector have the same values;
    an empty table, or one without usable vectors, gives no rows.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    kept = [F.col(c).alias(o) for c, o in zip(keep, names, strict=True)]
    back = [F.col(o).alias(c) for c, o in zip(keep, names, strict=True)]
    usable = integer_vectors(embeddings.select(*kept, F.col(vector).alias("_vector")), "_vector", "_x").drop("_vector")
    rows = written(usable, "whitening-input")
    fitted = fit(rows, "_x", components)
    if fitted is None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in OUTPUT]
        return rows.select(*back, *empty)
    done = project(rows, "_x", fitted)
    sums = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in fitted.sums])
    gaps = F.zip_with("_x", sums, lambda v, s: (v.cast("decimal(19,0)") * F.lit(fitted.n) - s).cast("decimal(19,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    deviation = F.aggregate(gaps, zero, lambda a, g: (a + (g * g).cast("decimal(38,0)")).cast("decimal(38,0)"))
    return done.select(
        *back,
        F.lit(fitted.n).cast("long").alias("n"),
        deviation.alias("deviation"),
        "whitened",
        F.array(*[F.lit(e).cast("double") for e in fitted.explained]).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


OUTPUT = [
    ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "array<double>"), ("explained", "array<double>"),
    ("identity_error", "double"),
]


def by_component(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each row and component, numbered from 1; deviation as a long."""
    pairs = F.arrays_zip("whitened", "explained")
    opened = rows.select(*keep, "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(pairs).alias("_k", "_p"))
    return opened.select(
        *keep, (F.col("_k") + 1).cast("int").alias("component"), "n", "deviation", F.col("_p.whitened").alias("whitened"),
        F.col("_p.explained").alias("explained"), "identity_error",
    )
