"""Whitening of embeddings on distributed block matrices.

Vectors become whole numbers, each distinct one a row of the fit list. The centred rows are indexed into a block matrix;
its transpose times itself is the scatter, which is as small as a vector is long squared, so its eigenvectors are found
on the driver. The block matrix times the whitening matrix gives the projected rows, and their own scatter checks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.plans.lineage import cut

SCALE, COMPONENTS = 256, 4
#: Rows of one block, and the share of all variance below which a component has none.
BLOCK_ROWS, LEAST_SHARE = 1024, 1e-12


def whole_entries(vector: Column, scale: int = SCALE) -> Column:
    """The entries times ``scale``, rounded down, as longs; null if the vector or an entry is null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * scale).cast("bigint") + 0))


def numbered(df: DataFrame) -> DataFrame:
    """``df``, computed once, with ``index``: gapless numbers from 0, by the rows that each partition has."""
    base = cut(df).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    parts = base.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select(F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return base.join(parts, F.col("__part") == F.col("__p")).withColumn("index", F.col("__at") - F.col("__first") + F.col("__start")).drop("__part", "__at", "__p", "__first", "__start")


def column_sums(df: DataFrame, col: str) -> list[int]:
    """The exact sums of each place of an array of longs; tasks send one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])

    sums = df.select(col).mapInArrow(run, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s"))
    return [r["s"] for r in sums.orderBy("i").collect()]


def block_matrix(rows: DataFrame, index: str, vector: str, width: int, block_rows: int) -> BlockMatrix:
    """Rows ``(index, vector)`` as blocks of ``block_rows`` whole rows; the rows stay in the JVM."""
    ready = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).cast("bigint").alias("index"), array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(ready).toBlockMatrix(block_rows, width)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The transpose of ``m`` times ``m``. The long dimension is split, so that blocks are multiplied where they are and summed."""
    parts = max(1, -(-m.numRows() // m.rowsPerBlock))
    mid = min(parts, m.blocks.getNumPartitions())
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, mid)
    return np.asarray(BlockMatrix(product, m.numCols(), m.numCols()).toLocalMatrix().toArray())


def times(m: BlockMatrix, right: np.ndarray) -> DataFrame:
    """``(index, vector)``: the rows of ``m`` times a small matrix, which goes to each row of blocks as one block."""
    d, k = right.shape
    sc = m.blocks.context
    one = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(d, k, right.T.ravel().tolist()))], 1), d, k, d, k)
    rows = callMLlibFunc("getIndexedRows", m.multiply(one).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("vector"))


@dataclass
class Whitening:
    """A fitted whitening: rows of the fit list, sums, eigenvalues (falling), unit eigenvectors as columns, all variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self) -> np.ndarray:
        """What centred rows are multiplied with."""
        return self.vectors / np.sqrt(self.values)


def fitted(m: BlockMatrix, n: int, sums: list[int], components: int) -> Whitening:
    """Eigenvectors of the covariance (divisor ``n``) of centred rows; those without variance are left out, signs are fixed."""
    v = scatter(m) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(v))
    k = int(np.count_nonzero(values[:components] > LEAST_SHARE * trace)) if trace > 0 else 0
    vectors = vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0) if k else vectors
    return Whitening(n, sums, values[:k], vectors, trace)


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` of every usable row and component.

    Rows whose vector is null, or holds null or non-finite entries, go; so do those of another length than the longest
    vector. Entries times ``scale``, rounded down, are the whole numbers that all is computed from. The fit list has each
    distinct vector once, ``n`` in all; equal vectors, repeated and null ids included, get equal results. ``deviation``
    is the exact sum of (n x - sums) squared, null where it exceeds a long. ``identity_error`` is the largest entry by
    which the covariance of ``whitened`` over the fit list departs from the identity. Components without variance (no
    two different vectors, dependent entries) have no rows; neither has an empty table. Other columns are not read.
    """
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    none = df.sparkSession.createDataFrame([], schema)
    rows = df.select(F.col(id_col).alias("id"), whole_entries(F.col(vec_col), scale).alias("x")).where("x is not null")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return none
    rows = rows.where(F.size("x") == width)
    fit = numbered(rows.select("x").distinct())
    n, sums = fit.count(), column_sums(fit, "x")
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = fit.select("index", F.zip_with("x", mean, lambda x, c: x.cast("double") - c).alias("vector"))
    m = block_matrix(centred, "index", "vector", width, block_rows)
    w = fitted(m, n, sums, components)
    k = len(w.values)
    if not k:
        return none
    projected = cut(times(m, w.matrix()))
    error = np.abs(scatter(block_matrix(projected, "index", "vector", k, block_rows)) / n - np.eye(k)).max()

    exact = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("bigint")), s))
    deviation = F.aggregate(exact, F.lit(0).cast("bigint"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    told = fit.select("index", F.col("x").alias("__x"), deviation.alias("deviation")).join(projected, "index")
    out = rows.join(told, F.col("x") == F.col("__x")).select("id", "deviation", F.posexplode("vector").alias("at", "whitened"))
    share = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
