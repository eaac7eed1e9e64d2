"""Low-rank tables of a long sparse matrix ``(id, term, weight)``: non-negative factors and truncated singular vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foldspan.operators.folds import hash_unit
from foldspan.operators.tfidf import list_bounds, numbered, vector_struct
from foldspan.plans.lineage import cut

#: Bytes of right singular vectors up to which tasks get them all; they have a row for each term.
MOST_BYTES = 256 << 20


#: Cells of a block of rows, about; a task holds one block and the factors of the terms in it.
BLOCK_CELLS = 1 << 20


def _gram(factors: DataFrame, k: int) -> np.ndarray:
    """The k x k products of the columns ``f0`` on, zeros included."""
    cells = [F.coalesce(F.sum(F.col(f"f{i}") * F.col(f"f{j}")), F.lit(0.0)) for i in range(k) for j in range(k)]
    return np.array(factors.agg(*cells).first(), float).reshape(k, k)


def _descended(f: np.ndarray, b: np.ndarray, gram: np.ndarray, inner: int) -> np.ndarray:
    """Non-negative ``f`` after ``inner`` rounds of coordinate descent on its normal equations."""
    f = f.copy()
    for _ in range(inner):
        for j in range(len(gram)):
            if gram[j, j] > 0:
                f[:, j] = np.maximum(0, f[:, j] + (b[:, j] - f @ gram[:, j]) / gram[j, j])
    return f


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in names]).astype(float)


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(block, at, id, k, x)`` of rows ``(id, k, x)``, with a number ``at`` a row, and ``(k, blocks)``: where a term is."""
    n = rows.agg(F.coalesce(F.sum(F.size("k")), F.lit(0))).first()[0]
    count = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_CELLS))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).repartition("block")
    blocks = cut(placed.select("block", F.monotonically_increasing_id().alias("at"), "id", "k", "x"))
    return blocks, blocks.select("block", F.explode("k").alias("k")).distinct().groupBy("k").agg(F.collect_list("block").alias("blocks"))


def _solver(gram: np.ndarray, inner: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What solves a block of rows from ``(side, key, f0, ...)``: its rows' factors and those of its terms."""
    k = len(gram)
    fs = [f"f{j}" for j in range(k)]

    def solve(cells: pa.Table, known: pa.Table) -> pa.Table:
        """New factors of the block's rows, and the products of its terms with them."""
        cells = cells.combine_chunks()
        block, mine = cells.column("block")[0].as_py(), known.filter(pc.field("side") == 0)
        theirs = known.filter(pc.field("side") == 1)
        terms, f = theirs.column("key").to_numpy(), _matrix(theirs, fs)
        order = np.argsort(terms)
        terms, f = terms[order], f[order]
        at = cells.column("at").to_numpy()
        own = _matrix(mine, fs)[np.argsort(mine.column("key").to_numpy())][np.argsort(np.argsort(at))]
        ks = cells.column("k").combine_chunks()
        row = np.repeat(np.arange(len(at)), np.diff(list_bounds(ks)))
        col = np.searchsorted(terms, ks.flatten().to_numpy(zero_copy_only=False))
        x = cells.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        b = np.column_stack([np.bincount(row, x * f[col, j], len(at)) for j in range(k)])
        own = _descended(own, b, gram, inner)
        part = np.column_stack([np.bincount(col, x * own[row, j], len(terms)) for j in range(k)])
        out = {"block": np.repeat(np.array([block, -1], np.int32), [len(at), len(terms)]), "key": np.concatenate([at, terms]).astype(np.int64)}
        return pa.table({**out, **{c: np.concatenate([own[:, j], part[:, j]]) for j, c in enumerate(fs)}})

    return solve


def factored_rows(rows: DataFrame, names: DataFrame, k: int, sweeps: int = 10, inner: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """``nonnegative_factors`` of rows ``(id, k, x)``, each id once and a column at most once in a row; ``names`` is ``(term, k)``.

    A block of rows gets the factors of its terms, solves its rows and gives its part of the terms' products, so that a
    sweep sends a term's numbers once a block and not once a cell.
    """
    blocks, where = _blocks(rows)
    fs, bs = [f"f{j}" for j in range(k)], [f"b{j}" for j in range(k)]
    start = lambda c: [(hash_unit(F.lit(f"nmf{seed}:{j}"), F.col(c)) + 0.1).alias(f) for j, f in enumerate(fs)]
    total = blocks.agg(F.coalesce(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.lit(0.0))).first()[0]
    left = blocks.select("block", "at", *start("id"))
    right = cut(names.join(where, "k").select("term", "k", "blocks", *start("term")))
    numbers = ", ".join(f"{f} double" for f in fs)
    residuals = []
    for _ in range(sweeps):
        gram = _gram(right, k)
        sent = right.select(F.explode("blocks").alias("block"), F.lit(1).alias("side"), F.col("k").cast("long").alias("key"), *fs)
        known = left.select("block", F.lit(0).alias("side"), F.col("at").alias("key"), *fs).unionByName(sent)
        parts = blocks.drop("id").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_solver(gram, inner), f"block int, key long, {numbers}")
        solved = cut(parts.groupBy("block", "key").agg(*[F.sum(f).alias(f) for f in fs]))
        left = solved.where("block >= 0").select("block", F.col("key").alias("at"), *fs)
        gram = _gram(left, k)

        def descend(batches: Iterator[pa.RecordBatch], gram=gram) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = _descended(_matrix(batch, fs), _matrix(batch, bs), gram, inner)
                kept = [batch.column(c) for c in ("term", "k", "blocks")]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(f[:, j]) for j in range(k)], *[batch.column(c) for c in bs]], names=["term", "k", "blocks", *fs, *bs])

        sums = solved.where("block < 0").select(F.col("key").cast("int").alias("__k"), *[F.col(f).alias(b) for f, b in zip(fs, bs, strict=True)])
        both = right.select("term", "k", "blocks", *fs).join(sums, F.col("k") == F.col("__k")).drop("__k")
        right = cut(both.mapInArrow(descend, both.schema))
        fits = right.agg(F.coalesce(F.sum(sum(F.col(f) * F.col(b) for f, b in zip(fs, bs, strict=True))), F.lit(0.0))).first()[0]
        residuals.append(float(total - 2 * fits + np.sum(gram * _gram(right, k))))
    factors = F.array(*fs).alias("f")
    return blocks.select("id", "at").join(left.drop("block"), "at").select("id", factors), right.select("term", factors), residuals


def nonnegative_factors(cells: DataFrame, k: int, sweeps: int = 10, inner: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """``(id, f)``, ``(term, f)`` and the squared residual of each sweep, where cells ``(id, term, weight)`` are about f f'.

    Both sides in turn are solved by alternating non-negative least squares; cells that are not there count as zeros,
    by the Gram matrix of the other side. Start values come from hashes, so that reruns agree. No side is ever gathered.
    """
    rows, vocab = _rows(cells)
    return factored_rows(rows, vocab, k, sweeps, inner, seed)


def _rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, k, x)``, an id a row, and ``(term, k)`` of cells ``(id, term, weight)``."""
    cells = cut(cells.select("id", "term", "weight"))
    vocab = cut(numbered(cells.select("term").distinct()))
    pair = F.array_sort(F.collect_list(F.struct("k", F.col("weight").cast("double").alias("x")))).alias("c")
    return cut(cells.join(vocab, "term").groupBy("id").agg(pair).select("id", F.col("c.k").alias("k"), F.col("c.x").alias("x"))), vocab


def main_factor(left: DataFrame, right: DataFrame, k: int, name: str = "topic") -> DataFrame:
    """``(id, name)``: the factor with the largest part of each row; factors are scaled by the sums of their terms."""
    scale = right.agg(*[F.coalesce(F.sum(F.col("f")[j]), F.lit(0.0)) for j in range(k)]).first()
    parts = F.array(*[F.col("f")[j] * float(s) for j, s in enumerate(scale)])
    return left.select("id", (F.array_position(parts, F.array_max(parts)) - 1).cast("int").alias(name))


def singular_rows(ids: DataFrame, cells: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """``(id, low)``: each row's products with the leading right singular vectors, and the singular values.

    The matrix has a column for each term, and a row of zeros for an id without cells; it is not centred. Vectors' signs
    are fixed by their largest entry. Fewer than ``dims`` values come back if the rank is lower.
    """
    return singular_products(ids, *_rows(cells), dims)


def singular_products(ids: DataFrame, rows: DataFrame, vocab: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """``singular_rows`` of rows ``(id, k, x)``, an id a row, whose columns are those of ``vocab``."""
    size = vocab.count()
    if not size:
        return ids.select("id", F.array().cast("array<double>").alias("low")), np.zeros(0)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "x"))
            yield pa.RecordBatch.from_arrays([vector_struct(size, list_bounds(batch.column("k")), k, x)], names=["features"])

    # every pass sends a vector as long as the vocabulary from each partition: one a core
    features = cut(rows.mapInArrow(build, StructType([StructField("features", VectorUDT())]))).coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(features, "features"))
    svd = matrix.computeSVD(min(dims, size), False)
    v, s = np.asarray(svd.V.toArray()), np.asarray(svd.s.toArray())
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    if v.nbytes > MOST_BYTES:
        raise ValueError("the vocabulary is too large for tasks to hold its singular vectors; raise min_df or lower dims")
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            k, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "x"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(list_bounds(batch.column("k"))))
            out = np.column_stack([np.bincount(row, v[k, j] * x, batch.num_rows) for j in range(v.shape[1])])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, v.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "low"])

    low = rows.mapInArrow(project, f"id {dict(rows.dtypes)['id']}, low array<double>")
    zeros = F.array(*[F.lit(0.0)] * v.shape[1])
    return ids.select("id").join(low, "id", "left").select("id", F.coalesce("low", zeros).alias("low")), s
