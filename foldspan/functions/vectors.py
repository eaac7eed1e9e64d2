"""Vector expressions on ``array<float>`` columns, and the encoder contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, also where ``f`` uses it inside a lambda."""
    return F.transform(F.array(c), f)[0]


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    return let(as_doubles(v), lambda w: let(norm(w), lambda k: F.transform(w, lambda x: F.when(k > 0, x / k).otherwise(x))))


def truncated(v: Column, dim: int, nested: bool = True) -> Column:
    """The first ``dim`` numbers as a unit vector; refused for models whose prefixes are no embeddings."""
    if not nested:
        raise ValueError("prefixes of this model's vectors are no embeddings")
    return unit(F.slice(v, 1, dim))


def joined_blocks(*vs: Column) -> Column:
    """Unit blocks one after another, as a unit vector."""
    return unit(F.concat(*[unit(v) for v in vs]))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: F.abs(x - y))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)


def relations(a: Column, b: Column) -> dict[str, Column]:
    """Joint, product and difference representations of a pair, and all of them together."""
    joint, prod, diff = joined_blocks(a, b), product(a, b), absolute_difference(a, b)
    return {"joint": joint, "product": prod, "absdiff": diff, "all": F.concat(joint, unit(prod), unit(diff))}


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def quality_gate(df: DataFrame, vec: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: rows, vectors with a number that isn't finite, vectors off the unit norm, dimensions, and whether all are equal."""
    v = as_doubles(F.col(vec))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.coalesce(finite, F.lit(False))).alias("n_not_finite"),
        F.count_if(F.abs(norm(F.col(vec)) - 1) > tolerance).alias("n_off_norm"),
        F.max(F.size(vec)).cast("bigint").alias("dim"),
        (F.min(vec) == F.max(vec)).alias("all_equal"),
    )


def hash_encoder(dim: int = 32) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: hashed character trigrams, projected to unit vectors."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            c = np.frombuffer(f"  {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:]) * np.uint64(0x165667B19E3779F9)
            np.add.at(row, (h >> np.uint64(40)).astype(np.int64) % dim, np.where((h >> np.uint64(39)) & np.uint64(1), 1.0, -1.0))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def _encoded(texts: list[str], encode: Callable[[list[str]], np.ndarray], batch: int, retries: int) -> Iterator[np.ndarray]:
    """The vectors of texts, ``batch`` at a time; a batch that fails is tried again."""
    for k in range(0, len(texts), batch):
        for left in range(retries, -1, -1):
            try:
                yield encode(texts[k : k + batch])
                break
            except Exception:
                if not left:
                    raise


def embed(df: DataFrame, id_col: str, text: Column, encode: Callable[[list[str]], np.ndarray], batch: int = 64, retries: int = 2) -> DataFrame:
    """``(id_col, vec)`` by a batch function of texts; a batch that fails is tried again. Null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [v for part in _encoded(b.column("text").to_pylist(), encode, batch, retries) for v in part.astype(np.float32).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vecs, pa.list_(pa.float32()))], names=["id", "vec"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, vec array<float>").withColumnRenamed("id", id_col)


def embed_chunked(df: DataFrame, id_col: str, tokens: Column, encode: Callable[[list[str]], np.ndarray], width: int, stride: int, batch: int = 64, retries: int = 2) -> DataFrame:
    """Vectors of long token lists: chunks, encoded in batches, averaged by their token counts, as unit vectors.

    The chunks of a row follow one another in its task, so their weighted vectors are summed as they come, over batches
    too, and nothing is shuffled. Each row has its own vector, rows of one id too; null tokens have no row, a
    vector of zeros stays one.
    """
    from foldspan.functions.text import chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that the last batch ended in: key, id, sum

        def told(ids: list, sums: list[np.ndarray]) -> pa.RecordBatch:
            m = np.array(sums)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("id").type
            key, ids = b.column("row").to_numpy(), b.column("id")
            weighed = np.concatenate(list(_encoded(b.column("text").to_pylist(), encode, batch, retries))).astype(np.float64) * b.column("n").to_numpy()[:, None]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rows = [(int(key[h]), ids[h].as_py(), v) for h, v in zip(head.tolist(), np.add.reduceat(weighed, head), strict=True)]
            if held is not None:
                rows = [(held[0], held[1], held[2] + rows[0][2]), *rows[1:]] if held[0] == rows[0][0] else [held, *rows]
            held = rows.pop()
            if rows:
                yield told([r[1] for r in rows], [r[2] for r in rows])
        if held is not None:
            yield told([held[1]], [held[2]])

    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), chunks(tokens, width, stride).alias("parts"))
    parts = rows.select("id", "row", F.explode("parts").alias("part"))
    parts = parts.select("id", "row", F.size("part").cast("double").alias("n"), F.array_join("part", " ").alias("text"))
    return parts.mapInArrow(run, f"id {parts.schema['id'].dataType.simpleString()}, vec array<double>").withColumnRenamed("id", id_col)
