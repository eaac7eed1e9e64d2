"""TF-IDF as long tables ``(id, term, weight)``, fitted inside folds."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foldspan.operators.folds import class_positions
from foldspan.plans.lineage import cut


def term_counts(df: DataFrame, id_col: str, terms: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, <keep>..., term, tf)``. Texts are dealt by id before they become terms, so that terms are counted where they are."""
    rows = df.repartition(F.col(id_col))
    return rows.select(F.col(id_col).alias("id"), *keep, F.explode(terms).alias("term")).groupBy("id", *keep, "term").agg(F.count("*").alias("tf"))


def fields_counts(df: DataFrame, id_col: str, fields: Mapping[str, Column]) -> DataFrame:
    """Term counts of several texts, each with a vocabulary of its own: the term is (field, term)."""
    named = lambda k: lambda t: F.concat(F.lit(f"{k}:"), t)
    each = F.explode(F.flatten(F.array(*[F.transform(c, named(k)) for k, c in fields.items()])))
    return df.select(F.col(id_col).alias("id"), each.alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """``(term, df, idf)`` with ln((1 + n) / (1 + df)) + 1; ``n_docs`` is one row ``n``."""
    v = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    return v.select("term", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def known_cells(counts: DataFrame, n_docs: DataFrame, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """``(id, term, tf, idf)``: the counts of the terms that ``vocabulary`` would take from them.

    A window counts the rows of a term where they meet, so that counts are shuffled by term once, and neither written nor
    joined to a vocabulary made of them.
    """
    met = counts.select("id", "term", "tf", F.count("*").over(Window.partitionBy("term")).alias("df")).crossJoin(F.broadcast(n_docs))
    met = met.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    return met.select("id", "term", "tf", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def _raw_weights(cells: DataFrame, sublinear: bool) -> DataFrame:
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    return cells.select("id", "term", (tf * F.col("idf")).alias("w"))


def _unit_weights(cells: DataFrame, sublinear: bool) -> DataFrame:
    # a window reads the cells once; sums per id joined to them would make them twice
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return _raw_weights(cells, sublinear).select("id", "term", (F.col("w") / norm).alias("weight")).where("id is not null")


def weights(counts: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """``(id, term, weight)``: unit rows of (1 + ln tf) idf. Terms that the vocabulary lacks are left out."""
    return _unit_weights(counts.join(vocab.select("term", "idf"), "term"), sublinear)


def tfidf(train: DataFrame, other: DataFrame, id_col: str, terms: Column, min_df: int = 1, max_share: float = 1.0, sublinear: bool = True) -> DataFrame:
    """Weights of the rows of ``other`` by the vocabulary of ``train``."""
    n = train.agg(F.count("*").cast("double").alias("n"))
    counts = term_counts(other, id_col, terms)
    if train is other:
        return _unit_weights(known_cells(counts, n, min_df, max_share), sublinear)
    return weights(counts, vocabulary(term_counts(train, id_col, terms), n, min_df, max_share), sublinear)


def tfidf_summary(df: DataFrame, id_col: str, terms: Column, min_df: int = 1, max_share: float = 1.0, sublinear: bool = True) -> DataFrame:
    """``(id, n_terms, top_weight, total)`` of the weights of ``tfidf`` on its own rows: number, largest and sum.

    A row's length divides its sums, not its cells, so that only sums are shuffled by id.
    """
    n = df.agg(F.count("*").cast("double").alias("n"))
    raw = _raw_weights(known_cells(term_counts(df, id_col, terms), n, min_df, max_share), sublinear).where("id is not null")
    sums = raw.groupBy("id").agg(F.count("*").alias("n_terms"), F.max("w").alias("top"), F.sum("w").alias("sum"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return sums.select("id", "n_terms", (F.col("top") / F.col("length")).alias("top_weight"), (F.col("sum") / F.col("length")).alias("total"))


def unit_rows(cells: DataFrame) -> DataFrame:
    """``(id, k, x)``: one row an id with its columns rising and its values at length 1, of long ``(id, k, w)``; once each."""
    lists = cells.groupBy("id").agg(F.collect_list("k").alias("k"), F.collect_list("w").alias("x"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = list_bounds(batch.column("k"))
            k, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "x"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            order = np.lexsort((k, row))
            x = x[order] / np.sqrt(np.bincount(row, x * x, batch.num_rows))[row]
            at = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, pa.array(k[order])), pa.ListArray.from_arrays(at, pa.array(x))], names=["id", "k", "x"])

    return lists.mapInArrow(unit, lists.schema)


def tfidf_rows(df: DataFrame, id_col: str, terms: Column, min_df: int = 1, max_share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The weights of ``tfidf`` on its own rows as ``(id, k, x)``, an id a row, and the vocabulary ``(term, df, idf, k)``.

    Terms become numbers where they meet their idf, so that only numbers go on, once. An id without terms has no row.
    """
    counts = cut(term_counts(df, id_col, terms))
    vocab = cut(numbered(vocabulary(counts, df.agg(F.count("*").cast("double").alias("n")), min_df, max_share)))
    w = ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")
    return cut(unit_rows(counts.where("id is not null").join(vocab, "term").select("id", "k", w))), vocab


def vector_struct(size: int, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> pa.StructArray:
    """Sparse vectors of MLlib as their struct: row i has the cells ``offsets[i]`` to ``offsets[i + 1]``, indices rising."""
    n, at = len(offsets) - 1, pa.array(offsets.astype(np.int32))
    fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(at, pa.array(indices.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values.astype(np.float64)))]
    return pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])


def list_bounds(column: pa.Array) -> np.ndarray:
    """Where the items of each list begin in ``column.flatten()``, one bound more than lists; a null has none."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])


def sparse_vectors(ids: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """``(id, features)`` of every id for MLlib: sparse vectors of ``(id, k, v)``, built by batches; an id without cells has zeros."""
    from pyspark.ml.linalg import VectorUDT

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            flat = lists.flatten()
            k, v = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vector_struct(size, list_bounds(lists), k, v)], names=["id", "features"])

    lists = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("cells"))
    rows = ids.select("id").join(lists, "id", "left").select("id", F.coalesce("cells", F.array().cast(lists.schema["cells"].dataType)).alias("cells"))
    return rows.mapInArrow(build, StructType([rows.schema["id"], StructField("features", VectorUDT())]))


def numbered(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``k``, numbers of its terms from 0 on without gaps, by hash buckets and not in one task."""
    return class_positions(vocab, "term", [], F.lit("term")).withColumn("k", F.col("pos").cast("int")).drop("pos", "size")


def term_vectors(ids: DataFrame, w: DataFrame, vocab: DataFrame, size: int) -> DataFrame:
    """``(id, features)``: a column for each of the ``size`` terms of a numbered vocabulary."""
    return sparse_vectors(ids, w.join(vocab.select("term", "k"), "term").select("id", "k", F.col("weight").alias("v")), size)
