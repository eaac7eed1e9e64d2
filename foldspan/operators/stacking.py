"""Cross-fitted text scores from one count of the terms: the vocabulary of every training set by subtraction.

A plan deals the rows into groups; each group is scored by a model of the others, and rows without a group by a model of
all that have one. Rows and documents of a term are counted once by (plan, group). What a training set has is the plan's
total less its left-out group, so neither texts nor terms are read again for a fold. Vectors of all models share one
numbering of the terms and are built in Arrow batches. Cells have a term's number and count; idf comes from an array for
each model.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Condition

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foldspan.operators.folds import nested_folds, stratified_folds
from foldspan.operators.metrics import metric_table
from foldspan.operators.tfidf import list_bounds, numbered, term_counts, vector_struct
from foldspan.plans.lineage import cut


#: Terms of all models that are fitted at the same time: the driver holds about 300 bytes for each.
WIDTH = 1 << 21


@dataclass(frozen=True)
class TextSetting:
    """How a text becomes terms, which of them count, and the inverse penalty of their logistic regression."""

    terms: Column
    min_df: int = 3
    max_share: float = 0.9
    c: float = 1.0


@dataclass(frozen=True)
class Plan:
    """Rows in ``groups`` groups by a column; ``rest``: rows without one are scored, by a model of all that have one."""

    name: str
    group: Column
    groups: int
    rest: bool = False

    def jobs(self) -> list[int | None]:
        return [*range(self.groups), *([None] if self.rest else [])]


class _Room:
    """Lets fits in while their terms stay within a width; one that has more runs alone."""

    def __init__(self, width: int):
        self.width = self.left = width
        self.changed = Condition()

    @contextmanager
    def of(self, terms: int) -> Iterator[None]:
        terms = min(terms, self.width)
        with self.changed:
            self.changed.wait_for(lambda: self.left >= terms)
            self.left -= terms
        try:
            yield
        finally:
            with self.changed:
                self.left += terms
                self.changed.notify_all()


def _fold_vectors(rows: DataFrame, idf: Broadcast, size: int) -> DataFrame:
    """``(id, y, features)`` with the weights of one training set: (1 + ln tf) idf of its ``size`` terms, numbered anew, in unit rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.cumsum(~np.isnan(idf.value)) - 1
        for batch in batches:
            k, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "tf"))
            row, w = np.repeat(np.arange(batch.num_rows), np.diff(list_bounds(batch.column("k")))), idf.value[k]
            known = ~np.isnan(w)
            k, row, v = k[known], row[known], (1 + np.log(tf[known])) * w[known]
            norm = np.sqrt(np.bincount(row, v * v, minlength=batch.num_rows))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            features = vector_struct(size, bounds, place[k], v / norm[row] if len(v) else v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), features], names=["id", "y", "features"])

    narrow = rows.select("id", F.col("y").cast("double").alias("y"), "k", "tf")
    return narrow.mapInArrow(build, StructType([narrow.schema["id"], narrow.schema["y"], StructField("features", VectorUDT())]))


def _job_idf(vocab: DataFrame, at: int, size: int) -> Broadcast:
    """The idf of a job's vocabulary by the number of the term, NaN where it lacks the term: as long as its model."""
    known = vocab.select("k", F.col("idf")[at].alias("w")).where("w is not null").toArrow()
    idf = np.full(size, np.nan)
    idf[known["k"].to_numpy()] = known["w"].to_numpy()
    return vocab.sparkSession.sparkContext.broadcast(idf)


def complement_scores(df: DataFrame, series: Mapping[str, TextSetting], plans: Sequence[Plan], threads: int = 8, width: int = WIDTH) -> DataFrame:
    """``(series, plan, job, id, p)``: every plan's groups (job: their number; null for rows without one) scored by the other rows.

    ``df`` has id, y and what the settings and groups read; ids are unique. A text without a term of the vocabulary, a
    null one too, is scored on zeros. A training set without both labels gives the share of ones it has. Models are
    fitted from as many threads as their vocabularies leave in ``width`` terms, and a model has the terms of its own
    training set only. Fits side by side share the cores: each reads as many partitions as its share, as each partition
    sends a gradient of the vocabulary for each step. Scores are kept, not models.
    """
    # a number for the row's groups in all plans, which goes along with its terms
    bases = [int(np.prod([q.groups + 1 for q in plans[:i]])) for i in range(len(plans))]
    place = lambda p: F.when(p.group.cast("int").between(0, p.groups - 1), p.group.cast("int")).otherwise(p.groups)
    df = cut(df.withColumn("__at", sum((place(p).cast("bigint") * b for p, b in zip(plans, bases, strict=True)), start=F.lit(0).cast("bigint"))))
    keys = cut(df.select("id", "y", F.array(*[p.group.cast("int") for p in plans]).alias("groups")))
    cores = df.sparkSession.sparkContext.defaultParallelism
    jobs = [(i, p, g) for i, p in enumerate(plans) for g in p.jobs()]
    inside = lambda i, g: F.coalesce(F.col("groups")[i] == g, F.lit(False))
    has = lambda i: F.col("groups")[i].isNotNull()
    cells = [(i, g) for i, p in enumerate(plans) for g in range(p.groups)]
    counted = [F.count_if(inside(i, g)).alias(f"c{i}_{g}") for i, g in cells]
    sizes = keys.agg(*counted, *[F.count_if(inside(i, g) & (F.col("y") > 0)).alias(f"y{i}_{g}") for i, g in cells]).first()

    def left(name, i, p, g):
        """What a training set has: all groups of the plan but the one left out."""
        return sum((name(i, h) for h in range(p.groups) if h != g), start=name(i, 0) * 0)

    def weigh(setting: TextSetting) -> tuple[DataFrame, DataFrame, list[int]]:
        counts = cut(term_counts(df, "id", setting.terms, ["__at"]))
        docs = counts.groupBy("term").agg(*[F.count_if(F.floor(F.col("__at") / bases[i]) % (plans[i].groups + 1) == g).alias(f"c{i}_{g}") for i, g in cells])
        idf = []
        for i, p, g in jobs:
            n, d = float(left(lambda i, h: sizes[f"c{i}_{h}"], i, p, g)), left(lambda i, h: F.col(f"c{i}_{h}"), i, p, g)
            idf.append(F.when((d >= setting.min_df) & (d <= setting.max_share * n), F.log((1.0 + n) / (1.0 + d)) + 1))
        vocab = cut(numbered(docs.select("term", F.array(*idf).alias("idf")).where(F.exists("idf", lambda x: x.isNotNull()))))
        numbers = counts.select("id", "term", F.col("tf").cast("int").alias("tf")).join(vocab.select("term", "k"), "term")
        of_row = numbers.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "tf"))).alias("cells"))
        none = F.array().cast("array<int>")
        rows = keys.join(of_row, "id", "left").select("id", "y", "groups", *[F.coalesce(F.col("cells")[c], none).alias(c) for c in ("k", "tf")])
        *known, size = vocab.agg(*[F.count(F.col("idf")[at]) for at in range(len(jobs))], F.count("*")).first()
        return cut(rows), vocab, [*known, size]

    with ThreadPoolExecutor(threads) as pool:
        ready = dict(zip(series, pool.map(weigh, series.values()), strict=True))

    work = [(name, j) for name in series for j in enumerate(jobs)]
    room = _Room(width)

    def fit(job) -> DataFrame:
        name, (at, (i, p, g)) = job
        rows, vocab, (*known, size) = ready[name]
        scored = rows.where(~has(i) if g is None else inside(i, g)).coalesce(cores)
        n, ones = (left(lambda i, h, x=x: sizes[f"{x}{i}_{h}"], i, p, g) for x in "cy")
        shape = [F.lit(name).alias("series"), F.lit(p.name).alias("plan"), F.lit(g).cast("int").alias("job"), "id"]
        if not 0 < ones < n:
            return scored.select(*shape, F.lit(ones / n if n else 0.0).alias("p"))
        terms = max(1, known[at])
        together = max(1, min(threads, len(work), width // terms))
        with room.of(terms):
            idf = _job_idf(vocab, at, max(1, size))
            train = _fold_vectors(rows.where(has(i) & ~inside(i, g) if g is not None else has(i)).coalesce(-(-cores // together)), idf, terms)
            lr = LogisticRegression(labelCol="y", regParam=1.0 / (series[name].c * n), standardization=False, maxIter=50)
            out = cut(lr.fit(train).transform(_fold_vectors(scored, idf, terms)).select(*shape, vector_to_array("probability")[1].alias("p")))
            idf.unpersist()
        return out

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(fit, work))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stacked_series(df: DataFrame, series: Mapping[str, TextSetting], k: int = 3, inner: int = 3) -> DataFrame:
    """``(outer, id, part, <series>...)``: text scores for every outer fold, from inner folds for its training rows and
    from all its training rows for its validation rows. ``df`` has id, y, fold and the texts. Each fold that it has is
    an outer one, ``k`` of them at least."""
    df = cut(df)
    k = max(k, 1 + (df.agg(F.max("fold")).first()[0] or 0))
    nested = nested_folds(df.select(F.lit(0).alias("seed"), "id", "y", "fold"), k, inner)
    # one row an id: an entry a fold, null for its own
    wide = nested.groupBy(F.col("id").alias("__id")).agg(*[F.max(F.when(F.col("outer") == o, F.col("inner"))).alias(f"__g{o}") for o in range(k)])
    rows = df.join(wide, F.col("id") == F.col("__id"), "left").drop("__id")
    out = complement_scores(rows, series, [Plan(str(o), F.col(f"__g{o}"), inner, True) for o in range(k)])
    part = F.when(F.col("job").isNull(), "valid").otherwise("train").alias("part")
    return out.groupBy(F.col("plan").cast("int").alias("outer"), "id", part).pivot("series", list(series)).agg(F.first("p"))


def setting_table(df: DataFrame, settings: Mapping[str, TextSetting], seeds: Sequence[int], k: int = 3) -> DataFrame:
    """``(config, metric, mean, sd)``: every text setting by repeated cross-validation, over its seeds."""
    folds = stratified_folds(df, "id", "y", seeds, k)
    wide = folds.groupBy(F.col("id").alias("__id")).agg(*[F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(f"__g{s}") for s in seeds])
    rows = df.join(wide, F.col("id") == F.col("__id")).drop("__id")
    p = complement_scores(rows, settings, [Plan(str(s), F.col(f"__g{s}"), k) for s in seeds])
    m = metric_table(cut(p.select(F.col("series").alias("config"), F.col("plan").cast("int").alias("seed"), "id", "p").join(df.select("id", "y"), "id")), ["config", "seed"])
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in (("auc", "auc"), ("ap", "ap"), ("f1", "best_f1"))]))
    return m.select("config", values.alias("x")).select("config", "x.*").groupBy("config", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
