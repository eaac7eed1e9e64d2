"""A quality classifier on supervised subword embeddings.

Words, repeated words and character n-grams are hashed to vectors; a text is the mean of its vectors, and a softmax
layer says how likely each class is. Vectors and layer are learned together by stochastic gradient descent in
numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.langid import softmax

BITS, DIM, ORDERS = 17, 12, (1, 2, 3, 4)
#: Labelled texts of each class that the vectors are fitted on; every fifth of them checks the scale of the scores.
PER_CLASS, CALIBRATION = 1200, 5
EPOCHS, RATE, SHRINK = 6, 0.5, 1e-5
ACCEPT = 0.7
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Feature numbers of a whole text: character n-grams inside words (ends marked by a space), words, word repeats.

    A word equal to the one before it gives one feature that all such repeats share.
    """
    words = " ".join((text or "").split())
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = c == 32
    out = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            break
        inner = np.ones(m, bool)
        for k in range(1, n - 1):
            inner &= ~space[k : k + m]
        if n == 1:
            inner = ~space
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ c[k : k + m]) * _K
        out.append(h[inner])
    # words by a rolling polynomial: differences of prefix sums, shifted to the word's start
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), _M)]).astype(np.uint64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), np.uint64(pow(int(_M), -1, 1 << 64)))]).astype(np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:-1])]).astype(np.uint64)
    at = np.flatnonzero(space)
    word = (sums[at[1:]] - sums[at[:-1] + 1]) * back[at[:-1] + 1]
    out += [word * _K + np.uint64(7), np.full(int((word[1:] == word[:-1]).sum()), 11, np.uint64)]
    h = np.concatenate(out)
    return (((h ^ (h >> np.uint64(31))) * _M) >> np.uint64(64 - bits)).astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(features(t), return_counts=True) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("n"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["label", "n", "ids", "counts"])


def train_vectors(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature vectors, output layer and its bias; the rate falls linearly to zero."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    w, b = rng.normal(0, 1 / dim, (classes, dim)), np.zeros(classes)
    steps, at = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, share, y = examples[k]
            step = rate * (1 - at / steps)
            at += 1
            v = share @ e[ids]
            g = softmax(w @ v + b)
            g[y] -= 1
            back = w.T @ g
            w -= step * (np.outer(g, v) + SHRINK * w)
            b -= step * g
            # a feature's gradient is scaled up by the number of features, as its share is small
            e[ids] -= step * np.outer(share * np.sqrt(len(ids)), back)
    return e, w, b


class QualityModel:
    """The learned classifier of two classes, folded to one number a feature: a text's logit is a mean of numbers."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def logit(self, text: str | None) -> float:
        f = features(text)
        return self.bias + (float(self.weight[f].mean(dtype=np.float64)) if len(f) else 0.0)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -60, 60))))


def _scale(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logits by Newton steps on the weighted log loss."""
    a, b = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -60, 60)))
        x = np.stack([logits, np.ones_like(logits)])
        g = x @ (weight * (p - y)) + np.array([1e-2 * (a - 1), 0.0]) * weight.sum()
        h = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-2, 1e-6]) * weight.sum()
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def fit_quality(train: DataFrame, id_col: str = "doc_id", text: str = "text", labels: DataFrame | None = None, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """A model of the 0/1 ``label`` of the rows of ``labels`` (id and label) over the texts of ``train``.

    At most ``per_class`` labels of each class are used, those with the smallest hashes of their ids; texts come to
    them by a broadcast of those ids, which has that bound. Other labels, nulls and null ids teach nothing; of texts
    that share an id one teaches, on every run the same. An id that is labelled both ways teaches both. Without labels
    of both classes every text scores the share of ones, a half if there are none. Texts are read whole.
    """
    spark = train.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return QualityModel(np.zeros(1 << BITS), float(np.log((ones + 0.5) / (zeros + 0.5))))
    # the smallest hashes of each class by a share that gives enough of them, then exactly; no row but these is read
    hashed = known.withColumn("h", F.xxhash64("id"))
    share = F.when(F.col("label") == 1, 1.2 * per_class / ones + 50 / ones).otherwise(1.2 * per_class / zeros + 50 / zeros)
    some = hashed.where(F.pmod("h", F.lit(1 << 30)) < F.least(share, F.lit(1.0)) * (1 << 30)).select("label", F.pmod("h", F.lit(1 << 30)).alias("o"), "h", "id").collect()
    picked = [r for y in (0, 1) for r in sorted((r for r in some if r["label"] == y), key=lambda r: (r["o"], r["h"]))[:per_class]]
    order = spark.createDataFrame([(r["id"], r["label"], n) for n, r in enumerate(picked)], hashed.select("id", "label").schema.add("n", "integer"))
    texts = train.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(order), "id")
    # of texts that share an id the one with the smallest hash
    texts = texts.groupBy("n", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    got = texts.mapInArrow(_examples, "label int, n int, ids array<int>, counts array<int>").toArrow().sort_by("n")
    seen = [0, 0]
    fit, check = [], []
    for y, ids, counts in zip(got["label"].to_pylist(), got["ids"], got["counts"], strict=True):
        seen[y] += 1
        if not len(ids):
            continue
        i, c = ids.values.to_numpy(), counts.values.to_numpy().astype(np.float32)
        (check if seen[y] % CALIBRATION == 0 else fit).append((i, c / c.sum(), y))
    if len({y for *_, y in fit}) < 2:
        return QualityModel(np.zeros(1 << BITS), float(np.log((ones + 0.5) / (zeros + 0.5))))
    e, w, b = train_vectors(fit, 2)
    weight, bias = e @ (w[1] - w[0]), b[1] - b[0]
    y = np.array([y for *_, y in check], np.float64)
    logits = np.array([bias + share @ weight[i] for i, share, _ in check])
    # classes count by their shares among all labels
    prior = np.where(y == 1, ones / max(1, (y == 1).sum()), zeros / max(1, (y == 0).sum())) / (ones + zeros) if len(y) else y
    slope, shift = _scale(logits, y, prior) if len(y) else (1.0, float(np.log(ones / zeros)))
    return QualityModel(slope * weight, slope * bias + shift)


def scored(df: DataFrame, model: QualityModel, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (1 from ``accept`` on); a null or empty text has the score of no feature.

    Whole texts of any length; equal texts have equal scores, and a score of just ``accept`` is accepted. Columns of ``df`` with these names are replaced. An empty
    table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = df.withColumn("score", F.arrow_udf(lambda t: pa.array([shared.value.score(x) for x in t.to_pylist()], pa.float64()), "double")(F.col(text).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= accept).cast("int"))
