"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample of each language, then
calibrated by a temperature on a part of the sample that the training didn't see. Document frequencies cover all
training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, ORDERS = 15, (1, 2, 3)
#: Texts of each language that the weights are fitted on, and texts that hash to the calibration part.
PER_CLASS, CALIBRATION = 400, 5
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 1e-4, 4
UNKNOWN = "und"
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def grams(text: str, bits: int = BITS, orders=ORDERS) -> np.ndarray:
    """Hashed character n-grams of the whole lower-cased text, its ends marked by a space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in orders:
        m = len(c) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : k + m]) * _STEPS[k]
            out.append(((h ^ (h >> np.uint64(29))) * _STEPS[1]) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def term_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text, bits), minlength=1 << bits)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each partition the number of texts that hold each feature; feature -1 counts the texts."""
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            df[np.unique(grams(t))] += 1
            n += 1
    ids = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(df[ids], n))], names=["feature", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["label", "h", "ids", "counts"])


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(np.linalg.norm(x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=0))
    return e / e.sum(axis=0)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS, seed=5) -> np.ndarray:
    """Weights by class and feature; most of them are zero."""
    z, n = np.zeros((classes, features)), np.zeros((classes, features))

    def weights(z, n):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, x, y = examples[k]
            zi, ni = z[:, ids], n[:, ids]
            w = weights(zi, ni)
            g = softmax(w @ x)
            g[y] -= 1
            g = g[:, None] * x
            grown = ni + g * g
            z[:, ids] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[:, ids] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits (classes x texts) that gives the least log loss, by a search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[y, np.arange(len(y))], 1e-300)).mean()

    lo, hi, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column, parts: int = 4) -> Column:
    """True if the CRC-32 of the id as text leaves 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 2, F.lit(False))


class LanguageModel:
    """Learned languages, their weights, the inverse document frequencies and the temperature."""

    def __init__(self, names: list[str], w: np.ndarray, idf: np.ndarray, divisor: float):
        self.names, self.w, self.idf, self.divisor = names, w, idf, divisor

    def logits(self, text: str) -> np.ndarray:
        ids, counts = term_counts(text)
        return self.w[:, ids] @ vector(counts, self.idf[ids])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.divisor)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def fit_languages(train: DataFrame, text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> LanguageModel:
    """A model of the non-null ``lang`` values of ``train``; rows with a null in either column teach nothing.

    The weights are fitted on at most ``per_class`` texts of a language, those with the smallest hashes of the text;
    frequencies are those of all rows.
    """
    rows = train.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("label")).where("text is not null and label is not null")
    df = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    idf = np.full(1 << BITS, np.log1p(total) + 1)
    for k, v in df.items():
        idf[k] = np.log((1 + total) / (1 + v)) + 1
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((0, 1 << BITS)), idf, 1.0)
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    # a share of each language that gives the asked number, and some; the surplus is cut below
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, 1.5 * per_class / sizes[k] + 50 / sizes[k]))])
    picked = hashed.where(F.col("h") < share[F.col("label")] * (1 << 30)).dropDuplicates(["label", "text"])
    got = picked.mapInArrow(_examples, "label string, h bigint, ids array<int>, counts array<int>").toArrow().sort_by([("label", "ascending"), ("h", "ascending")])
    taken: dict[str, int] = {}
    fit, check = [], []
    for label, ids, counts in zip(got["label"].to_pylist(), got["ids"], got["counts"], strict=True):
        taken[label] = taken.get(label, 0) + 1
        if taken[label] > per_class:
            continue
        i, c = ids.values.to_numpy(), counts.values.to_numpy()
        (check if taken[label] % CALIBRATION == 0 else fit).append((i, vector(c, idf[i]), names.index(label)))
    w = ftrl(fit, len(names), 1 << BITS)
    logits = np.array([w[:, i] @ x for i, x, _ in check]).T if check else np.zeros((len(names), 0))
    return LanguageModel(names, w, idf, temperature(logits, np.array([y for *_, y in check], np.int64)))


def identified(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``: a learned language and its calibrated probability.

    ``und`` and 0 for a null text, one without a letter, or a model that learned nothing. Texts of any length are read
    whole. Of languages that are as likely the first by name is taken, so equal texts get equal results, and repeated
    rows stay. Columns of ``df`` with these two names are replaced. An empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(t: pa.Array) -> pa.Array:
        rows = [shared.value.predict(x) for x in t.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["lang_pred", "score"])

    out = df.withColumn("__lang", F.arrow_udf(predict, "lang_pred string, score double")(F.col(text).cast("string")))
    return out.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
