"""The class model against a plain computation of its scores."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foldspan.llm import classlm as L

SCHEMA = "doc_id long, text string, n_tokens string"
ROWS = [
    *((i, " ".join(f"{a}{(i * k) % 7}" for k, a in enumerate("the red cat sees the blue dog and the old tree".split(), 1)), "clash") for i in range(40)),
    (100, None, None),
    (101, "", None),
    (102, " \n\t", None),
    (None, "The1 red1 unseen words here the1", None),
    (60, "The1 red1 unseen words here the1", None),
    (60, "The1 red1 unseen words here the1", None),
    (103, "the1 red2 new new cat3 sees4 zzz", None),
    (104, "long0 word1 " * 4000 + "end", None),
]


def words(text):
    return (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).split()


def learns(i):
    return i is not None and (i < 40 and i % 3 != 0 or i > 100)


def test_scores_by_plain_computation(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    train = (F.col("doc_id") < 40) & (F.col("doc_id") % 3 != 0) | (F.col("doc_id") > 100)
    texts = [words(t) for i, t, _ in ROWS if learns(i)]
    classes, core, least, distinct, tokens = L.word_classes(df.where(train), core=8, most_frequent=20)
    known = {r["word"]: (r["n"], r["cls"]) for r in classes.collect()}
    count = Counter(w for t in texts for w in t)
    assert {w: n for w, (n, _) in known.items()} == dict(count) and (distinct, tokens) == (len(count), sum(count.values()))
    inner = sorted(count, key=lambda w: (-count[w], w))[:8]
    assert core.v.core == inner and sum(n >= least for n, _ in known.values()) <= 20
    # the class of every other word is that of the strongest evidence of its neighbours
    end, other = core.k - 1, core.k - 2
    of_core = lambda w: end if w is None else core.cls[inner.index(w)] if w in inner else other
    for w in set(count) - set(inner):
        evidence = np.zeros(core.open)
        for t in texts:
            for k, x in enumerate(t):
                if x == w:
                    evidence += core.evidence[of_core(t[k - 1] if k else None)] + core.evidence[core.k + of_core(t[k + 1] if k + 1 < len(t) else None)]
        assert math.isclose(evidence[known[w][1]], evidence.max(), rel_tol=1e-9)
    # classes follow each other, words follow from classes
    k = core.open + 1
    joint, size, kinds = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in texts:
        seq = [k - 1, *(known[w][1] for w in t), k - 1]
        for a, b in zip(seq, seq[1:], strict=False):
            joint[a, b] += 1
    for n, c in known.values():
        size[c] += n
        kinds[c] += 1
    follows = L.class_transitions(joint)
    assert np.allclose(follows.sum(axis=1), 1)
    divisor = size + L.WORD_ADD * (kinds + 1)

    def score(text):
        total, before = 0.0, k - 1
        for w in words(text):
            if w in known:
                n, c = known[w]
            else:
                row = core.joint[before if before < k - 1 else core.k - 1, : core.open] + L.BIGRAM_ADD
                n, c = 0, int((np.log10(row) - np.log10(divisor[: core.open])).argmax())
            total += math.log10(follows[before, c]) + math.log10((n + L.WORD_ADD) / divisor[c])
            before = c
        return total + math.log10(follows[before, k - 1])

    got = L.class_model_scores(df, train, core=8, most_frequent=20).collect()
    key = lambda i: (i is None, i or 0)
    ends = len(texts)
    want = sorted(
        ((i, len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, sum(count.values()) + ends) for i, t, _ in ROWS),
        key=lambda r: key(r[0]),
    )
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=lambda r: key(r[0])) == want
    total, v = sum(count.values()) + ends, len(count) + 1
    text = {i: t for i, t, _ in ROWS}
    for r in got:
        assert math.isclose(r["score"], score(text[r["doc_id"]]), rel_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10((c + 1) / (total + v + 1)) for c in [*(count[w] for w in words(text[r["doc_id"]])), ends]), rel_tol=1e-9)
    # the same scores whatever is looked up by a join
    joined = {(r["doc_id"], round(r["score"], 8)) for r in L.class_model_scores(df, train, core=8, most_frequent=10_000).collect()}
    assert joined == {(r["doc_id"], round(r["score"], 8)) for r in got}


def test_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert L.class_model_scores(df.where("false"), F.lit(True)).count() == 0
    got = L.class_model_scores(df, F.lit(False)).collect()
    assert len(got) == len(ROWS) and all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_exchange_separates_what_never_meets():
    b = np.zeros((10, 10), np.int64)
    b[:4, :4], b[4:8, 4:8], b[9, :8], b[:8, 9] = 50, 50, 1, 1
    cls = L.exchange_classes(b, 2)
    assert len(set(cls[:4])) == len(set(cls[4:8])) == 1 and cls[0] != cls[4] and cls[8:].tolist() == [2, 3]


def test_contexts_of_a_word_may_span_batches(spark):
    """A word's sums go on over any number of rows of the sorted stream."""
    import pyarrow as pa

    core = L.CoreClasses(L.Vocabulary(["a", "b"]), np.ones((4, 4), np.int64), 2)
    event = lambda side, n: np.array([side | n << L.SIDE_BITS], np.uint32).tobytes()
    rows = [("x", event(0, 2)), ("x", event(1, 3)), ("x", event(core.k, 5)), ("y", event(0, 1)), ("z", event(2, 4)), ("z", event(0, 6))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["word", "events"])

    class Shared:
        value = core

    for step in (1, 2, 3, 100):
        out = [r for b in L._assigned(iter([batch]), Shared, step) for r in b.to_pylist()]
        assert [(r["word"], r["n"]) for r in out] == [("x", 5), ("y", 1), ("z", 10)]
