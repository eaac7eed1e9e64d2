"""Fitted blends, ensembles, pairs, text vectors and the monitor against numpy and plain enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.operators import blends as B
from foldspan.operators import models as M
from foldspan.operators.folds import balanced_pairs
from foldspan.operators.neighbors import smoothed_vote
from foldspan.operators.tfidf import numbered, term_counts, term_vectors, vocabulary, weights
from foldspan.streaming.monitor import windowed_confusion


def average_precision(y, p):
    out, steps = 0.0, sorted(set(p), reverse=True)
    seen = hits = 0
    for s in steps:
        n = sum(x == s for x in p)
        k = sum(v for v, x in zip(y, p, strict=True) if x == s)
        seen, hits = seen + n, hits + k
        out += k * hits / seen
    return out / sum(y)


def best_f1(y, p):
    found = []
    for k in range(97):
        t = 0.02 + k * 0.01
        predicted = [x >= t for x in p]
        tp = sum(v for v, x in zip(y, predicted, strict=True) if x)
        found.append(2 * tp / (sum(predicted) + sum(y)) if sum(predicted) + sum(y) else 0.0)
    return max(found)


def greedy(y, scores, base, rounds, drop):
    names, bag, good = sorted(scores), [], []
    for _ in range(rounds):
        mean = {n: [sum(v) / (len(bag) + 1) for v in zip(*[scores[m] for m in [*bag, n]], strict=True)] for n in names}
        ap = {n: average_precision(y, mean[n]) for n in names}
        best = min(names, key=lambda n: (-round(ap[n], 14), n))
        bag.append(best)
        if best_f1(y, mean[best]) >= best_f1(y, scores[base]) - drop and ap[best] > average_precision(y, scores[base]):
            good.append((round(ap[best], 14), -len(bag)))
    return bag[: -max(good)[1]] if good else [base]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_bag(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 60).tolist()
    scores = {n: [round(float(np.clip(s * v + rng.normal(0.3, 0.3), 0, 1)), 3) for v in y] for n, s in (("a", 0.2), ("b", 0.3), ("c", 0.1))}
    rows = [(0, m, i, float(p)) for m, v in scores.items() for i, p in enumerate(v)]
    preds = spark.createDataFrame(rows, "seed int, model string, id int, p double")
    labels = spark.createDataFrame(list(enumerate(y)), "id int, y int")
    for base in ("a", "b"):
        assert B.greedy_ensemble(preds, labels, base, 3, 0.02) == greedy(y, scores, base, 3, 0.02)


def test_balanced_anchors(spark):
    df = spark.createDataFrame([(i, int(i < 12)) for i in range(100)], "id int, y int")
    pairs = balanced_pairs(df, "id", "y").collect()
    label = lambda i: int(i < 12)
    anchors = {r["anchor"] for r in pairs}
    assert len(pairs) == 48 and len(anchors) == 24 and sum(map(label, anchors)) == 12
    assert all(r["anchor"] != r["partner"] and r["same"] == (label(r["anchor"]) == label(r["partner"])) for r in pairs)
    assert len({r["partner"] for r in pairs if not label(r["partner"])}) > 12


def test_meta_weights_are_the_least_loss(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    p = np.clip(np.stack([0.3 * y + rng.uniform(0.2, 0.6, 200), 0.1 * y + rng.uniform(0.3, 0.6, 200)]), 0.02, 0.98)
    df = spark.createDataFrame([(int(v), float(a), float(b)) for v, a, b in zip(y, *p, strict=True)], "y int, a double, b double")
    z = np.log(p / (1 - p))

    def loss(w, b, penalty):
        s = w @ z + b
        return np.mean(np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - y * s) + penalty(w)

    squares, spread = (lambda w: 0.01 * (w**2).sum()), (lambda w: 0.01 * ((w - w.mean()) ** 2).sum())
    for fit, penalty in ((B.fit_meta, squares), (B.fit_meta_spread, spread)):
        m = fit(df, ["a", "b"], alpha=0.01)
        w, b = np.array(m.weights), m.intercept
        here = loss(w, b, penalty)
        assert (w >= 0).all()
        for dw in itertools.product((-0.05, 0.0, 0.05), repeat=2):
            for db in (-0.05, 0.0, 0.05):
                moved = np.maximum(w + np.array(dw), 0)
                assert loss(moved, b + db, penalty) >= here - 1e-6


def test_text_vectors_keep_every_text(spark):
    df = spark.createDataFrame([(1, "a b b", 1), (2, "a c", 0), (3, "", 1), (4, "zz", 0), (5, "b c", 0), (6, "a b", 1)], "id int, text string, y int")
    terms = F.filter(F.split("text", " "), lambda w: w != "")
    vocab = numbered(vocabulary(term_counts(df, "id", terms), df.agg(F.count("*").cast("double").alias("n")), 2))
    assert sorted(r["k"] for r in vocab.collect()) == [0, 1, 2]
    w = weights(term_counts(df, "id", terms), vocab)
    got = {r["id"]: r["features"] for r in term_vectors(df, w, vocab, 3).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[3].numNonzeros() == got[4].numNonzeros() == 0
    assert all(abs(got[i].norm(2) - 1) < 1e-12 for i in (1, 2, 5, 6))
    scores = M.text_expert(terms, 2, 1.0)(df, df).collect()
    assert sorted(r["id"] for r in scores) == [1, 2, 3, 4, 5, 6] and all(0 < r["p"] < 1 for r in scores)


def test_few_neighbours_count_as_they_are(spark):
    near = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 8, 0.0, 0.0)], "query int, id int, y double, distance double")
    assert abs(smoothed_vote(near, 0.2).first()["score"] - (2 * 0.5 + 20 * 0.2) / 22) < 1e-12


def test_available():
    assert M.available(["a", "b"], {"x": ["a"], "y": ["a", "c"], "z": []}) == ["x", "z"]


def test_monitor_of_a_stream(spark, tmp_path):
    rows = spark.range(40).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 5)).alias("ts"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 3) / 2).alias("p"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed_confusion(stream, "ts", "y", "p", 0.5).writeStream.outputMode("complete").format("memory").queryName("confusion").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("confusion").collect()))
    assert got == sorted(map(tuple, windowed_confusion(rows, "ts", "y", "p", 0.5).collect())) and sum(r[2] for r in got) == 40


def test_rounds_of_the_ensemble_join_nothing(spark, monkeypatch):
    rows = [(0, i, m, (i * k % 7) / 7 + i / 40) for i in range(20) for m, k in (("a", 3), ("b", 5)) if (i, m) != (4, "b")]
    preds = spark.createDataFrame(rows, "seed int, id long, model string, p double")
    labels = spark.createDataFrame([(i, int(i > 9)) for i in range(20)], "id long, y int")
    plans, auc_ap = [], B.auc_ap
    monkeypatch.setattr(B, "auc_ap", lambda d, keys: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), auc_ap(d, keys))[1])
    assert set(B.greedy_ensemble(preds, labels, "a", 2)) <= {"a", "b"}
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_words_are_found_once_and_cells_are_weighed_once(spark):
    from foldspan.functions.text import word_ngrams
    from foldspan.operators.tfidf import tfidf

    df = spark.createDataFrame([(1, "Aa bb aa"), (2, "bb"), (3, None), (1, "cc")], "id long, text string")
    terms = df.select("id", word_ngrams(F.col("text"), 1, 2).alias("t"))
    assert terms._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r["t"] for r in terms.collect()] == [["aa", "bb", "aa", "aa bb", "bb aa"], ["bb"], [], ["cc"]]
    w = tfidf(df, df, "id", word_ngrams(F.col("text"), 1, 2))
    assert w._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2  # the vocabulary and the number of rows
    norms = w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert {r["id"]: round(r["n"], 9) for r in norms} == {1: 1.0, 2: 1.0}


def test_cells_are_shuffled_by_term_once_and_not_written(spark, monkeypatch):
    from foldspan.functions.text import word_ngrams
    from foldspan.operators import tfidf as I

    rows = [(1, "aa bb aa cc"), (2, "bb aa dd"), (3, None), (4, "cc cc bb aa"), (1, "ee bb"), (None, "aa bb zz"), (5, "bb")]
    df = spark.createDataFrame(rows, "id long, text string")
    terms = word_ngrams(F.col("text"), 1, 2)
    monkeypatch.setattr(I, "cut", lambda d: pytest.fail("cells are written"))
    w = I.tfidf(df, df, "id", terms, 2, 0.8)
    other = I.tfidf(df, df.select("*"), "id", terms, 2, 0.8)
    key = lambda d: {(r["id"], r["term"]): round(r["weight"], 12) for r in d.collect()}
    assert key(w) == key(other) and len(key(w)) > 5 and None not in {i for i, _ in key(w)}
    s = I.tfidf_summary(df, "id", terms, 2, 0.8)
    want = {r["id"]: r for r in w.groupBy("id").agg(F.count("*").alias("n_terms"), F.max("weight").alias("top_weight"), F.sum("weight").alias("total")).collect()}
    got = {r["id"]: r for r in s.collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r["n_terms"] == want[i]["n_terms"] and all(r[c] == pytest.approx(want[i][c], rel=1e-12) for c in ("top_weight", "total"))
    assert "Exchange hashpartitioning(term" in s._jdf.queryExecution().executedPlan().toString()
    assert s._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the number of rows
