import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foldspan.operators import models as M


def rows(spark, n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice("pq"), rng.choice("rst"), rng.choice(["u", "v", None])
        y = int(rng.random() < (0.85 if (a == "p") == (b == "r") else 0.15))
        out.append((i, a, b, c, rng.gauss(y, 1.0), rng.gauss(0, 1), y, i % 3))
    return spark.createDataFrame(out, "id bigint, a string, b string, c string, u double, v double, y int, inner int").repartition(3)


def crosses(df):
    level = lambda c: F.coalesce(F.col(c), F.lit("-"))
    return df.withColumns({f"{x}{y}": F.concat(level(x), level(y)) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))})


def test_screening_agrees_with_rates_row_by_row(spark):
    df = crosses(rows(spark))
    got = {r["cross"]: r["ap"] for r in M.screened_crosses(df, ["ab", "ac", "c"]).collect()}
    table = df.collect()
    for name in ("ab", "ac", "c"):
        scored = []
        for r in table:
            rest = [s for s in table if s["inner"] != r["inner"]]
            same = [s["y"] for s in rest if s[name] == r[name]]
            scored.append(((sum(same) + 10.0 * sum(s["y"] for s in rest) / len(rest)) / (len(same) + 10.0), r["y"]))
        total, ap = sum(y for _, y in scored), 0.0
        for p in {p for p, _ in scored}:
            above = [y for q, y in scored if q >= p]
            ap += sum(y for q, y in scored if q == p) / total * sum(above) / len(above)
        assert got[name] == pytest.approx(ap, rel=1e-12)
    assert M.screened_crosses(df.where("false"), ["ab"]).collect() == []


def test_survivors_of_the_screening_give_the_same_set_as_all(spark):
    df = crosses(rows(spark))
    names = ["ab", "ac", "bc"]
    whole = M.select_crosses(df, names, base_categorical=["a", "b", "c"], min_gain=0.05)
    assert whole == ["ab"] == M.select_crosses(df, names, base_categorical=["a", "b", "c"], min_gain=0.05, screen=1)


def test_the_kept_round_is_that_of_enumeration(spark):
    df = rows(spark, 300, 3).withColumn("x", array_to_vector(F.array("u", "v"))).select("x", F.col("y").cast("double").alias("y"), "inner")
    a, check = df.where("inner > 0").cache(), df.where("inner = 0").cache()
    best, losses = M.staged_rounds(a, check, rounds=24, patience=6, step=4)
    each = [list(GBTClassifier(featuresCol="x", labelCol="y", maxIter=n, maxDepth=3, stepSize=0.1, seed=7).fit(a).evaluateEachIteration(check))[-1] for n in range(1, len(losses) + 1)]
    assert losses == pytest.approx(each, rel=1e-12)
    full = list(GBTClassifier(featuresCol="x", labelCol="y", maxIter=24, maxDepth=3, stepSize=0.1, seed=7).fit(a).evaluateEachIteration(check))
    # the best of all, or the first after which six brought no gain
    low = 0
    for i, x in enumerate(full):
        low = i if x < full[low] else low
        if i - low >= 6:
            break
    assert best == low + 1 or full[best - 1] < full[low]


def test_staged_expert_scores_all_rows(spark):
    df = rows(spark, 200, 4)
    p = M.staged_tree_expert(["u", "v"], rounds=16, patience=4, step=4)(df.where("inner > 0"), df.where("inner = 0"))
    assert p.count() == df.where("inner = 0").count() and M.REGISTRY["staged"] is M.staged_tree_expert


def test_boosting_fits_no_short_model_first_and_deals_rows(spark, monkeypatch):
    seen, plain = [], GBTClassifier.fit

    def fit(self, train):
        seen.append((self.getMaxIter(), train.rdd.getNumPartitions()))
        return plain(self, train)

    monkeypatch.setattr(M.GBTClassifier, "fit", fit)
    df = rows(spark, 300, 3).coalesce(1)
    got = M.boosting_rounds(df.where("inner > 0"), df.where("inner = 0"), ["u", "v"], rounds=10, patience=6, step=4).count()
    assert 4 <= got <= 10 and seen == [(10, M.FIT_PARTS)]
