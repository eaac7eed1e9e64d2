import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldspan.functions.text import word_ngrams
from foldspan.operators import decompose as D
from foldspan.operators import models as M
from foldspan.operators import stacking as K
from foldspan.operators.tfidf import sparse_vectors

SCHEMA = "id bigint, text string, y int, fold int"


def docs(spark, n=90, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        text = " ".join([rng.choice(words[:14] if y else words[8:]) for _ in range(rng.randint(0, 12))])
        rows.append((i, text if i % 17 else None, y, i % 3))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_scores_agree_with_models_fitted_on_each_training_set(spark):
    df = docs(spark)
    terms = word_ngrams(F.coalesce(F.col("text"), F.lit("")), 1, 1)
    got = K.stacked_series(df, {"a": K.TextSetting(terms), "b": K.TextSetting(terms, 5, 0.5)}, 3, 2).toPandas()
    want = M.stacked_text(df, {"a": M.text_expert(terms, 3), "b": M.text_expert(terms, 5, 0.5)}, 3, 2).toPandas()
    both = got.merge(want, on=["outer", "id", "part"], suffixes=("", "_want"))
    assert len(both) == len(got) == len(want) == 90 * 3
    for c in ("a", "b"):
        assert np.allclose(both[c], both[f"{c}_want"], atol=2e-3)


def test_setting_table_has_every_setting_and_a_training_set_of_one_label(spark):
    df = docs(spark, 60)
    terms = word_ngrams(F.coalesce(F.col("text"), F.lit("")), 1, 1)
    got = K.setting_table(df.drop("fold"), {"a": K.TextSetting(terms), "none": K.TextSetting(terms, 1000)}, [0, 1], 2).toPandas().set_index(["config", "metric"])["mean"]
    assert got["a", "auc"] > 0.75 and got["none", "auc"] == pytest.approx(0.5, abs=0.15)
    one = K.complement_scores(df.withColumn("y", F.when(F.col("fold") == 0, 1).otherwise(0)), {"a": K.TextSetting(terms)}, [K.Plan("p", F.col("fold"), 3)]).where("job = 0")
    assert {r["p"] for r in one.collect()} == {0.0}


def test_arrow_vectors(spark):
    cells = spark.createDataFrame([(1, 3, 0.5), (1, 0, 2.0), (2, 1, 1.0)], "id bigint, k int, v double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    got = {r["id"]: r["x"] for r in sparse_vectors(ids, cells, 4).select("id", vector_to_array("features").alias("x")).collect()}
    assert got == {1: [2.0, 0.0, 0.0, 0.5], 2: [0.0, 1.0, 0.0, 0.0], 3: [0.0] * 4}


def planted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"t{3 * 10 + j if rng.random() < 0.05 else (i % 3) * 10 + j}", float(rng.uniform(0.5, 1.5))) for i in range(90) for j in range(10) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "id bigint, term string, weight double").groupBy("id", "term").agg(F.sum("weight").alias("weight"))


def test_factors_recover_planted_blocks_and_residuals_fall(spark):
    cells = planted(spark)
    left, right, residuals = D.nonnegative_factors(cells, 3, 8)
    assert all(a >= b - 1e-9 for a, b in zip(residuals, residuals[1:], strict=False))
    topic = {r["id"]: r["topic"] for r in D.main_factor(left, right, 3).collect()}
    assert len({(i % 3, t) for i, t in topic.items()}) == 3
    w, h = ({r[0]: r[1] for r in x.collect()} for x in (left, right))
    v = {(r["id"], r["term"]): r["weight"] for r in cells.collect()}
    plain = sum((v.get((i, t), 0.0) - float(np.dot(w[i], h[t]))) ** 2 for i in w for t in h)
    assert plain == pytest.approx(residuals[-1], rel=1e-9) and min(min(x) for x in [*w.values(), *h.values()]) >= 0


def test_a_sweep_sends_a_terms_factors_once_a_block(spark, monkeypatch):
    cells = planted(spark)
    one = D.nonnegative_factors(cells, 3, 3)
    monkeypatch.setattr(D, "BLOCK_CELLS", 100)
    sent, plain = [], D._solver
    total = spark.sparkContext.accumulator(0)

    def solver(gram, inner):
        solve = plain(gram, inner)
        sent.append(1)

        def counted(cells, known):
            total.add(known.num_rows)
            return solve(cells, known)

        return counted

    monkeypatch.setattr(D, "_solver", solver)
    many = D.nonnegative_factors(cells, 3, 3)
    assert len(sent) == 3 and total.value <= 3 * (90 + 8 * 40) < 3 * cells.count()
    assert np.allclose(one[2], many[2], rtol=1e-9)
    for a, b in zip(one[:2], many[:2], strict=True):
        a, b = ({r[0]: r[1] for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], rtol=1e-7, atol=1e-10) for i in a)


def test_cells_of_singular_rows_are_made_once(spark):
    cells, made = planted(spark), spark.sparkContext.accumulator(0)
    n = cells.count()

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    D.singular_rows(spark.range(92), cells.mapInArrow(seen, cells.schema), 4)[0].count()
    assert made.value == n


def test_singular_values_agree_with_numpy(spark):
    cells = planted(spark)
    ids = spark.range(92)
    low, s = D.singular_rows(ids, cells, 4)
    terms = sorted({r["term"] for r in cells.collect()})
    a = np.zeros((92, len(terms)))
    for r in cells.collect():
        a[r["id"], terms.index(r["term"])] = r["weight"]
    u, want, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s, want[:4])
    got = np.array([r["low"] for r in low.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * want[:4]), atol=1e-6) and not got[90:].any()
    none, s = D.singular_rows(ids, cells.where("false"), 2)
    assert none.count() == 92 and len(s) == 0


def test_fits_use_a_partition_a_core_and_as_many_threads_as_the_vocabulary_leaves(spark, monkeypatch):
    running, most, parts, plain = [], [], [], K.LogisticRegression.fit

    def fit(self, train):
        running.append(1)
        most.append(len(running))
        parts.append(train.rdd.getNumPartitions())
        try:
            return plain(self, train)
        finally:
            running.pop()

    monkeypatch.setattr(K.LogisticRegression, "fit", fit)
    terms = word_ngrams(F.coalesce(F.col("text"), F.lit("")), 1, 1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = K.complement_scores(docs(spark), {"a": K.TextSetting(terms)}, [K.Plan("p", F.col("fold"), 3)], width=20)
        assert out.count() == 90 and len(parts) == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(parts) <= spark.sparkContext.defaultParallelism and max(most) == 1


def test_fits_side_by_side_share_the_cores_and_have_their_own_terms(spark, monkeypatch):
    parts, features, plain = [], [], K.LogisticRegression.fit

    def fit(self, train):
        parts.append(train.rdd.getNumPartitions())
        model = plain(self, train)
        features.append(model.numFeatures)
        return model

    monkeypatch.setattr(K.LogisticRegression, "fit", fit)
    df = docs(spark).withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("only"), "fold")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = K.complement_scores(df, {"a": K.TextSetting(word_ngrams(F.col("text"), 1, 1))}, [K.Plan("p", F.col("fold"), 3)])
        assert out.count() == 90
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts == [2, 2, 2]  # 4 cores, three fits
    assert features == [27, 27, 27]  # of 28 terms: a fold's own one is not in its training set


def test_room_is_shared_by_terms_and_one_that_exceeds_it_runs_alone():
    import threading
    import time

    room, now, most = K._Room(10), [], []

    def one(terms):
        with room.of(terms):
            now.append(terms)
            most.append(list(now))
            time.sleep(0.05)
            now.remove(terms)

    threads = [threading.Thread(target=one, args=(n,)) for n in (4, 4, 4, 30, 4, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(most) == 6 and all(sum(x) <= 10 or x == [30] for x in most) and room.left == 10


def test_every_fold_is_an_outer_one(spark, sf_dir, monkeypatch):
    from foldspan import catalog

    catalog.register_all()
    asked = []

    def scores(df, series, plans):
        asked.append([(p.name, p.groups, p.rest) for p in plans])
        assert df.columns[-3:] == ["__g0", "__g1", "__g2"]
        return df.sparkSession.createDataFrame([("0", None, 1, 0.5)], "plan string, job int, id bigint, p double").withColumn("series", F.lit(next(iter(series))))

    monkeypatch.setattr(K, "complement_scores", scores)
    K.stacked_series(docs(spark), {"a": K.TextSetting(word_ngrams(F.col("text"), 1, 1))}, 2, 2)
    catalog.QUERIES["q_text_series"](spark, sf_dir)
    assert asked == [[("0", 2, True), ("1", 2, True), ("2", 2, True)]] * 2
