"""Hand-checked cases and invariants of the evaluation operators."""

import pytest
from pyspark.sql import functions as F

from foldspan.functions import rows as R
from foldspan.functions.text import chunks, future_carried, word_ngrams
from foldspan.functions.vectors import unit
from foldspan.operators.blends import cross_fitted_meta
from foldspan.operators.decisions import swapped_labels, top_k_labels
from foldspan.operators.encoders import encode_new
from foldspan.operators.explore import bh_fdr, fisher_p, wilson
from foldspan.operators.folds import poisson_weights, stratified_folds
from foldspan.operators.metrics import auc_ap, best_threshold, f1_curve
from foldspan.operators.neighbors import smoothed_vote


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 1, 0.4), (5, 0, 0.3), (6, 0, 0.1)], "id long, y int, p double")


def test_auc_ap(scored):
    r = auc_ap(scored).first()
    assert (round(r["auc"], 6), round(r["ap"], 6)) == (0.833333, 0.805556)
    assert auc_ap(scored.repartition(7)).first() == r


def test_f1_curve(scored):
    f = {round(r["t"], 2): round(r["f1"], 6) for r in f1_curve(scored, grid=(0.05, 0.05, 17)).collect()}
    assert (f[0.05], f[0.35], f[0.4], f[0.85]) == (0.666667, 0.857143, 0.857143, 0.5)
    assert round(best_threshold(f1_curve(scored, grid=(0.05, 0.05, 17))).first()["best_t"], 2) == 0.35


def test_target_encoding(spark):
    rows = [("A", 1)] * 3 + [("A", 0)] + [("B", 1)] + [("B", 0)] * 5
    got = encode_new(spark.createDataFrame(rows, "c string, y int"), spark.createDataFrame([("A",), ("B",), ("C",)], "c string"), "c", "y")
    assert {r["c"]: round(r["te"], 6) for r in got.collect()} == {"A": 0.5, "B": 0.3125, "C": 0.4}


def test_knn(spark):
    near = spark.createDataFrame([(1, 1.0, 0.0), (1, 0.0, 0.1), (1, 1.0, 0.5)], "query long, y double, distance double")
    assert round(smoothed_vote(near, 0.24, k=3).first()["score"], 6) == 0.299197


def test_row_functions(spark):
    r = spark.range(1).select(R.safe_div(F.lit(1.0), F.lit(0.0)).alias("a"), R.signed_log(F.lit(-3.0)).alias("b"), unit(F.array(F.lit(3.0), F.lit(4.0))).alias("c"), chunks(F.array(*[F.lit(str(i)) for i in range(10)]), 4, 3).alias("d"), word_ngrams(F.lit("ab cd ef")).alias("e")).first()
    assert r["a"] is None and round(r["b"], 6) == -1.386294 and r["c"] == [0.6, 0.8]
    assert [c[0] for c in r["d"]] == ["0", "3", "6"] and r["e"] == ["ab", "cd", "ef", "ab cd", "cd ef"]


def test_future_carried(spark):
    text = "a。b F。c。d C。e。"
    assert spark.range(1).select(future_carried(F.lit(text), ["F"], ["C"])).first()[0] == "b F。 c。 e。"


def test_decisions(spark, scored):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.4)], "id long, p double")
    assert [r["id"] for r in top_k_labels(rows, "id", "p", 1).where("label = 1").collect()] == [2]
    for m in (0, 1, 5):
        assert swapped_labels(scored, "id", "p", "p", 0.5, m).agg(F.sum("label")).first()[0] == 3


def test_statistics(spark):
    tests = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "id long, p double")
    assert {r["id"]: round(r["q"], 6) for r in bh_fdr(tests, "p", "id").collect()} == {1: 0.04, 2: 0.04, 3: 0.04, 4: 0.5}
    lo, hi = wilson(F.lit(79), F.lit(141))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r["lo"], 4), round(r["hi"], 4)) == (0.4778, 0.6395)
    assert round(fisher_p(3, 1, 1, 3), 6) == 0.485714


def test_folds(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    f = stratified_folds(df, "id", "y", [0, 1], 5)
    assert f.select("seed", "id").distinct().count() == f.count() == 206
    n = [r["n"] for r in f.where("seed = 0 and y = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(n) - min(n) <= 1
    assert 0.7 < poisson_weights(df, "id", 20).agg(F.sum("w") / 2060).first()[0] < 1.3


def test_meta_blend_fills_every_inner_fold(spark):
    # three folds leave two for training, whose numbers are alike modulo 2 where the middle one is held out
    df = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 7 % 20 + F.col("id") % 2 * 5 + 1) / 30.0).alias("a"))
    out, metas = cross_fitted_meta(df, ["a"], k=3, grid=(0.01, 0.1), inner=2)
    assert out.count() == 60 and len(metas) == 3 and all(w >= 0 for m in metas for w in m.weights)


def test_crosses_start_from_the_base(spark, monkeypatch):
    from foldspan.operators import models as M

    # scores by the set of columns: ``a`` is best alone, ``c`` adds most to it and ``b`` then nothing; ``z`` never gains
    ap = {"": 0.5, "a": 0.7, "b": 0.65, "c": 0.6, "z": 0.5, "ab": 0.71, "ac": 0.8, "az": 0.7, "abc": 0.8, "acz": 0.8}
    rows = spark.range(4).selectExpr("id", "cast(id % 2 as int) as y", "cast(id % 2 as int) as inner")
    monkeypatch.setattr(M, "cut", lambda df: df)
    monkeypatch.setattr(M, "linear_expert", lambda base, cols, **_: lambda train, valid: valid.selectExpr("id", f"'{''.join(sorted(set(cols) - {'base'}))}' as p"))

    class Scored:
        def __init__(self, df):
            self.of = df.first()["p"]

        def first(self):
            return {"ap": ap[self.of]}

    monkeypatch.setattr(M, "auc_ap", Scored)
    assert M.select_crosses(rows, ["a", "b", "c", "z"], k=2, base_categorical=["base"]) == ["a", "c"]
    assert M.select_crosses(rows, ["z"], k=2, base_categorical=["base"]) == []


def test_covers_claims_only_what_is_built():
    from foldspan import catalog

    catalog.register_all()
    built = {"F4": "q_text_series", "J17": "q_shuffled_errors", "J23": "q_fixed_alpha", "J24": "q_text_lab", "S5": "q_saved_run", "S1": "q_load_entities"}
    for row, name in built.items():
        assert [q for q, rows in catalog.COVERS.items() if row in rows.split()] == [name]


def test_row_shape_is_compiled_and_terms_are_counted_without_ids(spark):
    from foldspan.functions import rows as R
    from foldspan.functions import text as T

    df = spark.createDataFrame([(1.0, 5.0, None), (None, None, None), (3.0, None, None), (2.0, float("nan"), 4.0)], "a double, b double, c double")
    got = df.select(*[v.alias(k) for k, v in R.row_shape(["a", "b", "c"]).items()])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(8**0.5, 4.0, 0.0, 4.0), (None, None, 0.0, 0.0), (None, 0.0, 1.0, 0.0), (2**0.5, 2.0, 0.0, 2.0)]
    assert [tuple(r) for r in got.collect()] == want
    names = spark.createDataFrame([(1, "abab"), (1, "ba"), (2, "ab"), (None, "ab"), (3, None)], "id long, t string")
    table = T.term_table(names, "id", "t", lambda c: T.char_ngrams(c, 2, 2))
    assert sorted(map(tuple, table.collect())) == [("ab", 4, 2), ("ba", 2, 1)]
    assert "gid" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_nfkc_holds_few_texts_as_strings(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from foldspan.functions import text as T

    monkeypatch.setattr(T.F, "arrow_udf", lambda f, kind: lambda c: f)
    f = T.nfkc(None)
    texts = pa.array([None, "", "ﬁ①"] + ["Ａé日" * 500] * 4000)
    tracemalloc.start()
    out = f(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.slice(0, 3).to_pylist() == [None, "", "fi1"] and out[4000].as_py() == "Aé日" * 500 and len(out) == 4003
    assert len(f(texts.slice(0, 0))) == 0 and peak < 4 << 20


def test_character_ngrams_are_those_of_code_points_and_linear_in_the_text(spark):
    import time

    from foldspan.functions import text as T

    texts = ["", "a", "ab", "añ😀\n b", "line\r\nend\u2028x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["g"] for r in df.select("id", T.char_ngrams(F.col("t"), 1, 3).alias("g")).collect()}
    assert got == {i: [x[at : at + n] for x in [t or ""] for n in (1, 2, 3) for at in range(len(x) - n + 1)] for i, t in enumerate(texts)}
    long = spark.range(1).select(F.repeat(F.lit("abcdefghé "), 40_000).alias("t"))
    began = time.time()
    assert long.select(F.size(T.char_ngrams(F.col("t"), 2, 2)).alias("n")).first()["n"] == 399_999
    assert time.time() - began < 15
