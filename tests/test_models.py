import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.operators import models as M
from foldspan.plans import experiments as P


def table(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(2, 3, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * (a - 2) - b)))).astype(int)
    rows = [(i, None if i % 11 == 0 else float(x), float(z), "uvw"[i % 3], [float(x), float(z)], int(t), i % 3) for i, (x, z, t) in enumerate(zip(a, b, y, strict=True))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c string, vec array<double>, y int, fold int").repartition(3)


def logistic(x, y, penalty):
    """Newton's method; the intercept is not penalised."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    ridge = np.diag([0.0, *[penalty] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    return lambda z: 1 / (1 + np.exp(-np.concatenate([np.ones((len(z), 1)), z], axis=1) @ w))


def parts(df, numeric):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    train, valid = ([r for r in rows if (r["fold"] == 0) == held] for held in (False, True))
    fill = {c: np.median([r[c] for r in train if r[c] is not None]) for c in numeric}
    matrix = lambda rs: np.array([[fill[c] if r[c] is None else r[c] for c in numeric] for r in rs])
    x, z = matrix(train), matrix(valid)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    return (x - mean) / sd, np.array([r["y"] for r in train]), (z - mean) / sd, [r["id"] for r in valid], train, valid


def by_id(df, col="p"):
    return {r["id"]: r[col] for r in df.collect()}


def test_linear_expert_agrees_with_newton(spark):
    df = table(spark)
    x, y, z, ids, train, valid = parts(df, ["a", "b"])
    got = by_id(M.linear_expert(["a", "b"])(df.where("fold > 0"), df.where("fold = 0")))
    assert [got[i] for i in ids] == pytest.approx(logistic(x, y, 1.0)(z), abs=1e-3)
    hot = lambda rs: np.array([[float(r["c"] == v) for v in "uvw"] for r in rs])
    got = by_id(M.linear_expert(["a"], ["c"])(df.where("fold > 0"), df.where("fold = 0")))
    want = logistic(np.concatenate([x[:, :1], hot(train)], 1), y, 1.0)(np.concatenate([z[:, :1], hot(valid)], 1))
    assert [got[i] for i in ids] == pytest.approx(want, abs=2e-3)


def test_vector_expert_agrees_with_newton(spark):
    df = table(spark)
    *_, ids, train, valid = parts(df, ["b"])
    m = logistic(np.array([r["vec"] for r in train]), np.array([r["y"] for r in train]), 1.0)
    got = by_id(M.vector_expert()(df.where("fold > 0"), df.where("fold = 0")))
    assert [got[i] for i in ids] == pytest.approx(m(np.array([r["vec"] for r in valid])), abs=1e-3)


def test_bank_has_out_of_fold_and_mean_test_scores(spark):
    df, test = table(spark), table(spark, 30, 9).drop("fold").withColumn("id", F.col("id") + 1000)
    expert = M.linear_expert(["a", "b"])
    got = M.out_of_fold(df, {"e": expert}, 3, test=test.drop("y"))
    oof, mean = ({r["id"]: r["p"] for r in got.where(F.col("split") == s).collect()} for s in ("oof", "test"))
    each = [by_id(expert(df.where(F.col("fold") != f), df.where(F.col("fold") == f))) for f in range(3)]
    assert oof == pytest.approx({i: p for e in each for i, p in e.items()}, abs=1e-6)
    tests = [by_id(expert(df.where(F.col("fold") != f), test)) for f in range(3)]
    assert mean == pytest.approx({i: np.mean([t[i] for t in tests]) for i in tests[0]}, abs=1e-6) and len(mean) == 30


def test_folds_share_their_percentiles_and_score_as_each_fit_alone(spark, monkeypatch):
    df = table(spark)
    experts = {"linear": M.linear_expert(["a", "b"], ["c"]), "trees": M.tree_expert(["a", "b"], rounds=3), "spline": M.spline_expert(["b"], ["c"])}
    one = df.coalesce(1).sortWithinPartitions("id")  # trees sample as the rows are dealt
    each = {n: by_id(e(one.where("fold != 1"), one.where("fold = 1"))) for n, e in experts.items()}
    calls = []
    monkeypatch.setattr(M, "column_percentiles", lambda *a: calls.append(a))
    got = M.out_of_fold(df, experts, 3)
    assert not calls and got.columns == ["config", "seed", "model", "split", "id", "p"] and got.count() == 3 * 240
    for n, want in each.items():
        found = by_id(got.where((F.col("model") == n) & (F.col("id") % 3 == 1)))
        assert found == pytest.approx(want, abs=1e-6) and len(found) == 80


def test_other_experts_get_two_tables_with_all_columns(spark):
    seen = []

    def mean(train, valid):
        seen.append(train.columns)
        return valid.select("id", F.lit(train.agg(F.avg("b")).first()[0]).alias("p"))

    df = table(spark).withColumn("nothing", F.lit(None))
    got = by_id(M.out_of_fold(df, {"mean": mean, "linear": M.linear_expert(["a"])}, 3).where("model = 'mean'"))
    want = {f: df.where(F.col("fold") != f).agg(F.avg("b")).first()[0] for f in range(3)}
    assert got == pytest.approx({i: want[i % 3] for i in range(240)}) and all(c == df.columns for c in seen)


def test_ridge_of_a_residual_agrees_with_its_normal_equations(spark):
    df = table(spark).withColumn("residual", F.col("y") - F.lit(0.4))
    x, y, z, ids, *_ = parts(df, ["a", "b"])
    r = y - 0.4
    w = np.linalg.solve(x.T @ x + 10.0 * np.eye(2), x.T @ (r - r.mean()))
    got = by_id(M.ridge_residual(df, "residual", ["a", "b"]), "guess")
    assert [got[i] for i in ids] == pytest.approx(r.mean() + z @ w, abs=1e-6) and len(got) == 240


def test_a_large_penalty_leaves_the_offset(spark):
    df = table(spark).withColumn("base", 1 / (1 + F.exp(-F.col("b"))))
    got = by_id(M.offset_correction(df.where("fold > 0"), df.where("fold = 0"), "base", ["a"], alpha=1e6))
    shift = [np.log(got[r["id"]] / (1 - got[r["id"]])) - r["b"] for r in df.where("fold = 0").collect()]
    assert np.ptp(shift) < 1e-3  # an intercept, and the base logit with the coefficient one


def test_a_better_candidate_is_accepted_and_the_same_is_not(spark):
    df = table(spark, 400)
    base = P.repeated_scores(df, M.linear_expert(["a"]), [0, 1, 2], "base", 2)
    cand = P.repeated_scores(df, M.linear_expert(["a", "b"]), [0, 1, 2], "cand", 2)
    better, same = P.judge(base, cand, "base", "cand").first(), P.judge(base, base.withColumn("config", F.lit("cand")), "base", "cand").first()
    assert "ACCEPT" in better.asDict().values() and "ACCEPT" not in same.asDict().values()


def test_a_holdout_run_scores_rows_it_has_not_seen(spark):
    df = table(spark, 400)
    rules = P.holdout_run(df.drop("fold"), {"a": M.linear_expert(["a"]), "b": M.linear_expert(["b"])}, k=2).collect()
    assert {r["auc"] for r in rules} and all(0.6 < r["auc"] < 1 and 0 < r["f1"] <= 1 and 0 < r["t"] < 1 for r in rules)
    noise = df.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    assert all(0.3 < r["auc"] < 0.7 for r in P.holdout_run(noise.drop("fold"), {"a": M.linear_expert(["a"]), "b": M.linear_expert(["b"])}, k=2).collect())
