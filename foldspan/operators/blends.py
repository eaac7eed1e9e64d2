"""Blends of model scores. Scores are long tables ``(seed, model, id, p)``; weights are small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.functions.rows import logit, sigmoid
from foldspan.operators.metrics import auc_ap, best_threshold, f1_curve
from foldspan.operators.ranks import rank_normalised
from foldspan.plans.lineage import cut


def weighted(preds: DataFrame, weights: Mapping[str, float], method: str = "prob") -> DataFrame:
    """``(seed, id, p)``: the weighted mean of scores or of their normalised ranks over the models with a weight."""
    rows = preds.where(F.col("model").isin(list(weights)))
    if method == "rank":
        rows = rank_normalised(rows, ["seed", "model"], "p", "r").withColumn("p", F.col("r"))
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("model")]
    return rows.groupBy("seed", "id").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("p"))


def uniform_logit(preds: DataFrame) -> DataFrame:
    return preds.groupBy("seed", "id").agg(F.avg(logit("p")).alias("z")).select("seed", "id", sigmoid("z").alias("p"))


def wide(preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(seed, id, <model>...)``; the models are named, so that no pass looks for them."""
    return preds.groupBy("seed", "id").pivot("model", list(models)).agg(F.first("p"))


def weight_sweep(df: DataFrame, a: str, b: str, y: str = "y", step: float = 0.05, seed: str = "seed") -> DataFrame:
    """auc, ap and best F1 of ``(1 - w) a + w b`` for each weight of a grid, averaged over seeds."""
    n = round(1 / step)
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("p", (1 - F.col("k") * step) * F.col(a) + F.col("k") * step * F.col(b))
    keys = ["k", seed]
    each = auc_ap(rows, keys, y, "p").join(best_threshold(f1_curve(rows, keys, y, "p"), keys), keys)
    return each.groupBy("k").agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"), F.avg("best_f1").alias("best_f1")).withColumn("w", F.col("k") * step)


def percentile_rank_blend(df: DataFrame, id_col: str, a: str, b: str, lam: float) -> DataFrame:
    """``p``: (1 - lam) and lam of the percentile ranks (rank over n) of two scores."""
    ra = rank_normalised(df, [], a, "__ra", plus=0)
    return rank_normalised(ra, [], b, "__rb", plus=0).withColumn("p", (1 - lam) * F.col("__ra") + lam * F.col("__rb")).drop("__ra", "__rb")


def seed_mean(blends: DataFrame) -> DataFrame:
    """Mean over seeds of each row's score, and its population deviation between seeds."""
    return blends.groupBy("id").agg(F.avg("p").alias("p"), F.stddev_pop("p").alias("p_sd"))


class Meta:
    """Non-negative weights on logits, and an intercept."""

    def __init__(self, models: Sequence[str], weights: Sequence[float], intercept: float, alpha: float):
        self.models, self.weights, self.intercept, self.alpha = list(models), [float(w) for w in weights], float(intercept), alpha

    def apply(self, df: DataFrame, out: str = "p") -> DataFrame:
        z = F.lit(self.intercept)
        for m, w in zip(self.models, self.weights, strict=True):
            z = z + w * logit(m)
        return df.withColumn(out, sigmoid(z))


def fit_meta(df: DataFrame, models: Sequence[str], y: str = "y", alpha: float = 0.01) -> Meta:
    """Mean log loss plus ``alpha`` times the squared weights, weights at least 0."""
    from pyspark.ml.linalg import DenseMatrix

    names = [f"__z{i}" for i in range(len(models))]
    rows = df.withColumns({n: logit(m) for n, m in zip(names, models, strict=True)}).withColumn("__y", F.col(y).cast("double"))
    rows = VectorAssembler(inputCols=names, outputCol="__x").transform(rows)
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=2 * alpha, standardization=False, tol=1e-9, maxIter=300, lowerBoundsOnCoefficients=DenseMatrix(1, len(models), [0.0] * len(models)))
    m = lr.fit(rows.select("__x", "__y"))
    return Meta(models, m.coefficients.toArray(), m.intercept, alpha)


def fit_meta_spread(df: DataFrame, models: Sequence[str], y: str = "y", alpha: float = 0.01, steps: int = 200) -> Meta:
    """As ``fit_meta``, but the penalty is on the spread of the weights around their mean.

    Projected gradient steps with backtracking; each evaluates loss and gradient by one aggregate of the table.
    """
    k = len(models)
    names = [f"z{i}" for i in range(k)]
    rows = df.select(*[logit(m).alias(n) for n, m in zip(names, models, strict=True)], F.col(y).cast("double").alias("y")).cache()

    def evaluate(w, b):
        z = F.lit(float(b))
        for n, v in zip(names, w, strict=True):
            z = z + float(v) * F.col(n)
        p = 1 / (1 + F.exp(-z))
        loss = F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z))) - F.col("y") * z
        r = rows.agg(F.avg(loss).alias("l"), F.avg(p - F.col("y")).alias("gb"), *[F.avg((p - F.col("y")) * F.col(n)).alias(n) for n in names]).first()
        mean = w.mean()
        return r["l"] + alpha * ((w - mean) ** 2).sum(), np.array([r[n] for n in names]) + 2 * alpha * (w - mean), r["gb"]

    w, b, size = np.full(k, 1.0 / k), 0.0, 1.0
    loss, g, gb = evaluate(w, b)
    for _ in range(steps):
        while True:
            nw, nb = np.maximum(w - size * g, 0), b - size * gb
            new, ng, ngb = evaluate(nw, nb)
            if new <= loss + 1e-12 or size < 1e-8:
                break
            size /= 2
        moved = abs(nw - w).max() + abs(nb - b)
        w, b, loss, g, gb, size = nw, nb, new, ng, ngb, size * 1.5
        if moved < 1e-6:
            break
    rows.unpersist()
    return Meta(models, w, b, alpha)


def select_alpha(df: DataFrame, models: Sequence[str], y: str = "y", fold: str = "inner", k: int = 3, grid: Sequence[float] = (0.0001, 0.001, 0.01, 0.1)) -> float:
    """The penalty with the highest inner AP; of equal ones the first."""
    def one(job):
        alpha, f = job
        fitted = fit_meta(df.where(F.col(fold) != f), models, y, alpha)
        return fitted.apply(df.where(F.col(fold) == f), "__p").select(F.lit(alpha).alias("alpha"), y, "__p")

    with ThreadPoolExecutor(4) as pool:
        scored = list(pool.map(one, [(alpha, f) for alpha in grid for f in range(k)]))
    rows = scored[0]
    for s in scored[1:]:
        rows = rows.unionByName(s)
    ap = {r["alpha"]: r["ap"] for r in auc_ap(cut(rows), ["alpha"], y, "__p").collect()}
    return max(grid, key=lambda a: (ap[a] or 0.0, -grid.index(a)))


def fixed_alphas(df: DataFrame, models: Sequence[str], alphas: Sequence[float], y: str = "y", fold: str = "fold", k: int = 3) -> DataFrame:
    """``(alpha, model, weight, auc, ap)``: out-of-fold quality of the blend at each fixed penalty, and its mean weights."""
    df = cut(df)

    def one(job):
        alpha, f = job
        meta = fit_meta(df.where(F.col(fold) != f), models, y, alpha)
        return alpha, meta.weights, meta.apply(df.where(F.col(fold) == f), "p").select(F.lit(alpha).alias("alpha"), y, "p")

    with ThreadPoolExecutor(4) as pool:
        fitted = list(pool.map(one, [(a, f) for a in alphas for f in range(k)]))
    rows = fitted[0][2]
    for _, _, r in fitted[1:]:
        rows = rows.unionByName(r)
    mean = [(float(a), m, float(np.mean([w[i] for b, w, _ in fitted if b == a]))) for a in alphas for i, m in enumerate(models)]
    weights = df.sparkSession.createDataFrame(mean, "alpha double, model string, weight double")
    return weights.join(auc_ap(cut(rows), ["alpha"], y, "p").select("alpha", "auc", "ap"), "alpha")


def cross_fitted_meta(df: DataFrame, models: Sequence[str], y: str = "y", fold: str = "fold", k: int = 5, grid: Sequence[float] = (0.001, 0.01, 0.1), inner: int = 3) -> tuple[DataFrame, list[Meta]]:
    """Out-of-fold blend: for each fold a penalty and weights from the other folds; and the fitted blends."""
    metas, parts = [], []
    df = cut(df)
    for f in range(k):
        train = df.where(F.col(fold) != f).withColumn("inner", F.pmod(F.col(fold) - f - 1, F.lit(k)) % inner)
        metas.append(fit_meta(train, models, y, select_alpha(train, models, y, "inner", inner, grid)))
        parts.append(metas[-1].apply(df.where(F.col(fold) == f), "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, metas


def subsets(preds: DataFrame, drop: Sequence[str]) -> DataFrame:
    """The scores without some members; nothing is fitted again."""
    return preds.where(~F.col("model").isin(list(drop)))


def greedy_ensemble(preds: DataFrame, labels: DataFrame, base: str, rounds: int = 10, f1_drop: float = 0.002, min_gain: float = 0.0) -> list[str]:
    """Members, with repetition, of the best bag; only ``base`` if none is better than it.

    The bag starts empty and takes in every round the model that gives it the highest mean AP, gain or not, of equal
    ones the first by name. Of its beginnings that have more AP than the base alone, by more than ``min_gain``, and lose no
    more than ``f1_drop`` of the base's best F1, the one with the highest AP is taken, the shortest of equal ones.
    Every round scores all candidates by one job, the candidate being part of the key.
    """
    models = sorted(r[0] for r in preds.select("model").distinct().collect())
    # a row has all its models' scores, so that no round shuffles or joins rows
    each = [F.collect_list(F.when(F.col("model") == m, F.struct("p"))).alias(f"__{i}") for i, m in enumerate(models)]
    wide = cut(preds.join(labels.select("id", "y"), "id").groupBy("id", "seed", "y").agg(*each))
    one = lambda m: F.transform(f"__{models.index(m)}", lambda x: F.struct(F.lit(m).alias("model"), x["p"].alias("p")))
    rows = wide.select("seed", "y", F.explode(F.concat(*map(one, models))).alias("x")).select("seed", "y", "x.*")
    mean = lambda d, keys: auc_ap(d, keys).join(best_threshold(f1_curve(d, keys), keys), keys)
    base_ap, base_f1 = mean(rows.where(F.col("model") == base), ["seed"]).agg(F.avg("ap"), F.avg("best_f1")).first()
    bag: list[str] = []
    good: list[tuple[float, int]] = []
    for n in range(1, rounds + 1):
        times = lambda c: lambda x: c * x["p"]
        parts = [F.transform(f"__{i}", times(float(bag.count(m)))) for i, m in enumerate(models)]
        held = F.aggregate(F.filter(F.concat(*parts), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
        tried = wide.select("seed", "y", held.alias("held"), F.explode(F.concat(*map(one, models))).alias("x")).select("seed", "y", "x.model", ((F.col("held") + F.col("x.p")) / float(n)).alias("p"))
        table = mean(tried.select("seed", "model", "y", "p"), ["model", "seed"]).groupBy("model").agg(F.avg("ap").alias("ap"), F.avg("best_f1").alias("f1")).collect()
        best = min(table, key=lambda r: (-round(r["ap"], 14), r["model"]))
        bag.append(best["model"])
        if best["f1"] >= base_f1 - f1_drop and best["ap"] > base_ap + min_gain:
            good.append((round(best["ap"], 14), -n))
    return bag[: -max(good)[1]] if good else [base]


def anchored_lambda(df: DataFrame, a: str, b: str, y: str = "y", fold: str = "fold", grid: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.5), ap_tolerance: float = 0.002) -> float:
    """The share of ``b`` whose thresholds transfer best between folds, among those that lose little AP.

    F1 of a fold is that at the best threshold of the other folds; of equal shares the smallest wins.
    """
    lam = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    rows = df.withColumn("lam", lam).withColumn("p", (1 - F.col("lam")) * F.col(a) + F.col("lam") * F.col(b))
    k = [r[0] for r in df.select(fold).distinct().collect()]
    outer = rows.withColumn("outer", F.explode(F.array(*[F.lit(x) for x in k])))
    t = best_threshold(f1_curve(outer.where(F.col(fold) != F.col("outer")), ["lam", "outer"], y, "p"), ["lam", "outer"])
    here = rows.join(F.broadcast(t.withColumnRenamed("outer", fold)), ["lam", fold]).withColumn("l", (F.col("p") >= F.col("best_t")).cast("int"))
    f1s = here.groupBy("lam", fold).agg((2.0 * F.sum(F.col("l") * F.col(y)) / F.greatest(F.sum("l") + F.sum(y), F.lit(1))).alias("f1")).groupBy("lam").agg(F.avg("f1").alias("f1"))
    found = {r["lam"]: (r["ap"], r["f1"]) for r in f1s.join(auc_ap(rows, ["lam"], y, "p"), "lam").collect()}
    floor = found[float(grid[0])][0] - ap_tolerance
    return max((g for g in map(float, grid) if found[g][0] >= floor), key=lambda g: (round(found[g][1], 12), -g))


def support_scores(df: DataFrame, base: str, others: Mapping[str, float], out: str = "support") -> DataFrame:
    """Weighted percentile ranks of the base and the other scores; the base has the weight that is left."""
    names = {base: 1 - sum(others.values()), **others}
    total = F.lit(0.0)
    for i, (c, w) in enumerate(names.items()):
        df = rank_normalised(df, [], c, f"__r{i}", plus=0)
        total = total + w * F.col(f"__r{i}")
    return df.withColumn(out, total).drop(*[f"__r{i}" for i in range(len(names))])


