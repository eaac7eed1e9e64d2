"""Expert models and out-of-fold scores. Every expert takes (train, valid) with ``id``, ``y`` and its columns and
gives ``(id, p)``; scores are kept as a long table ``(config, seed, model, split, id, p)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.functions.rows import MISSING, logit, sigmoid
from foldspan.operators.decompose import factored_rows, main_factor, singular_products
from foldspan.operators.encoders import spline_basis
from foldspan.operators.folds import hash_unit, nested_folds, permuted_labels
from foldspan.operators.metrics import auc_ap
from foldspan.operators.ranks import column_percentiles, fold_percentiles
from foldspan.operators.tfidf import numbered, term_counts, term_vectors, tfidf_rows, vocabulary, weights
from foldspan.plans.lineage import cut, ensure_checkpoint_dir

Expert = Callable[[DataFrame, DataFrame], DataFrame]

#: Partitions of rows that a long fit reads; a fixed number, as MLlib's sampled thresholds depend on it.
FIT_PARTS = 12

#: Rows of a partition that the fits of out-of-fold scores read; the row count alone decides how many there are.
FIT_ROWS = 1 << 17


@dataclass(frozen=True)
class Known:
    """What was found for the training rows of all folds at once: percentiles by (column, share), and the columns that
    have no null in any row, which need no median."""

    percentiles: Mapping[tuple[str, float], float | None] = field(default_factory=dict)
    whole: frozenset[str] = frozenset()


def _declared(fit: Expert, reads: Sequence[str], fills: Sequence[str] = (), places: Sequence[tuple[str, float]] = ()) -> Expert:
    """``fit`` with the columns it reads, those it fills by their median, and the percentiles it takes; as it says so, it
    may be given what is ``known`` of them."""
    fit.reads, fit.fills, fit.places = list(reads), list(fills), list(places)
    return fit


def _assembled(train: DataFrame, valid: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool, known: Known | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``x``: numbers imputed by the median of ``train`` and standardised by its population figures."""
    if numeric:
        known = known or Known()
        medians = {c: known.percentiles[c, 0.5] for c in numeric if (c, 0.5) in known.percentiles}
        asked = [c for c in numeric if c not in medians and c not in known.whole]
        if asked:
            medians |= {c: m[0] if m else None for c, m in zip(asked, column_percentiles(train, asked, [0.5]).first(), strict=True)}
        fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c) or 0.0))) for c in numeric}
        train, valid = train.withColumns(fill), valid.withColumns(fill)
        if scale:
            s = train.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"d_{c}") for c in numeric]).first()
            z = {c: (F.col(c) - float(s[f"m_{c}"] or 0.0)) / float(s[f"d_{c}"] or 0.0 if (s[f"d_{c}"] or 0.0) > 1e-9 else 1.0) for c in numeric}
            train, valid = train.withColumns(z), valid.withColumns(z)
    level = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}
    if level:
        train, valid = train.withColumns(level), valid.withColumns(level)
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"__i_{c}" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in categorical], outputCols=[f"__o_{c}" for c in categorical], dropLast=False))
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"__o_{c}" for c in categorical]], outputCol="x"))
    m = Pipeline(stages=stages).fit(train)
    return m.transform(train), m.transform(valid)


def _p(df: DataFrame) -> DataFrame:
    return df.select("id", vector_to_array("probability")[1].alias("p"))


def linear_expert(numeric: Sequence[str], categorical: Sequence[str] = (), c: float = 1.0, weight: str | None = None) -> Expert:
    """L2 logistic regression on standardised, imputed and one-hot columns; the penalty is 1 / (c n)."""

    def fit(train: DataFrame, valid: DataFrame, known: Known | None = None) -> DataFrame:
        a, b = _assembled(train, valid, numeric, categorical, True, known)
        lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (c * max(1, train.count())), standardization=False, maxIter=100)
        return _p((lr.setWeightCol(weight) if weight else lr).fit(a).transform(b))

    return _declared(fit, [*numeric, *categorical, *([weight] if weight else [])], numeric)


def tree_expert(numeric: Sequence[str], categorical: Sequence[str] = (), rounds: int = 20, depth: int = 3, check_share: float = 0.2, seed: int = 7) -> Expert:
    """Boosted trees that stop early on a part of the training rows, never on the rows that are scored."""

    def fit(train: DataFrame, valid: DataFrame, known: Known | None = None) -> DataFrame:
        a, b = _assembled(train, valid, numeric, categorical, False, known)
        a = a.withColumn("__check", hash_unit(F.lit("check"), F.col("id")) < check_share)
        return _p(GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, validationIndicatorCol="__check").fit(a).transform(b))

    return _declared(fit, [*numeric, *categorical], numeric)


def staged_rounds(train: DataFrame, check: DataFrame, rounds: int = 2000, patience: int = 100, step: int = 64, depth: int = 3, seed: int = 7) -> tuple[int, list[float]]:
    """The number of boosted trees with the least loss on ``check``, and the loss after each tree that was tried.

    ``step`` trees are judged, then twice as many and so on: the trees of a shorter fit are the first ones of a longer
    one, so the first fit has as many as the second judgement can ask for. It ends at ``rounds``, or once ``patience``
    trees after the best one brought no gain. Of equal losses the first counts. Both tables have ``x`` and y; ``check``
    must not be empty.
    """
    n, tried = min(step, rounds), []
    while True:
        if n > len(tried):
            most = max(n, min(rounds, max(2 * step, step + patience)))
            model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=most, maxDepth=depth, stepSize=0.1, seed=seed).fit(train)
            tried = list(model.evaluateEachIteration(check))
        losses = tried[:n]
        best = min(range(len(losses)), key=lambda i: (losses[i], i)) + 1
        if n >= rounds or n - best >= patience:
            return best, losses[: best + patience]
        n = min(rounds, max(2 * n, best + patience))


def boosting_rounds(train: DataFrame, check: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), **more) -> DataFrame:
    """``(round, loss, best_round)``: the loss on ``check`` after every tree that ``staged_rounds`` tried, and the one it keeps.

    Each tree reads all rows several times, so both tables are dealt by id, however few splits their files have.
    """
    a, b = (cut(d.repartition(FIT_PARTS, "id").sortWithinPartitions("id").select("x", F.col("y").cast("double").alias("y"))) for d in _assembled(train, check, numeric, categorical, False))
    best, losses = staged_rounds(a, b, **more)
    return train.sparkSession.createDataFrame([(i + 1, float(x), best) for i, x in enumerate(losses)], "round int, loss double, best_round int")


def staged_tree_expert(numeric: Sequence[str], categorical: Sequence[str] = (), rounds: int = 2000, patience: int = 100, step: int = 64, depth: int = 3, check_share: float = 0.2, seed: int = 7) -> Expert:
    """Boosted trees, as many as are best on a part of the training rows by hash, never on the rows that are scored.

    Without rows in that part, or of both labels in the other, ``step`` trees are fitted.
    """

    def fit(train: DataFrame, valid: DataFrame, known: Known | None = None) -> DataFrame:
        a, b = _assembled(train, valid, numeric, categorical, False, known)
        held = hash_unit(F.lit("check"), F.col("id")) < check_share
        rest, check = cut(a.where(~held).select("x", F.col("y").cast("double").alias("y"))), cut(a.where(held).select("x", F.col("y").cast("double").alias("y")))
        n = step if check.isEmpty() or rest.select("y").distinct().count() < 2 else staged_rounds(rest, check, rounds, patience, step, depth, seed)[0]
        return _p(GBTClassifier(featuresCol="x", labelCol="y", maxIter=n, maxDepth=depth, stepSize=0.1, seed=seed).fit(rest).transform(b))

    return _declared(fit, [*numeric, *categorical], numeric)


def forest_expert(numeric: Sequence[str], categorical: Sequence[str] = (), trees: int = 20, depth: int = 5, seed: int = 7) -> Expert:
    def fit(train: DataFrame, valid: DataFrame, known: Known | None = None) -> DataFrame:
        a, b = _assembled(train, valid, numeric, categorical, False, known)
        return _p(RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(a).transform(b))

    return _declared(fit, [*numeric, *categorical], numeric)


def vector_expert(vec: str = "vec", c: float = 1.0) -> Expert:
    """Logistic regression on a vector column as it is."""

    def fit(train: DataFrame, valid: DataFrame) -> DataFrame:
        x = array_to_vector(F.col(vec).cast("array<double>"))
        lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (c * max(1, train.count())), standardization=False)
        return _p(lr.fit(train.withColumn("x", x)).transform(valid.withColumn("x", x)))

    return fit


def text_expert(terms: Column, min_df: int = 3, max_share: float = 0.9, c: float = 1.0) -> Expert:
    """Logistic regression on TF-IDF of the training vocabulary; a text without a term of it is scored on zeros."""

    def fit(train: DataFrame, valid: DataFrame) -> DataFrame:
        vocab = cut(numbered(vocabulary(term_counts(train, "id", terms), train.agg(F.count("*").cast("double").alias("n")), min_df, max_share)))
        size = max(1, vocab.count())
        vec = lambda df: cut(df.select("id", "y").join(term_vectors(df, weights(term_counts(df, "id", terms), vocab), vocab, size), "id"))
        a = vec(train)
        lr = LogisticRegression(labelCol="y", regParam=1.0 / (c * max(1, a.count())), standardization=False, maxIter=50).fit(a)
        return _p(lr.transform(vec(valid)))

    return fit


def spline_expert(numeric: Sequence[str], categorical: Sequence[str] = (), knots: int = 3, c: float = 1.0) -> Expert:
    """An additive model of few degrees of freedom: quadratic splines at training quantiles, and one-hot levels."""

    shares = [(k + 1) / (knots + 1) for k in range(knots)]

    def fit(train: DataFrame, valid: DataFrame, known: Known | None = None) -> DataFrame:
        known = known or Known()
        told = all((n, s) in known.percentiles for n in numeric for s in shares)
        q = [[known.percentiles[n, s] for s in shares] for n in numeric] if told else column_percentiles(train, numeric, shares).first()
        cols, whole = [], set()
        for n, edges in zip(numeric, q, strict=True):
            at = sorted({e for e in edges or [] if e is not None})
            train, valid = spline_basis(train, n, at), spline_basis(valid, n, at)
            basis = [f"{n}_s1", f"{n}_s2", *[f"{n}_k{i}" for i in range(len(at))]]
            cols += basis
            whole |= set(basis) if n in known.whole else set()
        return linear_expert(cols, categorical, c)(train, valid, Known(whole=frozenset(whole)))

    return _declared(fit, [*numeric, *categorical], places=[(n, s) for n in numeric for s in shares])


REGISTRY: dict[str, Callable[..., Expert]] = {"linear": linear_expert, "trees": tree_expert, "staged": staged_tree_expert, "forest": forest_expert, "vector": vector_expert, "text": text_expert, "spline": spline_expert}


def available(columns: Sequence[str], needs: Mapping[str, Sequence[str]]) -> list[str]:
    """Names of the experts whose columns are all there."""
    return [k for k, v in needs.items() if set(v) <= set(columns)]


def _shared(df: DataFrame, experts: Sequence[Expert], k: int, alone: bool) -> tuple[DataFrame, list[Known]]:
    """``df`` as its fits read it, and what is known of each fold. Unless ``df`` is ``alone``, other rows that are scored may have nulls anywhere."""
    if all(hasattr(e, "reads") for e in experts):
        df = df.select(*dict.fromkeys(["id", "y", "fold", *[c for e in experts for c in e.reads]]))
        # fits read few columns, several times, which Parquet is faster at than a checkpoint's rows
        path = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
        df.repartition(df.count() // FIT_ROWS + 1, "id").sortWithinPartitions("id").write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    fills = sorted({c for e in experts for c in getattr(e, "fills", ())})
    places = {x for e in experts for x in getattr(e, "places", ())}
    cols = sorted({*fills, *[c for c, _ in places]})
    if not cols:
        return df, [Known()] * k
    n, *filled = df.agg(F.count("*"), *[F.count(c) for c in cols]).first()
    whole = frozenset(c for c, x in zip(cols, filled, strict=True) if x == n and alone)
    wanted = sorted(places | {(c, 0.5) for c in fills if c not in whole})
    return df, [Known(p, whole) for p in fold_percentiles(df, wanted, k)]


def out_of_fold(df: DataFrame, experts: Mapping[str, Expert], k: int = 5, seed: int = 0, config: str = "base", test: DataFrame | None = None, threads: int = 4) -> DataFrame:
    """Scores of every expert for every fold (split oof), and mean scores of the folds' models for ``test``.

    ``df`` has id, y and fold. If all experts say which columns they read, these are written once, dealt by id.
    The percentiles that they say they take are found for all folds at once. Fits are independent jobs, started from a
    few threads.
    """
    df, known = _shared(df, list(experts.values()), k, test is None)
    jobs = [(name, f) for name in experts for f in range(k)]

    def one(job):
        name, f = job
        train, valid = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        fit = experts[name] if not hasattr(experts[name], "reads") else lambda a, b: experts[name](a, b, known[f])
        keep = lambda d, split: d.select(F.lit(name).alias("model"), F.lit(split).alias("split"), F.col("id").cast("bigint").alias("id"), "p")
        if test is None:
            return keep(fit(train, valid), "oof")
        both = valid.select(*valid.columns).unionByName(test, allowMissingColumns=True)
        scored = fit(train, both.withColumn("y", F.coalesce("y", F.lit(0))))
        ids = valid.select(F.col("id").alias("__v"))
        inside = scored.join(ids, F.col("id") == F.col("__v"), "left_semi")
        return keep(inside, "oof").unionByName(keep(scored.join(ids, F.col("id") == F.col("__v"), "left_anti"), "test"))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    mean = out.groupBy("model", "split", "id").agg(F.avg("p").alias("p"))
    return mean.select(F.lit(config).alias("config"), F.lit(seed).alias("seed"), "model", "split", "id", "p")


def holdout_scores(df: DataFrame, experts: Mapping[str, Expert]) -> DataFrame:
    """All experts fitted on part A score part B."""
    a, b = df.where("part = 'A'"), df.where("part = 'B'")
    parts = [e(a, b).withColumn("model", F.lit(n)) for n, e in experts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "id", "p")


def stacked_text(df: DataFrame, series: Mapping[str, Expert], k: int = 3, inner: int = 3) -> DataFrame:
    """``(outer, id, part, <series>...)``: text scores for every outer fold, from inner folds for its training rows
    and from all its training rows for its validation rows. ``df`` has id, y, fold and the texts."""
    df = cut(df)
    folds = df.select(F.lit(0).alias("seed"), "id", "y", "fold")
    nested = cut(nested_folds(folds, k, inner).select("outer", F.col("id").alias("__id"), "inner"))
    jobs = [(o, i, s) for o in range(k) for i in [*range(inner), None] for s in series]

    def one(job):
        o, i, s = job
        train = df.where(F.col("fold") != o)
        if i is None:
            return series[s](train, df.where(F.col("fold") == o)).select(F.lit(o).alias("outer"), "id", F.lit("valid").alias("part"), F.lit(s).alias("series"), "p")
        placed = train.join(nested.where(F.col("outer") == o).select("__id", "inner"), F.col("id") == F.col("__id")).drop("__id")
        return series[s](placed.where(F.col("inner") != i), placed.where(F.col("inner") == i)).select(F.lit(o).alias("outer"), "id", F.lit("train").alias("part"), F.lit(s).alias("series"), "p")

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("outer", "id", "part").pivot("series", list(series)).agg(F.first("p"))


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Gain of each column of a fitted tree model."""
    v = model.featureImportances
    return [(n, float(v[i])) for i, n in enumerate(names)]


def fold_importances(df: DataFrame, numeric: Sequence[str], k: int = 3) -> DataFrame:
    """``(column, gain)`` averaged over the folds' tree models, which are fitted from a few threads."""

    def one(f: int) -> list[tuple[str, float]]:
        a, _ = _assembled(df.where(F.col("fold") != f), df.limit(1), numeric, (), False)
        return importances(GBTClassifier(featuresCol="x", labelCol="y", maxIter=10, maxDepth=3, seed=7).fit(a), numeric)

    with ThreadPoolExecutor(4) as pool:
        rows = [r for part in pool.map(one, range(k)) for r in part]
    return df.sparkSession.createDataFrame(rows, "column string, gain double").groupBy("column").agg(F.avg("gain").alias("gain"))


def error_probability(df: DataFrame, label: str, features: Sequence[str], k: int = 3, c: float = 1.0) -> DataFrame:
    """``(id, p)``: out-of-fold probability that a label is wrong; both classes weigh the same."""
    rows = df.withColumn("__wrong", (F.col(label) != F.col("y")).cast("int")).withColumn("y", F.col("__wrong"))
    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    w = F.when(F.col("y") == 1, n["n"] / (2.0 * max(1, n["pos"] or 0))).otherwise(n["n"] / (2.0 * max(1, n["n"] - (n["pos"] or 0))))
    rows = rows.withColumn("__w", w)
    parts = [linear_expert(features, c=c, weight="__w")(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)) for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffled_error_auc(df: DataFrame, label: str, features: Sequence[str], replicates: int = 10, k: int = 3, seed: int = 0) -> DataFrame:
    """``(rep, auc)``: the AUC of the error classifier, fitted again for every replicate, when errors are permuted.

    Replicate -1 is the real one. A baseline of what the classifier finds where there is nothing to find.
    """
    rows = cut(df.withColumn("__wrong", (F.col(label) != F.col("y")).cast("int")))
    mixed = cut(permuted_labels(rows.select("id", "__wrong"), "id", "__wrong", replicates, seed).select("rep", F.col("id").alias("__id"), F.col("__wrong").alias("__new")))

    def one(rep):
        here = rows
        if rep >= 0:
            here = rows.drop("__wrong").join(mixed.where(F.col("rep") == rep), F.col("id") == F.col("__id")).withColumn("__wrong", F.col("__new")).drop("rep", "__id", "__new")
        real = here.withColumns({"y": F.lit(0), "__label": F.col("__wrong")})
        scores = error_probability(real, "__label", features, k)
        return auc_ap(cut(scores.join(here.select("id", F.col("__wrong").alias("y")), "id"))).select(F.lit(rep).alias("rep"), "auc")

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, range(-1, replicates)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ridge_residual(df: DataFrame, residual: str, features: Sequence[str], alpha: float = 10.0, k: int = 3) -> DataFrame:
    """``(id, guess)``: out-of-fold ridge regression of a signed residual: squares plus ``alpha`` times those of the coefficients."""
    parts = []
    for f in range(k):
        a, b = _assembled(df.where(F.col("fold") != f), df.where(F.col("fold") == f), features, (), True)
        n, spread = a.agg(F.count("*"), F.stddev_pop(residual)).first()
        # MLlib divides the penalty by the deviation of the label
        lr = LinearRegression(featuresCol="x", labelCol=residual, regParam=alpha * float(spread or 0.0) / max(1, n), elasticNetParam=0.0, standardization=False, solver="normal")
        parts.append(lr.fit(a).transform(b).select("id", F.col("prediction").alias("guess")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def offset_correction(train: DataFrame, other: DataFrame, base: str, features: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """``(id, p)``: the base logit, its coefficient fixed at one, plus a penalised correction."""
    a, b = _assembled(train, other, features, (), True)
    a, b = a.withColumn("__off", logit(base)), b.withColumn("__off", logit(base))
    m = GeneralizedLinearRegression(featuresCol="x", labelCol="y", family="binomial", link="logit", offsetCol="__off", regParam=2 * alpha, maxIter=50).fit(a)
    z = F.col("__off") + float(m.intercept)
    for i, w in enumerate(m.coefficients):
        z = z + float(w) * vector_to_array("x")[i]
    return b.select("id", sigmoid(z).alias("p"))


def screened_crosses(df: DataFrame, candidates: Sequence[str], fold: str = "inner", strength: float = 10.0) -> DataFrame:
    """``(cross, ap)``: the average precision of each categorical column alone, by the target rates of its cells out of fold.

    All candidates are screened in one job: rows collapse to counts by (column, cell, fold) before anything is shuffled,
    a cell's rate comes from the other folds, drawn to the target rate of these by ``strength`` rows, and the precision
    from the counts. A missing value is a cell. Rows without a label don't count.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("cross"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("cell")) for c in candidates]))
    long = df.where("y is not null").select(F.col(fold).alias("fold"), F.col("y").cast("long").alias("y"), cells.alias("x")).select("fold", "y", "x.*")
    g = cut(long.groupBy("cross", "cell", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    cell, whole = Window.partitionBy("cross", "cell"), Window.partitionBy("cross")  # over counts, one row a fold
    totals = g.groupBy("cross", "fold").agg(F.sum("n").alias("fn"), F.sum("pos").alias("fp"))
    totals = totals.withColumns({"rn": F.sum("fn").over(whole) - F.col("fn"), "rp": F.sum("fp").over(whole) - F.col("fp")}).select("cross", "fold", "rn", "rp")
    g = g.withColumns({"on": F.sum("n").over(cell) - F.col("n"), "op": F.sum("pos").over(cell) - F.col("pos")}).join(totals, ["cross", "fold"])
    rate = F.coalesce(F.try_divide(F.col("rp").cast("double"), F.col("rn").cast("double")), F.lit(0.0))
    scored = g.withColumn("p", (F.col("op") + strength * rate) / (F.col("on") + strength))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("w"))))
    return auc_ap(scored.select("cross", "p", sides.alias("s")).select("cross", "p", "s.*").where("w > 0"), ["cross"], weight="w").select("cross", "ap")


def select_crosses(df: DataFrame, candidates: Sequence[str], most: int = 20, min_gain: float = 0.001, fold: str = "inner", k: int = 3, base: Sequence[str] = (), screen: int | None = None, base_categorical: Sequence[str] = ()) -> list[str]:
    """Crosses (categorical columns) that raise the inner AP of a one-hot model with the base columns.

    All are tried alone, or only the ``screen`` best of ``screened_crosses``, if given; each round then tries every one
    that is left beside those chosen and takes the best, until it gains less than ``min_gain``. Without base columns the
    start is the target rate.
    """

    def ap(cols):
        if not (base or base_categorical or cols):
            return df.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
        parts = [linear_expert(base, [*base_categorical, *cols])(df.where(F.col(fold) != f), df.where(F.col(fold) == f)) for f in range(k)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return auc_ap(cut(out.join(df.select("id", "y"), "id"))).first()["ap"] or 0.0

    df = cut(df)
    if screen is not None and screen < len(candidates):
        candidates = [r["cross"] for r in screened_crosses(df, candidates, fold).orderBy(F.col("ap").desc_nulls_last(), "cross").limit(screen).collect()]
    best, chosen = ap([]), []
    with ThreadPoolExecutor(4) as pool:
        tried = dict(zip(candidates, pool.map(lambda c: ap([c]), candidates), strict=True))
        left = sorted(candidates, key=lambda c: (-tried[c], c))
        while left and len(chosen) < most:
            if chosen:
                tried = dict(zip(left, pool.map(lambda c: ap([*chosen, c]), left), strict=True))
            c = max(left, key=lambda c: (tried[c], c))
            if tried[c] - best < min_gain:
                break
            best = tried[c]
            chosen.append(c)
            left.remove(c)
    return chosen


def adversarial_auc(df: DataFrame, part: str, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 3) -> DataFrame:
    """AUC, out of fold, of telling two parts apart by their columns; ``df`` has id and fold."""
    rows = df.withColumn("y", F.col(part))
    parts = [linear_expert(numeric, categorical)(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)) for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return auc_ap(cut(out.join(rows.select("id", "y"), "id"))).select("auc")


def topic_table(df: DataFrame, terms: Column, k: int = 5, y: str = "y", sweeps: int = 8, min_df: int = 2, max_share: float = 0.9) -> DataFrame:
    """Size and target rate of the main topics: non-negative factors of TF-IDF on the whole vocabulary."""
    from foldspan.operators.explore import group_rates

    left, right, _ = factored_rows(*tfidf_rows(df, "id", terms, min_df, max_share), k, sweeps)
    return group_rates(main_factor(left, right, k).join(df.select("id", y), "id"), "topic", y)


def cluster_table(df: DataFrame, terms: Column, k: int = 8, dims: int = 10, y: str = "y", seed: int = 1, min_df: int = 2, max_share: float = 0.9) -> DataFrame:
    """Size, target rate and lift of k-means clusters of the leading singular vectors of TF-IDF, on the whole vocabulary."""
    from pyspark.ml.clustering import KMeans

    from foldspan.operators.explore import group_rates

    low, _ = singular_products(df, *tfidf_rows(df, "id", terms, min_df, max_share), dims)
    low = cut(low).withColumn("low", array_to_vector("low"))
    out = KMeans(k=k, seed=seed, featuresCol="low", predictionCol="cluster").fit(low).transform(low).select("id", "cluster")
    return group_rates(out.join(df.select("id", y), "id"), "cluster", y)
