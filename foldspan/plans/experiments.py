"""Registries of features, and the comparisons of a candidate with a baseline."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.functions import rows
from foldspan.operators.blends import fit_meta, select_alpha, wide
from foldspan.operators.compare import paired_deltas, verdict
from foldspan.operators.decisions import threshold_rules
from foldspan.operators.encoders import target_encoding
from foldspan.operators.folds import stratified_folds, stratified_holdout
from foldspan.operators.metrics import auc_ap, f1_of_labels, metric_table
from foldspan.operators.models import Expert, holdout_scores, out_of_fold
from foldspan.plans.lineage import cut

Feature = Callable[[DataFrame], DataFrame]

#: Features of a row alone, and features that are fitted inside folds.
FEATURES: dict[str, Feature] = {f.__name__: f for f in (rows.margins, rows.solvency, rows.per_head, rows.finance_ratios, rows.cash_slack, rows.survey_shape, rows.survey_steps, rows.survey_gaps, rows.need_gap, rows.intent_gap, rows.cross_features, rows.affordability)}
FOLD_FEATURES: dict[str, Feature] = {"industry_te": lambda df: target_encoding(df, "industry", "y")}


def composed(names: Sequence[str]) -> Feature:
    """The named features, one after another."""
    return lambda df: reduce(DataFrame.transform, [FEATURES[n] if n in FEATURES else FOLD_FEATURES[n] for n in names], df)


def build_matrices(train: DataFrame, test: DataFrame, names: Sequence[str], key: str = "id", y: str = "y", drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables with the features; the test table has the training table's columns, in order, without the target."""
    a, b = (composed(names)(d).drop(*drop) for d in (train, test))
    return a, b.select(*[c for c in a.columns if c != y])


def repeated_scores(df: DataFrame, expert: Expert, seeds: Sequence[int], config: str, k: int = 5) -> DataFrame:
    """``(config, seed, metric, value)`` of repeated cross-validation; folds of all seeds come from one table."""
    folds = cut(stratified_folds(df, "id", "y", seeds, k).select("seed", "id", "fold"))
    parts = []
    for s in seeds:
        f = folds.where(F.col("seed") == s).select(F.col("id").alias("__f"), "fold")
        placed = cut(df.drop("fold").join(f, F.col("id") == F.col("__f")).drop("__f"))
        p = out_of_fold(placed, {config: expert}, k, s, config)
        parts.append(p.select("seed", "id", "p"))
    preds = cut(reduce(DataFrame.unionByName, parts).join(df.select("id", "y"), "id"))
    m = metric_table(preds, ["seed"])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in (("auc", "auc"), ("ap", "ap"), ("f1", "best_f1"))]))
    return m.select(F.lit(config).alias("config"), "seed", cells.alias("x")).select("config", "seed", "x.*")


def setting_lab(df: DataFrame, settings: Mapping[str, Expert], seeds: Sequence[int], k: int = 3) -> DataFrame:
    """``(config, metric, mean, sd)``: every text setting by repeated cross-validation, over its seeds."""
    parts = [repeated_scores(df, expert, seeds, name, k) for name, expert in settings.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("config", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def judge(base: DataFrame, cand: DataFrame, base_name: str, cand_name: str) -> DataFrame:
    return verdict(paired_deltas(base.unionByName(cand), base_name, cand_name))


def holdout_run(df: DataFrame, experts: Mapping[str, Expert], share: float = 0.35, seed: int = 0, k: int = 3) -> DataFrame:
    """One repetition: scores on A out of fold, weights and thresholds from A only, metrics on B.

    ``(rule, t, f1, auc, ap)`` of the blend on B.
    """
    parts = stratified_holdout(df, "id", "y", share, seed).select(F.col("id").alias("__p"), "part")
    df = df.drop("part", "fold").join(parts, F.col("id") == F.col("__p")).drop("__p")
    df = cut(df)
    a = df.where("part = 'A'")
    f = stratified_folds(a, "id", "y", [seed], k).select(F.col("id").alias("__f"), "fold")
    a = cut(a.join(f, F.col("id") == F.col("__f")).drop("__f"))
    names = list(experts)
    oof = cut(wide(out_of_fold(a, experts, k, seed).select("seed", "model", "id", "p"), names).join(a.select("id", "y", "fold"), "id"))
    alpha = select_alpha(oof, names, "y", "fold", k)
    meta = fit_meta(oof, names, "y", alpha)
    b = cut(meta.apply(wide(holdout_scores(df, experts).withColumn("seed", F.lit(seed)), names)).join(df.select("id", "y"), "id"))
    rules = threshold_rules(meta.apply(oof), b, "y", "p")
    scored = b.crossJoin(F.broadcast(cut(rules))).withColumn("l", (F.col("p") >= F.col("t")).cast("int"))
    return f1_of_labels(scored, F.col("l"), "y", ["rule", "t"]).crossJoin(F.broadcast(auc_ap(b).select("auc", "ap")))
