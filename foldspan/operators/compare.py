"""Paired comparisons, correlations and diagnostics of runs; long score tables ``(config, seed, metric, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.operators.metrics import auc_ap
from foldspan.operators.ranks import average_ranks, column_percentiles, exact_percentiles

#: Shares of seeds that must gain, least mean gain of AP, largest mean loss of F1 (fixed values).
AUC_SHARE, AP_SHARE, AP_GAIN, F1_LOSS = 0.70, 0.75, 0.005, -0.002


def spearman_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, a, b, rho)`` for the pairs of columns: correlations of average ranks."""
    for c in cols:
        df = average_ranks(df, list(by), c, f"__r_{c}")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.groupBy(*by).agg(*[F.corr(f"__r_{a}", f"__r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("x")).select(*by, "x.*")


def mean_rank_correlation(df: DataFrame, a: str, b: str, seed: str = "seed") -> DataFrame:
    return spearman_matrix(df, [a, b], [seed]).agg(F.avg("rho").alias("rho"))


def paired_deltas(scores: DataFrame, base: str, cand: str) -> DataFrame:
    """By metric: mean, sample deviation, number positive, lowest and highest of the differences at equal seeds."""
    b = scores.where(F.col("config") == base).select("seed", "metric", F.col("value").alias("b"))
    c = scores.where(F.col("config") == cand).select("seed", "metric", F.col("value").alias("c"))
    d = F.col("c") - F.col("b")
    return b.join(c, ["seed", "metric"]).groupBy("metric").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count_if(d > 0).alias("n_positive"), F.min(d).alias("min"), F.max(d).alias("max"))


def verdict(deltas: DataFrame) -> DataFrame:
    """One row: ACCEPT, PARK or REJECT.

    REJECT if the mean F1 falls by more than allowed, or neither share of gaining seeds is reached; ACCEPT if both
    are and the mean AP gains enough; PARK otherwise.
    """
    of = lambda m, v: F.max(F.when(F.col("metric") == m, v))
    share = F.col("n_positive") / F.col("n")
    w = deltas.agg(of("auc", share).alias("auc_share"), of("ap", share).alias("ap_share"), of("ap", F.col("mean")).alias("ap_gain"), of("f1", F.col("mean")).alias("f1_gain"))
    auc, ap = F.col("auc_share") >= AUC_SHARE, F.col("ap_share") >= AP_SHARE
    return w.withColumn("verdict", F.when((F.col("f1_gain") < F1_LOSS) | (~auc & ~ap), "REJECT").when(auc & ap & (F.col("ap_gain") >= AP_GAIN), "ACCEPT").otherwise("PARK"))


def correlation_gate(correlation: DataFrame, limit: float = 0.95) -> DataFrame:
    return correlation.withColumn("gate", F.when(F.col("rho") >= limit, "REJECT").otherwise("PASS"))


def paired_pivot(scores: DataFrame, configs: Sequence[str], base: str) -> DataFrame:
    """``(seed, metric, <config>..., <config>_delta...)``."""
    w = scores.groupBy("seed", "metric").pivot("config", list(configs)).agg(F.first("value"))
    return w.withColumns({f"{c}_delta": F.col(c) - F.col(base) for c in configs if c != base})


def unpivoted(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*keep, "x.*")


def column_signal(df: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    """By column: coverage, AUC and AP in the better direction, AP over the base rate."""
    long = unpivoted(df, cols, [y])
    cover = long.groupBy("column").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"))
    both = long.where("v is not null").withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("p", F.col("v") * F.col("sign"))
    m = auc_ap(both, ["column", "sign"], y, "p").groupBy("column").agg(F.max("auc").alias("auc"), F.max("ap").alias("ap"), F.max(F.col("n_pos") / F.col("n")).alias("rate"))
    return cover.join(m, "column", "left").withColumn("ap_lift", F.try_divide(F.col("ap"), F.col("rate"))).drop("rate")


def max_rank_correlation(df: DataFrame, new: Sequence[str], old: Sequence[str], id_col: str) -> DataFrame:
    """For each new column the old one of highest absolute rank correlation, over rows that have both."""
    long = unpivoted(df, [*new, *old], [id_col])
    ranked = average_ranks(long, ["column"], "v", "r")
    a = ranked.where(F.col("column").isin(list(new))).select(id_col, F.col("column").alias("new"), F.col("r").alias("ra"))
    b = ranked.where(F.col("column").isin(list(old))).select(id_col, F.col("column").alias("old"), F.col("r").alias("rb"))
    rho = a.join(b, id_col).groupBy("new", "old").agg(F.abs(F.corr("ra", "rb")).alias("rho"))
    return rho.groupBy("new").agg(F.max("rho").alias("max_rho"), F.max_by("old", F.struct("rho", "old")).alias("closest"))


def quadrants(df: DataFrame, a: str, b: str, y: str = "y") -> DataFrame:
    """One row: rates of the four median-split cells, and the excess of the last over what the other three add up to."""
    m = column_percentiles(df, [a, b], [0.5]).select(F.col("q0")[0].alias("ma"), F.col("q1")[0].alias("mb"))
    ha, hb = (F.col(a) > F.col("ma")).cast("int"), (F.col(b) > F.col("mb")).cast("int")
    rate = lambda i, k: F.avg(F.when((ha == i) & (hb == k), F.col(y).cast("double"))).alias(f"r{i}{k}")
    out = df.crossJoin(F.broadcast(m)).agg(*[rate(i, k) for i in (0, 1) for k in (0, 1)])
    return out.withColumn("excess", F.col("r11") - F.col("r10") - F.col("r01") + F.col("r00"))


def stability(df: DataFrame, cols: Sequence[str], part: str) -> DataFrame:
    """By column and part: share missing, mean, and the 10th, 50th and 90th percentile."""
    long = unpivoted(df, cols, [part])
    q = exact_percentiles(long, ["column", part], "v", [0.1, 0.5, 0.9], "q").select(F.col("column").alias("__c"), F.col(part).alias("__p"), "q")
    out = long.groupBy("column", part).agg(F.avg(F.col("v").isNull().cast("double")).alias("missing"), F.avg("v").alias("mean"))
    out = out.join(q, (F.col("column") == F.col("__c")) & F.col(part).eqNullSafe(F.col("__p")), "left")
    return out.select("column", part, "missing", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def selection_stability(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``(fold, item)``: Jaccard of each two folds, and how often each item is selected."""
    sets = selected.groupBy("fold").agg(F.collect_set("item").alias("s"))
    a, b = sets.select(F.col("fold").alias("a"), F.col("s").alias("sa")), sets.select(F.col("fold").alias("b"), F.col("s").alias("sb"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("jaccard"))
    return pairs, selected.groupBy("item").agg(F.count_distinct("fold").alias("n_folds"))


def weight_cosines(weights: DataFrame) -> DataFrame:
    """From ``(fold, model, w)``: cosine of the weight vectors of each two folds."""
    norm = weights.groupBy("fold").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = weights.join(norm, "fold")
    a, b = w.select(F.col("fold").alias("a"), "model", F.col("w").alias("wa"), F.col("norm").alias("na")), w.select(F.col("fold").alias("b"), "model", F.col("w").alias("wb"), F.col("norm").alias("nb"))
    return a.join(b, "model").where("a < b").groupBy("a", "b").agg((F.sum(F.col("wa") * F.col("wb")) / (F.first("na") * F.first("nb"))).alias("cosine"))


def error_by_group(df: DataFrame, group: str, y: str, label: str, least: int = 8) -> DataFrame:
    wrong = (F.col(y) != F.col(label)).cast("double")
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(wrong).alias("error_rate"), F.count_if((F.col(y) == 1) & (F.col(label) == 0)).alias("n_fn"), F.count_if((F.col(y) == 0) & (F.col(label) == 1)).alias("n_fp"))
    return out.where(F.col("n") >= least)


def means_by_class(df: DataFrame, kind: Column, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in cols])


def top_errors(df: DataFrame, kind: Column, p: str, t: float, id_col: str, n: int) -> DataFrame:
    """The ``n`` most confident rows of each error class; the engine keeps ``n`` rows of a class in each task."""
    rows = df.withColumn("kind", kind).withColumn("confidence", F.abs(F.col(p) - t))
    w = Window.partitionBy("kind").orderBy(F.col("confidence").desc(), id_col)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("kind", "place", id_col, "confidence")


def drift(a: DataFrame, b: DataFrame, p: str = "p", t: float = 0.5, ok: float = 1e-9, fail: float = 1e-6) -> DataFrame:
    """One row: ids on either side only, largest difference, label differences and a graded verdict."""
    x = a.select(F.col("id").alias("__a"), F.col(p).alias("pa")).join(b.select(F.col("id").alias("__b"), F.col(p).alias("pb")), F.col("__a") == F.col("__b"), "full")
    out = x.agg(F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("n_unmatched"), F.coalesce(F.max(F.abs(F.col("pa") - F.col("pb"))), F.lit(0.0)).alias("max_diff"), F.count_if((F.col("pa") >= t) != (F.col("pb") >= t)).alias("n_label_diff"))
    return out.withColumn("grade", F.when((F.col("n_unmatched") > 0) | (F.col("n_label_diff") > 0) | (F.col("max_diff") > fail), "FAIL").when(F.col("max_diff") <= ok, "OK").otherwise("WARN"))
