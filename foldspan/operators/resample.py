"""Bootstrap and permutation by hash-drawn weights and places: all replicates are one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.operators.folds import permuted_labels, poisson_weights
from foldspan.operators.metrics import GRID, auc_ap, best_threshold, f1_curve


def bootstrap_threshold(df: DataFrame, id_col: str = "id", y: str = "y", p: str = "p", replicates: int = 50, seed: int = 0, grid=GRID) -> DataFrame:
    """``(rep, best_f1, best_t)``: the best threshold of each weighted replicate."""
    rows = poisson_weights(df.select(id_col, y, p), id_col, replicates, seed)
    return best_threshold(f1_curve(rows, ["rep"], y, p, weight="w", grid=grid), ["rep"])


def bootstrap_auc_delta(df: DataFrame, a: str, b: str, id_col: str = "id", y: str = "y", replicates: int = 50, seed: int = 0) -> DataFrame:
    """One row: 2.5th, 50th, 97.5th percentile of the AUC difference, both scores on the same weights."""
    rows = poisson_weights(df.select(id_col, y, a, b), id_col, replicates, seed)
    long = rows.select("rep", y, "w", F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in (a, b)])).alias("x")).select("rep", y, "w", "x.*")
    m = auc_ap(long, ["rep", "model"], y, "p", weight="w").groupBy("rep").agg((F.max(F.when(F.col("model") == b, F.col("auc"))) - F.max(F.when(F.col("model") == a, F.col("auc")))).alias("d"))
    q = m.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.avg((F.col("d") > 0).cast("double")).alias("share_positive"))
    return q.select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"), "share_positive")


def permutation_auc(df: DataFrame, id_col: str = "id", y: str = "y", p: str = "p", replicates: int = 50, seed: int = 0) -> DataFrame:
    """One row: the AUC, mean and deviation of the AUC under permuted labels, and the share of those at least as high."""
    null = auc_ap(permuted_labels(df.select(id_col, y, p), id_col, y, replicates, seed), ["rep"], y, p)
    real = auc_ap(df, [], y, p).select(F.col("auc").alias("real"))
    return null.crossJoin(F.broadcast(real)).agg(F.first("real").alias("auc"), F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_sd"), ((F.count_if(F.col("auc") >= F.col("real")) + 1) / (F.count("*") + 1.0)).alias("p_value"))
