"""Exact evaluation of scores against 0/1 labels, for any number of models and seeds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.operators.ranks import prefix_sums

#: Thresholds 0.02, 0.03, ... 0.98.
GRID = (0.02, 0.01, 97)


def score_steps(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """For each distinct score, highest first: rows, positives, and their sums down to that score."""
    w = F.col(weight) if weight else F.lit(1)
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("p"))
    g = g.agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"))
    return prefix_sums(g, by, "p", ["n", "pos"], descending=True)


def auc_ap(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """``auc`` (ties a half) and ``ap`` (steps, not interpolated); null without rows of both labels."""
    s = score_steps(df, by, y, p, weight)
    neg = F.col("n") - F.col("pos")
    out = s.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("n_pos"),
        F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("pairs"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n").cast("double")).alias("steps"),
    )
    return out.select(*by, "n", "n_pos", F.try_divide(F.col("pairs"), (F.col("n_pos") * (F.col("n") - F.col("n_pos"))).cast("double")).alias("auc"), F.try_divide(F.col("steps"), F.col("n_pos").cast("double")).alias("ap"))


def threshold(step: Column, grid=GRID) -> Column:
    return F.lit(grid[0]) + step * F.lit(grid[1])


def f1(tp: Column, predicted: Column, positives: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, (predicted + positives).cast("double")), F.lit(0.0))


def grid_step(p: Column, grid=GRID) -> Column:
    """The step of the highest threshold that a score reaches, -1 below the first."""
    near = F.floor((p - grid[0]) / grid[1]).cast("int")
    # the division may be off by one step; the comparison with the threshold decides
    step = F.when(p >= threshold(near + 1, grid), near + 1).when(p < threshold(near, grid), near - 1).otherwise(near)
    return F.least(F.greatest(step, F.lit(-1)), F.lit(grid[2] - 1))


def f1_curve(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", weight: str | None = None, grid=GRID) -> DataFrame:
    """``(by, step, t, f1)`` for every threshold of the grid.

    A row is counted once, in the step of the highest threshold that it reaches; sums from the top then run over the
    steps, of which there are as many as thresholds.
    """
    w = F.col(weight) if weight else F.lit(1)
    step = grid_step(F.col(p), grid)
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, step.alias("step")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"))
    totals = g.groupBy(*by).agg(F.sum("pos").alias("positives"))
    every = totals.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(grid[2] - 1))))
    full = every.join(g, [*by, "step"], "left")
    down = Window.partitionBy(*by).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"tp": F.coalesce(F.sum("pos").over(down), F.lit(0)), "predicted": F.coalesce(F.sum("n").over(down), F.lit(0))})
    return full.select(*by, "step", threshold(F.col("step"), grid).alias("t"), f1(F.col("tp"), F.col("predicted"), F.col("positives")).alias("f1"))


def best_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best F1 and the lowest threshold that reaches it."""
    best = F.max(F.struct("f1", (-F.col("step")).alias("s"), "t"))
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.f1").alias("best_f1"), F.col("b.t").alias("best_t"))


def log_loss(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", eps: float = 1e-15) -> DataFrame:
    c = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*by).agg(F.avg(-F.when(F.col(y) == 1, F.log(c)).otherwise(F.log(1 - c))).alias("log_loss"))


def metric_table(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", grid=GRID) -> DataFrame:
    """auc, ap, best F1 with its threshold, and log loss of every group."""
    keys = list(by)
    return auc_ap(df, by, y, p).join(best_threshold(f1_curve(df, by, y, p, grid=grid), by), keys).join(log_loss(df, by, y, p), keys)


def threshold_analysis(df: DataFrame, seed: str = "seed", y: str = "y", p: str = "p", tolerance: float = 0.002, grid=GRID) -> DataFrame:
    """One row: the threshold of the mean curve, its plateau, F1 at thresholds of the other seeds, bias, rate.

    Everything after the curves runs on seeds x thresholds.
    """
    curve = f1_curve(df, [seed], y, p, grid=grid)
    seeds = F.col("seeds")
    mean = curve.groupBy("step", "t").agg(F.avg("f1").alias("mean_f1"), F.sum("f1").alias("sum_f1"), F.count("*").alias("seeds"))
    top = mean.agg(F.max(F.struct("mean_f1", (-F.col("step")).alias("s"), "t")).alias("b")).select(F.col("b.mean_f1").alias("f1_insample"), F.col("b.t").alias("th_star"))
    flat = mean.crossJoin(F.broadcast(top)).where(F.col("mean_f1") >= F.col("f1_insample") - tolerance).agg(F.min("t").alias("plateau_lo"), F.max("t").alias("plateau_hi"))
    others = curve.join(mean, ["step", "t"]).withColumn("rest", F.when(seeds > 1, (F.col("sum_f1") - F.col("f1")) / (seeds - 1)).otherwise(F.col("mean_f1")))
    loso = others.groupBy(seed).agg(F.max_by("f1", F.struct(F.round("rest", 12), (-F.col("step")).alias("s"))).alias("f1"))
    loso = loso.agg(F.avg("f1").alias("f1_loso"), F.stddev_pop("f1").alias("f1_loso_sd"))
    rates = df.crossJoin(F.broadcast(top)).groupBy(seed).agg(F.avg((F.col(p) >= F.col("th_star")).cast("double")).alias("r")).agg(F.avg("r").alias("rate"), F.stddev_pop("r").alias("rate_sd"))
    base = df.agg(F.avg(F.col(y).cast("double")).alias("base_rate"))
    out = top
    for part in (flat, loso, rates, base):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumns({"selection_bias": F.col("f1_insample") - F.col("f1_loso"), "calibrated_at": F.col("f1_insample") / 2})


def fold_threshold_sd(df: DataFrame, seed: str = "seed", fold: str = "fold", y: str = "y", p: str = "p", grid=GRID) -> DataFrame:
    best = best_threshold(f1_curve(df, [seed, fold], y, p, grid=grid), [seed, fold])
    return best.groupBy(seed).agg(F.stddev_pop("best_t").alias("threshold_sd"))


def label_disagreement(df: DataFrame, a: str, b: str, seed: str = "seed", y: str = "y", grid=GRID) -> DataFrame:
    """Rows that two scores label differently, each at its own best threshold, and which of them is right."""
    for c in (a, b):
        best = best_threshold(f1_curve(df, [seed], y, c, grid=grid), [seed]).select(F.col(seed).alias("__s"), F.col("best_t").alias(f"__t_{c}"))
        df = df.join(F.broadcast(best), F.col(seed) == F.col("__s")).drop("__s")
    la, lb = F.col(a) >= F.col(f"__t_{a}"), F.col(b) >= F.col(f"__t_{b}")
    return df.groupBy(seed).agg(F.count_if(la != lb).alias("n_differ"), F.count_if((la != lb) & (la.cast("int") == F.col(y))).alias("first_right"), F.count_if((la != lb) & (lb.cast("int") == F.col(y))).alias("second_right"))


def confusion_class(y: Column, label: Column) -> Column:
    return F.when((y == 1) & (label == 1), "TP").when((y == 0) & (label == 1), "FP").when((y == 1) & (label == 0), "FN").when((y == 0) & (label == 0), "TN")


def error_changes(df: DataFrame, base: str, cand: str, y: str = "y") -> DataFrame:
    b, c, t = F.col(base), F.col(cand), F.col(y)
    return df.agg(
        F.count_if((t == 1) & (b == 0) & (c == 1)).alias("rescued"),
        F.count_if((t == 1) & (b == 1) & (c == 0)).alias("new_fn"),
        F.count_if((t == 0) & (b == 1) & (c == 0)).alias("removed_fp"),
        F.count_if((t == 0) & (b == 0) & (c == 1)).alias("new_fp"),
        F.count_if(b != c).alias("n_differ"),
    )


def label_transitions(df: DataFrame, base: str, cand: str, y: str = "y") -> DataFrame:
    """Numbers of rows by move (0→1, 1→0) and truth."""
    moved = df.where(F.col(base) != F.col(cand))
    return moved.groupBy(F.concat_ws("->", F.col(base).cast("string"), F.col(cand).cast("string")).alias("move"), F.col(y).alias("truth")).agg(F.count("*").alias("n"))


def f1_of_labels(df: DataFrame, label: Column, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(f1(F.sum(label * F.col(y)), F.sum(label), F.sum(y)).alias("f1"))


def ceiling_f1(df: DataFrame, label: str, in_band: Column, y: str = "y") -> DataFrame:
    """F1 if every row of a band were labelled right."""
    return f1_of_labels(df, F.when(in_band, F.col(y)).otherwise(F.col(label)), y).withColumnRenamed("f1", "ceiling_f1")


def r_squared(df: DataFrame, truth: str, guess: str) -> DataFrame:
    t, g = F.col(truth), F.col(guess)
    return df.agg((1 - F.try_divide(F.sum((t - g) * (t - g)), F.var_pop(t) * F.count(t))).alias("r2"))
