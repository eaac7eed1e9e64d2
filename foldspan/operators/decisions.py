"""Labels from scores: thresholds, budgets and swaps. Ties are broken by the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.operators.ranks import exact_percentiles, top_k


def at_threshold(p: Column, t) -> Column:
    return (p >= t).cast("int")


def rate_cut(df: DataFrame, p: str, rate: float) -> DataFrame:
    """One row: the score above which a share of ``rate`` lies, between scores by linear interpolation."""
    return exact_percentiles(df, [], p, [1 - rate]).select(F.col("edges")[0].alias("cut"))


def resolve_threshold(df: DataFrame, p: str, count: int | None = None, value: float | None = None) -> DataFrame:
    """One row ``cut``: the given value, or the score of the ``count``-th row from the top."""
    if value is not None:
        return df.sparkSession.range(1).select(F.lit(float(value)).alias("cut"))
    return top_k(df.select(F.col(p).alias("p")), [F.col("p").desc()], count).agg(F.min("p").alias("cut"))


def _marked(df: DataFrame, id_col: str, chosen: DataFrame, name: str) -> DataFrame:
    ids = chosen.select(F.col(id_col).alias("__id")).withColumn("__in", F.lit(1))
    return df.join(ids, F.col(id_col) == F.col("__id"), "left").withColumn(name, F.coalesce("__in", F.lit(0))).drop("__id", "__in")


def top_k_labels(df: DataFrame, id_col: str, p: str, k: int, out: str = "label") -> DataFrame:
    """Exactly ``k`` positives: the highest scores, of equal ones those with the larger ids."""
    return _marked(df, id_col, top_k(df.select(id_col, p), [F.col(p).desc(), F.col(id_col).desc()], k), out)


def boundary_band(df: DataFrame, id_col: str, p: str, t: float, k: int, out: str = "in_band") -> DataFrame:
    """The ``k`` lowest scores at or above the threshold and the ``k`` highest below it."""
    above = top_k(df.where(F.col(p) >= t).select(id_col, p), [F.col(p), F.col(id_col).desc()], k)
    below = top_k(df.where(F.col(p) < t).select(id_col, p), [F.col(p).desc(), F.col(id_col)], k)
    return _marked(df, id_col, above.unionByName(below), out)


def swapped_labels(df: DataFrame, id_col: str, p: str, support: str, t: float, m: int, width: int | None = None, out: str = "label") -> DataFrame:
    """Labels at the threshold, after the ``m`` best supported negatives and worst supported positives change places.

    ``m`` is capped by the rows of either class (the tops of both are bounded by it); with a ``width`` only the rows
    nearest to the threshold take part. The number of positives stays. Equal rows: the smaller id first.
    """
    label = at_threshold(F.col(p), t)
    rows = df.select(id_col, p, support).withColumn("__l", label)
    sides = []
    for side in (0, 1):
        part = rows.where(F.col("__l") == side)
        if width is not None:
            part = top_k(part, [F.abs(F.col(p) - t), F.col(id_col)], width)
        sides.append(top_k(part, [F.col(support).desc() if side == 0 else F.col(support), F.col(id_col)], m))
    # the same number from both sides: places in two lists of at most m rows
    add = sides[0].withColumn("__r", F.row_number().over(Window.orderBy(F.col(support).desc(), id_col)))
    drop = sides[1].withColumn("__r", F.row_number().over(Window.orderBy(F.col(support), id_col)))
    pairs = add.select(F.col(id_col).alias("a"), "__r").join(drop.select(F.col(id_col).alias("d"), "__r"), "__r")
    moved = pairs.select(F.explode(F.array("a", "d")).alias(id_col))
    marked = _marked(df, id_col, moved, "__moved")
    return marked.withColumn(out, F.when(F.col("__moved") == 1, 1 - label).otherwise(label)).drop("__moved")


def threshold_rules(oof: DataFrame, target: DataFrame, y: str, p: str, fold: str = "fold", grid=None) -> DataFrame:
    """``(rule, t)`` for oof_best, fold_mean, rate and half_f1, from out-of-fold scores only (rate: applied to ``target``)."""
    from foldspan.operators.metrics import GRID, best_threshold, f1_curve

    grid = grid or GRID
    best = best_threshold(f1_curve(oof, [], y, p, grid=grid))
    by_fold = best_threshold(f1_curve(oof, [fold], y, p, grid=grid), [fold])
    rate = oof.crossJoin(F.broadcast(best)).agg(F.avg((F.col(p) >= F.col("best_t")).cast("double"))).first()[0]
    cut = rate_cut(target, p, rate or 0.0).select(F.lit("rate").alias("rule"), F.col("cut").alias("t"))
    out = best.select(F.lit("oof_best").alias("rule"), F.col("best_t").alias("t"))
    out = out.unionByName(by_fold.agg(F.avg("best_t").alias("t")).select(F.lit("fold_mean").alias("rule"), "t"))
    return out.unionByName(cut).unionByName(best.select(F.lit("half_f1").alias("rule"), (F.col("best_f1") / 2).alias("t")))
