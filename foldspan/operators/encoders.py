"""Statistics fitted inside folds. A row's statistics leave out its own fold: totals minus that fold's share,
from one aggregate over (fold, key), never a scan for each fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.functions.rows import MISSING
from foldspan.operators.ranks import exact_percentiles


def target_encoding(df: DataFrame, cat: str, y: str, fold: str = "fold", m: float = 10.0, out_of_fold: bool = True) -> DataFrame:
    """``df`` with ``te``: the smoothed mean of ``y`` in the category, (n mean + m prior) / (n + m).

    Out of fold, statistics are those of the other folds, which is what keeps labels from leaking. Otherwise they
    are those of all rows, as for fitting on a training table that is encoded by its own labels. A category without
    rows in the statistics gets the prior; nulls are a category.
    """
    g = df.groupBy(F.col(fold).alias("__f"), F.coalesce(F.col(cat).cast("string"), F.lit(MISSING)).alias("__c")).agg(F.sum(y).cast("double").alias("__s"), F.count(y).alias("__n"))
    total = g.groupBy("__c").agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    folds = g.groupBy("__f").agg(F.sum("__s").alias("__fs"), F.sum("__n").alias("__fn"))
    grand = g.agg(F.sum("__s").alias("__gs"), F.sum("__n").alias("__gn"))
    key = F.coalesce(F.col(cat).cast("string"), F.lit(MISSING))
    own = lambda c: F.coalesce(c, F.lit(0)) if out_of_fold else F.lit(0)
    out = df.withColumn("__key", key).join(total.withColumnRenamed("__c", "__tc"), F.col("__key") == F.col("__tc"), "left")
    out = out.join(g, (F.col("__key") == F.col("__c")) & (F.col(fold) == F.col("__f")), "left").drop("__f").join(folds, F.col(fold) == F.col("__f"), "left").crossJoin(F.broadcast(grand))
    n, s = F.col("__tn") - own(F.col("__n")), F.col("__ts") - own(F.col("__s"))
    prior = F.try_divide(F.col("__gs") - own(F.col("__fs")), F.col("__gn") - own(F.col("__fn")))
    return out.withColumn("te", (s + m * prior) / (n + m)).drop("__key", "__tc", "__ts", "__tn", "__c", "__s", "__n", "__f", "__fs", "__fn", "__gs", "__gn")


def encode_new(train: DataFrame, other: DataFrame, cat: str, y: str, m: float = 10.0) -> DataFrame:
    """``other`` with ``te`` from the statistics of ``train``; unseen categories get the prior."""
    t = train.groupBy(F.coalesce(F.col(cat).cast("string"), F.lit(MISSING)).alias("__c")).agg(F.sum(y).cast("double").alias("__s"), F.count(y).alias("__n"))
    prior = train.agg(F.avg(F.col(y).cast("double")).alias("__p"))
    out = other.withColumn("__key", F.coalesce(F.col(cat).cast("string"), F.lit(MISSING))).join(t, F.col("__key") == F.col("__c"), "left").crossJoin(F.broadcast(prior))
    return out.withColumn("te", F.coalesce((F.col("__s") + m * F.col("__p")) / (F.col("__n") + m), F.col("__p"))).drop("__key", "__c", "__s", "__n", "__p")


def training_rows(df: DataFrame, fold: str = "fold", k: int = 5) -> DataFrame:
    """Every row once for each fold whose training part it is in: ``outer`` differs from its own fold."""
    return df.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col(fold) != F.col("outer"))


def fold_percentiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float], fold: str = "fold", k: int = 5, where: Column | None = None) -> DataFrame:
    """``(outer, column, edges)``: exact percentiles of each column over the training rows of each fold."""
    rows = training_rows(df if where is None else df.where(where), fold, k).select("outer", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    return exact_percentiles(rows.select("outer", "x.*"), ["outer", "column"], "v", shares)


def median_filled(df: DataFrame, cols: Sequence[str], fold: str = "fold", k: int = 5, second: float = 0.0, where: Column | None = None) -> DataFrame:
    """``df`` with nulls of ``cols`` filled by the median of the other folds, else by ``second``."""
    med = fold_percentiles(df, cols, (0.5,), fold, k, where).groupBy(F.col("outer").alias("__o")).agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("edges")[0]))).alias("__m"))
    out = df.join(F.broadcast(med), F.col(fold) == F.col("__o"), "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("__m")[c], F.lit(second)) for c in cols}).drop("__o", "__m")


def standardised(df: DataFrame, cols: Sequence[str], fold: str = "fold") -> DataFrame:
    """``df`` with ``cols`` over mean and population deviation of the other folds; a null becomes 0, a constant stays 0."""
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts += [F.count(c).alias(f"n_{c}"), F.sum(v).alias(f"s_{c}"), F.sum(v * v).alias(f"q_{c}")]
    g = df.groupBy(F.col(fold).alias("__f")).agg(*parts)
    total = g.agg(*[F.sum(f"{x}_{c}").alias(f"t{x}_{c}") for c in cols for x in "nsq"])
    g = g.crossJoin(total)  # folds x one row
    stats = {}
    for c in cols:
        n, s, q = (F.coalesce(F.col(f"t{x}_{c}") - F.coalesce(F.col(f"{x}_{c}"), F.lit(0)), F.lit(0)) for x in "nsq")
        mean = F.try_divide(s, n.cast("double"))
        stats |= {f"__m_{c}": mean, f"__d_{c}": F.sqrt(F.greatest(F.try_divide(q, n.cast("double")) - mean * mean, F.lit(0.0)))}
    fit = g.select("__f", *[v.alias(k) for k, v in stats.items()])
    out = df.join(F.broadcast(fit), F.col(fold) == F.col("__f"))
    scaled = {c: F.coalesce(F.when(F.col(f"__d_{c}") > 1e-9, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__d_{c}")), F.lit(0.0)) for c in cols}
    return out.withColumns(scaled).drop("__f", *stats)


def quantile_bins(df: DataFrame, cols: Sequence[str], shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8), fold: str = "fold", k: int = 5) -> DataFrame:
    """``df`` with ``<c>_bin``: how many distinct edges of the other folds are at or below the value; null: missing."""
    e = fold_percentiles(df, cols, shares, fold, k).groupBy(F.col("outer").alias("__o")).agg(F.map_from_entries(F.collect_list(F.struct("column", F.array_distinct("edges")))).alias("__e"))
    out = df.join(F.broadcast(e), F.col(fold) == F.col("__o"), "left")
    label = lambda c: F.coalesce(F.concat(F.lit("b"), F.size(F.filter(F.col("__e")[c], lambda x: x <= F.col(c))).cast("string")), F.lit(MISSING))
    return out.withColumns({f"{c}_bin": F.when(F.col(c).isNull(), MISSING).otherwise(label(c)) for c in cols}).drop("__o", "__e")


def crossed(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``axb`` columns of two categories, nulls as a level."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    return df.withColumns({f"{a}x{b}": F.concat_ws("||", level(a), level(b)) for a, b in pairs})


def spline_basis(df: DataFrame, col: str, knots: Sequence[float]) -> DataFrame:
    """``df`` with the quadratic truncated-power basis of a column: x, x², and (x - knot)₊² for each knot."""
    x = F.col(col).cast("double")
    basis = {f"{col}_s1": x, f"{col}_s2": x * x}
    return df.withColumns(basis | {f"{col}_k{i}": F.pow(F.greatest(x - k, F.lit(0.0)), 2) for i, k in enumerate(knots)})
