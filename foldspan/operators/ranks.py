"""Prefix sums, ranks and top-k over whole tables without moving all rows to one task.

``Window.orderBy`` without a partition is one task. Here rows with equal values collapse first, values fall into
ranges (bounds from a quantile sketch; they balance the work and don't change the result), sums of ranges are
scanned over as many rows as there are ranges, and a window works inside each range only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.plans.lineage import cut

#: Rows that a range is worth, and the most ranges that one sketch gives.
RANGE_ROWS, MOST_RANGES = 1 << 16, 1024


def value_range(df: DataFrame, col: str, ranges: int | None = None) -> Column:
    """The number of range bounds at or below a value; unless ``ranges`` is given, the row count decides how many."""
    if ranges is None:
        ranges = df.agg(F.count(col)).first()[0] // RANGE_ROWS
    if ranges < 2:
        return F.lit(0)  # no sketch for what one task sorts
    shares = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    found = df.agg(F.percentile_approx(col, shares, 10 * MOST_RANGES)).first()[0]
    step = -(-MOST_RANGES // min(MOST_RANGES, max(1, ranges)))
    bounds = sorted({float(b) for b in (found or [])[step - 1 :: step]})
    if not bounds:
        return F.lit(0)
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col(col)))
    literal = lambda values: F.array(*[F.lit(b) for b in values])
    width = math.isqrt(len(bounds)) + 1
    parts = [bounds[at : at + width] for at in range(0, len(bounds), width)]
    if len(parts) == 1:
        return below(literal(bounds))
    part = F.greatest(below(literal([p[0] for p in parts])) - 1, F.lit(0))  # the bounds themselves in two steps
    return part * width + below(F.get(F.array(*map(literal, parts)), part))


def prefix_sums(groups: DataFrame, by: Sequence[str], col: str, values: Sequence[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``groups`` with ``cum_<value>``: sums over the rows of the same ``by`` up to and including the row.

    ``groups`` has one row for each ``by`` and ``col``; null values of ``col`` must be gone. They are written once, as
    counting them, the sketch of the ranges, their sums and the windows each read them.
    """
    groups = cut(groups)
    rows = groups.withColumn("__range", value_range(groups, col, ranges))
    order = (lambda c: F.col(c).desc()) if descending else F.col
    totals = rows.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    over = Window.partitionBy(*by).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(b).alias(f"__k_{b}") for b in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t_{v}").over(over), F.lit(0)).alias(f"__s_{v}") for v in values])
    same = F.col("__range") == F.col("__r")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    inside = Window.partitionBy(*by, "__range").orderBy(order(col)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values}).join(starts, same)
    return out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"__s_{v}") for v in values}).drop("__range", "__r", *[f"__k_{b}" for b in by], *[f"__s_{v}" for v in values])


def average_ranks(df: DataFrame, by: Sequence[str], col: str, out: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with the 1-based average rank of ``col`` inside ``by``; a null value has a null rank."""
    g = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("__n"))
    g = prefix_sums(g, by, col, ["__n"], ranges=ranges)
    g = g.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col(col).alias("__v"), (F.col("cum___n") - (F.col("__n") - 1) / 2.0).alias(out))
    same = F.col(col) == F.col("__v")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    return df.join(g, same, "left").drop("__v", *[f"__b_{b}" for b in by])


def exact_percentiles(df: DataFrame, by: Sequence[str], col: str, shares: Sequence[float], out: str = "edges") -> DataFrame:
    """``by`` and ``out``: the exact percentiles of ``col``, between two values by linear interpolation.

    Equal values are counted first and places come from prefix sums, so that no task holds all values of a column.
    Nulls don't count. A group without a value has no row; without ``by`` there is one row, of nulls if need be.
    """
    g = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    upto = prefix_sums(g, by, "__v", ["__n"])
    size = g.groupBy(*[F.col(b).alias(f"__g_{b}") for b in by]).agg(F.sum("__n").alias("__size"))
    if by:
        same = F.lit(True)
        for b in by:
            same &= F.col(b).eqNullSafe(F.col(f"__g_{b}"))
        upto = upto.join(size, same)
    else:
        upto = upto.crossJoin(F.broadcast(size))  # one row
    at = [(F.col("__size") - 1) * F.lit(float(s)) for s in shares]
    ends = [[F.min(F.when(F.col("cum___n") > f(p), F.col("__v"))).alias(f"__{name}{i}") for name, f in (("lo", F.floor), ("hi", F.ceil))] for i, p in enumerate(at)]
    found = upto.groupBy(*by).agg(F.max("__size").alias("__size"), *[e for pair in ends for e in pair])

    def between(i: int, p: Column) -> Column:
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return found.select(*by, F.array(*[between(i, p) for i, p in enumerate(at)]).alias(out))


def column_percentiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row: for each column an array of its exact percentiles, null for a column without a value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    found = exact_percentiles(long, ["i"], "v", shares)
    return found.agg(*[F.max(F.when(F.col("i") == i, F.col("edges"))).alias(f"q{i}") for i in range(len(cols))])


def fold_percentiles(df: DataFrame, wanted: Sequence[tuple[str, float]], k: int, fold: str = "fold") -> list[dict[tuple[str, float], float | None]]:
    """For each of ``k`` folds the exact percentiles (column, share) over the rows of the other folds, as numbers; None for a column without a value.

    Those of all folds come from one count of equal values and one scan of its sums: of each column only the values at
    the places asked for reach the driver. Rows whose fold is null count nowhere.
    """
    cols = sorted({c for c, _ in wanted})
    if not cols:
        return [{} for _ in range(k)]
    outside = lambda f: F.col(fold) != f
    found = df.agg(*[F.count(F.when(outside(f), F.col(c))) for f in range(k) for c in cols]).first()
    size = {(f, c): found[f * len(cols) + i] for f in range(k) for i, c in enumerate(cols)}
    long = df.select(fold, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(cols)])).alias("x")).select(fold, "x.*")
    names = [f"__n{f}" for f in range(k)]
    g = long.where(F.col("__v").isNotNull()).groupBy("i", "__v").agg(*[F.count(F.when(outside(f), 1)).alias(n) for f, n in enumerate(names)])
    place = {(f, c, s): (size[f, c] - 1) * float(s) for f in range(k) for c, s in wanted if size[f, c]}
    ends = sorted({(cols.index(c), f, end(p)) for (f, c, _), p in place.items() for end in (math.floor, math.ceil)})
    here = F.lit(False)
    for i in range(len(cols)):
        at = F.lit(False)
        for _, f, e in (x for x in ends if x[0] == i):
            at |= (F.col(f"cum___n{f}") > e) & (F.col(f"cum___n{f}") - F.col(names[f]) <= e)
        here |= (F.col("i") == i) & at
    rows = prefix_sums(g, ["i"], "__v", names).where(here).collect()
    value = {(i, f, e): r["__v"] for r in rows for i, f, e in ends if r["i"] == i and r[f"cum___n{f}"] - r[names[f]] <= e < r[f"cum___n{f}"]}

    def between(f: int, c: str, p: float) -> float:
        lo, hi = (value[cols.index(c), f, end(p)] for end in (math.floor, math.ceil))
        return lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi

    return [{(c, s): between(f, c, place[f, c, s]) if (f, c, s) in place else None for c, s in wanted} for f in range(k)]


def rank_normalised(df: DataFrame, by: Sequence[str], col: str, out: str = "rank_norm", plus: int = 1) -> DataFrame:
    """Average rank over n + ``plus``: 1 keeps the ends off 0 and 1, 0 is the percentile rank."""
    n = df.groupBy(*by).agg(F.count(col).alias("__size")) if by else df.agg(F.count(col).alias("__size"))
    ranked = average_ranks(df, by, col, "__rank")
    if by:
        n = n.select(*[F.col(b).alias(f"__g_{b}") for b in by], "__size")
        same = F.lit(True)
        for b in by:
            same &= F.col(b).eqNullSafe(F.col(f"__g_{b}"))
        ranked = ranked.join(n, same).drop(*[f"__g_{b}" for b in by])
    else:
        ranked = ranked.crossJoin(F.broadcast(n))  # one row
    return ranked.withColumn(out, F.col("__rank") / (F.col("__size") + plus)).drop("__rank", "__size")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps its own first ``k``."""
    return df.orderBy(*order).limit(k)
