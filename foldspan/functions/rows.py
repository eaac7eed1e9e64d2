"""Deterministic row features of numbers and survey answers, as column expressions.

Every division is safe: by zero, or with a null, it gives null. NaN is read as null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__MISSING__"
#: Where customers without the tool stand on its satisfaction scale (a fixed value of the survey).
NOT_INSTALLED = 3.3
FIVE_POINT = ("q1", "q2", "q3", "q4", "q5", "q8", "q9", "q10", "q11")


def num(c) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def safe_div(a, b) -> Column:
    out = F.try_divide(num(a), num(b))
    return F.when(F.abs(out) < float("inf"), out)


def ratio_columns(df: DataFrame, ratios: Mapping[str, tuple]) -> DataFrame:
    return df.withColumns({k: safe_div(a, b) for k, (a, b) in ratios.items()})


#: Ratios of the entity table (fixed definitions).
MARGINS = {"op_margin": ("op_profit", "sales"), "ord_margin": ("ord_profit", "sales"), "net_margin": ("net_profit", "sales")}
SOLVENCY = {"equity_ratio": ("equity", "assets"), "debt_ratio": ("debt", "equity"), "roa": ("net_profit", "assets"), "roe": ("net_profit", "equity")}
PER_HEAD = {"software_per_head": ("software_chg", "employees"), "sales_per_head": ("sales", "employees"), "assets_per_head": ("assets", "employees")}
FINANCE = {"software_to_sales": ("software_chg", "sales"), "current_ratio": ("current_assets", "debt"), "net_assets_ratio": ("net_assets", "assets"), "inv_cf_to_sales": ("inv_cf", "sales")}


def margins(df):
    return ratio_columns(df, MARGINS)


def solvency(df):
    return ratio_columns(df, SOLVENCY)


def per_head(df):
    return ratio_columns(df, PER_HEAD)


def finance_ratios(df):
    return ratio_columns(df, FINANCE)


def cash_slack(df):
    free = num("op_cf") + num("inv_cf")
    return ratio_columns(df, {"cf_margin": ("op_cf", "sales"), "fcf_ratio": (free, "assets"), "cash_roa": ("op_cf", "assets")})


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the values that are there."""
    values = F.filter(F.array(*[num(c) for c in cols]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def row_shape(cols: Sequence[str], middle: float = 3) -> dict[str, Column]:
    """Sample deviation, range, number of middle answers, distance from the middle."""
    # sums of columns, not of arrays: compiled, and the mean is made once a row
    values = [num(c) for c in cols]
    total = lambda parts: sum((F.coalesce(p, F.lit(0.0)) for p in parts), start=F.lit(0.0))
    size = sum((v.isNotNull().cast("int") for v in values), start=F.lit(0))
    mean = F.try_divide(total(values), size)
    spread = total((v - mean) * (v - mean) for v in values)
    return {
        "row_sd": F.sqrt(F.try_divide(spread, F.when(size > 1, size - 1))),
        "row_range": F.greatest(*values) - F.least(*values) if len(values) > 1 else values[0] - values[0],
        "row_middle": total((v == middle).cast("double") for v in values),
        "row_off_middle": total(F.abs(v - middle) for v in values),
    }


def survey_shape(df):
    return df.withColumns(row_shape(FIVE_POINT))


def threshold_flag(c, at_least: float | None = None, at_most: float | None = None) -> Column:
    """1.0 or 0.0; a null is 0."""
    hit = F.lit(True)
    if at_least is not None:
        hit = hit & (num(c) >= at_least)
    if at_most is not None:
        hit = hit & (num(c) <= at_most)
    return F.coalesce(hit, F.lit(False)).cast("double")


def survey_steps(df):
    return df.withColumns({"q1_high": threshold_flag("q1", at_least=4), "q2_low": threshold_flag("q2", at_most=2), "q4_high": threshold_flag("q4", at_least=4), "q10_high": threshold_flag("q10", at_least=4)})


def survey_gaps(df):
    tool = F.when(num("q6") == 2, F.lit(NOT_INSTALLED)).otherwise(6 - F.coalesce(num("q7"), F.lit(3.0)))
    return df.withColumns({"tool_gap": tool, "q2_q8": num("q2") * num("q8"), "q11_q10": num("q11") * num("q10"), "q1_q10": num("q1") * num("q10")})


def need_gap(df):
    return df.withColumns({"dissatisfaction": 6 - row_mean(["q2", "q8"]), "strategy_gap": num("q1") - num("q2"), "tool_dissatisfaction": F.coalesce(6 - num("q7"), F.lit(0.0))})


def intent_gap(df):
    """Intent minus achievement, and dissatisfaction of those who have the tool."""
    intent, done = row_mean(["q1", "q11", "q9"]), row_mean(["q3", "q8", "q2"])
    tool = F.when(num("q6") == 1, 5 - F.coalesce(num("q7"), F.lit(5.0))).otherwise(0.0)
    return df.withColumns({"intent": intent, "achievement": done, "intent_gap": intent - done, "adopter_gap": tool})


def reversed_items(cols: Sequence[str], conditional: str = "q7") -> dict[str, Column]:
    return {f"rev_{c}": 6 - (F.coalesce(num(c), F.lit(NOT_INSTALLED)) if c == conditional else num(c)) for c in cols}


def dissatisfaction(cols: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for c in reversed_items(cols).values():
        out = out + c
    return out


def log1p_clipped(c) -> Column:
    return F.log1p(F.greatest(num(c), F.lit(0.0)))


def finance_parents() -> dict[str, Column]:
    """Five parents; software spending is recorded as a negative change and gets its sign back."""
    spent = -num("software_chg")
    return {
        "spend_to_sales": safe_div(spent, "sales"),
        "cf_margin": safe_div("op_cf", "sales"),
        "equity_ratio": safe_div("equity", "assets"),
        "log_spend": F.when(spent.isNotNull(), log1p_clipped(spent)),
        "loan_ratio": safe_div(num("short_loans") + num("long_loans"), "assets"),
    }


def cross_features(df):
    """Two scores, five parents and the products of the second score with them."""
    four = dissatisfaction(["q2", "q4", "q7", "q10"])
    parents = finance_parents()
    return df.withColumns({"dis2": dissatisfaction(["q2", "q7"]), "dis4": four, **parents, **{f"dis4_{k}": four * v for k, v in parents.items()}})


def product_grid(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Products of all pairs of parents, named ``axb``."""
    return df.withColumns({f"{a}x{b}": num(a) * num(b) for a in left for b in right})


def raw_parents(df: DataFrame, items: Sequence[str] = ("q2", "q4", "q7", "q10"), keep: Sequence[str] = ("id",)) -> DataFrame:
    return df.select(*keep, *[c.alias(k) for k, c in {**reversed_items(items), **finance_parents()}.items()])


def signed_log(c) -> Column:
    return F.signum(num(c)) * F.log1p(F.abs(num(c)))


def affordability(df):
    heads = F.greatest(num("employees"), F.lit(1.0))
    heads = F.when(num("employees").isNotNull(), heads)
    spent = -num("software_chg")
    spent = F.when(spent.isNotNull(), F.greatest(spent, F.lit(0.0)))
    return df.withColumns({"cf_per_head": signed_log(num("op_cf") / heads), "profit_per_head": signed_log(num("op_profit") / heads), "cash_pressure": F.log1p(spent) - signed_log("op_cf")})


def logit(p, eps: float = 1e-6) -> Column:
    c = F.greatest(F.least(num(p), F.lit(1 - eps)), F.lit(eps))
    c = F.when(num(p).isNotNull(), c)
    return F.log(c / (1 - c))


def sigmoid(z) -> Column:
    return 1 / (1 + F.exp(-num(z)))


def disagreement(base: str, experts: Sequence[str], pairs: Sequence[tuple[str, str]] = (), eps: float = 1e-6) -> dict[str, Column]:
    """Entropy of the base score, population deviation and range of the experts' scores, pairwise gaps."""
    p = F.greatest(F.least(num(base), F.lit(1 - eps)), F.lit(eps))
    values = F.array(*[num(c) for c in experts])
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(experts)
    out = {
        "entropy": -(p * F.log(p) + (1 - p) * F.log(1 - p)),
        "expert_sd": F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(experts)),
        "expert_range": F.array_max(values) - F.array_min(values),
    }
    return out | {f"{a}_minus_{b}": num(a) - num(b) for a, b in pairs}


# Cleaning


def missing_flags(df: DataFrame, zero_fill: Sequence[str], flag_only: Sequence[str] = ()) -> DataFrame:
    """``c_isna`` for all columns; those of ``zero_fill`` get 0 for null."""
    flags = {f"{c}_isna": num(c).isNull().cast("int") for c in (*zero_fill, *flag_only)}
    return df.withColumns(flags).withColumns({c: F.coalesce(num(c), F.lit(0.0)) for c in zero_fill})


def fill_category(df: DataFrame, cols: Sequence[str], sentinel: str = MISSING) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(sentinel)) for c in cols})


def frozen_levels(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``other`` with levels that ``train`` doesn't have set to null; joins are left to the engine's size checks."""
    for c in cols:
        levels = train.select(F.col(c).alias("__level")).where("__level is not null").distinct()
        other = other.join(levels, F.col(c) == F.col("__level"), "left").withColumn(c, F.col("__level")).drop("__level")
    return other


def column_group(df: DataFrame, names: Sequence[str] | None = None, prefix: str | None = None, exclude: Sequence[str] = (), exclude_suffix: str | None = None) -> list[str]:
    """Columns by list, by prefix, by exclusion, minus a suffix; in the table's order."""
    out = [c for c in df.columns if names is None or c in names]
    out = [c for c in out if (prefix is None or c.startswith(prefix)) and c not in exclude]
    return [c for c in out if not exclude_suffix or not c.endswith(exclude_suffix)]


def one_hot(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``other`` with a 0/1 column for each level that ``train`` has; levels must be few, as each is a column."""
    for c in cols:
        levels = [r[0] for r in train.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).distinct().collect()]
        other = other.withColumns({f"{c}={v}": (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v).cast("int") for v in sorted(levels)})
    return other
