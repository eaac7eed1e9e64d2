"""Queries on row features and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.catalog import COMPANY, SCORES, plain, query
from foldspan.functions import rows as R
from foldspan.operators.encoders import crossed
from foldspan.sources.store import checked, id_mismatch, key_faults, nan_to_null, submission

C = f"WITH c AS ({plain(COMPANY)}) "
S = f"WITH s AS ({plain(SCORES)}) "
_DIV = lambda a, b: f"({a}) / nullif({b}, 0)"


def _ratios(spec):
    return ", ".join(f"{_DIV(a, b)} AS {k}" for k, (a, b) in spec.items())


@query("N1 N2", C + f"SELECT id, {_ratios(R.MARGINS)} FROM c")
def q_margins(t):
    return R.margins(t.view(COMPANY)).select("id", *R.MARGINS)


@query("N3", C + f"SELECT id, {_ratios(R.SOLVENCY)} FROM c")
def q_solvency(t):
    return R.solvency(t.view(COMPANY)).select("id", *R.SOLVENCY)


@query("N4", C + f"SELECT id, {_ratios(R.PER_HEAD)} FROM c")
def q_per_head(t):
    return R.per_head(t.view(COMPANY)).select("id", *R.PER_HEAD)


@query("N8", C + f"SELECT id, {_ratios(R.FINANCE)} FROM c")
def q_finance_ratios(t):
    return R.finance_ratios(t.view(COMPANY)).select("id", *R.FINANCE)


@query("N7", C + f"SELECT id, {_DIV('op_cf', 'sales')} AS cf_margin, {_DIV('op_cf + inv_cf', 'assets')} AS fcf_ratio, {_DIV('op_cf', 'assets')} AS cash_roa FROM c")
def q_cash_slack(t):
    return R.cash_slack(t.view(COMPANY)).select("id", "cf_margin", "fcf_ratio", "cash_roa")


@query("N5", C + "SELECT id, 6 - (q2 + q8) / 2.0 AS dissatisfaction, CAST(q1 - q2 AS DOUBLE) AS strategy_gap, coalesce(6 - q7, 0) AS tool_dissatisfaction FROM c")
def q_need_gap(t):
    return R.need_gap(t.view(COMPANY)).select("id", "dissatisfaction", "strategy_gap", "tool_dissatisfaction")


_INTENT = "(q1 + q11 + coalesce(q9, 0)) / (2.0 + CASE WHEN q9 IS NULL THEN 0 ELSE 1 END)"


@query("N6", C + f"SELECT id, {_INTENT} AS intent, (q3 + q8 + q2) / 3.0 AS achievement, {_INTENT} - (q3 + q8 + q2) / 3.0 AS intent_gap, CASE WHEN q6 = 1 THEN 5 - coalesce(q7, 5) ELSE 0 END AS adopter_gap FROM c")
def q_intent_gap(t):
    return R.intent_gap(t.view(COMPANY)).select("id", "intent", "achievement", "intent_gap", "adopter_gap")


_DIS4 = "(6e0 - q2) + (6 - q4) + (6 - coalesce(q7, 3.3e0)) + (6 - q10)"
_PARENTS = {"spend_to_sales": _DIV("-software_chg", "sales"), "cf_margin": _DIV("op_cf", "sales"), "equity_ratio": _DIV("equity", "assets"), "log_spend": "ln(1 + greatest(-software_chg, 0))", "loan_ratio": _DIV("short_loans + long_loans", "assets")}
_CROSS = ", ".join(f"{v} AS {k}, ({_DIS4}) * ({v}) AS dis4_{k}" for k, v in _PARENTS.items())


@query("N9 N10 N11", C + f"SELECT id, (6e0 - q2) + (6 - coalesce(q7, 3.3e0)) AS dis2, {_DIS4} AS dis4, {_CROSS} FROM c")
def q_cross_features(t):
    return R.cross_features(t.view(COMPANY)).select("id", "dis2", "dis4", *_PARENTS, *[f"dis4_{k}" for k in _PARENTS])


@query("N12", C + f"SELECT id, {', '.join(f'{_DIV(a, b)} * {x} AS {k}x{x}' for k, (a, b) in R.MARGINS.items() for x in ('q1', 'q11'))} FROM c")
def q_product_grid(t):
    out = R.product_grid(R.margins(t.view(COMPANY)), list(R.MARGINS), ["q1", "q11"])
    return out.select("id", *[f"{a}x{b}" for a in R.MARGINS for b in ("q1", "q11")])


_SLOG = lambda x: f"(CASE WHEN {x} IS NULL THEN NULL ELSE sign({x}) * ln(1 + abs({x})) END)"


@query("N13", f"SELECT c_custkey AS id, {_SLOG('c_acctbal')} AS signed_log FROM customer")
def q_signed_log(t):
    return t.customer.select(F.col("c_custkey").alias("id"), R.signed_log("c_acctbal").alias("signed_log"))


@query("N14", C + f"SELECT id, {_SLOG('op_cf / greatest(employees, 1)')} AS cf_per_head, {_SLOG('op_profit / greatest(employees, 1)')} AS profit_per_head, ln(1 + greatest(-software_chg, 0)) - {_SLOG('op_cf')} AS cash_pressure FROM c")
def q_affordability(t):
    return R.affordability(t.view(COMPANY)).select("id", "cf_per_head", "profit_per_head", "cash_pressure")


_V = "[" + ", ".join(R.FIVE_POINT) + "]"


@query("N15", C + f"""SELECT id, sd AS row_sd, CAST(hi - lo AS DOUBLE) AS row_range, CAST(mid AS DOUBLE) AS row_middle, CAST(off AS DOUBLE) AS row_off_middle FROM (
SELECT id, stddev_samp(v) AS sd, max(v) AS hi, min(v) AS lo, count(*) FILTER (v = 3) AS mid, sum(abs(v - 3)) AS off FROM (SELECT id, unnest({_V}) AS v FROM c) GROUP BY id)""")
def q_row_shape(t):
    return R.survey_shape(t.view(COMPANY)).select("id", "row_sd", "row_range", "row_middle", "row_off_middle")


@query("N16", C + "SELECT id, CAST(q1 >= 4 AS DOUBLE) AS q1_high, CAST(q2 <= 2 AS DOUBLE) AS q2_low, CAST(q4 >= 4 AS DOUBLE) AS q4_high, CAST(q10 >= 4 AS DOUBLE) AS q10_high FROM c")
def q_survey_steps(t):
    return R.survey_steps(t.view(COMPANY)).select("id", "q1_high", "q2_low", "q4_high", "q10_high")


@query("N17", C + "SELECT id, CASE WHEN q6 = 2 THEN 3.3e0 ELSE 6 - coalesce(q7, 3) END AS tool_gap, CAST(q2 * q8 AS DOUBLE) AS q2_q8, CAST(q11 * q10 AS DOUBLE) AS q11_q10, CAST(q1 * q10 AS DOUBLE) AS q1_q10 FROM c")
def q_survey_gaps(t):
    return R.survey_gaps(t.view(COMPANY)).select("id", "tool_gap", "q2_q8", "q11_q10", "q1_q10")


@query("N18", C + f"SELECT id, 6e0 - q2 AS rev_q2, 6e0 - q4 AS rev_q4, 6 - coalesce(q7, 3.3e0) AS rev_q7, 6e0 - q10 AS rev_q10, {', '.join(f'{v} AS {k}' for k, v in _PARENTS.items())} FROM c")
def q_raw_parents(t):
    return R.raw_parents(t.view(COMPANY))


@query("N19", S + "SELECT id, ln(p1 / (1 - p1)) AS z, 1 / (1 + exp(-(ln(p1 / (1 - p1)) + 0.5e0))) AS shifted FROM s")
def q_logit(t):
    z = R.logit("p1")
    return t.view(SCORES).select("id", z.alias("z"), R.sigmoid(z + 0.5).alias("shifted"))


@query("N20", S + """SELECT id, -(p1 * ln(p1) + (1 - p1) * ln(1 - p1)) AS entropy,
sqrt(greatest((p1 * p1 + p2 * p2 + p3 * p3) / 3 - power((p1 + p2 + p3) / 3, 2), 0)) AS expert_sd, greatest(p1, p2, p3) - least(p1, p2, p3) AS expert_range, p1 - p2 AS p1_minus_p2 FROM s""")
def q_disagreement(t):
    f = R.disagreement("p1", ["p1", "p2", "p3"], [("p1", "p2")])
    return t.view(SCORES).select("id", *[v.alias(k) for k, v in f.items()])


@query("P2", C + "SELECT id, CAST(offices IS NULL AS INT) AS offices_isna, CAST(plants IS NULL AS INT) AS plants_isna, CAST(op_profit IS NULL AS INT) AS op_profit_isna, coalesce(offices, 0) AS offices, coalesce(plants, 0) AS plants, op_profit FROM c")
def q_missing_flags(t):
    out = R.missing_flags(t.view(COMPANY), ["offices", "plants"], ["op_profit"])
    return out.select("id", "offices_isna", "plants_isna", "op_profit_isna", "offices", "plants", "op_profit")


@query("P1 P4 P5 P9 P16", C + "SELECT id, q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, coalesce(name, '') || ' ' || coalesce(channel, '') AS joined FROM c WHERE y = 1")
def q_column_group(t):
    df = t.view(COMPANY).where("y = 1").withColumn("joined", F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("channel", F.lit("")))).drop("name", "channel")
    return df.select("id", *R.column_group(df, prefix="q", exclude=("qx",), exclude_suffix="_isna"), "joined")


@query("P3", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW') THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 2 = 1")
def q_frozen_category(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return R.frozen_levels(o.where("id % 2 = 0 and priority <> '5-LOW'"), o.where("id % 2 = 1"), ["priority"])


@query("P10 P11", C + "SELECT id, coalesce(listing, '__MISSING__') AS listing, CAST(coalesce(listing, '__MISSING__') = '__MISSING__' AS INT) AS is_missing, CAST(coalesce(listing, '__MISSING__') = 'listed' AS INT) AS is_listed, CAST(coalesce(listing, '__MISSING__') = 'private' AS INT) AS is_private FROM c WHERE fold = 1")
def q_one_hot(t):
    c = t.view(COMPANY)
    out = R.one_hot(c.where("fold = 0"), R.fill_category(c.where("fold = 1"), ["listing"]), ["listing"])
    return out.select("id", "listing", F.col("`listing=__MISSING__`").alias("is_missing"), F.col("`listing=listed`").alias("is_listed"), F.col("`listing=private`").alias("is_private"))


@query("P6 P7 P8", C + f"SELECT id, industry, {_ratios(R.MARGINS)}, CAST(q1 >= 4 AS DOUBLE) AS q1_high, CAST(q2 <= 2 AS DOUBLE) AS q2_low, CAST(q4 >= 4 AS DOUBLE) AS q4_high, CAST(q10 >= 4 AS DOUBLE) AS q10_high FROM c WHERE fold = 4")
def q_matrices(t):
    from foldspan.plans.experiments import build_matrices

    c = t.view(COMPANY)
    raw = [x for x in c.columns if x not in ("id", "industry", "y")]
    _, test = build_matrices(c.where("fold <> 4"), c.where("fold = 4"), ["margins", "survey_steps"], drop=raw)
    return test


@query("F6", C + "SELECT id, coalesce(industry, '__MISSING__') || '||' || coalesce(listing, '__MISSING__') AS industryxlisting FROM c")
def q_cross(t):
    return crossed(t.view(COMPANY), [("industry", "listing")]).select("id", "industryxlisting")


@query("S2", "SELECT CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_null_key, CAST((SELECT count(*) FROM customer WHERE c_acctbal IS NULL) AS BIGINT) AS null_c_acctbal, CAST((SELECT count(*) FROM customer WHERE c_mktsegment IS NULL) AS BIGINT) AS null_c_mktsegment")
def q_key_check(t):
    c = nan_to_null(checked(t.customer, "c_custkey", ["c_acctbal", "c_mktsegment"]))
    return key_faults(c, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("S3", "SELECT CAST((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS only_first, CAST((SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS BIGINT) AS only_second")
def q_id_mismatch(t):
    return id_mismatch(t.documents, t.labels, "doc_id")


@query("S7 D1", S + "SELECT o.o_orderkey AS id, CAST(s.p1 >= 0.6e0 AS INT) AS label FROM orders o LEFT JOIN s ON s.id = o.o_orderkey")
def q_submission(t):
    from foldspan.operators.decisions import at_threshold

    p = t.view(SCORES).withColumn("label", at_threshold(F.col("p1"), 0.6))
    return submission(t.orders.select(F.col("o_orderkey").alias("id")), p)
