"""Queries on metrics, decisions, blends and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.catalog import COMPANY, PREDS, SCORES, SEEDED, plain, query
from foldspan.operators import blends as B
from foldspan.operators import compare as J
from foldspan.operators import decisions as D
from foldspan.operators import metrics as M
from foldspan.operators.ranks import rank_normalised

C = f"WITH c AS ({plain(COMPANY)}) "
S = f"WITH s AS ({plain(SCORES)})"
Z = f"WITH z AS ({plain(SEEDED)})"
P = f"WITH p AS ({plain(PREDS)})"
_GRID = "grid AS (SELECT CAST(i AS INT) AS step, 0.02e0 + i * 0.01e0 AS t FROM range(0, 97) r(i))"


def _auc(source: str, y: str, p: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {k}CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, sum((n - pos) * (cp - pos / 2.0)) / (sum(pos) * (sum(n) - sum(pos))) AS auc, sum(pos * cp / cn) / sum(pos) AS ap
FROM (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS cp, CAST(sum(n) OVER ({part}ORDER BY p DESC) AS DOUBLE) AS cn
      FROM (SELECT {k}{p} AS p, count(*) AS n, sum({y}) AS pos FROM {source} GROUP BY {k}{p})) {f'GROUP BY {by}' if by else ''}"""


def _curve(source: str, y: str, p: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"""SELECT {k}step, t, coalesce(2.0 * sum(CASE WHEN {p} >= t THEN {y} ELSE 0 END) / nullif(count(*) FILTER ({p} >= t) + sum({y}), 0), 0) AS f1
FROM {source} CROSS JOIN grid GROUP BY {k}step, t"""


def _best(curve: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT {k}f1 AS best_f1, t AS best_t FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, step) AS r FROM ({curve})) WHERE r = 1"


@query("M1 M2", f"{S} {_auc('s', 'y', 'p1')}")
def q_auc_ap(t):
    return M.auc_ap(t.view(SCORES), p="p1")


@query("M3", f"{S}, {_GRID} {_curve('s', 'y', 'p1')}")
def q_f1_curve(t):
    return M.f1_curve(t.view(SCORES), p="p1")


@query("M4", f"{Z}, {_GRID} {_best(_curve('z', 'y', 'p1', 'seed'), 'seed')}")
def q_best_threshold(t):
    return M.best_threshold(M.f1_curve(t.view(SEEDED), ["seed"], p="p1"), ["seed"])


@query("M5", f"{S} SELECT avg(-(y * ln(p1) + (1 - y) * ln(1 - p1))) AS log_loss FROM s")
def q_log_loss(t):
    return M.log_loss(t.view(SCORES), p="p1")


@query("M6", f"{Z}, {_GRID}, a AS ({_auc('z', 'y', 'p1', 'seed')}), b AS ({_best(_curve('z', 'y', 'p1', 'seed'), 'seed')}), l AS (SELECT seed, avg(-(y * ln(p1) + (1 - y) * ln(1 - p1))) AS log_loss FROM z GROUP BY seed) SELECT * FROM a JOIN b USING (seed) JOIN l USING (seed)")
def q_metric_table(t):
    return M.metric_table(t.view(SEEDED), ["seed"], p="p1")


@query("M7", f"""{Z}, {_GRID}, c AS ({_curve('z', 'y', 'p1', 'seed')}),
m AS (SELECT step, t, avg(f1) AS mean_f1 FROM c GROUP BY step, t), top AS (SELECT mean_f1 AS f1_insample, t AS th_star FROM m ORDER BY mean_f1 DESC, step LIMIT 1),
pl AS (SELECT min(t) AS plateau_lo, max(t) AS plateau_hi FROM m, top WHERE mean_f1 >= f1_insample - 0.002),
rest AS (SELECT c.seed, c.step, c.f1, round((SELECT avg(d.f1) FROM c d WHERE d.seed <> c.seed AND d.step = c.step), 12) AS r FROM c),
lo AS (SELECT avg(f1) AS f1_loso, stddev_pop(f1) AS f1_loso_sd FROM (SELECT f1, row_number() OVER (PARTITION BY seed ORDER BY r DESC, step) AS k FROM rest) WHERE k = 1),
ra AS (SELECT avg(r) AS rate, stddev_pop(r) AS rate_sd FROM (SELECT seed, avg(CASE WHEN p1 >= th_star THEN 1.0 ELSE 0.0 END) AS r FROM z, top GROUP BY seed))
SELECT f1_insample, th_star, plateau_lo, plateau_hi, f1_loso, f1_loso_sd, rate, rate_sd, (SELECT avg(y) FROM z) AS base_rate, f1_insample - f1_loso AS selection_bias, f1_insample / 2 AS calibrated_at FROM top, pl, lo, ra""")
def q_threshold_analysis(t):
    return M.threshold_analysis(t.view(SEEDED), p="p1")


@query("M8", f"{Z}, {_GRID}, b AS ({_best(_curve('z', 'y', 'p1', 'seed, fold'), 'seed, fold')}) SELECT seed, stddev_pop(best_t) AS threshold_sd FROM b GROUP BY seed")
def q_fold_threshold_sd(t):
    return M.fold_threshold_sd(t.view(SEEDED), p="p1")


@query("M10", f"""{Z}, {_GRID}, a AS ({_best(_curve('z', 'y', 'p1', 'seed'), 'seed')}), b AS ({_best(_curve('z', 'y', 'p2', 'seed'), 'seed')})
SELECT seed, count(*) FILTER (la <> lb) AS n_differ, count(*) FILTER (la <> lb AND la = y) AS first_right, count(*) FILTER (la <> lb AND lb = y) AS second_right
FROM (SELECT z.seed, y, CAST(p1 >= a.best_t AS INT) AS la, CAST(p2 >= b.best_t AS INT) AS lb FROM z JOIN a ON z.seed = a.seed JOIN b ON z.seed = b.seed) GROUP BY seed""")
def q_label_disagreement(t):
    return M.label_disagreement(t.view(SEEDED), "p1", "p2")


_LAB = "l AS (SELECT *, CAST(p1 >= 0.6e0 AS INT) AS la, CAST(p2 >= 0.6e0 AS INT) AS lb FROM s)"


def _labelled(t):
    return t.view(SCORES).withColumns({"la": D.at_threshold(F.col("p1"), 0.6), "lb": D.at_threshold(F.col("p2"), 0.6)})


@query("M11 J19", f"{S}, {_LAB} SELECT CASE WHEN y = 1 AND la = 1 THEN 'TP' WHEN y = 0 AND la = 1 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS kind, count(*) AS n, avg(p1) AS mean_p1, avg(p2) AS mean_p2 FROM l GROUP BY 1")
def q_means_by_error(t):
    return J.means_by_class(_labelled(t), M.confusion_class(F.col("y"), F.col("la")), ["p1", "p2"])


@query("M12", f"{S}, {_LAB} SELECT count(*) FILTER (y = 1 AND la = 0 AND lb = 1) AS rescued, count(*) FILTER (y = 1 AND la = 1 AND lb = 0) AS new_fn, count(*) FILTER (y = 0 AND la = 1 AND lb = 0) AS removed_fp, count(*) FILTER (y = 0 AND la = 0 AND lb = 1) AS new_fp, count(*) FILTER (la <> lb) AS n_differ FROM l")
def q_error_changes(t):
    return M.error_changes(_labelled(t), "la", "lb")


@query("M13", f"{S}, {_LAB} SELECT la || '->' || lb AS move, y AS truth, count(*) AS n FROM l WHERE la <> lb GROUP BY 1, 2")
def q_transitions(t):
    return M.label_transitions(_labelled(t), "la", "lb")


@query("M14", f"{S}, {_LAB}, x AS (SELECT y, CASE WHEN abs(p1 - 0.6e0) < 0.05e0 THEN y ELSE la END AS k FROM l) SELECT 2.0 * sum(k * y) / (sum(k) + sum(y)) AS ceiling_f1 FROM x")
def q_ceiling(t):
    return M.ceiling_f1(_labelled(t), "la", F.abs(F.col("p1") - 0.6) < 0.05)


@query("M15", f"{S} SELECT 1 - sum(power(p1 - p2, 2)) / (var_pop(p1) * count(*)) AS r2 FROM s")
def q_r_squared(t):
    return M.r_squared(t.view(SCORES), "p1", "p2")


_RANK = "(rank() OVER ({0}ORDER BY {1}) + (count(*) OVER ({0}{2}) - 1) / 2.0)"


@query("B1", f"{P} SELECT seed, model, id, {_RANK.format('PARTITION BY seed, model ', 'p', '').replace('count(*) OVER (PARTITION BY seed, model )', 'count(*) OVER (PARTITION BY seed, model, p)')} / (count(*) OVER (PARTITION BY seed, model) + 1) AS r FROM p")
def q_rank_normalised(t):
    return rank_normalised(t.view(PREDS), ["seed", "model"], "p", "r").drop("p")


@query("B2 B8", f"{P} SELECT seed, id, sum(CASE model WHEN 'a' THEN 0.7e0 ELSE 0.3e0 END * p) / 1.0 AS p FROM p GROUP BY seed, id")
def q_weighted_blend(t):
    return B.weighted(B.subsets(t.view(PREDS), ["none"]), {"a": 0.7, "b": 0.3})


@query("B3", f"{P}, m AS (SELECT seed, id, avg(ln(p / (1 - p))) AS z FROM p GROUP BY seed, id) SELECT seed, id, 1 / (1 + exp(-z)) AS p FROM m")
def q_uniform_logit(t):
    return B.uniform_logit(t.view(PREDS))


@query("B9", f"""{Z}, {_GRID}, w AS (SELECT CAST(k AS INT) AS k, seed, y, (1 - k * 0.25e0) * p1 + k * 0.25e0 * p2 AS p FROM z CROSS JOIN range(0, 5) r(k)),
a AS ({_auc('w', 'y', 'p', 'k, seed')}), b AS ({_best(_curve('w', 'y', 'p', 'k, seed'), 'k, seed')})
SELECT k, avg(auc) AS auc, avg(ap) AS ap, avg(best_f1) AS best_f1, k * 0.25e0 AS w FROM a JOIN b USING (k, seed) GROUP BY k""")
def q_weight_sweep(t):
    return B.weight_sweep(t.view(SEEDED), "p1", "p2", step=0.25)


@query("B12", f"{S} SELECT id, 0.8e0 * {_RANK.format('', 'p1', 'PARTITION BY p1')} / count(*) OVER () + 0.2e0 * {_RANK.format('', 'p2', 'PARTITION BY p2')} / count(*) OVER () AS p FROM s")
def q_rank_blend(t):
    return B.percentile_rank_blend(t.view(SCORES), "id", "p1", "p2", 0.2).select("id", "p")


@query("B13", f"{Z} SELECT id, avg(0.5e0 * p1 + 0.5e0 * p2) AS p, stddev_pop(0.5e0 * p1 + 0.5e0 * p2) AS p_sd FROM z GROUP BY id")
def q_seed_mean(t):
    return B.seed_mean(B.weighted(t.view(PREDS), {"a": 0.5, "b": 0.5}))


@query("D2", f"{S} SELECT quantile_cont(p1, 0.75) AS cut FROM s")
def q_rate_match(t):
    return D.rate_cut(t.view(SCORES), "p1", 0.25)


@query("D3", f"{S} SELECT id, CAST(row_number() OVER (ORDER BY p1 DESC, id DESC) <= 200 AS INT) AS label FROM s")
def q_top_k_label(t):
    return D.top_k_labels(t.view(SCORES), "id", "p1", 200).select("id", "label")


@query("D4", f"{S} SELECT id, CAST(CASE WHEN p1 >= 0.6e0 THEN row_number() OVER (PARTITION BY p1 >= 0.6e0 ORDER BY p1, id DESC) ELSE row_number() OVER (PARTITION BY p1 >= 0.6e0 ORDER BY p1 DESC, id) END <= 60 AS INT) AS in_band FROM s")
def q_band(t):
    return D.boundary_band(t.view(SCORES), "id", "p1", 0.6, 60).select("id", "in_band")


def _swap_sql(width: int | None) -> str:
    near = f"WHERE d <= {width}" if width else ""
    return f"""{S}, {_LAB}, d AS (SELECT id, la, p2, row_number() OVER (PARTITION BY la ORDER BY abs(p1 - 0.6e0), id) AS d FROM l),
r AS (SELECT id, la, row_number() OVER (PARTITION BY la ORDER BY CASE WHEN la = 0 THEN -p2 ELSE p2 END, id) AS r FROM d {near}),
m AS (SELECT least(20, (SELECT count(*) FROM r WHERE la = 0), (SELECT count(*) FROM r WHERE la = 1)) AS m)
SELECT l.id, CASE WHEN r.r <= m THEN 1 - l.la ELSE l.la END AS label FROM l LEFT JOIN r ON l.id = r.id CROSS JOIN m"""


@query("D5", _swap_sql(200))
def q_swap_boundary(t):
    return D.swapped_labels(t.view(SCORES), "id", "p1", "p2", 0.6, 20, 200).select("id", "label")


@query("D6", _swap_sql(None))
def q_swap(t):
    return D.swapped_labels(t.view(SCORES), "id", "p1", "p2", 0.6, 20).select("id", "label")


@query("D7", f"{S} SELECT id, 0.7e0 * {_RANK.format('', 'p1', 'PARTITION BY p1')} / count(*) OVER () + 0.2e0 * {_RANK.format('', 'p2', 'PARTITION BY p2')} / count(*) OVER () + 0.1e0 * {_RANK.format('', 'p3', 'PARTITION BY p3')} / count(*) OVER () AS support FROM s")
def q_support(t):
    return B.support_scores(t.view(SCORES), "p1", {"p2": 0.2, "p3": 0.1}).select("id", "support")


@query("D8", f"""{S}, {_GRID}, o AS (SELECT * FROM s WHERE id % 2 = 0), h AS (SELECT * FROM s WHERE id % 2 = 1), b AS ({_best(_curve('o', 'y', 'p1'))}), f AS ({_best(_curve('o', 'y', 'p1', 'fold'), 'fold')}),
q AS (SELECT list(p1 ORDER BY p1) AS v, (1 - (SELECT avg(CAST(p1 >= best_t AS INT)) FROM o, b)) * (count(*) - 1) AS k FROM h)
SELECT 'oof_best' AS rule, best_t AS t FROM b UNION ALL SELECT 'fold_mean', avg(best_t) FROM f UNION ALL SELECT 'half_f1', best_f1 / 2 FROM b
UNION ALL SELECT 'rate', v[CAST(floor(k) AS INT) + 1] + (k - floor(k)) * (v[least(CAST(floor(k) AS INT) + 2, len(v))] - v[CAST(floor(k) AS INT) + 1]) FROM q""")
def q_threshold_rules(t):
    s = t.view(SCORES)
    return D.threshold_rules(s.where("id % 2 = 0"), s.where("id % 2 = 1"), "y", "p1")


@query("D9", f"{S} SELECT min(p1) AS cut FROM (SELECT p1 FROM s ORDER BY p1 DESC LIMIT 300)")
def q_resolve_threshold(t):
    return D.resolve_threshold(t.view(SCORES), "p1", count=300)


_RANKED = f"k AS (SELECT y, {_RANK.format('', 'p1', 'PARTITION BY p1')} AS r1, {_RANK.format('', 'p2', 'PARTITION BY p2')} AS r2, {_RANK.format('', 'p3', 'PARTITION BY p3')} AS r3 FROM s)"


@query("J1", f"{S}, {_RANKED} SELECT 'p1' AS a, 'p2' AS b, corr(r1, r2) AS rho FROM k UNION ALL SELECT 'p1', 'p3', corr(r1, r3) FROM k UNION ALL SELECT 'p2', 'p3', corr(r2, r3) FROM k")
def q_spearman(t):
    return J.spearman_matrix(t.view(SCORES), ["p1", "p2", "p3"])


_SEEDRANK = "k AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY p1) + (count(*) OVER (PARTITION BY seed, p1) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY seed ORDER BY p2) + (count(*) OVER (PARTITION BY seed, p2) - 1) / 2.0 AS r2 FROM z)"


@query("J2 J5", f"{Z}, {_SEEDRANK}, m AS (SELECT avg(rho) AS rho FROM (SELECT corr(r1, r2) AS rho FROM k GROUP BY seed)) SELECT rho, CASE WHEN rho >= 0.95 THEN 'REJECT' ELSE 'PASS' END AS gate FROM m")
def q_rank_correlation(t):
    return J.correlation_gate(J.mean_rank_correlation(t.view(SEEDED), "p1", "p2"))


_LONG = f"a AS ({_auc('z', 'y', 'p1', 'seed')}), a2 AS ({_auc('z', 'y', 'p2', 'seed')}), b AS ({_best(_curve('z', 'y', 'p1', 'seed'), 'seed')}), b2 AS ({_best(_curve('z', 'y', 'p2', 'seed'), 'seed')}), x AS (SELECT seed, 'auc' AS metric, a2.auc - a.auc AS d FROM a JOIN a2 USING (seed) UNION ALL SELECT seed, 'ap', a2.ap - a.ap FROM a JOIN a2 USING (seed) UNION ALL SELECT seed, 'f1', b2.best_f1 - b.best_f1 FROM b JOIN b2 USING (seed)), dl AS (SELECT metric, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, count(*) FILTER (d > 0) AS n_positive, min(d) AS min, max(d) AS max FROM x GROUP BY metric)"


def _scores(t):
    z = t.view(SEEDED)
    parts = []
    for c in ("p1", "p2"):
        m = M.metric_table(z, ["seed"], p=c)
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(k).alias("value")) for n, k in (("auc", "auc"), ("ap", "ap"), ("f1", "best_f1"))]))
        parts.append(m.select(F.lit(c).alias("config"), "seed", cells.alias("x")).select("config", "seed", "x.*"))
    return parts[0].unionByName(parts[1])


@query("J3", f"{Z}, {_GRID}, {_LONG} SELECT * FROM dl")
def q_paired_delta(t):
    return J.paired_deltas(_scores(t), "p1", "p2")


@query("J4", f"""{Z}, {_GRID}, {_LONG}, w AS (SELECT max(n_positive / n) FILTER (metric = 'auc') AS auc_share, max(n_positive / n) FILTER (metric = 'ap') AS ap_share, max(mean) FILTER (metric = 'ap') AS ap_gain, max(mean) FILTER (metric = 'f1') AS f1_gain FROM dl)
SELECT *, CASE WHEN f1_gain < -0.002 OR (auc_share < 0.7 AND ap_share < 0.75) THEN 'REJECT' WHEN auc_share >= 0.7 AND ap_share >= 0.75 AND ap_gain >= 0.005 THEN 'ACCEPT' ELSE 'PARK' END AS verdict FROM w""")
def q_verdict(t):
    return J.verdict(J.paired_deltas(_scores(t), "p1", "p2"))


@query("J9", f"{Z}, {_GRID}, a AS ({_auc('z', 'y', 'p1', 'seed')}), a2 AS ({_auc('z', 'y', 'p2', 'seed')}), b AS ({_best(_curve('z', 'y', 'p1', 'seed'), 'seed')}), b2 AS ({_best(_curve('z', 'y', 'p2', 'seed'), 'seed')}), x AS (SELECT seed, 'auc' AS metric, a.auc AS p1, a2.auc AS p2 FROM a JOIN a2 USING (seed) UNION ALL SELECT seed, 'ap', a.ap, a2.ap FROM a JOIN a2 USING (seed) UNION ALL SELECT seed, 'f1', b.best_f1, b2.best_f1 FROM b JOIN b2 USING (seed)) SELECT *, p2 - p1 AS p2_delta FROM x")
def q_paired_pivot(t):
    return J.paired_pivot(_scores(t), ["p1", "p2"], "p1")


_NUMS = ("employees", "offices", "op_profit", "sales")
_LONGC = "u AS (" + " UNION ALL ".join(f"SELECT id, y, fold, '{c}' AS col, {c} AS v FROM c" for c in _NUMS) + ")"


@query("J10", f"""{C}, {_LONGC}, b AS (SELECT col, s, y, v * s AS p FROM u CROSS JOIN (SELECT 1 AS s UNION ALL SELECT -1) WHERE v IS NOT NULL), a AS ({_auc('b', 'y', 'p', 'col, s')})
SELECT u.col AS "column", coverage, auc, ap, ap / rate AS ap_lift FROM (SELECT col, avg(CAST(v IS NOT NULL AS INT)) AS coverage FROM u GROUP BY col) u JOIN (SELECT col, max(auc) AS auc, max(ap) AS ap, max(n_pos / n) AS rate FROM a GROUP BY col) a ON u.col = a.col""")
def q_column_signal(t):
    return J.column_signal(t.view(COMPANY), _NUMS)


@query("J11", f"""{C}, r AS (SELECT id, {', '.join(f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 END AS {x}" for x in ('offices', 'employees', 'op_profit', 'sales'))} FROM c),
m AS ({' UNION ALL '.join(f"SELECT '{a}' AS new, '{b}' AS old, abs(corr({a}, {b})) AS rho FROM r WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in ('offices', 'op_profit') for b in ('employees', 'sales'))})
SELECT new, max(rho) AS max_rho, arg_max(old, rho) AS closest FROM m GROUP BY new""")
def q_max_rank_correlation(t):
    return J.max_rank_correlation(t.view(COMPANY), ["offices", "op_profit"], ["employees", "sales"], "id")


@query("J12", f"""{C}, m AS (SELECT median(sales) AS ma, median(assets) AS mb FROM c), h AS (SELECT y, CAST(sales > ma AS INT) AS a, CAST(assets > mb AS INT) AS b FROM c, m),
r AS (SELECT avg(y) FILTER (a = 0 AND b = 0) AS r00, avg(y) FILTER (a = 0 AND b = 1) AS r01, avg(y) FILTER (a = 1 AND b = 0) AS r10, avg(y) FILTER (a = 1 AND b = 1) AS r11 FROM h) SELECT *, r11 - r10 - r01 + r00 AS excess FROM r""")
def q_quadrant(t):
    return J.quadrants(t.view(COMPANY), "sales", "assets")


@query("J13", f"""{C}, {_LONGC} SELECT col AS "column", CAST(fold = 4 AS INT) AS part, avg(CAST(v IS NULL AS INT)) AS missing, avg(v) AS mean, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM u GROUP BY 1, 2""")
def q_stability(t):
    return J.stability(t.view(COMPANY).withColumn("part", (F.col("fold") == 4).cast("int")), _NUMS, "part")


_SEL = "SELECT CAST(o_orderkey % 4 AS INT) AS fold, o_orderpriority || '/' || CAST(o_custkey % 40 AS VARCHAR(8)) AS item FROM {orders} WHERE (o_custkey * 31 + o_orderkey % 4 * 7) % 3 = 0 GROUP BY 1, 2"


@query("J14", f"WITH s AS ({plain(_SEL)}), n AS (SELECT fold, count(*) AS n FROM s GROUP BY fold), i AS (SELECT x.fold AS a, z.fold AS b, count(*) AS k FROM s x JOIN s z ON x.item = z.item AND x.fold < z.fold GROUP BY 1, 2) SELECT a, b, k / (na.n + nb.n - k) AS jaccard FROM i JOIN n na ON a = na.fold JOIN n nb ON b = nb.fold")
def q_selection_stability(t):
    return J.selection_stability(t.view(_SEL))[0]


_WEIGHTS = "SELECT CAST(o_orderkey % 3 AS INT) AS fold, o_orderpriority AS model, avg(o_totalprice) AS w FROM {orders} GROUP BY 1, 2"


@query("J15", f"WITH w AS ({plain(_WEIGHTS)}), n AS (SELECT fold, sqrt(sum(w * w)) AS n FROM w GROUP BY fold) SELECT x.fold AS a, z.fold AS b, sum(x.w * z.w) / (max(na.n) * max(nb.n)) AS cosine FROM w x JOIN w z ON x.model = z.model AND x.fold < z.fold JOIN n na ON x.fold = na.fold JOIN n nb ON z.fold = nb.fold GROUP BY 1, 2")
def q_weight_cosine(t):
    return J.weight_cosines(t.view(_WEIGHTS))


@query("J18", f"{S}, {_LAB} SELECT cust % 200 AS grp, count(*) AS n, avg(CAST(y <> la AS INT)) AS error_rate, count(*) FILTER (y = 1 AND la = 0) AS n_fn, count(*) FILTER (y = 0 AND la = 1) AS n_fp FROM l GROUP BY 1 HAVING count(*) >= 8")
def q_error_by_group(t):
    return J.error_by_group(_labelled(t).withColumn("grp", F.col("cust") % 200), "grp", "y", "la")


@query("J20", f"{S}, {_LAB}, k AS (SELECT id, CASE WHEN y = 1 AND la = 1 THEN 'TP' WHEN y = 0 AND la = 1 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS kind, abs(p1 - 0.6e0) AS confidence FROM l) SELECT kind, CAST(place AS INT) AS place, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id) AS place FROM k) WHERE place <= 10")
def q_top_errors(t):
    return J.top_errors(_labelled(t), M.confusion_class(F.col("y"), F.col("la")), "p1", 0.6, "id", 10)


@query("J21", f"{S} SELECT count(*) FILTER (id % 50 = 0) AS n_unmatched, max(CASE WHEN id % 50 > 0 THEN abs(p1 - p2) END) AS max_diff, count(*) FILTER (id % 50 > 0 AND (p1 >= 0.5) <> (p2 >= 0.5)) AS n_label_diff, 'FAIL' AS grade FROM s")
def q_drift(t):
    s = t.view(SCORES)
    return J.drift(s.select("id", F.col("p1").alias("p")), s.where("id % 50 > 0").select("id", F.col("p2").alias("p")))


