"""Queries on splits, samples and statistics fitted inside folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.catalog import COMPANY, SCORES, plain, query
from foldspan.operators import encoders as E
from foldspan.operators import folds as K

C = f"WITH c AS ({plain(COMPANY)})"
S = f"WITH s AS ({plain(SCORES)})"


def _h(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8) AS BIGINT)"


_FOLDS = f"f AS (SELECT s.seed, id, y, CAST((row_number() OVER (PARTITION BY s.seed, y ORDER BY {_h('s.seed', 'id')}, id) - 1) % 5 AS INT) AS fold FROM o CROSS JOIN (SELECT 0 AS seed UNION ALL SELECT 1) s)"


@query("K1 K2", f"{S}, o AS (SELECT id, y FROM s), {_FOLDS} SELECT * FROM f")
def q_folds(t):
    return K.stratified_folds(t.view(SCORES), "id", "y", [0, 1])


@query("K3", f"""{S}, o AS (SELECT id, y FROM s), {_FOLDS}, n AS (SELECT seed, CAST(k AS INT) AS "outer", id, y FROM f CROSS JOIN range(0, 5) r(k) WHERE fold <> k)
SELECT seed, "outer", id, y, CAST((row_number() OVER (PARTITION BY seed, "outer", y ORDER BY {_h("'inner'", 'seed', '"outer"', 'id')}, id) - 1) % 5 AS INT) AS inner FROM n""")
def q_nested_folds(t):
    return K.nested_folds(K.stratified_folds(t.view(SCORES), "id", "y", [0, 1]))


@query("K4", f"{S} SELECT id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_h(chr(39) + 'holdout0' + chr(39), 'id')}, id) <= floor(0.35e0 * count(*) OVER (PARTITION BY y)) THEN 'B' ELSE 'A' END AS part FROM s")
def q_holdout(t):
    return K.stratified_holdout(t.view(SCORES), "id", "y", 0.35)


@query("K5", f"{S} SELECT id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_h(chr(39) + 'lockbox0' + chr(39), 'id')}, id) <= 100 THEN 'lockbox' ELSE 'discovery' END AS part FROM s")
def q_lockbox(t):
    return K.lockbox_split(t.view(SCORES), "id", "y", 100)


@query("K6", "WITH r AS (SELECT o_orderkey // 1024 AS r, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(d, ',' ORDER BY r)) AS fingerprint FROM r")
def q_split_fingerprint(t):
    return K.split_fingerprint(t.orders, "o_orderkey", 1024)


@query("K7", f"""{S}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {_h("'pairs0'", "id")}, id) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM s),
m AS (SELECT min(n) AS fewest FROM r), z AS (SELECT DISTINCT y AS ty, n AS tn FROM r),
w AS (SELECT id, y, ty, CASE WHEN ty = y THEN (pos + 1 + {_h("'same0'", "id")} % greatest(tn - 1, 1)) % tn ELSE {_h("'other0'", "id")} % tn END AS place FROM r CROSS JOIN m CROSS JOIN z WHERE pos < fewest)
SELECT w.id AS anchor, r.id AS partner, CAST(w.y = r.y AS INT) AS same FROM w JOIN r ON r.y = ty AND r.pos = place WHERE w.id <> r.id""")
def q_balanced_pairs(t):
    return K.balanced_pairs(t.view(SCORES), "id", "y")


@query("K8 K9", f"""{S}, r AS (SELECT id, y, CAST(floor((row_number() OVER (PARTITION BY y ORDER BY {_h("'batch0'", "id")}, id) - 1) / 16) AS BIGINT) AS batch, count(*) OVER (PARTITION BY y) AS n FROM s)
SELECT batch, id, y, batch = 0 OR {_h("'cand0'", "id")} / 4294967296e0 < 0.3e0 AS is_candidate FROM r WHERE batch < (SELECT min(floor(n / 16)) FROM r)""")
def q_balanced_batches(t):
    s = t.view(SCORES)
    batches = K.balanced_batches(s, "id", "y", 16)
    return batches.join(K.candidate_sample(s, batches.where("batch = 0"), "id", 0.3).select(F.col("id").alias("c")), F.col("id") == F.col("c"), "left").withColumn("is_candidate", F.col("c").isNotNull()).drop("c")


@query("P14", f"{S} SELECT id, sqrt(-2 * ln(1 - {_h(chr(39) + 'n1-0' + chr(39), 'id')} / 4294967296e0)) * cos(6.283185307179586e0 * ({_h(chr(39) + 'n2-0' + chr(39), 'id')} / 4294967296e0)) AS noise FROM s")
def q_noise(t):
    return K.noise_column(t.view(SCORES), "id").select("id", "noise")


_TE = "g AS (SELECT fold AS f, priority AS k, sum(y) AS s, count(*) AS n FROM s GROUP BY 1, 2), tk AS (SELECT k, sum(s) AS s, sum(n) AS n FROM g GROUP BY k), tf AS (SELECT f, sum(s) AS s, sum(n) AS n FROM g GROUP BY f), a AS (SELECT sum(s) AS s, sum(n) AS n FROM g)"


@query("F1", f"{S}, {_TE} SELECT s.id, ((tk.s - g.s) + 10 * ((a.s - tf.s) / (a.n - tf.n))) / ((tk.n - g.n) + 10) AS te FROM s JOIN g ON s.fold = g.f AND s.priority = g.k JOIN tk ON s.priority = tk.k JOIN tf ON s.fold = tf.f CROSS JOIN a")
def q_target_encode_oof(t):
    return E.target_encoding(t.view(SCORES), "priority", "y").select("id", "te")


@query("F1", f"{S}, {_TE} SELECT s.id, (tk.s + 10 * (a.s / a.n)) / (tk.n + 10) AS te FROM s JOIN tk ON s.priority = tk.k CROSS JOIN a")
def q_target_encode(t):
    return E.target_encoding(t.view(SCORES), "priority", "y", out_of_fold=False).select("id", "te")


@query("F1", f"{S}, a AS (SELECT * FROM s WHERE id % 2 = 0 AND priority <> '5-LOW'), k AS (SELECT priority, sum(y) AS s, count(*) AS n FROM a GROUP BY 1), p AS (SELECT avg(y) AS p FROM a) SELECT s.id, coalesce((k.s + 10 * p) / (k.n + 10), p) AS te FROM s LEFT JOIN k USING (priority) CROSS JOIN p WHERE s.id % 2 = 1")
def q_target_encode_new(t):
    s = t.view(SCORES)
    return E.encode_new(s.where("id % 2 = 0 and priority <> '5-LOW'"), s.where("id % 2 = 1"), "priority", "y").select("id", "te")


_MED = lambda c, w="true": f"(SELECT quantile_cont(d.{c}, 0.5) FROM c d WHERE d.fold <> k AND {w})"


@query("P12", f"{C}, m AS (SELECT CAST(k AS INT) AS k, {_MED('op_profit')} AS a, {_MED('offices')} AS b FROM range(0, 5) r(k)) SELECT id, coalesce(op_profit, a) AS op_profit, coalesce(offices, b) AS offices FROM c JOIN m ON fold = k")
def q_fold_median(t):
    return E.median_filled(t.view(COMPANY), ["op_profit", "offices"]).select("id", "op_profit", "offices")


@query("P13", f"{C}, m AS (SELECT CAST(k AS INT) AS k, {_MED('q7', 'd.q6 = 1')} AS a FROM range(0, 5) r(k)) SELECT id, coalesce(q7, a) AS q7 FROM c JOIN m ON fold = k")
def q_conditional_median(t):
    return E.median_filled(t.view(COMPANY), ["q7"], where=F.col("q6") == 1).select("id", "q7")


@query("P15", f"{C}, m AS (SELECT CAST(k AS INT) AS k, (SELECT avg(d.sales) FROM c d WHERE d.fold <> k) AS a, (SELECT stddev_pop(d.sales) FROM c d WHERE d.fold <> k) AS s, (SELECT avg(d.op_profit) FROM c d WHERE d.fold <> k) AS a2, (SELECT stddev_pop(d.op_profit) FROM c d WHERE d.fold <> k) AS s2 FROM range(0, 5) r(k)) SELECT id, (sales - a) / s AS sales, coalesce((op_profit - a2) / s2, 0) AS op_profit FROM c JOIN m ON fold = k")
def q_fold_scale(t):
    return E.standardised(t.view(COMPANY), ["sales", "op_profit"]).select("id", "sales", "op_profit")


@query("F5", f"""{C}, m AS (SELECT CAST(k AS INT) AS k, (SELECT quantile_cont(d.sales, [0.2, 0.4, 0.6, 0.8]) FROM c d WHERE d.fold <> k) AS e, (SELECT quantile_cont(d.offices, [0.2, 0.4, 0.6, 0.8]) FROM c d WHERE d.fold <> k) AS e2 FROM range(0, 5) r(k))
SELECT id, 'b' || len(list_filter(list_distinct(e), lambda x: x <= sales)) AS sales_bin, CASE WHEN offices IS NULL THEN '__MISSING__' ELSE 'b' || len(list_filter(list_distinct(e2), lambda x: x <= offices)) END AS offices_bin FROM c JOIN m ON fold = k""")
def q_quantile_bin(t):
    return E.quantile_bins(t.view(COMPANY), ["sales", "offices"]).select("id", "sales_bin", "offices_bin")


@query("F8", f"{C} SELECT id, sales AS sales_s1, sales * sales AS sales_s2, power(greatest(sales - 250, 0), 2) AS sales_k0, power(greatest(sales - 750, 0), 2) AS sales_k1 FROM c")
def q_spline_basis(t):
    return E.spline_basis(t.view(COMPANY), "sales", [250, 750]).select("id", "sales_s1", "sales_s2", "sales_k0", "sales_k1")
