"""Queries on exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.catalog import COMPANY, LABELLED, plain, query
from foldspan.functions import text as T
from foldspan.operators import explore as X

C = f"WITH c AS ({plain(COMPANY)})"
L = f"WITH l AS ({plain(LABELLED)})"
_COLS = ("industry", "listing", "offices", "q9")


@query("X1", f"""{C} SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS col, '{k}' AS type, count(DISTINCT {c}) AS n_distinct, CAST(count(*) - count({c}) AS BIGINT) AS n_null, (count(*) - count({c})) / count(*) AS null_share FROM c" for c, k in zip(_COLS, ('string', 'string', 'double', 'int'), strict=True))})""".replace("AS col,", 'AS "column",'))
def q_profile(t):
    return X.profile(t.view(COMPANY), _COLS)


@query("X2", f"{C} SELECT listing AS value, count(*) FILTER (offices IS NULL) AS n_missing, count(*) FILTER (offices IS NOT NULL) AS n_present FROM c GROUP BY 1")
def q_missing_crosstab(t):
    return X.missing_crosstab(t.view(COMPANY), "listing", "offices")


@query("X3", f"{C} SELECT industry, count(*) AS n, avg(CAST(offices IS NULL AS INT)) AS offices_missing, avg(CAST(q9 IS NULL AS INT)) AS q9_missing FROM c GROUP BY industry")
def q_missing_by(t):
    return X.missing_by(t.view(COMPANY), "industry", ["offices", "q9"])


@query("X4", f"""{C} SELECT 'offices' AS "column", avg(y) FILTER (offices IS NULL) AS rate_missing, avg(y) FILTER (offices IS NOT NULL) AS rate_present FROM c UNION ALL SELECT 'listing', avg(y) FILTER (listing IS NULL), avg(y) FILTER (listing IS NOT NULL) FROM c""")
def q_target_by_missing(t):
    return X.target_by_missing(t.view(COMPANY), ["offices", "listing"])


_TERMS = ("###", "!!", "tion", "heit", "quell")


@query("X5", f"{L}, k AS (SELECT term, y, contains(text, term) AS hit FROM l CROSS JOIN (SELECT unnest({list(_TERMS)}) AS term)) SELECT term, count(*) FILTER (hit) AS n, avg(y) FILTER (hit) AS rate_with, avg(y) FILTER (NOT hit) AS rate_without, avg(y) FILTER (hit) - avg(y) FILTER (NOT hit) AS difference FROM k GROUP BY term")
def q_keyword_rate(t):
    return X.keyword_rates(t.view(LABELLED), "text", _TERMS)


@query("X6", f"{C} SELECT CAST(sales >= 0 AS INT) + CAST(sales >= 250 AS INT) + CAST(sales >= 500 AS INT) + CAST(sales >= 750 AS INT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, avg(y) AS rate FROM c GROUP BY 1")
def q_rate_by_bin(t):
    return X.rate_by_bin(t.view(COMPANY), "sales", [0, 250, 500, 750])


_W = lambda s: f"(hits / n + 1.96e0 * 1.96e0 / (2 * n) {s} 1.96e0 * sqrt(hits / n * (1 - hits / n) / n + 1.96e0 * 1.96e0 / (4.0 * n * n))) / (1 + 1.96e0 * 1.96e0 / n)"


@query("X7", f"{C}, m AS (SELECT median(sales) AS a, median(assets) AS b, median(employees) AS d, avg(y) AS r FROM c), g AS (SELECT CAST(sales > a AS INT) AS sales_high, CAST(assets > b AS INT) AS assets_high, CAST(employees > d AS INT) AS employees_high, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, max(r) AS r FROM c, m GROUP BY 1, 2, 3) SELECT * EXCLUDE (r), hits / n AS rate, {_W('-')} AS lo, {_W('+')} AS hi, hits / n / r AS lift FROM g")
def q_segment_table(t):
    return X.segment_table(t.view(COMPANY), ["sales", "assets", "employees"])


@query("X8", f"{C}, m AS (SELECT median(sales) AS a, median(assets) AS b, median(employees) AS d FROM c) SELECT CAST(sales > a AS INT) + CAST(assets > b AS INT) AS n_high, CAST(employees > d AS INT) AS third_high, count(*) AS n, avg(y) AS rate FROM c, m GROUP BY 1, 2")
def q_readiness(t):
    return X.readiness_table(t.view(COMPANY), ["sales", "assets"], "employees")


_NUM = ("sales", "offices", "op_profit")
_U = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, y, {c} AS v FROM c WHERE {c} IS NOT NULL" for c in _NUM) + ")"


@query("X9")
def q_mann_whitney_p(t):
    return X.mann_whitney(t.view(COMPANY), _NUM)


@query("X9", f"""{C}, {_U}, g AS (SELECT col, v, count(*) AS n, sum(y) AS p FROM u GROUP BY 1, 2), k AS (SELECT *, sum(p) OVER (PARTITION BY col ORDER BY v DESC) AS cp FROM g), a AS (SELECT col, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(p) AS DOUBLE) AS n1, sum((n - p) * (cp - p / 2.0)) AS u, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM k GROUP BY col)
SELECT col AS "column", CAST(n AS BIGINT) AS n, u, u / (n1 * (n - n1)) AS auc, 2 * u / (n1 * (n - n1)) - 1 AS cliffs_delta, (u - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM a""")
def q_mann_whitney(t):
    return X.mann_whitney(t.view(COMPANY), _NUM).drop("p_value")


@query("X10", f"""{C}, {_U}, a AS (SELECT col, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0, var_samp(v) FILTER (y = 1) AS v1, var_samp(v) FILTER (y = 0) AS v0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, corr(v, y) AS r FROM u GROUP BY col) SELECT col AS "column", (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS cohens_d, r AS point_biserial FROM a""")
def q_effect_size(t):
    return X.effect_size(t.view(COMPANY), _NUM)


_LOGP = "lgamma(a + b + 1) + lgamma(n - a - b + 1) + lgamma(a + c + 1) + lgamma(n - a - c + 1) - lgamma(n + 1) - lgamma({x} + 1) - lgamma(a + b - {x} + 1) - lgamma(a + c - {x} + 1) - lgamma(n - a - b - a - c + {x} + 1)"


@query("X11", f"""WITH k AS ({plain(COMPANY)}), g AS (SELECT industry, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM k GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM g),
f AS (SELECT industry, a, b, CAST(ta - a AS BIGINT) AS c, CAST(tb - b AS BIGINT) AS d, CAST(ta + tb AS BIGINT) AS n FROM g CROSS JOIN t),
x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - n), least(a + b, a + c) + 1)) AS x FROM f),
p AS (SELECT *, {_LOGP.format(x="x")} AS lp, {_LOGP.format(x="a")} AS here FROM x)
SELECT industry, a, b, c, d, least(1e0, sum(exp(lp)) FILTER (lp <= here + 1e-7)) AS fisher_p FROM p GROUP BY ALL HAVING true""".replace(" GROUP BY ALL HAVING true", " GROUP BY industry, a, b, c, d"))
def q_fisher(t):
    c = t.view(COMPANY)
    g = c.groupBy("industry").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).crossJoin(F.broadcast(c.agg(F.count_if(F.col("y") == 1).alias("ta"), F.count_if(F.col("y") == 0).alias("tb"))))
    return X.fisher_2x2(g.select("industry", "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d")))


_TESTS = "SELECT s_suppkey AS id, (s_suppkey * 37 % 101 + 1) / 2000e0 AS p FROM {supplier}"


@query("X12", f"WITH t AS ({plain(_TESTS)}), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM t) SELECT id, p, least(min(p * m / k) OVER (ORDER BY p DESC), 1.0) AS q FROM r")
def q_bh_fdr(t):
    return X.bh_fdr(t.view(_TESTS), "p", "id")


@query("X13", f"""{C}, g AS (SELECT industry, CAST(fold = 4 AS INT) AS s, count(*) AS o FROM c GROUP BY 1, 2), r AS (SELECT industry, sum(o) AS r FROM g GROUP BY 1), k AS (SELECT s, sum(o) AS k FROM g GROUP BY 1), f AS (SELECT coalesce(o, 0) AS o, r * k / (SELECT sum(k) FROM k) AS e FROM r CROSS JOIN k LEFT JOIN g ON r.industry = g.industry AND k.s = g.s) SELECT sum((o - e) * (o - e) / e) AS chi2, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS dof FROM f""")
def q_chi2(t):
    return X.chi2_two_sample(t.view(COMPANY).withColumn("s", (F.col("fold") == 4).cast("int")), "s", "industry")


@query("X14", f"""{C}, u AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, CAST(fold = 4 AS INT) AS s, {c} AS v FROM c WHERE {c} IS NOT NULL" for c in _NUM)}), g AS (SELECT col, v, sum(s) AS a, sum(1 - s) AS b FROM u GROUP BY 1, 2), k AS (SELECT col, sum(a) OVER w / sum(a) OVER (PARTITION BY col) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY col) AS fb FROM g WINDOW w AS (PARTITION BY col ORDER BY v)) SELECT col AS "column", max(abs(fa - fb)) AS ks FROM k GROUP BY col""")
def q_ks(t):
    return X.ks_two_sample(t.view(COMPANY), _NUM, (F.col("fold") == 4).cast("int"))


@query("X17", f"""WITH d AS (SELECT p_partkey AS id, p_name AS c, CAST(p_size < 15 AS INT) AS y FROM part), g AS (SELECT DISTINCT id, y, unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) AS term FROM d),
a AS (SELECT term, count(*) AS df, CAST(sum(y) AS BIGINT) AS hits FROM g GROUP BY term HAVING count(*) >= 5), t AS (SELECT count(*) AS n, sum(y) / count(*) AS p, sum(y) AS pos FROM d)
SELECT term, df, hits, hits / df AS rate, CASE WHEN n > df THEN (hits / df - (pos - hits) / (n - df)) / sqrt(p * (1 - p) * (1.0 / df + 1.0 / (n - df))) END AS z FROM a, t""")
def q_ngram_scan(t):
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_size") < 15).cast("int").alias("y"))
    return X.char_ngram_scan(p, F.col("p_name"), 3, 3).drop("p_value", "q")


@query("X18", f"{L} SELECT md5(text) AS digest, count(*) AS n, min(id) AS first_id, min(y) <> max(y) AS conflict FROM l GROUP BY md5(text) HAVING count(*) > 1")
def q_duplicates(t):
    return X.duplicate_groups(t.view(LABELLED), "text", "id")




def _outline(t):
    df = t.view(LABELLED).select("id", "y", F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("\n  ")), F.lit(". "), F.lit("\n")).alias("text"))
    return df, X.outline_nodes(df, "id", "text")


_LINES = f"""{L}, r AS (SELECT id, y, unnest(s) AS raw, generate_subscripts(s, 1) AS line FROM (SELECT id, y, string_split(replace(replace(text, ', ', chr(10) || '  '), '. ', chr(10)), chr(10)) AS s FROM l)),
k AS (SELECT id, y, line, trim(regexp_replace(regexp_replace(raw, '[│├└─┬|+`]|--+', ' ', 'g'), '[(（][^)）]*[)）]', '', 'g'), ' ') AS node, CAST(floor((length(raw) - length(ltrim(regexp_replace(raw, '[│├└─┬|+`]', ' ', 'g'), ' '))) / 2) AS INT) AS depth FROM r),
n AS (SELECT *, CAST(coalesce(lead(depth) OVER (PARTITION BY id ORDER BY line), -1) <= depth AS INT) AS leaf FROM k WHERE node <> '')"""


@query("X21", f"{_LINES} SELECT id, count(*) AS n_nodes, max(depth) AS max_depth, CAST(sum(leaf) AS BIGINT) AS n_leaves, count(*) FILTER (ends_with(node, 'ing')) AS n_ing, count(*) FILTER (ends_with(node, 'en')) AS n_en FROM n GROUP BY id")
def q_outline_nodes(t):
    return X.outline_summary(_outline(t)[1], {"ing": "ing", "en": "en"})


@query("X22", f"{_LINES}, d AS (SELECT id, max(y) AS y, coalesce(min(depth) FILTER (contains(node, 'tion')), -1) AS depth_class FROM n GROUP BY id) SELECT depth_class, count(*) AS n, avg(y) AS rate FROM d GROUP BY 1")
def q_depth_rate(t):
    df, nodes = _outline(t)
    return X.depth_rates(nodes, df.select("id", "y"), "tion")


@query("X23", f"{_LINES}, d AS (SELECT DISTINCT id, y, node FROM n) SELECT x.node AS a, z.node AS b, count(*) AS n, avg(x.y) AS rate FROM d x JOIN d z ON x.id = z.id AND x.node < z.node GROUP BY 1, 2 HAVING count(*) >= 3")
def q_pair_support(t):
    df, nodes = _outline(t)
    return X.pair_support(nodes, df.select("id", "y"), 3)
