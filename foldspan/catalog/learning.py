"""Queries on models, blends that are fitted, resampling and stores; SQL where it can say the same."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from foldspan.catalog import COMPANY, LABELLED, PREDS, SCORES, SEEDED, plain, query
from foldspan.catalog.folds import S, _h
from foldspan.functions.text import char_ngrams, word_ngrams
from foldspan.operators import blends as B
from foldspan.operators import models as M
from foldspan.operators import replicates as X
from foldspan.operators import resample as R
from foldspan.operators import stacking as K
from foldspan.operators.encoders import crossed, quantile_bins
from foldspan.operators.folds import POISSON_STEPS, stratified_folds
from foldspan.plans import experiments as P
from foldspan.plans.lineage import cut, ensure_checkpoint_dir
from foldspan.sources import store
from foldspan.sources.store import stored

_NUM = ["employees", "sales", "op_profit", "assets"]


def _docs(t):
    df = t.view(LABELLED)
    f = stratified_folds(df, "id", "y", [0], 3).select(F.col("id").alias("f"), "fold")
    return df.join(f, F.col("id") == F.col("f")).drop("f")


@query("F2 F3")
def q_text_stack(t):
    return K.stacked_series(_docs(t), {"words": K.TextSetting(word_ngrams(F.col("text"), 1, 1))}, 3, 3)


@query("F4")
def q_text_series(t):
    half = F.floor(F.length("text") / 2).cast("int")
    texts = {"whole": F.col("text"), "first": F.substring("text", F.lit(1), half), "last": F.substring("text", half + 1, F.length("text"))}
    return K.stacked_series(_docs(t), {n: K.TextSetting(word_ngrams(c, 1, 1)) for n, c in texts.items()}, 3, 2)


@query("J24")
def q_text_lab(t):
    terms = {"words": word_ngrams(F.col("text"), 1, 1), "words-lower": word_ngrams(F.lower("text"), 1, 1), "chars": char_ngrams(F.col("text"), 2, 2)}
    return K.setting_table(t.view(LABELLED), {n: K.TextSetting(c) for n, c in terms.items()}, [0, 1], 2)


@query("M-A M-B M-C M-D M-F M-I")
def q_expert_preds(t):
    experts = {"linear": M.linear_expert(_NUM, ["industry", "listing"]), "trees": M.tree_expert(_NUM, rounds=8), "forest": M.forest_expert(_NUM, trees=8), "spline": M.spline_expert(["sales", "assets"]), "vector": M.vector_expert()}
    needs = {"linear": [*_NUM, "industry", "listing"], "trees": _NUM, "forest": _NUM, "spline": ["sales", "assets"], "vector": ["vec"]}
    df = t.view(COMPANY)
    return M.out_of_fold(df, {k: experts[k] for k in M.available(df.columns, needs)}, 5)


@query("M-A")
def q_boosting_rounds(t):
    """The loss after each boosted tree on the held-out fold, and the round that is kept."""
    c = t.view(COMPANY)
    return M.boosting_rounds(c.where("fold > 0"), c.where("fold = 0"), _NUM)


_PAIRS = list(combinations(["industry", "listing", "channel"], 2))
_CELLS = " UNION ALL ".join(f"SELECT fold, y, '{a}x{b}' AS \"cross\", coalesce({a}, '__MISSING__') || '||' || coalesce({b}, '__MISSING__') AS cell FROM c" for a, b in _PAIRS)


@query("F7", f"""WITH c AS ({plain(COMPANY)}), l AS ({_CELLS}), g AS (SELECT "cross", cell, fold, count(*) AS n, sum(y) AS pos FROM l GROUP BY ALL),
f AS (SELECT "cross", fold, sum(n) AS fn, sum(pos) AS fp FROM g GROUP BY ALL), r AS (SELECT "cross", fold, (sum(fp) OVER w - fp) / CAST(sum(fn) OVER w - fn AS DOUBLE) AS rate FROM f WINDOW w AS (PARTITION BY "cross")),
o AS (SELECT g.*, sum(n) OVER w - n AS other_n, sum(pos) OVER w - pos AS other_pos FROM g WINDOW w AS (PARTITION BY "cross", cell)),
p AS (SELECT o."cross", n, pos, (other_pos + 10e0 * rate) / (other_n + 10e0) AS p FROM o JOIN r ON o."cross" = r."cross" AND o.fold = r.fold),
d AS (SELECT "cross", p, sum(n) AS n, sum(pos) AS pos FROM p GROUP BY ALL),
u AS (SELECT "cross", pos, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n FROM d WINDOW w AS (PARTITION BY "cross" ORDER BY p DESC))
SELECT "cross", sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / sum(pos) AS ap FROM u GROUP BY "cross" """)
def q_screened_crosses(t):
    return M.screened_crosses(crossed(t.view(COMPANY), _PAIRS), [f"{a}x{b}" for a, b in _PAIRS], "fold")


def _scratch(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}"


_ENTITY = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("S1 S9", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def q_load_entities(t):
    path = _scratch(t)
    spoilt = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", spoilt.alias("c_acctbal"), "c_mktsegment")
    rows.where("c_custkey % 3 = 0").write.parquet(f"{path}/parquet")
    rows.where("c_custkey % 3 = 1").write.option("header", True).csv(f"{path}/csv")
    rows.where("c_custkey % 3 = 2").write.option("header", False).csv(f"{path}/bare")
    schema = t.spark.createDataFrame([], _ENTITY).schema
    bare = store.nan_to_null(store.load_headerless(t.spark, f"{path}/bare", schema))
    return store.load_entities(t.spark, f"{path}/parquet", schema).unionByName(store.load_entities(t.spark, f"{path}/csv", schema, "csv")).unionByName(bare)


@query("S5", f"SELECT seed, model, id, p, 'base' AS config, '5' AS folds FROM ({plain(PREDS)}) x")
def q_saved_run(t):
    path = _scratch(t)
    store.save_run(t.view(PREDS).withColumn("config", F.lit("base")), {"folds": 5}, path)
    preds, settings = store.load_run(t.spark, path)
    return preds.select("seed", "model", "id", "p", "config", F.lit(settings["folds"]).alias("folds"))


@query("S8 S10 S11 S12", f"""{S}, m AS (SELECT fold, count(*) AS n, sum(y) AS pos, avg(p1) AS mean_p FROM s GROUP BY 1)
SELECT fold, n, CAST(pos AS BIGINT) AS pos, mean_p, true AS refused, 'PARK' AS verdict, CAST(2 AS BIGINT) AS decisions FROM m""")
def q_result_sinks(t):
    path = _scratch(t)
    s = t.view(SCORES).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.avg("p1").alias("mean_p"))
    store.write_scores(s.select("fold", "mean_p"), f"{path}/scores")
    try:
        store.write_scores(s.select("fold", "mean_p"), f"{path}/scores")
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "ALREADY_EXISTS" in str(e)
    store.write_records(s.select("fold", F.struct("n", "pos").alias("counts")), f"{path}/records")
    for verdict in ("REJECT", "PARK"):
        store.append_decision(t.spark, f"{path}/log", "base", verdict, "by fold")
    log = t.spark.read.parquet(f"{path}/log").agg(F.max_by("verdict", "at").alias("verdict"), F.count("*").alias("decisions"))
    records = t.spark.read.schema("fold int, counts struct<n:bigint,pos:bigint>").json(f"{path}/records").select("fold", "counts.*")
    rows = records.join(t.spark.read.parquet(f"{path}/scores"), "fold").withColumn("refused", F.lit(refused))
    return rows.crossJoin(F.broadcast(log))  # one row


@query("M-E")
def q_vector_expert(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") < 3).cast("int").alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"))
    return M.out_of_fold(v, {"vector": M.vector_expert()}, 3)


@query("M-H")
def q_importances(t):
    return M.fold_importances(t.view(COMPANY), _NUM)


@query("M-J")
def q_error_probability(t):
    s = t.view(SCORES).withColumns({"l": (F.col("p1") >= 0.6).cast("int"), "fold": F.col("fold") % 3})
    return M.error_probability(s, "l", ["p1", "p2"])


@query("J17")
def q_shuffled_errors(t):
    s = t.view(SCORES).withColumns({"l": (F.col("p1") >= 0.6).cast("int"), "fold": F.col("fold") % 3})
    return X.error_replicates(s, "l", ["p1", "p2"], 20, 3)


@query("M-K")
def q_ridge_residual(t):
    s = t.view(SCORES).withColumns({"residual": F.col("y") - F.col("p1"), "fold": F.col("fold") % 3})
    return M.ridge_residual(s, "residual", ["p2", "p3"])


@query("M-L")
def q_offset_correction(t):
    s = t.view(SCORES)
    return M.offset_correction(s.where("fold > 0"), s.where("fold = 0"), "p1", ["p2", "p3"])


@query("B4 B6 B7")
def q_meta_blend(t):
    out, _ = B.cross_fitted_meta(t.view(SCORES).withColumn("fold", F.col("fold") % 3), ["p1", "p2", "p3"], k=3, grid=(0.001, 0.1), inner=2)
    return out.select("id", "p")


@query("J23")
def q_fixed_alpha(t):
    return B.fixed_alphas(t.view(SCORES).withColumn("fold", F.col("fold") % 3), ["p1", "p2", "p3"], (0.001, 0.1))


@query("B5")
def q_meta_spread(t):
    m = B.fit_meta_spread(t.view(SCORES), ["p1", "p2"], alpha=0.05, steps=15)
    return m.apply(t.view(SCORES)).select("id", "p")


@query("B10")
def q_ges(t):
    z = t.view(SEEDED)
    long = z.select("seed", "id", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("p1").alias("p")), F.struct(F.lit("b").alias("model"), F.col("p2").alias("p")))).alias("x")).select("seed", "id", "x.*")
    members = B.greedy_ensemble(long, z.where("seed = 0").select("id", "y"), "a", 3)
    return B.weighted(long, {m: members.count(m) / len(members) for m in set(members)})


@query("B11")
def q_anchored(t):
    s = t.view(SCORES)
    lam = B.anchored_lambda(s, "p1", "p2", grid=(0.0, 0.2, 0.4))
    return s.select("id", F.lit(lam).alias("lam"), ((1 - lam) * F.col("p1") + lam * F.col("p2")).alias("p"))


@query("F7")
def q_select_crosses(t):
    columns = ["sales_bin", "assets_bin", "industry", "listing", "channel"]
    pairs = list(combinations(columns, 2))
    c = crossed(quantile_bins(t.view(COMPANY), ["sales", "assets"]), pairs).withColumn("inner", F.col("fold") % 2)
    names = [f"{a}x{b}" for a, b in pairs]
    chosen = M.select_crosses(c, names, k=2, base_categorical=columns, screen=3)
    return c.select("id", *[F.col(n) for n in names], F.lit(",".join(chosen)).alias("chosen"))


_WEIGHT = "(" + " + ".join(f"CAST(u >= {c!r} AS INT)" for c in POISSON_STEPS) + ")"
_BOOT = f"b AS (SELECT *, {_WEIGHT} AS w FROM (SELECT s.*, rep, {_h("'boot0'", 'rep', 'id')} / 4294967296e0 AS u FROM s CROSS JOIN range(0, 20) r(rep)))"
_STEPS = "0.02e0 + k * 0.01e0"


@query("K10 M9", f"""{S}, {_BOOT}, g AS (SELECT rep, p1 AS p, sum(w) AS n, sum(w * y) AS pos FROM b GROUP BY 1, 2), a AS (SELECT rep, sum(pos) AS positives FROM g GROUP BY 1),
c AS (SELECT g.rep, k, sum(CASE WHEN p >= {_STEPS} THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= {_STEPS} THEN n ELSE 0 END) AS predicted FROM g CROSS JOIN range(0, 97) t(k) GROUP BY 1, 2),
f AS (SELECT rep, k, coalesce(2e0 * tp / nullif(predicted + positives, 0), 0) AS f1 FROM c JOIN a USING (rep))
SELECT CAST(rep AS INT) AS rep, f1 AS best_f1, {_STEPS} AS best_t FROM f QUALIFY row_number() OVER (PARTITION BY rep ORDER BY f1 DESC, k) = 1""")
def q_bootstrap(t):
    return R.bootstrap_threshold(t.view(SCORES).withColumn("p", F.col("p1")), replicates=20)


_AUC = """(SELECT {by} sum((w_n - w_pos) * (above + w_pos / 2e0)) / (any_value(tp) * (any_value(tn) - any_value(tp))) AS auc FROM (
SELECT *, coalesce(sum(w_pos) OVER ({part} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(w_pos) OVER ({part}) AS tp, sum(w_n) OVER ({part}) AS tn
FROM (SELECT {by} p, CAST(sum(w) AS DOUBLE) AS w_n, CAST(sum(w * y) AS DOUBLE) AS w_pos FROM {rows} GROUP BY {by} p)) {group})"""


@query("K11 J16", f"""{S}, z AS (SELECT id, y, p1 AS p, 1 AS w, rep FROM s CROSS JOIN range(0, 20) r(rep) WHERE p1 BETWEEN 0.5 AND 0.7),
a AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY {_h("'permA0'", 'rep', 'id')}, id) AS pos FROM z), b AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {_h("'permB0'", 'rep', 'id')}, id) AS pos FROM z),
m AS (SELECT a.rep, p, w, b.y FROM a JOIN b USING (rep, pos)), n AS {_AUC.format(by="rep,", part="PARTITION BY rep", rows="m", group="GROUP BY rep")}, real AS {_AUC.format(by="", part="", rows="(SELECT * FROM z WHERE rep = 0)", group="")}
SELECT any_value(real.auc) AS auc, avg(n.auc) AS null_mean, stddev_samp(n.auc) AS null_sd, (count(*) FILTER (n.auc >= real.auc) + 1) / (count(*) + 1e0) AS p_value FROM n CROSS JOIN real""")
def q_perm_auc(t):
    return R.permutation_auc(t.view(SCORES).where("p1 between 0.5 and 0.7"), p="p1", replicates=20)


@query("X16", f"""{S}, {_BOOT}, l AS (SELECT rep, w, y, p1 AS p, 'a' AS model FROM b UNION ALL SELECT rep, w, y, p2 AS p, 'b' AS model FROM b), n AS {_AUC.format(by="rep, model,", part="PARTITION BY rep, model", rows="(SELECT * FROM l WHERE w > 0)", group="GROUP BY rep, model")},
d AS (SELECT rep, max(auc) FILTER (model = 'b') - max(auc) FILTER (model = 'a') AS d FROM n GROUP BY rep)
SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.5) AS mid, quantile_cont(d, 0.975) AS hi, avg(CAST(d > 0 AS DOUBLE)) AS share_positive FROM d""")
def q_bootstrap_delta(t):
    return R.bootstrap_auc_delta(t.view(SCORES), "p1", "p2", replicates=20)


@query("K10 M9")
def q_bootstrap_groups(t):
    return X.threshold_replicates(t.view(SCORES), p="p1", replicates=1000)


@query("K11 J16")
def q_perm_auc_groups(t):
    return X.permutation_test(t.view(SCORES).where("p1 between 0.5 and 0.7"), p="p1", replicates=2000)


@query("X16")
def q_bootstrap_delta_groups(t):
    return X.auc_delta_interval(t.view(SCORES), "p1", "p2", replicates=1000)


@query("X24")
def q_adjusted_effect(t):
    return X.adjusted_effect(t.view(SCORES), "p1", ["p2", "p3"], replicates=1000)


@query("X15")
def q_adversarial(t):
    c = t.view(COMPANY).withColumns({"part": (F.col("sales") > 500).cast("int"), "fold": F.col("fold") % 2})
    return M.adversarial_auc(c, "part", ["employees", "assets"], k=2)


@query("X19")
def q_topics(t):
    return M.topic_table(t.view(LABELLED), word_ngrams(F.col("text"), 1, 1), 4)


@query("X20")
def q_clusters(t):
    return M.cluster_table(t.view(LABELLED), word_ngrams(F.col("text"), 1, 1), 4, 4)


@query("J6 J7")
def q_hypothesis(t):
    c = t.view(COMPANY)
    base = P.repeated_scores(c, M.linear_expert(["sales", "assets"]), [0, 1], "base", 2)
    cand = P.repeated_scores(P.composed(["survey_steps"])(c), M.linear_expert(["sales", "assets", "q1_high", "q2_low"]), [0, 1], "cand", 2)
    return P.judge(base, cand, "base", "cand")


@query("J8 M-G")
def q_holdout_run(t):
    experts = {"a": M.linear_expert(["sales", "assets"]), "b": M.linear_expert(["employees"], ["industry"])}
    return P.holdout_run(t.view(COMPANY).drop("fold"), experts, k=2)


@query("J22")
def q_determinism(t):
    from foldspan.operators.compare import drift

    c = t.view(COMPANY)
    fit = lambda: M.tree_expert(_NUM, rounds=5)(c.where("fold > 0"), c.where("fold = 0"))
    return drift(fit(), fit())


@query("S4 S6", f"{S} SELECT id, p1 AS p, 'base' AS config, 'f1' AS fingerprint FROM s")
def q_stored_preds(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/preds-{uuid.uuid4().hex}"
    make = lambda: t.view(SCORES).select("id", F.col("p1").alias("p"))
    stored(t.spark, path, "base", make, "f1")
    return stored(t.spark, path, "base", make, "f1")


@query("S6", f"{S} SELECT 'same split' AS asked, id, p1 AS p, 'f1' AS fingerprint FROM s UNION ALL SELECT 'other split', id, p2, 'f2' FROM s")
def q_stored_other_split(t):
    """What is stored is reused for its own split, whatever the new computation, and computed again for another one."""
    path = f"{ensure_checkpoint_dir(t.spark)}/preds-{uuid.uuid4().hex}"
    make = lambda p: lambda: t.view(SCORES).select("id", F.col(p).alias("p"))
    stored(t.spark, path, "base", make("p1"), "f1")
    # read before the second split overwrites it
    same = cut(stored(t.spark, path, "base", make("p3"), "f1"))
    other = stored(t.spark, path, "base", make("p2"), "f2")
    asked = lambda df, name: df.select(F.lit(name).alias("asked"), "id", "p", "fingerprint")
    return asked(same, "same split").unionByName(asked(other, "other split"))
