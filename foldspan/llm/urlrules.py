"""URL filters: stated rules, and association rules mined from labelled URLs.

FP-growth finds the frequent combinations of URL tokens and labels. Rules that lead to the bad label are kept if
they cover a share of the bad URLs and are confident even if two more URLs, one of them good, are added to what they
cover; a rule is dropped if a part of its combination says it as surely. URLs are matched by an inverted index: each
rule is filed under its rarest token, and a URL looks up its own tokens only.

Texts of any length are taken whole. Equal URLs are judged alike and all rows returned; an empty table has no rows.
Only the id and URL columns are read, so that other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (rule, verdict): a host, and from its first slash on the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The share of the bad labelled URLs that a mined rule covers at least, and its confidence: (bad + 1) / (all + 2).
MIN_SHARE, MIN_CONFIDENCE = 0.1, 0.8
BAD, GOOD = "label:block", "label:allow"
MINED = "antecedent array<string>, anchor string, size int, confidence double, support double"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL_PARTS, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL_PARTS, 2)


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: scheme, all host labels, all path segments with their depth, all query keys; digits become 0."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    masked = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    host = F.transform(F.split(url_host(url), r"\."), lambda x: F.concat(F.lit("host:"), masked(x)))
    path = F.transform(F.split(url_path(url), "/"), lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), masked(x)))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(scheme, host, path, keys), lambda x: ~x.endswith(":"))))


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct with the ``rule`` and ``verdict`` of the longest of the rules that fits, null where none does.

    One expression over the stated rules, a list given by hand: no row leaves its partition, however hot its host. Of
    rules of one length the greater one is taken. An empty host fits none.
    """
    kind = "struct<n:int,rule:string,verdict:string,host:string,path:string>"
    rows = [(len(r), r, v, r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.partition("/")[2] if "/" in r else "") for r, v in rules]
    known = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("n", "rule", "verdict", "host", "path"), row, strict=True)]) for row in rows]).cast(f"array<{kind}>")
    return F.array_max(F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])))


def frequent_tokens(rows: DataFrame, least: float) -> dict[str, tuple[int, int]]:
    """Tokens that ``least`` or more bad rows have, with the rows that have them and a sum of hashes of these rows.

    They are found among the bad rows first, so that there are at most as many as bad rows have tokens on average, times
    bad rows over ``least``, however many other rows there are; only those are then counted in all rows.
    """
    bad = rows.where("bad").select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    names = sorted(r["token"] for r in bad.where(F.col("n") >= least).collect())
    if not names:
        return {}
    here = F.array_intersect("tokens", F.array(*[F.lit(t) for t in names]))
    tokens = rows.select(F.explode(here).alias("token"), F.xxhash64("tokens").cast("decimal(38,0)").alias("h"))
    return {r["token"]: (r["n"], r["h"]) for r in tokens.groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h")).collect()}


def mine_rules(labelled: DataFrame, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(antecedent, anchor, size, confidence, support)`` of the rules from ``tokens`` to a true ``bad``.

    Rows with null tokens or a null ``bad`` teach nothing. Of tokens that always come together only the first is an
    item of FP-growth, and a rule that has it has them all; the tokens that are frequent in bad rows, at most those of a
    bad URL over the least share, are what reaches the driver. A rule is left out if a rule on a part of its tokens is at least as
    confident. No bad rows, no rules.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.where("tokens is not null and bad is not null").select("tokens", "bad"))
    n, bad = rows.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    if not bad:
        return spark.createDataFrame([], MINED)
    least = min_share * bad
    often = frequent_tokens(rows, least)
    together: dict[tuple, list[str]] = {}
    for t in sorted(often):
        together.setdefault(often[t], []).append(t)
    groups = {ts[0]: ts for ts in together.values()}
    if not groups:
        return spark.createDataFrame([], MINED)
    items = rows.select(F.array_union(F.array_intersect("tokens", F.array(*[F.lit(t) for t in groups])), F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where((F.col("consequent")[0] == BAD) & ~F.array_contains("antecedent", GOOD))
    hits = F.round(F.col("support") * n)
    found = found.withColumn("confidence", (hits + 1) / (F.round(hits / F.col("confidence")) + 2)).where(F.col("confidence") >= min_confidence)
    wide = F.create_map(*[x for k, ts in groups.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in ts]))])
    seen = F.create_map(*[x for t, (k, _) in often.items() for x in (F.lit(t), F.lit(k))])
    all_tokens = F.array_sort(F.flatten(F.transform("antecedent", lambda t: wide[t])))
    found = found.select(all_tokens.alias("antecedent"), "confidence", "support").withColumn("size", F.size("antecedent"))
    rarest = F.array_min(F.transform("antecedent", lambda t: F.struct(seen[t].alias("n"), t.alias("token"))))
    found = cut(found.withColumn("anchor", rarest["token"]).select("antecedent", "anchor", "size", "confidence", "support"))
    part = found.select(F.col("antecedent").alias("part"), F.col("anchor").alias("token"), F.col("confidence").alias("part_confidence"), F.col("size").alias("part_size"))
    beaten = found.withColumn("token", F.explode("antecedent")).join(part, "token").where("part_size < size and part_confidence >= confidence").where(F.size(F.array_except("part", "antecedent")) == 0).select("antecedent").distinct()
    return found.join(beaten, "antecedent", "left_anti").select("antecedent", "anchor", "size", "confidence", "support")


def match_rules(df: DataFrame, rules: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``df`` with ``rule_tokens``, ``confidence`` and ``support`` of the most confident mined rule, null where none fits.

    Distinct token sets, not rows, are matched; the rows get the result of their set by an equi-join. Of rules that
    are as confident the one with more support is taken, then the greater one.
    """
    sets = df.select(F.col(tokens).alias("set")).where("set is not null").distinct()
    hits = sets.withColumn("anchor", F.explode("set")).join(rules, "anchor").where(F.size(F.array_except("antecedent", "set")) == 0)
    best = hits.groupBy("set").agg(F.max(F.struct("confidence", "support", F.array_join("antecedent", " ").alias("rule_tokens"))).alias("best"))
    out = df.join(best, F.col(tokens) == F.col("set"), "left")
    return out.withColumns({k: F.col(f"best.{k}") for k in ("rule_tokens", "confidence", "support")}).drop("set", "best")


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, rule_tokens, confidence, support)`` of every page.

    ``labelled`` has ``url`` and a boolean ``bad``; without it the pages that a stated rule fits teach the mined
    ones. A null url, or one without ``://``, has an empty host and path, fits no stated rule and is allowed unless a mined
    rule fits its tokens. Repeated pages are judged alike.
    """
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    df = df.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "tokens": url_tokens(F.col("url"))}).drop("url")
    ruled = df.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumns({"rule": F.col("stated.rule"), "rule_verdict": F.col("stated.verdict")}).drop("stated")
    if labelled is None:
        known = ruled.where("rule is not null").select("tokens", (F.col("rule_verdict") == "block").alias("bad"))
    else:
        known = labelled.select(url_tokens(F.col("url")).alias("tokens"), "bad")
    out = match_rules(ruled, mine_rules(known, min_share, min_confidence))
    verdict = F.coalesce("rule_verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rule_tokens", "confidence", "support")
