"""Exploratory statistics as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.operators.metrics import score_steps
from foldspan.operators.ranks import column_percentiles, prefix_sums, value_range
from foldspan.plans.lineage import cut


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """By column: type, distinct values, nulls and their share; one pass over (column, value) pairs."""
    cols = list(cols or df.columns)
    kinds = dict(df.dtypes)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
    g = pairs.groupBy("column", "type", "v").agg(F.count("*").alias("n"))
    return g.groupBy("column", "type").agg(F.count("v").alias("n_distinct"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum("n").alias("n")).withColumn("null_share", F.col("n_null") / F.col("n")).drop("n")


def missing_crosstab(df: DataFrame, value: str, other: str) -> DataFrame:
    return df.groupBy(F.col(value).cast("string").alias("value")).agg(F.count_if(F.col(other).isNull()).alias("n_missing"), F.count_if(F.col(other).isNotNull()).alias("n_present"))


def missing_by(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in cols])


def target_by_missing(df: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    long = df.select(y, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("gone")) for c in cols])).alias("x")).select(y, "x.*")
    return long.groupBy("column").agg(F.avg(F.when(F.col("gone"), F.col(y).cast("double"))).alias("rate_missing"), F.avg(F.when(~F.col("gone"), F.col(y).cast("double"))).alias("rate_present"))


def keyword_rates(df: DataFrame, text: str, terms: Sequence[str], y: str = "y") -> DataFrame:
    """By term: rows with it, target rates with and without it, their difference."""
    some = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.contains(F.col(text), F.lit(t)), F.lit(False)).alias("hit")) for t in terms]))
    long = df.select(F.col(y).cast("double").alias("y"), some.alias("x")).select("y", "x.*")
    out = long.groupBy("term").agg(F.count_if(F.col("hit")).alias("n"), F.avg(F.when(F.col("hit"), F.col("y"))).alias("rate_with"), F.avg(F.when(~F.col("hit"), F.col("y"))).alias("rate_without"))
    return out.withColumn("difference", F.col("rate_with") - F.col("rate_without"))


def rate_by_bin(df: DataFrame, p: str, edges: Sequence[float], y: str = "y") -> DataFrame:
    b = sum((F.col(p) >= float(e)).cast("int") for e in edges[1:]) + (F.col(p) >= float(edges[0])).cast("int")
    return df.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(y).cast("bigint").alias("hits"), F.avg(F.col(y).cast("double")).alias("rate"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, n = hits / n, n.cast("double")
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def _medians(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    return column_percentiles(df, axes, [0.5]).select(*[F.col(f"q{i}")[0].alias(f"__m{i}") for i in range(len(axes))])


def segment_table(df: DataFrame, axes: Sequence[str], y: str = "y") -> DataFrame:
    """Cells of median-split axes: n, hits, rate, Wilson interval, lift over all rows."""
    m = _medians(df, axes).crossJoin(df.agg(F.avg(F.col(y).cast("double")).alias("__rate")))  # one row each
    cells = df.crossJoin(F.broadcast(m)).groupBy(*[(F.col(a) > F.col(f"__m{i}")).cast("int").alias(f"{a}_high") for i, a in enumerate(axes)])
    g = cells.agg(F.count("*").alias("n"), F.sum(y).cast("bigint").alias("hits"), F.first("__rate").alias("__rate"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return g.withColumns({"rate": F.col("hits") / F.col("n"), "lo": lo, "hi": hi, "lift": F.col("hits") / F.col("n") / F.col("__rate")}).drop("__rate")


def readiness_table(df: DataFrame, axes: Sequence[str], third: str, y: str = "y") -> DataFrame:
    """Target rate by the number of high axes and by a third axis, all split at their medians."""
    m = _medians(df, [*axes, third])
    high = [(F.col(a) > F.col(f"__m{i}")).cast("int") for i, a in enumerate([*axes, third])]
    g = df.crossJoin(F.broadcast(m)).groupBy(sum(high[1:-1], high[0]).alias("n_high"), high[-1].alias("third_high"))
    return g.agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal law; applied to tables of tests, one row each. Spark has no built-in."""
    return F.arrow_udf(lambda v: pa.array([None if x is None else math.erfc(abs(x) / math.sqrt(2)) for x in v.to_pylist()], pa.float64()), "double")(z)


def mann_whitney(df: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    """By column: AUC, U, tie-corrected normal p and Cliff's delta of the two classes."""
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("p")) for c in cols])).alias("x")).select("y", "x.*")
    s = score_steps(long, ["column"], "y", "p")
    neg, n = F.col("n") - F.col("pos"), F.col("n").cast("double")
    g = s.groupBy("column").agg(F.sum("n").cast("double").alias("n"), F.sum("pos").cast("double").alias("n1"), F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("u"), F.sum(n * n * n - n).alias("ties"))
    n1, n0, t = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    sd = F.sqrt(n1 * n0 / 12 * (t + 1 - F.col("ties") / (t * (t - 1))))
    z = F.try_divide(F.col("u") - n1 * n0 / 2, sd)
    return g.select("column", F.col("n").cast("bigint").alias("n"), F.col("u"), F.try_divide(F.col("u"), n1 * n0).alias("auc"), (2 * F.try_divide(F.col("u"), n1 * n0) - 1).alias("cliffs_delta"), z.alias("z"), normal_tail(z).alias("p_value"))


def effect_size(df: DataFrame, cols: Sequence[str], y: str = "y") -> DataFrame:
    """By column: Cohen's d with the pooled sample variance, and the point-biserial correlation."""
    long = df.select(F.col(y).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("y", "x.*")
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    g = long.where("v is not null").groupBy("column").agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), F.count(one).alias("n1"), F.count(zero).alias("n0"), F.corr("v", "y").alias("r"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return g.select("column", F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"), F.col("r").alias("point_biserial"))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher test of a 2x2 table: the sum over tables with its margins that are no likelier."""
    n, r, k = a + b + c + d, a + b, a + c
    lg = math.lgamma
    logp = lambda x: lg(r + 1) + lg(n - r + 1) + lg(k + 1) + lg(n - k + 1) - lg(n + 1) - lg(x + 1) - lg(r - x + 1) - lg(k - x + 1) - lg(n - r - k + x + 1)
    here = logp(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, r + k - n), min(r, k) + 1) if (p := logp(x)) <= here + 1e-7))


def fisher_2x2(tables: DataFrame) -> DataFrame:
    """``tables`` (one row each, counts a b c d) with ``fisher_p``; counts come from aggregates, one row a test."""
    run = F.pandas_udf(lambda a, b, c, d: pd.Series([fisher_p(*map(int, v)) for v in zip(a, b, c, d, strict=True)], dtype="float64"), "double")
    return tables.withColumn("fisher_p", run("a", "b", "c", "d"))


def bh_fdr(tests: DataFrame, p: str, key: str) -> DataFrame:
    """``tests`` with ``q``: Benjamini-Hochberg. Ranks and the running minimum go over ranges of p."""
    g = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    ranked = prefix_sums(g, [], "__p", ["__n"])
    m = g.agg(F.sum("__n").alias("__m"))
    q = ranked.crossJoin(F.broadcast(m)).withColumn("__v", F.col("__p") * F.col("__m") / F.col("cum___n"))
    # reverse running minimum in two steps: minima of ranges, then inside ranges
    q = q.withColumn("__range", value_range(g, "__p"))
    later = Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = q.groupBy("__range").agg(F.min("__v").alias("__low")).select(F.col("__range").alias("__r"), F.min("__low").over(later).alias("__tail"))
    inside = Window.partitionBy("__range").orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("__v", F.min("__v").over(inside)).join(tails, F.col("__range") == F.col("__r"))
    q = q.select("__p", F.least(F.col("__v"), F.coalesce("__tail", "__v"), F.lit(1.0)).alias("q"))
    return tests.join(q, F.col(p) == F.col("__p"), "left").drop("__p")


def chi2_two_sample(df: DataFrame, part: str, col: str) -> DataFrame:
    """One row: chi-square of the distribution of a category in two parts, and its degrees of freedom."""
    g = df.groupBy(F.col(col).alias("c"), F.col(part).alias("s")).agg(F.count("*").cast("double").alias("o"))
    rows, cols = g.groupBy("c").agg(F.sum("o").alias("r")), g.groupBy("s").agg(F.sum("o").alias("k"))
    full = rows.crossJoin(F.broadcast(cols)).join(g.select(F.col("c").alias("c2"), F.col("s").alias("s2"), "o"), F.col("c").eqNullSafe(F.col("c2")) & (F.col("s") == F.col("s2")), "left")
    n = cols.agg(F.sum("k").alias("t"))
    e = F.col("r") * F.col("k") / F.col("t")
    d = F.coalesce("o", F.lit(0.0)) - e
    return full.crossJoin(F.broadcast(n)).agg(F.sum(d * d / e).alias("chi2"), ((F.count_distinct(F.coalesce(F.col("c").cast("string"), F.lit("\0"))) - 1) * (F.count_distinct("s") - 1)).alias("dof"))


def ks_two_sample(df: DataFrame, cols: Sequence[str], part: Column) -> DataFrame:
    """By column: the largest distance of the two parts' distribution functions; ``part`` is 0 or 1."""
    long = df.select(part.alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("p")) for c in cols])).alias("x")).select("y", "x.*")
    s = score_steps(long, ["column"], "y", "p")
    t = s.groupBy("column").agg(F.sum("pos").alias("t1"), F.sum("n").alias("t"))
    gap = F.abs(F.col("cum_pos") / F.col("t1") - (F.col("cum_n") - F.col("cum_pos")) / (F.col("t") - F.col("t1")))
    return s.join(t, "column").groupBy("column").agg(F.max(gap).alias("ks"))


def duplicate_groups(df: DataFrame, text: str, id_col: str, y: str = "y") -> DataFrame:
    """Texts that occur twice or more: rows, first id, whether their labels disagree."""
    g = df.groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), (F.min(y) != F.max(y)).alias("conflict"))
    return g.where("n > 1")


def group_rates(df: DataFrame, group: str, y: str = "y") -> DataFrame:
    """Size, target rate and lift of groups such as topics or clusters."""
    base = df.agg(F.avg(F.col(y).cast("double")).alias("__b"))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate")).crossJoin(F.broadcast(base)).withColumn("lift", F.try_divide(F.col("rate"), F.col("__b"))).drop("__b")


def terms_rates(df: DataFrame, id_col: str, terms: Column, y: str = "y", least: int = 5) -> DataFrame:
    """By term: texts that hold it, hits among them, rate; terms of fewer texts are left out."""
    rows = df.select(F.col(y).cast("int").alias("y"), F.explode(F.array_distinct(terms)).alias("term"))
    g = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("y").cast("bigint").alias("hits"))
    return g.where(F.col("df") >= least).withColumn("rate", F.col("hits") / F.col("df"))


#: Bits of a bit map that tasks get; a power of two.
MAP_BITS = 1 << 22


def bit_map(numbers: DataFrame, col: str, bits: int = MAP_BITS) -> np.ndarray:
    """Which of the buckets 0 to ``bits`` - 1 are among the numbers; the driver gets ``bits`` / 64 words at most."""
    word = numbers.groupBy(F.shiftright(col, 6).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({col} & 63 AS INT)))").alias("b"))
    out = np.zeros(bits // 64, np.uint64)
    for r in word.collect():
        out[r["w"]] = r["b"] & (1 << 64) - 1
    return out


def _has(words: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (words[bucket >> 6] >> (bucket & 63).astype(np.uint64)) & np.uint64(1) > 0


def grown_ngrams(df: DataFrame, text: Column, low: int, high: int, y: str = "y", least: int = 5, bits: int = MAP_BITS) -> DataFrame:
    """``(term, df, hits, rate)`` of the character n-grams of ``low`` to ``high`` characters that ``least`` texts hold.

    Lengths grow one by one. An n-gram is shuffled and counted only if both its ends of n - 1 characters are frequent,
    by a bit map of the hashes of those of the level before; a collision costs a count, never a result. So what is
    shuffled grows with the frequent n-grams and not with the rare ones. A null text has none.
    """
    rows, out, known = df.select(F.col(y).cast("int").alias("y"), text.alias("text")).where("text is not null"), None, None
    for n in range(1, high + 1):
        every = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(n))), lambda g: F.length(g) == n)
        grams = rows.select("y", F.explode(F.array_distinct(every)).alias("term"))
        if known is not None:
            shared = known
            ends = [F.pmod(F.xxhash64(F.substring("term", F.lit(at), F.lit(n - 1))), F.lit(bits)) for at in (1, 2)]
            both = F.arrow_udf(lambda a, b, shared=shared: pa.array(_has(shared, a.to_numpy()) & _has(shared, b.to_numpy())), "boolean")
            grams = grams.where(both(*ends))
        g = grams.groupBy("term").agg(F.count("*").alias("df"), F.sum("y").cast("bigint").alias("hits")).where(F.col("df") >= least)
        if n < high:
            g = cut(g)
            known = bit_map(g.select(F.pmod(F.xxhash64("term"), F.lit(bits)).alias("b")), "b", bits)
        if n >= low:
            out = g if out is None else out.unionByName(g)
    return out.withColumn("rate", F.col("hits") / F.col("df"))


def char_ngram_scan(df: DataFrame, text: Column, low: int, high: int, y: str = "y", least: int = 5) -> DataFrame:
    """``grown_ngrams`` with a two-sided test of two shares and its FDR."""
    return _tested(df, grown_ngrams(df, text, low, high, y, least), y)


def ngram_scan(df: DataFrame, id_col: str, terms: Column, y: str = "y", least: int = 5) -> DataFrame:
    """``terms_rates`` with a two-sided test of two shares and its FDR."""
    return _tested(df, terms_rates(df, id_col, terms, y, least), y)


def _tested(df: DataFrame, rates: DataFrame, y: str) -> DataFrame:
    t = df.agg(F.count("*").cast("double").alias("n"), F.sum(y).cast("double").alias("pos"))
    g = rates.crossJoin(F.broadcast(t))  # one row
    n1, n0 = F.col("df").cast("double"), F.col("n") - F.col("df")
    p = F.col("pos") / F.col("n")
    z = F.try_divide(F.col("hits") / n1 - F.try_divide(F.col("pos") - F.col("hits"), n0), F.sqrt(p * (1 - p) * (1 / n1 + F.try_divide(F.lit(1.0), n0))))
    tested = g.select("term", "df", "hits", "rate", z.alias("z"), normal_tail(z).alias("p_value"))
    return bh_fdr(tested, "p_value", "term")


# Outlines: texts with a node a line, indented by depth.


def outline_nodes(df: DataFrame, id_col: str, text: str, indent: int = 2) -> DataFrame:
    """``(id, line, depth, node, leaf)``: tree marks and notes in brackets go; a node is a leaf if the next isn't deeper."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("raw", r"[│├└─┬|+`]|--+", " "), r"[(（][^)）]*[)）]", ""))
    lead = F.length("raw") - F.length(F.ltrim(F.regexp_replace("raw", r"[│├└─┬|+`]", " ")))
    rows = lines.select("id", "line", F.floor(lead / indent).cast("int").alias("depth"), clean.alias("node")).where("node <> ''")
    ahead = F.lead("depth").over(Window.partitionBy("id").orderBy("line"))
    return rows.withColumn("leaf", (F.coalesce(ahead, F.lit(-1)) <= F.col("depth")).cast("int"))


def outline_summary(nodes: DataFrame, suffixes: Mapping[str, str]) -> DataFrame:
    return nodes.groupBy("id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.sum("leaf").cast("bigint").alias("n_leaves"), *[F.count_if(F.endswith("node", F.lit(s))).alias(f"n_{k}") for k, s in suffixes.items()])


def depth_rates(nodes: DataFrame, labels: DataFrame, keyword: str) -> DataFrame:
    """Target rate by the depth at which a keyword first occurs; -1: nowhere. ``labels`` has id and y."""
    d = nodes.groupBy("id").agg(F.coalesce(F.min(F.when(F.contains("node", F.lit(keyword)), F.col("depth"))), F.lit(-1)).alias("depth_class"))
    return d.join(labels, "id").groupBy("depth_class").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate"))


#: Names of one block of an outline, whose pairs one row of a task makes, and buckets of pairs.
PAIR_BLOCK, PAIR_BUCKETS = 256, 1 << 20


def _pair_buckets(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each pair of hashes, (left, right)."""
    x = (left.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ right.astype(np.uint64)[None, :]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def pair_support(nodes: DataFrame, labels: DataFrame, least: int, block: int = PAIR_BLOCK, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """``(a, b, n, rate)`` of pairs of names in one outline that ``least`` outlines have.

    Names rarer than that are dropped before pairing, as no pair of them can reach it. Pairs are counted by hash bucket
    first, inside tasks; only those of buckets that reach ``least`` are then made as rows and shuffled. An outline's
    sorted names are cut into blocks, and its pairs of blocks are dealt over tasks.
    """
    d = nodes.select("id", "node").distinct()
    often = d.groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("node")
    names = d.join(often, "node").groupBy("id").agg(F.array_sort(F.collect_list("node")).alias("names")).join(labels.select("id", "y"), "id")
    last = F.floor((F.size("names") - 1) / block).cast("int")
    part = lambda i: F.slice("names", i * block + 1, block)
    pairs = names.select("id", "y", "names", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("last"))
    pairs = pairs.select("id", "y", "names", "i", F.explode(F.sequence("i", "last")).alias("j"))
    pairs = pairs.select("id", "i", "j", "y", part(F.col("i")).alias("l"), part(F.col("j")).alias("r"), (F.col("i") == F.col("j")).alias("same")).repartition("id", "i", "j")
    pairs = cut(pairs.withColumns({k: F.transform(v, lambda x: F.xxhash64(x)) for k, v in (("lh", "l"), ("rh", "r"))}))

    def made(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for row, (lh, rh, same) in enumerate(zip(*(batch.column(c) for c in ("lh", "rh", "same")), strict=True)):
            b = _pair_buckets(np.array(lh.as_py(), np.int64), np.array(rh.as_py(), np.int64), buckets)
            yield row, b, np.triu(np.ones(b.shape, bool), 1) if same.as_py() else np.ones(b.shape, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, b, ok in made(batch):
                np.add.at(total, b[ok], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    full = pairs.select("lh", "rh", "same").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    shared = bit_map(full, "b", buckets)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a block's pairs at a time: those of a batch are as many as its rows times the square of a block
            for row, b, ok in made(batch):
                i, j = np.nonzero(ok & _has(shared, b))
                if len(i):
                    l, r = (batch.column(c)[row].values.take(pa.array(at)) for c, at in (("l", i), ("r", j)))
                    y = pa.array([batch.column("y")[row].as_py()] * len(i), pa.float64())
                    yield pa.RecordBatch.from_arrays([l, r, y], names=["a", "b", "y"])

    found = pairs.withColumn("y", F.col("y").cast("double")).mapInArrow(rows, "a string, b string, y double")
    return found.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).where(F.col("n") >= least)
