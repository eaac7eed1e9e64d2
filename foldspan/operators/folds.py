"""Splits and samples by hashes of ids: the same on every run, layout and engine."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def _hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def class_positions(df: DataFrame, id_col: str, by: Sequence[str], *salt: Column) -> DataFrame:
    """``df`` with ``pos``: the 0-based place of each row in its class by (hash, id), and ``size`` of the class.

    Hash buckets (the top twelve bits) are counted first, so that a class, however large, is never one task.
    """
    rows = df.withColumn("__h", _hash32(*salt, F.col(id_col))).withColumn("__b", F.shiftright("__h", 20).cast("int"))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(b).alias(f"__k_{b}") for b in by], F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*by)).alias("size"))
    same = F.col("__b") == F.col("__c")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    inside = Window.partitionBy(*by, "__b").orderBy("__h", id_col)
    out = rows.withColumn("pos", F.row_number().over(inside) - 1).join(starts, same)
    return out.withColumn("pos", (F.col("pos") + F.col("__start")).cast("bigint")).drop("__h", "__b", "__c", "__start", *[f"__k_{b}" for b in by])


def stratified_folds(df: DataFrame, id_col: str, y: str, seeds: Sequence[int] = (0,), k: int = 5) -> DataFrame:
    """``(seed, id, y, fold)``: class counts of the folds of a seed differ by one at most."""
    rows = df.select(F.col(id_col).alias("id"), F.col(y).alias("y"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    return class_positions(rows, "id", ["seed", "y"], F.col("seed")).select("seed", "id", "y", F.pmod("pos", F.lit(k)).cast("int").alias("fold"))


def nested_folds(folds: DataFrame, k: int = 5, inner: int = 5, salt: str = "inner") -> DataFrame:
    """``(seed, outer, id, y, inner)``: inner folds of the training rows of every outer fold."""
    train = folds.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> outer")
    placed = class_positions(train.select("seed", "outer", "id", "y"), "id", ["seed", "outer", "y"], F.lit(salt), F.col("seed"), F.col("outer"))
    return placed.select("seed", "outer", "id", "y", F.pmod("pos", F.lit(inner)).cast("int").alias("inner"))


def stratified_holdout(df: DataFrame, id_col: str, y: str, share: float, seed: int = 0) -> DataFrame:
    """``(id, y, part)`` with ``floor(share * n)`` rows of each class in part B."""
    rows = class_positions(df.select(F.col(id_col).alias("id"), F.col(y).alias("y")), "id", ["y"], F.lit(f"holdout{seed}"))
    return rows.select("id", "y", F.when(F.col("pos") < F.floor(F.col("size") * share), "B").otherwise("A").alias("part"))


def lockbox_split(df: DataFrame, id_col: str, y: str, size: int, seed: int = 0) -> DataFrame:
    """``(id, y, part)`` with ``size`` rows of each class, or all there are, in the lockbox."""
    rows = class_positions(df.select(F.col(id_col).alias("id"), F.col(y).alias("y")), "id", ["y"], F.lit(f"lockbox{seed}"))
    return rows.select("id", "y", F.when(F.col("pos") < size, "lockbox").otherwise("discovery").alias("part"))


def split_fingerprint(df: DataFrame, id_col: str, width: int = 1 << 20) -> DataFrame:
    """One row: ids, and a SHA-256 of the digests of id ranges of ``width``, each over its sorted ids.

    One range of ids is the largest thing that a task gathers; the last digest gathers a line for each range.
    """
    parts = df.groupBy(F.floor(F.col(id_col) / width).cast("bigint").alias("r")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ","), 256).alias("d"))
    return parts.agg(F.sum("n").alias("n_ids"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "d"))), lambda s: s["d"]), ","), 256).alias("fingerprint"))


def balanced_pairs(df: DataFrame, id_col: str, y: str, seed: int = 0) -> DataFrame:
    """``(anchor, partner, same)``: for each anchor one partner of each class, any of its rows but the anchor itself.

    Of each class as many rows are anchors as the smallest class has, so that no class rules. Anchors are the first
    by a hash, partners are at the places that other hashes of the anchor name.
    """
    rows = class_positions(df.select(F.col(id_col).alias("id"), F.col(y).alias("y")), "id", ["y"], F.lit(f"pairs{seed}")).select("id", "y", "pos", "size")
    other = rows.select(F.col("id").alias("partner"), F.col("y").alias("py"), F.col("pos").alias("ppos"))
    sizes = rows.groupBy("y").agg(F.first("size").alias("n"))  # one row a class
    fewest = sizes.agg(F.min("n").alias("fewest"))
    want = rows.crossJoin(F.broadcast(fewest)).where("pos < fewest").crossJoin(F.broadcast(sizes.select(F.col("y").alias("ty"), "n")))
    inside = F.pmod(F.col("pos") + 1 + F.pmod(_hash32(F.lit(f"same{seed}"), F.col("id")), F.greatest(F.col("n") - 1, F.lit(1))), F.col("n"))
    outside = F.pmod(_hash32(F.lit(f"other{seed}"), F.col("id")), F.col("n"))
    want = want.withColumn("place", F.when(F.col("ty") == F.col("y"), inside).otherwise(outside))
    pairs = want.join(other, (F.col("ty") == F.col("py")) & (F.col("place") == F.col("ppos")))
    return pairs.where(F.col("id") != F.col("partner")).select(F.col("id").alias("anchor"), "partner", (F.col("y") == F.col("py")).cast("int").alias("same"))


def balanced_batches(df: DataFrame, id_col: str, y: str, half: int, seed: int = 0) -> DataFrame:
    """``(batch, id, y)``: batches of ``half`` rows of each class, while both classes last."""
    rows = class_positions(df.select(F.col(id_col).alias("id"), F.col(y).alias("y")), "id", ["y"], F.lit(f"batch{seed}")).withColumn("batch", F.floor(F.col("pos") / half).cast("bigint"))
    fewest = rows.groupBy("y").agg((F.floor(F.max("size") / half)).alias("full")).agg(F.min("full").alias("full"))
    return rows.crossJoin(F.broadcast(fewest)).where("batch < full").select("batch", "id", "y")


def candidate_sample(df: DataFrame, batch: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """All rows of the batch, and about ``share`` of the others by their hashes."""
    chosen = df.join(batch.select(F.col("id").alias("__id")).distinct(), F.col(id_col) == F.col("__id"), "left_semi")
    rest = df.join(batch.select(F.col("id").alias("__id")).distinct(), F.col(id_col) == F.col("__id"), "left_anti")
    return chosen.unionByName(rest.where(hash_unit(F.lit(f"cand{seed}"), F.col(id_col)) < share))


#: The distribution function of Poisson(1) at 0, 1, ... 10.
POISSON_STEPS = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(11))


def poisson_weights(df: DataFrame, id_col: str, replicates: int, seed: int = 0) -> DataFrame:
    """``df`` for every replicate with ``w``: a Poisson(1) number from a hash of replicate and id; rows of weight 0 go."""
    u = lambda rep: hash_unit(F.lit(f"boot{seed}"), rep, F.col(id_col))
    # the hash is made inside the generator: a condition on what it gives cannot be moved below, to be computed again
    drawn = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda rep: F.struct(rep.alias("rep"), u(rep).alias("u")))
    w = F.lit(0)
    for step in POISSON_STEPS:
        w = w + (F.col("__x.u") >= step).cast("int")
    return df.withColumn("__x", F.explode(drawn)).where(F.col("__x.u") >= POISSON_STEPS[0]).withColumns({"rep": F.col("__x.rep"), "w": w}).drop("__x")


def permuted_labels(df: DataFrame, id_col: str, y: str, replicates: int, seed: int = 0, first: int = 0) -> DataFrame:
    """``df`` for every replicate from ``first`` on with its labels permuted: places by one hash get the labels of places by another."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))))
    a = class_positions(reps, id_col, ["rep"], F.lit(f"permA{seed}"), F.col("rep")).drop("size")
    b = class_positions(reps.select("rep", F.col(id_col).alias("__id"), F.col(y).alias("__y")), "__id", ["rep"], F.lit(f"permB{seed}"), F.col("rep")).select(F.col("rep").alias("__rep"), F.col("pos").alias("__pos"), "__y")
    return a.join(b, (F.col("rep") == F.col("__rep")) & (F.col("pos") == F.col("__pos"))).withColumn(y, F.col("__y")).drop("__rep", "__pos", "__y", "pos")


def noise_column(df: DataFrame, id_col: str, name: str = "noise", seed: int = 0) -> DataFrame:
    """A standard normal column by the Box-Muller transform of two hashes of the id."""
    u, v = hash_unit(F.lit(f"n1-{seed}"), F.col(id_col)), hash_unit(F.lit(f"n2-{seed}"), F.col(id_col))
    return df.withColumn(name, F.sqrt(-2 * F.log(1 - u)) * F.cos(6.283185307179586 * v))


