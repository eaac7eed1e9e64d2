"""A Merkle manifest of a table: a content-addressed store of digest and children, and proofs by descent from the root.

The rows of each group are leaves in the order of their ids. Every ``FANOUT`` neighbours become one node whose digest is
the hash of theirs, until one node is left; the last nodes of the groups form a tree of their own, whose last node is
the root. Nodes are records ``(digest, children)``. A request for a leaf goes down from the root: the digits of its rank
say which child comes next, the others are its siblings there. Requests that pass a node share the way to it, so each
node is visited once; the segments of the way, reversed, lead from the leaf to the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.plans.lineage import cut

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """A value as its UTF-8 bytes' count, a colon and itself; null: a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The SHA-256 of a row's values, as lowercase hex digits."""
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df``, computed once, with ``rank``: its 0-based place inside ``by``, nulls first. Rows alike in ``order`` may swap.

    Rows are sorted over ranges of all of them, so that a large group takes many tasks, as do many rows alike. What is
    summed apart has one row for each group and task.
    """
    spread = df.withColumn("__salt", F.monotonically_increasing_id())
    base = cut(spread.repartitionByRange(*by, *order, "__salt").sortWithinPartitions(*by, *order, "__salt").drop("__salt"))
    base = base.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    runs = base.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(b).alias(f"__k_{b}") for b in by], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = F.col("__part") == F.col("__p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return base.join(runs, same).withColumn("rank", F.col("__at") - F.col("__first") + F.col("__start")).drop("__part", "__at", "__p", "__first", "__start", *[f"__k_{b}" for b in by])


def height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**k) for k in range(15)]), lambda x: x < n))


def tree_levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, rank, digest, n), each with ``children``; ``most`` is the largest n of a tree."""
    out, level, k = [], nodes, 0
    while FANOUT**k < most:
        k += 1
        run = level.where(F.lit(FANOUT ** (k - 1)) < F.col("n")).groupBy("tree", F.shiftright("rank", 4).alias("rank")).agg(F.first("n").alias("n"), F.collect_list(F.struct("rank", "digest")).alias("__c"))
        run = run.withColumn("children", F.transform(F.array_sort("__c"), lambda x: x["digest"])).drop("__c")
        level = cut(run.withColumn("digest", F.sha2(F.array_join("children", "").cast("binary"), 256)))
        out.append(level)
    return out


@dataclass
class Manifest:
    """``leaves`` (tree, rank, digest and what came with them), ``groups`` (tree, rank, digest, n), ``records`` (digest, children), the root."""

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame | None
    root: str | None
    most: int
    n_groups: int


def manifest(leaves: DataFrame, tree: str, order: list[str], digest: str = "digest") -> Manifest:
    """The manifest of ``leaves``: groups by ``tree`` (null is one of them, the first), inside them by ``order``, then digest.

    Leaves alike in all of these may swap. An empty table has no root and no records.
    """
    rows = ranked(leaves.withColumnsRenamed({tree: "tree", digest: "digest"}), ["tree"], [*["tree" if c == tree else c for c in order], "digest"])
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    most, n_groups = sizes.agg(F.max("n"), F.count("*")).first()
    if not n_groups:
        return Manifest(rows, sizes, None, None, 0, 0)
    small = sizes.select(F.col("tree").alias("__t"), "n")
    nodes = rows.select("tree", "rank", "digest").join(small, F.col("tree").eqNullSafe(F.col("__t"))).drop("__t")
    levels = tree_levels(nodes, most)
    # a tree's last node is in the level that is as high as its size asks for
    last = nodes.where("n = 1").select("tree", "digest", "n")
    for k, level in enumerate(levels, 1):
        last = last.unionByName(level.where((F.lit(FANOUT ** (k - 1)) < F.col("n")) & (F.col("n") <= FANOUT**k)).select("tree", "digest", "n"))
    groups = ranked(last, [], ["tree"])
    top = groups.select(F.lit(None).cast("string").alias("tree"), "rank", "digest", F.lit(n_groups).cast("long").alias("n"))
    levels += (above := tree_levels(top, n_groups))
    root = (above[-1] if above else groups).select("digest").first()[0]
    records = None
    for level in levels:
        one = level.select("digest", "children")
        records = one if records is None else records.unionByName(one)
    if records is not None:
        records = cut(records.groupBy("digest").agg(F.first("children").alias("children")))
    return Manifest(rows, groups, records, root, most, n_groups)


def _descended(front: DataFrame, m: Manifest) -> DataFrame:
    """The children of the nodes of ``front`` (rank, digest, way, left, ...), each with one more segment of its way."""
    kept = [c for c in front.columns if c not in ("rank", "digest", "way", "levels")]
    step = front.join(m.records, "digest").select(*kept, "levels", "rank", "way", "children", F.posexplode("children").alias("at", "child"))
    return step.select(*kept, (F.col("levels") - 1).alias("levels"), (F.col("rank") * FANOUT + F.col("at")).alias("rank"), F.col("child").alias("digest"), F.concat("way", F.array(segment(F.col("children"), F.col("at")))).alias("way"))


def segment(children: Column, at: Column) -> Column:
    """The siblings before and after a child, as two texts."""
    rest = F.greatest(F.size(children) - at - 1, F.lit(0))
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("before"), F.array_join(F.slice(children, at + 2, rest), "").alias("after"))


def proofs(m: Manifest) -> DataFrame:
    """The manifest's leaves with ``subroot`` and ``way``: their siblings (before, after) from the leaf's level to the root."""
    nothing = F.array().cast("array<struct<before: string, after: string>>")
    if m.records is None:  # no leaf, or a single one
        return m.leaves.withColumns({"subroot": F.col("digest"), "way": nothing})
    groups = m.groups.select("tree", F.col("rank").alias("__g"), F.col("digest").alias("subroot"), height(F.col("n")).alias("levels"))
    spark = m.leaves.sparkSession
    front = spark.createDataFrame([(0, m.root)], "rank bigint, digest string").select("rank", "digest", nothing.alias("way"), F.lit(0).alias("levels"))
    n = m.n_groups
    while n > 1:
        front, n = cut(_descended(front, m)), -(-n // FANOUT)
    front = front.drop("levels").withColumnRenamed("rank", "__r").join(groups, F.col("__r") == F.col("__g"))
    front = front.select("tree", "subroot", "levels", F.lit(0).cast("long").alias("rank"), "digest", "way")
    # down to the nodes above leaves; a lone leaf is its own subroot
    n, ready = m.most, front.where("levels <= 1")
    while n > FANOUT:
        front, n = cut(_descended(front.where("levels > 1"), m)), -(-n // FANOUT)
        ready = ready.unionByName(front.where("levels = 1"))
    ready = ready.join(m.records.withColumnRenamed("digest", "__d"), (F.col("digest") == F.col("__d")) & (F.col("levels") == 1), "left")
    ready = ready.select(F.col("tree").alias("__tree"), F.col("rank").alias("__node"), "subroot", "way", "children")
    asked = m.leaves.join(ready, F.col("tree").eqNullSafe(F.col("__tree")) & (F.shiftright("rank", 4) == F.col("__node")))
    last = F.when(F.col("children").isNull(), F.col("way")).otherwise(F.concat("way", F.array(segment(F.col("children"), F.pmod("rank", F.lit(FANOUT)).cast("int")))))
    return asked.withColumn("way", F.reverse(last)).drop("__tree", "__node", "children")


def way_digest(way: Column) -> Column:
    """The SHA-256 of all siblings of a way, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the siblings of its way give."""
    return F.aggregate(way, leaf, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]).cast("binary"), 256))


def verified_rows(df: DataFrame, fields: list[str], group: str, id_col: str, text_col: str = "text", every: int = 5) -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of ``df``.

    ``fields`` make the leaf, in this order. Rows of a ``group`` ascend by id. Where ``every`` divides the CRC-32 of the
    decimal id, A-Z of the text are lowered before the leaf is hashed again; ``folded_root`` comes from that leaf (else
    from the original one) and the original siblings, and ``verified`` says whether it is the root.

    Null values count as a dash, a null group is a group of its own and comes first, null ids come first in theirs and
    are never tampered with. Repeated ids are ordered by their leaves; equal rows may swap, which changes nothing that
    a set of rows shows. Texts of any length are hashed where they are read and go no further. An empty table has no
    rows; columns other than these are not read.
    """
    digest = lambda text: leaf_digest(*[text if f == text_col else F.col(f) for f in fields])
    changed = F.when(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(every)) == 0, digest(F.translate(F.col(text_col), UPPER, LOWER)))
    leaves = df.select(F.col(id_col).alias("__id"), F.col(group).alias("__group"), digest(F.col(text_col)).alias("digest"), changed.alias("__changed"))
    m = manifest(leaves, "__group", ["__id"])
    root = F.lit(m.root).cast("string")
    out = proofs(m).select(F.col("__id").alias(id_col), F.col("digest").alias("leaf"), "subroot", root.alias("root"), way_digest(F.col("way")).alias("proof_sha256"), folded(F.coalesce("__changed", "digest"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
