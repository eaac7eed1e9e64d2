"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into partitions by a hash of their content. How many rows of each partition go to each shard is drawn
from the multivariate hypergeometric law, which is that of a uniform shuffle; each partition permutes its rows and
deals them out by those counts; each shard permutes what it got. The rows never leave the engine: the driver sees
the number of rows of each partition and returns the cumulative counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.plans.lineage import cut

#: Rows that a partition of the local permutations holds, about.
PARTITION_ROWS = 50_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null: 0."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition the rows it sends to each shard; columns sum to the shard sizes, at most one apart.

    Partition by partition, its row is drawn from what the shards still lack.
    """
    rng, total = np.random.default_rng(seed), sum(counts)
    lack = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = []
    for n in counts:
        row = rng.multivariate_hypergeometric(lack, n, method="marginals")
        lack -= row
        out.append(row.tolist())
    return out


def shuffled_shards(df: DataFrame, shards: int = 8, key_cols: list[str] | None = None, seed: int = 7, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within the shard), in uniform random order.

    Shard sizes differ by one row at most. ``key_cols`` (all columns if not given) give the seeded hashes, nulls
    included, so that the result doesn't depend on how the input is laid out; rows equal in all of them are
    interchangeable. Columns called shard or slot are replaced. An empty table stays empty.
    """
    spark = df.sparkSession
    keys = key_cols or df.columns
    base = cut(df.drop("shard", "slot").withColumns({"__h": F.xxhash64(F.lit(seed), *keys), "__g": F.xxhash64(F.lit(seed + 1), *keys)}))
    total = base.count()
    parts = max(shards, -(-total // partition_rows))
    part = F.pmod("__h", F.lit(parts)).cast("int")
    counts = {r["p"]: r["n"] for r in base.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = np.cumsum(np.array(matrix, np.int64).reshape(parts, shards), axis=1)
    # the matrix as one literal row for each partition: where the rows of each shard end
    dealt = spark.createDataFrame([(p, ends[p].tolist()) for p in range(parts)], "p int, ends array<bigint>")
    local = Window.partitionBy("__p").orderBy("__h", "__g")
    at = base.withColumn("__p", part).withColumn("__at", F.row_number().over(local))
    at = at.join(F.broadcast(dealt) if parts * shards <= 1 << 20 else dealt, F.col("__p") == F.col("p"))
    # a second hash, salted by the shard, orders what the shard got; buckets of it keep the windows small
    sent = at.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("__at"))).cast("int"))
    sent = sent.withColumn("__o", F.xxhash64(F.lit(seed + 2), "shard", "__g", "__h")).drop("p", "ends", "__at", "__p")
    buckets = max(1, -(-total // (shards * partition_rows))) * 8
    sent = cut(sent.withColumn("__b", (F.shiftrightunsigned("__o", 33) * buckets / (1 << 31)).cast("int")))
    sizes = sent.groupBy("shard", "__b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("shard").alias("s"), F.col("__b").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "__b").orderBy(F.shiftrightunsigned("__o", 1), "__o", "__h")
    out = sent.withColumn("slot", F.row_number().over(order) - 1).join(starts, (F.col("shard") == F.col("s")) & (F.col("__b") == F.col("b")))
    return out.withColumn("slot", (F.col("slot") + F.col("start")).cast("long")).drop("s", "b", "start", "__b", "__o", "__h", "__g")


def shard_digests(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The assignment of documents without their texts: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and no checksum. The law is ``rows``; it binds no shard to a key, so grown_shard is null.
    """
    slim = docs.select("doc_id", (text_bytes(F.col("text")) + 1).alias("size"), F.crc32(F.encode(F.col("text").cast("string"), "UTF-8")).alias("text_crc32"))
    out = shuffled_shards(slim, shards, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
