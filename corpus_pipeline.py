"""A corpus pipeline: classify, deduplicate, decontaminate, mix and shard the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.llm.containment import decontaminate
from foldspan.llm.langid import held_out
from foldspan.llm.mixing import mix_sources, word_count
from foldspan.llm.nearcopies import drop_similar
from foldspan.llm.quality import fit_quality, scored
from foldspan.llm.sharding import shuffled_shards
from foldspan.plans.lineage import ensure_checkpoint_dir
from foldspan.session import table

SHARDS = 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of those that are not held out.

    A null or empty text is scored like any other, on no feature. Repeated rows are decided alike. Without labels of
    both classes all texts have one score. An empty table stays empty.
    """
    model = fit_quality(docs, labels=table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return scored(docs, model).where("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity from 0.8), the one with the smallest id."""
    return drop_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is decided by its own text.

    Null and empty texts hold none and stay, as do all if there are no items. Repeated rows are decided alike. An empty
    table stays empty.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Rows that share an id and a size are taken alike, as often as the one of them that is taken most.
    """
    taken = mix_sources(docs).where("taken > 0").groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    keys = docs["doc_id"].eqNullSafe(F.col("__id")) & (word_count(docs["text"]) == F.col("__size"))
    return docs.join(taken, keys).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it.

    Nulls in any column and empty texts are hashed like other values; rows alike in all columns are interchangeable. An
    empty table stays empty.
    """
    return shuffled_shards(docs, SHARDS)


STAGES = [("quality", keep_quality), ("near_copies", drop_copies), ("benchmark", drop_benchmark), ("mixing", mix), ("sharding", shard)]

#: The classifier is trained in numpy and the fingerprints use XXH64; neither can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet in the shared folder and read again.

    What a stage leaves out is gone for the next one. Nulls, empty texts, repeated rows and an empty table are taken as
    each stage says; ids need be neither unique nor there.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
