"""Sources and sinks: checked scans, the score store, label files, result records and the decision log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_entities(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", header: bool = True) -> DataFrame:
    """A table with an explicit schema; NaN is read as null."""
    r = spark.read.schema(schema)
    df = r.option("header", header).csv(path) if fmt == "csv" else getattr(r, fmt)(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else df


def load_headerless(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", False).csv(path)


def key_faults(df: DataFrame, key: str, not_null: Sequence[str] = ()) -> DataFrame:
    """One row: keys that occur more than once, null keys, and rows with a null in each of ``not_null``."""
    dup = df.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null])
    return dup.agg(F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_null_key"), *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in not_null])


def checked(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The columns of ``df``; raises if the key repeats or a column has nulls."""
    found = key_faults(df, key, cols).first().asDict()
    if any(found.values()):
        raise ValueError(f"bad keys or nulls: {found}")
    return df.select(key, *cols)


def id_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids that only one of two tables has."""
    x = a.select(F.col(key).alias("__a")).distinct().join(b.select(F.col(key).alias("__b")).distinct(), F.col("__a") == F.col("__b"), "full")
    return x.agg(F.count_if(F.col("__b").isNull()).alias("only_first"), F.count_if(F.col("__a").isNull()).alias("only_second"))


def stored(spark: SparkSession, path: str, config: str, compute: Callable[[], DataFrame], fingerprint: str | None = None) -> DataFrame:
    """Scores of a configuration: read if they are there, and made of the same split, else computed and written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/config={config}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        old = spark.read.option("basePath", path).parquet(f"{path}/config={config}")
        if fingerprint is None or old.where(F.col("fingerprint") != fingerprint).isEmpty():
            return old
    df = compute().withColumn("config", F.lit(config))
    if fingerprint is not None:
        df = df.withColumn("fingerprint", F.lit(fingerprint))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(path)
    return spark.read.option("basePath", path).parquet(f"{path}/config={config}")


def save_run(preds: DataFrame, settings: dict, path: str) -> None:
    """Scores by configuration and seed, and their settings as a table of pairs."""
    preds.write.mode("errorifexists").partitionBy("config", "seed").parquet(f"{path}/preds")
    preds.sparkSession.createDataFrame([(k, str(v)) for k, v in settings.items()], "name string, value string").write.mode("errorifexists").json(f"{path}/settings")


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    rows = spark.read.schema("name string, value string").json(f"{path}/settings").collect()
    return spark.read.parquet(f"{path}/preds"), {r["name"]: r["value"] for r in rows}


def submission(sample: DataFrame, preds: DataFrame, label: str = "label") -> DataFrame:
    """``(id, label)`` of the sample's ids; an id without a label has a null, which ``write_labels`` refuses."""
    p = preds.select(F.col("id").alias("__p"), F.col(label).alias("label"))
    return sample.select("id").join(p, F.col("id") == F.col("__p"), "left").select("id", "label")


def write_labels(rows: DataFrame, path: str) -> None:
    """A headerless file of two columns; never over another one."""
    if not rows.where("label is null").isEmpty():
        raise ValueError("ids without a label")
    rows.select("id", "label").write.mode("errorifexists").option("header", False).csv(path)


def write_scores(scores: DataFrame, path: str, overwrite: bool = False) -> None:
    scores.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Nested result records as JSON lines."""
    records.write.mode("errorifexists").json(path)


def append_decision(spark: SparkSession, path: str, name: str, verdict: str, detail: str) -> None:
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(verdict).alias("verdict"), F.lit(detail).alias("detail"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(path)
