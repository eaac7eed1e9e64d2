"""Scores of a stream: windowed confusion counts with a watermark, for models that are already fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.operators.metrics import confusion_class


def windowed_confusion(stream: DataFrame, ts: str, y: str, p: str, t: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each confusion class by event-time window; works alike on a batch table."""
    kind = confusion_class(F.col(y), (F.col(p) >= t).cast("int"))
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, width).alias("w"), kind.alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
