"""Event-time windows over streams: an addition to the language, which has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Count and sum of ``value`` a window and key; works on batches and streams. ``late``: how long late rows are waited for."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = df.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Rows of a key with no pause longer than ``gap`` between them."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = df.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), key, "n")


def subscribe(stream: DataFrame, checkpoint: str, handler, id_col: str = "event_id", time: str | None = None, late: str = "10 minutes"):
    """Calls ``handler(frame, batch number)`` for each batch of a stream, without events seen twice: within the batch, and with an
    event time also in earlier batches, as long as ``late``."""
    if time is not None:
        stream = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])
    return stream.writeStream.foreachBatch(lambda df, n: handler(df.dropDuplicates([id_col]), n)).option("checkpointLocation", checkpoint)
