"""Date histograms over streams: the batch bucket as a tumbling window with a watermark. An extension of the dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsql.functions.dates import fixed_micros


def date_histogram(stream: DataFrame, time_col: str, interval: str, metrics: dict[str, Column], keys: tuple[str, ...] = (), late: str = "10 minutes", offset: str | None = None) -> DataFrame:
    """One row for each bucket and keys: bucket start, keys, doc_count and the metrics.

    Rows that come later than `late` behind the newest time are left out; state older than that is dropped. The
    same function works on batch tables, where the watermark has no effect.
    """
    size = f"{fixed_micros(interval)} microseconds"
    start = f"{fixed_micros(offset)} microseconds" if offset else None
    at = stream.withColumn("__ts", F.col(f"`{time_col}`").cast("timestamp")).withWatermark("__ts", late)
    window = F.window("__ts", size, startTime=start) if start else F.window("__ts", size)
    out = at.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("doc_count"), *[c.alias(n) for n, c in metrics.items()])
    return out.select(F.col("w.start").alias("bucket"), *keys, "doc_count", *metrics)


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str = "30 seconds", once: bool = False):
    """Finished buckets go to a Parquet sink, each exactly once."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
