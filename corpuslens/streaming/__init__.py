"""Streaming forms of the windowed and latest-wins operators, for units that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import latest


def windowed_counts(stream: DataFrame, ts: str, label: str, late: str = "1 day", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Label counts over sliding windows; rows later than the watermark are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size, slide).alias("w"), label).agg(F.count("*").alias("n")).select("w.start", "w.end", label, "n")


def drop_duplicates(stream: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """The first unit of each hash within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's latest rows, a folder a batch so that a repeated batch
    overwrites itself. ``latest`` over all folders is the store's state."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
