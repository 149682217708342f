"""Structured Streaming forms of the operators. Frames never end on a stream, so what needs a whole frame takes an event-time window instead."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import tables


def each(stream: DataFrame, unit: str, column: str, out: str | None = None, reverse: bool = False, **args: Any) -> DataFrame:
    """A unit on each row: the same plan as on a table."""
    return tables.each(stream, unit, column, out, reverse, **args)


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed them, so state is bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def group_windows(stream: DataFrame, key: str, time: str, length: str, slide: str | None = None, delay: str = "10 minutes", value: str | None = None) -> DataFrame:
    """groupby with counts (and a sum) by event-time windows; late rows within the delay count."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return stream.withWatermark(time, delay).groupBy(window.alias("window"), key).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", *(["total"] if value else []))


def running_state(stream: DataFrame, key: str, value: str) -> DataFrame:
    """scan: the running count and sum of each key, kept as state in the JVM; for output in update mode. State grows with the keys: use :func:`group_windows` where they are without end."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A Parquet sink with exactly-once output."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
