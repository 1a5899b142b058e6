"""Sessions per stream, and stable hash partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.clock import next_up
from spanweave.operators.scan import prefix_scan
from spanweave.schema import ValidationError, number


def session_members(events: DataFrame, gap_ms: float, time: str = "timestamp_ms") -> DataFrame:
    """Adds end_ms and session (per stream from 0): a break where time - the running largest end exceeds the gap."""
    number(gap_ms, "gap_ms", least=0)
    rows = events.withColumn("end_ms", F.when(F.col("duration_ms") == 0, next_up(F.col(time))).otherwise(F.col(time) + F.col("duration_ms")))
    block, order = F.floor(F.col(time) / max(float(gap_ms) * 1024, 1.0)), [time, "id"]
    rows = prefix_scan(rows, {"_end": ("max", F.col("end_ms"))}, block, order, ["stream"])
    breaks = F.when(F.col("_end_before").isNotNull() & (F.col(time) - F.col("_end_before") > gap_ms), 1).otherwise(0)
    rows = prefix_scan(rows.withColumn("_break", breaks), {"_session": ("sum", F.col("_break"))}, block, order, ["stream"])
    return rows.withColumn("session", F.col("_session").cast("long")).drop("_end", "_end_before", "_break", "_session", "_session_before")


def sessionize(events: DataFrame, gap_ms: float, time: str = "timestamp_ms") -> DataFrame:
    """stream, session, start_ms, end_ms, n_events and idx (numbered over streams in order, then by start)."""
    one = session_members(events, gap_ms, time).groupBy("stream", "session").agg(F.min(time).alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_events"))
    counts = one.groupBy("stream").count()
    before = counts.select("stream", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("stream")) - F.col("count")).alias("_before"))
    return one.join(before, "stream").withColumn("idx", F.col("_before") + F.col("session")).drop("_before")


def partition_of(identity: Column, n: int) -> Column:
    """The first 8 bytes of SHA-256, as an unsigned integer, modulo n (1 to 1024)."""
    if not 1 <= n <= 1024:
        raise ValidationError("between 1 and 1024 partitions")
    return (F.conv(F.substring(F.sha2(identity, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def partition_events(events: DataFrame, n: int) -> DataFrame:
    return events.withColumn("partition_id", partition_of(F.col("id"), n))
