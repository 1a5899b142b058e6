"""Event readers: strict native JSON lines, CloudEvents 1.0 lines, keyed records, and the benchmark's generator.

Lines are read by Spark; a line's position is its byte offset in its file (from the reader's own order, kept by a file at a
time), so arrival order survives any split. Every line becomes a row with an error text or without; strict readers raise the
first error by position, lenient ones return both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.values import canonical, check_value, parse_strict
from spanweave.schema import ValidationError
from spanweave.session import saved
from spanweave.sources.cloudevents import cloud_event

# Fields of the native event.
EVENT_FIELDS = {"id", "stream", "modality", "timestamp_ms", "duration_ms", "data"}
_ROWS = "line_no long, id string, stream string, modality string, timestamp_ms double, duration_ms double, data string, error string"
_COLUMNS = ["line_no", "id", "stream", "modality", "timestamp_ms", "duration_ms", "data", "error"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): blank lines skipped, line_no in file order (several files: in order of their names)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    # Within a split rows come in order, and splits of a file are ordered by their first byte.
    counts = rows.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    before = counts.select("f", "b", "first", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("f", "b")) - F.col("n")).alias("before"))
    out = rows.join(before, ["f", "b"]).select((F.col("before") + F.col("i") - F.col("first")).alias("line_no"), F.col("value").alias("raw"))
    return out.where(F.trim("raw") != "")


def label(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip() or len(value.strip()) > 1024 or any(ord(c) < 32 or 127 <= ord(c) < 160 or 0xD800 <= ord(c) < 0xE000 for c in value.strip()):
        raise ValueError(f"{name} must be a non-empty label")
    return value.strip()


def finite(value, name: str, least: float | None = None) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) == float("inf") or least is not None and value < least:
        raise ValueError(f"{name} must be a finite number" + ("" if least is None else f" of {least} or more"))
    return float(value)


def native_event(payload: dict) -> tuple:
    if not isinstance(payload, dict) or payload.keys() - EVENT_FIELDS:
        raise ValueError("unknown fields" if isinstance(payload, dict) else "not an object")
    data = payload.get("data", {})
    if not isinstance(data, dict):
        raise ValueError("data must be an object")
    check_value(data)
    t, d = finite(payload.get("timestamp_ms"), "timestamp_ms"), finite(payload.get("duration_ms", 0), "duration_ms", 0)
    finite(t + d, "the event's end")
    return label(payload.get("id"), "id"), label(payload.get("stream"), "stream"), label(payload.get("modality"), "modality"), t, d, canonical(data)


def _parsed(lines: DataFrame, one) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, raw in zip(pdf["line_no"], pdf["raw"], strict=True):
                try:
                    rows.append((n, *one(parse_strict(raw)), None))
                except Exception as error:
                    rows.append((n, None, None, None, None, None, None, f"line {n + 1}: {error}"))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return lines.mapInPandas(run, _ROWS)


def _strict(rows: DataFrame) -> DataFrame:
    rows = saved(rows, "lines")  # parsed once, for the checks and for what follows
    if bad := rows.where("error IS NOT NULL").orderBy("line_no").first():
        raise ValidationError(bad["error"])
    if again := rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("at")).where("n > 1").orderBy("at").first():
        raise ValidationError(f"line {again['at'] + 1}: id {again['id']!r} occurs again")
    return rows.drop("error").withColumnRenamed("line_no", "arrival_pos")


def load_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows = _parsed(read_lines(spark, path), native_event)
    return _strict(rows) if strict else rows


def load_cloudevents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows = _parsed(read_lines(spark, path), cloud_event)
    return _strict(rows) if strict else rows


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines {"key": string or null, "value": any}, exactly these fields -> (pos, key, value as canonical JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, raw in zip(pdf["line_no"], pdf["raw"], strict=True):
                record = parse_strict(raw)
                if not isinstance(record, dict) or set(record) != {"key", "value"} or not (record["key"] is None or isinstance(record["key"], str)):
                    raise ValueError(f"line {n + 1}: not a keyed record")
                check_value(record["value"])
                rows.append((n, record["key"], canonical(record["value"])))
            yield pd.DataFrame(rows, columns=["pos", "key", "value"])

    return read_lines(spark, path).mapInPandas(run, "pos long, key string, value string")


def round_robin_streams(streams: int) -> tuple[str, ...]:
    return tuple(f"stream-{k:02}" for k in range(streams))


def generate_round_robin(spark: SparkSession, events: int, streams: int) -> DataFrame:
    """The benchmark's workload: in-order point events dealt to streams in turn, ten milliseconds a round."""
    i, s = F.col("id"), F.lit(streams).cast("long")
    turn, round_ = F.pmod(i, s), F.call_function("div", i, s)
    modality = F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("text")), (F.pmod(i, F.lit(3)) + 1).cast("int"))
    return spark.range(events).select(
        F.format_string("event-%08d", i).alias("id"),
        F.format_string("stream-%02d", turn).alias("stream"),
        modality.alias("modality"),
        (round_ * F.lit(10.0) + turn / s).alias("timestamp_ms"),
        F.lit(0.0).alias("duration_ms"),
        F.concat(F.lit('{"sequence":'), i, F.lit("}")).alias("data"),
        i.alias("arrival_pos"),
    )
