"""A small example: three streams with clocks of their own, arriving out of order, and a benchmark of both alignments."""

from __future__ import annotations

import json
import math
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from spanweave import report
from spanweave.operators import align as A
from spanweave.schema import EVENT, AlignConfig, ValidationError
from spanweave.sources.jsonl import generate_round_robin, native_event, round_robin_streams

# The example's configuration, and its events in order of arrival (id, stream, modality, time, duration, data).
CONFIG = {
    "window_ms": 1000,
    "hop_ms": 500,
    "allowed_lateness_ms": 150,
    "origin_ms": 0,
    "required_streams": ["camera", "microphone", "transcript"],
    "offsets_ms": {"camera": -40, "microphone": 15, "transcript": 0},
    "expected_cadence_ms": {"camera": 500, "microphone": 500, "transcript": 750},
    "gap_factor": 1.6,
    "late_policy": "reject",
    "max_events_per_window": 100,
    "max_output_windows": 100,
}
ROWS = (
    ("v0", "camera", "video", 40, 420, {"label": "entrance"}),
    ("a0", "microphone", "audio", -15, 480, {"rms": 0.14}),
    ("t0", "transcript", "text", 120, 240, {"text": "vehicle entering"}),
    ("v1", "camera", "video", 540, 420, {"label": "merge"}),
    ("t1", "transcript", "text", 880, 260, {"text": "braking"}),
    ("a2", "microphone", "audio", 985, 480, {"rms": 0.52}),
    ("a1", "microphone", "audio", 485, 480, {"rms": 0.18}),
    ("v2", "camera", "video", 1040, 420, {"label": "stop"}),
    ("v3", "camera", "video", 2040, 420, {"label": "clear"}),
    ("a3", "microphone", "audio", 1485, 480, {"rms": 0.2}),
    ("t2", "transcript", "text", 1650, 300, {"text": "lane clear"}),
)
FIELDS = ("id", "stream", "modality", "timestamp_ms", "duration_ms", "data")


def payloads() -> list[dict]:
    return [dict(zip(FIELDS, row, strict=True)) for row in ROWS]


def lines() -> str:
    return "".join(json.dumps(p) + "\n" for p in payloads())


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*native_event(p), pos) for pos, p in enumerate(payloads())], EVENT)


def nearest_rank(values: list[float], share: float) -> float:
    """The smallest value that at least this share of the values doesn't exceed."""
    return sorted(values)[max(math.ceil(share * len(values)), 1) - 1]


def benchmark(spark: SparkSession, count: int = 3000, streams: int = 3, repeats: int = 5, warmups: int = 1) -> dict:
    """Both alignments of the round-robin workload; timed until the windows' events are computed, the digest apart from that."""
    if not 1 <= streams <= count or repeats < 1 or warmups < 0:
        raise ValidationError("1 <= streams <= count, one repeat or more, warm-ups not negative")
    config = AlignConfig(100.0, required_streams=round_robin_streams(streams), max_events_per_window=max(1000, count), max_output_windows=max(100, count))
    modes = []
    for name, run in (("offline-sort", A.align), ("watermark-replay", A.replay)):
        took = []
        for _ in range(warmups + repeats):
            began = time.perf_counter()
            A.window_events(run(generate_round_robin(spark, count, streams), config)).write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter() - began) * 1000)
        took = took[warmups:]
        result = report.document(run(generate_round_robin(spark, count, streams), config), most=max(100_000, count))
        middle = statistics.median(took)
        modes.append({"mode": name, "median_runtime_ms": middle, "p95_runtime_ms": nearest_rank(took, 0.95), "median_events_per_second": count / middle * 1000, "windows": len(result["windows"]), "output_sha256": report.digest(result)})
    return {"events": count, "streams": streams, "repeats": repeats, "warmups": warmups, "equivalent_outputs": len({m["output_sha256"] for m in modes}) == 1, "modes": modes}
