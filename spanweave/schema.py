"""Event and record schemas, configuration and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("timestamp_ms", T.DoubleType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("data", T.StringType()),
        T.StructField("arrival_pos", T.LongType()),
    ]
)
RECORD = "pos long, key string, value string"
TAGGED = "pos long, side string, key string, value string"

MAX_DRIFT_PPM = 10_000.0
MAX_TICK = 2**53 - 1


class SpanweaveError(Exception):
    """Base of the engine's errors."""


class ValidationError(SpanweaveError):
    """An input or a configuration breaks a rule."""


class LateEventError(SpanweaveError):
    """A late event under the reject policy."""


class LimitError(SpanweaveError):
    """A result would exceed a declared limit; nothing is returned."""


def number(value: float, name: str, least: float | None = None, above: float | None = None) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValidationError(f"{name} must be a finite number")
    if least is not None and value < least or above is not None and value <= above:
        raise ValidationError(f"{name} is out of range: {value}")
    return float(value)


@dataclass(frozen=True)
class ClockDrift:
    """Correction offset_ms + rate_ppm * 1e-6 * (t - epoch_ms) of a stream's clock."""

    offset_ms: float
    rate_ppm: float
    epoch_ms: float

    def __post_init__(self):
        number(self.offset_ms, "offset_ms")
        number(self.epoch_ms, "epoch_ms")
        if abs(number(self.rate_ppm, "rate_ppm")) > MAX_DRIFT_PPM:
            raise ValidationError(f"rate_ppm exceeds {MAX_DRIFT_PPM}")


@dataclass(frozen=True)
class AlignConfig:
    """Windows [origin + i * hop, origin + i * hop + window) for i >= 0, and the rules of lateness, clocks and cadence."""

    window_ms: float
    hop_ms: float | None = None
    allowed_lateness_ms: float = 0.0
    origin_ms: float = 0.0
    required_streams: tuple[str, ...] = ()
    offsets_ms: dict[str, float] = field(default_factory=dict)
    clock_drifts: dict[str, ClockDrift] = field(default_factory=dict)
    expected_cadence_ms: dict[str, float] = field(default_factory=dict)
    gap_factor: float = 1.5
    late_policy: str = "reject"
    max_events_per_window: int = 10_000_000
    max_output_windows: int = 1_000_000

    def __post_init__(self):
        number(self.window_ms, "window_ms", above=0)
        if self.hop_ms is None:
            object.__setattr__(self, "hop_ms", self.window_ms)
        number(self.hop_ms, "hop_ms", above=0)
        number(self.allowed_lateness_ms, "allowed_lateness_ms", least=0)
        number(self.origin_ms, "origin_ms")
        number(self.gap_factor, "gap_factor", above=1)
        if self.late_policy not in ("reject", "drop", "accept"):
            raise ValidationError(f"late_policy: {self.late_policy!r}")
        for name in ("max_events_per_window", "max_output_windows"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 1:
                raise ValidationError(f"{name} must be a positive integer")
        for stream, value in self.offsets_ms.items():
            number(value, f"offset of {stream}")
        if not all(isinstance(s, str) and s for s in self.required_streams):
            raise ValidationError("required_streams must hold names")
        if len(set(self.required_streams)) != len(self.required_streams):
            raise ValidationError("required_streams repeats a stream")
        if set(self.offsets_ms) & set(self.clock_drifts):
            raise ValidationError("a stream has both an offset and a drift")
        for name, value in self.expected_cadence_ms.items():
            number(value, f"cadence of {name}", above=0)
