"""Alignment of streams in Structured Streaming: what `replay` gives for a whole table, window by window as events arrive.

State per alignment key: each stream's latest time, the next window to close, and one accumulator per open window that an event
has reached; events themselves aren't kept, as their windows are known when they arrive. The watermark is the engine's own (the
least of the required streams' latest times, less the lateness), since Spark's is one for all rows and a batch behind.
A window is put out when the watermark passes its end; a flush row closes the rest of the grid, and nothing may follow it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanweave.functions.clock import next_up, normalise
from spanweave.schema import AlignConfig, LateEventError, LimitError, ValidationError
from spanweave.streaming.processors import _sorted

WINDOWS = "key string, idx long, start_ms double, end_ms double, n_events long, missing_streams string, modalities string, complete boolean"
EVENTS = "key string, id string, disposition string, n_windows long"


class StreamAligner(StatefulProcessor):
    """(pos, key, op, id, stream, modality, t, horizon) -> closed windows, or with emit="dispositions" each event's disposition
    and number of windows. op is event or flush. The lists of streams and modalities are joined by commas, the missing streams
    in the order in which they are required.

    Under the reject policy a late event fails the batch, which then leaves no trace. check_ids: a repeated id fails it too; the
    ids of events are then remembered until `retain_ms` after their last window has closed (for ever, if that is None)."""

    def __init__(self, config: AlignConfig, emit: str = "windows", check_ids: bool = False, retain_ms: float | None = None):
        if emit not in ("windows", "dispositions"):
            raise ValidationError(f"emit {emit!r}")
        self.config, self.emit, self.check_ids, self.retain_ms = config, emit, check_ids, retain_ms
        self.schema = WINDOWS if emit == "windows" else EVENTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "stream string", "t double")
        self.open = handle.getMapState("open", "idx long", "n long, streams string, modalities string")
        self.grid = handle.getValueState("grid", "next long, reach long, closed boolean")
        if self.check_ids:
            self.ids = handle.getMapState("ids", "id string", "horizon double")

    def _start(self, i: int) -> float:
        return float(self.config.origin_ms) + i * float(self.config.hop_ms)

    def _end(self, i: int) -> float:
        return self._start(i) + float(self.config.window_ms)

    def _between(self, t: float, horizon: float, least: int) -> list[int]:
        """The windows from `least` on that overlap [t, horizon)."""
        c = self.config
        last = int((horizon - c.origin_ms) // c.hop_ms) + 1
        while self._start(last) >= horizon:
            last -= 1
        first = int((t - c.origin_ms - c.window_ms) // c.hop_ms) - 1
        while self._end(first) <= t:
            first += 1
        return [i for i in range(max(first, least), last + 1) if self._start(i) < horizon and t < self._end(i)]

    def _cell(self, i: int) -> list:
        """A window's accumulator (events, streams, modalities), read from the state once a batch."""
        if i not in self.cells:
            n, streams, modalities = self.open.getValue((i,)) if self.open.containsKey((i,)) else (0, "[]", "[]")
            self.cells[i] = [n, set(json.loads(streams)), set(json.loads(modalities))]
        return self.cells[i]

    def _closed(self, i: int) -> tuple:
        n, streams, modalities = self._cell(i)
        if n > self.config.max_events_per_window:
            raise LimitError(f"more than {self.config.max_events_per_window} events in window {i}")
        missing = [s for s in self.config.required_streams if s not in streams]
        return i, self._start(i), self._end(i), n, ",".join(missing), ",".join(sorted(modalities)), not missing

    def handleInputRows(self, key, rows, timerValues):
        c, windows, events, self.cells = self.config, [], [], {}
        at, reach, closed = self.grid.get() if self.grid.exists() else (0, -1, False)
        latest = {s: self.latest.getValue((s,))[0] for s in c.required_streams if self.latest.containsKey((s,))}
        columns = ["op", "id", "stream", "modality", "t", "horizon"]
        for op, own, stream, modality, t, horizon in _sorted(rows)[columns].astype(object).itertuples(index=False):
            if closed:
                raise ValidationError(f"{op} after the flush of key {key[0]!r}")
            if op == "flush":
                while at <= reach:
                    self._limit(at)
                    windows.append(self._closed(at))
                    at += 1
                closed = True
                continue
            if self.check_ids:
                if self.ids.containsKey((own,)):
                    raise ValidationError(f"event id {own!r} occurs again")
                self.ids.updateValue((own,), (horizon,))
            obsolete = horizon <= self._start(at)
            late = obsolete or (at > 0 and t < self._end(at - 1))
            if late and c.late_policy == "reject":
                raise LateEventError(f"event {own} at {t} is late under the reject policy")
            if late and (c.late_policy == "drop" or obsolete):
                events.append((own, "dropped", 0))
                continue
            idxs = self._between(t, horizon, at)
            for i in idxs:
                cell = self._cell(i)
                cell[0] += 1
                cell[1].add(stream)
                if modality is not None:
                    cell[2].add(modality)
            reach = max(reach, self._last(horizon))
            events.append((own, "unassigned" if not idxs else "late" if late else "ok", len(idxs)))
            if stream in c.required_streams and not t <= latest.get(stream, float("-inf")):
                latest[stream] = t
            if c.required_streams and len(latest) == len(c.required_streams):
                mark = min(latest.values()) - float(c.allowed_lateness_ms)
                while self._end(at) <= mark:
                    self._limit(at)
                    windows.append(self._closed(at))
                    at += 1
        for stream, t in latest.items():
            self.latest.updateValue((stream,), (t,))
        for i, (n, streams, modalities) in self.cells.items():
            if i < at:
                self.open.removeKey((i,))
            else:
                self.open.updateValue((i,), (n, json.dumps(sorted(streams)), json.dumps(sorted(modalities))))
        self.grid.update((at, reach, closed))
        if self.check_ids and self.retain_ms is not None:
            for own in [k for k, (horizon,) in self.ids.iterator() if horizon <= self._start(at) - self.retain_ms]:
                self.ids.removeKey(own)
        names = [x.split()[0] for x in self.schema.split(", ")]
        yield pd.DataFrame([(key[0], *x) for x in (windows if self.emit == "windows" else events)], columns=names)

    def _last(self, horizon: float) -> int:
        last = int((horizon - self.config.origin_ms) // self.config.hop_ms) + 1
        while self._start(last) >= horizon:
            last -= 1
        return last

    def _limit(self, i: int) -> None:
        if i >= self.config.max_output_windows:
            raise LimitError(f"more than {self.config.max_output_windows} windows")

    def close(self) -> None:
        pass


def align_stream(events: DataFrame, config: AlignConfig, **options) -> DataFrame:
    """Events (pos, key, op, id, stream, modality, timestamp_ms, duration_ms), streaming or not, through the aligner of their key."""
    rows = normalise(events, config)
    horizon = F.when(F.col("duration_ms") == 0, next_up(F.col("t"))).otherwise(F.col("t") + F.col("duration_ms"))
    rows = rows.select("pos", "key", "op", "id", "stream", "modality", "t", horizon.alias("horizon"))
    processor = StreamAligner(config, **options)
    _ = rows.sparkSession.streams
    return rows.groupBy("key").transformWithStateInPandas(processor, processor.schema, outputMode="append", timeMode="None")
