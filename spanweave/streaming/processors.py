"""Keyed state in Structured Streaming: transformWithState processors for running totals, keyed joins and window folds.

The same processors run in batch. State rows exist while a key is retained; event-time rules are the engine's own, carried as
state, since Spark's watermark is batch-delayed and measured over all rows. One micro-batch is atomic; within it rows of a key
are put in order of pos, so that a restart or another batching gives the same rows.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanweave.schema import LimitError, ValidationError

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values("pos") if parts else pd.DataFrame()


class RunningTotal(StatefulProcessor):
    """(pos, key, value) -> (pos, key, value, total, seen)."""

    schema = "pos long, key string, value long, total long, seen long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", "total long, seen long")

    def handleInputRows(self, key, rows, timerValues):
        total, seen = self.state.get() if self.state.exists() else (0, 0)
        out = []
        for pos, value in _sorted(rows)[["pos", "value"]].itertuples(index=False):
            total, seen = total + int(value), seen + 1
            out.append((pos, key[0], int(value), total, seen))
        self.state.update((total, seen))
        yield pd.DataFrame(out, columns=["pos", "key", "value", "total", "seen"])

    def close(self) -> None:
        pass


class KeyedJoin(StatefulProcessor):
    """Tagged arrivals -> rows (pos, key, ordinal, present and value of each side), as the batch join's.

    emit complete: a row per combination once every side of a key is present; the key then starts anew. emit running: the
    combinations after every arrival, absent sides not present and null. emit final: none until every side is closed; pos is then
    null, as in the batch join. A value that is null is present all the same.

    A row with op eof (a column that data rows have null or as data) closes its side, for every key of the group: final joins are
    therefore grouped by shard (runner.sharded), the others by key. A closed side takes no more arrivals; closing it again does
    nothing. With the last closing a final join's keys come out in order, each as a whole; the others' incomplete keys are dropped."""

    def __init__(self, sides: list[str], insert: str = "last", emit: str = "complete", max_rows_per_key: int = 1_000_000):
        if insert not in ("first", "last", "product") or emit not in ("complete", "running", "final"):
            raise ValidationError(f"insert {insert!r}, emit {emit!r}")
        self.sides, self.insert, self.emit, self.most = sides, insert, emit, max_rows_per_key
        self.schema = "pos long, key string, ordinal long, " + ", ".join(f"{s}_present boolean, {s}_value string" for s in sides)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "key string", "value string")
        self.closed = handle.getValueState("closed", "sides string")

    def _rows(self, cell: dict[str, list]) -> Iterator[tuple]:
        choices = [[(True, v) for v in cell[s]] if s in cell else [(False, None)] for s in self.sides]
        if math.prod(map(len, choices)) > self.most:
            raise LimitError(f"more than {self.most} rows for a key")
        for k, chosen in enumerate(itertools.product(*choices)):
            yield k, *itertools.chain.from_iterable(chosen)

    def handleInputRows(self, key, rows, timerValues):
        closed = set(json.loads(self.closed.get()[0])) if self.closed.exists() else set()
        before: dict[str, str | None] = {}
        cells: dict[str, dict[str, list]] = {}
        out, frame = [], _sorted(rows)
        ops = frame["op"] if "op" in frame else ["data"] * len(frame)
        for op, pos, own, side, value in zip(ops, *(frame[c].astype(object) for c in ("pos", "key", "side", "value")), strict=True):
            if side not in self.sides:
                continue
            if op == "eof":
                if side not in closed and len(closed) == len(self.sides) - 1:
                    out += self._ended(cells)
                closed.add(side)
                continue
            if side in closed:
                raise ValidationError(f"position {pos} follows the end of side {side}")
            if own not in cells:
                before[own] = self.cells.getValue((own,))[0] if self.cells.containsKey((own,)) else None
                cells[own] = json.loads(before[own]) if before[own] else {}
            cell = cells[own]
            held = cell.setdefault(side, [])
            if self.insert == "product":
                held.append(value)
            elif self.insert == "last" or not held:
                held[:] = [value]
            full = len(cell) == len(self.sides)
            if full and self.emit == "complete" or self.emit == "running":
                out += [(pos, own, *row) for row in self._rows(cell)]
            if full and self.emit == "complete":
                cells[own] = {}
        if closed:
            self.closed.update((json.dumps(sorted(closed)),))
        for own, cell in cells.items():
            if cell and len(closed) < len(self.sides):
                self.cells.updateValue((own,), (json.dumps(cell),))
            elif before.get(own) is not None and self.cells.containsKey((own,)):
                self.cells.removeKey((own,))
        yield pd.DataFrame(out, columns=["pos", "key", "ordinal", *[f"{s}_{part}" for s in self.sides for part in ("present", "value")]]).astype({"pos": "Int64"})

    def _ended(self, cells: dict[str, dict[str, list]]) -> Iterator[tuple]:
        """What the last closing puts out; nothing is kept after it."""
        for (own,), (cell,) in list(self.cells.iterator()):
            cells.setdefault(own, json.loads(cell))
        self.cells.clear()
        if self.emit == "final":
            for own in sorted(cells):
                if cells[own]:
                    yield from ((None, own, *row) for row in self._rows(cells[own]))

    def close(self) -> None:
        pass


class WindowSum(StatefulProcessor):
    """(pos, key, op, timestamp, value) -> closed windows (key, idx, start, end, input_count, total).

    Control rows (watermark, drain, finish) must come for every key: broadcast them by the caller. A drain closes what the
    watermark allows, a finish everything. Late arrivals are dropped; a watermark that goes back and rows after a finish fail."""

    schema = "key string, idx long, start long, end long, input_count long, total long"

    def __init__(self, width: int, hop: int, origin: int):
        self.width, self.hop, self.origin = width, hop, origin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "idx long", "n long, total long")
        self.mark = handle.getValueState("mark", "tick long, finished boolean")

    def handleInputRows(self, key, rows, timerValues):
        mark, finished = self.mark.get() if self.mark.exists() else (None, False)
        out = []
        for op, tick, value in _sorted(rows)[["op", "timestamp", "value"]].astype(object).itertuples(index=False):
            tick = None if tick is None or tick != tick else int(tick)  # pandas makes a column with nulls double
            if finished:
                raise ValidationError(f"{op} after the finish of key {key[0]!r}")
            if op == "process":
                if mark is not None and tick < mark:
                    continue
                for idx in range((tick - self.origin - self.width) // self.hop + 1, (tick - self.origin) // self.hop + 1):
                    n, total = self.windows.getValue((idx,)) if self.windows.containsKey((idx,)) else (0, 0)
                    self.windows.updateValue((idx,), (n + 1, total + int(value)))
            else:
                if op == "watermark":
                    if mark is not None and tick < mark:
                        raise ValidationError(f"the watermark goes back from {mark} to {tick}")
                    mark = tick
                finished = op == "finish"
                for idx in sorted(k[0] for k in self.windows.keys()):
                    start = self.origin + idx * self.hop
                    if finished or mark is not None and start + self.width <= mark:
                        n, total = self.windows.getValue((idx,))
                        out.append((key[0], idx, start, start + self.width, n, total))
                        self.windows.removeKey((idx,))
        if mark is not None or finished:
            self.mark.update((mark, finished))
        yield pd.DataFrame(out, columns=["key", "idx", "start", "end", "input_count", "total"])

    def close(self) -> None:
        pass


def stateful(df: DataFrame, processor: StatefulProcessor, by: str = "key") -> DataFrame:
    """Works on streaming and batch DataFrames; both need the RocksDB state store. by: key, or shard."""
    _ = df.sparkSession.streams  # a batch query finds no state store coordinator unless this session's stream manager exists
    return df.groupBy(by).transformWithStateInPandas(processor, processor.schema, outputMode="append", timeMode="None")
