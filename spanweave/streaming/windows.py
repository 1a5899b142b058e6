"""Window folds in Structured Streaming, in order of arrival, or of time: then arrivals wait in a buffer until the watermark
passes them.

A processor holds the keys of a shard (see runner.sharded), so that a control row is sent to each shard once, not to each key.
Rows are (pos, op, timestamp, key, value): op is process, watermark (timestamp is the new watermark), drain (timestamp is the most
windows that it takes, null for all) or finish.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanweave.operators.folds import FoldWindow
from spanweave.operators.stateful import WindowFoldError, _checked
from spanweave.schema import LateEventError, LimitError, ValidationError
from spanweave.streaming.processors import _sorted


class StreamWindow(StatefulProcessor):
    """-> drained windows (key, idx, start, end, input_count, value, epoch); epoch is the position of the drain row.

    State is JSON: begin() and fold() give JSON values, and finalize() the text that goes out (canonical JSON without one).
    ordered=False folds arrivals as they come, and the spec's late policy holds. Ordered ones that are late are rejected, whatever
    the policy: the buffer has put the others in order. Arrivals and watermarks are refused
    while a closed window waits for a drain; the finish only if the buffer isn't empty then either. Repeated finishes do nothing.
    """

    schema = "key string, idx long, start long, end long, input_count long, value string, epoch long"

    def __init__(self, spec: FoldWindow, begin: Callable[[], Any], fold: Callable[[Any, Any], Any], finalize: Callable[[Any], str] | None = None, most_buffered: int = 1_000, ordered: bool = True):
        self.spec, self.begin, self.fold, self.finalize, self.most, self.ordered = spec, begin, fold, finalize, most_buffered, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "timestamp long, pos long, key string, value string")
        self.cells = handle.getMapState("cells", "idx long, key string", "n long, state string")
        self.mark = handle.getValueState("mark", "tick long, finished boolean")

    def _call(self, phase: str, function: Callable, key: str, idx: int, *args: Any) -> Any:
        try:
            return _checked(function(*args))
        except Exception as error:
            raise WindowFoldError(f"{phase} of key {key!r}, idx {idx}: {type(error).__name__}: {error}") from error

    def _fold(self, cells: dict, held: dict[int, list], heap: list[int], tick: int, key: str, value: Any) -> None:
        spec = self.spec
        for idx in range((tick - spec.origin - spec.width) // spec.hop + 1, (tick - spec.origin) // spec.hop + 1):
            n, state = cells.get((idx, key)) or (0, json.dumps(self._call("begin", self.begin, key, idx)))
            if not n:
                self._hold(held, heap, idx, key)
            cells[idx, key] = n + 1, json.dumps(self._call("fold", self.fold, key, idx, json.loads(state), value))

    def _hold(self, held: dict[int, list], heap: list[int], idx: int, key: str) -> None:
        """held: the keys of each window that hasn't closed; heap: these windows, the first to close on top."""
        if idx not in held:
            held[idx] = []
            heapq.heappush(heap, idx)
        held[idx].append(key)

    def _end(self, idx: int) -> int:
        return self.spec.origin + idx * self.spec.hop + self.spec.width

    def _drained(self, cells: dict, ready: list[tuple], pos: int) -> Iterator[tuple]:
        for idx, key in ready:
            n, state = cells.pop((idx, key))
            value = json.loads(state)
            text = self._call("finalize", self.finalize, key, idx, value) if self.finalize else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            yield key, idx, self._end(idx) - self.spec.width, self._end(idx), n, text, pos

    def handleInputRows(self, key, rows, timerValues):
        mark, finished = self.mark.get() if self.mark.exists() else (None, False)
        waiting = [(t, p, n, k, v) for n, (t, p, k, v) in enumerate(map(tuple, self.buffer.get()))]  # n: the order of arrival
        heapq.heapify(waiting)
        arrived = len(waiting)
        before = {tuple(k): tuple(v) for k, v in self.cells.iterator()}
        cells, out = dict(before), []
        held, heap, ready = {}, [], deque()
        for idx, own in before:
            self._hold(held, heap, idx, own)

        def release(below: int | None = None) -> None:
            """Folds what waits (below a time) in order of time."""
            while waiting and (below is None or waiting[0][0] < below):
                t, _, _, k, v = heapq.heappop(waiting)
                self._fold(cells, held, heap, t, k, v)

        def close_due() -> None:
            """Windows that have closed since the last call go to the end of ready, as (idx, key) in order; only a watermark or the
            finish closes any, so drains and arrivals look at none."""
            while heap and (finished or mark is not None and self._end(heap[0]) <= mark):
                idx = heapq.heappop(heap)
                ready.extend((idx, own) for own in sorted(held.pop(idx)))

        close_due()
        for pos, op, tick, own, value in _sorted(rows)[["pos", "op", "timestamp", "key", "value"]].astype(object).itertuples(index=False):
            tick = None if tick is None or tick != tick else int(tick)  # pandas makes a column with nulls double
            if op == "drain":
                out += self._drained(cells, [ready.popleft() for _ in range(len(ready))[:tick]], pos)
            elif op == "finish":
                if not finished and ready and waiting:
                    raise ValidationError(f"position {pos}: drain closed windows before the buffer can be finished")
                if not finished:
                    release()
                    finished = True
                    close_due()
            elif finished or ready:
                raise ValidationError(f"{op} at position {pos} {'after the finish' if finished else 'while closed windows wait for a drain'}")
            elif op == "watermark":
                if mark is not None and tick < mark:
                    raise ValidationError(f"the watermark goes back from {mark} to {tick}")
                release(tick)
                mark = tick
                close_due()
            else:
                if mark is not None and tick < mark:
                    if not self.ordered and self.spec.late_policy == "drop":
                        continue
                    raise LateEventError(f"arrival {pos} at {tick} is below the watermark {mark}")
                if not self.ordered:
                    self._fold(cells, held, heap, tick, own, value)
                elif len(waiting) >= self.most:
                    raise LimitError(f"more than {self.most} arrivals wait for the watermark")
                else:
                    heapq.heappush(waiting, (tick, pos, arrived, own, value))
                    arrived += 1
        if waiting:
            self.buffer.put([(t, p, k, v) for t, p, _, k, v in sorted(waiting, key=lambda x: x[2])])
        else:
            self.buffer.clear()
        for cell in before.keys() - cells.keys():
            self.cells.removeKey(cell)
        for cell, state in cells.items():
            if before.get(cell) != state:
                self.cells.updateValue(cell, state)
        if mark is not None or finished:
            self.mark.update((mark, finished))
        yield pd.DataFrame(out, columns=["key", "idx", "start", "end", "input_count", "value", "epoch"])

    def close(self) -> None:
        pass
