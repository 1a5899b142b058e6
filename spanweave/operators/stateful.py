"""Ordered per-key state as a fold over sorted partitions.

Rows are dealt by key and sorted by (key, order) in each partition; a Python iterator then carries one key's state at a time
across Arrow batches. Memory holds one batch and one key's state, however many rows a key has.
"""

from __future__ import annotations

import copy
import inspect
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from spanweave.schema import SpanweaveError


class FlowExecutionError(SpanweaveError):
    """A callback failed; the message names its step."""


def fold_sorted(df: DataFrame, key: str, order: list[str], begin: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, Iterable[dict]]], schema: str, step_id: str = "step") -> DataFrame:
    """For each key in turn: step(state, row) -> (state, output rows), from begin(). A state of None begins anew.

    Output rows get column ordinal, their place among the outputs of one input row, if schema names it. A raised error
    fails the job with the step's name.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if row[key] != current:
                    current, state = row[key], None
                try:
                    state, rows = step(begin() if state is None else state, row)
                    out += [r | {"ordinal": k} for k, r in enumerate(rows)]
                except Exception as error:
                    raise FlowExecutionError(f"{step_id}: {type(error).__name__}: {error}") from error
            yield pd.DataFrame(out, columns=names)

    dealt = df.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, schema)


class WindowFoldError(FlowExecutionError):
    """A fold's callback failed; the message names the phase, the key and the window."""


def _checked(value: Any) -> Any:
    if inspect.isawaitable(value):
        if inspect.iscoroutine(value):
            value.close()
        raise TypeError("callbacks must not return awaitables")
    return value


def fold_groups(df: DataFrame, keys: list[str], order: list[str], begin: Callable[[], Any], fold: Callable[[Any, Any], Any], finalize: Callable[[Any], Any] | None, value_type: str) -> DataFrame:
    """One row per group of keys: input_count and value, of fold(state, value) over the group's values in order, from begin().

    Groups are dealt by all keys and sorted within partitions, so a task streams through them with one state, across Arrow
    batches: a group may be larger than a batch, or than memory. Each group's state starts as a copy of its own.
    """
    types = dict(df.dtypes)
    out_type = pa.schema([*[(k, from_ddl(types[k])) for k in keys], ("input_count", pa.int64()), ("value", from_ddl(value_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, n, rows = None, None, 0, []

        def call(phase: str, function: Callable, *args: Any) -> Any:
            try:
                return _checked(function(*args))
            except Exception as error:
                where = ", ".join(f"{k} {v!r}" for k, v in zip(keys, group, strict=True))
                raise WindowFoldError(f"{phase} of {where}: {type(error).__name__}: {error}") from error

        def close() -> None:
            value = state if finalize is None else call("finalize", finalize, state)
            rows.append((*group, n, value))

        for batch in batches:
            for *own, value in zip(*(batch[k].to_pylist() for k in (*keys, "value")), strict=True):
                if own != group:
                    if group is not None:
                        close()
                    group, n = own, 0
                    state = copy.deepcopy(call("begin", begin))
                state = call("fold", fold, state, value)
                n += 1
            yield pa.RecordBatch.from_pylist([dict(zip(out_type.names, r, strict=True)) for r in rows], schema=out_type)
            rows = []
        if group is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(out_type.names, r, strict=True)) for r in rows], schema=out_type)

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "input_count long", f"value {value_type}"])
    return df.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order).select(*keys, "value").mapInArrow(run, schema)


def from_ddl(kind: str) -> pa.DataType:
    return to_arrow_type(DataType.fromDDL(kind))
