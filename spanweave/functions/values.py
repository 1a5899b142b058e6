"""Canonical JSON and strict JSON checks, as Arrow-batched functions for ingest and egress only."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of a JSON value.
MAX_DEPTH, MAX_NODES, MAX_ENTRIES, MAX_INT = 64, 100_000, 4096, 2**53 - 1


def parse_strict(text: str):
    """json.loads without repeated keys, NaN and infinities."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key is repeated")
        return out

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def check_value(value, depth: int = 0, left: list[int] | None = None) -> None:
    left = [MAX_NODES] if left is None else left
    left[0] -= 1
    if depth > MAX_DEPTH or left[0] < 0:
        raise ValueError("the value is too deep or too large")
    if isinstance(value, dict):
        if len(value) > MAX_ENTRIES:
            raise ValueError("an object has too many entries")
        for v in value.values():
            check_value(v, depth + 1, left)
    elif isinstance(value, list):
        for v in value:
            check_value(v, depth + 1, left)
    elif isinstance(value, int) and not isinstance(value, bool) and abs(value) > MAX_INT or isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number is out of range")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_json(text: Column) -> Column:
    """Sorted keys, no spaces, no escapes beyond JSON's own; an error for text that isn't strict JSON."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            value = parse_strict(x)
            check_value(value)
            return canonical(value)

        return values.map(one)

    return run(text)
