"""Record steps: map, filter, flat_map, key_by, drop_key, branch, merge and keyed state, over (pos, ordinal, key, value).

pos is the source position and ordinal the place among the records that one source record has become. Column expressions stay
in the JVM; any Python function can be passed as a (pandas) UDF column. A null predicate is an error, not false.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.values import canonical
from spanweave.operators.scan import prefix_scan
from spanweave.operators.stateful import FlowExecutionError, fold_sorted


def strict(condition: Column, step_id: str) -> Column:
    return F.when(condition.isNull(), F.raise_error(F.lit(f"{step_id}: the predicate is null")).cast("boolean")).otherwise(condition)


def records(df: DataFrame) -> DataFrame:
    return df.select("pos", F.lit(0).cast("long").alias("ordinal"), "key", "value")


def map_values(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("value", value)


def filter_records(df: DataFrame, condition: Column, step_id: str = "filter") -> DataFrame:
    return df.where(strict(condition, step_id))


def flat_map(df: DataFrame, values: Column, most: int | None = None) -> DataFrame:
    """values: an array per record. Records keep the order of their origin; ordinals are numbered anew per position."""
    if most is not None:
        values = F.when(F.size(values) <= most, values).otherwise(F.raise_error(F.lit(f"more than {most} values")).cast("array<string>"))
    out = df.select("pos", F.col("ordinal").alias("_from"), "key", F.posexplode(values).alias("_i", "value"))
    ordinal = F.row_number().over(Window.partitionBy("pos").orderBy("_from", "_i")) - 1
    return out.select("pos", ordinal.cast("long").alias("ordinal"), "key", "value")


def flat_map_udtf(df: DataFrame, expand: Callable, most: int = 1_000, step_id: str = "flat_map", value_type: str = "string") -> DataFrame:
    """expand(value) gives an iterable, a generator for one, which a Python table function reads value by value: at most `most`
    of them, since more raise before they are put out. Text, bytes, mappings and awaitables aren't expansions."""

    class Expansion:
        def eval(self, value):
            try:
                values = expand(value)
                if inspect.isawaitable(values) or isinstance(values, (str, bytes, bytearray, Mapping)) or not isinstance(values, Iterable):
                    raise TypeError(f"{type(values).__name__} is no expansion")
                for i, item in enumerate(values):
                    if i >= most:
                        raise ValueError(f"more than {most} values")
                    yield i, item
            except Exception as error:
                raise FlowExecutionError(f"{step_id}: {type(error).__name__}: {error}") from error

    table = F.udtf(Expansion, returnType=f"_i int, _value {value_type}")
    out = df.withColumnRenamed("ordinal", "_from").lateralJoin(table(F.col("value").outer()))
    ordinal = F.row_number().over(Window.partitionBy("pos").orderBy("_from", "_i")) - 1
    return out.select("pos", ordinal.cast("long").alias("ordinal"), "key", F.col("_value").alias("value"))


def key_by(df: DataFrame, key: Column, step_id: str = "key_by") -> DataFrame:
    """Keys are trimmed, non-empty strings."""
    good = key.isNotNull() & (key != "") & ~key.rlike(r"(?U)^\s|\s$")
    return df.withColumn("key", F.when(good, key).otherwise(F.raise_error(F.lit(f"{step_id}: not a canonical key"))))


def drop_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.lit(None).cast("string"))


def branch(df: DataFrame, condition: Column, step_id: str = "branch") -> tuple[DataFrame, DataFrame]:
    """(true, false); the predicate becomes a column once, and both routes filter by it."""
    routed = df.withColumn("_route", strict(condition, step_id))
    return routed.where("_route").drop("_route"), routed.where("NOT _route").drop("_route")


def merge(parts: list[DataFrame]) -> DataFrame:
    """All records of the parts; per position, earlier parts first."""
    out = parts[0].withColumn("_edge", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_edge", F.lit(k)))
    ordinal = F.row_number().over(Window.partitionBy("pos").orderBy("_edge", "ordinal")) - 1
    return out.withColumn("ordinal", ordinal.cast("long")).drop("_edge")


def running(df: DataFrame, block: int = 1 << 16, **totals: Column | tuple[str, Column]) -> DataFrame:
    """Known keyed folds in order of (pos, ordinal) per key. ("sum", column), ("max", ...) and ("min", ...) are scanned in blocks
    of positions, so a hot key is many tasks; any other aggregate is a Column, e.g. F.avg(...), over one window per key."""
    scanned = {n: c for n, c in totals.items() if isinstance(c, tuple)}
    if scanned:
        df = prefix_scan(df, scanned, F.call_function("div", F.col("pos"), F.lit(block).cast("long")), ["pos", "ordinal"], ["key"]).drop(*[f"{n}_before" for n in scanned])
    frame = Window.partitionBy("key").orderBy("pos", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: c.over(frame) for n, c in totals.items() if n not in scanned})


def stateful_map(df: DataFrame, begin: Callable, update: Callable, step_id: str = "stateful_map", value_type: str = "string") -> DataFrame:
    """update(value, state) -> (state, value, emit, retain); a state that isn't retained begins anew."""

    def step(state, row):
        new, value, emit, retain = update(row["value"], state)
        out = [{"pos": row["pos"], "from": row["ordinal"], "key": row["key"], "value": value}] if emit else []
        return (new if retain else None), out

    return _renumbered(fold_sorted(df.select("pos", F.col("ordinal").cast("long"), "key", "value"), "key", ["pos", "ordinal"], begin, step, f"pos long, from long, ordinal long, key string, value {value_type}", step_id))


def stateful_flat_map(df: DataFrame, begin: Callable, update: Callable, step_id: str = "stateful_flat_map", value_type: str = "string") -> DataFrame:
    """update(value, state) -> (state, values, retain); no values still keeps the new state."""

    def step(state, row):
        new, values, retain = update(row["value"], state)
        out = [{"pos": row["pos"], "from": row["ordinal"], "key": row["key"], "value": v} for v in values]
        return (new if retain else None), out

    return _renumbered(fold_sorted(df.select("pos", F.col("ordinal").cast("long"), "key", "value"), "key", ["pos", "ordinal"], begin, step, f"pos long, from long, ordinal long, key string, value {value_type}", step_id))


def stateful_sizes(df: DataFrame, begin: Callable, update: Callable, flat: bool = False, step_id: str = "stateful_map") -> DataFrame:
    """(pos, ordinal, key, fresh, before, after) of each record that a keyed state meets: whether its state begins anew, and the
    bytes of the state, as canonical JSON, before and after (null: none)."""

    def step(held, row):
        state, before = held if held else (begin(), None)
        new, *_, retain = update(row["value"], state)
        after = len(canonical(new).encode()) if retain else None
        out = {"pos": row["pos"], "ordinal": row["ordinal"], "key": row["key"], "fresh": before is None, "before": before, "after": after}
        return ((new, after) if retain else None), [{("from" if k == "ordinal" else k): v for k, v in out.items()}]

    schema = "pos long, from long, ordinal long, key string, fresh boolean, before long, after long"
    out = fold_sorted(df.select("pos", F.col("ordinal").cast("long"), "key", "value"), "key", ["pos", "ordinal"], lambda: None, step, schema, step_id)
    return out.drop("ordinal").withColumnRenamed("from", "ordinal")


def _renumbered(df: DataFrame) -> DataFrame:
    ordinal = F.row_number().over(Window.partitionBy("pos").orderBy("from", "ordinal")) - 1
    return df.select("pos", ordinal.cast("long").alias("ordinal"), "key", "value")
