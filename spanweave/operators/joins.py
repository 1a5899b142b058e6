"""Keyed n-way joins over tagged arrivals (pos, side, key, value): three insert modes times three emit modes.

insert: first keeps a side's first value, last its latest, product all of them. emit: final gives rows once all input is seen
(absent sides null, present false), running after every arrival, complete once every side is present, after which the key
starts anew. Rows carry key, side-wise present and value columns, and their order: pos (of the arrival; null for final) and
ordinal (place in the product, the earlier sides slowest). A null value of a present side is not an absent side.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.scan import prefix_scan
from spanweave.operators.stateful import fold_sorted
from spanweave.schema import LimitError, ValidationError

INSERT, EMIT = ("first", "last", "product"), ("final", "running", "complete")


def keyed_join(tagged: DataFrame, sides: list[str], insert: str = "last", emit: str = "complete", max_rows_per_key: int = 1_000_000) -> DataFrame:
    if not 2 <= len(sides) <= 16 or len(set(sides)) != len(sides):
        raise ValidationError("2 to 16 different sides")
    if insert not in INSERT or emit not in EMIT:
        raise ValidationError(f"insert {insert!r}, emit {emit!r}")
    tagged = tagged.where(F.col("side").isin(sides))
    if emit == "complete":
        return _complete(tagged, sides, insert)
    if insert == "product":
        return _product(tagged, sides, emit, max_rows_per_key)
    return (_final if emit == "final" else _running)(tagged, sides, insert)


def _columns(cells: dict[str, Column]) -> list:
    return [c for s, x in cells.items() for c in (x.isNotNull().alias(f"{s}_present"), x["value"].alias(f"{s}_value"))]


def _final(tagged: DataFrame, sides: list[str], insert: str) -> DataFrame:
    pick = F.min_by if insert == "first" else F.max_by
    value = F.struct("value")
    out = tagged.groupBy("key").agg(*[pick(F.when(F.col("side") == s, value), F.when(F.col("side") == s, F.col("pos"))).alias(f"_{s}") for s in sides])
    return out.select("key", F.lit(None).cast("long").alias("pos"), F.lit(0).cast("long").alias("ordinal"), *_columns({s: F.col(f"_{s}") for s in sides}))


POSITIONS_A_BLOCK = 1 << 16


def _block() -> Column:
    return F.call_function("div", F.col("pos"), F.lit(POSITIONS_A_BLOCK).cast("long"))


def _running(tagged: DataFrame, sides: list[str], insert: str) -> DataFrame:
    """A side's cell is its earliest or latest (position, value) so far: a scan in blocks of positions, so a hot key is many tasks."""
    kind = "min" if insert == "first" else "max"
    out = prefix_scan(tagged, {f"_{s}": (kind, F.when(F.col("side") == s, F.struct("pos", "value"))) for s in sides}, _block(), ["pos"], ["key"])
    return out.select("key", "pos", F.lit(0).cast("long").alias("ordinal"), *_columns({s: F.col(f"_{s}") for s in sides}))


def _product(tagged: DataFrame, sides: list[str], emit: str, most: int) -> DataFrame:
    """Counts come first: a key (or arrival) whose product passes the limit raises before anything is joined. Then each side's rows
    are joined in turn, so no row ever holds a list, and the join's rows are those that go out."""
    if emit == "final":
        base = product_sizes(tagged, sides).withColumn("pos", F.lit(None).cast("long"))
    else:
        base = prefix_scan(tagged, {f"_{s}": ("sum", F.when(F.col("side") == s, F.lit(1).cast("long"))) for s in sides}, _block(), ["pos"], ["key"])
        base = base.select("key", "pos", _times([F.greatest(F.coalesce(F.col(f"_{s}"), F.lit(0)), F.lit(1)) for s in sides]).alias("rows"))
    fault = F.raise_error(F.lit(f"more than {most} rows for a key")).cast("boolean")
    out = base.where(F.when(F.col("rows") <= most, True).otherwise(fault)).drop("rows")
    for s in sides:
        own = tagged.where(F.col("side") == s).select(F.col("key").alias("_key"), F.struct("pos", "value").alias(f"_{s}"))
        met = F.col("key").eqNullSafe(F.col("_key"))
        out = out.join(own, met if emit == "final" else met & (F.col(f"_{s}.pos") <= F.col("pos")), "left").drop("_key")
    ordinal = F.row_number().over(Window.partitionBy("key", "pos").orderBy(*[F.col(f"_{s}.pos") for s in sides])) - 1
    return out.select("key", "pos", ordinal.cast("long").alias("ordinal"), *_columns({s: F.col(f"_{s}") for s in sides}))


def _times(counts: list) -> Column:
    """Their product as a double, since it may pass a long."""
    out = F.lit(1.0)
    for n in counts:
        out = out * n
    return out


def product_sizes(tagged: DataFrame, sides: list[str]) -> DataFrame:
    """Rows that the final product join would give per key: the preflight of a limit."""
    counts = tagged.groupBy("key").agg(*[F.greatest(F.count_if(F.col("side") == s), F.lit(1)).alias(s) for s in sides])
    return counts.select("key", _times([F.col(s) for s in sides]).alias("rows"))


def check_product(tagged: DataFrame, sides: list[str], most: int) -> None:
    if bad := product_sizes(tagged, sides).where(F.col("rows") > most).orderBy("key").first():
        raise LimitError(f"key {bad['key']!r} gives {bad['rows']:.0f} rows; {most} at most")


def _complete(tagged: DataFrame, sides: list[str], insert: str) -> DataFrame:
    kind = dict(tagged.dtypes)["value"]

    def step(cell: dict, row: dict):
        own = cell.setdefault(row["side"], [])
        if insert == "product":
            own.append(row["value"])
        elif insert == "last" or not own:
            own[:] = [row["value"]]
        if any(s not in cell for s in sides):
            return cell, []
        made = [{"key": row["key"], "pos": row["pos"]} | {f"{s}_value": v for s, v in zip(sides, values, strict=True)} for values in itertools.product(*(cell[s] for s in sides))]
        return None, made

    schema = "key string, pos long, ordinal long, " + ", ".join(f"{s}_value {kind}" for s in sides)
    out = fold_sorted(tagged.select("key", "pos", "side", "value"), "key", ["pos"], dict, step, schema, "join")
    return out.select("key", "pos", "ordinal", *[c for s in sides for c in (F.lit(True).alias(f"{s}_present"), F.col(f"{s}_value"))])
