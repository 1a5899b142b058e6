"""Ordered running maxima and sums without a single-task window: scan blocks, then within each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.session import saved

_COMBINE = {"max": F.max, "sum": F.sum, "min": F.min}


BLOCKS_A_GROUP = 1024


def _same(keys: list[str]) -> Column:
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return condition


def _both(kind: str, a: str, b: str) -> Column:
    if kind == "sum":
        return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return (F.greatest if kind == "max" else F.least)(a, b)


def _blocks_before(totals: DataFrame, kinds: dict[str, str], keys: list[str]) -> DataFrame:
    """Of (keys, _block, _t_name): _p_name, over all blocks before. Blocks are scanned in groups of 1,024, the groups' totals in
    one window per key: a row in it stands for some 67 million rows."""
    rows = totals.withColumn("_group", F.floor(F.col("_block") / BLOCKS_A_GROUP))
    before = Window.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(*keys, "_group").agg(*[_COMBINE[k](f"_t_{n}").alias(f"_t_{n}") for n, k in kinds.items()])
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, "_group", *[_COMBINE[k](f"_t_{n}").over(over).alias(f"_g_{n}") for n, k in kinds.items()])
    rows = rows.select(*keys, "_group", "_block", *[_COMBINE[k](f"_t_{n}").over(before).alias(f"_o_{n}") for n, k in kinds.items()])
    rows = rows.alias("x").join(groups.alias("y"), _same([*keys, "_group"])).select("x.*", *[f"y._g_{n}" for n in kinds])
    return rows.select(*keys, "_block", *[_both(k, f"_g_{n}", f"_o_{n}").alias(f"_p_{n}") for n, k in kinds.items()])


def prefix_scan(df: DataFrame, values: dict[str, tuple[str, Column]], block: Column, order: list, keys: list[str] | None = None) -> DataFrame:
    """Adds, for each name of values (kind, column), name (up to and with the row) and name_before (up to the row before).

    kind is max, min or sum. block must not decrease along order. Rows meet per (keys, block), and one row per block with those
    of its group of blocks. Before the first value all are null.
    """
    keys = keys or []
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_block").agg(*[_COMBINE[k](c).alias(f"_t_{n}") for n, (k, c) in values.items()])
    totals = _blocks_before(totals, {n: k for n, (k, _) in values.items()}, keys)
    out = df.withColumns({f"_i_{n}": _COMBINE[k](c).over(upto) for n, (k, c) in values.items()} | {f"_b_{n}": _COMBINE[k](c).over(before) for n, (k, c) in values.items()})
    # plain equality of blocks, so that without keys the rows stay where the windows above put them; a null block is the first, with none before
    out = out.alias("x").join(totals.alias("y"), _same(keys) & (F.col("x._block") == F.col("y._block")), "left").select("x.*", *[F.col(f"y._p_{n}") for n in values])
    made = {n: _both(k, f"_p_{n}", f"_i_{n}") for n, (k, _) in values.items()} | {f"{n}_before": _both(k, f"_p_{n}", f"_b_{n}") for n, (k, _) in values.items()}
    return out.withColumns(made).drop("_block", *[f"_{x}_{n}" for n in values for x in "pib"])


def number_rows(df: DataFrame, order: list, name: str = "rank", tag: str = "ranked") -> DataFrame:
    """Numbers rows from 0 in the given order: they are dealt in ranges, numbered within each, and one row per range meets in
    the window over ranges. The ranges are written, since they depend on a sample."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)).withColumn("_own", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), tag)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_size")).alias("_first"))
    return dealt.join(before, "_range").withColumn(name, F.col("_first") + F.col("_own")).drop("_first", "_own", "_range")
