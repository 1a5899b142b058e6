"""Closing the sides of a final join, and draining its result in pages of whole keys.

A page takes keys in order while it has fewer than max_keys and their rows and bytes fit; which key opens a page so depends on
all keys before it. That chain is cut into blocks of ranks: each block works out, for every place at which a page that came from
the block before can end, where its own last page ends. Those tables are narrow - max_keys rows a block - and only they are
walked in one task; then every block marks its pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.joins import keyed_join
from spanweave.operators.scan import number_rows
from spanweave.schema import LimitError, ValidationError

KEYS_A_BLOCK = 1 << 16


@dataclass(frozen=True)
class DrainLimits:
    """What a page may hold; bytes are those of keys and present values in UTF-8, once per row."""

    max_keys: int = 100
    max_rows_per_key: int = 1_000
    max_rows_per_page: int = 10_000
    max_page_bytes: int = 16 << 20

    def __post_init__(self):
        if min(self.max_keys, self.max_rows_per_key, self.max_rows_per_page, self.max_page_bytes) < 1 or self.max_keys > 100_000:
            raise ValidationError("limits are positive, and a page has 100,000 keys at most")
        if self.max_rows_per_key > self.max_rows_per_page:
            raise ValidationError("a key's rows must fit a page")


def close_sides(arrivals: DataFrame, sides: list[str]) -> DataFrame:
    """The data rows of (pos, op, side, key, value); op eof closes its side, and may be repeated. An arrival after its side's
    end, on an unknown side or without a key fails the job, and so does a side that is never closed."""
    ends = arrivals.where("op = 'eof'").groupBy("side").agg(F.min("pos").alias("_end"))
    known = F.array(*map(F.lit, sides))
    closed = ends.where(F.array_contains(known, F.col("side"))).agg(F.map_from_entries(F.collect_list(F.struct("side", "_end"))).alias("_ends"))  # 16 entries at most
    data = arrivals.where("op = 'data'").crossJoin(F.broadcast(closed))
    end = F.try_element_at("_ends", "side")
    fault = (
        F.when(~F.array_contains(known, F.col("side")), F.format_string("position %d: unknown side %s", "pos", "side"))
        .when(F.col("key").isNull(), F.format_string("position %d has no key", "pos"))
        .when(F.size("_ends") < len(sides), F.lit("all sides must close before the final drain"))
        .when(F.col("pos") > end, F.format_string("position %d follows the end of side %s at %d", "pos", "side", end))
    )
    checked = data.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))
    return checked.select("pos", "side", "key", "value")


def cell_sizes(tagged: DataFrame, sides: list[str], insert: str) -> DataFrame:
    """(key, rows, bytes) that each key's final rows will have, from counts and sums alone: nothing is multiplied out before."""
    long = F.octet_length(F.coalesce(F.col("value").cast("string"), F.lit("")))
    own = lambda s: F.col("side") == s
    if insert == "product":
        parts = [x for s in sides for x in (F.count_if(own(s)).alias(f"n_{s}"), F.coalesce(F.sum(F.when(own(s), long)), F.lit(0)).alias(f"b_{s}"))]
    else:
        pick = F.min_by if insert == "first" else F.max_by
        parts = [x for s in sides for x in (F.least(F.count_if(own(s)), F.lit(1)).alias(f"n_{s}"), F.coalesce(pick(F.when(own(s), long), F.when(own(s), F.col("pos"))), F.lit(0)).alias(f"b_{s}"))]
    counts = tagged.groupBy("key").agg(*parts)
    rows = F.lit(1.0)  # as a double, since a product of counts may pass a long
    for s in sides:
        rows = rows * F.greatest(F.col(f"n_{s}"), F.lit(1))
    size = rows * F.octet_length("key")
    for s in sides:
        size = size + rows / F.greatest(F.col(f"n_{s}"), F.lit(1)) * F.col(f"b_{s}")
    return counts.select("key", rows.alias("rows"), size.alias("bytes"))


def _next(rows: np.ndarray, size: np.ndarray, limits: DrainLimits) -> np.ndarray:
    """For each key the one that opens the next page, if it opens one itself."""
    n = len(rows)
    out = np.minimum(np.arange(n) + limits.max_keys, n)
    for own, most in ((rows, limits.max_rows_per_page), (size, limits.max_page_bytes)):
        ends = np.concatenate([[0.0], np.cumsum(own)])
        out = np.minimum(out, np.searchsorted(ends, ends[:-1] + most, "right") - 1)
    return out


def pages(sizes: DataFrame, limits: DrainLimits, block: int = KEYS_A_BLOCK) -> DataFrame:
    """(key, page) of (key, rows, bytes): pages from 0, filled in order of key as far as the limits go. A key beyond them raises."""
    fault = F.when(F.col("rows") > limits.max_rows_per_key, F.format_string("key %s gives %.0f rows; %d at most", "key", "rows", F.lit(limits.max_rows_per_key))).when(F.col("bytes") > limits.max_page_bytes, F.format_string("key %s gives %.0f bytes; %d at most", "key", "bytes", F.lit(limits.max_page_bytes)))
    checked = sizes.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))
    ranked = number_rows(checked, ["key"])
    block = max(block, 2 * limits.max_keys)
    at = F.call_function("div", F.col("rank"), F.lit(block).cast("long"))
    ahead = (F.col("rank") % block < limits.max_keys) & (at > 0)  # what the last page of the block before may reach
    dealt = ranked.withColumn("block", F.explode(F.when(ahead, F.array(at, at - 1)).otherwise(F.array(at))))

    def walk(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        own = int((pdf["rank"] // block == pdf["block"].iloc[0]).sum())
        return int(pdf["block"].iloc[0]), own, _next(pdf["rows"].to_numpy(float), pdf["bytes"].to_numpy(float), limits)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        number, own, after = walk(pdf.sort_values("rank"))
        exits, count = after.copy(), np.ones(len(after), np.int64)
        for i in range(own - 1, -1, -1):
            if after[i] < own:
                exits[i], count[i] = exits[after[i]], 1 + count[after[i]]
        n = min(limits.max_keys, own)
        return pd.DataFrame({"block": number, "entry": np.arange(n), "leaves": exits[:n] - own, "pages": count[:n]})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block_now, entry, page, found = None, 0, 0, None
        for pdf in batches:
            for number, at, leaves, n in pdf[["block", "entry", "leaves", "pages"]].itertuples(index=False):
                if number != block_now:
                    if found is not None:
                        entry, page = found[0], page + found[1]
                    block_now = number
                    yield pd.DataFrame({"block": [number], "entry": [entry], "page": [page]})
                if at == entry:
                    found = (leaves, n)

    def mark(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        _, own, after = walk(pdf)
        page = np.full(own, start["page"].iloc[0] - 1)
        i, number = int(start["entry"].iloc[0]), int(start["page"].iloc[0])
        while i < own:
            page[i : after[i]] = number
            i, number = int(after[i]), number + 1
        return pd.DataFrame({"key": pdf["key"].to_numpy()[:own], "page": page})

    tables = dealt.groupBy("block").applyInPandas(table, "block long, entry long, leaves long, pages long")
    starts = tables.coalesce(1).sortWithinPartitions("block", "entry").mapInPandas(chain, "block long, entry long, page long")
    return dealt.groupBy("block").cogroup(starts.groupBy("block")).applyInPandas(mark, "key string, page long")


def drain_final(arrivals: DataFrame, sides: list[str], insert: str = "last", limits: DrainLimits | None = None, block: int = KEYS_A_BLOCK) -> DataFrame:
    """The final join of arrivals with closings, a page to each row: the n-th drain of at most max_keys keys gives page n."""
    limits = limits or DrainLimits()
    tagged = close_sides(arrivals, sides)
    of = pages(cell_sizes(tagged, sides, insert), limits, block)
    return keyed_join(tagged, sides, insert, "final", limits.max_rows_per_key).join(of, "key")


def check_drain(arrivals: DataFrame, sides: list[str], insert: str, limits: DrainLimits) -> None:
    """Looks for the first key beyond the limits before anything is joined."""
    sizes = cell_sizes(close_sides(arrivals, sides), sides, insert)
    bad = sizes.where((F.col("rows") > limits.max_rows_per_key) | (F.col("bytes") > limits.max_page_bytes)).orderBy("key").first()
    if bad:
        raise LimitError(f"key {bad['key']!r} gives {bad['rows']:.0f} rows and {bad['bytes']:.0f} bytes")
