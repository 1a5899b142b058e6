"""Tolerance joins of two streams of an alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.align import Alignment
from spanweave.schema import LimitError, number
from spanweave.session import saved

LEAST_BUCKET = 0.001


def band_join(left: DataFrame, right: DataFrame, tolerance: float, time: str = "t") -> DataFrame:
    """Pairs with |left - right| <= tolerance, columns prefixed l_ and r_: an equi-join on time buckets twice the tolerance
    wide, a microsecond at least (the left side visits those that its tolerance reaches, mostly two), then the exact predicate.
    With tolerance 0, equality."""
    number(tolerance, "tolerance", least=0)
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    if tolerance == 0:
        return a.join(b, F.col(f"l_{time}") == F.col(f"r_{time}")).withColumn("delta_ms", F.lit(0.0))
    wide, t = max(2 * tolerance, LEAST_BUCKET), F.col(f"l_{time}")
    slack = (F.abs(t / wide) + 1) * 4e-15  # more than the rounding of both sides
    a = a.withColumn("_bucket", F.explode(F.sequence(F.floor((t - tolerance) / wide - slack), F.floor((t + tolerance) / wide + slack))))
    b = b.withColumn("_bucket", F.floor(F.col(f"r_{time}") / wide))
    return a.join(b, "_bucket").drop("_bucket").withColumn("delta_ms", F.abs(F.col(f"l_{time}") - F.col(f"r_{time}"))).where(F.col("delta_ms") <= tolerance)


def join_streams(alignment: Alignment, left: str, right: str, max_delta_ms: float | None, max_comparisons: int | None = None) -> DataFrame:
    """left_id, right_id, delta_ms and window_indexes (common to both) of events in windows. Without a tolerance every pair
    counts, so then max_comparisons must be given and is checked first."""
    live = alignment.dispositions.where((F.col("disposition") != "dropped") & (F.size("idxs") > 0) & F.col("stream").isin(left, right))
    first, last = F.element_at("idxs", 1).alias("first"), F.element_at("idxs", -1).alias("last")  # an event's windows are a range
    live = saved(live.select("id", "stream", "t", first, last), "joined")  # each event once
    a, b = (live.where(F.col("stream") == s).select("id", "t", "first", "last") for s in (left, right))
    if max_comparisons is not None and (n := a.count() * b.count()) > max_comparisons:
        raise LimitError(f"{n} comparisons; {max_comparisons} at most")
    if max_delta_ms is None:
        if max_comparisons is None:
            raise LimitError("a join without tolerance needs max_comparisons")
        x, y = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns]) for d, p in ((a, "l"), (b, "r")))
        pairs = x.join(y).withColumn("delta_ms", F.abs(F.col("l_t") - F.col("r_t")))
    else:
        pairs = band_join(a, b, float(max_delta_ms))
    first, last = F.greatest("l_first", "r_first"), F.least("l_last", "r_last")
    common = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return pairs.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "delta_ms", common.alias("window_indexes"))
