"""Clock correction of streams, and robust fits of offset and drift from anchors (reference_ms, observed_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.schema import MAX_DRIFT_PPM, AlignConfig, ClockDrift, LimitError, ValidationError
from spanweave.session import saved

MAX_DRIFT_ANCHORS = 1024


def next_up(x: Column) -> Column:
    """The next double above x: no built-in function, so the JVM's own."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), x).cast("double")


def _lookup(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def offset_at(config: AlignConfig, stream: Column, timestamp: Column) -> Column:
    """Drift where the stream has one, else its constant offset, else 0."""
    drift = {n: {s: float(getattr(d, n)) for s, d in config.clock_drifts.items()} for n in ("offset_ms", "epoch_ms")}
    rate = {s: d.rate_ppm * 1e-6 for s, d in config.clock_drifts.items()}
    by_drift = _lookup(drift["offset_ms"], stream) + _lookup(rate, stream) * (timestamp - _lookup(drift["epoch_ms"], stream))
    return F.coalesce(by_drift, _lookup({s: float(v) for s, v in config.offsets_ms.items()}, stream), F.lit(0.0))


def normalise(events: DataFrame, config: AlignConfig) -> DataFrame:
    """Adds t, the corrected timestamp; timestamp_ms stays as it came, durations aren't scaled."""
    return events.withColumn("t", F.col("timestamp_ms") + offset_at(config, F.col("stream"), F.col("timestamp_ms")))


def _median(rows: DataFrame) -> float:
    """Exact median of the column d, none of it null: ranges of values are counted, and ranks found in the middle ones alone."""
    rows = saved(rows.repartitionByRange("d").select("d", F.spark_partition_id().alias("_p")), "ranges")
    before, found = 0, []
    counts = sorted(rows.groupBy("_p").count().collect())  # one row for each range
    total = sum(n for _, n in counts)
    for p, n in counts:
        ranks = [k - before + 1 for k in {(total - 1) // 2, total // 2} if before <= k < before + n]
        if ranks:
            own = rows.where(F.col("_p") == p).withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("d")))
            found += [r["d"] for r in own.where(F.col("_k").isin(ranks)).collect()]
        before += n
    return sum(found) / len(found)


def estimate_offset(anchors: DataFrame) -> DataFrame:
    """One row: offset_ms (median of reference - observed), mad_ms, max_residual_ms, anchors. Needs one anchor at least."""
    d = saved(anchors.select((F.col("reference_ms") - F.col("observed_ms")).alias("d")).where("d IS NOT NULL"), "offsets")
    n, out = d.count(), []
    if n:
        mid = _median(d)
        residual = d.select(F.abs(F.col("d") - F.lit(mid)).alias("d"))
        out = [(mid, _median(residual), residual.agg(F.max("d")).first()[0], n)]
    return d.sparkSession.createDataFrame(out, "offset_ms double, mad_ms double, max_residual_ms double, anchors long")


def sliced_anchors(anchors: DataFrame, slices: int = MAX_DRIFT_ANCHORS) -> DataFrame:
    """All anchors as `slices` anchors at most: the medians of equal slices of the reference time."""
    ends = anchors.agg(F.min("reference_ms").alias("_a"), F.max("reference_ms").alias("_z"))
    at = F.when(F.col("_z") > F.col("_a"), F.least(F.lit(slices - 1), F.floor((F.col("reference_ms") - F.col("_a")) * slices / (F.col("_z") - F.col("_a"))))).otherwise(0)
    cut = anchors.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("_slice"))
    return cut.agg(F.median("reference_ms").alias("reference_ms"), F.median("observed_ms").alias("observed_ms")).drop("_slice")


def drift_pairs(anchors: DataFrame) -> DataFrame:
    """Slopes (ppm) of all pairs of anchors with different observed times; anchors are at most MAX_DRIFT_ANCHORS."""
    rows = anchors.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("observed_ms", "reference_ms")))
    rows = rows.withColumn("d", F.col("reference_ms") - F.col("observed_ms"))
    a, b = rows.select(F.col("i").alias("i"), F.col("observed_ms").alias("x0"), F.col("d").alias("d0")), rows.select(F.col("i").alias("j"), F.col("observed_ms").alias("x1"), F.col("d").alias("d1"))
    return a.join(b, F.col("i") < F.col("j")).where("x1 <> x0").select("i", "j", ((F.col("d1") - F.col("d0")) / (F.col("x1") - F.col("x0")) * 1e6).alias("ppm"))


def estimate_drift(anchors: DataFrame, check: bool = True) -> DataFrame:
    """One row: rate_ppm (median slope of pairs), epoch_ms (median observed time), offset_ms (median detrended difference),
    mad_ms, max_residual_ms, anchors, usable_pairs.

    Refused with fewer than 5 anchors or more than MAX_DRIFT_ANCHORS, without a usable pair, if one anchor takes part in
    half of the usable pairs or more, and beyond MAX_DRIFT_PPM.
    """
    if check:
        n = anchors.count()
        if n > MAX_DRIFT_ANCHORS:
            raise LimitError(f"{n} anchors; {MAX_DRIFT_ANCHORS} at most")
        if n < 5:
            raise ValidationError(f"{n} anchors; 5 at least")
        pairs = drift_pairs(anchors)
        usable = pairs.count()
        shared = pairs.select(F.explode(F.array("i", "j")).alias("a")).groupBy("a").count().agg(F.max("count")).first()[0] or 0
        if not usable or 2 * shared >= usable:
            raise ValidationError("one anchor decides over half of the usable pairs, or none is usable")
    rate = drift_pairs(anchors).agg(F.median("ppm").alias("rate_ppm"), F.count("ppm").alias("usable_pairs"))
    rows = anchors.crossJoin(F.broadcast(rate)).crossJoin(F.broadcast(anchors.agg(F.median("observed_ms").alias("epoch_ms"), F.count("observed_ms").alias("anchors"))))
    rows = rows.withColumn("e", F.col("reference_ms") - F.col("observed_ms") - F.col("rate_ppm") * 1e-6 * (F.col("observed_ms") - F.col("epoch_ms")))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.median("e").alias("offset_ms"))))
    residual = F.abs(F.col("e") - F.col("offset_ms"))
    out = rows.groupBy("rate_ppm", "epoch_ms", "offset_ms", "anchors", "usable_pairs").agg(F.median(residual).alias("mad_ms"), F.max(residual).alias("max_residual_ms"))
    if check and abs(out.first()["rate_ppm"]) > MAX_DRIFT_PPM:
        raise ValidationError("the fitted rate is out of range")
    return out


def as_correction(fit: DataFrame) -> ClockDrift:
    row = fit.first()
    return ClockDrift(row["offset_ms"], row["rate_ppm"], row["epoch_ms"])
