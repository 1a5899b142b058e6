"""Alignment of multi-stream events to windows: watermark replay as scans, dispositions, members, windows and gaps.

The replay is set-based. Every arrival, dropped or not, counts for its stream's running maximum (a dropped one can't raise the
watermark far enough to close a window earlier), so watermarks are ordered running maxima, and each event's window numbers and
disposition follow from the watermark before it. All doubles are computed as origin + i * hop; candidates from division are
corrected against the exact predicate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.clock import next_up, normalise
from spanweave.operators.scan import prefix_scan
from spanweave.schema import AlignConfig, LateEventError, LimitError, ValidationError
from spanweave.session import saved

ARRIVALS_A_BLOCK = 1 << 16


@dataclass(frozen=True)
class Grid:
    origin: float
    window: float
    hop: float

    def start(self, i: Column) -> Column:
        return F.lit(self.origin) + i * F.lit(self.hop)

    def end(self, i: Column) -> Column:
        return self.start(i) + F.lit(self.window)

    def _settle(self, guess: Column, holds) -> Column:
        """The largest i near guess for which holds(i), a predicate that falls once along i."""
        return F.when(holds(guess + 1), guess + 1).when(holds(guess), guess).when(holds(guess - 1), guess - 1).otherwise(guess - 2)

    def closed(self, watermark: Column) -> Column:
        """How many windows end at or before the watermark (0 while there is none)."""
        guess = F.floor((watermark - self.origin - self.window) / self.hop)
        return F.coalesce(F.greatest(F.lit(0).cast("long"), self._settle(guess, lambda i: self.end(i) <= watermark) + 1), F.lit(0).cast("long"))

    def last(self, horizon: Column) -> Column:
        """The last window that starts before the horizon (-1 or less: none)."""
        return self._settle(F.floor((horizon - self.origin) / self.hop), lambda i: self.start(i) < horizon)

    def first(self, t: Column) -> Column:
        """The first window that ends after t."""
        return self._settle(F.floor((t - self.origin - self.window) / self.hop), lambda i: self.end(i) <= t) + 1


@dataclass(frozen=True)
class Alignment:
    """dispositions: an event each, with t, horizon, disposition (ok, late, dropped, unassigned) and its first and last window;
    members: (idx, event); windows: one row per window of the dense grid; gaps."""

    config: AlignConfig
    dispositions: DataFrame
    members: DataFrame
    windows: DataFrame
    gaps: DataFrame


def _watermark(config: AlignConfig, suffix: str) -> Column:
    seen = [F.col(f"_m{k}{suffix}") for k in range(len(config.required_streams))]
    if not seen:
        return F.lit(None).cast("double")
    known = seen[0].isNotNull()
    for s in seen[1:]:
        known = known & s.isNotNull()
    return F.when(known, (F.least(*seen) if len(seen) > 1 else seen[0]) - F.lit(float(config.allowed_lateness_ms)))


def _spans(events: DataFrame, config: AlignConfig) -> DataFrame:
    """Normalised events with their horizon, the time that they reach to."""
    rows = normalise(events, config)
    return rows.withColumn("horizon", F.when(F.col("duration_ms") == 0, next_up(F.col("t"))).otherwise(F.col("t") + F.col("duration_ms")))


def classify(events: DataFrame, config: AlignConfig, order: list | None = None, block: Column | None = None, lenient: bool = False) -> DataFrame:
    """Dispositions of events in the given order; without one, offline: by (t, stream, id), in blocks of a hop each (as many
    as there are windows, which are limited). Under the reject policy a late event raises; lenient: it is marked rejected."""
    grid = Grid(float(config.origin_ms), float(config.window_ms), float(config.hop_ms))
    rows = _spans(events, config)
    if order is None:
        order, block = ["t", "stream", "id"], F.floor((F.col("t") - grid.origin) / grid.hop)
    values = {f"_m{k}": ("max", F.when(F.col("stream") == s, F.col("t"))) for k, s in enumerate(config.required_streams)}
    if values:
        rows = prefix_scan(rows, values, block, order)
    rows = rows.withColumn("watermark_ms", _watermark(config, "")).withColumn("_n", grid.closed(_watermark(config, "_before"))).drop(*[f"_m{k}{x}" for k in range(len(values)) for x in ("", "_before")])
    obsolete = F.col("horizon") <= grid.start(F.col("_n"))
    late = obsolete | ((F.col("_n") > 0) & (F.col("t") < grid.end(F.col("_n") - 1)))
    rows = rows.withColumn("_obsolete", obsolete).withColumn("_late", late)
    rows = rows.withColumn("first_idx", F.greatest(grid.first(F.col("t")), F.col("_n"))).withColumn("last_idx", grid.last(F.col("horizon")))
    dropped = F.col("_late") & ((F.lit(config.late_policy) == "drop") | F.col("_obsolete"))
    overlap = lambda i: (grid.start(i) < F.col("horizon")) & (F.col("t") < grid.end(i))
    idx = F.when(~dropped & (F.col("first_idx") <= F.col("last_idx")), F.filter(F.sequence("first_idx", "last_idx"), overlap)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("idxs", idx)
    refused = F.lit("rejected") if lenient else F.raise_error(F.format_string("event %s at %s is late under the reject policy", F.col("id"), F.col("t").cast("string"))).cast("string")
    kind = F.when(F.col("_late") & (F.lit(config.late_policy) == "reject"), refused).when(dropped, "dropped").when(F.size("idxs") == 0, "unassigned").when(F.col("_late"), "late").otherwise("ok")
    return rows.withColumn("disposition", kind).drop("_n", "_late", "_obsolete", "first_idx")


def check_identity(events: DataFrame) -> None:
    """Refuses repeated event ids."""
    again = events.groupBy("id").count().where("count > 1").orderBy("id").first()
    if again:
        raise ValidationError(f"event id {again['id']!r} occurs {again['count']} times")


def refuse_repeats(rows: DataFrame) -> DataFrame:
    """rows, failing the job where an id occurs again (which check_identity looks for before)."""
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min("id").alias("_again"))  # one row
    fault = F.raise_error(F.format_string("event id %s occurs more than once", F.col("_again"))).cast("boolean")
    return rows.crossJoin(F.broadcast(again)).where(F.when(F.col("_again").isNotNull(), fault).otherwise(True)).drop("_again")


def _total(rows: DataFrame, config: AlignConfig) -> DataFrame:
    """One row: the number of windows, up to the last closed one and the last one that a live event reaches. The last watermark
    follows from each stream's latest event, dropped ones included, since they raise no watermark far enough to close more."""
    grid = Grid(float(config.origin_ms), float(config.window_ms), float(config.hop_ms))
    seen = [F.max(F.when(F.col("stream") == s, F.col("t"))).alias(f"_m{k}") for k, s in enumerate(config.required_streams)]
    reach = F.max(F.when(F.col("disposition") != "dropped", F.col("last_idx"))).alias("_reach")
    return rows.agg(reach, *seen).select(F.greatest(grid.closed(_watermark(config, "")), F.col("_reach") + 1).alias("total"))


def _build(rows: DataFrame, config: AlignConfig, events: DataFrame) -> Alignment:
    """rows: one classification, which windows, members and their number are read from."""
    grid = Grid(float(config.origin_ms), float(config.window_ms), float(config.hop_ms))
    live = F.col("disposition") != "dropped"
    members = rows.where(live).select(F.explode("idxs").alias("idx"), "id", "stream", "modality", "t", "duration_ms", *[c for c in ("data",) if c in rows.columns])
    dense = _total(rows, config).where("total > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("total") <= config.max_output_windows, F.col("total") - 1).otherwise(F.raise_error(F.lit(f"more than {config.max_output_windows} windows")).cast("long")))).alias("idx"))
    found = members.groupBy("idx").agg(F.count(F.lit(1)).alias("n_events"), F.collect_set("stream").alias("streams"), F.array_sort(F.collect_set("modality")).alias("modalities"))
    required = F.array(*map(F.lit, config.required_streams)) if config.required_streams else F.array().cast("array<string>")
    windows = dense.join(found, "idx", "left").select(
        "idx",
        grid.start(F.col("idx")).alias("start_ms"),
        grid.end(F.col("idx")).alias("end_ms"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.array_except(required, F.coalesce("streams", F.array().cast("array<string>"))).alias("missing_streams"),
        F.coalesce("modalities", F.array().cast("array<string>")).alias("modalities"),
    )
    windows = windows.withColumn("complete", F.size("missing_streams") == 0)
    windows = windows.withColumn("n_events", F.when(F.col("n_events") <= config.max_events_per_window, F.col("n_events")).otherwise(F.raise_error(F.lit(f"more than {config.max_events_per_window} events in a window")).cast("long")))
    return Alignment(config, rows, members, windows, detect_gaps(events, config))


def align(events: DataFrame, config: AlignConfig, check: bool = False, unique: bool = True) -> Alignment:
    """Offline alignment, in order of time, in which no event is late. check: look for repeated ids and too many windows first.
    unique=False takes events whose ids may repeat; otherwise a repeated id fails the job. The classification runs at once."""
    return _checked(classify(events, config, lenient=check), config, events, check, True, unique)


def replay(events: DataFrame, config: AlignConfig, check: bool = False, positions_a_block: int = ARRIVALS_A_BLOCK, unique: bool = True) -> Alignment:
    """Alignment of events in order of arrival_pos. Sparse positions need wider blocks: one holds what a task scans. Under the
    reject policy the job fails on a late event; check: it is looked for first, as are repeated ids (actions of their own)."""
    rows = classify(events, config, ["arrival_pos"], F.expr(f"arrival_pos div {positions_a_block}"), lenient=check)
    return _checked(rows, config, events, check, False, unique)


def _checked(rows: DataFrame, config: AlignConfig, events: DataFrame, check: bool, in_order: bool, unique: bool) -> Alignment:
    if check:
        check_identity(events)
    rows = saved(rows, "dispositions")
    if check:
        if not in_order and config.late_policy == "reject" and (bad := rows.where("disposition = 'rejected'").orderBy("arrival_pos").first()):
            raise LateEventError(f"event {bad['id']!r} at {bad['t']} is late")
        span = rows.where("disposition <> 'dropped'").agg(F.max("last_idx")).first()[0]
        if span is not None and span >= config.max_output_windows:
            raise LimitError(f"{span + 1} windows; {config.max_output_windows} at most")
    return _build(refuse_repeats(rows) if unique and not check else rows, config, events)


def window_events(alignment: Alignment) -> DataFrame:
    """One row per window with its events in order of (t, stream, id)."""
    event = F.struct("t", "stream", "id", "modality", "duration_ms")
    lists = alignment.members.groupBy("idx").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return alignment.windows.join(lists, "idx", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<t:double,stream:string,id:string,modality:string,duration_ms:double>>")))


def detect_gaps(events: DataFrame, config: AlignConfig) -> DataFrame:
    """stream, start_ms, end_ms, expected_ms, observed_ms where a stream's next event is later than cadence * gap_factor."""
    if not config.expected_cadence_ms:
        return normalise(events, config).limit(0).selectExpr("stream", "t AS start_ms", "t AS end_ms", "t AS expected_ms", "t AS observed_ms")
    cadence = F.create_map(*[F.lit(v) for s, c in config.expected_cadence_ms.items() for v in (s, float(c))])
    rows = normalise(events, config).withColumn("expected_ms", F.try_element_at(cadence, "stream")).where("expected_ms IS NOT NULL").select("stream", "id", "t", "expected_ms")
    wide = 1024 * max(float(c) for c in config.expected_cadence_ms.values())
    rows = prefix_scan(rows, {"_last": ("max", F.col("t"))}, F.floor(F.col("t") / wide), ["t", "id"], ["stream"])  # in order of t the last is the largest
    observed = F.col("t") - F.col("_last_before")
    return rows.where(observed > F.col("expected_ms") * config.gap_factor).select("stream", (F.col("_last_before") + F.col("expected_ms")).alias("start_ms"), F.col("t").alias("end_ms"), "expected_ms", observed.alias("observed_ms"))
