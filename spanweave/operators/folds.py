"""Keyed folds over fixed windows of integer ticks, with explicit watermarks.

Input rows are (pos, op, timestamp, key, value); op is process, watermark (timestamp is the new watermark), finish or drain.
Window i covers [origin + i * hop, origin + i * hop + width), i any integer. An arrival is late if its timestamp is below the
watermark before it (tested first), a gap if no window holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.scan import number_rows, prefix_scan
from spanweave.operators.stateful import fold_groups
from spanweave.schema import MAX_TICK, LateEventError, ValidationError
from spanweave.session import saved


@dataclass(frozen=True)
class FoldWindow:
    width: int
    hop: int | None = None
    origin: int = 0
    tick_unit: str = "ms"
    late_policy: str = "reject"

    def __post_init__(self):
        if self.hop is None:
            object.__setattr__(self, "hop", self.width)
        if self.width <= 0 or self.hop <= 0 or max(self.width, self.hop, abs(self.origin)) > MAX_TICK:
            raise ValidationError("width and hop are positive safe integers")
        if self.late_policy not in ("reject", "drop"):
            raise ValidationError(f"late_policy: {self.late_policy!r}")

    def _div(self, x: Column) -> Column:
        """Division by hop, rounded down."""
        hop = F.lit(self.hop).cast("long")
        return F.call_function("div", x - F.pmod(x, hop), hop)

    def first(self, t: Column) -> Column:
        return self._div(t - F.lit(self.origin + self.width).cast("long")) + 1

    def last(self, t: Column) -> Column:
        return self._div(t - F.lit(self.origin).cast("long"))

    def start(self, i: Column) -> Column:
        return F.lit(self.origin).cast("long") + i * F.lit(self.hop).cast("long")


def with_watermark(control: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds watermark (the largest so far, null before the first) to rows with control operations, in order of pos."""
    mark = {"watermark": ("max", F.when(F.col("op") == "watermark", F.col("timestamp")))}
    return prefix_scan(control, mark, F.expr(f"pos div {block}"), ["pos"]).drop("watermark_before")


def classify(control: DataFrame, spec: FoldWindow) -> DataFrame:
    """The process rows with state (late, gap or ok), first and last window."""
    rows = with_watermark(control).where("op = 'process'")
    first, last = spec.first(F.col("timestamp")), spec.last(F.col("timestamp"))
    state = F.when(F.col("timestamp") < F.col("watermark"), "late").when(first > last, "gap").otherwise("ok")
    return rows.withColumn("first_idx", first).withColumn("last_idx", last).withColumn("state", state)


def members(control: DataFrame, spec: FoldWindow, check: bool = False) -> DataFrame:
    """One row per arrival and window: pos, key, idx, timestamp, value. Under the reject policy a late arrival raises, check
    being an action that looks for the first one before."""
    rows = classify(control, spec)
    if check and spec.late_policy == "reject" and (bad := rows.where("state = 'late'").orderBy("pos").first()):
        raise LateEventError(f"arrival {bad['pos']} at {bad['timestamp']} is below the watermark {bad['watermark']}")
    if spec.late_policy == "reject":
        late = F.raise_error(F.format_string("arrival %d at %d is below the watermark", F.col("pos"), F.col("timestamp"))).cast("boolean")
        rows = rows.where(F.when(F.col("state") == "late", late).otherwise(F.col("state") == "ok"))  # alone, as with state = 'ok' the optimizer would drop it
    else:
        rows = rows.where("state = 'ok'")
    return rows.select("pos", "key", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"), "timestamp", "value")


def fold(control: DataFrame, spec: FoldWindow, aggregates: dict[str, Column], check: bool = False) -> DataFrame:
    """Window rows by plain aggregates of value: key, idx, start, end, tick_unit, input_count and the aggregates, for windows
    that are eligible at the end: finished, or the last watermark has reached their end."""
    out = members(control, spec, check).groupBy("key", "idx").agg(F.count(F.lit(1)).alias("input_count"), *[c.alias(n) for n, c in aggregates.items()])
    return _eligible(out, control, spec)


def fold_ordered(control: DataFrame, spec: FoldWindow, zero: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, by_time: bool = False, check: bool = False) -> DataFrame:
    """A fold in order of arrival (or of time, then arrival: the released order of an ordered window), as a value column."""
    order = F.struct("timestamp", "pos", "value") if by_time else F.struct("pos", "value")
    cells = members(control, spec, check).groupBy("key", "idx").agg(F.array_sort(F.collect_list(order)).alias("_own"))
    folded = F.aggregate("_own", zero, lambda a, x: merge(a, x["value"]), finish) if finish else F.aggregate("_own", zero, lambda a, x: merge(a, x["value"]))
    out = cells.select("key", "idx", F.size("_own").cast("long").alias("input_count"), folded.alias("value"))
    return _eligible(out, control, spec)


def fold_python(control: DataFrame, spec: FoldWindow, begin: Callable[[], object], fold: Callable[[object, object], object], finalize: Callable[[object], object] | None = None, value_type: str = "string", by_time: bool = False, check: bool = False) -> DataFrame:
    """A fold by Python functions, in order of arrival (or of time, then arrival), as a value column; see fold_groups."""
    order = ["timestamp", "pos"] if by_time else ["pos"]
    return _eligible(fold_groups(members(control, spec, check), ["key", "idx"], order, begin, fold, finalize, value_type), control, spec)


def closed_by(control: DataFrame, indexes: DataFrame, spec: FoldWindow, block: int = 1 << 20) -> DataFrame:
    """(idx, closer): the position of the control row that made each window of indexes (idx) eligible - the first watermark that
    reached its end, else the finish; without one the window isn't closed. Both are put in falling order of time, so the closer
    is a running minimum of positions."""
    marks = control.where("op = 'watermark'").groupBy("timestamp").agg(F.min("pos").alias("closer")).select(F.col("timestamp").alias("tick"), F.lit(0).alias("kind"), "closer", F.lit(None).cast("long").alias("idx"))
    ends = indexes.select((spec.start(F.col("idx")) + spec.width).alias("tick"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("closer"), "idx")
    found = prefix_scan(marks.unionByName(ends), {"first": ("min", F.col("closer"))}, F.call_function("div", -F.col("tick"), F.lit(block * spec.hop).cast("long")), [F.col("tick").desc(), "kind"])
    finish = control.where("op = 'finish'").agg(F.min("pos").alias("_finish"))  # one row
    return found.where("kind = 1").crossJoin(F.broadcast(finish)).select("idx", F.coalesce("first", "_finish").alias("closer")).where("closer IS NOT NULL")


def drain(cells: DataFrame, control: DataFrame, spec: FoldWindow, strict: bool = True, block: int = 1 << 16) -> DataFrame:
    """cells (key, idx, ...) that are drained, with place (their number from 0 in order of window, then key) and epoch (the
    position of the drain row that put them out). A drain row's timestamp is the most windows that it takes; null is no limit.

    Windows become eligible in order of their index, so those put out by the j-th drain are a range of places: its end is the
    least, over the drains i up to j and the start, of what was eligible at i plus what drains after i may take. strict: no
    arrival or watermark may come while an eligible window waits.
    """
    wide = F.lit(1 << 45).cast("long")
    cells = saved(cells, "cells")
    closers = closed_by(control, cells.select("idx").distinct(), spec)
    ready = number_rows(cells.join(closers, "idx"), ["idx", "key"], "place")
    sizes = ready.groupBy(F.col("closer").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    steps = sizes.select("pos", "n", F.lit(0).cast("long").alias("cap"), F.lit(None).cast("long").alias("input"), F.lit(False).alias("drains"))
    if strict:  # what comes in, to see whether a window waits then
        inputs = control.where("op IN ('process', 'watermark')").select("pos", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cap"), F.col("pos").alias("input"), F.lit(False).alias("drains"))
        steps = steps.unionByName(inputs).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("cap").alias("cap"), F.max("input").alias("input"), F.lit(False).alias("drains"))
    drains = control.where("op = 'drain'").select("pos", F.lit(0).cast("long").alias("n"), F.coalesce("timestamp", wide).alias("cap"), F.lit(None).cast("long").alias("input"), F.lit(True).alias("drains"))
    line = F.call_function("div", F.col("pos"), F.lit(block).cast("long"))
    scan = prefix_scan(saved(steps.unionByName(drains), "steps"), {"eligible": ("sum", F.col("n").cast("long")), "room": ("sum", F.col("cap"))}, line, ["pos"])
    scan = prefix_scan(saved(scan, "steps"), {"low": ("min", F.when(F.col("drains"), F.col("eligible") - F.col("room")))}, line, ["pos"])
    taken = F.coalesce(F.col("room") + F.least(F.col("low"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    scan = saved(scan.withColumn("taken", F.greatest(taken, F.lit(0).cast("long"))), "steps")
    if strict:
        scan = prefix_scan(scan, {"_taken": ("max", F.when(F.col("drains"), F.col("taken")))}, line, ["pos"])
        waiting = F.col("input").isNotNull() & (F.coalesce("eligible_before", F.lit(0)) > F.coalesce("_taken_before", F.lit(0)))
        fault = F.raise_error(F.format_string("position %d comes while closed windows wait for a drain", F.col("pos"))).cast("long")
        refusals = scan.agg(F.max(F.when(waiting, fault)).alias("_fault"))
    ends = scan.where("drains").select((F.col("taken") - 1).alias("place"), F.lit(0).alias("kind"), F.col("pos").alias("epoch"))
    own = ready.select("place", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("epoch"))
    found = prefix_scan(ends.unionByName(own), {"out": ("min", F.col("epoch"))}, F.call_function("div", -F.col("place"), F.lit(block).cast("long")), [F.col("place").desc(), "kind"])
    out = ready.join(found.where("kind = 1 AND out IS NOT NULL").select("place", F.col("out").alias("epoch")), "place").drop("closer")
    return out.join(F.broadcast(refusals), F.col("_fault").isNull()).drop("_fault") if strict else out  # one row


def all_cells(control: DataFrame, spec: FoldWindow, aggregates: dict[str, Column], check: bool = False) -> DataFrame:
    """fold() without its last step: every window that an arrival has created, closed or not."""
    out = members(control, spec, check).groupBy("key", "idx").agg(F.count(F.lit(1)).alias("input_count"), *[c.alias(n) for n, c in aggregates.items()])
    return out.withColumn("start", spec.start(F.col("idx"))).withColumn("end", F.col("start") + spec.width)


def check_control(control: DataFrame, block: int = 1 << 16) -> DataFrame:
    """One row: the last watermark (_mark) and whether the input is finished (_finished). Raises where a watermark is below one
    before it, or where an arrival or a watermark follows the finish (repeated ones are fine)."""
    marks = prefix_scan(control.where("op = 'watermark'"), {"_seen": ("max", F.col("timestamp"))}, F.expr(f"pos div {block}"), ["pos"])
    back = F.raise_error(F.format_string("the watermark at %d goes back to %d", F.col("pos"), F.col("timestamp"))).cast("long")
    mark = marks.agg(F.max(F.when(F.col("timestamp") < F.col("_seen_before"), back).otherwise(F.col("timestamp"))).alias("_mark"))
    ends = control.agg(F.min(F.when(F.col("op") == "finish", F.col("pos"))).alias("_end"), F.max(F.when(F.col("op").isin("process", "watermark"), F.col("pos"))).alias("_last"))
    after = F.raise_error(F.format_string("position %d follows the finish", F.col("_last"))).cast("boolean")
    finished = F.when(F.col("_last") > F.col("_end"), after).otherwise(F.col("_end").isNotNull()).alias("_finished")
    return mark.crossJoin(F.broadcast(ends.select(finished)))  # two rows of one


def _eligible(cells: DataFrame, control: DataFrame, spec: FoldWindow) -> DataFrame:
    end = check_control(control)
    out = cells.withColumn("start", spec.start(F.col("idx"))).withColumn("end", F.col("start") + spec.width)
    out = out.crossJoin(F.broadcast(end)).where(F.col("_finished") | (F.col("end") <= F.col("_mark"))).drop("_mark", "_finished")
    rest = [c for c in out.columns if c not in ("key", "idx", "start", "end")]
    return out.select("key", "idx", "start", "end", F.lit(spec.tick_unit).alias("tick_unit"), *rest)


def counters(control: DataFrame, spec: FoldWindow) -> DataFrame:
    """One row: processed, late, gap and memberships."""
    n = F.when(F.col("state") == "ok", F.col("last_idx") - F.col("first_idx") + 1).otherwise(0)
    return classify(control, spec).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("state") == "late").alias("late"), F.count_if(F.col("state") == "gap").alias("gap"), F.coalesce(F.sum(n), F.lit(0)).alias("memberships"))


def counter_algebra(cells: DataFrame, drained: DataFrame, control: DataFrame, spec: FoldWindow) -> DataFrame:
    """counters() with the windows that were created, emitted (drained) and are retained, and the memberships in either: created is
    emitted and retained, memberships are finalized and retained ones."""
    made = cells.agg(F.count(F.lit(1)).alias("created"), F.coalesce(F.sum("input_count"), F.lit(0)).alias("_all"))
    out = drained.agg(F.count(F.lit(1)).alias("emitted"), F.coalesce(F.sum("input_count"), F.lit(0)).alias("finalized_memberships"))
    rows = counters(control, spec).crossJoin(F.broadcast(made)).crossJoin(F.broadcast(out))  # one row each
    return rows.withColumns({"retained": F.col("created") - F.col("emitted"), "retained_memberships": F.col("_all") - F.col("finalized_memberships")}).drop("_all")
