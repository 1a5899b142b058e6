"""The registered queries of the engine on the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import clock
from spanweave.operators import align as A
from spanweave.operators import bandjoin, folds, joins, sessions, steps
from spanweave.plans.flow import Edge, Graph, Node, linear
from spanweave.plans.pages import Pages
from spanweave.schema import AlignConfig, ClockDrift
from spanweave.session import saved, shared_dir
from spanweave.sources import jsonl
from spanweave.streaming import processors
from spanweave.streaming.runner import run_batches

HOUR = 3_600_000.0
ORIGIN = 1_704_067_200_000.0
STREAMS = ("click", "error", "purchase", "signup", "view")
OFFSETS, DRIFT = {"click": -40.0, "view": 15.0}, {"error": ClockDrift(120.0, 250.0, ORIGIN)}
TUMBLING = AlignConfig(6 * HOUR, None, 0.0, ORIGIN, STREAMS, late_policy="drop")
SLIDING = AlignConfig(6 * HOUR, 2 * HOUR, 0.0, ORIGIN, STREAMS, late_policy="drop")
GAPPED = AlignConfig(4 * HOUR, 6 * HOUR, 0.0, ORIGIN, ("click", "view"), late_policy="drop")
CADENCE = {s: 4 * HOUR / 10 for s in STREAMS}
SIDES = ["click", "view", "purchase"]
ARRIVAL_BLOCK = 24 * 3_600_000 * 10**6
SPECS = {"tumbling": folds.FoldWindow(4 * 3_600_000, None, 0, late_policy="drop"), "sliding": folds.FoldWindow(4 * 3_600_000, 3_600_000, 1000, late_policy="drop"), "gapped": folds.FoldWindow(2 * 3_600_000, 5 * 3_600_000, -7, late_policy="drop")}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros(c: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000
    return day + F.hour(c) * F.lit(3_600_000_000).cast("long") + F.minute(c) * F.lit(60_000_000).cast("long") + (F.extract(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")


def _millis(c: str = "ts") -> Column:
    return F.call_function("div", _micros(c), F.lit(1000).cast("long"))


def _nearest_millis(c: str = "ts") -> Column:
    """Milliseconds as the SQL's epoch_ms gives them: rounded to the nearest, halves away from zero."""
    us = _micros(c)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000).cast("long"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as aligner events, with a deterministic disorder of up to two hours as arrival order."""
    ms = _micros() / F.lit(1000.0)
    arrival = (_nearest_millis() + F.col("event_id") * 7919 % 7_200_000) * 1_000_000 + F.col("event_id")
    return _table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.col("event_type").alias("stream"), F.col("event_type").alias("modality"), ms.alias("timestamp_ms"), (F.col("event_id") % 4 * 900_000.0).alias("duration_ms"), arrival.alias("arrival_pos"))


def _windows(a: A.Alignment) -> DataFrame:
    return a.windows.select("idx", "start_ms", "end_ms", F.col("n_events").cast("long").alias("n_events"), "complete", F.array_join("missing_streams", ",").alias("missing"), F.array_join("modalities", ",").alias("modalities"))


def _late(policy: str) -> AlignConfig:
    return AlignConfig(6 * HOUR, 3 * HOUR, HOUR / 4, ORIGIN, STREAMS, late_policy=policy)


def _replayed(spark: SparkSession, d: str, policy: str) -> A.Alignment:
    return A.replay(_events(spark, d), _late(policy), positions_a_block=ARRIVAL_BLOCK)


def _dispositions(spark: SparkSession, d: str, policy: str) -> DataFrame:
    return _replayed(spark, d, policy).dispositions.select("id", "disposition", F.size("idxs").cast("long").alias("n_windows"))


def _clocked(spark: SparkSession, d: str) -> DataFrame:
    config = AlignConfig(HOUR, offsets_ms=OFFSETS, clock_drifts=DRIFT)
    return clock.normalise(_events(spark, d), config)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of a simulated clock: every signup, observed with an offset, a drift and a jitter."""
    e = _table(spark, d, "events").where("event_type = 'signup'")
    ref = _millis().cast("double")
    return e.select(ref.alias("reference_ms"), (ref - 250.0 - (ref - ORIGIN) * 0.0001 + F.col("event_id") % 7).alias("observed_ms"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.expr("cast(unix_date(to_date(ts)) div 3 as string)"))
    return e.select(F.col("event_id").alias("pos"), F.col("event_type").alias("side"), key.alias("key"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("value"))


def _joined(insert: str, emit: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: joins.keyed_join(_tagged(spark, d), SIDES, insert, emit)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """(pos, ordinal, key, value): an event each, value in hundredths."""
    e = _table(spark, d, "events")
    return steps.records(e.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("key"), F.round(F.col("value") * 100).cast("long").alias("value")))


def _control(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals with up to two hours of disorder, and a watermark an hour back after every 50th."""
    e = _table(spark, d, "events").withColumn("ms", _nearest_millis())
    cents = F.round(F.col("value") * 100).cast("long")
    data = e.select((F.col("event_id") * 2).alias("pos"), F.lit("process").alias("op"), (F.col("ms") - F.col("event_id") * 7919 % 7_200_000).alias("timestamp"), F.col("user_id").cast("string").alias("key"), cents.alias("value"), "event_type")
    marks = e.where("event_id % 50 = 0").select((F.col("event_id") * 2 + 1).alias("pos"), F.lit("watermark").alias("op"), (F.col("ms") - 3_600_000).alias("timestamp"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("string").alias("event_type"))
    return data.unionByName(marks)


def _folded(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: folds.fold(_control(spark, d), SPECS[name], {"total": F.sum("value"), "least": F.min("value"), "most": F.max("value")})


def _concat(spark: SparkSession, d: str, by_time: bool) -> DataFrame:
    control = _control(spark, d).drop("value").withColumnRenamed("event_type", "value")
    out = folds.fold_ordered(control, SPECS["tumbling"], F.lit(""), lambda a, x: F.concat(a, F.lit("|"), x), lambda a: F.substring(a, 2, 1_000_000_000), by_time=by_time)
    return out.select("key", "idx", "start", "end", "input_count", "value")


def _suffix(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows go through a suffix: only totals above 100, then a running total per key in window order."""
    closed = folds.fold(_control(spark, d), SPECS["tumbling"], {"total": F.sum("value")})
    rows = closed.select(F.col("idx").alias("pos"), F.lit(0).cast("long").alias("ordinal"), "key", F.col("total").alias("value"))
    kept = steps.filter_records(rows, F.col("value") > 100)
    return steps.running(kept, running_total=("sum", F.col("value"))).select("pos", "key", "value", "running_total")


def _expand(spark: SparkSession, d: str) -> DataFrame:
    """Each record becomes its value and, if above 5000, its half."""
    r = _records(spark, d)
    values = F.when(F.col("value") > 5000, F.array("value", F.expr("value div 2"))).otherwise(F.array("value"))
    return steps.flat_map(r, values)


def _branch_merge(spark: SparkSession, d: str) -> DataFrame:
    high, low = steps.branch(_records(spark, d), F.col("value") >= 5000)
    return steps.merge([steps.map_values(low, -F.col("value")), steps.map_values(high, F.col("value") + 1), steps.map_values(high, F.lit(7).cast("long"))])


def _streak(spark: SparkSession, d: str) -> DataFrame:
    """Keyed state in Python: every third record of a key emits the sum of the last three and forgets them."""

    def update(value, state):
        state = [*state, value]
        return (state, sum(state), len(state) == 3, len(state) < 3)

    return steps.stateful_map(_records(spark, d), list, update, value_type="long")


def _stateful_expand(spark: SparkSession, d: str) -> DataFrame:
    """Keyed state in Python: each record emits as many counters as it has places in its key modulo 3."""

    def update(value, state):
        n = state[0] + 1
        return [n], [n * 10 + k for k in range(n % 3)], True

    return steps.stateful_flat_map(_records(spark, d), lambda: [0], update, value_type="long")


def _reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Two sources joined per order, absent sides included: the order's price and its lines' net sum, in hundredths."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.lit("order").alias("side"), F.col("o_orderkey").cast("string").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("value"))
    p = lines.select(F.col("l_orderkey").alias("pos"), F.lit("lines").alias("side"), F.col("l_orderkey").cast("string").alias("key"), "value")
    return joins.keyed_join(o.unionByName(p), ["order", "lines"], "last", "final").drop("pos", "ordinal")


def _band(spark: SparkSession, d: str, indexes: bool) -> DataFrame:
    out = bandjoin.join_streams(A.align(_events(spark, d), SLIDING), "purchase", "signup", HOUR / 2)
    out = out.withColumn("delta_ms", F.round("delta_ms", 3))
    return out.withColumn("window_indexes", F.array_join(F.col("window_indexes").cast("array<string>"), ",")) if indexes else out.drop("window_indexes")


def _branched() -> Graph:
    """A graph with fan-out: high values are doubled and expanded, low ones renamed, both merged; high ones also end apart."""
    v = F.col("value")
    return Graph(
        "orders", "1",
        (Node("in", "entry"), Node("high", "branch", v >= 5000), Node("double", "map", v * 2), Node("parts", "flat_map", F.array(v, v - 1)), Node("low", "key_by", F.concat(F.lit("low"), F.pmod(v, F.lit(3)).cast("string"))), Node("all", "merge"), Node("apart", "drop_key")),
        (Edge("in", "high"), Edge("high", "double", True), Edge("high", "low", False), Edge("double", "parts"), Edge("double", "apart"), Edge("low", "all"), Edge("parts", "all")),
    )


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return _branched().outputs({"in": _records(spark, d)})


def _window_graph(spark: SparkSession, d: str) -> DataFrame:
    """Prefix filter, window, suffix map: sums of positive values per closed window, as text."""
    c = _control(spark, d)
    data = c.where("op = 'process'").select("pos", "key", "value", "timestamp", F.lit(0).cast("long").alias("ordinal"))
    spec = {"spec": SPECS["sliding"], "aggregates": {"total": F.sum("value")}, "control": c.where("op <> 'process'").select("pos", "op", "timestamp")}
    g = linear("windows", "1", [Node("keep", "filter", F.col("value") % 2 == 0), Node("window", "window", spec), Node("total", "map", F.get_json_object("value", "$.total"))])
    return g.outputs({"input": data}).select("pos", "key", "value")


def _streamed_total(spark: SparkSession, d: str) -> DataFrame:
    """Running totals by a stateful stream, from a file sink."""
    return run_batches(_records(spark, d).drop("ordinal"), [F.lit(True)], lambda s: processors.stateful(s, processors.RunningTotal()))


def _journal_page(spark: SparkSession, d: str) -> DataFrame:
    """Two appends of orders; a cursor opened after the first reads a page that the second doesn't change."""
    pages = Pages(spark, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}")
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    pages.append(rows.where("o_orderstatus = 'O'"), ["o_orderkey"])
    cursor = pages.cursor()
    pages.append(rows.where("o_orderstatus <> 'O'"), ["o_orderkey"])
    _, cursor = pages.read(cursor, 10)
    return pages.read(cursor, 1000)[0].select("seq", "o_orderkey", "o_orderstatus")


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read back by the strict reader, positions in the order of the file."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    fields = ["id", "stream", "modality", "timestamp_ms", "duration_ms"]
    _events(spark, d).select(*fields).orderBy("timestamp_ms").write.json(path)
    return jsonl.load_events(spark, path).select("arrival_pos", "id", "stream", F.round("timestamp_ms", 3).alias("timestamp_ms"), "duration_ms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from spanweave import catalog_control

    out = catalog_control.queries() | {
        "graph_branches": _graph,
        "graph_window_suffix": _window_graph,
        "stream_running_total": _streamed_total,
        "journal_page": _journal_page,
        "json_lines_round_trip": _json_lines,
        "align_tumbling": lambda s, d: _windows(A.align(_events(s, d), TUMBLING)),
        "align_sliding": lambda s, d: _windows(A.align(_events(s, d), SLIDING)),
        "align_gapped": lambda s, d: _windows(A.align(_events(s, d), GAPPED)),
        "align_members": lambda s, d: A.align(_events(s, d), SLIDING).members.select("idx", "id"),
        "align_replay_drop_disposition": lambda s, d: _dispositions(s, d, "drop"),
        "align_replay_accept_disposition": lambda s, d: _dispositions(s, d, "accept"),
        "align_replay_windows": lambda s, d: _windows(_replayed(s, d, "drop")),
        "cadence_gaps": lambda s, d: A.detect_gaps(_events(s, d), AlignConfig(HOUR, expected_cadence_ms=CADENCE, gap_factor=1.6)).select("stream", *[F.round(c, 3).alias(c) for c in ("start_ms", "end_ms", "expected_ms", "observed_ms")]),
        "sessions": lambda s, d: _sessions(_events(s, d).withColumn("duration_ms", F.lit(1000.0))),
        "sessions_with_duration": lambda s, d: _sessions(_events(s, d).withColumn("duration_ms", F.col("duration_ms") + 1000.0)),
        "partition_events": lambda s, d: sessions.partition_events(_events(s, d), 7).select("id", "partition_id"),
        "clock_normalise": lambda s, d: _clocked(s, d).select("id", F.floor("t").alias("t")),
        **dict.fromkeys(("offset_fit", "offset_fit_every"), lambda s, d: _rounded(clock.estimate_offset(_anchors(s, d)))),
        **dict.fromkeys(("drift_fit", "drift_fit_every"), lambda s, d: _rounded(clock.estimate_drift(saved(clock.sliced_anchors(_anchors(s, d)), "anchors")))),
        "band_join": lambda s, d: _band(s, d, False),
        "band_join_with_windows": lambda s, d: _band(s, d, True),
        "flow_map_filter": lambda s, d: steps.filter_records(steps.map_values(_records(s, d), F.col("value") * 3 + 1), F.col("value") % 2 == 0),
        "flow_flat_map": _expand,
        "flow_branch_merge": _branch_merge,
        "flow_key_by": lambda s, d: steps.key_by(steps.drop_key(_records(s, d)), F.concat(F.lit("v"), (F.col("value") % 10).cast("string"))),
        "flow_running_total": lambda s, d: steps.running(_records(s, d), total=("sum", F.col("value")), seen=("sum", F.lit(1).cast("long"))),
        "flow_stateful_map": _streak,
        "flow_stateful_expand": _stateful_expand,
        "fold_late_counters": lambda s, d: folds.counters(_control(s, d), SPECS["gapped"]),
        "fold_ordered_concat": lambda s, d: _concat(s, d, False),
        "fold_time_ordered_concat": lambda s, d: _concat(s, d, True),
        "fold_with_suffix": _suffix,
        "multi_source_reconcile": _reconcile,
    }
    out |= {f"fold_{n}_sum": _folded(n) for n in SPECS}
    return out | {f"join_{i}_{e}": _joined(i, e) for i in joins.INSERT for e in joins.EMIT}


def _sessions(events: DataFrame) -> DataFrame:
    return sessions.sessionize(events, HOUR / 6).select("idx", "stream", "session", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "n_events")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- SQL -----------------------------------------------------------------------------------------------------------

_E = """e AS (SELECT 'e' || event_id AS id, event_type AS stream, epoch_us(ts) / 1000.0 AS t, (event_id % 4) * 900000.0::DOUBLE AS d,
  (epoch_ms(ts) + (event_id * 7919) % 7200000) * 1000000 + event_id AS arrival FROM events)"""
_LIST = "[" + ", ".join(f"'{s}'" for s in STREAMS) + "]"


def _grid_sql(c: AlignConfig, body: str, source: str = "e") -> str:
    """m: (idx, id, stream) of each event and window; g: the dense grid."""
    o, w, h = c.origin_ms, c.window_ms, c.hop_ms
    start = f"({o}::DOUBLE + idx * {h}::DOUBLE)"
    inside = f"(CASE WHEN d = 0 THEN {start} <= t ELSE {start} < t + d END) AND t < {start} + {w}::DOUBLE"
    return f"""WITH {_E if source == 'e' else source},
  x AS (SELECT *, CASE WHEN d = 0 THEN floor((t - {o}::DOUBLE) / {h}::DOUBLE) ELSE ceil((t + d - {o}::DOUBLE) / {h}::DOUBLE) - 1 END::BIGINT AS last_idx FROM {'e' if source == 'e' else 'live'}),
  far AS (SELECT *, unnest(generate_series(greatest(0, floor((t - {o}::DOUBLE - {w}::DOUBLE) / {h}::DOUBLE)::BIGINT), last_idx)) AS idx FROM x),
  m AS (SELECT DISTINCT idx, id, stream FROM far WHERE {inside}{' AND idx >= n' if source != 'e' else ''}),
  g AS (SELECT unnest(generate_series(0, (SELECT max(last_idx) FROM x))) AS idx)
{body}"""


def _windows_sql(c: AlignConfig, source: str = "e") -> str:
    required = "[" + ", ".join(f"'{s}'" for s in c.required_streams) + "]"
    body = f"""SELECT g.idx, {c.origin_ms}::DOUBLE + g.idx * {c.hop_ms}::DOUBLE AS start_ms, {c.origin_ms}::DOUBLE + g.idx * {c.hop_ms}::DOUBLE + {c.window_ms}::DOUBLE AS end_ms,
  count(m.id) AS n_events, len(list_filter({required}, lambda r: NOT list_contains(coalesce(list(m.stream), []), r))) = 0 AS complete,
  array_to_string(list_filter({required}, lambda r: NOT list_contains(coalesce(list(m.stream), []), r)), ',') AS missing,
  coalesce(string_agg(DISTINCT m.stream, ',' ORDER BY m.stream), '') AS modalities
FROM g LEFT JOIN m USING (idx) GROUP BY g.idx"""
    return _grid_sql(c, body, source)


def _gapped_sql() -> str:
    """Offline, an event is dropped if all of it lies before the first window that is open when it comes."""
    return _windows_sql(GAPPED, _replay_sources(GAPPED, "t, stream, id"))


def _replay_sources(c: AlignConfig, order: str) -> str:
    o, w, h, late = c.origin_ms, c.window_ms, c.hop_ms, c.allowed_lateness_ms
    marks = ", ".join(f"max(CASE WHEN stream = '{s}' THEN t END) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m{k}" for k, s in enumerate(c.required_streams))
    names = [f"m{k}" for k in range(len(c.required_streams))]
    known = " AND ".join(f"{n} IS NOT NULL" for n in names)
    n = f"CASE WHEN {known} THEN greatest(0, floor((least({', '.join(names)}) - {late}::DOUBLE - {o}::DOUBLE - {w}::DOUBLE) / {h}::DOUBLE)::BIGINT + 1) ELSE 0 END"
    return f"""{_E}, p AS (SELECT *, {marks} FROM e), q AS (SELECT *, {n} AS n FROM p),
  s AS (SELECT *, (CASE WHEN d = 0 THEN t < {o}::DOUBLE + n * {h}::DOUBLE ELSE t + d <= {o}::DOUBLE + n * {h}::DOUBLE END) AS obsolete, n > 0 AND t < {o}::DOUBLE + (n - 1) * {h}::DOUBLE + {w}::DOUBLE AS behind FROM q),
  live AS (SELECT * FROM s WHERE NOT (obsolete {'OR behind' if c.late_policy == 'drop' else ''}))"""


def _disposition_sql(policy: str) -> str:
    c = _late(policy)
    dropped = "s.obsolete OR s.behind" if policy == "drop" else "s.obsolete"
    body = f"""SELECT s.id, CASE WHEN {dropped} THEN 'dropped' WHEN count(m.idx) = 0 THEN 'unassigned' WHEN s.behind THEN 'late' ELSE 'ok' END AS disposition, count(m.idx) AS n_windows
FROM s LEFT JOIN m USING (id) GROUP BY s.id, s.obsolete, s.behind"""
    return _grid_sql(c, body, _replay_sources(c, "arrival"))


def _sessions_sql(duration: str) -> str:
    return f"""WITH {_E}, x AS (SELECT stream, id, t, t + {duration} AS f FROM e),
  b AS (SELECT *, max(f) OVER (PARTITION BY stream ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
  n AS (SELECT *, sum(CASE WHEN t - before > {HOUR / 6}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b),
  o AS (SELECT stream, session, min(t) AS a, max(f) AS z, count(*) AS n_events FROM n GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY stream, a) - 1)::BIGINT AS idx, stream, session, round(a, 3) AS start_ms, round(z, 3) AS end_ms, n_events FROM o"""


_ANCHORS = f"""a AS (SELECT r AS reference_ms, r - 250.0::DOUBLE - (r - {ORIGIN}::DOUBLE) * 0.0001::DOUBLE + event_id % 7 AS observed_ms
  FROM (SELECT (epoch_us(ts) // 1000)::DOUBLE AS r, event_id FROM events WHERE event_type = 'signup'))"""
_SLICED = f"""{_ANCHORS.replace("a AS (", "v AS (", 1)}, w AS (SELECT min(reference_ms) AS lo, max(reference_ms) AS hi FROM v),
  a AS (SELECT median(reference_ms) AS reference_ms, median(observed_ms) AS observed_ms FROM v, w
  GROUP BY CASE WHEN hi > lo THEN least(1023, floor((reference_ms - lo) * 1024 / (hi - lo))) ELSE 0 END)"""
_TAGGED = "t AS (SELECT event_id AS pos, event_type AS side, user_id || '-' || (date_diff('day', DATE '1970-01-01', ts::DATE) // 3) AS key, event_type || ':' || event_id AS value FROM events WHERE event_type IN ('click', 'view', 'purchase'))"
_R = "r AS (SELECT event_id AS pos, 0::BIGINT AS ordinal, user_id::VARCHAR AS key, round(value * 100)::BIGINT AS value FROM events)"


def _join_sql(insert: str, emit: str) -> str:
    if insert == "product":
        last = "k.pos" if emit == "running" else "NULL::BIGINT"
        base = "SELECT key, pos FROM t" if emit == "running" else "SELECT DISTINCT key, NULL::BIGINT AS pos FROM t"
        upto = lambda s: f" AND {s}.pos <= k.pos" if emit == "running" else ""
        joined = " ".join(f"LEFT JOIN (SELECT * FROM t WHERE side = '{s}') {s} ON {s}.key = k.key{upto(s)}" for s in SIDES)
        cells = ", ".join(f"{s}.pos IS NOT NULL AS {s}_present, {s}.value AS {s}_value" for s in SIDES)
        order = ", ".join(f"{s}.pos" for s in SIDES)
        return f"WITH {_TAGGED}, k AS ({base}) SELECT k.key, {last} AS pos, row_number() OVER (PARTITION BY k.key, k.pos ORDER BY {order}) - 1 AS ordinal, {cells} FROM k {joined}"
    if emit == "final":
        pick = "arg_min" if insert == "first" else "arg_max"
        cells = ", ".join(f"count(*) FILTER (side = '{s}') > 0 AS {s}_present, {pick}(value, pos) FILTER (side = '{s}') AS {s}_value" for s in SIDES)
        return f"WITH {_TAGGED} SELECT key, NULL::BIGINT AS pos, 0::BIGINT AS ordinal, {cells} FROM t GROUP BY key"
    cell = lambda s: f"{insert}_value(CASE WHEN side = '{s}' THEN value END IGNORE NULLS) OVER w"
    cells = ", ".join(f"{cell(s)} IS NOT NULL AS {s}_present, {cell(s)} AS {s}_value" for s in SIDES)
    return f"WITH {_TAGGED} SELECT key, pos, 0::BIGINT AS ordinal, {cells} FROM t WINDOW w AS (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def _complete_sql(insert: str) -> str:
    """A key's arrivals in turn, a list of values per side; once no list is empty their product comes out and the key starts anew."""
    arrived = {"product": "list_append({0}, n.value)", "last": "[n.value]", "first": "CASE WHEN len({0}) > 0 THEN {0} ELSE [n.value] END"}[insert]
    full = " AND ".join(f"len(r.{s}) > 0" for s in SIDES)
    held = {s: f"(CASE WHEN {full} THEN []::VARCHAR[] ELSE r.{s} END)" for s in SIDES}
    start = ", ".join(f"CASE WHEN side = '{s}' THEN [value] ELSE []::VARCHAR[] END AS {s}" for s in SIDES)
    step = ", ".join(f"CASE WHEN n.side = '{s}' THEN {arrived.format(held[s])} ELSE {held[s]} END" for s in SIDES)
    cells, width = [], "1"
    for s in reversed(SIDES):
        cells.append(f"true AS {s}_present, {s}[ordinal // ({width}) % len({s}) + 1] AS {s}_value")
        width += f" * len({s})"
    return f"""WITH RECURSIVE {_TAGGED}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM t),
  r AS (SELECT key, pos, n, {start} FROM n WHERE n = 1 UNION ALL SELECT n.key, n.pos, n.n, {step} FROM r JOIN n ON n.key = r.key AND n.n = r.n + 1)
SELECT key, pos, ordinal, {", ".join(cells)} FROM (SELECT *, unnest(range({width})) AS ordinal FROM r WHERE {full})"""


def _members_sql(name: str) -> str:
    s = SPECS[name]
    div = lambda x: f"floor(({x})::DOUBLE / {s.hop})::BIGINT"
    return f"""c AS (SELECT event_id * 2 AS pos, 'process' AS op, epoch_ms(ts) - (event_id * 7919) % 7200000 AS tick, user_id::VARCHAR AS key, round(value * 100)::BIGINT AS value, event_type FROM events
    UNION ALL SELECT event_id * 2 + 1, 'watermark', epoch_ms(ts) - 3600000, NULL, NULL, NULL FROM events WHERE event_id % 50 = 0),
  k AS (SELECT *, max(CASE WHEN op = 'watermark' THEN tick END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS mark FROM c),
  f AS (SELECT *, coalesce(tick < mark, false) AS late, {div(f'tick - {s.origin} - {s.width}')} + 1 AS lo, {div(f'tick - {s.origin}')} AS hi FROM k WHERE op = 'process'),
  m AS (SELECT *, unnest(generate_series(lo, hi)) AS idx FROM f WHERE NOT late AND lo <= hi),
  z AS (SELECT max(tick) AS last_mark FROM c WHERE op = 'watermark')"""


def _fold_sql(name: str, columns: str) -> str:
    s = SPECS[name]
    return f"""WITH {_members_sql(name)}
SELECT key, idx, {s.origin}::BIGINT + idx * {s.hop} AS start, {s.origin}::BIGINT + idx * {s.hop} + {s.width} AS "end", {columns}
FROM m, z WHERE {s.origin}::BIGINT + idx * {s.hop} + {s.width} <= last_mark GROUP BY key, idx"""


def oracle_sql() -> dict[str, str]:
    sums = "'ms' AS tick_unit, count(*) AS input_count, sum(value)::BIGINT AS total, min(value) AS least, max(value) AS most"
    concat = lambda order: _fold_sql("tumbling", f"count(*) AS input_count, string_agg(event_type, '|' ORDER BY {order}) AS value")
    offsets = " ".join(f"WHEN stream = '{s}' THEN {v}::DOUBLE" for s, v in OFFSETS.items())
    residual = "abs(reference_ms - observed_ms - offset_ms)"
    pairs = "b AS (SELECT *, row_number() OVER (ORDER BY observed_ms, reference_ms) AS i, reference_ms - observed_ms AS dd FROM a), s AS (SELECT (y.dd - x.dd) / (y.observed_ms - x.observed_ms) * 1000000.0 AS ppm FROM b x JOIN b y ON x.i < y.i AND x.observed_ms <> y.observed_ms), r AS (SELECT median(ppm) AS rate_ppm, count(*) AS usable_pairs FROM s), p AS (SELECT median(observed_ms) AS epoch_ms, count(*) AS anchors FROM a), x AS (SELECT *, dd - rate_ppm * 0.000001::DOUBLE * (observed_ms - epoch_ms) AS ee FROM b, r, p), o AS (SELECT median(ee) AS offset_ms FROM x)"
    band = f"""SELECT l.id AS left_id, r.id AS right_id, round(abs(l.t - r.t), 3) AS delta_ms{{}} FROM (SELECT DISTINCT id, t FROM e JOIN m USING (id) WHERE e.stream = 'purchase') l
  JOIN (SELECT DISTINCT id, t FROM e JOIN m USING (id) WHERE e.stream = 'signup') r ON abs(l.t - r.t) <= {HOUR / 2}"""
    common = ", coalesce((SELECT string_agg(u.idx, ',' ORDER BY u.idx) FROM m u JOIN m v USING (idx) WHERE u.id = l.id AND v.id = r.id), '') AS window_indexes"
    out = {
        "align_tumbling": _windows_sql(TUMBLING),
        "align_sliding": _windows_sql(SLIDING),
        "align_gapped": _gapped_sql(),
        "align_members": _grid_sql(SLIDING, "SELECT idx, id FROM m"),
        "align_replay_drop_disposition": _disposition_sql("drop"),
        "align_replay_accept_disposition": _disposition_sql("accept"),
        "align_replay_windows": _windows_sql(_late("drop"), _replay_sources(_late("drop"), "arrival")),
        "cadence_gaps": f"""WITH {_E}, g AS (SELECT stream, t, lag(t) OVER (PARTITION BY stream ORDER BY t, id) AS p FROM e)
SELECT stream, round(p + {4 * HOUR / 10}::DOUBLE, 3) AS start_ms, round(t, 3) AS end_ms, {4 * HOUR / 10}::DOUBLE AS expected_ms, round(t - p, 3) AS observed_ms FROM g WHERE t - p > {4 * HOUR / 10}::DOUBLE * 1.6::DOUBLE""",
        "sessions": _sessions_sql("1000.0::DOUBLE"),
        "sessions_with_duration": _sessions_sql("(d + 1000.0::DOUBLE)"),
        "partition_events": "SELECT 'e' || event_id AS id, (('0x' || substr(sha256('e' || event_id), 1, 16))::UBIGINT % 7)::INTEGER AS partition_id FROM events",
        "clock_normalise": f"WITH {_E} SELECT id, floor(t + CASE {offsets} WHEN stream = 'error' THEN 120.0::DOUBLE + 250.0::DOUBLE * 0.000001::DOUBLE * (t - {ORIGIN}::DOUBLE) ELSE 0 END)::BIGINT AS t FROM e",
        **dict.fromkeys(("offset_fit", "offset_fit_every"), f"WITH {_ANCHORS}, o AS (SELECT median(reference_ms - observed_ms) AS offset_ms FROM a) SELECT round(offset_ms, 2) AS offset_ms, round(median({residual}), 2) AS mad_ms, round(max({residual}), 2) AS max_residual_ms, count(*) AS anchors FROM a, o GROUP BY offset_ms"),
        **dict.fromkeys(("drift_fit", "drift_fit_every"), f"WITH {_SLICED}, {pairs} SELECT round(rate_ppm, 2) AS rate_ppm, round(epoch_ms, 2) AS epoch_ms, round(offset_ms, 2) AS offset_ms, anchors, usable_pairs, round(median(abs(ee - offset_ms)), 2) AS mad_ms, round(max(abs(ee - offset_ms)), 2) AS max_residual_ms FROM x, o GROUP BY ALL"),
        "band_join": _grid_sql(SLIDING, band.format("")),
        "band_join_with_windows": _grid_sql(SLIDING, band.format(common)),
        "flow_map_filter": f"WITH {_R} SELECT pos, ordinal, key, value * 3 + 1 AS value FROM r WHERE (value * 3 + 1) % 2 = 0",
        "flow_flat_map": f"WITH {_R} SELECT pos, 0::BIGINT AS ordinal, key, value FROM r UNION ALL SELECT pos, 1, key, value // 2 FROM r WHERE value > 5000",
        "flow_branch_merge": f"WITH {_R} SELECT pos, 0::BIGINT AS ordinal, key, CASE WHEN value >= 5000 THEN value + 1 ELSE -value END AS value FROM r UNION ALL SELECT pos, 1, key, 7 FROM r WHERE value >= 5000",
        "flow_key_by": f"WITH {_R} SELECT pos, ordinal, 'v' || (value % 10) AS key, value FROM r",
        "flow_running_total": f"WITH {_R} SELECT *, sum(value) OVER w::BIGINT AS total, count(*) OVER w AS seen FROM r WINDOW w AS (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING)",
        "flow_stateful_map": f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS i, sum(value) OVER (PARTITION BY key ORDER BY pos ROWS 2 PRECEDING)::BIGINT AS three FROM r) SELECT pos, ordinal, key, three AS value FROM n WHERE i % 3 = 0",
        "flow_stateful_expand": f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM r) SELECT pos, k::BIGINT AS ordinal, key, (i * 10 + k)::BIGINT AS value FROM n, (SELECT unnest([0, 1]) AS k) WHERE k < i % 3",
        "fold_late_counters": f"WITH {_members_sql('gapped')} SELECT count(*) AS processed, count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND lo > hi) AS gap, coalesce(sum(hi - lo + 1) FILTER (NOT late AND lo <= hi), 0)::BIGINT AS memberships FROM f",
        "fold_ordered_concat": concat("pos"),
        "fold_time_ordered_concat": concat("tick, pos"),
        "fold_with_suffix": f"WITH w AS ({_fold_sql('tumbling', 'sum(value)::BIGINT AS value')}) SELECT idx AS pos, key, value, sum(value) OVER (PARTITION BY key ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS running_total FROM w WHERE value > 100",
        "multi_source_reconcile": "WITH l AS (SELECT l_orderkey AS k, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS v FROM orders) SELECT coalesce(o.k, l.k)::VARCHAR AS key, o.k IS NOT NULL AS order_present, o.v AS order_value, l.k IS NOT NULL AS lines_present, l.v AS lines_value FROM o FULL JOIN l ON o.k = l.k",
    }
    from spanweave import catalog_control

    out |= catalog_control.oracle_sql()
    out["graph_branches"] = f"""WITH {_R}, h AS (SELECT pos, key, value * 2 AS value FROM r WHERE value >= 5000)
SELECT 'apart' AS terminal, 1 AS rank, pos, 0::BIGINT AS ordinal, NULL AS key, value::VARCHAR AS value FROM h
UNION ALL SELECT 'all', 0, pos, 0, key, value::VARCHAR FROM h UNION ALL SELECT 'all', 0, pos, 1, key, (value - 1)::VARCHAR FROM h
UNION ALL SELECT 'all', 0, pos, 0, 'low' || (value % 3), value::VARCHAR FROM r WHERE value < 5000"""
    out["graph_window_suffix"] = "SELECT idx AS pos, key, total AS value FROM (" + _fold_sql("sliding", "sum(value)::BIGINT::VARCHAR AS total").replace("WHERE op = 'process')", "WHERE op = 'process' AND value % 2 = 0)") + ")"
    out["stream_running_total"] = f"WITH {_R} SELECT pos, key, value, sum(value) OVER w::BIGINT AS total, count(*) OVER w AS seen FROM r WINDOW w AS (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    out["journal_page"] = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' QUALIFY seq BETWEEN 10 AND 1009"
    out["json_lines_round_trip"] = f"WITH {_E} SELECT row_number() OVER (ORDER BY t) - 1 AS arrival_pos, id, stream, round(t, 3) AS timestamp_ms, d AS duration_ms FROM e"
    out |= {f"fold_{n}_sum": _fold_sql(n, sums) for n in SPECS}
    out |= {f"join_{i}_complete": _complete_sql(i) for i in joins.INSERT}
    return out | {f"join_{i}_{e}": _join_sql(i, e) for i in joins.INSERT for e in ("final", "running")}
