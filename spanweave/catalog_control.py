"""Registered queries of control: streams, closings, drains, budgets, Python folds and pages; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave import catalog as C
from spanweave import report
from spanweave.functions.values import canonical_json
from spanweave.operators import align as A
from spanweave.operators import drains, folds, joins, steps
from spanweave.plans import budgets
from spanweave.plans.flow import Edge, Graph, Node, linear
from spanweave.plans.pages import Pages
from spanweave.session import shared_dir
from spanweave.sources import jsonl
from spanweave.streaming import processors
from spanweave.streaming.aligner import align_stream
from spanweave.streaming.runner import run_batches, sharded, streamed_join
from spanweave.streaming.windows import StreamWindow

GROUPS, SHARDS = 3, 8
LIMITS = drains.DrainLimits(50, 20_000, 20_000, 1 << 20)
SPEC = C.SPECS["tumbling"]


def _last_id(spark: SparkSession, d: str) -> int:
    return C._table(spark, d, "events").agg(F.max("event_id")).first()[0]


def _stream_align(spark: SparkSession, d: str) -> DataFrame:
    """Events of three alignment groups through the streaming aligner in two micro-batches, the second with the flush."""
    number = F.substring("id", 2, 30).cast("long")
    e = C._events(spark, d).withColumn("key", F.concat(F.lit("g"), number % GROUPS)).withColumn("op", F.lit("event")).withColumnRenamed("arrival_pos", "pos")
    ends = e.select("key").distinct().select("key", F.lit("flush").alias("op"), F.lit(1 << 62).cast("long").alias("pos"))
    half = (C.ORIGIN + 15 * 24 * C.HOUR) * 10**6
    rows = e.unionByName(ends, allowMissingColumns=True)
    out = run_batches(rows, [F.col("pos") < half, F.col("pos") >= half], lambda s: align_stream(s, C._late("drop")))
    return out.withColumnRenamed("missing_streams", "missing")


def _closings(spark: SparkSession, d: str) -> DataFrame:
    """Tagged events whose sides close at 60, 80 and 100 % of the input; a closed side's source has ended, so it sends no more."""
    last = C._table(spark, d, "events").agg(F.max("event_id").alias("_last"))
    end = F.element_at(F.create_map(*[x for s, part in zip(C.SIDES, (6, 8, 10), strict=True) for x in (F.lit(s), F.lit(part))]), F.col("side"))
    at = F.call_function("div", F.col("_last") * end, F.lit(10).cast("long"))
    data = C._tagged(spark, d).where(F.col("side").isin(C.SIDES)).crossJoin(F.broadcast(last)).where(F.col("pos") <= at)  # one row
    ends = last.withColumn("side", F.explode(F.array(*map(F.lit, C.SIDES)))).select(at.alias("pos"), F.lit("eof").alias("op"), "side")
    return data.drop("_last").withColumn("op", F.lit("data")).unionByName(ends, allowMissingColumns=True)


def _drained_join(spark: SparkSession, d: str) -> DataFrame:
    return drains.drain_final(_closings(spark, d), C.SIDES, "product", LIMITS).drop("pos")


def _with_drains(spark: SparkSession, d: str) -> DataFrame:
    """The control rows, and a drain after every second watermark: of at most 40 windows, then of all."""
    control = C._control(spark, d).drop("event_type").withColumn("pos", F.col("pos") * 2)
    e = C._table(spark, d, "events").where("event_id % 100 = 0")
    cap = F.when(F.col("event_id") % 200 != 0, F.lit(40).cast("long"))
    return control.unionByName(e.select((F.col("event_id") * 4 + 3).alias("pos"), F.lit("drain").alias("op"), cap.alias("timestamp")), allowMissingColumns=True)


def _drained(spark: SparkSession, d: str) -> DataFrame:
    control = _with_drains(spark, d)
    cells = folds.all_cells(control, SPEC, {"total": F.sum("value")})
    return folds.drain(cells, control, SPEC, strict=False)


def _drain_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Drained windows under new keys, with a running total per key in the order in which they were put out."""
    rows = _drained(spark, d).select(F.col("place").alias("pos"), F.lit(0).cast("long").alias("ordinal"), "key", F.col("total").alias("value"), "epoch")
    keyed = steps.key_by(rows, F.substring("key", -1, 1))
    return steps.running(keyed, running_total=("sum", F.col("value"))).drop("ordinal")


def _drain_graph(spark: SparkSession, d: str) -> DataFrame:
    """A graph of an even-valued prefix, a drained window and a suffix that changes keys and then counts in Python what has passed."""
    c = _with_drains(spark, d)
    data = c.where("op = 'process'").select("pos", "key", "value", "timestamp", F.lit(0).cast("long").alias("ordinal"))
    window = {"spec": SPEC, "aggregates": {"total": F.sum("value")}, "control": c.where("op <> 'process'").select("pos", "op", "timestamp"), "drains": True}

    def passed(value, state):
        return state + 1, f"{state + 1}:{value}", True, True

    total, epoch = F.get_json_object("value", "$.total"), F.get_json_object("value", "$.epoch")
    nodes = [Node("even", "filter", F.col("value") % 2 == 0), Node("window", "window", window), Node("last", "key_by", F.substring("key", -1, 1)), Node("text", "map", F.concat_ws("@", total, epoch)), Node("count", "stateful_map", (int, passed))]
    return linear("drains", "1", nodes).outputs({"input": data}).select("pos", "key", "value")


def _algebra(spark: SparkSession, d: str) -> DataFrame:
    control = _with_drains(spark, d)
    cells = folds.all_cells(control, SPEC, {"total": F.sum("value")})
    return folds.counter_algebra(cells, folds.drain(cells, control, SPEC, strict=False), control, SPEC)


def _python_span(spark: SparkSession, d: str) -> DataFrame:
    """A Python fold per window in order of time: the first and the last type of event, and how many there are."""
    control = C._control(spark, d).drop("value").withColumnRenamed("event_type", "value")
    out = folds.fold_python(control, SPEC, list, lambda a, x: [a[0], x, a[2] + 1] if a else [x, x, 1], lambda a: f"{a[0]}>{a[1]}:{a[2]}", by_time=True)
    return out.select("key", "idx", "start", "end", "input_count", "value")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """Each record becomes its halves, quarters and so on, as many as its value modulo 4, from a generator."""

    def halves(value):
        for _ in range(value % 4):
            yield value
            value //= 2

    return steps.flat_map_udtf(C._records(spark, d), halves, 3, value_type="long")


def _stream_fold(spark: SparkSession, d: str, ordered: bool) -> DataFrame:
    """A fold as a stream of two micro-batches, on eight shards; a drain follows every watermark. The ordered one gets no late
    arrivals, which it would reject; the other drops them."""
    control = folds.with_watermark(C._control(spark, d))
    if ordered:
        control = control.where("op <> 'process' OR watermark IS NULL OR timestamp >= watermark")
    rows = control.select((F.col("pos") * 2).alias("pos"), "op", "timestamp", "key", F.col("event_type").alias("value"))
    after = rows.where("op = 'watermark'").select((F.col("pos") + 1).alias("pos"), F.lit("drain").alias("op"))
    rows = sharded(rows.unionByName(after, allowMissingColumns=True), SHARDS)
    half = _last_id(spark, d) * 2
    fold = StreamWindow(SPEC, str, lambda a, x: f"{a}|{x}", lambda a: a[1:], 100_000, ordered)
    out = run_batches(rows, [F.col("pos") < half, F.col("pos") >= half], lambda s: processors.stateful(s, fold, "shard"))
    return out.drop("epoch")


def _stream_final(spark: SparkSession, d: str) -> DataFrame:
    tagged = C._tagged(spark, d).where(F.col("side").isin(C.SIDES))
    return streamed_join([_last_id(spark, d) // 2], SHARDS)(tagged, C.SIDES, "last", "final")


def _byte_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of orders, which its bytes end before its rows do."""
    pages = Pages(spark, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", 4096)
    pages.append(C._table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    _, cursor = pages.read(pages.cursor(), 10)
    return pages.read(cursor, 5000, 30_000)[0].select("seq", "o_orderkey", "o_orderstatus")


def _cloud_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written as CloudEvents lines and read back by the strict reader."""
    path = f"{shared_dir(spark)}/cloudevents-{uuid.uuid4().hex}"
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    envelope = F.struct(F.lit("1.0").alias("specversion"), F.col("event_id").cast("string").alias("id"), F.lit("/events").alias("source"), F.col("event_type").alias("type"), time.alias("time"), (F.col("event_id") % 4 * 900).cast("int").alias("durationms"), F.from_json("props", "k int").alias("data"))
    C._table(spark, d, "events").select(F.to_json(envelope)).write.text(path)
    out = jsonl.load_cloudevents(spark, path)
    return out.select("id", "stream", "modality", "timestamp_ms", "duration_ms", F.get_json_object("data", "$.payload.k").cast("long").alias("k"))


def _join_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers as the two producers of a join node, whose rows become records."""
    o = C._table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    c = C._table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    join = Node("both", "join", {"sides": ["customer", "order"], "insert": "last", "emit": "final"})
    g = Graph("customers", "1", (Node("customers", "entry"), Node("orders", "entry"), join), (Edge("customers", "both", side="customer"), Edge("orders", "both", side="order")))
    return g.outputs({"customers": c, "orders": o}).select("pos", "key", "value")


def _finished(spark: SparkSession, d: str) -> DataFrame:
    """The fold of a finished input: windows that no watermark has reached are closed too."""
    control = C._control(spark, d)
    end = control.agg((F.max("pos") + 1).alias("pos")).withColumn("op", F.lit("finish"))
    return folds.fold(control.unionByName(end, allowMissingColumns=True), C.SPECS["sliding"], {"total": F.sum("value")})


def _window_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a result document, read back: each window's events, the first and the last of them."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    report.write_document(A.align(C._events(spark, d), C.GAPPED), path, most=1, timeline=1)
    events = F.col("events")
    return spark.read.json(f"{path}/window_lines", schema="idx long, events array<struct<id:string>>").select("idx", F.size(events).cast("long").alias("n"), F.element_at(events, 1)["id"].alias("first"), F.element_at(events, -1)["id"].alias("last"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_align_windows": _stream_align,
        "join_final_drain": _drained_join,
        "graph_charges": lambda s, d: budgets.work(budgets.charges(C._branched(), {"in": C._records(s, d)})),
        "graph_edge_deliveries": lambda s, d: budgets.deliveries(budgets.charges(C._branched(), {"in": C._records(s, d)})),
        "fold_drain_epochs": lambda s, d: _drained(s, d).select("key", "idx", "epoch", "place", "total"),
        "fold_drain_suffix": _drain_suffix,
        "fold_counter_algebra": _algebra,
        "graph_drained_suffix": _drain_graph,
        "fold_python_span": _python_span,
        "flow_generator": _generated,
        "stream_ordered_concat": lambda s, d: _stream_fold(s, d, True),
        "stream_fold_concat": lambda s, d: _stream_fold(s, d, False),
        "cloudevents_round_trip": _cloud_events,
        "graph_join_records": _join_records,
        "join_product_sizes": lambda s, d: joins.product_sizes(C._tagged(s, d).where(F.col("side").isin(C.SIDES)), C.SIDES).select("key", F.col("rows").cast("long").alias("rows")),
        "fold_finished": _finished,
        "canonical_json": lambda s, d: C._table(s, d, "events").select("event_id", canonical_json(F.concat(F.lit('{"z": 1.50, "a": '), F.col("props"), F.lit("}"))).alias("value")),
        "report_window_lines": _window_lines,
        "stream_join_final": _stream_final,
        "page_by_bytes": _byte_page,
    }


# -- SQL -------------------------------------------------------------------------------------------------------------


def _align_sql() -> str:
    one = C._windows_sql(C._late("drop"), C._replay_sources(C._late("drop"), "arrival"))
    return " UNION ALL ".join(f"SELECT 'g{g}' AS key, * FROM ({one.replace('FROM events)', f'FROM events WHERE event_id % {GROUPS} = {g})')})" for g in range(GROUPS))


def _drained_join_sql() -> str:
    """A key after the other joins the page before it, or opens a new one."""
    ends = " OR ".join(f"side = '{s}' AND pos <= (SELECT max(event_id) FROM events) * {part} // 10" for s, part in zip(C.SIDES, (6, 8, 10), strict=True))
    final = C._join_sql("product", "final").replace("WITH ", "", 1).replace("t AS (", "u AS (", 1)
    tagged, rest = final.split(", k AS (", 1)
    cells = " + ".join(f"strlen(coalesce({s}_value, ''))" for s in C.SIDES)
    fits = f"p.keys < {LIMITS.max_keys} AND p.n_rows + s.n_rows <= {LIMITS.max_rows_per_page} AND p.n_bytes + s.n_bytes <= {LIMITS.max_page_bytes}"
    columns = ", ".join(f"{s}_{x}" for s in C.SIDES for x in ("present", "value"))
    return f"""WITH RECURSIVE {tagged}, t AS (SELECT * FROM u WHERE {ends}), f AS (SELECT * FROM (WITH k AS ({rest})),
  s AS (SELECT key, count(*) AS n_rows, sum(strlen(key) + {cells}) AS n_bytes, row_number() OVER (ORDER BY key) AS n FROM f GROUP BY key),
  p AS (SELECT n, key, 0::BIGINT AS page, 1 AS keys, n_rows, n_bytes FROM s WHERE n = 1
    UNION ALL SELECT s.n, s.key, CASE WHEN {fits} THEN p.page ELSE p.page + 1 END, CASE WHEN {fits} THEN p.keys + 1 ELSE 1 END,
      CASE WHEN {fits} THEN p.n_rows + s.n_rows ELSE s.n_rows END, CASE WHEN {fits} THEN p.n_bytes + s.n_bytes ELSE s.n_bytes END FROM p JOIN s ON s.n = p.n + 1)
SELECT f.key, f.ordinal, {columns}, p.page FROM f JOIN p USING (key)"""


def _drains_sql(columns: str) -> str:
    """Drains one after another: each takes what is eligible and not yet taken, as far as it may."""
    return f"""WITH RECURSIVE {C._members_sql("tumbling")},
  w AS (SELECT key, idx, sum(value)::BIGINT AS total, count(*) AS input_count FROM m GROUP BY key, idx),
  i AS (SELECT idx, (SELECT min(pos) * 2 FROM c WHERE op = 'watermark' AND tick >= idx * {SPEC.hop} + {SPEC.width}) AS closer FROM (SELECT DISTINCT idx FROM w)),
  o AS (SELECT w.*, closer, row_number() OVER (ORDER BY idx, key) - 1 AS place FROM w JOIN i USING (idx) WHERE closer IS NOT NULL),
  d AS (SELECT event_id * 4 + 3 AS pos, CASE WHEN event_id % 200 = 0 THEN 1000000000 ELSE 40 END AS cap, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id % 100 = 0),
  q AS (SELECT d.*, (SELECT count(*) FROM o WHERE o.closer < d.pos) AS eligible FROM d),
  r AS (SELECT n, pos, least(eligible, cap) AS taken FROM q WHERE n = 1 UNION ALL SELECT q.n, q.pos, least(q.eligible, r.taken + q.cap) FROM r JOIN q ON q.n = r.n + 1),
  z2 AS (SELECT o.key, o.idx, o.place, o.total, o.input_count, min(r.pos) AS epoch FROM o JOIN r ON r.taken > o.place GROUP BY ALL)
{columns}"""


def oracle_sql() -> dict[str, str]:
    size = lambda x: f"strlen(({x})::VARCHAR)"
    edges = {("in", "high"): "count(*)", ("high", "double"): "count(*) FILTER (value >= 5000)", ("high", "low"): "count(*) FILTER (value < 5000)", ("double", "parts"): "count(*) FILTER (value >= 5000)", ("double", "apart"): "count(*) FILTER (value >= 5000)", ("parts", "all"): "2 * count(*) FILTER (value >= 5000)", ("low", "all"): "count(*) FILTER (value < 5000)"}
    span = "count(*) AS input_count, first(event_type ORDER BY tick, pos) || '>' || last(event_type ORDER BY tick, pos) || ':' || count(*) AS value"
    counted = "count(*) AS processed, count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND lo > hi) AS gap, coalesce(sum(hi - lo + 1) FILTER (NOT late AND lo <= hi), 0)::BIGINT AS memberships"
    return {
        "stream_align_windows": _align_sql(),
        "join_final_drain": _drained_join_sql(),
        "graph_charges": f"WITH {C._R} SELECT pos, CASE WHEN value >= 5000 THEN 14 ELSE 7 END::BIGINT AS work_records, CASE WHEN value >= 5000 THEN 4 * {size('value')} + 7 * {size('2 * value')} + 3 * {size('2 * value - 1')} ELSE 7 * {size('value')} END::BIGINT AS work_bytes FROM r",
        "graph_edge_deliveries": f"WITH {C._R} " + " UNION ALL ".join(f"SELECT '{a}' AS node, '{b}' AS target, ({n})::BIGINT AS deliveries FROM r" for (a, b), n in edges.items()),
        "fold_drain_epochs": _drains_sql("SELECT key, idx, epoch, place, total FROM z2"),
        "fold_drain_suffix": _drains_sql("SELECT place AS pos, right(key, 1) AS key, total AS value, epoch, sum(total) OVER (PARTITION BY right(key, 1) ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS running_total FROM z2"),
        "fold_counter_algebra": _drains_sql(f"""SELECT a.*, created, emitted, created - emitted AS retained, finalized AS finalized_memberships, every - finalized AS retained_memberships
FROM (SELECT {counted} FROM f) a, (SELECT count(*) AS created, sum(input_count)::BIGINT AS every FROM w), (SELECT count(*) AS emitted, coalesce(sum(input_count), 0)::BIGINT AS finalized FROM z2)"""),
        "graph_drained_suffix": _drains_sql("SELECT place AS pos, right(key, 1) AS key, row_number() OVER (PARTITION BY right(key, 1) ORDER BY place) || ':' || total || '@' || epoch AS value FROM z2").replace("WHERE op = 'process')", "WHERE op = 'process' AND value % 2 = 0)"),
        "fold_python_span": C._fold_sql("tumbling", span),
        "flow_generator": f"WITH {C._R} SELECT pos, k AS ordinal, key, value // (1 << k) AS value FROM (SELECT *, unnest(range(value % 4)) AS k FROM r)",
        "stream_ordered_concat": C._fold_sql("tumbling", "count(*) AS input_count, string_agg(event_type, '|' ORDER BY tick, pos) AS value"),
        "stream_fold_concat": C._fold_sql("tumbling", "count(*) AS input_count, string_agg(event_type, '|' ORDER BY pos) AS value"),
        "cloudevents_round_trip": "SELECT 'ce:%2Fevents:' || event_id AS id, '/events' AS stream, event_type AS modality, (epoch_us(ts) // 1000)::DOUBLE AS timestamp_ms, (event_id % 4 * 900)::DOUBLE AS duration_ms, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
        "graph_join_records": """WITH o AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT -1::BIGINT AS pos, coalesce(k, c_custkey)::VARCHAR AS key, '{"present":[' || (c_custkey IS NOT NULL) || ',' || (k IS NOT NULL) || '],"values":[' || coalesce('"' || c_mktsegment || '"', 'null') || ',' || coalesce('"' || v || '"', 'null') || ']}' AS value FROM customer FULL JOIN o ON k = c_custkey""",
        "join_product_sizes": f"WITH {C._TAGGED} SELECT key, (" + " * ".join(f"greatest(count(*) FILTER (side = '{s}'), 1)" for s in C.SIDES) + ")::BIGINT AS rows FROM t GROUP BY key",
        "fold_finished": C._fold_sql("sliding", "'ms' AS tick_unit, count(*) AS input_count, sum(value)::BIGINT AS total").rsplit("WHERE", 1)[0] + "GROUP BY key, idx",
        "canonical_json": """SELECT event_id, '{"a":' || replace(props, ': ', ':') || ',"z":1.5}' AS value FROM events""",
        "report_window_lines": C._grid_sql(C.GAPPED, "SELECT g.idx, count(m.id) AS n, first(m.id ORDER BY x.t, x.stream, x.id) AS first, last(m.id ORDER BY x.t, x.stream, x.id) AS last FROM g LEFT JOIN m USING (idx) LEFT JOIN x ON x.id = m.id GROUP BY g.idx", C._replay_sources(C.GAPPED, "t, stream, id")),
        "stream_join_final": C._join_sql("last", "final"),
        "page_by_bytes": """WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_orderkey, o_orderstatus, strlen('{"o_orderkey":,"o_orderstatus":""}') + strlen(o_orderkey::VARCHAR) + strlen(o_orderstatus) AS b FROM orders),
  p AS (SELECT *, sum(b) OVER (ORDER BY seq) AS upto FROM s WHERE seq >= 10) SELECT seq, o_orderkey, o_orderstatus FROM p WHERE upto <= 30000 AND seq < 5010""",
    }
