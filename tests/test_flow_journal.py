"""Flow graphs, readers and stateful processors."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from spanweave import cli
from spanweave.functions.values import canonical_json
from spanweave.operators import folds, joins, steps
from spanweave.plans.flow import Edge, Graph, Node, linear
from spanweave.schema import AlignConfig, LateEventError, ValidationError
from spanweave.sources import jsonl
from spanweave.streaming import processors as P
from spanweave.streaming.runner import run_batches


def records(spark, rows):
    return spark.createDataFrame(rows, "pos long, key string, value long")


def test_branch_merge_and_order(spark):
    v = F.col("value")
    g = Graph(
        "g", "1",
        (Node("in", "entry"), Node("odd", "branch", v % 2 == 1), Node("ten", "map", v * 10), Node("all", "merge"), Node("twice", "flat_map", F.array(v, v + 1)), Node("side", "drop_key")),
        (Edge("in", "odd"), Edge("odd", "ten", True), Edge("odd", "all", False), Edge("ten", "all"), Edge("all", "twice"), Edge("ten", "side")),
    )
    out = g.run({"in": records(spark, [(0, "a", 1), (1, None, 2), (2, "b", 3)])})
    assert sorted(map(tuple, out["twice"].collect())) == [(0, 0, "a", 10), (0, 1, "a", 11), (1, 0, None, 2), (1, 1, None, 3), (2, 0, "b", 30), (2, 1, "b", 31)]
    assert [tuple(r) for r in out["side"].orderBy("pos").collect()] == [(0, 0, None, 10), (2, 0, None, 30)]
    assert g.terminals == ["twice", "side"] and g.identity == Graph("g", "1", g.nodes, g.edges).identity != Graph("g", "2", g.nodes, g.edges).identity
    assert g.outputs({"in": records(spark, [(0, "a", 1)])}).count() == 3


def test_graph_rules():
    a, m = Node("a", "entry"), Node("m", "map")
    for nodes, edges in (((a, a), ()), ((a, m), ()), ((a, Node("b", "branch")), (Edge("a", "b"),)), ((m, Node("n", "map")), (Edge("m", "n"), Edge("n", "m"))), ((a, m), (Edge("a", "m"), Edge("a", "x")))):
        with pytest.raises(ValidationError):
            Graph("g", "1", nodes, edges)


def test_null_predicates_and_bad_keys_fail(spark):
    df = steps.records(records(spark, [(0, "a", None)]))
    with pytest.raises(Exception, match="predicate is null"):
        steps.filter_records(df, F.col("value") > 0, "f").collect()
    with pytest.raises(Exception, match="canonical key"):
        steps.key_by(df, F.lit(" a")).collect()
    with pytest.raises(Exception, match="boom"):
        steps.stateful_map(df, dict, lambda v, s: 1 / 0, "boom", "long").collect()


def test_join_node_and_window_node(spark):
    g = Graph("j", "1", (Node("o", "entry"), Node("p", "entry"), Node("j", "join", {"sides": ["o", "p"], "insert": "product", "emit": "final"})), (Edge("o", "j", side="o"), Edge("p", "j", side="p")))
    rows = g.run({"o": records(spark, [(0, "a", 1), (1, "b", 2)]), "p": records(spark, [(0, "a", 5), (1, "a", 6)])})["j"].collect()
    assert sorted((r.key, r.ordinal, json.loads(r.value)["values"]) for r in rows) == [("a", 0, ["1", "5"]), ("a", 1, ["1", "6"]), ("b", 0, ["2", None])]
    control = spark.createDataFrame([(9, "finish", None)], "pos long, op string, timestamp long")
    spec = folds.FoldWindow(10)
    w = linear("w", "1", [Node("w", "window", {"spec": spec, "aggregates": {"n": F.count(F.lit(1))}, "control": control}), Node("k", "map", F.get_json_object("value", "$.n"))])
    data = spark.createDataFrame([(0, "a", '{"timestamp": 3}'), (1, "a", '{"timestamp": 7}'), (2, "a", '{"timestamp": -1}')], "pos long, key string, value string")
    assert sorted((r.pos, r.value) for r in w.run({"input": data})["k"].collect()) == [(-1, "1"), (0, "2")]


def test_late_folds(spark):
    rows = [(0, "process", 5, "a", 1), (1, "watermark", 10, None, None), (2, "process", 10, "a", 2), (3, "process", 9, "a", 4), (4, "finish", None, None, None)]
    control = spark.createDataFrame(rows, "pos long, op string, timestamp long, key string, value long")
    with pytest.raises(LateEventError):
        folds.members(control, folds.FoldWindow(10), check=True)
    out = folds.fold(control, folds.FoldWindow(10, late_policy="drop"), {"s": F.sum("value")})
    assert sorted((r.idx, r.s) for r in out.collect()) == [(0, 1), (1, 2)]
    assert folds.counters(control, folds.FoldWindow(10)).first().late == 1
    with pytest.raises(Exception, match="below the watermark"):
        folds.fold(control, folds.FoldWindow(10), {"s": F.sum("value")}).collect()


def test_controls_that_go_back(spark):
    schema = "pos long, op string, timestamp long, key string, value long"
    rows = [(0, "process", 5, "a", 1), (1, "watermark", 10, None, None), (200_000, "watermark", 9, None, None)]
    total = {"s": F.sum("value")}
    with pytest.raises(Exception, match="goes back to 9"):
        folds.fold(spark.createDataFrame(rows, schema), folds.FoldWindow(10), total).collect()
    rows = [(0, "process", 5, "a", 1), (1, "finish", None, None, None), (2, "process", 6, "a", 1)]
    with pytest.raises(Exception, match="position 2 follows the finish"):
        folds.fold(spark.createDataFrame(rows, schema), folds.FoldWindow(10), total).collect()
    rows = [(0, "process", 5, "a", 1), (1, "watermark", 7, None, None), (2, "watermark", 7, None, None), (3, "finish", None, None, None), (4, "finish", None, None, None)]
    assert [r.s for r in folds.fold(spark.createDataFrame(rows, schema), folds.FoldWindow(10), total).collect()] == [1]


def test_streams_restart_and_equal_batch(spark):
    rows = [(i, f"k{i % 3}", i * 7 % 11) for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, key string, value long")
    pos = F.col("pos")
    got = run_batches(df, [pos < 25, (pos >= 25) & (pos < 40), pos >= 40], lambda s: P.stateful(s, P.RunningTotal()))
    want = steps.running(steps.records(df), total=F.sum("value"), seen=F.count(F.lit(1)))
    assert sorted((r.pos, r.total, r.seen) for r in got.collect()) == sorted((r.pos, r.total, r.seen) for r in want.collect())


def test_processors_in_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    rows = [(0, "a", "x", "1"), (1, "a", "y", "2"), (2, "a", "y", "3"), (3, "a", "x", "4"), (4, "b", "x", "5")]
    out = P.stateful(spark.createDataFrame(rows, "pos long, key string, side string, value string"), P.KeyedJoin(["x", "y"])).collect()
    assert sorted((r.pos, r.x_value, r.y_value) for r in out) == [(1, "1", "2"), (3, "4", "3")]
    ctl = [(0, "a", "process", 5, 1), (1, "a", "watermark", 10, None), (2, "a", "process", 9, 9), (3, "a", "process", 12, 2), (4, "a", "finish", None, None)]
    out = P.stateful(spark.createDataFrame(ctl, "pos long, key string, op string, timestamp long, value long"), P.WindowSum(10, 10, 0)).collect()
    assert sorted((r.idx, r.input_count, r.total) for r in out) == [(0, 1, 1), (1, 1, 2)]


@pytest.mark.parametrize("op, tick", [("process", 30), ("watermark", 5)])
def test_window_sum_refuses(spark, op, tick):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    rows = [(0, "a", "drain", None, None), (1, "a", "watermark", 10, None), (2, "a", "finish" if op == "process" else "drain", None, None), (3, "a", op, tick, 1)]
    with pytest.raises(Exception, match="after the finish|goes back"):
        P.stateful(spark.createDataFrame(rows, "pos long, key string, op string, timestamp long, value long"), P.WindowSum(10, 10, 0)).collect()


def test_streamed_joins_equal_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    schema, sides = "pos long, key string, side string, value string", ["x", "y", "z"]
    rows = [(i, f"k{i * i % 3}", "xyzu"[i * 7 % 11 % 4], None if i % 5 == 0 else str(i)) for i in range(30)]
    want = lambda insert, emit: sorted(map(str, ((r.pos, r.key, r.ordinal, *(r[f"{s}_{p}"] for s in sides for p in ("present", "value"))) for r in joins.keyed_join(spark.createDataFrame(rows, schema), sides, insert, emit).collect())))
    for insert, emit in (("first", "running"), ("last", "running"), ("product", "complete")):
        out = P.stateful(spark.createDataFrame(rows, schema), P.KeyedJoin(sides, insert, emit))
        assert sorted(map(str, map(tuple, out.collect()))) == want(insert, emit)
    base = tempfile.mkdtemp()
    for part in (rows[:13], rows[13:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = P.stateful(spark.readStream.schema(schema).parquet(f"{base}/in"), P.KeyedJoin(sides, "product", "running"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    assert sorted(map(str, map(tuple, spark.read.parquet(f"{base}/out").collect()))) == want("product", "running")


def test_strict_readers(spark):
    base = tempfile.mkdtemp()

    def write(name, *lines):
        with open(f"{base}/{name}", "w") as f:
            f.write("\n".join(lines))
        return f"{base}/{name}"

    good = [json.dumps({"id": f"e{i}", "stream": " s ", "modality": "m", "timestamp_ms": i, "data": {"b": 1.0, "a": i}}) for i in range(3)]
    rows = jsonl.load_events(spark, write("a", good[0], "", *good[1:])).orderBy("arrival_pos").collect()
    assert [r.id for r in rows] == ["e0", "e1", "e2"] and rows[0].stream == "s" and rows[2].data == '{"a":2,"b":1.0}'
    for bad in ('{"id":"x","id":"y"}', '{"id":"x","stream":"s","modality":"m","timestamp_ms":NaN}', '{"id":"x","stream":"s","modality":"m","timestamp_ms":1,"more":1}', good[0]):
        with pytest.raises(ValidationError, match="line 4|line 2"):
            jsonl.load_events(spark, write("b", *good, bad))
    ce = {"specversion": "1.0", "id": "1 *~", "source": "/a%20b", "type": "t", "time": "2024-01-01T00:00:00.250+01:00", "durationms": 5, "data": [1]}
    row = jsonl.load_cloudevents(spark, write("c", json.dumps(ce))).first()
    assert row.id == "ce:%2Fa%2520b:1%20%2A~" and row.stream == "/a%20b" and row.timestamp_ms == 1704063600250.0 and row.duration_ms == 5
    for change in ({"time": "2024-01-01T00:00:00.2501Z"}, {"data_base64": "eA=="}, {"Bad-Name": 1}, {"specversion": "0.3"}):
        assert jsonl.load_cloudevents(spark, write("d", json.dumps(ce | change)), strict=False).first().error
    assert jsonl.load_records(spark, write("e", '{"key":null,"value":{"b":[],"a":"é"}}')).first().value == '{"a":"é","b":[]}'
    assert spark.createDataFrame([('{"b": 1, "a": [1.0, "\\u00e9"]}',)], "v string").select(canonical_json(F.col("v"))).first()[0] == '{"a":[1.0,"é"],"b":1}'


def test_command_line(spark, capsys, monkeypatch):
    base = tempfile.mkdtemp()
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    with open(f"{base}/e", "w") as f:
        f.write("\n".join(json.dumps({"id": f"e{i}", "stream": "ab"[i % 2], "modality": "m", "timestamp_ms": i * 10.0}) for i in range(40)))
    with open(f"{base}/c", "w") as f:
        json.dump({"window_ms": 100, "required_streams": ["a", "b"]}, f)
    assert cli.main(["align", "--config", f"{base}/c", "--events", f"{base}/e", "--output", f"{base}/out"]) == 0
    assert json.loads(capsys.readouterr().out)["windows"] == 4
    assert spark.read.parquet(f"{base}/out/windows").count() == 4
    assert cli.main(["join", "--config", f"{base}/c", "--events", f"{base}/e", "--output", f"{base}/join", "--left", "a", "--right", "b", "--tolerance", "10"]) == 0
    assert spark.read.json(f"{base}/join").count() == 39
    with open(f"{base}/e", "a") as f:
        f.write("\n{}")
    assert cli.main(["validate", "--config", f"{base}/c", "--events", f"{base}/e"]) == 2


def test_report_is_escaped_and_bounded(spark):
    from spanweave import report
    from spanweave.operators import align as A
    from spanweave.schema import LimitError

    a = A.align(jsonl.generate_round_robin(spark, 30, 1), AlignConfig(10.0, required_streams=("<b>",), late_policy="drop"))
    assert "&lt;b&gt;" in report.render_html(a) and "<b>" not in report.render_html(a)
    with pytest.raises(LimitError):
        report.render_html(a, most=3)
