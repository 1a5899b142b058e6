"""Streaming ordered windows, final joins and graphs of joins against models and batch plans, for any batching."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import folds, joins
from spanweave.plans.flow import Edge, Graph, Node
from spanweave.schema import LateEventError, LimitError, ValidationError
from spanweave.streaming import processors as P
from spanweave.streaming.runner import run_batches, sharded, streamed_join
from spanweave.streaming.windows import StreamWindow
from tests.fake_state import run

COLUMNS = ["pos", "op", "timestamp", "key", "value"]


def arrivals(rng, n, spec):
    rows, mark = [], None
    put = lambda *x: rows.append((len(rows), *x))
    for _ in range(n):
        if rng.random() < 0.75:
            put("process", (mark if mark is not None else -8) + rng.randint(0, 14), rng.choice("abz"), rng.choice("uvwxy"))
        else:
            mark = (mark if mark is not None else -9) + rng.randint(0, 6)
            put("watermark", mark, None, None)
            put("drain", None, None, None)
    put("finish", None, None, None)
    put("drain", 2, None, None)
    put("drain", None, None, None)
    put("finish", None, None, None)
    return rows


def test_ordered_window_any_batching():
    rng = random.Random(5)
    for _ in range(150):
        spec = folds.FoldWindow(*rng.choice([(5, 5, 0), (7, 3, -2), (2, 5, 1)]))
        rows = arrivals(rng, rng.randint(0, 40), spec)
        cuts = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, 4) if len(rows) > 4 else 0))
        make = lambda spec=spec: StreamWindow(spec, list, lambda a, x: [*a, x], lambda a: ",".join(a))
        got = run(make, rows, COLUMNS, 0, cuts)
        want = {}
        for _, op, t, key, value in sorted((r for r in rows if r[1] == "process"), key=lambda r: (r[2], r[0])):
            for i in range((t - spec.origin - spec.width) // spec.hop + 1, (t - spec.origin) // spec.hop + 1):
                want.setdefault((key, i), []).append(value)
        assert {(r[0], r[1]): (r[4], r[5]) for r in got} == {k: (len(v), ",".join(v)) for k, v in want.items()}
        assert len(got) == len(want) and [r[6] for r in got] == sorted(r[6] for r in got)
        for epoch in {r[6] for r in got}:
            own = [(r[1], r[0]) for r in got if r[6] == epoch]
            assert own == sorted(own)


def test_arrival_order_any_batching():
    rng = random.Random(6)
    dropped = 0
    for _ in range(150):
        spec = folds.FoldWindow(*rng.choice([(5, 5, 0), (7, 3, -2), (2, 5, 1)]), late_policy=rng.choice(["drop", "reject"]))
        rows = [(p, op, t - rng.randint(0, 4) if op == "process" else t, k, v) for p, op, t, k, v in arrivals(rng, rng.randint(0, 40), spec)]
        cuts = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, 4) if len(rows) > 4 else 0))
        want, mark, late = {}, None, None
        for pos, op, t, key, value in rows:
            if op == "watermark":
                mark = t
            elif op == "process" and mark is not None and t < mark:
                late = pos if late is None else late
            elif op == "process":
                for i in range((t - spec.origin - spec.width) // spec.hop + 1, (t - spec.origin) // spec.hop + 1):
                    want.setdefault((key, i), []).append(value)
        make = lambda spec=spec: StreamWindow(spec, list, lambda a, x: [*a, x], lambda a: ",".join(a), ordered=False)
        if late is not None and spec.late_policy == "reject":
            with pytest.raises(LateEventError, match=f"arrival {late} "):
                run(make, rows, COLUMNS, 0, cuts)
            continue
        dropped += late is not None
        got = run(make, rows, COLUMNS, 0, cuts)
        assert sorted((r[0], r[1], r[5]) for r in got) == sorted((*k, ",".join(v)) for k, v in want.items())
    assert dropped > 20


def test_ordered_window_refusals():
    spec = folds.FoldWindow(5)
    make = lambda: StreamWindow(spec, int, lambda a, x: a + int(x), most_buffered=3)
    p, w = lambda pos, t: (pos, "process", t, "a", "1"), lambda pos, t: (pos, "watermark", t, None, None)
    drain, finish = (lambda pos: (pos, "drain", None, None, None)), (lambda pos: (pos, "finish", None, None, None))
    for rows, error, text in (
        ([w(0, 5), p(1, 4)], LateEventError, "arrival 1 at 4"),
        ([w(0, 5), w(1, 4)], ValidationError, "goes back from 5 to 4"),
        ([p(0, 1), p(1, 1), p(2, 1), p(3, 1)], LimitError, "more than 3 arrivals"),
        ([p(0, 1), w(1, 5), p(2, 6)], ValidationError, "process at position 2 while closed windows wait"),
        ([p(0, 1), w(1, 5), w(2, 6)], ValidationError, "watermark at position 2 while"),
        ([p(0, 1), p(1, 9), w(2, 5), finish(3)], ValidationError, "position 3: drain closed windows before the buffer"),
        ([p(0, 1), finish(1), drain(2), p(3, 9)], ValidationError, "process at position 3 after the finish"),
    ):
        for cuts in ([], [1], [1, 2]):
            with pytest.raises(error, match=text):
                run(make, rows, COLUMNS, 0, cuts)
    assert [r[5] for r in run(make, [p(0, 1), w(1, 5), finish(2), drain(3)], COLUMNS, 0, [2])] == ["1"]  # nothing is buffered
    with pytest.raises(Exception, match="fold of key 'a', idx 0: ValueError"):
        run(make, [(0, "process", 1, "a", "x"), w(1, 5)], COLUMNS, 0, [])


def test_final_join_any_batching(spark):
    rng = random.Random(7)
    sides, columns = ["x", "y", "z"], ["pos", "op", "side", "key", "value"]
    rows = [(p, "data", rng.choice("xyzq"), f"k{rng.randint(0, 9)}", rng.choice([None, "", "v", str(p)])) for p in range(60)]
    ends = [(100 + k, "eof", s, None, None) for k, s in enumerate("zxyx")]
    df = spark.createDataFrame([r for r in rows if r[2] in sides], "pos long, op string, side string, key string, value string")
    for insert in joins.INSERT:
        want = sorted(map(str, ((r.key, r.ordinal, *(r[f"{s}_{x}"] for s in sides for x in ("present", "value"))) for r in joins.keyed_join(df, sides, insert, "final").collect())))
        for cuts in ([], [20, 40], [60, 61, 62], list(range(1, 64))):
            got = run(lambda insert=insert: P.KeyedJoin(sides, insert, "final"), rows + ends, columns, 0, cuts)
            assert sorted(str(r[1:]) for r in got) == want
            assert [r[1] for r in got] == sorted(r[1] for r in got)
    make = lambda emit: lambda: P.KeyedJoin(sides, "last", emit)
    with pytest.raises(ValidationError, match="position 9 follows the end of side x"):
        run(make("final"), [(1, "eof", "x", None, None), (9, "data", "x", "k", "v")], columns, 0, [1])
    late = [(1, "data", "x", "k", "v"), *[(2, "eof", s, None, None) for s in sides]]
    assert run(make("complete"), late, columns, 0, [1]) == []  # an incomplete key is dropped with the last closing


def test_graph_of_two_joins_streams_as_in_batch(spark):
    """The second final join reads the first one's final rows, so it can close only after they have flowed."""
    final = {"insert": "last", "emit": "final"}
    v = F.col("value")
    g = Graph(
        "g", "1",
        (Node("a", "entry"), Node("b", "entry"), Node("c", "entry"), Node("one", "join", {"sides": ["a", "b"]} | final), Node("short", "map", F.substring(v, 1, 40)), Node("two", "join", {"sides": ["ab", "c"], "insert": "product", "emit": "final"})),
        (Edge("a", "one", side="a"), Edge("b", "one", side="b"), Edge("one", "short"), Edge("short", "two", side="ab"), Edge("c", "two", side="c")),
    )
    rows = lambda n, m: spark.createDataFrame([(p, f"k{p * m % 5}", f"{m}:{p}") for p in range(n)], "pos long, key string, value string")
    sources = {"a": rows(12, 1), "b": rows(9, 2), "c": rows(14, 3)}
    out = [sorted((r.pos, r.ordinal, r.key, r.value) for r in g.run(sources, join)["two"].collect()) for join in (joins.keyed_join, streamed_join([50, 120], 3))]
    assert out[0] == out[1] and len(out[0]) > 10


def test_ordered_window_as_a_stream(spark):
    spec = folds.FoldWindow(7, 3, -2)
    rows = arrivals(random.Random(9), 60, spec)
    df = spark.createDataFrame(rows, "pos long, op string, timestamp long, key string, value string")
    pos, make = F.col("pos"), StreamWindow(spec, str, lambda a, x: a + x, str)
    got = run_batches(sharded(df, 3), [pos < 20, pos.between(20, 45), pos > 45], lambda s: P.stateful(s, make, "shard"))
    want = folds.fold_ordered(df.where("op <> 'drain'"), spec, F.lit(""), lambda a, x: F.concat(a, x), by_time=True)
    assert sorted((r.key, r.idx, r.input_count, r.value) for r in got.collect()) == sorted((r.key, r.idx, r.input_count, r.value) for r in want.collect())
