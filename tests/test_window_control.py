"""Drain epochs, Python folds and expansions by table functions, against models."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import folds, steps
from spanweave.schema import ValidationError

SCHEMA = "pos long, op string, timestamp long, key string, value long"


def control(rng, n, spec, caps=(None,), drain_all=True):
    """Arrivals, watermarks, drains; with drain_all a drain follows before the next input whenever a window is eligible."""
    rows, pos, mark, low = [], 0, None, -20
    put = lambda *x: rows.append((len(rows) * 3, *x))
    cells, finished = set(), False
    while pos < n:
        pos += 1
        if rng.random() < 0.8:
            t, key = low + rng.randint(0, 25), rng.choice("abcde")
            put("process", t, key, rng.randint(1, 9))
            if mark is None or t >= mark:
                cells |= {(i, key) for i in range((t - spec.origin - spec.width) // spec.hop + 1, (t - spec.origin) // spec.hop + 1)}
        else:
            mark = low = max(low, (mark if mark is not None else -30)) + rng.randint(0, 9)
            put("watermark", mark, None, None)
        if pos == n:
            put("finish", None, None, None)
            finished = True
        pending = lambda: [c for c in cells if finished or mark is not None and spec.origin + c[0] * spec.hop + spec.width <= mark]
        while drain_all and pending():
            cap = rng.choice(caps)
            put("drain", cap, None, None)
            for c in sorted(pending())[:cap]:
                cells.discard(c)
        if not drain_all and rng.random() < 0.2:
            put("drain", rng.choice(caps), None, None)
    return rows


def model(rows, spec):
    cells, mark, finished, out, place = {}, None, False, [], 0
    for pos, op, t, key, value in rows:
        if op == "process":
            if mark is not None and t < mark:
                continue
            for i in range((t - spec.origin - spec.width) // spec.hop + 1, (t - spec.origin) // spec.hop + 1):
                cells.setdefault((i, key), []).append(value)
        elif op == "watermark":
            mark = t
        elif op == "finish":
            finished = True
        else:
            ready = sorted(c for c in cells if finished or mark is not None and spec.origin + c[0] * spec.hop + spec.width <= mark)
            for c in ready[:t]:
                out.append((c[1], c[0], pos, place, cells.pop(c)))
                place += 1
    return sorted(out)


@pytest.mark.parametrize(("seed", "geometry", "caps", "drain_all"), [(1, (5, 5, 0), (None,), True), (2, (7, 3, -2), (1, 2, 3), True), (3, (2, 5, 1), (None, 1), True), (4, (7, 3, -2), (1, 2, None), False), (5, (5, 5, 0), (1,), False)])
def test_drains_against_a_model(spark, seed, geometry, caps, drain_all):
    spec = folds.FoldWindow(*geometry, late_policy="drop")
    rows = control(random.Random(seed), 150, spec, caps, drain_all)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cells = folds.fold_python(df, spec, list, lambda a, x: [*a, x], None, "array<long>")
    got = sorted((r.key, r.idx, r.epoch, r.place, list(r.value)) for r in folds.drain(cells, df, spec, drain_all, block=16).collect())
    assert got == model(rows, spec)
    assert len({r[2] for r in got}) > 5


def test_input_between_close_and_drain_is_refused(spark):
    spec = folds.FoldWindow(5, late_policy="drop")
    rows = [(0, "process", 1, "a", 1), (1, "watermark", 5, None, None), (2, "process", 6, "a", 1), (3, "drain", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = folds.fold(df, spec, {"total": F.sum("value")})
    with pytest.raises(Exception, match="position 2 comes while closed windows wait"):
        folds.drain(cells, df, spec).collect()
    assert [r.epoch for r in folds.drain(cells, df, spec, strict=False).collect()] == [3]


def test_python_fold_cells_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(6)
        rows = [(p, "process", rng.randint(0, 12), rng.choice("ab"), p) for p in range(100)] + [(200, "finish", None, None, None)]
        df = spark.createDataFrame(rows, SCHEMA)
        spec = folds.FoldWindow(10, late_policy="drop")
        for by_time in (False, True):
            got = {(r.key, r.idx): (r.input_count, r.value) for r in folds.fold_python(df, spec, lambda: {"all": []}, lambda a, x: a | {"all": [*a["all"], x]}, lambda a: ",".join(map(str, a["all"])), by_time=by_time).collect()}
            want = {}
            for p, _, t, key, v in sorted(rows[:-1], key=(lambda r: (r[2], r[0])) if by_time else (lambda r: r[0])):
                want.setdefault((key, t // 10), []).append(v)
            assert got == {k: (len(v), ",".join(map(str, v))) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def bad(a, x):
        if x == 40:
            raise KeyError("forty")
        return a

    async def later(a, x):
        return a

    where = next(r for r in rows if r[4] == 40)
    with pytest.raises(Exception, match=f"fold of key '{where[3]}', idx {where[2] // 10}: KeyError"):
        folds.fold_python(df, spec, int, bad).collect()
    with pytest.raises(Exception, match="finalize of key"):
        folds.fold_python(df, spec, int, lambda a, x: a + x, lambda a: a / 0).collect()
    with pytest.raises(Exception, match="must not return awaitables"):
        folds.fold_python(df, spec, int, later).collect()


def test_expansion_by_a_generator(spark):
    df = steps.records(spark.createDataFrame([(p, "k", str(p)) for p in range(6)], "pos long, key string, value string"))

    def expand(value):
        for i in range(int(value)):
            yield None if i == 1 else f"{value}.{i}"

    got = sorted((r.pos, r.ordinal, r.key, r.value) for r in steps.flat_map_udtf(df, expand, 5).collect())
    assert got == [(p, i, "k", None if i == 1 else f"{p}.{i}") for p in range(6) for i in range(p)]
    twice = steps.flat_map_udtf(steps.flat_map_udtf(df, expand, 5), lambda v: [v, v], 2)
    assert [(r.pos, r.ordinal) for r in twice.orderBy("pos", "ordinal").collect()] == [(p, i) for p in range(6) for i in range(2 * p)]
    for bad, text in ((expand, "more than 4 values"), (lambda v: v, "str is no expansion"), (lambda v: {v: 1}, "dict is no expansion"), (lambda v: 3, "int is no expansion")):
        with pytest.raises(Exception, match=f"split: .*{text}"):
            steps.flat_map_udtf(df, bad, 4, "split").collect()


def test_window_dominates_terminals():
    from spanweave.plans.flow import Edge, Graph, Node

    entry, window, step = Node("in", "entry"), Node("w", "window"), lambda i: Node(i, "drop_key")
    for nodes, edges in (((entry, window, step("out")), [("in", "w"), ("w", "out")]), ((entry, step("a"), window), [("in", "a"), ("a", "w")]), ((entry, step("a"), step("b"), Node("m", "merge"), window, step("x"), step("y")), [("in", "a"), ("in", "b"), ("a", "m"), ("b", "m"), ("m", "w"), ("w", "x"), ("w", "y")])):
        assert Graph("g", "1", nodes, tuple(Edge(*e) for e in edges)).dominated
    for nodes, edges in (((entry, window, step("past")), [("in", "w"), ("in", "past")]), ((entry, window, Node("m", "merge")), [("in", "w"), ("in", "m"), ("w", "m")]), ((entry, step("a"), window, step("b")), [("in", "a"), ("a", "w"), ("a", "b")])):
        with pytest.raises(ValidationError, match="past the window"):
            Graph("g", "1", nodes, tuple(Edge(*e) for e in edges))
