"""Replay, scans, sessions and joins against plain recurrences on random cases."""

import math
import random

import pytest

from spanweave.operators import align as A
from spanweave.operators import joins, sessions
from spanweave.schema import AlignConfig, LateEventError, ValidationError

SCHEMA = "id string, stream string, modality string, timestamp_ms double, duration_ms double, data string, arrival_pos long"


def recurrence(events, c):
    """One event at a time; dropped events don't reach the maxima."""
    o, w, h, late = c.origin_ms, c.window_ms, c.hop_ms, c.allowed_lateness_ms
    seen, closed, disp, members, last_all = {}, 0, {}, set(), -1
    for e_id, stream, _, t, d, _, _ in events:
        horizon = math.nextafter(t, math.inf) if d == 0 else t + d
        obsolete = horizon <= o + closed * h
        is_late = obsolete or closed > 0 and t < o + (closed - 1) * h + w
        if is_late and c.late_policy == "reject":
            disp[e_id] = "rejected"
            return disp, members, None
        if is_late and (c.late_policy == "drop" or obsolete):
            disp[e_id] = "dropped"
            continue
        own, i = [], closed
        while o + i * h < horizon:
            if t < o + i * h + w:
                own.append(i)
            last_all = max(last_all, i)
            i += 1
        members |= {(i, e_id) for i in own}
        disp[e_id] = "unassigned" if not own else "late" if is_late else "ok"
        seen[stream] = max(seen.get(stream, -math.inf), t)
        if c.required_streams and all(r in seen for r in c.required_streams):
            mark = min(seen[r] for r in c.required_streams) - late
            while o + closed * h + w <= mark:
                closed += 1
    return disp, members, max(closed, last_all + 1)


@pytest.mark.parametrize("window,hop,origin", [(100, 100, 0), (100, 50, 0), (100, 150, 0), (0.5, 0.1, 0.1), (7, 3, 1.7e12), (100, 25, -60)])
@pytest.mark.parametrize("policy", ["drop", "accept"])
def test_replay_against_the_recurrence(spark, window, hop, origin, policy):
    rng = random.Random(hash((window, hop, policy)) & 0xFFFF)
    for required in ((), ("a",), ("a", "b")):
        events = []
        for i in range(150):
            t = origin + (i * 0.11 + rng.uniform(-2, 1)) * window
            if rng.random() < 0.3:
                t = origin + rng.randint(-1, 40) * hop
            events.append((f"e{i}", rng.choice("abc"), "m", float(t), rng.choice([0.0, 0.0, window * 1.0, window * 0.3]), "{}", i))
        c = AlignConfig(window, hop, rng.choice([0.0, window / 2]), origin, required, late_policy=policy)
        want, members, total = recurrence(events, c)
        got = A.replay(spark.createDataFrame(events, SCHEMA).repartition(4), c, positions_a_block=16)
        assert {r.id: r.disposition for r in got.dispositions.collect()} == want
        assert {(r.idx, r.id) for r in got.members.collect()} == members
        assert got.windows.count() == (total or 0)


def test_reject_and_identity(spark):
    events = [("x", "a", "m", 500.0, 0.0, "{}", 0), ("y", "a", "m", 10.0, 0.0, "{}", 1)]
    c = AlignConfig(100.0, required_streams=("a",))
    with pytest.raises(LateEventError):
        A.replay(spark.createDataFrame(events, SCHEMA), c, check=True)
    with pytest.raises(Exception, match="late under the reject policy"):
        A.replay(spark.createDataFrame(events, SCHEMA), c).windows.collect()
    assert A.align(spark.createDataFrame(events, SCHEMA), c, check=True).windows.count() == 6
    with pytest.raises(ValidationError):
        A.align(spark.createDataFrame([events[0], events[0]], SCHEMA), c, check=True)
    assert A.align(spark.createDataFrame([], SCHEMA), c).windows.count() == 0


def test_published_benchmark_shape(spark):
    from spanweave.sources.jsonl import generate_round_robin, round_robin_streams

    c = AlignConfig(100.0, required_streams=round_robin_streams(3))
    events = generate_round_robin(spark, 3000, 3)
    for run in (A.align, A.replay):
        rows = run(events, c, check=True).windows.collect()
        assert len(rows) == 100 and all(r.n_events == 30 and r.complete for r in rows)


def test_sessions_against_the_recurrence(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", rng.choice("ab"), "m", float(rng.randint(0, 4000)), float(rng.choice([0, 0, 5, 80])), "{}", i) for i in range(300)]
    want = []
    for s in "ab":
        end, n = None, -1
        for e in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0])):
            f = math.nextafter(e[3], math.inf) if e[4] == 0 else e[3] + e[4]
            if end is None or e[3] - end > 10:
                n += 1
            end = f if end is None else max(end, f)
            want.append((e[0], s, n))
    got = sessions.session_members(spark.createDataFrame(rows, SCHEMA), 10.0).collect()
    assert sorted((r.id, r.stream, r.session) for r in got) == sorted(want)


@pytest.mark.parametrize("insert", joins.INSERT)
@pytest.mark.parametrize("emit", joins.EMIT)
def test_nine_join_modes_against_a_model(spark, insert, emit):
    import itertools

    rng, sides = random.Random(71), ["name", "email", "role"]
    rows = [(i, rng.choice(sides), f"{rng.randint(0, 25)}雪", rng.choice([None, "v", "w"])) for i in range(260)]
    cells, want = {}, []

    def product(key, pos):
        cell = cells[key]
        for k, values in enumerate(itertools.product(*(cell.get(s, [(None,)]) for s in sides))):
            want.append((key, pos, k, *[x for s, v in zip(sides, values) for x in (s in cell, v[0])]))

    for pos, side, key, value in rows:
        own = cells.setdefault(key, {}).setdefault(side, [])
        if insert == "product":
            own.append((value,))
        elif insert == "last" or not own:
            own[:] = [(value,)]
        if emit == "running" or emit == "complete" and len(cells[key]) == 3:
            product(key, pos)
            if emit == "complete":
                cells[key] = {}
    if emit == "final":
        for key in cells:
            product(key, None)
    df = spark.createDataFrame(rows, "pos long, side string, key string, value string").repartition(3)
    names = ["key", "pos", "ordinal", *[f"{s}_{x}" for s in sides for x in ("present", "value")]]
    got = [tuple(r[n] for n in names) for r in joins.keyed_join(df, sides, insert, emit).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_repeated_ids_fail_by_default(spark):
    rows = [("x", "a", "m", 1.0, 0.0, "{}", 0), ("y", "a", "m", 2.0, 0.0, "{}", 1), ("x", "a", "m", 30.0, 0.0, "{}", 2)]
    events = spark.createDataFrame(rows, SCHEMA)
    c = AlignConfig(10.0, required_streams=("a",), late_policy="drop")
    for run in (A.align, A.replay):
        with pytest.raises(Exception, match="event id x occurs more than once"):
            run(events, c).windows.collect()
        with pytest.raises(ValidationError, match="'x' occurs 2 times"):
            run(events, c, check=True)
        assert run(events, c, unique=False).windows.count() == 4


def test_result_document_and_timeline(spark, tmp_path):
    import json

    from spanweave import report

    rows = [(f"e{i}", "ab"[i % 2], "m", i * 7.0, 3.0, '{"n":1}', i) for i in range(12)]
    found = A.replay(spark.createDataFrame(rows, SCHEMA), AlignConfig(20.0, required_streams=("a", "b"), late_policy="drop"))
    assert report.write_document(found, f"{tmp_path}/r") == {"document": True, "timeline": True}
    text = spark.read.text(f"{tmp_path}/r/document").first().value
    assert json.loads(text) == json.loads(json.dumps(report.document(found))) and len(json.loads(text)["windows"]) == 4
    assert "<svg" in spark.read.text(f"{tmp_path}/r/timeline").first().value
    lines = spark.read.json(f"{tmp_path}/r/window_lines")
    assert lines.count() == 4 and sum(len(r.events) for r in lines.collect()) == found.members.count()
    assert report.write_document(found, f"{tmp_path}/s", 100, 3) == {"document": True, "timeline": False}
