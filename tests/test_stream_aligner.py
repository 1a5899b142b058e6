"""The streaming aligner against `replay` and against an arrival-by-arrival model, for any batching."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import align as A
from spanweave.schema import AlignConfig, LateEventError, LimitError, ValidationError
from spanweave.streaming.aligner import StreamAligner, align_stream
from spanweave.streaming.runner import run_batches
from tests.fake_state import run

COLUMNS = ["pos", "op", "id", "stream", "modality", "t", "horizon"]


def model(rows, c):
    """One event at a time over a list of live events: (windows, dispositions)."""
    live, latest, n, windows, kinds = [], {}, 0, [], {}
    start = lambda i: c.origin_ms + i * c.hop_ms
    end = lambda i: start(i) + c.window_ms

    def close():
        nonlocal n
        own = [e for e in live if e[6] > start(n) and e[5] < end(n)]
        for e in own:
            kinds[e[2]][1] += 1
        missing = [s for s in c.required_streams if s not in {e[3] for e in own}]
        windows.append((n, start(n), end(n), len(own), ",".join(missing), ",".join(sorted({e[4] for e in own})), not missing))
        n += 1

    for e in rows:
        if e[1] == "flush":
            far = max((x[6] for x in live), default=-math.inf)
            while start(n) < far:
                close()
            break
        obsolete = e[6] <= start(n)
        late = obsolete or (n > 0 and e[5] < end(n - 1))
        if late and c.late_policy == "reject":
            raise LateEventError(e[2])
        if late and (c.late_policy == "drop" or obsolete):
            kinds[e[2]] = ["dropped", 0]
            continue
        kinds[e[2]] = ["late" if late else "ok", 0]
        live.append(e)
        latest[e[3]] = max(e[5], latest.get(e[3], -math.inf))
        if c.required_streams and all(s in latest for s in c.required_streams):
            while end(n) <= min(latest[s] for s in c.required_streams) - c.allowed_lateness_ms:
                close()
            live = [x for x in live if x[6] > start(n)]
    return windows, [(i, kind if kind == "dropped" or count else "unassigned", count) for i, (kind, count) in kinds.items()]


def events(rng, n):
    rows = []
    for pos in range(n):
        t = float(max(-50, pos * 7 + rng.randint(-60, 60)))
        d = float(rng.choice([0, 0, 10, 120]))
        rows.append((pos, "event", f"e{pos}", rng.choice("abc"), rng.choice("xy"), t, math.nextafter(t, math.inf) if d == 0 else t + d))
    return [*rows, (n, "flush", None, None, None, math.nan, math.nan)]


def test_any_batching_against_a_model():
    rng = random.Random(3)
    policies, rejected = {"drop": 0, "accept": 0}, 0
    for case in range(300):
        policy = rng.choice(["drop", "accept", "reject"])
        c = AlignConfig(rng.choice([50.0, 100.0]), rng.choice([20.0, 50.0, 130.0]), rng.choice([0.0, 30.0]), rng.choice([0.0, 15.0]), rng.choice([("a",), ("a", "b"), ()]), late_policy=policy)
        rows = events(rng, rng.randint(0, 40))
        cuts = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, min(5, len(rows)))))
        results = []
        for emit in ("windows", "dispositions"):
            try:
                results.append([r[1:] for r in run(lambda emit=emit: StreamAligner(c, emit), rows, COLUMNS, "k", cuts)])
            except LateEventError:
                results.append(None)
        try:
            want = model(rows, c)
        except LateEventError:
            assert results == [None, None]
            rejected += 1
            continue
        assert results[0] == want[0], (case, c)
        assert sorted(results[1]) == sorted(want[1]), (case, c)
        policies[policy if policy != "reject" else "drop"] += any(x[1] != "ok" for x in want[1])
    assert rejected > 20 and min(policies.values()) > 20


def test_limits_and_control():
    c = AlignConfig(10.0, late_policy="drop", required_streams=("a",), max_output_windows=3, max_events_per_window=2)
    row = lambda pos, t, i=None: (pos, "event", i or f"e{pos}", "a", "x", float(t), float(t) + 1)
    flush = (9, "flush", None, None, None, math.nan, math.nan)
    with pytest.raises(LimitError, match="3 windows"):
        run(lambda: StreamAligner(c), [row(0, 1), row(1, 45)], COLUMNS, "k", [])
    with pytest.raises(LimitError, match="2 events"):
        run(lambda: StreamAligner(c), [row(0, 1), row(1, 2), row(2, 3), row(3, 11)], COLUMNS, "k", [2])
    with pytest.raises(ValidationError, match="after the flush"):
        run(lambda: StreamAligner(c), [row(0, 1), flush, row(10, 2)], COLUMNS, "k", [2])
    with pytest.raises(ValidationError, match="occurs again"):
        run(lambda: StreamAligner(c, check_ids=True), [row(0, 1, "z"), row(1, 2, "z")], COLUMNS, "k", [1])
    assert len(run(lambda: StreamAligner(c, check_ids=True, retain_ms=0.0), [row(0, 1, "z"), row(1, 15), row(2, 16, "z"), flush], COLUMNS, "k", [1, 2, 3])) == 2


def test_stream_equals_replay(spark):
    """Two groups, three micro-batches: the windows of each group are those of its replay."""
    rng = random.Random(8)
    rows = [(pos, "g" + str(pos % 2), "event", i, s, m, t, h - t if h - t > 1 else 0.0) for pos, _, i, s, m, t, h in events(rng, 120)[:-1]]
    rows += [(1000 + k, f"g{k}", "flush", None, None, None, None, None) for k in range(2)]
    df = spark.createDataFrame(rows, "pos long, key string, op string, id string, stream string, modality string, timestamp_ms double, duration_ms double")
    c = AlignConfig(100.0, 50.0, 20.0, 0.0, ("a", "b"), offsets_ms={"b": 5.0}, late_policy="accept")
    batches = [F.col("pos") < 30, F.col("pos").between(30, 70), F.col("pos") > 70]
    got = sorted(tuple(r) for r in run_batches(df, batches, lambda s: align_stream(s, c)).collect())
    want = []
    for g in ("g0", "g1"):
        own = A.replay(df.where((F.col("key") == g) & (F.col("op") == "event")).withColumnRenamed("pos", "arrival_pos"), c).windows
        own = own.select(F.lit(g), "idx", "start_ms", "end_ms", F.col("n_events").cast("long"), F.array_join("missing_streams", ","), F.array_join("modalities", ","), "complete")
        want += [tuple(r) for r in own.collect()]
    assert got == sorted(want)
