"""What a tolerance join deals out: each left row about twice, and the rows of a scan without keys once."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators.align import align
from spanweave.operators.bandjoin import band_join, join_streams
from spanweave.operators.scan import prefix_scan
from spanweave.schema import AlignConfig


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


@pytest.mark.parametrize(("base", "tolerance"), [(0.0, 5.0), (-300.0, 0.1), (1.7e12, 1_800_000.0), (1.7e12, 1e-5), (1e-3, 1e-4)])
def test_pairs_and_copies(spark, base, tolerance):
    rng = random.Random(3)
    step = tolerance * rng.choice([0.25, 0.5])
    times = [[(n, base + step * rng.randint(-200, 200)) for n in range(300)] for _ in range(2)]
    left, right = (spark.createDataFrame(x, "n long, t double") for x in times)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = band_join(left, right, tolerance)
        got = sorted((r.l_n, r.r_n, r.delta_ms) for r in df.collect())
        made = [x.metrics().get("numOutputRows").get().value() for x in nodes(df._jdf.queryExecution().executedPlan()) if x.nodeName() == "Generate"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == sorted((a, b, abs(x - y)) for a, x in times[0] for b, y in times[1] if abs(x - y) <= tolerance)
    assert len(got) > 100 and (base == 1.7e12 and tolerance < 1 or sum(made) <= 2.7 * 300)  # three each before; more where a bucket is a few ulps wide


def test_common_windows(spark):
    rng = random.Random(4)
    rows = [(f"{s}{n}", s, "m", rng.uniform(0, 300), rng.choice([0.0, 0.0, 7.0, 40.0])) for s in "ab" for n in range(60)]
    events = spark.createDataFrame(rows, "id string, stream string, modality string, timestamp_ms double, duration_ms double")
    for hop in (4.0, 10.0, 15.0):
        alignment = align(events, AlignConfig(10.0, hop, 0.0, 0.0, (), late_policy="drop"))
        pairs = join_streams(alignment, "a", "b", 12.0)
        assert "idxs" not in pairs._jdf.queryExecution().optimizedPlan().toString()
        idxs = {r.id: r.idxs for r in alignment.dispositions.collect() if r.idxs}
        got = {(r.left_id, r.right_id): r.window_indexes for r in pairs.collect()}
        t = {r[0]: r[3] for r in rows if r[0] in idxs}
        assert got == {(a, b): [i for i in idxs[a] if i in idxs[b]] for a in t for b in t if a[0] == "a" and b[0] == "b" and abs(t[a] - t[b]) <= 12.0}


def test_scan_deals_rows_once(spark):
    rng = random.Random(5)
    rows = [(None if n < 3 else rng.randint(0, 5000), n, rng.choice([None, rng.randint(0, 99)])) for n in range(400)]
    df = spark.createDataFrame(rows, "t long, n long, v long")
    out = prefix_scan(df, {"most": ("max", F.col("v"))}, F.expr("t div 300"), ["t", "n"])
    assert "hashpartitioning(coalesce(_block" not in out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    want, most = {}, None
    for _, n, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        before, most = most, v if most is None else most if v is None else max(most, v)
        want[n] = before, most
    assert {r.n: (r.most_before, r.most) for r in out.collect()} == want
