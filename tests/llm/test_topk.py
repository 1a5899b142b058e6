import math
import random

import duckdb
import pytest

from spanweave.llm import topk as K


def brute(rows, k, query=lambda i: i % 100 == 0):
    ints = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.append((i, [math.floor(1024 * x) for x in v]))
    out = set()
    for i, q in ints:
        if query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, p)), j) for j, p in ints if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("kind", ["unit", "skewed", "signs", "large"])
def test_against_all_products(spark, kind):
    rng = random.Random(kind)
    rows = []
    for i in range(1500):
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = math.sqrt(sum(x * x for x in v))
        size = {"unit": 1, "skewed": math.exp(rng.gauss(0, 1.5)), "signs": 1, "large": 1e6}[kind]
        v = [x / n * size for x in v]
        if kind == "signs":
            v = [-abs(x) if rng.random() < 0.9 else 0.0 for x in v]
            v[0] = abs(v[0]) if i % 100 else -abs(v[0])
        rows.append((i, v))
    rows += [(2000 + i, rows[300][1]) for i in range(60)]  # a group of copies, one of them a query
    rows += [(3000, None), (3001, [None] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [0.0] * 7), (3100, [0.0] * 8), (None, [1.0] * 8), (3200, []), (3201, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {tuple(r) for r in K.topk_digest(df).collect()}
    assert got == brute(rows, 10)
    few = K.top_k(df, K.F.col("vec_id") % 100 == 0, block=64, query_block=3, seeds=16)
    assert {tuple(r) for r in few.collect()} == got


def test_fewer_rows_than_k_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (100, [0.1, 0.1])]
    assert {tuple(r) for r in K.topk_digest(spark.createDataFrame(rows, schema)).collect()} == brute(rows, 10)
    assert K.topk_digest(spark.createDataFrame([], schema)).count() == 0
    assert K.topk_digest(spark.createDataFrame([(1, [1.0])], schema)).count() == 0


def test_components_and_scores_beyond_a_long(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.choice([0, 3, 16, 18, 30, 60, 140]) for _ in range(4)]) for i in range(260)]
    rows += [(300, [9.1e15, 1.0, 0.0, 0.0]), (301, [9.1e15, 1.0, 0.0, 0.0]), (302, [-3.3, 2.0**52 / 1024, 0.0, 0.0])]
    got = K.topk_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    exact = brute(rows, 10)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {x[:3] for x in exact}
    end = (1 << 63) - 1
    assert {tuple(r) for r in got} == {(*x[:3], max(-end, min(x[3], end))) for x in exact}


def test_against_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = K.topk_digest(spark.read.parquet(path)).collect()
    want = connection.sql(K.ORACLE_SQL).project("query_id, rank, vec_id, score").fetchall()
    assert len(got) == len(want) > 0 and set(map(tuple, got)) == set(want)
