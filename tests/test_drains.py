"""Side closings and pages of the final join against a key-by-key model."""

import itertools
import random

import pytest

from spanweave.operators import drains as D
from spanweave.schema import LimitError

SIDES = ["name", "email", "role"]


def model(arrivals, insert, limits):
    cells = {}
    for _, op, side, key, value in arrivals:
        if op == "data":
            own = cells.setdefault(key, {}).setdefault(side, [])
            if insert == "product":
                own.append(value)
            elif insert == "last" or not own:
                own[:] = [value]
    out, page, held = [], -1, None
    for key in sorted(cells):
        rows = list(itertools.product(*(cells[key].get(s, [None]) for s in SIDES)))
        size = sum(len(key.encode()) + sum(len((v or "").encode()) for v in r) for r in rows)
        if held is None or held[0] == limits.max_keys or held[1] + len(rows) > limits.max_rows_per_page or held[2] + size > limits.max_page_bytes:
            page, held = page + 1, [0, 0, 0]
        held[0] += 1
        held[1] += len(rows)
        held[2] += size
        out += [(key, k, page, *r) for k, r in enumerate(rows)]
    return sorted(out, key=str)


def arrivals(rng, n, keys):
    rows = [(pos, "data", rng.choice(SIDES), f"k{rng.randint(0, keys):03d}" + rng.choice(["", "é"]), rng.choice([None, "", "x" * rng.randint(1, 9), "雪"])) for pos in range(n)]
    cut = {s: rng.randint(n // 2, n) for s in SIDES}
    rows = [r for r in rows if r[0] < cut[r[2]]]
    rows += [(c, "eof", s, None, None) for s, c in cut.items()] + [(n + 5, "eof", "name", None, None)]
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize(("seed", "insert", "limits", "block"), [(1, "last", D.DrainLimits(3), 8), (2, "product", D.DrainLimits(7, 60, 80, 900), 14), (3, "first", D.DrainLimits(100, 1, 5, 60), 1), (4, "product", D.DrainLimits(2, 500, 500, 10**6), 1 << 16)])
def test_pages_against_a_model(spark, seed, insert, limits, block):
    rows = arrivals(random.Random(seed), 260, 90)
    df = spark.createDataFrame(rows, "pos long, op string, side string, key string, value string")
    got = D.drain_final(df, SIDES, insert, limits, block).collect()
    assert sorted(((r.key, r.ordinal, r.page, r.name_value, r.email_value, r.role_value) for r in got), key=str) == model(rows, insert, limits)
    assert max(r.page for r in got) > 5 or seed == 4


def test_refusals(spark):
    make = lambda rows: spark.createDataFrame(rows, "pos long, op string, side string, key string, value string")
    ends = [(9, "eof", s, None, None) for s in SIDES]
    for rows, text in (
        ([(10, "data", "name", "k", "v"), *ends], "follows the end of side name at 9"),
        ([(1, "data", "name", "k", "v"), *ends[:2]], "all sides must close"),
        ([(1, "data", "other", "k", "v"), *ends], "unknown side other"),
        ([(1, "data", "name", None, "v"), *ends], "has no key"),
        ([(k, "data", s, "hot", "v") for k in range(5) for s in SIDES] + ends, "key hot gives 125 rows; 100 at most"),
        ([(1, "data", "name", "k", "v" * 50), *ends], "key k gives 51 bytes; 40 at most"),
    ):
        limits = D.DrainLimits(10, 100, 1000, 40 if "bytes" in text else 10**6)
        with pytest.raises(Exception, match=text):
            D.drain_final(make(rows), SIDES, "product", limits).collect()
    with pytest.raises(LimitError, match="125 rows"):
        D.check_drain(make([(k, "data", s, "hot", "v") for k in range(5) for s in SIDES] + ends), SIDES, "product", limits)
    assert D.drain_final(make(ends), SIDES).collect() == []
