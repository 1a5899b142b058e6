"""Charges, calls and state of a graph against a record-by-record model."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanweave.plans import budgets as B
from spanweave.plans.flow import Edge, Graph, Node
from spanweave.schema import LimitError


def total(value, state):
    state = state + [value]
    return state, sum(state), len(state) > 1, len(state) < 3


def graph():
    v = F.col("value")
    return Graph(
        "g", "1",
        (Node("in", "entry"), Node("odd", "branch", v % 2 == 1), Node("wide", "flat_map", F.sequence(v, v + v % 4)), Node("sum", "stateful_map", (list, total)), Node("all", "merge")),
        (Edge("in", "odd"), Edge("odd", "wide", True), Edge("odd", "all", False), Edge("wide", "sum"), Edge("sum", "all")),
    )


def model(rows):
    states, out = {}, {}
    for pos, key, v in rows:
        work, calls, fresh = [], 1, 0
        work += [("admission", "in", v), ("delivery", "in", v), ("emission", "odd", v), ("delivery", "odd", v)]
        if v % 2:
            own = list(range(v, v + v % 4 + 1))
            calls += 1
            work += [("emission", "wide", x) for x in own] + [("delivery", "wide", x) for x in own]
            for x in own:
                calls += 1
                fresh += key not in states
                state, value, emit, retain = total(x, states.get(key, []))
                if retain:
                    states[key] = state
                else:
                    states.pop(key, None)
                if emit:
                    work += [("emission", "sum", value), ("delivery", "sum", value), ("emission", "all", value)]
        else:
            work += [("emission", "all", v)]
        size = lambda x: len(str(x))
        by = Counter(n for k, n, _ in work if k == "emission")
        out[pos] = {
            "max_work_records": len(work), "max_work_bytes": sum(size(x) for *_, x in work), "max_calls_per_input": calls + fresh,
            "max_records_per_input": max(by.values()), "max_record_bytes": max(size(x) for k, _, x in work if k != "delivery"),
            "max_batch_bytes": max(sum(size(x) for k, n, x in work if k == "emission" and n == i) for i in by),
            "max_state_keys": len(states), "max_state_bytes": sum(len(json.dumps(s, separators=(",", ":"))) for s in states.values()),
        }
    return out


def test_against_a_model(spark):
    rng = random.Random(2)
    rows = [(p, rng.choice("abcdefgh"), rng.randint(0, 10 ** rng.randint(1, 6))) for p in range(150)]
    sources = {"in": spark.createDataFrame(rows, "pos long, key string, value long")}
    want = model(rows)
    charged = B.charges(graph(), sources)
    got = {r.pos: (r.work_records, r.work_bytes) for r in B.work(charged).collect()}
    assert got == {p: (w["max_work_records"], w["max_work_bytes"]) for p, w in want.items()}
    edges = {(r.node, r.target): r.deliveries for r in B.deliveries(charged).collect()}
    assert edges["in", "odd"] == 150 and edges["odd", "wide"] + edges["odd", "all"] == 150
    limits = {name: max(w[name] for w in want.values()) - 1 for name in next(iter(want.values()))}
    found = {(r.pos, r.limit): r.amount for r in B.breaches(graph(), sources, B.FlowLimits(**limits), block=16).collect()}
    beyond = {(p, name): w[name] for p, w in want.items() for name, most in limits.items() if w[name] > most}
    states = {k: v for k, v in found.items() if k[1].startswith("max_state")}
    changed = {p for p, _, v in rows if v % 2}  # positions that change no state aren't looked at again
    assert states == {k: v for k, v in beyond.items() if k[1].startswith("max_state") and k[0] in changed}
    assert {k: v for k, v in found.items() if k not in states} == {k: v for k, v in beyond.items() if not k[1].startswith("max_state")}
    assert {name for _, name in found} == set(limits)
    first = min(p for p, _ in found)
    with pytest.raises(LimitError, match=f"position {first}"):
        B.check_budgets(graph(), sources, B.FlowLimits(**limits))
    B.check_budgets(graph(), sources, B.FlowLimits())
    with pytest.raises(LimitError, match="max_state_value_bytes"):
        B.check_budgets(graph(), sources, B.FlowLimits(max_state_value_bytes=3))
