"""Dataflow graphs as plans: nodes over records (pos, ordinal, key, value), composed in topological order.

A graph has entries (one DataFrame each), steps, branches with a true and a false route, merges (inputs in edge order), joins
(one producer per side) and at most one window between prefix and suffix. Every node becomes a DataFrame of its inputs, so
Catalyst sees the whole graph; terminals are returned by name, or united with a column terminal. What several edges read can be
persisted by the caller's choice. Identity is a digest of the declaration, not of code: change revision when code changes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators import folds, joins, steps
from spanweave.schema import ValidationError

MAX_NODES, MAX_EDGES = 64, 256
KINDS = ("entry", "map", "filter", "flat_map", "key_by", "drop_key", "stateful_map", "stateful_flat_map", "branch", "merge", "join", "window")


@dataclass(frozen=True)
class Node:
    """function: what the kind needs - a Column for map, filter, flat_map, key_by and branch; (begin, update) for keyed state;
    {sides, insert, emit} for a join; {spec, aggregates, control} for a window."""

    node_id: str
    kind: str
    function: object = None


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    route: bool | None = None  # of a branch
    side: str | None = None  # of a join


@dataclass(frozen=True)
class Graph:
    graph_id: str
    revision: str
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    order: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        ids = [n.node_id for n in self.nodes]
        if not 1 <= len(ids) <= MAX_NODES or len(set(ids)) != len(ids) or len(self.edges) > MAX_EDGES:
            raise ValidationError(f"1 to {MAX_NODES} different nodes and {MAX_EDGES} edges at most")
        of = {n.node_id: n for n in self.nodes}
        for n in self.nodes:
            if n.kind not in KINDS:
                raise ValidationError(f"{n.node_id}: kind {n.kind!r}")
            into, out = self.into(n.node_id), self.out(n.node_id)
            if any(e.source not in of or e.target not in of for e in into + out):
                raise ValidationError(f"{n.node_id}: an edge to or from no node")
            if n.kind == "entry" and into or n.kind == "merge" and len(into) < 2 or n.kind not in ("entry", "merge", "join") and len(into) != 1:
                raise ValidationError(f"{n.node_id}: {len(into)} inputs")
            if n.kind == "branch" and {e.route for e in out} != {True, False}:
                raise ValidationError(f"{n.node_id}: both routes of a branch must lead somewhere")
            if n.kind == "join" and sorted(str(e.side) for e in into) != sorted(n.function["sides"]):
                raise ValidationError(f"{n.node_id}: one producer for each side")
            if n.kind != "branch" and any(e.route is not None for e in out):
                raise ValidationError(f"{n.node_id}: only branches have routes")
        if sum(n.kind == "window" for n in self.nodes) > 1:
            raise ValidationError("one window at most")
        object.__setattr__(self, "order", tuple(self._sorted(ids)))
        if any(n.kind == "window" for n in self.nodes) and not self.dominated:
            raise ValidationError("a path leads past the window to a terminal")

    def into(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node_id]

    def out(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.source == node_id]

    def _sorted(self, ids: list[str]) -> list[str]:
        """The earliest declared node whose inputs are done comes next."""
        done: list[str] = []
        while len(done) < len(ids):
            ready = next((i for i in ids if i not in done and all(e.source in done for e in self.into(i))), None)
            if ready is None:
                raise ValidationError("the graph has a cycle")
            done.append(ready)
        return done

    @property
    def terminals(self) -> list[str]:
        return [i for i in self.order if not self.out(i)]

    @property
    def identity(self) -> str:
        shape = {"id": self.graph_id, "revision": self.revision, "nodes": [[n.node_id, n.kind] for n in self.nodes], "edges": [[e.source, e.target, e.route, e.side] for e in self.edges]}
        return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()

    @property
    def dominated(self) -> bool:
        """Whether every path from an entry to a terminal leads through the window."""
        window = next((n.node_id for n in self.nodes if n.kind == "window"), None)
        around: set[str] = set()  # nodes that a path reaches past the window
        for i in self.order:
            into = self.into(i)
            if i != window and (not into or any(e.source in around for e in into)):
                around.add(i)
        return not any(t in around for t in self.terminals)

    def run(self, sources: dict[str, DataFrame], join: Callable[..., DataFrame] = joins.keyed_join) -> dict[str, DataFrame]:
        """The DataFrame of every terminal. sources: one of records for each entry; join: how joins run (a stream, for one)."""
        made = self.every(sources, join)
        return {t: made[t] for t in self.terminals}

    def delivered(self, edge: Edge, made: dict) -> DataFrame:
        """What goes over an edge, of the outputs that every() gives."""
        return made[edge.source] if edge.route is None else made[edge.source][0 if edge.route else 1]

    def every(self, sources: dict[str, DataFrame], join: Callable[..., DataFrame] = joins.keyed_join) -> dict:
        """The output of every node: a DataFrame, of a branch one for each route."""
        of, made = {n.node_id: n for n in self.nodes}, {}
        entries = {n.node_id for n in self.nodes if n.kind == "entry"}
        if set(sources) != entries:
            raise ValidationError(f"sources {sorted(sources)}; entries {sorted(entries)}")

        for i in self.order:
            node = of[i]
            inputs = [self.delivered(e, made) for e in self.into(i)]
            if node.kind == "entry":
                made[i] = steps.records(sources[i]) if "ordinal" not in sources[i].columns else sources[i]
            elif node.kind == "join":
                made[i] = _join([(e.side, x) for e, x in zip(self.into(i), inputs, strict=True)], join, **node.function)
            else:
                made[i] = _APPLY[node.kind](node, inputs)
        return made

    def outputs(self, sources: dict[str, DataFrame]) -> DataFrame:
        """All terminals with the same columns, as terminal, rank (in execution order), pos, ordinal, key and value."""
        parts = [df.select(F.lit(t).alias("terminal"), F.lit(k).alias("rank"), "pos", "ordinal", "key", F.col("value").cast("string").alias("value")) for k, (t, df) in enumerate(self.run(sources).items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _join(inputs: list[tuple[str, DataFrame]], join: Callable[..., DataFrame], sides: list[str], insert: str = "last", emit: str = "final") -> DataFrame:
    """Arrivals in order of position, then of side as declared; a row becomes the record {present, values} as JSON."""
    tagged = None
    for side, df in inputs:
        one = df.select((F.col("pos") * 16 + sides.index(side)).alias("pos"), F.lit(side).alias("side"), "key", F.col("value").cast("string").alias("value"))
        tagged = one if tagged is None else tagged.unionByName(one)
    rows = join(tagged, sides, insert, emit)
    record = F.to_json(F.struct(F.array(*[F.col(f"{s}_present") for s in sides]).alias("present"), F.array(*[F.col(f"{s}_value") for s in sides]).alias("values")), {"ignoreNullFields": "false"})
    return rows.select(F.coalesce(F.floor(F.col("pos") / 16), F.lit(-1)).cast("long").alias("pos"), F.col("ordinal").cast("long").alias("ordinal"), "key", record.alias("value"))


def _window(node: Node, inputs: list[DataFrame]) -> DataFrame:
    """Prefix records carry their tick in value.timestamp (JSON) or column timestamp; closed windows become records in order
    of window, then key. With drains (True, or "strict": nothing may come while a closed window waits) control holds drain rows,
    only drained windows go on, with their epoch, and their position is their place among all drained ones: each runs through the
    suffix before the next, so a suffix that changes keys meets them in order of epoch, window and key."""
    spec, aggregates, control = (node.function[k] for k in ("spec", "aggregates", "control"))
    drains = node.function.get("drains", False)
    data = inputs[0]
    rows = data.select((F.col("pos") * 2).alias("pos"), F.lit("process").alias("op"), F.col("timestamp") if "timestamp" in data.columns else F.get_json_object("value", "$.timestamp").cast("long").alias("timestamp"), "key", "value")
    marks = control.select((F.col("pos") * 2 + 1).alias("pos"), "op", "timestamp", F.lit(None).cast("string").alias("key"), F.lit(None).cast(dict(data.dtypes)["value"]).alias("value"))
    every = rows.unionByName(marks)
    if drains:
        out = folds.drain(folds.all_cells(every, spec, aggregates), every, spec, drains == "strict").withColumn("epoch", F.expr("epoch div 2")).withColumn("pos", F.col("place"))
    else:
        out = folds.fold(every, spec, aggregates).withColumn("pos", F.col("idx"))
    names = ["start", "end", "input_count", *(["epoch"] if drains else []), *aggregates]
    return out.select("pos", F.lit(0).cast("long").alias("ordinal"), "key", F.to_json(F.struct(*names)).alias("value"))


_APPLY: dict[str, Callable] = {
    "map": lambda n, x: steps.map_values(x[0], n.function),
    "filter": lambda n, x: steps.filter_records(x[0], n.function, n.node_id),
    "flat_map": lambda n, x: steps.flat_map(x[0], n.function),
    "key_by": lambda n, x: steps.key_by(x[0], n.function, n.node_id),
    "drop_key": lambda n, x: steps.drop_key(x[0]),
    "stateful_map": lambda n, x: steps.stateful_map(x[0], *n.function, step_id=n.node_id, value_type=dict(x[0].dtypes)["value"]),
    "stateful_flat_map": lambda n, x: steps.stateful_flat_map(x[0], *n.function, step_id=n.node_id, value_type=dict(x[0].dtypes)["value"]),
    "branch": lambda n, x: steps.branch(x[0], n.function, n.node_id),
    "merge": lambda n, x: steps.merge(x),
    "window": _window,
}


def linear(flow_id: str, revision: str, nodes: list[Node]) -> Graph:
    """A flow without branches: entry, then the nodes in order."""
    every = [Node("input", "entry"), *nodes]
    return Graph(flow_id, revision, tuple(every), tuple(Edge(a.node_id, b.node_id) for a, b in zip(every, every[1:])))
