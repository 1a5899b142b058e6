"""Budgets of a graph's work: what each input costs, and the first position that costs too much.

An input is charged one record and its value's bytes when it is admitted, for every record that a node emits for it, and for
every record that an edge delivers, so a fan-out pays per edge. Charges are sums per position; what keyed state holds after each
position is a prefix scan over the changes. Nothing is looked at row by row on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.scan import prefix_scan
from spanweave.operators.steps import stateful_sizes
from spanweave.plans.flow import Graph
from spanweave.schema import LimitError, ValidationError

_CALLS = ("map", "filter", "flat_map", "key_by", "branch", "stateful_map", "stateful_flat_map")


@dataclass(frozen=True)
class FlowLimits:
    """Per input: records and bytes that one node emits, calls of all nodes, bytes of a record, records and bytes of all work.
    Over the whole run: bytes of one key's state at a node, and the keys and bytes that all states hold after a position."""

    max_records_per_input: int = 1_000
    max_calls_per_input: int = 10_000
    max_record_bytes: int = 1 << 20
    max_batch_bytes: int = 16 << 20
    max_state_value_bytes: int = 1 << 20
    max_state_keys: int = 10_000
    max_state_bytes: int = 64 << 20
    max_work_records: int = 10_000
    max_work_bytes: int = 64 << 20

    def __post_init__(self):
        for f in fields(self):
            if type(getattr(self, f.name)) is not int or getattr(self, f.name) < 1:
                raise ValidationError(f"{f.name} must be a positive integer")


def _size(value: Column) -> Column:
    """Bytes of a value as it is encoded: null is JSON's null."""
    return F.octet_length(F.coalesce(value.cast("string"), F.lit("null"))).cast("long")


def charges(graph: Graph, sources: dict[str, DataFrame]) -> DataFrame:
    """(pos, node, kind, target, records, bytes, largest): kind is admission, emission or delivery (to the target)."""
    made = graph.every(sources)
    of = {n.node_id: n for n in graph.nodes}
    parts = []

    def charge(df: DataFrame, node: str, kind: str, target: str | None = None) -> None:
        parts.append(df.select("pos", F.lit(node).alias("node"), F.lit(kind).alias("kind"), F.lit(target).cast("string").alias("target"), _size(F.col("value")).alias("bytes")))

    for i in graph.order:
        if of[i].kind == "entry":
            charge(made[i], i, "admission")
        else:
            for df in made[i] if of[i].kind == "branch" else [made[i]]:
                charge(df, i, "emission")
        for e in graph.out(i):
            charge(graph.delivered(e, made), i, "delivery", e.target)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pos", "node", "kind", "target").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))


def work(charged: DataFrame) -> DataFrame:
    """(pos, work_records, work_bytes)."""
    return charged.groupBy("pos").agg(F.sum("records").alias("work_records"), F.sum("bytes").alias("work_bytes"))


def deliveries(charged: DataFrame) -> DataFrame:
    """(node, target, deliveries): the counter of each edge."""
    return charged.where("kind = 'delivery'").groupBy("node", "target").agg(F.sum("records").alias("deliveries"))


def state_changes(graph: Graph, sources: dict[str, DataFrame], made: dict | None = None) -> DataFrame:
    """(pos, node, ordinal, key, fresh, before, after): of each record that a keyed state meets, whether its state began anew, and
    the bytes of the state before and after it (null: none)."""
    made = made or graph.every(sources)
    out = None
    for n in graph.nodes:
        if n.kind in ("stateful_map", "stateful_flat_map"):
            read = graph.delivered(graph.into(n.node_id)[0], made)
            one = stateful_sizes(read, *n.function, flat=n.kind == "stateful_flat_map", step_id=n.node_id).withColumn("node", F.lit(n.node_id))
            out = one if out is None else out.unionByName(one)
    return out


def breaches(graph: Graph, sources: dict[str, DataFrame], limits: FlowLimits, block: int = 1 << 16) -> DataFrame:
    """(pos, limit, node, amount, most) of everything that goes beyond a limit."""
    charged = charges(graph, sources)
    changes = state_changes(graph, sources)
    none = F.lit(None).cast("string")
    of = {n.node_id: n.kind for n in graph.nodes}
    called = F.create_map(*[x for i, kind in of.items() for x in (F.lit(i), F.lit(kind in _CALLS))])

    def over(df: DataFrame, limit: str, amount: Column, node: Column = none) -> DataFrame:
        most = getattr(limits, limit)
        return df.select("pos", F.lit(limit).alias("limit"), node.alias("node"), amount.cast("long").alias("amount"), F.lit(most).cast("long").alias("most")).where("amount > most")

    calls = charged.where("kind = 'delivery'").where(called[F.col("target")]).select("pos", F.col("records").alias("calls"))
    if changes is not None:
        calls = calls.unionByName(changes.where("fresh").groupBy("pos").agg(F.count(F.lit(1)).alias("calls")))  # of the initial state
    emitted = charged.where("kind = 'emission'")
    found = [
        over(emitted, "max_records_per_input", F.col("records"), F.col("node")),
        over(emitted, "max_batch_bytes", F.col("bytes"), F.col("node")),
        over(charged.where("kind <> 'delivery'"), "max_record_bytes", F.col("largest"), F.col("node")),
        over(calls.groupBy("pos").agg(F.sum("calls").alias("calls")), "max_calls_per_input", F.col("calls")),
        over(work(charged), "max_work_records", F.col("work_records")),
        over(work(charged), "max_work_bytes", F.col("work_bytes")),
    ]
    if changes is not None:
        held = state_totals(changes, block)
        found += [over(changes, "max_state_value_bytes", F.col("after"), F.col("node")), over(held, "max_state_keys", F.col("keys")), over(held, "max_state_bytes", F.col("bytes"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def state_totals(changes: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(pos, keys, bytes) that all states hold after each position that changes one."""
    delta = changes.groupBy("pos").agg(F.sum(F.col("after").isNotNull().cast("long") - F.col("before").isNotNull().cast("long")).alias("_k"), F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("_b"))
    return prefix_scan(delta, {"keys": ("sum", F.col("_k")), "bytes": ("sum", F.col("_b"))}, F.call_function("div", F.col("pos"), F.lit(block).cast("long")), ["pos"]).select("pos", "keys", "bytes")


def check_budgets(graph: Graph, sources: dict[str, DataFrame], limits: FlowLimits) -> None:
    """Raises for the first position beyond a limit."""
    if bad := breaches(graph, sources, limits).orderBy("pos", "limit", "node").first():
        where = f" at {bad['node']}" if bad["node"] else ""
        raise LimitError(f"position {bad['pos']}{where}: {bad['limit']} is {bad['most']}, not {bad['amount']}")
