"""Reports of an alignment: tables as Parquet, the whole result as one JSON document, and a bounded HTML timeline."""

from __future__ import annotations

import hashlib
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.align import Alignment, window_events
from spanweave.schema import LimitError


def write_report(alignment: Alignment, path: str) -> None:
    alignment.windows.write.parquet(f"{path}/windows")
    alignment.members.write.parquet(f"{path}/members")
    alignment.gaps.write.parquet(f"{path}/gaps")
    alignment.dispositions.drop("idxs").write.parquet(f"{path}/dispositions")


def write_document(alignment: Alignment, path: str, most: int = 100_000, timeline: int = 1_000) -> dict[str, bool]:
    """The result as one JSON document and as a timeline, each a text file in a folder of its own, for results within the bounds;
    beyond one, that file isn't written rather than cut. In any case a line of JSON per window with its events is."""
    spark = alignment.windows.sparkSession
    window_events(alignment).write.json(f"{path}/window_lines")
    written = {}
    for name, make in (("document", lambda: json.dumps(document(alignment, most), sort_keys=True, separators=(",", ":"))), ("timeline", lambda: render_html(alignment, timeline))):
        try:
            text = make()
        except LimitError:
            written[name] = False
            continue
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
        written[name] = True
    return written


def _bounded(rows: DataFrame, most: int, what: str) -> list:
    """All rows on the driver, or an error where there are more than `most`."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise LimitError(f"more than {most} {what}")
    return found


def document(alignment: Alignment, most: int = 100_000) -> dict:
    """The whole result as one value, for results of at most `most` windows, memberships, gaps and excluded events each."""
    order = "arrival_pos" if "arrival_pos" in alignment.dispositions.columns else "t"
    apart = _bounded(alignment.dispositions.where("disposition IN ('dropped', 'late', 'unassigned')").select(order, "t", "stream", "id", "disposition"), most, "late or unassigned events")
    events: dict[int, list[dict]] = {}
    for row in sorted(_bounded(alignment.members, most, "memberships"), key=lambda r: (r["t"], r["stream"], r["id"])):
        event = {"timestamp_ms": row["t"], "data": json.loads(row["data"])} | {c: row[c] for c in ("id", "stream", "modality", "duration_ms")}
        events.setdefault(row["idx"], []).append(event)
    windows = [
        {"index": w["idx"], "events": events.get(w["idx"], [])} | {c: w[c] for c in ("start_ms", "end_ms", "complete", "missing_streams", "modalities")}
        for w in sorted(_bounded(alignment.windows, most, "windows"), key=lambda w: w["idx"])
    ]
    gaps = sorted((g.asDict() for g in _bounded(alignment.gaps, most, "gaps")), key=lambda g: (g["stream"], g["start_ms"]))
    ids = {name: [r["id"] for r in sorted(apart) if r["disposition"] == kind] for name, kind in (("accepted_late", "late"), ("dropped", "dropped"), ("unassigned", "unassigned"))}
    return {"windows": windows, "gaps": gaps} | {f"{name}_event_ids": found for name, found in ids.items()}


def digest(result: dict) -> str:
    return hashlib.sha256(json.dumps(result, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def _timeline(members: list) -> str:
    """A lane per stream; an event is a bar of its duration, at least two units wide."""
    if not members:
        return ""
    lanes = {s: k for k, s in enumerate(sorted({m["stream"] for m in members}))}
    low, high = min(m["t"] for m in members), max(m["t"] + m["duration_ms"] for m in members)
    scale = 800 / max(high - low, 1.0)
    names = "".join(f"<text x='4' y='{30 * k + 20}'>{html.escape(s)}</text>" for s, k in lanes.items())
    bars = "".join(
        f"<rect x='{160 + (m['t'] - low) * scale:.2f}' y='{30 * lanes[m['stream']] + 8}' width='{max(m['duration_ms'] * scale, 2):.2f}' height='16'><title>{html.escape(m['id'])}</title></rect>"
        for m in members
    )
    return f"<svg viewBox='0 0 980 {30 * len(lanes)}' fill-opacity='0.6'>{names}{bars}</svg>"


def render_html(alignment: Alignment, most: int = 1000) -> str:
    """A timeline, and tables of windows with complete and missing streams and of gaps. More than `most` rows of any are refused."""
    windows = sorted(_bounded(alignment.windows, most, "windows"), key=lambda w: w["idx"])
    gaps = sorted(_bounded(alignment.gaps, most, "gaps"))
    members = _bounded(alignment.members.select("id", "stream", "t", "duration_ms").distinct(), most, "events")
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    state = lambda w: "complete" if w["complete"] else "missing " + ", ".join(w["missing_streams"])
    rows = "".join("<tr>" + "".join(map(cell, (w["idx"], w["start_ms"], w["end_ms"], w["n_events"], state(w)))) + "</tr>" for w in windows)
    missed = "".join("<tr>" + "".join(map(cell, g)) + "</tr>" for g in gaps)
    timeline = _timeline(sorted(members, key=lambda m: (m["t"], m["stream"], m["id"])))
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Alignment</title>{timeline}<h1>Windows</h1><table>{rows}</table><h1>Gaps</h1><table>{missed}</table>"


def summary(alignment: Alignment) -> dict[str, int]:
    counts = {r["disposition"]: r["count"] for r in alignment.dispositions.groupBy("disposition").count().collect()}
    n = alignment.windows.agg(F.count(F.lit(1)).alias("windows"), F.count_if("complete").alias("complete")).first()
    return counts | n.asDict()
