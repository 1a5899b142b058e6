"""Command line: align, replay, join and sessions over files of events; a demo and a benchmark."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields
from pathlib import Path

from spanweave import demo, report
from spanweave.functions.values import parse_strict
from spanweave.operators import align as A
from spanweave.operators import bandjoin, sessions
from spanweave.schema import AlignConfig, ClockDrift, SpanweaveError, ValidationError
from spanweave.session import build_session
from spanweave.sources import jsonl


def load_config(text: str) -> AlignConfig:
    """A configuration from strict JSON; unknown fields, wrong types and values out of range are validation errors."""
    try:
        given = parse_strict(text)
    except (ValueError, RecursionError) as error:
        raise ValidationError(f"the configuration isn't strict JSON: {error}") from error
    known = {f.name for f in fields(AlignConfig)}
    if not isinstance(given, dict) or given.keys() - known or "window_ms" not in given:
        raise ValidationError(f"a configuration is an object with window_ms, and of other fields only {', '.join(sorted(known))}")
    streams = given.get("required_streams", [])
    if not isinstance(streams, list) or not all(isinstance(given.get(name, {}), dict) for name in ("offsets_ms", "clock_drifts", "expected_cadence_ms")):
        raise ValidationError("required_streams must be a list, and offsets_ms, clock_drifts and expected_cadence_ms objects")
    drifts = {}
    for stream, drift in given.get("clock_drifts", {}).items():
        if not isinstance(drift, dict) or drift.keys() != {f.name for f in fields(ClockDrift)}:
            raise ValidationError(f"the drift of {stream} must have offset_ms, rate_ppm and epoch_ms")
        drifts[stream] = ClockDrift(**drift)
    return AlignConfig(**given | {"required_streams": tuple(streams), "clock_drifts": drifts})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanweave")
    parser.add_argument("command", choices=["validate", "align", "replay", "join", "sessions", "demo", "benchmark"])
    parser.add_argument("--config")
    parser.add_argument("--events")
    parser.add_argument("--format", choices=["native", "cloudevents"], default="native")
    parser.add_argument("--output")
    parser.add_argument("--left")
    parser.add_argument("--right")
    parser.add_argument("--tolerance", type=float)
    parser.add_argument("--gap", type=float, default=1000.0)
    parser.add_argument("--count", type=int, default=3000)
    parser.add_argument("--streams", type=int, default=3)
    parser.add_argument("--repeats", type=int, default=5)
    parser.add_argument("--warmups", type=int, default=1)
    args = parser.parse_args(argv)
    spark = build_session()
    try:
        if args.command == "benchmark":
            text = json.dumps(demo.benchmark(spark, args.count, args.streams, args.repeats, args.warmups), indent=2, sort_keys=True)
            print(text)
            if args.output:
                Path(args.output).write_text(text + "\n", encoding="utf-8")
            return 0
        if args.command == "demo":
            folder = Path(args.output)
            folder.mkdir(parents=True)
            (folder / "events.jsonl").write_text(demo.lines(), encoding="utf-8")
            (folder / "config.json").write_text(json.dumps(demo.CONFIG, indent=2) + "\n", encoding="utf-8")
            result = A.replay(demo.events(spark), load_config(json.dumps(demo.CONFIG)), check=True)
            (folder / "alignment.json").write_text(json.dumps(report.document(result), indent=2, sort_keys=True) + "\n", encoding="utf-8")
            (folder / "timeline.html").write_text(report.render_html(result), encoding="utf-8")
            return 0
        events = (jsonl.load_events if args.format == "native" else jsonl.load_cloudevents)(spark, args.events)
        if args.command == "sessions":
            sessions.sessionize(events, args.gap).write.json(args.output)
            return 0
        with open(args.config) as file:
            config = load_config(file.read())
        if args.command == "validate":
            A.check_identity(events)
            print(json.dumps({"events": events.count()}))
            return 0
        result = (A.replay if args.command == "replay" else A.align)(events, config, check=True)
        if args.command == "join":
            bandjoin.join_streams(result, args.left, args.right, args.tolerance, None if args.tolerance is not None else 5_000_000).write.json(args.output)
        else:
            report.write_report(result, args.output)
            print(json.dumps(report.summary(result) | report.write_document(result, args.output)))
        return 0
    except SpanweaveError as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
