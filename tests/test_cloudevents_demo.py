"""CloudEvents envelopes, the demo's golden result, the benchmark's digest, strict configurations."""

import json
import tempfile

import pytest

from spanweave import cli, demo, report
from spanweave.operators import align as A
from spanweave.schema import ValidationError
from spanweave.sources.cloudevents import cloud_event, event_id, uri_reference

ENVELOPE = {"specversion": "1.0", "id": "frame-1", "source": "urn:camera:front", "type": "org.example.frame", "time": "2026-01-02T03:04:05.250Z"}


def test_envelope_is_kept_as_data():
    more = {"stream": "camera", "durationms": 40, "subject": None, "traceid": "x", "data": {"objects": 3}}
    name, stream, modality, t, duration, data = cloud_event(ENVELOPE | more)
    assert (name, stream, modality) == ("ce:urn%3Acamera%3Afront:frame-1", "camera", "org.example.frame")
    assert (t, duration) == (1767323045250.0, 40.0)
    assert json.loads(data) == {"cloudevent": ENVELOPE, "extensions": {"stream": "camera", "durationms": 40, "traceid": "x"}, "payload": {"objects": 3}}
    assert json.loads(cloud_event(ENVELOPE | {"data": None})[5])["payload"] is None
    assert json.loads(cloud_event(ENVELOPE | {"data_base64": "eA==", "durationms": None})[5])["payload_base64"] == "eA=="
    assert cloud_event(ENVELOPE | {"time": "1969-12-31T23:59:59.9Z"})[3] == -100.0


def test_long_ids_are_hashes_of_the_pair():
    long = event_id("/" + "é" * 1000, "1")
    assert long.startswith("ce-sha256:") and len(long) == 74 and long != event_id("/" + "é" * 1000, "2")


@pytest.mark.parametrize(
    "change",
    [{"time": None}, {"time": "2026-01-02t03:04:05z"}, {"time": "2026-01-02T03:04:05.2501Z"}, {"time": "2026-02-30T00:00:00Z"}, {"id": ""}, {"id": "a\x01"}, {"id": "﷐"}, {"id": "a\U0001ffff"}]
    + [{"id": "x" * 1025}, {"source": "a b"}, {"type": 1}, {"stream": " a"}, {"durationms": 1.0}, {"durationms": True}, {"durationms": -1}, {"durationms": 2**31}, {"Bad": 1}, {"a" * 21: 1}]
    + [{"extra": 1.5}, {"extra": [1]}, {"extra": 2**31}, {"datacontenttype": "json"}, {"dataschema": "/relative"}, {"dataschema": "http://h/a#f"}, {"subject": ""}, {"data": 1, "data_base64": "eA=="}, {"data_base64": "e"}],
)
def test_faulty_envelopes(change):
    with pytest.raises(ValueError):
        cloud_event(ENVELOPE | change)


def test_uri_references():
    for good in ("/a/b", "a/b:c", "urn:x:y", "http://u:p@h:80/a?b#c", "//h", "http://[::1]:8/", "http://[v1.a:b]", "?q", "#f", "mailto:a@b", "a%20b", "file:///x", "http://h:"):
        assert uri_reference(good, "source")[0] == good
    for bad in ("1a:b", ":a", "a b", "a%2", "http://[::1", "http://[::1%25eth0]", "http://[1::2::3]", "http://h:8x", "http://a@b@c", "a#b#c", "é", "//h:1:2", "<a>", "http://[]/"):
        with pytest.raises(ValueError):
            uri_reference(bad, "source")


def test_demo(spark):
    config = cli.load_config(json.dumps(demo.CONFIG))
    for run in (A.align, A.replay):
        result = report.document(run(demo.events(spark), config, check=True))
        assert [[e["id"] for e in w["events"]] for w in result["windows"]] == [["v0", "a0", "t0", "v1", "a1", "t1"], ["v1", "a1", "t1", "v2", "a2"], ["t1", "v2", "a2", "a3", "t2"], ["a3", "t2", "v3"], ["v3"]]
        assert [w["complete"] for w in result["windows"]] == [True] * 4 + [False] and result["windows"][4]["missing_streams"] == ["microphone", "transcript"]
        assert result["gaps"] == [{"stream": "camera", "start_ms": 1500.0, "end_ms": 2000.0, "expected_ms": 500.0, "observed_ms": 1000.0}]
        assert not result["dropped_event_ids"] and not result["accepted_late_event_ids"] and not result["unassigned_event_ids"]
    page = report.render_html(A.align(demo.events(spark), config))
    assert page.count("<rect") == 11 and "microphone" in page


def test_benchmark_has_the_published_digest(spark):
    out = demo.benchmark(spark, 600, repeats=1, warmups=0)
    assert out["equivalent_outputs"] and [m["windows"] for m in out["modes"]] == [20, 20]
    assert out["modes"][0]["output_sha256"] == "933b1f3d572ae2748af4abd83af3d274f81674e34507da58d6b8e91f06bf749f"
    assert demo.nearest_rank([5.0, 1.0, 3.0], 0.5) == 3.0 and demo.nearest_rank([1.0, 2.0], 0.95) == 2.0


@pytest.mark.parametrize("text", ["{", "[]", "{}", '{"window_ms": 1, "more": 2}', '{"window_ms": "1"}', '{"window_ms": 1, "window_ms": 2}', '{"window_ms": 1, "required_streams": "a"}', '{"window_ms": 1, "max_output_windows": 0}', '{"window_ms": 1, "offsets_ms": {"a": null}}', '{"window_ms": 1, "clock_drifts": {"a": {"offset_ms": 1}}}'])
def test_strict_configurations(text):
    with pytest.raises(ValidationError):
        cli.load_config(text)


def test_demo_command(spark, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    folder = tempfile.mkdtemp() + "/demo"
    assert cli.main(["demo", "--output", folder]) == 0
    with open(f"{folder}/alignment.json") as file:
        assert len(json.load(file)["windows"]) == 5
