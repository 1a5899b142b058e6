import base64
import hashlib
import tempfile

import pytest

from spanweave.llm import warc as W


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_by_declared_lengths(version):
    records = [("http://a.b/x y", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\n\nhttp://fake 0 0 t 3\nabc"), ("dns:a.b", "1.2.3.4", "20200102030405", "text/dns", b""), ("http://é/", "-", "2020", "x/y", bytes(range(256)))]
    got = list(W.parse_arc(W.arc_bytes("t.arc", records, version)))
    assert [b for _, _, b in got] == [r[4] for r in records]
    assert got[0][1]["URL"] == "http://a.b/x%20y" and len(got[0][1]) == len(W.ARC_FIELDS[version].split())
    made = [W.convert_record("t.arc", *g) for g in got]
    assert [m["type"] for m in made] == ["response", "resource", "resource"]
    assert made[0]["date"] == "2020-01-02T03:04:05Z" and made[2]["date"].startswith("2020-00")
    assert len({m["record_id"] for m in made}) == 3
    with pytest.raises(ValueError):
        list(W.parse_arc(W.arc_bytes("t.arc", records, version)[:-200]))


def test_any_bytes_survive_the_archive(spark):
    payload = bytes(range(256)) + b"\r\n\r\nWARC/1.1\r\n"
    arc = W.arc_bytes("t.arc", [("http://a/", "-", "20200102030405", "x/y", payload), ("http://b/", "-", "20200102030405", "x/y", b"")])
    records = W.convert_arc(spark.createDataFrame([("t.arc", bytearray(arc))], "path string, content binary"))
    path = tempfile.mkdtemp() + "/w"
    W.write_warc(W.mark_revisits(records), path)
    got = {r.uri: r for r in W.read_warc(spark, path).collect()}
    assert bytes(got["http://a/"].payload) == payload and bytes(got["http://b/"].payload) == b""


def test_round_trip(spark):
    rows = [(1, "u", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "u v", "<p>é</p>"), (4, "u", None), (2, "u", ""), (6, "u", "\r\n\r\n" * 9), (7, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (8, "u", "lone"), (8, "u", "lone")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, refers_to int")
    got = sorted(W.warc_round_trip(pages).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == len(rows)
    of = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        data = of[r.page_id]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    refers = {r.page_id: r.refers_to for r in got}
    assert refers == {1: None, 2: None, 3: 1, 4: 2, 5: 1, 6: None, 7: None, 8: None, None: None}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)


def test_empty_table(spark):
    assert W.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
