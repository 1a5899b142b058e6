"""Legacy archive converter: ARC files, versions 1 and 2, to WARC records, and reading and writing of WARC archives.

An ARC file opens with a version block that names the fields of all later header lines; each record is a header line of
those fields, the last of them the declared length, then as many bytes and a line feed. The converter follows declared
lengths only, never separators, and synthesises what ARC lacks: record identifiers (a UUID of the archive's name and the
record's place, or of the key that the record itself carries), ISO timestamps, record types and SHA-1 digests in base32.

Archives are written by Spark's text writer, one record a row with the record separator as line end, so they reach any file
system that Spark does; maxRecordsPerFile bounds an archive, and one archive is parsed in one task. Null payloads are empty;
null keys have no smaller key and are matched only to each other; a table without rows makes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import shared_dir

# The field lists of ARC version blocks and the identifiers of WARC 1.1.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_FIELD, REFERS_FIELD = "X-Record-Key", "X-Refers-To-Key"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "spanweave:warc")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


# -- ARC -----------------------------------------------------------------------------------------------------------


def arc_bytes(name: str, records: list[tuple[str, str, str, str, bytes]], version: str = "1") -> bytes:
    """An ARC file of records (url, ip, 14-digit date, content type, block)."""
    fields = ARC_FIELDS[version]
    block = f"{version} 0 spanweave\n{fields}\n".encode()
    middle = "" if version == "1" else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain{middle} {len(block)}\n".encode(), block, b"\n"]
    for url, ip, date, kind, body in records:
        extra = "" if version == "1" else f" 200 {digest32(body)} - {sum(map(len, out))} {name}"
        out += [f"{quote(url, safe=_URL_SAFE)} {ip} {date} {kind}{extra} {len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record after the version block, by declared lengths."""
    if not data:
        return
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    head = data[end + 1 : end + 1 + length].decode("latin-1").split("\n")
    if head[0].split(" ")[0] not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version: {head[0]!r}")
    names = head[1].split(" ") if len(head) > 1 and head[1] else ARC_FIELDS[head[0].split(" ")[0]].split(" ")
    at = end + 1 + length
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"ARC header at byte {at} has {len(values)} fields of {len(names)}")
        fields = dict(zip(names, values, strict=True))
        length = int(fields["Archive-length"])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes, {len(block)} are left")
        yield at, fields, block
        at = end + 1 + length


# -- conversion ----------------------------------------------------------------------------------------------------


def convert_record(archive: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    """The WARC equivalent of an ARC record: key, id, type, date, uri, ip, content type, HTTP head, payload and its digest."""
    head, payload = b"", block
    http = block.startswith(b"HTTP/")
    if http and (cut := re.search(rb"\r?\n\r?\n", block)):
        head, payload = block[: cut.end()], block[cut.end() :]
    key = re.search(rf"(?im)^{KEY_FIELD}: *([^\r\n]*)".encode(), head)
    d = fields["Archive-date"].ljust(14, "0")
    return {
        "key": key[1].decode() if key else None,
        "record_id": record_urn(key[1].decode() if key else f"{archive}:{offset}"),
        "type": "response" if http else "resource",
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "uri": fields["URL"],
        "ip": fields["IP-address"],
        "content_type": "application/http; msgtype=response" if http else fields["Content-type"],
        "head": head,
        "payload": payload,
        "payload_bytes": len(payload),
        "digest": digest32(payload),
    }


_RECORDS = "key string, record_id string, type string, date string, uri string, ip string, content_type string, head binary, payload binary, payload_bytes long, digest string"


def convert_arc(archives: DataFrame, part: int = 500) -> DataFrame:
    """WARC record columns of ARC files given as rows (path, content), as spark.read.format("binaryFile") gives them.
    Files whose name ends in .gz are unpacked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for offset, fields, block in parse_arc(gzip.decompress(content) if path.endswith(".gz") else bytes(content)):
                    rows.append(convert_record(path, offset, fields, block))
                    if len(rows) == part:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return archives.select("path", "content").mapInPandas(run, _RECORDS)


def pages_as_arc(pages: DataFrame, version: str = "1", part: int = 500, date: str = "20240101000000", most: int = 1 << 25) -> DataFrame:
    """ARC files (path, content) of up to part pages and about most bytes each (or of one page), HTTP responses whose head
    carries page_id as the record's key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["html"].str.len().to_numpy().cumsum()
            a = 0
            while a < len(pdf):
                b = max(a + 1, min(a + part, int(size.searchsorted(most + (size[a - 1] if a else 0), "right"))))
                some, records = pdf.iloc[a:b], []
                a = b
                for key, url, html in zip(some["page_id"], some["url"], some["html"], strict=True):
                    body = html.encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{KEY_FIELD}: {key}\r\n\r\n"
                    records.append((url, "0.0.0.0", date, "text/html", head.encode() + body))
                yield pd.DataFrame({"path": [f"pages-{some['page_id'].iloc[0]}.arc"], "content": [arc_bytes("pages.arc", records, version)]})

    columns = ("coalesce(CAST(page_id AS STRING), '') AS page_id", "coalesce(url, 'http:///') AS url", "coalesce(html, '') AS html")
    return pages.selectExpr(*columns).mapInPandas(run, "path string, content binary")


def mark_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds refers_to: of records with equal payloads of at least `least` bytes, the smallest integer key, for all others."""
    number = F.expr("TRY_CAST(key AS BIGINT)")
    narrow = records.where(F.col("payload_bytes") >= least).select(number.alias("_number"), "digest", "payload_bytes").where("_number IS NOT NULL")
    first = narrow.groupBy("digest", "payload_bytes").agg(F.min("_number").alias("_first"), F.max("_number").alias("_last")).where("_first < _last").drop("_last")
    later = narrow.join(first, ["digest", "payload_bytes"]).where("_number > _first").select(F.col("_number").cast("string").alias("_key"), F.col("digest").alias("_digest"), F.col("_first").cast("string").alias("refers_to")).distinct()
    return records.join(later, (F.col("key") == F.col("_key")) & (F.col("digest") == F.col("_digest")), "left").drop("_key", "_digest")


# -- WARC ----------------------------------------------------------------------------------------------------------


def warc_record(r: dict) -> bytes:
    """One WARC record without its closing separator. Revisits keep the HTTP head only."""
    revisit = r["refers_to"] is not None
    block = bytes(r["head"]) + (b"" if revisit else bytes(r["payload"]))
    lines = [WARC_VERSION, f"WARC-Type: {'revisit' if revisit else r['type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(r['refers_to'])}", f"{REFERS_FIELD}: {r['refers_to']}"]
    lines += [f"WARC-Block-Digest: sha1:{digest32(block)}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, per_file: int = 5000, compression: str = "gzip", most: int = 1 << 29) -> None:
    """Archives of up to per_file records, and of fewer where records are so long that an archive might exceed most bytes (but
    of one record at least). Reads the largest length first."""
    longest = records.agg(F.max(F.col("payload_bytes"))).first()[0] or 0
    per_file = max(1, min(per_file, most // (longest + 4096)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record": [warc_record(r) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]})

    rows = records.mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} doesn't end where it declares")
        yield fields, block
        at = end + 8 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key, record_type, uri, date, payload_bytes and payload_digest (of the full payload), refers_to (a key) and payload
    (null for revisits) of every record. Digests are verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for f, block in parse_warc(gzip.decompress(content) if path.endswith(".gz") else bytes(content)):
                    if f["warc-block-digest"] != f"sha1:{digest32(block)}":
                        raise ValueError(f"block digest of {f['warc-record-id']} differs")
                    head, payload = b"", block
                    if f["content-type"].startswith("application/http"):
                        cut = re.search(rb"\r?\n\r?\n", block)
                        head, payload = (block[: cut.end()], block[cut.end() :]) if cut else (block, b"")
                    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n"))}
                    revisit, told = f["warc-type"] == "revisit", f["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and told != digest32(payload):
                        raise ValueError(f"payload digest of {f['warc-record-id']} differs")
                    rows.append((named.get(KEY_FIELD.lower()), f["warc-type"], f.get("warc-target-uri"), f["warc-date"], int(named.get("content-length", 0)) if revisit else len(payload), told, f.get(REFERS_FIELD.lower()), None if revisit else payload))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["key", "record_type", "uri", "date", "payload_bytes", "payload_digest", "refers_to", "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, "key string, record_type string, uri string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def warc_round_trip(pages: DataFrame, version: str = "1") -> DataFrame:
    """Pages as ARC files, converted, written as WARC archives in the shared folder, and read back: the contract's columns."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = convert_arc(pages_as_arc(pages, version))
    records.write.option("compression", "zstd").parquet(f"{path}-records")  # converted once, read for the digests and for the records
    write_warc(mark_revisits(spark.read.schema(records.schema).parquet(f"{path}-records")), path)
    number = F.expr("TRY_CAST(key AS BIGINT)").alias("page_id")
    return read_warc(spark, path).select(number, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
