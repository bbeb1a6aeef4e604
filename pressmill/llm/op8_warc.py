"""Seekable Zstandard WARC bundles.

Records are grouped into independent Zstandard frames; a bundle is its frames followed by a seek table in a skippable
frame (magic 0x184D2A5E, entries of compressed and uncompressed size, footer magic 0x8F92EAB1). An index maps each
record id to (frame, offset inside the uncompressed frame, length), so that one record is read by decompressing one
frame. Bundles are rows of a Spark table in the shared folder, written and read by Spark's own writers, because
executors share no local folder.

Of records with equal payloads of at least `min_revisit` bytes the one with the smallest page id is the response and
the others are revisits without a body.

Nulls, ties, repeats: null html is an empty payload, null url an empty target; rows repeated with the smallest page id
are all responses; a null page id never leads a group and is a revisit where another row has the same payload. An empty
table gives no bundles. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 4 << 20, 3
DATE = "2024-01-01T00:00:00Z"  # a fixed capture time: the pages carry none
BUNDLE_SCHEMA = "bundle_id string, data binary, record_index array<struct<record_id:string, page_id:bigint, frame:int, offset:bigint, length:bigint>>"
RECORD_SCHEMA = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> tuple[str, bytes]:
    """One WARC/1.1 record as (id, bytes)."""
    rid = record_id(page_id, digest)
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head.append(("X-Payload-Length", str(len(payload))))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
        body = http
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return rid, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of every frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    start = len(data) - 9 - count * width
    if struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, count * width + 9):
        raise ValueError("seek table damaged")
    out, at = [], 0
    for k in range(count):
        c, d = struct.unpack_from("<II", data, start + k * width)
        out.append((at, c, d))
        at += c
    return out


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL)
    frames: list[bytes] = []
    sizes: list[tuple[int, int]] = []
    index: list[dict] = []
    open_frame, held = bytearray(), 0

    def end_frame() -> None:
        nonlocal open_frame, held
        if open_frame:
            frames.append(pack.compress(bytes(open_frame)))
            sizes.append((len(frames[-1]), len(open_frame)))
            held += len(frames[-1])
            open_frame = bytearray()

    def end_bundle() -> pd.DataFrame:
        nonlocal held
        row = pd.DataFrame({"bundle_id": [uuid.uuid4().hex], "data": [b"".join(frames) + seek_table(sizes)], "record_index": [list(index)]})
        frames.clear(), sizes.clear(), index.clear()
        held = 0
        return row

    for pdf in batches:
        for page_id, url, html, first in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["first_id"], strict=True):
            payload = html.encode()
            page_id, first = (None if pd.isna(page_id) else int(page_id)), (None if pd.isna(first) else int(first))
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            rid, record = warc_record(page_id, url, payload, digest, first)
            index.append({"record_id": rid, "page_id": page_id, "frame": len(frames), "offset": len(open_frame), "length": len(record)})
            open_frame += record
            if len(open_frame) >= FRAME_BYTES:
                end_frame()
                if held >= BUNDLE_BYTES:
                    yield end_bundle()
    end_frame()
    if frames:
        yield end_bundle()


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record; checks length and, for a response, the digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    payload = body.partition(b"\r\n\r\n")[2]
    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload digest is wrong")
    page = h.get("X-Page-Id")
    refers = h.get("X-Refers-To-Page")
    return {
        "page_id": int(page) if page else None, "url": h["WARC-Target-URI"], "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None,
    }


def read_record(data: bytes, frame: int, offset: int, length: int) -> dict:
    """Random access: decompress one frame of a bundle and parse the record at the offset."""
    import zstandard

    start, c, d = read_seek_table(data)[frame]
    return parse_record(zstandard.ZstdDecompressor().decompress(data[start : start + c], max_output_size=d)[offset : offset + length])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for pdf in batches:
        for data, index in zip(pdf["data"], pdf["record_index"], strict=True):
            seek, rows, at, frame = read_seek_table(data), [], -1, b""
            for e in index:
                if e["frame"] != at:
                    at = e["frame"]
                    start, c, d = seek[at]
                    frame = unpack.decompress(data[start : start + c], max_output_size=d)
                rows.append(parse_record(frame[e["offset"] : e["offset"] + e["length"]]))
            out = pd.DataFrame(rows)
            out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
            yield out


def write_bundles(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Bundles of all `pages` as a table in the shared folder (bundle_id, data, record_index)."""
    ship(pages.sparkSession)
    p = pages.select("page_id", text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    keyed = p.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("n"))
    lead = keyed.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("k")).where("k > 1")
    again = keyed.join(lead, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()).select("page_id", "digest", "first_id").distinct()
    p = p.withColumn("digest", F.unhex(F.sha1("html")))
    joined = p.alias("p").join(again.alias("a"), F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("p.digest") == F.col("a.digest")), "left")
    return written(joined.select("p.page_id", "p.url", "p.html", "a.first_id").mapInPandas(_bundles, BUNDLE_SCHEMA), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, through their seek tables and indexes."""
    return bundles.select("data", "record_index").mapInPandas(_records, RECORD_SCHEMA)


def query(spark, sf_dir):
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has no base32, so the digest is spelled out from the hex SHA-1: 32 groups of five bits, eight in ten hex digits.
ORACLE_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""
