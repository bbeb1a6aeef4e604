"""GIF media columns: payloads stored as GIF89a frames, LZW code streams decoded, frames composed and described.

`encode` stores a payload losslessly: one byte is one pixel of a 64-pixel-wide grey image, cut into frames of at most
1024 rows that are shown one after another. `decode_gif` reads any GIF89a/87a stream: LZW code streams of every minimum
code size, global and local palettes, interlace, disposal 0-3, transparency and delays. `gif_frames` explodes a column
of GIFs into timed frames with composed RGB canvases and colour-histogram columns.

Nulls and edges: a null or empty text is the payload of 64 zero bytes; long texts give more frames, none is cut; equal
texts give equal media. A null GIF gives no frames, a broken one raises. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty, written

WIDTH, ROWS, DELAY_CS = 64, 1024, 4
GREYS = bytes(v for g in range(256) for v in (g, g, g))


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % 64 or (0 if payload else 64))


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """Variable-width LZW as GIF has it: clear code first, widths grow with the table, a new clear when 4096 entries are full."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    runs: list[list[int]] = []
    table: dict[int, int] = {}
    find, codes, nxt = table.get, [clear], end + 1
    put = codes.append
    prefix = data[0]
    for byte in data[1:]:
        key = prefix << 8 | byte
        known = find(key)
        if known is not None:
            prefix = known
            continue
        put(prefix)
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
        else:
            runs.append(codes)
            codes, nxt = [clear], end + 1
            put = codes.append
            table.clear()
        prefix = byte
    put(prefix)
    put(end)
    runs.append(codes)
    # In a run the width of a code depends on its place alone: after the clear, code k is written when k-1 entries are known.
    widths = [_widths(len(run), min_size) for run in runs]
    for k in range(1, len(runs)):
        widths[k] = widths[k].copy()
        widths[k][0] = _width_after(len(runs[k - 1]), min_size)
    return _packed(np.concatenate([np.array(run, np.int64) for run in runs]), np.concatenate(widths))


def _width_after(count: int, min_size: int) -> int:
    """Width of the code that follows `count` codes of a run (its clear included)."""
    size = (1 << min_size) + 2 + max(0, count - 2)
    return min(12, max(min_size + 1, int(size).bit_length()))


_WIDTHS: dict[int, np.ndarray] = {}


def _widths(count: int, min_size: int) -> np.ndarray:
    if min_size not in _WIDTHS:
        _WIDTHS[min_size] = np.array([min_size + 1] + [_width_after(k, min_size) for k in range(1, 5000)], np.int64)
    full = _WIDTHS[min_size]
    return full[:count] if count <= len(full) else np.concatenate([full, np.full(count - len(full), 12)])


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as a little-endian bit stream: each touches three bytes at most, and its bits are its own."""
    ends = np.cumsum(widths)
    starts = ends - widths
    held, place, size = codes << (starts & 7), starts >> 3, (int(ends[-1]) + 7) // 8 + 2
    total = np.zeros(size)
    for k in range(3):
        total += np.bincount(place + k, (held >> 8 * k) & 255, size)
    return total.astype(np.uint8)[: (int(ends[-1]) + 7) // 8].tobytes()


def _expanded(codes: list[int], clear: int) -> bytes:
    """The bytes of one run of codes. Table entry k is code k and the first byte of code k+1, which lie side by side in the
    output, so each byte of a table code is a copy of a known earlier byte; chains of copies are halved until they end."""
    c = np.array(codes, np.int32)
    n = len(c)
    if not n:
        return b""
    entry = c - (clear + 2)
    copies = c >= clear
    if (copies & ((entry < 0) | (entry >= np.arange(n)))).any():
        raise ValueError("LZW code out of range")
    sizes, up = np.ones(n + 1, np.int32), np.where(copies, entry, n).astype(np.int32)
    sizes[n], up = 0, np.append(up, n)
    while (up != n).any():
        sizes += sizes[up]
        up = up[up]
    sizes = sizes[:n]
    begins = np.cumsum(sizes, dtype=np.int32) - sizes
    back = np.where(copies, begins - begins[np.where(copies, entry, 0)], 0)
    source = np.arange(int(begins[-1] + sizes[-1]), dtype=np.int32) - np.repeat(back, sizes)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    flat = np.zeros(len(source), np.uint8)
    flat[begins[~copies]] = c[~copies]
    return flat[source].tobytes()


def lzw_decode(data: bytes, min_size: int, pixels: int) -> bytes:
    """The index stream of one image."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    out, at, total = bytearray(), 0, len(data) * 8
    first = True
    while at < total and len(out) < pixels:
        # One run: up to the next clear or end code; the places of its codes follow from their number.
        if first:
            code = int(words[at >> 3]) >> (at & 7) & (1 << min_size + 1) - 1
            if code == clear:
                at += min_size + 1
            first = False
        span, stop = 4200, None
        done: list[int] = []
        while stop is None:
            widths = _widths(len(done) + span + 1, min_size)[1 + len(done) :]
            starts = at + np.concatenate([[0], np.cumsum(widths)[:-1]])
            fit = int(np.searchsorted(starts + widths, total, side="right"))
            starts, widths = starts[:fit], widths[:fit]
            if not fit:
                stop, at = "end", total
                break
            codes = words[starts >> 3] >> (starts & 7) & (1 << widths) - 1
            marks = np.flatnonzero((codes == clear) | (codes == end))
            if len(marks):
                k = int(marks[0])
                done += codes[:k].tolist()
                stop, at = ("clear" if codes[k] == clear else "end"), int(starts[k] + widths[k])
            else:
                done += codes.tolist()
                at = int(starts[-1] + widths[-1])
                if fit < span:
                    stop = "end"
        out += _expanded(done, clear)
        if stop == "end":
            break
    if len(out) < pixels:
        raise ValueError("LZW stream ends early")
    return bytes(out[:pixels])


def encode(payload: bytes) -> bytes:
    """GIF89a of a payload whose length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREYS]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        parts += [b"\x21\xf9\x04\x04", struct.pack("<HBB", DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        stream = lzw_encode(part)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\x00")
    return b"".join([*parts, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    got = []
    while n := data[at]:
        got.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(got), at + 1


def decode_gif(data: bytes) -> Iterator[dict]:
    """Frames in order: indexes as stored, the composed RGBA canvas, when it starts and for how long it shows."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear, number, clock = 0, 0, None, 0, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = bits >> 2 & 7, (index if bits & 1 else None)
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at, colours = at + 10, palette
        if local & 0x80:
            n = 3 << ((local & 7) + 1)
            colours, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        indexes = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8).reshape(h, w)
        if local & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            straight = np.empty_like(indexes)
            straight[order] = indexes
            indexes = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[y : y + h, x : x + w]
        seen = indexes[: area.shape[0], : area.shape[1]]
        painted = np.empty((*seen.shape, 4), np.uint8)
        painted[..., :3], painted[..., 3] = colours[seen], 255
        if clear is None:
            area[:] = painted
        else:
            area[seen != clear] = painted[seen != clear]
        yield {"frame": number, "start_ms": clock * 10, "delay_ms": delay * 10, "disposal": disposal, "left": x, "top": y, "width": w, "height": h, "indexes": indexes, "canvas": canvas.copy()}
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        number, clock = number + 1, clock + delay
        delay, disposal, clear = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of the visible pixels in bins**3 colour cells."""
    rgb = canvas[canvas[..., 3] > 0][:, :3].astype(np.int32) * bins // 256
    return np.bincount((rgb[:, 0] * bins + rgb[:, 1]) * bins + rgb[:, 2], minlength=bins**3)


FRAME_SCHEMA = "media_id bigint, frame int, start_ms int, delay_ms int, disposal int, width int, height int, rgba binary, hist array<bigint>"


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for media_id, gif in zip(pdf["media_id"], pdf["gif"], strict=True):
            if gif is None:
                continue
            for f in decode_gif(gif):
                h, w, _ = f["canvas"].shape
                row = {"media_id": media_id, "width": w, "height": h, "rgba": f["canvas"].tobytes(), "hist": histogram(f["canvas"]).tolist()}
                yield pd.DataFrame([row | {k: f[k] for k in ("frame", "start_ms", "delay_ms", "disposal")}])[[c.split()[0] for c in FRAME_SCHEMA.split(", ")]]


def gif_frames(media: DataFrame, id_col: str = "media_id", gif_col: str = "gif") -> DataFrame:
    """One row per frame of every GIF."""
    ship(media.sparkSession)
    return media.select(F.col(id_col).cast("bigint").alias("media_id"), F.col(gif_col).alias("gif")).mapInPandas(_frames, FRAME_SCHEMA)


def _encode_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = [t.encode() for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(r) for r in raw], "gif": [encode(padded(r)) for r in raw]})


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames int, hist array<bigint>"


def _describe_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, n, gif in zip(pdf["doc_id"], pdf["n_bytes"], pdf["gif"], strict=True):
            pixels, hist, frames, shown = [], np.zeros(64, np.int64), 0, 0
            for f in decode_gif(gif):
                pixels.append(f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"], 0].tobytes())
                hist += np.bincount((np.frombuffer(pixels[-1], np.uint8) >> 6).astype(np.int64) * 21, minlength=64)
                frames, shown = frames + 1, shown + f["delay_ms"]
            payload = b"".join(pixels)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), f"frames={frames};ms={shown};hist={','.join(map(str, hist[[0, 21, 42, 63]]))}", frames, hist.tolist()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])
        yield out.assign(doc_id=out["doc_id"].astype("Int64"))


def texts_as_gifs(docs: DataFrame) -> DataFrame:
    """The stored form: (doc_id, n_bytes, gif), as a table in the shared folder."""
    ship(docs.sparkSession)
    return written(docs.select("doc_id", text_or_empty("text").alias("text")).mapInPandas(_encode_batch, "doc_id bigint, n_bytes bigint, gif binary"), "gif")


def query(spark, sf_dir):
    return texts_as_gifs(table(spark, sf_dir, "documents")).mapInPandas(_describe_batch, FEATURES)
