import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from pressmill.llm import op1_gif, op2_sharding, op6_packing, op8_warc
from tests.llm.util import awkward, awkward_texts


# --- 1: GIF ---------------------------------------------------------------------------
@pytest.mark.parametrize("data,size", [(b"a" * 64, 8), (bytes(range(256)) * 40, 8), (random.Random(1).randbytes(30_000), 8), (b"abcabcab" * 4000, 8), (bytes(random.Random(2).choices(range(4), k=9000)), 2), (b"\x01", 2)])
def test_lzw_round_trip(data, size):
    assert op1_gif.lzw_decode(op1_gif.lzw_encode(data, size), size, len(data)) == data


def test_lzw_decodes_a_known_stream():
    # Ten red, white and blue pixels as the GIF specification's usual example has them.
    assert list(op1_gif.lzw_decode(bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01]), 2, 100))[:10] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2]


def _gif(frames, size=(4, 4)):
    """frames: (indexes h x w, left, top, disposal, clear index or None, delay, interlaced)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x91, 0, 0), palette]
    for pixels, left, top, disposal, clear, delay, interlaced in frames:
        h, w = len(pixels), len(pixels[0])
        rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)] if interlaced else range(h)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0), b"\x2c", struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0), b"\x02"]
        stream = op1_gif.lzw_encode(bytes(v for r in rows for v in pixels[r]), 2)
        out += [bytes([len(stream)]), stream, b"\x00"]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_interlace_and_time():
    full = [[1] * 4 for _ in range(4)]
    patch = [[2, 3], [3, 2]]
    mixed = [[k % 4] * 4 for k in range(4)]
    frames = list(op1_gif.decode_gif(_gif([(full, 0, 0, 1, None, 5, False), (patch, 1, 1, 3, 3, 7, False), (patch, 0, 0, 2, None, 2, False), (mixed, 0, 0, 0, 0, 1, True)])))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert [f["start_ms"] for f in frames] == [0, 50, 120, 140] and [f["delay_ms"] for f in frames] == [50, 70, 20, 10]
    assert frames[1]["canvas"][1, 1].tolist() == green and frames[1]["canvas"][1, 2].tolist() == red  # index 3 is clear there
    assert frames[2]["canvas"][1, 1].tolist() == green and frames[2]["canvas"][0, 1].tolist() == blue and frames[2]["canvas"][2, 2].tolist() == red  # the patch before was taken back
    assert frames[3]["canvas"][0, 0].tolist() == [0, 0, 0, 0] and frames[3]["canvas"][1, 0].tolist() == red  # background, then interlaced rows
    assert op1_gif.histogram(frames[0]["canvas"]).sum() == 16


def test_gif_frames_and_payloads(spark):
    media = spark.createDataFrame([(1, _gif([([[1] * 4] * 4, 0, 0, 1, None, 5, False)] * 2), 9), (2, None, 9)], "media_id bigint, gif binary, frame int")
    got = op1_gif.gif_frames(media).orderBy("frame").collect()
    assert [(r.media_id, r.frame, r.start_ms) for r in got] == [(1, 0, 0), (1, 1, 50)] and sum(got[0].hist) == 16
    rows = op1_gif.texts_as_gifs(awkward(spark)).mapInPandas(op1_gif._describe_batch, op1_gif.FEATURES).collect()
    want = sorted((hashlib.sha256(op1_gif.padded((t or "").encode())).hexdigest(), len((t or "").encode())) for _, t in awkward_texts())
    assert sorted((r.payload_sha256, r.n_bytes) for r in rows) == want
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows) and max(r.n_frames for r in rows) > 1
    assert op1_gif.texts_as_gifs(awkward(spark, [])).count() == 0


# --- 2: sharding ----------------------------------------------------------------------
def _brute(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_minimax_capacity_is_the_smallest(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 500) if rng.random() < 0.97 else rng.randint(500, 9000) for _ in range(rng.randint(5, 3000))]
    shards = rng.randint(2, 12)
    ends = np.cumsum(sizes).tolist()
    known = [0, *sorted({*rng.sample(ends, min(len(ends), 15)), ends[-1]})]
    atomic = {e for k, e in enumerate(ends) if e in known and (ends[k - 1] if k else 0) in known}

    def finer(intervals):
        inside = [e for e in ends if any(a < e <= b for a, b in intervals)]
        share = -(-len(inside) // 50)
        got = {e for e in inside if share == 1 or e * 2654435761 % share == 0}
        return got, (got if share == 1 else set())

    capacity, cuts = op2_sharding.minimax_cuts(known, atomic, shards, max(sizes), finer)
    assert capacity == _brute(sizes, shards)
    edges = [0, *cuts]
    assert all(b - a <= capacity for a, b in zip(edges, edges[1:], strict=False)) and set(cuts) <= set(ends) and cuts[-1] == ends[-1]


def test_sharding_contract(spark):
    rows = awkward_texts() + [(1000 + k, "the same line of text") for k in range(300)]
    got = op2_sharding.shard_documents(awkward(spark, rows), shards=5).collect()
    assert len(got) == len(rows)
    by_shard, by_text = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert set(by_shard) <= set(range(5)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert all(len(v) == 1 for v in by_text.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert op2_sharding.shard_documents(awkward(spark, [])).count() == 0


# --- 6: packing -----------------------------------------------------------------------
@pytest.mark.parametrize("total", [1, 2, 63, 64, 65, 100, 1000, 1366, 2047, 2048, 2049, 3000, 4095, 4096, 4097, 123_457])
def test_cuts_cover_and_fill(total):
    cut = op6_packing.cut_lengths(total)
    assert sum(cut) == total and all(0 < c <= 4096 and 4096 - (4096 // c) * c <= op6_packing.TOLERANCE for c in cut)


def test_word_cache_encodes_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    with open(op6_packing.default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    plain, cached = Tokenizer.from_str(definition), op6_packing.WordTokens(definition)
    texts = [t or "" for _, t in awkward_texts()] + ["It's We'LL don't, é ́x ÀÉ, Straße ΣΑΣ. İx 12,5 a b\tc  d\r\n!!, ok?! x\x01y \x01", "…—’ ñandú, año."]
    for text, ids in zip(texts * 2, cached.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:50]


def test_packing_contract(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(op6_packing.default_tokenizer())
    rows = awkward_texts()
    got = op6_packing.pack(op6_packing.pieces(awkward(spark, rows), with_ids=True), fill=1).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 4096
    want = sorted(plain.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows if d is not None and d != 8)
    docs = {}
    for r in sorted((r for r in got if r.doc_id is not None and r.doc_id != 8), key=lambda r: r.start):
        docs.setdefault(r.doc_id, []).extend(r.ids)
    assert sorted(docs.values()) == want
    assert sum(r.length for r in got) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert op6_packing.pack(op6_packing.pieces(awkward(spark, []), with_ids=False)).count() == 0


# --- 8: WARC --------------------------------------------------------------------------
def test_warc_contract_and_random_access(spark):
    html = {1: "<p>a</p>", 2: None, 3: "<p>a</p>", 4: "", 5: "x" * 400_000, 6: "<p>a</p>", 7: "ü"}
    rows = [(k, f"http://h/{k}", h, 5) for k, h in html.items()] + [(1, "http://h/1", "<p>a</p>", 5), (None, None, "<p>a</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    bundles = op8_warc.write_bundles(pages)
    got = op8_warc.read_bundles(bundles).collect()
    assert len(got) == len(rows)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), 5: ("response", None), 6: ("revisit", 1), 7: ("response", None), None: ("revisit", 1)}
    for r in got:
        raw = (html[r.page_id or 1] or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    b = max(bundles.collect(), key=lambda r: len(r.record_index))
    for e in b.record_index:
        record = op8_warc.read_record(bytes(b.data), e.frame, e.offset, e.length)
        assert record["page_id"] == e.page_id and op8_warc.record_id(e.page_id, record["payload_digest"]) == e.record_id
    smaller = {r.page_id: r.record_type for r in op8_warc.read_bundles(op8_warc.write_bundles(pages, min_revisit=1)).collect()}
    assert smaller[4] == "response" and smaller[3] == "revisit"
    assert op8_warc.read_bundles(op8_warc.write_bundles(pages.where("false"))).count() == 0


def test_frames_decompress_with_a_plain_reader(spark):
    import zstandard

    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 9000) for k in range(9)], "page_id bigint, url string, html string").coalesce(1)
    b = op8_warc.write_bundles(pages).first()
    frames = op8_warc.read_seek_table(bytes(b.data))
    assert len(frames) > 1
    whole = b"".join(zstandard.ZstdDecompressor().decompress(bytes(b.data)[s : s + c], max_output_size=d) for s, c, d in frames)
    assert whole.count(b"WARC/1.1\r\n") == 9


def test_token_ids_are_the_tokenisers_own():
    """Added tokens, letters whose lower case is no letter, marks, digits, white space of all kinds, other scripts."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    definition = open(op6_packing.default_tokenizer(), encoding="utf-8").read()
    own, whole = op6_packing.WordTokens(definition), Tokenizer.from_str(definition)
    rng = random.Random(3)
    letters = "aZ é'ßİ.́²1_<|>\n\t漢-,ÀſĿ"
    texts = ["<|startoftext|> a<|endoftext|>b <|endoftext|>", "İ. İ x", "a\tb c", "it's 's' don't, x'", "²³ 12.5 a1b2", "ǅ ß ẞ ΑΣ ΑΣ.", "é ́a", "\x00\x01 \x1f", "漢字。 かな", "...!!! ,", "", " ", "\n\n", "a_b _ __a", "A" * 500]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert own.by_words
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_another_tokeniser_is_used_whole():
    import json

    definition = json.loads(open(op6_packing.default_tokenizer(), encoding="utf-8").read())
    definition["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[^x]+|x"}
    assert not op6_packing.WordTokens(json.dumps(definition)).by_words


def test_packing_of_many_equal_small_pieces(spark):
    """A class with far more pieces than a worker takes goes through several rounds; nothing overlaps or gets lost."""
    from pyspark.sql import functions as F

    n = 60_000
    cut = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("start"), F.when(F.col("id") % 3 == 0, 1).otherwise(300).cast("bigint").alias("length"))
    got = op6_packing.pack(cut, fill=2).groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("n"), F.count_distinct("offset").alias("places"), F.max(F.col("offset") + F.col("length")).alias("end"))
    rows = got.collect()
    assert sum(r.n for r in rows) == n and all(r.n == r.places and r.used == r.end <= 4096 for r in rows)
    assert len(rows) <= 1.02 * (20_000 / 4096 + 40_000 / 13) + 2


def test_cuts_are_even_under_the_smallest_capacity():
    rng = random.Random(9)
    for _ in range(400):
        sizes = [rng.choice([1, 2, 3, 5, 8, 40]) for _ in range(rng.randint(1, 120))]
        known, shards = [0], rng.randint(1, 12)
        for n in sizes:
            known.append(known[-1] + n)
        capacity, cuts = op2_sharding.minimax_cuts(known, set(known), shards, max(sizes), lambda intervals: (set(), set()))
        parts = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
        assert len(cuts) == shards and cuts[-1] == known[-1] and set(cuts) <= set(known) and max(parts) <= capacity
        assert op2_sharding._strict(known, shards, capacity) and not (capacity > max(sizes) and op2_sharding._strict(known, shards, capacity - 1))
        if len(sizes) >= 3 * shards:
            assert min(parts) > 0, (sizes, shards, cuts)


def test_warc_query_equals_its_sql(spark):
    import glob
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{glob.glob(folder + '/pages.parquet*')[0]}')")
    want = con.sql(op8_warc.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, op8_warc.query(spark, folder).collect()), key=str) == sorted(want, key=str) and len(want) > 0
