"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length r belongs to class m = capacity // r, so m pieces of its class fill one sequence. Documents are cut so
that pieces come close to capacity / m from below (`cut_lengths`), which leaves at most TOLERANCE tokens of padding in a
full sequence. The pieces of a class are dealt over workers, about FILL sequences to each, and each worker fills its own
sequences, m pieces to each, without knowing of the others. What remains of a class (fewer than m pieces a worker) is
dealt again over fewer workers, until one is left. The last pieces of all classes, a number bounded by the capacity alone,
are placed first-fit.

Nulls, empties, ties: a null or empty text is its end token alone; rows repeated in full are packed as often as they
come; a null id stays null; an empty table gives no pieces. Extra columns are dropped.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty, written

CAPACITY, TOLERANCE, END_ID, FILL = 4096, 64, 2, 64
CACHE_ENTRIES = 400_000  # per Python worker and generation: when full, the older of two generations goes


def cut_lengths(total: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[int]:
    """Piece lengths of a document, in order; they depend on its length alone."""
    out = [capacity] * (total // capacity)
    left = total % capacity
    while left:
        m = capacity // left
        take = left if capacity - m * left <= tolerance else capacity // (m + 1)
        out.append(take)
        left -= take
    return out


# The parts of a tokeniser definition for which a text's ids are the ids of its space-parted words in order,
# runs of letters are one pre-token, and ASCII stands for itself.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII but the apostrophe, which begins contractions


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _by_words(definition: str) -> bool:
    parts = json.loads(definition)
    before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        (parts["normalizer"] or {}).get("normalizers") == _NORMALIZER
        and [x["type"] for x in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": _SPLIT}
        and before[0]["invert"] and before[0]["behavior"] == "Removed" and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        and parts["post_processor"] is None
        and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["content"].rstrip(_MARKS).isalpha() for t in parts["added_tokens"])
    )


class WordTokens:
    """Token ids of texts as little-endian bytes, equal to the tokeniser's own.

    Where its pre-tokeniser never joins across a space or line feed (`_by_words`), what a word encodes to is kept in a
    bounded cache; Latin letters with or without marks behind them go to the model at once, any other word through the whole
    tokeniser. With any other tokeniser every text goes through it whole."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_words = _by_words(definition)
        self.model = self.tokenizer.model
        self.bytes = _byte_characters()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, pre_token: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(pre_token)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _latin(self, core: str) -> str | None:
        """What the model is given for a run of Latin letters; None for anything that may not be one pre-token."""
        if core.isascii():
            return core.lower() if core.isalpha() else None
        plain = self.tokenizer.normalizer.normalize_str(core)
        return plain.encode().decode("latin-1").translate(self.bytes) if plain.isalpha() and max(plain) < "\u0250" else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        if len(self.words) > CACHE_ENTRIES:
            self.older, self.words = self.words, {}
        older, words, rest = self.older, self.words, []
        for word in missing:
            known = older.get(word)
            if known is None:
                core = word.rstrip(_MARKS)
                letters = self._latin(core) if core else ""
                if letters is None:
                    rest.append(word)
                    continue
                known = (self._piece(letters) if core else b"") + (self._piece(word[len(core) :]) if len(core) < len(word) else b"")
            words[word] = known
        for k in range(0, len(rest), 2000):
            words.update(zip(rest[k : k + 2000], self._whole(rest[k : k + 2000]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_words:
            yield from self._whole(texts)
            return
        split = [t.replace("\n", " ").split(" ") for t in texts]
        own: set[str] = set()
        for s in split:
            own.update(s)
        missing = own.difference(self.words)
        if missing:
            if len(self.words) > CACHE_ENTRIES:
                missing = own  # a new generation begins
            self._learn(missing)
        find = self.words.__getitem__
        for s in split:
            yield b"".join(map(find, s))


_TOKENISERS: dict[int, WordTokens] = {}


def tokeniser(definition: str) -> WordTokens:
    key = zlib.crc32(definition.encode())
    if key not in _TOKENISERS:
        _TOKENISERS[key] = WordTokens(definition)
    return _TOKENISERS[key]


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _piece_batches(definition, capacity: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokeniser(definition.value)
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part, rows = pdf.iloc[k : k + 256], []
                for doc_id, ids in zip(part["doc_id"], tokens.encode(part["text"].tolist()), strict=True):
                    ids += end
                    start, total = 0, len(ids) // 4
                    for length in cut_lengths(total, capacity):
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, start, length, zlib.crc32(own), total)
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
                        start += length
                names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Tokenised documents cut into pieces; `ids` has each piece's tokens unless with_ids is off."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB whatever the corpus
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(_piece_batches(definition, capacity, with_ids), schema)


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        room: list[int] = []
        sequence, offset = [], []
        low = 0
        for length in pdf["length"]:
            k = next((k for k in range(low, len(room)) if room[k] >= length), len(room))
            if k == len(room):
                room.append(capacity)
            sequence.append(k)
            offset.append(capacity - room[k])
            room[k] -= length
            while low < len(room) and not room[low]:
                low += 1
        return pdf.drop(columns="one").assign(sequence_id=sequence, offset=offset)

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, fill: int = FILL) -> DataFrame:
    """`cut` with sequence_id and offset. fill: about how many sequences a worker fills."""
    names = cut.columns
    # The row's own number spreads rows whose id and place are the same, or null, over workers.
    rest = written(cut.withColumns({"m": F.expr(f"{capacity} div length"), "row": F.monotonically_increasing_id()}), "pieces")
    order, placed, level = ["doc_id", "start", "row"], [], 0
    while True:
        counts = {r.m: r.n for r in rest.groupBy("m").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
        workers = {m: n // (fill * m) for m, n in counts.items() if n >= 2 * fill * m}
        of_class = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in workers.items() for x in pair]), F.col("m")), F.lit(1)) if workers else F.lit(1)
        dealt = rest.withColumn("worker", F.pmod(F.xxhash64("doc_id", "start", "row", F.lit(level)), of_class).cast("long"))
        own = Window.partitionBy("m", "worker")
        dealt = dealt.withColumns({"k": F.row_number().over(own.orderBy(*order)) - 1, "n": F.count("*").over(own)}).withColumn("bin", F.expr("k div m"))
        before = F.sum("length").over(Window.partitionBy("m", "worker", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        dealt = written(dealt.withColumn("offset", F.coalesce(before, F.lit(0))), "packed")
        whole = F.col("k") < F.col("n") - F.col("n") % F.col("m")
        # 13 bits of class, 3 of level, 34 of worker, 12 of its sequence: unique without any count over all workers.
        number = F.shiftleft("m", 49) + F.lit(level << 46) + F.shiftleft("worker", 12) + F.col("bin")
        placed.append(dealt.where(whole).select(*names, number.alias("sequence_id"), "offset"))
        rest, level = dealt.where(~whole).select(*names, "m", "row"), level + 1
        if not workers:
            break
    # Fewer than m pieces of each class m are left: about capacity * (ln tolerance + 1) rows at most, whatever the corpus.
    placed.append(rest.select(*names, F.lit(0).alias("one")).groupBy("one").applyInPandas(_first_fit(capacity), cut.schema.add("sequence_id", "long").add("offset", "long")))
    return reduce(DataFrame.unionByName, placed)


def query(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents"), with_ids=False)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
