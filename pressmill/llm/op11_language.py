"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text, once, on the executors. A text is folded to bytes (lower
case, everything of ASCII but letters to one space, UTF-8) and parsed from left to right into the longest phrases that occur
in the language's labelled text; a byte that does not occur there at all is a phrase of its own. A phrase costs log2 of the
labelled text's length, as it is a pointer into it, and the language with the smallest cost a byte wins. Texts are parsed
whole, in blocks of BLOCK bytes: a phrase ends at the end of its block, so that a very long text is as many small units, and
thousands of blocks walk through the automata of all languages in step as numpy arrays.

Fit: at most some 2 * ROWS distinct texts of a language, those with the smallest hash, and of each a stretch of at most
STRETCH characters at a place that the hash chooses; of these the first ROWS. The bounds are parameters. Everything else
runs over all rows.

Nulls, ties, repeats: null text, or text without a letter, is `und` with score 0; so is everything where nothing can be
learned. Equal costs go to the language that sorts first. Copies count once in the fit. A null or empty lang is not learned
from; a null doc_id counts as the empty text in the hash that holds rows out. Rows come back as often as they are given. An
empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, written

ROWS, STRETCH = 100, 300
BLOCK, LANES = 1024, 2048
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MODEL_SCHEMA = "lang string, size bigint, edges binary"
RESULT_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double"


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split())


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def automaton(data: bytes) -> np.ndarray:
    """Edges (from, byte, to) of the suffix automaton of `data`; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in step[at]:
            step[at][byte] = new
            at = link[at]
        if at >= 0:
            to = step[at][byte]
            if length[to] != length[at] + 1:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(byte) == to:
                    step[at][byte] = copy
                    at = link[at]
                link[to] = copy
                to = copy
            link[new] = to
        last = new
    out = np.empty((sum(map(len, step)), 3), dtype=np.int32)
    out[:, 0] = np.repeat(np.arange(len(step)), [len(x) for x in step])
    out[:, 1] = np.fromiter(chain.from_iterable(step), np.int32, len(out))
    out[:, 2] = np.fromiter(chain.from_iterable(x.values() for x in step), np.int32, len(out))
    return out


def labelled_text(rows: pd.DataFrame) -> bytes:
    """The first ROWS stretches by hash, folded, with a byte between them that no folded text holds."""
    return b"\0".join(folded(x) for x in rows.sort_values(["h", "stretch"]).head(ROWS).stretch)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    data = labelled_text(rows)
    return pd.DataFrame({"lang": [rows.lang.iloc[0]], "size": [len(data)], "edges": [automaton(data).tobytes()]})


def held_out(doc_id: str | Column = "doc_id") -> Column:
    as_text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(as_text, F.lit("")).cast("binary")) % 3 == 1


def stretches(docs: DataFrame) -> DataFrame:
    """(lang, h, stretch): the bounded sample that is learned from."""
    learned = docs.where(~held_out() & (F.col("lang") != "") & (F.length("text") > 0)).select("lang", "text")
    # One number for each language, of which the model holds an automaton each anyway.
    counts = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return learned.select("lang", F.lit(0.0).alias("h"), F.col("text").alias("stretch")).limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * ROWS / n))])
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.floor(F.pmod(F.xxhash64(F.lit(7), "text"), F.greatest(F.lit(1), F.length("text") - STRETCH + 1))).cast("int") + 1
    chosen = learned.withColumn("h", h).where(F.col("h") < share[F.col("lang")])
    return chosen.groupBy("lang", "h").agg(F.min(F.substring(F.col("text"), place, F.lit(STRETCH))).alias("stretch"))


def fit(docs: DataFrame) -> DataFrame:
    """(lang, size, edges): one automaton for each language, built by one task each from its bounded sample."""
    ship(docs.sparkSession)
    return written(stretches(docs).groupBy("lang").applyInPandas(_fit, MODEL_SCHEMA), "languages")


class Parser:
    """The automata of all languages as one table of steps.

    Row s, column c holds the row's start after byte c: negative where c begins a new phrase. The last column is padding,
    which goes back to the root and begins none; column 0 stands for bytes that no language has."""

    def __init__(self, models: list[tuple[str, int, bytes]]):
        models = sorted(models)
        self.langs = [lang for lang, _, _ in models]
        self.price = np.array([math.log2(size + 1) for _, size, _ in models])
        edges = [np.frombuffer(x, np.int32).reshape(-1, 3) for _, _, x in models]
        known = np.unique(np.concatenate([[32], *[x[:, 1] for x in edges]]))
        self.code = np.zeros(256, np.uint8)
        known = known[known > 0]
        self.code[known] = np.arange(1, len(known) + 1)
        width = len(known) + 2
        self.pad = width - 1
        states = [int(x[:, 2].max(initial=0)) + 1 for x in edges]
        starts = np.cumsum([1, *states])
        self.step = np.zeros((int(starts[-1]), width), np.int32)
        for x, start, n in zip(edges, starts, states, strict=False):
            x = x[x[:, 1] > 0]
            own = self.step[start : start + n]
            own[x[:, 0], self.code[x[:, 1]]] = (x[:, 2] + start) * width
            own[0, own[0] == 0] = start * width
            anew = -own[0].copy()
            own[:] = np.where(own == 0, anew, own)
            own[0] = anew
            own[:, self.pad] = start * width
        self.roots = (starts[:-1] * width).astype(np.int64)
        self.step = self.step.reshape(-1)

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases of every language (rows) in every column of `blocks` (codes, padded)."""
        state = np.repeat(self.roots[:, None], blocks.shape[1], axis=1)
        count = np.zeros(state.shape, np.int32)
        for codes in blocks:
            to = self.step.take(np.add(state, codes, out=state))
            count += to < 0
            np.abs(to, out=state)
        return count

    def parse(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        whole, owner, tails = [], [], []
        for k, text in enumerate(texts):
            codes = self.code[np.frombuffer(text, np.uint8)]
            full = len(codes) // BLOCK
            whole.append(codes[: full * BLOCK].reshape(-1, BLOCK))
            owner += [k] * full
            if len(codes) > full * BLOCK:
                tails.append((len(codes) - full * BLOCK, k, codes[full * BLOCK :]))
        whole = np.concatenate(whole) if whole else np.zeros((0, BLOCK), np.uint8)
        for at in range(0, len(whole), LANES):
            np.add.at(out, owner[at : at + LANES], self.phrases(np.ascontiguousarray(whole[at : at + LANES].T)).T)
        tails.sort(key=lambda x: x[0])
        for at in range(0, len(tails), LANES):
            some = tails[at : at + LANES]
            blocks = np.full((some[-1][0], len(some)), self.pad, np.uint8)
            for j, (n, _, codes) in enumerate(some):
                blocks[:n, j] = codes
            np.add.at(out, [k for _, k, _ in some], self.phrases(blocks).T)
        return out

    def best(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, share of its code length among all, bits a byte) of every text."""
        bits = self.parse(texts) * self.price
        first = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        return [self.langs[k] for k in first], score, least / [max(1, len(x)) for x in texts]


def identify(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of every row.

    The model is broadcast: its size is bounded by ROWS * STRETCH characters for each language, not by the documents."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast([(r.lang, r.size, bytes(r.edges)) for r in model.collect()])
    made: list[Parser] = []

    def answer(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [folded(x) if has_letter(x) else None for x in part.column("text").to_pylist()]
        at = [k for k, x in enumerate(texts) if x is not None]
        langs, scores, bits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        if at and made:
            best = made[0].best([texts[k] for k in at])
            for k, lang, score, cost in zip(at, *best, strict=True):
                langs[k], scores[k], bits[k] = lang, score, float(cost)
        columns = [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array(bits, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value and not made:
            made.append(Parser(shared.value))
        for batch in batches:
            start, size = 0, 0
            for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), 1):
                size += n + 100
                if size >= 2 * BLOCK * LANES or k == batch.num_rows:
                    yield answer(batch.slice(start, k - start))
                    start, size = k, 0

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, RESULT_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
