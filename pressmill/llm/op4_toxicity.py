"""Toxicity by multiple-instance learning: a document is a bag of sentences, and is toxic if any sentence is.

A sentence's probability is logistic in its words (each word, and its first four and five letters, so that inflected
forms share what was learned). The document's probability is the noisy-or of its sentences. Only document labels are
used; the gradient of their likelihood through the noisy-or spreads blame over sentences, so the trained sentence scores
locate what offends.

Fitting uses a bounded sample: at most PER_CLASS labelled documents of each label, taken in the order of a hash of their
id among those outside the held-out fold, without those of more than CHARS_FITTED characters, and reweighted to the label
counts of all labelled documents. Scoring reads every whole text.

Nulls, empties, ties: a null or empty text is one empty sentence and scores the base rate; a null label is no label; of
repeated labels of one document the highest counts; of texts that share an id the first in order is fitted on; repeated
documents get equal scores; without any usable label every score is 0, and where all labels are alike it is that label; an
empty table gives an empty result. Columns other than doc_id and text are never looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import tee

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty

PER_CLASS, CHARS_FITTED, ROUNDS, RATE, DECAY = 3000, 100_000, 300, 0.1, 0.02
SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
WEIGHT_CACHE = 1_000_000


@dataclass
class Model:
    base: float
    weights: dict[str, float]


class _Weights(dict):
    """Weight of a word, worked out once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.known = weights

    def __missing__(self, word: str) -> float:
        get = self.known.get
        total = get("=" + word, 0.0) + get("4" + word[:4], 0.0) + get("5" + word[:5], 0.0)
        if len(self) > WEIGHT_CACHE:
            self.clear()
        self[word] = total
        return total


def fit(texts: Iterable[str], toxic: Iterable[int], prior: tuple[int, int]) -> Model:
    """Maximum likelihood by Adam over all sentences of the sample, which is read once, a text and its label at a time. prior:
    counts of label 0 and 1 among all labelled documents."""
    # Flat arrays of machine integers, not lists: the sample is held by the driver.
    words: dict[str, int] = {}
    labels, occurrences, sentence_sizes, document_sizes, pair_words, pair_sizes = (array("i") for _ in range(6))
    for text, label in zip(texts, toxic, strict=True):
        labels.append(label)
        sentences, seen = SENTENCE_END.split(text.lower()), set()
        for sentence in sentences:
            own = [words.setdefault(w, len(words)) for w in WORD.findall(sentence)]
            occurrences.extend(own)
            sentence_sizes.append(len(own))
            seen.update(own)
        document_sizes.append(len(sentences))
        pair_words.extend(seen)
        pair_sizes.append(len(seen))
    if len(set(labels)) < 2:
        return Model(-30.0 if not any(labels) else 30.0, {})
    plain = lambda a: np.frombuffer(a, np.int32) if len(a) else np.zeros(0, np.int32)
    occ, s_sizes, d_sizes = plain(occurrences), plain(sentence_sizes), plain(document_sizes)
    sentence_of = np.repeat(np.arange(len(s_sizes), dtype=np.int32), s_sizes)
    document_of = np.repeat(np.arange(len(d_sizes), dtype=np.int32), d_sizes)
    # A word is the feature of its own number; beginnings are numbered behind the words.
    starts: dict[str, int] = {}
    features = array("i")
    for k, w in enumerate(words):
        features.extend((k, len(words) + starts.setdefault("4" + w[:4], len(starts)), len(words) + starts.setdefault("5" + w[:5], len(starts))))
    n_names = len(words) + len(starts)
    of_word = plain(features).reshape(-1, 3)
    y = np.array(labels, float)
    pair_docs = np.repeat(np.arange(len(pair_sizes), dtype=np.int64), plain(pair_sizes))
    live = _telling(of_word, pair_docs, plain(pair_words), n_names, y)
    del pair_docs, pair_words
    useful = live[of_word].any(axis=1)[occ]
    occ, sentence_of = occ[useful], sentence_of[useful]
    used, occ = np.unique(occ, return_inverse=True)
    of_word = of_word[used]
    weight = np.where(y == 1, prior[1] / y.sum(), prior[0] / (len(y) - y.sum())) / sum(prior) * len(y)
    w, base = np.zeros(n_names), -6.0
    moment, spread = np.zeros(n_names + 1), np.zeros(n_names + 1)
    for step in range(1, ROUNDS + 1):
        per_word = w[of_word].sum(axis=1)
        z = np.clip(base + np.bincount(sentence_of, per_word[occ], len(s_sizes)), -60, 60)
        clean = np.bincount(document_of, np.logaddexp(0, z), len(d_sizes))  # -log of the chance that no sentence offends
        pull = np.where(y == 1, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0) * weight / len(y)
        g_sentence = pull[document_of] / (1 + np.exp(-z))
        g_word = np.bincount(occ, g_sentence[sentence_of], len(used))
        g = np.append(sum(np.bincount(of_word[:, k], g_word, n_names) for k in range(3)) * live + DECAY / len(y) * w, g_sentence.sum())
        moment = 0.9 * moment + 0.1 * g
        spread = 0.99 * spread + 0.01 * g * g
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-7)
        w, base = (w - move[:-1]) * live, base - move[-1]
    telling = {k: float(w[k]) for k in np.flatnonzero(np.abs(w) > 1e-3).tolist()}
    weights = {"=" + x: telling[k] for k, x in enumerate(words) if k in telling}
    return Model(float(base), weights | {x: telling[len(words) + k] for x, k in starts.items() if len(words) + k in telling})


def _telling(of_word: np.ndarray, docs: np.ndarray, words: np.ndarray, n_names: int, y: np.ndarray) -> np.ndarray:
    """Features that more toxic documents have than chance explains: log-likelihood ratio above 2 ln(number of features).

    docs, words: which document has which word, each pair once."""
    has = np.zeros((2, n_names))
    for k in range(3):
        both = np.unique(docs << 32 | of_word[words, k])
        for label in (0, 1):
            has[label] += np.bincount(both[y[both >> 32] == label] & 0xFFFFFFFF, minlength=n_names)
    totals = np.array([(y == 0).sum(), (y == 1).sum()], float)[:, None]
    part = lambda seen, size: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(size, 1e-9))
    share = has.sum(axis=0) / totals.sum()
    ratio = 2 * (part(has, totals * share) + part(totals - has, totals * (1 - share))).sum(axis=0)
    return (ratio > 2 * np.log(n_names)) & (has[1] * totals[0] > has[0] * totals[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = CHARS_FITTED) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # 2 * per_class ids at most, so the broadcast is bounded whatever the corpus; so is the sample, by `chars` a document.
    short = docs.select("doc_id", text_or_empty("text").alias("text")).where(F.length("text") <= chars)
    sample = short.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # Read a partition at a time and turned into numbers at once: the driver never holds the texts.
    rows, again = tee(sample.orderBy("doc_id", "toxic").select("text", "toxic").toLocalIterator())
    return fit((r.text for r in rows), (r.toxic for r in again), (counts.get(0, 0), counts.get(1, 0)))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _score_batches(model, sentences: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model.value
        weights, base = _Weights(known.weights), known.base
        value = weights.__getitem__
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                parts = SENTENCE_END.split(text.lower())
                z = np.array([base + sum(map(value, WORD.findall(s))) for s in parts])
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                if sentences:
                    for k, s in enumerate(SENTENCE_END.split(text)):
                        if k < len(p) and p[k] >= 0.5:
                            rows.append((doc_id, k, s.strip(), float(p[k])))
                else:
                    score = float(-np.expm1(-np.logaddexp(0, z).sum()))
                    rows.append((doc_id, min(1.0, max(0.0, score)), int(score >= 0.5), int((p >= 0.5).sum()), int(p.argmax()), float(p.max())))
            out = pd.DataFrame(rows, columns=["doc_id", "sentence_no", "sentence", "score"] if sentences else ["doc_id", "score", "predicted", "n_offending", "worst_sentence", "worst_score"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _applied(docs: DataFrame, model: Model, sentences: bool, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the training sample
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(_score_batches(sent, sentences), schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Noisy-or score of every document, and where its worst sentence is."""
    return _applied(docs, model, False, "doc_id bigint, score double, predicted int, n_offending int, worst_sentence int, worst_score double")


def offending_sentences(docs: DataFrame, model: Model) -> DataFrame:
    """Every sentence that is more likely toxic than not."""
    return _applied(docs, model, True, "doc_id bigint, sentence_no int, sentence string, score double")


def score_column(spark, model: Model, text: str = "text"):
    """The score as a column, for filters on whole rows."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield next(_score_batches(sent, False)(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])))["score"]

    return scored(text_or_empty(text))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_offending", "worst_sentence", "worst_score")
