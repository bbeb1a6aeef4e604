"""Benchmark decontamination by latent semantic retrieval.

1. Words of the benchmark make the vocabulary; how many passages of the whole corpus have each word gives its inverse
   passage frequency.
2. A distributed randomised SVD of the benchmark's TF-IDF matrix (range finder with power iterations; every product with
   the matrix is a sum over partitions) gives a latent space of at most RANK dimensions.
3. A stretch of text is looked at for the items of which enough words for the subsequence asked for below stand in it, as near
   one another as in a window and the words around it; most stretches have no such item and end here. The others are cut into windows of 16, 32, 64 and 256 words, every half window; those of each width are compared with
   the items of a fitting length (SPANS), so that a short item is not diluted. Window vectors are projected and compared in
   blocks of items; pairs with a cosine of at least COSINE are candidates.
4. A candidate is confirmed by the longest common subsequence of the item's words and the words around the window (at
   least LCS of the item). Below SURE of the item its answer must be told, too: ANSWER of the distinct words of the item's
   last sentences (as many as have ANSWER_WORDS distinct words), each as rare as the item's median word at least.

The benchmark is dealt in slices of about MAX_ITEMS items and MAX_WORDS words at most, each of which is broadcast and
searched in a pass of its own.

Nulls, empties, ties: null and empty texts and items match nothing; repeated rows of documents give repeated results
merged to one row by (doc_id, item_id); a null id of either is kept as null; with an empty table the result is empty. A
match that several windows show is reported once with its best figures. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty, written

RANK, OVERSAMPLE, POWER = 192, 16, 2
PASSAGE, CHUNK = 32, 8
SPANS = ((2, 0, 12), (4, 8, 48), (8, 24, 192), (32, 96, 1 << 40))  # windows of so many chunks for items of so many words
COSINE, LCS, SURE, ANSWER, ANSWER_WORDS = 0.4, 0.6, 0.8, 0.5, 3
MAX_ITEMS, MAX_WORDS, ITEM_BLOCK, CELLS = 20_000, 100_000, 1024, 1 << 20
STRETCH = 768  # words; a multiple of half of every window
SEED = 11
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, one machine-independent integer a row of the table."""
    where: dict = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = where.get(w)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def runs(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges first to end, each with its range's place."""
    sizes = end - first
    upto = np.cumsum(sizes)
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + sizes, sizes)


def answer_words(text: str) -> set[str]:
    """Distinct words of the last sentence, with those before it while they are fewer than ANSWER_WORDS."""
    found: set[str] = set()
    for part in reversed(re.split(r"[.!?\n]+", text)):
        if len(found) >= ANSWER_WORDS:
            break
        found |= set(words(part))
    return found


def _frequencies(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = vocabulary.value, 0
        counts = np.zeros(len(at), np.int64)
        get = at.get
        for pdf in batches:
            for text in pdf["text"]:
                ids = np.array([get(w, -1) for w in words(text)], np.int64)
                if len(ids):
                    passage = np.arange(len(ids)) // PASSAGE
                    known = ids >= 0
                    pairs = np.unique(passage[known] * len(at) + ids[known])
                    counts += np.bincount(pairs % len(at), minlength=len(at))
                    total += int(passage[-1]) + 1
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"word": np.append(seen, -1), "n": np.append(counts[seen], total)})

    return run


def passage_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """How many passages of 32 words have each vocabulary word, and how many passages there are. The result is as long as the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # about MAX_WORDS at most
    rows = docs.select(text_or_empty("text").alias("text")).mapInPandas(_frequencies(sent), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary))
    total = 0
    for r in rows:
        if r.word < 0:
            total = r.n
        else:
            counts[r.word] = r.n
    return counts, total


def tf_idf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and unit-length weights."""
    distinct, times = np.unique(ids, return_counts=True)
    weight = times * idf[distinct]
    norm = np.sqrt((weight**2).sum())
    return distinct, weight / norm if norm else weight


def _gram(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, vocabulary, basis = sent.value
        total = np.zeros(basis.shape)
        for pdf in batches:
            for text in pdf["text"]:
                ids = np.array([vocabulary[w] for w in words(text)], np.int64)
                if len(ids):
                    at, weight = tf_idf(ids, idf)
                    total[at] += weight[:, None] * (weight @ basis[at])[None, :]
        rows = np.flatnonzero(total.any(axis=1))
        if len(rows):  # an empty column of lists has no Arrow type
            yield pd.DataFrame({"word": rows, "row": list(total[rows])})

    return run


def latent_basis(items: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the items' TF-IDF matrix A: the range of (A'A)^POWER times a random
    matrix, then the singular directions inside that range. Products with A'A are summed over partitions by Spark."""
    spark, n = items.sparkSession, len(vocabulary)
    width = min(rank + OVERSAMPLE, n)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    texts = items.select(text_or_empty("text").alias("text"))
    sums = [F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(width)]

    def product(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((idf, vocabulary, q))
        got = texts.mapInPandas(_gram(sent), "word bigint, row array<double>").groupBy("word").agg(*sums).toPandas()
        out = np.zeros((n, width))
        out[got["word"].to_numpy(np.int64)] = got.drop(columns="word").to_numpy()
        return out

    for _ in range(POWER):
        basis = np.linalg.qr(product(basis))[0]
    inner = basis.T @ product(basis)  # = (A Q)'(A Q)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-12)]
    return (basis @ vectors[:, keep]).astype(np.float32)


class Searcher:
    """Windows of a text against all items in the latent space."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, basis: np.ndarray, items: list[tuple[object, str]]):
        self.get = vocabulary.get
        self.project = np.vstack([basis * idf[:, None].astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)])
        self.items = [(k, words(t), answer_words(t)) for k, t in items]
        self.items = [x for x in self.items if x[1]]
        median = {k: float(np.median([idf[vocabulary[w]] for w in own])) for k, (_, own, _) in enumerate(self.items)}
        self.answers = [{w for w in answer if idf[vocabulary[w]] >= median[k]} or answer for k, (_, _, answer) in enumerate(self.items)]
        latent = np.stack([self.project[[vocabulary[w] for w in own]].sum(axis=0) for _, own, _ in self.items]) if self.items else np.zeros((0, basis.shape[1]), np.float32)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.ids = [[vocabulary[w] for w in own] for _, own, _ in self.items]
        self.counts = [Counter(own) for own in self.ids]
        sizes = np.array([len(own) for own in self.ids], np.int64)
        fitting = [(span, np.flatnonzero((sizes >= least) & (sizes <= most))) for span, least, most in SPANS]
        self.fitting = [(span, at) for span, at in fitting if len(at)]
        self.need = LCS * sizes
        # Which items have a word, and how often: postings of word w are postings[starts[w] : starts[w + 1]].
        held = sorted((w, k, c) for k, counts in enumerate(self.counts) for w, c in counts.items())
        self.starts = np.searchsorted(np.array([h[0] for h in held], np.int64), np.arange(len(vocabulary) + 1))
        self.words_from = np.cumsum([0, *(len(counts) for counts in self.counts)])
        self.held_words = np.array([w for counts in self.counts for w in counts], np.int64)
        self.held_times = np.array([c for counts in self.counts for c in counts.values()], np.int64)
        self.postings, self.times = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.float64)
        # A match has so many of the item's words among so many words of the text, as it is told from a window and n words around it.
        self.least = np.ceil(self.need - 1e-9).astype(np.int64)
        self.reach = 2 * sizes
        for span, at in self.fitting:  # spans grow
            self.reach[at] = CHUNK * span + 2 * sizes[at]
        # Stretches overlap by a window and an item on each side of it, so every match lies whole in one of them.
        self.overlap = CHUNK * max([span for span, _ in self.fitting], default=1) + 2 * int(sizes.max(initial=0))
        self.stretch = -(-max(STRETCH, 2 * self.overlap) // STRETCH) * STRETCH

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Items of which enough words are among the ids, and close enough together in one place at least."""
        known = ids >= 0
        own, where = ids[known], np.flatnonzero(known)
        order = np.argsort(own, kind="stable")
        own, where = own[order], where[order]
        distinct = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        at = runs(self.starts[distinct], self.starts[distinct + 1])[1]
        possible = np.bincount(self.postings[at], self.times[at], len(self.items)) >= self.need - 1e-9
        items, wide = np.flatnonzero(possible), len(ids) + 1
        step = max(1, CELLS // wide)
        for part in (items[k : k + step] for k in range(0, len(items), step)):
            row, held = runs(self.words_from[part], self.words_from[part + 1])
            first = np.searchsorted(own, self.held_words[held], "left")
            held_in, at = runs(first, np.searchsorted(own, self.held_words[held], "right"))
            row, times, places = row[held_in], self.held_times[held][held_in], where[at]
            # A word counts as often as the item has it: in the stretches of `reach` words that hold this occurrence and not
            # the one so many places before it.
            full = at - first[held_in] >= times
            begin = np.maximum(np.where(full, where[np.where(full, at - times, 0)] + 1, 0), places - self.reach[part][row] + 1)
            steps = np.bincount(row * wide + np.maximum(begin, 0), minlength=len(part) * wide) - np.bincount(row * wide + places + 1, minlength=len(part) * wide)
            possible[part] = np.cumsum(steps).reshape(len(part), wide).max(axis=1) >= self.least[part]
        return possible

    def candidates(self, ids: np.ndarray, cosine: float, possible: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first and last word of the window, likeness)."""
        n_chunks = -(-len(ids) // CHUNK)
        chunks = np.add.reduceat(self.project[ids], np.arange(0, len(ids), CHUNK), axis=0)
        upto = np.vstack([np.zeros((1, chunks.shape[1]), np.float64), np.cumsum(chunks, axis=0, dtype=np.float64)])
        for span, fitting in self.fitting:
            items = fitting[possible[fitting]]
            if not len(items):
                continue
            latent = self.latent[items]
            first = np.arange(0, max(1, n_chunks - span // 2), span // 2)
            last = np.minimum(first + span, n_chunks)
            vectors = (upto[last] - upto[first]).astype(np.float32)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for at in range(0, len(items), ITEM_BLOCK):
                likeness = vectors @ latent[at : at + ITEM_BLOCK].T
                near, which = np.nonzero(likeness >= cosine)
                yield from zip(items[at + which].tolist(), (first[near] * CHUNK).tolist(), np.minimum(last[near] * CHUNK, len(ids)).tolist(), likeness[near, which].tolist(), strict=True)

    def search(self, text: str) -> list[tuple]:
        """(item id, cosine, LCS share, answer share) of every confirmed item."""
        own = words(text)
        if not own or not self.items:
            return []
        get = self.get
        all_ids = np.array([get(w, -1) for w in own], np.int64)
        best: dict[int, tuple] = {}
        for start in range(0, max(1, len(own) - self.overlap), self.stretch):
            end = start + self.stretch + self.overlap
            ids = all_ids[start:end]
            possible = self.possible(ids)
            if possible.any():
                self._search(own[start:end], ids, possible, best)
        return list(best.values())

    def _search(self, own: list[str], ids: np.ndarray, possible: np.ndarray, best: dict[int, tuple]) -> None:
        known = ids.tolist()
        for k, first, last, likeness in self.candidates(ids, COSINE, possible):
            item_id, item, _ = self.items[k]
            if k in best and best[k][2] >= 1:
                continue
            counts, n = self.counts[k], len(item)
            a, b = max(0, first - n), last + n
            # A common subsequence has words of both; too few of them settle the matter, and other words do not change it.
            both = list(filter(counts.__contains__, known[a:b]))
            if len(both) < LCS * n or sum(map(counts.__getitem__, set(both))) < LCS * n:
                continue
            share = lcs_length(self.ids[k], both) / n
            if share < LCS:
                continue
            near = own[a:b]
            answer = self.answers[k]
            told = len(answer.intersection(near)) / len(answer)
            if (share >= SURE or told >= ANSWER) and (k not in best or (share, likeness) > (best[k][2], best[k][1])):
                best[k] = (item_id, likeness, share, told)


def _search_batches(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(*sent.value)
        for pdf in batches:
            rows = [(d, *hit) for d, text in zip(pdf["doc_id"], pdf["text"], strict=True) for hit in searcher.search(text)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs", "answer"])
            out["doc_id"], out["item_id"] = out["doc_id"].astype("Int64"), out["item_id"].astype("Int64")
            yield out

    return run


MATCHES = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of every benchmark item that a document holds."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.split("text", r"\W+"))), F.lit(0)).alias("words")).first()
    slices = max(1, -(-size.n // MAX_ITEMS), -(-size.words // MAX_WORDS))
    found = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k) if slices > 1 else items
        held = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # about MAX_ITEMS
        vocabulary: dict[str, int] = {}
        for _, text in held:
            for w in words(text):
                vocabulary.setdefault(w, len(vocabulary))
        if not vocabulary:
            continue
        counts, passages = passage_frequencies(docs, vocabulary)
        idf = np.log((passages + 1) / (counts + 1)) + 0.01
        sent = spark.sparkContext.broadcast((vocabulary, idf, latent_basis(part, vocabulary, idf), held))
        hits = docs.mapInPandas(_search_batches(sent), MATCHES)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], MATCHES)
    best = F.max(F.struct("lcs", "cosine", "answer")).alias("b")
    return written(found, "leaks").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.answer")


def query(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
