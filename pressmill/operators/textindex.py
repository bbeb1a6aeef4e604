"""Keyword search: boolean queries over terms and phrases, a rank from the places of the terms, and an inverted index.

Query language: words must all occur, a quoted phrase in its order, -word or -"phrase" must not, `or` joins alternatives.
Rank, as the reference's store works it out: a query with `or`, or of one term, takes each term's sum of 1 / j**2 over its
occurrences; any other takes all pairs of occurrences of different terms, the nearer the more. A term's first 256 places
below 16,384 count for the rank, as that store keeps no more; whether a text matches is decided from all places.

The index is a table of posting lists, one row for each term and block of texts, sorted by term, so that a query opens the
row groups of its terms alone and no text is analysed again. A block holds some `texts_per_block` texts, whatever term, so a
frequent term is many rows. From each row's largest number of occurrences follows the best rank that a block may hold: the
best blocks are ranked first, and of the others only those that may still reach the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import stemming

# Fixed values of the reference's rank: weight of a place, limit of the sum of 1 / j**2, places kept, floor of a match.
WEIGHT, SUM_LIMIT, PLACES, LAST_PLACE, LEAST = 0.1, 1.64493406685, 256, 16383, 1e-20
SPREAD = 16  # tasks that a term's blocks are dealt over at build
SUMS = [0.0]
for _j in range(1, PLACES + 1):
    SUMS.append(SUMS[-1] + 1 / _j**2)


@dataclass(frozen=True)
class TextQuery:
    """Alternatives of (wanted phrases, unwanted phrases); a phrase is a tuple of terms, empty where a stop word stands."""

    alternatives: tuple[tuple[tuple[tuple[str, ...], ...], tuple[tuple[str, ...], ...]], ...]
    any: bool

    @staticmethod
    def parse(text: str, analyzer: str = "english") -> TextQuery:
        term_of = stemming.ANALYZERS[analyzer]
        groups: list[tuple[list, list]] = [([], [])]
        for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
            if plain.lower() == "or" and not minus:
                groups.append(([], []))
                continue
            terms = [term_of(w) for w in stemming.query_words(quoted or plain)]
            while terms and not terms[0]:
                terms = terms[1:]
            while terms and not terms[-1]:
                terms = terms[:-1]
            if terms:
                groups[-1][bool(minus)].append(tuple(terms))
        kept = tuple((tuple(wanted), tuple(unwanted)) for wanted, unwanted in groups if wanted)
        return TextQuery(kept, len(kept) > 1)

    @property
    def terms(self) -> list[str]:
        """All different terms, of unwanted phrases too: the rank counts them."""
        return sorted({t for wanted, unwanted in self.alternatives for p in (*wanted, *unwanted) for t in p if t})

    @property
    def by_pairs(self) -> bool:
        return not self.any and len(self.terms) > 1


def _near(distance: Column) -> Column:
    return 1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))


def _no_pair(a: Column, b: Column) -> Column:
    """The product over all pairs of places of one less their weight."""

    def of_place(x: Column) -> Column:
        near = F.filter(b, lambda y: F.abs(x - y) <= 100)
        return F.aggregate(near, F.lit(1.0), lambda u, y: u * (1 - WEIGHT * F.sqrt(_near(F.abs(x - y)))))

    return F.aggregate(a, F.lit(1.0), lambda t, x: t * of_place(x))


def _matches(q: TextQuery, places: dict[str, Column]) -> Column:
    """places: of each term the array of its places in the text, null if it has none."""

    def has(phrase: tuple[str, ...]) -> Column:
        there = reduce(Column.__and__, [places[t].isNotNull() for t in phrase if t])
        if len(phrase) == 1:
            return there
        rest = [(k, t) for k, t in enumerate(phrase) if k and t]
        return there & F.exists(places[phrase[0]], lambda p: reduce(Column.__and__, [F.array_contains(places[t], p + k) for k, t in rest]))

    def all_of(wanted, unwanted) -> Column:
        return reduce(Column.__and__, [F.coalesce(has(p), F.lit(False)) for p in wanted] + [~F.coalesce(has(p), F.lit(False)) for p in unwanted])

    return reduce(Column.__or__, [all_of(*a) for a in q.alternatives])


def _rank(q: TextQuery, places: dict[str, Column]) -> Column:
    counted = {t: F.slice(F.filter(places[t], lambda p: p <= LAST_PLACE), 1, PLACES) for t in q.terms}
    if not q.by_pairs:
        sums = F.array(*[F.lit(x) for x in SUMS])
        parts = [F.get(sums, F.coalesce(F.size(counted[t]), F.lit(0))) for t in q.terms]
        return F.greatest(reduce(Column.__add__, parts) * (WEIGHT / SUM_LIMIT / len(q.terms)), F.lit(LEAST))
    # The chance that no pair counts, were each a chance of its own.
    none = F.lit(1.0)
    for k, a in enumerate(q.terms):
        for b in q.terms[k + 1 :]:
            none = none * F.coalesce(_no_pair(counted[a], counted[b]), F.lit(1.0))
    return F.greatest(1 - none, F.lit(LEAST))


def _best_of_block(q: TextQuery, most: dict[str, Column]) -> Column:
    """A bound of the ranks in a block, from the largest number of occurrences that a text of it has of each term."""
    count = {t: F.least(F.coalesce(most[t], F.lit(0)), F.lit(PLACES)) for t in q.terms}
    if not q.by_pairs:
        sums = F.array(*[F.lit(x) for x in SUMS])
        return reduce(Column.__add__, [F.get(sums, count[t]) for t in q.terms]) * (WEIGHT / SUM_LIMIT / len(q.terms))
    # An occurrence meets at most two of another term at each distance.
    one = math.prod((1 - WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))) ** 2 for d in range(1, 101))
    nearest = 1 - WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))
    none = F.lit(1.0)
    for k, a in enumerate(q.terms):
        for b in q.terms[k + 1 :]:
            none = none * F.greatest(F.pow(F.lit(one), F.least(count[a], count[b])), F.pow(F.lit(nearest), count[a] * count[b]))
    return 1 - none


def _found(entries: DataFrame, q: TextQuery, by: list[str]) -> DataFrame:
    """Matches with their rank. entries (by..., term, places): of the query's terms alone, one row for each text and term."""
    names = {t: f"_p{k}" for k, t in enumerate(q.terms)}
    texts = entries.groupBy(*by).agg(*[F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(c) for t, c in names.items()])
    places = {t: F.col(c) for t, c in names.items()}
    return texts.where(_matches(q, places)).withColumn("rank", _rank(q, places)).select(*by, "rank")


def best_first(found: DataFrame, limit: int, key: str, published: str) -> DataFrame:
    return found.orderBy(F.desc("rank"), F.desc(published), F.asc(key)).limit(limit)


def scan(rows: DataFrame, text: str, limit: int, *, column: str, key: str, published: str, analyzer: str = "english") -> DataFrame:
    """(key, published, rank) of the best matches, analysing every text now: for rows that are few or filtered closely."""
    q = TextQuery.parse(text, analyzer)
    if not q.alternatives:
        return rows.select(key, published, F.lit(0.0).alias("rank")).where(F.lit(False))
    placed = rows.select(key, published, F.explode(stemming.entries(analyzer)(stemming.words(F.col(column)))).alias("e")).where(F.col("e.term").isin(q.terms))
    return best_first(_found(placed.select(key, published, F.col("e.term").alias("term"), F.col("e.places").alias("places")), q, [key, published]), limit, key, published)


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _of_block(block: pa.Table, term_of: Callable[[str], str]) -> pa.RecordBatch | None:
    """The posting lists (term, block, postings, most) of the texts of one block."""
    block = block.combine_chunks()
    words = block.column("words").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = words.flatten().dictionary_encode()
    terms = [term_of(w) for w in coded.dictionary.to_pylist()]
    names = sorted(set(terms) - {""})
    if not names:
        return None
    number = {t: k for k, t in enumerate(names)}
    term = np.array([number.get(t, -1) for t in terms])[coded.indices.to_numpy()]
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    order = np.lexsort((text, term))  # stable, so places stay in order
    order = order[term[order] >= 0]
    term, text, place = term[order], text[order], place[order]
    entry = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], np.diff(term[entry]) != 0]))
    counts = np.diff(np.append(entry, len(term)))
    at = pa.array(text[entry])
    column = lambda c: block.column(c).take(at).combine_chunks()
    whole = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (column("id"), column("at"))]
    postings = pa.StructArray.from_arrays([*whole, _lists(pa.array(place.astype(np.int32)), entry)], ["id", "at", "places"])
    number_of_block = np.full(len(first), block.column("block")[0].as_py(), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(number_of_block), _lists(postings, first), pa.array(np.maximum.reduceat(counts, first).astype(np.int32))], ["term", "block", "postings", "most"])


def _posted(batches: Iterator[pa.RecordBatch], analyzer: str) -> Iterator[pa.RecordBatch]:
    """The posting lists of texts that come block by block; only the current block's texts are held."""
    term_of, held, current = stemming.ANALYZERS[analyzer], [], None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(numbers)) + 1, len(numbers))
        start = 0
        for end in ends if len(numbers) else ():
            if held and numbers[start] != current:
                if (done := _of_block(pa.Table.from_batches(held), term_of)) is not None:
                    yield done
                held = []
            held.append(batch.slice(start, end - start))
            current, start = numbers[start], end
    if held and (done := _of_block(pa.Table.from_batches(held), term_of)) is not None:
        yield done


class TextIndex:
    """The index at a path. Ids are of any one type; one text for each id."""

    FIRST_BLOCKS = 32

    def __init__(self, spark: SparkSession, path: str, key: str, published: str, analyzer: str = "english"):
        self.spark, self.path, self.key, self.published, self.analyzer = spark, path, key, published, analyzer

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, text: str, key: str, published: str, analyzer: str = "english", texts_per_block: int = 1024) -> TextIndex:
        """Analyse every text once and write its posting lists. A null text has none.

        The texts of a block come together, so that its posting lists are made in one go from arrays, and no posting is a row of
        its own in a shuffle. A frequent term is dealt over some tasks by its blocks."""
        blocks = max(1, math.ceil(rows.count() / texts_per_block))
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        texts = rows.select(F.col(key).alias("id"), F.col(published).alias("at"), block.alias("block"), F.col(text).alias("text"))
        dealt = texts.repartition("block").sortWithinPartitions("block", "id").select("id", "at", "block", stemming.words(F.col("text")).alias("words"))
        id_kind, at_kind = (dealt.schema[c].dataType.simpleString() for c in ("id", "at"))
        lists = dealt.mapInArrow(partial(_posted, analyzer=analyzer), f"term string, block int, postings array<struct<id: {id_kind}, at: {at_kind}, places: array<int>>>, most int")
        lists.repartition("term", F.pmod("block", F.lit(SPREAD))).sortWithinPartitions("term", "block").write.option("parquet.block.size", 16 << 20).parquet(path)
        return cls(rows.sparkSession, path, key, published, analyzer)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, text: str, limit: int, among: DataFrame | None = None) -> DataFrame:
        """(key, published, rank), best first, then newest, then by id: at most `limit` matches, of `among` (key) if given."""
        q, rows = TextQuery.parse(text, self.analyzer), self.read()
        if not q.alternatives:
            return rows.select(F.lit(None).cast(rows.schema["postings"].dataType.elementType["id"].dataType).alias(self.key), F.current_timestamp().cast("timestamp_ntz").alias(self.published), F.lit(0.0).alias("rank")).where(F.lit(False))
        blocks = self.blocks(q)
        first = blocks.orderBy(F.desc("best"), "block").limit(self.FIRST_BLOCKS)
        top = best_first(self._in_blocks(q, first, among), limit, self.key, self.published)
        head = top.collect()  # at most `limit` rows
        schema = top.schema
        # A block whose best rank is below the last of a full result holds nothing of it; equal ranks may still be newer.
        reached = head[-1]["rank"] if len(head) == limit else 0.0
        rest = blocks.where(F.col("best") >= reached * (1 - 1e-12)).join(first, "block", "left_anti")
        whole = self.spark.createDataFrame(head, schema)
        if not rest.isEmpty():
            whole = whole.unionByName(self._in_blocks(q, rest, among))
        return best_first(whole, limit, self.key, self.published)

    def blocks(self, q: TextQuery) -> DataFrame:
        """(block, best): blocks that have all terms of an alternative, with a bound of their ranks. Reads no postings."""
        names = {t: f"_m{k}" for k, t in enumerate(q.terms)}
        heads = self.read().where(F.col("term").isin(q.terms)).groupBy("block").agg(*[F.max(F.when(F.col("term") == t, F.col("most"))).alias(c) for t, c in names.items()])
        most = {t: F.col(c) for t, c in names.items()}
        able = reduce(Column.__or__, [reduce(Column.__and__, [most[t].isNotNull() for p in wanted for t in p if t]) for wanted, _ in q.alternatives])
        return heads.where(able).select("block", _best_of_block(q, most).alias("best"))

    def _in_blocks(self, q: TextQuery, blocks: DataFrame, among: DataFrame | None) -> DataFrame:
        lists = self.read().where(F.col("term").isin(q.terms)).join(blocks.select("block"), "block", "left_semi")
        entries = lists.select("term", "block", F.explode("postings").alias("p")).select("term", "block", F.col("p.id").alias(self.key), F.col("p.at").alias(self.published), F.col("p.places").alias("places"))
        if among is not None:
            entries = entries.join(among.select(self.key), self.key, "left_semi")
        return _found(entries, q, ["block", self.key, self.published]).drop("block")
