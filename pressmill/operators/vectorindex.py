"""Nearest vectors through inverted lists with product quantisation.

Build: unit vectors are dealt to the lists of a k-means (Spark's, over a sample of at most `sampled` vectors); what a vector
differs from its list's centre is cut into PARTS pieces, each coded by the nearest of CODES patterns. Codes lie in a table of
their own, sorted by list, so that a search opens a few row groups of short codes, ranks by them, and reads whole vectors for
the best candidates alone. Vectors are kept as they came: the distances that a search returns are worked out from them in
double precision, term by term, not from unit vectors, whose single precision is off by some 1e-8.

How many lists a search must look into depends on the data, so the build measures it: `TUNERS` vectors of the table are searched
exactly, and `probes` becomes the least number of nearest lists that hold a share of TARGET of their ten nearest.

Search runs all queries of a table together. A query looks into its `probes` nearest lists first. While a query has found
fewer than `limit` rows (as under a filter), it looks into four times as many, in the end into all, so that a filtered search
is full where the filter leaves enough. With `exact`, lists are read until none left can hold anything nearer: a list's radius
bounds how near its vectors may be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.operators.search import dot

PARTS, CODES, SAMPLED, SEED = 16, 64, 50_000, 7
TUNERS, TARGET = 100, 0.985
BLOCK, CODED_BLOCK, SLICE, DEALT = 8_192, 65_536, 32, 8_192  # vectors and codes of a group, queries compared at a time, queries of a group


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=-1)[..., None] - 2 * x @ centres.T + (centres * centres).sum(axis=-1), 0)


def _patterns(pieces: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """`count` centres of the rows of a bounded sample."""
    rng = np.random.default_rng(SEED)
    centres = pieces[rng.permutation(len(pieces))[:count]]
    for _ in range(rounds):
        owner = _squares(pieces, centres).argmin(axis=1)
        sizes = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, pieces)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def unit(v: Column) -> Column:
    """The vector at length 1; null for one without a direction."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def _filled(units: DataFrame, dims: int) -> DataFrame:
    """Unit vectors, those that there are, and their vectors, filled up to `dims` by zeros."""
    blank = lambda c: F.array_repeat(F.lit(0.0).cast(units.schema[c].dataType.elementType), F.lit(dims) - F.size(c))
    return units.where("unit IS NOT NULL").withColumns({c: F.concat(c, blank(c)) for c in ("unit", "vector") if c in units.columns})


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """`x` at `digits` decimals, halves away from zero."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**digits


def rounded(x: Column, digits: int) -> Column:
    """`_rounded` of a column: rounds its product, as SQL does, not its decimal digits."""
    return F.round(x * 10.0**digits) / 10.0**digits


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, added up in order: sums by the matrix product may differ in the last bits."""
    return np.cumsum(x, axis=1)[:, -1]


def _coded(batches: Iterator[pa.RecordBatch], centres: np.ndarray, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("unit"), batch.num_rows)
        lists = batch.column("list").to_numpy()
        rest = x - centres[lists]
        width = books.shape[2]
        code = np.stack([_squares(rest[:, j * width : (j + 1) * width], books[j]).argmin(axis=1) for j in range(len(books))], axis=1)
        codes = pa.ListArray.from_arrays(np.arange(0, code.size + 1, len(books), dtype=np.int32), pa.array(code.reshape(-1).astype(np.int16)))
        yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column("key"), pa.array(np.sqrt((rest * rest).sum(axis=1))), codes], ["list", "key", "off", "code"])


def _probes(batches: Iterator[pa.RecordBatch], lo: int, hi: int, centres: np.ndarray, radius: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query's lists from place `lo` to `hi`, a row for each block of lists, with a bound of what is left."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            far = np.sqrt(_squares(_matrix(part.column("unit"), part.num_rows), centres))
            order = far.argsort(axis=1, kind="stable")
            nearest = np.maximum(np.take_along_axis(far, order, 1) - radius[order], 0)
            left = nearest[:, hi:].min(axis=1, initial=np.inf)
            rows, block, lists = [], [], []
            for k, at in enumerate(order[:, lo:hi]):
                of = blocks[at]
                for b in np.unique(of):
                    rows.append(k)
                    block.append(b)
                    lists.append(at[of == b].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(rows, pa.int64())), part.column("vector").take(pa.array(rows, pa.int64())), pa.array(block, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(left[rows])], ["query", "vector", "block", "lists", "left"])


def _ranks(keys: pa.ChunkedArray) -> np.ndarray:
    """The place of each key in the keys' order."""
    if pa.types.is_struct(keys.type):
        values = [tuple(x.values()) for x in keys.to_pylist()]
        order = np.array(sorted(range(len(values)), key=values.__getitem__), dtype=np.int64)
    else:
        order = pc.sort_indices(keys).to_numpy()
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _met(looks: pa.Table, rows: pa.Table, most: int, centres: np.ndarray, books: np.ndarray | None, digits: int | None) -> pa.Table:
    """The `most` best rows of a block for each query that looks into it: (query, list, key, score). The score is the distance,
    whose order is that at `digits` decimals, or by `books` that of the codes. Only SLICE queries are compared at a time."""
    schema = pa.schema([looks.schema.field("query"), ("list", pa.int32()), rows.schema.field("key"), ("score", pa.float64())])
    if not looks.num_rows or not rows.num_rows:
        return schema.empty_table()
    lists, ranks, n = rows.column("list").to_numpy(), _ranks(rows.column("key")), rows.num_rows
    data = rows.column("vector" if books is None else "code").combine_chunks()
    data = data.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    data = data.astype(np.float64) if books is None else data
    squares = _in_order(data * data) if books is None else None
    members = {k: np.flatnonzero(lists == k) for k in np.unique(lists)}
    asked, at, scores = [], [], []
    for start in range(0, looks.num_rows, SLICE):
        part = looks.slice(start, SLICE)
        q = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
        own_squares = _in_order(q * q)
        units = q / np.sqrt(own_squares)[:, None]
        wanted = part.column("lists").to_pylist()
        score = np.full((part.num_rows, n), np.inf)
        seekers: dict[int, list[int]] = {}
        for k, own in enumerate(wanted):
            for x in own:
                seekers.setdefault(x, []).append(k)
        for x, who in seekers.items():
            if (own := members.get(x)) is None:
                continue
            if books is None:
                found = 1 - (units[who] @ data[own].T) / np.sqrt(squares[own])
            else:
                rest, width, found = units[who] - centres[x], books.shape[2], np.zeros((len(who), len(own)))
                for j, book in enumerate(books):
                    found += _squares(rest[:, j * width : (j + 1) * width], book).astype(np.float32)[:, data[own, j]]
            score[np.ix_(who, own)] = found
        cut = np.partition(score, most - 1, axis=1)[:, most - 1] if most < n else np.full(part.num_rows, np.inf)
        for k, row in enumerate(score):
            # The distances of all that may count are added up in order.
            near = np.flatnonzero((row <= cut[k] + (1e-9 if digits is None else 1e-9 + 10.0**-digits)) & np.isfinite(row))
            value = 1 - _in_order(data[near] * q[k]) / np.sqrt(own_squares[k] * squares[near]) if books is None else row[near]
            best = np.lexsort((ranks[near], value if digits is None or books is not None else _rounded(value, digits)))[:most]
            asked.append(np.full(len(best), start + k))
            at.append(near[best])
            scores.append(value[best])
    asked, at = pa.array(np.concatenate(asked)), pa.array(np.concatenate(at))
    return pa.Table.from_arrays([looks.column("query").take(asked), rows.column("list").take(at).cast(pa.int32()), rows.column("key").take(at), pa.chunked_array([np.concatenate(scores)])], schema=schema)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.codes, self.vectors = (spark.read.parquet(f"{path}/{t}") for t in ("codes", "vectors"))
        # Centres and patterns: one row a list and a pattern, which every task holds.
        lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
        books = spark.read.parquet(f"{path}/books").orderBy("part", "code").collect()
        self.centres, self.radius = np.array([r.centre for r in lists]), np.array([r.radius for r in lists])
        self.sizes = {r.list: r.n for r in lists}
        self.books = np.array([r.centre for r in books]).reshape(PARTS, -1, len(books[0].centre)) if books else np.zeros((PARTS, 0, 1))

    @cached_property
    def _settings(self) -> tuple[int, int]:
        return tuple(self.spark.read.parquet(f"{self.path}/settings").first())

    @property
    def probes(self) -> int:
        return self._settings[0]

    @property
    def refine(self) -> int:
        return self._settings[1]

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, key: str = "article_id", embedding: str = "embedding", lists: int | None = None, sampled: int = SAMPLED) -> VectorIndex:
        """Index every vector of `rows` that has a direction. The number of dimensions must be a multiple of PARTS, which fewer
        dimensions are filled up to by zeros. `sampled` vectors at most are fitted on."""
        spark = rows.sparkSession
        units = rows.select(F.col(key).alias("key"), unit(F.col(embedding)).alias("unit"), F.col(embedding).alias("vector")).where("unit IS NOT NULL")
        dims = units.agg(F.max(F.size("unit"))).first()[0] or PARTS
        width = math.ceil(dims / PARTS)
        units = _filled(units, width * PARTS)
        count = units.count()
        lists = lists or max(1, round(math.sqrt(count)))
        share = min(1.0, sampled / max(1, count))
        # By hash, so that a lost executor samples the same rows again.
        sample = units.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) <= share * (1 << 20)).select(array_to_vector("unit").alias("v"))
        if not count:
            centres = np.zeros((1, width * PARTS))
            placed = units.withColumn("list", F.lit(0))
        else:
            model = KMeans(k=lists, featuresCol="v", predictionCol="list", maxIter=12, seed=SEED, initSteps=2).fit(sample)
            centres = np.array(model.clusterCenters())
            placed = model.transform(units.withColumn("v", array_to_vector("unit"))).drop("v")
        placed.select("list", "key", "vector").repartitionByRange("list", "key").sortWithinPartitions("list", "key").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/vectors")
        placed = spark.read.parquet(f"{path}/vectors").select("list", "key", unit(F.col("vector")).alias("unit"))
        some = placed.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) <= min(1.0, 10_000 / max(1, count)) * (1 << 20)).select("list", "unit").collect()
        rest = np.array([r.unit for r in some], dtype=float).reshape(len(some), width * PARTS) - centres[[r.list for r in some]] if some else np.zeros((1, width * PARTS))
        books = np.stack([_patterns(rest[:, j * width : (j + 1) * width], CODES) for j in range(PARTS)])
        kind = rows.schema[key].dataType.simpleString()
        coded = placed.mapInArrow(partial(_coded, centres=centres, books=books), f"list int, key {kind}, off double, code array<smallint>")
        coded.write.option("parquet.block.size", 4 << 20).parquet(f"{path}/codes")
        facts = {r.list: r for r in spark.read.parquet(f"{path}/codes").groupBy("list").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect()}
        frame = [(k, c.tolist(), float(facts[k].radius) if k in facts else 0.0, facts[k].n if k in facts else 0) for k, c in enumerate(centres)]
        spark.createDataFrame(frame, "list int, centre array<double>, radius double, n bigint").write.parquet(f"{path}/lists")
        patterns = [(j, k, c.tolist()) for j, book in enumerate(books) for k, c in enumerate(book)]
        spark.createDataFrame(patterns, "part int, code int, centre array<double>").write.parquet(f"{path}/books")
        probes, refine = cls(spark, path, key)._measured(count)
        spark.createDataFrame([(probes, refine)], "probes int, refine int").write.parquet(f"{path}/settings")
        return cls(spark, path, key)

    def _measured(self, count: int) -> tuple[int, int]:
        """The least number of nearest lists, and of candidates by code in multiples of ten, that hold TARGET of the ten nearest
        of some vectors of the table."""
        share = min(1.0, TUNERS / max(1, count))
        tuners = self.vectors.where(F.pmod(F.xxhash64(unit(F.col("vector"))), F.lit(1 << 20)) <= share * (1 << 20)).select(F.col("key").alias("query"), F.col("vector").alias("embedding"))
        units = {r.query: np.array(r.unit, dtype=float)[None, :] for r in tuners.select("query", unit(F.col("embedding")).alias("unit")).collect()}
        near = self.search(tuners, 10, exact=True, probes=len(self.centres), explain=True).collect()
        if not near:
            return 1, 1
        places = [int(np.flatnonzero(_squares(units[r.query], self.centres)[0].argsort(kind="stable") == r.list)[0]) for r in near]
        probes = int(np.quantile(places, TARGET, method="higher")) + 1
        rough = [r.k for r in self.search(tuners, 10, probes=probes, refine=200, explain=True).collect()]
        return probes, math.ceil(float(np.quantile(rough, TARGET, method="higher")) / 10)

    def search(self, queries: DataFrame, limit: int, *, among: DataFrame | None = None, probes: int | None = None, refine: int | None = None, exact: bool = False, explain: bool = False, digits: int | None = None) -> DataFrame:
        """(query, key, distance, place): of each query (query, embedding) the nearest rows, nearest first, keys break ties.

        A query without a direction finds nothing. refine: candidates by code, in multiples of `limit`, whose vectors are read.
        probes and refine are those that the build measured unless given. explain: also a row's list and place by code, k.
        digits: distances that are one at so many decimals, 6 to 12, are a tie."""
        if digits is not None and not 6 <= digits <= 12:
            raise ValueError(f"digits {digits}: it must be from 6 to 12")
        refine = 1 if exact else refine or self.refine
        dims = self.centres.shape[1]
        units = _filled(queries.select("query", unit(F.col("embedding")).alias("unit"), F.col("embedding").alias("vector")), dims)
        if not sum(self.sizes.values()):  # an empty index has no number of dimensions
            units = units.where(F.lit(False))
        kind = dict(queries.dtypes)["query"]
        probed = f"query {kind}, vector {units.schema['vector'].dataType.simpleString()}, block int, lists array<int>, left double"
        blocks = self._blocks(BLOCK if exact else CODED_BLOCK)
        lo, hi, found, waiting = 0, min(probes or self.probes, len(self.centres)), None, units
        while True:
            step = partial(_probes, lo=lo, hi=hi, centres=self.centres, radius=self.radius, blocks=blocks)
            looks = waiting.mapInArrow(step, probed)
            hits = self._hits(looks, blocks, limit, among, refine, exact, digits)
            found = _nearest(hits if found is None else found.unionByName(hits), limit, self.key, digits).drop("place").checkpoint()
            if hi >= len(self.centres):
                break
            state = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
            if exact:
                # Distance 1 - cosine is half the squared distance of unit vectors, which are single-precision numbers.
                bounds = looks.groupBy("query").agg(F.first("left").alias("left"))
                state = bounds.join(state, "query", "left").withColumn("last", F.coalesce("last", F.lit(3.0)) - F.pow("left", F.lit(2)) / 2 + 1e-5)
                done = state.where((F.col("n") >= limit) & (F.col("last") < 0))
            else:
                done = state.where(F.col("n") >= limit)
            waiting = waiting.join(done.select("query"), "query", "left_anti").checkpoint()
            if waiting.isEmpty():
                break
            lo, hi = hi, min(4 * hi, len(self.centres))
        return _nearest(found if explain else found.drop("list", "k"), limit, self.key, digits)

    def _blocks(self, most: int) -> np.ndarray:
        """Of each list its block: neighbouring lists that hold some `most` vectors together."""
        sizes = np.array([self.sizes[k] for k in range(len(self.centres))])
        return ((np.cumsum(sizes) - sizes) // most).astype(np.int32)

    def _hits(self, looks: DataFrame, blocks: np.ndarray, limit: int, among: DataFrame | None, refine: int, exact: bool, digits: int | None) -> DataFrame:
        """Blocks of lists meet the queries that look into them. A block is cut into parts by its rows' hash where a list is large,
        and the queries of a block are dealt, so that no group grows with the table."""
        rows = self.vectors if exact else self.codes.select("list", "key", "code")
        if among is not None:
            rows = rows.join(among.select(F.col(self.key).alias("key")).distinct(), "key", "left_semi")
        sizes = np.bincount(blocks, weights=[self.sizes[k] for k in range(len(self.centres))])
        parts = [max(1, round(x / (BLOCK if exact else CODED_BLOCK))) for x in sizes]
        dealt = max(1, math.ceil(looks.select("query").distinct().count() / DEALT))
        at = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
        of_block = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("block") + 1)
        rows = rows.withColumn("block", at).withColumn("part", F.pmod(F.xxhash64("key"), of_block)).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
        looks = looks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), of_block.cast("long") - 1))).withColumn("deal", F.pmod(F.xxhash64("query"), F.lit(dealt)).cast("int"))
        q, k = looks.schema["query"].dataType.simpleString(), self.vectors.schema["key"].dataType.simpleString()
        cell, most = ["block", "part", "deal"], limit if exact else limit * refine
        step = partial(_met, most=most, centres=self.centres, books=None if exact else self.books, digits=digits)
        met = looks.drop("left").groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(step, f"query {q}, list int, key {k}, score double")
        if exact:
            return met.select("query", "list", F.lit(None).cast("int").alias("k"), F.col("key").alias(self.key), F.col("score").alias("distance"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("score", "key"))
        met = met.withColumn("k", place).where(F.col("k") <= most)
        asked = looks.select("query", F.col("vector").alias("q"), dot(F.col("vector"), F.col("vector")).alias("q_squares")).dropDuplicates(["query"])
        near = met.join(self.vectors, ["list", "key"]).join(asked, "query")
        v = F.col("vector")
        return near.select("query", "list", "k", F.col("key").alias(self.key), (1 - dot(v, F.col("q")) / F.sqrt(F.col("q_squares") * dot(v, v))).alias("distance"))

    def read_share(self, queries: DataFrame, probes: int | None = None) -> float:
        """Vectors whose codes a search of `probes` lists reads, as a share of all, on average over the queries."""
        probes = probes or self.probes
        sizes = np.array([self.sizes[k] for k in range(len(self.centres))])
        units = _filled(queries.select(unit(F.col("embedding")).alias("unit")), self.centres.shape[1]).collect()
        orders = [_squares(np.array(r.unit, dtype=float)[None, :], self.centres)[0].argsort(kind="stable") for r in units]
        shares = [sizes[order[:probes]].sum() / max(1, sizes.sum()) for order in orders]
        return float(np.mean(shares)) if shares else 0.0


def _nearest(found: DataFrame, limit: int, key: str, digits: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance" if digits is None else rounded(F.col("distance"), digits), key))
    return found.withColumn("place", place).where(F.col("place") <= limit)
