"""Near-duplicate documents: MinHash banding, verification on full shingle sets, components by alternating stars.

1. Every text becomes its set of distinct word shingles (64-bit hashes), BANDS x ROWS universal hash minima, and band
   keys. Texts with equal sets collapse to the smallest id first, so copies cost one row each from there on.
2. In each band bucket all members are compared with one leader, the member that shares most buckets overall: in a
   cluster of edited copies that is the text they were edited from. Signatures sift the pairs, full sets decide.
3. Only pairs that share a bucket but are not yet connected are left. They are compared in blocks of members against
   members outside the bucket's main component, and give one link for each component met. So no bucket is ever
   expanded into all its pairs, no link between components is lost, and no task holds more than two blocks.

At a similarity of 0.8 a pair shares none of 42 bands of 5 with probability (1 - 0.8^5)^42 = 6e-8.

Nulls, empties, ties: a null or word-less text has an empty set and links to nothing; with fewer words than a shingle
the whole sequence is one shingle; rows repeated in full are one document, as are rows that share an id; a null id
links to nothing and its component is null; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table, text_or_empty, written
from pressmill.llm.components import components

BANDS, ROWS, BLOCK = 42, 5, 512
SLACK = 0.17  # six standard deviations of a similarity of 0.8 estimated from BANDS * ROWS minima
_RNG = np.random.default_rng(20240101)
_A = (_RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_WORDS: dict[bytes, int] = {}
WORD_CACHE = 1_000_000  # entries a Python worker keeps


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # of bytes: ASCII only, as wanted
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > WORD_CACHE:
        _WORDS.clear()
    for w in words:
        if w not in _WORDS:
            _WORDS[w] = xxh3_64_intdigest(w)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    span = min(k, len(ids))
    n = len(ids) - span + 1
    h = np.full(n, span, np.uint64)
    for j in range(span):
        h = h * _STEP + ids[j : j + n]
    return np.unique(_mixed(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each universal hash a*x+b (its upper 32 bits) over a non-empty set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(least, (_A[:, None] * shingles[None, k : k + 512] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed(_mixed((rows * _FOLD).sum(axis=1, dtype=np.uint64)) + _SEED).view(np.int64)


SIGNATURES = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<tinyint>"


def _signatures(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingle_hashes(text, k)
                if len(s):
                    m = minima(s)
                    rows.append((len(s), xxh3_128_digest(s.tobytes()), band_keys(m), m.astype(np.uint8).view(np.int8)))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sketch"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
            yield out

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"].astype("Int64"), "hashes": [shingle_hashes(t, k).view(np.int64) for t in pdf["text"]]})

    return run


def _similar(common, n_a, n_b, percent: int):
    return common * 100 >= (n_a + n_b - common) * percent


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar: sifted by size and signature, decided on full sets."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    alike = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    likely = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (alike >= int((percent / 100 - SLACK) * BANDS * ROWS)))
        .select("a", "b")
    )
    full = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h_{x}"))
    both = likely.join(full("a"), "a").join(full("b"), "b").withColumn("common", F.size(F.array_intersect("h_a", "h_b")))
    return both.where(_similar(F.col("common"), F.size("h_a"), F.size("h_b"), percent)).select("a", "b")


def _block_links(percent: int):
    """Links of one block of queries with one block of members of a bucket: for each query one for every component met."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, found = key[0], []
        queries, members = pdf[pdf["query"]], pdf[~pdf["query"]].reset_index(drop=True)
        if len(queries) and len(members):
            bands, sketches = np.stack(members["bands"].to_list()), np.stack(members["sketch"].to_list())
            sets = [np.asarray(h) for h in members["hashes"]]
            sizes, comps, ids = np.array([len(s) for s in sets]), members["comp"].to_numpy(), members["id"].to_numpy()
            for q in queries.itertuples(index=False):
                shared = bands == np.asarray(q.bands)
                first = np.asarray(q.bands)[shared.argmax(axis=1)] == bucket  # a pair counts in its first common bucket alone
                own = np.sort(np.asarray(q.hashes))
                n = len(own)
                may = first & (comps != q.comp) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent)
                may &= (sketches == np.asarray(q.sketch)).sum(axis=1) >= int((percent / 100 - SLACK) * BANDS * ROWS)
                met = set()
                for k in np.flatnonzero(may):
                    if comps[k] in met:
                        continue
                    at = np.searchsorted(own, sets[k])
                    common = int((own[np.minimum(at, n - 1)] == sets[k]).sum())
                    if _similar(common, n, int(sizes[k]), percent):
                        met.add(comps[k])
                        found.append((q.id, int(ids[k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    signed = written(docs.mapInPandas(_signatures(shingle), SIGNATURES), "minhash")
    classes = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    lead = signed.select("doc_id", "digest", "n_shingles", "bands", "sketch").join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
    keys = lead.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared, "bucket"), "buckets")
    involved = members.select("id").distinct()
    nodes = written(lead.join(involved.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"), "nodes")
    sets = written(docs.join(nodes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInPandas(_sets(shingle), "id bigint, hashes array<bigint>"), "sets")

    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    leaders = written(members.join(fame, "id").groupBy("bucket").agg((-F.max(F.struct("fame", (-F.col("id")).alias("id")))["id"]).alias("leader")), "leaders")
    to_leader = members.join(leaders, "bucket").where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    links = written(_confirmed(to_leader, nodes, sets, percent), "links")
    grouped = components(links)

    # What shares a bucket and is not connected yet.
    placed = written(members.join(grouped, "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("comp")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("bucket", "n")
    main = leaders.join(placed.select(F.col("id").alias("leader"), "bucket", F.col("comp").alias("main")), ["bucket", "leader"]).select("bucket", "main").distinct()
    open_ = placed.join(mixed, "bucket").join(main, "bucket").withColumn("outside", F.col("comp") != F.col("main"))
    counts = open_.groupBy("bucket").agg(F.sum(F.col("outside").cast("long")).alias("n_out"))
    open_ = open_.join(counts, "bucket").withColumns({"m_blocks": F.ceil(F.col("n") / BLOCK), "q_blocks": F.ceil(F.col("n_out") / BLOCK)})
    dealt = F.xxhash64("id", F.lit(7))
    as_member = open_.select("id", "bucket", "comp", F.lit(False).alias("query"), F.pmod(dealt, "m_blocks").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"))
    as_query = open_.where("outside").select("id", "bucket", "comp", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"), F.pmod(dealt, "q_blocks").alias("qb"))
    blocks = as_member.unionByName(as_query).join(nodes.select("id", "bands", "sketch"), "id").join(sets, "id")
    more = written(blocks.groupBy("bucket", "mb", "qb").applyInPandas(_block_links(percent), "a bigint, b bigint").distinct(), "more-links")
    joined = components(links.unionByName(more))

    final = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "rep", "component")
    out = signed.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
