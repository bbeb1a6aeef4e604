"""Test sets put together from event clusters, settings compared over them, and exact resampling.

Samples are the rows with the smallest hashes of a seed and their key, so they follow from the data alone, whatever machine or
order they are worked out in. Queries and judgements come in as tables, as a model or a person makes them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions import scalars as S
from pressmill.operators import evalset

AMBIGUOUS = 0.8


def _draw(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def sampled(rows: DataFrame, n: int, key: str, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """`n` rows, of each group of `by` if given: those whose keys hash smallest. Keys are unique."""
    if not by:
        return rows.orderBy(_draw(seed, key), key).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(_draw(seed, key), key))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def assemble(articles: DataFrame, clusters: DataFrame, texts: DataFrame, judged: DataFrame, *, max_clusters: int, distractors: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries) of a test set.

    articles (article_id, title); clusters (event_id, members); texts (event_id, kind, text): a query written for a cluster's
    seed; judged (event_id, article_id): members that tell the seed's story, by somebody's judgement.

    A cluster's seed is its smallest member; members that the judge rejects are hard negatives, unless their title is nearly
    the seed's: these are left out of the corpus where no kept cluster has them. A cluster needs two members, a seed stands
    for its smallest cluster alone, a text for the smallest cluster of a kind, and it must be an acceptable query over the
    corpus's titles. Distractors are articles of no chosen cluster.

    corpus (article_id, title); queries (event_id, kind, query, seed, members, expected)."""
    picked = sampled(clusters.select("event_id", F.array_sort("members").alias("members")), max_clusters, "event_id", seed).checkpoint()
    each = picked.select("event_id", F.array_min("members").alias("seed"), F.explode("members").alias("article_id"))
    inside = each.select("article_id").distinct()
    outside = sampled(articles.select("article_id").join(inside, "article_id", "left_anti"), distractors, "article_id", seed)
    chosen = inside.unionByName(outside).join(articles.select("article_id", "title"), "article_id").checkpoint()
    title = lambda c: chosen.select(F.col("article_id").alias(c), F.col("title").alias(f"{c}_title"))
    told = each.join(title("seed"), "seed").join(title("article_id"), "article_id").join(judged.select("event_id", "article_id", F.lit(True).alias("same")).distinct(), ["event_id", "article_id"], "left")
    own = F.col("article_id") == F.col("seed")
    told = told.withColumn("member", own | F.coalesce("same", F.lit(False))).checkpoint()
    near = S.word_overlap(F.col("seed_title"), F.col("article_id_title")) >= AMBIGUOUS
    ambiguous = told.where(~F.col("member") & near).select("article_id").distinct()
    kept = told.where("member").groupBy("event_id", "seed").agg(F.array_sort(F.collect_list("article_id")).alias("members")).where(F.size("members") >= 2)
    kept = kept.groupBy("seed").agg(F.min_by(F.struct("event_id", "members"), "event_id").alias("c")).select("seed", "c.event_id", "c.members")
    asked = texts.join(kept, "event_id").withColumn("query_id", F.concat_ws(":", "kind", F.col("event_id").cast("string")))
    fits = evalset.acceptable_queries(asked.select("query_id", "text"), chosen.select("title")).select("query_id")
    asked = asked.join(fits, "query_id").select("event_id", "kind", F.col("text").alias("query"), "seed", "members", F.array_except("members", F.array("seed")).alias("expected"))
    queries = asked.groupBy(F.col("kind").alias("_kind"), F.lower("query").alias("_text")).agg(F.min_by(F.struct(*asked.columns), "event_id").alias("q")).select("q.*").checkpoint()
    used = queries.select(F.explode("members").alias("article_id")).distinct()
    corpus = chosen.join(ambiguous.join(used, "article_id", "left_anti"), "article_id", "left_anti")
    return corpus.select("article_id", "title"), queries


def violations(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(rule, id): what breaks the rules of a set from `assemble`; a sound one gives no row."""
    clusters = queries.groupBy("event_id").agg(F.first("members").alias("members"), F.first("seed").alias("seed"))
    keyed = corpus.select("article_id", S.story_key(F.col("title")).alias("story_key"))
    split = queries.select(F.concat_ws(":", "kind", F.col("event_id").cast("string")).alias("query_id"), "event_id", "expected", F.array_except("expected", "expected").alias("ignored"))
    asked = queries.select(F.concat_ws(":", "kind", F.col("event_id").cast("string")).alias("query_id"), F.col("query").alias("text"))
    poor = asked.join(evalset.acceptable_queries(asked, corpus.select("title")).select("query_id"), "query_id", "left_anti").select(F.lit("query is empty or a title").alias("rule"), F.col("query_id").alias("id"))
    inside = queries.select(F.explode("members").alias("article_id")).distinct()
    others = corpus.join(inside, "article_id", "left_anti").agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no distractors").alias("rule"), F.lit("").alias("id"))
    return evalset.set_violations(clusters, keyed, split).union(poor).union(others)


def swept(queries: DataFrame, legs: DataFrame, rrf_k: list[int], candidates: list[int], k: int = 5) -> DataFrame:
    """(prefix, rrf_k, candidates, method, recall, mrr, queries): every setting over shared candidate lists, in one pass.

    queries (query_id, expected); legs (prefix, query_id, leg, id, rank), one list a leg ('vector', 'fulltext'), as deep as the
    largest number of candidates. 'hybrid' is their fusion at 1 / (rrf_k + rank), best first, then by id.

    The lists of a prefix and query become one row, bounded by the number of candidates; every setting is worked out in it, so
    what is shuffled does not depend on the number of settings, nor at all where legs are dealt by query_id already."""
    deep = legs.where(F.col("rank") <= max(candidates)).select("prefix", "query_id", "leg", "id", "rank")
    # Terms are summed in the order of the legs' names, so that equal scores are equal to the last bit.
    each = deep.groupBy("prefix", "query_id", "id").agg(F.array_sort(F.collect_list(F.struct("leg", "rank"))).alias("places"))
    lists = each.groupBy("prefix", "query_id").agg(F.collect_list(F.struct("id", "places")).alias("entries"))
    run = lists.join(queries.where(F.size("expected") > 0).select("query_id", "expected"), "query_id", "left")
    names = F.array_distinct(F.flatten(F.transform("entries", lambda e: F.transform(e["places"], lambda p: F.struct(p["leg"].alias("leg"))))))
    run = run.select("prefix", "expected", "entries", names.alias("legs"))

    def judged(method: Column, depth: int, ordered: Column, rrf: list[int]) -> Column:
        """What a list of (s, id), empty where the setting has none, is worth; the same for all of `rrf`."""
        ids = F.transform(F.array_sort(ordered), lambda x: x["id"])

        def worth(found: Column) -> Column:
            recall = F.size(F.array_intersect("expected", F.slice(found, 1, k))) / F.size(F.array_distinct("expected"))
            places = F.filter(F.transform("expected", lambda e: F.array_position(found, e)), lambda p: p > 0)
            return F.struct(F.coalesce(recall, F.lit(0.0)).alias("recall"), F.coalesce(1 / F.array_min(places), F.lit(0.0)).alias("mrr"))

        # Bound in an array of one, so that the list is sorted once.
        one = F.transform(F.filter(F.array(ids), lambda found: F.size(found) > 0), worth)
        return F.flatten(F.transform(one, lambda w: F.array(*[F.struct(F.lit(r).alias("rrf_k"), F.lit(depth).alias("candidates"), method.alias("method"), w["recall"].alias("recall"), w["mrr"].alias("mrr")) for r in rrf])))

    def fused(rrf: int, depth: int) -> Column:
        score = lambda e: F.aggregate(F.filter(e["places"], lambda p: p["rank"] <= depth), F.lit(0.0), lambda a, p: a + 1.0 / (rrf + p["rank"]))
        scored = F.transform("entries", lambda e: F.struct((-score(e)).alias("s"), e["id"].alias("id")))
        return judged(F.lit("hybrid"), depth, F.filter(scored, lambda x: x["s"] < 0), [rrf])

    def alone(leg: Column, depth: int) -> Column:
        of_leg = F.transform("entries", lambda e: F.transform(F.filter(e["places"], lambda p: (p["leg"] == leg) & (p["rank"] <= depth)), lambda p: F.struct(p["rank"].cast("double").alias("s"), e["id"].alias("id"))))
        return judged(leg, depth, F.flatten(of_leg), rrf_k)

    worths = [fused(a, b) for a in rrf_k for b in candidates] + [F.flatten(F.transform("legs", partial(lambda depth, x: alone(x["leg"], depth), b))) for b in candidates]
    setting = ["prefix", "rrf_k", "candidates", "method"]
    rows = run.select("prefix", F.col("expected").isNotNull().alias("asked"), F.explode(F.concat(*worths)).alias("w")).select("prefix", "asked", "w.*")
    total = lambda c: F.sum(F.when(F.col("asked"), F.col(c)).otherwise(0.0))
    sums = rows.groupBy(*setting).agg(total("recall").alias("recall"), total("mrr").alias("mrr"))
    # A query that a setting finds nothing for counts with 0.
    count = queries.where(F.size("expected") > 0).agg(F.count("*").alias("queries")).where("queries > 0")
    return sums.crossJoin(F.broadcast(count)).select(*setting, (F.col("recall") / F.col("queries")).alias("recall"), (F.col("mrr") / F.col("queries")).alias("mrr"), "queries")


# --- resampling -----------------------------------------------------------------------


def _split(seed: int, sample: int, low: int, high: int, n: int, share: float) -> int:
    """How many of n draws fall into the left part of a node: a draw that anyone who asks works out alike."""
    key = [(seed << 32 | sample) & (2**64 - 1), low << 32 | high]
    return int(np.random.Generator(np.random.Philox(key=np.array(key, dtype=np.uint64))).binomial(n, share))


def _draws_of_block(block: int, sizes: np.ndarray, seed: int, sample: int, draws: int) -> int:
    """How many of a sample's draws fall into a block: down the tree of blocks, halving each time."""
    low, high = 0, len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1 and draws:
        middle = (low + high) // 2
        total = ends[high] - ends[low]
        left = _split(seed, sample, low, high, draws, (ends[middle] - ends[low]) / total) if total else 0
        low, high, draws = (low, middle, left) if block < middle else (middle, high, draws - left)
    return draws


def resampled(pairs: DataFrame, n: int = 1000, seed: int = 0, per_block: int = 4096) -> DataFrame:
    """(sample, draws, total): of each of n resamples with replacement how many pairs it has, always as many as there are, and
    the sum of a - b over them. pairs (pair_id, a, b), ids unique.

    A sample's draws are dealt down a tree of blocks of pairs by binomial numbers that follow from seed, sample and place in
    the tree, so every block works out its own part and no draw passes through the driver."""
    rows = pairs.select("pair_id", (F.col("a") - F.col("b")).cast("double").alias("gap"))
    count = rows.count()
    blocks = max(1, -(-count // per_block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("pair_id"), F.lit(blocks)).cast("int")).checkpoint()
    found = {r.block: r.n for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}  # one number a block
    sizes = np.array([found.get(b, 0) for b in range(blocks)])

    def part(own: pd.DataFrame) -> pd.DataFrame:
        block, gaps = int(own.block.iloc[0]), own.sort_values("pair_id").gap.to_numpy()
        out = []
        for sample in range(n):
            draws = _draws_of_block(block, sizes, seed, sample, int(sizes.sum()))
            if draws:
                rng = np.random.Generator(np.random.Philox(key=np.array([(seed << 32 | sample) & (2**64 - 1), 1 << 63 | block], dtype=np.uint64)))
                out.append((sample, draws, float(rng.multinomial(draws, np.full(len(gaps), 1 / len(gaps))) @ gaps)))
        return pd.DataFrame(out, columns=["sample", "draws", "total"])

    parts = rows.groupBy("block").applyInPandas(part, "sample int, draws bigint, total double")
    return parts.groupBy("sample").agg(F.sum("draws").alias("draws"), F.sum("total").alias("total"))


def resampled_interval(pairs: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """(low, high): the interval that holds 95% of the resamples' means of a - b; no row without pairs."""
    means = resampled(pairs, n, seed).agg(F.array_sort(F.collect_list(F.col("total") / F.col("draws"))).alias("m")).where(F.size("m") > 0)  # n numbers
    at = lambda share: F.element_at("m", F.least(F.size("m"), F.floor(F.size("m") * share).cast("int") + 1))
    return means.select(at(0.025).alias("low"), at(0.975).alias("high"))


def compared(candidate: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """(by..., recall_gain, mrr_gain, worse) of two frames of metrics (by..., recall, mrr): worse where either is lower."""
    c, b = (x.select(*by, F.col("recall").alias(f"{n}_recall"), F.col("mrr").alias(f"{n}_mrr")) for x, n in ((candidate, "c"), (baseline, "b")))
    gains = c.join(b, by).select(*by, (F.col("c_recall") - F.col("b_recall")).alias("recall_gain"), (F.col("c_mrr") - F.col("b_mrr")).alias("mrr_gain"))
    return gains.withColumn("worse", (F.col("recall_gain") < 0) | (F.col("mrr_gain") < 0))
