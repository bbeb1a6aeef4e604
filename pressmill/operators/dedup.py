"""First-wins dedup, story grouping, collapse of batches, derived mentions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions import scalars as S

STORY_WINDOW = timedelta(hours=48)


def first_by(rows: DataFrame, key: str, order: list[str], state: DataFrame | None = None) -> DataFrame:
    """The first row of each key that the state does not hold already. Partial aggregation picks it: nothing is sorted."""
    whole = F.struct(*rows.columns)
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")
    return first if state is None else first.join(state.select(key), key, "left_anti")


def newest_in_batch(rows: DataFrame, key: list[str], at: str, arrival: str) -> DataFrame:
    """The newest row of each key; of equally new ones the later arrival."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(whole, F.struct(at, arrival)).alias("r")).select("r.*")


def representatives(articles: DataFrame, key: str = "story_key", article_id: str = "article_id") -> DataFrame:
    """(article_id, representative): the smallest id of each story."""
    least = articles.groupBy(key).agg(F.min(article_id).alias("representative"))
    return articles.select(article_id, key).join(least, key).select(article_id, "representative")


def derived_mentions(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Mentions of a story's main article that follow from real mentions of its copies and are not there yet.

    mentions (event_id, url_hash, derived, ingested_at); sources (url_hash, article_id)."""
    copies = sources.where("article_id <> url_hash")
    follow = mentions.where("not derived").join(copies, "url_hash").groupBy("event_id", "article_id").agg(F.min("ingested_at").alias("ingested_at"))
    follow = follow.select("event_id", F.col("article_id").alias("url_hash"), F.lit(True).alias("derived"), "ingested_at")
    return follow.join(mentions.select("event_id", "url_hash"), ["event_id", "url_hash"], "left_anti")


_STORY = "article_id string, story_id string, outcome string"


def _assign(window: timedelta):
    """Stories of rows that come island by island in order of arrival; only the current island's stories are held, each with
    the pages that it has of every domain."""
    reach = int(window.total_seconds() * 1e6)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, stories = None, []  # by time, then in order of their start
        for batch in batches:
            ids, outcomes = [], []
            columns = [batch.column(c).to_pylist() for c in ("story_key", "island", "article_id", "domain", "signature", "at")]
            for key, part, article_id, domain, signature, at in zip(*columns, strict=True):
                if (key, part) != island:
                    island, stories = (key, part), []
                near = () if at is None else range(bisect_left(stories, (at - reach,)), bisect_right(stories, (at + reach, len(stories))))
                story = next((stories[k] for k in near if domain is None or stories[k][3].get(domain, {signature}) == {signature}), None)
                if story is None:
                    story = (at, len(stories), article_id, {})
                    if at is not None:
                        insort(stories, story, key=lambda s: s[:2])
                if domain is not None:
                    story[3].setdefault(domain, set()).add(signature)
                ids.append(story[2])
                outcomes.append("canonical" if story[2] == article_id else "grouped")
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), pa.array(ids, pa.string()), pa.array(outcomes, pa.string())], ["article_id", "story_id", "outcome"])

    return walk


def group_stories(articles: DataFrame, window: timedelta = STORY_WINDOW) -> DataFrame:
    """(article_id, story_id, outcome): the story of each article under one ordered read.

    articles (article_id string, story_key, domain, url, published_at, arrival). A URL counts once, at its first arrival.
    An article joins the earliest story of its key within the window of that story's first article, unless its domain is
    there with another page; else it starts a story. Stories never cross keys, so keys are independent. A key whose rows
    all fall within the window and have a domain each is decided without leaving the JVM: it is one story.
    Rows further apart than the window never meet, so a key falls apart at gaps in time; a row without a key or a time is a
    story of its own."""
    # Kept once: four branches read these rows, and their keys may come from a Python step.
    wanted = articles.select("article_id", "story_key", "domain", "published_at", "arrival", S.page_signature(F.col("url")).alias("signature"))
    rows = first_by(wanted, "article_id", ["arrival"]).checkpoint()
    own = rows.where("story_key is null").select("article_id", F.col("article_id").alias("story_id"), F.lit("canonical").alias("outcome"))
    span = F.expr(f"interval '{int(window.total_seconds())}' second")
    rows = rows.where("story_key is not null")
    facts = rows.groupBy("story_key").agg(
        F.count("*").alias("n"), F.count_distinct("domain").alias("n_domains"), F.min(F.struct("arrival", "article_id"))["article_id"].alias("head"),
        F.min("published_at").alias("lo"), F.max("published_at").alias("hi"),
    )
    rows = rows.join(facts, "story_key")
    simple = (F.col("n") == F.col("n_domains")) & (F.col("hi") - F.col("lo") <= span)
    easy = rows.where(simple).select("article_id", F.col("head").alias("story_id"), F.when(F.col("article_id") == F.col("head"), "canonical").otherwise("grouped").alias("outcome"))
    by_time = Window.partitionBy("story_key").orderBy("published_at", "article_id")
    gap = F.coalesce((F.col("published_at") - F.lag("published_at").over(by_time) > span).cast("int"), F.lit(0))
    hard = rows.where(~simple).select("story_key", "article_id", "domain", "signature", "published_at", "arrival").withColumn("gap", gap)
    hard = hard.withColumn("island", F.sum("gap").over(by_time.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    at = F.unix_micros(F.col("published_at").cast("timestamp")).alias("at")
    placed = hard.select("story_key", "island", "article_id", "domain", "signature", at, "arrival").repartition("story_key", "island")
    walked = placed.sortWithinPartitions("story_key", "island", "arrival", "article_id").mapInArrow(_assign(window), _STORY)
    return easy.unionByName(walked).unionByName(own)


def batch_counters(outcomes: DataFrame, total: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: canonicals, grouped copies, URL duplicates and dead letters of a batch; they add up to its size."""
    o = outcomes.agg(F.count_if(F.col("outcome") == "canonical").alias("canonicals"), F.count_if(F.col("outcome") == "grouped").alias("grouped"), F.count("*").alias("_kept"))
    t = total.agg(F.count("*").alias("_all")).join(dead.agg(F.count("*").alias("dlq")))
    return o.join(t).select("canonicals", "grouped", (F.col("_all") - F.col("_kept") - F.col("dlq")).alias("url_duplicates"), "dlq")

