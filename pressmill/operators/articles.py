"""Reading articles: pages, their events, sources and scores. The page is cut first and only then enriched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group under `order`; Spark cuts groups before the shuffle (window group limit)."""
    keys = [group] if isinstance(group, str) else group
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def mention_counts(mentions: DataFrame) -> DataFrame:
    """Mentions of each event that were really made, not derived."""
    return mentions.where("not derived").groupBy("event_id").agg(F.count("*").alias("mention_count"))


def events_of(page: DataFrame, mentions: DataFrame, events: DataFrame, k: int = 20) -> DataFrame:
    """The k most mentioned events of each article of a page, with how often each is mentioned anywhere."""
    of_page = mentions.join(page.select("article_id"), "article_id", "left_semi").select("article_id", "event_id").distinct()
    linked = of_page.join(events, "event_id")
    top = top_per_group(linked, "article_id", [F.desc("num_mentions"), F.asc("event_id")], k)
    counts = mention_counts(mentions.join(top.select("event_id").distinct(), "event_id", "left_semi"))
    return top.join(counts, "event_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


def source_counts(page: DataFrame, sources: DataFrame) -> DataFrame:
    """`page` with how many sources each article has, one at least."""
    counts = sources.join(page.select("article_id"), "article_id", "left_semi").groupBy("article_id").agg(F.count("*").alias("source_count"))
    return page.join(counts, "article_id", "left").withColumn("source_count", F.greatest(F.coalesce("source_count", F.lit(1)), F.lit(1)))


def latest_scores(page: DataFrame, analyses: DataFrame) -> DataFrame:
    """(article_id, scores): newest numeric score of each agent as a map."""
    newest = analyses.join(page.select("article_id"), "article_id", "left_semi").where("score is not null").groupBy("article_id", "agent").agg(F.max_by("score", F.struct("created_at", "analysis_id")).alias("score"))
    return newest.groupBy("article_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent", "score")))).alias("scores"))


def detail(page: DataFrame, sources: DataFrame, analyses: DataFrame) -> DataFrame:
    """`page` with its sources by time and its analyses by agent."""
    s = sources.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("published_at", "source_id"))), lambda x: x["source_id"]).alias("sources"))
    a = analyses.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("agent", "score"))).alias("analyses"))
    keys = page.select("article_id")
    return page.join(s.join(keys, "article_id", "left_semi"), "article_id", "left").join(a.join(keys, "article_id", "left_semi"), "article_id", "left")


def assembled(page: DataFrame, *, sources: DataFrame, analyses: DataFrame | None = None, mentions: DataFrame | None = None, events: DataFrame | None = None, include: tuple[str, ...] = ()) -> DataFrame:
    """A page with its source counts and the optional parts named in `include`; a part not named is not computed."""
    out = source_counts(page, sources)
    if "scores" in include and analyses is not None:
        out = out.join(latest_scores(page, analyses), "article_id", "left")
    if "events" in include and mentions is not None and events is not None:
        listed = events_of(page, mentions, events).groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("num_mentions")).alias("order"), "event_id"))), lambda x: x["event_id"]).alias("events"))
        out = out.join(listed, "article_id", "left")
    return out


def latest_seq(articles: DataFrame, seq: str = "seq") -> DataFrame:
    return articles.agg(F.coalesce(F.max(seq), F.lit(0)).alias("latest_seq"))


def health(articles: DataFrame, slots: DataFrame) -> DataFrame:
    """One row: newest published slot, slots that wait or failed, articles and the newest of them."""
    s = slots.agg(
        F.max(F.when(F.col("status") == "published", F.col("slot"))).alias("last_slot"),
        F.count_if(F.col("status") == "pending").alias("pending_slots"),
        F.count_if(F.col("status") == "failed").alias("failed_slots"),
    )
    a = articles.agg(F.count("*").alias("articles"), F.max("published_at").alias("newest"))
    return s.join(a)
