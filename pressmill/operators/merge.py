"""State changes as merges of two tables: upserts, cursors, retention, the work queue.

Every merge is one union and one aggregation by key, so it shuffles once and combines before the shuffle. The stream's state,
which takes small batches, lies in streaming/store.py.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_latest(state: DataFrame, incoming: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """The row of each key with the greatest rank; where ranks tie, the stored one. `incoming` has one row for each key."""
    both = state.withColumn("_stored", F.lit(1)).unionByName(incoming.withColumn("_stored", F.lit(0)))
    whole = F.struct(*state.columns)
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(whole, F.struct(rank.alias("rank"), "_stored")).alias("r")).select("r.*")


def upsert_events(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """An event is replaced only by one added later."""
    return merge_latest(state, incoming, ["event_id"], F.col("date_added"))


def upsert_mentions(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """A mention is replaced if it was derived, or by one made later; what comes in is real."""
    return merge_latest(state, incoming.withColumn("derived", F.lit(False)), ["event_id", "url_hash"], F.struct(~F.col("derived"), F.col("mention_time")))


def upsert_analyses(state: DataFrame, incoming: DataFrame, articles: DataFrame, max_bytes: int = 64 << 10) -> tuple[DataFrame, DataFrame]:
    """(state, refused): the last payload of each (article, agent) wins; unknown articles and large payloads are refused."""
    fits = F.coalesce(F.octet_length("payload") <= max_bytes, F.lit(True))
    whole = F.struct(*state.columns)
    # What is too large never reaches a sort or the join, and of the rest only the last of each key does.
    last = incoming.where(fits).groupBy(F.col("article_id").alias("_a"), F.col("agent").alias("_g")).agg(F.max_by(whole, F.struct("created_at", "arrival")).alias("r")).select("r.*")
    last = last.join(articles.select("article_id"), "article_id", "left_semi").select(*state.columns)
    known = incoming.join(articles.select("article_id").distinct().withColumn("_known", F.lit(True)), "article_id", "left")
    refused = known.withColumn("reason", F.when(F.col("_known").isNull(), "not_found").when(~fits, "too_large")).drop("_known").where("reason is not null")
    kept = state.join(last.select("article_id", "agent"), ["article_id", "agent"], "left_anti")
    return kept.unionByName(last), refused


def advance_cursors(state: DataFrame, acks: DataFrame) -> DataFrame:
    """Cursors only move forward."""
    return state.select("agent_id", "seq").unionByName(acks.select("agent_id", "seq")).groupBy("agent_id").agg(F.max("seq").alias("seq"))


def retained(rows: DataFrame, now: datetime, keep: timedelta = timedelta(days=7), ingested: str = "ingested_at") -> DataFrame:
    return rows.where(F.col(ingested) >= F.lit(now - keep).cast("timestamp_ntz"))


def retained_children(children: DataFrame, articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows of a table that goes with its articles."""
    return children.join(articles.select(key), key, "left_semi")


def eligible(queue: DataFrame, now: datetime, keep: timedelta, limit: int) -> DataFrame:
    """Work that is due and still wanted, newest first."""
    moment = F.lit(now).cast("timestamp_ntz")
    return queue.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= moment) & (F.col("created_at") >= F.lit(now - keep).cast("timestamp_ntz"))).orderBy(F.desc("seq")).limit(limit)


def queued_pages(queue: DataFrame, articles: DataFrame, now: datetime, keep: timedelta, limit: int, key: str = "url_hash") -> DataFrame:
    """Due work with the URL of its article, newest first. Only work whose article is still there counts for the limit."""
    return eligible(queue.join(articles.select(key, "url"), key), now, keep, limit)


def embed_round(titles: DataFrame, passages: DataFrame, skip: DataFrame, model: str, batch: int) -> DataFrame:
    """(kind, key, text) of one round: the newest titles without a vector of `model`, then the newest passages.

    titles and passages (key, seq, text, embedding_model); skip (key). A vector of another model counts as none, as it is
    cleared first. Each kind has a batch of its own, so titles come first and passages never starve."""

    def next_batch(rows: DataFrame, kind: str) -> DataFrame:
        open_ = rows.where(~F.col("embedding_model").eqNullSafe(F.lit(model))).join(skip.select("key"), "key", "left_anti")
        return open_.orderBy(F.desc("seq"), "key").limit(batch).select(F.lit(kind).alias("kind"), "key", "text")

    return next_batch(titles, "title").unionByName(next_batch(passages, "passage"))


def one_per_host(ready: DataFrame, busy: DataFrame, last_fetch: DataFrame, now: datetime, limit: int) -> DataFrame:
    """The newest ready row of every host that is not being fetched and whose delay has passed.

    busy (host); last_fetch (host, fetched_at, delay_seconds)."""
    blocked = last_fetch.where(F.col("fetched_at") + F.make_dt_interval(secs=F.col("delay_seconds")) > F.lit(now).cast("timestamp_ntz")).select("host")
    free = ready.join(busy.select("host").union(blocked), "host", "left_anti")
    whole = F.struct(*ready.columns)
    return free.groupBy(F.col("host").alias("_host")).agg(F.max_by(whole, F.struct("seq")).alias("r")).select("r.*").orderBy(F.desc("seq")).limit(limit)


def settle(queue: DataFrame, outcomes: DataFrame, now: datetime, *, backoff_minutes=(15, 60, 240), max_attempts: int = 4, max_site_delay: float = 3600.0) -> DataFrame:
    """Queue rows after their outcomes (url_hash, outcome, retry_after): only pending rows change.

    outcome 'transient' counts an attempt and waits by the backoff table (raised by Retry-After, an hour at most) or fails
    at the last one; 'unreachable' waits without counting; anything else is final."""
    joined = queue.join(outcomes.select("url_hash", "outcome", "retry_after"), "url_hash", "left")
    open_ = (F.col("status") == "pending") & F.col("outcome").isNotNull()
    transient, unreachable = open_ & (F.col("outcome") == "transient"), open_ & (F.col("outcome") == "unreachable")
    count = F.col("attempts") + F.when(transient, 1).otherwise(0)
    last = transient & (count >= max_attempts)
    minutes = F.array(*[F.lit(m) for m in backoff_minutes])
    wait = F.element_at(minutes, F.greatest(F.lit(1), F.least(count, F.lit(len(backoff_minutes))))) * 60
    wait = F.greatest(wait.cast("double"), F.least(F.coalesce("retry_after", F.lit(0.0)), F.lit(float(max_site_delay))))
    moment = F.lit(now).cast("timestamp_ntz")
    status = F.when(~open_, F.col("status")).when(last, "failed").when(transient | unreachable, "pending").otherwise(F.col("outcome"))
    due = F.when(~open_, F.col("next_attempt_at")).when((transient & ~last) | unreachable, moment + F.make_dt_interval(secs=wait))
    return joined.withColumns({"status": status, "attempts": count, "next_attempt_at": due}).select(*queue.columns)


def fill_vectors(rows: DataFrame, computed: DataFrame, model: str) -> DataFrame:
    """Vectors fill empty places only."""
    fresh = computed.select("article_id", F.col("embedding").alias("_new"))
    joined = rows.join(fresh, "article_id", "left")
    fills = F.col("embedding").isNull() & F.col("_new").isNotNull()
    return joined.withColumns({"embedding_model": F.when(fills, F.lit(model)).otherwise(F.col("embedding_model")), "embedding": F.coalesce("embedding", "_new")}).select(*rows.columns)


def split_good(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, refused with reason): one bad row never takes its batch along. The first failing check names the reason."""
    judged = rows.withColumn("reason", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def skip_list(failures: DataFrame, after: int = 3, most: int = 1000) -> DataFrame:
    """Keys that failed `after` times; of more than `most` the latest ones."""
    counted = failures.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return counted.where(F.col("n") >= after).orderBy(F.desc("last"), "key").limit(most)

