"""The feed as Structured Streaming: route raw lines, merge into state, group stories, push, limit rates (on streams: keyed.py).

Delivery is at least once and every write is idempotent: a batch of the state counts as a whole or not at all, and merges keep
the newest row whatever order rows come in, so no watermark is needed. The source is a factory; a message log where the connector is
installed, files elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressmill import schemas
from pressmill.functions import scalars as S
from pressmill.operators import dedup, parsers
from pressmill.streaming.store import RunStore, TableSpec


def raw_stream(spark: SparkSession, source: str, *, format: str = "json", options: dict | None = None) -> DataFrame:
    """Raw messages of a folder of JSON files (any file format), or of a message log (format 'kafka')."""
    if format == "kafka":
        rows = spark.readStream.format("kafka").option("subscribe", source).options(**(options or {})).load()
        return enveloped(rows.select(F.col("key").cast("string"), F.col("value").cast("string")))
    return spark.readStream.schema(schemas.RAW_MESSAGE).format(format).options(**(options or {"maxFilesPerTrigger": 10})).load(source)


def enveloped(messages: DataFrame) -> DataFrame:
    """Raw messages from (key, value). A value that is no message keeps the slot and row of its key and becomes a line
    that no parser takes, hence a dead letter."""
    m = F.from_json("value", schemas.RAW_MESSAGE)
    parts = F.split("key", ":")
    broken = m["line"].isNull() | m["slot"].isNull()
    return messages.select(
        F.when(broken, F.get(parts, F.lit(0))).otherwise(m["slot"]).alias("slot"),
        F.when(broken, F.element_at(parts, -1).try_cast("int")).otherwise(m["row_no"]).alias("row_no"),
        F.when(broken, F.col("value")).otherwise(m["line"]).alias("line"),
        F.when(broken, "gkg").otherwise(F.coalesce(m["kind"], F.lit("gkg"))).alias("kind"),
    )


def routed(raw: DataFrame) -> dict[str, DataFrame]:
    """Good rows by kind, and the dead letters. Works on batches and streams alike; never fails on data."""
    return {kind: parsers.good_rows(raw, kind) for kind in schemas.KINDS} | {"dlq": parsers.dead_letters(raw)}


STATE = {
    "events": TableSpec(f"{schemas.CLEAN_EVENT}, ingested_at TIMESTAMP_NTZ", ("event_id",), "event_id", "ingested_at"),
    "articles": TableSpec(f"{schemas.CLEAN_ARTICLE}, story_key STRING, story_id STRING, arrival STRING, ingested_at TIMESTAMP_NTZ, kept_from TIMESTAMP_NTZ", ("url_hash",), "url_hash", "kept_from", once=True),
    # What a story is decided from, by story key.
    "stories": TableSpec("story_key STRING, url_hash STRING, domain STRING, url STRING, published_at TIMESTAMP_NTZ, arrival STRING, kept_from TIMESTAMP_NTZ", ("url_hash",), "story_key", "kept_from", once=True),
    "mentions": TableSpec(f"{schemas.CLEAN_MENTION}, derived BOOLEAN, ingested_at TIMESTAMP_NTZ", ("event_id", "url_hash"), "url_hash", "ingested_at", (("url_hash", "url", "sha2(url, 256)"),)),
    "dlq": TableSpec(schemas.DEAD_LETTER, ("slot", "row_no", "kind"), "slot", once=True),
    "slots": TableSpec("slot STRING, kind STRING, md5 STRING, status STRING, attempts INT, row_count BIGINT", ("slot", "kind"), "slot"),
}


MENTION_KEY, DEAD_KEY = ["event_id", "url_hash"], ["slot", "row_no", "kind"]


def _arrival() -> Column:
    return F.struct("_slot", "row_no")


@dataclass(frozen=True)
class StateTable:
    store: RunStore
    name: str

    def read(self, *columns: str) -> DataFrame:
        return self.store.read(self.name, list(columns) or None)

    def versions(self) -> list[int]:
        """The batches whose state can still be read."""
        return self.store.versions()


class FeedStore:
    """Events, mentions, articles and dead letters that batches merge into (see RunStore). `keep` manifests stay.

    An article is stored once, with its story. Only the stories of keys that a batch brings are decided again, from the
    articles of these keys in order of arrival, so what was decided before stays. Mentions of a story's copies count for its
    main article, too, marked as derived: a batch derives them from its own mentions and for its own copies. Rows go `retention`
    after they came in or changed last; a story's copies go with its main article."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, retention: timedelta | None = timedelta(days=7), **options):
        self.spark = spark
        self.store = RunStore(spark, path, STATE, keep=retention, manifests=keep, **options)
        self.events, self.mentions, self.articles, self.dead, self.slots = (StateTable(self.store, n) for n in ("events", "mentions", "articles", "dlq", "slots"))

    def absorb(self, raw: DataFrame, batch: int, now: datetime | None = None, also: dict[str, DataFrame] | None = None) -> None:
        """Merge a batch of raw messages; a batch absorbed before changes nothing. `also`: rows of other tables of the store
        that change with it or not at all."""
        if batch <= self.store.batch:
            return
        now = now or datetime.now(UTC).replace(tzinfo=None)
        self.store.expire(now)
        raw = parsers.with_kind(raw.select("slot", "row_no", "line", "kind"))
        folder = f"{self.store.path}/parsed/b{batch:012d}"
        try:
            # Every line is parsed once, for good rows and dead letters alike.
            with ThreadPoolExecutor(3) as pool:
                parsed = dict(pool.map(lambda kind: (kind, self._parsed(raw, kind, f"{folder}/{kind}")), parsers.PARSERS))
            good = {kind: rows.where("reason is null").select(f"{parsers.PARSERS[kind][1]}.*", "row_no", F.col("slot").alias("_slot")) for kind, rows in parsed.items()}
            # The tables hardly depend on one another and a batch is small, so their jobs run side by side.
            with ThreadPoolExecutor(3) as pool:
                events = pool.submit(self._absorb_events, good["events"], batch, now)
                mentions = pool.submit(self._absorb_mentions, good["mentions"], batch, now)
                dead = pool.submit(self._absorb_dead, parsed, batch)
                fresh = self._absorb_articles(good["gkg"], batch, now)
                self._derive_mentions(mentions.result(), fresh, batch, now)
                events.result(), dead.result()
            for name, rows in (also or {}).items():
                self.store.write_run(name, rows, batch)
            self.store.commit(batch, now)
        finally:
            self.store.drop(folder)

    def _parsed(self, raw: DataFrame, kind: str, folder: str) -> DataFrame:
        """The parsed lines of a kind, written: readers open the columns that they need, in pieces of a file, where a cached
        partition would be held, and moved to other executors, whole. Good rows need their line no more."""
        rows = parsers.PARSERS[kind][0](raw.where(F.col("kind") == kind))
        rows = rows.withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line")))
        rows.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _newest(self, table: str, rows: DataFrame, at: str, known: DataFrame) -> DataFrame:
        """The newest row of each key of a batch, of equally new ones the later arrival, with what is known of the key. Known rows
        (the key, what else it follows from, and more) move with the batch's, so that nothing is moved for a join."""
        rows = rows.withColumns({"arrival": _arrival(), "_new": F.lit(True)}).drop("row_no", "_slot")
        also = {c: F.max(c) for c in known.columns if c.startswith("_")}
        order = F.when(F.col("_new"), F.struct(at, "arrival"))
        return self.store.best(table, rows.unionByName(known, allowMissingColumns=True), order, also).drop("arrival", "_new")

    def _absorb_events(self, events: DataFrame, batch: int, now: datetime) -> None:
        """An event is replaced only by one added later."""
        known = self.store.lookup("events", events, ["event_id"], ["event_id", "date_added"]).withColumnRenamed("date_added", "_known")
        events = self._newest("events", events, "date_added", known)
        newer = F.col("_known").isNull() | (F.col("_known") < F.col("date_added"))
        self.store.write_run("events", events.where(newer).drop("_known").withColumn("ingested_at", _moment(now)), batch)

    def _absorb_articles(self, articles: DataFrame, batch: int, now: datetime) -> DataFrame:
        """The batch's articles that are new, with their stories, written."""
        in_order = F.concat_ws(":", F.lpad(F.lit(batch).cast("string"), 12, "0"), "_slot", F.lpad(F.col("row_no").cast("string"), 10, "0"))
        articles = articles.withColumn("arrival", in_order).drop("row_no", "_slot")
        known = self.store.lookup("articles", articles, ["url_hash"], ["url_hash"])
        fresh = dedup.first_by(articles, "url_hash", ["arrival"], known)
        fresh = fresh.withColumn("story_key", S.story_key(F.col("title"))).persist()
        facts = ["story_key", "url_hash", "domain", "url", "published_at", "arrival"]
        past = self.store.lookup("stories", fresh, ["story_key"])
        both = past.select(*facts).unionByName(fresh.select(*facts)).withColumn("article_id", F.col("url_hash"))
        stories = dedup.group_stories(both).select(F.col("article_id").alias("url_hash"), "story_id")
        heads = past.select(F.col("url_hash").alias("story_id"), F.col("kept_from").alias("_head"))
        # A copy is kept from when its main article came in, so that both go on the same day.
        times = {"ingested_at": _moment(now), "kept_from": F.coalesce("_head", _moment(now))}
        decided = stories.join(heads, "story_id", "left")
        written = self.store.write_run("articles", fresh.join(decided, "url_hash").withColumns(times), batch)
        self.store.write_run("stories", written.select(*facts, "kept_from"), batch)
        fresh.unpersist()
        return written

    def _absorb_mentions(self, mentions: DataFrame, batch: int, now: datetime) -> DataFrame:
        """The batch's mentions that count, written: one is replaced if it was derived, or by one made later; what comes in is real."""
        known = self.store.lookup("mentions", mentions, MENTION_KEY, [*MENTION_KEY, "url", "derived", "mention_time"])
        known = known.select(*MENTION_KEY, "url", F.col("derived").alias("_derived"), F.col("mention_time").alias("_known"))
        newer = F.col("_known").isNull() | F.col("_derived") | (F.col("_known") < F.col("mention_time"))
        real = self._newest("mentions", mentions, "mention_time", known).where(newer).drop("_derived", "_known")
        return self.store.write_run("mentions", real.withColumns({"derived": F.lit(False), "ingested_at": _moment(now)}), batch)

    def _derive_mentions(self, real: DataFrame, fresh: DataFrame, batch: int, now: datetime) -> None:
        """Mentions of main articles that follow from the batch's mentions of copies and from known mentions of its copies."""
        told = ["url_hash", "url", "story_id"]
        named = self.store.lookup("articles", real, ["url_hash"], told).unionByName(fresh.select(*told))
        copies = fresh.where("story_id <> url_hash").select(*told)
        earlier = self.store.lookup("mentions", copies, ["url_hash"], [*MENTION_KEY, "derived", "mention_time"])
        sources = named.unionByName(copies).where("story_id <> url_hash").distinct().select("url_hash", F.col("story_id").alias("article_id")).persist()
        if sources.isEmpty():  # else the mentions would be dealt to meet nothing
            sources.unpersist()
            return
        of_copies = real.select(*MENTION_KEY, "derived", "mention_time").unionByName(earlier).withColumn("ingested_at", F.col("mention_time"))
        follow = dedup.derived_mentions(of_copies, sources).select("event_id", "url_hash", "derived", F.col("ingested_at").alias("mention_time")).persist()
        there = self.store.lookup("mentions", follow, MENTION_KEY, MENTION_KEY).unionByName(real.select(*MENTION_KEY))
        main = self.store.lookup("articles", follow, ["url_hash"], ["url_hash", "url"]).unionByName(fresh.select("url_hash", "url"))
        derived = follow.join(there, MENTION_KEY, "left_anti").join(main, "url_hash")
        blank = {"source_name": F.lit(None).cast("string"), "confidence": F.lit(None).cast("int"), "ingested_at": _moment(now)}
        self.store.write_run("mentions", derived.withColumns(blank), batch, "d")
        follow.unpersist()
        sources.unpersist()

    def _absorb_dead(self, parsed: dict[str, DataFrame], batch: int) -> None:
        dead = reduce(DataFrame.unionByName, map(parsers.dead_of, parsed.values())).dropDuplicates(DEAD_KEY)
        known = self.store.lookup("dlq", dead, [], DEAD_KEY)
        same = reduce(Column.__and__, [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in DEAD_KEY])
        self.store.write_run("dlq", dead.alias("d").join(known.alias("k"), same, "left_anti"), batch)


def _moment(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def run_feed(raw: DataFrame, store: FeedStore, checkpoint: str, *, every: str | None = None, clock: Callable[[], datetime] | None = None) -> StreamingQuery:
    """Absorb raw messages in micro-batches: all that are there, or new ones `every` interval without end. Offsets are
    committed after the batch's writes, so a batch that broke off comes again under its number."""
    stream = raw.writeStream.option("checkpointLocation", checkpoint)
    stream = stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)
    return stream.foreachBatch(lambda rows, n: store.absorb(rows, n, clock() if clock else None)).start()


def push_frames(articles: DataFrame) -> DataFrame:
    """Server-sent frames of new articles, one an article, whose id is the reader's next cursor."""
    data = F.to_json(F.struct(*[c for c in articles.columns if c != "seq"]))
    return articles.select("seq", F.concat(F.lit("id: "), S.encode_cursor(F.col("seq")), F.lit("\nevent: article\ndata: "), data, F.lit("\n\n")).alias("frame"))


def push(articles: DataFrame, condition, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Deliver matching new rows of a stream, micro-batch by micro-batch."""
    return articles.where(condition).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(deliver).start()


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60, key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """`requests` with allowed and retry_after: the first `limit` of each key in a fixed window pass."""
    from pyspark.sql import Window

    start = F.window(at, f"{seconds} seconds")
    w = requests.withColumn("_w", start)
    place = F.row_number().over(Window.partitionBy(key, "_w.start").orderBy(at, order))
    wait = F.greatest(F.lit(1), F.ceil((F.unix_micros(F.col("_w.end").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6)).cast("bigint")
    return w.withColumn("_k", place).select(*requests.columns, (F.col("_k") <= limit).alias("allowed"), F.when(F.col("_k") > limit, wait).otherwise(F.lit(0).cast("bigint")).alias("retry_after"))


def window_limits(attempts: DataFrame, limit: int, span: timedelta, key: str, at: str) -> DataFrame:
    """Attempts with allowed, under windows that the first attempt of a key opens.

    A key's attempts are walked in order; how many a key has is bounded by what the limiter keeps (its retention)."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        opened, used, out = None, 0, []
        for moment in pdf[at]:
            if opened is None or moment - opened >= span:
                opened, used = moment, 0
            used += 1
            out.append(used <= limit)
        return pdf.assign(allowed=out)

    return attempts.groupBy(key).applyInPandas(walk, attempts.schema.add("allowed", "boolean"))


def atomic_digest(folder: str) -> Callable[[datetime, str], None]:
    """Writer of <day>/<HHMM>.md and latest.md on the driver; a reader sees whole files only."""
    import os
    import tempfile

    def write(now: datetime, text: str) -> None:
        for target in (os.path.join(folder, f"{now:%Y-%m-%d}", f"{now:%H%M}.md"), os.path.join(folder, "latest.md")):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            handle, temporary = tempfile.mkstemp(dir=os.path.dirname(target))
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(temporary, target)

    return write
