"""The feed's roles bound to the driver's tables, as frames and as the same thing in SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.shipping import ship


class Tables:
    """Tables of a folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        if spark.sparkContext.getCheckpointDir() is None:  # on a cluster spark.checkpoint.dir names a shared folder
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pressmill-')}")
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, frame)
        return frame


def articles(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS article_id", "o_orderkey AS seq", "o_custkey AS owner_id", "o_orderdate AS published_at", "o_orderdate AS ingested_at", "o_orderpriority AS domain",
        "concat('Order ', o_orderkey, ' ', o_orderpriority) AS title", "array(concat('STATUS_', o_orderstatus), concat('PRIO_', substr(o_orderpriority, 1, 1))) AS themes", "CAST(o_totalprice / 10000 AS FLOAT) AS tone_neg",
    )


ARTICLES = """articles AS (SELECT o_orderkey AS article_id, o_orderkey AS seq, o_custkey AS owner_id, o_orderdate AS published_at, o_orderdate AS ingested_at,
  o_orderpriority AS domain, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title, ['STATUS_' || o_orderstatus, 'PRIO_' || substr(o_orderpriority, 1, 1)] AS themes,
  CAST(o_totalprice / 10000 AS FLOAT) AS tone_neg FROM orders)"""


def mentions(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_partkey AS event_id", "l_orderkey AS article_id", "l_shipdate AS mention_time", "l_linenumber AS confidence", "l_suppkey AS source_id", "l_returnflag = 'R' AS derived")


MENTIONS = "mentions AS (SELECT l_partkey AS event_id, l_orderkey AS article_id, l_shipdate AS mention_time, l_linenumber AS confidence, l_suppkey AS source_id, l_returnflag = 'R' AS derived FROM lineitem)"


def events(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey AS event_id", "p_size AS num_mentions", "p_brand AS cameo_code")


EVENTS = "news_events AS (SELECT p_partkey AS event_id, p_size AS num_mentions, p_brand AS cameo_code FROM part)"


def texts(t: Tables) -> DataFrame:
    """Documents as articles with a headline (their first line) and a body."""
    return t.documents.selectExpr(
        "doc_id AS article_id", "doc_id AS seq", "split(coalesce(text, ''), '\n')[0] AS title", "text AS body", "source AS domain",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id % 500000 AS INT), 0) AS published_at", "lang",
    )


TEXTS = """texts AS (SELECT doc_id AS article_id, doc_id AS seq, string_split(coalesce(text, ''), chr(10))[1] AS title, text AS body, source AS domain,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 500000) AS published_at, lang FROM documents)"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.selectExpr("vec_id AS article_id", "embedding", "CAST(label AS STRING) AS embedding_model", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(vec_id % 100 AS INT), 0) AS published_at")


VECTORS = "vectors AS (SELECT vec_id AS article_id, embedding, CAST(label AS VARCHAR) AS embedding_model, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id % 100) AS published_at FROM embeddings)"


def arrivals(t: Tables) -> DataFrame:
    """Events of the stream table as arriving versions of one row a user and type."""
    return t.events.selectExpr("user_id AS id", "event_type AS kind", "ts AS seen_at", "value", "event_id AS arrival")


ARRIVALS = "arrivals AS (SELECT user_id AS id, event_type AS kind, ts AS seen_at, value, event_id AS arrival FROM events)"


def query_vector(t: Tables) -> list[float]:
    """The vector of the first row: one row, whatever the table."""
    row = t.embeddings.where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding]


def moment(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def sql_moment(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def feed_line(size: int, cells: dict[int, str]) -> str:
    """SQL of a feed line of `size` fields, those in `cells` by their expressions, the others empty."""
    return "concat_ws('\t', " + ", ".join(cells.get(k, "''") for k in range(size)) + ")"


def raw_messages(t: Tables) -> DataFrame:
    """Orders as articles and events, line items as mentions, as the lines that a feed delivers, with the batch they come in.
    A URL or event comes again with every order of its customer, a mention with every item of its part and supplier."""

    line = lambda size, cells: f"{feed_line(size, cells)} AS line"
    stamp = lambda c: f"date_format({c}, 'yyyyMMddHHmmss')"
    slot = f"{stamp('o_orderdate')} AS slot"
    url, batch = "concat('http://c.com/', o_custkey)", "CAST(o_orderkey % 3 AS INT) AS batch"
    article = {0: "string(o_orderkey)", 1: stamp("o_orderdate"), 3: "'c.com'", 4: url, 7: "'A;B'", 15: "'1,2,3,4,0,0,5'", 26: "concat('<PAGE_TITLE>Order ', o_orderkey, ' of ', o_orderpriority, '</PAGE_TITLE>')"}
    event = {0: "string(o_custkey)", 1: "date_format(o_orderdate, 'yyyyMMdd')", 26: "'010'", 29: "'1'", 31: "'1'", 32: "'1'", 33: "'1'", 59: stamp("o_orderdate"), 60: url}
    mention = {0: "string(l_partkey)", 2: stamp("l_shipdate"), 4: "'s.com'", 5: "concat('http://s.com/', l_suppkey)", 11: "string(l_linenumber)"}
    gkg = t.orders.selectExpr(slot, "CAST(o_orderkey AS INT) AS row_no", line(27, article), "'gkg' AS kind", batch)
    events_ = t.orders.selectExpr(slot, "CAST(o_orderkey AS INT) AS row_no", line(61, event), "'events' AS kind", batch)
    items = t.lineitem.selectExpr(f"{stamp('l_shipdate')} AS slot", "CAST(l_orderkey AS INT) AS row_no", line(16, mention), "'mentions' AS kind", "CAST(l_linenumber % 3 AS INT) AS batch")
    return gkg.unionByName(events_).unionByName(items)
