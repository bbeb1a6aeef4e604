"""Every operator as a query over the driver's tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions import scalars as S
from pressmill.operators import articles as A
from pressmill.operators import assembly, dedup, digest, evalset, filters, merge, parsers, passages, search, textindex
from pressmill.operators.vectorindex import VectorIndex, rounded
from pressmill.plans import bindings as B
from pressmill.plans.bindings import ARRIVALS, ARTICLES, EVENTS, MENTIONS, TEXTS, VECTORS, moment, sql_moment
from pressmill.sources import layout, slots, web
from pressmill.streaming import feed

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its name; `sql` is what DuckDB runs over the same tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(B.Tables(spark, folder))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


SQL_PAGE = f"article_id, domain, {sql_moment('published_at')}"
NOW = datetime(1999, 1, 1)


def page_columns():
    return ["article_id", "domain", moment("published_at")]

# --- reading articles -----------------------------------------------------------------


@query(f"""WITH {ARTICLES}, page AS (SELECT * FROM articles WHERE published_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND domain = '1-URGENT'
    AND tone_neg >= CAST(9.7 AS FLOAT) AND (published_at < TIMESTAMP '1998-06-01' OR (published_at = TIMESTAMP '1998-06-01' AND article_id > 100)) ORDER BY published_at DESC, article_id LIMIT 50),
  n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)
  SELECT {SQL_PAGE}, greatest(coalesce(c, 1), 1) AS source_count FROM page LEFT JOIN n ON l_orderkey = article_id""")
def articles_by_filter_keyset(t):
    f = filters.ArticleFilter(time_from=datetime(1996, 1, 1), time_to=datetime(1998, 12, 31), domain="1-URGENT", min_negativity=9.7)
    rows = filters.matching(B.articles(t), f).where(filters.before_key(datetime(1998, 6, 1), 100))
    return A.source_counts(filters.newest_first(rows, 50), B.mentions(t)).select(*page_columns(), "source_count")


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE published_at >= TIMESTAMP '1997-03-01' AND published_at <= TIMESTAMP '1997-03-31'")
def filter_time_range(t):
    return filters.matching(B.articles(t), filters.ArticleFilter(time_from=datetime(1997, 3, 1), time_to=datetime(1997, 3, 31))).select(*page_columns())


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE list_contains(themes, 'STATUS_P')")
def filter_theme_exact(t):
    return filters.matching(B.articles(t), filters.ArticleFilter(theme="STATUS_P")).select(*page_columns())


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE len(list_filter(themes, lambda x: starts_with(x, 'PRIO_'))) > 0")
def filter_theme_prefix(t):
    return filters.matching(B.articles(t), filters.ArticleFilter(theme="PRIO_*")).select(*page_columns())


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE domain = '5-LOW'")
def filter_domain(t):
    return filters.matching(B.articles(t), filters.ArticleFilter(domain="5-LOW")).select(*page_columns())


@query(f"WITH {TEXTS} SELECT article_id, domain FROM texts WHERE contains(lower(title), 'th%')  OR contains(lower(title), 'the ')")
def filter_text_substring(t):
    rows = B.texts(t)
    a, b = (filters.conditions(filters.ArticleFilter(text=x))[0] for x in ("TH%", "The "))
    return rows.where(a | b).select("article_id", "domain")


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE tone_neg >= CAST(42.3 AS FLOAT)")
def filter_min_negativity(t):
    return filters.matching(B.articles(t), filters.ArticleFilter(min_negativity=42.3)).select(*page_columns())


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE published_at < TIMESTAMP '1998-01-01' OR (published_at = TIMESTAMP '1998-01-01' AND article_id > 4000) ORDER BY published_at DESC, article_id LIMIT 200")
def keyset_page(t):
    a = B.articles(t)
    return filters.newest_first(a.where(filters.before_key(datetime(1998, 1, 1), 4000)), 200).select(*page_columns())


def _by_time(t):
    order = [layout.By("published_at", descending=True), layout.By("article_id")]
    return layout.OrderedTable.write(B.articles(t), layout.scratch(t.spark, "articles"), order, zoned=["tone_neg"], rows_per_file=2000)


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE published_at < TIMESTAMP '1997-05-01' OR (published_at = TIMESTAMP '1997-05-01' AND article_id > 4000) ORDER BY published_at DESC, article_id LIMIT 200")
def ordered_keyset_page(t):
    return _by_time(t).page(200, behind=(datetime(1997, 5, 1), 4000)).select(*page_columns())


@query(f"WITH {ARTICLES} SELECT {SQL_PAGE} FROM articles WHERE published_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30' AND tone_neg >= CAST(30 AS FLOAT) AND domain = '5-LOW' ORDER BY published_at DESC, article_id LIMIT 50")
def ordered_filtered_page(t):
    ranges = [layout.Range("published_at", datetime(1995, 1, 1), datetime(1996, 6, 30)), layout.Range("tone_neg", 30.0)]
    return _by_time(t).page(50, where=[F.col("domain") == "5-LOW"], ranges=ranges).select(*page_columns())


@query(f"WITH {ARTICLES} SELECT seq, {SQL_PAGE} FROM articles WHERE seq > 7000 ORDER BY seq LIMIT 100")
def ordered_cursor_page(t):
    laid = layout.OrderedTable.write(B.articles(t), layout.scratch(t.spark, "articles"), [layout.By("seq")], rows_per_file=2000)
    return laid.page(100, behind=(7000,)).select("seq", *page_columns())


@query(f"WITH {ARTICLES} SELECT seq, {SQL_PAGE} FROM articles WHERE seq > 500 ORDER BY seq LIMIT 200")
def cursor_page(t):
    return filters.new_since(B.articles(t), 200, after_seq=filters.start_after(500, 20)).select("seq", *page_columns())


@query(f"WITH {ARTICLES} SELECT seq, {SQL_PAGE} FROM articles WHERE ingested_at >= TIMESTAMP '2000-01-01' ORDER BY seq LIMIT 100")
def first_window_page(t):
    return filters.new_since(B.articles(t), 100, since=datetime(2000, 1, 1)).select("seq", *page_columns())


_SUBSCRIPTIONS = [(1, "PRIO_1", None, None, None), (2, None, "5-LOW", None, 40.0), (3, "STATUS_*", "1-URGENT", None, 45.5), (4, None, None, "order 77", None), (5, "STATUS_F", None, "99", 30.0)]


@query(f"""WITH {ARTICLES}, s(subscription_id, theme, domain_, text, tone) AS (VALUES (1, 'PRIO_1', NULL, NULL, NULL), (2, NULL, '5-LOW', NULL, 40.0), (3, 'STATUS_*', '1-URGENT', NULL, 45.5), (4, NULL, NULL, 'order 77', NULL), (5, 'STATUS_F', NULL, '99', 30.0))
  SELECT CAST(subscription_id AS INTEGER) AS subscription_id, article_id FROM articles, s WHERE (theme IS NULL OR CASE WHEN theme LIKE '%*' THEN len(list_filter(themes, lambda x: starts_with(x, theme[:-2]))) > 0 ELSE list_contains(themes, theme) END)
  AND (domain_ IS NULL OR domain = domain_) AND (text IS NULL OR contains(lower(title), lower(text))) AND (tone IS NULL OR tone_neg >= CAST(tone AS FLOAT))""")
def subscription_matches(t):
    s = t.spark.createDataFrame(_SUBSCRIPTIONS, "subscription_id int, theme string, domain string, text string, min_negativity double")
    return filters.match_subscriptions(B.articles(t), s).select("subscription_id", "article_id")


@query("SELECT c_custkey AS agent_id, c_nationkey AS owner_id FROM customer WHERE c_nationkey = 7")
def agent_scope(t):
    agents = t.customer.selectExpr("c_custkey AS agent_id", "c_nationkey AS owner_id")
    return filters.visible_agents(agents, "member", 7)


@query("SELECT o.o_orderkey AS subscription_id FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def scope_semi_join(t):
    agents = filters.visible_agents(t.customer.selectExpr("c_custkey AS agent_id", "c_nationkey AS owner_id"), "member", 7)
    return t.orders.selectExpr("o_orderkey AS subscription_id", "o_custkey AS agent_id").join(agents, "agent_id", "left_semi").select("subscription_id")


@query(f"WITH {ARTICLES} SELECT article_id FROM articles WHERE len(list_filter(themes, lambda x: starts_with(x, 'STATUS_O') OR starts_with(x, 'PRIO_2'))) > 0")
def scorer_theme_prefilter(t):
    return B.articles(t).where(filters.any_theme_starts(F.col("themes"), ["STATUS_O", "PRIO_2"])).select("article_id")


_QUEUE = "SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'ok' END AS status, o_orderdate AS created_at, o_orderdate + INTERVAL 3 DAY AS next_attempt_at, CAST(o_orderkey % 4 AS INTEGER) AS attempts FROM orders"


def _queue(t):
    return t.orders.selectExpr("o_orderkey AS seq", "CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'ok' END AS status", "o_orderdate AS created_at", "o_orderdate + INTERVAL 3 DAY AS next_attempt_at", "CAST(o_orderkey % 4 AS INT) AS attempts")


@query(f"SELECT seq FROM ({_QUEUE}) WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '1999-01-01' AND created_at >= TIMESTAMP '1998-01-01' ORDER BY seq DESC LIMIT 100")
def queue_eligible(t):
    return merge.eligible(_queue(t), NOW, timedelta(days=365), 100).select("seq")


@query(f"WITH {VECTORS} SELECT article_id, CASE WHEN embedding_model = '2' THEN embedding_model END AS embedding_model, embedding_model = '2' AS has_vector FROM vectors")
def stale_model_clear(t):
    return filters.stale_vectors_cleared(B.vectors(t), "2").select("article_id", "embedding_model", F.col("embedding").isNotNull().alias("has_vector"))


@query("SELECT event_id FROM events WHERE NOT (ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20' OR ts < TIMESTAMP '2024-01-20' - INTERVAL 12 HOUR)")
def expiry_sweep(t):
    sessions = t.events.selectExpr("event_id", "ts + INTERVAL 1 DAY AS expires_at", "ts AS last_seen")
    now = "timestamp_ntz'2024-01-20 00:00:00'"
    return sessions.where(f"NOT (expires_at <= {now} OR last_seen < {now} - INTERVAL 12 HOUR)").select("event_id")


# --- joins and enrichment -------------------------------------------------------------

_PAGE_SQL = "page AS (SELECT * FROM articles ORDER BY published_at DESC, article_id LIMIT 300)"


def _page(t):
    return filters.newest_first(B.articles(t), 300)


@query(f"""WITH {ARTICLES}, {MENTIONS}, {EVENTS}, {_PAGE_SQL}, linked AS (SELECT DISTINCT article_id, event_id FROM mentions WHERE article_id IN (SELECT article_id FROM page)),
  r AS (SELECT l.article_id, e.event_id, num_mentions, row_number() OVER (PARTITION BY l.article_id ORDER BY num_mentions DESC, e.event_id) AS k FROM linked l JOIN news_events e USING (event_id)),
  n AS (SELECT event_id, count(*) AS c FROM mentions WHERE NOT derived GROUP BY 1)
  SELECT article_id, event_id, num_mentions, coalesce(c, 0) AS mention_count FROM r LEFT JOIN n USING (event_id) WHERE k <= 3""")
def article_events_top(t):
    return A.events_of(_page(t), B.mentions(t), B.events(t), 3).select("article_id", "event_id", "num_mentions", "mention_count")


@query(f"WITH {MENTIONS} SELECT event_id, count(*) AS mention_count FROM mentions WHERE NOT derived GROUP BY 1")
def mention_count(t):
    return A.mention_counts(B.mentions(t))


@query(f"WITH {MENTIONS}, {EVENTS} SELECT article_id, event_id, cameo_code, confidence FROM mentions JOIN news_events USING (event_id)")
def mentions_join_events(t):
    return B.mentions(t).join(B.events(t), "event_id").select("article_id", "event_id", "cameo_code", "confidence")


@query(f"WITH {ARTICLES}, {_PAGE_SQL}, n AS (SELECT l_orderkey AS article_id, count(*) AS c FROM lineitem GROUP BY 1) SELECT article_id, greatest(coalesce(c, 1), 1) AS source_count FROM page LEFT JOIN n USING (article_id)")
def source_count(t):
    return A.source_counts(_page(t), B.mentions(t)).select("article_id", "source_count")


@query(f"""WITH {ARTICLES}, {_PAGE_SQL}, a AS (SELECT l_orderkey AS article_id, l_suppkey % 5 AS agent, arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey)) AS score FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2)
  SELECT article_id, agent, CAST(score AS DOUBLE) AS score FROM page JOIN a USING (article_id)""")
def latest_scores(t):
    analyses = t.lineitem.where("l_quantity > 5").selectExpr("l_orderkey AS article_id", "l_suppkey % 5 AS agent", "l_quantity AS score", "l_shipdate AS created_at", "struct(l_linenumber, l_partkey) AS analysis_id")
    return A.latest_scores(_page(t), analyses).select("article_id", F.explode("scores").alias("agent", "score"))


@query(f"""WITH {ARTICLES}, {_PAGE_SQL}, s AS (SELECT l_orderkey AS article_id, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_shipdate, l_suppkey) AS sources FROM lineitem GROUP BY 1),
  n AS (SELECT l_orderkey AS article_id, count(*) AS c FROM lineitem GROUP BY 1)
  SELECT article_id, coalesce(sources, '') AS sources, greatest(coalesce(c, 1), 1) AS source_count FROM page LEFT JOIN s USING (article_id) LEFT JOIN n USING (article_id)""")
def page_assembly(t):
    sources = t.lineitem.selectExpr("l_orderkey AS article_id", "l_shipdate AS published_at", "l_suppkey AS source_id")
    none = t.lineitem.where("false").selectExpr("l_orderkey AS article_id", "'a' AS agent", "1D AS score")
    page = A.assembled(_page(t), sources=sources, include=S.parse_include("", ("events", "scores")))
    return A.detail(page, sources, none).select("article_id", F.array_join(F.coalesce("sources", F.array().cast("array<bigint>")), ",").alias("sources"), "source_count")


@query("SELECT max(o_orderkey) AS latest_seq FROM orders")
def latest_seq(t):
    return A.latest_seq(B.articles(t))


@query("SELECT max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS last_slot, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS pending_slots, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS failed_slots, count(*) AS articles, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS newest FROM orders")
def health(t):
    state = t.orders.selectExpr("o_orderkey AS slot", "CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status")
    return A.health(B.articles(t), state).select("last_slot", "pending_slots", "failed_slots", "articles", moment("newest"))


@query("SELECT c.c_nationkey AS owner_id, count(*) AS agents, count(DISTINCT c.c_mktsegment) AS segments FROM customer c GROUP BY 1")
def owner_quota(t):
    return t.customer.groupBy(F.col("c_nationkey").alias("owner_id")).agg(F.count("*").alias("agents"), F.count_distinct("c_mktsegment").alias("segments"))


@query("SELECT c_custkey AS agent_id, n_name AS owner FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def agents_left_users(t):
    users = t.nation.where("n_regionkey <> 2")
    return t.customer.join(users, F.col("n_nationkey") == F.col("c_nationkey"), "left").selectExpr("c_custkey AS agent_id", "n_name AS owner")


@query("SELECT s_suppkey AS key_id, n_name AS agent, r_name AS owner FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def keys_lookup(t):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).selectExpr("s_suppkey AS key_id", "n_name AS agent", "r_name AS owner")


@query("SELECT vec_id AS article_id FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') ORDER BY vec_id DESC LIMIT 50")
def skip_list_anti(t):
    skip = t.events.where("event_type = 'error'").selectExpr("event_id AS article_id")
    return t.embeddings.selectExpr("vec_id AS article_id").join(skip, "article_id", "left_anti").orderBy(F.desc("article_id")).limit(50)


@query("SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3")
def embedder_skip_list(t):
    return merge.skip_list(t.events.where("event_type = 'error'").selectExpr("user_id AS key", "ts AS at"), 3, 1_000_000).select("key", "n")


@query("SELECT o_orderkey AS article_id FROM orders WHERE o_orderkey > (SELECT max(vec_id) FROM embeddings) AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def discovery(t):
    newest = t.embeddings.agg(F.coalesce(F.max("vec_id"), F.lit(-1)).alias("seen"))
    known = t.events.where("event_type = 'view'").selectExpr("event_id AS article_id")
    return t.orders.join(F.broadcast(newest), F.col("o_orderkey") > F.col("seen")).selectExpr("o_orderkey AS article_id").join(known, "article_id", "left_anti")


@query(f"""WITH {TEXTS}, p AS (SELECT doc_id AS article_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS passage FROM documents)
  SELECT p.article_id, p.idx::INTEGER AS idx, length(passage)::INTEGER AS n_chars FROM p JOIN texts USING (article_id) WHERE domain = 'src3' AND passage <> ''""")
def passages_join_articles(t):
    p = t.documents.select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("idx", "passage"))
    return p.where("passage <> ''").join(B.texts(t).where("domain = 'src3'").select("article_id"), "article_id").select("article_id", "idx", F.length("passage").alias("n_chars"))


@query(f"""WITH {TEXTS}, p AS (SELECT doc_id AS article_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents WHERE lang = 'de')
  SELECT article_id, idx::INTEGER AS idx FROM p JOIN texts USING (article_id) ORDER BY seq DESC, idx LIMIT 64""")
def unembedded_passages(t):
    p = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("idx", "passage"))
    return p.join(B.texts(t).select("article_id", "seq"), "article_id").orderBy(F.desc("seq"), "idx").limit(64).select("article_id", "idx")


@query("""SELECT a.event_id AS id, count(*) AS candidates FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id
  AND b.ts BETWEEN a.ts - INTERVAL 48 HOUR AND a.ts + INTERVAL 48 HOUR GROUP BY 1""")
def story_candidates(t):
    # A count over a range of time, so that no pair of a hot user is ever made.
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    near = Window.partitionBy("user_id", "event_type").orderBy("at").rangeBetween(-172_800_000_000, 172_800_000_000)
    counted = t.events.select(F.col("event_id").alias("id"), "user_id", "event_type", micros.alias("at")).withColumn("candidates", F.count("*").over(near) - 1)
    return counted.where("candidates > 0").select("id", "candidates")


# --- dedup and state ------------------------------------------------------------------


@query(f"WITH {ARRIVALS} SELECT id, kind, arg_min(arrival, arrival) AS arrival, round(arg_min(value, arrival), 4) AS value FROM arrivals GROUP BY 1, 2")
def url_dedup_first(t):
    rows = B.arrivals(t).withColumn("key", F.concat_ws(":", "id", "kind"))
    return dedup.first_by(rows, "key", ["arrival"]).select("id", "kind", "arrival", F.round("value", 4).alias("value"))


@query(f"WITH {ARRIVALS} SELECT id, kind, arrival, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY date_trunc('hour', seen_at) DESC, arrival DESC) AS k FROM arrivals) WHERE k = 1")
def batch_collapse_latest(t):
    rows = B.arrivals(t).withColumn("seen_at", F.date_trunc("hour", "seen_at"))
    return dedup.newest_in_batch(rows, ["id", "kind"], "seen_at", "arrival").select("id", "kind", "arrival", F.round("value", 4).alias("value"))


def _split_arrivals(t):
    rows = t.events.selectExpr("user_id AS event_id", "ts AS date_added", "value", "event_id AS arrival").withColumn("date_added", F.date_trunc("hour", "date_added"))
    state = dedup.newest_in_batch(rows.where("arrival % 2 = 0"), ["event_id"], "date_added", "arrival")
    fresh = dedup.newest_in_batch(rows.where("arrival % 2 = 1"), ["event_id"], "date_added", "arrival")
    return state, fresh


@query("""WITH r AS (SELECT user_id AS event_id, date_trunc('hour', ts) AS date_added, event_id AS arrival FROM events),
  s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, arrival % 2 ORDER BY date_added DESC, arrival DESC) AS k FROM r) WHERE k = 1)
  SELECT event_id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY date_added DESC, arrival % 2) AS j FROM s) WHERE j = 1""")
def event_upsert(t):
    state, fresh = _split_arrivals(t)
    return merge.upsert_events(state, fresh).select("event_id", "arrival")


@query("""WITH r AS (SELECT user_id AS event_id, event_type AS url_hash, date_trunc('day', ts) AS mention_time, event_id AS arrival, event_id % 4 = 0 AS derived FROM events),
  s AS (SELECT *, row_number() OVER (PARTITION BY event_id, url_hash, arrival % 2 ORDER BY mention_time DESC, arrival DESC) AS k FROM r),
  b AS (SELECT event_id, url_hash, mention_time, arrival, CASE WHEN arrival % 2 = 1 THEN false ELSE derived END AS derived FROM s WHERE k = 1)
  SELECT event_id, url_hash, arrival, derived FROM (SELECT *, row_number() OVER (PARTITION BY event_id, url_hash ORDER BY derived, mention_time DESC, arrival % 2) AS j FROM b) WHERE j = 1""")
def mention_upsert(t):
    rows = t.events.selectExpr("user_id AS event_id", "event_type AS url_hash", "date_trunc('day', ts) AS mention_time", "event_id AS arrival", "event_id % 4 = 0 AS derived")
    part = lambda k: dedup.newest_in_batch(rows.where(f"arrival % 2 = {k}"), ["event_id", "url_hash"], "mention_time", "arrival")
    return merge.upsert_mentions(part(0), part(1)).select("event_id", "url_hash", "arrival", "derived")


@query("""WITH c AS (SELECT o_orderkey AS url_hash, o_orderkey - o_orderkey % 5 AS article_id FROM orders), m AS (SELECT l_partkey AS event_id, l_orderkey AS url_hash, l_returnflag = 'R' AS derived FROM lineitem)
  SELECT DISTINCT event_id, article_id AS url_hash FROM m JOIN c USING (url_hash) WHERE NOT derived AND article_id <> url_hash AND NOT EXISTS (SELECT 1 FROM m x WHERE x.event_id = m.event_id AND x.url_hash = c.article_id)""")
def derived_mentions(t):
    sources = t.orders.selectExpr("o_orderkey AS url_hash", "o_orderkey - o_orderkey % 5 AS article_id")
    m = t.lineitem.selectExpr("l_partkey AS event_id", "l_orderkey AS url_hash", "l_returnflag = 'R' AS derived", "l_shipdate AS ingested_at")
    return dedup.derived_mentions(m, sources).select("event_id", "url_hash")


@query(f"WITH {ARRIVALS} SELECT id AS agent_id, max(arrival) AS seq FROM arrivals GROUP BY 1")
def cursor_advance(t):
    rows = B.arrivals(t).selectExpr("id AS agent_id", "arrival AS seq")
    return merge.advance_cursors(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


@query("SELECT l_orderkey AS article_id, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01')")
def retention_sweep(t):
    kept = merge.retained(t.orders.selectExpr("o_orderkey AS article_id", "o_orderdate AS ingested_at"), datetime(2001, 5, 8))
    return merge.retained_children(t.lineitem.selectExpr("l_orderkey AS article_id", "l_linenumber AS line"), kept)


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IN (SELECT o_orderkey FROM orders) AND value < 50)
  SELECT user_id AS article_id, event_type AS agent, event_id AS arrival FROM i WHERE k = 1""")
def analysis_upsert(t):
    rows = t.events.selectExpr("user_id AS article_id", "event_type AS agent", "CASE WHEN value < 50 THEN 'x' ELSE repeat('x', 70000) END AS payload", "ts AS created_at", "event_id AS arrival")
    state = rows.where("false")
    return merge.upsert_analyses(state, rows, B.articles(t))[0].select("article_id", "agent", "arrival")


@query(f"""WITH q AS ({_QUEUE}), o AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'transient' WHEN seq % 3 = 1 THEN 'unreachable' ELSE 'http_error' END AS outcome, CASE WHEN seq % 2 = 0 THEN 1800.0 ELSE 0 END AS ra FROM q),
  c AS (SELECT *, attempts + CASE WHEN status = 'pending' AND outcome = 'transient' THEN 1 ELSE 0 END AS n FROM o)
  SELECT seq, n AS attempts, CASE WHEN status <> 'pending' THEN status WHEN outcome = 'transient' AND n >= 4 THEN 'failed' WHEN outcome IN ('transient', 'unreachable') THEN 'pending' ELSE outcome END AS new_status,
  CASE WHEN status <> 'pending' THEN strftime(next_attempt_at, '%Y-%m-%d %H:%M:%S') WHEN (outcome = 'transient' AND n < 4) OR outcome = 'unreachable'
    THEN strftime(TIMESTAMP '1999-01-01' + to_seconds(greatest(CASE greatest(1, least(n, 3)) WHEN 1 THEN 900 WHEN 2 THEN 3600 ELSE 14400 END, ra)::BIGINT), '%Y-%m-%d %H:%M:%S') END AS next_attempt_at FROM c""")
def retry_transition(t):
    q = _queue(t).withColumn("url_hash", F.col("seq"))
    outcomes = t.orders.selectExpr("o_orderkey AS url_hash", "CASE o_orderkey % 3 WHEN 0 THEN 'transient' WHEN 1 THEN 'unreachable' ELSE 'http_error' END AS outcome", "CASE WHEN o_orderkey % 2 = 0 THEN 1800D ELSE 0D END AS retry_after")
    return merge.settle(q, outcomes, NOW).select("seq", "attempts", F.col("status").alias("new_status"), moment("next_attempt_at"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-30'))
  SELECT user_id AS host, event_id AS seq FROM r WHERE k = 1 ORDER BY event_id DESC LIMIT 40""")
def one_per_host(t):
    ready = t.events.selectExpr("user_id AS host", "event_id AS seq")
    last = t.events.where("event_type = 'error'").selectExpr("user_id AS host", "ts AS fetched_at", "CAST(86400 AS DOUBLE) AS delay_seconds")
    return merge.one_per_host(ready, ready.where("false").select("host"), last, datetime(2024, 1, 31), 40)


@query(f"WITH {VECTORS} SELECT article_id, CASE WHEN article_id % 2 = 0 THEN embedding_model ELSE 'new' END AS embedding_model FROM vectors")
def vector_fill(t):
    v = B.vectors(t)
    holes = v.withColumns({"embedding": F.when(F.col("article_id") % 2 == 0, F.col("embedding")), "embedding_model": F.when(F.col("article_id") % 2 == 0, F.col("embedding_model"))})
    return merge.fill_vectors(holes, v, "new").select("article_id", "embedding_model")


@query("SELECT event_id, CASE WHEN value < 5 THEN 'value' WHEN event_type = 'view' THEN 'type' END AS reason FROM events WHERE value < 5 OR event_type = 'view'")
def poison_isolation(t):
    return merge.split_good(t.events.select("event_id", "value", "event_type"), {"value": F.col("value") >= 5, "type": F.col("event_type") != "view"})[1].select("event_id", "reason")


@query(f"WITH {TEXTS}, r AS (SELECT lang, domain, min(article_id) AS representative FROM texts GROUP BY 1, 2) SELECT article_id, representative FROM texts JOIN r USING (lang, domain)")
def collapse_representative(t):
    return dedup.representatives(B.texts(t).withColumn("story_key", F.concat_ws("/", "lang", "domain")))


@query("SELECT text AS title, min(doc_id) AS arrival FROM (SELECT coalesce(string_split(text, chr(10))[1], '') AS text, doc_id FROM documents) GROUP BY 1")
def title_dedup(t):
    rows = B.texts(t).select(F.coalesce("title", F.lit("")).alias("title"), F.col("seq").alias("arrival"))
    return dedup.first_by(rows, "title", ["arrival"]).select("title", "arrival")


def _stories(t):
    rows = B.texts(t).where("title <> ''")
    return rows.select(F.col("article_id").cast("string").alias("article_id"), S.story_key(F.col("title")).alias("story_key"), "domain", F.concat(F.lit("http://x/"), (F.col("seq") % 3).cast("string")).alias("url"), "published_at", F.col("seq").alias("arrival"))


@query()
def story_grouping(t):
    return dedup.group_stories(_stories(t))


@query()
def story_batch_counters(t):
    rows = _stories(t)
    return dedup.batch_counters(dedup.group_stories(rows), rows, rows.where("false"))


# --- scalar functions -----------------------------------------------------------------

_U = "'^(?:([a-zA-Z][a-zA-Z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$'"
_NORM = f"lower(regexp_extract(url, {_U}, 1)) || '://' || lower(regexp_extract(url, {_U}, 2)) || regexp_replace(regexp_extract(url, {_U}, 3), '/+$', '') || CASE WHEN regexp_extract(url, {_U}, 4) <> '' THEN '?' || regexp_extract(url, {_U}, 4) ELSE '' END"


@query(f"SELECT page_id, {_NORM} AS normal, sha256({_NORM}) AS url_hash FROM pages")
def url_normalize_hash(t):
    return t.pages.select("page_id", S.normalize_url(F.col("url")).alias("normal"), S.url_hash(F.col("url")).alias("url_hash"))


@query(f"SELECT page_id, lower(regexp_extract(regexp_extract(url, {_U}, 2), '^(?:.*@)?([^:]*)', 1)) AS host, lower(regexp_extract(url, {_U}, 1)) || '://' || lower(regexp_extract(url, {_U}, 2)) AS origin FROM pages")
def host_and_origin(t):
    return t.pages.select("page_id", S.host_of(F.col("url")).alias("host"), S.origin_of(F.col("url")).alias("origin"))


@query(f"""WITH p AS (SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, {_U}, 3), '/'), lambda x: x <> '')[-1], '') AS last, list_sort(list_filter(string_split(regexp_extract(url, {_U}, 4), '&'), lambda x: regexp_matches(x, '=.'))) AS q FROM pages)
  SELECT page_id, lower(last) || chr(10) || array_to_string(q, '&') AS signature FROM p""")
def page_signature(t):
    return t.pages.select("page_id", S.page_signature(F.col("url")).alias("signature"))


@query("SELECT o_orderkey AS seq, rtrim(replace(replace(base64(CAST('seq:' || o_orderkey AS BLOB)), '+', '-'), '/', '_'), '') AS cursor, o_orderkey AS back FROM orders")
def cursor_codec(t):
    c = S.encode_cursor(F.col("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("seq"), c.alias("cursor"), S.decode_cursor(c).alias("back"))


@query("SELECT event_id, event_type || ',' || user_id || ';' || event_type AS raw, event_type AS names FROM events")
def name_list_parse(t):
    raw = F.concat(F.col("event_type"), F.lit(","), F.col("user_id").cast("string"), F.lit(";"), F.col("event_type"))
    return t.events.select("event_id", raw.alias("raw"), F.array_join(S.name_list(raw), "|").alias("names"))


@query(f"WITH {TEXTS} SELECT article_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS story_key FROM texts WHERE NOT regexp_matches(title, '\\s[|–—-]\\s')")
def story_key_plain(t):
    rows = B.texts(t).where(~F.col("title").rlike(r"\s[|–—\-]\s"))
    return rows.select("article_id", S.story_key(F.col("title"), fold=False).alias("story_key"))


@query()
def story_key_nfkc(t):
    return B.texts(t).select("article_id", S.story_key(F.col("title")).alias("story_key"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"
_TOKENS = f"""list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(lower(title), '[^a-z0-9\\s''-]', ' ', 'g'), '''s', ''), '\\s+'), lambda w: trim(w, '''-')),
  lambda w: length(w) >= 3 AND NOT list_contains({_STOPS}, w)), lambda w: substr(CASE WHEN suffix(w, 'ies') AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END, 1, 6))))"""


@query(f"WITH {TEXTS} SELECT article_id, array_to_string({_TOKENS}, ' ') AS tokens FROM texts")
def title_tokens(t):
    return B.texts(t).select("article_id", F.array_join(S.title_tokens(F.col("title"), cleaned=True), " ").alias("tokens"))


@query(f"""WITH {TEXTS}, p AS (SELECT article_id, {_TOKENS} AS tokens FROM texts) SELECT a.article_id AS a, b.article_id AS b FROM p a JOIN p b ON a.article_id < b.article_id WHERE len(list_intersect(a.tokens, b.tokens)) >= 3
  AND (len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens)) >= 0.75 OR len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.5)""")
def pair_match(t):
    return digest.matching_articles(_headlines(t))


@query(f"""WITH {TEXTS}, w AS (SELECT article_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9'']+'), lambda x: length(x) > 3)) AS t, list_distinct(list_filter(regexp_extract_all(lower(body), '[a-z0-9'']+'), lambda x: length(x) > 3)) AS b FROM texts WHERE body IS NOT NULL)
  SELECT article_id, round(len(list_intersect(t, b)) / greatest(1, least(len(t), len(b))), 6) AS share FROM w""")
def word_overlap(t):
    return B.texts(t).where("body IS NOT NULL").select("article_id", F.round(S.word_overlap(F.col("title"), F.col("body")), 6).alias("share"))


@query()
def clean_titles(t):
    return t.pages.select("page_id", S.clean_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("SELECT conv_id, turn, replace(replace(replace(replace(trim(translate(text, chr(10) || chr(13) || chr(9), '')), ' ', '%20'), '(', '%28'), ')', '%29'), '<', '%3C') AS link, regexp_replace(text, '([\\\\\\[\\]`*_<>|&#~])', '\\\\\\1', 'g') AS markdown FROM conversations")
def markdown_escape(t):
    return t.conversations.select("conv_id", "turn", S.encode_link(F.col("text")).alias("link"), S.escape_markdown(F.col("text")).alias("markdown"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS score FROM events")
def json_numeric_score(t):
    return t.events.select("event_id", S.numeric_score(F.col("props"), "k").alias("score"))


@query("SELECT vec_id, len(embedding) = 64 AS valid FROM embeddings")
def vector_validate(t):
    return t.embeddings.select("vec_id", S.valid_vector(F.col("embedding"), 64).alias("valid"))


@query()
def fake_embedding(t):
    return t.conversations.select("conv_id", "turn", S.embed(16)("text").alias("embedding"))


@query()
def name_extraction(t):
    return B.texts(t).select("article_id", S.extract_names(F.col("title")).alias("names"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'transient' WHEN 1 THEN 'http_error' WHEN 2 THEN 'transient' WHEN 3 THEN 'not_html' WHEN 4 THEN 'fetched' WHEN 5 THEN 'fetched' ELSE 'too_large' END AS outcome, CASE event_id % 7 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'allow' WHEN 2 THEN 'unreachable' ELSE 'parse' END AS robots FROM events")
def fetch_outcomes(t):
    k = F.col("event_id") % 7
    status = F.when(k == 0, 503).when(k == 1, 404).when(k == 2, 301).otherwise(200)
    kind = F.when(k == 3, "application/pdf").when(k == 4, "text/html; charset=utf-8").otherwise("TEXT/HTML")
    size = F.when(k == 6, web.MAX_PAGE_BYTES + 1).otherwise(1000)
    return t.events.select("event_id", web.fetch_outcome(status, kind, size).alias("outcome"), web.robots_rule(status).alias("robots"))


@query("SELECT event_id, CAST(CASE WHEN user_id % 3 = 0 THEN user_id WHEN user_id % 3 = 1 THEN 90 END AS DOUBLE) AS wait, least(2.0 * pow(2, user_id % 9), 300.0) AS backoff FROM events")
def retry_after_backoff(t):
    header = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("user_id") % 3 == 1, F.lit("Mon, 01 Jan 2024 00:01:30 GMT")).otherwise("soon")
    return t.events.select("event_id", web.retry_after_seconds(header, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("wait"), web.backoff(F.col("user_id") % 9 + 1, 2.0, 300.0).alias("backoff"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#@:]+([/?#]|$)') AS fetchable FROM pages")
def url_guard(t):
    return t.pages.select("page_id", web.fetchable_url(F.col("url")).alias("fetchable"))


# --- search ---------------------------------------------------------------------------

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DIST = f"round(1 - list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[])), 6)"


@query(f"WITH {VECTORS} SELECT article_id, {_DIST} AS distance FROM vectors ORDER BY 2, 1 LIMIT 20")
def vector_topk(t):
    return search.vector_leg(B.vectors(t), B.query_vector(t), 20).select("article_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {VECTORS} SELECT article_id, {_DIST} AS distance FROM vectors WHERE embedding_model = '2' AND published_at >= TIMESTAMP '2024-01-01 00:10:00' ORDER BY 2, 1 LIMIT 10")
def vector_topk_filtered(t):
    rows = filters.matching(B.vectors(t), filters.ArticleFilter(time_from=datetime(2024, 1, 1, 0, 10)))
    return search.vector_leg(rows, B.query_vector(t), 10, model="2").select("article_id", F.round("distance", 6).alias("distance"))


def _passages(t):
    """Four vectors an article as its passages, and the articles that a filter leaves."""
    rows = B.vectors(t)
    passages_ = rows.selectExpr("article_id div 4 AS article_id", "CAST(article_id % 4 AS INT) AS idx", "concat('p', article_id) AS passage", "embedding", "embedding_model")
    kept = rows.selectExpr("article_id div 4 AS article_id").distinct().where("article_id % 3 <> 0").withColumn("published_at", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    return passages_, kept


@query(f"""WITH c AS (SELECT vec_id // 4 AS article_id, CAST(vec_id % 4 AS INTEGER) AS idx, 'p' || vec_id AS passage, {_DIST} AS d, 1 - list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[])) AS far
    FROM embeddings WHERE label = 2 AND (vec_id // 4) % 3 <> 0 ORDER BY far, article_id, idx LIMIT 150)
  SELECT article_id, idx, passage, d AS distance FROM c QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY far, idx) = 1 ORDER BY far, article_id LIMIT 25""")
def passage_vector_leg(t):
    passages_, kept = _passages(t)
    leg = search.passage_vector_leg(passages_, kept, B.query_vector(t), 25, model="2")
    return leg.select("article_id", "idx", "passage", F.round("distance", 6).alias("distance"))


@query(f"""WITH c AS (SELECT vec_id // 4 AS id, 'p' || vec_id AS passage, label, vec_id, {_DIST} AS d FROM embeddings),
  legs AS (SELECT id, passage, 0 AS leg, row_number() OVER (ORDER BY d, vec_id) AS rank FROM c WHERE vec_id % 4 = label % 4 QUALIFY rank <= 200
    UNION ALL SELECT id, passage, 1, row_number() OVER (ORDER BY vec_id DESC) FROM c WHERE vec_id % 4 = 1 QUALIFY row_number() OVER (ORDER BY vec_id DESC) <= 200)
  SELECT id, arg_min(passage, (rank, leg)) AS passage FROM legs GROUP BY id""")
def passage_choice(t):
    """Of each article the passage of the leg where it stands highest, the first leg before the second."""
    c = B.vectors(t).withColumn("label", F.col("embedding_model").cast("int")).withColumn("distance", F.round(search.cosine_distance(F.col("embedding"), B.query_vector(t)), 6))
    c = c.select(F.expr("article_id div 4 AS id"), F.concat(F.lit("p"), "article_id").alias("passage"), "label", F.col("article_id").alias("vec_id"), "distance")
    first = c.where("vec_id % 4 = label % 4").orderBy("distance", "vec_id").limit(200).withColumn("rank", F.row_number().over(Window.orderBy("distance", "vec_id")))
    second = c.where("vec_id % 4 = 1").orderBy(F.desc("vec_id")).limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("vec_id"))))
    return search.best_passages([first, second])


@query(f"""WITH {TEXTS}, w AS (SELECT article_id, published_at, unnest(list_zip(l, range(1, len(l) + 1))) AS z FROM (SELECT article_id, published_at, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}'']*') AS l FROM texts)),
  hit AS (SELECT article_id, published_at, z[1] AS term, row_number() OVER (PARTITION BY article_id, z[1] ORDER BY z[2]) AS j FROM w WHERE z[1] IN ('the', 'la')),
  best AS (SELECT article_id, row_number() OVER (ORDER BY round(sum(1 / (j * j)), 9) DESC, published_at DESC, article_id) AS rank FROM hit WHERE j <= 256 GROUP BY article_id, published_at)
  SELECT article_id AS id, round(1 / (60 + rank), 9) AS score, 'keyword' AS matched_by, true AS degraded FROM best WHERE rank <= 20""")
def semantic_degraded(t):
    """Without an embedder a hybrid search answers from keywords alone and says so."""

    def unavailable(text: str) -> list[float]:
        raise search.EmbeddingUnavailable

    hits, degraded = search.semantic_search(B.texts(t), "the or la", unavailable, title_index=_title_index(t, "simple"))
    return hits.select("id", F.round("score", 9).alias("score"), F.array_join("matched_by", ",").alias("matched_by"), F.lit(degraded).alias("degraded"))


def _vector_index(t):
    """(index of all vectors, the queries: every vector whose id is divisible by 20)."""
    path = layout.scratch(t.spark, "vectors")
    rows = B.vectors(t)
    return VectorIndex.build(rows, path), rows.where("article_id % 20 = 0").select(F.col("article_id").alias("query"), "embedding")


_NEAREST = """SELECT q.vec_id AS query, e.vec_id AS article_id, 1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS d
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"""


@query(f"SELECT query, article_id, round(d, 4) AS distance, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(d, 7), article_id) AS INTEGER) AS place FROM ({_NEAREST})) WHERE place <= 10")
def vector_index_exact(t):
    """Lists are read until none that is left can hold a nearer vector."""
    index, queries = _vector_index(t)
    found = index.search(queries, 10, exact=True, digits=7)
    return found.select("query", "article_id", rounded(F.col("distance"), 4).alias("distance"), "place")


@query("SELECT vec_id AS query, least(10, (SELECT count(*) FROM embeddings WHERE label = 2 AND vec_id % 3 = 0)) AS found, 0 AS strangers FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_filtered(t):
    """A filter leaves few rows, and still every query is full."""
    index, queries = _vector_index(t)
    among = B.vectors(t).where("embedding_model = '2' AND article_id % 3 = 0")
    found = index.search(queries, 10, among=among).join(among.select("article_id", F.lit(0).alias("known")), "article_id", "left")
    return found.groupBy("query").agg(F.count("*").alias("found"), F.count_if(F.col("known").isNull()).cast("int").alias("strangers"))


@query("SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(t):
    """Whether the index finds 0.95 or more of the ten nearest, against the exact search over all vectors."""
    index, queries = _vector_index(t)
    true, got = index.search(queries, 10, exact=True), index.search(queries, 10)
    both = true.select("query", "article_id").join(got.select("query", "article_id", F.lit(1).alias("hit")), ["query", "article_id"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*") >= 0.95).alias("recall_reached"))


@query(f"""WITH {VECTORS}, c AS (SELECT article_id // 4 AS a, article_id % 4 AS idx, {_DIST} AS d FROM vectors ORDER BY d, article_id LIMIT 150)
  SELECT a AS article_id, idx, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, idx) AS k FROM c) WHERE k = 1 ORDER BY d, a LIMIT 20""")
def best_passage_fold(t):
    v = B.vectors(t)
    near = search.vector_leg(v, B.query_vector(t), 150).select(F.expr("article_id div 4").alias("article_id"), (F.col("article_id") % 4).alias("idx"), F.round("distance", 6).alias("distance"))
    return search.fold_passages(near, [F.asc("distance"), F.asc("article_id"), F.asc("idx")], 20)


@query(f"""WITH {ARTICLES}, v AS (SELECT article_id, published_at, row_number() OVER (ORDER BY tone_neg DESC, article_id) AS r FROM articles ORDER BY r LIMIT 50), k AS (SELECT article_id, published_at, row_number() OVER (ORDER BY published_at DESC, article_id) AS r FROM articles ORDER BY r LIMIT 50),
  u AS (SELECT *, 0 AS leg, 'vector' AS name FROM v UNION ALL SELECT *, 1, 'keyword' FROM k)
  SELECT article_id AS id, round(sum(1.0 / (60 + r)), 9) AS score, string_agg(name, ',' ORDER BY leg) AS matched_by FROM u GROUP BY 1""")
def rrf_fuse(t):
    a = B.articles(t)
    by_tone, by_time = [F.desc("tone_neg"), F.asc("article_id")], [F.desc("published_at"), F.asc("article_id")]
    legs = [search.ranked(a.orderBy(*by_tone).limit(50), by_tone, "vector"), search.ranked(a.orderBy(*by_time).limit(50), by_time, "keyword")]
    return search.fuse(legs).select("id", F.round("score", 9).alias("score"), F.array_join("matched_by", ",").alias("matched_by"))


def _title_index(t, analyzer: str = "english"):
    path = layout.scratch(t.spark, "index")
    return textindex.TextIndex.build(B.texts(t), path, text="title", key="article_id", published="published_at", analyzer=analyzer)


@query()
def keyword_leg_ranked(t):
    return search.keyword_leg(B.texts(t), 'the with -zzz OR "de la"', 50, index=_title_index(t)).select("article_id", F.round("rank", 9).alias("rank"))


_WORDS = r"""w AS (SELECT doc_id, published_at, unnest(list_zip(l, range(1, len(l) + 1))) AS z FROM
    (SELECT article_id AS doc_id, published_at, regexp_extract_all(lower(body), '[\p{L}\p{N}][\p{L}\p{N}'']*') AS l FROM texts WHERE body IS NOT NULL)),
  hit AS (SELECT doc_id, published_at, z[1] AS term, CAST(z[2] AS INTEGER) AS place, row_number() OVER (PARTITION BY doc_id, z[1] ORDER BY z[2]) AS j FROM w WHERE z[1] IN (@))"""


def _body_index(t):
    path = layout.scratch(t.spark, "index")
    return textindex.TextIndex.build(B.texts(t), path, text="body", key="article_id", published="published_at", analyzer="simple", texts_per_block=256)


def _hits(found):
    return found.select("article_id", F.round("rank", 9).alias("rank"))


@query(f"""WITH {TEXTS}, {_WORDS.replace("@", "'idiot', 'license', 'the'")}
  SELECT doc_id AS article_id, round(sum(1 / (j * j)) * 0.1 / 1.64493406685 / 3, 9) AS rank FROM hit WHERE j <= 256 AND place <= 16383 GROUP BY doc_id, published_at ORDER BY sum(1 / (j * j)) DESC, published_at DESC, doc_id LIMIT 200""")
def keyword_index_any(t):
    return _hits(_body_index(t).search("license or idiot or the", 200))


_PAIRS = """pair AS (SELECT a.doc_id, a.published_at, greatest(1 - exp(sum(ln(1 - CASE WHEN abs(a.place - b.place) <= 100 THEN 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.place - b.place) / 1.5 - 2))) ELSE 0 END))), 1e-20) AS rank
    FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.term < b.term AND a.j <= 256 AND b.j <= 256 AND a.place <= 16383 AND b.place <= 16383 GROUP BY a.doc_id, a.published_at)"""


@query(f"""WITH {TEXTS}, {_WORDS.replace("@", "'license', 'under', 'apache'")}, {_PAIRS}
  SELECT doc_id AS article_id, round(rank, 9) AS rank FROM pair JOIN (SELECT doc_id FROM hit GROUP BY doc_id HAVING count(DISTINCT term) FILTER (term <> 'apache') = 2 AND count(*) FILTER (term = 'apache') = 0) USING (doc_id)
  ORDER BY 2 DESC, published_at DESC, doc_id LIMIT 100""")
def keyword_index_all(t):
    return _hits(_body_index(t).search("license under -apache", 100))


@query(f"""WITH {TEXTS}, {_WORDS.replace("@", "'all', 'rights', 'reserved'")}, {_PAIRS}
  SELECT doc_id AS article_id, round(rank, 9) AS rank FROM pair WHERE doc_id IN (SELECT a.doc_id FROM hit a JOIN hit b ON b.doc_id = a.doc_id AND b.place = a.place + 1 JOIN hit c ON c.doc_id = a.doc_id AND c.place = a.place + 2
    WHERE a.term = 'all' AND b.term = 'rights' AND c.term = 'reserved') ORDER BY 2 DESC, published_at DESC, doc_id LIMIT 100""")
def keyword_index_phrase(t):
    return _hits(_body_index(t).search('"all rights reserved"', 100))


@query()
def passage_keyword_fold(t):
    """Lines as passages, through an index of them."""
    rows = B.texts(t).select("article_id", "published_at", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("idx", "passage"))
    path = layout.scratch(t.spark, "index")
    index = textindex.TextIndex.build(rows.withColumn("passage_id", F.struct("article_id", "idx")), path, text="passage", key="passage_id", published="published_at")
    legs = search.passage_keyword_leg(rows.drop("published_at"), B.texts(t), "licensed or rights", 50, index=index)
    return legs.select("article_id", "idx", F.round("rank", 9).alias("rank"))


@query()
def semantic_search_hybrid(t):
    rows = B.texts(t).withColumns({"embedding": S.embed(32)("title"), "embedding_model": F.lit("hash")})
    hits, _ = search.semantic_search(rows.where("title is not null"), "the with", lambda q: S.hashed_unit_vector(q, 32), model="hash")
    return hits.select("id", F.round("score", 9).alias("score"), "matched_by")


@query(r"""SELECT doc_id AS article_id, CASE WHEN length(text) <= 700 THEN text WHEN length(string_split(text, chr(10))[1]) <= 700 THEN array_to_string(list_slice(string_split(text, chr(10)), 1, len(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: length(array_to_string(list_slice(string_split(text, chr(10)), 1, i), chr(10))) <= 700))), chr(10))
  ELSE rtrim(CASE WHEN instr(substr(text, 2, 699), ' ') > 0 THEN regexp_extract(substr(text, 1, 700), '(?s)^(.+) [^ ]*$', 1) ELSE substr(text, 1, 700) END) END AS capped FROM documents WHERE text IS NOT NULL""")
def cap_text(t):
    return t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("article_id"), passages.cap_text(F.col("text"), 700).alias("capped"))


@query()
def split_passages(t):
    return passages.split_passages(t.documents, "doc_id")


# --- digest ---------------------------------------------------------------------------


def _members(t):
    return t.orders.selectExpr("o_custkey AS group_id", "o_orderkey AS article_id", "o_orderdate AS published_at", "CAST(o_orderkey % 5 + 1 AS BIGINT) AS source_count", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS tone_neg", "o_orderpriority AS domain", "array(concat('STATUS_', o_orderstatus), concat('PRIO_', substr(o_orderpriority, 1, 1))) AS themes", "o_orderpriority AS headline")


_MEMBERS = "members AS (SELECT o_custkey AS group_id, o_orderkey AS article_id, o_orderdate AS published_at, o_orderkey % 5 + 1 AS source_count, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS tone_neg, o_orderpriority AS domain, o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS pr FROM orders)"
_GROUPS = f"{_MEMBERS}, g AS (SELECT group_id, sum(source_count)::BIGINT AS sources, max(tone_neg) AS tone, arg_max(article_id, (source_count, published_at, article_id)) AS shown, max(published_at) AS newest, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, sum(source_count) * (1 + coalesce(max(tone_neg), 0) / 10) AS score FROM members GROUP BY 1)"


@query(f"WITH {_GROUPS} SELECT group_id, sources, tone, shown, domains, {sql_moment('newest')}, round(score, 6) AS score FROM g")
def group_score(t):
    return digest.rolled_up(_members(t)).select("group_id", "sources", "tone", "shown", F.array_join("domains", ",").alias("domains"), moment("newest"), F.round("score", 6).alias("score"))


@query(f"WITH {_GROUPS} SELECT CASE WHEN count(tone) > 0 THEN 'coverage and tone' ELSE 'coverage' END AS ranking FROM g")
def ranking_label(t):
    return digest.ranking_label(digest.rolled_up(_members(t)))


_LABELS = [("Open", ("STATUS_O", "PRIO_9")), ("Urgent", ("PRIO_1", "PRIO_2")), ("Done", ("STATUS_F",))]
_VOTES = f"""{_MEMBERS}, v AS (SELECT group_id, sum((st = 'O')::INT) AS a, sum((pr IN ('1', '2'))::INT) AS b, sum((st = 'F')::INT) AS c FROM members GROUP BY 1),
  lab AS (SELECT group_id, CASE WHEN greatest(a, b, c) < 3 THEN 'Other' WHEN a = greatest(a, b, c) THEN 'Open' WHEN b = greatest(a, b, c) THEN 'Urgent' ELSE 'Done' END AS label, (CASE WHEN greatest(a, b, c) < 3 THEN 0 ELSE greatest(a, b, c) END)::BIGINT AS votes FROM v)"""


@query(f"WITH {_VOTES} SELECT * FROM lab")
def section_vote(t):
    return digest.section_votes(_members(t), _LABELS, 3).withColumn("votes", F.col("votes").cast("bigint"))


@query(f"""WITH {_GROUPS}, {_VOTES[len(_MEMBERS) + 2:]}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, sources DESC, newest DESC, shown) AS k FROM g JOIN lab USING (group_id) WHERE sources >= 20),
  rest AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS place, min(k) OVER (PARTITION BY label) AS lead FROM r WHERE k > 5),
  sec AS (SELECT label, dense_rank() OVER (ORDER BY lead) AS lr, group_id, place FROM rest)
  SELECT group_id, 'top' AS block, k::INTEGER AS place FROM r WHERE k <= 5 UNION ALL SELECT group_id, 'section:' || lr || ':' || label, place::INTEGER FROM sec WHERE place <= 3 AND lr <= 3""")
def selection(t):
    m = _members(t)
    return digest.selected(digest.rolled_up(m), digest.section_votes(m, _LABELS, 3), top=5, max_sections=3, per_section=3, min_sources=20)


@query(f"""WITH {_GROUPS}, f AS (SELECT m.group_id, m.article_id, m.domain, row_number() OVER (PARTITION BY m.group_id, lower(m.domain) ORDER BY (m.article_id <> g.shown)::INT, m.source_count DESC, m.published_at DESC, m.article_id) AS k, (m.article_id <> g.shown)::INT AS nf, m.source_count, m.published_at FROM members m JOIN g USING (group_id))
  SELECT group_id, article_id, row_number() OVER (PARTITION BY group_id ORDER BY nf, source_count DESC, published_at DESC, article_id)::INTEGER AS place FROM f WHERE k = 1""")
def headline_variants(t):
    m = _members(t)
    return digest.variants(m, digest.rolled_up(m))


@query()
def digest_groups(t):
    return digest.group_headlines(_headlines(t))


def _headlines(t):
    rows = B.texts(t).where("title is not null")
    return rows.select("article_id", S.title_tokens(F.col("title"), cleaned=True).alias("tokens"), "domain", "published_at", (F.col("article_id") % 4 + 1).alias("source_count"))


@query("SELECT lower(w) AS token, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def token_index(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("token")).groupBy(F.lower("token").alias("token")).agg(F.count_distinct("p_partkey").alias("df"))


# --- retrieval test sets --------------------------------------------------------------

_REP = "rep AS (SELECT o_orderkey AS article_id, o_orderkey - o_orderkey % 3 AS representative FROM orders)"
_CLUSTERS = f"{MENTIONS}, {_REP}, cl AS (SELECT event_id, list_sort(list(DISTINCT representative)) AS members FROM mentions JOIN rep USING (article_id) GROUP BY 1 HAVING count(DISTINCT representative) >= 2)"


def _clusters(t):
    rep = t.orders.selectExpr("o_orderkey AS article_id", "o_orderkey - o_orderkey % 3 AS representative")
    return evalset.event_clusters(B.mentions(t), rep)


@query(f"WITH {_CLUSTERS} SELECT event_id, array_to_string(members, ',') AS members, members[1] AS seed FROM cl")
def event_clusters(t):
    c = _clusters(t)
    return c.join(evalset.seeds(c), "event_id").select("event_id", F.array_join("members", ",").alias("members"), "seed")


@query(f"""WITH {_CLUSTERS}, e AS (SELECT event_id, unnest(members) AS a FROM cl), loose AS (SELECT a FROM e GROUP BY 1 HAVING count(*) > 12),
  ti AS (SELECT event_id, list_sort(list(a)) AS members FROM e WHERE a NOT IN (SELECT a FROM loose) GROUP BY 1 HAVING count(*) >= 2)
  SELECT min(event_id) AS event_id, array_to_string(members, ',') AS members FROM ti GROUP BY members""")
def drop_roundups(t):
    return evalset.without_roundups(_clusters(t), 12).select("event_id", F.array_join("members", ",").alias("members"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS w FROM documents) WHERE w = lower(w) GROUP BY 1 HAVING count(*) >= 4")
def common_words(t):
    return evalset.common_words(t.documents.select(F.col("text").alias("title")))


@query("SELECT item_id AS query_id FROM benchmark b WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(trim(b.text))) OR (length(d.text) > 0 AND contains(lower(trim(b.text)), lower(d.text))))")
def query_ok(t):
    q = t.benchmark.selectExpr("item_id AS query_id", "text")
    return evalset.acceptable_queries(q, t.documents.select(F.col("text").alias("title"))).select("query_id")


_RUNS = """runs AS (SELECT l_partkey AS q, 'k' || (l_partkey % 3) AS kind, list_sort(list(DISTINCT l_orderkey) FILTER (l_linenumber <= 2)) AS expected, list(l_orderkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS vector,
  list(l_orderkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS fulltext, list(l_orderkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS hybrid FROM lineitem GROUP BY 1)"""


def _runs(t):
    rows = t.lineitem
    ids = lambda *key: F.transform(F.array_sort(F.collect_list(F.struct(*key, "l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"])
    return rows.groupBy(F.col("l_partkey").alias("q")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_orderkey")))).alias("expected"),
        ids((-F.col("l_extendedprice")).alias("p")).alias("vector"), ids((-F.col("l_quantity")).alias("p")).alias("fulltext"), ids("l_shipdate").alias("hybrid"),
    ).withColumn("kind", F.concat(F.lit("k"), (F.col("q") % 3).cast("string")))


@query(f"""WITH {_RUNS}, m AS (SELECT kind, len(list_intersect(expected, list_slice(vector, 1, 5))) / len(expected) AS r, coalesce(1.0 / list_min(list_filter(list_transform(expected, lambda e: list_position(vector, e)), lambda p: p > 0)), 0) AS rr FROM runs WHERE len(expected) > 0)
  SELECT kind, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS queries FROM m GROUP BY 1""")
def recall_mrr(t):
    m = evalset.retrieval_metrics(_runs(t).withColumn("found", F.col("vector")), ["kind"])
    return m.select("kind", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "queries")


@query(f"""WITH {_RUNS}, h AS (SELECT list_intersect(list_slice(vector, 1, 5), expected) AS v, list_intersect(list_slice(fulltext, 1, 5), expected) AS f, list_slice(hybrid, 1, 5) AS h FROM runs WHERE expected IS NOT NULL)
  SELECT sum(len(v))::BIGINT AS vector_hits, sum(len(list_filter(v, lambda x: NOT list_contains(h, x))))::BIGINT AS vector_lost, sum(len(f))::BIGINT AS fulltext_hits, sum(len(list_filter(f, lambda x: NOT list_contains(h, x))))::BIGINT AS fulltext_lost FROM h""")
def hybrid_noise(t):
    return evalset.hybrid_noise(_runs(t))


@query(f"WITH {_RUNS} SELECT q, array_to_string(list_slice(list_filter(hybrid, lambda x: x % 2 = 1), 1, 5), ',') AS found FROM runs")
def leave_one_out(t):
    runs = _runs(t).withColumn("drop", F.filter("hybrid", lambda x: x % 2 == 0)).withColumn("found", F.col("hybrid"))
    return evalset.leave_out(runs).select("q", F.array_join("found", ",").alias("found"))


@query("""WITH p AS (SELECT a.p_partkey AS s, b.p_partkey AS m, list_distinct(list_filter(regexp_extract_all(lower(a.p_name), '[a-z0-9'']+'), lambda x: length(x) > 3)) AS wa, list_distinct(list_filter(regexp_extract_all(lower(b.p_name), '[a-z0-9'']+'), lambda x: length(x) > 3)) AS wb
    FROM part a JOIN part b ON a.p_partkey % 10 = 0 AND b.p_partkey // 10 = a.p_partkey // 10 AND a.p_partkey <> b.p_partkey), o AS (SELECT *, len(list_intersect(wa, wb)) / greatest(1, least(len(wa), len(wb))) < 0.5 AS low FROM p)
  SELECT s AS event_id, coalesce(string_agg(CASE WHEN low THEN CAST(m AS VARCHAR) END, ',' ORDER BY m), '') AS expected, coalesce(string_agg(CASE WHEN NOT low THEN CAST(m AS VARCHAR) END, ',' ORDER BY m), '') AS ignored FROM o GROUP BY 1""")
def graded_split(t):
    seed = t.part.where("p_partkey % 10 = 0").selectExpr("p_partkey AS event_id", "p_partkey div 10 AS g", "p_name AS seed_title")
    m = seed.join(t.part.selectExpr("p_partkey AS article_id", "p_partkey div 10 AS g", "p_name AS title"), "g").where("event_id <> article_id")
    return evalset.graded(m).select("event_id", F.array_join("expected", ",").alias("expected"), F.array_join("ignored", ",").alias("ignored"))


@query("""WITH c AS (SELECT sum((s >= 0.5 AND quality = 1)::INT)::BIGINT AS tp, sum((s >= 0.5 AND quality <> 1)::INT)::BIGINT AS fp, sum((s < 0.5 AND quality = 1)::INT)::BIGINT AS fn, sum((s < 0.5 AND quality <> 1)::INT)::BIGINT AS tn FROM (SELECT quality, (doc_id % 10) / 10 AS s FROM labels WHERE doc_id % 11 <> 0))
  SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_metrics(t):
    scored = t.labels.select(F.col("quality").alias("truth"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 10) / 10).alias("score"))
    return evalset.confusion(scored).select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_POISSON = [0.36787944117144233 * x for x in (1, 2, 2.5, 8 / 3, 65 / 24, 163 / 60, 1957 / 720, 13700 / 5040)]  # P(a Poisson(1) number is at most 0 ... 7)


@query(f"""WITH d AS (SELECT s, CAST(quality AS DOUBLE) - toxic AS gap, CAST(('0x' || substr(md5('0:' || s || ':' || doc_id), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 AS u FROM labels, range(200) r(s)),
  w AS (SELECT s, gap, {' + '.join(f'(u > {x!r})::INT' for x in _POISSON)} AS w FROM d), m AS (SELECT sum(gap * w) / nullif(sum(w), 0) AS m FROM w GROUP BY s), o AS (SELECT list_sort(list(m)) AS m FROM m WHERE m IS NOT NULL)
  SELECT round(m[floor(len(m) * 0.025)::INT + 1], 6) AS low, round(m[floor(len(m) * 0.975)::INT + 1], 6) AS high FROM o""")
def bootstrap_interval(t):
    low_high = evalset.bootstrap_frame(t.labels.selectExpr("doc_id AS pair_id", "CAST(quality AS DOUBLE) AS a", "CAST(toxic AS DOUBLE) AS b"), 200)
    return low_high.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) <= 20")
def sampled_by_language(t):
    return assembly.sampled(t.documents.where("doc_id IS NOT NULL").select("doc_id", "lang"), 20, "doc_id", 3, ["lang"])


@query("SELECT CAST(s AS INTEGER) AS sample, (SELECT count(*) FROM labels) AS draws FROM range(100) r(s) WHERE (SELECT count(*) FROM labels) > 0")
def resample_counts(t):
    """Every resample draws as many pairs as there are, whatever the blocks."""
    return assembly.resampled(t.labels.selectExpr("doc_id AS pair_id", "CAST(quality AS DOUBLE) AS a", "CAST(toxic AS DOUBLE) AS b"), 100, per_block=64).select("sample", "draws")


@query("SELECT round(m, 6) AS mean, true AS inside FROM (SELECT avg(quality - toxic) AS m FROM labels)")
def resampled_interval(t):
    """The mean, and whether the resampled interval holds it and is about as wide as its standard error says."""
    pairs = t.labels.selectExpr("doc_id AS pair_id", "CAST(quality AS DOUBLE) AS a", "CAST(toxic AS DOUBLE) AS b")
    gap = F.col("a") - F.col("b")
    facts = pairs.agg(F.avg(gap).alias("mean"), (F.stddev(gap) / F.sqrt(F.count("*"))).alias("error"))
    wide = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("error"))
    return facts.join(assembly.resampled_interval(pairs, 1000)).select(F.round("mean", 6).alias("mean"), (F.col("mean").between(F.col("low"), F.col("high")) & wide.between(0.85, 1.15)).alias("inside"))


@query(f"""WITH {_RUNS}, m AS (SELECT kind, len(list_intersect(expected, list_slice(vector, 1, 5))) / len(expected) AS vr, len(list_intersect(expected, list_slice(hybrid, 1, 5))) / len(expected) AS hr,
    coalesce(1.0 / list_min(list_filter(list_transform(expected, lambda e: list_position(vector, e)), lambda p: p > 0)), 0) AS vm, coalesce(1.0 / list_min(list_filter(list_transform(expected, lambda e: list_position(hybrid, e)), lambda p: p > 0)), 0) AS hm FROM runs WHERE len(expected) > 0)
  SELECT kind, round(avg(hr) - avg(vr), 6) AS recall_gain, round(avg(hm) - avg(vm), 6) AS mrr_gain, avg(hr) < avg(vr) OR avg(hm) < avg(vm) AS worse FROM m GROUP BY 1""")
def methods_compared(t):
    runs = _runs(t)
    of = lambda c: evalset.retrieval_metrics(runs.withColumn("found", F.col(c)), ["kind"])
    gains = assembly.compared(of("hybrid"), of("vector"), ["kind"])
    return gains.select("kind", F.round("recall_gain", 6).alias("recall_gain"), F.round("mrr_gain", 6).alias("mrr_gain"), "worse")


@query("""WITH r AS (SELECT l_partkey AS q, l_orderkey AS id, l_linenumber AS line, l_extendedprice AS price, l_shipdate AS day FROM lineitem),
  ex AS (SELECT q, list_sort(list(DISTINCT id) FILTER (line <= 2)) AS expected FROM r GROUP BY q HAVING count(*) FILTER (line <= 2) > 0),
  legs AS (SELECT prefix, q, leg, id, CAST(row_number() OVER (PARTITION BY prefix, q, leg ORDER BY o, id) AS INTEGER) AS rank FROM (
    SELECT 'on' AS prefix, q, 'vector' AS leg, id, min(-price) AS o FROM r GROUP BY q, id UNION ALL SELECT 'off', q, 'vector', id, min(price) FROM r GROUP BY q, id
    UNION ALL SELECT p, q, 'fulltext', id, min(epoch(day)) FROM r, (VALUES ('on'), ('off')) v(p) GROUP BY p, q, id)),
  s AS (SELECT * FROM (VALUES (10), (30), (60), (100)) a(rrf_k), (VALUES (5), (10), (20)) b(candidates)),
  hit AS (SELECT prefix, rrf_k, candidates, 'hybrid' AS method, q, id, sum(CAST(1.0 AS DOUBLE) / (rrf_k + rank) ORDER BY leg) AS score FROM legs, s WHERE rank <= candidates GROUP BY ALL
    UNION ALL SELECT prefix, rrf_k, candidates, leg, q, id, CAST(1.0 AS DOUBLE) / rank FROM legs, s WHERE rank <= candidates),
  placed AS (SELECT *, row_number() OVER (PARTITION BY prefix, rrf_k, candidates, method, q ORDER BY score DESC, id) AS place FROM hit),
  each AS (SELECT prefix, rrf_k, candidates, method, q, count(*) FILTER (place <= 5 AND list_contains(expected, id)) / any_value(len(expected)) AS recall, coalesce(1.0 / min(place) FILTER (list_contains(expected, id)), 0) AS rr FROM placed JOIN ex USING (q) GROUP BY ALL)
  SELECT prefix, rrf_k, candidates, method, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS queries FROM each GROUP BY ALL""")
def sweep_grid(t):
    """24 settings over the line items of every part as two candidate lists a prefix."""
    r = t.lineitem.selectExpr("l_partkey AS query_id", "l_orderkey AS id", "l_linenumber AS line", "CAST(l_extendedprice AS DOUBLE) AS price", "CAST(unix_date(CAST(l_shipdate AS DATE)) AS DOUBLE) AS day")
    queries = r.where("line <= 2").groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("expected"))
    # Dealt by query once: what follows groups and ranks inside a task, and the orders are worked out before they are told apart.
    one = r.repartition("query_id").groupBy("query_id", "id").agg(F.min(-F.col("price")).alias("dear"), F.min("price").alias("cheap"), F.min("day").alias("early"))
    by = {("on", "vector"): "dear", ("off", "vector"): "cheap", ("on", "fulltext"): "early", ("off", "fulltext"): "early"}
    orders = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(leg).alias("leg"), F.col(o).alias("o")) for (p, leg), o in by.items()])
    told = one.select("query_id", "id", F.explode(orders).alias("x")).select("query_id", "id", "x.*")
    legs = told.withColumn("rank", F.row_number().over(Window.partitionBy("prefix", "query_id", "leg").orderBy("o", "id")))
    found = assembly.swept(queries, legs, [10, 30, 60, 100], [5, 10, 20])
    return found.select("prefix", "rrf_k", "candidates", "method", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "queries")


@query()
def hard_queries(t):
    rows = B.texts(t).where("title is not null")
    clusters = rows.groupBy(F.expr("article_id div 4").alias("event_id")).agg(F.min("article_id").alias("seed"), F.array_sort(F.collect_list("article_id")).alias("members"), F.max_by("title", "article_id").alias("paraphrase"))
    return evalset.hard_queries(clusters.where("size(members) > 1"), rows.select("article_id", "title"))


# --- queue, embedding and digest cycle ------------------------------------------------


@query(f"""SELECT q.seq, 'http://n/' || n_name AS url, q.attempts FROM ({_QUEUE}) q JOIN orders ON o_orderkey = q.seq JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE n_regionkey <> 2 AND q.status = 'pending' AND q.next_attempt_at <= TIMESTAMP '1999-01-01' AND q.created_at >= TIMESTAMP '1998-01-01' ORDER BY q.seq DESC LIMIT 100""")
def queued_pages(t):
    home = t.customer.join(F.broadcast(t.nation.where("n_regionkey <> 2")), F.col("n_nationkey") == F.col("c_nationkey")).selectExpr("c_custkey AS o_custkey", "concat('http://n/', n_name) AS url")
    articles = t.orders.join(home, "o_custkey").selectExpr("o_orderkey AS url_hash", "url")
    return merge.queued_pages(_queue(t).withColumn("url_hash", F.col("seq")), articles, NOW, timedelta(days=365), 100).select("seq", "url", "attempts")


@query(f"""WITH {TEXTS}, s AS (SELECT doc_id FROM labels WHERE quality = 0), a AS (SELECT article_id, seq, lang FROM texts WHERE article_id NOT IN (SELECT doc_id FROM s)),
  p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents WHERE lang <> 'de' AND text IS NOT NULL)
  (SELECT 'title' AS kind, CAST(article_id AS VARCHAR) AS key FROM a WHERE lang <> 'en' ORDER BY seq DESC, key LIMIT 40) UNION ALL (SELECT 'passage', doc_id || ':' || idx FROM p ORDER BY doc_id DESC, doc_id || ':' || idx LIMIT 40)""")
def embed_round(t):
    titles = B.texts(t).select(F.col("article_id").cast("string").alias("key"), "seq", F.col("title").alias("text"), F.col("lang").alias("embedding_model"))
    each = t.documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    passages = each.select(F.concat_ws(":", "doc_id", "idx").alias("key"), F.col("doc_id").alias("seq"), "text", F.when(F.col("lang") == "de", "en").alias("embedding_model"))
    skip = t.labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("key"))
    return merge.embed_round(titles, passages, skip, "en", 40).select("kind", "key")


@query(f"WITH {ARTICLES}, w AS (SELECT * FROM articles WHERE seq > 700 ORDER BY seq LIMIT 900) SELECT count(*) AS n_rows, count(*) FILTER (WHERE domain = '5-LOW') AS n_unreadable, max(seq) AS cursor FROM w")
def digest_window(t):
    rows = B.articles(t).withColumn("url", F.when(F.col("domain") != "5-LOW", F.lit("http://x/")).otherwise(F.lit(" ")))
    return digest.read_window(rows, 700, 900)[1]


@query(f"""WITH {TEXTS}, h AS (SELECT *, article_id // 4 AS group_id, row_number() OVER (PARTITION BY article_id // 4 ORDER BY article_id DESC) AS place FROM texts),
  e AS (SELECT *, CASE WHEN place <= 2 AND lang <> 'de' AND trim(coalesce(body, ''), ' ') <> '' THEN substr(trim(body, ' '), 1, 100) END AS x FROM h)
  SELECT group_id, array_to_string(list_transform(list_sort(list({{'p': place, 't': title}}) FILTER (place <= 3)), lambda v: v.t), '|') AS titles, arg_min(x, place) FILTER (x IS NOT NULL) AS excerpt, count(x) > 0 OR count(*) >= 2 AS wanted FROM e GROUP BY 1""")
def summary_plan(t):
    rows = B.texts(t).withColumn("group_id", F.expr("article_id div 4"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("article_id"))))
    bodies = rows.select("article_id", F.when(F.col("lang") != "de", "ok").otherwise("no_text").alias("body_status"), "body")
    plan = digest.summary_plan(placed.select("group_id", "article_id", "place", "title"), bodies, also=2, lookups=2, body_chars=100)
    return plan.select("group_id", F.array_join("titles", "|").alias("titles"), "excerpt", "wanted")


_SECTION_JSON = '{"Finished": ["STATUS_F"], "Urgent": ["PRIO_1", "PRIO_2"], "Open": ["STATUS_"]}'


@query(f"""WITH {ARTICLES}, v AS (SELECT article_id, (list_contains(themes, 'STATUS_F'))::INT AS a, (list_contains(themes, 'PRIO_1') OR list_contains(themes, 'PRIO_2'))::INT AS b FROM articles)
  SELECT article_id AS group_id, CASE WHEN a = 1 THEN 'Finished' WHEN b = 1 THEN 'Urgent' ELSE 'Open' END AS label FROM v""")
def section_map(t):
    rows = B.articles(t).withColumn("group_id", F.col("article_id"))
    return digest.section_votes(rows, digest.section_map(_SECTION_JSON), 1).select("group_id", "label")


@query()
def page_outcomes(t):
    return t.pages.select("page_id", passages.page_outcome(F.col("html")).alias("o")).select("page_id", "o.status", "o.text")


# --- slots and streams ----------------------------------------------------------------


@query("SELECT strftime(TIMESTAMP '2024-01-02 00:00:00' - to_minutes(15 * i), '%Y%m%d%H%M%S') AS slot FROM range(96) r(i)")
def slot_list(t):
    return slots.slots_back(t.spark, datetime(2024, 1, 2), 96)


@query("""SELECT '20240101' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || '1500' AS slot, CASE event_type WHEN 'click' THEN 'gkg' WHEN 'view' THEN 'events' ELSE 'mentions' END AS kind, md5(CAST(event_id AS VARCHAR)) AS md5,
  'http://h/20240101' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || '1500.' || CASE event_type WHEN 'click' THEN 'gkg.csv' WHEN 'view' THEN 'export.CSV' ELSE 'mentions.CSV' END || '.zip' AS url FROM events WHERE event_type IN ('click', 'view', 'signup')""")
def slot_index(t):
    tail = F.when(F.col("event_type") == "click", "gkg.csv").when(F.col("event_type") == "view", "export.CSV").when(F.col("event_type") == "signup", "mentions.CSV").otherwise("other")
    url = F.concat(F.lit("http://h/20240101"), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit("1500."), tail, F.lit(".zip"))
    return slots.parse_index(t.events.select(F.concat_ws(" ", F.lit("123"), F.md5(F.col("event_id").cast("string")), url).alias("value")))


@query("""WITH s AS (SELECT user_id AS slot, event_type AS kind, 'pending' AS status, CAST(user_id % 4 AS INTEGER) AS attempts FROM events GROUP BY ALL), p AS (SELECT user_id AS slot, event_type AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL)
  SELECT CAST(slot AS VARCHAR) AS slot, kind, CASE WHEN n IS NOT NULL THEN 'published' WHEN attempts + 1 >= 4 THEN 'failed' ELSE 'pending' END AS status, (attempts + CASE WHEN n IS NULL THEN 1 ELSE 0 END)::INTEGER AS attempts, n AS row_count FROM s LEFT JOIN p USING (slot, kind)""")
def slot_state(t):
    each = t.events.selectExpr("CAST(user_id AS STRING) AS slot", "event_type AS kind", "user_id")
    state = each.select("slot", "kind", F.lit("pending").alias("status"), (F.col("user_id") % 4).cast("int").alias("attempts"), F.lit(None).cast("bigint").alias("row_count")).distinct()
    done = each.where("kind <> 'error'").groupBy("slot", "kind").agg(F.count("*").alias("row_count"))
    return slots.advance(state, each.select("slot", "kind").distinct(), done)


@query("SELECT text AS title, lang || ';' || source AS themes FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def label_export(t):
    return slots.label_export(t.documents.select(F.col("text").alias("title"), F.array("lang", "source").alias("themes"), F.col("doc_id").alias("arrival")))


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) AS k, epoch_us(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR) - epoch_us(ts) AS left_us FROM events)
  SELECT event_id, k <= 2 AS allowed, CASE WHEN k > 2 THEN greatest(1, ceil(left_us / 1e6))::BIGINT ELSE 0 END AS retry_after FROM w""")
def rate_limit_fixed_window(t):
    return feed.rate_limited(t.events, 2, 21600).select("event_id", "allowed", "retry_after")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'bad_column_count' WHEN event_id % 3 = 1 THEN 'missing_event_id' ELSE 'missing_url' END AS reason FROM events")
def dlq_reason(t):
    k = F.col("event_id") % 3
    cells = F.when(k == 0, F.array_repeat(F.lit("1"), 15)).when(k == 1, F.array_repeat(F.lit("x"), 16)).otherwise(F.concat(F.array(F.lit("7")), F.array_repeat(F.lit(""), 15)))
    raw = t.events.select(F.lit("s").alias("slot"), F.col("event_id").cast("int").alias("row_no"), F.array_join(cells, "\t").alias("line"), F.lit("mentions").alias("kind"))
    return parsers.dead_letters(raw).select(F.col("row_no").cast("bigint").alias("event_id"), "reason")


@query("SELECT o_orderkey AS seq, 'id: ' || base64(CAST('seq:' || o_orderkey AS BLOB)) || chr(10) || 'event: article' || chr(10) || 'data: {\"o_orderstatus\":\"' || o_orderstatus || '\"}' || chr(10) || chr(10) AS frame FROM orders")
def push_frames(t):
    return feed.push_frames(t.orders.selectExpr("o_orderkey AS seq", "o_orderstatus"))


@query("""SELECT 'article' AS kind, 'http://c.com/' || o_custkey AS id, arg_min('Order ' || o_orderkey || ' of ' || o_orderpriority, (o_orderkey % 3, o_orderdate, o_orderkey)) AS value FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'event', CAST(o_custkey AS VARCHAR), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'mention', l_partkey || ' http://s.com/' || l_suppkey, strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem GROUP BY l_partkey, l_suppkey""")
def feed_store(t):
    """The whole tables as feed lines, absorbed in three batches of the store; what it then holds."""
    store = feed.FeedStore(t.spark, layout.scratch(t.spark, "feed"), retention=None, fan=2)
    messages = B.raw_messages(t)
    for batch in range(3):
        store.absorb(messages.where(F.col("batch") == batch), batch)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    parts = [
        store.articles.read("url", "title").select(F.lit("article").alias("kind"), F.col("url").alias("id"), F.col("title").alias("value")),
        store.events.read("event_id", "date_added").select(F.lit("event"), F.col("event_id").cast("string"), day("date_added")),
        store.mentions.read("event_id", "url", "mention_time").select(F.lit("mention"), F.concat_ws(" ", "event_id", "url"), day("mention_time")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


# --- whole lines through the parsers, good ones and broken ones -------------------------

_GKG = {
    0: "concat('rec-', o_orderkey)", 1: "if(o_orderkey % 17 = 0, 'bad', date_format(o_orderdate, 'yyyyMMddHHmmss'))", 3: "if(o_orderkey % 5 = 0, '', concat('D', o_custkey, '.com'))",
    4: "if(o_orderkey % 13 = 0, '  ', concat('HTTP://Www.X.com//a/', o_orderkey, '/?b=1#f'))", 7: "'V1A;V1B,5;;V1A'", 8: "if(o_orderkey % 3 = 0, '', concat('T', o_orderstatus, ',12;ECON,3;T', o_orderstatus, ',99'))",
    12: "'ann lee,1;bob;ann lee,7'", 15: "if(o_orderkey % 19 = 0, '1,2', concat('1.5,-2.25,3,', o_custkey, '.5,0,0,', o_custkey))",
    26: "concat(if(o_orderkey % 11 = 0, '', concat('<PAGE_TITLE> Order ', o_orderkey, ' </PAGE_TITLE>')), if(o_orderkey % 2 = 0, concat('<PAGE_PRECISEPUBTIMESTAMP>', date_format(o_orderdate, 'yyyyMMdd'), '123456</PAGE_PRECISEPUBTIMESTAMP>'), ''), if(o_orderkey % 23 = 0, '\t', ''))",
}


@query("""SELECT o_orderkey AS row, CASE WHEN k % 23 = 0 THEN 'bad_column_count' WHEN k % 13 = 0 THEN 'missing_url' WHEN k % 11 = 0 THEN 'missing_title' WHEN k % 19 = 0 OR (k % 17 = 0 AND k % 2 = 1) THEN 'bad_field' END AS reason,
    CASE WHEN reason IS NULL THEN 'http://www.x.com//a/' || k || '?b=1' END AS url, CASE WHEN reason IS NULL THEN sha256('http://www.x.com//a/' || k || '?b=1') END AS url_hash, CASE WHEN reason IS NULL THEN 'Order ' || k END AS title,
    CASE WHEN reason IS NULL AND k % 5 <> 0 THEN 'D' || o_custkey || '.com' END AS domain, CASE WHEN reason IS NULL THEN strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN k % 2 = 0 THEN ' 12:34:56' ELSE ' 00:00:00' END END AS published_at,
    CASE WHEN reason IS NULL THEN CASE WHEN k % 3 = 0 THEN 'V1A|V1B' ELSE 'T' || o_orderstatus || '|ECON' END END AS themes, CASE WHEN reason IS NULL THEN 'ann lee|bob|0' END AS people,
    CASE WHEN reason IS NULL THEN CAST(o_custkey + 0.5 AS DOUBLE) END AS polarity, CASE WHEN reason IS NULL THEN CAST(o_custkey AS INTEGER) END AS word_count
  FROM (SELECT *, o_orderkey AS k FROM orders)""")
def parsed_articles(t):
    raw = t.orders.selectExpr("date_format(o_orderdate, 'yyyyMMddHHmmss') AS slot", "CAST(o_orderkey AS INT) AS row_no", f"{B.feed_line(27, _GKG)} AS line", "'gkg' AS kind")
    a = parsers.parse_articles(raw).select("row_no", "reason", "article.*")
    people = F.concat_ws("|", F.array_join("persons", "|"), F.size("orgs").cast("string"))
    return a.select(F.col("row_no").cast("bigint").alias("row"), "reason", "url", "url_hash", "title", "domain", moment("published_at"), F.array_join("themes", "|").alias("themes"),
        F.when(F.col("reason").isNull(), people).alias("people"), F.col("tone.polarity").alias("polarity"), F.col("tone.word_count").alias("word_count"))


_EVENT = {
    0: "if(k % 29 = 0, 'abc', string(k))", 1: "if(k % 31 = 0, '20230229', '20240229')", 5: "concat('C', k)", 6: "if(k % 3 = 0, '', c_mktsegment)", 12: "'GOV'", 25: "if(k % 2 = 0, '1', '0')", 26: "if(k % 37 = 0, '', '040')", 27: "'04'",
    29: "if(k % 6 = 0, '', '3')", 30: "CASE WHEN k % 4 = 0 THEN '' WHEN k % 41 = 0 THEN 'x' ELSE '-2.5' END", 31: "'5'", 32: "if(k % 43 = 0, '', '2')", 33: "'7'", 34: "'0.125'", 52: "if(k % 5 = 0, 'Oslo', '')", 56: "if(k % 5 = 0, '38.5', '')",
    59: "if(k % 47 = 0, '2024030100000', '20240301003000')", 60: "if(k % 53 = 0, '', concat('http://E.com/', k, '/'))",
}


@query("""SELECT k AS row, CASE WHEN k % 29 = 0 THEN 'missing_event_id' WHEN k % 53 = 0 THEN 'missing_url' WHEN k % 31 = 0 OR k % 37 = 0 OR (k % 41 = 0 AND k % 4 <> 0) OR k % 43 = 0 OR k % 47 = 0 THEN 'bad_field' END AS reason,
    CASE WHEN reason IS NULL THEN k END AS event_id, CASE WHEN reason IS NULL THEN '2024-02-29' END AS event_date, CASE WHEN reason IS NULL THEN 'C' || k || '|' || CASE WHEN k % 3 = 0 THEN '-' ELSE c_mktsegment END || '|GOV|-' END AS actors,
    CASE WHEN reason IS NULL THEN k % 2 = 0 END AS is_root, CASE WHEN reason IS NULL THEN '040|04|-' END AS cameo, CASE WHEN reason IS NULL AND k % 6 <> 0 THEN 3 END AS quad_class, CASE WHEN reason IS NULL AND k % 4 <> 0 THEN CAST(-2.5 AS DOUBLE) END AS goldstein,
    CASE WHEN reason IS NULL THEN 14 END AS counts, CASE WHEN reason IS NULL AND k % 5 = 0 THEN 'Oslo 38.5' END AS geo, CASE WHEN reason IS NULL THEN '2024-03-01 00:30:00' END AS date_added, CASE WHEN reason IS NULL THEN 'http://e.com/' || k END AS source_url
  FROM (SELECT *, c_custkey AS k FROM customer)""")
def parsed_events(t):
    # A task reads a row group at least, and a million customers fit in one: a few bytes each are dealt before their lines are made.
    rows = t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment").repartition(2 * t.spark.sparkContext.defaultParallelism, "k")
    raw = rows.selectExpr("'s' AS slot", "CAST(k AS INT) AS row_no", f"{B.feed_line(61, _EVENT)} AS line", "'events' AS kind")
    e = parsers.parse_events(raw).select("row_no", "reason", "event.*")
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return e.select(F.col("row_no").cast("bigint").alias("row"), "reason", "event_id", F.col("event_date").cast("string").alias("event_date"), good(F.concat_ws("|", dash("actor1.code"), dash("actor1.name"), dash("actor1.type1"), dash("actor2.name"))).alias("actors"),
        "is_root", good(F.concat_ws("|", dash("cameo_code"), dash("cameo_base"), dash("cameo_root"))).alias("cameo"), "quad_class", "goldstein", (F.col("num_mentions") + F.col("num_sources") + F.col("num_articles")).alias("counts"),
        F.concat(F.col("geo.name"), F.lit(" "), F.col("geo.lat").cast("string")).alias("geo"), moment("date_added"), "source_url")


_MENTION = {
    0: "if(n % 29 = 0, '-5', string(l_partkey))", 2: "if(n % 31 = 0, '20241301000000', date_format(l_shipdate, 'yyyyMMddHHmmss'))", 4: "if(n % 3 = 0, '', concat('s', l_suppkey))", 5: "if(n % 37 = 0, '', concat(' https://M.com/', l_orderkey, '//'))",
    11: "CASE WHEN n % 4 = 0 THEN '' WHEN n % 41 = 0 THEN '8.5' ELSE '80' END",
}


@query("""SELECT l_orderkey AS "order", l_linenumber AS line, CASE WHEN n % 29 = 0 THEN 'missing_event_id' WHEN n % 37 = 0 THEN 'missing_url' WHEN n % 31 = 0 OR (n % 41 = 0 AND n % 4 <> 0) THEN 'bad_field' END AS reason,
    CASE WHEN reason IS NULL THEN l_partkey END AS event_id, CASE WHEN reason IS NULL THEN 'https://m.com/' || l_orderkey END AS url, CASE WHEN reason IS NULL AND n % 3 <> 0 THEN 's' || l_suppkey END AS source_name,
    CASE WHEN reason IS NULL THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS mention_time, CASE WHEN reason IS NULL AND n % 4 <> 0 THEN 80 END AS confidence FROM (SELECT *, l_orderkey + l_linenumber AS n FROM lineitem)""")
def parsed_mentions(t):
    raw = t.lineitem.withColumn("n", F.col("l_orderkey") + F.col("l_linenumber")).selectExpr("l_orderkey AS slot", "CAST(l_linenumber AS INT) AS row_no", f"{B.feed_line(16, _MENTION)} AS line", "'mentions' AS kind")
    m = parsers.parse_mentions(raw).select("slot", "row_no", "reason", "mention.*")
    return m.select(F.col("slot").alias("order"), F.col("row_no").cast("bigint").alias("line"), "reason", "event_id", "url", "source_name", moment("mention_time"), "confidence")


# --- small rules over whole tables ------------------------------------------------------


@query(r"SELECT doc_id, md5(regexp_replace(text, '([\\%_])', '\\\1', 'g')) AS pattern_md5, len(regexp_extract_all(text, '[\\%_]')) AS escaped FROM documents WHERE text IS NOT NULL")
def like_escape(t):
    d = t.documents.where("text IS NOT NULL")
    return d.select("doc_id", F.md5(S.escape_like(F.col("text")).cast("binary")).alias("pattern_md5"), F.size(F.regexp_extract_all("text", F.lit(r"[\\%_]"), F.lit(0))).cast("bigint").alias("escaped"))


@query(r"""SELECT p_partkey AS part, CASE WHEN length(p_name) <= 15 THEN p_name ELSE trim(CASE WHEN regexp_extract(substr(p_name, 1, 15), '^(.*)\s\S*$', 1) <> '' THEN regexp_extract(substr(p_name, 1, 15), '^(.*)\s\S*$', 1) ELSE substr(p_name, 1, 15) END) || '…' END AS clipped FROM part""")
def clip_words(t):
    return t.part.select(F.col("p_partkey").alias("part"), S.clip_words(F.col("p_name"), 15).alias("clipped"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN quality = 1 END AS relevant, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN greatest(0.0, least(1.0, (doc_id % 20) / 10 - 0.5)) END AS score,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE '' END END AS reason FROM labels""")
def model_score(t):
    """A model's answers as JSON: scores outside 0 to 1, missing reasons, unreadable answers, answers without a score."""
    score = F.concat(F.lit('"score": '), ((F.col("doc_id") % 20) / 10 - 0.5).cast("string"))
    fields = F.concat_ws(", ", F.concat(F.lit('"relevant": '), (F.col("quality") == 1).cast("string")), F.when(F.col("doc_id") % 7 != 0, score), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"reason": "r'), "doc_id", F.lit('"'))))
    answer = F.when(F.col("doc_id") % 5 == 0, "no JSON").otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    return t.labels.select("doc_id", S.model_score(answer).alias("m")).select("doc_id", "m.relevant", "m.score", "m.reason")


@query("SELECT event_id, CASE WHEN event_id % 12 = 0 THEN 0.0 ELSE least(30.0 * 2 ** (event_id % 12 - 1), 3600.0) END AS wait FROM events")
def failure_backoff(t):
    return t.events.select("event_id", web.backoff((F.col("event_id") % 12).cast("int"), 30, 3600).alias("wait"))
