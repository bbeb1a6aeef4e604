"""Predicates over articles, shared by every query. Each takes column names, so it binds to any table."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.scalars import InvalidRequest, check_negativity
from pressmill.operators.patterns import holding


@dataclass(frozen=True)
class ArticleFilter:
    """What a reader may ask for; None asks for nothing. A theme ending in * is a prefix."""

    time_from: datetime | None = None
    time_to: datetime | None = None
    theme: str | None = None
    domain: str | None = None
    text: str | None = None
    min_negativity: float | None = None

    def __post_init__(self):
        check_negativity(self.min_negativity)


def theme_condition(themes: Column, theme: str) -> Column:
    if theme.endswith("*"):
        return F.exists(themes, lambda t: t.startswith(theme[:-1]))
    return F.array_contains(themes, theme)


def conditions(f: ArticleFilter, *, published="published_at", themes="themes", domain="domain", title="title", tone="tone_neg") -> list[Column]:
    """The filter as a list of conditions: comparisons on plain columns first, which reach the Parquet scan."""
    out = []
    if f.time_from is not None:
        out.append(F.col(published) >= F.lit(f.time_from).cast("timestamp_ntz"))
    if f.time_to is not None:
        out.append(F.col(published) <= F.lit(f.time_to).cast("timestamp_ntz"))
    if f.domain is not None:
        out.append(F.col(domain) == f.domain)
    if f.min_negativity is not None:
        out.append(F.col(tone) >= F.lit(f.min_negativity).cast("float"))  # tones are stored as 4-byte floats
    if f.theme is not None:
        out.append(theme_condition(F.col(themes), f.theme))
    if f.text is not None:
        out.append(F.contains(F.lower(F.col(title)), F.lit(f.text.lower())))
    return out


def matching(articles: DataFrame, f: ArticleFilter, **columns: str) -> DataFrame:
    for c in conditions(f, **columns):
        articles = articles.where(c)
    return articles


def before_key(published: datetime, article_id, *, at="published_at", key="article_id") -> Column:
    """Rows after the key under newest first, id ascending."""
    moment = F.lit(published).cast("timestamp_ntz")
    return (F.col(at) < moment) | ((F.col(at) == moment) & (F.col(key) > article_id))


def newest_first(articles: DataFrame, limit: int, *, at="published_at", key="article_id") -> DataFrame:
    return articles.orderBy(F.desc(at), F.asc(key)).limit(limit)


def start_after(explicit: int | None, stored: int | None) -> int | None:
    """Which cursor a feed read starts from: the explicit one, else the stored one, else none (the time window)."""
    return explicit if explicit is not None else stored


def new_since(articles: DataFrame, limit: int, *, after_seq: int | None = None, since: datetime | None = None, seq="seq", ingested="ingested_at") -> DataFrame:
    """Oldest unseen first: after a cursor, else inside the first-read window."""
    if after_seq is not None:
        articles = articles.where(F.col(seq) > after_seq)
    elif since is not None:
        articles = articles.where(F.col(ingested) >= F.lit(since).cast("timestamp_ntz"))
    return articles.orderBy(seq).limit(limit)


SALTS = 16
_SUBSCRIBABLE = {"theme", "domain", "text", "min_negativity"}


def subscription(spec: dict) -> ArticleFilter:
    """A subscriber's filter; an empty one matches all, unknown keys and a bare * are refused."""
    extra = set(spec) - _SUBSCRIBABLE
    if extra:
        raise InvalidRequest(f"unknown filter keys: {', '.join(sorted(extra))}")
    if spec.get("theme") == "*":
        raise InvalidRequest("a theme prefix must not be empty")
    return ArticleFilter(**{f.name: spec.get(f.name) for f in fields(ArticleFilter) if f.name in _SUBSCRIBABLE})


def match_subscriptions(articles: DataFrame, subscriptions: DataFrame, key: str = "article_id") -> DataFrame:
    """(subscription_id, articles.*) for every match of many filters (subscription_id, theme, domain, text, min_negativity).

    Each filter is filed under one of its conditions: the domain, theme or beginning of a theme that the fewest articles have,
    else its text, else its least tone. An article is looked up under what it has, all by equality: its domain, its themes,
    their beginnings of the lengths that are asked for, the texts that it holds (by one automaton), the whole tones up to its
    own. What is found meets its other conditions then, so no filter is compared with articles at large. Ids are unique."""
    s = subscriptions.select("subscription_id", F.col("theme").alias("f_theme"), F.col("domain").alias("f_domain"), F.lower("text").alias("f_text"), F.col("min_negativity").cast("float").alias("f_tone"))
    prefix = F.col("f_theme").endswith("*")
    start = F.expr("substring(f_theme, 1, length(f_theme) - 1)")
    theme = F.when(prefix, F.struct(F.lit("prefix").alias("kind"), start.alias("value"))).when(~prefix, F.struct(F.lit("theme").alias("kind"), F.col("f_theme").alias("value")))
    domain = F.when(F.col("f_domain").isNotNull(), F.struct(F.lit("domain").alias("kind"), F.col("f_domain").alias("value")))
    lengths = [r[0] for r in s.where(prefix).select(F.length(start)).distinct().collect()]  # a few numbers

    def labels(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    begun = [F.transform(F.filter("themes", _as_long_as(n)), _start_of(n)) for n in lengths]
    has = F.concat(labels("domain", F.array("domain")), labels("theme", F.col("themes")), labels("prefix", F.concat(*begun) if begun else F.array().cast("array<string>")))
    had = articles.select(key, F.explode(has).alias("c")).select(key, "c.kind", "c.value")
    asked = s.select("subscription_id", F.explode(F.array_compact(F.array(domain, theme))).alias("c")).select("subscription_id", "c.kind", "c.value")
    common = had.join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "kind")
    filed = asked.join(common, ["kind", "value"], "left").groupBy("subscription_id").agg(F.min_by(F.struct("kind", "value"), rarity).alias("c")).select("subscription_id", "c.kind", "c.value")
    # Filters of unknown size would have Spark broadcast the articles instead, through the driver; a label that many articles
    # have is dealt over SALTS tasks.
    salted = lambda rows: rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    spread = lambda rows: rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    met = salted(had).join(spread(filed), ["kind", "value", "_salt"]).select("subscription_id", key)

    free = s.where("f_domain IS NULL AND f_theme IS NULL")
    by_text = holding(articles.select(F.col(key).alias("text_id"), F.lower("title").alias("text")), free.where("f_text <> ''").select(F.col("subscription_id").alias("pattern_id"), F.col("f_text").alias("pattern")))
    by_text = by_text.select(F.col("pattern_id").alias("subscription_id"), F.col("text_id").alias(key))
    # Tones run from 0 to 100, a filter without one or below 0 stands under -1, as every article does.
    whole = lambda c: F.least(F.greatest(F.floor(c), F.lit(-1)), F.lit(100)).cast("int")
    by_tone = free.where("f_text IS NULL OR f_text = ''").select("subscription_id", F.coalesce(whole(F.col("f_tone")), F.lit(-1)).alias("step"))
    steps = articles.select(key, F.explode(F.sequence(F.lit(-1), F.coalesce(whole(F.col("tone_neg")), F.lit(-1)))).alias("step"))
    steps = steps.join(F.broadcast(by_tone.select("step").distinct()), "step", "left_semi")  # 102 numbers at most
    met = met.unionByName(by_text).unionByName(salted(steps).join(spread(by_tone), ["step", "_salt"]).select("subscription_id", key))

    theme_ok = F.col("f_theme").isNull() | F.when(prefix, F.expr("exists(themes, t -> startswith(t, substring(f_theme, 1, length(f_theme) - 1)))")).otherwise(F.expr("array_contains(themes, f_theme)"))
    ok = theme_ok & (F.col("f_domain").isNull() | (F.col("domain") == F.col("f_domain"))) & (F.col("f_text").isNull() | F.contains(F.lower("title"), "f_text")) & (F.col("f_tone").isNull() | (F.col("tone_neg") >= F.col("f_tone")))
    return met.join(s, "subscription_id").join(articles.hint("merge"), key).where(ok).select("subscription_id", *articles.columns)


def _as_long_as(n: int):
    return lambda t: F.length(t) >= n


def _start_of(n: int):
    return lambda t: F.substring(t, 1, n)


def visible_agents(agents: DataFrame, role: str, user_id) -> DataFrame:
    """Owners and admins see every agent, members their own, others none."""
    if role in ("owner", "admin"):
        return agents
    return agents.where(F.col("owner_id") == user_id) if role == "member" else agents.where(F.lit(False))


def any_theme_starts(themes: Column, prefixes: list[str]) -> Column:
    return F.exists(themes, lambda t: F.greatest(F.lit(False), F.lit(False), *[t.startswith(p) for p in prefixes]))


def stale_vectors_cleared(rows: DataFrame, model: str) -> DataFrame:
    """Vectors of another model, or of none, are taken out together with their model name."""
    stale = F.col("embedding").isNotNull() & ~F.col("embedding_model").eqNullSafe(model)
    return rows.withColumns({"embedding": F.when(~stale, F.col("embedding")), "embedding_model": F.when(~stale, F.col("embedding_model"))})
