"""Raw feed lines to typed rows or dead letters, all in column expressions.

Numbers and times are read strictly: `1_000`, Unicode digits and times of fewer digits are bad fields here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.functions import scalars as S

COLUMNS = {"gkg": 27, "events": 61, "mentions": 16}


def _time(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{14}\z"), F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))).cast("timestamp_ntz")


def _number(c: Column, kind: str) -> tuple[Column, Column]:
    """Value of an optional number, and whether it is there but not a number."""
    text = S.text_or_null(c)
    value = text.try_cast(kind)
    return value, text.isNotNull() & value.isNull()


def _first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds; null if none does."""
    return F.coalesce(*[F.when(bad, F.lit(reason)) for bad, reason in cases])


def _fields(raw: DataFrame, url: int) -> tuple[DataFrame, Column, Callable[[int], Column]]:
    """`raw` with its line split once, the fields, and one field, and with the URL in field `url`, stripped and in its normal
    form. As columns of their own they are not worked out again for every field that is read."""
    c = F.col("_fields")
    at = lambda k: F.get(c, F.lit(k))
    raw = raw.withColumn("_fields", F.split("line", "\t", -1)).withColumn("_url", S.strip(at(url)))
    return raw.withColumn("_normal", S.normalize_url(F.col("_url"))), c, at


def parse_articles(raw: DataFrame) -> DataFrame:
    """`raw` with reason (null if good) and the article."""
    raw, c, at = _fields(raw, 4)
    url, normal, extras = F.col("_url"), F.col("_normal"), at(26)
    title = S.strip(F.regexp_extract(extras, r"(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1))
    precise = F.regexp_extract(extras, r"<PAGE_PRECISEPUBTIMESTAMP>(\d{14})</PAGE_PRECISEPUBTIMESTAMP>", 1)
    published = F.coalesce(_time(precise), _time(at(1)))
    tones = F.split(at(15), ",", -1)
    tone = [S.strip(F.get(tones, F.lit(k))).try_cast("double") for k in range(4)]
    word_count = S.strip(F.get(tones, F.lit(6))).try_cast("int")
    broken = published.isNull() | word_count.isNull()
    for t in tone:
        broken = broken | t.isNull()
    reason = _first_reason((F.size(c) != COLUMNS["gkg"], "bad_column_count"), (url == "", "missing_url"), (title == "", "missing_title"), (broken, "bad_field"))
    article = F.struct(
        F.sha2(normal, 256).alias("url_hash"), at(0).alias("gkg_record_id"), F.col("slot"), normal.alias("url"), title.alias("title"),
        S.text_or_null(at(3)).alias("domain"), published.alias("published_at"),
        S.name_list(F.coalesce(F.nullif(at(8), F.lit("")), at(7))).alias("themes"), S.name_list(at(12)).alias("persons"), S.name_list(at(14)).alias("orgs"),
        F.struct(tone[0].alias("tone"), tone[1].alias("positive"), tone[2].alias("negative"), tone[3].alias("polarity"), word_count.alias("word_count")).alias("tone"),
    )
    return raw.withColumn("reason", reason).withColumn("article", F.when(F.col("reason").isNull(), article)).drop("_fields", "_url", "_normal")


def parse_events(raw: DataFrame) -> DataFrame:
    """`raw` with reason (null if good) and the event."""
    raw, c, at = _fields(raw, 60)
    event_id, url, normal, cameo = S.strip(at(0)), F.col("_url"), F.col("_normal"), S.strip(at(26))
    date = F.when(at(1).rlike(r"^\d{8}\z"), F.try_to_timestamp(at(1), F.lit("yyyyMMdd"))).cast("date")
    added = _time(at(59))
    floats = {n: _number(at(k), "double") for n, k in (("goldstein", 30), ("avg_tone", 34), ("lat", 56), ("lon", 57))}
    quad, bad_quad = _number(at(29), "int")
    counts = {n: S.strip(at(k)).try_cast("int") for n, k in (("num_mentions", 31), ("num_sources", 32), ("num_articles", 33))}
    broken = date.isNull() | added.isNull() | (cameo == "") | bad_quad | event_id.try_cast("bigint").isNull()
    for v in counts.values():
        broken = broken | v.isNull()
    for _, bad in floats.values():
        broken = broken | bad
    reason = _first_reason((F.size(c) != COLUMNS["events"], "bad_column_count"), (~event_id.rlike(r"^\d+\z"), "missing_event_id"), (url == "", "missing_url"), (broken, "bad_field"))
    actor = lambda k, t: F.struct(S.text_or_null(at(k)).alias("code"), S.text_or_null(at(k + 1)).alias("name"), S.text_or_null(at(k + 2)).alias("country"), S.text_or_null(at(t)).alias("type1"))
    place = {"name": S.text_or_null(at(52)), "country": S.text_or_null(at(53)), "adm1": S.text_or_null(at(54)), "lat": floats["lat"][0], "lon": floats["lon"][0]}
    geo = F.when(F.coalesce(*[v.cast("string") for v in place.values()]).isNotNull(), F.struct(*[v.alias(k) for k, v in place.items()]))
    event = F.struct(
        event_id.try_cast("bigint").alias("event_id"), date.alias("event_date"), actor(5, 12).alias("actor1"), actor(15, 22).alias("actor2"),
        (S.strip(at(25)) == "1").alias("is_root"), cameo.alias("cameo_code"), S.text_or_null(at(27)).alias("cameo_base"), S.text_or_null(at(28)).alias("cameo_root"),
        quad.alias("quad_class"), floats["goldstein"][0].alias("goldstein"), *[v.alias(k) for k, v in counts.items()], floats["avg_tone"][0].alias("avg_tone"),
        geo.alias("geo"), added.alias("date_added"), normal.alias("source_url"), F.sha2(normal, 256).alias("source_url_hash"),
    )
    return raw.withColumn("reason", reason).withColumn("event", F.when(F.col("reason").isNull(), event)).drop("_fields", "_url", "_normal")


def parse_mentions(raw: DataFrame) -> DataFrame:
    """`raw` with reason (null if good) and the mention."""
    raw, c, at = _fields(raw, 5)
    event_id, url, normal = S.strip(at(0)), F.col("_url"), F.col("_normal")
    when_, (confidence, bad) = _time(at(2)), _number(at(11), "int")
    broken = when_.isNull() | bad | event_id.try_cast("bigint").isNull()
    reason = _first_reason((F.size(c) != COLUMNS["mentions"], "bad_column_count"), (~event_id.rlike(r"^\d+\z"), "missing_event_id"), (url == "", "missing_url"), (broken, "bad_field"))
    mention = F.struct(
        event_id.try_cast("bigint").alias("event_id"), normal.alias("url"), F.sha2(normal, 256).alias("url_hash"),
        S.text_or_null(at(4)).alias("source_name"), when_.alias("mention_time"), confidence.alias("confidence"),
    )
    return raw.withColumn("reason", reason).withColumn("mention", F.when(F.col("reason").isNull(), mention)).drop("_fields", "_url", "_normal")


PARSERS = {"gkg": (parse_articles, "article"), "events": (parse_events, "event"), "mentions": (parse_mentions, "mention")}


def with_kind(raw: DataFrame) -> DataFrame:
    """Messages of before kinds existed are articles."""
    return raw.withColumn("kind", F.coalesce("kind", F.lit("gkg")))


def good_rows(raw: DataFrame, kind: str) -> DataFrame:
    parse, name = PARSERS[kind]
    return parse(with_kind(raw).where(F.col("kind") == kind)).where("reason is null").select(f"{name}.*")


def dead_of(parsed: DataFrame) -> DataFrame:
    """Dead letters of parsed lines; the line is cut to the dead letter's length."""
    return parsed.where("reason is not null").select("reason", "slot", "row_no", F.substring("line", 1, schemas.DEAD_LETTER_CHARS).alias("line"), "kind")


def dead_letters(raw: DataFrame) -> DataFrame:
    """Every line that does not parse, of all kinds."""
    known = with_kind(raw)
    gkg, events, mentions = (dead_of(parse(known.where(F.col("kind") == kind))) for kind, (parse, _) in PARSERS.items())
    return gkg.unionByName(events).unionByName(mentions)
