"""Semantics of the feed that tables of numbers do not show: text rules, dead letters, replays, grouping, fusion."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.functions import scalars as S
from pressmill.functions.shipping import ship
from pressmill.operators import dedup, merge, parsers, passages, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        (" HTTPS://News.Example.COM/a/B/ ", "https://news.example.com/a/B"),
        ("http://x.org/p?Q=1#part", "http://x.org/p?Q=1"),
        ("http://x.org", "http://x.org"),
        ("http://x.org///", "http://x.org"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, S.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(
    "title,want",
    [
        ("Council approves the new harbour bridge plan | Daily Post", "council approves the new harbour bridge plan"),
        ("Council approves the new harbour bridge plan - Region - Daily Post", "council approves the new harbour bridge plan"),
        ("Short one | Daily Post", "short one | daily post"),
        ("  Wide   SPACE  ", "wide space"),
        ("ﬁre in the old town hall of the city", "fire in the old town hall of the city"),
        ("", ""),
    ],
)
def test_story_key(spark, title, want):
    ship(spark)
    assert one(spark, S.story_key(F.lit(title))) == want


def test_page_signature_sorts_pairs_and_drops_blank_ones(spark):
    a = one(spark, S.page_signature(F.lit("http://a.org/x/Story.HTML?b=2&a=1&c=")))
    assert a == one(spark, S.page_signature(F.lit("http://other.net/y/z/story.html?a=1&b=2"))) == "story.html\na=1&b=2"


def test_dead_letters_name_the_first_reason(spark):
    line = [""] * 16
    line[0], line[2], line[4], line[5], line[11] = "77", "20240101000000", "site", "http://x.org/a", "60"
    broken = lambda k, v: "\t".join(line[:k] + [v] + line[k + 1 :])
    cases = [("\t".join(line), None), ("\t".join(line[:-1]), "bad_column_count"), (broken(0, ""), "missing_event_id"), (broken(0, "x"), "missing_event_id"), (broken(5, " "), "missing_url"), (broken(2, "2024"), "bad_field"), (broken(11, "high"), "bad_field")]
    raw = spark.createDataFrame([("20240101000000", k, text, "mentions") for k, (text, _) in enumerate(cases)], "slot string, row_no int, line string, kind string")
    assert [r.reason for r in parsers.parse_mentions(raw).orderBy("row_no").collect()] == [reason for _, reason in cases]


def test_event_upsert_is_strict_and_replays_change_nothing(spark):
    kind = "event_id long, date_added timestamp_ntz, avg_tone double, ingested_at timestamp_ntz"
    day = datetime(2024, 1, 1)
    state = spark.createDataFrame([(1, day, 1.0, day), (2, day, 2.0, day)], kind)
    later = day + timedelta(days=1)
    incoming = spark.createDataFrame([(1, day, 9.0, later), (2, later, 3.0, later), (3, day, 4.0, later)], kind)
    merged = merge.upsert_events(state, incoming)
    want = [(1, 1.0), (2, 3.0), (3, 4.0)]
    assert sorted((r.event_id, r.avg_tone) for r in merged.collect()) == want
    assert sorted((r.event_id, r.avg_tone) for r in merge.upsert_events(merged, incoming).collect()) == want


def test_stories_respect_window_and_pages(spark):
    day = datetime(2024, 1, 1)
    rows = [
        ("a", "k", "one.org", "http://one.org/p1", day, 0),
        ("b", "k", "two.org", "http://two.org/p1", day + timedelta(hours=1), 1),
        ("c", "k", "one.org", "http://one.org/p2", day + timedelta(hours=2), 2),  # the same site, another page
        ("d", "k", "six.org", "http://six.org/p1", day + timedelta(hours=49), 3),  # outside the window of a, inside that of c
        ("e", "other", None, "http://q.org/p", day, 4),
        ("a", "k", "one.org", "http://one.org/p1", day, 5),  # seen before
    ]
    frame = spark.createDataFrame(rows, "article_id string, story_key string, domain string, url string, published_at timestamp_ntz, arrival int")
    got = {r.article_id: (r.story_id, r.outcome) for r in dedup.group_stories(frame).collect()}
    assert got == {"a": ("a", "canonical"), "b": ("a", "grouped"), "c": ("c", "canonical"), "d": ("c", "grouped"), "e": ("e", "canonical")}


def test_fusion_sums_reciprocal_ranks(spark):
    day = datetime(2024, 1, 1)
    leg = lambda name, ids: search.ranked(spark.createDataFrame([(k, float(n), day) for n, k in enumerate(ids)], "article_id string, d double, published_at timestamp_ntz"), [F.col("d")], name)
    got = {r.id: r for r in search.fuse([leg("vector", ["a", "b"]), leg("keyword", ["b", "c"])], k=60).collect()}
    assert set(got) == {"a", "b", "c"}
    best = max(got.values(), key=lambda r: r.score)
    assert best.id == "b" and abs(best.score - (1 / 62 + 1 / 61)) < 1e-12 and list(best.matched_by) == ["vector", "keyword"]


def test_passages_keep_every_word_and_the_bound():
    text = "\n\n".join(" ".join(f"word{k}x{j}" for j in range(90)) + "." for k in range(9)) + "\n" + "z" * 3000
    got = passages.passages_of(text)
    assert all(0 < len(p) <= 1200 for p in got)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert passages.passages_of(" \n \n") == []
