"""The stream end to end: files of raw lines through the router into the store, replayed, and pushed on."""

from datetime import datetime

from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.streaming import feed

SLOT = "20240301000000"


def article(k, domain, url, title, themes="TAX_A;TAX_B"):
    c = [""] * 27
    c[0], c[1], c[3], c[4], c[7], c[15], c[26] = f"g{k}", SLOT, domain, url, themes, "1.5,2,3,4,0,0,120", f"<PAGE_TITLE>{title}</PAGE_TITLE>"
    return "\t".join(c)


def mention(event, url, name):
    c = [""] * 16
    c[0], c[2], c[4], c[5], c[11] = str(event), SLOT, name, url, "80"
    return "\t".join(c)


TITLE = "Harbour bridge closed after storm damages its northern towers"
FILES = [
    [("gkg", article(1, "a.com", "http://a.com/1", TITLE)), ("gkg", article(2, "b.com", "http://b.com/1", TITLE)), ("gkg", "broken"), ("mentions", mention(7, "http://b.com/1", "b.com"))],
    [("gkg", article(3, "c.com", "http://c.com/1", TITLE)), ("gkg", article(4, "a.com", "http://a.com/1", TITLE)), ("gkg", article(5, "a.com", "http://a.com/2", TITLE)), ("mentions", mention(8, "http://c.com/1", "c.com")), ("mentions", mention(7, "http://a.com/2", "a.com"))],
]


def rows(table):
    return table.read().collect()


def test_stream_groups_stories_and_derives_mentions(spark, tmp_path):
    source, store = tmp_path / "in", feed.FeedStore(spark, f"file://{tmp_path}/state", keep=2)
    for n, lines in enumerate(FILES):
        messages = [(f"2024030100{15 * n:02d}00", k, line, kind) for k, (kind, line) in enumerate(lines)]
        spark.createDataFrame(messages, schemas.RAW_MESSAGE).coalesce(1).write.mode("append").json(f"file://{source}")
        feed.run_feed(feed.raw_stream(spark, f"file://{source}"), store, f"file://{tmp_path}/offsets").awaitTermination()
    stories = {r.url: r.story_id for r in rows(store.articles)}
    ids = {r.url: r.url_hash for r in rows(store.articles)}
    first = ids["http://a.com/1"]
    assert stories == {"http://a.com/1": first, "http://b.com/1": first, "http://c.com/1": first, "http://a.com/2": ids["http://a.com/2"]}
    got = {(r.event_id, r.url, r.derived) for r in rows(store.mentions)}
    assert got == {(7, "http://b.com/1", False), (7, "http://a.com/1", True), (8, "http://c.com/1", False), (8, "http://a.com/1", True), (7, "http://a.com/2", False)}
    assert [r.reason for r in rows(store.dead)] == ["bad_column_count"] and len(store.articles.versions()) == 2
    # A batch that comes again, and lines that come again in a later batch, change nothing.
    again = spark.createDataFrame([(SLOT, k, line, kind) for k, (kind, line) in enumerate(FILES[0] + FILES[1]) if line != "broken"], schemas.RAW_MESSAGE)
    store.absorb(again, 1)
    store.absorb(again, 2)
    assert {r.url: r.story_id for r in rows(store.articles)} == stories and {(r.event_id, r.url, r.derived) for r in rows(store.mentions)} == got


def test_push_delivers_matching_rows_once(spark, tmp_path):
    frame = spark.range(5).select(F.col("id").alias("seq"), F.concat(F.lit("t"), "id").alias("title"))
    frame.write.parquet(f"file://{tmp_path}/rows")
    seen = []
    stream = lambda: spark.readStream.schema(frame.schema).parquet(f"file://{tmp_path}/rows")
    for _ in range(2):
        feed.push(stream(), F.col("seq") > 2, lambda batch, n: seen.extend(r.frame for r in feed.push_frames(batch).collect()), f"file://{tmp_path}/offsets").awaitTermination()
    assert sorted(seen) == [f"id: {c}\nevent: article\ndata: {{\"title\":\"t{k}\"}}\n\n" for k, c in ((3, "c2VxOjM="), (4, "c2VxOjQ="))]


def test_digest_files_are_whole(tmp_path):
    feed.atomic_digest(str(tmp_path))(datetime(2024, 3, 1, 7, 5), "text")
    assert (tmp_path / "2024-03-01" / "0705.md").read_text() == (tmp_path / "latest.md").read_text() == "text"
