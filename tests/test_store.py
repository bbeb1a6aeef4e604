"""The state of runs against plain dictionaries, and the feed store's late, replayed, broken and expired rows."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.streaming import feed
from pressmill.streaming.store import BUCKET, RunStore, TableSpec
from tests.test_stream import SLOT, TITLE, article, mention

NOW = datetime(2024, 3, 1)
SPEC = {"t": TableSpec("k BIGINT, v STRING, seen TIMESTAMP_NTZ", ("k",), "k", "seen"), "log": TableSpec("k BIGINT, line STRING", ("k",), "k")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string, seen timestamp_ntz")


def put(store, spark, batch, rows, now=None):
    store.write_run("t", frame(spark, rows), batch)
    store.commit(batch, now)


def test_runs_equal_a_dictionary(spark, tmp_path):
    store, rng, plain = RunStore(spark, f"file://{tmp_path}/s", SPEC, buckets=4, fan=3, keep=None), random.Random(1), {}
    for batch in range(10):
        rows = {rng.randrange(60): (f"v{batch}", NOW + timedelta(days=rng.randrange(5))) for _ in range(12)}
        put(store, spark, batch, [(k, *x) for k, x in rows.items()])
        plain |= rows
        assert max(store.runs("t").count(level) for level in (0, 1)) < 3
    assert {r.k: (r.v, r.seen) for r in store.read("t").collect()} == plain
    some = spark.range(0, 80, 7).withColumnRenamed("id", "k")
    got = store.lookup("t", some, ["k"], ["k", "v"]).collect()
    assert sorted(map(tuple, got)) == sorted((k, plain[k][0]) for k in range(0, 80, 7) if k in plain)
    assert 2 in store.runs("t")


def test_a_lookup_reads_the_touched_partitions_only(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s", SPEC, buckets=8, keep=None)
    put(store, spark, 0, [(k, "x", NOW) for k in range(500)])
    one = spark.createDataFrame([(7,)], "k bigint")
    at = one.select(store.bucket(F.col("k"))).first()[0]
    plan = store.lookup("t", one, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert f"{BUCKET}" in plan and f"IN ({at})" in plan.replace(f"= {at})", f"IN ({at})")
    assert store.lookup("t", one, ["k"]).count() == 1 and store.lookup("t", one.limit(0), ["k"]).count() == 0


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    sizes = []
    for n in (200, 20_000):
        store = RunStore(spark, f"file://{tmp_path}/s{n}", SPEC, buckets=4, keep=None)
        put(store, spark, 0, [(k, f"value {k}", NOW) for k in range(n)])
        before = store.bytes_stored()
        put(store, spark, 1, [(k, "new", NOW) for k in range(50)])
        sizes.append((before, store.bytes_stored() - before))
    assert sizes[1][0] > 5 * sizes[0][0] and abs(sizes[1][1] - sizes[0][1]) < 200


def test_replayed_and_broken_batches(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s", SPEC, keep=None)
    put(store, spark, 0, [(1, "a", NOW)])
    put(store, spark, 0, [(1, "again", NOW)])
    assert [r.v for r in store.read("t").collect()] == ["a"]
    # A batch that broke off before its commit does not count; another attempt, of another process, writes it over.
    store.write_run("t", frame(spark, [(1, "lost", NOW), (2, "lost", NOW)]), 1)
    assert [r.v for r in store.read("t").collect()] == ["a"]
    other = RunStore(spark, f"file://{tmp_path}/s", SPEC, keep=None)
    put(other, spark, 1, [(2, "b", NOW)])
    assert sorted(r.v for r in store.read("t").collect()) == ["a", "b"]


def test_retention_drops_days(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s", SPEC, buckets=2, fan=2, keep=timedelta(days=7))
    for day in range(12):
        now = NOW + timedelta(days=day)
        store.write_run("log", spark.createDataFrame([(day, "kept for good")], "k bigint, line string"), day)
        put(store, spark, day, [(day, "x", now), (100, f"d{day}", now)], now)
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [*((d, "x") for d in range(4, 12)), (100, "d11")]
    assert store.read("log").count() == 12
    days = {p.name for p in tmp_path.glob("s/t/*/*") if p.name.startswith("_day=") and p.parent.name in {r["dir"].rsplit("/", 1)[1] for r in store.manifest()["runs"]["t"]}}
    assert min(days) == "_day=2024-03-05"
    # What was merged away is deleted once no kept manifest lists it.
    assert len(list(tmp_path.glob("s/t/*"))) <= 2 * 3 + 4 * 2


def event(k, added, cameo="010"):
    c = [""] * 61
    c[0], c[1], c[26], c[29], c[31], c[32], c[33], c[59], c[60] = str(k), "20240301", cameo, "1", "1", "1", "1", added, f"http://x.com/{k}"
    return "\t".join(c)


def messages(spark, *lines):
    return spark.createDataFrame([(SLOT, n, line, kind) for n, (kind, line) in enumerate(lines)], schemas.RAW_MESSAGE)


@pytest.fixture
def store(spark, tmp_path):
    return feed.FeedStore(spark, f"file://{tmp_path}/state", buckets=2, fan=3)


def test_late_rows_change_nothing_and_newer_ones_replace(spark, store):
    store.absorb(messages(spark, ("events", event(1, "20240301120000", "020")), ("mentions", mention(1, "http://a.com/1", "a"))), 0, NOW)
    store.absorb(messages(spark, ("events", event(1, "20240301110000", "030")), ("events", event(2, "20240301110000", "040"))), 1, NOW + timedelta(days=1))
    assert sorted((r.event_id, r.cameo_code) for r in store.events.read().collect()) == [(1, "020"), (2, "040")]
    store.absorb(messages(spark, ("events", event(1, "20240301130000", "050")), ("events", event(1, "20240301130000", "060"))), 2, NOW + timedelta(days=2))
    assert sorted((r.event_id, r.cameo_code, r.ingested_at.day) for r in store.events.read().collect()) == [(1, "060", 3), (2, "040", 2)]
    # An equally new event leaves the stored one.
    store.absorb(messages(spark, ("events", event(1, "20240301130000", "070"))), 3, NOW + timedelta(days=3))
    assert {r.cameo_code for r in store.events.read().collect()} == {"060", "040"} and store.mentions.read().count() == 1


def test_copies_go_with_their_story_and_the_key_is_free_again(spark, store):
    store.absorb(messages(spark, ("gkg", article(1, "a.com", "http://a.com/1", TITLE))), 0, NOW)
    store.absorb(messages(spark, ("gkg", article(2, "b.com", "http://b.com/1", TITLE)), ("mentions", mention(5, "http://b.com/1", "b"))), 1, NOW + timedelta(days=5))
    rows = {r.url: r for r in store.articles.read().collect()}
    assert rows["http://b.com/1"].story_id == rows["http://a.com/1"].url_hash
    assert {(r.url, r.derived) for r in store.mentions.read().collect()} == {("http://b.com/1", False), ("http://a.com/1", True)}
    store.absorb(messages(spark, ("gkg", article(3, "c.com", "http://c.com/1", TITLE))), 2, NOW + timedelta(days=8))
    # The old story went with its copy: its URL and key are new again.
    assert {r.url: r.story_id == r.url_hash for r in store.articles.read().collect()} == {"http://c.com/1": True}
    store.absorb(messages(spark, ("gkg", article(4, "d.com", "http://d.com/1", TITLE)), ("gkg", article(2, "b.com", "http://b.com/1", TITLE))), 3, NOW + timedelta(days=9))
    rows = {r.url: r for r in store.articles.read().collect()}
    assert set(rows) == {"http://b.com/1", "http://c.com/1", "http://d.com/1"} and {r.story_id for r in rows.values()} == {rows["http://c.com/1"].url_hash}


def test_dead_letters_once(spark, store):
    bad = [(None, None, "x", "gkg"), (SLOT, 3, "y", "events"), (SLOT, 3, "y", "mentions")]
    for batch in range(2):
        store.absorb(spark.createDataFrame(bad, schemas.RAW_MESSAGE), batch, NOW)
    assert sorted(r.kind for r in store.dead.read().collect()) == ["events", "gkg", "mentions"]


def test_rows_of_a_table_move_once(spark, tmp_path):
    """Keys that come once are read without a shuffle; of those that come again each row is dealt once, without its URL's hash."""
    store = feed.FeedStore(spark, f"file://{tmp_path}/s", buckets=4)
    old, new = mention(1, "http://a.com/1", "a"), mention(2, "http://a.com/1", "a")
    store.absorb(messages(spark, ("gkg", article(1, "a.com", "http://a.com/1", TITLE)), ("mentions", old), ("mentions", new)), 0, NOW)
    store.absorb(messages(spark, ("gkg", article(2, "a.com", "http://a.com/2", "Another one")), ("mentions", old), ("mentions", mention(3, "http://a.com/2", "a"))), 1, NOW)
    assert store.store.runs("articles") == store.store.runs("mentions") == [0, 0]  # no run of derived mentions where there are no copies
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(store.articles.read()) and "Exchange" not in plan(store.dead.read())
    mentions = plan(store.mentions.read("event_id", "url_hash"))
    assert mentions.count("Exchange") == 1 and "sha2" in mentions.split("Exchange")[0]
    got = sorted((r.event_id, r.url, r.url_hash) for r in store.mentions.read().collect())
    assert got == [(k, u, hashlib.sha256(u.encode()).hexdigest()) for k, u in ((1, "http://a.com/1"), (2, "http://a.com/1"), (3, "http://a.com/2"))]


def test_a_batch_does_not_hold_its_lines(spark, tmp_path, monkeypatch):
    """Raw and parsed lines are not cached, whose partitions are held whole; what a batch wrote for itself goes with it."""
    kept, frames = [], type(spark.range(0))
    plain = frames.persist
    monkeypatch.setattr(frames, "persist", lambda self, *a: (kept.append(self.columns), plain(self, *a))[1])
    store = feed.FeedStore(spark, f"file://{tmp_path}/state", buckets=2)
    store.absorb(messages(spark, ("gkg", article(1, "a.com", "http://a.com/1", TITLE)), ("gkg", "broken"), ("mentions", mention(1, "http://a.com/1", "a"))), 0, NOW)
    assert not [columns for columns in kept if "line" in columns]
    assert [r.line for r in store.dead.read().collect()] == ["broken"]
    assert store.articles.read().count() == 1 and store.mentions.read().count() == 1
    assert not list((tmp_path / "state" / "parsed").glob("*"))
