"""Keyed streams with late and expiring rows, against plain rules."""

import random
from datetime import datetime, timedelta

import pytest

from pressmill.streaming import keyed

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def stream(spark, folder, files, schema, column, late="10 minutes"):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}").withWatermark(column, late)


def collected(spark, out, tmp_path, name):
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_a_late_request_counts_in_its_own_window(spark, tmp_path):
    files = [[("u", at(5), 1), ("u", at(6), 2), ("v", at(7), 3)], [("u", at(65), 4)], [("u", at(10), 5), ("u", at(66), 6), ("u", at(70), 7)]]
    rows = stream(spark, tmp_path / "in", files, "user_id string, ts timestamp, event_id bigint", "ts")
    got = {r.event_id: (r.allowed, r.retry_after) for r in collected(spark, keyed.rate_limited(rows, 2, 60), tmp_path, "limited")}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (True, 0), 5: (False, 50), 6: (True, 0), 7: (False, 50)}


def test_rows_in_order_equal_the_batch_form(spark, tmp_path):
    from pressmill.streaming import feed

    rng = random.Random(2)
    rows = sorted((at(rng.randrange(400)), k, rng.choice("abc")) for k in range(120))
    files = [[(u, t, k) for t, k, u in rows[i : i + 40]] for i in (0, 40, 80)]
    schema = "user_id string, ts timestamp, event_id bigint"
    got = collected(spark, keyed.rate_limited(stream(spark, tmp_path / "in", files, schema, "ts"), 5, 60), tmp_path, "same")
    batch = feed.rate_limited(spark.createDataFrame(sum(files, []), schema), 5, 60).collect()
    assert sorted((r.event_id, r.allowed, r.retry_after) for r in got) == sorted((r.event_id, r.allowed, r.retry_after) for r in batch)


def test_windows_opened_by_the_first_attempt(spark, tmp_path):
    files = [[("u", at(50), 1), ("u", at(70), 2), ("u", at(100), 3)], [("u", at(151), 4), ("w", at(152), 5)], [("u", at(5000), 6)], [("u", at(5001), 7), ("u", at(5002), 8)]]
    rows = stream(spark, tmp_path / "in", files, "user_id string, ts timestamp, n bigint", "ts", "1 second")
    got = {r.n: r.allowed for r in collected(spark, keyed.first_attempt_limited(rows, 2, 100, key="user_id", at="ts", order="n"), tmp_path, "first")}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}


def test_hosts_are_fetched_in_turn(spark, tmp_path):
    files = [[("a", at(0), 1), ("a", at(0), 2), ("b", at(1), 3)], [("a", at(5), 4)], [("c", at(300), 9)], [("c", at(600), 10)], [("c", at(900), 11)]]
    rows = stream(spark, tmp_path / "in", files, "host string, at timestamp, seq bigint", "at", "1 second")
    got = sorted((r.host, r.seq, int((r.fetch_at - T0).total_seconds())) for r in collected(spark, keyed.paced(rows, 30), tmp_path, "paced"))
    a = [x for x in got if x[0] == "a"]
    # The newest first; each next one half a minute later; nothing lost, nothing twice.
    assert sorted(a, key=lambda x: x[2]) == [("a", 2, 0), ("a", 4, 30), ("a", 1, 60)]
    assert [x for x in got if x[0] != "a"] == [("b", 3, 1), ("c", 9, 300), ("c", 10, 600), ("c", 11, 900)]


@pytest.mark.parametrize("late", ["1 second", "1 hour"])
def test_robots_answers_expire(spark, tmp_path, late):
    files = [[("a", at(0), "deny", None), ("a", at(5), None, 1), ("b", at(6), None, 2)], [("a", at(90), None, 3), ("a", at(120), None, 4)], [("a", at(130), "allow", None), ("a", at(131), None, 5)]]
    rows = stream(spark, tmp_path / "in", files, "host string, at timestamp, robots string, request_id bigint", "at", late)
    got = {r.request_id: r.robots for r in collected(spark, keyed.answered(rows, 100), tmp_path, "robots" + late.replace(" ", ""))}
    assert got == {1: "deny", 2: None, 3: "deny", 4: None, 5: "allow"}
