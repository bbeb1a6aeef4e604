"""Pages of an ordered table against sorting everything, and how many files they open."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.sources.layout import By, OrderedTable, Range

ORDER = [By("at", descending=True), By("id")]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(k, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(n // 3 + 1)), float(rng.randrange(100))) for k in range(n)]


def laid(spark, path, rows, per_file=50):
    return OrderedTable.write(spark.createDataFrame(rows, "id bigint, at timestamp_ntz, tone double"), f"file://{path}", ORDER, zoned=["tone"], rows_per_file=per_file)


def plain(rows, limit, keep=lambda r: True, behind=None):
    key = lambda r: (-r[1].timestamp(), r[0])
    after = None if behind is None else (-behind[0].timestamp(), behind[1])
    return [r[0] for r in sorted(filter(keep, rows), key=key) if after is None or key(r) > after][:limit]


def test_pages_equal_sorting(spark, tmp_path):
    rows = rows_of(1000)
    table = laid(spark, tmp_path / "t", rows)
    ids = lambda page: [r.id for r in page.collect()]
    assert ids(table.page(30)) == plain(rows, 30)
    cursor, walked = None, []
    for _ in range(5):
        page = table.page(40, behind=cursor).collect()
        walked += [r.id for r in page]
        cursor = (page[-1]["at"], page[-1]["id"])
    assert walked == plain(rows, 200)
    low, high = datetime(2024, 1, 3), datetime(2024, 1, 9)
    assert ids(table.page(25, ranges=[Range("at", low, high), Range("tone", 60.0)], where=[F.col("id") % 2 == 0])) == plain(rows, 25, lambda r: low <= r[1] <= high and r[2] >= 60 and r[0] % 2 == 0)
    assert ids(table.page(500, where=[F.col("tone") == 7])) == plain(rows, 500, lambda r: r[2] == 7)
    assert ids(table.page(10, behind=(datetime(2000, 1, 1), 0))) == []
    assert ids(laid(spark, tmp_path / "e", []).page(5)) == []


@pytest.mark.parametrize("n", [600, 6000])
def test_a_page_opens_as_many_files_however_large_the_table(spark, tmp_path, n):
    rows = rows_of(n)
    table = laid(spark, tmp_path / "t", rows)
    assert table.zones.count() >= n // 100
    middle = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))[n // 2]
    assert len(table.page(20, behind=(middle[1], middle[0])).collect()) == 20 and table.opened == 2
    assert len(table.page(90, behind=(middle[1], middle[0])).collect()) == 90 and table.opened <= 6
