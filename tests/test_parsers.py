"""Lines through the parsers: URLs are worked out once, and rows are dealt before they are parsed."""

from pyspark.sql import functions as F

from pressmill.functions import scalars as S
from pressmill.operators import parsers


def test_normal_urls(spark):
    urls = [
        (" HTTP://Www.X.com//a/1/?b=1#f ", "http://www.x.com//a/1?b=1"), ("///p//", "/p"), ("x", "x"), ("", ""), ("#f", ""), ("//H?", "//h"), ("a:b/?q", "a:b?q"), (None, None),
    ]
    got = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "k int, u string").select("k", S.normalize_url(F.col("u")).alias("n"), S.url_hash(F.col("u")).alias("h")).orderBy("k").collect()
    assert [r.n for r in got] == [want for _, want in urls] and got[-1].h is None


def test_a_line_takes_its_url_apart_once(spark):
    raw = spark.createDataFrame([("s", 1, "\t".join(["7", "", "20240301003000", "", "n", "http://E.com/a/"] + [""] * 10))], "slot string, row_no int, line string")
    found = parsers.parse_mentions(raw.withColumn("kind", F.lit("mentions"))).select("reason", "mention.*")
    assert [(r.reason, r.url) for r in found.collect()] == [(None, "http://e.com/a")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 4  # scheme, host, path, query


def test_customers_of_one_row_group_are_dealt(spark, tmp_path):
    from pressmill.plans.queries import QUERIES

    spark.range(1, 200).selectExpr("id AS c_custkey", "'A' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["parsed_events"](spark, str(tmp_path))
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 199
