"""Patterns in texts and filters on articles against plain comparison of all with all."""

import random

from pyspark.sql import functions as F

from pressmill.operators import filters
from pressmill.operators.patterns import held_by, holding


def test_holding_and_held_by_equal_plain_search(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(k, word(rng.randint(0, 60))) for k in range(120)] + [(500, None), (501, "a" * 5000), (502, "")]
    patterns = [(k, word(rng.randint(0, 5))) for k in range(60)] + [(900, None), (901, "aaa"), (902, "aaa"), (903, "é" * 30)]
    t = spark.createDataFrame(texts, "text_id int, text string")
    p = spark.createDataFrame(patterns, "pattern_id int, pattern string")
    want = {(i, j) for i, x in texts for j, y in patterns if x and y and y in x}
    for options in ({}, {"slice_chars": 20}, {"per_slice": 7}):
        got = holding(t, p, **options).collect()
        assert len(got) == len(want) and {(r.text_id, r.pattern_id) for r in got} == want
    many = [(k, word(rng.randint(0, 20))) for k in range(150)] + [(900, None), (901, "aaaaaaaaaaaaaaaa")]
    got = held_by(t.select(F.col("text_id").alias("long_id"), "text"), spark.createDataFrame(many, "inside_id int, text string")).collect()
    assert {(r.long_id, r.inside_id) for r in got} == {(i, j) for i, x in texts for j, y in many if x and y and y in x} and len(got) == len(set(got))


def test_subscriptions_equal_plain_filters(spark):
    rng = random.Random(6)
    themes = ["TAX_A", "TAX_B", "TAX_AB", "WAR", "W", "ECON_X"]
    articles = [(k, "Hot" if k % 3 else rng.choice(["a", "b", None]), rng.choice(["Storm hits port", "port strike", "", "Calm É day"]), rng.sample(themes, rng.randint(0, 3)), rng.choice([None, 0.0, 3.5, 40.0, 99.5])) for k in range(200)]
    articles += [(900, None, None, None, None)]
    pick = lambda *x: rng.choice([None, None, *x])
    subscriptions = [(k, pick("TAX_*", "TAX_A", "W*", "WAR", "NONE", "NO*"), pick("Hot", "a", "zz"), pick("PORT", "é", "storm", "none", ""), pick(0.0, 3.5, 3.6, 50.0)) for k in range(300)]
    a = spark.createDataFrame(articles, "article_id int, domain string, title string, themes array<string>, tone_neg float")
    s = spark.createDataFrame(subscriptions, "subscription_id int, theme string, domain string, text string, min_negativity double")

    def ok(sub, art):
        _, theme, domain, text, tone = sub
        _, d, title, th, neg = art
        if theme is not None and not any(t.startswith(theme[:-1]) if theme.endswith("*") else t == theme for t in th or []):
            return False
        if domain is not None and d != domain or tone is not None and (neg is None or neg < tone):
            return False
        return text is None or title is not None and text.lower() in title.lower()

    found = filters.match_subscriptions(a, s)
    got = found.collect()
    want = {(x[0], y[0]) for x in subscriptions for y in articles if ok(x, y)}
    assert len(got) == len(want) and {(r.subscription_id, r.article_id) for r in got} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert filters.match_subscriptions(a.limit(0), s).count() == 0 and filters.match_subscriptions(a, s.limit(0)).count() == 0


def test_articles_are_not_broadcast_to_filters(spark):
    from pressmill.operators import filters

    articles = spark.range(300).selectExpr("id AS article_id", "concat('T ', id) AS title", "concat('d', id % 3) AS domain", "array(concat('t', id % 5)) AS themes", "CAST(id % 90 AS FLOAT) AS tone_neg")
    wanted = [(1, "t1", None, None, None), (2, None, "d2", None, 40.0), (3, "t*", "d0", None, 45.5), (4, None, None, "t 7", None), (5, None, None, None, 80.0), (6, None, None, None, None)]
    s = spark.createDataFrame(wanted, "subscription_id int, theme string, domain string, text string, min_negativity double")
    found = filters.match_subscriptions(articles, s).select("subscription_id", "article_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BroadcastExchange") <= 2
    ok = {1: lambda k: k % 5 == 1, 2: lambda k: k % 3 == 2 and k % 90 >= 40, 3: lambda k: k % 3 == 0 and k % 90 >= 45.5, 4: lambda k: "t 7" in f"t {k}", 5: lambda k: k % 90 >= 80, 6: lambda k: True}
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, k) for n, f in ok.items() for k in range(300) if f(k))
