"""Story and headline grouping against the plain rules on random rows, one key or title bearing a third of them."""

import random
from datetime import datetime, timedelta

import pytest

from pressmill.operators import dedup, digest

DAY, W = datetime(2024, 1, 1), timedelta(hours=48)


def plain_stories(rows):
    out, keys = {}, {}
    seen = set()
    for a, key, domain, url, at, arrival in sorted(rows, key=lambda r: (r[5], r[0])):
        if a in seen:
            continue
        seen.add(a)
        stories = keys.setdefault(key, []) if key is not None else []
        for s in sorted(stories, key=lambda s: (s["at"], s["order"])):
            if at is not None and abs(s["at"] - at) <= W and (domain is None or s["pages"].get(domain, {url}) == {url}):
                break
        else:
            s = {"id": a, "at": at, "pages": {}, "order": len(stories)}
            if at is not None:
                stories.append(s)
        if domain is not None:
            s["pages"].setdefault(domain, set()).add(url)
        out[a] = (s["id"], "canonical" if s["id"] == a else "grouped")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stories_equal_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(900):
        key = "hot" if k % 3 == 0 else rng.choice([None, *(f"k{j}" for j in range(25))])
        at = DAY + timedelta(hours=rng.randrange(0, 24 * (30 if key == "hot" else 12)))
        rows.append((f"a{k:04d}", key, rng.choice([None, "a", "b", "c"]), f"http://x/{rng.randrange(3)}", at, rng.randrange(500)))
    rows += [(*rows[6][:5], 900), (*rows[9][:5], 901)]
    frame = spark.createDataFrame(rows, "article_id string, story_key string, domain string, url string, published_at timestamp_ntz, arrival int")
    assert {r.article_id: (r.story_id, r.outcome) for r in dedup.group_stories(frame).collect()} == plain_stories(rows)


def test_rows_without_a_time_stand_alone(spark):
    rows = [("a", "k", "x", "http://x/1", None, 1), ("b", "k", "y", "http://y/1", None, 2), ("c", "k", "x", "http://x/1", DAY, 3), ("d", "k", "x", "http://x/2", DAY, 4), ("e", "k", "y", "http://y/2", DAY, 5)]
    frame = spark.createDataFrame(rows, "article_id string, story_key string, domain string, url string, published_at timestamp_ntz, arrival int")
    assert {r.article_id: r.story_id for r in dedup.group_stories(frame).collect()} == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "c"}


def plain_groups(rows, overlap=0.75, jaccard=0.5, least=3):
    groups, out = [], {}
    for a, tokens, domain, at, _ in sorted(rows, key=lambda r: (-r[4], r[3], r[0])):
        mine = set(tokens)
        for g in groups:
            n = len(mine & g["tokens"])
            match = n >= least and (n / min(len(mine), len(g["tokens"])) >= overlap or n / len(mine | g["tokens"]) >= jaccard)
            if match and abs(at - g["at"]) <= W and (domain is None or domain not in g["domains"]):
                break
        else:
            g = {"id": a, "tokens": mine, "at": at, "domains": set()}
            groups.append(g)
        g["domains"].add(domain)
        out[a] = g["id"]
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_headlines_equal_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    words = [f"w{j:02d}" for j in range(30)]
    titles = [sorted(rng.sample(words, rng.randint(0, 8))) for _ in range(60)]
    rows = []
    for k in range(600):
        tokens = titles[0] + ["extra"] if k % 3 == 0 else rng.choice(titles)
        tokens = sorted(set(tokens) ^ ({rng.choice(words)} if rng.random() < 0.3 else set()))
        rows.append((k, tokens, rng.choice([None, *"abcdef"]), DAY + timedelta(hours=rng.randrange(24 * 9)), rng.randint(1, 5)))
    frame = spark.createDataFrame(rows, "article_id bigint, tokens array<string>, domain string, published_at timestamp_ntz, source_count int")
    assert {r.article_id: r.group_id for r in digest.group_headlines(frame).collect()} == plain_groups(rows)


def test_components_of_long_chains(spark):
    pairs = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(200) if k % 50] + [("z", "y"), ("x", "z"), ("q", "q")]
    rng = random.Random(0)
    rng.shuffle(pairs)
    got = {r.id: r.component for r in digest.linked_components(spark.createDataFrame(pairs, "a string, b string").repartition(7)).collect()}
    assert got == {f"n{k:03d}": f"n{(k - 1) // 50 * 50 + 1:03d}" for k in range(1, 201)} | dict.fromkeys("xyz", "x")


def test_large_payloads_reach_no_join(spark):
    from pressmill.operators import merge

    rows = spark.range(40).selectExpr("id % 5 AS article_id", "CAST(id % 2 AS STRING) AS agent", "CASE WHEN id % 3 = 0 THEN repeat('x', 70000) WHEN id % 7 > 0 THEN 'x' END AS payload", "id AS created_at", "id AS arrival")
    articles = spark.range(4).selectExpr("id AS article_id")
    kept, refused = merge.upsert_analyses(rows.where("false"), rows, articles)
    want = {}
    for k in range(40):
        if k % 3 and k % 5 < 4:
            want[k % 5, str(k % 2)] = k
    assert {(r.article_id, r.agent): r.arrival for r in kept.collect()} == want
    assert {(r.arrival, r.reason) for r in refused.collect()} == {(k, "not_found" if k % 5 == 4 else "too_large") for k in range(40) if k % 5 == 4 or k % 3 == 0}
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    joins = [depth(x) for x in plan if "Join" in x]
    assert min(depth(x) for x in plan if "octet_length" in x) > min(joins) and any("octet_length" in x and "Filter" in x for x in plan)
