"""Test sets against a plain assembly, and resampling against what it must give."""

import hashlib
import random

import numpy as np

from pressmill.operators import assembly

WORDS = "harbour bridge storm tower flood valley mayor strike rail port vote court tax river school".split()


def draw(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def overlap(a, b):
    x, y = ({w for w in t.lower().split() if len(w) > 3} for t in (a, b))
    return len(x & y) / max(1, min(len(x), len(y)))


def plain(articles, clusters, texts, judged, max_clusters, distractors, seed):
    title = dict(articles)
    events = sorted(sorted(clusters, key=lambda e: (draw(seed, e), e))[:max_clusters])
    inside = {a for e in events for a in clusters[e]}
    pool = sorted(set(title) - inside, key=lambda a: (draw(seed, a), a))
    chosen = inside | set(pool[:distractors])
    lowered = [title[a].lower() for a in chosen]
    ok = lambda t: t.strip() and not any(x in t.strip().lower() or t.strip().lower() in x for x in lowered if x)
    queries, ambiguous, seeds, used = [], set(), set(), set()
    for e in events:
        s = min(clusters[e])
        members = [s]
        for m in sorted(clusters[e]):
            if m != s:
                if (e, m) in judged:
                    members.append(m)
                elif overlap(title[s], title[m]) >= 0.8:
                    ambiguous.add(m)
        members.sort()
        if len(members) < 2 or s in seeds:
            continue
        seeds.add(s)
        for kind in ("keywords", "paraphrase"):
            text = texts.get((e, kind))
            if text is not None and ok(text) and (kind, text.lower()) not in used:
                used.add((kind, text.lower()))
                queries.append((e, kind, text, s, members, [m for m in members if m != s]))
    kept = {m for q in queries for m in q[4]}
    return sorted(chosen - (ambiguous - kept)), sorted(queries)


def test_assembled_sets_equal_the_plain_rule(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        articles = [(k, " ".join(rng.sample(WORDS, rng.randint(3, 5))).capitalize() + f" {k}") for k in range(120)]
        clusters = {e: sorted(rng.sample(range(80), rng.randint(1, 5))) for e in range(40)}
        clusters[50], clusters[51] = clusters[3], clusters[3]
        texts = {(e, kind): rng.choice(["what of the port", "Vote", f"asked {e}", "", "asked about the rail"]) for e in clusters for kind in ("keywords", "paraphrase") if rng.random() < 0.9}
        judged = {(e, m) for e, members in clusters.items() for m in members if rng.random() < 0.6}
        frames = (
            spark.createDataFrame(articles, "article_id bigint, title string"),
            spark.createDataFrame(list(clusters.items()), "event_id bigint, members array<bigint>"),
            spark.createDataFrame([(e, k, t) for (e, k), t in texts.items()], "event_id bigint, kind string, text string"),
            spark.createDataFrame([*judged, next(iter(judged))], "event_id bigint, article_id bigint"),
        )
        corpus, queries = assembly.assemble(*frames, max_clusters=25, distractors=15, seed=seed)
        want = plain(articles, clusters, texts, judged, 25, 15, seed)
        assert sorted(r.article_id for r in corpus.collect()) == want[0]
        assert sorted((r.event_id, r.kind, r.query, r.seed, r.members, r.expected) for r in queries.collect()) == want[1] and want[1]
        assert {r.rule for r in assembly.violations(corpus, queries).collect()} <= {"fewer than two stories"}


def test_broken_sets_are_named(spark):
    corpus = spark.createDataFrame([(1, "Storm hits the northern harbour towns tonight"), (1, "Storm hits the northern harbour towns tonight"), (2, "Mayor opens a new railway bridge over river")], "article_id bigint, title string")
    queries = spark.createDataFrame([(7, "keywords", "", 5, [1, 2, 9], [1, 2])], "event_id bigint, kind string, query string, seed bigint, members array<bigint>, expected array<bigint>")
    rules = {r.rule for r in assembly.violations(corpus, queries).collect()}
    assert rules == {"duplicate id", "member not in corpus", "seed outside cluster", "expected and ignored do not split the members", "query is empty or a title", "no distractors"}


def test_resamples_draw_with_replacement(spark):
    n = 500
    pairs = spark.createDataFrame([(k, float(k % 7), 1.0) for k in range(n)], "pair_id bigint, a double, b double")
    for per_block in (16, 4096):
        rows = assembly.resampled(pairs, 400, seed=5, per_block=per_block).collect()
        assert len(rows) == 400 and {r.draws for r in rows} == {n}
        means = np.array([r.total / r.draws for r in rows])
        gaps = np.array([k % 7 - 1 for k in range(n)])
        error = gaps.std() / np.sqrt(n)
        assert abs(means.mean() - gaps.mean()) < 4 * error / 20 and 0.85 < means.std() / error < 1.15
    again = assembly.resampled(pairs.repartition(5), 400, seed=5, per_block=16).collect()
    first = {r.sample: r.total for r in assembly.resampled(pairs, 400, seed=5, per_block=16).collect()}
    assert all(abs(first[r.sample] - r.total) < 1e-9 for r in again)
    assert {r.sample: r.total for r in assembly.resampled(pairs, 3, seed=6).collect()} != {s: first[s] for s in range(3)}
    assert assembly.resampled_interval(pairs.limit(0), 10).collect() == []


def test_blocks_share_all_draws():
    sizes = np.array([3, 0, 10, 1, 7])
    draws = [[assembly._draws_of_block(b, sizes, 1, s, 21) for b in range(5)] for s in range(2000)]
    assert all(sum(d) == 21 and d[1] == 0 for d in draws)
    assert np.allclose(np.mean(draws, axis=0), sizes, atol=0.3)


def test_sweep_equals_the_plain_rule_and_deals_no_settings(spark):
    rng = random.Random(4)
    legs = [(p, q, leg, i, r) for p in ("on", "off") for q in range(12) for leg in ("vector", "fulltext") if rng.random() < 0.8 for r, i in enumerate(rng.sample(range(30), rng.randint(1, 25)), 1)]
    wanted = {q: rng.sample(range(30), rng.randint(0, 4)) for q in range(15)}
    rows = spark.createDataFrame(legs, "prefix string, query_id bigint, leg string, id bigint, rank int")
    found = assembly.swept(spark.createDataFrame(list(wanted.items()), "query_id bigint, expected array<bigint>"), rows, [10, 60], [3, 20])
    asked = {q: e for q, e in wanted.items() if e}
    want = {}
    for p in ("on", "off"):
        for k in (10, 60):
            for c in (3, 20):
                for method in ("vector", "fulltext", "hybrid"):
                    recalls, rrs = [], []
                    for q, e in asked.items():
                        score = {}
                        for _, _, leg, i, r in sorted(x for x in legs if x[0] == p and x[1] == q and x[4] <= c and method in ("hybrid", x[2])):
                            score[i] = score.get(i, 0.0) + (1 / (k + r) if method == "hybrid" else 1 / r)
                        order = sorted(score, key=lambda i: (-score[i], i))
                        recalls.append(len(set(order[:5]) & set(e)) / len(e))
                        rrs.append(max([1 / (order.index(i) + 1) for i in e if i in score], default=0))
                    want[p, k, c, method] = (round(sum(recalls) / len(asked), 9), round(sum(rrs) / len(asked), 9), len(asked))
    assert {(r.prefix, r.rrf_k, r.candidates, r.method): (round(r.recall, 9), round(r.mrr, 9), r.queries) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "rrf_k" in x and "query_id" in x]
