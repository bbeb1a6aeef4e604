"""The stemmer against published pairs, and the index and the scan against plain Python over all texts."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.functions import stemming
from pressmill.operators import search, textindex
from pressmill.operators.textindex import TextIndex, TextQuery

# Words and stems that the stemmer's authors publish as a sample, and its special cases.
PAIRS = """consigned consign consignment consign consistency consist consolation consol consolatory consolatori consolidating
consolid consonant conson conspicuously conspicu conspirators conspir constables constabl constancy constanc knackeries knackeri
knavish knavish kneaded knead kneels kneel knees knee knightly knight knitting knit knives knive knocker knocker general general
generously generous communication communic national nation relational relat conditional condit happy happi cry cri by by say say
hoping hope hopping hop falling fall ponies poni ties tie gas gas gaps gap this this kiwis kiwi agreed agre feed feed skies sky
dying die inning inning news news rolling roll bed bed youth youth flying fli luxuriated luxuri hesitancy hesit electricity
electr hopeful hope goodness good adoption adopt sensational sensat""".split()


def test_published_stems():
    assert [(w, stemming.stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2], strict=True))


def plain_entries(text, analyzer):
    out = {}
    for place, w in enumerate(re.findall(r"[^\W_][^\W_']*(?:'[^\W_']*)*", (text or "").lower()), 1):
        t = stemming.ANALYZERS[analyzer](w)
        if t:
            out.setdefault(t, []).append(place)
    return out


def plain_search(rows, q: TextQuery, limit, analyzer):
    found = []
    for key, at, text in rows:
        e = plain_entries(text, analyzer)
        has = lambda p, e=e: any(all(not t or x + k in e.get(t, ()) for k, t in enumerate(p)) for x in e.get(p[0], ()))
        if not any(all(map(has, wanted)) and not any(map(has, unwanted)) for wanted, unwanted in q.alternatives):
            continue
        kept = {t: [x for x in e.get(t, []) if x <= 16383][:256] for t in q.terms}
        if q.by_pairs:
            none = 1.0
            for k, a in enumerate(q.terms):
                for b in q.terms[k + 1 :]:
                    for x in kept[a]:
                        for y in kept[b]:
                            if abs(x - y) <= 100:
                                none *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
            rank = max(1 - none, 1e-20)
        else:
            rank = max(sum(0.1 / j**2 for t in q.terms for j in range(1, len(kept[t]) + 1)) / 1.64493406685 / len(q.terms), 1e-20)
        found.append((-round(rank, 9), -at.timestamp(), key))
    return [(k, -r) for r, _, k in sorted(found)[:limit]]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = "run running runs harbour harbours the of bridge bridges closing closed storm's storm it's national nations été 42 of-the".split()
    out = [(k, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40)), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    return out + [(900, datetime(2024, 1, 1), None), (901, datetime(2024, 1, 1), ""), (902, datetime(2024, 1, 1), "storm bridge " * 700), (903, datetime(2024, 1, 2), "x " * 17_000 + "harbour run")]


QUERIES = ["harbour", "running bridge", '"closed bridge" or storm', "run -storm", '"storm of bridge"', "the", "national or 42 or bridges", "été -\"the bridge\"", "harbour harbours run", '"harbour run"', "nothing here"]


@pytest.mark.parametrize("analyzer", ["english", "simple"])
def test_index_and_scan_equal_plain_search(spark, tmp_path, rows, analyzer, monkeypatch):
    monkeypatch.setattr(TextIndex, "FIRST_BLOCKS", 2)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "article_id bigint, published_at timestamp_ntz, title string, term string, block int")
    index = TextIndex.build(table, f"file://{tmp_path}/i", text="title", key="article_id", published="published_at", analyzer=analyzer, texts_per_block=20)
    for text in QUERIES:
        want = plain_search(rows, TextQuery.parse(text, analyzer), 12, analyzer)
        got = [(r.article_id, round(r.rank, 9)) for r in index.search(text, 12).collect()]
        assert [k for k, _ in got] == [k for k, _ in want] and all(abs(a - b) < 2e-9 for (_, a), (_, b) in zip(got, want, strict=True)), text
    for text in QUERIES[:4]:
        scanned = textindex.scan(table, text, 12, column="title", key="article_id", published="published_at", analyzer=analyzer)
        assert [r.article_id for r in scanned.collect()] == [k for k, _ in plain_search(rows, TextQuery.parse(text, analyzer), 12, analyzer)]


def test_search_reads_few_blocks_and_no_text(spark, tmp_path, rows):
    many = [(k, datetime(2024, 1, 1), "storm " * (1 + k % 7 if k > 30 else 40) + "word") for k in range(600)]
    table = spark.createDataFrame(many, "article_id bigint, published_at timestamp_ntz, title string")
    index = TextIndex.build(table, f"file://{tmp_path}/i", text="title", key="article_id", published="published_at", texts_per_block=10)
    q = TextQuery.parse("storm")
    best = sorted((r.best for r in index.blocks(q).collect()), reverse=True)
    full = index.search("storm", 5).collect()
    assert len(best) > 40 and sum(b >= full[-1].rank * (1 - 1e-12) for b in best) <= 30
    plan = index.search("storm", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filtered_and_empty_searches(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "article_id bigint, published_at timestamp_ntz, title string")
    index = TextIndex.build(table, f"file://{tmp_path}/i", text="title", key="article_id", published="published_at", texts_per_block=20)
    among = table.where("article_id % 9 = 4")
    want = plain_search([r for r in rows if r[0] % 9 == 4], TextQuery.parse("harbour or bridge"), 10, "english")
    leg = search.keyword_leg(among, "harbour or bridge", 10, index=index).collect()
    assert [r.article_id for r in leg] == [k for k, _ in want] and leg[0].title is not None
    assert index.search("the -harbour", 5).collect() == [] and index.search("", 5).collect() == []
    empty = TextIndex.build(table.limit(0), f"file://{tmp_path}/e", text="title", key="article_id", published="published_at")
    assert empty.search("harbour", 5).collect() == []


def test_passages_fold_to_articles(spark, tmp_path):
    passages = spark.createDataFrame([(1, 0, "storm"), (1, 1, "storm storm storm"), (2, 0, "calm"), (3, 5, "storm storm")], "article_id bigint, idx int, passage string")
    articles = spark.createDataFrame([(k, datetime(2024, 1, k)) for k in (1, 2, 3)], "article_id bigint, published_at timestamp_ntz")
    keyed = passages.join(articles, "article_id").withColumn("passage_id", F.struct("article_id", "idx"))
    index = TextIndex.build(keyed, f"file://{tmp_path}/p", text="passage", key="passage_id", published="published_at")
    for leg in (search.passage_keyword_leg(passages, articles, "storms", 5, index=index), search.passage_keyword_leg(passages, articles, "storms", 5)):
        assert [(r.article_id, r.idx, r.passage) for r in leg.collect()] == [(1, 1, "storm storm storm"), (3, 5, "storm storm")]


def test_postings_are_no_rows_of_their_own(spark, tmp_path, rows):
    """Texts are dealt by block and come back as whole posting lists, block after block, whatever the batches."""
    import pyarrow as pa

    texts = [(k, 1 + (k > 2), [f"w{j % (k + 1)}" for j in range(6)]) for k in range(5)] + [(7, 3, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(k, k * 10, b, w) for k, b, w in texts], strict=True)], ["id", "at", "block", "words"])
    lists = [r for out in textindex._posted(iter([batch.slice(0, 2), batch.slice(2, 0), batch.slice(2, 3), batch.slice(5)]), "simple") for r in out.to_pylist()]
    want = {}
    for k, b, words in texts:
        for place, w in enumerate(words or (), 1):
            want.setdefault((w, b), {}).setdefault(k, []).append(place)
    assert {(r["term"], r["block"]): ({p["id"]: p["places"] for p in r["postings"]}, r["most"]) for r in lists} == {key: (p, max(map(len, p.values()))) for key, p in want.items()}
    assert all(p["at"] == p["id"] * 10 for r in lists for p in r["postings"])
