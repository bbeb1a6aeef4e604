import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pressmill.llm import op11_language as op11
from pressmill.llm import op12_clusters as op12
from pressmill.llm import op13_prefixes as op13
from tests.llm.util import awkward, awkward_texts, prose

DATA = "/root/testdata/sf0.01"


# --- 11: language by cross-parsing ---


def plain_phrases(text: bytes, learned: bytes) -> int:
    """Longest phrases one after the other, by searching the labelled text itself."""
    n = 0
    for block in (text[i : i + op11.BLOCK] for i in range(0, len(text), op11.BLOCK)):
        at = 0
        while at < len(block):
            end = at + 1
            while end < len(block) and block[at : end + 1] in learned:
                end += 1
            at, n = end, n + 1
    return n


def test_phrases_equal_plain_search():
    rng = random.Random(3)
    learned = {"a": op11.folded(prose(rng, 150)), "b": op11.folded("ünï çødé " * 9 + prose(rng, 60)), "c": b"\0".join([b"ab ba", b"abba", b"c"])}
    parser = op11.Parser([(k, len(v), op11.automaton(v).tobytes()) for k, v in learned.items()])
    texts = [op11.folded(prose(rng, n)) for n in (1, 3, 40, 200, 900)] + [b"abba ab", b"zzz\xc3\xbc", b"a", "漢字 ünï".encode(), b"b ba" * 700]
    got = parser.parse(texts)
    assert parser.langs == ["a", "b", "c"]
    assert got.tolist() == [[plain_phrases(t, learned[k]) for k in parser.langs] for t in texts]


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(60))
    steps = {(a, b): c for a, b, c in op11.automaton(data).tolist()}

    def known(word: bytes) -> bool:
        at = 0
        for x in word:
            if (at, x) not in steps:
                return False
            at = steps[at, x]
        return True

    for n in range(1, 9):
        for k in range(1 << n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert known(word) == (word in data)


def test_language_query_on_awkward_rows(spark):
    rng = random.Random(9)
    voices = {"x": "pam tor lin sef gul".split(), "y": "quo zair woth jux vyk".split()}
    rows = [(100 + k, " ".join(rng.choice(voices[lang]) for _ in range(30)), lang) for k, lang in enumerate(["x", "y"] * 40)]
    odd = [(1, None, "x"), (2, "", "y"), (3, "12 34 !?", "x"), (4, "漢字", None), (None, "pam tor", None), (5, "quo zair " * 40_000, None), (6, "PAM, TOR", None), (6, "PAM, TOR", None), (7, "woth", "")]
    docs = spark.createDataFrame([(d, t, lang, 1, "s") for d, t, lang in rows + odd], "doc_id bigint, text string, lang string, h int, stretch string")
    got = op11.identify(docs, op11.fit(docs)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert [by_id[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by_id[1].score == 0
    assert by_id[4].lang_pred in voices
    assert (by_id[None].lang_pred, by_id[5].lang_pred, by_id[6].lang_pred, by_id[7].lang_pred) == ("x", "y", "x", "y")
    assert sum(r.doc_id == 6 for r in got) == 2
    assert all(by_id[d].lang_pred == lang for d, _, lang in rows)


def test_language_fit_is_bounded_and_leaves_held_out_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(op11, "ROWS", 20)
    rows = [(k, f"pam {k} " + "lin " * 400, "x") for k in range(600)] + [(k, "held out words", "held") for k in range(3000) if zlib.crc32(str(k).encode()) % 3 == 1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = op11.stretches(docs).collect()
    assert {r.lang for r in sample} == {"x"} and 20 <= len(sample) <= 80 and max(len(r.stretch) for r in sample) <= op11.STRETCH


def test_language_without_labels_or_rows(spark):
    docs = awkward(spark).selectExpr("*", "CAST(NULL AS string) AS lang")
    got = op11.identify(docs, op11.fit(docs)).collect()
    assert len(got) == len(awkward_texts()) and {r.lang_pred for r in got} == {"und"}
    assert op11.identify(docs.limit(0), op11.fit(docs.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = op11.query(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 200


# --- 12: delta Lloyd ---


def plain_lloyd(rows, k=op12.CENTROIDS, rounds=op12.ROUNDS, seed=op12.SEED):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == op12.DIMS and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        owner = [min((dist(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), o in zip(kept, owner, strict=True) if o[1] == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = defaultdict(int)
    for d, j in owner:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, owner, strict=True)), key=str)


def clustered(spark, rows):
    table = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, n int")
    return sorted(map(tuple, op12.cluster(table).collect()), key=str)


def test_clusters_equal_plain_lloyd(spark):
    rng = np.random.default_rng(4)
    single = lambda v: [float(x) for x in np.float32(v)]
    rows = [(k, single(rng.normal(size=64) * 0.05 + (k % 7))) for k in range(220)]
    rows += [(500 + k, rows[0][1]) for k in range(60)]  # copies, many of them among the first centroids
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[9][1]), (None, single(np.ones(64)))]
    rows += [(900, None), (901, [0.5] * 63), (902, [float("nan")] + [0.0] * 63), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [])]
    assert clustered(spark, rows) == plain_lloyd(rows)


def test_clusters_of_few_vectors_and_none(spark):
    rows = [(k, [0.25 * k] * 64) for k in range(3)] + [(7, [3e30] * 64)]
    got = clustered(spark, rows)
    assert [r[:3] for r in got] == [(k, got[i][1], 0) for i, k in enumerate((0, 1, 2, 7))] and len({r[1] for r in got}) == 4
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []


def test_changed_centroids_alone_give_the_owner_of_all():
    rng = np.random.default_rng(8)
    for scale in (3, 1 << 26):
        x, old = rng.integers(-scale, scale, (300, 64)), rng.integers(-scale, scale, (9, 64))
        owner, distance = op12.nearest(x, np.full(300, -1), np.zeros(300, np.int64), old, np.arange(9))
        new = old.copy()
        new[[2, 5]] = rng.integers(-scale, scale, (2, 64))
        new[8] = new[1] = old[1]
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in new] for v in x[:40]]
        got = op12.nearest(x, owner, distance, new, np.array([2, 5, 8]))
        assert got[0][:40].tolist() == [d.index(min(d)) for d in exact] and got[1][:40].tolist() == [min(d) for d in exact]


# --- 13: the trie of prefixes ---


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, done = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [done[k] for k in kids[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(x[1] for x in below)
        done[node] = (sum(x[0] for x in below) if below else 1, saved)
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below), *done[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, d int, digest string, block int")
    return sorted(map(tuple, op13.trie(table).collect()), key=str)


def talk(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 3 * n), n):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, "ua"[turn % 2], rng.choice(["hi", "yes", "", "é"]) if rng.random() < 0.8 else None))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_trie_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(op13, "BITS", bits)
    rows = talk(bits, 60)
    rows += [(5, 0, "u", "hi"), (5, 0, "u", "hi"), (5, None, None, None), (None, 1, "u", "x"), (-3, 1, "u", "a"), (-5, 1, "u", "a"), (-5, 2, "a", "b"), (7, 4, None, "tie"), (7, 4, "z", None)]
    # One conversation with a third of all rows, another that is its copy, and many short ones alike.
    rows += [(5000, t, "u", f"turn {t}") for t in range(150)] + [(5001, t, "u", f"turn {t}") for t in range(150)]
    rows += [(6000 + 5 * k, t, "u", "same") for k in range(60) for t in range(2)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_hands_long_groups_of_ends_on(spark):
    rows = [(5 * k, t, "u", "same") for k in range(700) for t in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert trie_rows(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_a_caterpillar_and_of_nothing(spark):
    rows = [(5 * k, t, "u", "s" if t < k else f"own {k}") for k in range(40) for t in range(min(40, k + 9))]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "u", "x")]) == []
    assert trie_rows(spark, [(1, 0, "u", "x")]) == plain_trie([(1, 0, "u", "x")])
