import re
from itertools import combinations

import pytest

from pressmill.llm import op3_minhash, op10_lines
from pressmill.llm.components import components
from tests.llm.util import awkward, awkward_texts, prose


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 8), (2, 1), (20, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == {n: r for n, r in _roots({x for p in links for x in p}, links).items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    import random

    rng = random.Random(3)
    rows = awkward_texts()
    hub = prose(rng, 150).split()
    for j in range(70):  # a cluster around one text, with members that only other members reach
        w = list(hub)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((500 + j, " ".join(w)))
    got = op3_minhash.near_duplicates(awkward(spark, rows), shingle=k).collect()
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingles(t, k))
    similar = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _roots(sets, similar)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_near_duplicates_of_nothing(spark):
    assert op3_minhash.near_duplicates(awkward(spark, [])).count() == 0
    assert [r.component_id for r in op3_minhash.near_duplicates(awkward(spark, [(3, None), (4, "")])).orderBy("doc_id").collect()] == [3, 4]


def test_sketches_have_a_bit_for_every_word(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "x y z"), (2, "x"), (3, "x x y")], "line_id bigint, line string")
    h = {r.w: r.h & 511 for r in spark.createDataFrame([("x",), ("y",), ("z",)], "w string").withColumn("h", F.xxhash64("w")).collect()}
    got = {r.line_id: (r.n_words, sum((r[b] & (2**64 - 1)) << 64 * k for k, b in enumerate(op10_lines.BITS))) for r in op10_lines.sketches(rows).collect()}
    bits = lambda ws: sum(1 << h[w] for w in ws)
    assert got == {1: (3, bits("xyz")), 2: (1, bits("x")), 3: (3, bits("xy"))}


def test_lines(spark):
    import random

    rng = random.Random(8)
    shared, other, third = prose(rng, 30), prose(rng, 30), prose(rng, 12)
    fuzzy = shared.split()
    fuzzy[7] = "changed"
    rows = [
        (1, f"{shared}\n{other}\nshort line"), (2, f"{shared.upper()}!\nfresh " + prose(rng, 20) + "\nshort line"), (3, None), (4, ""), (5, other),
        (6, " ".join(fuzzy) + "\n" + third + "\n" + third), (None, other), (7, "short line"), (1, f"{shared}\n{other}\nshort line"), (8, "\n\n" + other + "\n"),
    ]
    got = {}
    for r in op10_lines.dedup_lines(awkward(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [list(r.removed) for r in got[1]] == [[], []] and got[2][0].removed == [0, 2] and got[2][0].text.startswith("fresh")
    assert got[3][0].text is None and got[3][0].n_lines == 0 and got[4][0].text == "" and got[4][0].n_lines == 1
    assert got[5][0].text == "" and got[5][0].removed == [0] and got[7][0].text == "" and got[None][0].text == other
    assert got[6][0].removed in ([0, 2], [2]) and got[8][0].removed == [2] and got[8][0].text == "\n\n"
    assert got[1][0].id == "x" and got[1][0].worker == 4
    assert op10_lines.dedup_lines(awkward(spark, [])).count() == 0


def test_one_changed_word_in_a_long_line_is_found(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(40):
        line = prose(rng, 90).split()
        rows.append((2 * k, " ".join(line)))
        line[rng.randrange(90)] = "different"
        rows.append((2 * k + 1, " ".join(line)))
    removed = [r.doc_id for r in op10_lines.dedup_lines(awkward(spark, rows)).collect() if r.removed]
    assert len(removed) == 40 and all(d % 2 for d in removed)


def test_similar_lines_equal_brute_force(spark):
    import random

    rng = random.Random(12)
    lines = []
    for n in [1, 3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 24, 27, 30, 57, 100] * 6:
        line = [w.strip(",.") for w in prose(rng, n).split()]
        lines.append(line)
        for _ in range(2):  # edits up to the bound and one beyond, of all three kinds
            other = list(line)
            for k in range(rng.randint(1, n // 5 + 1)):
                at = rng.randrange(len(other))
                other[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [f"q{rng.randrange(10**6)}"], [f"q{rng.randrange(10**6)}"]])
            lines.append(other)
    lines = [x for x in lines if x]
    rng.shuffle(lines)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    near = [(a, b) for a, b in combinations(range(len(lines)), 2) if abs(len(lines[a]) - len(lines[b])) <= max(len(lines[a]), len(lines[b])) // 5]
    links = [(a, b) for a, b in near if distance(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b])) // 5]
    roots = _roots(range(len(lines)), links)
    got = {r.doc_id for r in op10_lines.dedup_lines(awkward(spark, [(k, " ".join(x)) for k, x in enumerate(lines)])).collect() if r.removed}
    assert len(links) > 100 and got == {k for k, r in roots.items() if k != r}


def test_a_line_has_no_more_buckets_than_edits_can_break(spark):
    """One more than 2 floor(0.2 n), or than one less where one word put in allows one more edit. Words all differ here."""
    rows = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (4, 5, 9, 10, 23, 24, 60, 100)]
    got = {r.line_id: r["count"] for r in op10_lines.bucket_keys(spark.createDataFrame(rows, "line_id bigint, line string"), 0.8).groupBy("line_id").count().collect()}
    assert got == {4: 2, 5: 3, 9: 4, 10: 5, 23: 9, 24: 10, 60: 25, 100: 41}


def test_similar_lines_of_unlike_lengths_share_a_bucket(spark):
    """As many words put into a line, changed in it or taken from it as keep it similar, anywhere: a bucket is left."""
    import random

    rng, rows = random.Random(6), []
    for n in list(range(4, 31)) + [44, 49, 59, 60, 74, 99]:
        for put in range(n // 4 + 1):
            line = [f"{'y' * rng.randrange(12)}{rng.randrange(10**6)}" for _ in range(n)]
            other = list(line)
            for at in sorted(rng.sample(range(n), (n + put) // 5 - put), reverse=True) if (n + put) // 5 >= put else []:
                other[at] = f"z{rng.randrange(10**6)}"
            for _ in range(put if (n + put) // 5 >= put else 0):
                other.insert(rng.randrange(len(other) + 1), f"{'z' * rng.randrange(16)}{rng.randrange(10**6)}")
            rows += [(2 * len(rows), " ".join(line)), (2 * len(rows) + 1, " ".join(other))]
    keys = {}
    for r in op10_lines.bucket_keys(spark.createDataFrame(rows, "line_id bigint, line string"), 0.8).collect():
        keys.setdefault(r.line_id, set()).add(r.bucket)
    assert len(rows) > 400 and all(keys[a] & keys[b] for (a, _), (b, _) in zip(rows[::2], rows[1::2], strict=True))


def _clusters(rng, n):
    """Lines around `n` roots, many of which share pairs of common words."""
    lines = []
    for _ in range(n):
        root = " ".join(rng.choice(["the old harbour", "of the city", "in the morning", "an old man", "the city council"]) + f" r{rng.randrange(10**6)}" for _ in range(6)).split()
        for _ in range(4):
            other = list(root)
            for at in rng.sample(range(len(other)), rng.randint(0, 4)):
                other[at] = f"q{rng.randrange(10**6)}"
            lines.append(" ".join(other))
    rng.shuffle(lines)
    return list(enumerate(lines))


def test_passes_and_salts_change_nothing(spark, monkeypatch):
    """Buckets are taken in passes of so many members, large ones by salts, and any order of grams finds the same lines."""
    import random

    rows = _clusters(random.Random(5), 60)
    removed = lambda: sorted(r.doc_id for r in op10_lines.dedup_lines(awkward(spark, rows)).collect() if r.removed)
    whole = removed()
    assert 60 < len(whole) < 240
    passes, plain = [], op10_lines.written
    monkeypatch.setattr(op10_lines, "written", lambda df, what: (passes.append(what), plain(df, what))[1])
    for name, value in {"PASS": 1, "SAMPLED": 2, "HOT": 2, "COUNTED": 1, "BLOCK": 5}.items():
        monkeypatch.setattr(op10_lines, name, value)
    assert removed() == whole and passes.count("line-apart") > 1
    monkeypatch.setattr(op10_lines, "word_ranks", lambda lines: None)
    assert removed() == whole


def test_grams_of_rare_words_are_the_buckets(spark):
    """Words that most lines have are left out of the buckets, however long they are."""
    rows = [(k, " ".join(x for j in range(5) for x in ("extraordinarily", "internationally", f"a{k}b{j}", f"c{k}d{j}"))) for k in range(64)]
    lines = spark.createDataFrame(rows, "line_id bigint, line string")
    ranks = op10_lines.word_ranks(lines.crossJoin(spark.range(20)).selectExpr("id * 64 + line_id AS line_id", "line"))
    shared = lambda r: op10_lines.bucket_keys(lines, 0.8, r).groupBy("bucket").count().where("count > 1").count()
    assert shared(None) > 0 and shared(ranks) == 0
