"""The vector index against exact search in numpy."""

import numpy as np
import pytest

from pressmill.operators import search
from pressmill.operators.vectorindex import VectorIndex

SCHEMA = "article_id bigint, embedding array<float>, published_at timestamp_ntz, embedding_model string, list int, code int"


def table(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], None, str(k % 3), 9, 9) for k, v in enumerate(vectors)], SCHEMA)


def plain(vectors, q, limit, keys=None):
    unit = lambda v: np.float32(np.asarray(v, dtype=float) / np.linalg.norm(v)).astype(float)
    rows = [(1 - float(unit(v) @ unit(q)), k) for k, v in enumerate(vectors) if v is not None and np.linalg.norm(v) > 0 and (keys is None or k in keys)]
    return [k for _, k in sorted(rows)[:limit]]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    out = [np.float32(centres[k % 12] + 0.35 * rng.normal(size=24)) for k in range(900)]
    out[5] = out[700] = out[40]  # ties
    return [*out, None, np.zeros(24)]


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex.build(table(spark, vectors), f"file://{tmp_path_factory.mktemp('v')}/x")


def asked(spark, vectors, ids):
    return spark.createDataFrame([(k, [float(x) for x in vectors[k]]) for k in ids], "query bigint, embedding array<float>")


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        out.setdefault(r.query, []).append(r.article_id)
    return out


def test_exact_search_equals_numpy(spark, index, vectors):
    ids = [0, 5, 40, 333, 899]
    got = answers(index.search(asked(spark, vectors, ids), 15, exact=True, probes=2))
    for k in ids:
        near = lambda j, k=k: float(np.float32(vectors[j] / np.linalg.norm(vectors[j])).astype(float) @ np.float32(vectors[k] / np.linalg.norm(vectors[k])).astype(float))
        assert [round(near(j), 6) for j in got[k]] == [round(near(j), 6) for j in plain(vectors, vectors[k], 15)]
    assert {5, 40, 700} == set(got[5][:3])


def test_recall_and_share_read(spark, index, vectors):
    ids = list(range(0, 900, 20))
    got = answers(index.search(asked(spark, vectors, ids), 10))
    recall = np.mean([len(set(got[k]) & set(plain(vectors, vectors[k], 10))) / 10 for k in ids])
    assert recall >= 0.95 and index.read_share(asked(spark, vectors, ids)) < 0.5


def test_filtered_searches_are_full(spark, index, vectors):
    keys = set(range(7, 900, 60))
    among = table(spark, vectors).where("article_id % 60 = 7")
    got = answers(index.search(asked(spark, vectors, [0, 100]), 10, among=among, probes=1, refine=3))
    assert all(len(got[k]) == 10 and set(got[k]) <= keys for k in (0, 100))
    assert answers(index.search(asked(spark, vectors, [0]), 10, among=among.limit(0))) == {}
    leg = search.vector_leg(table(spark, vectors), [float(x) for x in vectors[3]], 10, model="1", index=index).collect()
    assert len(leg) == 10 and {r.embedding_model for r in leg} == {"1"} and abs(leg[0].distance + leg[0].similarity - 1) < 1e-12


def test_odd_vectors_and_tables(spark, index, vectors, tmp_path):
    assert answers(index.search(asked(spark, vectors, [901]), 5)) == {}
    empty = VectorIndex.build(table(spark, vectors).limit(0), f"file://{tmp_path}/e")
    assert answers(empty.search(asked(spark, vectors, [1]), 5)) == {}
    few = VectorIndex.build(table(spark, [[1.0, 0, 0], [0, 1.0, 0], [1.0, 0.1, 0]]), f"file://{tmp_path}/f")
    assert answers(few.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query bigint, embedding array<float>"), 5)) == {1: [0, 2, 1]}


def test_blocks_and_parts_change_nothing(spark, index, vectors, monkeypatch):
    """Groups are bounded whatever the table's size, and what leaves one is cut to the result."""
    from pressmill.operators import vectorindex

    ids = [5, 40, 333]
    whole = answers(index.search(asked(spark, vectors, ids), 15))
    for name, most in (("BLOCK", 20), ("CODED_BLOCK", 20), ("DEALT", 2)):
        monkeypatch.setattr(vectorindex, name, most)
    assert answers(index.search(asked(spark, vectors, ids), 15)) == whole
    got = answers(index.search(asked(spark, vectors, ids), 15, exact=True, probes=2))
    assert got == {k: plain(vectors, vectors[k], 15) for k in ids}


def test_distances_are_those_of_the_vectors(spark, index, vectors):
    """In double precision, not those of unit vectors, and a tie where they are one at seven digits."""
    exact = lambda a, b: 1 - float(a @ b) / float(np.sqrt((a @ a) * (b @ b)))
    wide = [None if v is None else np.asarray(v, dtype=float) for v in vectors]
    for found in (index.search(asked(spark, vectors, [40, 333]), 15, exact=True), index.search(asked(spark, vectors, [40, 333]), 15)):
        assert all(abs(r.distance - exact(wide[r.query], wide[r.article_id])) < 1e-14 for r in found.collect())


@pytest.mark.parametrize("block", [8192, 2])
def test_ties_at_seven_digits_fall_to_the_key(spark, tmp_path, monkeypatch, block):
    from pressmill.operators import vectorindex

    monkeypatch.setattr(vectorindex, "BLOCK", block)
    rows = [[1.0, 0.5 - k * 1e-7] for k in range(6)] + [[1.0, 0.0], [0.0, 1.0]]  # larger keys are nearer to the query
    ties = VectorIndex.build(table(spark, rows), f"file://{tmp_path}/t", lists=2)
    exact = lambda b: 1 - float(b[0]) / float(np.sqrt(b[0] * b[0] + b[1] * b[1]))
    far = [exact(np.float32(v).astype(float)) for v in rows]
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query int, embedding array<float>")
    for digits in (7, None):
        want = sorted(range(8), key=lambda k: (far[k] if digits is None else round(far[k], digits), k))
        assert answers(ties.search(query, 4, exact=True, digits=digits)) == {1: want[:4]}
    assert want[:4] == [6, 5, 4, 3]
