"""Small tables with every awkward case, for all corpus operators."""

import random

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "xu") for b in ("dan", "fel", "gor", "hin", "jup", "kas", "lem", "mot", "nir", "pol")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward_texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, white space, ties, repeated rows, copies, near copies, one very long text."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = []
    for k in range(6):
        w = list(words)
        for j in range(k + 1):
            w[(17 * k + 9 * j) % len(w)] = f"new{k}{j}"
        near.append(" ".join(w))
    long = "\n".join(prose(rng, 60) for _ in range(250))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, base), (7, base.upper()), (8, base), (8, base), (9, long), (None, base), (None, None), (10, "ünï çødé ß 漢字 \x01 end")]
    rows += [(20 + k, t) for k, t in enumerate(near)]
    rows += [(40 + k, prose(rng, rng.randint(1, 200))) for k in range(25)]
    return rows


SCHEMA = "doc_id bigint, text string, id string, digest int, n int, m int, size string, bucket string, label int, score string, removed int, worker int"


def awkward(spark, rows=None):
    """The texts with extra columns whose names clash with names inside the operators."""
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, "s", "b", 7, "z", 9, 4) for d, t in rows], SCHEMA)
