"""Centroid clustering by delta Lloyd, exact in integers.

Vectors, their owner and their distance to it are kept as a table in the shared folder; the sums and counts of the clusters
are kept as a table of at most CENTROIDS rows. A round does only what changed: a vector whose owner stayed as it was meets
the centroids that changed, any other meets all of them, and the sums take only the vectors that moved, with a minus where
they left and a plus where they came. Nothing is shuffled but those partial sums. Where no centroid changes, the rounds that
remain would change nothing and are not run.

Components are floor(256 * x), held within +-2**27, so that every squared distance fits a long; sums are exact.

Nulls, ties, repeats: a vector that is null, has not DIMS components, or holds a null, NaN or infinite one is left out.
Equal distances go to the smaller centroid. A null vec_id hashes as the empty text; equal ids are told apart by their
components. With fewer than CENTROIDS vectors each is a centroid; of equal centroids the first takes all and the others stay
empty. An empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import forget, ship, table, written

DIMS, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
SCALE, LARGEST = 256, 1 << 27
STATE = "vec_id bigint, v array<int>, cluster int, was int, distance bigint"


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors with DIMS finite components, as integers."""
    usable = (F.size("embedding") == DIMS) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest hashes of their ids, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), DIMS)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact: in floating point, which the machine multiplies fast, only where every sum stays below 2**53."""
    cross = x.astype(float), centroids.astype(float)
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22:
        product = (cross[0] @ cross[1].T).astype(np.int64)
    else:
        product = x @ centroids.T
    return (x * x).sum(axis=1)[:, None] - 2 * product + (centroids * centroids).sum(axis=1)[None, :]


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after `changed` centroids took new places. owner -1: not assigned yet."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | np.isin(owner, changed)
    if anew.any():
        d = squared_distances(x[anew], centroids)
        owner[anew], distance[anew] = d.argmin(axis=1), d.min(axis=1)
    rest = ~anew
    if rest.any() and len(changed):
        d = squared_distances(x[rest], centroids[changed])
        best, at = d.min(axis=1), changed[d.argmin(axis=1)]
        takes = (best < distance[rest]) | ((best == distance[rest]) & (at < owner[rest]))
        owner[rest] = np.where(takes, at, owner[rest])
        distance[rest] = np.where(takes, best, distance[rest])
    return owner, distance


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """One assignment of every vector, written. The centroids travel with the function: CENTROIDS * DIMS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, DIMS)
            was = batch.column("cluster")
            owner, distance = nearest(x, was.to_numpy().astype(np.int64), batch.column("distance").to_numpy(), centroids, changed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(owner.astype(np.int32)), was, pa.array(distance)], ["vec_id", "v", "cluster", "was", "distance"])

    return written(state.mapInArrow(run, STATE), "clusters")


def _transfers(state: DataFrame) -> DataFrame:
    """(cluster, n, s): signed counts and sums of the vectors that changed their owner, at most one row a cluster."""
    moved = state.where("cluster <> was")
    came, left = F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign"))
    both = moved.select("v", F.explode(F.array(came, left)).alias("m")).where("m.c >= 0").select(F.col("m.c").alias("cluster"), F.col("m.sign").alias("sign"), "v")
    sums = [F.sum(F.col("v")[i].cast("bigint") * F.col("sign")).alias(f"s{i}") for i in range(DIMS)]
    return both.groupBy("cluster").agg(F.sum("sign").alias("n"), *sums).select("cluster", "n", F.array(*[f"s{i}" for i in range(DIMS)]).alias("s"))


def _moved(totals: DataFrame | None, state: DataFrame) -> DataFrame:
    """The clusters' counts and sums after the transfers of `state`, written."""
    parts = _transfers(state) if totals is None else totals.unionByName(_transfers(state))
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(DIMS)]
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums)
    return written(summed.select("cluster", "n", F.array(*[f"s{i}" for i in range(DIMS)]).alias("s")), "sums")


def cluster(vectors: DataFrame, rounds: int = ROUNDS, k: int = CENTROIDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    ship(spark)
    kept = kept_vectors(vectors)
    centroids = first_centroids(kept, k, seed)
    nobody = F.lit(-1)
    start = kept.select("vec_id", "v", nobody.alias("cluster"), nobody.alias("was"), F.lit(0).cast("bigint").alias("distance"))
    state, totals = _assigned(start, centroids, np.arange(len(centroids))), None
    for _ in range(rounds):
        after = _moved(totals, state)
        if totals is not None:
            forget(totals)
        totals = after
        fresh = centroids.copy()
        for r in totals.where("n > 0").collect():
            fresh[r.cluster] = [s // r.n for s in r.s]
        changed = np.flatnonzero((fresh != centroids).any(axis=1))
        if not len(changed):
            break
        centroids = fresh
        then = _assigned(state, centroids, changed)
        forget(state)
        state = then
    sums = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    if not sums:
        sums, digests = {0: 0}, [""]
    return state.select(
        "vec_id", "cluster", "distance",
        F.create_map(*[F.lit(x) for c, d in sums.items() for x in (c, d)])[F.col("cluster")].cast("bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.create_map(*[F.lit(x) for c in sums for x in (c, digests[c])])[F.col("cluster")].alias("centroid_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle_sql(rounds: int = ROUNDS, k: int = CENTROIDS, seed: int = SEED) -> str:
    """Plain Lloyd: every round compares every vector with every centroid."""
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"x AS (SELECT rid, unnest(range({DIMS})) AS pos, CAST(floor({SCALE} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"first AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS (SELECT c, pos, x FROM first JOIN x USING (rid))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS (SELECT rid, arg_min(c, d * 1000 + c) AS c, CAST(min(d) AS BIGINT) AS d FROM
  (SELECT x.rid, y.c, sum((x.x - y.x) * (x.x - y.x)) AS d FROM x JOIN c{r} y USING (pos) GROUP BY ALL) GROUP BY rid)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS (SELECT y.c, y.pos, CAST(coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, y.x) AS BIGINT) AS x FROM c{r} y LEFT JOIN
  (SELECT c, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY ALL) s ON s.c = y.c AND s.pos = y.pos)"""
            )
    return (
        "WITH " + ",\n".join(parts) + f""",
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN digest ON digest.c = a.c"""
    )


ORACLE_SQL = oracle_sql()
