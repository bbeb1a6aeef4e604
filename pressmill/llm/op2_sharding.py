"""Sharding by minimax contiguous partition, in DataFrame operations only.

Groups of rows with equal texts are atomic. Their order is by digest of the text, so it is fixed by the data alone.
The smallest feasible capacity is found by binary search with a greedy check. The search needs prefix sums only near
the cuts, so the driver holds a skeleton of at most a few thousand boundaries and asks Spark for finer ones inside the
few intervals where a cut can lie, until the strict bound (cuts on known boundaries) meets the relaxed one (cuts
anywhere). No list of groups, and no group, is ever collected. The greedy check leaves what is over to the last shards, so
the cuts are then moved, under that capacity, to the known boundaries nearest the even marks.

A group above the even share fills a shard of its own; the others are spread by minimax over the shards that remain,
so one hot text cannot leave shards empty.

Nulls, empties, ties: a null text counts as empty (text size 0); rows repeated in full are rows of the same group and
get slots of their own; rows with a null id sort first; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import text_or_empty, written

ROW_OVERHEAD = 16
BUCKET_HEX = 3  # leading hex digits of the digest: 4096 prefix-sum buckets
SALTS = 64
BOUNDARIES = 8192  # boundaries asked for in one refinement


def _next_cut(known: list[int], start: int, capacity: int) -> int:
    """Farthest known boundary within the capacity; start itself if there is none."""
    return known[bisect_right(known, start + capacity) - 1]


def _strict(known: list[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy over known boundaries: the cuts, or None when the shards do not suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        nxt = _next_cut(known, at, capacity)
        if nxt == at and at < known[-1]:
            return None
        at = nxt
        cuts.append(at)
    return cuts if at == known[-1] else None


def _relaxed(known: list[int], atomic: set[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy that may also cut inside an interval whose inner boundaries are unknown; reaches at least as far as any real cut."""
    cuts, at = [], 0
    for _ in range(shards):
        k = bisect_right(known, at + capacity) - 1
        reach = known[k]
        if k + 1 < len(known) and known[k + 1] not in atomic:
            reach = at + capacity
        at = min(reach, known[-1])
        cuts.append(at)
    return cuts if at >= known[-1] else None


def _smallest(feasible, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if feasible(mid) is not None:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(known: list[int], atomic: set[int], shards: int, largest: int, finer) -> tuple[int, list[int]]:
    """Smallest capacity and its cuts.

    known: ascending boundaries from 0 to the total. atomic: boundaries whose interval (down to the one before) is one
    group. finer(intervals): more boundaries inside the (low, high) intervals, with the atomic ones among all of them.
    """
    total = known[-1]
    floor = max(largest, -(-total // shards))
    while True:
        high = _smallest(lambda c: _strict(known, shards, c), floor, max(total, floor))
        low = _smallest(lambda c: _relaxed(known, atomic, shards, c), floor, high)
        if low == high:
            return high, even_cuts(known, shards, high)
        first = [c for c in (_strict_reach(known, shards, low)) if c < total]
        last = [c for c in _relaxed(known, atomic, shards, high) if c <= total]
        wanted = []
        for a, b in zip(first, last, strict=False):
            i, j = bisect_right(known, a) - 1, bisect_right(known, b)
            wanted += [(known[k], known[k + 1]) for k in range(max(i, 0), min(j, len(known) - 1)) if known[k + 1] not in atomic]
        if not wanted:
            return high, even_cuts(known, shards, high)
        wanted = sorted(set(wanted))
        more, single = finer(_merged(wanted))
        # A share of many boundaries may be known already; fewer intervals give a finer share, one gives new ones.
        while len(wanted) > 1 and more.issubset(known) and single.issubset(atomic):
            wanted = wanted[: len(wanted) // 2]
            more, single = finer(_merged(wanted))
        known = sorted({*known, *more})
        atomic = (atomic & set(known)) | single


def even_cuts(known: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts under a feasible capacity, each at the boundary nearest to an even share of what is left, as far as the rest
    still fits the shards that are left. None is empty while boundaries last."""
    cuts, at, total = [], 0, known[-1]
    for left in range(shards, 1, -1):
        here, far = bisect_right(known, at) - 1, bisect_right(known, at + capacity) - 1
        low, high = min(here + 1, far), far
        while low < high:  # the earliest boundary from which the other shards suffice
            mid = (low + high) // 2
            if _strict_from(known, known[mid], left - 1, capacity):
                high = mid
            else:
                low = mid + 1
        mark = at + (total - at) / left
        k = min(max(bisect_right(known, mark), low), far)
        best = min((j for j in (k - 1, k) if low <= j <= far), key=lambda j: abs(known[j] - mark))
        # Leave a boundary for every shard to come, where there are enough.
        best = max(low, min(best, len(known) - left))
        at = known[best]
        cuts.append(at)
    return [*cuts, total]


def _strict_from(known: list[int], at: int, shards: int, capacity: int) -> bool:
    for _ in range(shards):
        at = _next_cut(known, at, capacity)
    return at >= known[-1]


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(intervals)):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _strict_reach(known: list[int], shards: int, capacity: int) -> list[int]:
    at, out = 0, []
    for _ in range(shards):
        at = _next_cut(known, at, capacity)
        out.append(at)
    return out


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` as (id, size, text_crc32, shard, slot); see the module for the law and the edge cases."""
    text = text_or_empty(text_col)
    base = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "shard-rows",
    )
    # One row for each (text, salt): a hot text is dealt over SALTS tasks, and slots inside it come from counts.
    cells = base.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = written(
        cells.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("bucket", F.substring(F.hex("digest"), 1, BUCKET_HEX)),
        "shard-groups",
    )
    top = [r.bytes for r in groups.orderBy(F.desc("bytes")).limit(shards).select("bytes").collect()]
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left, rest = 0, shards, total
    while alone < len(top) and left > 1 and top[alone] * left > rest:
        rest, left, alone = rest - top[alone], left - 1, alone + 1
    bar = top[alone - 1] if alone else None
    # Groups of the same size as the smallest one set apart are told from each other by digest.
    big = groups.where(F.col("bytes") >= bar).orderBy(F.desc("bytes"), "digest").limit(alone).collect() if alone else []
    big = [(bytes(r.digest), r.bytes) for r in big]
    apart = F.lit(False) if not big else F.col("digest").isin([F.lit(d) for d, _ in big])
    groups = groups.withColumn("apart", apart).withColumns({"own_n": F.when(~F.col("apart"), F.col("n")).otherwise(0), "own_bytes": F.when(~F.col("apart"), F.col("bytes")).otherwise(0)})

    # Prefix sums in two levels: inside a bucket by a window, over the (4096 at most) buckets by offsets.
    per_bucket = groups.groupBy("bucket").agg(F.sum("own_bytes").alias("b"), F.sum("own_n").alias("r"), F.count("*").alias("k")).orderBy("bucket").collect()
    offsets, at_b, at_r, known, atomic = [], 0, 0, [0], set()
    for r in per_bucket:
        offsets.append((r.bucket, at_b, at_r))
        at_b, at_r = at_b + r.b, at_r + r.r
        if r.b:
            known.append(at_b)
            if r.k == 1:
                atomic.add(at_b)
    spark = docs.sparkSession
    starts = spark.createDataFrame(offsets or [("", 0, 0)], "bucket string, b0 long, r0 long")
    order = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(
        groups.join(F.broadcast(starts), "bucket").select(
            "digest", "apart", "own_bytes",
            (F.sum("own_bytes").over(order) + F.col("b0")).alias("upto"),
            (F.sum("own_n").over(order) + F.col("r0") - F.col("own_n")).alias("rows_before"),
        ),
        "shard-prefix",
    )

    def finer(intervals: list[tuple[int, int]]) -> tuple[set[int], set[int]]:
        """All boundaries inside the intervals where they are few, else a share of them by hash: exact ones either way."""
        inside = F.lit(False)
        for a, b in intervals:
            inside = inside | ((F.col("upto") > a) & (F.col("upto") <= b))
        near = placed.where(~F.col("apart") & inside)
        share = -(-near.count() // BOUNDARIES)
        if share > 1:
            near = near.where(F.pmod(F.xxhash64("upto", F.lit(share)), F.lit(share)) == 0)
        found = {r.upto for r in near.select("upto").collect()}
        return found, (found if share <= 1 else set())

    cuts: list[int] = []
    if known[-1]:
        largest = top[alone] if alone < len(top) else 0
        _, cuts = minimax_cuts(known, atomic, left, largest, finer)
    shard = F.lit(alone)
    if cuts:
        shard = shard + F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts[:-1]]) if len(cuts) > 1 else F.array().cast("array<long>"), lambda c: c < F.col("upto")))
    for k, (digest, _) in enumerate(big):
        shard = F.when(F.col("digest") == F.lit(digest), F.lit(k)).otherwise(shard)
    dealt = placed.withColumn("shard", shard.cast("int"))
    first = dealt.where("not apart").groupBy("shard").agg(F.min("rows_before").alias("first_row"))
    dealt = dealt.join(F.broadcast(first), "shard", "left").select("digest", "shard", F.when(F.col("apart"), F.lit(0)).otherwise(F.col("rows_before") - F.col("first_row")).alias("slot0"))

    salted = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = cells.select("digest", "salt", F.coalesce(F.sum("n").over(salted), F.lit(0)).alias("before")).join(dealt, "digest")
    numbered = base.withColumn("k", F.row_number().over(Window.partitionBy("digest", "salt").orderBy("id")) - 1)
    return numbered.join(cell_start, ["digest", "salt"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot0") + F.col("before") + F.col("k")).alias("slot")
    )


def query(spark, sf_dir):
    from pressmill.llm.common import table

    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
