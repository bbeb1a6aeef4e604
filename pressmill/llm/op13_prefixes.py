"""The trie of all prefixes of rebuilt conversations, as a table of nodes.

Every conversation c is rebuilt from the first h turns of conversation c - c % 5 (h = crc32 of c in decimal, % 9) and its own
turns after its first h. A node is a distinct sequence of first turns; its members are the conversations that start with it,
and its smallest member owns it. Who owns a prefix owns every longer prefix of itself, so a conversation owns a chain: all
depths from its first owned one to its end. The first owned depth is found by binary search, in rounds of one join of all
conversations with the minima of the prefix digests. The chains hang on one another as a tree, whose totals are summed
bottom-up by doubling (each round adds what hangs twice as far below), so that a tree of height n takes log n rounds; a
running sum down each chain then gives the nodes.

A prefix digest is the sum of a hash of each turn with its position, four numbers of 31 bits, so that it can be summed in any
order: a conversation of any length is taken in blocks of 2**BITS turns, none is gathered in one task, and positions come
from a sort by ranges. Different prefixes share a digest with a chance of some 2**-124 a pair.

`ends_sha256` hashes the ids of the conversations that end in a node, which the contract joins to one text: inner groups are
hashed where a sort by ranges puts them, groups that cross an Arrow batch are handed on as pieces of text, which one task for
each such group streams through its hash in order, with constant memory.

Nulls, ties, repeats: null role and text are empty; turns with equal numbers are ordered by role, then text, and repeated rows
are repeated turns; null turns come first. Rows without a conv_id belong to no conversation and are left out. For negative
ids c % 5 keeps c's sign. A conversation without turns after rebuilding is a member of the root alone. An empty table gives
no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.llm.common import forget, ship, table, text_or_empty, written

FAMILY, HEADS, BITS = 5, 9, 12
MASK = (1 << 31) - 1
LIMBS = ["l0", "l1", "l2", "l3"]
KEY = ["d", "p0", "p1"]
PIECE_SCHEMA = "d bigint, p0 bigint, p1 bigint, first bigint, piece string, sha string"
HASH_SCHEMA = "d bigint, p0 bigint, p1 bigint, sha string"


def heads_taken(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("bigint")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv, d, digest, bytes): every turn with its place from 1 in its conversation, written."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    turns = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", F.monotonically_increasing_id().alias("seq"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")),
        "turns",
    )
    # seq holds the sorted partition above its 33rd bit. Only a conversation that began in an earlier partition has turns
    # before this one, which is the first of its partition: `before` has at most as many rows as there are partitions.
    part = F.shiftright("seq", 33)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv", part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("conv", "part", F.sum("n").over(earlier).alias("base")).where("base > 0")
    here = turns.withColumn("part", part).withColumn("d", F.row_number().over(Window.partitionBy("conv", "part").orderBy("seq")))
    out = written(here.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("d") + F.coalesce("base", F.lit(0))).cast("bigint").alias("d"), "digest", "bytes"), "placed")
    forget(turns)
    return out


def running(rows: DataFrame, sums: list[str], back: bool = False) -> DataFrame:
    """Running sums (from the end: `back`) of columns along d within each conversation, and whether a row is its last.

    Blocks are summed each by itself, then the totals of the blocks before a block are added, so that no task holds more of a
    conversation than a block of it or a number for each of its blocks. `rows`: a written table with conv, d and the columns."""
    rows = rows.withColumn("block", F.shiftright("d", BITS))
    at = Window.partitionBy("conv", "block")
    along = at.orderBy(F.desc("d") if back else F.asc("d")).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({c: F.sum(c).over(along) for c in sums} | {"top": F.max("d").over(at)})
    blocks = Window.partitionBy("conv")
    earlier = blocks.orderBy(F.desc("block") if back else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "block").agg(*[F.sum(c).alias(f"of_{c}") for c in sums])
    offsets = totals.select("conv", "block", F.count("*").over(blocks).alias("blocks"), F.max("block").over(blocks).alias("top_block"), *[F.coalesce(F.sum(f"of_{c}").over(earlier), F.lit(0)).alias(f"of_{c}") for c in sums])
    done = inside.join(offsets.where("blocks > 1").drop("blocks"), ["conv", "block"], "left")
    last = (F.col("d") == F.col("top")) & (F.col("block") == F.coalesce("top_block", "block"))
    return done.withColumns({c: F.col(c) + F.coalesce(F.col(f"of_{c}"), F.lit(0)) for c in sums} | {"last": last}).select(*[c for c in rows.columns if c != "block"], "last")


def rebuilt_turns(placed: DataFrame) -> DataFrame:
    """(conv, d, bytes, four hashes) of all rebuilt conversations, the empty prefix of each included, written."""
    sizes = written(placed.groupBy("conv").agg(F.max("d").alias("n")), "sizes")
    roots = sizes.select(F.col("conv").alias("root"), F.col("n").alias("root_n"))
    wanted = sizes.withColumns({"h": heads_taken(F.col("conv")), "root": F.col("conv") - F.col("conv") % FAMILY})
    info = written(wanted.join(roots, "root", "left").withColumn("k", F.least("h", F.coalesce("root_n", F.lit(0)))).select("conv", "n", "h", "root", "k"), "rebuild")
    own = placed.where(F.col("d") > heads_taken(F.col("conv"))).withColumn("block", F.shiftright("d", BITS))
    short = info.where("k < h").select("conv", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("n", BITS))).alias("block"), (F.col("h") - F.col("k")).alias("less"))
    tails = own.join(short, ["conv", "block"], "left").select("conv", (F.col("d") - F.coalesce("less", F.lit(0))).alias("d"), "digest", "bytes")
    shared = placed.where((F.col("d") < HEADS) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "root")
    # A family has at most 9 members and gives at most 8 turns to each.
    heads = info.where("k > 0").select("conv", "root", "k").join(shared, "root").where("d <= k").select("conv", "d", "digest", "bytes")
    first, second = F.xxhash64(F.lit(1), "d", "digest"), F.xxhash64(F.lit(2), "d", "digest")
    limbs = [x.bitwiseAND(MASK) for y in (first, second) for x in (y, F.shiftrightunsigned(y, 31))]
    turns = tails.unionByName(heads).select("conv", "d", "bytes", *[x.alias(c) for c, x in zip(LIMBS, limbs, strict=True)])
    zero = F.lit(0).cast("bigint")
    out = written(turns.unionByName(info.select("conv", zero.alias("d"), zero.alias("bytes"), *[zero.alias(c) for c in LIMBS])), "rebuilt")
    forget(sizes, info)
    return out


def prefix_digests(rebuilt: DataFrame) -> DataFrame:
    """(conv, d, p0, p1, bytes, last): the digest of every prefix of every rebuilt conversation, written."""
    low = [F.col(c).bitwiseAND(MASK) for c in LIMBS]
    digests = [F.shiftleft(low[2 * i], 31).bitwiseOR(low[2 * i + 1]).alias(f"p{i}") for i in range(2)]
    return written(running(rebuilt, LIMBS).select("conv", "d", *digests, "bytes", "last"), "prefixes")


def first_owned(prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv, f, len): the first depth that each conversation owns, len + 1 where it owns none, written.

    Binary search: a conversation owns a depth where the minima have it as owner there, and then every greater depth."""
    owned = minima.select(F.col("owner").alias("conv"), F.col("d").alias("mid"), F.lit(True).alias("owns"))
    state = written(prefixes.where("last").select("conv", F.col("d").alias("len"), F.lit(0).cast("bigint").alias("lo"), (F.col("d") + 1).alias("hi")), "search")
    open_ = state.agg(F.max("hi")).first()[0] or 0
    while open_:
        probed = state.withColumn("mid", F.shiftright(F.col("lo") + F.col("hi"), 1)).join(owned, ["conv", "mid"], "left")
        yes, going = F.coalesce("owns", F.lit(False)), F.col("lo") < F.col("hi")
        step = probed.select("conv", "len", F.when(going & ~yes, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"), F.when(going & yes, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        step = written(step, "search")
        forget(state)
        state = step
        open_ = state.where("lo < hi").limit(1).count()
    return state.select("conv", F.col("lo").alias("f"), "len")


def hung_chains(found: DataFrame, prefixes: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """(conv, f, parent): every chain with the chain on which it hangs, at depth f - 1; the root's chain has none. Written."""
    chains = found.where("f <= len").select("conv", "f")
    at_root = chains.where("f <= 1").select("conv", "f", F.when(F.col("f") == 1, F.lit(root)).cast("bigint").alias("parent"))
    before = chains.where("f > 1").withColumn("d", F.col("f") - 1).join(prefixes.select("conv", *KEY), ["conv", "d"])
    deeper = before.join(minima.select(*KEY, F.col("owner").alias("parent")), KEY).select("conv", "f", "parent")
    return written(at_root.unionByName(deeper), "chains")


def chain_totals(own: DataFrame, chains: DataFrame, sums: list[str], root: int) -> DataFrame:
    """(conv, sums): totals of each chain and all that hang below it, written.

    Doubling: after j rounds a chain has what is less than 2**j chains below, and knows its 2**j-th ancestor."""
    state = written(chains.select("conv", F.col("parent").alias("up")).join(own, "conv"), "totals")
    while state.where("up IS NOT NULL").limit(1).count():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        # The root's chain, on which most hang, has nothing above it: no need to meet it in the join.
        jump = state.where(F.col("up") != root).select("conv", "up").join(state.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up").select("conv", "next")
        step = state.join(below, "conv", "left").join(jump, "conv", "left")
        step = written(step.select("conv", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]), "totals")
        forget(state)
        state = step
    return state.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and conv. A group inside a batch is hashed; one at its edge may go on and becomes a piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in KEY]
        conv = batch.column("conv").to_pylist()
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(conv)]])
        texts = [",".join(map(str, conv[a:b])) for a, b in zip(starts, ends, strict=True)]
        edge = {0, len(texts) - 1}
        piece = [x if k in edge else None for k, x in enumerate(texts)]
        sha = [None if k in edge else hashlib.sha256(x.encode()).hexdigest() for k, x in enumerate(texts)]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in keys], pa.array([conv[a] for a in starts], pa.int64()), pa.array(piece, pa.string()), pa.array(sha, pa.string())], [*KEY, "first", "piece", "sha"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first conv, hashed in order."""
    now, state = None, None

    def result(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in range(3)] + [pa.array([x[3] for x in done], pa.string())], [*KEY, "sha"])

    for batch in batches:
        done = []
        for *key, piece in zip(*[batch.column(c).to_pylist() for c in (*KEY, "piece")], strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(piece.encode())
        yield result(done)
    if now is not None:
        yield result([(*now, state.hexdigest())])


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """(key, sha): hash of the ids of the conversations that end in each node, for nodes in which one ends."""
    ends = prefixes.where("last").select(*KEY, "conv")
    pieces = written(ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_pieces, PIECE_SCHEMA), "pieces")
    crossing = pieces.where("sha IS NULL").select(*KEY, "first", "piece").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return pieces.where("sha IS NOT NULL").select(*KEY, "sha").unionByName(crossing.mapInArrow(_streamed, HASH_SCHEMA))


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    ship(conversations.sparkSession)
    placed = placed_turns(conversations)
    rebuilt = rebuilt_turns(placed)
    forget(placed)
    prefixes = prefix_digests(rebuilt)
    forget(rebuilt)
    ended = F.when(F.col("last"), F.col("conv"))
    minima = written(prefixes.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min(ended).alias("first_end")), "minima")
    root = minima.where("d = 0").select("owner").first()
    root = root[0] if root else 0
    chains = hung_chains(first_owned(prefixes, minima), prefixes, minima, root)

    place = ["conv", "d"]
    hung = chains.where("parent IS NOT NULL").select(F.col("conv").alias("chain"), F.col("parent").alias("conv"), (F.col("f") - 1).alias("d"))
    # The owner's own chain goes on below a node in which the owner doesn't end.
    goes_on = F.when(F.col("first_end") == F.col("owner"), F.lit(0)).otherwise(F.lit(1))
    own = minima.select(F.col("owner").alias("conv"), *KEY, "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), goes_on.alias("goes_on"))
    n_children = F.col("goes_on") + F.coalesce("hanging", F.lit(0))
    nodes = own.join(hung.groupBy(*place).agg(F.count("*").alias("hanging")), place, "left")
    nodes = written(nodes.select(*own.columns, n_children.cast("bigint").alias("n_children"), F.when(n_children == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("leaves")).drop("goes_on"), "nodes")

    sums = ["leaves", "saved"]
    totals = chain_totals(nodes.groupBy("conv").agg(*[F.sum(c).alias(c) for c in sums]), chains, sums, root)
    hanging = hung.join(totals.withColumnRenamed("conv", "chain"), "chain").groupBy(*place).agg(*[F.sum(c).alias(f"hung_{c}") for c in sums])
    starts = chains.select("conv", F.col("f").alias("d"), "parent", F.lit(True).alias("start"))
    full = nodes.join(hanging, place, "left").join(starts, place, "left")
    parent = F.when(F.col("start"), F.col("parent")).otherwise(F.col("conv"))
    full = written(full.select("conv", *KEY, "n_convs", "n_children", parent.alias("parent"), *[(F.col(c) + F.coalesce(f"hung_{c}", F.lit(0))).alias(c) for c in sums]), "full")
    return running(full, sums, back=True).join(end_hashes(prefixes), KEY, "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


# CRC-32 bit by bit over the decimal digits; every node meets each of its ancestors.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM t)),
joined AS (SELECT ids.c, 0 AS own, d, r, x FROM ids JOIN t ON t.c = ids.c - ids.c % {FAMILY} AND d <= h
  UNION ALL SELECT ids.c, 1, d, r, x FROM ids JOIN t ON t.c = ids.c AND d > h),
rebuilt AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY own, d) AS d FROM joined),
p AS (SELECT c, d, strlen(x) AS bytes, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM ids),
longest AS (SELECT c, max(d) AS n FROM p GROUP BY c),
node AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes, string_agg(CASE WHEN d = n THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM p JOIN longest USING (c) GROUP BY d, k),
up AS (SELECT y.c, y.d, x.c AS parent FROM node y JOIN p ON p.c = y.c AND p.d = y.d - 1 JOIN node x ON x.d = p.d AND x.k = p.k),
kids AS (SELECT parent AS c, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
low AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (c, d)),
sums AS (SELECT p.d, p.k, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * low.bytes) AS saved FROM low JOIN p ON p.c = low.c AND p.d <= low.d GROUP BY p.d, p.k)
SELECT low.c AS conv_id, low.d AS depth, up.parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM low JOIN sums ON sums.d = low.d AND sums.k = low.k LEFT JOIN up ON up.c = low.c AND up.d = low.d
"""
