"""Conversation prefix trie: which prefixes of turns conversations share, screened by a count-min sketch of prefix digests.

A turn's digest is hashed together with its place, and a prefix has the exclusive or of the hashes of its turns: a value that runs along a conversation,
can be summed in blocks of a long one, and gives the parent's digest by taking the last turn out again. A count-min sketch counts the digests. It never
counts too low, so an estimate of one proves that no other conversation has the prefix: from there on the conversation is a chain of its own, whose nodes
are given where the row is. Only prefixes that may be shared are shuffled and grouped exactly. Sums over subtrees take a number of steps that grows with
the logarithm of the deepest shared prefix, by pointers to ancestors that reach twice as far each time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, parts, schema, settle, ship, table

#: Turns that a conversation may take over, less one.
TAKEN = 9
#: Conversations that share one to take turns from.
FAMILY = 5
#: Turns of a conversation that one task runs along.
BLOCK = 4096
#: Rows of the sketch, counters of a row at least and at most, and counters for each prefix: what is sent to all tasks has at most ROWS * MOST / 8 bytes.
ROWS, LEAST, MOST, ROOM = 4, 1 << 12, 1 << 24, 4
#: Counters that tasks hand on together.
CELLS = 1024
#: Ids that are joined to one piece before a list of ids is hashed in order.
IDS = 4096
_MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]
NO_IDS = hashlib.sha256(b"").hexdigest()


def width_of(prefixes: int) -> int:
    """Counters in a row of the sketch, a power of two."""
    return min(MOST, max(LEAST, 1 << (ROOM * max(1, prefixes) - 1).bit_length()))


def _cells(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    """The counters of each digest, one in each row; those of the second row begin after the first's."""
    a, b = k1.view(np.uint64), k2.view(np.uint64)
    found = []
    for r, odd in enumerate(_MIX[:ROWS]):
        x = (a + b * np.uint64(2 * r + 1)) * np.uint64(odd)
        found.append(((x >> np.uint64(40)) & np.uint64(width - 1)).astype(np.int64) + r * width)
    return found


def _counted(width: int, together: int):
    """Digests (k1, k2) -> (block, counts): a task's counters, up to two, in blocks that are not all zero."""

    def run(batches):
        counts = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            for cells in _cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width):
                at, n = np.unique(cells, return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
        blocks = counts.reshape(-1, together)
        used = np.flatnonzero(blocks.any(axis=1))
        for i in range(0, len(used), 1024):
            some = used[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[b].tobytes() for b in some], pa.binary())], ["block", "counts"])

    return run


def _merged(batches):
    """Rows in order of their block -> (block, bits): which counters are two or more."""
    at, total = None, None
    for batch in batches:
        blocks, bits = [], []
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != at:
                if at is not None:
                    blocks.append(at), bits.append(np.packbits(total >= 2).tobytes())
                at, total = block, np.zeros(len(counts), np.uint8)
            total = np.minimum(total + np.frombuffer(counts, np.uint8), 2)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["block", "bits"])


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Of every counter of the sketch over prefixes(k1, k2) one bit: whether it counts two or more."""
    together = min(CELLS, width)
    counted = prefixes.select("k1", "k2").mapInArrow(_counted(width, together), schema("block int, counts binary"))
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, schema("block int, bits binary"))
    bits = np.zeros((ROWS * width // together, together // 8), np.uint8)
    for r in merged.collect():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def _several(bits: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Whether the estimate of each digest is above one."""
    found = np.ones(len(k1), bool)
    for cells in _cells(k1, k2, len(bits) * 8 // ROWS):
        found &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def _screened(bits: np.ndarray):
    """Adds to the rows whether the prefix, and the one without its last turn, may be shared; the root counts as shared."""

    def run(batches):
        for batch in parts(batches):
            k1, k2, p1, p2, depth = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("k1", "k2", "p1", "p2", "depth"))
            shared, above = _several(bits, k1, k2), _several(bits, p1, p2) | (depth == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared), pa.array(above)], [*batch.schema.names, "shared", "above"])

    return run


def _pieces(most: int):
    """Rows (k1, k2, conv) in order -> (k1, k2, first, ids): up to `most` ids joined."""

    def run(batches):
        at, ids = None, []
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != at or len(ids) >= most:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = (k1, k2), []
                ids.append(conv)
            yield _table(out, _PIECES)
        if ids:
            yield _table([(*at, ids[0], ",".join(map(str, ids)))], _PIECES)

    return run


_PIECES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hash", pa.string())])


def _table(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)


def _hashed(batches):
    """Pieces of lists of ids in order -> the SHA-256 of each whole list; a list is never held."""
    at, sha, out = None, None, []
    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (k1, k2) == at:
                sha.update(b",")
            else:
                if at:
                    out.append((*at, sha.hexdigest()))
                at, sha = (k1, k2), hashlib.sha256()
            sha.update(ids.encode())
        yield _table(out, _HASHES)
        out.clear()
    if at:
        out.append((*at, sha.hexdigest()))
    yield _table(out, _HASHES)


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv, place (from 1), m1, m2, bytes: every turn's place in its conversation, a digest of its role and text, and the bytes of the text.

    The order is by turn, null first, then by the digest. It is a sort by ranges, so a conversation of any length is spread over tasks; places go on from
    those of the ranges before, of which at most one for each range has to be known.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda i: F.conv(F.substring("mark", i, 15), 16, 10).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.octet_length(text).cast("long").alias("bytes"), mark.alias("mark"))
    rows = rows.filter("conv IS NOT NULL").select("conv", "turn", "bytes", half(1).alias("m1"), half(16).alias("m2"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "m1", "m2", "row"]
    rows = settle(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "trie-turns")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy("conv", "range").agg(F.count("*").alias("n")).withColumn("before", before).filter("before IS NOT NULL").select("conv", "range", "before")
    here = F.row_number().over(Window.partitionBy("range", "conv").orderBy(*order[1:]))
    placed = rows.withColumn("here", here).join(F.broadcast(ranges), ["conv", "range"], "left")
    return settle(placed.select("conv", (F.col("here") + F.coalesce("before", F.lit(0))).alias("place"), "m1", "m2", "bytes"), "trie-places")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each has taken the first turns of its family's first: conv, length and conv, length, depth, m1, m2, bytes."""
    conv = F.col("conv")
    convs = placed.groupBy("conv").agg(F.count("*").alias("n"))
    convs = settle(convs.select("conv", "n", (conv - conv % FAMILY).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % TAKEN).alias("h")), "trie-sizes")
    taken, own = F.least("h", F.coalesce("base_n", F.lit(0))), F.greatest(F.lit(0), F.col("n") - F.col("h"))
    convs = convs.join(convs.select(conv.alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", taken).withColumn("length", F.col("taken") + own)
    convs = settle(convs.select("conv", "n", "base", "h", "taken", "length"), "trie-conversations")
    kept = hot_join(placed, convs.select("conv", "h", "taken", "length", "n"), "conv", "n", "inner").filter("place > h")
    kept = kept.select("conv", "length", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "m1", "m2", "bytes")
    first = placed.filter(F.col("place") < TAKEN).select(conv.alias("base"), "place", "m1", "m2", "bytes")
    lent = convs.filter("taken > 0").select("conv", "base", "length", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("place"))
    lent = lent.join(first, ["base", "place"]).select("conv", "length", F.col("place").alias("depth"), "m1", "m2", "bytes")
    return convs.select("conv", "length"), kept.unionByName(lent)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv, length, depth, bytes, k1, k2, p1, p2: the digest of each prefix and of the one without its last turn."""
    hashed = [F.xxhash64(F.lit(i), "depth", "m1", "m2").alias(f"h{i}") for i in (1, 2)]
    rows = rebuilt.select("conv", "length", "depth", "bytes", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *hashed)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.filter(F.col("length") > BLOCK).groupBy("conv", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    blocks = blocks.select("conv", "block", *[F.bit_xor(f"x{i}").over(earlier).alias(f"b{i}") for i in (1, 2)])
    long = rows.filter(F.col("length") > BLOCK).join(blocks, ["conv", "block"])
    short = rows.filter(F.col("length") <= BLOCK).withColumns({"b1": F.lit(None).cast("long"), "b2": F.lit(None).cast("long")})
    along = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda i: F.bit_xor(f"h{i}").over(along).bitwiseXOR(F.coalesce(f"b{i}", F.lit(0)))
    both = short.unionByName(long).withColumns({"k1": key(1), "k2": key(2)})
    return both.select("conv", "length", "depth", "bytes", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)])


def subtree_sums(tree: DataFrame, height: int) -> DataFrame:
    """tree (key, up, leaves, saved), up null at the top -> key with leaves and saved summed over its subtree.

    After step i a row holds the sum over descendants less than 2**i below, and points 2**i up. The steps are written; a parent of very many is a hot key.
    """
    state = tree.select("key", "up", "leaves", "saved")
    for left in reversed(range(max(0, height).bit_length())):
        below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        added = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
        state = settle(state.join(below, "key", "left").select("key", "up", added("leaves", "l"), added("saved", "s"), F.coalesce("n", F.lit(0)).alias("n")), "trie-sums")
        if left:
            further = state.filter("n > 0").select(F.col("key").alias("up"), F.col("up").alias("next"), "n")
            moved = hot_join(state.filter("up IS NOT NULL").drop("n"), further, "up", "n", "inner")
            state = settle(moved.select("key", F.col("next").alias("up"), "leaves", "saved").unionByName(state.filter("up IS NULL").drop("n")), "trie-jumps")
    return state.select("key", "leaves", "saved")


def _ends_hash(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """key, hash for the nodes at which several conversations end."""
    several = nodes.filter("n_ends > 1").select("key", "n_ends")
    ids = hot_join(ends, several, "key", "n_ends", "inner").select("key.k1", "key.k2", "conv")
    pieces = ids.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(_pieces(IDS), schema("k1 long, k2 long, first long, ids string"))
    hashes = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, schema("k1 long, k2 long, hash string"))
    return hashes.select(F.struct("k1", "k2").alias("key"), "hash")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each distinct prefix of the rebuilt conversations.

    turns: conv_id, turn, role, text. Null roles and texts are empty; turns without a conv_id belong to no conversation and are left out; turns of one number
    are ordered by a digest, so repeated rows are turns of their own. No rows: no rows, not even a root. Other columns are ignored. Turns are told apart by
    120 bits of a digest, prefixes by 128 bits.
    """
    ship(turns.sparkSession)
    convs, rebuilt = rebuilt_turns(placed_turns(turns))
    rows = settle(prefixes(rebuilt), "trie-prefixes")
    bits = sketch(rows, width_of(rows.count()))
    rows = rows.mapInArrow(_screened(bits), schema(rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", shared boolean, above boolean"))
    rows = settle(rows, "trie-screened")
    key, parent = F.struct("k1", "k2").alias("key"), F.when(F.col("above"), F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))).alias("up")

    zero = F.lit(0).cast("long")
    root = convs.select("conv", "length", zero.alias("depth"), zero.alias("bytes"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), F.lit(False).alias("above"))
    may_be = rows.filter("shared").drop("shared").unionByName(root)
    ends = F.col("length") == F.col("depth")
    nodes = may_be.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv_id"), *[F.max(x).alias(x) for x in ("depth", "bytes", "p1", "p2", "above")], F.count("*").alias("n_convs"),
        F.count_if(ends).alias("n_ends"), F.max(F.when(ends, F.col("conv"))).alias("last_end"),
    )
    nodes = settle(nodes.select(key, parent, "conv_id", "depth", "bytes", "n_convs", "n_ends", "last_end"), "trie-nodes")
    tails = rows.filter("NOT shared AND above").select(parent, "conv", "depth", "length")
    below = nodes.filter("up IS NOT NULL").select("up", zero.alias("tail")).unionByName(tails.select("up", F.lit(1).cast("long").alias("tail")))
    below = below.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"), F.sum("tail").alias("tails"))
    tree = nodes.join(below, "key", "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "leaves": F.coalesce("tails", F.lit(1)).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"),
    })
    tree = settle(tree.drop("tails", "bytes"), "trie-tree")
    sums = subtree_sums(tree, tree.agg(F.max("depth")).first()[0] or 0).toDF("key", "n_leaves", "saved_tokens")

    one, none = F.sha2(F.col("last_end").cast("string").cast("binary"), 256), F.lit(NO_IDS)
    named = tree.join(sums, "key").join(_ends_hash(nodes, may_be.filter(ends).select(key, "conv")), "key", "left")
    named = named.withColumn("ends_sha256", F.when(F.col("n_ends") == 0, none).when(F.col("n_ends") == 1, one).otherwise(F.col("hash")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    chain = lambda df, *more: df.select(
        F.col("conv").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(ends, own).otherwise(none).alias("ends_sha256"), *more,
    )
    hanging = named.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "up").unionByName(chain(tails, "up"))
    parents = tree.filter("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = parents.withColumnRenamed("n_children", "n_below")
    hung = hot_join(hanging, parents, "up", "n_below")
    # a node that may be shared and whose parent is not is a conversation's own, as is all of a chain but its top
    hung = hung.withColumn("parent_conv_id", F.when(F.col("up").isNotNull(), F.col("parent_conv_id")).when(F.col("depth") > 0, F.col("conv_id")))
    alone = chain(rows.filter("NOT shared AND NOT above"), F.col("conv").alias("parent_conv_id"))
    return hung.select(columns).unionByName(alone.select(columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
listed AS (SELECT conv_id, list({{'m': m, 'b': b}} ORDER BY turn NULLS FIRST, m) AS l, CAST(conv_id AS VARCHAR) AS s FROM turns GROUP BY conv_id),
checked AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
    lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda d, i: xor(d >> 1, (d & 1) * 3988292384)))) % {TAKEN} AS h FROM listed),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.l, 1, c.h), []), coalesce(list_slice(c.l, c.h + 1, len(c.l)), [])) AS l
  FROM checked c LEFT JOIN checked b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
prefix AS MATERIALIZED (
  SELECT conv_id, depth, depth = len(l) AS ends, coalesce(l[depth].b, 0) AS b, md5(array_to_string(list_transform(list_slice(l, 1, depth), lambda x: x.m), '')) AS k,
    md5(array_to_string(list_transform(list_slice(l, 1, depth - 1), lambda x: x.m), '')) AS p
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM rebuilt)),
node AS MATERIALIZED (
  SELECT depth, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefix GROUP BY depth, k),
child AS (SELECT depth - 1 AS depth, p AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
sums AS (
  SELECT a.depth, a.k, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(d.saved) AS saved
  FROM node d LEFT JOIN child c USING (depth, k) JOIN prefix a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.depth, a.k)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sums s USING (depth, k) LEFT JOIN child c USING (depth, k) LEFT JOIN node up ON up.depth = n.depth - 1 AND up.k = n.p AND n.depth > 0
"""
