"""N-gram Jaccard join by PartEnum signatures; documents that links connect form a class.

Sets are classed by size, so that similar sets are in the same class or the next one. Two sets of a pair of classes that are similar enough differ in at
most k features. The features are dealt by a hash to more parts than k differences can fill with two each, and every part to two halves. One part at
least then has at most one difference, so one of its halves is the same in both sets: the features of each half, with its place, are a signature. For
small k one part with k + 2 pieces does the same: every choice of two pieces is a signature. So two similar sets share a signature for certain.

A half without features is the same in all sets that have none there and would gather strangers. It gives no signature; instead there are SPARE parts
beyond the number that the count needs. A set with more such parts than are spare gives the signatures of another dealing too, and those of the last
one give all. Of two similar sets the one with fewer such parts decides, so nothing is lost.

The smallest set of a signature is its pivot. Each set is verified against the pivot with which it shares most signatures, then pairs with other pivots
across components, then under each signature that still has several components with the set that shares signatures with most others, then what is
left meets in tiles of bounded size. Before whole sets are compared, a pair has to
pass a bound that loses nothing: a set's parities say for each of BITS cells whether it holds an odd number of features, and two sets differ in at least as
many features as their parities do in cells.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, hot_join, parts, schema, settle, ship, table
from .components import components
from .near_dup import SQL as FIVE_WORDS
from .near_dup import _same_ids, by_document, shingles, tiles, verify, words_key, words_of

WORDS, PERCENT = 4, 85
#: Up to so many differences one part with k + 2 pieces is used, beyond it parts with two halves.
FEW_DIFFERENCES = 3
#: Dealings of the features; a set with too many empty signatures in one goes on to the next.
DEALINGS = 4
_RNG = np.random.default_rng(20240612)
_DEAL = _RNG.integers(0, 1 << 63, DEALINGS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE, _CELL, _CLASS = (_RNG.integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
#: Signatures of a batch that Python hands back.
ROWS = 1 << 16
#: Cells of the parities, in words of 64.
WORDS_64 = 16
BITS = 64 * WORDS_64


class SizeClass(NamedTuple):
    """Sets of `low` to `high` features; with those of the next class, of up to `reach`, they differ in at most k."""

    low: int
    high: int
    reach: int
    k: int
    parts: int
    pieces: int
    spare: int

    @property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.pieces), self.pieces - self.k if self.parts == 1 else self.pieces - 1))


@lru_cache
def size_classes(percent: int, most: int) -> list[SizeClass]:
    """The classes of sets of up to `most` features."""
    found, low = [], 1
    while low <= most:
        high = low * 100 // percent
        reach = high * 100 // percent
        k = (100 - percent) * (high + reach) // (100 + percent)
        if k <= FEW_DIFFERENCES:
            found.append(SizeClass(low, high, reach, k, 1, k + 2 if k else 1, 0))
        else:
            need = k // 2 + 1
            spare = 1 + need // 32
            found.append(SizeClass(low, high, reach, k, need + spare, 2, spare))
        low = high + 1
    return found


def _dealt(s: np.ndarray, at: int, c: SizeClass) -> np.ndarray:
    value, count = s * np.uint64(_VALUE), c.parts * c.pieces
    value ^= value >> np.uint64(32)
    for dealing in range(DEALINGS):
        x = s * _DEAL[dealing]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        cell = ((x >> np.uint64(32)) % np.uint64(c.parts) * np.uint64(c.pieces) + (x & np.uint64(0xFFFFFFFF)) % np.uint64(c.pieces)).astype(np.int64)
        held = np.bincount(cell, minlength=count).reshape(c.parts, -1)
        # sums of the values modulo 2**64, by halves that a double holds exactly
        low, high = (np.bincount(cell, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=count).astype(np.uint64) for v in (value, value >> np.uint64(32)))
        sums = (low + (high << np.uint64(32))).reshape(c.parts, -1)
        place = (np.arange(c.parts * len(c.choices), dtype=np.uint64) + np.uint64(1)).reshape(c.parts, -1)
        some = np.stack([held[:, list(w)].sum(1) for w in c.choices], axis=1) > 0
        signed = np.stack([sums[:, list(w)].sum(1, dtype=np.uint64) for w in c.choices], axis=1) + place * np.uint64(_CELL) + np.uint64((dealing + 1 + at * DEALINGS) * _CLASS % (1 << 64))
        signed = (signed ^ (signed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        if dealing == DEALINGS - 1:
            yield signed.ravel()
        else:
            yield signed[some]
            if (~some.all(1)).sum() <= c.spare:
                return


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signed 64-bit signatures of a set of feature hashes, under its own class of sizes and under the one below."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    classes = size_classes(percent, 1 << n.bit_length())
    own = next(i for i, c in enumerate(classes) if n <= c.high)
    found = list(_dealt(s, own, classes[own]))
    if own and classes[own - 1].k and n <= classes[own - 1].reach:
        found += _dealt(s, own - 1, classes[own - 1])
    return np.concatenate(found).view(np.int64)


def node_of(words: list[bytes], apart: dict[bytes, int]) -> int:
    """The number of a text class, 64 bits of a hash; the few classes that share one have numbers in `apart`."""
    node = xxhash.xxh3_64_intdigest(b" ".join(words), seed=7)
    if apart:
        node = apart.get(words_key(words), node)
    return node - (1 << 64) if node >> 63 else node


def _read(size: int):
    def run(batches):
        for batch in parts(batches):
            words = [words_of(t) for t in batch.column(2).to_pylist()]
            sizes = [len(shingles(w, size)) for w in words]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([words_key(w) if w else None for w in words], pa.binary()), pa.array([node_of(w, {}) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_shingles", "words_key", "node"])

    return run


def _signed(percent: int, size: int, apart: dict[bytes, int]):
    """Texts -> (sig, node). A class that a task has just given is not given again."""

    def run(batches):
        seen, nodes, sigs, held = set(), [], [], 0
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                node = node_of(words, apart) if words else None
                if node is None or node in seen:
                    continue
                if len(seen) >= ROWS:
                    seen.clear()
                seen.add(node)
                s = signatures(shingles(words, size), percent)
                nodes.append(np.full(len(s), node)), sigs.append(s)
                held += len(s)
                if held >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])
                    nodes, sigs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])

    return run


def _with_node(apart: dict[bytes, int]):
    def run(batches):
        for batch in parts(batches):
            nodes = [node_of(words_of(t), apart) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0)], ["node", "text"])

    return run


def parities(s: np.ndarray) -> np.ndarray:
    """WORDS_64 longs: the parity of the number of features in each cell."""
    cell = (s * np.uint64(_VALUE) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _names(side: str) -> list[str]:
    return [f"{side}{i}" for i in range(WORDS_64)]


def _sketched(size: int):
    def run(batches):
        for batch in parts(batches):
            sets = [shingles(words_of(t), size) for t in batch.column(1).to_pylist()]
            columns = np.array([parities(s) for s in sets], np.int64).reshape(-1, WORDS_64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, columns)], ["node", "size", *_names("s")])

    return run


def _may_be_similar(one: str, two: str, percent: int) -> Column:
    """Whether two sets, by their sizes and parities, can be similar enough."""
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"s{one}{i}").bitwiseXOR(F.col(f"s{two}{i}"))) for i in range(WORDS_64)))
    a, b = F.col(f"size_{one}"), F.col(f"size_{two}")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (differ * (100 + percent) <= (100 - percent) * (a + b))


def _small(df: DataFrame) -> DataFrame:
    """A written table of short rows, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _across(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    side = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """members (sig, node, n_shingles) of the signatures that hold several components, with component and minor: whether it is not the signature's largest."""
    own = settle(members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-members")
    largest = own.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("several"))
    found = own.join(largest.filter("several > 1"), "sig").select("sig", "node", "n_shingles", "component", (F.col("component") != F.col("major")).alias("minor"))
    return settle(found, "join-open-members")


def _hub_pairs(open_: DataFrame) -> DataFrame:
    """(a, b): every member of an open signature with the member that shares signatures with most others, if they are of different components.

    Copies of one text, each changed in its own way, are nearer to that text than to each other, so it shares more signatures with them than they do.
    """
    sizes = open_.groupBy("sig").agg(F.count("*").alias("n"))
    weights = open_.select("sig", "node").join(sizes, "sig").groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = open_.join(weights, "node").groupBy("sig").agg(F.max_by(F.struct("node", "component"), F.struct("weight", "node")).alias("hub"))
    pairs = open_.join(hubs, "sig").filter(F.col("component") != F.col("hub.component")).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    return settle(pairs.distinct(), "join-hub-pairs")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text); texts are linked whose shingles of `size` words have a similarity of `percent`.

    Null, empty and blank texts have no shingles and stand alone. Rows of one id are one document: its texts are linked. A row without an id can link
    others; its component_id is the smallest id it reaches, null if there is none. No rows: no rows. Other columns are ignored. Every link is found, but for
    features of the same 64-bit hash.
    """
    if not 50 <= percent <= 99 or not 1 <= size <= 5:
        raise ValueError(f"a threshold of {percent} percent or shingles of {size} words are outside 50 to 99 or 1 to 5")
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    signed = settle(source.select("key", "doc_id", "text").mapInArrow(_read(size), schema("key long, doc_id long, n_shingles long, words_key binary, node long")), "join-texts")
    same = signed.filter("words_key IS NOT NULL").groupBy("words_key").agg(F.min("node").alias("node"), F.min("key").alias("key"), F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    same = settle(same, "join-copies")
    # classes of the same 64 bits, expected from about 10**9 classes on, are told apart by other bits
    clash = same.join(same.groupBy("node").count().filter("count > 1").select("node"), "node", "left_semi").select("words_key").collect()
    apart = {bytes(r.words_key): xxhash.xxh3_64_intdigest(r.words_key, seed=8) for r in clash}
    if apart:
        new = F.create_map(*[F.lit(x) for k, n in apart.items() for x in (k.hex(), n - (1 << 64) if n >> 63 else n)])
        same = settle(same.withColumn("node", F.coalesce(F.try_element_at(new, F.lower(F.hex("words_key"))), "node")), "join-copies")

    by_sig = Window.partitionBy("sig").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    rows = source.select("text").mapInArrow(_signed(percent, size, apart), schema("sig long, node long"))
    shared = settle(rows.withColumn("pivot", F.first("node").over(by_sig)).filter("node <> pivot"), "join-shared")
    proposed = settle(shared.groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n")), "join-proposed")
    texts = _texts(source, same, proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct(), apart)

    sketches = settle(texts.mapInArrow(_sketched(size), schema("node long, size long, " + ", ".join(f"{x} long" for x in _names("s")))), "join-sketches")
    one, two = (sketches.toDF(x, f"size_{x}", *_names(f"s{x}")) for x in "ab")
    pivots = one.join(proposed.groupBy("a").agg(F.count("*").alias("members")), "a")
    likely = settle(hot_join(proposed.join(two, "b"), pivots, "a", "members", "inner").filter(_may_be_similar("a", "b", percent)).select("a", "b", "n"), "join-likely")

    check = lambda pairs, label: settle(verify(settle(pairs, f"{label}-pairs"), texts, percent, size), label)
    best = settle(likely.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "join-best")
    links = check(best, "join-links").unionByName(_same_ids(signed, same))
    joined = components(links)
    rest = settle(_across(likely.select("a", "b").join(best, ["a", "b"], "left_anti"), joined), "join-rest")
    if not rest.isEmpty():
        links = links.unionByName(check(rest, "join-more-links"))
        joined = components(links)

    apart_pairs = settle(_across(proposed.select("a", "b"), joined), "join-apart")
    if not apart_pairs.isEmpty():
        open_sigs = settle(shared.join(_small(apart_pairs.toDF("pivot", "node")), ["pivot", "node"], "left_semi").select("sig").distinct(), "join-open-sigs")
        held = settle(shared.join(_small(open_sigs), "sig", "left_semi"), "join-open")
        members = held.select("sig", "node").unionByName(held.select("sig", F.col("pivot").alias("node"))).distinct()
        open_ = _open(members.join(same.select("node", "n_shingles"), "node"), joined)
        hubs = _hub_pairs(open_)
        pivots = one.join(hubs.groupBy("a").agg(F.count("*").alias("members")), "a")
        hubs = settle(hot_join(hubs.join(two, "b"), pivots, "a", "members", "inner").filter(_may_be_similar("a", "b", percent)).select("a", "b"), "join-hubs")
        if not hubs.isEmpty():
            links = links.unionByName(check(hubs, "join-hub-links"))
            joined = components(links)
            open_ = _open(open_.select("sig", "node", "n_shingles"), joined)
        open_ = settle(open_.join(sketches.drop("size"), "node").withColumnRenamed("sig", "band"), "join-open-signed")
        sides = zip("ab", tiles(open_, percent))
        named = lambda x: [F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("n_shingles").alias(f"size_{x}"), *[F.col(f"s{i}").alias(f"s{x}{i}") for i in range(WORDS_64)]]
        left, right = (side.select("tile", *named(x)) for x, side in sides)
        pairs = left.join(right, "tile").filter((F.col("ca") != F.col("cb")) & _may_be_similar("a", "b", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = settle(pairs.join(proposed.select("a", "b"), ["a", "b"], "left_anti"), "join-last")
        if not pairs.isEmpty():
            joined = components(links.unionByName(check(pairs, "join-last-links")))
    return by_document(signed, same, joined).select("doc_id", "n_shingles", "component_id")


def _texts(source: DataFrame, same: DataFrame, nodes: DataFrame, apart: dict[bytes, int]) -> DataFrame:
    """node, text for the text classes named."""
    wanted = settle(same.select("node", "key").join(nodes, "node", "left_semi"), "join-wanted")
    rows = source.select("key", "text").join(_small(settle(wanted.select("key").distinct(), "join-keys")), "key", "left_semi")
    found = rows.select("text").mapInArrow(_with_node(apart), schema("node long, text string"))
    return settle(found.join(_small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "join-wanted-texts")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: The near-duplicates' SQL with shingles of four words.
SQL = "SELECT doc_id, n_shingles, component_id FROM (" + FIVE_WORDS.replace("len(w) < 5", f"len(w) < {WORDS}").replace("len(w) - 3", "len(w) - 2").replace("i + 4", "i + 3") + ")"
