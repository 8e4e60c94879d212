"""MinHash near-duplicate detection: banded signatures propose pairs, full shingle sets confirm them, star steps join them.

Documents with the same words are one node from the start. In each band's bucket the smallest node is compared with all others
first, which joins most groups with as many comparisons as members. Only buckets that still hold several components then give
pairs across components, and only those whose longer signatures do not rule out the threshold. So a group of thousands of copies
that are near their pivot costs its size, not the square of it, and no pair in a bucket is left out. A bucket that stays open is cut
by set size, as only sets of nearly the same size can be similar enough, and then in tiles of bounded size, so that no task holds more than a tile.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Steps
from .common import hot_join, keyed_rows, parts, schema, settle, ship, table, take_rows
from .components import components

#: PERCENT is the contract of op4; the pipeline, which has none, links from PIPELINE_PERCENT.
WORDS, PERCENT, PIPELINE_PERCENT = 5, 85, 80
#: A pair at the threshold shares no band with at most this probability.
MISS = 3.1e-6
SKETCH, BITS = 1024, 4
WIDE = SKETCH // 64
#: Members compared with one copy of their pivot's set by one task.
GROUP = 64
#: Members on each side of a tile of an open bucket.
TILE = 512
_SEEDS = np.random.default_rng(20240229)
_A = (_SEEDS.integers(0, 1 << 31, SKETCH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _SEEDS.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_MIX = _SEEDS.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _SEEDS.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _SEEDS.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


class Plan(NamedTuple):
    """What the threshold asks for: bands of so many rows, and how many of SKETCH minima cut to BITS bits have to agree."""

    percent: int
    bands: int
    rows: int
    agree: int


def plan_of(percent: int) -> Plan:
    """At 85, 40 bands of 8 and 813 minima; at 80, 54 bands of 7 and 757. The minima are 6 standard deviations below the average at the threshold."""
    if not 60 <= percent <= 99:
        raise ValueError(f"a threshold of {percent} percent is outside 60 to 99")
    s = percent / 100
    rows = 8 if percent >= 85 else 7 if percent >= 80 else 5
    share = s + (1 - s) / (1 << BITS)
    return Plan(percent, math.ceil(math.log(MISS) / math.log(1 - s**rows)), rows, math.floor(SKETCH * share - 6 * math.sqrt(SKETCH * share * (1 - share))))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _keyed(batches):
    for batch in parts(batches):
        keys = [words_key(words_of(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["key", "text", "words_key"])


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words, up to five; of fewer words, one hash of all."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    s = h[:n] * _PLACE[0]
    for i in range(1, size):
        s += h[i : i + n] * _PLACE[i]
    s ^= s >> np.uint64(29)
    return np.unique(s * np.uint64(0xBF58476D1CE4E5B9))


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n universal hash functions (a * x + b) mod 2**32 its minimum over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(found, (_A[:n, None] * x[None, i : i + 512] + _B[:n, None]).min(axis=1), out=found)
    return found


def _signatures(plan: Plan):
    def run(batches):
        for batch in parts(batches):
            sizes, keys, bands = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                s = shingles(words)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), bands.append([])
                    continue
                keys.append(words_key(words))
                m = minima(s, plan.bands * plan.rows)
                b = (m.reshape(plan.bands, plan.rows).astype(np.uint64) * _MIX[: plan.rows]).sum(axis=1, dtype=np.uint64) ^ _BAND[: plan.bands]
                bands.append((b ^ (b >> np.uint64(31))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["key", "doc_id", "n_shingles", "words_key", "bands"])

    return run


def _names(side: str) -> list[str]:
    return [f"{side}{i}" for i in range(BITS * WIDE)]


def _sketches(batches):
    """BITS planes of SKETCH bits each: the low bits of a mix of every minimum."""
    for batch in parts(batches):
        out = []
        for text in batch.column(1).to_pylist():
            m = minima(shingles(words_of(text)), SKETCH) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            out.append(np.packbits(np.array([m >> np.uint32(i) & np.uint32(1) for i in range(BITS)], np.uint8), axis=1).ravel().view(np.int64))
        columns = np.array(out, np.int64).reshape(-1, BITS * WIDE).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["node", *_names("s")])


def _verify(percent: int, size: int):
    """Rows (pivot, part, is_member, node, text) in order, each pivot's own row first -> pairs that are similar enough."""

    def run(batches):
        at, base = None, None
        for batch in parts(batches):
            a, b = [], []
            for pivot, part, member, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(words_of(text), size)
                if not member:
                    at, base = (pivot, part), s
                    continue
                if (pivot, part) != at:
                    raise ValueError(f"node {pivot} has no text here")
                both = len(np.intersect1d(base, s, assume_unique=True))
                if both and 100 * both >= percent * (len(base) + len(s) - both):
                    a.append(pivot), b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, percent: int, size: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the similarity asked for. texts: node, text, one row for each node.

    A pivot's text goes once to each group of GROUP members, so that a pivot with many members is spread over many tasks.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    split = hot_join(pairs, counts.withColumn("n", F.col("parts").cast("long") * GROUP), "a", "n", "inner").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = split.join(texts, F.col("b") == F.col("node")).select("a", "part", F.lit(True).alias("member"), "node", "text")
    pivots = counts.join(texts, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), "node", "text")
    both = pivots.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "member", "node")
    return both.mapInArrow(_verify(percent, size), schema("a long, b long"))


def _agreeing(one: str, two: str) -> Column:
    """How many minima agree in all their bits. Sketches are columns of longs: that compiles to short code."""
    differ = lambda i: reduce(Column.bitwiseOR, (F.col(f"{one}{p * WIDE + i}").bitwiseXOR(F.col(f"{two}{p * WIDE + i}")) for p in range(BITS)))
    return SKETCH - reduce(Column.__add__, (F.bit_count(differ(i)) for i in range(WIDE)))


def tiles(members: DataFrame, percent: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """members (band, node, n_shingles, minor, ...) -> (left, right), each with a tile; every minor member of a bucket meets every member that can be similar enough in one tile.

    Minor members are those outside the bucket's largest component: of two members of different components one is minor. A bucket's members are classed by
    the logarithm of their set size, so that those of a similarity of `percent` are in the same or the next class, and a class is cut in parts of about `tile`
    members on each side. A tile is a part of minor members and a part of all; members of classes without minor ones near them are in none.
    """
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(percent / 100) * (1 + 1e-9))).cast("int")
    placed = members.withColumn("level", level)
    part_count = lambda n: F.ceil(n / tile).cast("int")
    sizes = placed.groupBy("band", "level").agg(F.count("*").alias("n"), part_count(F.count_if("minor")).alias("l0"), part_count(F.count("*")).alias("r0"))
    for step, name in ((-1, "below"), (1, "above")):
        near = sizes.select("band", (F.col("level") - step).alias("level"), F.col("l0").alias(f"l_{name}"), F.col("r0").alias(f"r_{name}"))
        sizes = sizes.select("band", "level", *[c for c in sizes.columns if c not in ("band", "level")]).join(near, ["band", "level"], "left")
    sizes = settle(sizes.fillna(0), "dup-classes-of-sizes")
    cell = F.struct("band", "level")
    counts = ["l0", "l_below", "l_above", "r0", "r_below", "r_above"]
    placed = hot_join(placed.withColumn("cell", cell).drop("band", "level"), sizes.select(cell.alias("cell"), *counts, "n"), "cell", "n", "inner")
    level = F.col("cell.level")
    at = lambda low, i, high, j: F.struct(F.col("cell.band").alias("band"), low.alias("left_level"), i.alias("left_part"), high.alias("right_level"), j.alias("right_part"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda n: F.pmod(F.xxhash64(F.lit(1), "node"), F.greatest(F.lit(1), n)).cast("int")
    steps = (("below", -1), ("0", 0), ("above", 1))
    name = lambda side, n: F.col(f"{side}0" if n == "0" else f"{side}_{n}")
    to_right = lambda d: lambda j: at(level, own(F.col("l0")), level + d, j)
    to_left = lambda d: lambda i: at(level + d, i, level, own(F.col("r0")))
    left = F.concat(*[F.transform(upto(name("r", n)), to_right(d)) for n, d in steps])
    right = F.concat(*[F.transform(upto(name("l", n)), to_left(d)) for n, d in steps])
    rest = [F.col("cell.band").alias("band"), *[c for c in members.columns if c != "band"]]
    return placed.filter("minor").select(F.explode(left).alias("tile"), *rest), placed.select(F.explode(right).alias("tile"), *rest)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); two texts are linked from a similarity of `percent` on.

    Null, empty and blank texts have no shingles and stand alone. Rows of one id are one document: its texts are linked, as are those of all rows with the
    same words. A row without an id can link others; its component_id is the smallest id it reaches, null if there is none, and it is not kept. No rows: no
    rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    plan = plan_of(percent)
    # what finds a row's text again: its id, or a hash of the text where it has none
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    signed = source.select("key", "doc_id", "text").mapInArrow(_signatures(plan), schema("key long, doc_id long, n_shingles long, words_key binary, bands array<long>"))
    signed = settle(signed.withColumn("row", F.monotonically_increasing_id()), "dup-signatures")
    # a node is a text class; its number is that of its first row
    same = settle(signed.filter("words_key IS NOT NULL").groupBy("words_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "dup-copies")
    nodes = signed.join(same.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "key", "words_key", "n_shingles", "bands")
    bands = Steps(docs.sparkSession)
    try:
        with bands:
            buckets = settle(nodes.select("node", F.explode("bands").alias("band")), "dup-bands")
            groups = settle(buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n")).filter("pivot < last").drop("last"), "dup-groups")
        shared = settle(hot_join(buckets, groups, "band", "n", "inner", written=True), "dup-buckets")
    finally:
        bands.close()
    wanted = settle(nodes.select("node", "key", "words_key").join(shared.select("node").distinct(), "node", "left_semi"), "dup-wanted")
    texts = source.select("key", "text").join(wanted.select("key").distinct(), "key", "left_semi").mapInArrow(_keyed, schema("key long, text string, words_key binary"))
    texts = settle(texts.join(wanted, ["key", "words_key"]).select("node", "text").dropDuplicates(["node"]), "dup-texts")
    sketches = settle(texts.mapInArrow(_sketches, schema("node long, " + ", ".join(f"{x} long" for x in _names("s")))), "dup-sketches")
    one, two = sketches.toDF("a", *_names("sa")), sketches.toDF("b", *_names("sb"))

    proposed = settle(shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "dup-proposed")
    pivots = one.join(proposed.groupBy("a").agg(F.count("*").alias("n")), "a")
    first = settle(hot_join(proposed.join(two, "b"), pivots, "a", "n", "inner").filter(_agreeing("sa", "sb") >= plan.agree).select("a", "b"), "dup-pairs")
    links = settle(verify(first, texts, percent).unionByName(_same_ids(signed, same)), "dup-all-links")
    joined = components(links)

    members = shared.select("band", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = settle(members, "dup-members")
    held = members.groupBy("band", "component").agg(F.count("*").alias("held"))
    mixed = held.groupBy("band").agg(F.max_by("component", F.struct("held", "component")).alias("major"), F.count("*").alias("components"), F.sum("held").alias("n")).filter("components > 1").select("band", "major", "n")
    open_ = settle(hot_join(members, mixed, "band", "n", "inner"), "dup-open")
    all_bands = nodes.select("node", "n_shingles", "bands").join(open_.select("node").distinct(), "node", "left_semi")
    open_ = settle(open_.join(all_bands.join(sketches, "node"), "node").withColumn("minor", F.col("component") != F.col("major")).drop("major"), "dup-open-signed")
    sides = zip("ab", tiles(open_, percent))
    left, right = (side.select("tile", "band", F.col("minor").alias(f"minor_{x}"), F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("bands").alias(f"bands_{x}"), *[F.col(f"s{i}").alias(f"s{x}{i}") for i in range(BITS * WIDE)]) for x, side in sides)
    # a pair comes from the first band that its nodes share, and from no other; two minor members, which meet twice, from one of their two orders
    once = (F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("band")) & (~F.col("minor_b") | (F.col("a") < F.col("b")))
    across = left.drop("minor_a").join(right.drop("band"), "tile").filter((F.col("ca") != F.col("cb")) & (_agreeing("sa", "sb") >= plan.agree) & once)
    rest = settle(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(first, ["a", "b"], "left_anti"), "dup-rest")
    more = settle(verify(rest, texts, percent), "dup-more-links")
    joined = components(links.unionByName(more)) if not more.isEmpty() else joined

    return by_document(signed, same, joined)


def by_document(signed: DataFrame, same: DataFrame, joined: DataFrame) -> DataFrame:
    """The component of each document: signed has its rows, same the text classes with their smallest ids, joined the components of classes."""
    classes = settle(same.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "dup-classes")
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    classes = hot_join(classes, least, "component", "n", "inner").select("words_key", "component_id", "copies")
    found = hot_join(signed.select("doc_id", "n_shingles", "words_key"), classes, "words_key", "copies")
    component = F.when(F.col("words_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _same_ids(signed: DataFrame, same: DataFrame) -> DataFrame:
    """Links between the texts of ids that stand under several ones: each with the smallest. Most tables have no such id."""
    several = signed.filter("words_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    rows = signed.filter("words_key IS NOT NULL").select("doc_id", "words_key").join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    held = settle(rows.join(same.select("words_key", "node"), "words_key").select("doc_id", "node"), "dup-same-ids")
    least = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return hot_join(held, least, "doc_id", "n", "inner").filter("node <> a").select("a", F.col("node").alias("b"))


def drop_near_duplicates(docs: DataFrame, percent: int = PIPELINE_PERCENT) -> DataFrame:
    """One row of each component: the one with the smallest id, rows without an id last. Every row counts by itself, whatever its id; of equal rows one stays."""
    rows, at = keyed_rows(docs, "dup-rows")
    work = Steps(docs.sparkSession)
    try:
        with work:
            found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col(at["text"]).alias("text")), percent).select(F.col("doc_id").alias("_row"), "component_id")
        doc_id = F.col(at["doc_id"])
        ranks = rows.select("_row", F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), "_hash", "_row").alias("rank"))
        kept = found.join(ranks, "_row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank._row", F.lit(1).alias("passes"))
        one = take_rows(rows, kept, 1, "dup-kept")
    finally:
        work.close()
    return one.select(*at.values()).toDF(*at)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words),
flat AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM shingled),
sizes AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM shingled),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n_shingles, y.n_shingles
  HAVING 100 * count(*) >= 85 * (x.n_shingles + y.n_shingles - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, any_value(n_shingles) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""
