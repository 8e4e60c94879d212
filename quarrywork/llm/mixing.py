"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words, in proportion to its weight and at most `most` times what it has. Its shuffled
documents queue up, again and again if the target asks for repeats; a document's virtual finish time is the source's
words so far divided by the source's target. All queues are merged in the order of finish times, and the merged sequence
is cut off where the total budget is used up. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut_at, keyed_rows, settle, table, take_rows, up_to

WEIGHTS, MOST = (5, 2, 1), 3
#: Hex digits of the shuffle key that split a source's queue into parts (16 ** 3 of them), so that no task sorts a whole source.
PART_DIGITS = 3
TIES = ["pass", "source_key", "shuffle_key", "doc_id"]


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """source_key, source_size -> the same with target: min(level * weight, most * size), level set so that targets add up to all sizes.

    The level is the largest, over the numbers k of capped sources, of (total - caps of the first k) / weights of the rest, sources
    ordered by cap per weight. One row for each source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy("source_key")) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap, whole = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    leveled = ranked.withColumn("left", left).withColumn("level", F.max("left").over(whole))
    return leveled.select("source_key", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def shuffle_key() -> Column:
    no_id = F.concat_ws(" ", F.lit("row"), F.xxhash64("text").cast("string"), F.monotonically_increasing_id().cast("string"))
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), no_id))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, shuffle: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes (the times the mix takes the document, 0 to `most`) of all rows of docs.

    Null text: size 0. Null source: a source of its own, after all others. Repeated rows count each. No rows: no rows. Other
    columns are ignored. shuffle: a string of hex digits that orders a source's documents, by default of doc_id; rows without one are shuffled by
    their text and place in the files, so that they spread over the parts of the queue however many they are.
    """
    shuffle = shuffle_key() if shuffle is None else shuffle
    key = F.when(F.col("source").isNull(), "b").otherwise(F.concat(F.lit("a"), "source"))
    slim = settle(docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("source_key"), shuffle.alias("shuffle_key")), "mix-sizes")
    slim = slim.withColumn("part", F.substring("shuffle_key", 1, PART_DIGITS))
    parts = slim.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    sources = targets(parts.groupBy("source_key").agg(F.sum("part_size").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).join(sources, "source_key").select("source_key", "part", "before", "source_size", "target")
    queue = Window.partitionBy("source_key", "part").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = settle(
        slim.join(parts, ["source_key", "part"])
        .withColumn("end", F.col("before") + F.sum("size").over(queue))
        .select("doc_id", "size", "source_key", "shuffle_key", "source_size", "target", "end"), "mix-queues")
    times = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.struct(p.alias("pass"), ((p * F.col("source_size") + F.col("end")) / F.col("target")).alias("finish"), (p * F.col("source_size") + F.col("end") - F.col("size")).alias("start")))
    entries = queued.filter("size > 0").select("doc_id", "size", "source_key", "shuffle_key", "target", F.explode(times).alias("t")).filter("t.start < target").select("doc_id", "size", "source_key", "shuffle_key", "t.pass", "t.finish")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    cut = cut_at(entries, "finish", TIES, "size", budget)
    counted = queued
    for p in range(most):
        start = F.lit(p) * F.col("source_size") + F.col("end") - F.col("size")
        counted = counted.withColumn("pass", F.lit(p)).withColumn("finish", (F.lit(p) * F.col("source_size") + F.col("end")) / F.when(F.col("target") > 0, F.col("target"))).withColumn(f"in_{p}", F.coalesce((F.col("size") > 0) & (start < F.col("target")) & up_to(cut, "finish", TIES), F.lit(False)))
    passes = sum((F.col(f"in_{p}").cast("int") for p in range(most)), F.lit(0))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * passes).alias("taken"), passes.alias("passes"))


def apply_mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows themselves, each as often as the mix takes it. Every row counts by itself, whatever its id; rows without one are shuffled by what they hold. No rows: no rows."""
    rows, at = keyed_rows(docs, "mix-rows")
    digits, doc_id = F.lower(F.hex("_hash")), F.col(at["doc_id"])
    shuffle = F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("row "), digits))), digits)
    asked = rows.select(F.col("_row").alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source"), shuffle.alias("_shuffle"))
    taken = mix(asked, weights, most, F.col("_shuffle"))
    copies = take_rows(rows, taken.select(F.col("doc_id").alias("_row"), "passes"), most, "mix-taken")
    return copies.select(*at.values()).toDF(*at)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH slim AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN 'b' ELSE concat('a', source) END AS source_key, md5(CAST(doc_id AS VARCHAR)) AS shuffle_key
  FROM documents),
sources AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source_key),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    row_number() OVER (ORDER BY source_key) AS place, source_size * 3.0::DOUBLE AS cap
  FROM sources),
lefts AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS room
  FROM ranked WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source_key, source_size, least((SELECT max(room) FROM lefts) * weight, cap) AS target FROM lefts),
queued AS (
  SELECT s.*, g.source_size, g.target,
    CAST(sum(size) OVER (PARTITION BY s.source_key ORDER BY shuffle_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM slim s JOIN goals g ON s.source_key = g.source_key),
entries AS (
  SELECT doc_id, size, source_key, shuffle_key, p AS pass, (p * source_size + done) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS p) WHERE size > 0 AND p * source_size + done - size < target),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, pass, source_key, shuffle_key, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM entries),
passes AS (SELECT doc_id, count(*) AS n FROM merged WHERE running <= (SELECT sum(size) FROM slim) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(p.n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN passes p ON p.doc_id = q.doc_id
"""
