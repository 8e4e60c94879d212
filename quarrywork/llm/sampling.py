"""Bounded samples of labelled rows to train on, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, settle


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by: what keeps rows out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def labelled_sample(docs: DataFrame, ids: DataFrame, most: int, seed: int = 17) -> DataFrame:
    """doc_id, label, text of at most `most` documents of each label, those first by a hash of the id.

    ids: doc_id, label; null ones do not count. An id with several labels has its smallest one, an id with several texts its smallest text.
    A label's rows are first thinned by the hash to about twice `most`, so only these are ranked together, however many there are.
    """
    once = settle(ids.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label")), "sample-labels")
    sizes = settle(once.groupBy("label").agg(F.count("*").alias("n")), "sample-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    share = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))).alias("share")
    thin = once.join(sizes, "label").select("doc_id", "label", "n", share).filter(F.col("share") * F.col("n") <= 2 * most + 100)
    place = F.row_number().over(Window.partitionBy("label").orderBy("share", "doc_id"))
    picked = settle(thin.withColumn("place", place).filter(F.col("place") <= most).select("doc_id", "label"), "sample-ids")
    picked = F.broadcast(picked) if picked.count() <= FEW else picked
    return settle(docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
