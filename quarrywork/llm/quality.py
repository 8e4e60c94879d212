"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's log weight is the log ratio of two bags of hashed n-grams: of good labelled documents and of the whole raw corpus. There are two
sets of n-grams, of words and of the shapes of tokens (case, digits, signs, whether a token repeats the one before). Gumbel noise from a hash of
the id is added, and the k largest keys are the sample: drawn without replacement, in proportion to the weights. k is what the labels
say the corpus holds: the number of documents with a log weight above the cut that best parts the labels.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_at, give_back, parts, schema, settle, ship, table, up_to
from .sampling import labelled_sample

#: Labelled documents of each class that the target model and the cut are learned from.
SAMPLE = 4000
WORD_BITS, SHAPE_BITS = 14, 12
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Share of the uniform distribution in each model, so that rare n-grams say little.
SMOOTH = 0.1
#: How much worse it is to reject a good document than to keep a bad one, in setting the cut.
COST = 4.0
TEMPERATURE, SEED = 1.0, 97
KNOWN = 100_000
#: Tokens taken at once, so that memory does not follow the length of a text.
BLOCK = 1 << 18
_TOKEN = re.compile(r"\w+|[^\w\s]")


class Codes(dict):
    """token -> the hash of its lower case and its shape, from 0 to 63, in one number, as bytes."""

    def __missing__(self, token: str) -> bytes:
        if len(self) > KNOWN:
            self.clear()
        if not (token[0].isalnum() or token[0] == "_"):
            shape = 8 + xxhash.xxh32_intdigest(token) % 56
        elif not token.isalpha() and any(map(str.isdigit, token)):
            shape = 4
        else:
            shape = 0 if token.islower() else 1 if len(token) == 1 or token[1:].islower() else 2 if token.isupper() else 3
        self[token] = n = (xxhash.xxh64_intdigest(token.lower()) >> 8 << 6 & (1 << 63) - 1 | shape).to_bytes(8, "little")
        return n


class Tokens(dict):
    """Characters between white space -> the codes of their tokens."""

    def __init__(self):
        self.codes = Codes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > KNOWN:
            self.clear()
        self[chunk] = codes = self.codes[chunk] if chunk.isalpha() else b"".join([self.codes[t] for t in _TOKEN.findall(chunk)])
        return codes

    def forget(self) -> None:
        """At the end of a task: the worker lives on and keeps no memory of it."""
        self.codes.clear(), self.clear()
        give_back()


def ngrams(text: str | None, known: Tokens) -> np.ndarray:
    """The bucket of every n-gram. A block sees the three tokens before it, and gives the n-grams that end inside it."""
    found = []
    tokens = np.frombuffer(b"".join([known[c] for c in (text or "").split()]), np.uint64)
    for at in range(0, len(tokens), BLOCK):
        lead = min(at, 3)
        x = tokens[at - lead : at + BLOCK]
        words, shapes = x >> np.uint64(6), (x & np.uint64(63)) << np.uint64(1)
        pairs = (words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)
        found += [words[lead:] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS), pairs[max(0, lead - 1) :]]
        shapes[1:] |= words[1:] == words[:-1]
        for n in (1, 2, 3):
            h = np.full(max(0, len(shapes) - n + 1), n, np.uint64)
            for i in range(n):
                h = h * np.uint64(131) + shapes[i : len(shapes) - n + 1 + i]
            buckets = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SHAPE_BITS)) + np.uint64(1 << WORD_BITS)
            found.append(buckets[max(0, lead - n + 1) :])
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def count_ngrams(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: every task sums its own, Spark sums theirs, SIZE numbers reach the driver."""
    ship(docs.sparkSession)

    def run(batches):
        total, known = np.zeros(SIZE, np.int64), Tokens()
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                total += np.bincount(ngrams(text, known), minlength=SIZE)
        known.forget()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE)), pa.array(total)], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, schema("bucket long, n long")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def log_shares(counts: np.ndarray) -> np.ndarray:
    parts = np.split(counts, [1 << WORD_BITS])
    return np.concatenate([np.log((1 - SMOOTH) * p / max(1.0, p.sum()) + SMOOTH / len(p)) for p in parts])


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least cost; halfway between the two weights around it."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    cost = COST * np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]])
    i = int(np.argmin(cost))
    return float(w[0] - 1 if i == 0 else w[-1] + 1 if i == len(w) else (w[i - 1] + w[i]) / 2)


def _weigh(ratios, at: int):
    """Adds the log weight of the text in column `at`."""

    def run(batches):
        known = Tokens()
        for batch in parts(batches):
            weights = [float(ratios.value[ngrams(t, known)].sum()) for t in batch.column(at).to_pylist()]
            yield batch.append_column("weight", pa.array(weights, pa.float64()))
        known.forget()

    return run


def weigh(docs: DataFrame, ratios, *columns: str) -> DataFrame:
    """The given columns and log_weight, the log weight of text; texts stay where they are."""
    ship(docs.sparkSession)
    plain = docs.select(*columns, "text").toDF(*[f"c{i}" for i in range(len(columns) + 1)])  # no name of the caller's can clash
    weighed = plain.mapInArrow(_weigh(ratios, len(columns)), T.StructType([*plain.schema.fields, T.StructField("weight", T.DoubleType())]))
    return weighed.drop(plain.columns[-1]).toDF(*columns, "log_weight")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


class Sampler:
    """What resampling has learned from docs(doc_id, text) and labels(doc_id, label 1 or 0): the log ratios, k, and where the keys are cut.

    Null and empty texts have a log weight of 0. Rows that repeat an id and a text have one key and are selected together or not at all; rows of one id with
    different texts count each, and so do rows without an id, whose noise comes from a null. Without labels of both kinds, or without documents, every
    document is selected.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
        spark = docs.sparkSession
        sample = labelled_sample(docs, labels, most)
        ratios = log_shares(count_ngrams(sample.filter("label = 1"))) - log_shares(count_ngrams(docs))
        self.ratios = spark.sparkContext.broadcast(ratios)
        rows = weigh(sample, self.ratios, "label").collect()
        weights, good = np.array([r["log_weight"] for r in rows]), np.array([r["label"] == 1 for r in rows], bool)
        self.all = len(set(good.tolist())) < 2
        self.threshold = 0.0 if self.all else best_cut(weights, good)
        self.docs, self._keys = docs, None

    @property
    def keys(self) -> DataFrame:
        """doc_id, log_weight, key, order of every document, written once; with k and the cut."""
        if self._keys is None:
            self._cut(settle(self._keyed(weigh(self.docs, self.ratios, "doc_id")), "quality-keys"))
        return self._keys

    def _keyed(self, weighed: DataFrame) -> DataFrame:
        keyed = weighed.withColumn("key", F.col("log_weight") + TEMPERATURE * gumbel(F.col("doc_id")))
        return keyed.withColumn("order", -F.col("key"))

    def _cut(self, keys: DataFrame) -> None:
        self._keys, self.k = keys, keys.filter(F.col("log_weight") >= self.threshold).count()
        self.cut = cut_at(keys.select("order", "doc_id", F.lit(1).alias("one")), "order", ["doc_id"], "one", self.k)

    def selected(self) -> Column:
        return F.lit(True) if self.all else F.coalesce(up_to(self.cut, "order", ["doc_id"]), F.lit(False))

    def scores(self) -> DataFrame:
        """doc_id, log_weight, key, kept (whether it is in the sample) of every document."""
        return self.keys.withColumn("kept", self.selected()).drop("order")

    def kept_rows(self) -> DataFrame:
        """The selected rows of docs with all their columns. The rows are written with their weights once, so no text is shuffled, or tokenized again."""
        columns = self.docs.columns
        rows = self.docs.toDF(*[f"c{i}" for i in range(len(columns))])
        at = {c: f"c{i}" for i, c in enumerate(columns)}
        ship(rows.sparkSession)
        weighed = rows.mapInArrow(_weigh(self.ratios, columns.index("text")), T.StructType([*rows.schema.fields, T.StructField("weight", T.DoubleType())]))
        held = settle(weighed, "quality-rows")
        keyed = self._keyed(held.withColumns({"doc_id": F.col(at["doc_id"]), "log_weight": F.col("weight")}))
        self._cut(keyed.select("doc_id", "log_weight", "key", "order"))
        return keyed.filter(self.selected()).select(*rows.columns).toDF(*columns)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sampler(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_labels(spark, sf_dir)).scores()
