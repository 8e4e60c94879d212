"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's score is logistic in the features of its words (the word, its beginnings, its letter groups); a document is toxic if any
sentence is: 1 - product(1 - p). Only the documents of a bounded sample are labelled for training; the sentences' own scores
then say where a document offends.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, schema, ship, table
from .sampling import labelled_sample, remainder

#: Labelled documents of each class to train on, whole.
SAMPLE = 4000
BITS, PREFIXES = 18, (3, 4, 5, 6)
#: Words of a sentence at most; longer runs without a stop are read in parts of this length.
PART = 48
ROUNDS, RATE = 80, 0.1
#: A feature takes part if its share of toxic documents is significantly above that of others: chi-square, and log ratio.
CHI, RATIO = 15.0, 2.0
KNOWN = 500_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
#: Where training starts a sentence's score.
BIAS = -10.0


def features(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [xxhash.xxh32_intdigest(f"{len(p)}^{p}" if i else f"={p}") & mask for i, p in enumerate((word, *(word[:n] for n in PREFIXES if len(word) >= n)))]


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) in order; white space around is not cut off."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        words = list(_WORD.finditer(m[0].lower())) if m[0].isascii() else list(_WORD.finditer(m[0]))
        for i in range(0, len(words), PART):
            part = words[i : i + PART]
            found.append((m.start() + part[0].start(), m.start() + part[-1].end(), [w[0].lower() for w in part]))
    return found


class Known(dict):
    """word -> its features."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > KNOWN // 10:
            self.clear()
        self[word] = found = features(word)
        return found


class Weights(dict):
    """word -> the sum of its features' weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > KNOWN:
            self.clear()
        self[word] = w = float(sum(self.weights[f] for f in features(word)))
        return w


def noisy_or(scores: list[float]) -> float:
    """1 - product(1 - p), with p = logistic(score)."""
    return -math.expm1(-sum(s + math.log1p(math.exp(-s)) if s > 0 else math.log1p(math.exp(s)) for s in scores))


def _counted(batches):
    """label, text -> for each feature, in how many texts of each label it occurs; every task sums its own."""
    counts, known = np.zeros((2, 1 << BITS), np.int64), Known()
    for batch in parts(batches):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for _, _, part in sentences(text) for w in part}
            counts[label, np.unique(np.array([f for w in words for f in known[w]], np.int64))] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["feature", "zero", "one"])


def _bags(chosen):
    """doc_id, label, text -> the chosen features of every sentence that has any, one after the other, where each sentence ends, and how many have none."""

    def run(batches):
        known, of = Known(), chosen.value
        for batch in parts(batches):
            rows = []
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                index, ends, plain = [], [], 0
                for _, _, words in sentences(text) or [(0, 0, [])]:
                    before = len(index)
                    index.extend(f for w in words for f in known[w] if f in of)
                    if len(index) > before:
                        ends.append(len(index))
                    else:
                        plain += 1
                rows.append((label, index, ends, plain))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
            columns = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "label", "index", "ends", "plain"])

    return run


def choose(zero: np.ndarray, one: np.ndarray, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features are significantly more frequent in toxic documents, and the log ratio of every feature."""
    ratio = np.log((one + 0.5) / (n1 + 1)) - np.log((zero + 0.5) / (n0 + 1))
    share = (one + zero) / (n1 + n0)
    chi = (one / n1 - zero / n0) ** 2 / np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12)
    return (ratio > RATIO) & (chi > CHI), ratio


def train(y: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], plain: np.ndarray, start: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the documents' likelihood under noisy-or, by full-batch Adam.

    bags: features and sentence ends of each document; plain: its sentences without features, whose score is the bias. Features that are
    not used stay at 0, the others begin at `start`.
    """
    x = np.concatenate([b[0] for b in bags]).astype(np.int32)
    counts = np.concatenate([np.diff(b[1], prepend=0) for b in bags]).astype(np.int64)
    of_sentence, of_doc = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    w, b, m, v = np.where(used, start, 0.0), BIAS, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    for t in range(1, ROUNDS + 1):
        s = np.bincount(of_sentence, w[x], len(counts)) + b
        p, p0 = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(-b))
        a = np.bincount(of_doc, np.logaddexp(0, s), len(y)) + plain * np.logaddexp(0, b)
        d = np.where(y, -np.exp(-a) / np.maximum(-np.expm1(-a), 1e-9), 1.0) * weight
        ds = d[of_doc] * p
        g = np.append(np.where(used, np.bincount(x, ds[of_sentence], 1 << BITS), 0.0), ds.sum() + (d * plain).sum() * p0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, b = w - step[:-1], b - step[-1]
    return w.astype(np.float32), float(b)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """docs(doc_id, text), labels(doc_id, label 0 or 1). Without labels of both kinds every document scores near 0.

    At most `most` documents of each label are learned from, whole. Texts are read by tasks; what reaches the driver are counts of features and the chosen
    features of each sampled document.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = labelled_sample(docs, labels.select("doc_id", F.col("label").cast("long").alias("label")), most)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not (n0 := sizes.get(0)) or not (n1 := sizes.get(1)):
        return np.zeros(1 << BITS, np.float32), BIAS
    found = sample.select("label", "text").mapInArrow(_counted, schema("feature long, zero long, one long")).groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    zero, one = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = found["feature"].to_numpy()
    zero[at], one[at] = found["zero"].to_numpy(), found["one"].to_numpy()
    used, ratio = choose(zero, one, n0, n1)
    chosen = spark.sparkContext.broadcast(frozenset(np.flatnonzero(used).tolist()))
    rows = sample.select("doc_id", "label", "text").mapInArrow(_bags(chosen), schema("doc_id long, label long, index array<int>, ends array<int>, plain long")).orderBy("doc_id").toArrow()
    bags = [(np.array(i, np.int32), np.array(e, np.int64)) for i, e in zip(rows["index"].to_pylist(), rows["ends"].to_pylist())]
    return train(rows["label"].to_numpy() == 1, bags, rows["plain"].to_numpy(), ratio, used)


def score(docs: DataFrame, model: tuple[np.ndarray, float], locate: float = 0.5) -> DataFrame:
    """doc_id, score, offending (start, end, score of each sentence with a score of `locate` or more) for every row.

    Null and empty texts, and those without a word, have one sentence without words. Other columns are ignored.
    """
    ship(docs.sparkSession)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    known: dict[int, Weights] = {}

    def run(batches):
        of = known.setdefault(0, Weights(weights.value))
        for batch in parts(batches):
            scores, spots = [], []
            for text in batch.column(1).to_pylist():
                found = [(s, e, bias + sum(map(of.__getitem__, words))) for s, e, words in sentences(text)]
                scores.append(noisy_or([x[2] for x in found] or [bias]))
                spots.append([{"start": s, "end": e, "score": p} for s, e, x in found if (p := noisy_or([x])) >= locate])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spots, kind)], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema("doc_id long, score double, offending array<struct<start: long, end: long, score: double>>"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offending: the sentences that score one half or more, as start:end:score, comma-joined; code points, end exclusive."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learn = labels.filter((remainder(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    scored = score(docs, fit(docs, learn))
    spots = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"], F.round(s["score"], 4))), ",")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spots.alias("offending"))
