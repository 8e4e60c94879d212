"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, schema, ship, table
from .sampling import labelled_sample, remainder

#: Families of closely related languages; any other code is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "hi", "mr", "ne", "pa", "ur"),
}
#: Documents of each language to train on, whole.
SAMPLE = 1500
BITS = 13
SIZE = 1 << BITS
EPOCHS, REGULAR = 12, 1e-4
UNKNOWN = "und"
#: Characters taken at once, so that memory does not follow the length of a text.
BLOCK = 1 << 20


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def vector(text: str) -> np.ndarray:
    """Counts of hashed letter groups of one to three, lower case, everything that is no letter as one space; of unit length.

    A block sees the two letters before it and counts the groups that end inside it.
    """
    counts, text = np.zeros(SIZE), text.lower()
    for at in range(0, len(text), BLOCK):
        lead = min(at, 2)
        block = text[at - lead : at + BLOCK]
        c = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        plain = ((c < 97) | ((c > 122) & (c < 0xAA)) | (c == 0xD7) | (c == 0xF7) | ((c >= 0x2000) & (c < 0x2C00)) | ((c >= 0x3000) & (c < 0x3040))).astype(bool)
        c[plain] = 32
        one, two = c * np.uint64(0x9E3779B97F4A7C15), None
        hashes = [one]
        if len(c) > 1:
            two = (one[:-1] ^ (c[1:] + np.uint64(0x1F))) * np.uint64(0xC2B2AE3D27D4EB4F)
            hashes.append(two)
        if len(c) > 2:
            hashes.append((two[:-1] ^ (c[2:] + np.uint64(0x2F))) * np.uint64(0x165667B19E3779F9))
        for n, h in enumerate(hashes):
            counts += np.bincount((h[max(0, lead - n) :] >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    counts = np.sqrt(counts)
    return counts / (np.linalg.norm(counts) or 1.0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(starts: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear support vector machine (y in -1, 1) by averaged sub-gradient steps in a fixed order; the last weight is the bias.

    Row i has value[k] at index[k] for k from starts[i] to starts[i + 1]; nothing is ever as wide as all features times all rows.
    """
    n = len(y)
    w, total, t, taken = np.zeros(SIZE + 1), np.zeros(SIZE + 1), 0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // 32)):
            t += 1
            rate = 1 / (REGULAR * (t + 1000))
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
            row = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            margin = np.bincount(row, w[index[at]] * value[at], len(part)) + w[-1]
            push = weight[part] * y[part] * (y[part] * margin < 1)
            step = np.append(np.bincount(index[at], push[row] * value[at], SIZE), push.sum())
            w = (1 - rate * REGULAR) * w + rate / len(part) * step * 0.1
            if epoch >= EPOCHS // 2:
                total += w
                taken += 1
    return total / max(1, taken)


def _features(batches):
    """doc_id, label, text -> label and the sparse vector of every whole text that has a letter."""
    for batch in parts(batches):
        labels, indexes, values = [], [], []
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if has_letter(text):
                v = vector(text)
                used = np.flatnonzero(v)
                labels.append(label), indexes.append(used.astype(np.int32)), values.append(v[used].astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(indexes, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["label", "index", "value"])


def _machine(rows: pa.Table) -> pa.Table:
    """The rows of one machine -> its weights."""
    rows = rows.sort_by([("label", "ascending"), ("order", "ascending")]).combine_chunks()
    flat = [rows[c].combine_chunks() for c in ("index", "value")]
    index, value = (x.flatten().to_numpy() for x in flat)
    starts = np.concatenate([[0], np.cumsum(flat[0].value_lengths().to_numpy())])
    w = svm(starts, index, value, rows["y"].to_numpy())
    return pa.table([rows["one"].slice(0, 1), rows["other"].slice(0, 1), pa.array([w.tolist()], pa.list_(pa.float64()))], ["one", "other", "weights"])


def machines(vectors: DataFrame, langs: list[str]) -> dict[tuple[str, str], np.ndarray]:
    """(family, "") and (language, language) -> weights. Each machine is one group of a bounded number of rows; only weights reach the driver."""
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family(lang), []).append(lang)
    mark = lambda a, b, y: F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), F.lit(float(y)).alias("y"))
    tasks: Column = F.array().cast("array<struct<one: string, other: string, y: double>>")
    for lang in langs:
        own = [mark(f, "", 1 if f == family(lang) else -1) for f in sorted(groups)] if len(groups) > 1 else []
        own += [mark(a, b, 1 if a == lang else -1) for a, b in combinations(groups[family(lang)], 2) if lang in (a, b)]
        if own:
            tasks = F.when(F.col("label") == lang, F.array(*own)).otherwise(tasks)
    dealt = vectors.select("label", "index", "value", F.xxhash64("index", "value").alias("order"), F.explode(tasks).alias("m")).select("label", "order", "index", "value", "m.one", "m.other", "m.y")
    trained = dealt.groupBy("one", "other").applyInArrow(_machine, schema("one string, other string, weights array<double>"))
    return {(r["one"], r["other"]): np.array(r["weights"]) for r in trained.collect()}


def predict(model: dict, text: str | None) -> tuple[str, float]:
    """(language, how sure from 0 to 1). Without a letter, or with no language learned: und, 0."""
    if not model["names"] or not has_letter(text):
        return UNKNOWN, 0.0
    v = np.append(vector(text), 1.0)
    best, margins = model["names"][0], [2.0]
    if model["first"]:
        scores = [float(model["first"][f] @ v) for f in model["names"]]
        best = model["names"][int(np.argmax(scores))]
        ordered = sorted(scores)
        margins = [ordered[-1] - ordered[-2]]
    langs = model["groups"][best]
    wins = dict.fromkeys(langs, (0, 0.0))
    for a, b in combinations(langs, 2):
        s = float(model["pairs"][a, b] @ v)
        for lang, m in ((a, s), (b, -s)):
            wins[lang] = (wins[lang][0] + (m > 0), wins[lang][1] + m)
    lang = max(langs, key=lambda x: (wins[x], x))
    if len(langs) > 1:
        margins.append(wins[lang][1] / (len(langs) - 1))
    return lang, float(np.prod([1 / (1 + np.exp(-2 * m)) for m in margins]))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """docs(doc_id, text), labels(doc_id, label: a language). Learns from at most `most` documents of each language, from their whole texts; those without a letter teach nothing.

    No labels: a model that knows no language. Languages are few: their names are collected.
    """
    ship(docs.sparkSession)
    vectors = labelled_sample(docs, labels, most).select("doc_id", "label", "text").mapInArrow(_features, schema("label string, index array<int>, value array<float>"))
    langs = sorted(r[0] for r in vectors.select("label").distinct().collect())
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family(lang), []).append(lang)
    trained = machines(vectors, langs) if len(langs) > 1 else {}
    return {
        "groups": groups, "names": sorted(groups), "first": {a: w for (a, b), w in trained.items() if not b}, "pairs": {k: w for k, w in trained.items() if k[1]},
    }


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text).

    Null and empty texts and those without a letter: und with score 0. Repeated rows and null ids: a row each. No rows: no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches):
            found = [predict(shared.value, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema("doc_id long, lang_pred string, score double"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.filter((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    found = identify(docs, fit(docs, learn))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
