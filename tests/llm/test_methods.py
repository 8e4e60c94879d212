"""The methods against direct computations, hot groups, repeated ids and clashing names."""

import hashlib
import math
import os
import random
import re
import threading
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarrywork import shared
from quarrywork.llm import common, language, media, mixing, near_dup, packing, pii, quality, sampling, toxicity

SMALL = "/root/testdata/sf0.001"
CLASH = {"passes": 9, "log_weight": "w", "key": "k", "order": 1, "_copy": 2, "_row": "r", "_hash": 3, "cell": 4, "nr": 5}


def clashing(df, names=tuple(CLASH)):
    return df.withColumns({k: F.lit(CLASH[k]) for k in names})


# --- media ---


def slow_fingerprint(payload):
    """Peaks by a discrete Fourier transform written out."""
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    n = max(1, math.ceil((len(x) - 256) / 128) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * 128 + 256 - len(x))])
    window, t = np.hanning(256), np.arange(256)
    power = np.array([[abs((x[i * 128 : i * 128 + 256] * window * np.exp(-2j * np.pi * k * t / 256)).sum()) for k in range(129)] for i in range(n)])
    peaks = []
    for i in range(n):
        for low, high in media.BANDS:
            own = power[i, low:high].max()
            if own > 1e-3 and all(own >= power[j, low:high].max() - 1e-4 for j in range(max(0, i - 2), min(n, i + 3))):
                peaks.append((i, low + int(power[i, low:high].argmax())))
    return sorted((a << 24) | (f << 16) | (g << 8) | (b - a) for p, (a, f) in enumerate(peaks) for b, g in peaks[p + 1 : p + 4] if b - a <= 63)


def test_media_query_by_hand(spark):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SMALL, "documents").collect()}
    for r in media.op1_media(spark, SMALL).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        wav = media.to_wav(payload)
        assert wav.endswith(payload) and (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature.startswith(f"{len(r.fingerprint)}:")
        if len(payload) < 3000:
            slow, own = set(slow_fingerprint(payload)), set(r.fingerprint)
            assert len(slow & own) >= 0.98 * max(len(slow), len(own))  # single precision decides near ties


# --- personal data ---


def test_many_spans_take_time_in_proportion():
    text = "mail a.b@c.org now; account 123-45-6789 ssn; 10.20.30.40 x " * 18_000
    began = time.process_time()
    found = pii.find_spans(text)
    assert len(text) > 1_000_000 and len(found) >= 3 * 18_000 and time.process_time() - began < 8
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 2


def test_secrets_need_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" x') == ["secret"] and kinds("hash 9b0b3c6a43eb78aa99cbd7049c572391524f37a8") == []
    assert kinds("key aaaaaaaaaaaaaaaaaaaaaaaaaaaa") == [] and kinds("key internationalization2024forever") == []


# --- toxicity ---


def test_noisy_or_and_choice_by_hand():
    for scores in ([-3.0, 0.0, 2.0], [-50.0], [40.0, -1.0]):
        assert toxicity.noisy_or(scores) == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-s)) for s in scores))
    zero, one = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    zero[:3], one[:3] = (50, 1, 0), (55, 30, 1)
    used, ratio = toxicity.choose(zero, one, 100, 100)
    assert used[:3].tolist() == [False, True, False] and ratio[1] == pytest.approx(math.log(30.5 / 101) - math.log(1.5 / 101))


def test_training_counts_plain_sentences():
    """Sentences without chosen features, kept as a number, weigh as if each were written out."""
    y, used = np.array([True, False, True, False]), np.zeros(1 << toxicity.BITS, bool)
    used[[1, 2]] = True
    bags = [(np.array([1], np.int32), np.array([1])), (np.array([2], np.int32), np.array([1])), (np.array([1, 2], np.int32), np.array([1, 2])), (np.array([], np.int32), np.array([], np.int64))]
    w, b = toxicity.train(y, bags, np.array([3, 3, 3, 4]), np.where(used, 1.0, 0.0), used)
    assert w[1] > w[2] and b < 0 and not w[[0, 3]].any()


def test_long_labelled_documents_teach(spark):
    filler = " ".join(["the sun was over our old green hill."] * 1200)
    docs = spark.createDataFrame([(i, f"{filler} You zorgle one. {filler}" if i % 2 else filler) for i in range(60)], ["doc_id", "text"])
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("label")))
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in toxicity.score(docs, model).collect())


# --- language ---


def test_prediction_by_hand(spark):
    docs = common.table(spark, SMALL, "documents")
    model = language.fit(docs, docs.select("doc_id", F.col("lang").alias("label")))
    assert sorted(model["groups"]["germanic"]) == ["de", "en"] and set(model["pairs"]) == {("de", "en"), ("es", "fr")}
    for r in docs.limit(60).collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            continue
        v = np.append(language.vector(r.text), 1.0)
        family = max(model["first"], key=lambda f: model["first"][f] @ v)
        a, b = sorted(model["groups"][family])
        assert language.predict(model, r.text)[0] == (a if model["pairs"][a, b] @ v > 0 else b)


def test_sparse_machine_is_the_dense_one():
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((64, language.SIZE)) < 0.01, rng.random((64, language.SIZE)), 0)
    y = np.where(np.arange(64) % 2, 1.0, -1.0)
    dense[:, 5] = y == 1
    index = [np.flatnonzero(r) for r in dense]
    w = language.svm(np.concatenate([[0], np.cumsum([len(i) for i in index])]), np.concatenate(index), np.concatenate([r[i] for r, i in zip(dense, index)]), y)
    assert ((dense @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


# --- quality ---


def test_ratios_and_sample_by_hand(spark):
    docs = common.table(spark, SMALL, "documents")
    sampler = quality.Sampler(docs, quality.quality_labels(spark, SMALL))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = [r.doc_id for r in quality.quality_labels(spark, SMALL).filter("label = 1").collect()]
    count = lambda ids: sum((np.bincount(quality.ngrams(texts[i], quality.Tokens()), minlength=quality.SIZE) for i in ids), np.zeros(quality.SIZE))
    ratios = []
    for a, b in zip(*(np.split(count(ids), [1 << quality.WORD_BITS]) for ids in (good, texts))):
        ratios.append(np.log(0.9 * a / a.sum() + 0.1 / len(a)) - np.log(0.9 * b / b.sum() + 0.1 / len(b)))
    ratios = np.concatenate(ratios)
    rows = {r.doc_id: r for r in sampler.scores().collect()}
    keys = {}
    for i, t in texts.items():
        weight = ratios[quality.ngrams(t, quality.Tokens())].sum()
        assert rows[i].log_weight == pytest.approx(weight, abs=1e-6)
        keys[i] = rows[i].key
    k = sum(r.log_weight >= sampler.threshold for r in rows.values())
    assert {i for i, r in rows.items() if r.kept} == set(sorted(keys, key=lambda i: (-keys[i], i))[:k])


# --- near-duplicates ---


def test_ids_under_several_texts_lose_no_link(spark):
    x, y = " ".join(f"x{i}" for i in range(80)), " ".join(f"y{i}" for i in range(80))
    rows = [(5, x), (9, y), (9, x + " more"), (7, y + " more"), (None, x), (None, "alone here and nowhere else at all"), (None, None)]
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == [(0, 0, False), (0, 0, False), (0, 5, False), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False)]


@pytest.mark.parametrize("minor", [3, 300])
def test_tiles_hold_every_pair_that_can_be_similar(spark, minor):
    rng = random.Random(4)
    rows = [(1, i, rng.randint(20, 60), i < minor) for i in range(300)] + [(2, 1000 + i, 50, i % 2 == 0) for i in range(40)]
    left, right = near_dup.tiles(spark.createDataFrame(rows, "band long, node long, n_shingles long, minor boolean"), 85, tile=16)
    for side in (left, right):
        assert side.groupBy("tile").count().agg(F.max("count")).first()[0] <= 60
    met = left.select("tile", F.col("node").alias("a")).join(right.select("tile", F.col("node").alias("b")), "tile").groupBy("a", "b").count().collect()
    want = {(a, b) for x, a, m, s in rows for y, b, n, _ in rows if s and x == y and 100 * min(m, n) >= 85 * max(m, n)}
    assert want <= {(r.a, r.b) for r in met} and all(r["count"] == 1 for r in met)


def test_a_bucket_of_unlike_members(spark):
    """Five thousand texts that share a band, in pairs of near copies and otherwise below the threshold."""
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(60)]
    base = [shared + [f"u{k}w{i}" for i in range(30)] for k in range(700)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "z"]) for w in base]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), ["doc_id", "text"])
    sizes = near_dup.near_duplicates(df).groupBy("component_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {(r["count"], r.n) for r in sizes} == {(2, 700)}


# --- hot and odd rows ---


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 7 if i % 5 else None, f"some words number {i % 9} of a text that goes on", "en", "s" if i % 3 else "t", 10) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = clashing(docs)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    kept = quality.Sampler(docs, labels).kept_rows()
    assert kept.columns == docs.columns and {(r.passes, r.log_weight, r.key, r.order) for r in kept.collect()} <= {(9, "w", "k", 1)}
    one = near_dup.drop_near_duplicates(docs)
    assert one.columns == docs.columns and one.count() == 9
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and {(r._copy, r._row, r._hash) for r in mixed.collect()} == {(2, "r", 3)} and abs(mixed.count() - 60) <= 2
    parts = clashing(packing.pieces(docs), ("cell", "nr"))
    assert packing.pack(parts).columns == [*parts.columns, "sequence_id", "offset"]


def test_stages_leave_texts_where_they_are(spark):
    """Texts are not shuffled to drop or repeat rows, and what led to near duplicates is gone before the rows that stay are written once more."""
    text = lambda i: " ".join(f"{i}w{k}" for k in range(30))
    docs = spark.createDataFrame([(i, text(i % 90), "en", "s", 10) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    few = "spark.sql.autoBroadcastJoinThreshold"
    before, folder = spark.conf.get(few), shared.shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(folder))
    spark.conf.set(few, "-1")
    try:
        with shared.Steps(spark) as work:
            one = near_dup.drop_near_duplicates(docs)
            assert {p[:-33] for p in set(os.listdir(folder)) - there} == {"dup-rows", "dup-kept", "dup-kept-marks"}
            many = mixing.apply_mix(docs)
        for df in (one, many):
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in one.collect()) == list(range(90)) and sorted(r.doc_id for r in many.collect()) == list(range(300))
    finally:
        spark.conf.set(few, before)
    work.close()


@pytest.mark.parametrize("marks", [common.MARKS, 0])
def test_rows_are_taken_as_often_as_asked(spark, marks):
    docs = spark.range(1000).select(F.col("id").alias("doc_id")).repartition(3)
    rows, at = common.keyed_rows(docs, "test-rows")
    passes = {i: i * 7 % 4 for i in range(1000) if i % 10}
    asked = spark.createDataFrame(list(passes.items()), "doc_id long, passes int").withColumnRenamed("doc_id", at["doc_id"])
    taken = rows.join(asked, at["doc_id"]).select("_row", "passes")
    got = Counter(r[0] for r in common.take_rows(rows, taken, 3, "test-taken", marks).select(at["doc_id"]).collect())
    assert got == {i: n for i, n in passes.items() if n}


def test_a_step_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, own = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    step = common.settle(frame, "test-shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and step.count() == frame.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == own


def test_workers_give_memory_back(monkeypatch):
    """Python workers outlive a task, and those of a former stage stand beside the next one's."""
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append("parts"))
    monkeypatch.setattr(quality, "give_back", lambda: called.append("tokens"))
    batches = [pa.RecordBatch.from_pydict({"text": [str(i)] * 600}) for i in range(3)]
    assert [b.num_rows for b in common.parts(iter(batches))] == [512, 88] * 3 and called == ["parts"]
    quality.Tokens().forget()
    assert called == ["parts", "tokens"]


def test_repeated_rows_fill_sequences(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(30).cast("long").alias("length"))
    packed = packing.pack(rows, size=100, cell=500).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert len(packed) == 1000 and all(r.n == 90 and r.k == r.m == 3 for r in packed)


def test_local_search_leaves_nothing_that_gains():
    rng = np.random.default_rng(9)
    for _ in range(5):
        n = rng.integers(1, 40, 60)
        bins = packing.improve(packing.best_fit(n, 100), n, 100)
        assert sorted(i for b in bins for i in b) == list(range(60))
        fill = [int(n[b].sum()) for b in bins]
        assert max(fill) <= 100
        for a in range(len(bins)):
            for b in range(len(bins)):
                if a != b and fill[b] <= fill[a] < 100:
                    for give in [(i,) for i in bins[b]] + [(i, j) for i in bins[b] for j in bins[b] if i < j]:
                        for own in [0, *n[bins[a]]]:
                            by = int(n[list(give)].sum() - own)
                            assert not 0 < by <= 100 - fill[a]


def test_samples_are_bounded_and_the_same_in_every_run(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 5").withColumn("text", F.lit("a")))
    ids = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "rare").otherwise("usual").alias("label"))
    ids = ids.unionByName(spark.createDataFrame([(None, "rare"), (3, None)], "doc_id long, label string"))
    runs = [sorted((r.doc_id, r.label, r.text) for r in sampling.labelled_sample(docs.repartition(n), ids.repartition(n), 100).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 200 and all(t == "a" for i, _, t in runs[0] if i < 5)


def test_pipeline_of_odd_rows(spark, odd, none):
    """Null and repeated ids, empty and very long texts, repeated rows and clashing columns through all stages."""
    docs = clashing(odd)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.settle(stage(spark, docs, SMALL), "odd")
        assert docs.columns == columns, name
    packed = corpus_pipeline.packing(spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and all(r.length <= packing.LENGTH for r in packed)
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = common.settle(stage(spark, empty, SMALL), "odd")
    assert empty.count() == 0


def test_hashes_are_the_library_s():
    assert near_dup.words_key([b"a", b"b"]) == xxhash.xxh3_128_digest(b"a b")


def test_blocks_of_a_text_count_as_the_whole(monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["one", "two", "two", "Three", "İst", "ΟΣ", "4", "!"]) for _ in range(2500))
    whole, letters = np.bincount(quality.ngrams(text, quality.Tokens()), minlength=quality.SIZE), language.vector(text)
    tokens = len(re.findall(r"\w+|[^\w\s]", text))
    for block in (1, 2, 3, 4, tokens // 5 * 2):
        monkeypatch.setattr(quality, "BLOCK", block), monkeypatch.setattr(language, "BLOCK", block)
        assert (np.bincount(quality.ngrams(text, quality.Tokens()), minlength=quality.SIZE) == whole).all()
        assert (language.vector(text) == letters).all()


def test_rows_without_an_id_spread_over_the_queue(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("a").alias("source"))
    taken = mixing.mix(docs).groupBy("taken").count().collect()
    assert {r.taken: r["count"] for r in taken} == {2: 100_000}
    held = docs.groupBy(F.substring(mixing.shuffle_key(), 1, mixing.PART_DIGITS).alias("part")).count().agg(F.max("count"), F.count("*")).first()
    assert held[0] < 100 and held[1] == 4096


def _chained(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    return sorted((r.doc_id, r.piece, r.length) for r in docs.collect())


def test_stages_chain_without_writing_in_between(spark, odd):
    """Each stage reads the former's lazy result; a result that is still held is there after later stages."""
    docs = common.table(spark, SMALL, "documents")
    first = corpus_pipeline.quality(spark, docs, SMALL)
    kept = first.count()
    mixed = corpus_pipeline.mixing(spark, corpus_pipeline.near_duplicates(spark, first, SMALL), SMALL)
    assert mixed.count() > 0 and first.count() == kept
    assert _chained(spark, docs) == sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SMALL).collect())


def test_two_pipelines_at_once(spark, odd):
    docs, found, failed = common.table(spark, SMALL, "documents"), {}, []

    def work(name):
        try:
            found[name] = _chained(spark, docs)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and found[0] == found[1]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
