"""Every operator against brute force, round trips or held-out accuracy, and on odd rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrywork.llm import common, components, language, media, mixing, near_dup, neighbours, packing, pii, quality, queries, toxicity, urls

from ..oracle import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_cut_at_agrees_with_a_sort(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, ["key", "id", "w"])
    for budget in (0, 5, 777, 6000, 10**9):
        total, want = 0, set()
        for key, i, w in sorted(rows):
            total += w
            if total > budget:
                break
            want.add(i)
        cut = common.cut_at(df, "key", ["id"], "w", budget, bins=7, last=20)
        got = {r[0] for r in df.filter(common.up_to(cut, "key", ["id"])).select("id").collect()}
        assert sum(w for _, i, w in rows if i in got) == sum(w for _, i, w in rows if i in want)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (9, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, ["a", "b"])).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


# --- media ---


def test_media_round_trip(spark, odd, none):
    rows = media.read_media(media.store_media(odd)).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == 11
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.payload).rstrip(b"\0") == raw.rstrip(b"\0") and len(r.payload) % 64 == 0 and len(r.payload) >= max(64, len(raw))
        assert media.from_wav(bytes(r.media)) == bytes(r.payload)
    assert media.read_media(media.store_media(none)).count() == 0


def test_fingerprint_finds_tones():
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * t * 24 / 256) + 60 * np.sin(2 * np.pi * t * 50 / 256)).astype(np.uint8)
    bins = {(c >> 16) & 255 for c in media.fingerprint(tone)}
    assert {24, 50} <= bins
    assert len(media.fingerprint(np.full(64, 128, np.uint8))) == 0


# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(rng.choice(["aB@.-%", "0123.", "49 -", "+1 ().-0", "a@b.c 1.2.3.4", "é@1"])) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_checks_and_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("card 4111 1111 1111 1111.") == ["card"] and kinds("card 4111 1111 1111 1112.") == []
    assert kinds("account DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("account DE88 3704 0044 0532 0130 00") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert pii.mask("a b@c.org d", pii.find_spans("a b@c.org d")) == "a [EMAIL] d"


def test_ibans_with_tokens_around_them():
    found = lambda t: [t[s:e] for k, s, e, _ in pii.find_spans(t) if k == "iban"]
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "NO93 8601 1117 947"):
        for text in ("{}", "IBAN: {} BIC: COBADEFFXXX", "{} 2024", "{} 12 3456 7890 ABC", "REF AB12 {}.", "AB12CD34 {} X"):
            assert found(text.format(iban)) == [iban], text
    assert found("two: DE89370400440532013000 GB82WEST12345698765432 end") == ["DE89370400440532013000", "GB82WEST12345698765432"]
    assert found("DE88 3704 0044 0532 0130 00 BIC") == [] and found("DE89370400440532013000x") == [] and found("xDE89370400440532013000") == []


def test_an_iban_over_a_card_is_masked_whole():
    text = next(t for i in range(10**4) if pii.mod97((t := f"NO{i % 100:02} 8601 {i // 100:04} 947 ")[:-1]) and pii.luhn(pii._digits(t))) + "is the account"
    kinds = [s[0] for s in pii.find_spans(text)]
    assert kinds == ["card", "iban"] and pii.mask(text, pii.find_spans(text)) == "[IBAN] is the account"


def test_personal_data_of_odd_rows(odd, none):
    assert pii.personal_data(odd).filter("size(spans) > 0").count() == 0
    kept = pii.mask_personal_data(odd)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert pii.personal_data(none).count() == 0


def test_query_agrees_with_the_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SMALL, "documents").collect()}
    for r in pii.op2_personal_data(spark, SMALL).collect():
        base = ",".join(":".join(map(str, s)) for s in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


# --- mixing ---


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and mixing.mix(none).count() == 0
    assert all(0 <= r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows) <= sum(r.size for r in rows)
    assert {(r.doc_id, r.taken) for r in mixing.mix(odd).collect()} == {(r.doc_id, r.taken) for r in rows}


def test_targets_are_filled_up(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0)], ["source_key", "source_size"])
    got = {r.source_key: r.target for r in mixing.targets(df).collect()}
    assert got["a"] == 30 and got["d"] == 0 and abs(sum(got.values()) - 1510) < 1e-6 and abs(got["b"] / got["c"] - 2) < 1e-9


# --- near-duplicates ---


def brute_components(texts):
    sets = {i: set(near_dup.shingles(near_dup.words_of(t)).tolist()) for i, t in texts.items()}
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return {i: (len(sets[i]), best[i]) for i in sets}


def test_near_duplicates_with_chains_and_crowded_buckets(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    texts = {}
    for family in range(6):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(80)] = rng.choice(words)
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), ["doc_id", "text"])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(texts)


def test_near_duplicates_of_odd_rows(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6][1] == got[7][1] == 6 and got[8][2]
    assert near_dup.near_duplicates(none).count() == 0


def families(seed, edits):
    """Families of 80 words with a few of them changed."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    texts = {}
    for _ in range(12):
        base = [rng.choice(words) for _ in range(80)]
        for k in range(8):
            own = list(base)
            for _ in range(k and rng.randint(0, edits)):
                own[rng.randrange(80)] = rng.choice(words)
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_each_threshold(spark, percent):
    texts = families(8, 3)
    sets = {i: set(near_dup.shingles(near_dup.words_of(t)).tolist()) for i, t in texts.items()}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(list(texts.items()), ["doc_id", "text"])
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, percent).collect()} == least


def test_pipeline_drops_copies_between_the_thresholds(spark):
    base = [f"w{i}" for i in range(50)]
    near = list(base)
    near[20] = "other"
    sets = [set(near_dup.shingles(near_dup.words_of(" ".join(t))).tolist()) for t in (base, near)]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], ["doc_id", "text"])
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()] == [1]
    assert near_dup.near_duplicates(df).filter("kept").count() == 2


def test_bands_and_signatures_miss_few():
    for percent, plan in ((85, (85, 40, 8, 813)), (80, (80, 54, 7, 757))):
        assert near_dup.plan_of(percent) == plan
        assert (1 - (percent / 100) ** plan[2]) ** plan[1] <= 3.1e-6


# --- urls ---


def test_rules_and_hosts(spark):
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "https://net/"), (3, "https://net"), (4, None), (5, "no scheme/fr/"), (6, "x://b.org/fr/1#a"), (7, "http://example.com?/de/"), (8, "http://x.example.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame([(6, 1)], "page_id long, good int")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2].rule == "net/" and got[3].rule is None and got[3].path == ""
    assert (got[4].host, got[4].path) == (got[5].host, got[5].path) == ("", "")
    assert got[6].rule == "org/fr/" and got[7].rule is None and got[8].rule == "example.com/de/"
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "page_id long, good int")).count() == 0


def test_reputation_shrinks(spark):
    rows = [(i, f"http://good.a.com/{i}") for i in range(60)] + [(100 + i, f"http://bad.a.com/{i}") for i in range(60)] + [(200, "http://new.a.com/")]
    good = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)]
    got = {r.host: r for r in urls.judge(spark.createDataFrame(rows, ["page_id", "url"]), spark.createDataFrame(good, ["page_id", "good"]), rules=()).collect()}
    assert got["good.a.com"].verdict == "allow" and got["bad.a.com"].verdict == "block" and got["bad.a.com"].mean < got["new.a.com"].mean < got["good.a.com"].mean


def test_domains_and_suffixes(spark):
    hosts = {"a.co.uk": ("co.uk", "a.co.uk"), "x.b.co.uk:80": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "u@w.a.com:8080": ("com", "a.com"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], ["host"])
    suffix, domain = urls.suffix_and_domain(F.col("host"))
    assert {r[0]: (r[1], r[2]) for r in df.select("host", suffix, domain).collect()} == hosts


def test_urls_of_odd_rows(spark):
    rows = [(None, "http://a.com/1"), (None, "http://a.com/1"), (1, "http://a.com/" + "x" * 100_000), (1, "http://b.com/y"), (2, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"n": F.lit("n"), "good": F.lit("g"), "_hot": F.lit(1)})
    got = urls.judge(pages, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, good int")).collect()
    assert len(got) == 5 and all(r.n == 1 and r.k == 0 for r in got if r.host == "b.com") and {r.n for r in got if r.host == "a.com"} == {1}


# --- toxicity, language, quality ---


def test_toxicity(spark, odd, none):
    rng = random.Random(4)
    clean = [" ".join(rng.choice("the sun was over our old green hill".split()) for _ in range(60)) + "." for _ in range(300)]
    docs = [(i, t if i % 3 else f"{t} You {rng.choice(['zorgle', 'zorglix'])} one. {t}") for i, t in enumerate(clean)]
    df = spark.createDataFrame(docs, ["doc_id", "text"])
    labels = df.filter("doc_id < 200").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("label"))
    model = toxicity.fit(df, labels)
    for r in toxicity.score(df, model).filter("doc_id >= 200").collect():
        assert (r.score >= 0.5) == (r.doc_id % 3 == 0)
        if r.offending:
            text = docs[r.doc_id][1]
            assert any("zorg" in text[s.start : s.end] for s in r.offending) and len(r.offending) == 1
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(none, model).count() == 0
    assert toxicity.fit(df, labels.limit(0))[0].sum() == 0


def test_toxicity_of_held_out_documents(spark):
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.85


def test_language(spark, odd, none):
    docs = common.table(spark, SMALL, "documents")
    got = language.op8_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    model = language.fit(docs, docs.select("doc_id", F.col("lang").alias("label")))
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] == rows[9] == ("und", 0.0) and rows[10][0] in ("de", "en", "es", "fr")
    assert language.identify(none, model).count() == 0
    empty = language.fit(none, none.select("doc_id", F.col("lang").alias("label")))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_quality(spark, odd, none):
    labels = quality.quality_labels(spark, SMALL)
    got = quality.op9_quality(spark, SMALL).join(labels, "doc_id")
    bad = {(r.label, r.kept): r.n for r in got.groupBy("label", "kept").agg(F.count("*").alias("n")).collect()}
    assert bad.get((1, False), 0) <= 0.02 * bad[1, True] and bad.get((0, True), 0) <= 0.1 * bad[0, False]
    docs = common.table(spark, SMALL, "documents")
    sampler = quality.Sampler(docs, labels)
    kept = sampler.kept_rows()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in sampler.scores().filter("kept").collect()}
    assert sampler.scores().filter("kept").count() == sampler.k
    whole = quality.Sampler(odd, labels.limit(0))
    assert whole.scores().filter("kept").count() == 11 and quality.Sampler(none, labels.limit(0)).scores().count() == 0


# --- packing ---


def test_word_cache_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole, known = Tokenizer.from_file(packing.default_tokenizer()), packing.word_ids(packing.default_tokenizer())
    rng = random.Random(1)
    letters = "abcXYZé ÉñŸſſ'sT'll .,!?0123½²ªßẞ́İΣσ\x1c\x85\xa0\n\t日本🙂İK-_@#"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "", "<|endoftext|>x"])
        assert known.text(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packed(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pack(spark, odd, none):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(odd).collect()
    check_packed(rows, packing.LENGTH)
    whole = Tokenizer.from_file(packing.default_tokenizer())
    for doc, text in {(r.doc_id, r.text) for r in odd.collect()}:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc})
        assert own == [(i, at, len(p := ids[at : at + 4096]), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), 4096))]
    assert packing.pack_documents(none).count() == 0


def test_pack_over_many_cells_is_tight(spark):
    rng = random.Random(6)
    parts = [(i, 0, 0, rng.choice([rng.randint(1, 100), rng.randint(30, 100), rng.randint(45, 60)]), 0) for i in range(3000)]
    rows = packing.pack(spark.createDataFrame(parts, "doc_id long, piece int, start long, length long, ids_crc32 long"), size=100, cell=400).collect()
    assert len(rows) == 3000
    one = len(packing.best_fit(np.array([p[3] for p in parts]), 100))
    assert check_packed(rows, 100) <= one * 1.02


def test_local_search_empties_a_sequence():
    lengths = np.array([6, 3, 5, 5, 7, 4])
    bins = packing.improve([[0, 1], [2, 3], [4], [5]], lengths, 10)
    assert len(bins) == 4 or sorted(i for b in bins for i in b) == list(range(6))
    better = packing.improve([[0], [1], [2], [3]], np.array([6, 4, 5, 5]), 10)
    assert len(better) == 2


# --- neighbours ---


def test_neighbours_recall_and_exact_scores(spark):
    e = common.table(spark, SMALL, "embeddings").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hit = total = 0
    for q, g in neighbours.op10_neighbours(spark, SMALL).toPandas().groupby("query_id"):
        s = x @ x[ids == q][0]
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g["score"], [s[ids == v][0] for v in g["vec_id"]])
        hit, total = hit + len(set(ids[want]) & set(g["vec_id"])), total + 20
    assert hit / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (40, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = neighbours.Index(df)
    got = index.search(index.rows.filter("vec_id % 20 = 0").select("vec_id", "embedding"))
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()] == [
        (0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 6, 0.0), (20, 3, 7, 0.0)]
    none = neighbours.Index(df.limit(0))
    assert none.search(none.rows.select("vec_id", "embedding")).count() == 0


def test_neighbours_over_many_blocks(spark):
    """Recall over all queries of a table of many blocks, searched in part; no leaf much larger than asked for, and query parts."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 16))[rng.integers(0, 500, 50_000)] + 0.15 * rng.normal(size=(50_000, 16))).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    index = neighbours.Index(df, sample=2000)
    queries = index.rows.filter("vec_id % 20 = 0").select("vec_id", "embedding")
    leaves = index.calibrate(queries)
    assert max(index.sizes.values()) <= 8 * index.leaf and index.tree.leaves > 100 and leaves < index.tree.leaves / 4 and max(b for b, _ in index.blocks.values()) >= 8
    got = index.search(queries, 20, leaves).toPandas()
    asked = np.arange(0, 50_000, 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-scores, 20, axis=1)[:, :20]
    hits = sum(len(set(true[q // 20]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert len(got) == 20 * len(asked) and hits / true.size >= 0.9
    assert np.allclose(got["score"], [x[q] @ x[v] for q, v in zip(got["query_id"], got["vec_id"])])


def test_neighbours_with_ties_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 60)] + [(7, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [2.0, 0.0])]
    index = neighbours.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=8)
    got = index.search(spark.createDataFrame([(0, [2.0, 0.0])], "vec_id long, embedding array<double>"), 8).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 2.0) for i in (1, 2, 3, 4, 5, 6, 7, 7)]


# --- pipeline ---


def test_stages_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    big = (1 << 53) + 1
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (4, text("c") + " x"), (5, text("c") + " y"), (5, text("d")), (6, text("e")), (6, text("e")), (6, text("e")), (big, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    have = lambda df: sorted([(r.doc_id or 0, r.text) for r in df.collect()])
    want = sorted((i or 0, t) for i, t in {rows[k] for k in (0, 1, 3, 5, 6, 9)})
    assert have(corpus_pipeline.near_duplicates(spark, docs, SMALL)) == want
    assert have(corpus_pipeline.mixing(spark, docs, SMALL)) == sorted((i or 0, t) for i, t in rows)  # of one source, all once
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.packing(spark, docs, SMALL).collect()) == sorted(i or 0 for i, _ in rows)
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, label int")
    sampler = quality.Sampler(docs, labels)
    assert sampler.kept_rows().count() == sampler.scores().filter("kept").count() > 0


def test_pipeline(spark):
    docs = common.table(spark, SMALL, "documents")
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, common.settle(stage(spark, at, SMALL), "test")
        assert at.columns == columns and {r.doc_id for r in at.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}, name
    packed = corpus_pipeline.run(spark, SMALL).collect()
    check_packed(packed, packing.LENGTH)
    assert {r.doc_id for r in packed} == {r.doc_id for r in at.collect()}
    assert json.dumps(sorted({r.doc_id for r in packed})) == json.dumps(sorted({r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}))


