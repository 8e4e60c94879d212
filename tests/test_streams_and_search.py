"""Streams against their batch twins, the limiter and the search against brute force."""

import random
import time
from functools import cache

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrywork.operators import search as E
from quarrywork.sources.sinks import read_graph, remove_replaced, write_graph
from quarrywork.streaming import events as ST


def through(spark, df, stream, tmp_path, mode="append"):
    """What the streaming form gives, replayed over files in order."""
    source = str(tmp_path / "in")
    df.repartition(3).write.parquet(source)
    name = f"out_{random.randint(0, 10**9)}"
    run = stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(source))
    q = run.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_events(spark, tmp_path):
    lines = [
        '{"type":"stage","run_id":"1","stage":"tree","status":"progress","progress":7}', '{"type":"st', '{"type":"other"}', '{"type":"stage"}', "", '{"type":"error","message":"%s"}' % ("x" * 300),
        '{"type":"heartbeat"}', '{"type":"stage","stage":"tree","status":"bogus"}', '{"type":"warning","message":" a\\u0000\\n b "}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], ["value"])
    batch = {r.value: r for r in ST.parse_events(df).collect()}
    assert [batch[x].reason for x in lines] == [None, "malformed", "unknown-type", "unknown-stage", "malformed", None, None, "unknown-status", None]
    assert batch[lines[0]].progress == 1.0 and batch[lines[5]].message == "x" * 159 + "…" and batch[lines[8]].message == "a  b"
    assert sorted(map(str, through(spark, df, ST.parse_events, tmp_path).collect())) == sorted(map(str, batch.values()))


def test_active_stage(spark):
    rows = [("a", 1, "tree", "done"), ("a", 2, "fetch", "start"), ("a", 5, "fetch", "progress"), ("a", 3, "parse", "start"), ("a", 4, "parse", "done"), ("a", 6, "history", "warning"), ("a", 7, "made-up", "start"), ("b", 1, "parse", "start"), ("b", 2, "tree", "start"), ("c", 1, "tree", "skipped")]
    df = spark.createDataFrame(rows, "run_id string, seq int, stage string, status string")
    assert {r.run_id: (r.active, r.finished) for r in ST.active_stage(df).collect()} == {"a": ("fetch", 3), "b": ("parse", 0), "c": (None, 1)}


def test_counts_and_dedupe(spark, tmp_path):
    rows = [("r", f"s{i % 40}", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=7 * (i % 40))).to_pydatetime()) for i in range(80)]
    df = spark.createDataFrame(rows, "repo_id string, sha string, date timestamp")
    got = through(spark, df, lambda s: ST.commit_counts(s, "7 days"), tmp_path / "a", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, ST.commit_counts(df, "7 days").collect()))
    assert {r.sha for r in through(spark, df, ST.dedupe_commits, tmp_path / "b").collect()} == {r[1] for r in rows}


def test_token_bucket(spark, tmp_path):
    times = [0, 0, 0, 100, 20_100, 20_200, 90_000]
    rows = [("c", i, (pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=t)).to_pydatetime()) for i, t in enumerate(times)] + [("d", 99, pd.Timestamp("2024-01-01").to_pydatetime())]
    df = spark.createDataFrame(rows, "client_key string, request_id long, ts timestamp").coalesce(1)
    source = str(tmp_path / "in")
    df.write.parquet(source)
    run = ST.token_bucket(spark.readStream.schema(df.schema).parquet(source), 2, 3)
    q = run.writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(90):  # timeouts by the clock keep a stream going for ever, so it is stopped once all is answered
        if q.exception() or spark.table("bucket").count() >= len(rows):
            break
        time.sleep(1)
    q.stop()
    assert q.exception() is None
    got = {r.request_id: (r.allowed, r.retry_after_ms) for r in spark.table("bucket").collect()}
    assert [got[i][0] for i in range(7)] == [True, True, False, False, True, False, True] and got[99] == (True, 0)
    assert got[2][1] == 20_000 and got[3][1] == 19_900


def slow_score(query, target):
    """Every alignment, by recursion."""
    low, t = target.lower(), target

    def bonus(j):
        if j == 0:
            return 10
        b, c = t[j - 1], t[j]
        return 9 if b in "/\\" else 8 if b in E.DELIMITERS else 7 if c.isupper() and b.islower() or c.isdigit() and not b.isdigit() else 0

    @cache
    def ways(i, j):
        """The best (score, run) with character i at place j."""
        if low[j] != query[i].lower():
            return None
        case = t[j] == query[i]
        if i == 0:
            return 16 + 2 * bonus(j) + case, bonus(j)
        best = None
        if j and (w := ways(i - 1, j - 1)):
            run = max(w[1], bonus(j))
            best = (w[0] + 16 + max(run, 5) + case, run)
        gaps = [ways(i - 1, k)[0] - 3 - (j - 2 - k) for k in range(j - 1) if ways(i - 1, k)]
        if gaps and (best is None or max(gaps) + 16 + bonus(j) + case > best[0]):
            best = (max(gaps) + 16 + bonus(j) + case, bonus(j))
        return best

    return max((w[0] for j in range(len(t)) if (w := ways(len(query) - 1, j))), default=float("-inf"))


def test_alignment():
    rng = random.Random(8)
    for _ in range(400):
        target = "".join(rng.choice("abAB/._1x") for _ in range(rng.randint(1, 14)))
        query = "".join(rng.choice("abAB1x") for _ in range(rng.randint(1, 4)))
        others = ["".join(rng.choice("abAB/._1x") for _ in range(rng.randint(1, 30))) for _ in range(5)]
        assert E.best_alignment(query.lower(), query, target) == slow_score(query, target), (query, target)
        assert E.best_alignments(query.lower(), query, [target, *others]).tolist() == [slow_score(query, t) for t in (target, *others)]


def test_search_order(spark):
    entries = spark.createDataFrame(
        [("r", "file", "1", "graph.ts", "graph.ts", "graph", "src/graph.ts", 5, 4.9), ("r", "file", "2", "graph", "graph", "", "graph", 5, 4.9), ("r", "file", "3", "graphs.ts", "graphs.ts", "graphs", "graphs.ts", 5, 4.9), ("r", "file", "4", "x.ts", "x.ts", "x", "graph/x.ts", 5, 4.9)],
        "repo_id string, kind string, id string, title string, name string, stem string, path string, prior int, bias double")
    queries = spark.createDataFrame([(1, "gra ph"), (2, "h/x.ts"), (3, ""), (4, "zz")], ["query_id", "query"])
    got = [(r.query_id, r.id) for r in E.search_top_k(queries, entries, 3).orderBy("query_id", "place").collect()]
    assert got == [(1, "2"), (1, "1"), (1, "3"), (2, "4")]


def test_sink_replaces_one_key(spark, tmp_path):
    rows = lambda n, sha: spark.createDataFrame([("r", sha, i) for i in range(n)], ["repo_id", "commit_sha", "x"])
    for n, sha in ((3, "a"), (2, "b"), (1, "a")):
        write_graph({"files": rows(n, sha), "symbols": rows(2 * n, sha)}, str(tmp_path))
    held = lambda name: {(r.commit_sha, r["count"]) for r in read_graph(spark, str(tmp_path), name).groupBy("commit_sha").agg(F.count("*").alias("count")).collect()}
    assert held("files") == {("a", 1), ("b", 2)} and held("symbols") == {("a", 2), ("b", 4)}
    with pytest.raises(Exception, match="lost"):
        write_graph({"files": rows(9, "a"), "symbols": rows(9, "b").withColumn("x", F.raise_error(F.lit("lost")).cast("long"))}, str(tmp_path))
    assert held("files") == {("a", 1), ("b", 2)} and held("symbols") == {("a", 2), ("b", 4)}
    write_graph({"files": rows(5, "b"), "symbols": rows(1, "b").limit(0)}, str(tmp_path))
    assert held("files") == {("a", 1), ("b", 5)} and held("symbols") == {("a", 2)}
    assert remove_replaced(spark, str(tmp_path), ["files", "symbols"]) == 2
    assert held("files") == {("a", 1), ("b", 5)} and held("symbols") == {("a", 2)}


def test_run_state_as_a_stream(spark):
    rows = []
    for run in range(12):
        events = [("stage", "tree", "start", 0.0, None), ("stage", "tree", "done", None, None), ("stage", "fetch", "progress", 0.4, None), ("stage", "parse", "warning", None, "slow"), ("preview", None, None, None, None)]
        events += [("complete", None, None, None, None), ("stage", "fetch", "start", 0.0, None)] if run % 3 == 0 else [("error", None, None, None, None), ("complete", None, None, None, None)] if run % 3 == 1 else []
        rows += [(str(run), i, *e) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "run_id string, seq long, type string, stage string, status string, progress double, message string").repartition(1)
    batch = {r.run_id: r for r in ST.run_state_batch(df).collect()}
    assert batch["0"].stages == "tree=done,fetch=done,parse=warning" and batch["0"].status == "complete" and batch["0"].finished == 3 and batch["1"].status == "error" and batch["2"].status == "preview" and batch["2"].warnings == 1
    source = spark.sparkContext.getConf().get("spark.checkpoint.dir") + f"/runs-{random.randint(0, 10**9)}"
    df.write.parquet(source)
    q = ST.run_state(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("memory").queryName("runs").outputMode("update").start()
    for _ in range(90):
        if q.exception() or spark.table("runs").count() >= 12:
            break
        time.sleep(1)
    q.stop()
    assert q.exception() is None and {r.run_id: tuple(r) for r in spark.table("runs").collect()} == {k: tuple(r) for k, r in batch.items()}


def test_positions_explain_the_score():
    rng = random.Random(11)
    for _ in range(300):
        target = "".join(rng.choice("abAB/._1x") for _ in range(rng.randint(1, 14)))
        query = "".join(rng.choice("abAB1x") for _ in range(rng.randint(1, 4)))
        at, best = E.alignment(query.lower(), query, target), slow_score(query, target)
        assert bool(at) == (best > float("-inf"))
        if at:
            assert at == sorted(set(at)) and [target[i].lower() for i in at] == list(query.lower())
            bonus, score, run = E.position_bonuses(target), 0, 0
            for n, (i, c) in enumerate(zip(at, query)):
                own = int(bonus[i])
                if n == 0:
                    score, run = 16 + 2 * own, own
                elif i == at[n - 1] + 1:
                    run = max(run, own)
                    score += 16 + max(run, 5)
                else:
                    score, run = score - 3 - (i - at[n - 1] - 2) + 16 + own, own
                score += target[i] == c
            assert score == best


def test_masks_and_many_queries(spark, monkeypatch):
    entries = spark.createDataFrame([("r", "file", str(i), f"n{i}.ts", f"n{i}.ts", f"n{i}", f"src/n{i}.ts", 5, 4.9) for i in range(30)], "repo_id string, kind string, id string, title string, name string, stem string, path string, prior int, bias double")
    queries = spark.createDataFrame([(i, f"n{i}") for i in range(12)] + [(50, " ")], ["query_id", "query"])
    suggested = spark.createDataFrame([("r", "file", "9", "n9.ts", 1), ("r", "directory", "d", "src/", 1)], "repo_id string, kind string, id string, title string, place int")
    few = sorted(map(str, E.search_top_k(queries, entries, 3, suggested=suggested).collect()))
    assert sum("query_id=50" in r for r in few) == 2
    monkeypatch.setattr(E, "FEW_QUERIES", 5)
    assert sorted(map(str, E.search_top_k(queries, entries, 3, suggested=suggested).collect())) == few
    assert {r.kind for r in E.search_top_k(queries, entries, 3, ("directory",), suggested).collect()} == {"directory"}


def test_a_long_ring_and_its_tails(spark, monkeypatch):
    """A ring of 3,000, a tail into it and one out of it, and a small cycle beside; the number of steps does not follow the length."""
    from quarrywork.operators import graph as G

    monkeypatch.setattr(G, "SMALL", 20)
    name = lambda i: f"n{i:05}"
    edges = [(name(i), name((i + 1) % 3000)) for i in range(3000)] + [(name(5000 + i), name(5001 + i) if i < 199 else name(7)) for i in range(200)] + [(name(9), name(6000))] + [(name(6000 + i), name(6001 + i)) for i in range(200)] + [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "b")]
    df = spark.createDataFrame([("r", a, b, 1) for a, b in edges], "repo_id string, source string, target string, weight int")
    began = time.time()
    got = {(r.component, r["size"], r["first"], r["edges"]) for r in G.import_cycles(df).collect()}
    assert got == {(name(2999), 3000, name(0), 3000), ("d", 4, "a", 5)} and time.time() - began < 600


def test_index_finds_what_a_scan_finds(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcAB_%/.1\\é") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    asked = ["a", "ab", "aa", "bab", "%", "_a", "/", "é1", "zz", "a.b/1", "\\", "abcabc"]
    df = spark.createDataFrame([(t,) for t in set(texts)], "text string")
    want = sorted((i, t) for i, q in enumerate(asked) for t in set(texts) if E.is_subsequence(q, t.lower()))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string").withColumn("original", F.col("query")).withColumn("asked", E.character_mask(F.col("query")))
    for few in (E.FEW_QUERIES, 0):
        monkeypatch.setattr(E, "FEW_QUERIES", few)
        got = E.matches(queries, df)
        assert sorted((r.query_id, r.text) for r in got.select("query_id", "text").collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_search_broadcasts_no_texts_and_ranks_few(spark):
    """Queries that ask the same are searched once, texts found are never broadcast, and only rows about the k-th score are ranked; results as of a scan."""
    entries = spark.range(4000).selectExpr(
        "concat('r', id % 2) AS repo_id", "'symbol' AS kind", "concat('sym:', id) AS id", "concat('n', id % 1000, '()') AS title", "concat('n', id % 1000) AS name", "'' AS stem", "'' AS path", "CAST(id % 3 AS INT) AS prior", "id % 3 - 0.01D AS bias")
    queries = spark.createDataFrame([(i, "n1" if i < 6 else f"n{i}") for i in range(12)], ["query_id", "query"])
    held = {(q.query_id, e.id): e for q in queries.collect() for e in entries.collect() if E.is_subsequence(q.query, e.name)}
    counts = E.candidate_counts(queries, entries)
    assert "BroadcastHashJoin" not in counts._jdf.queryExecution().optimizedPlan().toString() and "strategy=merge" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.repo_id): (r.names, r["last"]) for r in counts.collect()} == {
        k: (len(ids), max(ids)) for k in {(q, e.repo_id) for (q, _), e in held.items()} for ids in [[i for (q, i), e in held.items() if (q, e.repo_id) == k]]}
    got = E.search_top_k(queries, entries, 3).collect()
    tier = lambda q, e: 40_000 if e.name == q else 30_000 if e.name.startswith(q) else 20_000
    asked = {q.query_id: q.query for q in queries.collect()}
    score = {(asked[q], e.name): tier(asked[q], e) + E.best_alignment(asked[q], asked[q], e.name) for (q, _), e in held.items()}
    for k in {(q, e.repo_id) for (q, _), e in held.items()}:
        want = sorted((-(score[asked[q], e.name] + e.bias), e.title, i) for (q, i), e in held.items() if (q, e.repo_id) == k)[:3]
        assert [r.id for r in sorted(got, key=lambda r: r.place) if (r.query_id, r.repo_id) == k] == [i for _, _, i in want]
