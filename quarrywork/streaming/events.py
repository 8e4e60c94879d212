"""Streaming forms of the event and history operators. Each is a plain DataFrame function, so a batch gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.text import truncate
from ..shared import settle, shared_dir

# Stages in order; the statuses of a stage, those of one that runs and those of one that has ended; the kinds of events; characters of a message kept.
STAGES = ("connect", "tree", "languages", "fetch", "parse", "dependencies", "history", "construct")
RUNNING, ENDED = ("start", "progress"), ("done", "skipped", "warning")
TYPES = ("stage", "warning", "preview", "complete", "error", "heartbeat")
MESSAGE = 160
EVENT = "type string, run_id string, stage string, status string, progress double, message string"


def clean_message(message: Column) -> Column:
    """Runs of control characters become a space; cut with an ellipsis; null if nothing is left."""
    flat = F.trim(F.regexp_replace(message, r"[\x00-\x1f\x7f]+", " "))
    return F.nullif(truncate(flat, MESSAGE), F.lit(""))


def parse_events(lines: DataFrame) -> DataFrame:
    """value (one JSON event a line) -> the event's fields and reason, which says why a line goes to the dead letters; null for good ones.

    A stage's event has a known stage and status; other kinds say nothing of either.
    """
    read = lines.withColumn("e", F.from_json("value", EVENT))
    is_stage, known = F.col("e.type") == "stage", lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    reason = (
        F.when(F.col("e").isNull() | F.col("e.type").isNull(), "malformed").when(~F.col("e.type").isin(*TYPES), "unknown-type")
        .when(is_stage & ~known("e.stage", STAGES), "unknown-stage").when(is_stage & ~known("e.status", RUNNING + ENDED), "unknown-status")
    )
    progress = F.when(~F.isnan("e.progress"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "e.progress")))
    return read.select("value", "e.type", "e.run_id", "e.stage", "e.status", progress.alias("progress"), clean_message(F.col("e.message")).alias("message"), reason.alias("reason"))


def active_stage(events: DataFrame) -> DataFrame:
    """events (run_id, seq, stage, status) -> the last of the stages, in their order, that runs, and the number that have ended, by run. Unknown stages do not count."""
    latest = events.filter(F.col("stage").isin(*STAGES)).groupBy("run_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    runs, place = F.col("status").isin(*RUNNING), F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return latest.groupBy("run_id").agg(F.max_by(F.when(runs, F.col("stage")), F.when(runs, place)).alias("active"), F.count_if(F.col("status").isin(*ENDED)).alias("finished"))


#: A run that says nothing for this long is forgotten, in milliseconds.
FORGET = 120_000
RUN = "run_id string, status string, stages string, finished int, progress double, warnings int, ended boolean"


def _after(state: dict, event: dict) -> dict:
    """The state of a run after one more event; what comes after the end changes nothing."""
    if state["status"] in ("complete", "error"):
        return state
    kind = event["type"]
    if kind == "preview":
        state["status"] = "preview"
    elif kind == "error":
        state["status"] = "error"
    elif kind == "complete":
        state["status"] = "complete"
        state["stages"] = {k: ("done", 1.0) if s in RUNNING else (s, p) for k, (s, p) in state["stages"].items()}
    elif kind == "stage":
        before = state["stages"].get(event["stage"], (None, None))[1]
        status, progress = event["status"], event["progress"]
        state["stages"][event["stage"]] = (status, 1.0 if status == "done" else progress if status == "start" else before if progress is None or status != "progress" else progress)
        if status == "warning" and event["message"] and event["message"] not in state["warnings"]:
            state["warnings"] = [*state["warnings"], event["message"]][-20:]
    return state


def _shown(run: str, state: dict) -> tuple:
    known = [s for s in STAGES if s in state["stages"]] + sorted(s for s in state["stages"] if s not in STAGES)
    shares = [p if p is not None else 0.0 for _, p in state["stages"].values()]
    ended = sum(s in ENDED for s, _ in state["stages"].values())
    return run, state["status"], ",".join(f"{s}={state['stages'][s][0]}" for s in known), ended, float(sum(shares) / len(shares)) if shares else 0.0, len(state["warnings"]), state["status"] in ("complete", "error")


def run_state(events: DataFrame) -> DataFrame:
    """events (run_id, seq, type, stage, status, progress, message) -> a row for each run and batch: its status, its stages' statuses, how many have ended, mean progress, warnings.

    The state of a run is that of its stages; it goes once the run has said nothing for two minutes. In a batch the rows of a run are taken in the order of seq.
    Events after the end of a run change nothing; stages that still run when it completes are done.
    """
    fields = ("type", "stage", "status", "progress", "message")

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {"status": "loading", "stages": {}, "warnings": []}
        now["stages"] = {k: tuple(v) for k, v in now["stages"].items()}
        rows = pd.concat(list(parts)).sort_values("seq")
        for values in rows[list(fields)].itertuples(index=False, name=None):
            now = _after(now, {k: None if v is None or v != v else v for k, v in zip(fields, values)})
        state.update((json.dumps(now),))
        state.setTimeoutDuration(FORGET)
        yield pd.DataFrame([_shown(key[0], now)], columns=[c.split()[0] for c in RUN.split(", ")])

    return events.groupBy("run_id").applyInPandasWithState(take, RUN, "state string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_state_batch(events: DataFrame) -> DataFrame:
    """The last state of each run of a finished log."""
    fields = ("type", "stage", "status", "progress", "message")

    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now = {"status": "loading", "stages": {}, "warnings": []}
        for values in rows.sort_values("seq")[list(fields)].itertuples(index=False, name=None):
            now = _after(now, {k: None if v is None or v != v else v for k, v in zip(fields, values)})
        return pd.DataFrame([_shown(key[0], now)], columns=[c.split()[0] for c in RUN.split(", ")])

    return events.groupBy("run_id").applyInPandas(take, RUN)


def replay(df: DataFrame, stream, key: str, mode: str = "append") -> DataFrame:
    """What a stream over df's rows gives: they are written to the shared folder, read as a stream until all are taken, and what it wrote is reread.

    mode append: the stream appends files. mode update or complete: every batch replaces the rows with the same key columns, comma-joined in `key`, as an upserting sink does.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    made = stream(source)
    writer = made.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("append").parquet(f"{base}/out")).start()
    query.awaitTermination()
    out = spark.read.schema(made.schema if mode == "append" else T.StructType([*made.schema.fields, T.StructField("_batch", T.LongType())])).parquet(f"{base}/out")
    if mode == "append":
        return out
    keys = key.split(",")
    rest = [c for c in made.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def commit_counts(commits: DataFrame, unit: str = "1 day", late: str = "7 days") -> DataFrame:
    """Commits of each repository and UTC bucket; weeks (7 days) start on Monday. commits: repo_id, date."""
    offset = "4 days" if unit == "7 days" else "0 seconds"
    timed = commits.withWatermark("date", late) if commits.isStreaming else commits
    return timed.groupBy("repo_id", F.window("date", unit, startTime=offset)).agg(F.count("*").alias("commits")).select("repo_id", F.col("window.start").alias("bucket_start"), "commits")


def trailing_windows(commits: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """Commits and distinct authors of the trailing days, one row for each day. State is bounded by the watermark."""
    timed = commits.withWatermark("date", late) if commits.isStreaming else commits
    return timed.groupBy("repo_id", F.window("date", f"{days} days", "1 day")).agg(F.count("*").alias("commits"), F.approx_count_distinct("author_name").alias("authors")).select("repo_id", F.col("window.end").alias("cursor"), "commits", "authors")


def author_days(commits: DataFrame, late: str = "7 days") -> DataFrame:
    """repo_id, author_name, day: each author's days with commits, once each. A stream keeps them until the watermark has passed the day."""
    days = commits.select("repo_id", "author_name", F.date_trunc("day", "date").alias("day"))
    return (days.withWatermark("day", late) if commits.isStreaming else days).dropDuplicates(["repo_id", "author_name", "day"])


def trailing_totals(days: DataFrame, counts: DataFrame, widths: tuple[int, ...] = (7, 30, 90, 365)) -> DataFrame:
    """days (from author_days), counts (repo_id, day, commits) -> repo_id, width, cursor, commits, authors: exact numbers of the trailing days up to each cursor, where there are any.

    An author counts from a day with commits until the next one, or until the day leaves the window: one more at the one, one less at the other. So distinct
    authors are a running sum of few changes, however wide the window is.
    """
    widths_of = F.explode(F.array(*map(F.lit, widths))).alias("width")
    after = F.lead("day").over(Window.partitionBy("repo_id", "author_name").orderBy("day"))
    a = days.withColumn("next", after).select("repo_id", "day", "next", widths_of).withColumn("ends", F.least("next", F.expr("day + make_dt_interval(width)")))
    c = counts.select("repo_id", "day", "commits", widths_of)
    change = lambda df, day, commits, authors: df.select("repo_id", "width", day.alias("day"), commits.cast("long").alias("commits"), authors.cast("long").alias("authors"))
    none, one, day, gone = F.lit(0), F.lit(1), F.col("day"), F.expr("day + make_dt_interval(width)")
    changes = change(a, day, none, one).unionByName(change(a, F.col("ends"), none, -one)).unionByName(change(c, day, F.col("commits"), none)).unionByName(change(c, gone, -F.col("commits"), none))
    changes = changes.groupBy("repo_id", "width", "day").agg(F.sum("commits").alias("commits"), F.sum("authors").alias("authors"))
    span = changes.groupBy("repo_id", "width").agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    upto = Window.partitionBy("repo_id", "width").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    sums = span.join(changes, ["repo_id", "width", "day"], "left").select("repo_id", "width", "day", *[F.sum(F.coalesce(x, F.lit(0))).over(upto).alias(x) for x in ("commits", "authors")])
    return sums.filter("commits > 0").select("repo_id", "width", (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("cursor"), "commits", "authors")


def dedupe_commits(commits: DataFrame, late: str = "7 days") -> DataFrame:
    """One row of each sha; in a stream, within the watermark."""
    if commits.isStreaming:
        return commits.withWatermark("date", late).dropDuplicatesWithinWatermark(["repo_id", "sha"])
    return commits.dropDuplicates(["repo_id", "sha"])


def latest_activity(changes: DataFrame) -> DataFrame:
    """Last change and number of commits of each path; in update mode a sink upserts the rows. changes: repo_id, path, sha, date, author; ties of time go to the largest sha."""
    return changes.groupBy("repo_id", "path").agg(F.max("date").alias("last_modified"), F.max_by("author", F.struct("date", "sha")).alias("last_author"), F.count("*").alias("commit_count"))


def route_late(commits: DataFrame, path: str, late: str = "7 days"):
    """Writer of a stream of commits (repo_id, date, ...) that puts rows on time under path/kept and those that come too late under path/late.

    A row is late if its repository has had, in an earlier batch, a row that is newer by more than `late`. The newest date of each repository and batch is kept
    under path/marks, a row each. Everything a batch writes is in folders of its number, which a repeated batch writes anew: so a batch that is tried again gives the same.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = settle(batch, "late-batch")  # read several times
        none = spark.createDataFrame([], "repo_id string, newest timestamp, batch long")
        marks = spark.read.schema(none.schema).parquet(f"{path}/marks").filter(F.col("batch") < number) if number else none
        before = marks.groupBy("repo_id").agg(F.max("newest").alias("newest"))
        is_late = F.coalesce(F.col("date") < F.col("newest") - F.expr(f"INTERVAL {late}"), F.lit(False))
        judged = batch.join(before, "repo_id", "left").withColumn("is_late", is_late)
        for name, rows in (("kept", judged.filter("NOT is_late")), ("late", judged.filter("is_late"))):
            rows.drop("newest", "is_late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.groupBy("repo_id").agg(F.max("date").alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return commits.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint")


def late_commits(commits: DataFrame, window_start) -> tuple[DataFrame, DataFrame]:
    """Commits from the start of the kept window on, and those before it, which go to a side table."""
    return commits.filter(F.col("date") >= window_start), commits.filter(F.col("date") < window_start)


def token_bucket(requests: DataFrame, capacity: float, per_minute: float) -> DataFrame:
    """requests (client_key, request_id, ts) -> request_id, client_key, allowed, retry_after_ms. A bucket refills all the time; a request takes one token.

    The state of a client is its tokens and the time they were counted. Requests of a batch are taken in the order of time; clients
    without requests for as long as a refill takes are forgotten, which changes nothing, as their bucket would be full.
    """
    per_ms = per_minute / 60_000
    forget = int(capacity / per_ms) + 1000

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "request_id"])
        out = []
        for request, ts in zip(rows["request_id"], rows["ts"]):
            now = ts.value / 1e6
            tokens = tokens if at is None else min(capacity, tokens + max(0.0, now - at) * per_ms)
            at = now
            if tokens >= 1:
                tokens -= 1
                out.append((request, key[0], True, 0))
            else:
                out.append((request, key[0], False, int(-(-(1 - tokens) // per_ms))))
        state.update((tokens, at))
        state.setTimeoutDuration(forget)
        yield pd.DataFrame(out, columns=["request_id", "client_key", "allowed", "retry_after_ms"])

    return requests.groupBy("client_key").applyInPandasWithState(take, "request_id long, client_key string, allowed boolean, retry_after_ms long", "tokens double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)
