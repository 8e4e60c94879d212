"""More registered queries: ingestion, fetch plans, reports, timelines, symbols, emphasis, layout, resolution and streams."""

from __future__ import annotations

import uuid
from contextlib import suppress
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.jsonc import plain_json
from ..operators import budgets as B
from ..operators import ecmascript as ES
from ..operators import emphasis as M
from ..operators import graph as G
from ..operators import history as H
from ..operators import layout as L
from ..operators import modules as MO
from ..operators import report as RE
from ..operators import rollups as R
from ..operators import scores as S
from ..operators import symbols as SY
from ..shared import shared_dir
from ..sources import ingest as I
from ..sources import sinks as SK
from ..streaming import events as ST
from . import queries as Q
from .queries import ACTIVITY, AUTHORED, BUCKETS, CHANGES, CONNECTED, COUNTED, ENDS, INV, ORDERED, PEOPLE, ROLLED, changes, classified, counted, cursor, event_lines, inventory, micros, states
from .registry import query, typed

# --- ingestion -----------------------------------------------------------------------------------------------------------

RAW = """CASE WHEN event_id % 9 = 0 THEN concat('{"sha":"xyz","commit":{"author":{"date":"2024-01-01T00:00:00Z"}}}') ELSE concat('{"sha":"', upper(lpad(CAST(event_id AS VARCHAR(40)), 40, 'a')), '","commit":{"message":"', event_type, ' line\\nrest","author":{"name":"  Name  ', CAST(user_id AS VARCHAR(20)), ' "',
  CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"date":"2024-02-03T04:05:06+01:00"' END, '},"committer":{"date":"2024-03-01T00:00:00Z"}},"author":{"login":"', CASE WHEN event_id % 5 = 0 THEN '-bad-' ELSE concat('user', CAST(user_id AS VARCHAR(20))) END,
  '"},"stats":{"additions":', CAST(event_id % 10 AS VARCHAR(5)), ',"deletions":1},"files":[{"filename":"src/a', CAST(event_id % 3 AS VARCHAR(5)), '.ts"},{"filename":"../up"},{"filename":"src/a', CAST(event_id % 3 AS VARCHAR(5)), '.ts"},{"filename":"b.py"}]}') END"""


def raw_commits(v) -> DataFrame:
    return v("events").select(F.concat(F.lit("fx:"), (F.col("user_id") % 4).cast("string")).alias("repo_id"), F.expr(RAW.replace("\\n", "\\\\n")).alias("payload"))


query("flatten_commits", """SELECT concat('fx:', user_id % 4) AS repo_id, lpad(CAST(event_id AS VARCHAR), 40, 'a') AS sha, concat(event_type, ' line') AS message, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('user', user_id) END AS author_login,
  concat('Name ', user_id) AS author_name, CASE WHEN event_id % 4 = 0 THEN '2024-03-01T00:00:00.000Z' ELSE '2024-02-03T03:05:06.000Z' END AS date, CAST(event_id % 10 AS BIGINT) AS additions, CAST(1 AS BIGINT) AS deletions FROM events WHERE event_id % 9 <> 0""")(
    lambda v: I.flatten_commits(raw_commits(v)))
query("flatten_commit_files", """SELECT concat('fx:', user_id % 4) AS repo_id, lpad(CAST(event_id AS VARCHAR), 40, 'a') AS sha, unnest([concat('src/a', event_id % 3, '.ts'), 'b.py']) AS path FROM events WHERE event_id % 9 <> 0""")(
    lambda v: I.flatten_commit_files(raw_commits(v)))
query("ingest_contributors", """SELECT repo_id, login, contributions, row_number() OVER (PARTITION BY repo_id ORDER BY contributions DESC, ordinal) AS place FROM (
  SELECT concat('fx:', c_custkey % 4) AS repo_id, min(c_custkey) AS ordinal, arg_min(CASE WHEN c_custkey % 2 = 0 THEN concat('User-', CAST(floor(c_custkey / 8) AS BIGINT)) ELSE concat('user-', CAST(floor(c_custkey / 8) AS BIGINT)) END, c_custkey) AS login, arg_min(CAST(floor(abs(c_acctbal)) AS BIGINT), c_custkey) AS contributions
  FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_custkey % 4, CAST(floor(c_custkey / 8) AS BIGINT))""")(
    lambda v: I.ingest_contributors(v("customer").selectExpr("concat('fx:', c_custkey % 4) AS repo_id", "c_custkey AS ordinal", "CASE WHEN c_custkey % 5 = 0 THEN concat('bad login ', c_custkey) WHEN c_custkey % 2 = 0 THEN concat('User-', c_custkey div 8) ELSE concat('user-', c_custkey div 8) END AS login", "CAST(floor(abs(c_acctbal)) AS BIGINT) AS contributions")))
query("classify_content", """SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2) THEN 'binary' ELSE 'text' END AS kind, CASE WHEN doc_id % 5 IN (1, 2) THEN -1 ELSE length(coalesce(text, '')) + CASE doc_id % 5 WHEN 4 THEN 3 ELSE 0 END END AS chars FROM documents""")(
    lambda v: I.classify_content(v("documents").selectExpr("doc_id", """CAST(CASE doc_id % 5 WHEN 1 THEN concat(x'6100', CAST(coalesce(text, '') AS BINARY)) WHEN 2 THEN concat(CAST(repeat(chr(1), 6000) AS BINARY), CAST(coalesce(text, '') AS BINARY))
      WHEN 3 THEN concat(x'EFBBBF', CAST(coalesce(text, '') AS BINARY)) WHEN 4 THEN concat(CAST(coalesce(text, '') AS BINARY), x'0C6109') ELSE CAST(coalesce(text, '') AS BINARY) END AS BINARY) AS content""")).select("doc_id", "kind", F.coalesce(F.length("text"), F.lit(-1)).alias("chars")))  # fmt: skip
query("preview_graph", "SELECT i.repo_id, i.path, CASE WHEN is_binary THEN 'binary' ELSE 'metadata-only' END AS status, CASE WHEN is_binary THEN 0 ELSE CAST(" + Q.ESTIMATE + " AS BIGINT) END AS lines, NOT is_binary AS lines_estimated FROM inv i SEMI JOIN fx_docs d ON d.repo_id = i.repo_id AND d.path = i.path", INV)(
    lambda v: I.preview_graph(inventory(v), v("fx_docs")))

# --- history and timelines -----------------------------------------------------------------------------------------------

query("derive_contributors", """SELECT repo_id, coalesce('login:' || lower(author_login), 'name:' || lower(trim(author_name))) AS who, count(*) AS commits, arg_min(coalesce(author_login, author_name), (-epoch_us(date), sha)) AS name FROM fx_commits GROUP BY ALL""")(
    lambda v: H.derive_contributors(v("fx_commits")))
query("derive_file_activity", """SELECT c.repo_id, path, epoch_us(max(date)) AS last_modified, arg_min(author_login, (-epoch_us(date), m.sha)) FILTER (WHERE author_login IS NOT NULL OR true) AS ignored FROM changes c JOIN fx_commits m ON m.repo_id = c.repo_id AND m.sha = c.sha GROUP BY ALL""".replace(", arg_min(author_login, (-epoch_us(date), m.sha)) FILTER (WHERE author_login IS NOT NULL OR true) AS ignored", ", arg_min(author_name, (-epoch_us(date), m.sha)) AS author_name"), CHANGES)(
    lambda v: micros(H.derive_file_activity(v("fx_commits"), changes(v)), "last_modified").select("repo_id", "path", "last_modified", "author_name"))
LOOKUPS = "lookups AS (SELECT repo_id, path, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 2000) AS at, concat('user:look', doc_id % 5) AS who FROM fx_docs WHERE doc_id % 3 = 0)"
query("file_activity_lookups", """SELECT coalesce(a.repo_id, l.repo_id) AS repo_id, coalesce(a.path, l.path) AS path, coalesce(commit_count, CASE WHEN l.at >= w.lo THEN 1 ELSE 0 END) AS commit_count, epoch_us(CASE WHEN l.at IS NOT NULL AND (last_modified IS NULL OR l.at > last_modified) THEN l.at ELSE last_modified END) AS last_modified,
  CASE WHEN l.at IS NOT NULL AND (last_modified IS NULL OR l.at > last_modified) THEN who ELSE last_author_id END AS last_author_id FROM activity a FULL JOIN lookups l ON l.repo_id = a.repo_id AND l.path = a.path
  LEFT JOIN (SELECT repo_id, min(date) AS lo FROM fx_commits GROUP BY repo_id) w ON w.repo_id = coalesce(a.repo_id, l.repo_id)""", AUTHORED, CHANGES, ACTIVITY, LOOKUPS)(
    lambda v: micros(H.file_activity(v("fx_commits"), changes(v), v("fx_docs").filter("doc_id % 3 = 0").selectExpr("repo_id", "path", "TIMESTAMP '2024-01-01' + make_dt_interval(0, CAST(doc_id % 2000 AS INT)) AS last_modified", "concat('user:look', doc_id % 5) AS author_id")), "last_modified").drop("contributors"))
query("contributor_files", "SELECT repo_id, author_id AS id, string_agg(path, '|' ORDER BY path) AS paths FROM (SELECT DISTINCT c.repo_id, author_id, path FROM changes c JOIN authored a ON a.repo_id = c.repo_id AND a.sha = c.sha WHERE author_id IS NOT NULL) GROUP BY ALL", AUTHORED, CHANGES)(
    lambda v: H.contributor_files(v("fx_commits"), changes(v)).withColumn("paths", F.array_join("paths", "|")))
query("activity_range", "SELECT repo_id, epoch_us(min(last_modified)) AS first, epoch_us(max(last_modified)) AS last FROM activity GROUP BY repo_id", AUTHORED, CHANGES, ACTIVITY)(
    lambda v: micros(S.activity_range(H.file_activity(v("fx_commits"), changes(v))), "first", "last"))
query("bucket_commits_by_day", """SELECT s.repo_id, epoch_us(d) AS bucket_start, count(c.sha) AS commits FROM (SELECT repo_id, unnest(range(date_trunc('day', min(date))::TIMESTAMP, date_trunc('day', max(date))::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM fx_commits GROUP BY repo_id) s
  LEFT JOIN fx_commits c ON c.repo_id = s.repo_id AND date_trunc('day', c.date) = d GROUP BY s.repo_id, d""")(lambda v: micros(H.bucket_commits(v("fx_commits"), "day"), "bucket_start").select("repo_id", "bucket_start", "commits"))
query("full_history_counts", """SELECT r.repo_id, epoch_us(m) AS start, count(c.sha) AS commits FROM (SELECT repo_id, unnest(range(date_trunc('year', min(date))::TIMESTAMP, date_trunc('week', max(date))::TIMESTAMP + INTERVAL 7 DAY, INTERVAL 7 DAY)) AS d FROM fx_commits GROUP BY repo_id) x, LATERAL (SELECT x.repo_id, date_trunc('week', d)::TIMESTAMP AS m) r
  LEFT JOIN fx_commits c ON c.repo_id = r.repo_id AND c.date >= m AND c.date < m + INTERVAL 7 DAY GROUP BY r.repo_id, m""")(
    lambda v: micros(H.full_history_counts(v("fx_commits").groupBy("repo_id").agg((F.max("date") - F.expr("INTERVAL 20 DAYS")).alias("created"), F.max("date").alias("end")), v("fx_commits")), "start").select("repo_id", "start", "commits"))
EXACT = "SELECT repo_id, 'month' AS granularity, TIMESTAMP '2024-01-01' AS bucket_start, TIMESTAMP '2024-02-01' AS bucket_end, count(*) AS commits FROM fx_commits WHERE repo_id IN ('fx:0', 'fx:2') GROUP BY repo_id"
query("build_timeline", f"""SELECT repo_id, granularity, 'full-history' AS coverage, epoch_us(bucket_start) AS bucket_start, commits, epoch_us(bucket_end) AS end FROM ({EXACT})
  UNION ALL SELECT repo_id, granularity, 'sampled', epoch_us(bucket_start), commits, epoch_us(max(bucket_end) OVER (PARTITION BY repo_id)) FROM buckets WHERE repo_id NOT IN ('fx:0', 'fx:2')""", BUCKETS)(
    lambda v: micros(H.build_timeline(v("fx_commits").filter("repo_id IN ('fx:0', 'fx:2')").groupBy("repo_id").agg(F.count("*").alias("commits")).selectExpr("repo_id", "'month' AS granularity", "TIMESTAMP '2024-01-01' AS bucket_start", "TIMESTAMP '2024-02-01' AS bucket_end", "commits"), v("fx_commits")), "bucket_start", "end").select("repo_id", "granularity", "coverage", "bucket_start", "commits", "end"))
SPANS = [("2024-01-01", "2024-01-08"), ("2024-01-01 12:00:00", "2024-02-05"), ("2023-11-15", "2024-04-15"), ("2022-03-10", "2024-01-10"), ("2015-06-01", "2024-06-01")]
LABELS = ["Jan 3,Jan 5,Jan 7", "Jan 9,Jan 16,Jan 23,Jan 30", "Dec,2024,Feb,Mar,Apr", "Apr,Oct,Apr,Oct", "2016,2018,2020,2022,2024"]
query("axis_ticks", f"SELECT doc_id, {typed(LABELS, 'doc_id')} AS labels FROM documents")(lambda v: ticks(v))


def ticks(v) -> DataFrame:
    """Every document's span, which is one of five."""
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]).cast("timestamp") for s in SPANS]), (F.col("doc_id") % 5 + 1).cast("int"))
    t = H.axis_ticks(v("documents").select(F.col("doc_id").alias("repo_id"), pick(0).alias("start"), pick(1).alias("end")))
    return t.groupBy(F.col("repo_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "label"))), lambda x: x["label"]), ",").alias("labels"))


IN7 = "date > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND date <= TIMESTAMP '2024-01-20'"
query("window_stats", f"""SELECT o.repo_id, count(a.sha) AS commits, count(DISTINCT coalesce(a.author_id, concat('name:', a.author_name))) FILTER (WHERE a.sha IS NOT NULL) AS contributors, count(*) FILTER (WHERE a.has_details) AS with_details,
  CASE WHEN count(*) FILTER (WHERE a.has_details) > 0 THEN (SELECT count(DISTINCT path) FROM changes c SEMI JOIN (SELECT * FROM authored WHERE {IN7} AND has_details) w ON w.repo_id = c.repo_id AND w.sha = c.sha WHERE c.repo_id = o.repo_id)
    ELSE (SELECT count(*) FROM activity t WHERE t.repo_id = o.repo_id AND last_modified > TIMESTAMP '2024-01-13' AND last_modified <= TIMESTAMP '2024-01-20') END AS files_changed,
  CASE WHEN count(*) FILTER (WHERE a.has_details) > 0 THEN 'commits' ELSE 'activity' END AS basis, CASE WHEN o.repo_id <> 'fx:1' THEN 'full' WHEN TIMESTAMP '2024-01-20' < lo THEN 'none' WHEN TIMESTAMP '2024-01-13' < lo THEN 'partial' ELSE 'full' END AS coverage
  FROM (SELECT repo_id, min(date) AS lo FROM fx_commits GROUP BY repo_id) o LEFT JOIN (SELECT * FROM authored WHERE {IN7}) a ON a.repo_id = o.repo_id GROUP BY o.repo_id, lo""", AUTHORED, CHANGES, ACTIVITY)(
    lambda v: H.window_stats(v("fx_commits"), changes(v), cursor(), 7, H.file_activity(v("fx_commits"), changes(v)), v("fx_commits").filter("repo_id = 'fx:1'").select("repo_id")))
query("largest_files_below", "SELECT repo_id, directory, path, lines, size, place FROM (SELECT repo_id, dir AS directory, path, lines, size, row_number() OVER (PARTITION BY repo_id, dir ORDER BY lines DESC, size DESC, path) AS place FROM (SELECT *, " + Q.UP.format(c="directory") + " AS dir FROM counted WHERE own)) WHERE place <= 5", INV, *COUNTED)(
    lambda v: R.largest_files_below(counted(v)).select("repo_id", "directory", "path", "lines", "size", "place"))

# --- reports -------------------------------------------------------------------------------------------------------------


def coverage(v) -> DataFrame:
    c = counted(v)
    return RE.coverage_report(inventory(v), c.filter("in_graph").select("repo_id", "status"), R.directory_rollup(c), v("fx_symbols"), states(v))


COVERAGE = f"""covered AS (SELECT r.repo_id, (SELECT count(*) FROM inv i WHERE i.repo_id = r.repo_id) AS files_in_repository, (SELECT CAST(sum(size) AS BIGINT) FROM inv i WHERE i.repo_id = r.repo_id) AS bytes_in_repository,
  f.*, (SELECT count(*) FROM rolled d WHERE d.repo_id = r.repo_id) AS directories_in_repository, (SELECT count(*) FROM fx_symbols s WHERE s.repo_id = r.repo_id) AS symbols_extracted, m.*
  FROM (SELECT DISTINCT repo_id FROM inv) r JOIN (SELECT repo_id AS k, count(*) AS files_in_graph, count(*) FILTER (WHERE status = 'parsed') AS files_parsed, CAST(0 AS BIGINT) AS files_partial, count(*) FILTER (WHERE status = 'content-only') AS files_content_only,
    count(*) FILTER (WHERE status = 'metadata-only') AS files_metadata_only, count(*) FILTER (WHERE status = 'binary') AS files_binary, CAST(0 AS BIGINT) AS files_failed FROM counted WHERE in_graph GROUP BY repo_id) f ON f.k = r.repo_id
  JOIN (SELECT repo_id AS l, count(*) AS imports_found, count(*) FILTER (WHERE s = 'resolved') AS imports_resolved, count(*) FILTER (WHERE s = 'external') AS external_imports, count(*) FILTER (WHERE s = 'unresolved') AS unresolved_imports FROM (SELECT repo_id, {Q.STATE} AS s FROM fx_imports) GROUP BY repo_id) m ON m.l = r.repo_id)"""
query("coverage", "SELECT * EXCLUDE (k, l) FROM covered", INV, *COUNTED, ROLLED, COVERAGE)(coverage)


def facts(v) -> DataFrame:
    """Coverage with what else the warnings look at; which repository is what depends on its number."""
    n = F.substring_index("repo_id", ":", -1).cast("int")
    return coverage(v).withColumns({
        "tier": F.when(n == 3, "directory-first").otherwise("full"), "truncated": n == 1, "skipped_parse_limit": F.when(n == 2, 7).otherwise(0), "skipped_byte_budget": F.when(n == 0, 1).otherwise(0), "eligible": F.col("files_parsed") + 7,
        "has_history": n != 3, "commits": F.when(n == 0, 300).otherwise(40), "with_details": F.when(n == 1, 10).otherwise(40), "languages": F.when(n == 0, F.array(*map(F.lit, "abcdefg"))).when(n == 1, F.array(F.lit("ruby"))).otherwise(F.array().cast("array<string>"))})


COMMA = "printf('{:,}', CAST({x} AS BIGINT))"
N = "CAST(right(repo_id, 1) AS INT)"
WARNED = f"""warned AS (SELECT repo_id, unnest(list_filter([
  CASE WHEN {N} = 1 THEN 'TREE_TRUNCATED=The file listing was truncated, so some files are missing.=' END, CASE WHEN {N} = 3 THEN 'LARGE_REPOSITORY=This repository is very large; a representative sample of files was analyzed.=' END,
  CASE WHEN files_in_graph < files_in_repository THEN concat('FILE_NODE_LIMIT=Showing ', format('{{:,}}', files_in_graph), ' of ', format('{{:,}}', files_in_repository), ' files.=shown:', files_in_graph, ',total:', files_in_repository) END,
  CASE WHEN {N} = 2 THEN concat('PARSE_LIMIT=Parsed ', format('{{:,}}', files_parsed), ' of ', format('{{:,}}', files_parsed + 7), ' eligible source files.=eligible:', files_parsed + 7, ',parsed:', files_parsed) END,
  CASE WHEN {N} = 0 THEN 'BYTE_LIMIT=The download budget was reached by 1 file.=files:1,maxTotalBytes:52428800' END,
  CASE WHEN {N} = 0 THEN 'UNSUPPORTED_LANGUAGES=No parser for: a, b, c, d, e and 2 more.=languages:7' WHEN {N} = 1 THEN 'UNSUPPORTED_LANGUAGES=No parser for: ruby.=languages:1' END,
  CASE WHEN {N} = 3 THEN 'HISTORY_UNAVAILABLE=Commit history could not be loaded.=' END,
  CASE WHEN {N} = 0 THEN 'HISTORY_LIMITED=Activity is based on the latest 300 commits; file-level activity on the latest 40.=commits:300,commitsWithDetails:40' WHEN {N} = 1 THEN 'HISTORY_LIMITED=Activity is based on the latest 40 commits; file-level activity on the latest 10.=commits:40,commitsWithDetails:10' END
  ], lambda w: w IS NOT NULL)) AS w FROM covered),
warnings AS (SELECT repo_id, string_split(w, '=')[1] AS code, string_split(w, '=')[2] AS message, string_split(w, '=')[3] AS detail FROM warned)"""
flat = lambda df: df.withColumn("detail", F.array_join(F.transform(F.array_sort(F.map_entries("detail")), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))
query("derive_warnings", "SELECT * FROM warnings", INV, *COUNTED, ROLLED, COVERAGE, WARNED)(lambda v: flat(RE.derive_warnings(facts(v))))
query("merge_warnings", """SELECT repo_id, code, message, row_number() OVER (PARTITION BY repo_id ORDER BY rank) AS place FROM (SELECT repo_id, code, arg_min(message, (src, message)) AS message, any_value(CASE code WHEN 'TREE_TRUNCATED' THEN 3 WHEN 'LARGE_REPOSITORY' THEN 4 WHEN 'FILE_NODE_LIMIT' THEN 5 WHEN 'PARSE_LIMIT' THEN 6 WHEN 'BYTE_LIMIT' THEN 8
    WHEN 'UNSUPPORTED_LANGUAGES' THEN 9 WHEN 'FETCH_FAILURES' THEN 11 WHEN 'HISTORY_UNAVAILABLE' THEN 12 WHEN 'HISTORY_LIMITED' THEN 13 ELSE 14 END) AS rank FROM (SELECT repo_id, code, message, 1 AS src FROM warnings UNION ALL SELECT DISTINCT repo_id, code, concat('given ', run_id % 3), 0 FROM fx_runs) GROUP BY repo_id, code)""", INV, *COUNTED, ROLLED, COVERAGE, WARNED)(
    lambda v: RE.merge_warnings(v("fx_runs").selectExpr("repo_id", "code", "concat('given ', run_id % 3) AS message", "CAST(map() AS map<string,string>) AS detail").dropDuplicates(["repo_id", "code", "message"]), RE.derive_warnings(facts(v))).drop("detail"))
query("repository_stats", """SELECT c.repo_id, files_in_repository, files_parsed + files_content_only AS files_analysed, files_parsed, symbols_extracted AS symbols, total_lines AS lines_of_code, lines_estimated, (SELECT count(*) FROM fx_edges e WHERE e.repo_id = c.repo_id) AS dependencies,
  (SELECT count(*) FROM packages p WHERE p.repo_id = c.repo_id) AS external_packages, (SELECT count(*) FROM fx_contributors p WHERE p.repo_id = c.repo_id) AS contributors FROM covered c JOIN rolled r ON r.repo_id = c.repo_id AND r.path = ''""", INV, *COUNTED, ROLLED, COVERAGE, classified("langs", "fx_docs"), Q.PACKAGES)(
    lambda v: RE.repository_stats(coverage(v), R.directory_rollup(counted(v)).filter("path = ''"), v("fx_edges"), Q.packages(v), v("fx_contributors")))
query("coverage_summary", f"""SELECT repo_id, CAST(place AS BIGINT) AS place, split_part(r, '=', 1) AS label, split_part(r, '=', 2) AS value, complete FROM (SELECT repo_id, complete, unnest(rows) AS r, generate_subscripts(rows, 1) AS place FROM (SELECT repo_id, false AS complete, list_filter([
  concat('Files in repository=', format('{{:,}}', files_in_repository), CASE WHEN {N} = 1 THEN '+' ELSE '' END), concat('Files in the graph=', format('{{:,}}', files_in_graph)), concat('Parsed=', format('{{:,}}', files_parsed)), CASE WHEN files_content_only > 0 THEN concat('Counted, no parser=', format('{{:,}}', files_content_only)) END,
  CASE WHEN files_metadata_only > 0 THEN concat('Size only (not downloaded)=', format('{{:,}}', files_metadata_only)) END, CASE WHEN files_binary > 0 THEN concat('Binary=', format('{{:,}}', files_binary)) END, concat('Symbols extracted=', format('{{:,}}', symbols_extracted)),
  concat('Internal imports resolved=', format('{{:,}}', imports_resolved), ' of ', format('{{:,}}', greatest(imports_found - external_imports, imports_resolved))), CASE WHEN {N} = 0 THEN 'Commits analysed=300' ELSE 'Commits analysed=40' END], lambda x: x IS NOT NULL) AS rows FROM covered))""", INV, *COUNTED, ROLLED, COVERAGE)(
    lambda v: RE.coverage_summary(facts(v).withColumn("codes", F.array(F.lit("HISTORY_LIMITED")))))
query("stage_rows_from_coverage", f"""SELECT repo_id, CAST(generate_subscripts(m, 1) AS BIGINT) AS place, unnest(['connect', 'tree', 'languages', 'fetch', 'parse', 'dependencies', 'history', 'construct']) AS stage, unnest(m) AS message FROM (SELECT repo_id, ['Repository found', concat(format('{{:,}}', files_in_repository), ' files', CASE WHEN {N} = 1 THEN ' · listing truncated' ELSE '' END),
  CASE WHEN {N} = 2 THEN 'No recognized languages' ELSE 'Rust 62%' END, 'Cached', concat(format('{{:,}}', files_parsed), ' files parsed · cached'), concat(format('{{:,}}', imports_found), ' imports · ', format('{{:,}}', imports_resolved), ' resolved'), CASE {N} WHEN 0 THEN '300 commits · 1 contributor' ELSE '40 commits' END, 'Complete'] AS m FROM covered)""", INV, *COUNTED, ROLLED, COVERAGE)(
    lambda v: RE.stage_rows(facts(v).withColumns({"language": F.when(F.col("repo_id") != "fx:2", "Rust"), "language_share": F.lit(0.6172), "contributors": F.when(F.col("repo_id") == "fx:0", 1).otherwise(0)})))
query("low_quota", "SELECT run_id FROM fx_runs WHERE remaining < 500")(lambda v: RE.low_quota(v("fx_runs")).select("run_id"))
query("degraded_analyses", """SELECT run_id, minutes_ago >= 15 AS expired FROM fx_runs WHERE run_id % 9 = 0 OR (run_id % 9 = 1 AND run_id % 2 = 1) OR (run_id % 9 = 2 AND run_id % 2 = 0) OR run_id % 9 = 3""")(
    lambda v: RE.degraded_analyses(v("fx_runs").selectExpr("run_id", "TIMESTAMP '2024-01-01 12:00:00' - make_dt_interval(0, 0, CAST(minutes_ago AS INT)) AS generated_at"), v("fx_runs").selectExpr("run_id", "code", "map(detail_key, detail_value) AS detail"), F.expr("TIMESTAMP '2024-01-01 12:00:00'")).select("run_id", "expired"))
query("run_summary", "SELECT outcome, cached, count(*) AS runs, CAST(sum(files) AS BIGINT) AS files, CAST(sum(failures) AS BIGINT) AS failures, round(avg(duration_ms), 4) AS mean_ms, round(quantile_cont(duration_ms, 0.5), 4) AS median_ms FROM fx_runs GROUP BY ALL")(
    lambda v: RE.run_summary(v("fx_runs")).withColumns({c: F.round(c, 4) for c in ("mean_ms", "median_ms")}))
query("stage_timings", """SELECT run_id, unnest(CASE WHEN run_id % 2 = 0 THEN [1, 2, 3] ELSE [1, 2] END)::BIGINT AS place, unnest(CASE WHEN run_id % 2 = 0 THEN ['tree', 'parse', 'extra'] ELSE ['tree', 'extra'] END) AS stage, unnest(CASE WHEN run_id % 2 = 0 THEN [2.0, duration_ms, 1.0] ELSE [2.0, 1.0] END)::DOUBLE AS ms FROM fx_runs""")(
    lambda v: RE.stage_timings(v("fx_runs").selectExpr("run_id", "map('extra', 1.0D, 'parse', CASE WHEN run_id % 2 = 0 THEN duration_ms ELSE double('NaN') END, 'tree', 2.0D, 'fetch', -1.0D) AS timings")))
NOTES = """CASE WHEN p.files > 0 THEN NULL WHEN coalesce(theirs, 0) = 0 AND p.repo_id = 'fx:1' THEN concat('No file changes in the analysed window: only the latest ', format('{:,}', h.n), ' commits were examined.')
  WHEN coalesce(theirs, 0) = 0 THEN concat('No file changes in the analysed history: none of its ', format('{:,}', h.n), ' commits are theirs.') WHEN coalesce(detailed, 0) > 0 THEN 'No changes to files in this view: those that their commits changed were deleted or are not shown.'
  ELSE concat('No file changes in the analysed window: file details were fetched for only the latest ', format('{:,}', h.d), ' commits, and none are theirs.') END"""
query("contributor_notes", f"""SELECT p.repo_id, p.id, {NOTES} AS note FROM people p LEFT JOIN (SELECT repo_id, author_id, count(*) AS theirs, count(*) FILTER (WHERE has_details) AS detailed FROM authored GROUP BY ALL) o ON o.repo_id = p.repo_id AND o.author_id = p.id
  JOIN (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE has_details) AS d FROM fx_commits GROUP BY repo_id) h ON h.repo_id = p.repo_id""", AUTHORED, CHANGES, PEOPLE)(
    lambda v: RE.contributor_notes(H.contributors(v("fx_commits"), v("fx_contributors"), changes(v), 1 << 30), H.with_authors(v("fx_commits")), H.history_summary(v("fx_commits"), H.file_activity(v("fx_commits"), changes(v))).withColumn("truncated", F.col("repo_id") == "fx:1")))
WINDOWS = [None, "the latest 1 commit (Jan 1, 2024 – Jan 2, 2024); file-level details were not fetched", "file details of the latest 2 commits (of 1,200 commits read (Jan 1, 2024 – Jan 2, 2024))", "the latest 5 commits"]
LIMITS = ["History limited. No commits were read.", "History limited: no token configured. Activity covers the latest commit, without file changes.", "History limited: time budget reached. Activity covers the latest 1,200 commits, with file changes from the latest 2 commits.", "History limited: quota running low. Activity covers the latest 5 commits."]
query("history_notes", f"SELECT doc_id, {typed(WINDOWS, 'doc_id')} AS \"window\", {typed(LIMITS, 'doc_id')} AS \"limit\" FROM documents")(
    lambda v: RE.history_notes(v("documents").selectExpr("doc_id AS repo_id", "element_at(array(0, 1, 1200, 5), CAST(doc_id % 4 + 1 AS INT)) AS commits", "element_at(array(0, 0, 2, 5), CAST(doc_id % 4 + 1 AS INT)) AS with_details", "CASE WHEN doc_id % 4 IN (1, 2) THEN TIMESTAMP '2024-01-01' END AS oldest", "TIMESTAMP '2024-01-02' AS newest", "element_at(array(NULL, 'unauthenticated', 'time-budget', 'low-quota'), CAST(doc_id % 4 + 1 AS INT)) AS reason")).withColumnRenamed("repo_id", "doc_id"))

# --- fetch plans ---------------------------------------------------------------------------------------------------------

BYTES, PARSE, FILE, PARSED = 400_000, 3000, 8000, 60
CFG = Q.CONFIG + " AND category <> 'vendor' AND NOT is_binary AND size <= 262144"


def _greedy(name: str, source: str, room: str) -> str:
    """A recursive pass over `source` (repo_id, path, place, cost) with a first room by repository."""
    return f"""{name} AS (SELECT s.repo_id, s.path, s.place, s.cost <= r.room AS took, CASE WHEN s.cost <= r.room THEN r.room - s.cost ELSE r.room END AS room FROM {source} s JOIN {room} r ON r.repo_id = s.repo_id WHERE s.place = 1
  UNION ALL SELECT s.repo_id, s.path, s.place, s.cost <= g.room, CASE WHEN s.cost <= g.room THEN g.room - s.cost ELSE g.room END FROM {name} g JOIN {source} s ON s.repo_id = g.repo_id AND s.place = g.place + 1)"""


PLAN = (
    f"cfg AS (SELECT repo_id, path, size, size AS cost, row_number() OVER (PARTITION BY repo_id ORDER BY depth, path) AS place FROM inv WHERE {CFG})", f"room0 AS (SELECT DISTINCT repo_id, {BYTES} AS room FROM inv)", _greedy("g1", "cfg", "room0"),
    "picked1 AS (SELECT g.*, c.size FROM g1 g JOIN cfg c ON c.repo_id = g.repo_id AND c.path = g.path WHERE took QUALIFY row_number() OVER (PARTITION BY g.repo_id ORDER BY g.place) <= 300)",
    f"""graphed AS (SELECT i.*, p.path IS NOT NULL AS config, CASE WHEN i.is_binary THEN 'binary' WHEN i.is_generated OR i.category = 'vendor' THEN 'generated' WHEN parser_language IS NOT NULL AND i.size <= {PARSE} THEN 'parse' WHEN p.path IS NOT NULL THEN 'free'
  WHEN parser_language IS NOT NULL AND i.size <= {FILE} THEN 'oversized' WHEN parser_language IS NOT NULL THEN 'size-limit' WHEN i.size <= {FILE} THEN 'text' ELSE 'not-parseable' END AS class, CASE WHEN i.repo_id = 'fx:3' THEN 'directory-first' WHEN i.repo_id = 'fx:2' THEN 'progressive' ELSE 'full' END AS tier
  FROM inv i SEMI JOIN chosen d ON d.repo_id = i.repo_id AND d.path = i.path LEFT JOIN picked1 p ON p.repo_id = i.repo_id AND p.path = i.path)""",
    """cand AS (SELECT repo_id, path, size, size AS cost, tier, row_number() OVER (PARTITION BY repo_id ORDER BY grp, round, area) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, grp, area ORDER BY depth, path) AS round FROM (SELECT *, CASE WHEN category = 'test' THEN 3 WHEN category = 'source' AND NOT list_has_any(segs, ['docs', 'examples']) THEN 1 ELSE 2 END AS grp,
    CASE WHEN len(segs) = 0 THEN '' WHEN len(segs) > 1 AND segs[1] = 'packages' THEN concat(segs[1], '/', segs[2]) ELSE segs[1] END AS area FROM graphed WHERE class = 'parse')))""",
    f"room1 AS (SELECT r.repo_id, r.room - coalesce((SELECT sum(size) FROM picked1 p WHERE p.repo_id = r.repo_id), 0) AS room FROM room0 r)", _greedy("g2", "cand", "room1"),
    f"tried2 AS (SELECT g.*, c.size, coalesce(sum(took::INT) OVER (PARTITION BY g.repo_id ORDER BY g.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {PARSED} AS late FROM g2 g JOIN cand c ON c.repo_id = g.repo_id AND c.path = g.path)",
    "cont AS (SELECT repo_id, path, size AS cost, tier, class, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN class = 'oversized' THEN -1 ELSE CASE category WHEN 'source' THEN 0 WHEN 'test' THEN 1 WHEN 'config' THEN 2 WHEN 'style' THEN 2 WHEN 'docs' THEN 3 ELSE 5 END END, depth, path) AS place FROM graphed WHERE class IN ('oversized', 'text'))",
    "room2 AS (SELECT r.repo_id, r.room - coalesce((SELECT sum(size) FROM tried2 p WHERE p.repo_id = r.repo_id AND took AND NOT late), 0) AS room FROM room1 r)", _greedy("g3", "cont", "room2"),
    "tried3 AS (SELECT g.*, c.class, coalesce(sum(took::INT) OVER (PARTITION BY g.repo_id ORDER BY g.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= CASE tier WHEN 'full' THEN 1500 WHEN 'progressive' THEN 300 ELSE 0 END AS late FROM g3 g JOIN cont c ON c.repo_id = g.repo_id AND c.path = g.path)",
    """planned AS (SELECT repo_id, path, 'config' AS step, place, NULL AS reason FROM picked1 UNION ALL SELECT repo_id, path, 'parse', row_number() OVER (PARTITION BY repo_id ORDER BY place), NULL FROM tried2 WHERE took AND NOT late
  UNION ALL SELECT repo_id, path, 'content', row_number() OVER (PARTITION BY repo_id ORDER BY ord, turn, path), NULL FROM (SELECT repo_id, path, 0 AS ord, depth AS turn FROM graphed WHERE class = 'free' UNION ALL SELECT repo_id, path, 1, place FROM tried3 WHERE took AND NOT late)
  UNION ALL SELECT repo_id, path, NULL, NULL, class FROM graphed WHERE class IN ('binary', 'generated', 'size-limit', 'not-parseable') UNION ALL SELECT repo_id, path, NULL, NULL, CASE WHEN late THEN 'parse-limit' ELSE 'byte-budget' END FROM tried2 WHERE late OR NOT took
  UNION ALL SELECT repo_id, path, NULL, NULL, CASE WHEN late THEN CASE WHEN class = 'oversized' THEN 'size-limit' ELSE 'not-selected' END ELSE 'byte-budget' END FROM tried3 WHERE late OR NOT took)""",
)
CHOSEN = "chosen AS (SELECT repo_id, path FROM inv WHERE length(path) % 17 <> 0)"


def plan(v) -> DataFrame:
    i = inventory(v)
    chosen = i.filter(F.length("path") % 17 != 0)
    tiers = i.select("repo_id").distinct().withColumn("tier", F.when(F.col("repo_id") == "fx:3", "directory-first").when(F.col("repo_id") == "fx:2", "progressive").otherwise("full"))
    return B.fetch_plan(i, chosen, tiers, R.is_config(), BYTES, PARSE, FILE, PARSED)


query("fetch_plan", "SELECT * REPLACE (coalesce(place, 0) AS place) FROM planned", INV, CHOSEN, *PLAN)(lambda v: plan(v).fillna(0, ["place"]))
query("skip_reason_counts", "SELECT repo_id, reason, count(*) AS files FROM planned WHERE reason IS NOT NULL GROUP BY ALL", INV, CHOSEN, *PLAN)(lambda v: RE.skip_reason_counts(plan(v).filter("reason IS NOT NULL")))
query("download_plan", "SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY s, p) AS place FROM (SELECT repo_id, path, min(s * 1000000 + place) % 1000000 AS p, min(s) AS s FROM (SELECT *, CASE step WHEN 'config' THEN 0 WHEN 'parse' THEN 1 ELSE 2 END AS s FROM planned WHERE step IS NOT NULL) GROUP BY repo_id, path)", INV, CHOSEN, *PLAN)(
    lambda v: B.download_plan(plan(v)))
query("interleave", f"SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY round, directory) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, directory ORDER BY size DESC, path) AS round FROM inv)", INV)(
    lambda v: B.interleave(inventory(v), ["repo_id"], "directory", [F.desc("size"), "path"]).select("repo_id", "path", "place"))
query("extraction_drops", f"""SELECT repo_id, path, count(*) - 20 AS dropped FROM fx_symbols GROUP BY ALL HAVING count(*) > 20""")(lambda v: B.extraction_drops(B.cap_extraction(Q.numbered(v), 20, 1 << 30)))
OUTCOME = "CASE doc_id % 11 WHEN 0 THEN 'ok' WHEN 1 THEN 'errors' WHEN 2 THEN 'no-parser' WHEN 3 THEN 'crash' WHEN 4 THEN 'limited' END"
FETCH = "CASE doc_id % 11 WHEN 5 THEN 'missing' WHEN 6 THEN 'too-large' WHEN 7 THEN 'binary' WHEN 3 THEN 'missing' END"
query("file_status", f"""SELECT i.repo_id, i.path, CASE doc_id % 11 WHEN 0 THEN 'parsed' WHEN 1 THEN 'partial' WHEN 2 THEN 'content-only' WHEN 3 THEN 'failed' WHEN 4 THEN 'partial' WHEN 5 THEN 'failed' WHEN 6 THEN 'metadata-only' WHEN 7 THEN 'binary' ELSE CASE WHEN is_binary THEN 'binary' ELSE 'metadata-only' END END AS status,
  CASE doc_id % 11 WHEN 3 THEN 'the parser failed' WHEN 4 THEN 'too many symbols' WHEN 5 THEN 'not found' WHEN 6 THEN 'larger than the limit' WHEN 8 THEN CASE WHEN is_binary THEN 'binary' ELSE 'parse-limit' END WHEN 9 THEN CASE WHEN is_binary THEN 'binary' ELSE 'not processed' END WHEN 10 THEN CASE WHEN is_binary THEN 'binary' ELSE 'not processed' END END AS reason,
  CASE WHEN doc_id % 11 <= 4 THEN 12 WHEN doc_id % 11 = 7 OR (doc_id % 11 >= 8 AND is_binary) THEN 0 ELSE CAST({Q.ESTIMATE.replace('size', 'i.size')} AS BIGINT) END AS lines, doc_id % 11 > 4 AND doc_id % 11 <> 7 AND NOT (doc_id % 11 >= 8 AND is_binary) AS lines_estimated
  FROM inv i JOIN fx_docs d ON d.repo_id = i.repo_id AND d.path = i.path""", INV)(
    lambda v: B.file_status(R.restrict_to_selected(inventory(v), v("fx_docs")), v("fx_docs").select("repo_id", "path", F.expr(FETCH).alias("outcome")).filter("outcome IS NOT NULL"), v("fx_docs").select("repo_id", "path", F.expr(OUTCOME).alias("outcome"), F.lit(12).alias("lines")).filter("outcome IS NOT NULL"), v("fx_docs").filter("doc_id % 11 = 8").select("repo_id", "path", F.lit("parse-limit").alias("reason"))))

# --- symbols -------------------------------------------------------------------------------------------------------------

SEQ = "row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line, end_line, name, kind, exported)"
RAWSYM = f"""rawsym AS (SELECT *, CASE WHEN s % 4 = 0 THEN NULL ELSE s - s % 4 END AS parent FROM (SELECT *, {SEQ} AS s FROM fx_symbols)),
namedsym AS (SELECT *, concat('sym:', path, '#', name, '@', start_line) AS id FROM rawsym WHERE s % 13 <> 0),
built AS (SELECT repo_id, path, id, min(s) AS s FROM namedsym GROUP BY ALL)"""


def raw_symbols(v) -> DataFrame:
    n = Q.numbered(v)
    s = F.col("seq")
    return n.select("repo_id", "path", "seq", F.when(s % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("name"), "kind", "start_line", "end_line", "exported", F.lit("f( a,\n b )").alias("signature"), F.when(s % 4 != 0, s - s % 4).alias("parent_seq"))


query("build_symbols", """SELECT b.repo_id, b.path, b.id, CASE WHEN p.id <> b.id THEN p.id END AS parent_id, row_number() OVER (PARTITION BY b.repo_id, b.path ORDER BY n.start_line, n.end_line DESC, b.s) AS place, 'f( a, b )' AS signature
  FROM built b JOIN namedsym n ON n.repo_id = b.repo_id AND n.path = b.path AND n.s = b.s LEFT JOIN namedsym p ON p.repo_id = b.repo_id AND p.path = b.path AND p.s = n.parent""", RAWSYM)(
    lambda v: SY.build_symbols(raw_symbols(v)).select("repo_id", "path", "id", "parent_id", "place", "signature"))
query("symbol_spans", """SELECT repo_id, path, id, depth, round(low, 9) AS low, round(low + sz, 9) AS high FROM (SELECT *, greatest(bottom, least((y0 + y1) / 2 - sz / 2, top - sz)) AS low FROM (SELECT *, least(top - bottom, greatest(y1 - y0, 0.05)) AS sz FROM (
  SELECT f.repo_id, f.path, f.id, 0 AS depth, 0.0 AS bottom, 1.0 AS top, (start_line - 1) / n AS y0, end_line / n AS y1 FROM flat f JOIN files g ON g.repo_id = f.repo_id AND g.path = f.path WHERE par IS NULL
  UNION ALL SELECT f.repo_id, f.path, f.id, 1, h.low, h.low + h.sz, (start_line - 1) / n, end_line / n FROM flat f JOIN files g ON g.repo_id = f.repo_id AND g.path = f.path JOIN (SELECT *, greatest(0.0, least((y0 + y1) / 2 - sz / 2, 1.0 - sz)) AS low FROM (SELECT t.repo_id, t.path, t.id, (start_line - 1) / n AS y0, end_line / n AS y1, least(1.0, greatest(end_line / n - (start_line - 1) / n, 0.05)) AS sz FROM flat t JOIN files u ON u.repo_id = t.repo_id AND u.path = t.path WHERE par IS NULL)) h
    ON h.repo_id = f.repo_id AND h.path = f.path AND h.id = f.par WHERE par IS NOT NULL)))""",
  f"flat AS (SELECT repo_id, path, concat('s', s) AS id, CASE WHEN s % 5 = 0 OR s < 5 THEN NULL ELSE concat('s', s - s % 5) END AS par, start_line, end_line FROM (SELECT *, {SEQ} AS s FROM fx_symbols))", "files AS (SELECT repo_id, path, CAST(greatest(max(end_line), 30) AS DOUBLE) AS n FROM flat GROUP BY ALL)")(
    lambda v: flat_spans(v))


def flat_spans(v) -> DataFrame:
    s = F.col("seq")
    n = Q.numbered(v).select("repo_id", "path", F.concat(F.lit("s"), s).alias("id"), F.when((s % 5 != 0) & (s > 5), F.concat(F.lit("s"), s - s % 5)).alias("parent_id"), "start_line", "end_line")
    out = SY.symbol_spans(n, n.select("repo_id", "path").distinct().withColumn("lines", F.lit(30)), 0.05)
    return out.withColumns({c: F.round(c, 9) for c in ("low", "high")})


query("symbol_counts", """SELECT repo_id, path, count(*) FILTER (WHERE kind IN ('function', 'method')) AS functions, count(*) FILTER (WHERE kind IN ('class', 'struct')) AS classes, count(*) AS total FROM fx_symbols GROUP BY ALL""")(lambda v: SY.symbol_counts(v("fx_symbols")))
query("kind_counts", "SELECT repo_id, path, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS \"{k}\"" for k in ("class", "interface", "struct", "trait", "enum", "type", "function", "method", "constant", "variable", "module")) + " FROM fx_symbols GROUP BY ALL")(
    lambda v: SY.kind_counts(v("fx_symbols")))

# --- emphasis ------------------------------------------------------------------------------------------------------------

ACTIVE = "active AS (SELECT repo_id, min(id) AS id FROM people WHERE files > 0 AND repo_id IN ('fx:0', 'fx:1') GROUP BY repo_id UNION ALL SELECT 'fx:2', 'user:nobody')"
SLOTTED = "slotted AS (SELECT * FROM (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY commit_count DESC, contributions DESC, id) AS slot FROM people WHERE commit_count > 0 OR contributions > 0 OR files > 0) WHERE slot <= 8)"
query("contributor_highlight", """SELECT repo_id, path, role, CASE WHEN role = 'slot' THEN slot ELSE 0 END AS slot, CASE role WHEN 'dimmed' THEN 0.18 WHEN 'last' THEN 1 WHEN 'touched' THEN 1 WHEN 'none' THEN 0.4 WHEN 'slot' THEN 0.95 ELSE 0.6 END::DOUBLE AS emphasis, CASE role WHEN 'last' THEN 0.4 WHEN 'touched' THEN 0.2 ELSE 0 END::DOUBLE AS glow FROM (
  SELECT d.repo_id, d.path, slot, CASE WHEN lit AND own IS NULL THEN 'dimmed' WHEN lit AND last_author_id = p.id THEN 'last' WHEN lit THEN 'touched' WHEN last_author_id IS NULL THEN 'none' WHEN slot IS NOT NULL THEN 'slot' ELSE 'other' END AS role
  FROM fx_docs d LEFT JOIN activity a ON a.repo_id = d.repo_id AND a.path = d.path LEFT JOIN active p ON p.repo_id = d.repo_id LEFT JOIN (SELECT DISTINCT c.repo_id, path, true AS own FROM changes c JOIN authored m ON m.repo_id = c.repo_id AND m.sha = c.sha JOIN active p ON p.repo_id = c.repo_id AND p.id = author_id) o ON o.repo_id = d.repo_id AND o.path = d.path
  LEFT JOIN slotted s ON s.repo_id = d.repo_id AND s.id = last_author_id, (SELECT true) WHERE true)""".replace("WHEN lit AND own IS NULL", "WHEN d.repo_id IN ('fx:0', 'fx:1') AND own IS NULL").replace("WHEN lit AND last", "WHEN d.repo_id IN ('fx:0', 'fx:1') AND last").replace("WHEN lit THEN", "WHEN d.repo_id IN ('fx:0', 'fx:1') THEN").replace(", (SELECT true) WHERE true", ""), AUTHORED, CHANGES, ACTIVITY, PEOPLE, ACTIVE, SLOTTED)(
    lambda v: highlighted(v))


def highlighted(v) -> DataFrame:
    people = H.contributors(v("fx_commits"), v("fx_contributors"), changes(v), 1 << 30)
    active = people.filter("files > 0 AND repo_id IN ('fx:0', 'fx:1')").groupBy("repo_id").agg(F.min("id").alias("id")).unionByName(people.filter("repo_id = 'fx:2'").selectExpr("repo_id", "'user:nobody' AS id").distinct())
    return M.contributor_highlight(v("fx_docs"), H.file_activity(v("fx_commits"), changes(v)), people, H.files_touched_by(v("fx_commits"), changes(v)), active).fillna(0, ["slot"])


MODES = ("contributors", "activity", "complexity", "dependencies", "overview")
FACTS = "moded AS (SELECT doc_id, repo_id, doc_id % 900 AS lines, 900 AS max_lines, doc_id % 7 AS degree, 6 AS max_degree, CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 1000) END AS last_modified, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 2 = 0 END AS touched FROM fx_docs), ranged AS (SELECT repo_id AS k, min(last_modified) AS lo, max(last_modified) AS hi FROM moded GROUP BY repo_id)"
LEVELS = {
    "contributors": "CASE WHEN touched IS NULL THEN 0.8 WHEN touched THEN 1.0 ELSE 0.14 END", "activity": "coalesce(0.2 + 0.8 * (epoch_ms(last_modified) - epoch_ms(lo)) / greatest(1, epoch_ms(hi) - epoch_ms(lo)), 0.18)", "complexity": "0.2 + 0.8 * lines / 900",
    "dependencies": "CASE WHEN degree = 0 THEN 0.18 ELSE 0.35 + 0.65 * degree / 6 END", "overview": "0.9",
}
query("mode_emphasis", "SELECT doc_id, " + ", ".join(f"round(CAST({x} AS DOUBLE), 9) AS {m}" for m, x in LEVELS.items()) + " FROM moded JOIN ranged ON k = repo_id", FACTS)(lambda v: moded(v))


def moded(v) -> DataFrame:
    df = v("fx_docs").selectExpr("doc_id", "repo_id", "doc_id % 900 AS lines", "900 AS max_lines", "doc_id % 7 AS degree", "6 AS max_degree", "CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + make_dt_interval(0, CAST(doc_id % 1000 AS INT)) END AS last_modified", "CASE WHEN doc_id % 4 <> 3 THEN doc_id % 2 = 0 END AS touched")
    for m in MODES:
        df = M.mode_emphasis(df, m).withColumn(m, F.round("emphasis", 9)).drop("emphasis")
    return df.select("doc_id", *MODES)


LAYERS = [
    ((0.9, 0.5, True, False, None, False, False), "0.9|0.1"), ((0.4, 0.0, False, True, None, False, False), "0.9|0.22"), ((0.9, 0.3, False, False, False, False, False), "0.15|0.0"), ((0.1, 0.0, False, False, False, True, False), "1.0|0.3"),
    ((0.9, 0.9, False, False, True, False, True), "1.0|1.0"), ((0.2, 0.1, False, False, None, False, True), "0.75|0.28"),
]
query("layered_emphasis", f"SELECT doc_id, {typed([x[1] for x in LAYERS], 'doc_id')} AS result FROM fx_docs")(lambda v: layered(v))


def layered(v) -> DataFrame:
    at = (F.col("doc_id") % len(LAYERS) + 1).cast("int")
    pick = lambda i, kind: F.element_at(F.array(*[F.lit(x[0][i]).cast(kind) for x in LAYERS]), at)
    e, g = M.layered_emphasis(pick(0, "double"), pick(1, "double"), *[pick(i, "boolean") for i in range(2, 7)])
    return v("fx_docs").select("doc_id", F.concat_ws("|", F.round(e, 6), F.round(g, 6)).alias("result"))


SELECTED = f"picked AS ({Q.SELECTED})"
query("budget_edges_of_selection", """SELECT repo_id, edge_id, role, place FROM (SELECT e.repo_id, edge_id, CASE WHEN s.file IS NOT NULL AND t.file IS NOT NULL THEN 'internal' WHEN s.file IS NOT NULL THEN 'outgoing' ELSE 'incoming' END AS role, row_number() OVER (PARTITION BY e.repo_id ORDER BY weight DESC, edge_id) AS place
  FROM fx_edges e LEFT JOIN picked s ON s.repo_id = e.repo_id AND s.file = e.source LEFT JOIN picked t ON t.repo_id = e.repo_id AND t.file = e.target WHERE s.file IS NOT NULL OR t.file IS NOT NULL) WHERE place <= 4000""", ENDS, CONNECTED, SELECTED)(
    lambda v: G.budget_edges(v("fx_edges"), selection=G.rank_connectivity(v("fx_edges"), 3)).select("repo_id", "edge_id", "role", "place"))
query("budget_edges_in_focus", """SELECT repo_id, edge_id, 'focus' AS role, row_number() OVER (PARTITION BY repo_id ORDER BY weight DESC, edge_id) AS place FROM fx_edges e WHERE list_contains(['0', '1', '2', '3', '4', '5', '6'], right(source, 1)) AND list_contains(['0', '1', '2', '3', '4', '5', '6'], right(target, 1)) QUALIFY place <= 5000""")(
    lambda v: G.budget_edges(v("fx_edges"), focus=v("fx_docs").filter("doc_id % 10 < 7").select(F.concat(F.lit("file:"), F.col("doc_id").cast("string")).alias("file"))).select("repo_id", "edge_id", "role", "place"))
query("distinct_imports", """SELECT repo_id, path, label, state, row_number() OVER (PARTITION BY repo_id, path ORDER BY CASE state WHEN 'internal' THEN 0 WHEN 'external' THEN 1 ELSE 2 END, label) AS place FROM (SELECT DISTINCT repo_id, path, coalesce(CASE WHEN target_doc IS NOT NULL THEN substr(specifier, 2) END, specifier) AS label,
  CASE WHEN target_doc IS NOT NULL THEN 'internal' WHEN starts_with(specifier, '@/') THEN 'unresolved' ELSE 'external' END AS state FROM fx_imports)""")(
    lambda v: G.distinct_imports(states(v).select("repo_id", "path", "seq", "specifier", (F.col("state") == "external").alias("external"), F.when(F.col("target_doc").isNotNull(), F.substr("specifier", F.lit(2))).alias("target"))))

# --- layout --------------------------------------------------------------------------------------------------------------


def broken(v) -> tuple[DataFrame, DataFrame]:
    """The roll-up's directories with some parents unknown, and files of which some stand in an unknown directory."""
    d = L.parent_ids(R.directory_rollup(counted(v))).withColumn("parent_id", F.when(F.length("path") % 5 == 3, "dir:gone").otherwise(F.col("parent_id")))
    f = v("fx_docs").select("repo_id", P.file_id(F.col("path")).alias("id"), "path", F.when(F.col("doc_id") % 6 == 5, "dir:lost").otherwise(P.directory_id(P.parent_path(F.col("path")))).alias("directory_id"))
    return d.unionByName(d.filter("length(path) % 3 = 1")), f


query("rehome_orphans", """SELECT repo_id, concat('dir:', path) AS id, CASE WHEN path = '' THEN NULL WHEN length(path) % 5 = 3 THEN 'dir:' ELSE concat('dir:', regexp_extract(path, '^(.*)/[^/]*$', 1)) END AS home FROM rolled
  UNION ALL SELECT repo_id, concat('file:', path), CASE WHEN doc_id % 6 = 5 OR NOT EXISTS (SELECT 1 FROM rolled r WHERE r.repo_id = d.repo_id AND r.path = regexp_extract(d.path, '^(.*)/[^/]*$', 1)) THEN 'dir:' ELSE concat('dir:', regexp_extract(path, '^(.*)/[^/]*$', 1)) END FROM fx_docs d""", INV, *COUNTED, ROLLED)(
    lambda v: (lambda d, f: d.select("repo_id", "id", F.col("parent_id").alias("home")).unionByName(f.select("repo_id", "id", F.col("directory_id").alias("home"))))(*L.rehome_orphans(*broken(v))))
query("content_districts", """SELECT r.repo_id, concat('dir:', r.path) AS id, depth AS level, greatest(0, omitted_file_count - coalesce(below, 0), direct_file_count - coalesce(held, 0)) AS direct_omitted FROM (SELECT *, CASE WHEN path = '' THEN 0 ELSE length(path) - length(replace(path, '/', '')) + 1 END AS depth FROM rolled) r
  LEFT JOIN (SELECT repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, CAST(sum(omitted_file_count) AS BIGINT) AS below FROM rolled WHERE path <> '' GROUP BY ALL) b ON b.repo_id = r.repo_id AND b.up = r.path LEFT JOIN (SELECT repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, count(*) AS held FROM fx_docs GROUP BY ALL) h ON h.repo_id = r.repo_id AND h.d = r.path""", INV, *COUNTED, ROLLED)(
    lambda v: districts(v))


def districts(v) -> DataFrame:
    rolled = R.directory_rollup(counted(v))
    d = L.parent_ids(rolled).join(rolled.select("repo_id", "path", F.col("omitted_file_count").alias("omitted"), F.col("direct_file_count").alias("direct")), ["repo_id", "path"])
    return L.content_districts(d, v("fx_docs").select("repo_id", P.directory_id(P.parent_path(F.col("path"))).alias("directory_id")))


PLACES = "SELECT repo_id, CAST(doc_id % 101 AS DOUBLE) AS x, CAST(doc_id % 37 AS DOUBLE) AS z, 1.0 + doc_id % 3 AS width, 1.0 + doc_id % 2 AS depth, 0.0 AS base, 1.0 + size % 10 AS height FROM fx_docs"
query("spatial_grid", """SELECT c.repo_id, c.cell, any_value(members) AS members, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, round(sqrt(max(pow(greatest(abs(x - width / 2 - cx), abs(x + width / 2 - cx)), 2) + pow(greatest(abs(base - cy), abs(base + height - cy)), 2) + pow(greatest(abs(z - depth / 2 - cz), abs(z + depth / 2 - cz)), 2))), 6) AS radius FROM binned b
  JOIN (SELECT repo_id, cell, count(*) AS members, (min(x - width / 2) + max(x + width / 2)) / 2 AS cx, (min(base) + max(base + height)) / 2 AS cy, (min(z - depth / 2) + max(z + depth / 2)) / 2 AS cz FROM binned GROUP BY repo_id, cell) c ON c.repo_id = b.repo_id AND c.cell = b.cell GROUP BY c.repo_id, c.cell""",
  f"places AS ({PLACES})", """boxed AS (SELECT repo_id AS k, count(*) AS n, greatest(2, ceil(sqrt(count(*) / 25.0))) AS cells, min(x - width / 2) AS x0, max(x + width / 2) AS x1, min(z - depth / 2) AS z0, max(z + depth / 2) AS z1 FROM places GROUP BY repo_id),
  binned AS (SELECT places.*, CASE WHEN n <= 40 THEN -1 ELSE CAST(least(cells - 1, floor((z - z0) / (z1 - z0) * cells)) * cells + least(cells - 1, floor((x - x0) / (x1 - x0) * cells)) AS BIGINT) END AS cell FROM places JOIN boxed ON k = repo_id)""")(
    lambda v: L.spatial_grid(v("fx_docs").selectExpr("repo_id", "double(doc_id % 101) AS x", "double(doc_id % 37) AS z", "1.0D + doc_id % 3 AS width", "1.0D + doc_id % 2 AS depth", "0.0D AS base", "1.0D + size % 10 AS height"), 40, 25).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz", "radius")}))

# --- resolution ----------------------------------------------------------------------------------------------------------

JOINED = "SELECT i.repo_id, i.path, i.seq, t.path AS tpath, i.source_doc FROM fx_imports i LEFT JOIN fx_docs t ON t.doc_id = i.target_doc"
DOTTED = "replace(regexp_replace({p}, '\\.[a-z.]+$', ''), '/', '.')"


def asked(v, *endings: str) -> DataFrame:
    """The statements of files with these endings, with their target's path."""
    return Q.at_targets(v).filter(F.substring_index("path", ".", -1).isin(*endings))


def all_paths(v) -> DataFrame:
    return v("fx_docs").select("repo_id", "path", F.lit(True).alias("in_graph"))


def shown(df: DataFrame) -> DataFrame:
    return Q.at_sources(df).select("repo_id", "path", "seq", "state", F.get("targets", F.lit(0)).alias("target"), "name")


def es_configs(v) -> DataFrame:
    """A configuration at the root of every repository, which inherits one of its aliases, and a workspace package in each source; all with comments and stray commas."""
    repos = v("fx_docs").select("repo_id").distinct()
    own = repos.select("repo_id", F.explode(F.create_map(
        F.lit("tsconfig.json"), F.lit('\ufeff{ // inherits "paths": {} /* only\n  "extends": "./base.json", /* and , } nothing else */ }'),
        F.lit("base.json"), F.lit('{"compilerOptions": {"paths": {"~/*": ["./*", /* all */],},}, }'))).alias("path", "text"))
    tops = v("fx_docs").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct()
    package = F.concat(F.lit('{"name": "@w/'), "top", F.lit('", // {"name": "no"}\n "exports": {"./*": "./*",}, "homepage": "https://example.org//x/*y*/",}'))
    return own.unionByName(tops.select("repo_id", F.concat("top", F.lit("/package.json")).alias("path"), package.alias("text")))


def es_statements(v) -> DataFrame:
    """Targets are named by an alias, by the package of their source, or from the root, by turns."""
    i = asked(v, "ts", "js")
    named = F.when(F.col("n") == 3, F.col("specifier")).when(F.col("source_doc") % 3 == 0, F.concat(F.lit("~/"), "tpath")).when(F.col("source_doc") % 3 == 1, F.concat(F.lit("@w/"), "tpath")).otherwise(F.concat(F.lit("/"), "tpath"))
    return i.select("repo_id", "path", "seq", named.alias("specifier"))


ES_SQL = f"""SELECT i.repo_id, i.path, i.seq, CASE WHEN i.seq = 3 THEN CASE WHEN specifier = '@/missing' THEN 'unresolved' ELSE 'external' END ELSE 'internal' END AS state, t.path AS target,
  CASE WHEN i.seq = 3 THEN CASE WHEN specifier = '@/missing' THEN NULL WHEN specifier = 'fs/promises' THEN 'node:fs' WHEN starts_with(specifier, '@scope') THEN string_split(specifier, '/')[1] || '/' || string_split(specifier, '/')[2] ELSE specifier END END AS name FROM fx_imports i LEFT JOIN fx_docs t ON t.doc_id = i.target_doc WHERE i.path LIKE '%.ts' OR i.path LIKE '%.js'"""
query("match_path_alias", ES_SQL)(lambda v: shown(ES.resolve_ecmascript(es_statements(v), all_paths(v), es_configs(v))))
query("effective_config", "SELECT DISTINCT repo_id, p AS path, '~/*' AS pattern, '' AS paths_base FROM fx_docs, (SELECT unnest(['tsconfig.json', 'base.json']) AS p)")(
    lambda v: ES.effective_config(es_configs(v).filter("path NOT LIKE '%package.json'")).select("repo_id", "path", F.get(F.map_keys("aliases"), F.lit(0)).alias("pattern"), "paths_base"))
query("workspace_packages", "SELECT DISTINCT repo_id, concat('@w/', string_split(path, '/')[1]) AS name, string_split(path, '/')[1] AS directory FROM fx_docs")(lambda v: ES.workspace_packages(ES.manifests(es_configs(v))).select("repo_id", "name", "directory"))


def python_statements(v) -> DataFrame:
    i = asked(v, "py").filter("n < 3")
    dotted = F.replace(F.regexp_replace("tpath", r"\.[a-z.]+$", ""), F.lit("/"), F.lit("."))
    is_py = F.col("tpath").endswith(".py")
    return i.select("repo_id", "path", "seq", F.when(is_py, dotted).otherwise(F.concat(F.lit("out"), F.col("source_doc") % 3, F.lit(".part"))).alias("specifier"), F.when(is_py & (F.col("source_doc") % 2 == 0), F.array(F.lit("Thing"))).otherwise(F.array().cast("array<string>")).alias("names"))


PY = "tpath LIKE '%.py' AND tpath NOT LIKE '%/vendor/%'"
query("resolve_python_imports", f"""SELECT repo_id, path, seq, CASE WHEN {PY} THEN 'internal' ELSE 'external' END AS state, CASE WHEN {PY} THEN tpath END AS target, CASE WHEN {PY} THEN NULL WHEN tpath LIKE '%.py' THEN string_split(tpath, '/')[1] ELSE concat('out', source_doc % 3) END AS name
  FROM ({JOINED}) WHERE path LIKE '%.py' AND seq < 3""")(lambda v: shown(MO.resolve_python(python_statements(v), all_paths(v))))


def java_sources(v) -> DataFrame:
    """Java files with a license, an annotation and the row's own words around the declaration."""
    package = F.replace(P.parent_path(F.col("path")), F.lit("/"), F.lit("."))
    words = F.translate(F.substring("text", 1, 200), "*/\n\r", "    ")
    text = F.concat(F.lit("/* package wrong.one;\n * "), words, F.lit(" */\n// package wrong.two;\n@Made(\"by; hand)\") package "), package, F.lit(" ;\nimport java.util.List;\nclass A { String s = \"package wrong.three;\"; }\n"))
    return v("fx_docs").filter("path LIKE '%.java'").select("repo_id", "path", text.alias("text"))


def java_packages(v) -> DataFrame:
    return MO.java_packages(java_sources(v))


query("java_packages", "SELECT repo_id, path, replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', '.') AS package FROM fx_docs WHERE path LIKE '%.java'")(java_packages)
query("resolve_java_imports", f"""SELECT repo_id, path, seq, CASE WHEN tpath LIKE '%.java' THEN 'internal' ELSE 'external' END AS state, CASE WHEN tpath LIKE '%.java' THEN tpath END AS target, CASE WHEN tpath NOT LIKE '%.java' THEN 'org.out' END AS name FROM ({JOINED}) WHERE path LIKE '%.java' AND seq < 3""")(
    lambda v: shown(MO.resolve_java(java_statements(v), all_paths(v), java_packages(v))))


def go_mods(v) -> DataFrame:
    return v("fx_docs").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct().select("repo_id", F.concat("top", F.lit("/go.mod")).alias("path"), F.concat(F.lit("module example.org/"), "top", F.lit("\n\nrequire (\n\tgithub.com/a/b v1.0.0\n)\n")).alias("text"))


query("resolve_go_imports", """SELECT i.repo_id, i.path, i.seq, CASE WHEN i.seq = 1 THEN 'internal' ELSE 'external' END AS state, CASE WHEN i.seq = 1 THEN (SELECT min(g.path) FROM fx_docs g WHERE g.repo_id = i.repo_id AND g.path LIKE '%.go' AND regexp_extract(g.path, '^(.*)/[^/]*$', 1) = regexp_extract(i.path, '^(.*)/[^/]*$', 1)) END AS target,
  CASE WHEN i.seq <> 1 THEN 'github.com/a/b' END AS name FROM (SELECT repo_id, path, unnest([1, 2]) AS seq FROM fx_docs WHERE path LIKE '%.go') i""")(
    lambda v: shown(MO.resolve_go(go_statements(v), all_paths(v), go_mods(v))))


def rust_statements(v) -> DataFrame:
    """From one file of a source to another, from the crate's root."""
    i = asked(v, "rs").filter("n < 3")
    top = F.substring_index("tpath", "/", 1)
    inner = F.replace(F.regexp_replace(F.substr("tpath", F.length(F.concat(top, F.lit("/"))) + 1), r"\.rs$", ""), F.lit("/"), F.lit("::"))
    return i.select("repo_id", "path", "seq", F.when(F.col("tpath").endswith(".rs"), F.concat(top, F.lit("::"), inner, F.lit("::{Item, self}"))).otherwise("std::fmt::{self, Write}").alias("specifier"), F.lit("use").alias("kind"), F.array().cast("array<string>").alias("names"))


def cargo_texts(v) -> DataFrame:
    """A crate in each source, with a library file beside its directories; a line of each manifest is broken."""
    tops = v("fx_docs").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct()
    text = F.concat(F.lit("# [lib]\n[package]\nname = \""), "top", F.lit('" # the name\nedition = \'2021\'\nbroken = = 1\n\n[dependencies]\nserde = { version = "1.0", features = ["derive", "rc"] }\n[bad header\nname = "no"\n[lib]\npath = "lib.rs"\n'))
    return tops.select("repo_id", F.concat("top", F.lit("/Cargo.toml")).alias("path"), text.alias("text"))


def rust_manifests(v) -> DataFrame:
    return MO.cargo_manifests(cargo_texts(v))


TOPS = "(SELECT DISTINCT repo_id, string_split(path, '/')[1] AS top FROM fx_docs)"
query("cargo_manifests", f"SELECT repo_id, concat(top, '/Cargo.toml') AS path, top AS name, CAST(NULL AS VARCHAR) AS lib_name, 'lib.rs' AS lib_path FROM {TOPS}")(rust_manifests)


def python_projects(v) -> DataFrame:
    """In each source a pyproject.toml, a setup.cfg and a setup.py that declare where their code is."""
    tops = v("fx_docs").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct()
    texts = {
        "pyproject.toml": '[tool.setuptools.packages.find]\nwhere = [\n  "src", # more, ["no"]\n  "lib",\n]\n[tool.setuptools]\npackage-dir = {"" = "own"}\n[[tool.poetry.packages]]\ninclude = "x"\nfrom = "poet"\n[tool.hatch.build.targets.wheel]\npackages = ["hatch/pkg", """\n../outside/pkg"""]\n',
        "a/setup.cfg": "[options]\r\npackage_dir =\r\n    = code # here\r\n[options.packages.find]\r\nwhere = in-ner\r\n", "b/setup.py": "setup(name='b', package_dir = {\n '': 'old'})\nwhere = [1]\n",
    }
    return tops.select("repo_id", "top", F.explode(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])).alias("name", "text")).select("repo_id", F.concat_ws("/", "top", "name").alias("path"), "text")


query("declared_roots", f"SELECT repo_id, concat(top, '/', r) AS root FROM {TOPS}, (SELECT unnest(['src', 'lib', 'own', 'poet', 'hatch', 'a/code', 'a/in-ner', 'b/old']) AS r) UNION SELECT repo_id, 'outside' FROM {TOPS}")(
    lambda v: MO.declared_roots(python_projects(v)))
query("resolve_rust_imports", f"""SELECT repo_id, path, seq, CASE WHEN tpath LIKE '%.rs' THEN 'internal' ELSE 'external' END AS state, CASE WHEN tpath LIKE '%.rs' THEN tpath END AS target, CASE WHEN tpath NOT LIKE '%.rs' THEN 'std' END AS name FROM ({JOINED}) WHERE path LIKE '%.rs' AND seq < 3""")(
    lambda v: shown(MO.resolve_rust(rust_statements(v), all_paths(v).unionByName(rust_manifests(v).select("repo_id", F.concat("name", F.lit("/lib.rs")).alias("path"), F.lit(True).alias("in_graph"))), rust_manifests(v))))


def java_statements(v) -> DataFrame:
    named = F.when(F.col("tpath").endswith(".java"), F.concat(F.replace(F.regexp_replace("tpath", r"\.java$", ""), F.lit("/"), F.lit(".")), F.lit(".Inner"))).otherwise("org.out.Thing")
    return asked(v, "java").filter("n < 3").select("repo_id", "path", "seq", named.alias("specifier"), F.array(F.lit("Inner")).alias("names"))


def go_statements(v) -> DataFrame:
    own = F.struct(F.lit(1).alias("seq"), F.concat(F.lit('"example.org/'), P.parent_path(F.col("path")), F.lit('"')).alias("specifier"))
    return v("fx_docs").filter("path LIKE '%.go'").select("repo_id", "path", F.explode(F.array(own, F.struct(F.lit(2).alias("seq"), F.lit("github.com/a/b/c").alias("specifier")))).alias("s")).select("repo_id", "path", F.struct("repo_id", "s.seq").alias("seq"), "s.specifier")


def dispatched(v) -> DataFrame:
    """The statements of all five languages, with raw configurations."""
    none = F.array().cast("array<string>")
    parts = {"typescript": es_statements(v), "python": python_statements(v), "rust": rust_statements(v), "java": java_statements(v), "go": go_statements(v)}
    rows = [p.select("repo_id", "path", "seq", "specifier", F.lit("import").alias("kind"), F.col("names") if "names" in p.columns else none.alias("names"), F.lit(name).alias("language")) for name, p in parts.items()]
    paths = all_paths(v).unionByName(rust_manifests(v).select("repo_id", F.concat("name", F.lit("/lib.rs")).alias("path"), F.lit(True).alias("in_graph")))
    configs = es_configs(v).unionByName(cargo_texts(v)).unionByName(go_mods(v))
    return MO.dispatch_resolution(reduce(DataFrame.unionByName, rows), paths, configs, java_packages(v))


STATE_OF = "CASE WHEN {} THEN 'internal' ELSE 'external' END"
query("dispatch_resolution", f"""SELECT repo_id, state, count(*) AS statements FROM (SELECT repo_id, state FROM ({ES_SQL}) UNION ALL SELECT repo_id, {STATE_OF.format(PY)} FROM ({JOINED}) WHERE path LIKE '%.py' AND seq < 3
  UNION ALL SELECT repo_id, {STATE_OF.format("tpath LIKE '%.rs'")} FROM ({JOINED}) WHERE path LIKE '%.rs' AND seq < 3 UNION ALL SELECT repo_id, {STATE_OF.format("tpath LIKE '%.java'")} FROM ({JOINED}) WHERE path LIKE '%.java' AND seq < 3
  UNION ALL SELECT repo_id, unnest(['internal', 'external']) FROM fx_docs WHERE path LIKE '%.go') GROUP BY repo_id, state""")(lambda v: Q.at_sources(dispatched(v)).groupBy("repo_id", "state").agg(F.count("*").alias("statements")))  # fmt: skip


def commented(v) -> DataFrame:
    """Each document's text as a string in a configuration with comments, in which it also stands."""
    text = F.coalesce("text", F.lit(""))
    plain = F.to_json(F.struct(text.alias("text"), F.array(F.col("doc_id"), F.lit(7)).alias("list")))
    aside = F.concat(F.lit(" /* "), F.replace(text, F.lit("*/"), F.lit("")), F.lit(" */ // "), F.regexp_replace(text, r"[\r\n]", " "), F.lit("\n"))
    raw = F.concat(F.lit("\ufeff"), aside, F.replace(F.left(plain, F.length(plain) - 2), F.lit(',"list"'), F.concat(F.lit(","), aside, F.lit('"list"'))), F.lit(", "), aside, F.lit("], }"))
    return v("documents").select("doc_id", F.from_json(plain_json(raw), "text string, list array<long>").alias("j"))


query("plain_json", "SELECT doc_id, md5(coalesce(text, '')) AS text, CAST(doc_id + 7 AS BIGINT) AS total FROM documents")(
    lambda v: commented(v).select("doc_id", F.md5("j.text").alias("text"), F.aggregate("j.list", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))

# --- the sink ------------------------------------------------------------------------------------------------------------


def written_graph(v) -> DataFrame:
    """Files and symbols of all repositories are written, those of one again with fewer rows, and a third run dies between its two tables."""
    files = v("fx_docs").select("repo_id", F.lit("c1").alias("commit_sha"), "path", "size")
    symbols = v("fx_symbols").select("repo_id", F.lit("c1").alias("commit_sha"), "path", "name")
    spark, at = files.sparkSession, f"{shared_dir(files.sparkSession)}/graph-{uuid.uuid4().hex}"
    SK.write_graph({"files": files, "symbols": symbols}, at)
    again = files.filter("repo_id = 'fx:1' AND size % 2 = 0")
    SK.write_graph({"files": again, "symbols": symbols.filter("repo_id = 'fx:1' AND name LIKE '%1%'")}, at, files.filter("repo_id = 'fx:1'").select("repo_id", "commit_sha").distinct())
    with suppress(PySparkException):
        SK.write_graph({"files": files.filter("repo_id = 'fx:2'").limit(1), "symbols": symbols.withColumn("name", F.raise_error(F.lit("this run is to die")))}, at)
    count = lambda name: SK.read_graph(spark, at, name).groupBy("repo_id", F.lit(name).alias("kind")).agg(F.count("*").alias("n"))
    return count("files").unionByName(count("symbols"))


query("write_graph", """SELECT repo_id, 'files' AS kind, count(*) AS n FROM fx_docs WHERE repo_id <> 'fx:1' OR size % 2 = 0 GROUP BY ALL
  UNION ALL SELECT repo_id, 'symbols', count(*) FROM fx_symbols WHERE repo_id <> 'fx:1' OR name LIKE '%1%' GROUP BY ALL""")(written_graph)

# --- streams, run through ------------------------------------------------------------------------------------------------


def run_events(v) -> DataFrame:
    """A run for each conversation: its turns are stages; every third run completes, every fifth ends in an error, then goes on."""
    c = v("conversations").select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("long").alias("seq"), F.lit("stage").alias("type"), F.element_at(F.array(*map(F.lit, ST.STAGES)), (F.col("turn") % 8 + 1).cast("int")).alias("stage"), F.when(F.col("turn") % 2 == 0, "done").otherwise("progress").alias("status"), F.lit(0.5).alias("progress"), F.lit(None).cast("string").alias("message"))
    n = F.col("run_id").cast("long")
    ends = c.groupBy("run_id").agg(F.max("seq").alias("seq")).filter((n % 3 == 0) | (n % 5 == 0))
    last = ends.select("run_id", (F.col("seq") + 1).alias("seq"), F.when(n % 3 == 0, "complete").otherwise("error").alias("type"), *[F.lit(None).cast(k).alias(c) for c, k in (("stage", "string"), ("status", "string"), ("progress", "double"), ("message", "string"))])
    return c.unionByName(last).unionByName(last.withColumns({"seq": F.col("seq") + 1, "type": F.lit("preview")}))


query("run_state", """SELECT run_id, CASE WHEN run_id::BIGINT % 3 = 0 THEN 'complete' WHEN run_id::BIGINT % 5 = 0 THEN 'error' ELSE 'loading' END AS status, CAST(count(*) FILTER (WHERE last % 2 = 0 OR run_id::BIGINT % 3 = 0) AS BIGINT) AS finished, run_id::BIGINT % 3 = 0 OR run_id::BIGINT % 5 = 0 AS ended
  FROM (SELECT CAST(conv_id AS VARCHAR) AS run_id, turn % 8 AS stage, max(turn) AS last FROM conversations GROUP BY ALL) GROUP BY run_id""")(lambda v: ST.run_state_batch(run_events(v)).select("run_id", "status", "finished", "ended"))
query("parse_event_stream", """SELECT bad AS reason, count(*) AS lines, round(sum(CASE WHEN bad IS NULL THEN least(1, (turn % 9) / 8.0) END), 3)::DOUBLE AS progress, max(CASE WHEN bad IS NULL THEN length(m) END) AS longest FROM (
  SELECT *, CASE WHEN (conv_id * 31 + turn) % 13 = 0 THEN 'malformed' WHEN turn % 7 = 6 THEN NULL WHEN turn % 5 = 4 THEN 'unknown-type' WHEN turn % 8 = 5 THEN 'unknown-stage' WHEN turn % 6 = 0 THEN 'unknown-status' END AS bad,
    CASE WHEN length(flat) > 160 THEN concat(left(flat, 159), '…') ELSE nullif(flat, '') END AS m
  FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]+', ' ', 'g')) AS flat FROM conversations)) GROUP BY bad""")(
    lambda v: ST.replay(event_lines(v).select("value"), ST.parse_events, "value").groupBy("reason").agg(
        F.count("*").alias("lines"), F.round(F.sum(F.when(F.col("reason").isNull(), F.col("progress"))), 3).alias("progress"), F.max(F.when(F.col("reason").isNull(), F.length("message"))).alias("longest")))
query("commit_counts_stream", "SELECT repo_id, epoch_us(date_trunc('week', date)::TIMESTAMP) AS bucket_start, count(*) AS commits FROM fx_commits GROUP BY ALL")(
    lambda v: micros(ST.replay(v("fx_commits").select("repo_id", "date"), lambda s: ST.commit_counts(s, "7 days"), "repo_id,bucket_start", "complete"), "bucket_start"))
query("trailing_windows_stream", "SELECT repo_id, epoch_us(date_trunc('day', date)::TIMESTAMP + to_days(CAST(k AS INT))) AS cursor, count(*) AS commits FROM fx_commits, (SELECT unnest(range(1, 8)) AS k) GROUP BY ALL")(
    lambda v: micros(ST.replay(v("fx_commits").select("repo_id", "date", "author_name"), lambda s: ST.trailing_windows(s, 7), "repo_id,cursor", "complete"), "cursor").select("repo_id", "cursor", "commits"))
query("dedupe_commits_stream", "SELECT repo_id, sha FROM fx_commits")(
    lambda v: ST.replay(v("fx_commits").unionByName(v("fx_commits")).select("repo_id", "sha", "date"), lambda s: ST.dedupe_commits(s, "3650 days"), "sha").select("repo_id", "sha"))
query("file_activity_stream", "SELECT c.repo_id, c.path, epoch_us(max(date)) AS last_modified, arg_max(author_name, (epoch_us(date), m.sha)) AS last_author, count(*) AS commit_count FROM fx_commit_files c JOIN fx_commits m ON m.repo_id = c.repo_id AND m.sha = c.sha GROUP BY ALL")(
    lambda v: micros(ST.replay(v("fx_commit_files").join(v("fx_commits").select("repo_id", "sha", "date", F.col("author_name").alias("author")), ["repo_id", "sha"]), ST.latest_activity, "repo_id,path", "update"), "last_modified"))
query("late_commits", "SELECT repo_id, sha, date >= TIMESTAMP '2024-01-10' AS kept FROM fx_commits")(
    lambda v: (lambda a, b: a.withColumn("kept", F.lit(True)).unionByName(b.withColumn("kept", F.lit(False))).select("repo_id", "sha", "kept"))(*ST.late_commits(v("fx_commits"), F.expr("TIMESTAMP '2024-01-10'"))))


def routed(v) -> DataFrame:
    """Commits come in four files, one a batch, in an order that has little to do with their dates."""
    commits = v("fx_commits").select("repo_id", "sha", "date").withColumn("part", F.conv(F.right(F.md5("sha"), F.lit(1)), 16, 10).cast("int") % 4)
    spark, at = commits.sparkSession, f"{shared_dir(commits.sparkSession)}/late-{uuid.uuid4().hex}"
    for part in range(4):
        commits.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("repo_id string, sha string, date timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ST.route_late(stream, f"{at}/out", "7 days").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: spark.read.schema("repo_id string, sha string, date timestamp, batch long").parquet(f"{at}/out/{name}").select("repo_id", "sha", "batch", F.lit(name == "late").alias("late"))
    return read("kept").unionByName(read("late"))


query("late_commits_stream", """SELECT repo_id, sha, batch, coalesce(date < (SELECT max(date) FROM dealt b WHERE b.repo_id = c.repo_id AND b.batch < c.batch) - INTERVAL 7 DAY, false) AS late FROM dealt c""",
  "dealt AS (SELECT repo_id, sha, date, ('0x' || right(md5(sha), 1))::BIGINT % 4 AS batch FROM fx_commits)")(routed)


def trailing(v) -> DataFrame:
    """Authors' days and daily counts come from streams, the windows of four widths from their sums."""
    commits = v("fx_commits").select("repo_id", "date", "author_name")
    days = ST.replay(commits, lambda s: ST.author_days(s, "3650 days"), "repo_id")
    counts = ST.replay(commits, lambda s: ST.commit_counts(s, "1 day"), "repo_id,bucket_start", "complete").withColumnRenamed("bucket_start", "day")
    return micros(ST.trailing_totals(days, counts), "cursor")


query("trailing_authors", """SELECT repo_id, CAST(w AS BIGINT) AS width, epoch_us(day + to_days(CAST(k AS INT))) AS cursor, count(*) AS commits, count(DISTINCT author_name) AS authors
  FROM (SELECT repo_id, author_name, date_trunc('day', date)::TIMESTAMP AS day, w, unnest(range(1, w + 1)) AS k FROM fx_commits, (SELECT unnest([7, 30, 90, 365]) AS w)) GROUP BY ALL""")(trailing)
