"""Repository-shaped views over the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "fx_docs": """
SELECT doc_id, concat('fx:', CAST(doc_id % 4 AS VARCHAR(10))) AS repo_id,
  concat(source, '/',
    CASE WHEN doc_id % 7 = 0 THEN 'src' WHEN doc_id % 7 = 1 THEN 'src/core' WHEN doc_id % 7 = 2 THEN 'tests'
         WHEN doc_id % 7 = 3 THEN 'docs' WHEN doc_id % 7 = 4 THEN 'vendor/lib' WHEN doc_id % 7 = 5 THEN 'packages/ui/src'
         ELSE 'examples' END,
    '/f', CAST(doc_id AS VARCHAR(20)), '.',
    CASE WHEN doc_id % 10 = 0 THEN 'ts' WHEN doc_id % 10 = 1 THEN 'py' WHEN doc_id % 10 = 2 THEN 'go'
         WHEN doc_id % 10 = 3 THEN 'rs' WHEN doc_id % 10 = 4 THEN 'java' WHEN doc_id % 10 = 5 THEN 'md'
         WHEN doc_id % 10 = 6 THEN 'min.js' WHEN doc_id % 10 = 7 THEN 'css' WHEN doc_id % 10 = 8 THEN 'png'
         ELSE 'js' END) AS path,
  n_chars AS size, text
FROM documents""",
    "fx_tree": """
SELECT repo_id, path, CASE WHEN doc_id % 50 = 3 THEN 'symlink' WHEN doc_id % 50 = 7 THEN 'submodule' ELSE 'file' END AS type,
  size, doc_id AS ordinal FROM fx_docs
UNION ALL
SELECT repo_id, CASE WHEN doc_id % 3 = 0 THEN concat('/', path) WHEN doc_id % 3 = 1 THEN concat('../', path) ELSE concat('a//', path) END,
  'file', size, doc_id + 1000000 FROM fx_docs WHERE doc_id % 40 = 0
UNION ALL
SELECT repo_id, path, 'file', size + 1, doc_id + 2000000 FROM fx_docs WHERE doc_id % 25 = 0
UNION ALL
SELECT repo_id, concat(substr(path, 1, 4), '/m', CAST(doc_id AS VARCHAR(20)), '/', CASE WHEN doc_id % 4 = 0 THEN 'package.json' WHEN doc_id % 4 = 1 THEN 'Cargo.toml'
  WHEN doc_id % 4 = 2 THEN 'go.mod' ELSE 'tsconfig.json' END), 'file', 200 + doc_id % 50, doc_id + 3000000 FROM fx_docs WHERE doc_id % 9 = 4
UNION ALL
SELECT repo_id, concat(substr(path, 1, 4), '/lib/r', CAST(doc_id AS VARCHAR(20)), '.rb'), 'file', 900 + doc_id % 70, doc_id + 4000000 FROM fx_docs WHERE doc_id % 8 = 3""",
    "fx_imports": """
SELECT s.repo_id, s.path, 1 AS seq, 'import' AS kind, concat('/', t.path) AS specifier, s.doc_id AS source_doc, t.doc_id AS target_doc
FROM (SELECT d.*, (d.doc_id + 4 * (d.doc_id % 5)) % c.n AS target FROM fx_docs d CROSS JOIN (SELECT count(*) AS n FROM documents) c) s
JOIN fx_docs t ON t.doc_id = s.target
WHERE s.doc_id % 10 IN (0, 1, 2, 3, 4, 9)
UNION ALL
SELECT s.repo_id, s.path, 2, CASE WHEN s.doc_id % 3 = 0 THEN 'type-import' ELSE 'require' END, concat('/', t.path), s.doc_id, t.doc_id
FROM (SELECT d.*, (d.doc_id + c.n - CASE WHEN d.doc_id % 4 < 2 THEN 4 * (1 + d.doc_id % 5) ELSE 4 * (d.doc_id % 6) END) % c.n AS target FROM fx_docs d CROSS JOIN (SELECT count(*) AS n FROM documents) c) s
JOIN fx_docs t ON t.doc_id = s.target
WHERE s.doc_id % 10 IN (0, 1, 9)
UNION ALL
SELECT repo_id, path, 3, 'import', CASE WHEN doc_id % 4 = 0 THEN concat('@scope/p', CAST(doc_id % 13 AS VARCHAR(10)), '/sub')
  WHEN doc_id % 4 = 1 THEN 'fs/promises' WHEN doc_id % 4 = 2 THEN concat('pkg', CAST(doc_id % 11 AS VARCHAR(10))) ELSE '@/missing' END,
  doc_id, CAST(NULL AS BIGINT)
FROM fx_docs WHERE doc_id % 10 IN (0, 9)""",
    "fx_edges": """
SELECT repo_id, concat(kind, ':file:', CAST(source_doc AS VARCHAR(20)), '->file:', CAST(target_doc AS VARCHAR(20))) AS edge_id,
  concat('file:', CAST(source_doc AS VARCHAR(20))) AS source, concat('file:', CAST(target_doc AS VARCHAR(20))) AS target,
  kind, count(*) AS weight
FROM fx_imports WHERE target_doc IS NOT NULL AND source_doc <> target_doc
GROUP BY repo_id, kind, source_doc, target_doc""",
    "fx_commits": """
SELECT concat('fx:', CAST(user_id % 4 AS VARCHAR(10))) AS repo_id, lpad(CAST(event_id AS VARCHAR(40)), 40, '0') AS sha,
  concat(event_type, ' #', CAST(event_id AS VARCHAR(40))) AS message,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 2 = 0 THEN concat('User', CAST(user_id AS VARCHAR(20)))
       ELSE concat('user', CAST(user_id AS VARCHAR(20))) END AS author_login,
  concat('Name  ', CAST(user_id AS VARCHAR(20))) AS author_name, ts AS date, event_id % 3 <> 0 AS has_details
FROM events""",
    "fx_commit_files": """
SELECT DISTINCT t.repo_id, t.sha, coalesce(d.path, concat('gone/f', CAST(t.target AS VARCHAR(20)), '.ts')) AS path
FROM (SELECT concat('fx:', CAST(user_id % 4 AS VARCHAR(10))) AS repo_id, lpad(CAST(event_id AS VARCHAR(40)), 40, '0') AS sha,
    4 * ((event_id * 7 + user_id) % CAST(floor(n / 4) + 2 AS BIGINT)) + user_id % 4 AS target
  FROM events CROSS JOIN (SELECT count(*) AS n FROM documents) c WHERE event_id % 3 <> 0
  UNION ALL
  SELECT concat('fx:', CAST(user_id % 4 AS VARCHAR(10))), lpad(CAST(event_id AS VARCHAR(40)), 40, '0'),
    4 * ((event_id * 31 + 17 * user_id) % CAST(floor(n / 4) AS BIGINT)) + user_id % 4
  FROM events CROSS JOIN (SELECT count(*) AS n FROM documents) c WHERE event_id % 3 <> 0) t
LEFT JOIN fx_docs d ON d.doc_id = t.target""",
    "fx_contributors": """
SELECT concat('fx:', CAST(c_custkey % 4 AS VARCHAR(10))) AS repo_id, concat('user', CAST(c_custkey AS VARCHAR(20))) AS login, c_name AS name,
  CAST(floor(greatest(c_acctbal, 0.0)) AS BIGINT) AS contributions
FROM customer""",
    "fx_symbols": """
SELECT DISTINCT d.repo_id, d.path, concat('sym', CAST(l.l_partkey AS VARCHAR(20))) AS name,
  CASE WHEN l.l_linenumber % 4 = 0 THEN 'class' WHEN l.l_linenumber % 4 = 1 THEN 'function' WHEN l.l_linenumber % 4 = 2 THEN 'method' ELSE 'constant' END AS kind,
  l.l_linenumber * 5 AS start_line, l.l_linenumber * 5 + l.l_suppkey % 9 AS end_line, l.l_returnflag = 'A' AS exported
FROM (SELECT o.*, o.l_orderkey % c.n AS doc FROM lineitem o CROSS JOIN (SELECT count(*) AS n FROM documents) c) l
JOIN fx_docs d ON d.doc_id = l.doc
WHERE d.doc_id % 10 IN (0, 1, 2, 3, 4, 9)""",
    "fx_requests": """
SELECT event_id AS request_id, CAST(user_id AS VARCHAR(20)) AS client_key, ts FROM events""",
    "fx_urls": """
SELECT page_id, url FROM pages
UNION ALL
SELECT page_id + 1000000, CASE WHEN page_id % 6 = 0 THEN concat('https://github.com/o', CAST(page_id AS VARCHAR(20)), '/r.git')
  WHEN page_id % 6 = 1 THEN concat('git@github.com:o/r', CAST(page_id AS VARCHAR(20)), '.git') WHEN page_id % 6 = 2 THEN 'github.com/about/x'
  WHEN page_id % 6 = 3 THEN 'https://github.com/o/r/tree/main/src/a.ts' WHEN page_id % 6 = 4 THEN 'https://github.com/o' ELSE '' END FROM pages""",
    "fx_runs": """
SELECT o_orderkey AS run_id, concat('fx:', CAST(o_orderkey % 4 AS VARCHAR(10))) AS repo_id, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 11 = 0 THEN 'cancelled' ELSE 'complete' END AS outcome,
  o_orderkey % 3 = 0 AS cached, o_custkey % 500 AS files, o_custkey % 5 AS failures, CAST(o_totalprice AS DOUBLE) AS duration_ms, o_orderkey % 1000 AS remaining, 5000 AS quota,
  CASE WHEN o_orderkey % 9 = 0 THEN 'HISTORY_UNAVAILABLE' WHEN o_orderkey % 9 = 1 THEN 'FETCH_FAILURES' WHEN o_orderkey % 9 = 2 THEN 'HISTORY_LIMITED' WHEN o_orderkey % 9 = 3 THEN 'PARSE_LIMIT' ELSE 'TREE_TRUNCATED' END AS code,
  CASE WHEN o_orderkey % 9 = 1 THEN 'rateLimited' WHEN o_orderkey % 9 = 2 THEN 'reason' WHEN o_orderkey % 9 = 3 THEN 'stoppedEarly' ELSE 'x' END AS detail_key,
  CASE WHEN o_orderkey % 9 = 1 THEN CAST(o_orderkey % 2 AS VARCHAR(5)) WHEN o_orderkey % 9 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'low-quota' ELSE 'unauthenticated' END WHEN o_orderkey % 9 = 3 THEN '1' ELSE '0' END AS detail_value,
  o_orderkey % 60 AS minutes_ago
FROM orders""",
    "fx_queries": """
SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN concat('f', CAST(item_id AS VARCHAR(20))) WHEN item_id % 5 = 1 THEN 'core/f'
  WHEN item_id % 5 = 2 THEN 'srcts' WHEN item_id % 5 = 3 THEN concat('sym', CAST(item_id AS VARCHAR(20))) ELSE '' END AS query
FROM benchmark""",
}
TABLES = ("customer", "documents", "events", "pages", "benchmark", "lineitem")
_NAME = re.compile(r"(?<=FROM )\w+|(?<=JOIN )\w+")


def needed(sql: str) -> list[str]:
    """The views that a query reads, those that they read first."""
    found: list[str] = []
    for name in dict.fromkeys(_NAME.findall(sql)):
        if name in VIEWS:
            found += [*needed(VIEWS[name]), name]
    return list(dict.fromkeys(found))


def view(spark: SparkSession, sf_dir: str, name: str, made: dict | None = None) -> DataFrame:
    if spark.sparkContext.master.startswith("local["):  # a cluster gets the package by --py-files
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    made = {} if made is None else made
    if name not in made:
        if name in VIEWS:
            sql = VIEWS[name]
            parts = {n: view(spark, sf_dir, n, made) for n in dict.fromkeys(_NAME.findall(sql))}
            made[name] = spark.sql(_NAME.sub(lambda m: f"{{{m[0]}}}", sql), **parts)
        else:
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            made[name] = table.withColumns({c: F.col(c).cast("timestamp") for c, kind in table.dtypes if kind == "timestamp_ntz"})
    return made[name]


def duck(sql: str, *more: str) -> str:
    """A DuckDB query over the views: `more` are further common tables, as text of the form `name AS (...)`."""
    tables = [f"{n} AS ({VIEWS[n]})" for n in needed(" ".join([*more, sql]))]
    return "WITH RECURSIVE " + ", ".join([*tables, *more]) + sql if tables or more else sql
