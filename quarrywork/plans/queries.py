"""The registered queries over the fixture views, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import paths as P
from ..functions import text as X
from ..operators import budgets as B
from ..operators import graph as G
from ..operators import history as H
from ..operators import resolve as D
from ..operators import rollups as R
from ..operators import scores as S
from ..operators import search as E
from ..sources import tree as T
from ..streaming import events as ST
from . import examples  # noqa: F401
from .registry import ORACLES, QUERIES, query  # noqa: F401


# --- shared parts in SQL -------------------------------------------------------------------------------------------------

def classified(name: str, source: str) -> str:
    """Common tables that add the classification columns to `source`, the last called `name`: what each kind of file name in the views is, typed."""
    return f"""{name}_0 AS (SELECT *, list_extract(string_split(path, '/'), -1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory,
    list_slice(string_split(path, '/'), 1, -2) AS segs, regexp_extract(path, '\\.([a-z.]+)$', 1) AS ending FROM {source}),
{name} AS (SELECT * EXCLUDE (ending),
    CASE ending WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'min.js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust'
      WHEN 'java' THEN 'java' WHEN 'md' THEN 'markdown' WHEN 'css' THEN 'css' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' WHEN 'rb' THEN 'ruby' ELSE 'unknown' END AS language,
    CASE ending WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'min.js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS parser_language,
    ending = 'png' AS is_binary, ending = 'min.js' OR path LIKE '%/vendor/lib/%' AS is_generated, length(path) - length(replace(path, '/', '')) AS depth,
    CASE WHEN path LIKE '%/vendor/lib/%' THEN 'vendor' WHEN ending = 'png' THEN 'asset' WHEN path LIKE '%/tests/%' THEN 'test' WHEN ending = 'md' OR (ending = 'css' AND path LIKE '%/docs/%') THEN 'docs'
      WHEN ending = 'css' THEN 'style' WHEN ending IN ('json', 'toml') THEN 'config' WHEN ending = 'mod' THEN 'other' ELSE 'source' END AS category FROM {name}_0)"""


PARSED = "('typescript', 'javascript', 'python', 'java', 'go', 'rust')"
FINE = "NOT list_has_any(string_split(path, '/'), ['', '.', '..'])"
INV = classified("inv", f"(SELECT repo_id, path, greatest(arg_min(size, ordinal), 0) AS size FROM fx_tree WHERE type = 'file' AND {FINE} GROUP BY repo_id, path)")
ESTIMATE = """CASE WHEN size <= 0 THEN 0 ELSE greatest(1, floor(size / CASE language WHEN 'typescript' THEN 34 WHEN 'javascript' THEN 32 WHEN 'python' THEN 32 WHEN 'java' THEN 38 WHEN 'go' THEN 30
  WHEN 'rust' THEN 34 WHEN 'markdown' THEN 50 WHEN 'json' THEN 26 WHEN 'toml' THEN 26 WHEN 'css' THEN 24 WHEN 'ruby' THEN 28 ELSE 36 END + 0.5)) END"""
LINES = r"CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END"
COUNTED = (
    f"known AS (SELECT repo_id, path, doc_id, CASE WHEN doc_id % 3 <> 0 THEN {LINES} END AS exact_lines FROM fx_docs)",
    f"""counted AS (SELECT i.*, k.path IS NOT NULL AS in_graph, CAST(coalesce(exact_lines, CASE WHEN is_binary THEN 0 ELSE {ESTIMATE} END) AS BIGINT) AS lines,
    exact_lines IS NULL AND NOT is_binary AND size > 0 AS lines_estimated, NOT (is_generated OR is_binary OR category = 'vendor') AS own,
    CASE WHEN is_binary THEN 'binary' WHEN exact_lines IS NULL THEN 'metadata-only' WHEN language IN {PARSED} THEN 'parsed' ELSE 'content-only' END AS status
    FROM inv i LEFT JOIN known k ON i.repo_id = k.repo_id AND i.path = k.path)""",
)
OWN = "own_counted AS (SELECT * FROM counted c WHERE own OR NOT (SELECT bool_or(own) FROM counted d WHERE d.repo_id = c.repo_id))"
UP = "unnest(list_concat(CASE WHEN {c} = '' THEN [] ELSE list_transform(range(1, len(string_split({c}, '/')) + 1), lambda i: array_to_string(list_slice(string_split({c}, '/'), 1, i), '/')) END, ['']))"


def inventory(v) -> DataFrame:
    return T.build_inventory(v("fx_tree"))


def known(v) -> DataFrame:
    return v("fx_docs").select("repo_id", "path", "doc_id", F.when(F.col("doc_id") % 3 != 0, P.count_lines(F.col("text"))).alias("exact_lines"))


def counted(v) -> DataFrame:
    status = F.when(F.col("is_binary"), "binary").when(F.col("lines_estimated") | F.col("exact_lines").isNull(), "metadata-only").when(P.is_parseable(F.col("language")), "parsed").otherwise("content-only")
    files = known(v)
    return R.line_contribution(inventory(v), files).join(files.select("repo_id", "path", "exact_lines"), ["repo_id", "path"], "left").withColumn("status", status).drop("exact_lines")


# --- sources and path functions ------------------------------------------------------------------------------------------

query("build_inventory", "SELECT repo_id, path, size, language, parser_language, category, is_generated, is_binary, depth, directory FROM inv", INV)(
    lambda v: inventory(v).select("repo_id", "path", "size", "language", "parser_language", "category", "is_generated", "is_binary", "depth", "directory"))
query("excluded_counts", "SELECT repo_id, count(*) FILTER (WHERE type = 'submodule') AS submodules, count(*) FILTER (WHERE type = 'symlink') AS symlinks FROM fx_tree GROUP BY repo_id")(
    lambda v: T.excluded_counts(v("fx_tree")))
OK = "length(path) BETWEEN 1 AND 1024 AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(path, '(?i)(^|/)(\\.|%2e){0,2}(/|$)')"
query("sanitize_paths", f"SELECT repo_id, ordinal, path, {OK} AS accepted FROM fx_tree")(lambda v: T.sanitize_paths(v("fx_tree")).select("repo_id", "ordinal", "path", "accepted"))
query("cap_tree", f"""SELECT repo_id, path, ordinal, n > 50 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ordinal) AS place, count(*) OVER (PARTITION BY repo_id) AS n
  FROM (SELECT repo_id, path, min(ordinal) AS ordinal FROM fx_tree WHERE {OK} GROUP BY repo_id, path)) WHERE place <= 50""")(lambda v: T.cap_tree(v("fx_tree"), 50))
query("path_parts", r"""SELECT repo_id, path, ordinal, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, list_extract(string_split(path, '/'), -1) AS base,
  lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+\.([^.]+)$', 1)) AS extension, length(path) - length(replace(path, '/', '')) AS depth FROM fx_tree""")(
    lambda v: v("fx_tree").select("repo_id", "path", "ordinal", P.parent_path(F.col("path")).alias("parent"), P.base_name(F.col("path")).alias("base"), P.extension_of(F.col("path")).alias("extension"), P.depth_of(F.col("path")).alias("depth")))
query("make_ids", "SELECT repo_id, path, name, concat('sym:', path, '#', name, '@', start_line) AS id, path AS parsed, 'symbol' AS kind FROM fx_symbols")(
    lambda v: v("fx_symbols").withColumn("id", P.symbol_id(F.col("path"), F.col("name"), F.col("start_line"))).select("repo_id", "path", "name", "id", P.path_from_id(F.col("id")).alias("parsed"), P.kind_from_id(F.col("id")).alias("kind")))
query("ancestor_directories", f"SELECT DISTINCT repo_id, path, {UP.format(c='directory')} AS directory FROM (SELECT repo_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM fx_docs)")(
    lambda v: R.files_under(v("fx_docs")).select("repo_id", "path", "directory"))
query("path_predicates", r"""SELECT doc_id, starts_with(path, 'src1/') AS within, regexp_replace(path, '\.[^./]+$', '') AS stem,
  CASE WHEN string_split(path, '/')[1] <> 'src1' THEN 0 WHEN list_slice(string_split(path, '/'), 1, -2)[2] = 'src' THEN CASE WHEN list_slice(string_split(path, '/'), 1, -2)[3] = 'core' THEN 3 ELSE 2 END ELSE 1 END AS shared FROM fx_docs""")(
    lambda v: v("fx_docs").select("doc_id", P.is_within(F.col("path"), F.lit("src1")).alias("within"), P.strip_extension(F.col("path")).alias("stem"), P.shared_prefix_length(F.col("path"), F.lit("src1/src/core/f")).alias("shared")))
query("area_of", f"""SELECT doc_id, list_has_any(segs, ['docs', 'examples']) AS auxiliary, CASE WHEN len(segs) = 0 THEN '' WHEN len(segs) > 1 AND segs[1] = 'packages' THEN concat(segs[1], '/', segs[2]) ELSE segs[1] END AS area
  FROM (SELECT doc_id, list_slice(string_split(substr(path, strpos(path, '/') + 1), '/'), 1, -2) AS segs FROM fx_docs)""")(
    lambda v: v("fx_docs").withColumn("path", F.expr("substr(path, locate('/', path) + 1)")).select("doc_id", P.is_auxiliary(F.col("path")).alias("auxiliary"), P.area_of(F.col("path")).alias("area")))
query("estimate_lines", f"SELECT repo_id, path, CAST({ESTIMATE} AS BIGINT) AS lines FROM inv", INV)(lambda v: inventory(v).select("repo_id", "path", P.estimate_lines(F.col("size"), F.col("language")).alias("lines")))
query("count_lines", f"SELECT doc_id, {LINES} AS lines FROM fx_docs")(lambda v: v("fx_docs").select("doc_id", P.count_lines(F.col("text")).alias("lines")))

# --- texts ---------------------------------------------------------------------------------------------------------------

query("symbol_title", """SELECT DISTINCT repo_id, path, name, kind, start_line, end_line, CASE WHEN kind IN ('function', 'method') THEN concat(name, '()') ELSE name END AS title,
  CASE WHEN start_line = end_line THEN concat('line ', start_line) ELSE concat('lines ', start_line, '–', end_line) END AS label FROM fx_symbols""")(
    lambda v: v("fx_symbols").select("repo_id", "path", "name", "kind", "start_line", "end_line", X.symbol_title(F.col("name"), F.col("kind")).alias("title"), X.line_range_label(F.col("start_line"), F.col("end_line")).alias("label")).distinct())
query("prepare_queries", "SELECT query_id, lower(substr(replace(query, ' ', ''), 1, 64)) AS query FROM fx_queries")(lambda v: v("fx_queries").select("query_id", X.prepare_query(F.col("query")).alias("query")))
# --- roll-ups ------------------------------------------------------------------------------------------------------------

query("own_files", "SELECT repo_id, path FROM own_counted", INV, *COUNTED, OWN)(lambda v: R.own_files(counted(v)).select("repo_id", "path"))
query("line_contribution", "SELECT repo_id, path, lines, lines_estimated, in_graph FROM counted", INV, *COUNTED)(lambda v: R.line_contribution(inventory(v), known(v)).select("repo_id", "path", "lines", "lines_estimated", "in_graph"))
ROLLED = f"""rolled AS (SELECT repo_id, dir AS path, count(*) AS file_count, count(*) FILTER (WHERE dir = directory) AS direct_file_count,
  CAST(sum(CASE WHEN use THEN lines ELSE 0 END) AS BIGINT) AS total_lines, bool_or(use AND lines_estimated) AS lines_estimated, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE NOT in_graph) AS omitted_file_count
  FROM (SELECT c.*, {UP.format(c='c.directory')} AS dir, own OR NOT (SELECT bool_or(own) FROM counted d WHERE d.repo_id = c.repo_id) AS use FROM counted c) GROUP BY repo_id, dir)"""
query("directory_rollup", """SELECT r.*, coalesce(n, 0) AS direct_directory_count, CASE WHEN path = '' THEN 0 ELSE length(path) - length(replace(path, '/', '')) + 1 END AS depth
  FROM rolled r LEFT JOIN (SELECT repo_id AS k, regexp_extract(path, '^(.*)/[^/]*$', 1) AS p, count(*) AS n FROM rolled WHERE path <> '' GROUP BY ALL) ON k = repo_id AND p = path""", INV, *COUNTED, ROLLED)(
    lambda v: R.directory_rollup(counted(v)))
query("largest_directories", "SELECT repo_id, path, total_lines, file_count, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY total_lines DESC, path) AS place FROM rolled) WHERE place <= 20", INV, *COUNTED, ROLLED)(
    lambda v: R.largest_directories(R.directory_rollup(counted(v))).select("repo_id", "path", "total_lines", "file_count", "place"))
query("directory_language_bytes", f"""SELECT repo_id, dir AS path, string_agg(concat(language, '=', bytes), ',' ORDER BY language) AS language_bytes FROM (
  SELECT repo_id, dir, language, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT repo_id, language, size, {UP.format(c='directory')} AS dir FROM inv) GROUP BY ALL) GROUP BY repo_id, dir""", INV)(
    lambda v: R.directory_language_bytes(inventory(v)).withColumn("language_bytes", F.array_join(F.transform(F.array_sort(F.map_entries("language_bytes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")))
STATS = f"""stats AS (SELECT *, CASE WHEN total > 0 THEN bytes / total ELSE 0.0 END AS share FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY repo_id) AS BIGINT) AS total FROM (
  SELECT repo_id, language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines, language IN {PARSED} AS parseable FROM own_counted GROUP BY repo_id, language)))"""
query("language_stats", "SELECT * EXCLUDE (total) FROM stats", INV, *COUNTED, OWN, STATS)(lambda v: R.language_stats(counted(v)))
query("language_segments", """SELECT repo_id, segment, place, CASE WHEN segment = 'other' THEN concat(count(*), ' others') ELSE segment END AS name, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(files) AS BIGINT) AS files, sum(bytes) / any_value(t) AS share FROM (
  SELECT *, CASE WHEN n > 4 AND p >= 4 THEN 'other' ELSE language END AS segment, CASE WHEN n > 4 AND p >= 4 THEN 4 ELSE p END AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, language) AS p, count(*) OVER (PARTITION BY repo_id) AS n, CAST(sum(bytes) OVER (PARTITION BY repo_id) AS BIGINT) AS t FROM stats WHERE bytes > 0)) GROUP BY repo_id, segment, place""", INV, *COUNTED, OWN, STATS)(
    lambda v: R.language_segments(R.language_stats(counted(v)), 4))
query("determine_tier", "SELECT repo_id, count(*) AS files, CASE WHEN count(*) <= 1000 THEN 'full' WHEN count(*) <= 10000 THEN 'progressive' ELSE 'directory-first' END AS tier FROM inv GROUP BY repo_id", INV)(lambda v: R.determine_tier(inventory(v)))
query("unsupported_languages", f"SELECT repo_id, language, count(*) AS files FROM inv WHERE NOT is_generated AND category = 'source' AND language NOT IN {PARSED} GROUP BY ALL", INV)(lambda v: R.unsupported_languages(inventory(v)))
query("parse_coverage", f"""SELECT *, CASE WHEN eligible = 0 THEN 1.0::DOUBLE ELSE parsed / eligible END AS share FROM (SELECT repo_id, count(*) FILTER (WHERE fit AND status = 'parsed') AS parsed, count(*) FILTER (WHERE fit) AS eligible
  FROM (SELECT *, language IN {PARSED} AND NOT is_generated AND status <> 'binary' AS fit FROM counted) GROUP BY repo_id)""", INV, *COUNTED)(lambda v: R.parse_coverage(counted(v)))
query("largest_files", "SELECT repo_id, path, lines, size, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, size DESC, path) AS place FROM counted WHERE own) WHERE place <= 5", INV, *COUNTED)(
    lambda v: R.largest_files(counted(v)).select("repo_id", "path", "lines", "size", "place"))
query("tree_listing", """SELECT repo_id, parent, path, kind, place, siblings, CAST(floor((place - 1) / 20) AS BIGINT) AS page, greatest(0, siblings - CAST(floor((place - 1) / 20) + 1 AS BIGINT) * 20) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, parent ORDER BY kind, lower(base), base) AS place, count(*) OVER (PARTITION BY repo_id, parent) AS siblings FROM (
    SELECT *, list_extract(string_split(path, '/'), -1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM (SELECT repo_id, path, CAST(0 AS BIGINT) AS kind FROM rolled WHERE path <> '' UNION ALL SELECT repo_id, path, 1 FROM inv)))""", INV, *COUNTED, ROLLED)(
    lambda v: R.tree_listing(R.directory_rollup(counted(v)), inventory(v), 20))
query("files_under", f"SELECT repo_id, path, {UP.format(c='directory')} AS directory FROM inv", INV)(lambda v: R.files_under(inventory(v)))
query("category_emphasis", "SELECT repo_id, path, CASE WHEN is_generated OR category = 'vendor' THEN 0.4 WHEN category IN ('test', 'docs', 'config') THEN 0.88 ELSE 1.0 END::DOUBLE AS emphasis, CAST(CASE WHEN lines_estimated THEN 1 ELSE 0 END + CASE WHEN is_binary THEN 2 ELSE 0 END + CASE WHEN is_generated THEN 4 ELSE 0 END AS BIGINT) AS flags FROM counted", INV, *COUNTED)(
    lambda v: counted(v).select("repo_id", "path", R.category_emphasis().alias("emphasis"), R.honesty_flags().alias("flags")))
CLASS = "CASE category WHEN 'source' THEN 0 WHEN 'test' THEN 1 WHEN 'config' THEN 2 WHEN 'style' THEN 2 WHEN 'docs' THEN 3 WHEN 'asset' THEN 6 WHEN 'vendor' THEN 7 ELSE 5 END + CASE WHEN is_generated THEN 8 ELSE 0 END"
DEPTH = "CASE WHEN directory = '' THEN 0 ELSE length(directory) - length(replace(directory, '/', '')) + 1 END"
query("select_graph_files", f"""SELECT repo_id, path, first AND n > 40 AS representative FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, first ORDER BY class, round, {DEPTH}, directory) AS place, CAST(sum(first::INT) OVER (PARTITION BY repo_id) AS BIGINT) AS taken FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, class, directory, first ORDER BY depth, path) AS round FROM (
    SELECT *, rep AND row_number() OVER (PARTITION BY repo_id, rep ORDER BY class, depth, path) <= 20 AS first FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, directory ORDER BY class, depth, path) = 1 AND NOT is_generated AND category <> 'vendor' AS rep, count(*) OVER (PARTITION BY repo_id) AS n FROM (SELECT *, {CLASS} AS class FROM inv)))))
  WHERE n <= 40 OR first OR place <= 40 - taken""", INV)(lambda v: R.select_graph_files(inventory(v), 40))

# --- history -------------------------------------------------------------------------------------------------------------

WHO = "coalesce(CASE WHEN length(trim({l})) > 0 THEN concat('user:', lower(trim({l}))) END, CASE WHEN length(trim({n})) > 0 THEN concat('author:', lower(regexp_replace(trim({n}), '\\s+', ' ', 'g'))) END)"
AUTHORED = f"authored AS (SELECT *, {WHO.format(l='author_login', n='author_name')} AS author_id FROM fx_commits)"
CHANGES = "changes AS (SELECT c.* FROM fx_commit_files c SEMI JOIN fx_docs d ON c.repo_id = d.repo_id AND c.path = d.path)"


def changes(v) -> DataFrame:
    return H.commit_files_in_graph(v("fx_commit_files"), v("fx_docs"))


def micros(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.unix_micros(c))
    return df


def cursor():
    return F.expr("TIMESTAMP '2024-01-20 00:00:00'")


query("contributor_id", f"SELECT repo_id, sha, {WHO.format(l='author_login', n='author_name')} AS author_id FROM fx_commits")(lambda v: H.with_authors(v("fx_commits")).select("repo_id", "sha", "author_id"))
query("commit_files_in_graph", "SELECT f.repo_id, sha, count(*) AS changed, count(d.path) AS in_graph FROM fx_commit_files f LEFT JOIN fx_docs d ON d.repo_id = f.repo_id AND d.path = f.path GROUP BY f.repo_id, sha")(
    lambda v: H.changed_counts(v("fx_commit_files"), changes(v)))
query("merge_commits", "SELECT repo_id, sha, message, author_login, author_name, epoch_us(date) AS date, has_details, row_number() OVER (PARTITION BY repo_id ORDER BY date DESC NULLS LAST, sha) AS place FROM fx_commits")(
    lambda v: micros(H.merge_commits(v("fx_commits"), v("fx_commits").filter("has_details")), "date"))
ACTIVITY = "activity AS (SELECT c.repo_id, c.path, count(*) AS commit_count, max(date) AS last_modified, arg_min(author_id, (-epoch_us(date), a.sha)) AS last_author_id, count(DISTINCT author_id) AS contributors FROM changes c JOIN authored a ON a.repo_id = c.repo_id AND a.sha = c.sha GROUP BY c.repo_id, c.path)"
query("file_activity", "SELECT repo_id, path, commit_count, epoch_us(last_modified) AS last_modified, last_author_id, contributors FROM activity", AUTHORED, CHANGES, ACTIVITY)(lambda v: micros(H.file_activity(v("fx_commits"), changes(v)), "last_modified"))
PEOPLE = f"""listed AS (SELECT repo_id, {WHO.format(l='login', n='name')} AS id, max(contributions) AS contributions, min(login) AS login FROM fx_contributors GROUP BY ALL),
made AS (SELECT repo_id, author_id AS id, count(*) AS n, arg_min(trim(author_name), (-epoch_us(date), sha)) AS cname FROM authored WHERE author_id IS NOT NULL GROUP BY ALL),
touched AS (SELECT repo_id, id, count(*) AS files FROM (SELECT DISTINCT c.repo_id, author_id AS id, path FROM changes c JOIN authored a ON a.repo_id = c.repo_id AND a.sha = c.sha WHERE author_id IS NOT NULL) GROUP BY ALL),
people AS (SELECT coalesce(l.repo_id, m.repo_id) AS repo_id, coalesce(l.id, m.id) AS id, coalesce(cname, login, coalesce(l.id, m.id)) AS name, coalesce(contributions, 0) AS contributions, coalesce(n, 0) AS commit_count, coalesce(files, 0) AS files
  FROM listed l FULL JOIN made m ON l.repo_id = m.repo_id AND l.id = m.id LEFT JOIN touched t ON t.repo_id = coalesce(l.repo_id, m.repo_id) AND t.id = coalesce(l.id, m.id))"""
query("contributors", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY contributions DESC, commit_count DESC, lower(name), id) AS place FROM people) WHERE place <= 200", AUTHORED, CHANGES, PEOPLE)(
    lambda v: H.contributors(v("fx_commits"), v("fx_contributors"), changes(v)))
query("rank_contributors", """SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY contributions DESC, commit_count DESC, lower(name), id) AS by_provider,
  row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, commit_count DESC, contributions DESC, id) AS by_panel, row_number() OVER (PARTITION BY repo_id ORDER BY commit_count DESC, contributions DESC, id) AS by_palette, files > 0 OR commit_count > 0 AS active FROM people""", AUTHORED, CHANGES, PEOPLE)(
    lambda v: H.rank_contributors(H.contributors(v("fx_commits"), v("fx_contributors"), changes(v), 1 << 30)))
query("file_top_contributors", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY commits DESC, author_id) AS place FROM (
  SELECT c.repo_id, path, author_id, count(*) AS commits FROM changes c JOIN authored a ON a.repo_id = c.repo_id AND a.sha = c.sha WHERE author_id IS NOT NULL GROUP BY ALL)) WHERE place <= 10""", AUTHORED, CHANGES)(
    lambda v: H.file_top_contributors(v("fx_commits"), changes(v)))
query("recent_commits", "SELECT repo_id, author_id, sha, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, author_id ORDER BY date DESC NULLS LAST, sha) AS place FROM authored WHERE author_id IS NOT NULL) WHERE place <= 8", AUTHORED)(
    lambda v: H.recent_commits(v("fx_commits")).select("repo_id", "author_id", "sha", "place"))
query("history_summary", """SELECT c.repo_id, count(*) AS commits, count(*) FILTER (WHERE has_details) AS with_details, epoch_us(min(date)) AS oldest, epoch_us(max(date)) AS newest,
  (SELECT count(last_modified) FROM activity a WHERE a.repo_id = c.repo_id) AS files_with_activity FROM fx_commits c GROUP BY c.repo_id""", AUTHORED, CHANGES, ACTIVITY)(
    lambda v: micros(H.history_summary(v("fx_commits"), H.file_activity(v("fx_commits"), changes(v))), "oldest", "newest"))
IN30 = "date > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND date <= TIMESTAMP '2024-01-20'"
query("commits_in_window", f"SELECT repo_id, sha FROM fx_commits WHERE {IN30}")(lambda v: H.commits_in_window(v("fx_commits"), cursor(), 7).select("repo_id", "sha"))
query("window_top_files", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY changes DESC, path) AS place FROM (SELECT c.repo_id, path, count(*) AS changes FROM changes c
  SEMI JOIN (SELECT * FROM authored WHERE {IN30} AND has_details) w ON w.repo_id = c.repo_id AND w.sha = c.sha GROUP BY ALL)) WHERE place <= 5""", AUTHORED, CHANGES)(lambda v: H.window_top_files(v("fx_commits"), changes(v), cursor(), 7))
BUCKETS = """spans AS (SELECT repo_id, min(date) AS lo, max(date) AS hi, (epoch_us(max(date)) - epoch_us(min(date))) / 86400000000 AS days FROM fx_commits GROUP BY repo_id),
units AS (SELECT *, CASE WHEN days <= 45 THEN 'day' WHEN days <= 365 THEN 'week' WHEN days <= 1460 THEN 'month' ELSE 'quarter' END AS granularity FROM spans),
steps AS (SELECT *, CASE granularity WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END AS step FROM units),
spine AS (SELECT repo_id, granularity, step, unnest(range(date_trunc(granularity, lo)::TIMESTAMP, date_trunc(granularity, hi)::TIMESTAMP + step, step)) AS bucket_start FROM steps),
buckets AS (SELECT s.repo_id, bucket_start, bucket_start + any_value(step) AS bucket_end, any_value(s.granularity) AS granularity, count(c.sha) AS commits FROM spine s LEFT JOIN fx_commits c ON c.repo_id = s.repo_id AND date_trunc(s.granularity, c.date)::TIMESTAMP = bucket_start GROUP BY s.repo_id, bucket_start)"""
query("bucket_commits", "SELECT repo_id, epoch_us(bucket_start) AS bucket_start, epoch_us(bucket_end) AS bucket_end, granularity, commits FROM buckets", BUCKETS)(lambda v: micros(H.bucket_commits(v("fx_commits")), "bucket_start", "bucket_end"))
query("histogram_bars", "SELECT repo_id, epoch_us(bucket_start) AS bucket_start, commits, CASE WHEN commits = 0 THEN 0.0::DOUBLE ELSE greatest(0.06::DOUBLE, commits / max(commits) OVER (PARTITION BY repo_id)) END AS height FROM buckets", BUCKETS)(
    lambda v: micros(H.histogram_bars(H.bucket_commits(v("fx_commits"))), "bucket_start").select("repo_id", "bucket_start", "commits", "height"))
query("timeline_extent", "SELECT repo_id, epoch_us(min(bucket_start)) AS start, epoch_us(max(bucket_end)) AS end FROM buckets GROUP BY repo_id", BUCKETS)(
    lambda v: micros(H.timeline_extent(H.bucket_commits(v("fx_commits")), v("fx_commits")), "start", "end"))
query("count_commits_in_ranges", """SELECT r.repo_id, epoch_us(a) AS start, epoch_us(b) AS end, count(sha) AS commits FROM (SELECT DISTINCT repo_id, date_trunc('hour', date)::TIMESTAMP AS a, date_trunc('hour', date)::TIMESTAMP + INTERVAL 30 HOUR AS b FROM fx_commits) r
  LEFT JOIN fx_commits c ON c.repo_id = r.repo_id AND c.date >= a AND c.date < b GROUP BY r.repo_id, a, b""")(
    lambda v: micros(H.count_commits_in_ranges(v("fx_commits").select("repo_id", F.date_trunc("hour", "date").alias("start")).distinct().withColumn("end", F.col("start") + F.expr("INTERVAL 30 HOURS")), v("fx_commits")), "start", "end"))
query("most_active_areas", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, author_id ORDER BY files DESC, area) AS place FROM (SELECT repo_id, author_id, area, count(*) AS files FROM (
  SELECT repo_id, author_id, unnest(list_slice([p[1], concat(p[1], '/', p[2])], 1, least(2, len(p) - 1))) AS area FROM (SELECT DISTINCT c.repo_id, author_id, path, string_split(path, '/') AS p FROM changes c JOIN authored a ON a.repo_id = c.repo_id AND a.sha = c.sha WHERE author_id IS NOT NULL)) GROUP BY ALL)) WHERE place <= 3""", AUTHORED, CHANGES)(
    lambda v: H.most_active_areas(v("fx_commits"), changes(v)))

# --- graph ---------------------------------------------------------------------------------------------------------------


def statements(v) -> DataFrame:
    doc = lambda c: F.concat(F.lit("file:"), F.col(c).cast("string"))
    return v("fx_imports").select("repo_id", doc("source_doc").alias("source"), "seq", "kind", doc("target_doc").alias("target"))


def states(v) -> DataFrame:
    state = F.when(F.col("target_doc").isNotNull(), "resolved").when(F.col("specifier").startswith("@/"), "unresolved").otherwise("external")
    return v("fx_imports").withColumn("state", state)


def packages(v) -> DataFrame:
    outer = states(v).filter("state = 'external'").withColumn("package", N.external_package(F.col("specifier"))).withColumn("language", P.detect_language(F.col("path")))
    return G.external_packages(outer)


STATE = "CASE WHEN target_doc IS NOT NULL THEN 'resolved' WHEN starts_with(specifier, '@/') THEN 'unresolved' ELSE 'external' END"
query("dependency_edges", "SELECT * FROM fx_edges")(lambda v: G.dependency_edges(statements(v)))
query("edges_of_kind", "SELECT repo_id, edge_id FROM fx_edges WHERE kind IN ('import', 'require') AND source <> target")(lambda v: G.edges_of_kind(G.dependency_edges(statements(v)), ["import", "require"]).select("repo_id", "edge_id"))
ENDS = "ends AS (SELECT repo_id, source AS file, target AS imports, CAST(NULL AS VARCHAR) AS importer, weight FROM fx_edges UNION ALL SELECT repo_id, target, CAST(NULL AS VARCHAR), source, weight FROM fx_edges)"
CONNECTED = "connected AS (SELECT *, imported_by + imports AS degree FROM (SELECT repo_id, file, count(DISTINCT importer) AS imported_by, count(DISTINCT imports) AS imports, CAST(sum(weight) AS BIGINT) AS weight FROM ends GROUP BY repo_id, file))"
query("rank_connectivity", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, imported_by DESC, weight DESC, file) AS place FROM connected) WHERE place <= 10", ENDS, CONNECTED)(lambda v: G.rank_connectivity(v("fx_edges")))
query("degree", "SELECT repo_id, file, count(*) AS degree FROM ends GROUP BY repo_id, file", ENDS)(lambda v: G.degrees(v("fx_edges")))
query("import_stats", f"SELECT repo_id, path, count(*) AS found, count(*) FILTER (WHERE s = 'resolved') AS resolved, count(*) FILTER (WHERE s = 'external') AS external, count(*) FILTER (WHERE s = 'unresolved') AS unresolved FROM (SELECT *, {STATE} AS s FROM fx_imports) GROUP BY repo_id, path")(
    lambda v: G.import_stats(states(v), "repo_id", "path"))
query("import_resolution_by_language", f"SELECT repo_id, language, count(*) AS found, count(*) FILTER (WHERE s = 'resolved') AS resolved, count(*) FILTER (WHERE s = 'external') AS external, count(*) FILTER (WHERE s = 'unresolved') AS unresolved FROM (SELECT i.repo_id, l.language, {STATE} AS s FROM fx_imports i JOIN langs l ON i.repo_id = l.repo_id AND i.path = l.path) GROUP BY repo_id, language", classified("langs", "fx_docs"))(
    lambda v: G.import_stats(states(v).withColumn("language", P.detect_language(F.col("path"))), "repo_id", "language"))
PACKAGES = f"""outer_ AS (SELECT i.repo_id, i.path, l.language, CASE WHEN specifier = 'fs/promises' THEN 'node:fs' WHEN starts_with(specifier, '@') THEN regexp_extract(specifier, '^@[^/]+/[^/]+') ELSE specifier END AS package FROM fx_imports i JOIN langs l ON i.repo_id = l.repo_id AND i.path = l.path WHERE {STATE} = 'external'),
packages AS (SELECT repo_id, package, CAST(sum(n) AS BIGINT) AS import_count, arg_min(language, (-n, language)) AS language, (SELECT count(DISTINCT path) FROM outer_ o WHERE o.repo_id = p.repo_id AND o.package = p.package) AS file_count
  FROM (SELECT repo_id, package, language, count(*) AS n FROM outer_ GROUP BY ALL) p GROUP BY repo_id, package)"""
query("external_packages", "SELECT * FROM packages", classified("langs", "fx_docs"), PACKAGES)(lambda v: packages(v))
query("top_external_packages", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY import_count DESC, file_count DESC, package) AS place FROM packages) WHERE place <= 5", classified("langs", "fx_docs"), PACKAGES)(lambda v: G.top_external_packages(packages(v)))
SELECTED = "SELECT repo_id, file FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, imported_by DESC, weight DESC, file) AS place FROM connected) WHERE place <= 3"
query("related_files", f"""SELECT repo_id, file, bool_or(o) AS outgoing, bool_or(NOT o) AS incoming FROM (SELECT e.repo_id, target AS file, true AS o FROM fx_edges e SEMI JOIN ({SELECTED}) s ON e.repo_id = s.repo_id AND e.source = s.file
  UNION ALL SELECT e.repo_id, source, false FROM fx_edges e SEMI JOIN ({SELECTED}) s ON e.repo_id = s.repo_id AND e.target = s.file) r ANTI JOIN ({SELECTED}) s USING (repo_id, file) GROUP BY repo_id, file""", ENDS, CONNECTED)(
    lambda v: G.related_files(v("fx_edges"), G.rank_connectivity(v("fx_edges"), 3)))
query("budget_edges", "SELECT repo_id, edge_id, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY weight DESC, edge_id) AS place FROM fx_edges) WHERE place <= 100")(lambda v: G.budget_edges(v("fx_edges"), 100).select("repo_id", "edge_id", "weight", "place"))
PATHED = "pathed AS (SELECT e.repo_id, a.path AS sp, b.path AS tp, weight FROM fx_edges e JOIN fx_docs a ON e.source = concat('file:', a.doc_id) JOIN fx_docs b ON e.target = concat('file:', b.doc_id))"
query("intra_directory_adjacency", """SELECT repo_id, a, b, CAST(greatest(1, sum(weight)) AS BIGINT) AS weight FROM (SELECT repo_id, sp AS a, tp AS b, weight FROM pathed UNION ALL SELECT repo_id, tp, sp, weight FROM pathed) WHERE a <> b AND regexp_extract(a, '^(.*)/[^/]*$', 1) = regexp_extract(b, '^(.*)/[^/]*$', 1) GROUP BY repo_id, a, b""", PATHED)(
    lambda v: G.intra_directory_adjacency(with_paths(v)))


def with_paths(v) -> DataFrame:
    """The tables' edges go by number alone: an end may lie in another repository."""
    docs = v("fx_docs").select(F.concat(F.lit("file:"), F.col("doc_id").cast("string")).alias("id"), "path")
    edges = v("fx_edges")
    for end in ("source", "target"):
        edges = edges.join(docs.select(F.col("id").alias(end), F.col("path").alias(f"{end}_path")), end)
    return edges


REACH = """walk AS (SELECT repo_id, source AS a, target AS b FROM fx_edges UNION SELECT w.repo_id, a, target FROM walk w JOIN fx_edges e ON e.repo_id = w.repo_id AND e.source = b),
mates AS (SELECT x.repo_id, x.a AS node, max(x.b) AS component FROM walk x JOIN walk y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a GROUP BY x.repo_id, x.a)"""
query("import_cycles", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, first) AS place FROM (
  SELECT m.repo_id, m.component, count(*) AS size, min(node) AS first, (SELECT count(*) FROM fx_edges e JOIN mates s ON s.repo_id = e.repo_id AND s.node = e.source JOIN mates t ON t.repo_id = e.repo_id AND t.node = e.target WHERE e.repo_id = m.repo_id AND s.component = m.component AND t.component = m.component) AS edges
  FROM mates m GROUP BY m.repo_id, m.component HAVING count(*) > 1)) WHERE place <= 50""", REACH)(lambda v: G.import_cycles(v("fx_edges")))

# --- scores --------------------------------------------------------------------------------------------------------------


def scored(v) -> DataFrame:
    symbols = v("fx_symbols").groupBy("repo_id", "path").agg(F.count("*").alias("symbols"))
    degree = G.degrees(with_paths(v).select("repo_id", F.col("source_path").alias("source"), F.col("target_path").alias("target"))).withColumnRenamed("file", "path")
    return counted(v).join(symbols, ["repo_id", "path"], "left").join(degree, ["repo_id", "path"], "left").fillna(0, ["symbols", "degree"])


SCORED = (
    PATHED,
    """measured AS (SELECT c.*, coalesce(s, 0) AS symbols, coalesce(d, 0) AS degree FROM counted c LEFT JOIN (SELECT repo_id, path, count(*) AS s FROM fx_symbols GROUP BY ALL) x ON x.repo_id = c.repo_id AND x.path = c.path
  LEFT JOIN (SELECT repo_id, path, count(*) AS d FROM (SELECT repo_id, sp AS path FROM pathed UNION ALL SELECT repo_id, tp FROM pathed) GROUP BY ALL) y ON y.repo_id = c.repo_id AND y.path = c.path)""",
    "maxima AS (SELECT repo_id, greatest(1, max(lines)) AS max_lines, greatest(1, max(symbols)) AS max_symbols, greatest(1, max(degree)) AS max_degree FROM measured GROUP BY repo_id)",
)
query("graph_maxima", "SELECT * FROM maxima", INV, *COUNTED, *SCORED)(lambda v: S.graph_maxima(scored(v)))
query("complexity_score", """SELECT m.repo_id, path, round(CASE WHEN status = 'binary' THEN 0 WHEN status = 'parsed' THEN least(1, 0.5 * ln(1 + lines) / ln(1 + max_lines) + 0.28 * sqrt(symbols / max_symbols) + 0.22 * sqrt(degree / max_degree)) ELSE ln(1 + lines) / ln(1 + max_lines) END, 9)::DOUBLE AS complexity
  FROM measured m JOIN maxima x ON x.repo_id = m.repo_id""", INV, *COUNTED, *SCORED)(lambda v: S.complexity_score(scored(v)).select("repo_id", "path", F.round("complexity", 9).alias("complexity")))
query("size_measures", """SELECT repo_id, path, round(1 + 5 * sqrt(least(size, 65536) / 65536.0), 9)::DOUBLE AS footprint, round(CASE WHEN lines = 0 OR is_binary THEN 1 ELSE 1 + 5 * least(sqrt(lines) / (sqrt(lines) + sqrt(1500)), CASE WHEN is_generated THEN 0.12 ELSE 1 END) END, 9)::DOUBLE AS height FROM counted""", INV, *COUNTED)(
    lambda v: counted(v).select("repo_id", "path", *[F.round(c, 9).alias(n) for c, n in zip(S.size_measures(F.col("size"), F.col("lines"), F.col("is_generated"), F.col("is_binary")), ("footprint", "height"))]))
query("recency_score", """SELECT a.repo_id, path, round(0.8 * CASE WHEN hi > lo THEN (epoch_us(last_modified) - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo)) ELSE 1 END + 0.2 * exp(-greatest(0, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(last_modified)) / 1000000) / 15552000.0), 9)::DOUBLE AS recency
  FROM activity a JOIN (SELECT repo_id, min(last_modified) AS lo, max(last_modified) AS hi FROM activity GROUP BY repo_id) s ON s.repo_id = a.repo_id""", AUTHORED, CHANGES, ACTIVITY)(
    lambda v: S.recency_score(H.file_activity(v("fx_commits"), changes(v)), F.expr("TIMESTAMP '2024-03-01'")).select("repo_id", "path", F.round("recency", 9).alias("recency")))
query("activity_heat", """SELECT repo_id, path, round(CASE WHEN age BETWEEN 0 AND 7 THEN 1 - age / 7 END, 9) AS heat FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(last_modified)) / 86400000000 AS age FROM activity)""", AUTHORED, CHANGES, ACTIVITY)(
    lambda v: S.activity_heat(H.file_activity(v("fx_commits"), changes(v)), cursor(), 7).select("repo_id", "path", F.round("heat", 9).alias("heat")))
query("dependency_strength", "SELECT repo_id, file, round(sqrt(degree / max(degree) OVER (PARTITION BY repo_id)), 9) AS strength FROM (SELECT repo_id, file, count(*) AS degree FROM ends GROUP BY repo_id, file)", ENDS)(
    lambda v: S.dependency_strength(G.degrees(v("fx_edges"))).select("repo_id", "file", F.round("strength", 9).alias("strength")))

# --- budgets -------------------------------------------------------------------------------------------------------------

CONFIG = r"(name IN ('package.json', 'go.mod', 'Cargo.toml', 'pyproject.toml', 'setup.py', 'setup.cfg') OR regexp_matches(name, '^(tsconfig|jsconfig)(\..+)?\.json$'))"
query("fetch_plan_classify", f"""SELECT repo_id, path, CASE WHEN is_binary THEN 'binary' WHEN is_generated OR category = 'vendor' THEN 'generated' WHEN parser_language IS NOT NULL AND size <= 3000 THEN 'parse' WHEN {CONFIG} THEN 'free'
  WHEN parser_language IS NOT NULL AND size <= 8000 THEN 'oversized' WHEN parser_language IS NOT NULL THEN 'size-limit' WHEN size <= 5000 THEN 'text' ELSE 'not-parseable' END AS class FROM inv""", INV)(
    lambda v: (lambda i: i.select("repo_id", "path", B.fetch_class(R.is_config(), 3000, 8000, 5000).alias("class")))(inventory(v)))
query("resolution_configs", f"SELECT repo_id, path FROM inv WHERE {CONFIG}", INV)(lambda v: R.resolution_configs(inventory(v)).select("repo_id", "path"))
ORDERED = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY grp, round, area) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, grp, area ORDER BY depth, path) AS round FROM (
  SELECT *, CASE WHEN category = 'test' THEN 3 WHEN category = 'source' AND NOT list_has_any(segs, ['docs', 'examples']) THEN 1 ELSE 2 END AS grp,
    CASE WHEN len(segs) = 0 THEN '' WHEN len(segs) > 1 AND segs[1] = 'packages' THEN concat(segs[1], '/', segs[2]) ELSE segs[1] END AS area FROM inv WHERE parser_language IS NOT NULL)))"""
query("order_parse_candidates", "SELECT repo_id, path, place FROM ordered", INV, ORDERED)(lambda v: B.order_parse_candidates(inventory(v).filter("parser_language IS NOT NULL")).select("repo_id", "path", "place"))
query("byte_budget", """SELECT repo_id, path, took AS taken FROM greedy""", INV, ORDERED, """greedy AS (
  SELECT repo_id, path, place, size <= 150000 AS took, CASE WHEN size <= 150000 THEN 150000 - size ELSE 150000 END AS room FROM ordered WHERE place = 1
  UNION ALL SELECT o.repo_id, o.path, o.place, o.size <= g.room, CASE WHEN o.size <= g.room THEN g.room - o.size ELSE g.room END FROM greedy g JOIN ordered o ON o.repo_id = g.repo_id AND o.place = g.place + 1)""")(
    lambda v: B.byte_budget(B.order_parse_candidates(inventory(v).filter("parser_language IS NOT NULL")).select("repo_id", "path", "place", "size"), 150000).select("repo_id", "path", "taken"))
query("activity_candidates", "SELECT repo_id, path, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN status = 'parsed' AND category = 'source' THEN 0 ELSE 1 END, size DESC, path) AS place FROM counted) WHERE place <= 30", INV, *COUNTED)(
    lambda v: B.activity_candidates(counted(v), 30).select("repo_id", "path", "place"))
ITEMS = "SELECT repo_id, path, name, kind, start_line, end_line, CASE WHEN kind = 'method' THEN 1 ELSE 0 END AS depth, row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line, end_line, name, kind, exported) AS seq FROM fx_symbols"
query("cap_extraction", f"""SELECT r.repo_id, r.path, seq, place <= 20 AND place <= greatest(0, 1500 - coalesce(before, 0)) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY depth, seq) AS place FROM ({ITEMS})) r
  JOIN (SELECT repo_id, path, sum(n) OVER (PARTITION BY repo_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT repo_id, path, least(20, count(*)) AS n FROM fx_symbols GROUP BY ALL)) b ON b.repo_id = r.repo_id AND b.path = r.path""")(
    lambda v: B.cap_extraction(numbered(v), 20, 1500).select("repo_id", "path", "seq", "kept"))
query("export_names", """SELECT repo_id, path, string_agg(name, ',' ORDER BY first) AS exports FROM (SELECT repo_id, path, name, min(seq) AS first FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line, end_line, name, kind, exported) AS seq FROM fx_symbols) WHERE exported AND kind <> 'method' GROUP BY ALL) GROUP BY ALL""")(
    lambda v: numbered(v).filter("exported AND kind <> 'method'").groupBy("repo_id", "path", "name").agg(F.min("seq").alias("first")).groupBy("repo_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda s: s["name"]), ",").alias("exports")))


def numbered(v) -> DataFrame:
    """Symbols with their nesting depth and their place in the file."""
    place = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy("start_line", "end_line", "name", "kind", "exported"))
    return v("fx_symbols").withColumn("depth", F.when(F.col("kind") == "method", 1).otherwise(0)).withColumn("seq", place)


# --- resolution ----------------------------------------------------------------------------------------------------------


def relative(v) -> DataFrame:
    """Root-relative specifiers lose their extension on every third statement, so that candidates have to be tried."""
    cut = F.when((F.col("source_doc") % 3 == 0) & F.col("specifier").rlike(r"\.(ts|js)$"), P.strip_extension(F.col("specifier"))).otherwise(F.col("specifier"))
    return at_targets(v).withColumn("specifier", cut)


def at_targets(v) -> DataFrame:
    """The statements with their target's path as tpath and their number as n. The tables' targets go by number alone, and some lie in another repository:
    a statement is looked up in its target's, and seq holds its own repo_id and seq until `at_sources`."""
    targets = v("fx_docs").select(F.col("doc_id").alias("target_doc"), F.col("path").alias("tpath"), F.col("repo_id").alias("home"))
    i = v("fx_imports").join(targets, "target_doc", "left").withColumn("n", F.col("seq")).withColumn("seq", F.struct("repo_id", "seq"))
    return i.withColumn("repo_id", F.coalesce("home", "repo_id")).drop("home")


def at_sources(resolved: DataFrame) -> DataFrame:
    return resolved.withColumns({"repo_id": F.col("seq.repo_id"), "seq": F.col("seq.seq")})


query("resolve_relative_imports", """SELECT i.repo_id, i.path, seq, CASE WHEN starts_with(specifier, '/') THEN t.path END AS target FROM fx_imports i LEFT JOIN fx_docs t ON t.doc_id = i.target_doc""")(
    lambda v: at_sources(D.resolve_relative_imports(relative(v), v("fx_docs").select("repo_id", "path"))).select("repo_id", "path", "seq", "target"))
query("nearest_config", """SELECT repo_id, path, CASE WHEN path LIKE '%/src/core/%' THEN concat(string_split(path, '/')[1], '/src/core/tsconfig.json') WHEN path LIKE '%/packages/ui/src/%' THEN concat(string_split(path, '/')[1], '/tsconfig.json') ELSE concat(string_split(path, '/')[1], '/tsconfig.json') END AS config FROM fx_docs""")(
    lambda v: D.nearest_config(v("fx_docs").select("repo_id", "path"), configs(v)).select("repo_id", "path", "config"))


def configs(v) -> DataFrame:
    """A configuration at the top of each source and in its src/core."""
    top = v("fx_docs").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct()
    return top.select("repo_id", F.explode(F.array(F.concat("top", F.lit("/tsconfig.json")), F.concat("top", F.lit("/src/core/tsconfig.json")))).alias("path"))


CODE = """CASE language WHEN 'python' THEN concat('x = 1', chr(10), 'from a.b', seq, ' import c', chr(10)) WHEN 'go' THEN concat('package m', chr(10), 'import "h/', seq, '"') WHEN 'rust' THEN concat('use crate::m', seq, ';', chr(10), 'fn f() {}')
  WHEN 'java' THEN concat('import static a.B', seq, '.*;', chr(10), 'class C {}') ELSE concat('import x from "', specifier, '";', chr(10), 'const y = 1;') END"""
query("extract_import_refs", """SELECT repo_id, path, seq, CASE WHEN language = 'python' OR language = 'go' THEN 2 ELSE 1 END::BIGINT AS line, CASE language WHEN 'rust' THEN 'use' ELSE 'import' END AS kind,
  CASE language WHEN 'python' THEN concat('a.b', seq) WHEN 'go' THEN concat('h/', seq) WHEN 'rust' THEN concat('crate::m', seq) WHEN 'java' THEN concat('a.B', seq, '.*') ELSE specifier END AS specifier
  FROM (SELECT i.repo_id, i.path, seq, specifier, l.language FROM fx_imports i JOIN langs l ON l.repo_id = i.repo_id AND l.path = i.path)""", classified("langs", "fx_docs"))(
    lambda v: extracted(v))


def extracted(v) -> DataFrame:
    source = v("fx_imports").withColumn("language", P.parser_language(F.col("path"))).withColumn("text", F.expr(CODE.replace("language", "coalesce(language, '')")))
    found = D.extract_import_refs(source.withColumn("path", F.concat_ws("|", "path", "seq")))
    return found.select("repo_id", F.substring_index("path", "|", 1).alias("path"), F.substring_index("path", "|", -1).cast("long").alias("seq"), "line", "kind", "specifier")


query("restrict_to_selected", "SELECT inv.repo_id, inv.path FROM inv SEMI JOIN fx_docs d ON d.repo_id = inv.repo_id AND d.path = inv.path", INV)(
    lambda v: R.restrict_to_selected(inventory(v), v("fx_docs")).select("repo_id", "path"))
query("valid_edges", "SELECT repo_id, edge_id FROM fx_edges SEMI JOIN (SELECT concat('file:', doc_id) AS id FROM fx_docs WHERE doc_id % 7 <> 4) d ON d.id = source SEMI JOIN (SELECT concat('file:', doc_id) AS id FROM fx_docs WHERE doc_id % 7 <> 4) t ON t.id = target")(
    lambda v: G.valid_edges(v("fx_edges"), v("fx_docs").filter("doc_id % 7 <> 4").select(F.col("doc_id").cast("string").alias("path"))).select("repo_id", "edge_id"))

# --- search --------------------------------------------------------------------------------------------------------------


def entries(v) -> DataFrame:
    return E.search_entries(R.directory_rollup(counted(v)), inventory(v), v("fx_symbols"))


ENTRIES = f"""entries AS (SELECT repo_id, 'directory' AS kind, concat('dir:', path) AS id, concat(string_split(path, '/')[-1], '/') AS title, string_split(path, '/')[-1] AS name, '' AS stem, path, 6 AS prior FROM rolled WHERE path <> ''
  UNION ALL SELECT repo_id, 'file', concat('file:', path), name, name, lower(regexp_extract(name, '^(.+)\\.[^.]*$', 1)), path, 5 - CASE WHEN is_generated THEN 20 ELSE 0 END - CASE WHEN category = 'vendor' THEN 10 ELSE 0 END FROM inv
  UNION ALL SELECT s.repo_id, 'symbol', concat('sym:', s.path, '#', s.name, '@', start_line), CASE WHEN kind IN ('function', 'method') THEN concat(s.name, '()') ELSE s.name END, s.name, '', '',
    CASE kind WHEN 'class' THEN 4 WHEN 'function' THEN 3 WHEN 'method' THEN 2 ELSE 1 END + exported::INT - CASE WHEN is_generated THEN 20 ELSE 0 END FROM fx_symbols s JOIN inv ON inv.repo_id = s.repo_id AND inv.path = s.path)"""
query("search_entries", "SELECT repo_id, kind, id, title, name, stem, path, CAST(prior AS BIGINT) AS prior FROM entries", INV, *COUNTED, ROLLED, ENTRIES)(lambda v: entries(v).drop("bias"))
query("entry_counts", "SELECT repo_id, kind, count(*) AS entries FROM entries GROUP BY ALL", INV, *COUNTED, ROLLED, ENTRIES)(lambda v: entries(v).groupBy("repo_id", "kind").agg(F.count("*").alias("entries")))
LIKELY = "concat('%', array_to_string(list_transform(string_split(query, ''), lambda c: CASE WHEN c IN ('%', '_') THEN concat('!', c) ELSE c END), '%'), '%')"
PREPARED = f"prepared AS (SELECT query_id, query, {LIKELY} AS pattern FROM (SELECT query_id, lower(left(replace(regexp_replace(query, '\\s+', '', 'g'), '\\', '/'), 64)) AS query FROM fx_queries) WHERE query <> '')"
HELD = """held AS (SELECT query_id, query, e.*, NOT contains(query, '/') AND lower(name) LIKE pattern ESCAPE '!' AS by_name, path <> '' AND lower(path) LIKE pattern ESCAPE '!' AS by_path FROM prepared, entries e)"""
query("candidate_pairs", "SELECT query_id, repo_id, sum(by_name::INT)::BIGINT AS names, sum(by_path::INT)::BIGINT AS paths, max(CASE WHEN by_name OR by_path THEN id END) AS last FROM held WHERE by_name OR by_path GROUP BY ALL", INV, *COUNTED, ROLLED, ENTRIES, PREPARED, HELD)(lambda v: E.candidate_counts(v("fx_queries"), entries(v)))
query("rank_tier", """SELECT query_id, CAST(tier AS BIGINT) AS tier, count(*) AS entries FROM (SELECT query_id, CASE WHEN by_name THEN CASE WHEN lower(name) = query THEN 40000 WHEN stem = query THEN 35000 WHEN starts_with(lower(name), query) THEN 30000 ELSE 20000 END
  WHEN lower(path) = query OR ends_with(lower(path), concat('/', ltrim(query, '/'))) THEN 30000 ELSE 0 END AS tier FROM held WHERE by_name OR by_path) GROUP BY ALL""", INV, *COUNTED, ROLLED, ENTRIES, PREPARED, HELD)(
    lambda v: E.tier_counts(v("fx_queries"), entries(v)))
query("search_top_k")(lambda v: E.search_top_k(v("fx_queries"), entries(v), 50))

# --- events and streams --------------------------------------------------------------------------------------------------

STAGE_AT = "element_at(array('connect', 'tree', 'languages', 'fetch', 'parse', 'dependencies', 'history', 'construct'), CAST(turn % 8 + 1 AS INT))"


def event_lines(v) -> DataFrame:
    """A line for each turn: heartbeats, stages and unknown kinds, stages and statuses by turns, and some that are cut off."""
    stage = F.expr(f"CASE WHEN turn % 8 = 5 THEN 'nowhere' ELSE {STAGE_AT} END")
    kind = F.expr("CASE WHEN turn % 7 = 6 THEN 'heartbeat' WHEN turn % 5 = 4 THEN 'note' ELSE 'stage' END")
    status = F.expr("CASE WHEN turn % 6 = 0 THEN 'bogus' WHEN turn % 3 = 2 THEN 'progress' ELSE 'done' END")
    line = F.to_json(F.struct(kind.alias("type"), F.col("conv_id").cast("string").alias("run_id"), stage.alias("stage"), status.alias("status"), F.expr("CAST(turn % 9 AS DOUBLE) / 8").alias("progress"), F.coalesce("text", F.lit("")).alias("message")))
    return v("conversations").select("conv_id", "turn", F.when((F.col("conv_id") * 31 + F.col("turn")) % 13 == 0, F.left(line, F.lit(12))).otherwise(line).alias("value"))


query("active_stage", """SELECT run_id, ['connect', 'tree', 'languages', 'fetch', 'parse', 'dependencies', 'history', 'construct'][max(k + 1) FILTER (WHERE status = 'progress' OR status = 'start')] AS active,
    count(*) FILTER (WHERE status IN ('done', 'warning', 'skipped')) AS finished
  FROM (SELECT CAST(conv_id AS VARCHAR) AS run_id, turn % 8 AS k, arg_max(['done', 'progress', 'warning', 'start', 'skipped'][CAST((conv_id + turn) % 5 + 1 AS INT)], turn) AS status FROM conversations GROUP BY ALL) GROUP BY run_id""")(
    lambda v: ST.active_stage(v("conversations").select(
        F.col("conv_id").cast("string").alias("run_id"), F.expr(STAGE_AT).alias("stage"), F.col("turn").alias("seq"),
        F.expr("element_at(array('done', 'progress', 'warning', 'start', 'skipped'), CAST((conv_id + turn) % 5 + 1 AS INT))").alias("status"))))
query("check_references", """SELECT 'commit_files.sha' AS rule, (SELECT count(*) FROM fx_commit_files f ANTI JOIN fx_commits c ON c.repo_id = f.repo_id AND c.sha = f.sha) AS violations UNION ALL SELECT 'commit_files.path', (SELECT count(*) FROM fx_commit_files f ANTI JOIN inv d ON d.repo_id = f.repo_id AND d.path = f.path)
  UNION ALL SELECT 'symbols.path', (SELECT count(*) FROM fx_symbols f ANTI JOIN inv d ON d.repo_id = f.repo_id AND d.path = f.path) UNION ALL SELECT 'edges.self', (SELECT count(*) FROM fx_edges WHERE source = target)""", INV)(
    lambda v: R.check_references({"commit_files.sha": (v("fx_commit_files"), v("fx_commits"), ["repo_id", "sha"]), "commit_files.path": (v("fx_commit_files"), inventory(v), ["repo_id", "path"]), "symbols.path": (v("fx_symbols"), inventory(v), ["repo_id", "path"])}, {"edges.self": v("fx_edges").filter("source = target")}))

# --- more ----------------------------------------------------------------------------------------------------------------

query("files_active_in_window", "SELECT c.repo_id, c.path, epoch_us(max(date)) AS active FROM changes c JOIN fx_commits m ON m.repo_id = c.repo_id AND m.sha = c.sha WHERE date BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20' GROUP BY ALL", CHANGES)(
    lambda v: micros(H.files_active_in_window(v("fx_commits"), changes(v), cursor(), 7), "active"))
query("files_touched_by", "SELECT DISTINCT c.repo_id, author_id, path FROM changes c JOIN authored a ON a.repo_id = c.repo_id AND a.sha = c.sha WHERE author_id IS NOT NULL", AUTHORED, CHANGES)(lambda v: H.files_touched_by(v("fx_commits"), changes(v)))
query("plan_timeline_ranges", """SELECT repo_id, 'month' AS granularity, epoch_us(m) AS start, epoch_us(m + INTERVAL 1 MONTH) AS end FROM (
  SELECT repo_id, unnest(range(date_trunc('month', min(date) - INTERVAL 900 DAY)::TIMESTAMP, date_trunc('month', max(date))::TIMESTAMP + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m FROM fx_commits GROUP BY repo_id)""")(
    lambda v: micros(H.plan_timeline_ranges(v("fx_commits").groupBy("repo_id").agg((F.min("date") - F.expr("INTERVAL 900 DAYS")).alias("created"), F.max("date").alias("end"))), "start", "end"))
query("suggestions", """SELECT repo_id, 'file' AS kind, path, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, lines DESC, path) AS place FROM measured) WHERE place <= 8
  UNION ALL SELECT repo_id, 'directory', path, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_count DESC, path) AS place FROM rolled WHERE path <> '' AND length(path) - length(replace(path, '/', '')) <= 1) WHERE place <= 5""", INV, *COUNTED, *SCORED, ROLLED)(
    lambda v: G.suggestions(scored(v), R.directory_rollup(counted(v))))
query("relation_role", f"""SELECT repo_id, file, CASE WHEN bool_or(o) AND bool_or(NOT o) THEN 'mutual' WHEN bool_or(o) THEN 'out' ELSE 'in' END AS role FROM (SELECT e.repo_id, target AS file, true AS o FROM fx_edges e SEMI JOIN ({SELECTED}) s ON e.repo_id = s.repo_id AND e.source = s.file
  UNION ALL SELECT e.repo_id, source, false FROM fx_edges e SEMI JOIN ({SELECTED}) s ON e.repo_id = s.repo_id AND e.target = s.file) r ANTI JOIN ({SELECTED}) s USING (repo_id, file) GROUP BY repo_id, file""", ENDS, CONNECTED)(
    lambda v: G.relation_roles(v("fx_edges"), G.rank_connectivity(v("fx_edges"), 3)))
query("selection_files", "SELECT DISTINCT repo_id, path FROM fx_docs WHERE path LIKE 'src1/src/core/%' OR path LIKE 'src2/docs/%' OR doc_id % 10 = 3")(
    lambda v: G.selection_files(picked(v), v("fx_docs").select("repo_id", "path")))


def picked(v) -> DataFrame:
    """Two directories of every repository, and one file in ten."""
    repos = v("fx_docs").select("repo_id").distinct()
    dirs = repos.select("repo_id", F.lit("directory").alias("kind"), F.explode(F.array(F.lit("src1/src/core"), F.lit("src2/docs"))).alias("path"))
    return dirs.unionByName(v("fx_docs").filter("doc_id % 10 = 3").select("repo_id", F.lit("file").alias("kind"), "path"))


from . import more  # noqa: E402, F401
