"""What an analysis says about itself: coverage, warnings, summaries, notes, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# Statuses; warnings in display order; those that say something is left out; stages in order.
STATUSES = ("parsed", "partial", "content-only", "metadata-only", "binary", "failed")
WARNINGS = (
    "STALE_ANALYSIS", "EMPTY_REPOSITORY", "TREE_TRUNCATED", "LARGE_REPOSITORY", "FILE_NODE_LIMIT", "PARSE_LIMIT", "SYMBOL_LIMIT", "BYTE_LIMIT", "UNSUPPORTED_LANGUAGES", "PARSE_FAILURES",
    "FETCH_FAILURES", "HISTORY_UNAVAILABLE", "HISTORY_LIMITED", "RATE_LIMIT_LOW",
)
LIMITING = ("TREE_TRUNCATED", "FILE_NODE_LIMIT", "PARSE_LIMIT", "SYMBOL_LIMIT", "BYTE_LIMIT", "LARGE_REPOSITORY", "FETCH_FAILURES")
STAGES = ("connect", "tree", "languages", "fetch", "parse", "dependencies", "history", "construct")
LISTED = 5


def coverage_report(inventory: DataFrame, files: DataFrame, directories: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row for each repository: files and bytes, graph files by status, directories, symbols, imports by what became of them.

    files: repo_id, status. imports: repo_id, state (resolved, external, unresolved). Each table is summed before it is joined.
    """
    of = lambda s: F.count_if(F.col("status") == s).alias("files_" + s.replace("-", "_"))
    state = lambda s, n: F.count_if(F.col("state") == s).alias(n)
    sums = [
        files.groupBy("repo_id").agg(F.count("*").alias("files_in_graph"), *map(of, STATUSES)), directories.groupBy("repo_id").agg(F.count("*").alias("directories_in_repository")),
        symbols.groupBy("repo_id").agg(F.count("*").alias("symbols_extracted")),
        imports.groupBy("repo_id").agg(F.count("*").alias("imports_found"), state("resolved", "imports_resolved"), state("external", "external_imports"), state("unresolved", "unresolved_imports")),
    ]
    whole = inventory.groupBy("repo_id").agg(F.count("*").alias("files_in_repository"), F.sum("size").alias("bytes_in_repository"))
    joined = reduce(lambda a, b: a.join(b, "repo_id", "left"), sums, whole)
    return joined.fillna(0)


def _warning(code: str, condition: Column, message: Column, **detail: Column) -> Column:
    pairs = [x for k, v in sorted(detail.items()) for x in (F.lit(k), v.cast("string"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(condition, F.struct(F.lit(code).alias("code"), message.alias("message"), details.alias("detail")))


def derive_warnings(facts: DataFrame, max_commits: int = 300, max_bytes: int = 50 << 20) -> DataFrame:
    """repo_id, code, message, detail: the warnings that the facts of each repository call for.

    facts: coverage_report's columns, tier, truncated, skipped_parse_limit, skipped_byte_budget, eligible, has_history, commits, with_details, languages (the
    unsupported ones, most files first).
    """
    n, integer = F.col, lambda c: X.format_integer(F.col(c))
    parsed = n("files_parsed") + n("files_partial")
    eligible = F.greatest(n("eligible"), parsed)
    more = F.size("languages") - LISTED
    listed = F.concat(F.array_join(F.slice("languages", 1, LISTED), ", "), F.when(more > 0, F.concat(F.lit(" and "), X.format_integer(more), F.lit(" more"))).otherwise(""))
    limited = n("has_history") & (n("commits") > 0) & ((n("commits") >= max_commits) | (n("with_details") < n("commits")))
    level = F.when((n("with_details") > 0) & (n("with_details") < n("commits")), F.concat(F.lit("; file-level activity on the latest "), integer("with_details"))).otherwise("")
    rules = F.array(
        _warning("EMPTY_REPOSITORY", n("files_in_repository") == 0, F.lit("There are no files in this repository.")),
        _warning("TREE_TRUNCATED", n("truncated"), F.lit("The file listing was truncated, so some files are missing.")),
        _warning("LARGE_REPOSITORY", n("tier") == "directory-first", F.lit("This repository is very large; a representative sample of files was analyzed.")),
        _warning("FILE_NODE_LIMIT", n("files_in_graph") < n("files_in_repository"), F.concat(F.lit("Showing "), integer("files_in_graph"), F.lit(" of "), integer("files_in_repository"), F.lit(" files.")), shown=n("files_in_graph"), total=n("files_in_repository")),
        _warning("PARSE_LIMIT", n("skipped_parse_limit") > 0, F.concat(F.lit("Parsed "), X.format_integer(parsed), F.lit(" of "), X.format_integer(eligible), F.lit(" eligible source files.")), parsed=parsed, eligible=eligible),
        _warning("BYTE_LIMIT", n("skipped_byte_budget") > 0, F.concat(F.lit("The download budget was reached by "), X.pluralize(n("skipped_byte_budget"), "file"), F.lit(".")), files=n("skipped_byte_budget"), maxTotalBytes=F.lit(max_bytes)),
        _warning("UNSUPPORTED_LANGUAGES", F.size("languages") > 0, F.concat(F.lit("No parser for: "), listed, F.lit(".")), languages=F.size("languages")),
        _warning("PARSE_FAILURES", n("files_failed") > 0, F.concat(X.pluralize(n("files_failed"), "file"), F.lit(" could not be analyzed.")), files=n("files_failed")),
        _warning("HISTORY_UNAVAILABLE", ~n("has_history") & (n("files_in_repository") > 0), F.lit("Commit history could not be loaded.")),
        _warning("HISTORY_LIMITED", limited, F.concat(F.lit("Activity is based on the latest "), integer("commits"), F.lit(" commits"), level, F.lit(".")), commits=n("commits"), commitsWithDetails=n("with_details")),
    )
    return facts.select("repo_id", F.explode(F.filter(rules, lambda w: w.isNotNull())).alias("w")).select("repo_id", "w.*")


def _rank(code: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, WARNINGS)), code)
    return F.when(at > 0, at).otherwise(len(WARNINGS) + 1)


def merge_warnings(provided: DataFrame, derived: DataFrame) -> DataFrame:
    """The first warning of each code and repository, provided ones before derived; place in display order."""
    both = provided.withColumn("from", F.lit(0)).unionByName(derived.withColumn("from", F.lit(1)))
    columns = [c for c in derived.columns if c not in ("repo_id", "code")]
    once = both.groupBy("repo_id", "code").agg(F.min_by(F.struct(*columns), F.struct("from", "message")).alias("w")).select("repo_id", "code", "w.*")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(_rank(F.col("code")), "code")))


def low_quota(runs: DataFrame, share: float = 0.1) -> DataFrame:
    """Runs of which less than a tenth of the provider's quota is left. runs: remaining, quota."""
    return runs.filter((F.col("quota") > 0) & (F.col("remaining") < F.col("quota") * share))


def degraded_analyses(runs: DataFrame, warnings: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Runs that miss data for reasons that pass, with expired: whether they are older than that. runs: run_id, generated_at; warnings: run_id, code, detail."""
    d = lambda k: F.coalesce(F.try_element_at("detail", F.lit(k)), F.lit(""))
    positive = lambda k: F.coalesce(d(k).try_cast("double"), F.lit(0.0)) > 0
    bad = (
        (F.col("code") == "HISTORY_UNAVAILABLE") | ((F.col("code") == "FETCH_FAILURES") & (positive("rateLimited") | positive("timeBudget")))
        | ((F.col("code") == "PARSE_LIMIT") & positive("stoppedEarly")) | ((F.col("code") == "HISTORY_LIMITED") & d("reason").isin("time-budget", "low-quota"))
    )
    old = F.col("generated_at").isNull() | (F.unix_micros(now) - F.unix_micros("generated_at") >= minutes * 60_000_000)
    return runs.join(warnings.filter(bad).select("run_id").distinct(), "run_id", "left_semi").withColumn("expired", old)


def repository_stats(coverage: DataFrame, roots: DataFrame, edges: DataFrame, packages: DataFrame, people: DataFrame) -> DataFrame:
    """One summary row for each repository. roots: its root directories (repo_id, total_lines, lines_estimated)."""
    count = lambda df, n: df.groupBy("repo_id").agg(F.count("*").alias(n))
    out = coverage.select(
        "repo_id", "files_in_repository", (F.col("files_parsed") + F.col("files_partial") + F.col("files_content_only")).alias("files_analysed"),
        (F.col("files_parsed") + F.col("files_partial")).alias("files_parsed"), F.col("symbols_extracted").alias("symbols"))
    out = out.join(roots.select("repo_id", F.col("total_lines").alias("lines_of_code"), "lines_estimated"), "repo_id", "left")
    for df, n in ((edges, "dependencies"), (packages, "external_packages"), (people, "contributors")):
        out = out.join(count(df, n), "repo_id", "left").fillna(0, [n])
    return out


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """repo_id, place, label, value, complete: rows that say what an analysis covers. coverage: coverage_report's columns, tier, truncated, codes (of its warnings), commits."""
    n = F.col
    i = X.format_integer
    total = F.concat(i(n("files_in_repository")), F.when(n("truncated"), "+").otherwise(""))
    limited = (n("tier") != "full") | n("truncated") | (n("files_metadata_only") > 0) | (n("files_in_graph") < n("files_in_repository")) | F.arrays_overlap("codes", F.array(*map(F.lit, LIMITING)))
    internal = F.greatest(n("imports_found") - n("external_imports"), n("imports_resolved"))
    row = lambda label, value, shown=F.lit(True): F.when(shown, F.struct(F.lit(label).alias("label"), value.alias("value")))
    some = lambda label, c: row(label, i(n(c)), n(c) > 0)
    rows = F.array(
        row("Files in repository", total), row("Files in the graph", i(n("files_in_graph"))), row("Parsed", i(n("files_parsed"))), some("Partially parsed", "files_partial"), some("Counted, no parser", "files_content_only"),
        some("Size only (not downloaded)", "files_metadata_only"), some("Binary", "files_binary"), some("Failed", "files_failed"), row("Symbols extracted", i(n("symbols_extracted"))),
        row("Internal imports resolved", F.concat(i(n("imports_resolved")), F.lit(" of "), i(internal)), n("imports_found") > 0), some("Commits analysed", "commits"),
    )
    return coverage.select("repo_id", (~limited).alias("complete"), F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("place", "row")).select("repo_id", (F.col("place") + 1).alias("place"), "row.label", "row.value", "complete")


def stage_rows(coverage: DataFrame) -> DataFrame:
    """repo_id, place, stage, message: the eight stages of a finished analysis with their results. coverage: coverage_report's columns, truncated, language, language_share, commits, contributors."""
    n = F.col
    dot = F.lit(" · ")
    files = F.concat(X.pluralize(n("files_in_repository"), "file"), F.when(n("truncated"), " · listing truncated").otherwise(""))
    language = F.when(n("language").isNull(), "No recognized languages").otherwise(F.concat("language", F.lit(" "), X.format_percent(n("language_share"))))
    history = F.when(n("commits") == 0, "No history").otherwise(F.concat(X.pluralize(n("commits"), "commit"), F.when(n("contributors") > 0, F.concat(dot, X.pluralize(n("contributors"), "contributor"))).otherwise("")))
    messages = (
        F.lit("Repository found"), files, language, F.lit("Cached"), F.concat(X.pluralize(n("files_parsed") + n("files_partial"), "file"), F.lit(" parsed · cached")),
        F.concat(X.pluralize(n("imports_found"), "import"), dot, X.format_integer(n("imports_resolved")), F.lit(" resolved")), history, F.lit("Complete"),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), m.alias("message")) for i, (s, m) in enumerate(zip(STAGES, messages), 1)])
    return coverage.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


def stage_timings(runs: DataFrame) -> DataFrame:
    """runs (run_id, timings: map by stage) -> run_id, place, stage, ms: known stages in their order, others after them as they came; what is no finite number from 0 on goes."""
    rows = runs.select("run_id", F.posexplode(F.map_entries("timings")).alias("at", "e")).select("run_id", "at", F.col("e.key").alias("stage"), F.col("e.value").alias("ms"))
    rows = rows.filter(F.col("ms").isNotNull() & ~F.isnan("ms") & F.col("ms").between(0, 1.7e308))
    known = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    order = F.when(known > 0, known).otherwise(len(STAGES) + 1 + F.col("at"))
    return rows.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy(order)).alias("place"), "stage", "ms")


def run_summary(runs: DataFrame) -> DataFrame:
    """runs (outcome, cached, files, failures, duration_ms) -> number, files, failures, mean and median duration by outcome and cached."""
    ms = F.col("duration_ms")
    return runs.groupBy("outcome", "cached").agg(F.count("*").alias("runs"), F.sum("files").alias("files"), F.sum("failures").alias("failures"), F.avg(ms).alias("mean_ms"), F.percentile(ms, F.lit(0.5)).alias("median_ms"))


def skip_reason_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("repo_id", "reason").agg(F.count("*").alias("files"))


def _latest(n: Column) -> Column:
    return F.when(n == 1, "the latest commit").otherwise(F.concat(F.lit("the latest "), X.format_integer(n), F.lit(" commits")))


def contributor_notes(people: DataFrame, commits: DataFrame, history: DataFrame) -> DataFrame:
    """repo_id, id, note: why a contributor has no changed files; null for those who have some.

    people: repo_id, id, files. commits: repo_id, author_id, has_details. history: repo_id, commits, with_details, truncated.
    """
    own = commits.groupBy("repo_id", F.col("author_id").alias("id")).agg(F.count("*").alias("theirs"), F.count_if("has_details").alias("detailed"))
    j = people.join(own, ["repo_id", "id"], "left").fillna(0, ["theirs", "detailed"]).join(history, "repo_id")
    c = F.col
    only = F.concat(F.lit("No file changes in the analysed window: only "), _latest(c("commits")), F.when(c("commits") == 1, " was examined.").otherwise(" were examined."))
    none = F.when(c("commits") == 1, "No file changes in the analysed history: its only commit is not theirs.").otherwise(F.concat(F.lit("No file changes in the analysed history: none of its "), X.format_integer(c("commits")), F.lit(" commits are theirs.")))
    some = F.concat(F.lit("No file changes in the analysed window: file details were fetched for only "), _latest(c("with_details")), F.when(c("with_details") == 1, ", which is not theirs.").otherwise(", and none are theirs."))
    note = (
        F.when((c("files") > 0) | (c("commits") == 0), None).when((c("theirs") == 0) & c("truncated"), only).when(c("theirs") == 0, none)
        .when(c("detailed") > 0, "No changes to files in this view: those that their commits changed were deleted or are not shown.")
        .when(c("with_details") == 0, "No file changes in the analysed window: file details were not fetched for any commit.").otherwise(some)
    )
    return j.select("repo_id", "id", note.alias("note"))


def history_notes(history: DataFrame) -> DataFrame:
    """repo_id, window, limit: what the history of a repository covers. history: repo_id, commits, with_details, oldest, newest, reason (why it was limited, or null)."""
    c = F.col
    span = F.coalesce(F.concat(F.lit(" ("), X.format_date(F.when(c("newest").isNotNull(), c("oldest"))), F.lit(" – "), X.format_date(c("newest")), F.lit(")")), F.lit(""))
    span = F.when(c("oldest").isNotNull() & c("newest").isNotNull(), span).otherwise("")
    commits = X.pluralize(c("commits"), "commit")
    window = (
        F.when(c("commits") == 0, None).when(c("with_details") == 0, F.concat(F.lit("the latest "), commits, span, F.lit("; file-level details were not fetched")))
        .when(c("with_details") < c("commits"), F.concat(F.lit("file details of the latest "), X.pluralize(c("with_details"), "commit"), F.lit(" (of "), commits, F.lit(" read"), span, F.lit(")")))
        .otherwise(F.concat(F.lit("the latest "), commits, span))
    )
    why = F.when(c("reason") == "unauthenticated", "no token configured").when(c("reason") == "low-quota", "quota running low").when(c("reason") == "time-budget", "time budget reached")
    files = F.when(c("with_details") >= c("commits"), "").when(c("with_details") == 0, ", without file changes").otherwise(F.concat(F.lit(", with file changes from "), _latest(c("with_details"))))
    limit = F.concat(F.coalesce(F.concat(F.lit("History limited: "), why, F.lit(". ")), F.lit("History limited. ")), F.when(c("commits") == 0, "No commits were read.").otherwise(F.concat(F.lit("Activity covers "), _latest(c("commits")), files, F.lit("."))))
    return history.select("repo_id", window.alias("window"), limit.alias("limit"))
