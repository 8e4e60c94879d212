"""Commits, contributors, file activity and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_CONTRIBUTORS, MAX_FILE_CONTRIBUTORS = 200, 10


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\s+", " ")


def contributor_id(login: Column, name: Column) -> Column:
    """The login wins, else the name without case and extra space, else null."""
    by_login = F.when(F.length(F.trim(login)) > 0, F.concat(F.lit("user:"), F.lower(F.trim(login))))
    return F.coalesce(by_login, F.when(F.length(clean_name(name)) > 0, F.concat(F.lit("author:"), F.lower(clean_name(name)))))


def with_authors(commits: DataFrame) -> DataFrame:
    return commits.withColumn("author_id", contributor_id(F.col("author_login"), F.col("author_name")))


def commit_files_in_graph(commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of graph files only."""
    return commit_files.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def changed_counts(commit_files: DataFrame, in_graph: DataFrame) -> DataFrame:
    """repo_id, sha, changed (all files), in_graph."""
    keep = in_graph.groupBy("repo_id", "sha").agg(F.count("*").alias("in_graph"))
    return commit_files.groupBy("repo_id", "sha").agg(F.count("*").alias("changed")).join(keep, ["repo_id", "sha"], "left").fillna(0, ["in_graph"])


def merge_commits(listed: DataFrame, detailed: DataFrame) -> DataFrame:
    """By sha; listed fields win, details add files. place: newest first, undated last, then by sha."""
    a = listed.select("repo_id", "sha", *[F.col(c).alias(f"a_{c}") for c in ("message", "author_login", "author_name", "date")])
    b = detailed.select("repo_id", "sha", *[F.col(c).alias(f"b_{c}") for c in ("message", "author_login", "author_name", "date")], F.lit(True).alias("d"))
    both = a.join(b, ["repo_id", "sha"], "full_outer")
    merged = both.select("repo_id", "sha", *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in ("message", "author_login", "author_name", "date")], F.coalesce("d", F.lit(False)).alias("has_details"))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc_nulls_last("date"), "sha")))


def file_activity(commits: DataFrame, changes: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Commits, last change and its author of each changed file. Ties of time go to the smallest sha. Sums and maxima only, combined before the shuffle.

    lookups (repo_id, path, last_modified, author_id), a last commit known from elsewhere: a newer one wins, and one inside the window of the listed commits
    counts as one commit where no change is known.
    """
    own = changes.join(with_authors(commits).select("repo_id", "sha", "date", "author_id"), ["repo_id", "sha"])
    last = F.min_by("author_id", F.struct((-F.unix_micros("date")).alias("t"), "sha"))
    found = own.groupBy("repo_id", "path").agg(F.count("*").alias("commit_count"), F.max("date").alias("last_modified"), last.alias("last_author_id"), F.count_distinct("author_id").alias("contributors"))
    if lookups is None:
        return found
    start = commits.groupBy("repo_id").agg(F.min("date").alias("window_start"))
    known = lookups.groupBy("repo_id", "path").agg(F.max("last_modified").alias("looked_up"), F.max_by("author_id", "last_modified").alias("looked_up_author"))
    both = found.join(known, ["repo_id", "path"], "full_outer").join(start, "repo_id", "left")
    inside = F.coalesce((F.col("looked_up") >= F.col("window_start")).cast("int"), F.lit(0))
    newer = F.col("looked_up").isNotNull() & (F.col("last_modified").isNull() | (F.col("looked_up") > F.col("last_modified")))
    return both.select(
        "repo_id", "path", F.coalesce("commit_count", inside).alias("commit_count"), F.when(newer, F.col("looked_up")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(newer, F.col("looked_up_author")).otherwise(F.col("last_author_id")).alias("last_author_id"),
        F.greatest(F.coalesce("contributors", F.lit(0)), F.col("looked_up_author").isNotNull().cast("int")).alias("contributors"))


def derive_file_activity(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """The last commit that touches each path: repo_id, path, last_modified, author_login, author_name."""
    own = changes.join(commits.select("repo_id", "sha", "date", "author_login", "author_name"), ["repo_id", "sha"])
    last = F.min_by(F.struct("date", "author_login", "author_name"), F.struct((-F.unix_micros("date")).alias("t"), "sha"))
    return own.groupBy("repo_id", "path").agg(last.alias("c")).select("repo_id", "path", F.col("c.date").alias("last_modified"), "c.author_login", "c.author_name")


def contributor_files(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """repo_id, id, paths: the files each contributor has changed, in order."""
    return files_touched_by(commits, changes).groupBy("repo_id", F.col("author_id").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def contributors(commits: DataFrame, provider: DataFrame, changes: DataFrame, most: int = MAX_CONTRIBUTORS) -> DataFrame:
    """The union of identities from the provider's list and from commits; contributions, commits, newest name, changed files; the first `most`."""
    authored = with_authors(commits).filter("author_id IS NOT NULL")
    listed = provider.withColumn("id", contributor_id(F.col("login"), F.col("name"))).filter("id IS NOT NULL").groupBy("repo_id", "id").agg(F.max("contributions").alias("contributions"), F.min("login").alias("p_login"))
    newest_name = F.min_by(F.trim("author_name"), F.struct((-F.unix_micros("date")).alias("t"), "sha"))
    made = authored.groupBy("repo_id", F.col("author_id").alias("id")).agg(F.count("*").alias("commit_count"), newest_name.alias("commit_name"), F.min("author_login").alias("c_login"))
    touched = changes.join(authored.select("repo_id", "sha", F.col("author_id").alias("id")), ["repo_id", "sha"]).select("repo_id", "id", "path").distinct().groupBy("repo_id", "id").agg(F.count("*").alias("files"))
    joined = listed.join(made, ["repo_id", "id"], "full_outer").join(touched, ["repo_id", "id"], "left")
    named = joined.select("repo_id", "id", F.coalesce("commit_name", "p_login", "id").alias("name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("contributions", "commit_count", "files")])
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("contributions"), F.desc("commit_count"), F.lower("name"), "id"))
    return named.withColumn("place", place).filter(F.col("place") <= most)


def file_top_contributors(commits: DataFrame, changes: DataFrame, most: int = MAX_FILE_CONTRIBUTORS) -> DataFrame:
    own = changes.join(with_authors(commits).filter("author_id IS NOT NULL").select("repo_id", "sha", "author_id"), ["repo_id", "sha"])
    by = own.groupBy("repo_id", "path", "author_id").agg(F.count("*").alias("commits"))
    place = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("commits"), "author_id"))
    return by.withColumn("place", place).filter(F.col("place") <= most)


def recent_commits(commits: DataFrame, most: int = 8) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("repo_id", "author_id").orderBy(F.desc_nulls_last("date"), "sha"))
    return with_authors(commits).filter("author_id IS NOT NULL").withColumn("place", place).filter(F.col("place") <= most)


def rank_contributors(people: DataFrame) -> DataFrame:
    """Three orders: the provider's, the panel's (files first) and the palette's (commits first)."""
    over = lambda *by: F.row_number().over(Window.partitionBy("repo_id").orderBy(*by))
    return people.select(
        "repo_id", "id", over(F.desc("contributions"), F.desc("commit_count"), F.lower("name"), "id").alias("by_provider"),
        over(F.desc("files"), F.desc("commit_count"), F.desc("contributions"), "id").alias("by_panel"),
        over(F.desc("commit_count"), F.desc("contributions"), "id").alias("by_palette"), ((F.col("files") > 0) | (F.col("commit_count") > 0)).alias("active"))


def derive_contributors(commits: DataFrame) -> DataFrame:
    """Commits by login or, without one, by name, whatever the case; named as in the newest of them."""
    key = F.coalesce(F.concat(F.lit("login:"), F.lower("author_login")), F.concat(F.lit("name:"), F.lower(F.trim("author_name"))))
    name = F.min_by(F.coalesce("author_login", "author_name"), F.struct((-F.unix_micros("date")).alias("t"), "sha"))
    return commits.groupBy("repo_id", key.alias("who")).agg(F.count("*").alias("commits"), name.alias("name"))


def history_summary(commits: DataFrame, activity: DataFrame) -> DataFrame:
    files = activity.groupBy("repo_id").agg(F.count("last_modified").alias("files_with_activity"))
    return commits.groupBy("repo_id").agg(F.count("*").alias("commits"), F.count_if("has_details").alias("with_details"), F.min("date").alias("oldest"), F.max("date").alias("newest")).join(files, "repo_id", "left").fillna(0, ["files_with_activity"])


def commits_in_window(commits: DataFrame, cursor: Column, days: int) -> DataFrame:
    """After cursor - days, up to the cursor; at least one day."""
    return commits.filter((F.col("date") > cursor - F.make_dt_interval(F.lit(max(1, days)))) & (F.col("date") <= cursor))


#: Calendar units, finest first, with their steps; and buckets of a timeline at most.
UNITS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}
BUCKETS = 2000


def _by_unit(unit: Column, make) -> Column:
    """make(name, step) of the unit that a row has."""
    out = None
    for name, step in UNITS.items():
        out = F.when(unit == name, make(name, step)) if out is None else out.when(unit == name, make(name, step))
    return out


def bucket_commits(commits: DataFrame, granularity: str | None = None) -> DataFrame:
    """Contiguous UTC buckets of each repository, empty ones too: days up to a span of 45 days, weeks up to a year, months up to four, then quarters.

    A given granularity holds for all. Where one would give more than BUCKETS buckets, the next coarser one that does not is taken.
    """
    span = commits.filter("date IS NOT NULL").groupBy("repo_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = (F.unix_micros("last") - F.unix_micros("first")) / 86_400_000_000
    asked = F.lit(granularity) if granularity else F.when(days <= 45, "day").when(days <= 365, "week").when(days <= 4 * 365, "month").otherwise("quarter")
    names = F.array(*map(F.lit, UNITS))
    d = F.datediff("last", "first")
    months = lambda c: F.year(c) * 12 + F.month(c)
    sizes = F.array(d + 1, F.datediff(F.date_trunc("week", "last"), F.date_trunc("week", "first")) / 7 + 1, months("last") - months("first") + 1, (F.year("last") * 4 + F.quarter("last")) - (F.year("first") * 4 + F.quarter("first")) + 1, F.lit(1))
    fits = F.filter(names, lambda u: (F.array_position(names, u) >= F.array_position(names, F.col("asked"))) & (F.get(sizes, (F.array_position(names, u) - 1).cast("int")) <= BUCKETS))
    span = span.withColumn("asked", asked).withColumn("granularity", F.coalesce(F.get(fits, F.lit(0)), F.lit("year")))
    unit = F.col("granularity")
    floor = lambda c: _by_unit(unit, lambda name, _: F.date_trunc(name, c))
    spine = span.select("repo_id", "granularity", F.explode(_by_unit(unit, lambda name, step: F.sequence(F.date_trunc(name, "first"), F.date_trunc(name, "last"), F.expr(step)))).alias("bucket_start"))
    spine = spine.withColumn("bucket_end", _by_unit(unit, lambda _, step: F.col("bucket_start") + F.expr(step)))
    counted = commits.filter("date IS NOT NULL").join(span.select("repo_id", "granularity"), "repo_id").groupBy("repo_id", floor(F.col("date")).alias("bucket_start")).agg(F.count("*").alias("commits"))
    return spine.join(counted, ["repo_id", "bucket_start"], "left").fillna(0, ["commits"])


def build_timeline(exact: DataFrame, commits: DataFrame) -> DataFrame:
    """Exact counts where a repository has them (repo_id, granularity, bucket_start, bucket_end, commits), else its commits in buckets; with coverage, start and end."""
    counted = exact.filter("bucket_start IS NOT NULL AND bucket_end IS NOT NULL").withColumn("coverage", F.lit("full-history"))
    sampled = bucket_commits(commits.join(exact.select("repo_id").distinct(), "repo_id", "left_anti")).withColumn("coverage", F.lit("sampled"))
    both = counted.select("repo_id", "granularity", "coverage", "bucket_start", "bucket_end", "commits").unionByName(sampled.select("repo_id", "granularity", "coverage", "bucket_start", "bucket_end", "commits"))
    return both.join(both.groupBy("repo_id").agg(F.min("bucket_start").alias("start"), F.max_by("bucket_end", "bucket_start").alias("end")), "repo_id")


def axis_ticks(extent: DataFrame, most: int = 6) -> DataFrame:
    """extent (repo_id, start, end) -> repo_id, time, label, position of calendar ticks: years, quarters, months, weeks or days, thinned to `most`, none at the edges."""
    days = (F.unix_micros("end") - F.unix_micros("start")) / 86_400_000_000
    upto = lambda low, step: F.filter(F.when(low <= F.col("end"), F.sequence(low, F.col("end"), F.expr(step))).otherwise(F.array().cast("array<timestamp>")), lambda t: t <= F.col("end"))
    next_month, next_year = (F.date_trunc(u, "start") + F.expr(UNITS[u]) for u in ("month", "year"))
    day = F.date_trunc("day", F.col("start") + F.expr("INTERVAL 86399999999 MICROSECONDS"))
    years, months = upto(next_year, UNITS["year"]), upto(next_month, UNITS["month"])
    quarters = F.filter(months, lambda t: (F.month(t) - 1) % 3 == 0)
    times = F.when(days > 3 * 365, years).when(days > 540, quarters).when(days > 45, months).when(days > 14, upto(day, UNITS["week"])).otherwise(upto(day, UNITS["day"]))
    rows = extent.withColumn("days", days).withColumn("times", times)
    stride = F.greatest(F.lit(1), F.ceil(F.size("times") / float(max(1, most))))
    rows = rows.withColumn("stride", stride).select("repo_id", "start", "end", "days", "stride", F.posexplode("times").alias("i", "time")).filter("i % stride = 0")
    label = F.when(F.col("days") > 3 * 365, F.date_format("time", "yyyy")).when(F.col("days") > 45, F.when(F.month("time") == 1, F.date_format("time", "yyyy")).otherwise(F.date_format("time", "MMM"))).otherwise(F.date_format("time", "MMM d"))
    at = (F.unix_micros("time") - F.unix_micros("start")) / (F.unix_micros("end") - F.unix_micros("start"))
    return rows.select("repo_id", "time", label.alias("label"), at.alias("position")).filter("position > 0.02 AND position < 0.98")


def histogram_bars(buckets: DataFrame) -> DataFrame:
    most = F.max("commits").over(Window.partitionBy("repo_id"))
    return buckets.withColumn("height", F.when((most == 0) | (F.col("commits") == 0), 0.0).otherwise(F.greatest(F.lit(0.06), F.col("commits") / most)))


def timeline_extent(buckets: DataFrame, commits: DataFrame) -> DataFrame:
    """From the earliest to the latest of buckets and commits, at least a day."""
    both = buckets.select("repo_id", F.col("bucket_start").alias("a"), F.col("bucket_end").alias("b")).unionByName(commits.filter("date IS NOT NULL").select("repo_id", F.col("date").alias("a"), F.col("date").alias("b")))
    out = both.groupBy("repo_id").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    return out.withColumn("end", F.greatest(F.col("end"), F.col("start") + F.expr("INTERVAL 1 DAY")))


def window_stats(commits: DataFrame, changes: DataFrame, cursor: Column, days: int, activity: DataFrame | None = None, truncated: DataFrame | None = None) -> DataFrame:
    """A row for each repository: commits, distinct authors, commits with details and changed files of a trailing window, what these rest on, and how much of it the commits cover.

    basis is commits where any commit of the window has details, else activity: files are then those last changed in it (activity: repo_id, path,
    last_modified). coverage is full, partial or none; truncated (repo_id) names the repositories of which older commits exist.
    """
    inside = with_authors(commits_in_window(commits, cursor, days))
    author = F.coalesce("author_id", F.concat(F.lit("name:"), F.col("author_name")))
    total = inside.groupBy("repo_id").agg(F.count("*").alias("commits"), F.count_distinct(author).alias("contributors"), F.count_if("has_details").alias("with_details"))
    files = changes.join(inside.filter("has_details").select("repo_id", "sha"), ["repo_id", "sha"], "left_semi").groupBy("repo_id").agg(F.count_distinct("path").alias("changed"))
    start = cursor - F.make_dt_interval(F.lit(max(1, days)))
    oldest = commits.groupBy("repo_id").agg(F.min("date").alias("oldest"))
    out = oldest.join(total, "repo_id", "left").join(files, "repo_id", "left").fillna(0, ["commits", "contributors", "with_details", "changed"])
    if activity is not None:
        touched = activity.filter((F.col("last_modified") > start) & (F.col("last_modified") <= cursor)).groupBy("repo_id").agg(F.count("*").alias("active"))
        out = out.join(touched, "repo_id", "left").fillna(0, ["active"])
    else:
        out = out.withColumn("active", F.lit(0))
    cut = truncated.select("repo_id", F.lit(True).alias("cut")).distinct() if truncated is not None else oldest.select("repo_id", F.lit(False).alias("cut"))
    out = out.join(cut, "repo_id", "left")
    covered = F.when(~F.coalesce("cut", F.lit(False)), "full").when(cursor < F.col("oldest"), "none").when(start < F.col("oldest"), "partial").otherwise("full")
    detailed = F.col("with_details") > 0
    return out.select(
        "repo_id", "commits", "contributors", "with_details", F.when(detailed, F.col("changed")).otherwise(F.col("active")).alias("files_changed"),
        F.when(detailed, "commits").otherwise("activity").alias("basis"), covered.alias("coverage"))


def window_top_files(commits: DataFrame, changes: DataFrame, cursor: Column, days: int, most: int = 5) -> DataFrame:
    inside = commits_in_window(commits, cursor, days).filter("has_details")
    by = changes.join(inside.select("repo_id", "sha"), ["repo_id", "sha"], "left_semi").groupBy("repo_id", "path").agg(F.count("*").alias("changes"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("changes"), "path"))).filter(F.col("place") <= most)


def count_commits_in_ranges(ranges: DataFrame, commits: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Commits with start <= date < end of each range, none included; an explicit count (repo_id, start, end, commits) of the same range wins.

    ranges: repo_id, start, end. A range's whole days take the sums of days, which meet them by day; only its first and last day, where they are not whole, look at
    single commits, which meet them by day as well.
    """
    first, last = F.date_trunc("day", "start"), F.date_trunc("day", F.col("end") - F.expr("INTERVAL 1 MICROSECOND"))
    once = ranges.select("repo_id", "start", "end").distinct()
    days = once.filter("start < end").withColumn("day", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))))
    whole = (F.col("day") >= F.col("start")) & (F.col("day") + F.expr("INTERVAL 1 DAY") <= F.col("end"))
    dated = commits.filter("date IS NOT NULL").select("repo_id", F.date_trunc("day", "date").alias("day"), "date")
    sums = dated.groupBy("repo_id", "day").agg(F.count("*").alias("n"))
    inner = days.filter(whole).join(sums, ["repo_id", "day"]).select("repo_id", "start", "end", "n")
    edges = days.filter(~whole).join(dated, ["repo_id", "day"]).filter("date >= start AND date < end").select("repo_id", "start", "end", F.lit(1).cast("long").alias("n"))
    n = inner.unionByName(edges).groupBy("repo_id", "start", "end").agg(F.sum("n").alias("counted"))
    out = ranges.join(n, ["repo_id", "start", "end"], "left").withColumn("commits", F.coalesce("counted", F.lit(0))).drop("counted")
    if explicit is not None:
        out = out.join(explicit.select("repo_id", "start", "end", F.col("commits").alias("given")), ["repo_id", "start", "end"], "left").withColumn("commits", F.coalesce("given", "commits")).drop("given")
    return out


def full_history_counts(span: DataFrame, commits: DataFrame, most: int = 80) -> DataFrame:
    """Commits in the planned ranges of each repository; where some are older than its plan, the plan begins with the first year that has commits. span: repo_id, created, end."""
    first = plan_timeline_ranges(span, most).groupBy("repo_id").agg(F.min("start").alias("first"))
    older = commits.join(first, "repo_id").filter((F.col("date") >= F.expr("TIMESTAMP '1970-01-01 00:00:00'")) & (F.col("date") < F.col("first")))
    earliest = older.groupBy("repo_id").agg(F.date_trunc("year", F.min("date")).alias("earliest"))
    span = span.join(earliest, "repo_id", "left").select("repo_id", F.coalesce("earliest", "created").alias("created"), "end")
    return count_commits_in_ranges(plan_timeline_ranges(span, most), commits)


def most_active_areas(commits: DataFrame, changes: DataFrame, most: int = 3) -> DataFrame:
    """Changed files of each contributor by directory of depth one or two."""
    own = changes.join(with_authors(commits).filter("author_id IS NOT NULL").select("repo_id", "sha", "author_id"), ["repo_id", "sha"]).select("repo_id", "author_id", "path").distinct()
    parts = F.split("path", "/")
    areas = F.filter(F.array(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))), F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/"))), lambda x: x.isNotNull())
    by = own.withColumn("area", F.explode(areas)).groupBy("repo_id", "author_id", "area").agg(F.count("*").alias("files"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("repo_id", "author_id").orderBy(F.desc("files"), "area"))).filter(F.col("place") <= most)


def files_active_in_window(commits: DataFrame, changes: DataFrame, cursor: Column, days: int) -> DataFrame:
    """The latest change of each file within [cursor - days, cursor], both ends included."""
    inside = commits.filter((F.col("date") >= cursor - F.make_dt_interval(F.lit(days))) & (F.col("date") <= cursor))
    return changes.join(inside.select("repo_id", "sha", "date"), ["repo_id", "sha"]).groupBy("repo_id", "path").agg(F.max("date").alias("active"))


def files_touched_by(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """repo_id, author_id, path: every file that an author has changed, once."""
    authored = with_authors(commits).filter("author_id IS NOT NULL").select("repo_id", "sha", "author_id")
    return changes.join(authored, ["repo_id", "sha"]).select("repo_id", "author_id", "path").distinct()


def plan_timeline_ranges(span: DataFrame, most: int = 80) -> DataFrame:
    """Ranges of the finest calendar unit of which at most `most` reach from created to end; the most recent years if even these are too many.

    span: repo_id, created (null: 365 days before the end; later than the end: the end), end.
    """
    start = F.least(F.coalesce("created", F.col("end") - F.expr("INTERVAL 365 DAYS")), F.col("end"))
    units = (("week", "INTERVAL 7 DAYS"), ("month", "INTERVAL 1 MONTH"), ("quarter", "INTERVAL 3 MONTHS"), ("year", "INTERVAL 1 YEAR"))
    starts = {u: F.sequence(F.date_trunc(u, start), F.date_trunc(u, "end"), F.expr(by)) for u, by in units}
    chosen, unit = F.slice(starts["year"], F.greatest(F.lit(1), F.size(starts["year"]) - most + 1), F.lit(most)), F.lit("year")
    for u, _ in reversed(units):
        fits = F.size(starts[u]) <= most
        chosen, unit = F.when(fits, starts[u]).otherwise(chosen), F.when(fits, u).otherwise(unit)
    planned = span.select("repo_id", unit.alias("granularity"), F.explode(chosen).alias("start"))
    after = F.when(F.col("granularity") == "week", F.col("start") + F.expr("INTERVAL 7 DAYS"))
    for u, by in units[1:]:
        after = F.when(F.col("granularity") == u, F.col("start") + F.expr(by)).otherwise(after)
    return planned.withColumn("end", after)
