"""Directory, language and repository roll-ups of the inventory. All limits and rankings are per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P


def is_own() -> Column:
    return ~(F.col("is_generated") | F.col("is_binary") | (F.col("category") == "vendor"))


def own_files(inventory: DataFrame) -> DataFrame:
    """Hand-written files; all files of a repository that has none. The flag per repository is pre-aggregated, not windowed."""
    any_own = inventory.groupBy("repo_id").agg(F.bool_or(is_own()).alias("_any"))
    return inventory.join(any_own, "repo_id").filter(is_own() | ~F.col("_any")).drop("_any")


def is_config() -> Column:
    """Files that import resolution reads."""
    name = P.base_name(F.col("path"))
    return (name.isin("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "setup.py", "setup.cfg") | name.rlike(r"^(tsconfig|jsconfig)(\..+)?\.json$"))


def resolution_configs(inventory: DataFrame) -> DataFrame:
    return inventory.filter(is_config())


def restrict_to_selected(inventory: DataFrame, selected: DataFrame) -> DataFrame:
    """The inventory's rows of the selected files. selected: repo_id, path."""
    return inventory.join(selected.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def line_contribution(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """Adds lines, lines_estimated and in_graph: a graph file's own count, else an estimate; binary files 0. files: repo_id, path, exact_lines or null."""
    known = files.select("repo_id", "path", F.col("exact_lines"), F.lit(True).alias("in_graph"))
    estimate = F.when(F.col("is_binary"), 0).otherwise(P.estimate_lines(F.col("size"), F.col("language")))
    joined = inventory.join(known, ["repo_id", "path"], "left")
    return joined.select(
        *inventory.columns, F.coalesce("in_graph", F.lit(False)).alias("in_graph"), F.coalesce("exact_lines", estimate).cast("long").alias("lines"),
        (F.col("exact_lines").isNull() & ~F.col("is_binary") & (F.col("size") > 0)).alias("lines_estimated"))


def directory_rollup(counted: DataFrame) -> DataFrame:
    """Every directory with everything below it. counted: line_contribution's rows with symbols (or 0).

    Each file is first summed into its own directory, so a directory's row, not its files, is copied to its ancestors.
    """
    any_own = counted.groupBy("repo_id").agg(F.bool_or(is_own()).alias("any_own"))
    lines = F.when(is_own() | ~F.col("any_own"), F.col("lines")).otherwise(0)
    direct = counted.join(any_own, "repo_id").groupBy("repo_id", "directory").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(lines).alias("lines"),
        F.bool_or((is_own() | ~F.col("any_own")) & F.col("lines_estimated")).alias("estimated"),
        F.count_if(~F.col("in_graph")).alias("omitted"))
    up = direct.withColumn("dir", F.explode(F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array("directory"), P.ancestors(F.col("directory"))))))
    total = up.groupBy("repo_id", F.col("dir").alias("path")).agg(
        F.sum("files").alias("file_count"), F.sum(F.when(F.col("dir") == F.col("directory"), F.col("files")).otherwise(0)).alias("direct_file_count"),
        F.sum("lines").alias("total_lines"), F.bool_or("estimated").alias("lines_estimated"), F.sum("bytes").alias("total_bytes"), F.sum("omitted").alias("omitted_file_count"))
    children = total.filter("path <> ''").groupBy("repo_id", P.parent_path(F.col("path")).alias("path")).agg(F.count("*").alias("direct_directory_count"))
    return total.join(children, ["repo_id", "path"], "left").fillna(0, ["direct_directory_count"]).withColumn("depth", P.directory_depth(F.col("path")))


def directory_language_bytes(inventory: DataFrame) -> DataFrame:
    """repo_id, path, language_bytes: a map by language, keys in order, of each directory and all below."""
    direct = inventory.groupBy("repo_id", "directory", "language").agg(F.sum("size").alias("bytes"))
    up = direct.withColumn("path", F.explode(F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array("directory"), P.ancestors(F.col("directory"))))))
    by = up.groupBy("repo_id", "path", "language").agg(F.sum("bytes").alias("bytes"))
    return by.groupBy("repo_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "bytes")))).alias("language_bytes"))


def language_stats(counted: DataFrame) -> DataFrame:
    own = own_files(counted).groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"))
    total = F.sum("bytes").over(Window.partitionBy("repo_id"))
    return own.withColumn("share", F.when(total > 0, F.col("bytes") / total).otherwise(0.0)).withColumn("parseable", P.is_parseable(F.col("language")))


def language_segments(stats: DataFrame, most: int = 8) -> DataFrame:
    """The largest languages; beyond `most`, the tail as one segment named after its number."""
    w = Window.partitionBy("repo_id")
    ranked = stats.filter("bytes > 0").withColumn("place", F.row_number().over(w.orderBy(F.desc("bytes"), "language"))).withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("bytes").over(w))
    tail = (F.col("n") > most) & (F.col("place") >= most)
    folded = ranked.withColumn("segment", F.when(tail, "other").otherwise(F.col("language"))).withColumn("at", F.when(tail, most).otherwise(F.col("place")))
    name = F.when(F.col("segment") == "other", F.concat(F.col("members").cast("string"), F.lit(" others"))).otherwise(F.col("segment"))
    out = folded.groupBy("repo_id", "segment", "at", "total").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.count("*").alias("members"))
    return out.select("repo_id", "segment", F.col("at").alias("place"), name.alias("name"), "bytes", "files", (F.col("bytes") / F.col("total")).alias("share"))


def determine_tier(inventory: DataFrame) -> DataFrame:
    n = F.col("files")
    return inventory.groupBy("repo_id").agg(F.count("*").alias("files")).withColumn("tier", F.when(n <= 1000, "full").when(n <= 10000, "progressive").otherwise("directory-first"))


def unsupported_languages(inventory: DataFrame) -> DataFrame:
    missing = inventory.filter(~F.col("is_generated") & (F.col("category") == "source") & ~P.is_parseable(F.col("language")))
    return missing.groupBy("repo_id", "language").agg(F.count("*").alias("files"))


def parse_coverage(files: DataFrame) -> DataFrame:
    fit = P.is_parseable(F.col("language")) & ~F.col("is_generated") & (F.col("status") != "binary")
    done = files.groupBy("repo_id").agg(F.count_if(fit & F.col("status").isin("parsed", "partial")).alias("parsed"), F.count_if(fit).alias("eligible"))
    return done.withColumn("share", F.when(F.col("eligible") == 0, 1.0).otherwise(F.col("parsed") / F.col("eligible")))


def largest_files(files: DataFrame, most: int = 5) -> DataFrame:
    """Hand-written files that are not binary, by lines, size and path. WindowGroupLimit keeps `most` per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("lines"), F.desc("size"), "path"))
    return files.filter(is_own()).withColumn("place", rank).filter(F.col("place") <= most)


def largest_files_below(files: DataFrame, most: int = 5) -> DataFrame:
    """The largest hand-written files of every directory and all below it: repo_id, directory, path, lines, size, place."""
    own = files.filter(is_own()).select("repo_id", "path", "lines", "size", F.explode(P.ancestors(F.col("path"))).alias("directory"))
    place = F.row_number().over(Window.partitionBy("repo_id", "directory").orderBy(F.desc("lines"), F.desc("size"), "path"))
    return own.withColumn("place", place).filter(F.col("place") <= most)


def largest_directories(directories: DataFrame, most: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("total_lines"), "path"))
    return directories.withColumn("place", place).filter(F.col("place") <= most)


def tree_listing(directories: DataFrame, files: DataFrame, page: int = 200) -> DataFrame:
    """The children of every directory, directories first, then by name without case; with place, number, page and what remains after it."""
    dirs = directories.filter("path <> ''").select("repo_id", "path", P.parent_path(F.col("path")).alias("parent"), F.lit(0).alias("kind"))
    both = dirs.unionByName(files.select("repo_id", "path", P.parent_path(F.col("path")).alias("parent"), F.lit(1).alias("kind")))
    name = P.base_name(F.col("path"))
    w = Window.partitionBy("repo_id", "parent")
    placed = both.withColumn("place", F.row_number().over(w.orderBy("kind", F.lower(name), name))).withColumn("siblings", F.count("*").over(w))
    at = F.floor((F.col("place") - 1) / page)
    return placed.select("repo_id", "parent", "path", "kind", "place", "siblings", at.alias("page"), F.greatest(F.lit(0), F.col("siblings") - (at + 1) * page).alias("remaining"))


def files_under(inventory: DataFrame) -> DataFrame:
    """repo_id, directory, path: every file with each directory above it."""
    return inventory.select("repo_id", F.explode(P.ancestors(F.col("path"))).alias("directory"), "path")


def category_emphasis() -> Column:
    return F.when(F.col("is_generated") | (F.col("category") == "vendor"), 0.4).when(F.col("category").isin("test", "docs", "config"), 0.88).otherwise(1.0)


def honesty_flags() -> Column:
    flag = lambda c, n: F.when(F.col(c), n).otherwise(0)
    return flag("lines_estimated", 1).bitwiseOR(flag("is_binary", 2)).bitwiseOR(flag("is_generated", 4))


def select_graph_files(inventory: DataFrame, most: int) -> DataFrame:
    """At most `most` files of each repository: first the best real file of each directory, up to half of them, then round-robin over the
    directories of each priority class. Ranks inside (repository, class, directory) come first, so only places are ordered over a whole repository."""
    c = inventory.withColumn("class", P.priority_class(F.col("category"), F.col("is_generated")))
    best = Window.partitionBy("repo_id", "directory").orderBy("class", "depth", "path")
    c = c.withColumn("in_dir", F.row_number().over(best)).withColumn("n", F.count("*").over(Window.partitionBy("repo_id")))
    real = (F.col("in_dir") == 1) & ~F.col("is_generated") & (F.col("category") != "vendor")
    first = F.row_number().over(Window.partitionBy("repo_id", real).orderBy("class", "depth", "path"))
    c = c.withColumn("first", real & (first <= most // 2))
    round_ = F.row_number().over(Window.partitionBy("repo_id", "class", "directory", "first").orderBy("depth", "path"))
    c = c.withColumn("round", F.when(~F.col("first"), round_))
    taken = F.sum(F.col("first").cast("int")).over(Window.partitionBy("repo_id"))
    place = F.row_number().over(Window.partitionBy("repo_id", "first").orderBy("class", "round", P.directory_depth(F.col("directory")), "directory"))
    c = c.withColumn("taken", taken).withColumn("place", place)
    return c.filter((F.col("n") <= most) | F.col("first") | (F.col("place") <= most - F.col("taken"))).select("repo_id", "path", (F.col("first") & (F.col("n") > most)).alias("representative"))


def check_references(keys: dict[str, tuple[DataFrame, DataFrame, list[str]]], wrong: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: for each key the rows without a partner (child, parent, columns), for each other rule its rows."""
    out = None
    for rule, rows in {**{k: child.join(parent.select(*on).distinct(), on, "left_anti") for k, (child, parent, on) in keys.items()}, **wrong}.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
