"""From raw provider payloads to commits, changed files and contributors; text or binary content; the structure-only preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import characters as C
from ..functions import paths as P
from ..functions import text as X

COMMIT = (
    "struct<sha: string, html_url: string, commit: struct<message: string, author: struct<name: string, date: string>, committer: struct<date: string>>, "
    "author: struct<login: string>, stats: struct<additions: bigint, deletions: bigint>, files: array<struct<filename: string>>>"
)
#: Bytes that are looked at, and the share of control bytes above which content is binary.
SNIFF, CONTROL = 8192, 0.3


def valid_login(login: Column) -> Column:
    """A login of an account or an app; else null."""
    account = F.when(login.endswith("[bot]"), F.left(login, F.length(login) - 5)).otherwise(login)
    return F.when(C.only(account, C.ALNUM + "-") & ~account.startswith("-") & F.length(account).between(1, 39), login)


def flatten_commits(raw: DataFrame) -> DataFrame:
    """raw (repo_id, payload: JSON) -> repo_id, sha, message, author_login, author_name, date (UTC text), additions, deletions; rows without a full sha or a date go."""
    c = raw.select("repo_id", F.from_json("payload", COMMIT).alias("c"))
    login = valid_login(F.col("c.author.login"))
    name = F.nullif(X.clean_single_line(F.col("c.commit.author.name"), 200), F.lit(""))
    date = F.coalesce(X.normalize_iso_date(F.col("c.commit.author.date")), X.normalize_iso_date(F.col("c.commit.committer.date")))
    return c.filter(F.col("c.sha").rlike("(?i)^[0-9a-f]{40}$")).select(
        "repo_id", F.lower("c.sha").alias("sha"), X.clean_single_line(X.first_line(F.col("c.commit.message")), 300).alias("message"), login.alias("author_login"),
        F.coalesce(name, login, F.lit("Unknown")).alias("author_name"), date.alias("date"), F.col("c.stats.additions").alias("additions"), F.col("c.stats.deletions").alias("deletions"),
    ).filter("date IS NOT NULL")


def flatten_commit_files(raw: DataFrame, max_length: int = 1024) -> DataFrame:
    """repo_id, sha, path: the acceptable changed paths of every commit, each once."""
    c = raw.select("repo_id", F.from_json("payload", COMMIT).alias("c")).filter(F.col("c.sha").rlike("(?i)^[0-9a-f]{40}$"))
    paths = F.array_distinct(F.transform("c.files", lambda f: f["filename"]))
    return c.select("repo_id", F.lower("c.sha").alias("sha"), F.explode(paths).alias("path")).filter(P.acceptable(F.col("path"), max_length)).distinct()


def ingest_contributors(raw: DataFrame) -> DataFrame:
    """raw (repo_id, ordinal, login, contributions) -> the first row of each login, whatever its case, most contributions first. Adds place."""
    good = raw.filter(valid_login(F.col("login")).isNotNull())
    first = good.groupBy("repo_id", F.lower("login").alias("key")).agg(F.min_by(F.struct("ordinal", "login", "contributions"), "ordinal").alias("r")).select("repo_id", "r.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("contributions"), "ordinal"))).drop("ordinal")


def looks_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL or mostly control bytes."""
    head = F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1")
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0b\x0e-\x1f\x7f]"))
    return F.coalesce(head.contains("\x00") | (control > F.length(head) * CONTROL), F.lit(False))


def classify_content(files: DataFrame) -> DataFrame:
    """files (..., content: binary) -> the same with kind (text or binary), text (lenient UTF-8 without a byte order mark; null if binary) and bytes."""
    binary = looks_binary(F.col("content"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    return files.select(*[c for c in files.columns if c != "content"], F.when(binary, "binary").otherwise("text").alias("kind"), F.when(~binary, text).alias("text"), F.octet_length("content").cast("long").alias("bytes"))


def read_content(spark: SparkSession, at: str, max_bytes: int = 1 << 20) -> DataFrame:
    """path, kind, text, bytes of the files below a folder; those over max_bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).filter(F.col("length") <= max_bytes)
    return classify_content(files.select("path", "content"))


def preview_graph(inventory: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected files by structure alone: binary ones stay so, all others have metadata and estimated lines."""
    lines = F.when(F.col("is_binary"), 0).otherwise(P.estimate_lines(F.col("size"), F.col("language")))
    return inventory.join(selected.select("repo_id", "path"), ["repo_id", "path"], "left_semi").select(
        "repo_id", "path", F.when(F.col("is_binary"), "binary").otherwise("metadata-only").alias("status"), lines.alias("lines"), (~F.col("is_binary")).alias("lines_estimated"))
