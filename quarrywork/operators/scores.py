"""Numeric scores of files, 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def graph_maxima(files: DataFrame) -> DataFrame:
    top = lambda c: F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(1))).alias(f"max_{c}")
    return files.groupBy("repo_id").agg(top("lines"), top("symbols"), top("degree"))


def activity_range(activity: DataFrame) -> DataFrame:
    return activity.groupBy("repo_id").agg(F.min("last_modified").alias("first"), F.max("last_modified").alias("last"))


def complexity_score(files: DataFrame) -> DataFrame:
    """Lines on a log scale, symbols and degree, each against its repository's largest; lines alone where nothing was parsed; binary files 0.

    The maxima are one row per repository; Spark joins them by repo_id.
    """
    line = F.log1p(F.col("lines")) / F.log1p(F.col("max_lines"))
    whole = 0.5 * line + 0.28 * F.sqrt(F.col("symbols") / F.col("max_symbols")) + 0.22 * F.sqrt(F.col("degree") / F.col("max_degree"))
    score = F.when(F.col("status") == "binary", 0.0).when(F.col("status").isin("parsed", "partial"), clamp(whole)).otherwise(clamp(line))
    return files.join(graph_maxima(files), "repo_id").withColumn("complexity", score)


def recency_score(activity: DataFrame, now: Column, days: float = 180.0) -> DataFrame:
    """0.8 of the place in the repository's own range of changes, 0.2 of exp(-age / days); 0 without a change."""
    span = activity.groupBy("repo_id").agg(F.min("last_modified").alias("lo"), F.max("last_modified").alias("hi"))
    at = lambda c: F.unix_micros(c) / 1e6
    relative = F.when(F.col("hi") > F.col("lo"), clamp((at("last_modified") - at("lo")) / (at("hi") - at("lo")))).otherwise(1.0)
    fresh = F.exp(-F.greatest(F.lit(0.0), at(now) - at("last_modified")) / (days * 86400.0))
    return activity.join(span, "repo_id").withColumn("recency", F.when(F.col("last_modified").isNull(), 0.0).otherwise(clamp(0.8 * relative + 0.2 * fresh)))


def size_measures(size: Column, lines: Column, generated: Column, binary: Column, low: float = 1.0, high: float = 6.0) -> tuple[Column, Column]:
    """Footprint by the root of the size up to 64 KiB; height saturating in the root of the lines, capped at 12 % of the range for generated files, binary ones flat."""
    footprint = F.lit(low) + (high - low) * F.sqrt(F.least(size, F.lit(65536)) / 65536.0)
    root = F.sqrt(lines.cast("double"))
    share = root / (root + F.sqrt(F.lit(1500.0)))
    height = F.when((lines == 0) | binary, F.lit(low)).otherwise(F.lit(low) + (high - low) * F.when(generated, F.least(share, F.lit(0.12))).otherwise(share))
    return footprint, height


def activity_heat(activity: DataFrame, cursor: Column, days: int) -> DataFrame:
    """1 at the cursor down to 0 at the start of the window, ends included; null outside."""
    age = (F.unix_micros(cursor) - F.unix_micros("last_modified")) / 86_400_000_000.0
    return activity.withColumn("heat", F.when((age >= 0) & (age <= days), 1 - age / days))


def dependency_strength(degrees: DataFrame) -> DataFrame:
    top = degrees.groupBy("repo_id").agg(F.greatest(F.lit(1), F.max("degree")).alias("max_degree"))
    return degrees.join(top, "repo_id").withColumn("strength", F.sqrt(F.col("degree") / F.col("max_degree")))
