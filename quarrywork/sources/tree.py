"""From raw tree listings to the classified inventory. Tables carry repo_id first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P


def sanitize_paths(tree: DataFrame, max_length: int = 1024) -> DataFrame:
    return tree.withColumn("accepted", P.acceptable(F.col("path"), max_length))


def excluded_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("repo_id").agg(F.count_if(F.col("type") == "submodule").alias("submodules"), F.count_if(F.col("type") == "symlink").alias("symlinks"))


def cap_tree(tree: DataFrame, most: int) -> DataFrame:
    """The first `most` distinct acceptable paths of each repository in listing order, and whether there were more."""
    once = tree.filter(P.acceptable(F.col("path"))).groupBy("repo_id", "path").agg(F.min("ordinal").alias("ordinal"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("ordinal")))
    total = once.groupBy("repo_id").agg((F.count("*") > most).alias("truncated"))
    return placed.filter(F.col("place") <= most).join(total, "repo_id").select("repo_id", "path", "ordinal", "truncated")


def classify(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return (
        files.withColumn("language", P.detect_language(path)).withColumn("parser_language", P.parser_language(path))
        .withColumn("category", P.detect_category(path, F.col("language"))).withColumn("is_generated", P.is_generated_path(path))
        .withColumn("is_binary", P.is_binary_path(path)).withColumn("depth", P.depth_of(path)).withColumn("directory", P.parent_path(path))
    )


def build_inventory(tree: DataFrame) -> DataFrame:
    """Regular files with a representable path, the first entry of each path, classified. One shuffle, pre-aggregated."""
    fine = F.forall(F.split("path", "/"), lambda s: ~s.isin("", ".", ".."))
    files = tree.filter((F.col("type") == "file") & fine).groupBy("repo_id", "path").agg(F.min_by("size", "ordinal").alias("size"))
    return classify(files.withColumn("size", F.greatest(F.coalesce(F.floor("size"), F.lit(0)), F.lit(0)).cast("long")))
