"""Symbols of files: clean rows with parents, nesting depths, relative spans, counts by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X
from ..functions import values as V
from ..shared import settle


def build_symbols(raw: DataFrame) -> DataFrame:
    """raw (repo_id, path, seq, name, kind, start_line, end_line, exported, signature, parent_seq) -> the same with id and parent_id, in source order (place).

    Names are trimmed, those without one go; lines are at least 1 and ends not before starts; of one id the first in the file stays; a parent is the id that
    its row has, also where that row went as a repeat, but never the symbol itself.
    """
    start = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1))).cast("int")
    named = raw.withColumn("name", F.trim("name")).filter("name <> ''").withColumn("start_line", start).withColumn("end_line", F.greatest("start_line", F.coalesce("end_line", F.lit(1))).cast("int"))
    named = named.withColumn("id", P.symbol_id(F.col("path"), F.col("name"), F.col("start_line"))).withColumn("signature", X.normalize_signature(F.col("signature")))
    rest = [c for c in named.columns if c not in ("repo_id", "path", "id")]
    first = named.groupBy("repo_id", "path", "id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("repo_id", "path", "id", "r.*")
    parents = named.select("repo_id", "path", F.col("seq").alias("parent_seq"), F.col("id").alias("parent_id"))
    linked = first.join(parents, ["repo_id", "path", "parent_seq"], "left").withColumn("parent_id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")))
    return linked.drop("parent_seq").withColumn("place", F.row_number().over(Window.partitionBy("repo_id", "path").orderBy("start_line", F.desc("end_line"), "seq")))


def symbol_spans(symbols: DataFrame, files: DataFrame, least: float = 0.015) -> DataFrame:
    """symbols (repo_id, path, id, parent_id, start_line, end_line), files (repo_id, path, lines) -> repo_id, path, id, depth, low, high.

    A span is the symbol's share of the file's lines, from 0 to 1, widened to `least` around its middle and kept inside its parent's. Depth
    counts parents that exist in the file; symbols on a ring of parents, which only broken input has, count as top-level. One join for each level.
    """
    lines = symbols.groupBy("repo_id", "path").agg(F.max("end_line").alias("last")).join(files.select("repo_id", "path", "lines"), ["repo_id", "path"], "left")
    lines = lines.select("repo_id", "path", F.greatest(F.lit(1), "last", F.coalesce("lines", F.lit(0))).alias("n"))
    own = symbols.join(symbols.select("repo_id", "path", F.col("id").alias("parent_id"), F.lit(True).alias("known")), ["repo_id", "path", "parent_id"], "left").join(lines, ["repo_id", "path"])
    start = F.least(F.greatest(F.lit(1), "start_line"), "n")
    end = F.least(F.greatest("end_line", start), "n")
    left = settle(own.select("repo_id", "path", "id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), ((start - 1) / F.col("n")).alias("y0"), (end / F.col("n")).alias("y1")), "symbol-bands")

    def placed(rows: DataFrame) -> DataFrame:
        size = F.least(F.col("top") - F.col("bottom"), F.greatest(F.col("y1") - F.col("y0"), F.lit(least)))
        low = F.greatest(F.col("bottom"), F.least((F.col("y0") + F.col("y1")) / 2 - size / 2, F.col("top") - size))
        return rows.select("repo_id", "path", "id", "depth", low.alias("low"), (low + size).alias("high"))

    top = lambda rows: placed(rows.select("*", F.lit(0).alias("depth"), F.lit(0.0).alias("bottom"), F.lit(1.0).alias("top")))
    level = settle(top(left.filter("parent_id IS NULL")), "symbol-level")
    left, done = left.filter("parent_id IS NOT NULL"), [level]
    while not left.isEmpty():
        above = level.select("repo_id", "path", F.col("id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("bottom"), F.col("high").alias("top"))
        level = settle(placed(left.join(above, ["repo_id", "path", "parent_id"])), "symbol-level")
        if level.isEmpty():
            done.append(top(left))
            break
        done.append(level)
        left = settle(left.join(level.select("repo_id", "path", "id"), ["repo_id", "path", "id"], "left_anti"), "symbol-left")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """functions (with methods), classes (with structs) and total of each file."""
    return symbols.groupBy("repo_id", "path").agg(F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind").isin("class", "struct")).alias("classes"), F.count("*").alias("total"))


def kind_counts(symbols: DataFrame) -> DataFrame:
    """A column for each kind, in display order."""
    return symbols.groupBy("repo_id", "path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in V.KIND_LABELS])
