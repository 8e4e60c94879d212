"""Directory trees made whole, directories with content, and grids of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..shared import settle
from .forest import any_below, depths, least_above


def rehome_orphans(directories: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """directories (repo_id, id, path, parent_id; the root has path ''), files (repo_id, id, path, directory_id) -> the same, each id once, unknown parents and directories replaced by the root.

    Of one id the smallest path stays.
    """
    once = lambda df: df.groupBy("repo_id", "id").agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("repo_id", "id")]), "path").alias("r")).select("repo_id", "id", "r.*")
    d, f = once(directories), once(files)
    root = d.filter("path = ''").groupBy("repo_id").agg(F.min("id").alias("root"))
    known = d.select("repo_id", F.col("id").alias("k"), F.lit(True).alias("known"))
    own = d.join(known.withColumnRenamed("k", "parent_id"), ["repo_id", "parent_id"], "left").join(root, "repo_id")
    parent = F.when(F.col("id") == F.col("root"), None).when(F.col("known") & (F.col("parent_id") != F.col("id")), F.col("parent_id")).otherwise(F.col("root"))
    homed = f.join(known.withColumnRenamed("k", "directory_id"), ["repo_id", "directory_id"], "left").join(root, "repo_id")
    return own.select("repo_id", "id", "path", parent.alias("parent_id")), homed.select("repo_id", "id", "path", F.when(F.col("known"), F.col("directory_id")).otherwise(F.col("root")).alias("directory_id"))


def content_districts(directories: DataFrame, files: DataFrame) -> DataFrame:
    """directories (repo_id, id, path, parent_id, omitted: files left out below it, direct: files in it) and files (repo_id, directory_id) -> repo_id, id, level, direct_omitted of those with content.

    Directories that the root does not reach, on rings of parents, hang below the root from the first of them by path on. A directory has content if it, or
    one below, holds files or leaves some out. Parents come from rehome_orphans. Levels and contents are found by doubling, so a chain of any length takes few steps.
    """
    group = ["repo_id"]
    d = settle(directories, "district-rows")
    tree = d.select("repo_id", "id", F.col("parent_id").alias("up"))
    levels, lost = depths(tree, group)
    if not lost.isEmpty():
        # taken in the order of paths, a directory is hung up if none above it comes before it
        ranked = lost.join(d.select("repo_id", "id", "path"), ["repo_id", "id"])
        first = least_above(ranked, group, F.struct("path", "id")).filter(F.col("least.id") == F.col("id")).select("repo_id", "id")
        roots = d.filter("parent_id IS NULL").groupBy("repo_id").agg(F.min("id").alias("root"))
        hung = first.join(roots, "repo_id").select("repo_id", "id", "root")
        tree = settle(tree.join(hung, ["repo_id", "id"], "left").select("repo_id", "id", F.coalesce("root", "up").alias("up")), "district-tree")
        levels, _ = depths(tree, group)
    held = files.groupBy("repo_id", F.col("directory_id").alias("id")).agg(F.count("*").alias("held"))
    own = tree.join(levels.withColumnRenamed("depth", "level"), ["repo_id", "id"]).join(d.select("repo_id", "id", "omitted", "direct"), ["repo_id", "id"]).join(held, ["repo_id", "id"], "left").fillna(0, ["held"])
    below = own.filter("up IS NOT NULL").groupBy("repo_id", F.col("up").alias("id")).agg(F.sum("omitted").alias("below"))
    own = own.join(below, ["repo_id", "id"], "left").fillna(0, ["below"]).withColumn("direct_omitted", F.greatest(F.lit(0), F.col("omitted") - F.col("below"), F.col("direct") - F.col("held")))
    own = settle(own, "district-own")
    height = own.agg(F.max("level")).first()[0] or 0
    wanted = any_below(own, group, F.col("up").isNull() | (F.col("held") > 0) | (F.col("direct_omitted") > 0), height)
    return own.join(wanted, ["repo_id", "id"], "left_semi").select("repo_id", "id", "level", "direct_omitted")


def spatial_grid(places: DataFrame, threshold: int = 4000, target: int = 1500) -> DataFrame:
    """places (repo_id, x, z, width, depth, base, height) -> repo_id, cell, members, centre and radius of a ball around them. Up to `threshold` places are one cell, -1; more are cut so that a cell holds about `target`."""
    box = places.groupBy("repo_id").agg(
        F.count("*").alias("n"), *[F.min(F.col(c) - F.col(w) / 2).alias(f"{c}0") for c, w in (("x", "width"), ("z", "depth"))], *[F.max(F.col(c) + F.col(w) / 2).alias(f"{c}1") for c, w in (("x", "width"), ("z", "depth"))])
    box = box.withColumn("cells", F.greatest(F.lit(2), F.ceil(F.sqrt(F.col("n") / float(target)))))
    at = lambda c: F.least(F.col("cells") - 1, F.greatest(F.lit(0), F.floor((F.col(c) - F.col(f"{c}0")) / F.greatest(F.lit(1e-6), F.col(f"{c}1") - F.col(f"{c}0")) * F.col("cells"))))
    binned = places.join(box, "repo_id").withColumn("cell", F.when(F.col("n") <= threshold, F.lit(-1)).otherwise(at("z") * F.col("cells") + at("x")).cast("long"))
    low = {"x": F.col("x") - F.col("width") / 2, "y": F.col("base"), "z": F.col("z") - F.col("depth") / 2}
    high = {"x": F.col("x") + F.col("width") / 2, "y": F.col("base") + F.col("height"), "z": F.col("z") + F.col("depth") / 2}
    centre = binned.groupBy("repo_id", "cell").agg(F.count("*").alias("members"), *[((F.min(low[a]) + F.max(high[a])) / 2).alias(f"c{a}") for a in "xyz"])
    far = lambda a: F.greatest(F.abs(low[a] - F.col(f"c{a}")), F.abs(high[a] - F.col(f"c{a}")))
    radius = binned.join(centre, ["repo_id", "cell"]).groupBy("repo_id", "cell").agg(F.sqrt(F.max(far("x") * far("x") + far("y") * far("y") + far("z") * far("z"))).alias("radius"))
    return centre.join(radius, ["repo_id", "cell"])


def parent_ids(directories: DataFrame) -> DataFrame:
    """repo_id, id, path, parent_id of a directory roll-up's rows."""
    path = F.col("path")
    return directories.select("repo_id", P.directory_id(path).alias("id"), "path", F.when(path != "", P.directory_id(P.parent_path(path))).alias("parent_id"))
