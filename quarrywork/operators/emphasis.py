"""How strongly each file shows, from 0 to 1, by the view that is on and by what is selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import history as H
from .scores import activity_range, clamp

# Fixed values.
OUT_OF_FOCUS, DIMMED = 0.15, 0.18
SLOTS = 8


def contributor_slots(people: DataFrame, most: int = SLOTS) -> DataFrame:
    """The palette's places of the most active contributors: repo_id, id, slot."""
    ranked = H.rank_contributors(people.filter("commit_count > 0 OR contributions > 0 OR files > 0"))
    return ranked.filter(F.col("by_palette") <= most).select("repo_id", "id", F.col("by_palette").alias("slot"))


def contributor_highlight(files: DataFrame, activity: DataFrame, people: DataFrame, touched: DataFrame, active: DataFrame) -> DataFrame:
    """repo_id, path, role, slot, emphasis, glow of every file.

    files: repo_id, path. activity: repo_id, path, last_author_id. touched: repo_id, author_id, path. active: repo_id, id, the contributor that is picked, at most one a
    repository. One who has touched files lights these: last where theirs was the last change. Else files show their last author: slot for one of
    the palette, other for the rest, none without one.
    """
    own = touched.join(active.select("repo_id", F.col("id").alias("author_id")), ["repo_id", "author_id"], "left_semi").select("repo_id", "path", F.lit(True).alias("own")).distinct()
    lit = own.select("repo_id").distinct().withColumn("lit", F.lit(True))
    j = files.select("repo_id", "path").join(activity.select("repo_id", "path", "last_author_id"), ["repo_id", "path"], "left").join(own, ["repo_id", "path"], "left").join(lit, "repo_id", "left")
    j = j.join(active.select("repo_id", F.col("id").alias("picked")), "repo_id", "left").join(contributor_slots(people).withColumnRenamed("id", "last_author_id"), ["repo_id", "last_author_id"], "left")
    role = (
        F.when(F.col("lit") & F.col("own").isNull(), "dimmed").when(F.col("lit") & F.col("last_author_id").eqNullSafe(F.col("picked")), "last").when(F.col("lit"), "touched")
        .when(F.col("last_author_id").isNull(), "none").when(F.col("slot").isNotNull(), "slot").otherwise("other")
    )
    level = lambda **of: F.coalesce(*[F.when(F.col("role") == k, v) for k, v in of.items()])
    j = j.withColumn("role", role)
    return j.select(
        "repo_id", "path", "role", F.when(F.col("role") == "slot", F.col("slot")).alias("slot"), level(dimmed=DIMMED, last=1.0, touched=1.0, none=0.4, slot=0.95, other=0.6).alias("emphasis"),
        level(dimmed=0.0, last=0.4, touched=0.2, none=0.0, slot=0.0, other=0.0).alias("glow"))


def mode_emphasis(files: DataFrame, mode: str) -> DataFrame:
    """files (repo_id, path, lines, max_lines, degree, max_degree, last_modified, touched) with emphasis: what the mode is about from faint to full.

    touched: whether the picked contributor has touched the file; null where none is picked, or one without files.
    """
    if mode == "contributors":
        level = F.when(F.col("touched").isNull(), 0.8).when(F.col("touched"), 1.0).otherwise(0.14)
    elif mode == "activity":
        files = files.join(activity_range(files.filter("last_modified IS NOT NULL")), "repo_id", "left")
        millis = lambda c: F.unix_millis(F.col(c)).cast("double")
        span = F.greatest(F.lit(1.0), millis("last") - millis("first"))
        level = F.when(F.col("last_modified").isNull(), DIMMED).otherwise(0.2 + 0.8 * clamp((millis("last_modified") - millis("first")) / span))
        return files.withColumn("emphasis", level).drop("first", "last")
    elif mode == "complexity":
        level = 0.2 + 0.8 * F.least(F.lit(1.0), F.col("lines") / F.greatest(F.lit(1), "max_lines"))
    elif mode == "dependencies":
        level = F.when(F.col("degree") == 0, DIMMED).otherwise(0.35 + 0.65 * F.least(F.lit(1.0), F.col("degree") / F.greatest(F.lit(1), "max_degree")))
    else:
        level = F.lit(0.9)
    return files.withColumn("emphasis", level)


def layered_emphasis(emphasis: Column, glow: Column, binary: Column, related: Column, in_focus: Column, selected: Column, hovered: Column) -> tuple[Column, Column]:
    """(emphasis, glow) after the layers on top of the mode's: binary files glow little, neighbours of the selection are hinted at, what is outside the focus dims, then selection, then hover.

    in_focus is null where nothing is focused.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    g = F.when(yes(binary), F.least(glow, F.lit(0.1))).otherwise(glow)
    e, g = F.when(yes(related), F.greatest(emphasis, F.lit(0.9))).otherwise(emphasis), F.when(yes(related), F.greatest(g, F.lit(0.22))).otherwise(g)
    outside = ~F.coalesce(in_focus, F.lit(True))
    e, g = F.when(outside, F.least(e, F.lit(OUT_OF_FOCUS))).otherwise(e), F.when(outside, 0.0).otherwise(g)
    e, g = F.when(yes(selected), 1.0).otherwise(e), F.when(yes(selected), F.greatest(g, F.lit(0.3))).otherwise(g)
    e, g = F.when(yes(hovered), F.least(F.lit(1.0), F.greatest(e + 0.35, F.lit(0.75)))).otherwise(e), F.when(yes(hovered), g + 0.18).otherwise(g)
    return clamp(e), clamp(g)
