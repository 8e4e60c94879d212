"""Budgets: which files are fetched and parsed, byte budgets that skip and go on, caps of what is extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..shared import settle
from .ordered import ranged, running


def fetch_class(is_config: Column, max_parse: int, max_file: int, text_limit: int) -> Column:
    """The one class of each graph file, in the order of the rules."""
    size, parsed = F.col("size"), F.col("parser_language").isNotNull()
    return (
        F.when(F.col("is_binary"), "binary").when(F.col("is_generated") | (F.col("category") == "vendor"), "generated")
        .when(parsed & (size <= max_parse), "parse").when(is_config, "free").when(parsed & (size <= max_file), "oversized").when(parsed, "size-limit")
        .when(size <= min(text_limit, max_file), "text").otherwise("not-parseable")
    )


#: Repositories whose state is broadcast at most.
FEW = 200_000
SEGMENT = "struct<until: bigint, most: bigint, last: boolean>"


def byte_budget(items: DataFrame, budget: int | DataFrame) -> DataFrame:
    """items (repo_id, place, size, ...) in the order of place: an item is taken if it still fits, else skipped, and the next one is tried. Adds taken.

    budget: bytes for every repository, or repo_id and left; one without a budget takes nothing. Sizes are not negative; places are whole numbers, each once.

    A repository goes through segments of its items, two in a round. In the first all that is not larger than the room left is taken, up to the first item that no longer
    fits. In the second, with b the largest power of two within the room, items under b are taken as they come, and larger ones pass until one fits or the
    room falls under b. So the room loses a binary digit in each round: there are at most as many rounds as the budget has digits, however many items there are
    and however their sizes stand. A round is two sums over the items; what is kept of it is where a segment ends, what it takes, and whether its last item is taken.
    """
    rows = ranged(items.select("repo_id", F.col("place").cast("long").alias("place"), F.col("size").cast("long").alias("size")), "repo_id", [F.col("place")], "budget-items")
    given = budget.select("repo_id", "left") if isinstance(budget, DataFrame) else rows.select("repo_id").distinct().withColumn("left", F.lit(budget))
    none = F.array().cast(f"array<{SEGMENT}>")
    state = settle(given.filter("left >= 0").select("repo_id", F.col("left").cast("long").alias("left"), F.lit(None).cast("long").alias("at"), F.lit(False).alias("done"), none.alias("segments")), "budget-state")
    few = state.count() <= FEW
    side = F.broadcast if few else (lambda df: df)
    while not state.filter("NOT done").isEmpty():
        for step in (_all_that_fit, _under_a_power):
            now = side(state.filter("NOT done").select("repo_id", "left", "at"))
            open_ = rows.join(now, "repo_id").filter((F.col("at").isNull() | (F.col("place") > F.col("at"))) & (F.col("size") <= F.col("left")))
            state = settle(state.join(step(open_), "repo_id", "left").select(
                "repo_id", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"), F.coalesce("until", "at").alias("at"), (F.col("done") | F.col("until").isNull()).alias("done"),
                F.when(F.col("done") | F.col("most").isNull(), F.col("segments")).otherwise(F.concat("segments", F.array(F.struct("until", "most", "last").cast(SEGMENT)))).alias("segments")), "budget-state")
    found = items.join(side(state.select("repo_id", "segments")), "repo_id", "left")
    own = F.get(F.filter("segments", lambda s: s["until"].isNull() | (F.col("place") <= s["until"])), F.lit(0))
    last = own["until"].eqNullSafe(F.col("place"))
    taken = F.when(last, own["last"]).otherwise(F.col("size") <= own["most"])
    return found.withColumn("taken", F.coalesce(taken, F.lit(False))).drop("segments")


def _all_that_fit(open_: DataFrame) -> DataFrame:
    """repo_id, until (the first item that no longer fits, null if there is none), most (size taken), last (whether the item there is taken), spent."""
    summed = running(open_, "repo_id", [F.col("place")], F.col("size"), "run")
    fits = F.col("run") <= F.col("left")
    return summed.groupBy("repo_id").agg(F.min(F.when(~fits, F.col("place"))).alias("until"), F.max("left").alias("most"), F.lit(False).alias("last"), F.max(F.when(fits, F.col("run"))).alias("spent"))


def _under_a_power(open_: DataFrame) -> DataFrame:
    """The same for items under the largest power of two within the room, up to the first larger one that fits or where the room falls under the power."""
    power = F.when(F.col("left") > 0, F.pow(F.lit(2.0), F.length(F.bin("left")) - 1).cast("long")).otherwise(1)
    marked = open_.withColumn("power", power).withColumn("small", F.col("size") < F.col("power"))
    summed = running(marked, "repo_id", [F.col("place")], F.when(F.col("small"), F.col("size")).otherwise(0), "run")
    ends = F.when(F.col("small"), (F.col("left") > 0) & (F.col("left") - F.col("run") < F.col("power"))).otherwise(F.col("size") + F.col("run") <= F.col("left"))
    until = F.min(F.when(ends, F.struct("place", "small", "size", "run")))
    found = summed.groupBy("repo_id").agg(until.alias("end"), F.max("power").alias("power"), F.max("run").alias("all"))
    spent = F.when(F.col("end").isNull(), F.col("all")).otherwise(F.col("end.run") + F.when(F.col("end.small"), 0).otherwise(F.col("end.size")))
    return found.select("repo_id", F.col("end.place").alias("until"), (F.col("power") - 1).alias("most"), F.lit(True).alias("last"), spent.alias("spent"))


def cap_extraction(items: DataFrame, per_file: int, per_repo: int) -> DataFrame:
    """At most per_file items of each file, shallow ones first, and per_repo of each repository in the order of files. items: repo_id, path, depth, seq. Adds kept.

    Files are charged in the order of their paths: what they keep by the first cap is summed per file before it is summed over files.
    """
    in_file = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy("depth", "seq"))
    ranked = items.withColumn("in_file", in_file)
    counts = ranked.filter(F.col("in_file") <= per_file).groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("repo_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = counts.select("repo_id", "path", F.greatest(F.lit(0), F.lit(per_repo) - before).alias("room"))
    return ranked.join(room, ["repo_id", "path"]).withColumn("kept", (F.col("in_file") <= per_file) & (F.col("in_file") <= F.col("room"))).drop("in_file", "room")


def extraction_drops(capped: DataFrame) -> DataFrame:
    """How many items cap_extraction has dropped of each file that lost any."""
    return capped.groupBy("repo_id", "path").agg(F.count_if(~F.col("kept")).alias("dropped")).filter("dropped > 0")


def interleave(rows: DataFrame, within: list[str], group: str, order: list) -> DataFrame:
    """Adds place: in each `within`, the groups take turns, in their order; inside a group rows stand by `order`."""
    turns = rows.withColumn("_round", F.row_number().over(Window.partitionBy(*within, group).orderBy(*order)))
    return turns.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("_round", group))).drop("_round")


def activity_candidates(files: DataFrame, most: int) -> DataFrame:
    """Parsed source first, then the rest, each by size; the first `most`."""
    group = F.when((F.col("status") == "parsed") & (F.col("category") == "source"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(group, F.desc("size"), "path"))
    return files.withColumn("place", place).filter(F.col("place") <= most)


def order_parse_candidates(files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Place of each candidate: configurations first (repo_id, path), then core code, then auxiliary, then tests; inside these the areas take turns. files: repo_id, path, category, depth."""
    group = F.when(F.col("category") == "test", 3).when((F.col("category") == "source") & ~P.is_auxiliary(F.col("path")), 1).otherwise(2)
    f = files
    if configs is not None:
        f = f.join(configs.select("repo_id", "path", F.lit(True).alias("_config")), ["repo_id", "path"], "left")
        group = F.when(F.col("_config"), 0).otherwise(group)
    f = f.withColumn("group", group).withColumn("area", F.when(F.col("group") == 0, "").otherwise(P.area_of(F.col("path")))).drop("_config")
    f = f.withColumn("round", F.row_number().over(Window.partitionBy("repo_id", "group", "area").orderBy("depth", "path")))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("group", "round", "area")))


# Size and number of configurations, size of texts that are only counted, and by tier the files that are parsed and counted at most.
CONFIG_BYTES, CONFIGS, TEXT_BYTES = 256 * 1024, 300, 64 * 1024
PARSED = {"directory-first": 500}
COUNTED = {"full": 1500, "progressive": 300, "directory-first": 0}


def _numbered(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))


def _taken_up_to(taken: DataFrame, most: Column) -> DataFrame:
    """Adds number, of the taken ones up to each row, and late: whether `most` had been taken before it."""
    before = F.coalesce(F.sum(F.col("taken").cast("int")).over(Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return taken.withColumn("late", before >= most)


def fetch_plan(inventory: DataFrame, selected: DataFrame, tiers: DataFrame, is_config: Column, max_bytes: int, max_parse: int, max_file: int, max_parsed: int) -> DataFrame:
    """repo_id, path, step (config, parse, content or null), place in the step, reason why a graph file is not downloaded.

    Configurations come first, also those that are no graph files; then what is parsed, at most so many files by tier; then what is only counted. All share one
    budget of bytes: a file that does not fit is skipped and the next one tried. A file of two steps has a row for each. tiers: repo_id, tier.
    """
    keep = ["repo_id", "path", "size"]
    configs = inventory.filter(is_config & (F.col("category") != "vendor") & ~F.col("is_binary") & (F.col("size") <= CONFIG_BYTES))
    configs = byte_budget(_numbered(configs.select(*keep, "depth"), "depth", "path"), max_bytes)
    configs = settle(_taken_up_to(configs, F.lit(CONFIGS)).filter("taken AND NOT late").select(*keep, "place"), "plan-configs")
    names = configs.select("repo_id", "path", F.lit(True).alias("config"))
    graph = inventory.join(selected.select("repo_id", "path"), ["repo_id", "path"], "left_semi").join(names, ["repo_id", "path"], "left").join(tiers.select("repo_id", "tier"), "repo_id")
    config = F.coalesce("config", F.lit(False))
    graph = settle(graph.withColumn("class", fetch_class(config, max_parse, max_file, TEXT_BYTES)).withColumn("config", config), "plan-classes")

    spent = lambda df: df.groupBy("repo_id").agg(F.sum("size").alias("spent"))
    room = graph.select("repo_id").distinct().join(spent(configs), "repo_id", "left").select("repo_id", (F.lit(max_bytes) - F.coalesce("spent", F.lit(0))).alias("left"))
    ordered = order_parse_candidates(graph.filter("class = 'parse'"), configs)
    cost = ordered.withColumn("own", F.col("size")).withColumn("size", F.when(F.col("config"), 0).otherwise(F.col("size")))
    most = F.lit(max_parsed)
    for tier, n in PARSED.items():
        most = F.when(F.col("tier") == tier, min(n, max_parsed)).otherwise(most)
    tried = _taken_up_to(byte_budget(cost.select("repo_id", "path", "size", "place", "config", "tier"), room), most)
    parsed = settle(tried.withColumn("state", F.when(F.col("late") & F.col("config"), "free").when(F.col("late"), "parse-limit").when(F.col("taken"), "parse").otherwise("byte-budget")), "plan-parsed")

    free = graph.filter("class = 'free'").select(*keep, "depth").unionByName(parsed.filter("state = 'free'").join(graph.select("repo_id", "path", "depth"), ["repo_id", "path"]).select(*keep, "depth"))
    room = room.join(spent(parsed.filter("state = 'parse'")), "repo_id", "left").select("repo_id", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"))
    late = graph.filter("class IN ('oversized', 'text')")
    rank = F.when(F.col("class") == "oversized", -1).otherwise(P.priority_class(F.col("category"), F.lit(False)))
    most = F.lit(COUNTED["full"])
    for tier, n in COUNTED.items():
        most = F.when(F.col("tier") == tier, n).otherwise(most)
    tried = _taken_up_to(byte_budget(_numbered(late.select(*keep, "depth", "class", "category", "tier"), rank, "depth", "path"), room), most)
    counted = settle(tried.withColumn("state", F.when(F.col("late"), F.when(F.col("class") == "oversized", "size-limit").otherwise("not-selected")).when(F.col("taken"), "content").otherwise("byte-budget")), "plan-counted")

    none, row = F.lit(None).cast("string"), ["repo_id", "path", "step", "place", "reason"]
    content = free.withColumn("at", F.lit(0)).withColumn("turn", F.col("depth")).select("repo_id", "path", "at", "turn").unionByName(counted.filter("state = 'content'").select("repo_id", "path", F.lit(1).alias("at"), F.col("place").alias("turn")))
    steps = configs.select("repo_id", "path", F.lit("config").alias("step"), "place", none.alias("reason")).unionByName(
        _numbered(parsed.filter("state = 'parse'").withColumnRenamed("place", "turn"), "turn").select("repo_id", "path", F.lit("parse").alias("step"), "place", none.alias("reason"))).unionByName(
        _numbered(content, "at", "turn", "path").select("repo_id", "path", F.lit("content").alias("step"), "place", none.alias("reason")))
    skipped = graph.filter("class IN ('binary', 'generated', 'size-limit', 'not-parseable')").select("repo_id", "path", F.col("class").alias("reason")).unionByName(
        parsed.filter("state IN ('parse-limit', 'byte-budget')").select("repo_id", "path", F.col("state").alias("reason"))).unionByName(
        counted.filter("state <> 'content'").select("repo_id", "path", F.col("state").alias("reason")))
    return steps.select(*row).unionByName(skipped.select("repo_id", "path", none.alias("step"), F.lit(None).cast("int").alias("place"), "reason"))


def download_plan(plan: DataFrame) -> DataFrame:
    """repo_id, path, place: every planned download once, configurations first, then what is parsed, then what is counted."""
    step = F.when(F.col("step") == "config", 0).when(F.col("step") == "parse", 1).otherwise(2)
    first = plan.filter("step IS NOT NULL").groupBy("repo_id", "path").agg(F.min(F.struct(step.alias("step"), "place")).alias("at"))
    return _numbered(first, "at").select("repo_id", "path", "place")


# What a fetch and a parse can come to, and the status and reason that a file has then.
FETCHED = {
    "binary": ("binary", None), "too-large": ("metadata-only", "larger than the limit"), "missing": ("failed", "not found"), "failed": ("failed", "could not be downloaded"), "timeout": ("failed", "download timed out"),
    "rate-limited": ("metadata-only", "rate limited"), "byte-budget": ("metadata-only", "download budget reached"), "time-budget": ("metadata-only", "time budget reached"),
}
PARSE_RESULTS = {
    "ok": ("parsed", None), "errors": ("partial", None), "limited": ("partial", "too many symbols"), "no-parser": ("content-only", None), "too-large": ("content-only", None), "time-budget": ("content-only", "time budget reached"),
    "crash": ("failed", "the parser failed"), "timeout": ("failed", "parsing timed out"),
}


def file_status(files: DataFrame, fetched: DataFrame, parsed: DataFrame, skipped: DataFrame) -> DataFrame:
    """repo_id, path, status, reason, lines, lines_estimated of every graph file: what parsing says goes before what fetching says, then the kind of the file, then why it was skipped.

    files: repo_id, path, size, language, is_binary. fetched and parsed: repo_id, path, outcome, parsed also lines. skipped: repo_id, path, reason.
    """

    def by(table: dict, i: int) -> Column:
        out = F.lit(None).cast("string")
        for outcome, values in table.items():
            out = F.when(F.col("outcome") == outcome, F.lit(values[i]).cast("string")).otherwise(out)
        return out

    j = files.join(parsed.select("repo_id", "path", by(PARSE_RESULTS, 0).alias("p_status"), by(PARSE_RESULTS, 1).alias("p_reason"), F.col("lines").alias("exact")), ["repo_id", "path"], "left")
    j = j.join(fetched.select("repo_id", "path", by(FETCHED, 0).alias("f_status"), by(FETCHED, 1).alias("f_reason")), ["repo_id", "path"], "left").join(skipped.select("repo_id", "path", F.col("reason").alias("skip")), ["repo_id", "path"], "left")
    status = F.coalesce("p_status", "f_status", F.when(F.col("is_binary"), "binary"), F.lit("metadata-only"))
    reason = F.when(F.col("p_status").isNotNull(), F.col("p_reason")).when(F.col("f_status").isNotNull(), F.col("f_reason")).when(F.col("is_binary"), "binary").otherwise(F.coalesce("skip", F.lit("not processed")))
    lines = F.when(F.col("status") == "binary", 0).otherwise(F.coalesce("exact", P.estimate_lines(F.col("size"), F.col("language"))))
    j = j.withColumn("status", status).withColumn("reason", reason)
    return j.select("repo_id", "path", "status", "reason", lines.cast("long").alias("lines"), ((F.col("status") != "binary") & F.col("exact").isNull()).alias("lines_estimated"))
