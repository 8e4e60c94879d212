"""Fuzzy search as a batch job: many queries against the entries of all repositories."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X
from ..functions.names import let
from ..shared import settle

# Fixed values of the score.
MATCH, GAP, FURTHER, CASE, CONSECUTIVE, FIRST = 16, -3, -1, 1, 5, 2
START, SEPARATOR, DELIMITER, CAMEL = 10, 9, 8, 7
DELIMITERS = " #$(,-.:<@_"
LONGEST = 256
PRIORS = {"class": 4, "interface": 4, "struct": 4, "trait": 4, "enum": 3, "type": 3, "function": 3, "module": 2, "method": 2, "constant": 1, "variable": 0}
LOW = -(10**9)
#: Queries that are broadcast at most; more of them meet the index in a shuffled join.
FEW_QUERIES = 20_000
#: Least scores that are broadcast at most, one for each query and repository.
FEW_LEAST = 200_000


def search_entries(directories: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, kind, id, title, name, stem, path, prior of directories (without the root), files and symbols."""
    path, name = F.col("path"), P.base_name(F.col("path"))
    d = directories.filter("path <> ''").select("repo_id", F.lit("directory").alias("kind"), P.directory_id(path).alias("id"), F.concat(name, F.lit("/")).alias("title"), name.alias("name"), F.lit("").alias("stem"), path.alias("path"), F.lit(6).alias("prior"))
    less = F.when(F.col("is_generated"), 20).otherwise(0) + F.when(F.col("category") == "vendor", 10).otherwise(0)
    f = files.select("repo_id", F.lit("file").alias("kind"), P.file_id(path).alias("id"), name.alias("title"), name.alias("name"), F.lower(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).alias("stem"), path.alias("path"), (5 - less).alias("prior"))
    s = symbols.join(files.select("repo_id", "path", "is_generated"), ["repo_id", "path"])
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv]), F.col("kind")), F.lit(0)) + F.col("exported").cast("int") - F.when(F.col("is_generated"), 20).otherwise(0)
    s = s.select("repo_id", F.lit("symbol").alias("kind"), P.symbol_id(path, F.col("name"), F.col("start_line")).alias("id"), X.symbol_title(F.col("name"), F.col("kind")).alias("title"), F.col("name"), F.lit("").alias("stem"), F.lit("").alias("path"), prior.alias("prior"))
    length = F.when(F.length("path") > 0, F.length("path")).otherwise(F.length("name"))
    return d.unionByName(f).unionByName(s).withColumn("bias", F.col("prior") - length * 0.01)


def character_mask(lower: Column) -> Column:
    """Which characters a lower-case text holds: a bit for each letter, five for digits by their remainder, one for a slash. A query whose bits a target lacks is not in it."""
    groups = [*"abcdefghijklmnopqrstuvwxyz", "05", "16", "27", "38", "49", "/"]
    bits = [F.when(reduce(Column.__or__, [lower.contains(c) for c in chars]), 1 << i).otherwise(0) for i, chars in enumerate(groups)]
    return reduce(Column.bitwiseOR, bits).cast("long")


def is_subsequence(query: str, target: str) -> bool:
    """Whether the query's characters occur in the target in order."""
    rest = iter(target)
    return all(c in rest for c in query)


def position_bonuses(target: str) -> np.ndarray:
    """What a match at each place is worth for standing at a boundary."""
    t = np.array([ord(c) for c in target])
    before = np.concatenate([[0], t[:-1]])
    digit, was_digit = (t >= 48) & (t <= 57), (before >= 48) & (before <= 57)
    bonus = np.where((t >= 65) & (t <= 90) & (before >= 97) & (before <= 122) | digit & ~was_digit, CAMEL, 0)
    bonus = np.where(np.isin(before, [ord(c) for c in DELIMITERS]), DELIMITER, bonus)
    bonus = np.where((before == 47) | (before == 92), SEPARATOR, bonus)
    bonus[0] = START
    return bonus


def best_alignment(query: str, original: str, target: str) -> float:
    """The best score of the query's characters in order in the target's last LONGEST characters; -inf without a match.

    Row i holds, for each place, the best score with character i matched there. It comes from the place before (a run keeps its best
    boundary bonus) or, over a gap, from the running maximum of the row before.
    """
    target = target[-LONGEST:]
    t, low = np.array([ord(c) for c in target]), np.array([ord(c) for c in target.lower()[: len(target)]])
    if not len(query) or len(t) != len(low):
        return 0.0 if not len(query) else -np.inf
    bonus = position_bonuses(target)
    at = np.arange(len(t))
    score = run = None
    for i, c in enumerate(query):
        hit, own = low == ord(c), (t == ord(original[i])) * CASE
        if i == 0:
            new, kept = MATCH + bonus * FIRST + own, bonus
        else:
            near, near_run = np.concatenate([[LOW], score[:-1]]), np.concatenate([[0], run[:-1]])
            far = np.concatenate([[LOW, LOW], np.maximum.accumulate(score + at * -FURTHER)[:-2]])[: len(t)] + GAP + (at - 2) * FURTHER
            best_run = np.maximum(near_run, bonus)
            joined, apart = near + MATCH + np.maximum(best_run, CONSECUTIVE), far + MATCH + bonus
            new, kept = np.maximum(joined, apart) + own, np.where(joined >= apart, best_run, bonus)
        score, run = np.where(hit & (at >= i), new, LOW), np.where(hit, kept, 0)
        score = np.where(score > LOW / 2, score, LOW)
    best = score.max()
    return float(best) if best > LOW / 2 else -np.inf


def best_alignments(query: str, original: str, targets: list[str]) -> np.ndarray:
    """best_alignment of one query with many targets: the same rows of the table, for all targets at once."""
    out = np.full(len(targets), -np.inf)
    cut = [t[-LONGEST:] for t in targets]
    lows = [t.lower() for t in cut]
    use = [i for i, (t, low) in enumerate(zip(cut, lows)) if len(t) == len(low) and is_subsequence(query, low)]
    if not use or not query:
        out[use] = 0.0
        return out
    size = max(len(cut[i]) for i in use)
    codes = lambda texts: np.array(texts, f"<U{size}").view(np.uint32).reshape(len(texts), size).astype(np.int64)
    t, low = codes([cut[i] for i in use]), codes([lows[i] for i in use])
    before = np.hstack([np.zeros((len(t), 1), np.int64), t[:, :-1]])
    digit, was_digit = (t >= 48) & (t <= 57), (before >= 48) & (before <= 57)
    bonus = np.where((t >= 65) & (t <= 90) & (before >= 97) & (before <= 122) | digit & ~was_digit, CAMEL, 0)
    bonus = np.where(np.isin(before, [ord(c) for c in DELIMITERS]), DELIMITER, bonus)
    bonus = np.where((before == 47) | (before == 92), SEPARATOR, bonus)
    bonus[:, 0] = START
    at, edge = np.arange(size), np.full((len(t), 2), LOW)
    score = run = None
    for i, c in enumerate(query):
        hit, own = low == ord(c), (t == ord(original[i])) * CASE
        if i == 0:
            new, kept = MATCH + bonus * FIRST + own, bonus
        else:
            near, near_run = np.hstack([edge[:, :1], score[:, :-1]]), np.hstack([edge[:, :1] * 0, run[:, :-1]])
            far = np.hstack([edge, np.maximum.accumulate(score - at * FURTHER, axis=1)[:, :-2]])[:, :size] + GAP + (at - 2) * FURTHER
            best_run = np.maximum(near_run, bonus)
            joined, apart = near + MATCH + np.maximum(best_run, CONSECUTIVE), far + MATCH + bonus
            new, kept = np.maximum(joined, apart) + own, np.where(joined >= apart, best_run, bonus)
        score, run = np.where(hit & (at >= i), new, LOW), np.where(hit, kept, 0)
        score = np.where(score > LOW / 2, score, LOW)
    best = score.max(axis=1)
    out[use] = np.where(best > LOW / 2, best, -np.inf)
    return out


@F.pandas_udf(T.DoubleType())
def fuzzy_score(query: pd.Series, original: pd.Series, target: pd.Series) -> pd.Series:
    """The rows of one query are scored together, each different target once."""
    out = np.full(len(query), -np.inf)
    rows = pd.DataFrame({"q": query.to_numpy(), "o": original.to_numpy(), "t": target.to_numpy()})
    for (q, o), at in rows.groupby(["q", "o"], sort=False).indices.items():
        names, of = np.unique(rows["t"].to_numpy()[at].astype(str), return_inverse=True)
        out[at] = best_alignments(q, o, names.tolist())[of]
    return pd.Series(out)


def alignment(query: str, original: str, target: str) -> list[int]:
    """The places in the target of the query's characters in their best alignment; none without a match. Of equal ones that with the earliest end."""
    cut = max(0, len(target) - LONGEST)
    t = target[cut:]
    if not query or not is_subsequence(query, t.lower()):
        return []
    bonus = position_bonuses(t).tolist()
    rows: list[dict[int, tuple[int, int, int]]] = []  # for each character: place -> score, bonus of its run, place of the character before
    for i, c in enumerate(query):
        row: dict[int, tuple[int, int, int]] = {}
        for k in (k for k in range(i, len(t)) if t[k].lower() == c):
            own = (t[k] == original[i]) * CASE
            if i == 0:
                row[k] = (MATCH + bonus[k] * FIRST + own, bonus[k], -1)
                continue
            apart = max(((s + GAP + (k - 2 - j) * FURTHER, j) for j, (s, _, _) in rows[-1].items() if j <= k - 2), default=None)
            near = rows[-1].get(k - 1)
            if near:
                run = max(near[1], bonus[k])
                joined = near[0] + MATCH + max(run, CONSECUTIVE)
                if apart is None or joined >= apart[0] + MATCH + bonus[k]:
                    row[k] = (joined + own, run, k - 1)
                    continue
            if apart:
                row[k] = (apart[0] + MATCH + bonus[k] + own, bonus[k], apart[1])
        rows.append(row)
    at = min(rows[-1], key=lambda k: (-rows[-1][k][0], k))
    places = []
    for row in reversed(rows):
        places.append(at + cut)
        at = row[at][2]
    return places[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def match_positions(query: pd.Series, original: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([alignment(q, o, t) for q, o, t in zip(query, original, target)])


def rank_tier(by_name: Column) -> Column:
    """Exact name, stem, prefix (or path suffix at a boundary), other name, other path."""
    q, name, path = F.col("query"), F.lower("name"), F.lower("path")
    suffix = path.endswith(q) & ((F.length(path) == F.length(q)) | q.startswith("/") | F.substring(path, F.length(path) - F.length(q), F.lit(1)).eqNullSafe("/"))
    return F.when(by_name, F.when(name == q, 40_000).when(F.col("stem") == q, 35_000).when(name.startswith(q), 30_000).otherwise(20_000)).otherwise(F.when(suffix, 30_000).otherwise(0))


def pairs_in_order(text: Column) -> Column:
    """The index keys of a text: its characters, and each two of them of which the first stands before the other, once each."""
    chars = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.struct(c.alias("c"), F.instr(text, c).alias("first"), F.instr(F.reverse(text), c).alias("from_end")))
    two = lambda some: F.flatten(F.transform(some, lambda x: F.transform(F.filter(some, lambda y: x["first"] + y["from_end"] <= F.length(text)), lambda y: F.concat(x["c"], y["c"]))))
    return let(F.filter(chars, lambda x: x["c"] != ""), lambda some: F.concat(F.transform(some, lambda x: x["c"]), two(some)))


def query_keys(query: Column) -> Column:
    """The keys that a text must have to hold the query: its neighbouring characters, or its only one."""
    size = F.length(query)
    return F.when(size == 1, F.array(query)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - 1)), lambda i: F.substring(query, i, F.lit(2))))


def _in_order(query: Column) -> Column:
    """A pattern for LIKE: the query's characters in order, whatever stands between."""
    return F.concat(F.lit("%"), F.array_join(F.transform(F.split(query, ""), lambda c: F.when(c.isin("%", "_", "\\"), F.concat(F.lit("\\"), c)).otherwise(c)), "%"), F.lit("%"))


def matches(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """queries (query_id, query, ...), texts (text: each once) -> the queries' columns and text, of each query with each text that holds its characters in order.

    An index with the texts' ordered pairs of characters as its keys: a query looks under the one of its keys that fewest texts have. Only the keys that queries ask for leave
    a task, counted; then the texts meet the queries under these, in a hash join, and what they find is checked in whole.
    """
    low = F.lower("text")
    # texts are short and their pairs many: their bytes say nothing of the work, so tasks are not joined by them
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text"))
    asked = queries.select("query_id", F.explode(query_keys(F.col("query"))).alias("key"))
    few = queries.count() <= FEW_QUERIES
    side = F.broadcast if few else (lambda df: df)
    posted = texts.select(F.explode(pairs_in_order(low)).alias("key")).join(side(asked.select("key").distinct()), "key", "left_semi")
    counts = settle(posted.groupBy("key").agg(F.count("*").alias("n")), "search-counts")
    best = asked.join(counts, "key", "left").groupBy("query_id").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    best = settle(queries.join(best.filter("n > 0").drop("n"), "query_id").withColumn("pattern", _in_order(F.col("query"))), "search-keys")
    found = texts.select("text", F.explode(pairs_in_order(low)).alias("key")).join(side(best), "key")
    holds = F.col("asked").bitwiseAND(F.bitwise_not(character_mask(low))) == 0
    return found.filter(holds).filter(F.like(low, F.col("pattern"))).drop("key", "pattern")


def prepared(queries: DataFrame) -> DataFrame:
    """query_id, query, original, asked (mask), is_path of the queries that ask for something."""
    q = queries.select("query_id", X.prepare_query(F.col("query")).alias("query"), X.original_query(F.col("query")).alias("original")).filter("query <> ''")
    return settle(q.withColumn("asked", character_mask(F.col("query"))).withColumn("is_path", F.col("query").contains("/")), "search-queries")


def asked_once(q: DataFrame) -> DataFrame:
    """Of prepared queries that ask the same the one with the smallest query_id."""
    return q.groupBy("query", "original", "asked", "is_path").agg(F.min("query_id").alias("query_id"))


def for_all(q: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers to the queries asked once, for each of the prepared queries."""
    same = asked_once(q).select("query", "original", F.col("query_id").alias("_once"))
    same = q.select("query_id", "query", "original").join(same, ["query", "original"]).select(F.col("query_id").alias("_each"), F.col("_once").alias("query_id"))
    rest = [c for c in answers.columns if c != "query_id"]
    return answers.join(same, "query_id").select(F.col("_each").alias("query_id"), *rest)


def candidate_texts(once: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, paths): query_id, query, original, is_path, text, for each different name (of queries without a slash) and path that holds the query in order."""
    named = matches(once.filter("NOT is_path"), entries.select(F.col("name").alias("text")).distinct())
    pathed = matches(once, entries.filter("path <> ''").select(F.col("path").alias("text")).distinct())
    return tuple(settle(found.select("query_id", "query", "original", "is_path", "text"), label) for found, label in ((named, "search-names"), (pathed, "search-paths")))


def having(entries: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """The entries of the texts found. Texts pack so well that Spark would take millions of them for a table to broadcast; they are merged, and only what is left of the pairs in a task should leave it."""
    return entries.filter(F.col(column) != "").join(found.hint("merge"), F.col(column) == F.col("text"))


def _name_holds() -> Column:
    return ~F.col("is_path") & F.like(F.lower("name"), _in_order(F.col("query")))


def candidate_counts(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, repo_id, names, paths, last: how many entries hold the query in order in their name (of queries without a slash) and path, and the largest id of these.

    The entries of a text are counted before they meet the queries, and pairs are counted where they come about.
    """
    q, entries = prepared(queries), settle(entries.select("repo_id", "id", "name", "path"), "search-entries")
    parts = []
    for found, column, is_name in zip(candidate_texts(asked_once(q), entries), ("name", "path"), (1, 0)):
        texts = entries.groupBy("repo_id", column).agg(F.count("*").alias("n"), F.max("id").alias("last"))
        parts.append(having(texts, found, column).select("query_id", "repo_id", (F.col("n") * is_name).alias("names"), (F.col("n") * (1 - is_name)).alias("paths"), "last"))
    both = parts[0].unionByName(parts[1]).groupBy("query_id", "repo_id")
    return for_all(q, both.agg(F.sum("names").alias("names"), F.sum("paths").alias("paths"), F.max("last").alias("last")))


def tier_counts(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, tier, entries: how many candidates of each query are in each tier; an entry whose name holds the query counts by its name alone."""
    q, entries = prepared(queries), settle(entries.select("name", "stem", "path"), "search-entries")
    named, pathed = candidate_texts(asked_once(q), entries)
    names = having(entries.groupBy("name", "stem").agg(F.count("*").alias("n")).withColumn("path", F.lit("")), named, "name").select("query_id", rank_tier(F.lit(True)).alias("tier"), "n")
    paths = having(entries.groupBy("name", "stem", "path").agg(F.count("*").alias("n")), pathed, "path").filter(~F.coalesce(_name_holds(), F.lit(False))).select("query_id", rank_tier(F.lit(False)).alias("tier"), "n")
    return for_all(q, names.unionByName(paths).groupBy("query_id", "tier").agg(F.sum("n").alias("entries")))


def scored_pairs(once: DataFrame, entries: DataFrame) -> DataFrame:
    """The candidates of queries asked once with by_name and score; the path counts only where the name does not match. Each query and text is aligned once, however many entries have the text."""
    none = F.lit(float("-inf"))

    def aligned(found: DataFrame, label: str) -> DataFrame:
        return settle(found.sortWithinPartitions("query_id").withColumn("dp", fuzzy_score("query", "original", "text")).filter(F.col("dp") > none), label)

    named, pathed = candidate_texts(once, entries)
    names = having(entries, aligned(named, "search-name-scores"), "name").withColumn("by_name", F.lit(True))
    paths = having(entries, aligned(pathed, "search-path-scores"), "path")
    # a name that holds the query and cannot be aligned leaves it to the path
    paths = paths.filter(fuzzy_score("query", "original", F.when(_name_holds(), F.col("name")).otherwise("")) == none).withColumn("by_name", F.lit(False))
    return names.unionByName(paths).drop("text").withColumn("score", rank_tier(F.col("by_name")) + F.col("dp") + F.col("bias"))


def search_top_k(queries: DataFrame, entries: DataFrame, k: int = 50, kinds: tuple[str, ...] = (), suggested: DataFrame | None = None) -> DataFrame:
    """query_id, repo_id, kind, id, title, score, place, positions (in the title, of the characters that matched): the k best entries of each query in each repository.

    kinds: only these. An empty query gets the repository's suggestions (repo_id, kind, id, title, place), if given, without score.
    The path is looked at only where the name does not match. The candidates of each hundredth of a score are counted first; those below the hundredth that
    the k-th falls into are left where they come about, and the rest are ranked.
    """
    if kinds:
        entries = entries.filter(F.col("kind").isin(*kinds))
    q = prepared(queries)
    scored = scored_pairs(asked_once(q), settle(entries, "search-entries")).withColumn("step", F.floor(F.col("score") * 100))
    steps = scored.groupBy("query_id", "repo_id", "step").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query_id", "repo_id").orderBy(F.desc("step"))) - F.col("n")
    least = settle(steps.withColumn("before", before).filter(F.col("before") < k).groupBy("query_id", "repo_id").agg(F.min("step").alias("least")), "search-least")
    least = F.broadcast(least) if least.count() <= FEW_LEAST else least.hint("merge")
    place = F.row_number().over(Window.partitionBy("query_id", "repo_id").orderBy(F.desc("score"), "title", "id"))
    top = scored.join(least, ["query_id", "repo_id"]).filter("step >= least").withColumn("place", place).filter(F.col("place") <= k)
    at = match_positions("query", "original", F.when(F.col("by_name"), F.col("name")).otherwise(F.col("path")))
    offset = F.when(F.col("by_name"), 0).otherwise(F.length("path") - F.length("name"))
    found = top.withColumn("found", at).withColumn("offset", offset)
    found = found.withColumn("positions", F.transform(F.filter("found", lambda p: p >= F.col("offset")), lambda p: p - F.col("offset")))
    out = for_all(q, found.select("query_id", "repo_id", "kind", "id", "title", "score", "place", "positions"))
    if suggested is None:
        return out
    empty = queries.filter(F.coalesce(X.prepare_query(F.col("query")), F.lit("")) == "").select("query_id")
    own = suggested.filter(F.col("kind").isin(*kinds)) if kinds else suggested
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("kind"), "place"))).filter(F.col("place") <= k)
    # every suggestion answers every empty query: both sides are few, the suggestions of a repository at most k
    return out.unionByName(own.withColumn("_all", F.lit(1)).join(empty.withColumn("_all", F.lit(1)), "_all").select("query_id", "repo_id", "kind", "id", "title", F.lit(None).cast("double").alias("score"), "place", F.array().cast("array<int>").alias("positions")))
