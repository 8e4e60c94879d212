"""The dependency graph: edges, packages, rankings, neighbourhoods, import cycles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..shared import settle


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """resolved statements (repo_id, source, seq, kind, target) -> one edge per (source, target, kind) with the number of statements; no self-edges."""
    once = resolved.filter(F.col("target").isNotNull() & (F.col("source") != F.col("target"))).select("repo_id", "source", "seq", "kind", "target").distinct()
    edges = once.groupBy("repo_id", "source", "target", "kind").agg(F.count("*").alias("weight"))
    return edges.withColumn("edge_id", F.concat_ws("", "kind", F.lit(":"), "source", F.lit("->"), "target"))


def valid_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges between two of files (repo_id, path; without repo_id the paths hold for all repositories)."""
    own = [c for c in files.columns if c == "repo_id"]
    ends = files.select(*own, P.file_id(F.col("path")).alias("id"))
    for end in ("source", "target"):
        edges = edges.join(ends.withColumnRenamed("id", end), [*own, end], "left_semi")
    return edges.filter("source <> target")


def edges_of_kind(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.filter(F.col("kind").isin(*kinds) & (F.col("source") != F.col("target")))


def rank_connectivity(edges: DataFrame, most: int = 10) -> DataFrame:
    """Distinct importers and imports of each file, their sum, and the weight of its edges; the first `most` of each repository."""
    own = edges.filter("source <> target")
    ends = own.select("repo_id", F.col("source").alias("file"), F.col("target").alias("imports"), F.lit(None).cast("string").alias("by"), "weight").unionByName(
        own.select("repo_id", F.col("target").alias("file"), F.lit(None).cast("string").alias("imports"), F.col("source").alias("by"), "weight"))
    n = ends.groupBy("repo_id", "file").agg(F.count_distinct("by").alias("imported_by"), F.count_distinct("imports").alias("imports"), F.sum("weight").alias("weight"))
    n = n.withColumn("degree", F.col("imported_by") + F.col("imports"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("degree"), F.desc("imported_by"), F.desc("weight"), "file"))
    return n.withColumn("place", place).filter(F.col("place") <= most)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("repo_id", F.col("source").alias("file")).unionByName(edges.select("repo_id", F.col("target").alias("file")))
    return ends.groupBy("repo_id", "file").agg(F.count("*").alias("degree"))


def external_packages(externals: DataFrame) -> DataFrame:
    """externals (repo_id, path, package, language) -> imports, distinct files and the most frequent language (ties by name) of each package."""
    by = externals.groupBy("repo_id", "package", "language").agg(F.count("*").alias("n"))
    top = by.groupBy("repo_id", "package").agg(F.sum("n").alias("import_count"), F.min_by("language", F.struct((-F.col("n")).alias("n"), "language")).alias("language"))
    files = externals.groupBy("repo_id", "package").agg(F.count_distinct("path").alias("file_count"))
    return top.join(files, ["repo_id", "package"])


def top_external_packages(packages: DataFrame, most: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("import_count"), F.desc("file_count"), "package"))
    return packages.withColumn("place", place).filter(F.col("place") <= most)


def import_stats(imports: DataFrame, *by: str) -> DataFrame:
    """found = resolved + external + unresolved statements by the given columns. imports: state in resolved, external, unresolved."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return imports.groupBy(*by).agg(F.count("*").alias("found"), of("resolved"), of("external"), of("unresolved"))


def related_files(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Neighbours of the selected files outside the selection: repo_id, file, outgoing, incoming. selection: repo_id, file."""
    picked = F.lit(True).alias("x")
    out = edges.join(selection.select("repo_id", F.col("file").alias("source")), ["repo_id", "source"], "left_semi").select("repo_id", F.col("target").alias("file"), picked.alias("outgoing"), F.lit(False).alias("incoming"))
    into = edges.join(selection.select("repo_id", F.col("file").alias("target")), ["repo_id", "target"], "left_semi").select("repo_id", F.col("source").alias("file"), F.lit(False).alias("outgoing"), picked.alias("incoming"))
    both = out.unionByName(into).groupBy("repo_id", "file").agg(F.bool_or("outgoing").alias("outgoing"), F.bool_or("incoming").alias("incoming"))
    return both.join(selection.select("repo_id", "file"), ["repo_id", "file"], "left_anti")


def budget_edges(edges: DataFrame, most: int = 1500, selection: DataFrame | None = None, focus: DataFrame | None = None, drawable: DataFrame | None = None, most_selected: int = 4000, most_focused: int = 5000) -> DataFrame:
    """The heaviest edges of each repository, ties by id, with their role; self-edges and those of files that are not drawable go.

    selection (repo_id, file): its edges, outgoing, incoming or internal. Else focus (repo_id, file): the edges inside it. Else the top of all. Files without repo_id hold for all repositories.
    """
    own = edges.filter("source <> target")
    for end in ("source", "target") if drawable is not None else ():
        own = own.join(drawable.select("repo_id", F.col("file").alias(end)), ["repo_id", end], "left_semi")
    marked = selection if selection is not None else focus
    role = F.lit("top")
    if marked is not None:
        by = [c for c in marked.columns if c == "repo_id"]
        marked = marked.select(*by, "file").distinct()
        for end in ("source", "target"):
            own = own.join(marked.select(*by, F.col("file").alias(end), F.lit(True).alias(f"has_{end}")), [*by, end], "left")
        both, any_ = F.col("has_source").isNotNull() & F.col("has_target").isNotNull(), F.col("has_source").isNotNull() | F.col("has_target").isNotNull()
        own = own.filter(any_ if selection is not None else both)
        role = F.when(both, "internal").when(F.col("has_source").isNotNull(), "outgoing").otherwise("incoming") if selection is not None else F.lit("focus")
        most = most_selected if selection is not None else most_focused
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("weight"), "edge_id"))
    return own.withColumn("role", role).withColumn("place", place).filter(F.col("place") <= most).drop("has_source", "has_target")


def distinct_imports(imports: DataFrame) -> DataFrame:
    """imports (repo_id, path, seq, specifier, external, target: a graph file or null) -> one row for each target or specifier of a file: label, state, place; internal ones first, then external, then unresolved."""
    state = F.when(F.col("target").isNotNull(), "internal").when(F.col("external"), "external").otherwise("unresolved")
    rows = imports.select("repo_id", "path", F.coalesce("target", "specifier").alias("label"), state.alias("state")).distinct()
    order = F.when(F.col("state") == "internal", 0).when(F.col("state") == "external", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(order, "label")))


def intra_directory_adjacency(edges: DataFrame) -> DataFrame:
    """Undirected weighted neighbours within one directory. edges: repo_id, source_path, target_path, weight."""
    same = edges.filter((P.parent_path(F.col("source_path")) == P.parent_path(F.col("target_path"))) & (F.col("source_path") != F.col("target_path")))
    both = same.select("repo_id", F.col("source_path").alias("a"), F.col("target_path").alias("b"), "weight").unionByName(same.select("repo_id", F.col("target_path").alias("a"), F.col("source_path").alias("b"), "weight"))
    return both.groupBy("repo_id", "a", "b").agg(F.greatest(F.lit(1), F.sum("weight")).alias("weight"))


#: Fewer nodes of one way in and one way out than this are not contracted.
FEW = 64


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges at nodes that have none in or none out: those lie on no cycle."""
    edges = edges.join(edges.select("repo_id", F.col("target").alias("source")).distinct(), ["repo_id", "source"], "left_semi")
    return settle(edges.join(edges.select("repo_id", F.col("source").alias("target")).distinct(), ["repo_id", "target"], "left_semi"), "cycle-trim")


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, int]:
    """Takes some of the nodes with one way in and one way out off their chains, no two that are neighbours: (edges, what was taken, such nodes before).

    Taken: repo_id, node, p and s, its neighbours on both sides. A coin for each node and turn picks about a quarter, so chains of any length
    are gone after a number of turns that grows with the logarithm of the length.
    """
    out = edges.groupBy("repo_id", F.col("source").alias("node")).agg(F.count("*").alias("outs"), F.max("target").alias("s"))
    into = edges.groupBy("repo_id", F.col("target").alias("node")).agg(F.count("*").alias("ins"), F.max("source").alias("p"))
    chain = settle(out.join(into, ["repo_id", "node"]).filter("outs = 1 AND ins = 1").select("repo_id", "node", "p", "s"), "cycle-chains")
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), "repo_id", c), F.lit(2))
    taken = settle(chain.filter((coin("node") == 1) & (coin("p") == 0)), "cycle-taken")
    for end in ("source", "target"):
        edges = edges.join(taken.select("repo_id", F.col("node").alias(end)), ["repo_id", end], "left_anti")
    edges = edges.select("repo_id", "source", "target").unionByName(taken.filter("p <> s").select("repo_id", F.col("p").alias("source"), F.col("s").alias("target")))
    return settle(edges.distinct(), "cycle-edges"), taken, chain.count()


def _shrink(edges: DataFrame, turn: int) -> tuple[DataFrame, list[DataFrame], int]:
    """Trims and contracts by turns until neither does much."""
    gone: list[DataFrame] = []
    n = edges.count()
    while n:
        edges = _trim(edges)
        trimmed = edges.count()
        edges, taken, chains = _contract(edges, turn)
        gone.append(taken)
        turn += 1
        if trimmed == n and chains < FEW:
            break
        n = edges.count()
    return edges, gone, turn


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The largest label that reaches each node along the edges. labels: repo_id, node, label."""
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "source"), ["repo_id", "source"]).select("repo_id", F.col("target").alias("node"), "label")
        new = settle(labels.unionByName(sent.select(*labels.columns)).groupBy("repo_id", "node").agg(F.max("label").alias("label")), "cycle-labels")
        if new.join(labels.withColumnRenamed("label", "old"), ["repo_id", "node"]).filter("label <> old").isEmpty():
            return new
        labels = new


#: Edges of a repository that one task works on at most.
SMALL = 100_000


def components_of(sources: list, targets: list) -> dict:
    """node -> the largest node of its strong component, for components of two nodes or more: a depth-first walk with a stack of its own."""
    after: dict = {}
    for a, b in zip(sources, targets):
        after.setdefault(a, []).append(b)
    number: dict = {}
    low: dict = {}
    open_: list = []
    held: set = set()
    out: dict = {}
    for start in after:
        if start in number:
            continue
        walk = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        open_.append(start), held.add(start)
        while walk:
            node, rest = walk[-1]
            for n in rest:
                if n not in number:
                    number[n] = low[n] = len(number)
                    open_.append(n), held.add(n)
                    walk.append((n, iter(after.get(n, ()))))
                    break
                if n in held:
                    low[node] = min(low[node], number[n])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(open_.pop())
                    held.difference_update(part)
                    if len(part) > 1:
                        out |= dict.fromkeys(part, max(part))
    return out


def _in_tasks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, node, component of the repositories with at most SMALL edges, each found by one task; the edges of the others, of which there are few)."""
    big = settle(edges.groupBy("repo_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("repo_id"), "cycle-large")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def solve(rows: pa.Table) -> pa.Table:
        found = components_of(rows["source"].to_pylist(), rows["target"].to_pylist())
        kind = rows["source"].type
        return pa.table([rows["repo_id"].take(pa.array([0] * len(found), pa.int64())), pa.array(list(found), kind), pa.array(list(found.values()), kind)], ["repo_id", "node", "component"])

    small = edges.join(F.broadcast(big), "repo_id", "left_anti").groupBy("repo_id")
    found = settle(small.applyInArrow(solve, f"repo_id {kinds['repo_id']}, node {kinds['source']}, component {kinds['source']}"), "cycle-small")
    return found, edges.join(F.broadcast(big), "repo_id", "left_semi")


def strong_components(edges: DataFrame) -> DataFrame:
    """repo_id, node, component (its largest node) for nodes on a cycle. A repository with at most SMALL edges is the work of one task.

    Of larger ones, chains are contracted, which may make them small; the rest is found by trimming and forward-backward colouring. Forward, the largest id that reaches a node is its colour; backward, the nodes of a colour that reach the node it is named after
    are its component. Components leave the graph, and what is left goes round again. Then the nodes of the chains come back, last taken first: one whose
    neighbours are of one component, or are one node, belongs to it. Each step is written to the shared folder.
    """
    all_edges = settle(edges.select("repo_id", "source", "target").filter("source <> target").distinct(), "cycle-edges")
    found, large = _in_tasks(all_edges)
    if large.isEmpty():
        return found
    left, gone, turn = _shrink(settle(large, "cycle-edges"), 0)
    while not left.isEmpty():
        part, left = _in_tasks(left)
        found = found.unionByName(part)
        if left.isEmpty():
            break
        left = settle(left, "cycle-left")
        nodes = left.select("repo_id", F.col("source").alias("node")).unionByName(left.select("repo_id", F.col("target").alias("node"))).distinct()
        colours = _spread(left, nodes.withColumn("label", F.col("node")))
        c = lambda end: colours.select("repo_id", F.col("node").alias(end), F.col("label").alias(f"c_{end}"))
        inside = left.join(c("source"), ["repo_id", "source"]).join(c("target"), ["repo_id", "target"]).filter("c_source = c_target")
        back = inside.select("repo_id", F.col("target").alias("source"), F.col("source").alias("target"))
        roots = colours.select("repo_id", "node", F.when(F.col("node") == F.col("label"), 1).otherwise(0).alias("label"))
        reached = _spread(settle(back, "cycle-back"), roots).filter("label = 1").select("repo_id", "node")
        part = settle(colours.join(reached, ["repo_id", "node"]).select("repo_id", "node", F.col("label").alias("component")), "cycle-found")
        found = found.unionByName(part)
        for end in ("source", "target"):
            left = left.join(part.select("repo_id", F.col("node").alias(end)), ["repo_id", end], "left_anti")
        left, more, turn = _shrink(settle(left, "cycle-left"), turn)
        gone += more
    found = settle(found, "cycle-components")
    for taken in reversed(gone):
        if taken.isEmpty():
            continue
        of = lambda end: found.select("repo_id", F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        ends = taken.join(of("p"), ["repo_id", "p"], "left").join(of("s"), ["repo_id", "s"], "left")
        joined = ends.filter("p = s OR c_p = c_s").withColumn("component", F.coalesce("c_p", "p"))
        back = joined.select("repo_id", "node", "component").unionByName(joined.filter("c_p IS NULL").select("repo_id", F.col("p").alias("node"), "component"))
        found = settle(found.unionByName(back).distinct(), "cycle-components")
    largest = found.groupBy("repo_id", "component").agg(F.max("node").alias("largest"))
    return found.join(largest, ["repo_id", "component"]).select("repo_id", "node", F.col("largest").alias("component"))


def import_cycles(edges: DataFrame, most: int = 50) -> DataFrame:
    """Cycles of more than one file: members and inner edges of each component; the largest first, then by the smallest member."""
    members = strong_components(edges)
    sized = members.groupBy("repo_id", "component").agg(F.count("*").alias("size"), F.min("node").alias("first")).filter("size > 1")
    m = lambda end: members.select("repo_id", F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    inner = edges.filter("source <> target").join(m("source"), ["repo_id", "source"]).join(m("target"), ["repo_id", "target"]).filter("c_source = c_target")
    inner = inner.groupBy("repo_id", F.col("c_source").alias("component")).agg(F.count("*").alias("edges"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("size"), "first"))
    return sized.join(inner, ["repo_id", "component"]).withColumn("place", place).filter(F.col("place") <= most)


def suggestions(files: DataFrame, directories: DataFrame, most_files: int = 8, most_directories: int = 5) -> DataFrame:
    """The best files by degree, lines and path, and the largest directories of depth one or two, of each repository."""
    f = files.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("degree"), F.desc("lines"), "path"))).filter(F.col("place") <= most_files)
    d = directories.filter("depth BETWEEN 1 AND 2").withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("file_count"), "path"))).filter(F.col("place") <= most_directories)
    return f.select("repo_id", F.lit("file").alias("kind"), "path", "place").unionByName(d.select("repo_id", F.lit("directory").alias("kind"), "path", "place"))


def relation_roles(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """in, out or mutual of each neighbour of the selection."""
    role = F.when(F.col("outgoing") & F.col("incoming"), "mutual").when(F.col("outgoing"), "out").otherwise("in")
    return related_files(edges, selection).select("repo_id", "file", role.alias("role"))


def selection_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (repo_id, kind, path): a file is itself, a symbol its file, a directory all files below. repo_id, path, each once."""
    single = refs.filter("kind <> 'directory'").select("repo_id", "path").join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    up = files.select("repo_id", "path", F.explode(P.ancestors(F.col("path"))).alias("directory"))
    below = up.join(refs.filter("kind = 'directory'").select("repo_id", F.col("path").alias("directory")), ["repo_id", "directory"], "left_semi").select("repo_id", "path")
    return single.unionByName(below).distinct()
