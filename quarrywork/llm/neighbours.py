"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of the vectors; every vector is then dealt to a leaf, and leaves that hold too many are fitted further, each
on a bounded sample of its own. So leaves hold about as many vectors however many there are. A query goes through the tree with a
priority queue, always on at the most promising branch, and visits leaves in that order. How many leaves are visited is widened until a
calibration on some queries, against brute force over all vectors, reaches the recall asked for. Neighbouring leaves share a block of bounded size, and large
ones are cut into several; a query gets one list of its best from each block, over the leaves of it that it visits. The queries of a block are cut in
parts as well, so a task holds a block and a part, whatever the number of either. Where vectors are spread evenly, a large share of all leaves has to be
visited for the recall, and the work grows with queries times vectors.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, schema, settle, ship, table

K, EVERY = 20, 20
#: Vectors a tree or subtree is fitted on, branches of a node, rounds of each k-means.
SAMPLE, BRANCHES, ROUNDS = 20_000, 8, 8
#: Vectors in a leaf, about, and leaves at most: with more vectors than both allow, leaves are larger. The tree, which is broadcast, has at most so many centres.
LEAF, LEAVES = 256, 100_000
#: Vectors of the sample in a leaf at least; what that leaves too large is fitted further.
LEAST = 16
#: Queries the number of leaves is calibrated on, and the share of true neighbours they must find.
PROBES, RECALL = 200, 0.95
#: Rows that one task searches at once, of neighbouring leaves or a part of a large one, and queries of a part of them, compared with the rows so many at once.
BLOCK, PART, QUERIES = 4096, 2048, 512


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most k groups."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        used = np.unique(near)
        centres = np.array([x[near == c].mean(0) for c in used])
    return centres


class Tree:
    """centres: node -> the centres of its children; children: node -> their numbers, leaves as -1 - leaf."""

    def __init__(self, x: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = 5):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(x, branches, leaf, np.random.default_rng(seed))

    def _grow(self, x, branches, leaf, rng) -> int:
        if len(x) > leaf:
            centres = kmeans(x, min(branches, len(x)), rng)
            near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            if len(np.unique(near)) > 1:
                node = len(self.centres)
                self.centres.append(centres), self.children.append([])
                self.children[node] = [self._grow(x[near == c], branches, leaf, rng) for c in range(len(centres))]
                return node
        self.leaves += 1
        return -self.leaves

    def graft(self, leaf: int, tree: Tree) -> None:
        """Puts a subtree in the place of a leaf: its first leaf keeps that number, the others get new ones."""
        if tree.root < 0:
            return
        shift, name = len(self.centres), lambda n: -1 - leaf if n == -1 else n - self.leaves + 1
        moved = [[c + shift if c >= 0 else name(c) for c in children] for children in tree.children]
        for children in self.children:
            for i, c in enumerate(children):
                if c == -1 - leaf:
                    children[i] = tree.root + shift
        if self.root == -1 - leaf:
            self.root = tree.root + shift
        self.centres += tree.centres
        self.children += moved
        self.leaves += tree.leaves - 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            c = self.centres[node]
            near = (x[rows] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves, or more until they hold `least` vectors, best bin first: a branch's priority is its centre's inner product with the query."""
        queue, found, held = [(0.0, self.root)], [], 0
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += sizes.get(-1 - node, 0) if sizes else 0
            else:
                for p, child in zip(-(self.centres[node] @ q), self.children[node]):
                    heapq.heappush(queue, (float(p), child))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles: without null, zero or non-finite vectors, or a length other than the most frequent one."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.filter(good)
    usual = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("embedding") == (usual["n"] if usual else 0))


def _matrix(column) -> np.ndarray:
    """A batch's column of equal long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the k largest scores, ties by smaller id; -inf where there are fewer."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k] if scores.shape[1] <= 4 * k else None
    if top is None:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        top = np.empty((len(scores), k), np.int64)
        for i, s in enumerate(scores):
            own = np.flatnonzero(s >= edge[i])
            top[i] = own[np.argsort(-s[own], kind="stable")[:k]]
    return np.take_along_axis(scores, top, 1), ids[top]


def _search(k: int):
    """Rows of one block, with the leaf of each, and a part of the queries that visit it, with the leaves they visit -> each query's best of the block."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        asks, own = (rows.filter(m) for m in (rows["is_query"], pc.invert(rows["is_query"])))
        if not len(asks) or not len(own):
            return out.empty_table()
        x, ids = _matrix(own["embedding"].combine_chunks()), own["vec_id"].to_numpy()
        of = own["leaves"].combine_chunks().flatten().to_numpy()
        queries, names, ways = _matrix(asks["embedding"].combine_chunks()), asks["vec_id"].to_numpy(), asks["leaves"].to_pylist()
        found = []
        for at in range(0, len(asks), QUERIES):
            q = names[at : at + QUERIES]
            scores = queries[at : at + QUERIES] @ x.T
            visited = np.array([np.isin(of, w) for w in ways[at : at + QUERIES]])
            scores[(q[:, None] == ids[None, :]) | ~visited] = -np.inf
            best, who = _best(scores, ids, min(k, len(ids)))
            ok = best.ravel() > -np.inf
            found.append(pa.table([np.repeat(q, best.shape[1])[ok], who.ravel()[ok], best.ravel()[ok]], schema=out))
        return pa.concat_tables(found)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(vectors: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded number of probes: each task keeps its k best, Spark merges them."""
    shared = vectors.sparkSession.sparkContext.broadcast((probes, ids))

    def run(batches):
        q, who = shared.value
        best, got = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for batch in parts(batches):
            own = batch.column(0).to_numpy()
            scores = q @ _matrix(batch.column(1)).T
            scores[who[:, None] == own[None, :]] = -np.inf
            both, names = np.hstack([best, scores]), np.hstack([got, np.broadcast_to(own, scores.shape)])
            order = np.lexsort((names, -both), axis=1)[:, :k]
            best, got = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        ok = best.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, best.shape[1])[ok]), pa.array(got.ravel()[ok]), pa.array(best.ravel()[ok])], ["query_id", "vec_id", "score"])

    return _top(vectors.select("vec_id", "embedding").mapInArrow(run, schema("query_id long, vec_id long, score double")), k)


def _fit(leaf: int):
    """Rows (at, embedding) of one leaf's sample -> its subtree, pickled."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree = Tree(_matrix(rows["embedding"].combine_chunks()), leaf)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps((tree.centres, tree.children, tree.leaves, tree.root))], pa.binary())})

    return run


class Index:
    """Every usable row of vectors(vec_id, embedding), dealt to the leaves of a tree. Rows that repeat an id count each."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK):
        ship(vectors.sparkSession)
        rows = settle(usable(vectors), "ann-vectors")
        n = rows.count()
        self.leaf = max(leaf, -(-n // LEAVES))
        share = F.shiftrightunsigned(F.xxhash64(F.lit(3), "vec_id"), 11) / F.lit(float(1 << 53))
        picked = rows.filter(share * n <= 2 * sample).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
        self.tree = Tree(np.stack(picked["embedding"].to_numpy()), max(LEAST, self.leaf * len(picked) // n)) if len(picked) else None
        if self.tree is None:
            self.rows, self.sizes = rows.withColumn("leaf", F.lit(0).cast("long")), {}
        else:
            self.rows = settle(self._placed(rows), "ann-rows")
            self.sizes = self._sizes()
            while large := {k: m for k, m in self.sizes.items() if m > 4 * self.leaf} if self.tree.leaves * LEAST * 2 > len(picked) else {}:
                before = self.tree.leaves
                self._refine(large, sample)
                if self.tree.leaves == before:  # what is left is alike
                    break
                self.rows = settle(self._placed(rows), "ann-rows")
                self.sizes = self._sizes()
        self.blocks, at, filled = {}, 0, 0
        for name, m in sorted(self.sizes.items()):
            cut = -(-m // block)
            if filled and filled + m > block:
                at, filled = at + 1, 0
            self.blocks[name] = (at, cut)
            filled += m
            if cut > 1:
                at, filled = at + cut, 0

    def _sizes(self) -> dict[int, int]:
        """One number for each leaf of the tree."""
        return {r["leaf"]: r["count"] for r in self.rows.groupBy("leaf").count().collect()}

    def _refine(self, large: dict[int, int], sample: int) -> None:
        """Fits each of these leaves further, on at most about `sample` of its vectors, in a group of its own."""
        spark = self.rows.sparkSession
        rates = F.broadcast(spark.createDataFrame([(k, min(1.0, sample / m)) for k, m in large.items()], "leaf long, rate double"))
        share = F.shiftrightunsigned(F.xxhash64(F.lit(4), "vec_id"), 11) / F.lit(float(1 << 53))
        own = self.rows.join(rates, "leaf").filter(share <= F.col("rate")).select("leaf", "embedding")
        least = max(LEAST, self.leaf * min(sample, max(large.values())) // max(large.values()))
        for r in own.groupBy("leaf").applyInArrow(_fit(least), schema("leaf long, tree binary")).orderBy("leaf").collect():
            tree = Tree.__new__(Tree)
            tree.centres, tree.children, tree.leaves, tree.root = pickle.loads(r["tree"])
            self.tree.graft(r["leaf"], tree)

    def _placed(self, rows: DataFrame) -> DataFrame:
        tree = rows.sparkSession.sparkContext.broadcast(self.tree)

        def run(batches):
            for batch in parts(batches):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.place(_matrix(batch.column(1))))], ["vec_id", "embedding", "leaf"])

        return rows.mapInArrow(run, schema("vec_id long, embedding array<double>, leaf long"))

    def calibrate(self, queries: DataFrame, k: int = K, probes: int = PROBES, recall: float = RECALL) -> int:
        """The least number of leaves with which the probes, a bounded sample of the queries, find that share of their true neighbours."""
        picked = queries.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(probes).select("vec_id", "embedding").toPandas()
        if not len(picked):
            return 1
        ids, q = picked["vec_id"].to_numpy(), np.stack(picked["embedding"].to_numpy())
        true = _exact(self.rows, q, ids, k)
        leaf_of = self.rows.select("vec_id", "leaf").join(F.broadcast(true.select("query_id", "vec_id")), "vec_id").toPandas()
        if not len(leaf_of):
            return 1
        order = {i: {leaf: n for n, leaf in enumerate(self.tree.visits(v, self.tree.leaves))} for i, v in zip(ids.tolist(), q)}
        at = np.sort([order[i][leaf] for i, leaf in zip(leaf_of["query_id"], leaf_of["leaf"])])
        return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int = K, leaves: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, score: the k best found of all rows but the query's own. queries: usable rows (vec_id, embedding)."""
        if self.tree is None:
            return queries.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        leaves = leaves or self.calibrate(queries, k)
        spark = queries.sparkSession
        tree, sizes, blocks = spark.sparkContext.broadcast(self.tree), self.sizes, self.blocks

        def visit(batches):
            for batch in parts(batches):
                ways = []
                for v in _matrix(batch.column(1)):
                    by: dict[int, list[int]] = {}
                    for leaf in tree.value.visits(v, leaves, sizes, k + 1):
                        first, cut = blocks.get(leaf, (0, 0))
                        for block in range(first, first + cut):
                            by.setdefault(block, []).append(leaf)
                    ways.append([{"block": b, "leaves": x} for b, x in by.items()])
                kind = pa.list_(pa.struct([("block", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], ["vec_id", "embedding", "ways"])

        asks = queries.select("vec_id", "embedding").mapInArrow(visit, schema("vec_id long, embedding array<double>, ways array<struct<block: long, leaves: array<long>>>"))
        asks = settle(asks.select(F.explode("ways").alias("w"), "vec_id", "embedding").select("w.block", "vec_id", "embedding", "w.leaves", F.lit(True).alias("is_query")), "ann-visits")
        crowds = F.broadcast(asks.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("crowd")))  # as many rows as blocks at most
        placed = F.broadcast(spark.createDataFrame([(leaf, *b) for leaf, b in blocks.items()], "leaf long, first long, parts long"))
        block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        own = self.rows.join(placed, "leaf").select(block.alias("block"), "vec_id", "embedding", F.array("leaf").alias("leaves"), F.lit(False).alias("is_query")).join(crowds, "block")
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1)))
        asks = asks.join(crowds, "block").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("crowd")).cast("int"))
        found = own.unionByName(asks).drop("crowd").groupBy("block", "part").applyInArrow(_search(k), schema("query_id long, vec_id long, score double"))
        return _top(found, k)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids count each as a candidate, but never their own; a query that is repeated is asked once."""
    index = Index(table(spark, sf_dir, "embeddings"))
    queries = index.rows.filter(F.col("vec_id") % EVERY == 0).dropDuplicates(["vec_id"])
    return index.search(queries.select("vec_id", "embedding"))
