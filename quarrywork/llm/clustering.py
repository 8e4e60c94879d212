"""Centroid clustering over a vector-approximation file.

Every vector is kept twice in one written table: whole, and as a few bits a dimension that name the cell it lies in. For each centroid a lookup table
holds the least and the greatest squared distance to every cell, so a pass over the cells alone gives every vector an interval of distances to every
centroid. Where one interval lies below all others the vector is assigned; only where intervals overlap, or the vector changes its cluster and the
sums have to follow, is the whole vector fetched. No row is shuffled: what leaves a task is the sums that its vectors add to or take from a cluster.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, parts, schema, settle, ship, table

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Bits of a cell, at most 8. Where vectors are spread evenly, as in the test tables, fewer leave nearly every interval in an overlap.
BITS = 8
CELLS = 1 << BITS
#: The inner edges of the cells are evenly spaced between these quantiles of the sample.
EDGES = (0.001, 0.999)
#: Scaled components stop here, so that squared distances fit 63 bits.
LIMIT = 1 << 27
#: Vectors that the inner edges of the cells are taken from; every edge gives the same result.
SAMPLE = 20_000


class Grid(NamedTuple):
    """For each dimension the smallest and the greatest whole number in each cell, both included."""

    low: np.ndarray
    high: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        """Vectors (n, dims) -> their cells, a byte each."""
        return np.stack([np.searchsorted(self.low[d, 1:], v[:, d], side="right") for d in range(v.shape[1])], axis=1).astype(np.uint8)


def grid_of(least: np.ndarray, most: np.ndarray, sample: np.ndarray) -> Grid:
    """Cells of one width over the bulk of the sample; the outer ones reach to the least and the greatest component of all vectors."""
    low, high = np.quantile(sample, EDGES, axis=0)
    inner = np.linspace(low, high, CELLS - 1, axis=1).astype(np.int64)
    edges = np.concatenate([least[:, None], np.clip(inner, least[:, None], most[:, None])], axis=1)
    return Grid(edges, np.concatenate([edges[:, 1:] - 1, most[:, None]], axis=1))


class Lookup(NamedTuple):
    """(dimension, cell, centroid) -> least and greatest squared distance in the dimension."""

    low: np.ndarray
    high: np.ndarray

    def nearest(self, cells: np.ndarray) -> np.ndarray:
        """The one centroid that can be nearest; -1 where intervals overlap."""
        at = np.arange(cells.shape[1])
        low, high = self.low[at, cells].sum(1), self.high[at, cells].sum(1)
        return np.where((low <= high.min(1)[:, None]).sum(1) == 1, high.argmin(1), -1)


def lookup(grid: Grid, centroids: np.ndarray) -> Lookup:
    c = centroids.T[:, None, :]
    below, above = grid.low[:, :, None] - c, c - grid.high[:, :, None]
    low, high = np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(np.abs(grid.low[:, :, None] - c), np.abs(grid.high[:, :, None] - c)) ** 2
    return Lookup(low, high)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _filed(grid: Grid, dims: int):
    def run(batches):
        for batch in parts(batches):
            cells = grid.cells(_matrix(batch.column(2), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(bytes, cells), pa.binary())], ["row", "vec_id", "v", "cells"])

    return run


def _screened(was: Lookup, now: Lookup):
    """Rows (row, cells) -> those to fetch: of an overlap before or now, or of another centroid than before."""

    def run(batches):
        for batch in parts(batches):
            if batch.num_rows:
                cells = _bytes(batch.column(1), was.low.shape[0])
                a, b = was.nearest(cells), now.nearest(cells)
                wanted = pa.array((a < 0) | (b < 0) | (a != b))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(wanted), pa.array(a).filter(wanted), pa.array(b).filter(wanted)], ["row", "was", "now"])

    return run


def _moved(v: np.ndarray, a: np.ndarray, b: np.ndarray, was: np.ndarray | None, now: np.ndarray) -> pa.RecordBatch:
    """What the vectors add to their centroids' sums and take from the former ones, and under d = -1 to their counts; a and b: the centroids known from the cells, or -1."""
    a, b = a.copy(), b.copy()
    for known, centroids in ((a, was), (b, now)):
        open_ = np.flatnonzero(known < 0) if centroids is not None else []
        if len(open_):
            known[open_] = distances(v[open_], centroids).argmin(1)
    moves = [(int(c), sign, v[(known == c) & (a != b)]) for known, sign in ((a, -1), (b, 1)) for c in np.unique(known[(known >= 0) & (a != b)])]
    rows = [(c, d, s) for c, sign, x in moves for d, s in [(-1, sign * len(x)), *enumerate((sign * x.sum(0)).tolist())]]
    cluster, d, s = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(d, pa.int32()), pa.array(s, pa.int64())], ["cluster", "d", "s"])


def _fetched(was: np.ndarray, now: np.ndarray, dims: int):
    """Rows (was, now, v) that the screening asked for."""

    def run(batches):
        for batch in parts(batches):
            if batch.num_rows:
                yield _moved(_matrix(batch.column(2), dims), batch.column(0).to_numpy(), batch.column(1).to_numpy(), was, now)

    return run


def _side_by_side(was: np.ndarray | None, now: np.ndarray, grid: Grid):
    """Rows (cells, v): the cells are asked first, the vectors where they leave a doubt or moved. Without former centroids every vector is added."""
    before, after = lookup(grid, was) if was is not None else None, lookup(grid, now)

    def run(batches):
        for batch in parts(batches):
            if batch.num_rows:
                cells, v = _bytes(batch.column(0), len(grid.low)), _matrix(batch.column(1), len(grid.low))
                a = before.nearest(cells) if before else np.full(len(cells), -1)
                yield _moved(v, a, after.nearest(cells), was, now)

    return run


def _measured(centroids: np.ndarray, grid: Grid):
    """Rows (vec_id, cells, v) -> vec_id, cluster and exact distance."""
    found = lookup(grid, centroids)

    def run(batches):
        for batch in parts(batches):
            if batch.num_rows:
                v = _matrix(batch.column(2), len(grid.low))
                near = found.nearest(_bytes(batch.column(1), len(grid.low)))
                open_ = np.flatnonzero(near < 0)
                if len(open_):
                    near[open_] = distances(v[open_], centroids).argmin(1)
                away = ((v - centroids[near]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(away)], ["vec_id", "cluster", "distance"])

    return run


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as whole numbers floor(scale * x), of the vectors of exactly `dims` finite components."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") == dims)).filter(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), e * float(scale)))).cast("int")).alias("v"))


def _extremes(dims: int):
    def run(batches):
        for batch in parts(batches):
            if batch.num_rows:
                v = _matrix(batch.column(0), dims)
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(v.min(0)), pa.array(v.max(0)), pa.array([len(v)] * dims, pa.int64())], ["d", "low", "high", "n"])

    return run


def _grid(rows: DataFrame, dims: int) -> Grid | None:
    found = rows.select("v").mapInArrow(_extremes(dims), schema("d int, low long, high long, n long")).groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    found = sorted(found.collect())
    if not found:
        return None
    share = min(1.0, SAMPLE / found[0].n)
    sample = (rows.sample(share, 11) if share < 1 else rows).select("v").limit(2 * SAMPLE).collect()
    least, most = (np.array([r[name] for r in found], np.int64) for name in ("low", "high"))
    return grid_of(least, most, np.array([r.v for r in sample] or [least], np.int64))


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row of vectors(vec_id, embedding) with exactly `dims` finite components.

    The first centroids are the k vectors (all, if fewer) with the smallest sha256 of `seed:vec_id`, a null id as empty text, equal ones by their
    components. Other rows take no part and are not returned; rows of one id are vectors of their own; components of which the scaled value is beyond
    LIMIT count as LIMIT; an inertia beyond a long is null. No rows: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = scaled(vectors, dims, scale)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    grid = _grid(rows, dims)
    if grid is None:
        return spark.createDataFrame([], shape)
    kept = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    file = settle(kept.mapInArrow(_filed(grid, dims), schema("row long, vec_id long, v array<int>, cells binary")), "va-file")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    now = np.array([r.v for r in file.select("v", order.alias("order")).orderBy("order", "v").limit(k).collect()], np.int64)
    was, count, total = None, [0] * len(now), [[0] * dims for _ in now]
    for _ in range(rounds):
        for cluster, d, s in _moves(file, grid, was, now).groupBy("cluster", "d").agg(F.sum("s")).collect():
            if d < 0:
                count[cluster] += s
            else:
                total[cluster][d] += s
        was, now = now, np.array([[s // n for s in sums] if n else c.tolist() for c, n, sums in zip(now, count, total, strict=True)], np.int64)
        if (was == now).all():
            break
    found = settle(file.select("vec_id", "cells", "v").mapInArrow(_measured(now, grid), schema("vec_id long, cluster int, distance long")), "va-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    named = spark.createDataFrame([(c, fits(s), fits(sum(inertia.values())), sha[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moves(file: DataFrame, grid: Grid, was: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """What changes the sums of the clusters. Up to FEW vectors are fetched by their numbers; of more, cells and vectors are read side by side."""
    shape = schema("cluster int, d int, s long")
    if was is not None:
        wanted = settle(file.select("row", "cells").mapInArrow(_screened(lookup(grid, was), lookup(grid, now)), schema("row long, was long, now long")), "va-wanted")
        if wanted.count() <= FEW:
            return file.select("row", "v").join(F.broadcast(wanted), "row").select("was", "now", "v").mapInArrow(_fetched(was, now, len(grid.low)), shape)
    return file.select("cells", "v").mapInArrow(_side_by_side(was, now, grid), shape)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out; each is the same two steps."""
    steps = [f"""
scaled AS MATERIALIZED (SELECT vec_id, CAST(list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS BIGINT[]) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
x AS MATERIALIZED (SELECT vec_id, unnest(range(1, {DIMS + 1})) AS d, unnest(v) AS v FROM scaled),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM scaled QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, d, v FROM first JOIN x USING (vec_id))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (s, c)) AS c, min(s) AS s FROM (
  SELECT vec_id, c, sum((x.v - c{i}.v) * (x.v - c{i}.v)) AS s FROM x JOIN c{i} USING (d) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.d, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
  SELECT c, d, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM a{i} JOIN x USING (vec_id) GROUP BY c, d) m ON m.c = c{i}.c AND m.d = c{i}.d)""")
    return f"""WITH {",".join(steps)},
named AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN named USING (c)"""


SQL = _sql()
