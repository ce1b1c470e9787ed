"""Approximate nearest neighbours by cosine: balanced posting lists with a graph over their centroids.

Centroids come from at most SAMPLE vectors (least hash of vec_id): k-means, with lists of over twice the mean split
again. They form a graph in memory (near links and links from a random ring), searched best-first for all rows of a
batch at once. Every vector goes to the list of its nearest centroid, and boundary vectors to up to COPIES lists
whose distance is within BOUNDARY of the nearest. A query reads the lists within PRUNE of its nearest, between
LEAST_LISTS and MOST_LISTS.

A list is dealt in blocks of at most about BLOCK vectors and its queries likewise, so a hot vector or list never
gathers in one task. Scores are computed on the original vectors in double precision.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part (as queries neither); ties go to the smaller vec_id; rows that repeat a vec_id are one candidate with their
greatest score, and a query's own vec_id is none; fewer than k rows come back only if the lists read hold
fewer others; an empty table gives no rows; vectors of doubles stay doubles, other numbers become doubles; other columns
are ignored, whatever their names. Lists stop growing in number at SAMPLE / 8, so beyond SAMPLE / 8 * LIST vectors they
grow in length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows

SAMPLE = 20_000
LIST = 160
COPIES, BOUNDARY = 4, 1.25
LEAST_LISTS, MOST_LISTS, PRUNE = 24, 64, 1.6
LINKS, RING = 14, 4
BLOCK = 2000

NEAREST = "query_id long, rank int, vec_id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, centers: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(rounds):
        near = np.concatenate([(part @ centers.T).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 2000))])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=len(centers)) > 0
        norm = np.linalg.norm(sums, axis=1)
        full &= norm > 1e-9
        centers[full] = sums[full] / norm[full, None]
    return centers, near


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """About `lists` unit vectors; large clusters are split, empty ones dropped."""
    rng = np.random.default_rng(11)
    x = _unit(sample)
    centers, near = _means(x, x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy(), 8)
    for _ in range(4):
        sizes = np.bincount(near, minlength=len(centers))
        large = np.flatnonzero(sizes > 2 * len(x) / lists)
        if not len(large):
            break
        new = [x[rng.choice(np.flatnonzero(near == k))] for k in large]
        centers, near = _means(x, np.concatenate([centers, new]), 3)
    return np.unique(centers[np.bincount(near, minlength=len(centers)) > 0].round(12), axis=0)


def graph(centers: np.ndarray) -> np.ndarray:
    """Links of each centroid: the nearest ones, and steps of powers of two along a random ring."""
    n = len(centers)
    k = min(LINKS, n)
    near = np.concatenate([np.argsort(-(part @ centers.T), axis=1, kind="stable")[:, :k] for part in np.array_split(centers, -(-n // 1000))])
    ring = np.random.default_rng(5).permutation(n)
    where = np.argsort(ring)
    far = np.stack([ring[(where + step) % n] for step in (1, 7, 61, 509)[:RING]], axis=1)
    return np.concatenate([near, far], axis=1)


def search(x: np.ndarray, centers: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all rows at once: their `width` nearest centroids and distances, ascending."""
    n, width = len(centers), min(width, len(centers))
    entries = np.unique(np.linspace(0, n - 1, min(n, max(width, 16))).astype(int))
    rows = np.arange(len(x))[:, None]
    seen = np.zeros((len(x), n), bool)
    seen[:, entries] = True
    ids = np.broadcast_to(entries, (len(x), len(entries))).copy()
    dist = 1 - x @ centers[entries].T
    keep = max(width, 16)
    order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = np.zeros(ids.shape, bool)
    for _ in range(n):
        masked = np.where(done, np.inf, dist)
        best = masked.argmin(axis=1)
        if np.isinf(masked[rows[:, 0], best]).all():
            break
        go = np.isfinite(masked[rows[:, 0], best])
        done[rows[:, 0], best] = True
        next_ = links[ids[rows[:, 0], best]]
        fresh = ~seen[rows, next_] & go[:, None]
        seen[rows, next_] = True
        d = np.where(fresh, 1 - np.einsum("ij,ikj->ik", x, centers[next_]), np.inf)
        ids, dist, done = np.concatenate([ids, next_], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
        ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
    return ids[:, :width], np.maximum(dist[:, :width], 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), flat.dtype)


def _route(batches: Iterator[pa.RecordBatch], centers: np.ndarray, links: np.ndarray, most: int, least: int, ratio: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
            ids, dist = search(_unit(_matrix(b.column("embedding"))), centers, links, most)
            # Distances on the sphere, so that a ratio means the same for vectors and centroids.
            reach = np.sqrt(dist) <= ratio * np.sqrt(dist[:, :1]) + 1e-9
            reach[:, :least] = True
            row, column = np.nonzero(reach & np.isfinite(dist))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row, column], pa.int32()), b.column("vec_id").take(pa.array(row)), b.column("embedding").take(pa.array(row))], names=["list", "vec_id", "embedding"])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores wherever they stand."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _scan(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], []]
    if queries.num_rows and vectors.num_rows:
        x = _matrix(vectors.column("embedding").combine_chunks())
        ids = vectors.column("vec_id").to_numpy()
        unit = _unit(x)
        q = _matrix(queries.column("embedding").combine_chunks())
        near = _unit(q) @ unit.T
        names, of = np.unique(ids, return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(names)))
        for row, query in enumerate(queries.column("vec_id").to_pylist()):
            near[row, ids == query] = -np.inf
            # The k-th of the vec_ids, each with its best row.
            by_id = near[row] if len(names) == len(ids) else np.maximum.reduceat(near[row][order], starts)
            some = min(k, len(names))
            limit = np.partition(by_id, len(names) - some)[len(names) - some]
            # All within rounding of the k-th, scored exactly; then ties by vec_id.
            take = np.flatnonzero(near[row] >= max(limit - 1e-9, -2))
            score = cosines(q[row], x[take])
            best = np.lexsort((ids[take], -score))
            if len(names) < len(ids):
                best = best[np.sort(np.unique(ids[take][best], return_index=True)[1])]
            best = best[:k]
            out[0] += [query] * len(best)
            out[1] += ids[take][best].tolist()
            out[2] += score[best].tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int | None = None) -> DataFrame:
    """The k nearest rows of vectors(vec_id, embedding) for each row of queries(vec_id, embedding)."""
    spark = vectors.sparkSession
    arrow_rows(spark)

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>") if double else "embedding").where("vec_id is not null and embedding is not null")
        finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
        return df.where(finite & F.exists("embedding", lambda v: v != 0))

    double = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    placed_as = f"list int, vec_id long, embedding array<{'double' if double else 'float'}>"
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], NEAREST)
    rows = rows.where(F.size("embedding") == sizes["d"])
    asked = valid(queries).where(F.size("embedding") == sizes["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    points = np.stack(sample["embedding"].to_list()).astype(np.float64)
    centers = centroids(points, lists or max(1, min(sizes["n"] // LIST, len(points) // 8)))
    links = graph(centers)
    placed = rows.mapInArrow(lambda it: _route(it, centers, links, COPIES, 1, BOUNDARY), placed_as)
    probes = asked.mapInArrow(lambda it: _route(it, centers, links, MOST_LISTS, LEAST_LISTS, PRUNE), placed_as)
    # One row per list: bounded by the sample.
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = F.broadcast(blocks(placed.select("list"), "vb").join(blocks(probes.select("list"), "qb"), "list"))
    part = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    v = placed.join(grid, "list").select("list", part("vb").alias("b"), every("qb").alias("c"), "vec_id", "embedding")
    q = probes.join(grid, "list").select("list", part("qb").alias("c"), every("vb").alias("b"), "vec_id", "embedding")
    found = q.groupBy("list", "b", "c").cogroup(v.groupBy("list", "b", "c")).applyInArrow(lambda a, b: _scan(a, b, k), "query_id long, vec_id long, score double")
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
