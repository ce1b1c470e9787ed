"""Connected components of a table of links, without collecting it: large-star and small-star rounds.

Each round hangs every node's neighbours on the least node near it; the links that remain at the end are stars
around the least node of each component. Rounds write to the shared folder, so lost executors cost one round. At most
PORTION links, at the start or after a round, are finished by one task, which then holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Links that a task takes together.
PORTION = 100_000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if held and rows + b.num_rows > PORTION:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links in portions; each portion leaves a star per component, around its least node."""
    for b in _portions(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        nodes = np.array([x for x in parent if find(x) != x], np.int64)
        roots = np.array([find(int(x)) for x in nodes], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def _at_once(links: DataFrame) -> DataFrame:
    stars = stored(links.coalesce(1).mapInArrow(_contract, "a long, b long"), "stars")
    return stars.select(F.col("b").alias("id"), F.col("a").alias("component_id"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of long ids -> (id, component_id) for every node but the least of each component."""
    links = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if links.count() <= PORTION:
        return _at_once(links)
    edges = stored(links.mapInArrow(_contract, "a long, b long").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
        if now[0] <= PORTION:
            found = _at_once(edges)
            discard(edges)
            return found
        state = tuple(now)
        # Large star: the greater neighbours of each node hang on the least of it and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # Written first, so that the join below is one that Spark splits where a hub has a large share of the links.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        # Small star: each node and its lesser neighbours hang on the least of those.
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b").union(lowest.select("m", "b"))
        before, edges = edges, stored(small.distinct(), "links")
        discard(before, least)
