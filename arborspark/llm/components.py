"""Connected components of a link table by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond").

Each half-step replaces a node's links by links to its smallest neighbour, found by
a grouped minimum that combines before the shuffle; no neighbour list is
gathered.  Nodes of very many links, as the centres of large stars, are few; their
minima are broadcast, so their links stay where they are.  Before the first round
and after each, a task settles the links that it holds among themselves, at most
about TASK_LINKS of them: they become stars around their smallest nodes, which
joins nothing that was apart and leaves fewer rounds.  Links that fit one task are
thereby settled at once.  Rounds are written to the shared checkpoint folder.
Native components leave this step out: DataFrame operations only, in more rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_of, cut

#: A node has very many links beyond the greater of this number and the links' number by this one: so at most twice as many nodes have.
CROWDED, MOST_CROWDED = 1000, 100_000
#: Links that a task settles among themselves: some tens of MB while it does.
TASK_LINKS = 500_000


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """u, v, m of links (u, v): m is the least v of u."""
    limit = max(CROWDED, total // MOST_CROWDED)
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    crowded = cut(least.where(F.col("n") > limit).select("u", "m")) if total > limit else None
    if crowded is None or crowded.isEmpty():
        return links.join(least.select("u", "m"), "u")
    rest = links.join(F.broadcast(crowded.select("u")), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return links.join(F.broadcast(crowded), "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node that the links (u, v) connect it with, but for that node itself."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[column_of(x, c).to_numpy(zero_copy_only=False) for c in ("u", "v")] for x in batches if x.num_rows]
    if parts:
        u, v = stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame, most_rounds: int = 60, native: bool = False) -> DataFrame:
    """node, component (its smallest reachable node) of every node that has a link (a, b), both long.

    Self links, repeated links and links of null ends are allowed and mean nothing.
    native: no Python on the executors, so no task settles links by itself.
    """
    edges = cut(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    total, before = edges.count(), None
    for _ in range(most_rounds if total else 0):
        if not native:
            tasks = -(-total // TASK_LINKS)
            edges = cut(edges.coalesce(tasks).mapInArrow(_settled, "u long, v long").distinct() if tasks > 1 else edges.coalesce(1).mapInArrow(_settled, "u long, v long"))
            if tasks == 1:
                break
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        total, before = now[0], now
        both = _with_least(edges.union(edges.select("v", "u")), 2 * total)
        large = cut(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, total).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
    else:
        if total:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
