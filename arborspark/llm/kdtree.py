"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors are dealt to shards of a bounded number of rows by a hash of their id.
Within a shard a KD-tree splits at the median of the widest dimension down to
small leaves; every node has the tight bounding box of its vectors.  No vector in
a box has a greater inner product with q than

    sum_i max(q_i * low_i, q_i * high_i).

The traversal is best first: each query opens its nodes in falling order of that
bound and stops once the bound is below its k-th score, so boxes that cannot
matter are never read.  Queries of a block go through a tree together.

Two passes propagate the k-th score: each query first searches one home shard;
the k-th score found there is the starting limit for all other shards.  Queries
travel in groups of blocks, so a task holds one shard and a bounded number of queries.  Scores are integers, held
by 64-bit floats, and exact while the products of a query and a vector sum to less than 2**53.

Defined cases: vectors that are null, or hold a null or a non-finite component,
take no part; finite components beyond 2**46 count as
that, and scores beyond 2**62 as that; vectors of different lengths never meet; a query with fewer
candidates returns them all; ties go to the smaller id, equal ids in any
order; a row is no candidate for itself, nor are other rows of its id.  An empty
table gives no rows.  Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Rows of a shard and of a leaf, and queries that go through a tree together.
SHARD_ROWS = 8192
LEAF_ROWS = 64
BLOCK_QUERIES = 512
#: The greatest component, whose 256 fold is far from the end of long, and the greatest score.
LARGEST, HIGHEST = float(1 << 46), float(1 << 62)
#: Blocks of queries that one task takes to a shard.
GROUP_BLOCKS = 64


class KdTree:
    """Median splits down to leaves; nodes in preorder, with children or a span of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.children = [], [], [], []
        self.order = order
        self._build(vectors, 0, len(order), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _build(self, vectors: np.ndarray, start: int, stop: int, leaf: int) -> int:
        rows = vectors[self.order[start:stop]]
        node = len(self.span)
        low, high = rows.min(axis=0), rows.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, stop))
        self.children.append(None)
        if stop - start > leaf and (high > low).any():
            axis, half = int(np.argmax(high - low)), (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(rows[:, axis], half)]
            self.children[node] = (self._build(vectors, start, start + half, leaf), self._build(vectors, start + half, stop, leaf))
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (queries x k, padded by -inf) of each query's best rows that reach its limit."""
        n = len(queries)
        best, named = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        bound = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        limit = limit.copy()
        # each query's frontier: the nodes it may open, by their bounds
        frontier = np.full(bound.shape, -np.inf)
        frontier[:, 0] = bound[:, 0]
        live = np.arange(n)
        while len(live):
            node = np.argmax(frontier[live], axis=1)
            good = frontier[live, node] >= limit[live]
            good &= frontier[live, node] > -np.inf
            live, node = live[good], node[good]
            frontier[live, node] = -np.inf
            for x in np.unique(node):
                who = live[node == x]
                if self.children[x] is not None:
                    for child in self.children[x]:
                        frontier[who, child] = bound[who, child]
                    continue
                start, stop = self.span[x]
                for a in range(start, stop, 4096):  # a leaf of equal vectors may be long
                    b = min(stop, a + 4096)
                    score = queries[who] @ self.vectors[a:b].T
                    score[query_ids[who][:, None] == self.ids[a:b][None, :]] = -np.inf
                    scores = np.concatenate([best[who], score], axis=1)
                    ids = np.concatenate([named[who], np.broadcast_to(self.ids[a:b], score.shape)], axis=1)
                    keep = np.lexsort((ids, -scores), axis=1)[:, :k]
                    best[who], named[who] = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
                limit[who] = np.maximum(limit[who], best[who, -1])
        return best, named


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component; components beyond LARGEST count as that."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * 256).cast("long"))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k greatest inner products of each query's quantised vector; is_query reads vec_id."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    rows = usable.select("vec_id", quantised(F.col("embedding")).alias("v")).withColumn("dim", F.size("v"))
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    rows = cut(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def searched(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        """Each shard's best rows for the queries sent to it; candidates and queries of a (shard, group) come as one table."""

        def answer(all_rows: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "vec_id", "score")})]
            for _, same in all_rows.groupby("dim"):
                own, ask = same[~same["asks"]], same[same["asks"]]
                if own.empty or ask.empty:
                    continue
                tree = KdTree(own["id"].to_numpy(), np.stack(own["v"]).astype(np.float64).reshape(len(own), -1))
                for start in range(0, len(ask), BLOCK_QUERIES):
                    part = ask.iloc[start : start + BLOCK_QUERIES]
                    scores, ids = tree.search(part["id"].to_numpy(), np.stack(part["v"]).astype(np.float64).reshape(len(part), -1), k, part["least"].to_numpy())
                    good = scores > -np.inf
                    times = good.sum(axis=1)
                    out.append(pd.DataFrame({"query_row": np.repeat(part["query_row"].to_numpy(), times), "query_id": np.repeat(part["id"].to_numpy(), times), "vec_id": ids[good], "score": np.clip(scores[good], -HIGHEST, HIGHEST).astype(np.int64)}))
            return pd.concat(out)

        names = ("shard", "group", "asks", "query_row", "id", "v", "dim", "least")
        own = candidates.withColumns({"asks": F.lit(False), "query_row": F.lit(0).cast("long"), "id": F.col("vec_id"), "least": F.lit(0.0)})
        both = own.select(*names).union(asked.withColumn("asks", F.lit(True)).select(*names))
        return both.groupBy("shard", "group").applyInPandas(answer, "query_row long, query_id long, vec_id long, score long")

    # a query row is named by its id and its vector, as ids may repeat
    asked = queries.select(F.xxhash64("vec_id", "v").alias("query_row"), F.col("vec_id").alias("id"), "v", "dim", "shard").dropDuplicates(["query_row", "id"])
    asked = cut(asked.withColumn("block", F.pmod("query_row", F.lit(blocks)).cast("int")))
    whole = rows.withColumn("group", F.lit(0))
    home = cut(searched(whole, asked.withColumns({"group": F.lit(0), "least": F.lit(float("-inf"))})))
    kth = home.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("query_row", F.col("s").cast("double").alias("least"))
    others = asked.join(kth, "query_row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    others = others.withColumn("home", F.col("shard")).drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    # no task holds more than GROUP_BLOCKS blocks of queries beside its shard
    groups = -(-blocks // GROUP_BLOCKS)
    others = others.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS).cast("int"))
    far = searched(rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), others)
    found = home.union(far) if shards > 1 else home
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    # at most k rows of each shard come together for a query
    ranked = found.groupBy("query_row", "query_id").agg(F.slice(best, 1, k).alias("best"))
    flat = ranked.select("query_id", F.posexplode("best").alias("place", "x"))
    return flat.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every query: rows whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)
