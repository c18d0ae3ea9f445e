"""Exact top-k by inner product over KD-trees, a tree for each shard of the vectors.

Every shard's vectors are split at the median of the widest side until leaves are small; every node has a tight
bounding box. The largest inner product that a query can have with a box is the sum over components of the larger of
query times low and query times high side. A query goes down only to boxes whose bound reaches its k-th score so far,
and visits the leaves that are left best first. The k-th score that one shard has shown is sent along to all shards,
where it prunes from the start; it's a lower bound of the true one, and boxes that just reach it are visited, so
results are exact, ties and all.

Queries are packed into blocks of a bounded number; every pair of a block and a shard is a group of its own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, trimmed

#: Vectors of a shard, of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 4096, 64, 4096
#: Stands for no row among scores, and for its id.
NONE, NO_ID = -(1 << 62), (1 << 63) - 1
#: More than rounding can take from scores below 2^62 as doubles.
SLACK = 4096.0


class Tree:
    """ids and integer vectors in leaf order; nodes level by level: low and high corners, first and end row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        nodes, levels = [order], []
        while True:
            levels.append(nodes)
            if max(map(len, nodes)) <= leaf:
                break
            split = []
            for rows in nodes:
                part = vectors[rows]
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                half = len(rows) // 2
                at = np.argpartition(part[:, axis], half) if half else np.arange(len(rows))
                # the order by id within a node is kept
                split += [rows[np.sort(at[:half])], rows[np.sort(at[half:])]]
            nodes = split
        last = np.concatenate(levels[-1])
        self.ids, self.vectors = ids[last], vectors[last]
        self.levels = []
        for nodes in levels:
            size = np.array([len(x) for x in nodes])
            corners = [(vectors[x].min(axis=0), vectors[x].max(axis=0)) if len(x) else (np.zeros(vectors.shape[1]),) * 2 for x in nodes]
            self.levels.append((np.stack([c[0] for c in corners]), np.stack([c[1] for c in corners]), np.cumsum(size) - size, size))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the k best of each query in this tree, without those below `least` and without
        the query's own id. Values are whole and exact in the vectors' float type."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        slack = SLACK if queries.dtype == np.int64 else 0.0
        m = len(queries)
        best, best_id = np.full((m, k), NONE), np.full((m, k), NO_ID)
        kth = least.copy()
        alive = np.ones((m, 1), bool)
        bound = None
        for low, high, _first, size in self.levels:
            bound = (plus @ high.T + minus @ low.T).astype(np.float64) + slack
            if alive.shape[1] != bound.shape[1]:
                alive = np.repeat(alive, 2, axis=1)
            alive &= (bound >= kth[:, None]) & (size > 0)
        _, _, first, size = self.levels[-1]
        bound = np.where(alive, bound, -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(m)
        for step in range(order.shape[1]):
            node = order[active, step]
            active = active[bound[active, node] >= kth[active]]
            active = active[np.isfinite(bound[active, order[active, step]])]
            if not len(active):
                break
            node = order[active, step]
            for leaf in np.unique(node):
                rows = active[node == leaf]
                a, b = first[leaf], first[leaf] + size[leaf]
                product = queries[rows] @ self.vectors[a:b].T
                score = product if product.dtype == np.int64 else np.rint(product).astype(np.int64)
                score[(self.ids[a:b][None, :] == own[rows][:, None]) | (score + slack < kth[rows][:, None])] = NONE
                scores = np.concatenate([best[rows], score], axis=1)
                ids = np.concatenate([best_id[rows], np.where(score > NONE, self.ids[a:b][None, :], NO_ID)], axis=1)
                # highest scores first, equal ones by id
                chosen = np.lexsort((ids, -scores), axis=1)[:, :k]
                best[rows] = np.take_along_axis(scores, chosen, axis=1)
                best_id[rows] = np.take_along_axis(ids, chosen, axis=1)
                worst = best[rows, -1]
                full = worst > NONE
                kth[rows[full]] = np.maximum(kth[rows[full]], worst[full].astype(np.float64) - slack)
        row, place = np.nonzero(best > NONE)
        return row, best_id[row, place], best[row, place]


def _exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The type in which inner products of these whole numbers are exact: floats where they can be, or 64-bit integers."""
    top = max((abs(int(x)) for a in (vectors,) for x in (a.min(initial=0), a.max(initial=0))), default=0) * max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0)))) * vectors.shape[1]
    if top >= 2**62:
        raise ValueError("inner products don't fit 63 bits")
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, as array<long>. Rows whose vec_id or vector is null, or whose
    vector is empty or holds a null or non-finite component, are left out."""
    x = F.col("embedding").cast("array<double>")
    whole = vectors.where("vec_id is not null and embedding is not null").where((F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(scale * c)).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k rows of vectors(vec_id, v: array<long>) with the
    highest inner products, without rows of the query's own id; ties go to the smaller vec_id.

    is_query: a condition on vec_id. All vectors must be of one length, and scores must fit 63 bits (others are an
    error); a repeated row counts once for each time, and a repeated query once. Other columns are dropped, whatever
    their names. An empty table gives an empty one."""
    vectors = materialize(vectors.select("vec_id", "v"), "vectors")
    shards = max(1, round(vectors.count() / shard))

    @trimmed
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [pickle.dumps(tree)]})

    @trimmed
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "queries": [pickle.dumps((pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.int64)))]})

    def found(pdf: pd.DataFrame):
        tree, (ids, q) = pickle.loads(pdf["tree"].iloc[0]), pickle.loads(pdf["queries"].iloc[0])
        kind = _exact(tree.vectors, q)
        tree.vectors = tree.vectors.astype(kind)
        tree.levels = [(low.astype(kind), high.astype(kind), first, size) for low, high, first, size in tree.levels]
        least = pickle.loads(pdf["least"].iloc[0]) if "least" in pdf else np.full(len(ids), -np.inf)
        return ids, tree.search(q.astype(kind), ids, k, least)

    @trimmed
    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        """The k-th scores of a block within one shard."""
        ids, (row, _, score) = found(pdf)
        least = np.full(len(ids), np.inf)
        np.minimum.at(least, row, score.astype(np.float64) - SLACK * (np.abs(score) >= 2**53))
        least[np.bincount(row, minlength=len(ids)) < k] = -np.inf
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "least": [pickle.dumps(least)]})

    @trimmed
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, (row, vec, score) = found(pdf)
        return pd.DataFrame({"query_id": ids[row], "vec_id": vec, "score": score})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))
    trees = materialize(dealt.groupBy("shard").applyInPandas(build, "shard long, tree binary"), "trees")
    queries = vectors.where(is_query).dropDuplicates(["vec_id"])
    # a block is bounded by `block` queries, give or take the spread of a hash
    blocks = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(max(1, -(-vectors.where(is_query).count() // block))))
    packed = materialize(queries.withColumn("block", blocks).groupBy("block").applyInPandas(pack, "block long, queries binary"), "queries")
    one = trees.agg(F.min("shard").alias("shard"))
    near = packed.join(trees.join(one, "shard", "left_semi").withColumnRenamed("shard", "own"), F.lit(True)).groupBy("own", "block").applyInPandas(bounds, "block long, least binary")
    every = packed.join(materialize(near, "bounds"), "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    rows = every.join(trees, "shard").groupBy("shard", "block").applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
