"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

A ball with centre c and radius r has no vector of a product above q.c + |q| r with a query q. Nodes are
opened by falling bound, for a block of queries at once; a query leaves a node whose bound is below its kth
score so far. The kth scores are shared: shards are searched in waves, and each wave begins with those of
the waves before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialscope.llm.common import drop_path, kept_table
from trialscope.llm.vectors import BLOCK, HITS, NO_ID, SHARD, Pack, all_cells, best, exact_type, hits, meet, packed, places_of, usable, whole_numbers

#: Vectors of a leaf.
LEAF = 64
#: Shares of the shards that have been searched after each wave.
WAVES = (1 / 16, 1 / 4, 1.0)
TREE = "nodes binary, centres binary, radii binary"
NONE = np.iinfo(np.int64).min


@dataclass
class BallTree:
    """Nodes (start, end, left, right; left is -1 in a leaf) over vectors in the tree's order, with their balls."""

    pack: Pack
    nodes: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def grow(cls, pack: Pack, leaf: int = LEAF) -> BallTree:
        """Balls are halved at the median of the projection on the line between two far vectors."""
        v = pack.v.astype(np.float64)
        order, nodes, centres, radii = np.arange(len(v)), [], [], []
        waiting = [(0, len(v), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            at, here = len(nodes), v[order[start:end]]
            if parent >= 0:
                nodes[parent][2 + side] = at
            centre = here.mean(0) if len(here) else np.zeros(v.shape[1])
            away = np.sqrt(((here - centre) ** 2).sum(1))
            nodes.append([start, end, -1, -1])
            centres.append(centre)
            radii.append(away.max(initial=0.0))
            if end - start > leaf and radii[-1] > 0:
                a = here[away.argmax()]
                b = here[((here - a) ** 2).sum(1).argmax()]
                half = np.argsort(here @ (b - a), kind="stable")
                order[start:end] = order[start:end][half]
                middle = (start + end) // 2
                waiting += [(middle, end, at, 1), (start, middle, at, 0)]
        return cls(pack.take(order), np.array(nodes, np.int32).reshape(-1, 4), np.array(centres, np.float64).reshape(-1, v.shape[1]), np.array(radii, np.float64))

    def record(self) -> dict:
        return self.pack.record() | {"nodes": self.nodes.tobytes(), "centres": self.centres.tobytes(), "radii": self.radii.tobytes()}

    @classmethod
    def of(cls, row: dict) -> BallTree:
        return cls(Pack.of(row), np.frombuffer(row["nodes"], np.int32).reshape(-1, 4), np.frombuffer(row["centres"], np.float64).reshape(-1, row["d"]), np.frombuffer(row["radii"], np.float64))

    def search(self, queries: Pack, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the tree, score): of each query the k best of the tree that aren't below its kth, less itself."""
        d = min(self.pack.v.shape[1], queries.v.shape[1])
        kind = exact_type(self.pack.v, queries.v)
        v, q = np.ascontiguousarray(self.pack.v[:, :d], kind), np.ascontiguousarray(queries.v[:, :d], kind)
        qf, size = queries.v[:, :d].astype(np.float64), np.sqrt((queries.v.astype(np.float64) ** 2).sum(1))
        kth, found = kth.copy(), [np.zeros((3, 0), np.int64)]

        def bounds(node: int, who: np.ndarray) -> np.ndarray:
            reach = size[who] * self.radii[node]
            product = qf[who] @ self.centres[node, :d]
            return product + reach + 1e-9 * (np.abs(product) + reach) + 1e-3  # rounding errors of the bound are far below this

        everyone = np.arange(len(q))
        top = bounds(0, everyone)
        heap = [(-top.max(initial=-np.inf), 0, everyone, top)]
        pool = found[0]
        while heap:
            _, node, who, upper = heapq.heappop(heap)
            open_ = upper >= kth[who]
            who = who[open_]
            if not len(who):
                continue
            start, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (int(left), int(right)):
                    upper = bounds(child, who)
                    near = upper >= kth[who]
                    if near.any():
                        heapq.heappush(heap, (-upper[near].max(), child, who[near], upper[near]))
                continue
            score = (q[who] @ v[start:end].T).astype(np.int64)
            at = np.nonzero((score >= kth[who][:, None]) & (self.pack.rows[start:end] != queries.rows[who][:, None]))
            if not len(at[0]):
                continue
            # The k best of the queries that have anything new, with what they had; their kth scores rise.
            pool = np.concatenate([pool, np.stack([who[at[0]], at[1] + start, score[at]])], axis=1)
            pool = pool[:, best(pool[0], pool[2], self.pack.ids[pool[1]], self.pack.rows[pool[1]], k)]
            last = np.flatnonzero(np.diff(pool[0], append=-1))
            full = last[last - np.searchsorted(pool[0], pool[0][last]) == k - 1]
            kth[pool[0][full]] = np.maximum(kth[pool[0][full]], pool[2][full])
        return pool[0], pool[1], pool[2]


def searched(k: int):
    """The task of a wave: a tree and its blocks, whose kth scores are the state."""

    def run(shard: dict, blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        tree = BallTree.of(shard)
        for row in blocks:
            queries = Pack.of(row | {"pack": row["block"]})
            kth = np.full(len(queries.ids), NONE, np.int64)
            for s in row["kth"] or []:
                kth[s["place"]] = s["score"]
            who, at, score = tree.search(queries, kth, k)
            yield hits(row["block"], who, at, score, tree.pack)

    return run


def top_products(rows: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other rows.

    rows has vec_id and embedding; its queries are the rows whose vec_id `every` divides. Components count as
    floor(256 * x). Ties go to the smaller vec_id, then to the row that was read first. Rows whose vector is
    null or has a null or non-finite component take no part; rows without an id are never queries and come
    last among ties. Of vectors of different lengths the shorter counts as filled up with zeros; an empty one
    scores 0. Repeated rows are rows of their own: each is a query, and a candidate of the others. With k
    candidates or fewer, all are returned; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    valid = rows.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), whole_numbers("embedding").alias("v"))
    vectors, vectors_path = kept_table(valid.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0)
    n, queries = vectors.count(), asked.count()
    parts, lots = max(1, -(-n // shard)), max(1, -(-queries // block))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m))
    trees, trees_path = kept_table(packed(vectors, dealt(parts), TREE, lambda p: BallTree.grow(p).record()), "ball-trees")
    blocks, blocks_path = kept_table(packed(asked, dealt(lots)), "query-blocks")
    best_first = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc("vec_id"), "row")
    top, top_path, before = None, None, 0
    for share in WAVES:
        until = max(1, round(parts * share))
        if until == before:
            continue
        kth = F.lit(None).cast("array<struct<place:int,score:bigint>>")
        if top is None:
            asking = blocks.withColumn("kth", kth)
        else:
            # Only a query with k candidates has a kth score.
            full = top.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("kth")).withColumnRenamed("block", "pack")
            asking = blocks.join(full, "pack", "left")
        cells = all_cells(blocks, parts).where((F.col("shard") >= before) & (F.col("shard") < until))
        found = meet(trees.where((F.col("pack") >= before) & (F.col("pack") < until)), asking, cells, (until - before) * lots, "kth", searched(k), HITS)
        found = found if top is None else found.unionByName(top.drop("rank"))
        new, new_path = kept_table(found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k), "top")
        if top_path:
            drop_path(spark, top_path)
        top, top_path, before = new, new_path, until
    ids = asked.select(F.col("row").alias("_row"), F.col("vec_id").alias("query_id"))
    places = places_of(blocks)
    out, _ = kept_table(top.join(places, ["block", "place"]).join(ids, "_row").select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"), "top-products")
    for path in (vectors_path, trees_path, blocks_path, top_path):
        drop_path(spark, path)
    return out
