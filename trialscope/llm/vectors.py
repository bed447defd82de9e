"""Integer vectors in packs: shards of the candidates, blocks of the queries, and tasks in which both meet.

A pack is a row with some thousand vectors at most, so that tasks work on matrices. Blocks of a stated query
set are sent past the shards; a task holds one shard and one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a shard and of a block, about: what bounds a task's memory.
SHARD, BLOCK = 8192, 256
#: Blocks that follow a copy of a shard into one task.
LOT = 64
#: Components are cut off here; a score of 2,048 of them fits into a long.
LARGEST = 1 << 26
#: Ids of rows without one: they come after all others.
NO_ID = np.iinfo(np.int64).max

PACK = "pack int, n int, d int, width int, rows binary, ids binary, labels binary, v binary"


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), cut off at LARGEST."""
    cut = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda x: cut(x).cast("int"))


@dataclass
class Pack:
    """Vectors as rows of a matrix of whole numbers, with the numbers of their rows, their ids and their labels."""

    number: int
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Pack:
        longs = lambda c: np.frombuffer(row[c], np.int64)
        return cls(row["pack"], longs("rows"), longs("ids"), longs("labels"), np.frombuffer(row["v"], f"<i{row['width']}").reshape(row["n"], row["d"]))

    def record(self) -> dict:
        most = int(np.abs(self.v).max(initial=0))
        width = 2 if most < 1 << 15 else 4
        n, d = self.v.shape
        return {"pack": self.number, "n": n, "d": d, "width": width, "rows": self.rows.tobytes(), "ids": self.ids.tobytes(), "labels": self.labels.tobytes(), "v": self.v.astype(f"<i{width}").tobytes()}

    def take(self, at: np.ndarray) -> Pack:
        return Pack(self.number, self.rows[at], self.ids[at], self.labels[at], self.v[at])


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones have zeros at their ends."""
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def packed(vectors: DataFrame, part: Column, columns: str = "", more: Callable[[Pack], dict] | None = None) -> DataFrame:
    """A pack of each part of vectors (row, vec_id, label, v), by label, then row.

    part must deal rows so that each part is bounded; more() adds further columns.
    """
    schema = PACK + (", " + columns if columns else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("label", "ascending"), ("row", "ascending")]).combine_chunks()
        longs = lambda c: group[c].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        p = Pack(group["_pack"][0].as_py(), longs("row"), longs("vec_id"), longs("label"), matrix(group["v"].combine_chunks()))
        found = more(p) if more else p.record()
        return pa.table({c: pa.array([found[c]]) for c in names}).cast(pa.schema([(c, kind) for c, kind in zip(names, arrow_kinds(schema), strict=True)]))

    return vectors.select("row", "vec_id", "label", "v", part.cast("int").alias("_pack")).groupBy("_pack").applyInArrow(pack, schema)


def arrow_kinds(schema: str) -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type of numbers in which inner products of rows of a and b are exact."""
    bound = max(a.shape[1], b.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: the highest scores, ties by id, then row; in that order."""
    order = np.lexsort((rows, ids, -score, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return order[rank < k]


def all_cells(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard): every block of the query set with every shard."""
    return blocks.select(F.col("pack").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))


def meet(shards: DataFrame, blocks: DataFrame, cells: DataFrame, n_cells: int, state: str, run: Callable[[dict, Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run(shard, its blocks) yields for the cells (block, shard).

    Both kinds are rows of the same columns, dealt by shard and lot of blocks, with the shard first; so a task
    reads a shard, then its blocks one after the other. state names the blocks' column that shards lack.
    """
    cells = cells.withColumn("lot", F.floor(F.col("block") / LOT).cast("int"))
    kind = dict(blocks.dtypes)[state]
    extra = [c for c in shards.columns if c not in blocks.columns]
    left = shards.withColumnRenamed("pack", "shard").join(cells.select("shard", "lot").distinct(), "shard").withColumns({"block": F.lit(-1), state: F.lit(None).cast(kind)})
    right = blocks.withColumnRenamed("pack", "block").join(cells, "block").withColumns({c: F.lit(None).cast(dict(shards.dtypes)[c]) for c in extra})
    both = left.unionByName(right).withColumn("pack", F.when(F.col("block") < 0, F.col("shard")).otherwise(F.col("block")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
        row = next(rows, None)
        while row is not None:
            if row["block"] >= 0:  # of a shard to which no rows were dealt
                row = next(rows, None)
                continue
            shard, following = row, []

            def own(shard=shard, following=following) -> Iterator[dict]:
                for r in rows:
                    if r["block"] < 0 or (r["shard"], r["lot"]) != (shard["shard"], shard["lot"]):
                        following.append(r)
                        return
                    yield r

            blocks_ = own()
            yield from run(shard, blocks_)
            for _ in blocks_:
                pass
            row = following[0] if following else None

    tasks = max(1, min(10_000, 2 * n_cells))
    return both.repartition(tasks, "shard", "lot").sortWithinPartitions("shard", "lot", "block").mapInArrow(task, schema)


#: What tasks find: the query as place in a block, the score, and the id and row of the candidate.
HITS = "block int, place int, score long, vec_id long, row long"


def hits(block: int, who: np.ndarray, at: np.ndarray, score: np.ndarray, pack: Pack) -> pa.RecordBatch:
    """Scores of queries `who` of a block and rows `at` of a pack, as HITS."""
    columns = (np.full(len(who), block, np.int32), who.astype(np.int32), score.astype(np.int64), pack.ids[at], pack.rows[at])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in HITS.split(", ")])


def places_of(blocks: DataFrame) -> DataFrame:
    """block, place, _row of the queries in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, rows in zip(b["pack"].to_pylist(), b["rows"].to_pylist(), strict=True):
                at = np.frombuffer(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(at)], names=["block", "place", "_row"])

    return blocks.select("pack", "rows").mapInArrow(run, "block int, place int, _row long")
