"""Hard negatives by threshold joins over an inverted index that leaves out what can't decide.

Dimensions have one order, those of most energy first. For a threshold t of a query q, a row's last
dimensions stay out of the index as long as |q| times the norm of that suffix is below t: a row whose other
dimensions share nothing with q can't reach t by them. Scores are accumulated over the lists, dimension group
by dimension group; a row is dropped when for no query the score so far and the product of the remaining
norms reach t; what is left is verified with the suffixes. Thresholds fall round by round, for the anchors
whose windows aren't full; the last round has no threshold but the window's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.llm.common import drop_path, kept_table
from trialscope.llm.vectors import BLOCK, HITS, NO_ID, SHARD, Pack, all_cells, best, exact_type, hits, meet, packed, places_of, usable, whole_numbers

#: Thresholds of the positives' rounds, as shares of the product of the anchor's norm and the largest norm; the last has none.
POSITIVE_ROUNDS = (0.6, 0.4, 0.25, 0.1, -2.0)
#: Thresholds of the negatives' rounds, as shares of the anchor's lowest positive score; the last is the lowest end of its windows.
NEGATIVE_ROUNDS = (0.8, 0.65, 0.0)
#: Dimensions that are accumulated before rows are dropped again.
GROUP = 16


class SuffixIndex:
    """A shard's rows with their dimensions by falling energy, and the norms of every suffix."""

    def __init__(self, pack: Pack):
        v = pack.v.astype(np.float64)
        self.pack, self.order = pack, np.argsort(-(v**2).sum(0), kind="stable")
        v = v[:, self.order]
        self.rest = np.sqrt(np.concatenate([np.cumsum((v**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(v), 1))], axis=1))

    def lengths(self, least: float) -> np.ndarray:
        """Of each row the number of dimensions in the index, if queries ask for `least` times their norm."""
        return (self.rest[:, :-1] >= least).sum(1) if least > 0 else np.full(len(self.rest), self.rest.shape[1] - 1)

    def join(self, queries: Pack, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs that reach the queries' thresholds."""
        size = np.sqrt((queries.v.astype(np.float64) ** 2).sum(1))
        who = np.flatnonzero(least < np.inf)
        who = who[(least[who] <= 0) | (size[who] > 0)]
        none = np.zeros(0, np.int64)
        if not len(who) or not len(self.pack.rows):
            return none, none, none
        d = self.pack.v.shape[1]
        q = np.zeros((len(who), d), np.int64)
        q[:, : min(d, queries.v.shape[1])] = queries.v[who, :d]
        q = q[:, self.order]
        t = least[who]
        rest_q = np.sqrt(np.concatenate([np.cumsum((q.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], axis=1))
        lowest = float((t / np.maximum(size[who], 1e-9)).min()) if (t > 0).all() else 0.0
        length = self.lengths(lowest * (1 - 1e-9))
        kind = exact_type(self.pack.v, q)
        q = q.astype(kind)
        # The lists of the index: the rows of list j are those of an indexed length above j, a prefix of this order.
        at = np.argsort(-length, kind="stable")
        at = at[length[at] > 0] if lowest > 0 else at
        v, ends, norms = self.pack.v[at][:, self.order].astype(kind), length[at], self.rest[at]
        score = np.zeros((len(who), len(at)), kind)
        for start in range(0, d, GROUP):
            if not len(at):
                return none, none, none
            end, listed = min(d, start + GROUP), int((ends > start).sum())
            part = np.where(np.arange(start, end) < ends[:listed, None], v[:listed, start:end], 0)
            score[:, :listed] += q[:, start:end] @ part.T
            # What is missing of a row's score begins where its lists end, or where the accumulation stands.
            cut = np.minimum(ends, end)
            bound = score + rest_q[:, cut] * norms[np.arange(len(cut)), cut]
            alive = (bound + 1e-6 * np.abs(bound) + 1e-3 >= t[:, None]).any(0)
            if alive.sum() < 0.8 * len(alive):
                at, v, ends, norms, score = at[alive], v[alive], ends[alive], norms[alive], score[:, alive]
        outside = np.where(np.arange(d) >= ends[:, None], v, 0)
        if outside.any():
            score += q @ outside.T
        score = score.astype(np.int64)
        found = np.nonzero(score >= t[:, None])
        return who[found[0]], at[found[1]], score[found]


def _least(state: list[dict] | None, n: int) -> np.ndarray:
    """The thresholds of a block's queries; those without one ask for nothing."""
    least = np.full(n, np.inf)
    for s in state or []:
        least[s["place"]] = s["least"]
    return least


def positives_of(k: int):
    """The task of a positives' round: the k best rows of an anchor's own label that reach its threshold."""

    def run(shard: dict, blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        pack = Pack.of(shard | {"pack": shard["shard"]})
        index = SuffixIndex(pack)
        for row in blocks:
            queries = Pack.of(row | {"pack": row["block"]})
            who, at, score = index.join(queries, _least(row["ask"], len(queries.ids)))
            same = (pack.labels[at] == queries.labels[who]) & (pack.rows[at] != queries.rows[who])
            who, at, score = who[same], at[same], score[same]
            chosen = best(who, score, pack.ids[at], pack.rows[at], k)
            yield hits(row["block"], who[chosen], at[chosen], score[chosen], pack)

    return run


def negatives_of(k: int):
    """The task of a negatives' round: for each window (low, high) of an anchor the k best rows of other labels in it that reach its threshold."""

    def run(shard: dict, blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        pack = Pack.of(shard | {"pack": shard["shard"]})
        index = SuffixIndex(pack)
        for row in blocks:
            queries = Pack.of(row | {"pack": row["block"]})
            n = len(queries.ids)
            windows = [(s["place"], w["low"], w["high"]) for s in row["ask"] or [] for w in s["windows"]]
            most = np.full(n, -1, np.int64)
            for place, _, high in windows:
                most[place] = max(most[place], high)
            who, at, score = index.join(queries, _least(row["ask"], n))
            other = (pack.labels[at] != queries.labels[who]) & (score <= most[who])
            who, at, score = who[other], at[other], score[other]
            order = np.lexsort((pack.rows[at], pack.ids[at], -score, who))
            who, at, score = who[order], at[order], score[order]
            begins, taken = np.searchsorted(who, np.arange(n + 1)), np.zeros(len(who), bool)
            for place, low, high in windows:
                own = score[begins[place] : begins[place + 1]]  # falling
                first = begins[place] + np.searchsorted(-own, -high, "left")
                last = begins[place] + np.searchsorted(-own, -low, "right")
                taken[first : min(last, first + k)] = True
            yield hits(row["block"], who[taken], at[taken], score[taken], pack)

    return run


def _rounds(spark, shards: DataFrame, blocks: DataFrame, asks, cells, n_cells: int, rounds: tuple, run, enough) -> tuple[DataFrame, list[str]]:
    """What the rounds find: asks(round) has (block, place, least, ...) of all anchors, of which those without enough(found) go on."""
    done, paths, open_ = None, [], None
    for number in range(len(rounds)):
        now = asks(number) if open_ is None else asks(number).join(open_, ["block", "place"], "left_semi")
        fields = [c for c in now.columns if c != "block"]
        state = now.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("ask")).withColumnRenamed("block", "pack")
        found, path = kept_table(meet(shards, blocks.join(state, "pack"), cells, n_cells, "ask", run, HITS), "round")
        paths.append(path)
        last = number == len(rounds) - 1
        if last:
            done = found if done is None else done.unionByName(found)
            break
        full, path = kept_table(enough(found, now), "full")
        paths.append(path)
        mine = found.join(full, ["block", "place"], "left_semi")
        done = mine if done is None else done.unionByName(mine)
        open_, path = kept_table(now.select("block", "place").join(full, ["block", "place"], "left_anti"), "open")
        paths.append(path)
        if open_.isEmpty():
            break
    return done, paths


def hard_negatives(rows: DataFrame, label: Column | None = None, every: int = 50, positives: int = 5, negatives: int = 3, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of each anchor and positive.

    rows has vec_id, embedding and label (or an expression for it). Components count as floor(256 * x), scores
    are inner products; higher ones come first, ties by vec_id, then by row. Anchors are the rows whose vec_id
    `every` divides, an anchor's positives its first rows of the same label, a pair's negatives the first rows
    of other labels with 50 * positive_score <= 100 * negative_score <= 95 * positive_score; all, if there are
    fewer. Rows with a null label or a vector that is null or has a null or non-finite component take no part;
    rows without an id are never anchors and come last among ties. Shorter vectors count as filled up with
    zeros; repeated rows are rows of their own. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    label = (F.col("label") if label is None else label).cast("long")
    valid = rows.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole_numbers("embedding").alias("v")).where("label is not null")
    vectors, vectors_path = kept_table(valid.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = vectors.where(F.col("vec_id") % every == 0)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    told = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"), F.sqrt(F.max(square)).alias("longest")).first()
    n_shards, n_blocks = max(1, -(-told["n"] // shard)), max(1, -(-told["anchors"] // block))
    # A label's rows lie in as few shards as hold them, so that anchors meet those alone for their positives.
    counts = vectors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("subs"))
    piece = lambda sub: F.pmod(F.xxhash64("label", sub), F.lit(n_shards)).cast("int")
    dealt = vectors.join(counts, "label").withColumn("_part", piece(F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")))
    shards, shards_path = kept_table(packed(dealt, F.col("_part")), "shards")
    blocks, blocks_path = kept_table(packed(anchors, F.pmod(F.xxhash64("row"), F.lit(n_blocks))), "anchors")
    places, places_path = kept_table(places_of(blocks).join(anchors.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"), "label", F.sqrt(square).alias("size")), "_row").drop("_row"), "places")
    longest = float(told["longest"] or 0.0)

    own = places.select("block", "label").distinct().join(counts, "label")
    numbered = own.select("block", "label", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    own_cells, cells_path = kept_table(numbered.select("block", piece(F.col("sub")).alias("shard")).distinct(), "cells")

    def ask_positives(number: int) -> DataFrame:
        return places.select("block", "place", (F.col("size") * longest * POSITIVE_ROUNDS[number]).alias("least"))

    def five(found: DataFrame, now: DataFrame) -> DataFrame:
        return found.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= positives).select("block", "place")

    found, paths = _rounds(spark, shards, blocks, ask_positives, own_cells, n_shards + n_blocks, POSITIVE_ROUNDS, positives_of(positives), five)
    # A negative positive score has no window: its half is above its 95 hundredths.
    first = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id", "row")
    low, high = F.expr("(positive_score + 1) div 2"), F.expr("positive_score div 100 * 95 + positive_score % 100 * 95 div 100")
    best_ = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= positives).select("block", "place", F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    pairs, pairs_path = kept_table(best_.where("positive_score >= 0").withColumns({"low": low, "high": high}).where("low <= high"), "pairs")

    def ask_negatives(number: int) -> DataFrame:
        windows = F.collect_set(F.struct("low", "high")).alias("windows")
        of = pairs.groupBy("block", "place").agg(F.min("low").alias("low"), F.min("positive_score").alias("score"), windows)
        return of.select("block", "place", F.greatest(F.col("low").cast("double"), F.col("score") * NEGATIVE_ROUNDS[number]).alias("least"), "windows")

    def three(found: DataFrame, now: DataFrame) -> DataFrame:
        each = now.select("block", "place", "least", F.explode("windows").alias("w")).select("block", "place", "least", "w.low", "w.high")
        inside = found.select("block", "place", "score")
        seen = each.join(inside, ["block", "place"], "left").groupBy("block", "place", "least", "low", "high").agg(F.count_if((F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high"))).alias("n"))
        short = (F.col("n") < negatives) & (F.col("least") > F.col("low"))
        return seen.groupBy("block", "place").agg(F.count_if(short).alias("short")).where("short = 0").select("block", "place")

    others = all_cells(blocks, n_shards)
    found, more = _rounds(spark, shards, blocks, ask_negatives, others, n_shards * n_blocks, NEGATIVE_ROUNDS, negatives_of(negatives), three)
    met = pairs.join(found.select("block", "place", "score", F.col("vec_id").alias("negative_id"), F.col("row").alias("negative_row")), ["block", "place"]).where("score between low and high")
    rank = F.row_number().over(Window.partitionBy("block", "place", "positive_row").orderBy(F.desc("score"), "negative_id", "negative_row"))
    ranked = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    no_id = lambda c: F.when(F.col(c) < F.lit(NO_ID), F.col(c)).alias(c)
    out, _ = kept_table(ranked.join(places.select("block", "place", "anchor_id"), ["block", "place"]).select("anchor_id", no_id("positive_id"), "rank", no_id("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    for path in (vectors_path, shards_path, blocks_path, places_path, cells_path, pairs_path, *paths, *more):
        drop_path(spark, path)
    return out
