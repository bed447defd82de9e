"""Paths of a tree of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.sources.scratch import kept


#: Rounds of doubling after which anchors are used, and rows of which one is an anchor.
DIRECT, ANCHORS = 3, 32


def section_paths(sections: DataFrame) -> DataFrame:
    """id and path (names from the root, ' / ' between) of sections (id, parent_id, name), however deep they lie.

    Each round joins the table with itself: a row that knows the names up to its ancestor at distance d then
    knows those up to 2 d. Where three rounds aren't enough, rows climb to the next of some anchors alone, one row of
    some thirty by a hash; the paths of anchors are found by doubling on, and long paths are made once, by the join
    that returns them: only those of anchors are shuffled or written. A missing parent ends the path. Rows
    from which a cycle is reached are left when a round finishes none; they go on level by level, and the first
    section that comes again ends their path with a leading '?'.
    """
    known = sections.select(F.col("id").alias("_k")).distinct()
    at = kept(sections.join(known, F.col("parent_id") == F.col("_k"), "left").select("id", F.col("_k").alias("up"), F.col("name").alias("path")), "sections")
    paths, left = _paths(at)
    return paths if left is None else paths.unionByName(_cycles(sections, left))


def _paths(at: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, path), and the ids from which a cycle is reached, if there are any, of rows (id, up, path) that know the names below up."""
    rows, waiting, ends = _climbed(at, F.lit(False), DIRECT)
    if ends:
        return rows.where("up is null").select("id", "path"), waiting
    anchor = lambda c: F.pmod(F.xxhash64(c), F.lit(ANCHORS)) == 0
    rows, waiting, _ = _climbed(at, anchor("up"), None)
    anchors, left, _ = _climbed(kept(rows.where(anchor("id")), "section-anchors"), F.lit(False), None)
    above = anchors.where("up is null").select(F.col("id").alias("_a"), F.col("path").alias("_path"))
    further = rows.where("up is not null").join(above, F.col("up") == F.col("_a")).select("id", F.concat("_path", F.lit(" / "), "path").alias("path"))
    if left is not None:
        below = rows.join(left.select(F.col("id").alias("_a")).distinct(), F.col("up") == F.col("_a"), "left_semi").select("id")
        waiting = below if waiting is None else waiting.unionByName(below)
    return rows.where("up is null").select("id", "path").unionByName(further), waiting


def _climbed(at: DataFrame, stops: Column, rounds: int | None) -> tuple[DataFrame, DataFrame | None, bool]:
    """(rows that have come to a stop or to the end, ids of those that never do, whether all are told) after so many rounds, or as many as it takes."""
    waits = F.col("up").isNotNull() & ~stops
    done, last, before = at.where(~waits), at.where(waits), None
    while True:
        n = last.count()
        if n in (0, before):
            return done, last.select("id") if n else None, True
        if rounds == 0:
            return done, None, False
        above = done.unionByName(last).select(F.col("id").alias("_a"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        further = kept(last.join(above, F.col("up") == F.col("_a")).select("id", F.col("_up").alias("up"), F.concat("_path", F.lit(" / "), "path").alias("path")), "sections")
        done, last, before = done.unionByName(further.where(~waits)), further.where(waits), n
        rounds = rounds and rounds - 1


def _cycles(sections: DataFrame, ids: DataFrame) -> DataFrame:
    """id and path of the sections of ids, from all of which a cycle is reached."""
    parents = sections.select(F.col("id").alias("_p"), F.col("parent_id").alias("_next"), F.col("name").alias("_name"))
    at = sections.join(ids.distinct(), "id", "left_semi").select("id", F.col("parent_id").alias("at"), F.col("name").alias("path"), F.array("id").alias("seen"))
    done = None
    while True:
        joined = at.join(parents, F.col("at") == F.col("_p"))
        cycle = F.array_contains("seen", F.col("_p"))
        path = F.when(cycle, F.concat(F.lit("? / "), "path")).otherwise(F.concat("_name", F.lit(" / "), "path"))
        level = kept(joined.select("id", path.alias("path"), F.col("_next").alias("at"), F.concat("seen", F.array("_p")).alias("seen"), cycle.alias("done")), "section-cycles")
        found = level.where("done").select("id", "path")
        done = found if done is None else done.unionByName(found)
        at = level.where("not done").drop("done")
        if at.isEmpty():
            return done
