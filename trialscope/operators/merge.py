"""Keyed writes as functions of frames: each gives the new version of a table.

There is no table format with MERGE here; a merge is one full outer join on the key, which is written
as a new Parquet version. Keys are compared null-safely.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions.names import fresh
from trialscope.sources.scratch import spread

#: What a column of an existing row becomes: the new value, the new one unless it is null, the old one (set on creation only), or
#: the old one unless it is null.
NEW, NEW_UNLESS_NULL, OLD, OLD_UNLESS_NULL = "new", "new unless null", "old", "old unless null"


#: Order of confidence.
CONFIDENCE_RANK = {"HIGH": 3, "MED": 2, "LOW": 1}


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))


def last_write_wins(source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key of a batch: the first in the given order (all columns break ties)."""
    ties, number = [F.col(c).asc_nulls_last() for c, t in source.dtypes if "map<" not in t], fresh("_n", source.columns)
    first = Window.partitionBy(*keys).orderBy(*order, *ties)
    return source.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number)


def merge(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str] | None = None, insert: bool = True) -> DataFrame:
    """target with the rows of source merged in; source has at most one row per key.

    policy names what becomes of each other column of an existing row (NEW if not named); columns that
    source lacks keep their value and are null in new rows. insert=False leaves new keys out.
    Merging the same source again changes nothing.
    """
    policy = policy or {}
    mark = fresh("_there", [*target.columns, *source.columns])
    t, s = target.withColumn(mark, F.lit(True)).alias("t"), source.withColumn(mark, F.lit(True)).alias("s")
    joined = t.join(s, _same(keys), "full" if insert else "left")
    old_there, new_there = F.col(f"t.{mark}").isNotNull(), F.col(f"s.{mark}").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(old_there, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        if c not in source.columns:
            return F.col(f"t.{c}")
        new, old = F.col(f"s.{c}"), F.col(f"t.{c}")
        kept = {NEW: new, NEW_UNLESS_NULL: F.coalesce(new, old), OLD: old, OLD_UNLESS_NULL: F.coalesce(old, new)}[policy.get(c, NEW)]
        return F.when(old_there & new_there, kept).when(new_there, new).otherwise(old)

    return joined.select(*(value(c).alias(c) for c in target.columns))


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows of source whose key it lacks."""
    new = source.alias("s").join(target.select(*keys).distinct().alias("t"), _same(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """target without the rows for which condition holds; rows where it is null stay."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def reset_links(links: DataFrame, provenance: str, source: str | None = None) -> DataFrame:
    """Links without those of a provenance, and of one source if it is given."""
    cond = F.col("provenance") == provenance
    return delete_where(links, cond if source is None else cond & F.col("source").eqNullSafe(F.lit(source)))


def upsert_links(links: DataFrame, found: DataFrame, ends: list[str], provenance: str, source: str) -> DataFrame:
    """links with the found ones (ends, confidence, evidence) merged in under a provenance.

    Provenance is part of the key: links of other provenances between the same ends stay as they are.
    Of several found links of the same ends the most confident holds.
    """
    confident = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair)), F.col("confidence"))
    new = last_write_wins(found.select(*ends, "confidence", "evidence"), ends, [F.desc_nulls_last(confident)])
    return merge(links, new.withColumns({"provenance": F.lit(provenance), "source": F.lit(source)}), [*ends, "provenance"])


def link_counts(before: DataFrame, after: DataFrame, ends: list[str]) -> DataFrame:
    """provenance, confidence, written (new or changed), unchanged, removed: what a link job did to the table."""
    keys, told = [*ends, "provenance"], ["confidence", "evidence", "source"]
    state = lambda df, name: df.select(*keys, F.struct(*told).alias(name))
    both = state(before, "old").join(state(after, "new"), keys, "full")
    return both.groupBy("provenance", F.coalesce("new.confidence", "old.confidence").alias("confidence")).agg(
        F.count_if(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("written"),
        F.count_if(F.col("new").isNotNull() & F.col("new").eqNullSafe(F.col("old"))).alias("unchanged"),
        F.count_if(F.col("new").isNull()).alias("removed"),
    )


def merge_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """inserted, changed, unchanged, removed: what a job did to a keyed table (the counters that it reports)."""
    told = [c for c in after.columns if c not in keys]
    state = lambda df, name: df.select(*keys, F.struct(*told).alias(name)).alias(name)
    same = reduce(lambda a, b: a & b, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys))
    old, new = F.col("old.old"), F.col("new.new")
    return state(before, "old").join(state(after, "new"), same, "full").agg(
        F.count_if(old.isNull()).alias("inserted"), F.count_if(old.isNotNull() & new.isNotNull() & ~new.eqNullSafe(old)).alias("changed"),
        F.count_if(new.eqNullSafe(old)).alias("unchanged"), F.count_if(new.isNull()).alias("removed"),
    )


def upsert_decisions(decisions: DataFrame, found: DataFrame, window_start: str = "window_start") -> DataFrame:
    """Flake decisions with the found ones merged in: a test's decision of the same or a later window start is updated.

    found has one row per test; where a test has a decision from its window's start on, the latest such
    decision takes the new values, else the found one is new.
    """
    latest = decisions.groupBy("test_case_id").agg(F.max(window_start).alias("_latest"))
    aimed = found.join(latest, "test_case_id", "left").withColumn(window_start, F.when(F.col("_latest") >= F.col(window_start), F.col("_latest")).otherwise(F.col(window_start)))
    return merge(decisions, aimed.drop("_latest"), ["test_case_id", window_start])


def backfill(target: DataFrame, column: str, lookup: DataFrame, on: str, value: str) -> DataFrame:
    """target with null values of a column filled from lookup (one row per `on`)."""
    inner = fresh("_found", target.columns)
    found = lookup.select(F.col(on), F.col(value).alias(inner))
    return target.join(found, on, "left").withColumn(column, F.coalesce(column, inner)).select(*target.columns)


def keep_known(rows: DataFrame, known: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is known, the others): no row without its parent is written. What is known grows too, and is never broadcast."""
    keys = spread(known.select(*on).distinct())
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def latest_moment(rows: DataFrame, moment: str, overlap: str = "INTERVAL 1 HOUR") -> DataFrame:
    """since: the latest moment of all rows, less the overlap; null (full sync) without one."""
    return rows.agg((F.max(moment) - F.expr(overlap)).alias("since"))


def high_water_mark(rows: DataFrame, group: str, moment: str, overlap: str = "INTERVAL 1 HOUR") -> DataFrame:
    """since: the least of the groups' latest moments, less the overlap; null (full sync) if a group has none."""
    latest = rows.groupBy(group).agg(F.max(moment).alias("m"))
    return latest.agg(F.when(F.count_if(F.col("m").isNull()) > 0, None).otherwise(F.min("m") - F.expr(overlap)).alias("since"))


def project_marks(rows: DataFrame, projects: DataFrame, group: str, moment: str, overlap: str = "INTERVAL 1 HOUR", explicit=None, full: bool = False) -> DataFrame:
    """group, since: from when on each requested project's changes are to be asked for; null (everything) for one without rows.

    projects has the requested groups. An explicit moment holds for all of them, a full sync asks for everything.
    """
    latest = rows.groupBy(group).agg((F.max(moment) - F.expr(overlap)).alias("since"))
    asked = projects.select(group).distinct()
    if full or explicit is not None:
        return asked.withColumn("since", F.lit(None if full else explicit).cast("timestamp"))
    return asked.join(latest, group, "left")


def oldest_mark(marks: DataFrame) -> DataFrame:
    """since: the one moment that serves all projects of project_marks(); null if one of them needs everything."""
    return marks.agg(F.when(F.count_if(F.col("since").isNull()) > 0, None).otherwise(F.min("since")).alias("since"))


def incremental(rows: DataFrame, moment: str, since) -> DataFrame:
    """Rows changed at `since` or later; all, if it is null. The overlap is absorbed by the merge."""
    return rows.where((F.col(moment) >= F.lit(since)) if since is not None else F.lit(True))
