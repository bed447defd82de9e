"""Requirement coverage: best links, the coverage matrix, executed coverage and their summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions.measures import CONFIDENCE, PRIORITY, PROVENANCE, RELIABLE, n_where, percent, rank_of, since


def requirement_universe(issues: DataFrame) -> DataFrame:
    """Stories, bugs and tasks that aren't cancelled: what coverage is measured against."""
    chosen = issues.where(F.col("issue_type").isin("Story", "Bug", "Task") & (F.coalesce("status", F.lit("")) != "Cancelled"))
    return chosen.select("issue_key", "issue_type", "summary", "status", F.col("parent_key").alias("epic_key"), "project_key", "priority")


def best_links(links: DataFrame, target: str) -> DataFrame:
    """One link per (issue, target): the most confident, then explicit before manual before inferred."""
    order = Window.partitionBy("issue_key", target).orderBy(rank_of("confidence", CONFIDENCE).asc_nulls_last(), rank_of("provenance", PROVENANCE).asc_nulls_last(), F.col("created_at").asc_nulls_last())
    return links.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _side(best: DataFrame, prefix: str) -> DataFrame:
    """Links per issue; a best link is the only one of its pair, so that counting needs no distinct."""
    return best.groupBy("issue_key").agg(F.count(F.lit(1)).alias(f"{prefix}_link_count"), n_where(F.col("confidence").isin(*RELIABLE)).alias(f"reliable_{prefix}_link_count"))


def coverage_matrix(universe: DataFrame, best_auto: DataFrame, best_manual: DataFrame) -> DataFrame:
    """Per issue: link counts of either kind and coverage flags; each side is summed before it is joined."""
    joined = universe.join(_side(best_auto, "auto"), "issue_key", "left").join(_side(best_manual, "manual"), "issue_key", "left")
    counts = ["auto_link_count", "reliable_auto_link_count", "manual_link_count", "reliable_manual_link_count"]
    out = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    flags = {
        "has_auto_coverage": F.col("auto_link_count") > 0,
        "has_reliable_auto_coverage": F.col("reliable_auto_link_count") > 0,
        "has_manual_coverage": F.col("manual_link_count") > 0,
        "has_reliable_manual_coverage": F.col("reliable_manual_link_count") > 0,
        "has_any_coverage": (F.col("auto_link_count") > 0) | (F.col("manual_link_count") > 0),
        "has_reliable_coverage": (F.col("reliable_auto_link_count") > 0) | (F.col("reliable_manual_link_count") > 0),
        "has_dual_coverage": (F.col("auto_link_count") > 0) & (F.col("manual_link_count") > 0),
    }
    return out.withColumns(flags)


def _shares(total: Column, parts: dict[str, Column], shares: dict[str, str]) -> list[Column]:
    return [c.alias(n) for n, c in parts.items()] + [percent(parts[p], total).alias(n) for n, p in shares.items()]


def coverage_summary(matrix: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row of counts and shares; with no issue the counts are 0 and the shares null."""
    total = F.count(F.lit(1))
    parts = {
        "auto_covered": n_where("has_auto_coverage"),
        "auto_covered_reliable": n_where("has_reliable_auto_coverage"),
        "manual_covered": n_where("has_manual_coverage"),
        "manual_covered_reliable": n_where("has_reliable_manual_coverage"),
        "combined_covered": n_where("has_any_coverage"),
        "combined_covered_reliable": n_where("has_reliable_coverage"),
        "dual_covered": n_where("has_dual_coverage"),
        "uncovered": n_where("NOT has_any_coverage"),
    }
    shares = {"auto_pct": "auto_covered", "auto_reliable_pct": "auto_covered_reliable", "manual_pct": "manual_covered", "manual_reliable_pct": "manual_covered_reliable", "combined_pct": "combined_covered", "combined_reliable_pct": "combined_covered_reliable", "dual_pct": "dual_covered", "uncovered_pct": "uncovered"}
    return matrix.agg(total.alias("total_issues"), *_shares(total, parts, shares)).withColumn("as_of_date", F.lit(as_of.date()))


def _group_parts() -> dict[str, Column]:
    return {
        "auto_covered": n_where("has_reliable_auto_coverage"),
        "manual_covered": n_where("has_reliable_manual_coverage"),
        "combined_covered": n_where("has_reliable_coverage"),
        "uncovered": n_where("NOT has_any_coverage"),
    }


def coverage_by_project(matrix: DataFrame) -> DataFrame:
    """Reliable coverage per project, worst first; an unset project is labelled (unknown)."""
    total = F.count(F.lit(1))
    out = matrix.groupBy("project_key").agg(total.alias("total_issues"), *_shares(total, _group_parts(), {"auto_pct": "auto_covered", "manual_pct": "manual_covered", "combined_pct": "combined_covered"}))
    return out.withColumn("project_key", F.coalesce("project_key", F.lit("(unknown)"))).orderBy(F.asc_nulls_last("combined_pct"), "project_key")


def coverage_by_epic(matrix: DataFrame, issues: DataFrame) -> DataFrame:
    """Reliable coverage per epic with the epic's summary, worst first."""
    total = F.count(F.lit(1))
    per_epic = matrix.groupBy("epic_key").agg(total.alias("story_count"), *_shares(total, _group_parts(), {"auto_pct": "auto_covered", "combined_pct": "combined_covered"}))
    epics = issues.select(F.col("issue_key").alias("epic_key"), F.col("summary").alias("epic_summary"))
    out = per_epic.join(epics, "epic_key", "left").withColumn("epic_key", F.coalesce("epic_key", F.lit("(no epic)")))
    return out.orderBy(F.asc_nulls_last("combined_pct"), "epic_key")


def coverage_by_priority(matrix: DataFrame) -> DataFrame:
    """Reliable coverage per priority, highest first; priorities outside the scale come last."""
    total = F.count(F.lit(1))
    out = matrix.groupBy("priority").agg(total.alias("total_issues"), *_shares(total, _group_parts(), {"combined_pct": "combined_covered"}))
    return out.withColumn("priority", F.coalesce("priority", F.lit("(unset)"))).orderBy(rank_of("priority", PRIORITY, 6), "priority")


def test_runs(results: DataFrame, executions: DataFrame) -> DataFrame:
    """Runs of both eras: test_case_id, era, status, run_at."""
    pick = lambda df, era: df.select("test_case_id", F.lit(era).alias("era"), "status", "run_at")
    return pick(results, "junit").unionByName(pick(executions, "playwright"))


def auto_executed(best_auto: DataFrame, tests: DataFrame, runs: DataFrame, as_of: dt.datetime, window_days: int = 30) -> DataFrame:
    """Per issue: reliably linked tests with a run in the window, how many were executed, last run, any passed or failed.

    Runs are summed per test before they meet the links, so that a test's runs aren't multiplied by
    its issues.
    """
    ran = ((F.col("era") == "junit") & F.col("status").isin("PASSED", "FAILED", "ERROR")) | ((F.col("era") == "playwright") & F.col("status").isin("PASSED", "FAILED", "FLAKY", "ERROR"))
    passed = (F.col("status") == "PASSED") | ((F.col("era") == "playwright") & (F.col("status") == "FLAKY"))
    per_test = runs.where(since("run_at", as_of, window_days)).groupBy("test_case_id").agg(F.bool_or(ran).alias("ran"), F.max("run_at").alias("last"), F.bool_or(passed).alias("passed"), F.bool_or(F.col("status") == "FAILED").alias("failed"))
    reliable = best_auto.where(F.col("confidence").isin(*RELIABLE)).select("issue_key", "test_case_id").join(tests.select(F.col("id").alias("test_case_id")), "test_case_id", "left_semi")
    return reliable.join(per_test, "test_case_id").groupBy("issue_key").agg(F.count(F.lit(1)).alias("linked_test_count"), n_where("ran").alias("executed_test_count"), F.max("last").alias("last_run_at"), F.bool_or("passed").alias("any_passed"), F.bool_or("failed").alias("any_failed"))


def manual_executed(best_manual: DataFrame, results: DataFrame, as_of: dt.datetime, window_days: int = 30) -> DataFrame:
    """Per issue: reliably linked manual cases with a result in the window; blocked (2) and untested (3) don't count as executed."""
    ran = ~F.col("status_id").isin(2, 3)
    per_case = results.where(since("tested_at", as_of, window_days)).groupBy("tr_case_id").agg(F.coalesce(F.bool_or(ran), F.lit(False)).alias("ran"), F.max("tested_at").alias("last"), F.bool_or(F.col("status_id") == 1).alias("passed"), F.bool_or(F.col("status_id") == 5).alias("failed"))
    reliable = best_manual.where(F.col("confidence").isin(*RELIABLE)).select("issue_key", "tr_case_id")
    return reliable.join(per_case, "tr_case_id").groupBy("issue_key").agg(F.count(F.lit(1)).alias("linked_test_count"), n_where("ran").alias("executed_test_count"), F.max("last").alias("last_run_at"), F.bool_or("passed").alias("any_passed"), F.bool_or("failed").alias("any_failed"))


def executed_coverage_matrix(matrix: DataFrame, auto_long: DataFrame, auto_short: DataFrame, manual_long: DataFrame, manual_short: DataFrame) -> DataFrame:
    """The coverage matrix with what was executed in the long (30 d) and short (7 d) window."""
    def part(df: DataFrame, tag: str) -> DataFrame:
        return df.select("issue_key", F.col("executed_test_count").alias(f"{tag}_n"), F.col("last_run_at").alias(f"{tag}_last"), F.col("any_passed").alias(f"{tag}_p"), F.col("any_failed").alias(f"{tag}_f"))

    out = matrix
    for df, tag in ((auto_long, "a30"), (auto_short, "a7"), (manual_long, "m30"), (manual_short, "m7")):
        out = out.join(part(df, tag), "issue_key", "left")
    n = lambda tag: F.coalesce(f"{tag}_n", F.lit(0).cast("long"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        *matrix.columns,
        (n("a30") > 0).alias("auto_executed_30d"), n("a30").alias("auto_executed_test_count_30d"), F.col("a30_last").alias("auto_last_run_at_30d"), flag("a30_p").alias("auto_any_passed_30d"), flag("a30_f").alias("auto_any_failed_30d"),
        (n("a7") > 0).alias("auto_executed_7d"), n("a7").alias("auto_executed_test_count_7d"),
        (F.col("has_reliable_auto_coverage") & (n("a30") == 0)).alias("linked_but_not_run_30d"),
        (n("m30") > 0).alias("manual_executed_30d"), n("m30").alias("manual_executed_test_count_30d"), F.col("m30_last").alias("manual_last_run_at_30d"), flag("m30_p").alias("manual_any_passed_30d"), flag("m30_f").alias("manual_any_failed_30d"),
        (n("m7") > 0).alias("manual_executed_7d"), n("m7").alias("manual_executed_test_count_7d"),
    )


def executed_coverage_summary(executed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row of executed-coverage counts and shares."""
    total = F.count(F.lit(1))
    names = ("auto_executed_30d", "auto_executed_7d", "manual_executed_30d", "manual_executed_7d")
    parts = {n: n_where(n) for n in names}
    others = [n_where("linked_but_not_run_30d").alias("linked_but_stale_30d"), n_where("NOT has_any_coverage").alias("fully_uncovered")]
    return executed.agg(total.alias("total_issues"), *_shares(total, parts, {f"{n}_pct": n for n in names}), *others).withColumn("as_of_date", F.lit(as_of.date()))
