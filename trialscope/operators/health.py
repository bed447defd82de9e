"""Run history: flips between runs, health of suites, unified runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions.measures import n_where, percent, since


def flake_candidates(results: DataFrame, tests: DataFrame, links: DataFrame, as_of: dt.datetime, window_days: int = 14, min_runs: int = 5, high: float = 50, med: float = 20) -> DataFrame:
    """Tests by how often consecutive runs flip between passed and failed; other statuses don't break a flip."""
    recent = results.where(since("run_at", as_of, window_days) & F.col("status").isin("PASSED", "FAILED"))
    prev = F.lag("status").over(Window.partitionBy("test_case_id").orderBy("run_at", "id"))
    flips = recent.withColumn("prev", prev).groupBy("test_case_id").agg(F.count(F.lit(1)).alias("total_runs"), n_where("status <> prev").alias("flip_count")).where(F.col("total_runs") >= min_runs)
    rate = percent(F.col("flip_count"), F.col("total_runs") - 1)
    severity = F.when(F.col("flake_rate_pct") >= high, "HIGH").when(F.col("flake_rate_pct") >= med, "MED").otherwise("LOW")
    keys = links.groupBy("test_case_id").agg(F.array_join(F.sort_array(F.collect_set("issue_key")), ", ").alias("linked_jira_keys"))
    out = flips.join(tests.withColumnRenamed("id", "test_case_id"), "test_case_id").join(keys, "test_case_id", "left")
    out = out.withColumn("flake_rate_pct", rate).withColumn("flake_severity", severity)
    return out.select("test_case_id", "identity_key", "title", "suite_name", "total_runs", "flip_count", "flake_rate_pct", "flake_severity", "linked_jira_keys").orderBy(F.desc_nulls_last("flake_rate_pct"), "test_case_id")


def suite_health(tests: DataFrame, results: DataFrame, as_of: dt.datetime, window_days: int = 14) -> DataFrame:
    """Per suite: cases, counts by status in the window, pass rate without skips, mean seconds of passes, last run ever.

    One aggregate over the runs gives both the windowed counts and the last run.
    """
    named = tests.where("suite_name is not null")
    cases = named.groupBy("suite_name").agg(F.count_distinct("id").alias("test_case_count"))
    runs = results.join(named.select(F.col("id").alias("test_case_id"), "suite_name"), "test_case_id")
    recent = F.coalesce(since("run_at", as_of, window_days), F.lit(False))
    is_ = lambda *s: recent & F.col("status").isin(*s)
    passed, judged = n_where(is_("PASSED")), n_where(is_("PASSED", "FAILED", "ERROR"))
    ms, n = F.sum(F.when(is_("PASSED"), F.col("duration_ms"))), F.count(F.when(is_("PASSED"), F.col("duration_ms")))
    seconds = F.floor((2 * ms + 10 * n) / F.nullif(20 * n, F.lit(0))).cast("double") / 100
    stats = runs.groupBy("suite_name").agg(
        n_where(recent).alias("total_runs_14d"), passed.alias("pass_count"), n_where(is_("FAILED")).alias("fail_count"), n_where(is_("SKIPPED")).alias("skip_count"), n_where(is_("ERROR")).alias("error_count"),
        percent(passed, judged).alias("pass_rate_pct"), seconds.alias("avg_pass_duration_sec"), F.max("run_at").alias("last_run_at"),
    )
    counts = ("total_runs_14d", "pass_count", "fail_count", "skip_count", "error_count")
    out = cases.join(stats, "suite_name", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    return out.select("suite_name", "test_case_count", *counts, "pass_rate_pct", "avg_pass_duration_sec", "last_run_at").orderBy(F.asc_nulls_last("pass_rate_pct"), "suite_name")
