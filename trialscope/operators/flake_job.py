"""Flake detection over a window: score, class, action, and decisions that resolve themselves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.functions.measures import moment, n_where
from trialscope.functions.text import error_fingerprint, is_infra


def window_bounds(as_of: dt.datetime, days: int = 30) -> tuple[dt.datetime, dt.datetime]:
    """[start, midnight of as_of's day)."""
    end = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return end - dt.timedelta(days=days), end


def flake_groups(runs: DataFrame, as_of: dt.datetime, window_days: int = 30, min_runs: int = 5) -> DataFrame:
    """Per test: counts by status in the window, messages of failures, distinct error fingerprints.

    runs has test_case_id, status (PASSED, FAILED, FLAKY, ERROR), run_at, error_text; skipped runs
    don't count. Everything is one aggregate; fingerprints are counted, not gathered.
    """
    start, end = window_bounds(as_of, window_days)
    seen = runs.where((F.col("run_at") >= moment(start)) & (F.col("run_at") < moment(end)) & F.col("status").isin("PASSED", "FAILED", "FLAKY", "ERROR"))
    message = (F.col("status") != "PASSED") & F.col("error_text").isNotNull() & (F.col("error_text") != "")
    status = {s: n_where(F.col("status") == s.upper()).alias(s) for s in ("passed", "failed", "flaky", "error")}
    out = seen.groupBy("test_case_id").agg(F.count(F.lit(1)).alias("total"), *status.values(), n_where(message).alias("messages"), n_where(message & is_infra(F.col("error_text"))).alias("infra"), F.count_distinct(error_fingerprint(F.col("error_text"))).alias("hashes"))
    return out.where(F.col("total") >= min_runs).withColumn("flake_score", flake_score())


def flake_score() -> Column:
    """(flaky + the smaller of failed and passed) / total."""
    return (F.col("flaky") + F.least("failed", "passed")) / F.col("total")


def flake_class() -> Column:
    return (
        F.when(F.col("messages") == 0, "UNKNOWN").when(2 * F.col("infra") > F.col("messages"), "INFRA").when(F.col("hashes") == 1, "PRODUCT_BUG").when(F.col("hashes") > 1, "TEST_CODE").otherwise("UNKNOWN")
    )


def flake_decisions(groups: DataFrame, as_of: dt.datetime, window_days: int = 30, min_score: float = 0.10) -> DataFrame:
    """Tests at or above min_score with class, action and a note."""
    start, end = window_bounds(as_of, window_days)
    action = F.when(F.col("flake_score") >= 0.5, "quarantine").when(F.col("flake_score") >= 0.25, "assign").otherwise("rerun")
    note = F.format_string("%d run(s) in window: %d passed, %d failed, %d flaky, %d error. Score=%.1f%% class=%s uniqueErrorHashes=%d", "total", "passed", "failed", "flaky", "error", F.col("flake_score") * 100, "classification", "hashes")
    out = groups.where(F.col("flake_score") >= min_score).withColumn("classification", flake_class()).withColumn("recommended_action", action)
    return out.withColumns({"notes": note, "window_start": moment(start), "window_end": moment(end)})


def resolve_decisions(decisions: DataFrame, groups: DataFrame, min_score: float = 0.10) -> DataFrame:
    """Open decisions of tests that are now below min_score get the action ignore; tests with too few runs stay open."""
    healthy = groups.where(F.col("flake_score") < min_score).select("test_case_id", F.lit(True).alias("_healthy"))
    out = decisions.join(healthy, "test_case_id", "left")
    closes = F.coalesce("_healthy", F.lit(False)) & F.col("approved_at").isNull() & (F.col("recommended_action") != "ignore")
    return out.withColumn("recommended_action", F.when(closes, "ignore").otherwise(F.col("recommended_action"))).withColumn("notes", F.when(closes, "resolved: below the threshold in the current window").otherwise(F.col("notes"))).drop("_healthy")
