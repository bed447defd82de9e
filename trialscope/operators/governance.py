"""Link governance: orphan tests, unreviewed links, confidence of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.functions.measures import CONFIDENCE, PROVENANCE, RELIABLE, n_where, percent, rank_of


def orphan_tests(tests: DataFrame, links: DataFrame, results: DataFrame) -> DataFrame:
    """Tests without any link to an issue, with counts of their runs, last run first."""
    orphans = tests.join(links.select(F.col("test_case_id").alias("id")), "id", "left_anti")
    runs = results.groupBy(F.col("test_case_id").alias("id")).agg(
        F.max("run_at").alias("last_run_at"), F.count("id").alias("total_runs"),
        *(n_where(F.col("status") == s).alias(n) for s, n in (("PASSED", "pass_count"), ("FAILED", "fail_count"), ("SKIPPED", "skip_count"))),
    )
    counts = ("total_runs", "pass_count", "fail_count", "skip_count")
    out = orphans.join(runs, "id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    return out.select(F.col("id").alias("test_case_id"), "identity_key", "title", "suite_name", "last_run_at", *counts).orderBy(F.desc_nulls_last("last_run_at"), "test_case_id")


def orphan_summary(tests: DataFrame, links: DataFrame) -> DataFrame:
    """One row: tests without links, with reliable ones, with low ones only, and those to review."""
    per_test = links.groupBy(F.col("test_case_id").alias("id")).agg(F.bool_or(F.col("confidence").isin(*RELIABLE)).alias("reliable"), F.bool_or(F.col("confidence") == "LOW").alias("low"))
    marked = tests.select("id").join(per_test.withColumn("linked", F.lit(True)), "id", "left")
    flags = marked.select(*(F.coalesce(c, F.lit(False)).alias(c) for c in ("linked", "reliable", "low")))
    total, orphans = F.count(F.lit(1)), n_where("NOT linked")
    return flags.agg(total.alias("total_test_cases"), orphans.alias("orphan_count"), percent(orphans, total).alias("orphan_rate_pct"), n_where("reliable").alias("reliably_linked_count"), n_where("low AND NOT reliable").alias("low_confidence_only_count"), n_where("linked AND NOT reliable").alias("needs_review_count"))


def unreviewed_links(links: DataFrame, tests: DataFrame, issues: DataFrame) -> DataFrame:
    """Low-confidence links whose pair has no better link, oldest first."""
    better = links.where(F.col("confidence").isin(*RELIABLE)).select("issue_key", "test_case_id")
    low = links.where("confidence = 'LOW'").join(better, ["issue_key", "test_case_id"], "left_anti")
    out = low.join(tests.withColumnRenamed("id", "test_case_id"), "test_case_id").join(issues.select("issue_key", F.col("summary").alias("jira_summary"), "issue_type"), "issue_key")
    return out.select("issue_key", "jira_summary", "issue_type", "test_case_id", F.col("title").alias("test_title"), "suite_name", "identity_key", "confidence", "provenance", F.col("created_at").alias("link_created_at")).orderBy("link_created_at", "issue_key", "test_case_id", "provenance")


def link_confidence_breakdown(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """Counts of links, issues and tests by kind, confidence and provenance."""
    def branch(df: DataFrame, kind: str, target: str) -> DataFrame:
        return df.groupBy("confidence", "provenance").agg(F.lit(kind).alias("link_type"), F.count(F.lit(1)).alias("link_count"), F.count_distinct("issue_key").alias("distinct_issues"), F.count_distinct(target).alias("distinct_tests"))

    both = branch(auto, "automation", "test_case_id").unionByName(branch(manual, "manual", "tr_case_id"))
    return both.select("link_type", "confidence", "provenance", "link_count", "distinct_issues", "distinct_tests").orderBy("link_type", rank_of("confidence", CONFIDENCE).asc_nulls_last(), rank_of("provenance", PROVENANCE).asc_nulls_last())
