"""The views and dashboard cards as queries (spark, sf_dir)."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.operators import coverage, export, governance, health
from trialscope.plans.view_sql import AS_OF as AS_OF_SQL
from trialscope.plans.view_sql import over_views
from trialscope.sources.binding import Domain

AS_OF = dt.datetime(2024, 1, 31)


class Views(Domain):
    """Views over the domain tables at one moment; Spark inlines them into one plan."""

    as_of = AS_OF

    @cached_property
    def best_auto(self) -> DataFrame:
        return coverage.best_links(self.jira_automation_link, "test_case_id")

    @cached_property
    def best_manual(self) -> DataFrame:
        return coverage.best_links(self.jira_testrail_link, "tr_case_id")

    @cached_property
    def universe(self) -> DataFrame:
        return coverage.requirement_universe(self.jira_issue)

    @cached_property
    def matrix(self) -> DataFrame:
        return coverage.coverage_matrix(self.universe, self.best_auto, self.best_manual)

    def auto(self, days: int) -> DataFrame:
        return coverage.auto_executed(self.best_auto, self.test_case, coverage.test_runs(self.test_case_result, self.test_execution), self.as_of, days)

    def manual(self, days: int) -> DataFrame:
        return coverage.manual_executed(self.best_manual, self.testrail_result, self.as_of, days)

    @cached_property
    def executed(self) -> DataFrame:
        return coverage.executed_coverage_matrix(self.matrix, self.auto(30), self.auto(7), self.manual(30), self.manual(7))

    @cached_property
    def executed_summary(self) -> DataFrame:
        return coverage.executed_coverage_summary(self.executed, self.as_of)

    @cached_property
    def orphans(self) -> DataFrame:
        return governance.orphan_tests(self.test_case, self.jira_automation_link, self.test_case_result)

    @cached_property
    def orphan_summary(self) -> DataFrame:
        return governance.orphan_summary(self.test_case, self.jira_automation_link)

    @cached_property
    def unreviewed(self) -> DataFrame:
        return governance.unreviewed_links(self.jira_automation_link, self.test_case, self.jira_issue)

    @cached_property
    def confidence(self) -> DataFrame:
        return governance.link_confidence_breakdown(self.jira_automation_link, self.jira_testrail_link)

    @cached_property
    def flakes(self) -> DataFrame:
        return health.flake_candidates(self.test_case_result, self.test_case, self.jira_automation_link, self.as_of)

    @cached_property
    def suites(self) -> DataFrame:
        return health.suite_health(self.test_case, self.test_case_result, self.as_of)


def _mean_pass_rate(v: Views) -> DataFrame:
    tenths = F.sum(F.round(F.col("pass_rate_pct") * 10).cast("long"))
    n = F.count("pass_rate_pct")
    return v.suites.agg(F.coalesce(F.floor((2 * tenths + n) / F.nullif(2 * n, F.lit(0))).cast("double") / 10, F.lit(0.0)).alias("avg_pass_rate_pct"))


TREND = (dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 24), AS_OF)


def _trend(v: Views) -> DataFrame:
    """Executed shares of the snapshots that were taken at the moments of TREND."""
    history = None
    for at in TREND:
        then = Views(v.spark, v.sf_dir)
        then.as_of = at
        row = export.snapshot_row(then.executed_summary, at).select("taken_at", "auto_executed_30d_pct", "manual_executed_30d_pct")
        history = row if history is None else export.append_snapshot(history, row)
    return history.orderBy("taken_at")


def _trend_sql() -> str:
    one = lambda at: over_views(f"SELECT {AS_OF_SQL} AS taken_at, coalesce(auto_executed_30d_pct, 0.0) AS auto_executed_30d_pct, coalesce(manual_executed_30d_pct, 0.0) AS manual_executed_30d_pct FROM v_executed_summary").replace(AS_OF_SQL, f"TIMESTAMP '{at}'")
    return " UNION ALL ".join(f"SELECT * FROM ({one(at)})" for at in TREND)


def _dated(df: DataFrame) -> DataFrame:
    """The date as text, which both engines hand over alike."""
    return df.withColumn("as_of_date", F.col("as_of_date").cast("string"))


#: name: (query over the views, SQL over the SQL views)
QUERIES = {
    "req_universe": (lambda v: v.universe, "SELECT * FROM v_universe"),
    "best_auto_link": (lambda v: v.best_auto, "SELECT * FROM v_best_auto"),
    "best_manual_link": (lambda v: v.best_manual, "SELECT * FROM v_best_manual"),
    "coverage_matrix": (lambda v: v.matrix, "SELECT * FROM v_matrix"),
    "coverage_summary": (lambda v: _dated(coverage.coverage_summary(v.matrix, v.as_of)), "SELECT * REPLACE (CAST(as_of_date AS VARCHAR) AS as_of_date) FROM v_summary"),
    "coverage_by_project": (lambda v: coverage.coverage_by_project(v.matrix), "SELECT * FROM v_project"),
    "coverage_by_epic": (lambda v: coverage.coverage_by_epic(v.matrix, v.jira_issue), "SELECT * FROM v_epic"),
    "coverage_by_priority": (lambda v: coverage.coverage_by_priority(v.matrix), "SELECT * FROM v_priority"),
    "auto_executed_30d": (lambda v: v.auto(30), "SELECT * FROM v_auto30"),
    "auto_executed_7d": (lambda v: v.auto(7), "SELECT * FROM v_auto7"),
    "manual_executed_30d": (lambda v: v.manual(30), "SELECT * FROM v_manual30"),
    "manual_executed_7d": (lambda v: v.manual(7), "SELECT * FROM v_manual7"),
    "executed_coverage_matrix": (lambda v: v.executed, "SELECT * FROM v_executed"),
    "executed_coverage_summary": (lambda v: _dated(v.executed_summary), "SELECT * REPLACE (CAST(as_of_date AS VARCHAR) AS as_of_date) FROM v_executed_summary"),
    "orphan_tests": (lambda v: v.orphans, "SELECT * FROM v_orphans"),
    "orphan_summary": (lambda v: v.orphan_summary, "SELECT * FROM v_orphan_summary"),
    "unreviewed_links": (lambda v: v.unreviewed, "SELECT * FROM v_unreviewed"),
    "link_confidence_breakdown": (lambda v: v.confidence, "SELECT * FROM v_confidence"),
    "flake_candidates": (lambda v: v.flakes, "SELECT * FROM v_flakes"),
    "suite_health": (lambda v: v.suites, "SELECT * FROM v_suites"),
    "card_auto_tested": (lambda v: v.executed_summary.select("auto_executed_30d_pct"), "SELECT auto_executed_30d_pct FROM v_executed_summary"),
    "card_manual_tested": (lambda v: v.executed_summary.select("manual_executed_30d_pct"), "SELECT manual_executed_30d_pct FROM v_executed_summary"),
    "card_fully_uncovered": (lambda v: v.executed_summary.select("fully_uncovered"), "SELECT fully_uncovered FROM v_executed_summary"),
    "card_linked_but_stale": (lambda v: v.executed_summary.select("linked_but_stale_30d"), "SELECT linked_but_stale_30d FROM v_executed_summary"),
    "card_coverage_trend": (_trend, _trend_sql()),
    "card_by_project": (lambda v: coverage.coverage_by_project(v.matrix).select("project_key", "auto_pct", "manual_pct", "combined_pct").orderBy(F.asc_nulls_last("combined_pct"), "project_key").limit(20), "SELECT project_key, auto_pct, manual_pct, combined_pct FROM v_project ORDER BY combined_pct NULLS LAST, project_key LIMIT 20"),
    "card_by_priority": (lambda v: coverage.coverage_by_priority(v.matrix).select("priority", "total_issues", "combined_pct", "uncovered"), "SELECT priority, total_issues, combined_pct, uncovered FROM v_priority"),
    "card_uncovered_issues": (lambda v: v.matrix.where("NOT has_any_coverage").select("issue_key", "summary", "status", "priority", "project_key").orderBy(F.asc_nulls_last("priority"), "issue_key"), "SELECT issue_key, summary, status, priority, project_key FROM v_matrix WHERE NOT has_any_coverage"),
    "card_avg_pass_rate": (_mean_pass_rate, "SELECT coalesce(floor((2 * CAST(sum(CAST(round(pass_rate_pct * 10) AS BIGINT)) AS BIGINT) + count(pass_rate_pct)) / nullif(2 * count(pass_rate_pct), 0)) / 10.0, 0.0) AS avg_pass_rate_pct FROM v_suites"),
    "card_high_flakes": (lambda v: v.flakes.where("flake_severity = 'HIGH'").agg(F.count(F.lit(1)).alias("high_severity_flakes")), "SELECT count(*) AS high_severity_flakes FROM v_flakes WHERE flake_severity = 'HIGH'"),
    "card_suites_below_80": (lambda v: v.suites.where("pass_rate_pct < 80").agg(F.count(F.lit(1)).alias("suites_below_80")), "SELECT count(*) AS suites_below_80 FROM v_suites WHERE pass_rate_pct < 80"),
    "card_suite_health": (lambda v: v.suites.select("suite_name", "test_case_count", "pass_rate_pct", "avg_pass_duration_sec", "last_run_at"), "SELECT suite_name, test_case_count, pass_rate_pct, avg_pass_duration_sec, last_run_at FROM v_suites"),
    "card_flake_candidates": (lambda v: v.flakes.select("title", "suite_name", "flake_rate_pct", "flake_severity", "total_runs", "linked_jira_keys"), "SELECT title, suite_name, flake_rate_pct, flake_severity, total_runs, linked_jira_keys FROM v_flakes"),
    "card_orphan_rate": (lambda v: v.orphan_summary.select("orphan_rate_pct"), "SELECT orphan_rate_pct FROM v_orphan_summary"),
    "card_needs_review": (lambda v: v.orphan_summary.select("needs_review_count"), "SELECT needs_review_count FROM v_orphan_summary"),
    "card_reliably_linked": (lambda v: v.orphan_summary.select("reliably_linked_count"), "SELECT reliably_linked_count FROM v_orphan_summary"),
    "card_link_confidence": (lambda v: v.confidence.select("link_type", "confidence", "link_count"), "SELECT link_type, confidence, link_count FROM v_confidence"),
    "card_unreviewed_queue": (lambda v: v.unreviewed.select("issue_key", "jira_summary", "test_title", "confidence", "provenance", "link_created_at"), "SELECT issue_key, jira_summary, test_title, confidence, provenance, link_created_at FROM v_unreviewed"),
    "card_orphan_tests": (lambda v: v.orphans.select("title", "suite_name", "total_runs", "last_run_at", "pass_count", "fail_count", "test_case_id").orderBy(F.desc_nulls_last("last_run_at"), "test_case_id").limit(100), "SELECT title, suite_name, total_runs, last_run_at, pass_count, fail_count, test_case_id FROM v_orphans ORDER BY last_run_at DESC NULLS LAST, test_case_id LIMIT 100"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: over_views(text) for name, (_, text) in QUERIES.items()}


