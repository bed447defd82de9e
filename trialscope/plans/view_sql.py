"""SQL of the views, written apart from the operators, for the comparison in DuckDB."""

from __future__ import annotations

from trialscope.sources.binding import oracle_ctes

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def pct(part: str, whole: str) -> str:
    return f"(floor((2000 * {part} + {whole}) / nullif(2 * {whole}, 0)) / 10.0)"


def _conf(c: str) -> str:
    return f"CASE {c} WHEN 'HIGH' THEN 1 WHEN 'MED' THEN 2 WHEN 'LOW' THEN 3 END"


def _prov(c: str) -> str:
    return f"CASE {c} WHEN 'EXPLICIT' THEN 1 WHEN 'MANUAL' THEN 2 WHEN 'INFERRED' THEN 3 END"


def _best(table: str, target: str) -> str:
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY issue_key, {target} ORDER BY {_conf('confidence')}, {_prov('provenance')}, created_at) = 1"


def _n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _executed_auto(days: int) -> str:
    return f"""
SELECT a.issue_key, count(DISTINCT a.test_case_id) AS linked_test_count,
  count(DISTINCT a.test_case_id) FILTER (WHERE (r.era = 'j' AND r.status IN ('PASSED', 'FAILED', 'ERROR')) OR (r.era = 'p' AND r.status IN ('PASSED', 'FAILED', 'FLAKY', 'ERROR'))) AS executed_test_count,
  max(r.run_at) AS last_run_at,
  bool_or(r.status = 'PASSED' OR (r.era = 'p' AND r.status = 'FLAKY')) AS any_passed, bool_or(r.status = 'FAILED') AS any_failed
FROM v_best_auto a JOIN test_case t ON t.id = a.test_case_id
JOIN (SELECT test_case_id, status, run_at, 'j' AS era FROM test_case_result UNION ALL SELECT test_case_id, status, run_at, 'p' FROM test_execution) r
  ON r.test_case_id = t.id AND r.run_at >= {AS_OF} - INTERVAL '{days}' DAY
WHERE a.confidence IN ('HIGH', 'MED') GROUP BY a.issue_key"""


def _executed_manual(days: int) -> str:
    return f"""
SELECT m.issue_key, count(DISTINCT m.tr_case_id) AS linked_test_count, count(DISTINCT m.tr_case_id) FILTER (WHERE r.status_id NOT IN (2, 3)) AS executed_test_count,
  max(r.tested_at) AS last_run_at, bool_or(r.status_id = 1) AS any_passed, bool_or(r.status_id = 5) AS any_failed
FROM v_best_manual m JOIN testrail_result r ON r.tr_case_id = m.tr_case_id
WHERE m.confidence IN ('HIGH', 'MED') AND r.tested_at >= {AS_OF} - INTERVAL '{days}' DAY GROUP BY m.issue_key"""


_GROUP = f"""count(*) AS {{total}}, {_n('has_reliable_auto_coverage')} AS auto_covered, {_n('has_reliable_manual_coverage')} AS manual_covered,
  {_n('has_reliable_coverage')} AS combined_covered, {_n('NOT has_any_coverage')} AS uncovered"""

VIEWS = {
    "v_universe": "SELECT issue_key, issue_type, summary, status, parent_key AS epic_key, project_key, priority FROM jira_issue WHERE issue_type IN ('Story', 'Bug', 'Task') AND coalesce(status, '') <> 'Cancelled'",
    "v_best_auto": _best("jira_automation_link", "test_case_id"),
    "v_best_manual": _best("jira_testrail_link", "tr_case_id"),
    "v_counts": """
SELECT r.issue_key, r.issue_type, r.summary, r.status, r.epic_key, r.project_key, r.priority,
  count(DISTINCT a.test_case_id) AS auto_link_count, count(DISTINCT a.test_case_id) FILTER (WHERE a.confidence IN ('HIGH', 'MED')) AS reliable_auto_link_count,
  count(DISTINCT m.tr_case_id) AS manual_link_count, count(DISTINCT m.tr_case_id) FILTER (WHERE m.confidence IN ('HIGH', 'MED')) AS reliable_manual_link_count
FROM v_universe r LEFT JOIN v_best_auto a ON a.issue_key = r.issue_key LEFT JOIN v_best_manual m ON m.issue_key = r.issue_key
GROUP BY ALL""",
    "v_matrix": """
SELECT *, auto_link_count > 0 AS has_auto_coverage, reliable_auto_link_count > 0 AS has_reliable_auto_coverage,
  manual_link_count > 0 AS has_manual_coverage, reliable_manual_link_count > 0 AS has_reliable_manual_coverage,
  (auto_link_count > 0 OR manual_link_count > 0) AS has_any_coverage, (reliable_auto_link_count > 0 OR reliable_manual_link_count > 0) AS has_reliable_coverage,
  (auto_link_count > 0 AND manual_link_count > 0) AS has_dual_coverage FROM v_counts""",
    "v_summary": f"""
SELECT total_issues, auto_covered, auto_covered_reliable, manual_covered, manual_covered_reliable, combined_covered, combined_covered_reliable, dual_covered, uncovered,
  {pct('auto_covered', 'total_issues')} AS auto_pct, {pct('auto_covered_reliable', 'total_issues')} AS auto_reliable_pct, {pct('manual_covered', 'total_issues')} AS manual_pct,
  {pct('manual_covered_reliable', 'total_issues')} AS manual_reliable_pct, {pct('combined_covered', 'total_issues')} AS combined_pct,
  {pct('combined_covered_reliable', 'total_issues')} AS combined_reliable_pct, {pct('dual_covered', 'total_issues')} AS dual_pct, {pct('uncovered', 'total_issues')} AS uncovered_pct,
  CAST({AS_OF} AS DATE) AS as_of_date
FROM (SELECT count(*) AS total_issues, {_n('has_auto_coverage')} AS auto_covered, {_n('has_reliable_auto_coverage')} AS auto_covered_reliable, {_n('has_manual_coverage')} AS manual_covered,
  {_n('has_reliable_manual_coverage')} AS manual_covered_reliable, {_n('has_any_coverage')} AS combined_covered, {_n('has_reliable_coverage')} AS combined_covered_reliable,
  {_n('has_dual_coverage')} AS dual_covered, {_n('NOT has_any_coverage')} AS uncovered FROM v_matrix) x""",
    "v_project": f"""
SELECT coalesce(project_key, '(unknown)') AS project_key, total_issues, auto_covered, manual_covered, combined_covered, uncovered,
  {pct('auto_covered', 'total_issues')} AS auto_pct, {pct('manual_covered', 'total_issues')} AS manual_pct, {pct('combined_covered', 'total_issues')} AS combined_pct
FROM (SELECT project_key, {_GROUP.format(total='total_issues')} FROM v_matrix GROUP BY project_key) x""",
    "v_epic": f"""
SELECT coalesce(x.epic_key, '(no epic)') AS epic_key, e.summary AS epic_summary, story_count, auto_covered, manual_covered, combined_covered, uncovered,
  {pct('auto_covered', 'story_count')} AS auto_pct, {pct('combined_covered', 'story_count')} AS combined_pct
FROM (SELECT epic_key, {_GROUP.format(total='story_count')} FROM v_matrix GROUP BY epic_key) x LEFT JOIN jira_issue e ON e.issue_key = x.epic_key""",
    "v_priority": f"""
SELECT coalesce(priority, '(unset)') AS priority, total_issues, auto_covered, manual_covered, combined_covered, uncovered, {pct('combined_covered', 'total_issues')} AS combined_pct
FROM (SELECT priority, {_GROUP.format(total='total_issues')} FROM v_matrix GROUP BY priority) x""",
    "v_auto30": _executed_auto(30),
    "v_auto7": _executed_auto(7),
    "v_manual30": _executed_manual(30),
    "v_manual7": _executed_manual(7),
    "v_executed": """
SELECT c.*, coalesce(e30.executed_test_count, 0) > 0 AS auto_executed_30d, coalesce(e30.executed_test_count, 0) AS auto_executed_test_count_30d, e30.last_run_at AS auto_last_run_at_30d,
  coalesce(e30.any_passed, FALSE) AS auto_any_passed_30d, coalesce(e30.any_failed, FALSE) AS auto_any_failed_30d,
  coalesce(e7.executed_test_count, 0) > 0 AS auto_executed_7d, coalesce(e7.executed_test_count, 0) AS auto_executed_test_count_7d,
  (c.has_reliable_auto_coverage AND coalesce(e30.executed_test_count, 0) = 0) AS linked_but_not_run_30d,
  coalesce(m30.executed_test_count, 0) > 0 AS manual_executed_30d, coalesce(m30.executed_test_count, 0) AS manual_executed_test_count_30d, m30.last_run_at AS manual_last_run_at_30d,
  coalesce(m30.any_passed, FALSE) AS manual_any_passed_30d, coalesce(m30.any_failed, FALSE) AS manual_any_failed_30d,
  coalesce(m7.executed_test_count, 0) > 0 AS manual_executed_7d, coalesce(m7.executed_test_count, 0) AS manual_executed_test_count_7d
FROM v_matrix c LEFT JOIN v_auto30 e30 ON e30.issue_key = c.issue_key LEFT JOIN v_auto7 e7 ON e7.issue_key = c.issue_key
LEFT JOIN v_manual30 m30 ON m30.issue_key = c.issue_key LEFT JOIN v_manual7 m7 ON m7.issue_key = c.issue_key""",
    "v_executed_summary": f"""
SELECT *, {pct('auto_executed_30d', 'total_issues')} AS auto_executed_30d_pct, {pct('auto_executed_7d', 'total_issues')} AS auto_executed_7d_pct,
  {pct('manual_executed_30d', 'total_issues')} AS manual_executed_30d_pct, {pct('manual_executed_7d', 'total_issues')} AS manual_executed_7d_pct, CAST({AS_OF} AS DATE) AS as_of_date
FROM (SELECT count(*) AS total_issues, {_n('auto_executed_30d')} AS auto_executed_30d, {_n('auto_executed_7d')} AS auto_executed_7d, {_n('linked_but_not_run_30d')} AS linked_but_stale_30d,
  {_n('NOT has_any_coverage')} AS fully_uncovered, {_n('manual_executed_30d')} AS manual_executed_30d, {_n('manual_executed_7d')} AS manual_executed_7d FROM v_executed) x""",
    "v_orphans": f"""
SELECT t.id AS test_case_id, t.identity_key, t.title, t.suite_name, max(r.run_at) AS last_run_at, count(r.id) AS total_runs,
  {_n("r.status = 'PASSED'")} AS pass_count, {_n("r.status = 'FAILED'")} AS fail_count, {_n("r.status = 'SKIPPED'")} AS skip_count
FROM test_case t LEFT JOIN test_case_result r ON r.test_case_id = t.id
WHERE NOT EXISTS (SELECT 1 FROM jira_automation_link l WHERE l.test_case_id = t.id) GROUP BY t.id, t.identity_key, t.title, t.suite_name""",
    "v_orphan_summary": f"""
SELECT total_test_cases, orphan_count, {pct('orphan_count', 'total_test_cases')} AS orphan_rate_pct, reliably_linked_count, low_confidence_only_count, needs_review_count
FROM (SELECT count(*) AS total_test_cases, {_n('NOT l')} AS orphan_count, {_n('r')} AS reliably_linked_count, {_n('w AND NOT r')} AS low_confidence_only_count, {_n('l AND NOT r')} AS needs_review_count
  FROM (SELECT t.id, EXISTS (SELECT 1 FROM jira_automation_link a WHERE a.test_case_id = t.id) AS l,
    EXISTS (SELECT 1 FROM jira_automation_link a WHERE a.test_case_id = t.id AND a.confidence IN ('HIGH', 'MED')) AS r,
    EXISTS (SELECT 1 FROM jira_automation_link a WHERE a.test_case_id = t.id AND a.confidence = 'LOW') AS w FROM test_case t) y) x""",
    "v_unreviewed": """
SELECT l.issue_key, i.summary AS jira_summary, i.issue_type, l.test_case_id, t.title AS test_title, t.suite_name, t.identity_key, l.confidence, l.provenance, l.created_at AS link_created_at
FROM jira_automation_link l JOIN test_case t ON t.id = l.test_case_id JOIN jira_issue i ON i.issue_key = l.issue_key
WHERE l.confidence = 'LOW' AND NOT EXISTS (SELECT 1 FROM jira_automation_link b WHERE b.issue_key = l.issue_key AND b.test_case_id = l.test_case_id AND b.confidence IN ('HIGH', 'MED'))""",
    "v_confidence": """
SELECT 'automation' AS link_type, confidence, provenance, count(*) AS link_count, count(DISTINCT issue_key) AS distinct_issues, count(DISTINCT test_case_id) AS distinct_tests FROM jira_automation_link GROUP BY confidence, provenance
UNION ALL SELECT 'manual', confidence, provenance, count(*), count(DISTINCT issue_key), count(DISTINCT tr_case_id) FROM jira_testrail_link GROUP BY confidence, provenance""",
    "v_flips": f"""
SELECT test_case_id, count(*) AS total_runs, {_n('status <> prev')} AS flip_count
FROM (SELECT test_case_id, status, lag(status) OVER (PARTITION BY test_case_id ORDER BY run_at, id) AS prev FROM test_case_result
  WHERE run_at >= {AS_OF} - INTERVAL '14' DAY AND status IN ('PASSED', 'FAILED')) x GROUP BY test_case_id HAVING count(*) >= 5""",
    "v_flakes": f"""
SELECT test_case_id, identity_key, title, suite_name, total_runs, flip_count, rate AS flake_rate_pct, CASE WHEN rate >= 50 THEN 'HIGH' WHEN rate >= 20 THEN 'MED' ELSE 'LOW' END AS flake_severity, linked_jira_keys
FROM (SELECT f.test_case_id, t.identity_key, t.title, t.suite_name, f.total_runs, f.flip_count, {pct('f.flip_count', '(f.total_runs - 1)')} AS rate,
  (SELECT string_agg(DISTINCT l.issue_key, ', ' ORDER BY l.issue_key) FROM jira_automation_link l WHERE l.test_case_id = f.test_case_id) AS linked_jira_keys
  FROM v_flips f JOIN test_case t ON t.id = f.test_case_id) x""",
    "v_recent": f"""
SELECT t.suite_name, count(*) AS total_runs_14d, {_n("r.status = 'PASSED'")} AS pass_count, {_n("r.status = 'FAILED'")} AS fail_count, {_n("r.status = 'SKIPPED'")} AS skip_count, {_n("r.status = 'ERROR'")} AS error_count,
  {_n("r.status IN ('PASSED', 'FAILED', 'ERROR')")} AS judged, CAST(sum(r.duration_ms) FILTER (WHERE r.status = 'PASSED') AS BIGINT) AS ms
FROM test_case t JOIN test_case_result r ON r.test_case_id = t.id WHERE t.suite_name IS NOT NULL AND r.run_at >= {AS_OF} - INTERVAL '14' DAY GROUP BY t.suite_name""",
    "v_suites": f"""
SELECT s.suite_name, s.test_case_count, coalesce(r.total_runs_14d, 0) AS total_runs_14d, coalesce(r.pass_count, 0) AS pass_count, coalesce(r.fail_count, 0) AS fail_count, coalesce(r.skip_count, 0) AS skip_count,
  coalesce(r.error_count, 0) AS error_count, {pct('r.pass_count', 'r.judged')} AS pass_rate_pct, floor((2 * r.ms + 10 * r.pass_count) / nullif(20 * r.pass_count, 0)) / 100.0 AS avg_pass_duration_sec, l.last_run_at
FROM (SELECT suite_name, count(DISTINCT id) AS test_case_count FROM test_case WHERE suite_name IS NOT NULL GROUP BY suite_name) s LEFT JOIN v_recent r ON r.suite_name = s.suite_name
LEFT JOIN (SELECT t.suite_name, max(r.run_at) AS last_run_at FROM test_case t JOIN test_case_result r ON r.test_case_id = t.id GROUP BY t.suite_name) l ON l.suite_name = s.suite_name""",
}


def over_views(select: str) -> str:
    """A statement over the domain tables and the views."""
    views = ",\n".join(f"{n} AS ({text})" for n, text in VIEWS.items())
    return f"WITH {oracle_ctes()},\n{views}\n{select}"
