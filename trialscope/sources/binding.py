"""The domain tables, derived from the synthetic tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: SQL of each domain table over the synthetic ones; the same text serves Spark and DuckDB.
SQL = {
    "jira_issue": """
SELECT concat('P', CAST(p_size % 7 AS STRING), '-', CAST(p_partkey AS STRING)) AS issue_key, p_partkey,
  CASE p_partkey % 10 WHEN 0 THEN 'Epic' WHEN 1 THEN 'Sub-task' WHEN 2 THEN 'Bug' WHEN 3 THEN 'Task' ELSE 'Story' END AS issue_type,
  p_name AS summary,
  CASE p_partkey % 8 WHEN 0 THEN 'Cancelled' WHEN 1 THEN NULL ELSE 'Open' END AS status,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('E-', CAST((p_partkey % 40) * 10 AS STRING)) END AS parent_key,
  concat('P', CAST(p_size % 7 AS STRING)) AS project_key,
  CASE p_size % 6 WHEN 0 THEN 'Highest' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' WHEN 4 THEN 'Lowest' ELSE NULL END AS priority
FROM {part}""",
    "test_case": "SELECT c_custkey AS id, concat('test_', c_name) AS title, c_name AS identity_key, c_mktsegment AS suite_name FROM {customer}",
    "jira_automation_link": """
SELECT issue_key, test_case_id, provenance,
  CASE MIN(conf_rank) WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS confidence, MIN(created_at) AS created_at
FROM (SELECT ji.issue_key,
    o.o_custkey % (SELECT CAST(floor(count(*) / 5.0) AS BIGINT) FROM {customer}) AS test_case_id,
    CASE l.l_linenumber % 3 WHEN 0 THEN 'EXPLICIT' WHEN 1 THEN 'INFERRED' ELSE 'MANUAL' END AS provenance,
    CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS conf_rank, l.l_shipdate AS created_at
  FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {jira_issue} ji ON ji.p_partkey = l.l_partkey
  WHERE l.l_quantity >= 49) x
GROUP BY issue_key, test_case_id, provenance""",
    "testrail_case": """
SELECT s.s_suppkey AS tr_case_id, s.s_name AS title, concat(r.r_name, ' / ', n.n_name) AS section_path
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    "jira_testrail_link": """
SELECT issue_key, tr_case_id, provenance,
  CASE MIN(conf_rank) WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS confidence, MIN(created_at) AS created_at
FROM (SELECT ji.issue_key, l.l_suppkey AS tr_case_id,
    CASE l.l_linenumber % 3 WHEN 0 THEN 'EXPLICIT' WHEN 1 THEN 'INFERRED' ELSE 'MANUAL' END AS provenance,
    CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS conf_rank, l.l_shipdate AS created_at
  FROM {lineitem} l JOIN {jira_issue} ji ON ji.p_partkey = l.l_partkey WHERE l.l_quantity <= 2) x
GROUP BY issue_key, tr_case_id, provenance""",
    "testrail_result": """
SELECT DISTINCT (l_orderkey * 8 + l_linenumber) AS tr_run_id, l_suppkey AS tr_case_id,
  CAST(1 + (l_linenumber - 1) % 5 AS INT) AS status_id, l_shipdate + INTERVAL '8122' DAY AS tested_at
FROM {lineitem}""",
    "test_case_result": """
SELECT event_id AS id, user_id AS test_case_id, ts AS run_at,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED' WHEN 'click' THEN 'ERROR' ELSE 'PASSED' END AS status,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms
FROM {events} WHERE event_id % 3 <> 0""",
    "test_execution": """
SELECT event_id AS id, user_id AS test_case_id, ts AS run_at,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED' WHEN 'click' THEN 'FLAKY' ELSE 'PASSED' END AS status,
  CASE WHEN event_type IN ('error', 'click') THEN substr(props, 1, 8) ELSE NULL END AS error_text
FROM {events} WHERE event_id % 3 = 0""",
    "automation_testrail_link": """
SELECT DISTINCT o.o_custkey % (SELECT CAST(floor(count(*) / 5.0) AS BIGINT) FROM {customer}) AS test_case_id, l.l_suppkey AS tr_case_id
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity = 25""",
}

_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass
class Domain:
    """The domain tables of one folder, each read when it is first asked for."""

    spark: SparkSession
    sf_dir: str

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _bound(self, name: str) -> DataFrame:
        text = SQL[name]
        needed = {t: self.base(t) for t in _BASE if "{" + t + "}" in text}
        if "{jira_issue}" in text:
            needed["jira_issue"] = self.jira_issue
        return self.spark.sql(text, **needed)

    @cached_property
    def jira_issue(self) -> DataFrame:
        return self._bound("jira_issue")

    @cached_property
    def test_case(self) -> DataFrame:
        return self._bound("test_case")

    @cached_property
    def jira_automation_link(self) -> DataFrame:
        return self._bound("jira_automation_link")

    @cached_property
    def testrail_case(self) -> DataFrame:
        return self._bound("testrail_case")

    @cached_property
    def jira_testrail_link(self) -> DataFrame:
        return self._bound("jira_testrail_link")

    @cached_property
    def testrail_result(self) -> DataFrame:
        return self._bound("testrail_result")

    @cached_property
    def test_case_result(self) -> DataFrame:
        return self._bound("test_case_result")

    @cached_property
    def test_execution(self) -> DataFrame:
        return self._bound("test_execution")

    @cached_property
    def automation_testrail_link(self) -> DataFrame:
        return self._bound("automation_testrail_link")


def oracle_ctes() -> str:
    """The same tables as common table expressions."""
    names = dict.fromkeys((*_BASE, *SQL))
    return ",\n".join(f"{n} AS ({text.format(**{t: t for t in names})})" for n, text in SQL.items())
