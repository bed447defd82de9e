"""Readers of reports and landed pages, and the streaming drain."""

import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from trialscope.operators.sections import section_paths
from trialscope.plans import ingest
from trialscope.sources import junit, landed, playwright
from trialscope.streaming.drain import drain_json, reprocess
from trialscope.streaming.tables import Kind, Store


def test_junit_file(spark, tmp_path):
    (tmp_path / "918.xml").write_text(
        '<testsuites><testsuite name="pytest" tests="3" failures="1" skipped="0" errors="0" time="3.6" timestamp="2026-03-14T10:00:00+02:00">'
        '<testcase classname="tests.test_invite" name="test_view_invitation" time="1.2"/>'
        '<testcase classname="tests.test_rsvp" name="test_rsvp_yes" time="2.4"><failure message="NotInteractable">line 1\nline 2</failure></testcase>'
        '<testcase classname="c" name="p" time="x"><properties><property name="jira" value="QAA-659 X-1"/><property name="TestRail.Case">C27088</property></properties></testcase>'
        "</testsuite></testsuites>"
    )
    suites = junit.read_suites(spark, str(tmp_path))
    s = suites.withColumn("build", junit.build_number(F.col("path"))).first()
    assert (s.build, s.total_count, s.pass_count, s.duration_ms, str(s.started_at)) == (918, 3, 2, 3600, "2026-03-14 08:00:00")
    cases = junit.read_cases(suites)
    got = {r.identity_key: r for r in cases.collect()}
    assert got["tests.test_invite::test_view_invitation"].status == "PASSED" and got["tests.test_invite::test_view_invitation"].duration_ms == 1200
    bad = got["tests.test_rsvp::test_rsvp_yes"]
    assert (bad.status, bad.duration_ms, bad.error_message, bad.stack_trace) == ("FAILED", 2400, "NotInteractable", "line 1\nline 2")
    assert got["c::p"].duration_ms is None
    assert sorted(r.issue_key for r in junit.property_keys(cases, ["Jira"]).collect()) == ["QAA-659"]
    assert [r.tr_case_id for r in junit.property_case_ids(cases, ["testrail.case"]).collect()] == [27088]
    assert junit.fingerprints(spark, str(tmp_path), "*.xml").first().bytes == (tmp_path / "918.xml").stat().st_size


def result(status, **more):
    return {"status": status, "duration": 10, "retry": 0, "errors": [], **more}


def test_playwright_paths_and_attempts(spark, tmp_path):
    spec = {"title": "logs in", "tags": ["@QAA-100"], "tests": [{"projectName": "chromium", "status": "flaky", "annotations": [{"type": "TestRail", "description": "C5"}], "results": [result("failed", errors=[{"message": "at /a/b.spec.ts:3:9 x"}], stdout=[{"text": "a"}, {"buffer": "Yg=="}], attachments=[{"name": "My Shot", "contentType": "image/png", "path": "p.png"}]), result("passed", retry=1)]}]}
    report = {
        "suites": [{"title": "f", "file": "tests/auth/login.spec.ts", "suites": [{"title": "Auth", "file": "", "specs": [], "suites": [{"title": "Login", "file": "", "specs": [spec]}]}, {"title": "dropped", "file": "tests/auth/login.spec.ts", "specs": [{**spec, "title": "flat", "tests": [{"projectName": "webkit", "status": "skipped", "results": []}]}]}]}],
        "stats": {"startTime": "2026-01-01T00:00:00.000Z", "duration": 1500, "expected": 0, "skipped": 1, "unexpected": 0, "flaky": 1},
    }
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    reports = playwright.read_reports(spark, str(tmp_path))
    e = playwright.executions(playwright.specs(reports))
    got = {r.test_id: r for r in e.collect()}
    assert set(got) == {"tests/auth/login.spec.ts::Auth > Login > logs in", "tests/auth/login.spec.ts::flat"}
    login = got["tests/auth/login.spec.ts::Auth > Login > logs in"]
    assert (login.status, login.duration_ms, login.issue_keys, login.case_ids) == ("FLAKY", 20, ["QAA-100"], [5])
    attempts = playwright.attempts(e)
    assert sorted((r.attempt_no, r.status) for r in attempts.collect()) == [(0, "FAILED"), (1, "PASSED")]
    (log,) = playwright.build_logs(attempts).collect()
    assert (log.log_type, log.content, log["bytes"]) == ("stdout", "ab", 2)
    (a,) = playwright.artifacts(e).collect()
    assert (a["name"], a.kind) == ("my_shot", "screenshot")
    run = playwright.runs(reports).first()
    assert run.status == "FLAKY" and str(run.finished_at) == "2026-01-01 00:00:01.500000"


def test_landed_cases_results_and_manifests(spark):
    pages = spark.createDataFrame([(json.dumps([{"id": 1, "title": "a", "section_id": 2, "suite_id": 9, "priority_id": 1, "custom_x": "y"}]),), (json.dumps({"cases": [{"id": 2, "title": "b", "section_id": 1, "suite_id": 9, "updated_on": 0}]}),)], "text string")
    paths = section_paths(spark.createDataFrame([(1, None, "top"), (2, 1, "sub")], "id long, parent_id long, name string"))
    got = sorted((r.tr_case_id, r.section_path, r.custom) for r in landed.cases(pages, paths).collect())
    assert got == [(1, "top / sub", {"custom_x": "y"}), (2, "top", {})]
    res = spark.createDataFrame([(json.dumps({"results": [{"id": 1, "case_id": 1, "run_id": 3, "status_id": 5, "created_on": 60}, {"id": 2, "case_id": None, "run_id": 3}, {"id": 3, "case_id": 8, "run_id": 3}]}),)], "text string")
    assert [r.tr_result_id for r in landed.results(res, spark.createDataFrame([(1,)], "tr_case_id long")).collect()] == [1]
    ok = {"schema": "1", "jobName": "j", "buildNumber": 4, "framework": "junit", "resultFiles": ["a.xml"]}
    files = spark.createDataFrame([("/in/j/4/manifest.json", json.dumps(ok)), ("/in/j/5/manifest-shard2.json", json.dumps({**ok, "framework": "mocha"})), ("/in/j/5/other.json", "{}")], "path string, text string")
    good, bad = landed.manifests(files)
    assert good.first().ciProvider == "jenkins" and [r.reason for r in bad.collect()] == ["unknown framework"]


def test_drain_reads_each_file_once_and_sets_bad_lines_aside(spark, tmp_path):
    inn = tmp_path / "in"
    inn.mkdir()
    store = Store(spark, f"{tmp_path}/t", {"t": Kind("id long, at string, x long", ("id",))})
    drain = lambda: drain_json(store, "t", str(inn), f"{tmp_path}/r", f"{tmp_path}/c", "at")
    rows = lambda: sorted(map(tuple, store.read("t").collect()))
    (inn / "a.json").write_text('{"id":1,"at":"1","x":1}\n{"id":1,"at":"2","x":2}\nnot json\n')
    drain()
    (inn / "b.json").write_text('{"id":2,"at":"5","x":5}\n{"id":1,"at":"2","x":2}\n')
    drain()
    drain()
    assert rows() == [(1, "2", 2), (2, "5", 5)]
    (inn / "late.json").write_text('{"id":2,"at":"2","x":9}\n')
    drain()
    assert rows() == [(1, "2", 2), (2, "5", 5)]
    good, bad = reprocess(spark, f"{tmp_path}/r", "id long, at string, x long", lambda d: d.withColumn("text", F.lit('{"id":9,"at":"1","x":0}')))
    assert [tuple(r) for r in good.collect()] == [(9, "1", 0)] and bad.count() == 0


def test_suites_nested_to_any_depth(spark):
    suite = {"title": "deep", "specs": [{"title": "leaf", "tests": [{"projectName": "p", "status": "expected", "results": []}]}]}
    for i in range(12):
        suite = {"title": f"s{i}", "suites": [suite]}
    reports = spark.createDataFrame([("r", json.dumps({"suites": [{"title": "f", "file": "f.ts", "suites": [suite]}]}))], "path string, text string")
    (got,) = playwright.executions(playwright.specs(reports)).collect()
    assert got.test_id == "f.ts::" + " > ".join([f"s{i}" for i in range(11, -1, -1)] + ["deep", "leaf"])


def test_attachments_and_logs_are_indexed(spark):
    a = spark.createDataFrame([("r", "t", "p", "shot", "screenshot", "b.png"), ("r", "t", "p", "shot", "screenshot", "a.png"), ("r", "t", "p", "trace", "trace", "t.zip")], "path string, test_id string, project string, name string, kind string, uri string")
    assert playwright.artifact_index(a).first().uris == {"shot": "a.png", "trace": "t.zip"}
    logs = spark.createDataFrame([("r", "t", "p", 0, "stdout"), ("r", "t", "p", 0, "stderr"), ("r", "t", "p", 1, "stderr")], "path string, test_id string, project string, attempt_no int, log_type string")
    assert sorted((r.attempt_no, r.log_uri) for r in playwright.log_uris(logs).collect()) == [(0, "t/p/0/stdout"), (1, None)]


def test_reports_and_pages_of_large_keys_are_bounded(spark):
    runs = spark.range(2600).select("id", F.when(F.col("id") < 2500, 1).otherwise(2 + F.col("id") % 2).cast("long").alias("test_case_id"), F.lit(10).alias("duration_ms"), F.when(F.col("id") == 7, "FAILED").otherwise("PASSED").alias("status"), F.lit("e").alias("error_text"))
    named = {c: F.lit("x").alias(c) for c in ("summary", "status", "issue_type", "priority", "parent_key")}
    issues = spark.range(2500).select(F.concat(F.lit("P-"), F.col("id").cast("string")).alias("issue_key"), F.lit("P").alias("project_key"), *named.values())
    v = SimpleNamespace(spark=spark, test_case_result=runs, test_execution=runs, jira_issue=issues)
    sizes = lambda texts, mark: sorted(t.count(mark) for t in texts)
    files = [r.value for r in spark.read.text(ingest.junit_reports(v), wholetext=True).collect()]
    assert 1 < len(files) <= 3
    xml = [x for f in files for x in f.split("<testsuite ")[1:]]
    for n, total in ((sizes(xml, "<testcase "), 2600), (sizes([r.text for r in ingest.playwright_reports(v).collect()], '"projectName"'), 2600), (sizes([r.text for r in ingest.issue_pages(v).collect()], '"key":"P-'), 2500)):
        assert sum(n) == total and n[-1] <= ingest.REPORT_ROWS
    assert {(r.suite_name, r.total_count, r.fail_count, r.pass_count, r.duration_ms) for r in ingest.junit_suites(v).collect()} == {("S1", 2500, 1, 2499, 1500), ("S2", 50, 0, 50, 1500), ("S3", 50, 0, 50, 1500)}
    assert ingest.junit_cases(v).count() == 2600 and ingest.playwright_executions(v).count() == 2600
    assert sorted((r.path, r.status) for r in ingest.playwright_runs(v).collect()) == [("1", "FAILED"), ("2", "PASSED"), ("3", "PASSED")]


def test_files_of_a_pattern_are_listed_in_one_look(spark, tmp_path):
    from trialscope.sources import scratch

    for name in ("b=2/part-1", "b=1/part-0", "b=1/other", "c/part-3"):
        scratch.put_text(spark, f"{tmp_path}/{name}", "x")
    assert [f.split(f"{tmp_path}/")[1] for f in scratch.matching(spark, f"{tmp_path}/b=*/part-*")] == ["b=1/part-0", "b=2/part-1"]
    assert scratch.matching(spark, f"{tmp_path}/none/*") == []


def test_ingests_of_links_number_no_tests_and_write_no_state(spark, monkeypatch):
    from trialscope.operators import ingest as job_ops
    from trialscope.plans import ingest as plans
    from trialscope.plans.views import Views

    names = []
    for module in (job_ops, plans):
        monkeypatch.setattr(module, "kept", lambda df, name, real=module.kept: (names.append(name), real(df, name))[1])
    assert plans.issue_link_ingest(Views(spark, "/root/testdata/sf0.001")).count() > 0
    assert names == ["junit-tests", "playwright-tests"]
    plans.log_ingest(Views(spark, "/root/testdata/sf0.001"))
    assert names[2:] == ["playwright-tests", "numbered-tests", "numbered-tests"]


def test_attempts_are_told_by_their_rows_and_the_last_of_a_number_counts(spark):
    from trialscope.operators import ingest as job_ops

    result = lambda status, retry, start, out: {"status": status, "duration": 5.0, "retry": retry, "startTime": start, "stdout": out and [{"text": t} for t in out]}
    early, late = "2024-02-01T00:00:00.000Z", "2024-02-02T00:00:00.000Z"
    tests = spark.createDataFrame([
        {"file": "f", "framework": "playwright", "identity_key": "once", "status": "FLAKY", "results": [result("failed", 0, early, ["a", "b"]), result("passed", None, late, [""])]},
        {"file": "f", "framework": "playwright", "identity_key": "twice", "status": "PASSED", "results": [result("failed", 0, late, None), result("passed", 0, early, ["x"]), result("passed", 2, early, ["y"])]},
        {"file": "f", "framework": "playwright", "identity_key": "none", "status": "SKIPPED", "results": None},
    ], job_ops.TESTS)
    builds = spark.sql("SELECT 'f' AS file, 'j' AS job_name, 1 AS build_number, 0 AS shard, CAST(NULL AS STRING) AS ci_provider, CAST(NULL AS STRING) AS branch, CAST(NULL AS STRING) AS build_url, CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at")
    found = job_ops.found_tables(tests, builds, spark.createDataFrame([], "issue_key string"))
    of = {r.result_id: r.identity_key for r in found["result"].collect()}
    attempts = found["attempt"].collect()
    assert sorted((of[r.result_id], r.attempt_no, r.status, r.log_uri is not None) for r in attempts) == [("once", 0, "FAILED", True), ("once", 1, "PASSED", False), ("twice", 0, "FAILED", False), ("twice", 2, "PASSED", True)]
    logs = {r.attempt_id: r.content for r in found["build_log"].collect()}
    assert {f"{k}/stdout" for k in logs} == {r.log_uri for r in attempts if r.log_uri} and sorted(logs.values()) == ["ab", "y"]
    assert all(w not in found["attempt"].where("job_name = 'j'")._jdf.queryExecution().optimizedPlan().toString() for w in ("Join LeftOuter",))
