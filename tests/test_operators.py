"""Goldens and properties of the test-analytics operators."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from trialscope.functions import text as tx
from trialscope.functions.measures import percent
from trialscope.operators import coverage, export, flake_job, governance, health, inference, merge, sections


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=str)


def test_percent_rounds_half_up_and_is_null_without_whole(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (0, 0), (2, 2), (1, 16)], "a long, b long")
    assert [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()] == [12.5, 33.3, None, 100.0, 6.3]


def test_best_link_prefers_confidence_then_provenance(spark):
    links = spark.createDataFrame([("A", 1, "INFERRED", "HIGH", 1), ("A", 1, "EXPLICIT", "MED", 2), ("A", 2, "INFERRED", "LOW", 1), ("A", 2, "MANUAL", "LOW", 1)], "issue_key string, test_case_id long, provenance string, confidence string, created_at long")
    assert rows(coverage.best_links(links, "test_case_id"), "test_case_id", "provenance") == [(1, "INFERRED"), (2, "MANUAL")]


def test_summaries_of_no_issues_have_one_row(spark):
    issues = spark.createDataFrame([], "issue_key string, issue_type string, summary string, status string, parent_key string, project_key string, priority string")
    auto = spark.createDataFrame([], "issue_key string, test_case_id long, provenance string, confidence string, created_at long")
    manual = spark.createDataFrame([], "issue_key string, tr_case_id long, provenance string, confidence string, created_at long")
    matrix = coverage.coverage_matrix(coverage.requirement_universe(issues), coverage.best_links(auto, "test_case_id"), coverage.best_links(manual, "tr_case_id"))
    (row,) = coverage.coverage_summary(matrix, dt.datetime(2024, 1, 1)).collect()
    assert row.total_issues == 0 and row.auto_pct is None


def test_windows_count_runs_of_both_eras(spark):
    links = spark.createDataFrame([("A", 1, "HIGH"), ("A", 2, "MED"), ("A", 3, "LOW"), ("B", 1, "HIGH")], "issue_key string, test_case_id long, confidence string")
    tests = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    at = lambda d: dt.datetime(2024, 1, d)
    junit = spark.createDataFrame([(1, "SKIPPED", at(20)), (1, "PASSED", at(2)), (3, "PASSED", at(20))], "test_case_id long, status string, run_at timestamp_ntz")
    play = spark.createDataFrame([(2, "FLAKY", at(21))], "test_case_id long, status string, run_at timestamp_ntz")
    out = coverage.auto_executed(links, tests, coverage.test_runs(junit, play), dt.datetime(2024, 1, 25), 7)
    assert rows(out, "issue_key", "linked_test_count", "executed_test_count", "any_passed", "any_failed") == [("A", 2, 1, True, False), ("B", 1, 0, False, False)]


def test_flips_skip_other_statuses(spark):
    statuses = ["PASSED", "FAILED", "SKIPPED", "PASSED", "FAILED", "PASSED"]
    runs = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 10 + i), s) for i, s in enumerate(statuses)] + [(10 + i, 2, dt.datetime(2024, 1, 10 + i), "PASSED") for i in range(5)], "id long, test_case_id long, run_at timestamp_ntz, status string")
    tests = spark.createDataFrame([(1, "k1", "login", "s"), (2, "k2", "rsvp", "s")], "id long, identity_key string, title string, suite_name string")
    links = spark.createDataFrame([("B-2", 1), ("A-1", 1), ("A-1", 1)], "issue_key string, test_case_id long")
    out = health.flake_candidates(runs, tests, links, dt.datetime(2024, 1, 17))
    assert rows(out, "title", "total_runs", "flip_count", "flake_rate_pct", "flake_severity", "linked_jira_keys") == [("login", 5, 4, 100.0, "HIGH", "A-1, B-2"), ("rsvp", 5, 0, 0.0, "LOW", None)]


def test_governance_on_a_small_graph(spark):
    tests = spark.createDataFrame([(1, "k1", "t1", "s"), (2, "k2", "t2", "s"), (3, "k3", "t3", None)], "id long, identity_key string, title string, suite_name string")
    links = spark.createDataFrame([("A", 1, "INFERRED", "LOW", 1), ("A", 1, "EXPLICIT", "HIGH", 1), ("A", 2, "INFERRED", "LOW", 2)], "issue_key string, test_case_id long, provenance string, confidence string, created_at long")
    issues = spark.createDataFrame([("A", "sum", "Story")], "issue_key string, summary string, issue_type string")
    assert rows(governance.unreviewed_links(links, tests, issues), "test_case_id") == [(2,)]
    assert tuple(governance.orphan_summary(tests, links).first()) == (3, 1, 33.3, 1, 1, 1)


FLAKES = {"login": "P" * 10, "payment": "P" * 2 + "F" * 8, "send": "P" * 5 + "F" * 3 + "K" * 2, "concurrent": "P" * 6 + "K" * 4, "filter": "FFF"}
ERRORS = {"payment": ["Timeout: page timed out"] * 8, "send": ["expected a", "expected b", "expected c", "expected a", "expected b"], "concurrent": ["conflict at 10:5"] * 4, "filter": ["x"] * 3}


def test_flake_scenarios(spark):
    data, n = [], 0
    for i, (name, runs) in enumerate(FLAKES.items()):
        errors = iter(ERRORS.get(name, []))
        for r in runs:
            n += 1
            data.append((i, {"P": "PASSED", "F": "FAILED", "K": "FLAKY"}[r], dt.datetime(2026, 3, 1, 1, n % 60), None if r == "P" else next(errors)))
    df = spark.createDataFrame(data, "test_case_id long, status string, run_at timestamp_ntz, error_text string")
    groups = flake_job.flake_groups(df, dt.datetime(2026, 3, 12))
    out = flake_job.flake_decisions(groups, dt.datetime(2026, 3, 12))
    assert rows(out, "test_case_id", "flake_score", "classification", "recommended_action") == [(1, 0.2, "INFRA", "rerun"), (2, 0.5, "TEST_CODE", "quarantine"), (3, 0.4, "PRODUCT_BUG", "assign")]
    assert out.where("test_case_id = 2").first().notes == "10 run(s) in window: 5 passed, 3 failed, 2 flaky, 0 error. Score=50.0% class=TEST_CODE uniqueErrorHashes=3"


def test_embedded_keys(spark):
    tests = spark.createDataFrame(
        [(1, "QAA-100::login", "t", None), (2, "a", "PROJ-42 and QAA-101", None), (3, "b", "QAA-200", None), (4, "c", "d", "suite PROJ-99"), (5, "QAA-100_QAA-101", "x", None), (6, "e", "NOPE-1", None), (7, "plain", "test", "s")],
        "id long, identity_key string, title string, suite_name string",
    )
    known = spark.createDataFrame([(k,) for k in ("QAA-100", "QAA-101", "QAA-200", "PROJ-42", "PROJ-99")], "issue_key string")
    links, skipped = inference.embedded_key_links(tests, known)
    assert links.count() == 7 and rows(skipped, "issue_key") == [("NOPE-1",)]
    assert links.where("test_case_id = 4").first().evidence == 'Jira key found in suite_name: "suite PROJ-99"'


def test_keys_and_ids(spark):
    df = spark.createDataFrame([("test_QAA-100_x AQAA-7 QAA-12 TR-C5 @C77 spec2",)], "t string")
    lenient, strict, ids = df.select(tx.issue_keys(F.col("t")), tx.issue_keys_strict(F.col("t")), tx.case_ids(F.col("t"))).first()
    assert lenient == ["QAA-100", "AQAA-7", "QAA-12"] and strict == ["AQAA-7", "QAA-12"] and ids == [5, 77, 2]


@pytest.mark.parametrize("least", [0.2, 0.4, 0.45, 0.8])
def test_jaccard_pairs_equal_all_pairs(spark, least):
    import random

    rnd = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    sets = [sorted(set(rnd.choices(words, k=rnd.randint(1, 8)))) for _ in range(60)]
    a = [(i, s, len(s)) for i, s in enumerate(sets[:30])]
    b = [(i, s, len(s)) for i, s in enumerate(sets[30:])]
    want = sorted((i, k) for (i, x, _), (k, y, _) in itertools.product(a, b) if len(set(x) & set(y)) / len(set(x) | set(y)) >= least)
    frame = lambda d: spark.createDataFrame(d, "id long, tokens array<string>, n int")
    got = inference.jaccard_pairs(frame(a), frame(b), least)
    assert [x[:2] for x in rows(got, "a", "b", "score")] == sorted(want, key=str) or sorted((r.a, r.b) for r in got.collect()) == want


def test_merge_policies_and_idempotence(spark):
    target = spark.createDataFrame([(1, None, "a", 5), (2, "p", "b", 6)], "id long, part string, name string, n long")
    source = spark.createDataFrame([(1, None, None, 7), (3, None, "c", 8)], "id long, part string, name string, n long")
    policy = {"name": merge.NEW_UNLESS_NULL, "n": merge.OLD_UNLESS_NULL}
    once = merge.merge(target, source, ["id", "part"], policy)
    assert rows(once) == [(1, None, "a", 5), (2, "p", "b", 6), (3, None, "c", 8)]
    assert rows(merge.merge(once, source, ["id", "part"], policy)) == rows(once)
    assert rows(merge.insert_if_absent(target, source, ["id", "part"])) == [(1, None, "a", 5), (2, "p", "b", 6), (3, None, "c", 8)]


def test_section_paths_with_gaps_and_cycles(spark):
    df = spark.createDataFrame([(1, None, "root"), (2, 1, "mid"), (3, 2, "leaf"), (4, 99, "lost"), (5, 6, "x"), (6, 5, "y")], "id long, parent_id long, name string")
    assert dict(rows(sections.section_paths(df))) == {1: "root", 2: "root / mid", 3: "root / mid / leaf", 4: "lost", 5: "? / y / x", 6: "? / x / y"}


def test_snapshots_once_a_day(spark):
    row = spark.createDataFrame([(None, dt.datetime(2024, 1, 2, 5))], "auto_pct double, taken_at timestamp_ntz")
    first = export.append_snapshot(row.limit(0), export.snapshot_row(row.drop("taken_at").withColumn("as_of_date", F.lit(None)), dt.datetime(2024, 1, 2)))
    assert rows(first, "auto_pct") == [(0.0,)] and export.append_snapshot(first, row).count() == 1 and export.append_snapshot(first, row, force=True).count() == 2


def test_high_water_mark_is_null_if_a_group_has_none(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 2)), ("b", None)], "g string, m timestamp_ntz")
    assert merge.high_water_mark(df, "g", "m").first().since is None
    assert merge.high_water_mark(df.where("g = 'a'"), "g", "m").first().since == dt.datetime(2024, 1, 1, 23)


def test_export_prefers_annotations(spark):
    ex = spark.createDataFrame([(1, 10, "t", "FAILED", "boom", 65000, [7]), (1, 10, "t", "PASSED", None, 400, [])], "run_id long, test_case_id long, title string, status string, error_text string, duration_ms long, annotation_ids array<bigint>")
    links = spark.createDataFrame([(10, 3), (10, 4)], "test_case_id long, tr_case_id long")
    got = rows(export.export_results(ex, links))
    assert got == [(1, 3, 1, "Playwright: PASSED\nTest: t", "0s"), (1, 4, 1, "Playwright: PASSED\nTest: t", "0s"), (1, 7, 5, "Playwright: FAILED\nFailure:\nboom\nTest: t", "1m 5s")]


def test_names_and_environments(spark):
    df = spark.createDataFrame([("origin/main", None, 7, "abcdefghij", dt.datetime(2024, 1, 31), {"a": "1", "b": "2"}, '{"b":"3"}'), ("dev", "job", None, "abcdefghij", dt.datetime(2024, 1, 31), None, "not json")], "ref string, job string, build int, id string, at timestamp_ntz, env map<string,string>, extra string")
    got = df.select(tx.branch_name(F.col("ref")), tx.run_name(F.col("job"), F.col("build"), F.col("id"), F.col("at")), tx.merged_env(F.col("env"), F.col("extra"))).collect()
    assert [tuple(r) for r in got] == [("main", "playwright #7 — 2024-01-31", {"a": "1", "b": "3"}), ("dev", "job abcdefgh — 2024-01-31", {})]
