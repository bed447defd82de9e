"""The store of tables that change together, and the drain of manifests into it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trialscope.operators import ingest as job_ops
from trialscope.sources.scratch import as_qualified, kept, listing, qualified, scope, shared_dir
from trialscope.streaming import tables
from trialscope.streaming.drain import drain_manifests, drain_some, pending_manifests, reprocess_failed
from trialscope.streaming.tables import Change, Kind, Store, newest

FACT, DIM = Kind("job string, build int, x long", ("job", "build", "x"), ("job", "build")), Kind("id long, x long", ("id",))


def facts(spark, *builds, n=3, x=0):
    return spark.createDataFrame([(j, b, x + i) for j, b in builds for i in range(n)], FACT.schema)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_crash_at_any_step_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch):
    kinds = {"a": FACT, "b": DIM, "c": DIM}
    store = Store(spark, f"{tmp_path}/s", kinds)
    dim = lambda x: spark.createDataFrame([(i, x) for i in range(5)], DIM.schema)
    change = lambda x: {"a": Change(facts(spark, ("j", x))), "b": Change(dim(x)), "c": Change(dim(x))}
    store.commit(change(1), "stream", 0)
    bound = store.snapshot()

    def state(of):
        return [sorted(map(tuple, of.read(name).collect())) for name in kinds]

    before = state(store)
    real = {name: getattr(Store, name) for name in ("_write", "_told", "_seal")}
    written = []

    def dies_after(n):
        def write(self, name, *rest):
            if len(written) == n:
                raise RuntimeError("killed")
            written.append(name)
            return real["_write"](self, name, *rest)

        return write

    for n in range(3):
        written.clear()
        monkeypatch.setattr(Store, "_write", dies_after(n))
        with pytest.raises(RuntimeError):
            store.commit(change(2), "stream", 1)
        assert state(store) == before
    monkeypatch.setattr(Store, "_write", real["_write"])
    for step, broken in (("put_text", lambda *_: (_ for _ in ()).throw(RuntimeError("killed"))), ("put_once", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))):
        with monkeypatch.context() as m:
            m.setattr(tables, step, broken)
            with pytest.raises(RuntimeError):
                store.commit(change(2), "stream", 1)
        assert state(store) == before
    store.commit(change(2), "stream", 1)
    after = state(store)
    assert after != before and state(bound) == before  # a reader stays with its snapshot
    store.commit(change(3), "stream", 1)  # the batch again: it was committed
    assert state(store) == after
    assert {len(listing(spark, f"{tmp_path}/s/{name}")) for name in ("b", "c")} == {2}  # what the crashes left has gone
    with pytest.raises(FileExistsError):
        tables.put_once(spark, f"{tmp_path}/s/snapshots/2.json", "{}")


def test_a_new_build_touches_new_parts_only(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", {"f": FACT}, part_rows=1000)
    old = spark.range(10_000).select(F.lit("j").alias("job"), F.col("id").cast("int").alias("build"), F.col("id").alias("x"))
    store.commit({"f": Change(old)})
    parts = store.snapshot().parts("f")
    assert 8 <= len(parts) <= 12 and sum(p.rows for p in parts) == 10_000 and all(a.high < b.low for a, b in zip(parts, parts[1:], strict=False))
    before = files(tmp_path)
    store.commit({"f": Change(facts(spark, ("j", 10_001)))})
    store.commit({"f": Change(facts(spark, ("a", 5), ("k", 7)))})
    now = files(tmp_path)
    assert all(now[f] == t for f, t in before.items()) and len(now) == len(before) + 3  # before, behind and between others
    assert len(store.snapshot().parts("f")) == len(parts) + 3
    store.commit({"f": Change(facts(spark, ("j", 5000), x=-9))})  # a build in the middle rewrites its own part
    again = store.snapshot().parts("f")
    assert len({p.path for p in again} & {p.path for p in parts}) == len(parts) - 1 and store.read("f").count() == 10_012
    one = store.snapshot()
    point = FACT.point("j", 5000)
    assert one.read("f", point, point).where("build = 5000").count() == 4 and len(one.read("f", point, point).inputFiles()) == 1
    assert one.read("f", FACT.point("k"), FACT.point("k")).count() == 3


def test_small_parts_are_joined_and_large_ones_split(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", {"f": FACT}, part_rows=40)
    for b in (*range(0, 8), 20):
        store.commit({"f": Change(facts(spark, ("j", b)))})
    rows = sorted(map(tuple, store.read("f").collect()))
    assert len(store.snapshot().parts("f")) == 9
    now = store.compact("f")
    assert len(now.parts("f")) == 1 and sorted(map(tuple, store.read("f").collect())) == rows and store.compact("f").number == now.number
    big = Store(spark, store.path, store.kinds, part_rows=9)
    assert len(big.compact("f").parts("f")) >= 2 and sorted(map(tuple, big.read("f").collect())) == rows


def test_hashed_tables_keep_the_newest_row_of_a_key(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", {"d": DIM}, part_rows=20)
    rows = lambda *pairs: Change(spark.createDataFrame(pairs, DIM.schema), newest(("id",), [F.desc("x")]))
    assert store.read("d").count() == 0
    store.commit({"d": rows(*((i, 1) for i in range(50)))})
    store.commit({"d": rows((3, 3), (4, 0), (None, 7), (77, 1))})
    assert sorted(map(tuple, store.read("d").where("id in (3, 4, 77) or id is null").collect()), key=str) == [(3, 3), (4, 1), (77, 1), (None, 7)]
    parts = store.snapshot().parts("d")
    assert sum(p.rows for p in parts) == 52 and all(a.high < b.low for a, b in zip(parts, parts[1:], strict=False))


def suite(*cases):
    return '<testsuite name="s" timestamp="2024-01-05T00:00:00Z">' + "".join(cases) + "</testsuite>"


def case(name, time=1, inner=""):
    return f'<testcase classname="a" name="{name}" time="{time}">{inner}</testcase>'


def drop_zone(spark, tmp_path, name="s"):
    known = spark.createDataFrame([("QAA-1",)], "issue_key string"), spark.createDataFrame([(7,)], "tr_case_id long")
    return Store(spark, f"{tmp_path}/{name}", job_ops.KINDS), known


def land(folder, files=(), **manifest):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "manifest.json").write_text(json.dumps({"schema": "1", "jobName": "j", "buildNumber": 1, "framework": "junit", "resultFiles": list(files), **manifest}))


def test_two_manifests_of_one_build_lose_nothing(spark, tmp_path):
    store, known = drop_zone(spark, tmp_path)
    for k in (1, 2):
        land(tmp_path / "in" / str(k), ["r.xml"])
        (tmp_path / "in" / str(k) / "r.xml").write_text(suite(case("t"), case(f"own{k}", inner="<skipped/>")))
        drain_manifests(store, f"{tmp_path}/in", *known, f"{tmp_path}/c")
    results = job_ops.numbered_results(store.read("result")).collect()
    assert sorted((r.identity_key, r.attempt) for r in results) == [("a::own1", 1), ("a::own2", 1), ("a::t", 1), ("a::t", 2)]
    (run,) = job_ops.run_totals(store.read("run")).collect()
    assert (run.tests, run.passed, run.skipped, run.failed, run.files, run.status) == (4, 2, 2, 0, 2, "PASSED")
    # The same manifest again, with less in its file: what the file brought before goes.
    (tmp_path / "in" / "2" / "r.xml").write_text(suite(case("t")))
    drain_manifests(store, f"{tmp_path}/in", *known, f"{tmp_path}/another-checkpoint")
    assert store.read("result").count() == 3 and job_ops.run_totals(store.read("run")).first().tests == 3


def test_paths_in_every_spelling_and_nothing_left_behind(spark, tmp_path):
    store, known = drop_zone(spark, tmp_path)
    at = tmp_path / "in" / "a b+c%d"
    spellings = ["r 1.xml", f"{at}/r2.xml", f"file:{at}/r3.xml", f"file://{at}/r4.xml", f"file://localhost{at}/r5.xml"]
    land(at, spellings)
    for i, name in enumerate(("r 1.xml", "r2.xml", "r3.xml", "r4.xml", "r5.xml")):
        (at / name).write_text(suite(case(f"t{i}", inner='<properties><property name="jira" value="QAA-1 QAA-2"/><property name="testrail" value="C7, C8"/></properties>')))
    before = listing(spark, shared_dir(spark))
    drain_manifests(store, f"{tmp_path}/in", *known, f"{tmp_path}/c")
    assert listing(spark, shared_dir(spark)) == before
    (status,) = store.read("batch").collect()
    assert (status.status, status.files, status.tests, status.links, status.unknown_issues, status.unknown_cases) == ("ok", 5, 5, 5, 5, 5)
    assert {r.issue_key for r in store.read("link").collect()} == {"QAA-1"} and {r.tr_case_id for r in store.read("case_link").collect()} == {7}
    told = spark.read.text(str(at), wholetext=True).select(as_qualified(F.col("_metadata.file_path")).alias("p")).collect()
    assert {r.p for r in told} >= {qualified(spark, f"{at}/r 1.xml"), qualified(spark, f"file://{at}/r2.xml")}


def test_failed_batches_are_kept_and_reprocessed(spark, tmp_path):
    store, known = drop_zone(spark, tmp_path)
    folder = tmp_path / "in" / "j" / "1"
    land(folder, ["a.xml"])
    drain = lambda: drain_manifests(store, f"{tmp_path}/in", *known, f"{tmp_path}/c")
    drain()
    (status,) = store.read("batch").collect()
    assert status.status == "failed" and status.error.startswith("missing: ") and store.read("result").count() == 0
    (folder / "a.xml").write_text(suite(case("n", 1), case("n", 2)))
    drain()  # a manifest is read once
    assert store.read("result").count() == 0
    for _ in range(2):
        reprocess_failed(store, *known)
    (status,) = store.read("batch").collect()
    assert (status.status, status.error, status.tests) == ("ok", None, 2)
    assert sorted((r.identity_key, r.nth, r.duration_ms) for r in store.read("result").collect()) == [("a::n", 1, 1000), ("a::n", 2, 2000)]
    (build,) = store.read("build").collect()
    assert str(build.started_at) == "2024-01-05 00:00:00"  # none was given: the report's own


def test_a_limited_drain_stops_and_a_dry_one_writes_nothing(spark, tmp_path):
    store, known = drop_zone(spark, tmp_path)
    for k in range(3):
        land(tmp_path / "in" / str(k), ["r.xml"], buildNumber=k)
        (tmp_path / "in" / str(k) / "r.xml").write_text(suite(case("t")))
    land(tmp_path / "in" / "bad", ["r.xml"], framework="mocha")
    dry = drain_some(store, f"{tmp_path}/in", *known, dry_run=True).collect()
    assert sorted(r.status for r in dry) == ["dry", "dry", "dry", "failed"] and store.numbers() == []
    assert drain_some(store, f"{tmp_path}/in", *known, limit=2).count() == 2
    assert store.read("batch").count() == 2 and pending_manifests(store, f"{tmp_path}/in").count() == 2
    drain_some(store, f"{tmp_path}/in", *known)
    assert drain_some(store, f"{tmp_path}/in", *known).count() == 0 and store.read("build").count() == 3


def test_attempts_logs_and_artifacts_of_a_drained_report(spark, tmp_path):
    store, known = drop_zone(spark, tmp_path)
    shots = [{"name": "Deep", "contentType": "image/png", "path": "/ci/x/t1/shot.png"}, {"name": "Flat", "contentType": "image/png", "path": "/ci/x/t9/flat.png"}, {"name": "Lost", "contentType": "video/webm", "path": "/ci/x/t1/gone.webm"}]
    results = [{"status": "failed", "retry": 0, "duration": 5, "errors": [{"message": "e"}], "stdout": [{"text": "o"}], "stderr": [{"text": "x"}], "attachments": shots}, {"status": "passed", "retry": 1, "duration": 7, "errors": [], "attachments": []}]
    spec = {"title": "logs in", "tags": ["@QAA-1", "@C7", "@C9"], "tests": [{"projectName": "p", "status": "flaky", "results": results}]}
    folder = tmp_path / "in" / "1"
    land(folder, ["r.json"], framework="playwright", artifactFiles=["t1/shot.png", "other/shot.png", "flat.png"])
    report = lambda s: (folder / "r.json").write_text(json.dumps({"suites": [{"title": "f", "file": "f.ts", "specs": [s]}]}))
    report(spec)
    known = known[0], spark.createDataFrame([(7,)], "tr_case_id long")
    for again in range(2):
        drain_manifests(store, f"{tmp_path}/in", *known, f"{tmp_path}/c{again}")
        attempts = store.read("attempt").orderBy("attempt_no").collect()
        assert [(a.attempt_no, a.status, a.duration_ms, a.log_uri is not None) for a in attempts] == [(0, "FAILED", 5, True), (1, "PASSED", 7, False)]
        assert sorted((r.log_type, r.content) for r in store.read("build_log").collect()) == [("stderr", "x"), ("stdout", "o")]
        found = {r["name"]: r.uri for r in store.read("artifact").collect()}
        at = qualified(spark, str(folder))
        assert found == {"deep": f"{at}/artifacts/t1/shot.png", "flat": f"{at}/artifacts/flat.png"}
        (status,) = store.read("batch").collect()
        assert (status.lost_artifacts, status.links, status.unknown_cases) == (1, 1, 1)
    report({**spec, "tests": [{"projectName": "p", "status": "expected", "results": results[1:]}]})
    drain_manifests(store, f"{tmp_path}/in", *known, f"{tmp_path}/c2")
    assert [store.read(n).count() for n in ("attempt", "build_log", "artifact", "result")] == [1, 0, 0, 1]


def test_a_drain_broadcasts_neither_tests_nor_what_is_known(spark, tmp_path):
    """Both grow with the input, and compressed files tell little of the rows that they hold: only rows per file are sent to all tasks."""
    store, known = drop_zone(spark, tmp_path)
    prop = '<properties><property name="jira" value="QAA-1"/><property name="testrail" value="C7"/></properties>'
    land(tmp_path / "in" / "a", ["r.xml"])
    (tmp_path / "in" / "a" / "r.xml").write_text(suite(*(case(f"t{i}", inner=prop) for i in range(2000))))
    with scope(spark):
        found, status = job_ops.read_batches(pending_manifests(store, f"{tmp_path}/in"), *(kept(k, "known") for k in known))
        joins = [line for df in found.values() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert joins and not [line for line in joins if "BuildLeft" in line or "issue_key#" in line or "tr_case_id#" in line]
        assert status.first()["tests"] == 2000 and found["link"].count() == found["case_link"].count() == 2000


def test_a_scope_drops_what_was_kept_in_it(spark):
    before = listing(spark, shared_dir(spark))
    with pytest.raises(ZeroDivisionError), scope(spark):
        assert kept(spark.range(3), "x").count() == 3 and len(listing(spark, shared_dir(spark))) == len(before) + 1
        raise ZeroDivisionError
    assert listing(spark, shared_dir(spark)) == before
