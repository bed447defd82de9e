"""What leaves the tables: snapshots, result payloads, artifact retention and URIs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.functions.measures import moment
from trialscope.functions.text import elapsed, run_name, truncated
from trialscope.operators.merge import CONFIDENCE_RANK

#: Result codes of the manual-test tool, and how long artifacts are kept by suffix (days).
RESULT_CODE = {"PASSED": 1, "FAILED": 5, "FLAKY": 4, "SKIPPED": 3, "ERROR": 5}
RETENTION = {"webm": 30, "mp4": 30, "png": 90, "jpg": 90, "jpeg": 90, "zip": 90, "txt": 90, "log": 90}
MISSING = "gs://MISSING"


def snapshot_row(summary: DataFrame, as_of: dt.datetime) -> DataFrame:
    """A KPI row of the executed-coverage summary; null shares become 0."""
    shares = [c for c in summary.columns if c.endswith("_pct")]
    return summary.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in shares}).withColumn("taken_at", moment(as_of)).drop("as_of_date")


def append_snapshot(history: DataFrame, row: DataFrame, force: bool = False) -> DataFrame:
    """history with the row, unless its day has one already (or force)."""
    if force:
        return history.unionByName(row)
    days = history.select(F.to_date("taken_at").alias("_day")).distinct()
    return history.unionByName(row.join(days, F.to_date("taken_at") == F.col("_day"), "left_anti"))


def result_code(status: Column) -> Column:
    out = F.lit(5)
    for name, code in RESULT_CODE.items():
        out = F.when(status == name, F.lit(code)).otherwise(out)
    return out


def export_results(executions: DataFrame, links: DataFrame) -> DataFrame:
    """run_id, case_id, status_id, comment, elapsed of executions and the cases they stand for.

    executions has run_id, test_case_id, title, status, error_text, duration_ms, annotation_ids; links
    has test_case_id, tr_case_id. Annotated case ids take the place of links.
    """
    linked = links.groupBy("test_case_id").agg(F.sort_array(F.collect_set("tr_case_id")).alias("_linked"))
    cases = F.when(F.size("annotation_ids") > 0, F.col("annotation_ids")).otherwise(F.col("_linked"))
    failure = F.when(F.col("error_text").isNotNull() & (F.col("error_text") != ""), F.concat(F.lit("\nFailure:\n"), truncated(F.col("error_text"), 500, "…"))).otherwise("")
    comment = F.concat(F.lit("Playwright: "), "status", failure, F.lit("\nTest: "), "title")
    rows = executions.join(linked, "test_case_id", "left").withColumn("case_id", F.explode(cases))
    return rows.select("run_id", "case_id", result_code(F.col("status")).alias("status_id"), comment.alias("comment"), elapsed(F.col("duration_ms")).alias("elapsed"))


def annotation_case_ids(annotations: Column) -> Column:
    """Case ids of the annotations of type TestRail: numbers with or without a C before them."""
    told = F.filter(F.coalesce(annotations, F.array().cast("array<struct<type:string,description:string>>")), lambda n: n["type"] == "TestRail")
    ids = F.flatten(F.transform(told, lambda n: F.regexp_extract_all(F.coalesce(n["description"], F.lit("")), F.lit(r"[Cc]?(\d+)"), 1)))
    return F.array_distinct(F.transform(ids, lambda x: x.try_cast("long")))


def confident_links(links: DataFrame, least: str = "MED") -> DataFrame:
    """Links whose confidence is `least` or more; unknown confidence is less than any."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair)), F.col("confidence")), F.lit(0))
    return links.where(rank >= CONFIDENCE_RANK[least])


def selected_runs(runs: DataFrame, run_id=None, job: str | None = None, build: int | None = None, since: dt.datetime | None = None) -> DataFrame:
    """The runs (run_id, job_name, build_number, created_at) of an id, else of a job's build, else created since a moment."""
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id)
    if job is not None and build is not None:
        return runs.where((F.col("job_name") == job) & (F.col("build_number") == build))
    if since is not None:
        return runs.where(F.col("created_at") >= moment(since))
    raise ValueError("a run id, a job and build, or a moment must be given")


def export_runs(runs: DataFrame, executions: DataFrame, links: DataFrame, least: str = "MED") -> tuple[DataFrame, DataFrame]:
    """(headers, payload) of the result export of runs.

    headers: run_id, name, case_ids (distinct, sorted), n_results of runs that have any; payload: as
    export_results() gives it, over links of `least` confidence or more.
    """
    payload = export_results(executions.join(runs.select("run_id"), "run_id", "left_semi"), confident_links(links, least))
    of_run = payload.groupBy("run_id").agg(F.sort_array(F.collect_set("case_id")).alias("case_ids"), F.count(F.lit(1)).alias("n_results"))
    named = runs.select("run_id", run_name(F.col("job_name"), F.col("build_number"), F.col("run_id").cast("string"), F.col("created_at")).alias("name"))
    return named.join(of_run, "run_id"), payload


def object_key(build: Column, category: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit("builds"), build, category, F.element_at(F.split(path, "/"), -1))


def expired_artifacts(artifacts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Artifacts (uri, created_at) past the days that their suffix allows; unknown suffixes are kept."""
    suffix = F.lower(F.regexp_extract("uri", r"\.([A-Za-z0-9]+)$", 1))
    days = F.lit(None).cast("int")
    for name, n in RETENTION.items():
        days = F.when(suffix == name, F.lit(n)).otherwise(days)
    out = artifacts.withColumn("keep_days", days).withColumn("age_days", F.datediff(F.lit(as_of.date()), F.to_date("created_at")))
    return out.where(F.col("age_days") > F.col("keep_days"))


def backfill_uris(artifacts: DataFrame, stored: DataFrame, bucket: str) -> DataFrame:
    """Local URIs become object-store ones; files that aren't stored become a mark. Done again, nothing changes.

    artifacts has build, category, uri; stored has the object keys that exist.
    """
    local = F.col("uri").startswith("file://")
    key = object_key(F.col("build"), F.col("category"), F.col("uri"))
    found = artifacts.withColumn("_key", F.when(local, key)).join(stored.select(F.col("object_key").alias("_key")).distinct().withColumn("_there", F.lit(True)), "_key", "left")
    new = F.when(~local, F.col("uri")).when(F.col("_there"), F.concat(F.lit(f"gs://{bucket}/"), "_key")).otherwise(F.lit(MISSING))
    return found.withColumn("uri", new).select(*artifacts.columns)
