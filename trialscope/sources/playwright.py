"""Playwright JSON reports as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.functions.text import case_ids, error_fingerprint, issue_keys, truncated
from trialscope.sources.scratch import kept

_OUT = "array<struct<text:string,buffer:string>>"
RESULT = f"struct<status:string,duration:double,retry:int,startTime:string,errors:array<struct<message:string>>,stdout:{_OUT},stderr:{_OUT},attachments:array<struct<name:string,contentType:string,path:string>>,annotations:array<struct<type:string,description:string>>>"
_TEST = f"struct<projectName:string,status:string,annotations:array<struct<type:string,description:string>>,results:array<{RESULT}>>"
_SPEC = f"struct<id:string,title:string,ok:boolean,tags:array<string>,file:string,tests:array<{_TEST}>>"
#: Nested suites stay text until their level is reached: the tree has no fixed depth.
_SUITE = f"title string, file string, specs array<{_SPEC}>, suites array<string>"
_REPORT = "suites array<string>, stats struct<startTime:string,duration:double,expected:int,skipped:int,unexpected:int,flaky:int>"


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and text of whole report files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def runs(reports: DataFrame) -> DataFrame:
    """A row per report: status from the counts of its stats, start and finish."""
    s = F.from_json("text", _REPORT)["stats"]
    n = lambda c: F.coalesce(s[c], F.lit(0))
    status = F.when(n("unexpected") > 0, "FAILED").when(n("flaky") > 0, "FLAKY").when((n("expected") == 0) & (n("skipped") > 0), "SKIPPED").otherwise("PASSED")
    start = F.try_to_timestamp(s["startTime"])
    return reports.select("path", status.alias("status"), start.alias("started_at"), F.timestamp_millis(F.unix_millis(start) + s["duration"].cast("long")).alias("finished_at"))


def specs(reports: DataFrame) -> DataFrame:
    """A row per spec: path, file, titles (of the suites around it), spec.

    A suite with a file of its own adds no title; one without adds its title, if it has one; the file
    is the nearest one around. Suites may be nested to any depth: each level is parsed once and written
    to the shared folder, and the next one is read from there.
    """
    level = reports.select("path", F.explode(F.from_json("text", _REPORT)["suites"]).alias("s"), F.lit(None).cast("string").alias("file"), F.array().cast("array<string>").alias("titles"))
    out = None
    while True:
        s = level.select("path", F.from_json("s", _SUITE).alias("s"), F.col("file").alias("_file"), F.col("titles").alias("_titles"))
        own = F.nullif(F.col("s.file"), F.lit(""))
        titled = own.isNull() & F.col("s.title").isNotNull() & (F.col("s.title") != "")
        parsed = kept(s.select("path", "s.specs", "s.suites", F.coalesce(own, "_file").alias("file"), F.when(titled, F.concat("_titles", F.array("s.title"))).otherwise(F.col("_titles")).alias("titles")), "suites")
        found = parsed.select("path", "file", "titles", F.explode("specs").alias("spec"))
        out = found if out is None else out.unionByName(found)
        level = parsed.select("path", F.explode("suites").alias("s"), "file", "titles")
        if level.isEmpty():
            return out


def _execution_status(c: Column) -> Column:
    return F.when(c == "expected", "PASSED").when(c == "unexpected", "FAILED").when(c == "flaky", "FLAKY").when(c == "skipped", "SKIPPED").otherwise("ERROR")


def executions(spec_rows: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """A row per spec and project: test_id, status, duration, first error of the last attempt, annotations, keys.

    test_id is file::title > title of spec. Annotations of the test and of its results are joined.
    """
    file = F.coalesce(F.nullif(F.col("spec.file"), F.lit("")), F.col("file"), F.lit(""))
    test_id = F.concat(file, F.lit("::"), F.array_join(F.concat("titles", F.array("spec.title")), " > "))
    e = spec_rows.select("path", test_id.alias("test_id"), F.col("spec.title").alias("title"), F.coalesce("spec.tags", F.array().cast("array<string>")).alias("tags"), F.explode("spec.tests").alias("t"))
    if projects:
        e = e.where(F.col("t.projectName").isin(*projects))
    results = F.coalesce(F.col("t.results"), F.array().cast(f"array<{RESULT}>"))
    last = F.try_element_at(results, F.lit(-1))
    none = F.array().cast("array<struct<type:string,description:string>>")
    notes = F.array_distinct(F.concat(F.coalesce("t.annotations", none), F.flatten(F.transform(results, lambda r: F.coalesce(r["annotations"], none)))))
    told = F.concat_ws(" ", "title", F.array_join("tags", " "), F.concat_ws(" ", F.transform(notes, lambda n: n["description"])))
    return e.select(
        "path", "test_id", "title", "tags", F.col("t.projectName").alias("project"), _execution_status(F.col("t.status")).alias("status"),
        F.aggregate(results, F.lit(0.0), lambda a, r: a + F.coalesce(r["duration"], F.lit(0.0)), lambda a: a.cast("int")).alias("duration_ms"),
        truncated(F.get(last["errors"], F.lit(0))["message"], 2000).alias("failure_message"), notes.alias("annotations"), results.alias("results"),
        F.array_distinct(issue_keys(told)).alias("issue_keys"), case_ids(F.concat_ws(" ", F.array_join("tags", " "), F.concat_ws(" ", F.transform(notes, lambda n: n["description"])))).alias("case_ids"),
    )


#: What names an execution in a report.
EXECUTION = ("path", "test_id", "project")


def attempts(execution_rows: DataFrame, keys: tuple[str, ...] = EXECUTION) -> DataFrame:
    """A row per result: attempt number (its retry, else its place), status, duration, fingerprint of its first error."""
    r = execution_rows.select(*keys, F.posexplode("results").alias("pos", "r"))
    start = F.try_to_timestamp("r.startTime")
    message = F.get(F.col("r.errors"), F.lit(0))["message"]
    return r.select(
        *keys, F.coalesce("r.retry", "pos").alias("attempt_no"),
        F.when(F.col("r.status") == "passed", "PASSED").when(F.col("r.status") == "skipped", "SKIPPED").otherwise("FAILED").alias("status"),
        F.col("r.duration").cast("int").alias("duration_ms"), start.alias("started_at"), F.timestamp_millis(F.unix_millis(start) + F.col("r.duration").cast("long")).alias("finished_at"),
        F.when(message != "", error_fingerprint(message)).alias("error_hash"), F.col("r.stdout").alias("stdout"), F.col("r.stderr").alias("stderr"), F.col("r.attachments").alias("attachments"),
    )


def output(chunks: Column) -> Column:
    """Chunks of text and base 64 joined."""
    return F.array_join(F.transform(chunks, lambda c: F.coalesce(c["text"], F.try_to_binary(c["buffer"], F.lit("base64")).cast("string"), F.lit(""))), "")


def build_logs(attempt_rows: DataFrame, keys: tuple[str, ...] = (*EXECUTION, "attempt_no")) -> DataFrame:
    """A row per attempt and stream with output: chunks of text and base 64 joined, and their bytes."""
    logs = attempt_rows.select(*keys, F.explode(F.create_map(F.lit("stdout"), "stdout", F.lit("stderr"), "stderr")).alias("log_type", "chunks"))
    out = logs.where("chunks is not null").select(*keys, "log_type", output(F.col("chunks")).alias("content"))
    return out.withColumn("bytes", F.octet_length("content")).where("bytes > 0")


def artifact_kind(mime: Column, name: Column) -> Column:
    return F.when(mime.startswith("image/"), "screenshot").when(mime.startswith("video/"), "video").when(name.contains("trace") | (mime == "application/zip"), "trace").otherwise("attachment")


def artifacts(execution_rows: DataFrame, keys: tuple[str, ...] = EXECUTION) -> DataFrame:
    """Attachments of executions that didn't pass: normal name, kind, path."""
    bad = execution_rows.where(F.col("status").isin("FAILED", "FLAKY", "ERROR"))
    a = bad.select(*keys, F.explode("results").alias("r")).select(*keys, F.explode("r.attachments").alias("a"))
    name = F.regexp_replace(F.lower("a.name"), r"\s+", "_")
    return a.select(*keys, name.alias("name"), artifact_kind(F.col("a.contentType"), name).alias("kind"), F.col("a.path").alias("uri"))


def artifact_index(artifact_rows: DataFrame) -> DataFrame:
    """A row per execution: a map from normal attachment name to URI (the first by URI where names repeat)."""
    one = artifact_rows.groupBy("path", "test_id", "project", "name").agg(F.min("uri").alias("uri"))
    return one.groupBy("path", "test_id", "project").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "uri")))).alias("uris"))


def log_uris(log_rows: DataFrame) -> DataFrame:
    """A row per attempt: log_uri names the row of its standard output; null where it wrote none."""
    name = F.concat_ws("/", "test_id", "project", F.col("attempt_no").cast("string"), F.lit("stdout"))
    return log_rows.groupBy("path", "test_id", "project", "attempt_no").agg(F.max(F.when(F.col("log_type") == "stdout", name)).alias("log_uri"))
