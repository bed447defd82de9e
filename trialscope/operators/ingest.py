"""Ingest and sync jobs: what reports and landed pages hold, merged into the tables.

The jobs are functions from frames to the new versions of tables (a dry run is not writing them).
ingest_batches() does the same for manifests that a drain hands it, as one commit to a store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.functions.text import case_ids, issue_keys_strict
from trialscope.operators.merge import NEW, NEW_UNLESS_NULL, OLD, OLD_UNLESS_NULL, incremental, keep_known, last_write_wins, merge, upsert_links
from trialscope.sources import junit, landed, playwright
from trialscope.sources.scratch import as_qualified, kept, listing, qualified, scope
from trialscope.streaming.tables import Change, Kind, Store, replacing

_BUILD = ("job_name", "build_number")
_LINK = "provenance string, confidence string, evidence string, source string"
#: Tables of an ingest. A result's source is the file that it is from; so files of a build that come in different batches
#: never replace each other, and a file that comes again replaces its own rows. Children name their parent and its source.
KINDS = {
    "build": Kind("job_name string, build_number int, ci_provider string, branch string, build_url string, started_at timestamp, finished_at timestamp", _BUILD, _BUILD),
    "run": Kind("job_name string, build_number int, shard int, framework string, source string, status string, tests long, passed long, failed long, skipped long", (*_BUILD, "shard", "framework", "source"), _BUILD),
    "case": Kind("identity_key string, title string, suite_name string, file_path string", ("identity_key",)),
    "result": Kind("result_id string, job_name string, build_number int, shard int, identity_key string, project string, source string, nth int, status string, duration_ms int, message string", ("result_id",), _BUILD),
    "attempt": Kind("attempt_id string, result_id string, job_name string, build_number int, source string, attempt_no int, status string, duration_ms int, started_at timestamp, finished_at timestamp, error_hash string, log_uri string", ("attempt_id",), _BUILD),
    "build_log": Kind("attempt_id string, log_type string, job_name string, build_number int, source string, content string, bytes int", ("attempt_id", "log_type"), _BUILD),
    "artifact": Kind("result_id string, name string, kind string, uri string, job_name string, build_number int, source string", ("result_id", "name"), _BUILD),
    "link": Kind(f"issue_key string, identity_key string, {_LINK}", ("issue_key", "identity_key", "provenance")),
    "case_link": Kind(f"identity_key string, tr_case_id long, {_LINK}", ("identity_key", "tr_case_id", "provenance")),
    "batch": Kind("path string, job_name string, build_number int, shard int, framework string, status string, error string, files int, tests long, links int, unknown_issues int, unknown_cases int, lost_artifacts int", ("path",)),
}
LINK, KEYS = KINDS["link"].schema, {name: list(k.keys) for name, k in KINDS.items()}
#: Tables whose rows a file brings as a whole: what it brought before goes.
OF_SOURCE = ("run", "result", "attempt", "build_log", "artifact")
_RESULTS = f"array<{playwright.RESULT}>"
TESTS = f"file string, framework string, suite_name string, identity_key string, title string, file_path string, project string, status string, duration_ms int, message string, issue_keys array<string>, case_ids array<long>, told_at timestamp, results {_RESULTS}"
_TESTS = [c.split()[0] for c in TESTS.rsplit(", results", 1)[0].split(", ")] + ["results"]


def _as_tests(rows: DataFrame, **columns) -> DataFrame:
    """rows with the columns of TESTS; those that aren't named are null."""
    kinds = dict(rows.sparkSession.createDataFrame([], TESTS).dtypes)
    return rows.select(*(columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _TESTS))


def junit_tests(suites: DataFrame, property_names: tuple[str, ...] = ("jira",), case_property_names: tuple[str, ...] = ("testrail",)) -> DataFrame:
    """A row per test case of JUnit suites, as the ingest takes it; told_at is the report's own time."""
    times = suites.groupBy("path").agg(F.min("started_at").alias("told_at"))
    c, col = junit.read_cases(suites).join(times, "path"), F.col
    return _as_tests(c, file=as_qualified(col("path")), framework=F.lit("junit"), suite_name=col("suite_name"), identity_key=col("identity_key"), title=col("title"), status=col("status"), duration_ms=col("duration_ms"), message=col("error_message"), issue_keys=issue_keys_strict(junit.property_values(property_names)), case_ids=case_ids(junit.property_values(case_property_names)), told_at=col("told_at"))


def playwright_tests(reports: DataFrame) -> DataFrame:
    """A row per test and project of Playwright reports, as the ingest takes it, with its attempts."""
    times = playwright.runs(reports).select("path", F.col("started_at").alias("told_at"))
    e, col = playwright.executions(playwright.specs(reports)).join(times, "path", "left"), F.col
    file = F.nullif(F.split_part("test_id", F.lit("::"), F.lit(1)), F.lit(""))
    return _as_tests(e, file=as_qualified(col("path")), framework=F.lit("playwright"), identity_key=col("test_id"), title=col("title"), file_path=file, project=col("project"), status=col("status"), duration_ms=col("duration_ms"), message=col("failure_message"), issue_keys=col("issue_keys"), case_ids=case_ids(F.array_join("tags", " ")), told_at=col("told_at"), results=col("results"))


def _digest(*columns: str) -> Column:
    """An id of the values of columns that is the same wherever it is computed; null and empty text differ."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def found_tables(tests: DataFrame, builds: DataFrame, known_issues: DataFrame, known_cases: DataFrame | None = None, numbering: bool = True) -> dict[str, DataFrame]:
    """Rows of the tables of KINDS but batch that tests of files hold, and of skipped_link and skipped_case_link.

    builds has a row per file: file, shard and the columns of a build. A start that isn't given is the
    report's own. Tests that a file has several times are numbered (nth) in the order of their figures.
    Attempts are those that a report tells of a test; of attempts of one number the last counts. Links to
    issues and cases that aren't known are skipped. Numbered tests are kept, as results, attempts, logs and artifacts
    read them; without numbering, for callers that ask for none of these tables, those tables aren't returned.
    """
    rows = tests.select(*_TESTS).join(builds, "file").withColumn("source", F.md5("file"))
    text = [F.max(c).alias(c) for c in ("ci_provider", "branch", "build_url")]
    build = rows.groupBy(*_BUILD).agg(*text, F.coalesce(F.min("started_at"), F.min("told_at")).alias("started_at"), F.max("finished_at").alias("finished_at"))
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    run = rows.groupBy(*KEYS["run"]).agg(_worst(F.collect_set("status")).alias("status"), F.count(F.lit(1)).alias("tests"), n("PASSED", "FLAKY").alias("passed"), n("FAILED", "ERROR").alias("failed"), n("SKIPPED").alias("skipped"))
    case = rows.groupBy("identity_key").agg(*(F.max(c).alias(c) for c in ("title", "suite_name", "file_path")))
    keys = rows.select("identity_key", "framework", F.explode("issue_keys").alias("issue_key")).distinct()
    known, unknown = keep_known(keys, known_issues, ["issue_key"])
    told_by = F.when(F.col("framework") == "playwright", "tag").otherwise("property")
    strong = (F.lit("HIGH").alias("confidence"), F.concat(told_by, F.lit(" in a report")).alias("evidence"))
    ids = rows.select("identity_key", "framework", F.explode("case_ids").alias("tr_case_id")).where("tr_case_id is not null").distinct()
    known_ids, unknown_ids = keep_known(ids, known_cases if known_cases is not None else ids.limit(0), ["tr_case_id"])
    out = {
        "build": build, "run": run.select(*KINDS["run"].columns), "case": case, **(_results_of(rows) if numbering else {}),
        "link": known.select("issue_key", "identity_key", *strong), "case_link": known_ids.select("identity_key", "tr_case_id", *strong),
        "skipped_link": unknown.select("identity_key", "issue_key").distinct(), "skipped_case_link": unknown_ids.select("identity_key", "tr_case_id").distinct(),
    }
    return out


def _results_of(rows: DataFrame) -> dict[str, DataFrame]:
    """Results, attempts, logs and artifacts of the tests of files, by the numbered tests, which are kept.

    Attempts of a test lie in its row. So only tests of which a report tells an attempt's number twice are sorted for
    the last one, and whether an attempt wrote output is told by its own row.
    """
    nth = F.expr("row_number() over (partition by source, job_name, build_number, shard, identity_key, project order by status, duration_ms, message)")
    numbered = kept(rows.withColumn("nth", nth).withColumn("result_id", _digest("source", *_BUILD, "shard", "identity_key", "project", "nth")), "numbered-tests")
    owned = ("result_id", *_BUILD, "source")
    numbers = F.transform("results", lambda r, i: F.coalesce(r["retry"], i))
    repeated = F.coalesce(F.size(F.array_distinct(numbers)) < F.size(numbers), F.lit(False))
    one = F.row_number().over(_window(["result_id", "attempt_no"], F.desc_nulls_last("started_at"), F.desc_nulls_last("duration_ms"), "status"))
    last = playwright.attempts(numbered.where(repeated), owned).withColumn("_n", one).where("_n = 1").drop("_n")
    attempt = playwright.attempts(numbered.where(~repeated), owned).unionByName(last).withColumn("attempt_id", _digest("result_id", "attempt_no"))
    uri = F.when(F.octet_length(playwright.output(F.col("stdout"))) > 0, F.concat_ws("/", "attempt_id", F.lit("stdout")))
    first = F.row_number().over(_window(["result_id", "name"], "uri"))
    out = {
        "result": numbered, "attempt": attempt.withColumn("log_uri", uri), "build_log": playwright.build_logs(attempt, ("attempt_id", *owned[1:])),
        "artifact": playwright.artifacts(numbered, owned).withColumn("_n", first).where("_n = 1"),
    }
    return {name: df.select(*KINDS[name].columns) for name, df in out.items()}


def _window(by: list[str], *order):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def _worst(statuses: Column) -> Column:
    """The status of a set of statuses: any failure, else a flaky test, else a pass."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(has("FAILED") | has("ERROR"), "FAILED").when(has("FLAKY"), "FLAKY").when(has("PASSED"), "PASSED").otherwise("SKIPPED")


def run_totals(runs: DataFrame) -> DataFrame:
    """A row per job, build, shard and framework: what all its files hold."""
    sums = [F.sum(c).alias(c) for c in ("tests", "passed", "failed", "skipped")]
    return runs.groupBy(*_BUILD, "shard", "framework").agg(_worst(F.collect_set("status")).alias("status"), *sums, F.count(F.lit(1)).alias("files"))


def numbered_results(results: DataFrame) -> DataFrame:
    """results with attempt: the runs of a test in a shard of a build, over all its files."""
    order = _window([*_BUILD, "shard", "identity_key", "project"], "source", "nth")
    return results.withColumn("attempt", F.row_number().over(order).cast("int"))


def _build_policy(created_once: bool) -> dict[str, str]:
    times = {c: OLD_UNLESS_NULL if created_once else NEW_UNLESS_NULL for c in ("started_at", "finished_at")}
    return times | dict.fromkeys(("ci_provider", "branch", "build_url"), NEW_UNLESS_NULL)


_CASE_POLICY = {"suite_name": NEW_UNLESS_NULL, "file_path": NEW_UNLESS_NULL}
_ENDS = {"link": ["issue_key", "identity_key"], "case_link": ["identity_key", "tr_case_id"]}


def ingest(state: dict[str, DataFrame], found: dict[str, DataFrame], source: str, created_once: bool = False) -> dict[str, DataFrame]:
    """New versions of the tables with the found rows merged in; the same rows again change nothing.

    What a build newly knows replaces what it knew, but nothing becomes null; with created_once, its
    start and finish stay as they were created. Titles are replaced; suites and files are kept where the
    new ones are null. A file's runs, results, attempts, logs and artifacts replace those that it had. Links
    are EXPLICIT and HIGH; those of other provenances stay.
    """
    out = {
        "build": merge(state["build"], found["build"], KEYS["build"], _build_policy(created_once)),
        "case": merge(state["case"], found["case"], KEYS["case"], _CASE_POLICY),
        **{name: upsert_links(state[name], found[name], ends, "EXPLICIT", source) for name, ends in _ENDS.items()},
    }
    return out | {name: replacing(found["run"], ["source"])(state[name], found[name]) for name in OF_SOURCE if name in found}


def empty_state(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], kind.schema) for name, kind in KINDS.items()}


def sync_issues(issues: DataFrame, pages: DataFrame, since=None) -> DataFrame:
    """Landed issues that changed at `since` or later merged in; of several of a key the latest change holds, and its creation stays.

    since is what high_water_mark() says of the table: an hour before the least recent project's last change.
    """
    new = last_write_wins(incremental(landed.issues(pages), "updated_at", since), ["issue_key"], [F.desc_nulls_last("updated_at")])
    return merge(issues, new, ["issue_key"], {"created_at": OLD_UNLESS_NULL})


def sync_issue_projects(issues: DataFrame, pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Landed issues of the projects of marks (project_key, since) merged in, each project's from its own moment on.

    An issue of a project that wasn't asked for is left out; a null moment takes all of the project's. marks, a row
    per requested project, goes to all tasks: few projects have all issues, so issues aren't dealt by project.
    """
    asked = F.broadcast(marks.select(F.col("project_key"), F.col("since").alias("_since")))
    changed = landed.issues(pages).join(asked, "project_key").where(F.col("_since").isNull() | (F.col("updated_at") >= F.col("_since"))).drop("_since")
    new = last_write_wins(changed, ["issue_key"], [F.desc_nulls_last("updated_at")])
    return merge(issues, new, ["issue_key"], {"created_at": OLD_UNLESS_NULL})


def sync_cases(cases: DataFrame, links: DataFrame, pages: DataFrame, section_paths: DataFrame, priorities: DataFrame, known_issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, links, skipped): landed cases merged in with the names of their priorities, and EXPLICIT links from their refs.

    priorities has id and name; an unknown id stays as text. skipped has the refs to unknown issues.
    """
    new = landed.cases(pages, section_paths)
    named = new.join(F.broadcast(priorities.select(F.col("id").alias("priority"), F.col("name").alias("_name"))), "priority", "left")
    named = named.withColumn("priority", F.coalesce("_name", F.col("priority").cast("string"))).drop("_name")
    rows = last_write_wins(named, ["tr_case_id"], [F.desc_nulls_last("updated_at")])
    refs = rows.select("tr_case_id", F.explode(issue_keys_strict(F.col("refs"))).alias("issue_key")).distinct()
    known, unknown = keep_known(refs, known_issues, ["issue_key"])
    found = known.select("issue_key", "tr_case_id", F.lit("HIGH").alias("confidence"), F.lit("refs of the case").alias("evidence"))
    return merge(cases, rows, ["tr_case_id"]), upsert_links(links, found, ["issue_key", "tr_case_id"], "EXPLICIT", "case-refs"), unknown


def sync_results(results: DataFrame, pages: DataFrame, known_cases: DataFrame) -> DataFrame:
    """Landed results of known cases merged in; of an existing one only status and moment change."""
    new = last_write_wins(landed.results(pages, known_cases), ["tr_result_id"], [F.desc_nulls_last("tested_at")])
    return merge(results, new, ["tr_result_id"], {c: NEW if c in ("status_id", "tested_at") else OLD for c in results.columns})


def bulk_junit(spark, folder: str, job_name: str, ci_provider: str | None = None, url_prefix: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tests, builds, skipped) of a folder of JUnit files that are named by their build's number, such as 918.xml.

    The files are listed as a table, without their contents. skipped has the other .xml files; their tests join no
    build. A build starts when its report says.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select(F.col("path").alias("file"), junit.build_number(F.col("path")).alias("build_number"), F.col("length").alias("bytes"))
    url = F.concat(F.lit(url_prefix), F.lit("/"), F.col("build_number").cast("string"), F.lit("/"))
    none = lambda kind: F.lit(None).cast(kind)
    builds = listed.where("build_number is not null").select("file", F.lit(job_name).alias("job_name"), "build_number", F.lit(0).alias("shard"), F.lit(ci_provider).cast("string").alias("ci_provider"), none("string").alias("branch"), url.alias("build_url"), none("timestamp").alias("started_at"), none("timestamp").alias("finished_at"))
    return junit_tests(junit.read_suites(spark, f"{folder}/*.xml")), builds, listed.where("build_number is null").select("file", "bytes")


def _resolved(attachments: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, lost): attachments with the URI of the file that came with their manifest.

    A report tells paths on the machine that ran it; the manifest's file of the same folder and name is meant,
    else that of the name. What the manifest doesn't name is lost. manifests has source, path and artifactFiles.
    """
    sent = manifests.select("source", F.regexp_replace("path", "/[^/]*$", "").alias("_at"), F.explode("artifactFiles").alias("_sent"))
    last = lambda c, n: F.array_join(F.slice(F.split(c, "/"), -n, n), "/")
    named = attachments.withColumn("_flat", last("uri", 1)).withColumn("_deep", F.when(F.size(F.split("uri", "/")) > 1, last("uri", 2)).otherwise(F.col("uri")))
    met = named.join(sent, ["source"], "left").where(F.col("_sent").isNull() | F.col("_sent").isin(F.col("_flat"), F.col("_deep")))
    best = _window(["result_id", "name"], F.when(F.col("_sent") == F.col("_deep"), 0).otherwise(1), "_at", "_sent")
    one = met.where("_sent is not null").withColumn("_n", F.row_number().over(best)).where("_n = 1")
    found = one.withColumn("uri", F.concat_ws("/", "_at", F.lit("artifacts"), "_sent")).select(*KINDS["artifact"].columns)
    return found, attachments.join(found.select("result_id", "name"), ["result_id", "name"], "left_anti")


def read_batches(files: DataFrame, known_issues: DataFrame, known_cases: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(found tables, status of each manifest) of manifests (path in the spelling of qualified(), text) and the files that they name.

    Names are relative to the manifest, or absolute in any spelling. The manifests' folders and the names of
    their files come to the driver, as many as the drain takes manifests at a time; folders are listed once each.
    """
    spark = files.sparkSession
    good, rejected = landed.manifests(files)
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.col("_file")
    absolute = name.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?/")
    spelled = good.select("*", F.explode("resultFiles").alias("_file")).withColumn("told", F.when(absolute, name).otherwise(F.concat_ws("/", folder, name)))
    at = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    kept_rows = kept(spelled.select("path", "told", at("told").alias("folder"), F.substring_index("told", "/", -1).alias("name"), "framework", F.col("jobName").alias("job_name"), F.col("buildNumber").alias("build_number"), F.coalesce("shardIndex", F.lit(0)).alias("shard"), F.col("ciProvider").alias("ci_provider"), "branch", F.col("buildUrl").alias("build_url"), F.try_to_timestamp("startedAt").alias("started_at"), F.try_to_timestamp("finishedAt").alias("finished_at"), "artifactFiles"), "manifests")
    folders = {r["folder"]: qualified(spark, r["folder"]) for r in kept_rows.select("folder").distinct().collect()}
    present = [(f"{one}/{n}",) for one in sorted(set(folders.values())) for n in listing(spark, one)]
    spelling = spark.createDataFrame(list(folders.items()) or [("", "")], "folder string, _one string")
    listed = kept_rows.join(spelling, "folder").withColumn("file", F.concat_ws("/", "_one", "name")).drop("_one", "folder", "name", "told")
    there = spark.createDataFrame(present, "file string").withColumn("_there", F.lit(True))
    named = listed.join(there, "file", "left_semi").select("file", F.col("framework") == "playwright").distinct().collect()
    of_junit, of_playwright = ([f for f, is_playwright in sorted(map(tuple, named)) if is_playwright == wanted] for wanted in (False, True))
    parts = [spark.createDataFrame([], TESTS)]
    if of_junit:
        parts.append(junit_tests(junit.read_suites(spark, of_junit)))
    if of_playwright:
        parts.append(playwright_tests(playwright.read_reports(spark, of_playwright)))
    tests = kept(reduce(DataFrame.unionByName, parts), "tests")
    counted = tests.groupBy("file", "framework").agg(F.count(F.lit(1)).alias("tests"))
    # pytest writes JUnit reports.
    reads = F.when(F.col("framework") == "playwright", "playwright").otherwise("junit")
    of_file = listed.withColumn("_reads", reads).join(there, "file", "left").join(counted.withColumnRenamed("framework", "_reads"), ["file", "_reads"], "left")
    why = F.when(F.col("_there").isNull(), F.concat(F.lit("missing: "), "file")).when(F.col("tests").isNull(), F.concat(F.lit("no tests: "), "file"))
    ends = ["path", *_BUILD, "shard", "framework"]
    of_batch = of_file.withColumn("why", why).groupBy(*ends).agg(F.min("why").alias("error"), F.count(F.lit(1)).cast("int").alias("files"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"))
    none = dict.fromkeys((*_BUILD, "shard", "framework"))
    failed = rejected.select("path", F.col("reason").alias("error"), F.lit(0).alias("files"), F.lit(0).cast("long").alias("tests"), *(F.lit(None).cast(dict(of_batch.dtypes)[c]).alias(c) for c in none))
    status = kept(of_batch.unionByName(failed).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed")), "batches")
    # Frames made of Python rows have no known size, and Spark would rather broadcast all tests than the rows per file (whose names the driver has).
    fine = kept(listed.join(status.where("status = 'ok'").select("path"), "path", "left_semi"), "result-files")
    # A file that several manifests of a build name counts once.
    builds = fine.groupBy("file", *_BUILD, "shard").agg(*(F.max(c).alias(c) for c in ("ci_provider", "branch", "build_url")), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
    read_as = tests.join(fine.select("file", reads.alias("framework")).distinct(), ["file", "framework"], "left_semi")
    found = found_tables(read_as, F.broadcast(builds), known_issues, known_cases)
    sent = fine.select(F.md5("file").alias("source"), "path", "artifactFiles").distinct()
    found["artifact"], lost = _resolved(found["artifact"], sent)
    # What a batch's files say of links and attachments, counted per manifest.
    own = fine.select("path", F.col("file")).distinct()
    of = tests.select("file", "identity_key").distinct().join(F.broadcast(own), "file").select("path", "identity_key").distinct()
    each = lambda df, on, name: df.join(of, "identity_key").groupBy("path").agg(F.count_distinct(*on).cast("int").alias(name))
    told = [each(found["link"], ["issue_key", "identity_key"], "links"), each(found["skipped_link"], ["issue_key", "identity_key"], "unknown_issues"), each(found["skipped_case_link"], ["tr_case_id", "identity_key"], "unknown_cases")]
    told.append(lost.join(sent.select("source", "path"), "source").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("lost_artifacts")))
    for counts in told:
        status = status.join(counts, "path", "left")
    return found, status.fillna(0, ["links", "unknown_issues", "unknown_cases", "lost_artifacts"])


def ingest_batches(files: DataFrame, store: Store, known_issues: DataFrame, known_cases: DataFrame, source: str | None = None, batch: int = 0, created_once: bool = False) -> None:
    """Ingest manifests (path, text) into a store of KINDS, all tables in one commit.

    A build's row is shared by its files, whichever comes first: it starts with the earliest and finishes
    with the latest, unless created_once. A batch of a source that was committed before changes nothing; the same
    manifests in another batch replace what their files brought. Nothing stays in the shared folder.
    """
    if source is not None and store.snapshot().done.get(source, -1) >= batch:
        return
    with scope(files.sparkSession):
        found, status = read_batches(files, known_issues, known_cases)

        def one_build(old: DataFrame, new: DataFrame) -> DataFrame:
            times = old.unionByName(new).groupBy(*_BUILD).agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
            said = merge(old, new, KEYS["build"], _build_policy(created_once))
            return said if created_once else said.drop("started_at", "finished_at").join(times, list(_BUILD))

        links = lambda name: lambda old, new: upsert_links(old, new, _ENDS[name], "EXPLICIT", "report")
        sources = kept(found["run"], "sources")
        changes = {
            "build": Change(found["build"], one_build),
            "case": Change(found["case"], lambda old, new: merge(old, new, KEYS["case"], _CASE_POLICY)),
            **{name: Change(found[name], replacing(sources, ["source"]), touch=sources) for name in OF_SOURCE},
            **{name: Change(_whole_links(found[name]), links(name)) for name in _ENDS},
            "batch": Change(status),
        }
        store.commit(changes, source, batch)


def _whole_links(found: DataFrame) -> DataFrame:
    return found.withColumns({"provenance": F.lit("EXPLICIT"), "source": F.lit("report")})
