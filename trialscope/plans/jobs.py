"""Queries of the inference, flake, merge and export jobs over the bound tables, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.functions import text as tx
from trialscope.operators import export, flake_job, inference, merge, sections
from trialscope.plans.view_sql import AS_OF as SQL_AS_OF
from trialscope.plans.view_sql import over_views
from trialscope.plans.views import Views
from trialscope.sources import playwright


def _q(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Tokens and keys ------------------------------------------------------------------------------------------

def _keyed_tests(v: Views) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    return v.base("customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("test_P"), (F.col("c_custkey") % 7).cast("string"), F.lit("-"), n("c_custkey"), F.lit("_x")).alias("identity_key"),
        F.concat(F.lit("@P"), (F.col("c_nationkey") % 7).cast("string"), F.lit("-"), n("c_nationkey"), F.lit(" and NOPE-1")).alias("title"),
        F.col("c_mktsegment").alias("suite_name"),
    )


KEYED = """k AS (SELECT c_custkey AS id, concat('test_P', CAST(c_custkey % 7 AS STRING), '-', CAST(c_custkey AS STRING), '_x') AS identity_key,
  concat('@P', CAST(c_nationkey % 7 AS STRING), '-', CAST(c_nationkey AS STRING), ' and NOPE-1') AS title FROM customer),
f AS (SELECT id, 0 AS r, 'identity_key' AS field, unnest(regexp_extract_all(identity_key, '(^|[^A-Z0-9])([A-Z][A-Z0-9]{1,9}-[0-9]+)', 2)) AS issue_key FROM k
  UNION ALL SELECT id, 1, 'title', unnest(regexp_extract_all(title, '(^|[^A-Z0-9])([A-Z][A-Z0-9]{1,9}-[0-9]+)', 2)) FROM k),
o AS (SELECT id AS test_case_id, issue_key, arg_min(field, r) AS field FROM f GROUP BY 1, 2)"""


def _tokens_sql(source: str, tokens: str) -> str:
    return f"SELECT id, array_to_string(list_sort(list_distinct({tokens})), ' ') AS tokens FROM ({source}) x"


V1 = f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_q(tx.STOP_TITLES)}, w))"
V2 = f"list_filter(list_transform(list_concat(string_split_regex(regexp_replace(split_part(lower(t), '.', 1), '^(test_evite_|testevite|test_|test)', ''), '[\\s_./-]+'), string_split_regex(lower(t), '[\\s_./-]+')), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 2 AND NOT list_contains({_q(tx.STOP_CASES)}, w))"
NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '^\\s*(verify\\s+that|test\\s+that|ensure\\s+that|check\\s+that|should|it\\s+should)\\s+', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
V3 = f"list_filter(string_split({NORMAL}, ' '), lambda w: length(w) >= 2 AND NOT list_contains({_q(tx.STOP_SUMMARIES)}, w))"


def _joined(df: DataFrame, tokens) -> DataFrame:
    return df.select("id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


# Similar titles: suppliers and customers get titles of the parts of their numbers -------------------------

def _named_tests(v: Views) -> DataFrame:
    return v.base("supplier").join(v.base("part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("title"))


TESTS = "ts AS (SELECT s_suppkey AS id, concat(p_type, ' ', p_name) AS t FROM supplier JOIN part ON p_partkey = s_suppkey)"


def _all_tests(v: Views) -> DataFrame:
    """A test per part."""
    return v.base("part").select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" "), "p_name").alias("title"))


ALL_TESTS = "ts AS (SELECT p_partkey AS id, concat(p_type, ' ', p_name) AS t FROM part)"


def _title_sets(v: Views) -> tuple[DataFrame, DataFrame]:
    return inference.token_sets(_all_tests(v), "id", tx.title_tokens(F.col("title"))), inference.token_sets(v.jira_issue, "issue_key", tx.title_tokens(F.col("summary")))


def _cases(v: Views) -> DataFrame:
    """A case per part; those whose number is a supplier's have links."""
    return v.base("part").select(F.col("p_partkey").alias("tr_case_id"), F.concat(F.lit("Verify that "), F.col("p_name")).alias("title"))


CASES = "cs AS (SELECT p_partkey AS tr_case_id, concat('Verify that ', p_name) AS t FROM part)"


def _explicit(v: Views) -> DataFrame:
    """Cases with a confident explicit link to an issue."""
    return v.jira_testrail_link.where("provenance = 'EXPLICIT' AND confidence = 'HIGH'").select("tr_case_id").distinct()


EXPLICIT = "ex AS (SELECT DISTINCT tr_case_id FROM jira_testrail_link WHERE provenance = 'EXPLICIT' AND confidence = 'HIGH')"


def _titles(v: Views) -> DataFrame:
    """An issue per summary, so that summaries can differ in similarity."""
    return v.jira_issue.groupBy("summary").agg(F.min("issue_key").alias("issue_key"))


CASE_LINKS = "cl AS (SELECT test_case_id, tr_case_id FROM automation_testrail_link)"
ISSUES = "iss AS (SELECT issue_key, summary AS t FROM jira_issue)"
BRIDGE_A = "ba AS (SELECT DISTINCT l.issue_key, c.tr_case_id FROM jira_automation_link l JOIN cl c ON c.test_case_id = l.test_case_id WHERE c.tr_case_id NOT IN (SELECT tr_case_id FROM ex))"
BRIDGE_B = f"bb AS (SELECT DISTINCT i.issue_key, c.tr_case_id FROM (SELECT issue_key, {NORMAL} AS n FROM iss) i JOIN (SELECT tr_case_id, {NORMAL} AS n FROM cs) c ON c.n = i.n AND i.n <> '' WHERE c.tr_case_id NOT IN (SELECT tr_case_id FROM ex) AND c.tr_case_id NOT IN (SELECT tr_case_id FROM ba))"


def _jaccard_sql(least: float) -> str:
    return f"len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= {least}"


BRIDGE_C = f"""sc AS (SELECT tr_case_id, list_distinct({V3}) AS w FROM cs WHERE tr_case_id NOT IN (SELECT tr_case_id FROM ex) AND tr_case_id NOT IN (SELECT tr_case_id FROM ba) AND tr_case_id NOT IN (SELECT tr_case_id FROM bb)),
si AS (SELECT issue_key, list_distinct({V3}) AS w FROM iss),
sp AS (SELECT b.issue_key, a.tr_case_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS score FROM sc a JOIN si b ON len(a.w) > 0 AND len(b.w) > 0 AND {_jaccard_sql(0.45)}),
sr AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM sp WINDOW w AS (PARTITION BY tr_case_id ORDER BY score DESC, issue_key)),
bc AS (SELECT issue_key, tr_case_id, score FROM sr WHERE rn = 1 AND (nxt IS NULL OR score - nxt >= 0.15))"""


def _waterfall(v: Views) -> DataFrame:
    return inference.bridge_waterfall(v.jira_automation_link, v.automation_testrail_link, v.jira_issue, _cases(v), _explicit(v))


def run_selection(v: Views) -> DataFrame:
    """Runs by each way to ask for them: an id, a job's build, a moment."""
    runs = v.base("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("job_name"), (F.col("o_orderkey") % 50).cast("int").alias("build_number"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    ways = {"id": {"run_id": 7}, "build": {"job": "1-URGENT", "build": 7}, "since": {"since": dt.datetime(1998, 1, 1, tzinfo=dt.UTC)}}
    out = [export.selected_runs(runs, **how).select(F.lit(name).alias("way"), "run_id") for name, how in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def env_merge(v: Views) -> DataFrame:
    """A base environment with the entries of a JSON text over it; texts that are none change nothing."""
    s = v.base("supplier")
    base = F.create_map(F.lit("CI"), F.lit("1"), F.lit("name"), F.col("s_name"))
    extra = F.when(F.col("s_suppkey") % 3 == 0, "not json").otherwise(F.to_json(F.struct(F.upper("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))))
    env = tx.merged_env(base, extra)
    return s.select("s_suppkey", F.element_at(env, F.lit("CI")).alias("ci"), F.element_at(env, F.lit("name")).alias("name"), F.try_element_at(env, F.lit("nation")).alias("nation"))


def section_chain(v: Views) -> DataFrame:
    """Sections in chains of a thousand, each part below the one before it."""
    p, n = v.base("part"), F.col("p_partkey")
    return sections.section_paths(p.select(n.cast("long").alias("id"), F.when(n % 1000 != 1, n - 1).cast("long").alias("parent_id"), F.col("p_size").cast("string").alias("name")))


CHAIN = "SELECT p_partkey AS id, string_agg(CAST(p_size AS STRING), ' / ') OVER (PARTITION BY floor((p_partkey - 1) / 1000) ORDER BY p_partkey) AS path FROM part"


# Flakes ---------------------------------------------------------------------------------------------------

def _groups(v: Views) -> DataFrame:
    return flake_job.flake_groups(v.test_execution, v.as_of)


GROUPS = f"""g AS (SELECT test_case_id, count(*) AS total, count(*) FILTER (WHERE status = 'PASSED') AS passed, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'FLAKY') AS flaky,
  count(*) FILTER (WHERE status = 'ERROR') AS error, count(*) FILTER (WHERE status <> 'PASSED' AND error_text <> '') AS messages,
  count(DISTINCT substr(sha256(regexp_replace(regexp_replace(error_text, '[0-9]+:[0-9]+', '0:0', 'g'), '/[^\\s]*\\.(spec|test)\\.(ts|js)', '<f>', 'g')), 1, 16)) AS hashes
  FROM test_execution WHERE run_at >= {SQL_AS_OF} - INTERVAL '30' DAY AND run_at < {SQL_AS_OF} AND status <> 'SKIPPED' GROUP BY test_case_id HAVING count(*) >= 5),
gs AS (SELECT *, (flaky + least(failed, passed)) / total AS flake_score FROM g),
gd AS (SELECT *, CASE WHEN messages = 0 THEN 'UNKNOWN' WHEN hashes = 1 THEN 'PRODUCT_BUG' WHEN hashes > 1 THEN 'TEST_CODE' ELSE 'UNKNOWN' END AS classification,
  CASE WHEN flake_score >= 0.5 THEN 'quarantine' WHEN flake_score >= 0.25 THEN 'assign' ELSE 'rerun' END AS recommended_action FROM gs WHERE flake_score >= 0.1)"""


def _decisions(v: Views) -> DataFrame:
    """Open decisions of an earlier window (a shorter one), as the job had written them."""
    earlier = v.as_of - dt.timedelta(days=10)
    groups = flake_job.flake_groups(v.test_execution, earlier, 20, 3)
    return flake_job.flake_decisions(groups, earlier, 20).select("test_case_id", "recommended_action", "notes", F.lit(None).cast("timestamp_ntz").alias("approved_at"))


EARLIER = f"""ge AS (SELECT test_case_id, count(*) AS total, (count(*) FILTER (WHERE status = 'FLAKY') + least(count(*) FILTER (WHERE status = 'FAILED'), count(*) FILTER (WHERE status = 'PASSED'))) / count(*) AS score
  FROM test_execution WHERE run_at >= {SQL_AS_OF} - INTERVAL '30' DAY AND run_at < {SQL_AS_OF} - INTERVAL '10' DAY AND status <> 'SKIPPED' GROUP BY test_case_id HAVING count(*) >= 3),
od AS (SELECT test_case_id, CASE WHEN score >= 0.5 THEN 'quarantine' WHEN score >= 0.25 THEN 'assign' ELSE 'rerun' END AS recommended_action FROM ge WHERE score >= 0.1)"""


# Merges ---------------------------------------------------------------------------------------------------

def _target(v: Views) -> DataFrame:
    return v.base("orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def _source(v: Views) -> DataFrame:
    changed = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_totalprice").cast("double") + 1)
    return v.base("orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), changed.alias("o_totalprice"))


MERGE = """tg AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
sr AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"""


def _merge_sql(price: str, status: str) -> str:
    return f"WITH {MERGE} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey, {status} AS o_orderstatus, {price} AS o_totalprice FROM tg t FULL JOIN sr s ON s.o_orderkey = t.o_orderkey"


def _events_batch(v: Views) -> DataFrame:
    return v.base("events").select("user_id", "ts", "event_type", F.floor(F.col("value") * 100).cast("long").alias("cents"))


def _sections(v: Views) -> DataFrame:
    region = v.base("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nation = v.base("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name"))
    supplier = v.base("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent_id"), F.col("s_name").alias("name"))
    return region.unionByName(nation).unionByName(supplier)


SECTIONS = """WITH RECURSIVE s AS (SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name FROM region
  UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name FROM nation
  UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), s_name FROM supplier),
p AS (SELECT id, name AS path FROM s WHERE parent_id IS NULL UNION ALL SELECT s.id, concat(p.path, ' / ', s.name) FROM p JOIN s ON s.parent_id = p.id)
SELECT id, path FROM p"""


# Export ---------------------------------------------------------------------------------------------------

def _artifacts(v: Views) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".webm", ".png", ".zip", ".txt", ".bin"))), (F.col("event_id") % 5 + 1).cast("int"))
    return v.base("events").select(F.concat(F.lit("builds/"), F.col("event_id").cast("string"), F.lit("/x"), suffix).alias("uri"), (F.col("ts") - F.expr("INTERVAL 70 DAYS")).alias("created_at"))


def _local_artifacts(v: Views) -> tuple[DataFrame, DataFrame]:
    e = v.base("events")
    build = F.col("event_id").cast("string").alias("build")
    uri = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("gs://b/builds/"), F.col("event_id").cast("string"), F.lit("/log/a.txt"))).otherwise(F.concat(F.lit("file:///tmp/"), F.col("event_id").cast("string"), F.lit(".txt")))
    stored = e.where("event_id % 3 <> 0").select(F.concat(F.lit("builds/"), F.col("event_id").cast("string"), F.lit("/log/"), F.col("event_id").cast("string"), F.lit(".txt")).alias("object_key"))
    return e.select(build, F.lit("log").alias("category"), uri.alias("uri")), stored


def _executions(v: Views) -> DataFrame:
    ids = F.when(F.col("id") % 6 == 0, F.array(F.col("id") % 100)).otherwise(F.array().cast("array<bigint>"))
    return v.test_execution.select((F.col("id") % 50).alias("run_id"), "test_case_id", F.concat(F.lit("test "), F.col("test_case_id").cast("string")).alias("title"), "status", "error_text", (F.col("id") * 37 % 200000).alias("duration_ms"), ids.alias("annotation_ids"))


def _found_links(v: Views) -> DataFrame:
    """Links that the key inference finds, beside the bound ones of all provenances."""
    found = inference.embedded_key_links(_keyed_tests(v), v.jira_issue)[0]
    return found.select("issue_key", "test_case_id", F.lit("LOW").alias("confidence"), "evidence")


def _old_links(v: Views) -> DataFrame:
    return v.jira_automation_link.select("issue_key", "test_case_id", "provenance", "confidence", F.lit("old").alias("evidence"), F.lit("job").alias("source"))


def _upserted(v: Views) -> DataFrame:
    return merge.upsert_links(_old_links(v), _found_links(v), ["issue_key", "test_case_id"], "INFERRED", "name-inference")


def _noted_executions(v: Views) -> DataFrame:
    """The executions of the export, with annotations instead of case ids: every sixth names a case, all have another note."""
    note = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("description"))
    case = F.when(F.col("id") % 6 == 0, F.array(note("TestRail", F.concat(F.lit("C"), (F.col("id") % 100).cast("string"))))).otherwise(F.array().cast("array<struct<type:string,description:string>>"))
    notes = F.concat(case, F.array(note("issue", F.lit("C77"))))
    return v.test_execution.select((F.col("id") % 50).alias("run_id"), "test_case_id", F.concat(F.lit("test "), F.col("test_case_id").cast("string")).alias("title"), "status", "error_text", (F.col("id") * 37 % 200000).alias("duration_ms"), export.annotation_case_ids(notes).alias("annotation_ids"))


def _export(v: Views) -> tuple[DataFrame, DataFrame]:
    """The export of the runs (all that the executions have) that were created in the last twenty days, over links of MED or more."""
    e = _noted_executions(v)
    created = F.lit(v.as_of).cast("timestamp_ntz") - F.make_dt_interval(F.col("run_id").cast("int"))
    runs = e.select("run_id").distinct().select("run_id", F.lit("e2e").alias("job_name"), (F.col("run_id") % 10).cast("int").alias("build_number"), created.alias("created_at"))
    rank = (F.col("test_case_id") + F.col("tr_case_id")) % 3
    links = v.automation_testrail_link.withColumn("confidence", F.when(rank == 0, "HIGH").when(rank == 1, "MED").otherwise("LOW"))
    return export.export_runs(export.selected_runs(runs, since=v.as_of - dt.timedelta(days=20)), e, links)


EXPORT = """x AS (SELECT id % 50 AS run_id, test_case_id, status, id FROM test_execution WHERE id % 50 <= 20),
y AS (SELECT x.*, id % 100 AS case_id FROM x WHERE id % 6 = 0 UNION ALL SELECT x.*, l.tr_case_id FROM x JOIN automation_testrail_link l ON l.test_case_id = x.test_case_id AND (l.test_case_id + l.tr_case_id) % 3 < 2 WHERE id % 6 <> 0)"""
UPSERT = f"""{KEYED}, fl AS (SELECT issue_key, test_case_id FROM o WHERE issue_key IN (SELECT issue_key FROM jira_issue)),
un AS (SELECT coalesce(l.issue_key, f.issue_key) AS issue_key, coalesce(l.test_case_id, f.test_case_id) AS test_case_id, coalesce(l.provenance, 'INFERRED') AS provenance, CASE WHEN f.issue_key IS NULL THEN l.confidence ELSE 'LOW' END AS confidence, f.issue_key IS NOT NULL AS written
  FROM jira_automation_link l FULL JOIN fl f ON f.issue_key = l.issue_key AND f.test_case_id = l.test_case_id AND l.provenance = 'INFERRED')"""


# Small expressions and writes ----------------------------------------------------------------------------

def _text_parts(v: Views) -> DataFrame:
    """Test ids, cut texts, branches and run names of parts."""
    k = F.col("p_partkey")
    n = k.cast("string")
    file, title = tx.split_test_id(F.concat(F.lit("tests/u"), (k % 50).cast("string"), F.lit(".spec.ts::"), "p_type", F.lit(" > "), "p_name"))
    name = tx.run_name(F.when(k % 2 == 0, "job"), F.when(k % 3 == 0, k), F.concat(n, F.lit("-0123456789")), F.to_timestamp(F.lit("2024-01-31")))
    return v.base("part").select(k.alias("id"), file.alias("file"), title.alias("title"), tx.truncated(F.col("p_name"), 10, "…").alias("cut"), tx.branch_name(F.concat(F.lit("origin/"), "p_type")).alias("branch"), name.alias("run"), tx.snippet(F.concat(F.lit("abcdefghijklmnopqrstuvwxyz"), n, F.lit(" tail")), n).alias("near"))


#: Failures by the last digit of events; those at 3 and 7 aren't of infrastructure.
MESSAGES = ("Timed out waiting", "read ECONNRESET", "Browser crashed hard", "expected 3 to equal 4", "net: Network   Error", "java: Out of  memory", "Timeout of 30s", "element not found")


def _infra(v: Views) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    return v.base("events").groupBy("user_id").agg(F.count_if(tx.is_infra(message)).alias("infra"), F.count(F.lit(1)).alias("failures"))


def _artifact_kinds(v: Views) -> DataFrame:
    mime = F.element_at(F.array(*map(F.lit, ("image/png", "video/webm", "application/zip", "text/plain", "application/json"))), (F.col("event_id") % 5 + 1).cast("int"))
    name = F.when(F.col("event_id") % 10 == 3, "my_trace").otherwise("file")
    return v.base("events").groupBy(playwright.artifact_kind(mime, name).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _backfilled(v: Views) -> DataFrame:
    """Executions without a test get the one of their identity."""
    rows = v.test_execution.select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("test_case_id").cast("string"), 9, "0")).alias("identity_key"), F.when(F.col("id") % 4 != 0, F.col("test_case_id")).cast("long").alias("test_case_id"))
    return merge.backfill(rows, "test_case_id", v.test_case.select("identity_key", F.col("id").cast("long").alias("found")), "identity_key", "found")


def _decided(v: Views) -> DataFrame:
    """Decisions of half of the tests of a window, and found ones of an earlier or a later window."""
    day = lambda n: F.lit((v.as_of - dt.timedelta(days=n)).date().isoformat())
    old = v.test_case.where("id % 2 = 0").select(F.col("id").alias("test_case_id"), day(30).alias("window_start"), F.lit("old").alias("recommended_action"))
    new = v.test_case.select(F.col("id").alias("test_case_id"), F.when(F.col("id") % 3 == 0, day(40)).otherwise(day(10)).alias("window_start"), F.lit("new").alias("recommended_action"))
    return merge.upsert_decisions(old, new)


_DAYS_AGO = "strftime({} - INTERVAL '{}' DAY, '%Y-%m-%d')"
_D10, _D30, _D40 = (_DAYS_AGO.format(SQL_AS_OF, n) for n in (10, 30, 40))


#: name: (query over the views, SQL)
QUERIES = {
    "text_parts": (_text_parts, """SELECT p_partkey AS id, concat('tests/u', CAST(p_partkey % 50 AS STRING), '.spec.ts') AS file, p_name AS title, CASE WHEN length(p_name) > 10 THEN concat(left(p_name, 10), '…') ELSE p_name END AS cut, p_type AS branch,
  concat(CASE WHEN p_partkey % 2 = 0 THEN 'job' ELSE 'playwright' END, ' ', CASE WHEN p_partkey % 3 = 0 THEN concat('#', CAST(p_partkey AS STRING)) ELSE left(concat(CAST(p_partkey AS STRING), '-0123456789'), 8) END, ' — 2024-01-31') AS run, concat('…ghijklmnopqrstuvwxyz', CAST(p_partkey AS STRING), ' tail') AS near FROM part"""),
    "infra_failures": (_infra, "SELECT user_id, count(*) FILTER (WHERE event_id % 8 NOT IN (3, 7)) AS infra, count(*) AS failures FROM events GROUP BY user_id"),
    "artifact_kinds": (_artifact_kinds, "SELECT CASE WHEN event_id % 5 = 0 THEN 'screenshot' WHEN event_id % 5 = 1 THEN 'video' WHEN event_id % 5 = 2 OR event_id % 10 = 3 THEN 'trace' ELSE 'attachment' END AS kind, count(*) AS n FROM events GROUP BY 1"),
    "execution_backfill": (_backfilled, over_views("SELECT e.id, concat('Customer#', lpad(CAST(e.test_case_id AS STRING), 9, '0')) AS identity_key, CAST(CASE WHEN e.id % 4 <> 0 THEN e.test_case_id ELSE t.id END AS BIGINT) AS test_case_id FROM test_execution e LEFT JOIN test_case t ON t.identity_key = concat('Customer#', lpad(CAST(e.test_case_id AS STRING), 9, '0'))")),
    "decision_upsert": (_decided, over_views(f"SELECT id AS test_case_id, {_D30} AS window_start, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS recommended_action FROM test_case WHERE id % 2 = 0 UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN {_D40} ELSE {_D10} END, 'new' FROM test_case WHERE id % 2 <> 0 OR id % 3 <> 0")),
    "results_watermark": (lambda v: merge.latest_moment(v.testrail_result, "tested_at"), over_views("SELECT max(tested_at) - INTERVAL '1' HOUR AS since FROM testrail_result")),
    "link_upsert": (lambda v: _upserted(v).select("issue_key", "test_case_id", "provenance", "confidence"), over_views("").rstrip() + f",\n{UPSERT} SELECT issue_key, test_case_id, provenance, confidence FROM un"),
    "link_counts": (lambda v: merge.link_counts(_old_links(v), _upserted(v), ["issue_key", "test_case_id"]), over_views("").rstrip() + f",\n{UPSERT} SELECT provenance, confidence, count(*) FILTER (WHERE written) AS written, count(*) FILTER (WHERE NOT written) AS unchanged, CAST(0 AS BIGINT) AS removed FROM un GROUP BY provenance, confidence"),
    "export_selected": (lambda v: _export(v)[1].select("run_id", "case_id", "status_id"), over_views("").rstrip() + f",\n{EXPORT} SELECT run_id, case_id, CASE status WHEN 'PASSED' THEN 1 WHEN 'FLAKY' THEN 4 WHEN 'SKIPPED' THEN 3 ELSE 5 END AS status_id FROM y"),
    "export_runs": (lambda v: _export(v)[0].select("run_id", "name", F.array_join(F.transform("case_ids", lambda x: x.cast("string")), ",").alias("cases"), "n_results"), over_views("").rstrip() + f",\n{EXPORT} SELECT run_id, concat('e2e #', CAST(run_id % 10 AS STRING), ' — ', strftime({SQL_AS_OF} - to_days(CAST(run_id AS INT)), '%Y-%m-%d')) AS name, array_to_string(list_sort(list_distinct(list(case_id))), ',') AS cases, count(*) AS n_results FROM y GROUP BY run_id"),
    "key_links": (lambda v: inference.embedded_key_links(_keyed_tests(v), v.jira_issue)[0].select("issue_key", "test_case_id", "field"), over_views("").rstrip() + f",\n{KEYED} SELECT issue_key, test_case_id, field FROM o WHERE issue_key IN (SELECT issue_key FROM jira_issue)"),
    "skipped_keys": (lambda v: inference.embedded_key_links(_keyed_tests(v), v.jira_issue)[1].groupBy("issue_key").agg(F.count(F.lit(1)).alias("n")), over_views("").rstrip() + f",\n{KEYED} SELECT issue_key, count(*) AS n FROM o WHERE issue_key NOT IN (SELECT issue_key FROM jira_issue) GROUP BY issue_key"),
    "tokens_titles": (lambda v: _joined(v.base("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("t")), tx.title_tokens(F.col("t"))), _tokens_sql("SELECT conv_id * 100 + turn AS id, text AS t FROM conversations", V1)),
    "tokens_cases": (lambda v: _joined(v.base("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("test_"), "p_type", F.lit("."), "p_name").alias("t")), tx.case_tokens(F.col("t"))), _tokens_sql("SELECT p_partkey AS id, concat('test_', p_type, '.', p_name) AS t FROM part", V2)),
    "tokens_summaries": (lambda v: _joined(v.base("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Verify that  the "), "p_name").alias("t")), tx.summary_tokens(tx.normal_title(F.col("t")))), _tokens_sql("SELECT p_partkey AS id, concat('Verify that  the ', p_name) AS t FROM part", V3)),
    "title_similarity": (lambda v: inference.similar_title_links(_named_tests(v), v.jira_issue), over_views("").rstrip() + f""",\n{TESTS},
a AS (SELECT id, list_distinct({V1}) AS w FROM ts), b AS (SELECT issue_key, list_distinct({V1}) AS w FROM (SELECT issue_key, summary AS t FROM jira_issue WHERE issue_type IN ('Story', 'Bug', 'Task')) x)
SELECT issue_key, test_case_id, score, CASE WHEN score >= 0.4 THEN 'MED' ELSE 'LOW' END AS confidence FROM (SELECT b.issue_key, a.id AS test_case_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS score
  FROM a JOIN b ON len(a.w) > 0 AND len(b.w) > 0) y WHERE score >= 0.2"""),
    "title_links": (lambda v: inference.jaccard_links(*_title_sets(v), 0.2), over_views("").rstrip() + f""",\n{ALL_TESTS},
a AS (SELECT id, list_sort(list_distinct({V1})) AS w FROM ts), b AS (SELECT list_sort(list_distinct({V1})) AS w, count(*) AS n FROM (SELECT issue_key, summary AS t FROM jira_issue) x GROUP BY ALL),
k AS (SELECT w, min(id) AS class_id FROM a WHERE len(w) > 0 GROUP BY w),
s AS (SELECT k.w, b.n, len(list_intersect(k.w, b.w)) / (len(k.w) + len(b.w) - len(list_intersect(k.w, b.w))) AS score FROM k JOIN b ON len(b.w) > 0),
g AS (SELECT w, sum(n) AS links, max(score) AS best FROM s WHERE score >= 0.2 GROUP BY w)
SELECT id, class_id, CAST(coalesce(links, 0) AS BIGINT) AS links, best FROM a JOIN k USING (w) LEFT JOIN g USING (w)"""),
    "title_classes": (lambda v: inference.title_classes(v.jira_issue, _cases(v), _explicit(v), inference.bridge_by_test(v.jira_automation_link, v.automation_testrail_link, _explicit(v))), over_views("").rstrip() + f""",\n{CASE_LINKS}, {EXPLICIT}, {CASES}, {ISSUES}, {BRIDGE_A}, {BRIDGE_B}
SELECT tr_case_id, min(tr_case_id) OVER (PARTITION BY n) AS class_id, links FROM (SELECT tr_case_id, count(*) AS links FROM bb GROUP BY tr_case_id) x JOIN (SELECT tr_case_id, {NORMAL} AS n FROM cs) c USING (tr_case_id)"""),
    "overlap_topk": (lambda v: inference.overlapping_case_links(_all_tests(v), _cases(v)), over_views("").rstrip() + f""",\n{ALL_TESTS}, {CASES},
a AS (SELECT id, list_sort(list_distinct({V2})) AS w FROM ts), b AS (SELECT tr_case_id, list_sort(list_distinct({V2})) AS w FROM cs),
p AS (SELECT x.w AS aw, y.w AS bw, len(list_filter(x.w, lambda u: len(list_filter(y.w, lambda o: contains(o, u) OR contains(u, o))) > 0)) / len(x.w) AS score FROM (SELECT DISTINCT w FROM a WHERE len(w) > 0) x, (SELECT DISTINCT w FROM b) y),
s AS (SELECT a.id AS test_case_id, b.tr_case_id, score FROM p JOIN a ON a.w = aw JOIN b ON b.w = bw WHERE score >= 0.3)
SELECT test_case_id, tr_case_id, score, CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MED' ELSE 'LOW' END AS confidence FROM s
QUALIFY row_number() OVER (PARTITION BY test_case_id ORDER BY score DESC, tr_case_id) <= 5"""),
    "bridge_by_test": (lambda v: inference.bridge_by_test(v.jira_automation_link, v.automation_testrail_link, _explicit(v)), over_views("").rstrip() + f",\n{CASE_LINKS}, {EXPLICIT}, {BRIDGE_A} SELECT * FROM ba"),
    "bridge_by_title": (lambda v: inference.bridge_by_title(v.jira_issue, _cases(v), _explicit(v), inference.bridge_by_test(v.jira_automation_link, v.automation_testrail_link, _explicit(v))), over_views("").rstrip() + f",\n{CASE_LINKS}, {EXPLICIT}, {CASES}, {ISSUES}, {BRIDGE_A}, {BRIDGE_B} SELECT * FROM bb"),
    "bridge_waterfall": (_waterfall, over_views("").rstrip() + f",\n{CASE_LINKS}, {EXPLICIT}, {CASES}, {ISSUES}, {BRIDGE_A}, {BRIDGE_B}, {BRIDGE_C} SELECT issue_key, tr_case_id, 'A' AS strategy, 'HIGH' AS confidence FROM ba UNION ALL SELECT issue_key, tr_case_id, 'B', 'MED' FROM bb UNION ALL SELECT issue_key, tr_case_id, 'C', 'MED' FROM bc"),
    "similarity_gap": (lambda v: inference.bridge_by_similarity(_titles(v), _cases(v), _explicit(v), _explicit(v)), over_views("").rstrip() + f",\n{EXPLICIT}, {CASES}, iss AS (SELECT min(issue_key) AS issue_key, summary AS t FROM jira_issue GROUP BY summary), ba AS (SELECT tr_case_id FROM ex), bb AS (SELECT tr_case_id FROM ex), {BRIDGE_C} SELECT issue_key, tr_case_id, score FROM bc"),
    "anchor_links": (lambda v: inference.anchor_links(v.test_case, v.jira_issue.select("issue_key", F.concat(F.lit("test_Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("title")))[0].select("issue_key", "test_case_id"), over_views("SELECT i.issue_key, t.id AS test_case_id FROM jira_issue i JOIN test_case t ON t.title = concat('test_Customer#', lpad(CAST(i.p_partkey AS STRING), 9, '0'))")),
    "flake_scores": (lambda v: _groups(v).select("test_case_id", "total", "passed", "failed", "flaky", "error", "flake_score"), over_views("").rstrip() + f",\n{GROUPS} SELECT test_case_id, total, passed, failed, flaky, error, flake_score FROM gs"),
    "flake_decisions": (lambda v: flake_job.flake_decisions(_groups(v), v.as_of).select("test_case_id", "total", "flake_score", "hashes", "classification", "recommended_action"), over_views("").rstrip() + f",\n{GROUPS} SELECT test_case_id, total, flake_score, hashes, classification, recommended_action FROM gd"),
    "flake_resolve": (lambda v: flake_job.resolve_decisions(_decisions(v), _groups(v), 0.2).select("test_case_id", "recommended_action"), over_views("").rstrip() + f",\n{GROUPS}, {EARLIER} SELECT o.test_case_id, CASE WHEN g.flake_score < 0.2 THEN 'ignore' ELSE o.recommended_action END AS recommended_action FROM od o LEFT JOIN gs g ON g.test_case_id = o.test_case_id"),
    "merge_overwrite": (lambda v: merge.merge(_target(v), _source(v), ["o_orderkey"]), _merge_sql("CASE WHEN s.o_orderkey IS NULL THEN t.o_totalprice ELSE s.o_totalprice END", "coalesce(s.o_orderstatus, t.o_orderstatus)")),
    "merge_coalesce": (lambda v: merge.merge(_target(v), _source(v), ["o_orderkey"], {"o_totalprice": merge.NEW_UNLESS_NULL, "o_orderstatus": merge.OLD_UNLESS_NULL}), _merge_sql("coalesce(s.o_totalprice, t.o_totalprice)", "coalesce(t.o_orderstatus, s.o_orderstatus)")),
    "merge_counts": (lambda v: merge.merge_counts(_target(v), merge.merge(_target(v), _source(v), ["o_orderkey"]), ["o_orderkey"]), f"WITH {MERGE} SELECT count(*) FILTER (WHERE t.o_orderkey IS NULL) AS inserted, count(*) FILTER (WHERE t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL) AS changed, count(*) FILTER (WHERE s.o_orderkey IS NULL) AS unchanged, CAST(0 AS BIGINT) AS removed FROM tg t FULL JOIN sr s ON s.o_orderkey = t.o_orderkey"),
    "merge_insert_if_absent": (lambda v: merge.insert_if_absent(_target(v), _source(v), ["o_orderkey"]), f"WITH {MERGE} SELECT * FROM tg UNION ALL SELECT * FROM sr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tg)"),
    "merge_last_write": (lambda v: merge.last_write_wins(_events_batch(v), ["user_id"], [F.desc("ts")]), "SELECT user_id, ts, event_type, CAST(floor(value * 100) AS BIGINT) AS cents FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"),
    "merge_link_reset": (lambda v: merge.reset_links(v.jira_automation_link, "INFERRED"), over_views("SELECT * FROM jira_automation_link WHERE provenance <> 'INFERRED'")),
    "high_water_mark": (lambda v: merge.high_water_mark(v.base("orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("m")), "o_orderpriority", "m"), "SELECT min(m) - INTERVAL '1' HOUR AS since FROM (SELECT o_orderpriority, max(CAST(o_orderdate AS TIMESTAMP)) AS m FROM orders GROUP BY 1) x"),
    "section_chain": (section_chain, CHAIN),
    "run_selection": (run_selection, """SELECT 'id' AS way, o_orderkey AS run_id FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'build', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 7
  UNION ALL SELECT 'since', o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01'"""),
    "env_merge": (env_merge, "SELECT s_suppkey, '1' AS ci, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE upper(s_name) END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier"),
    "flake_notes": (lambda v: flake_job.flake_decisions(_groups(v), v.as_of).select("test_case_id", "notes"), over_views("").rstrip() + f""",\n{GROUPS} SELECT test_case_id, printf('%d run(s) in window: %d passed, %d failed, %d flaky, %d error. Score=%.1f%% class=%s uniqueErrorHashes=%d', total, passed, failed, flaky, error, floor(flake_score * 1000 + 0.5) / 10, classification, hashes) AS notes FROM gd"""),
    "section_path": (lambda v: sections.section_paths(_sections(v)), SECTIONS),
    "snapshot_row": (lambda v: export.snapshot_row(v.executed_summary, v.as_of), over_views(f"SELECT * EXCLUDE (as_of_date), {SQL_AS_OF} AS taken_at FROM v_executed_summary")),
    "expired_artifacts": (lambda v: export.expired_artifacts(_artifacts(v), v.as_of).select("uri", "age_days"), f"""SELECT uri, age_days FROM (SELECT concat('builds/', CAST(event_id AS STRING), '/x', CASE event_id % 5 WHEN 0 THEN '.webm' WHEN 1 THEN '.png' WHEN 2 THEN '.zip' WHEN 3 THEN '.txt' ELSE '.bin' END) AS uri,
  CAST({SQL_AS_OF} AS DATE) - CAST(ts - INTERVAL '70' DAY AS DATE) AS age_days, CASE event_id % 5 WHEN 0 THEN 30 WHEN 4 THEN NULL ELSE 90 END AS keep FROM events) x WHERE age_days > keep"""),
    "uri_backfill": (lambda v: export.backfill_uris(*_local_artifacts(v), "b"), """SELECT CAST(event_id AS STRING) AS build, 'log' AS category, CASE WHEN event_id % 4 = 0 THEN concat('gs://b/builds/', CAST(event_id AS STRING), '/log/a.txt')
  WHEN event_id % 3 <> 0 THEN concat('gs://b/builds/', CAST(event_id AS STRING), '/log/', CAST(event_id AS STRING), '.txt') ELSE 'gs://MISSING' END AS uri FROM events"""),
    "export_payload": (lambda v: export.export_results(_executions(v), v.automation_testrail_link), over_views("").rstrip() + """,
x AS (SELECT id % 50 AS run_id, test_case_id, concat('test ', CAST(test_case_id AS STRING)) AS title, status, error_text, id * 37 % 200000 AS ms, id FROM test_execution),
y AS (SELECT x.*, id % 100 AS case_id FROM x WHERE id % 6 = 0 UNION ALL SELECT x.*, l.tr_case_id FROM x JOIN automation_testrail_link l ON l.test_case_id = x.test_case_id WHERE id % 6 <> 0)
SELECT run_id, case_id, CASE status WHEN 'PASSED' THEN 1 WHEN 'FLAKY' THEN 4 WHEN 'SKIPPED' THEN 3 ELSE 5 END AS status_id,
  concat('Playwright: ', status, CASE WHEN error_text <> '' THEN concat(chr(10), 'Failure:', chr(10), error_text) ELSE '' END, chr(10), 'Test: ', title) AS comment,
  CASE WHEN floor(ms / 1000 + 0.5) >= 60 THEN concat(CAST(CAST(floor(floor(ms / 1000 + 0.5) / 60) AS BIGINT) AS STRING), 'm ', CAST(CAST(floor(ms / 1000 + 0.5) AS BIGINT) % 60 AS STRING), 's') ELSE concat(CAST(CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS STRING), 's') END AS elapsed FROM y"""),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items()}
