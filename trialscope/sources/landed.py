"""Landed API pages and manifests as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMED = "struct<name:string>"
_ISSUE = f"array<struct<id:string,key:string,fields:struct<summary:string,status:{_NAMED},issuetype:{_NAMED},priority:{_NAMED},labels:array<string>,created:string,updated:string,resolutiondate:string,parent:struct<key:string>,project:struct<key:string>,customfield_10014:string>>>"
_CASE = "struct<id:bigint,title:string,section_id:bigint,suite_id:bigint,priority_id:bigint,refs:string,updated_on:bigint>"
_MANIFEST = "schema string, jobName string, buildNumber int, framework string, resultFiles array<string>, branch string, gitSha string, startedAt string, finishedAt string, environment string, suiteName string, ciProvider string, buildUrl string, shardIndex int, shardTotal int, project string, artifactFiles array<string>, extraEnv map<string,string>"
FRAMEWORKS = ("pytest", "playwright", "junit")


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """text of whole landed pages."""
    return spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"))


def issues(pages: DataFrame) -> DataFrame:
    """jira_issue rows; the epic is the parent or the epic-link field, the project a prefix of the key at need."""
    i = pages.select(F.explode(F.from_json("text", f"issues {_ISSUE}")["issues"]).alias("i")).select("i.key", "i.fields.*", F.to_json("i").alias("raw"))
    none = lambda c: F.nullif(c, F.lit(""))
    return i.select(
        F.col("key").alias("issue_key"), F.coalesce("issuetype.name", F.lit("Unknown")).alias("issue_type"), "summary", F.col("status.name").alias("status"),
        F.coalesce(none(F.col("parent.key")), none(F.col("customfield_10014"))).alias("parent_key"), F.coalesce(none(F.col("project.key")), F.split_part("key", F.lit("-"), F.lit(1))).alias("project_key"),
        F.col("priority.name").alias("priority"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        *(F.try_to_timestamp(c).alias(n) for c, n in (("created", "created_at"), ("updated", "updated_at"), ("resolutiondate", "resolved_at"))), "raw",
    )


def cases(pages: DataFrame, section_paths: DataFrame) -> DataFrame:
    """testrail_case rows of pages that are a bare array or {cases: [...]}, with the path of their section and the record as it came (raw)."""
    bare, wrapped = F.from_json("text", f"array<{_CASE}>"), F.from_json("text", f"cases array<{_CASE}>")["cases"]
    custom = lambda t: F.map_filter(F.from_json(t, "map<string,string>"), lambda k, v: k.startswith("custom_"))
    texts = F.coalesce(F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")), F.from_json("text", "cases array<string>")["cases"])
    c = pages.select(F.explode(F.arrays_zip(F.coalesce(F.when(F.ltrim("text").startswith("["), bare), wrapped).alias("c"), texts.alias("t"))).alias("z")).select("z.c.*", custom(F.col("z.t")).alias("custom"), F.col("z.t").alias("raw"))
    out = c.join(section_paths.select(F.col("id").alias("section_id"), F.col("path").alias("section_path")), "section_id", "left")
    return out.select(F.col("id").alias("tr_case_id"), "title", "section_path", "suite_id", F.col("priority_id").alias("priority"), "refs", F.timestamp_seconds(F.nullif("updated_on", F.lit(0))).alias("updated_at"), "custom", "raw")


def results(pages: DataFrame, known_cases: DataFrame) -> DataFrame:
    """testrail_result rows with id, run and case, of cases that are known."""
    row = "struct<id:bigint,test_id:bigint,case_id:bigint,run_id:bigint,status_id:int,created_on:bigint>"
    r = pages.select(F.explode(F.from_json("text", f"results array<{row}>")["results"]).alias("r")).select("r.*").dropna(subset=["id", "case_id", "run_id"])
    out = r.select(F.col("id").alias("tr_result_id"), F.col("run_id").alias("tr_run_id"), F.col("case_id").alias("tr_case_id"), "status_id", F.timestamp_seconds(F.nullif("created_on", F.lit(0))).alias("tested_at"))
    return out.join(known_cases.select("tr_case_id"), "tr_case_id", "left_semi")


def manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, rejects) of manifest files (path, text): defaults are filled in; each reject has its reason."""
    m = files.where(F.col("path").rlike(r"/manifest(-shard\d+)?\.json$")).select("path", "text", F.from_json("text", _MANIFEST).alias("m"))
    why = (
        F.when(F.col("m").isNull() | F.col("m.schema").isNull(), "not a manifest").when(F.col("m.schema") != "1", "unknown schema").when(F.col("m.jobName").isNull() | F.col("m.buildNumber").isNull(), "no build")
        .when(~F.coalesce(F.col("m.framework").isin(*FRAMEWORKS), F.lit(False)), "unknown framework").when(F.coalesce(F.size("m.resultFiles"), F.lit(0)) < 1, "no result files")
    )
    m = m.withColumn("reason", why)
    good = m.where("reason is null").select("path", "m.*").withColumns({"ciProvider": F.coalesce("ciProvider", F.lit("jenkins")), "artifactFiles": F.coalesce("artifactFiles", F.array().cast("array<string>"))})
    return good, m.where("reason is not null").select("path", "text", "reason")
