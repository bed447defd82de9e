"""JUnit XML reports as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscope.functions.text import case_ids, issue_keys_strict, seconds_to_ms

_TEXT = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_PROBLEM = T.ArrayType(_struct(_message=_TEXT, _type=_TEXT, _text=_TEXT))
_PROPERTY = T.ArrayType(_struct(_name=_TEXT, _value=_TEXT, _text=_TEXT))
_CASE = _struct(_classname=_TEXT, _name=_TEXT, _time=_TEXT, skipped=_PROBLEM, failure=_PROBLEM, error=_PROBLEM, properties=_struct(property=_PROPERTY), property=_PROPERTY)
SUITE = _struct(_name=_TEXT, _tests=_TEXT, _failures=_TEXT, _errors=_TEXT, _skipped=_TEXT, _time=_TEXT, _timestamp=_TEXT, _hostname=_TEXT, testcase=T.ArrayType(_CASE))


def read_suites(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row per <testsuite>, with its attributes, its cases, and the file that it is from."""
    raw = spark.read.format("xml").option("rowTag", "testsuite").option("valueTag", "_text").option("nullValue", "\x00").schema(SUITE).load(paths)
    n = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    total, failed, skipped, errors = n("_tests"), n("_failures"), n("_skipped"), n("_errors")
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.coalesce("_name", F.lit("default")).alias("suite_name"),
        total.alias("total_count"), failed.alias("fail_count"), skipped.alias("skip_count"), errors.alias("error_count"),
        F.greatest(F.lit(0), total - failed - skipped - errors).alias("pass_count"),
        seconds_to_ms(F.col("_time")).alias("duration_ms"), F.try_to_timestamp("_timestamp").alias("started_at"), "testcase",
    )


def build_number(path: Column) -> Column:
    """The number of a file named 918.xml; null for other names."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d+)\.xml$", 1), F.lit("")).cast("int")


def read_cases(suites: DataFrame, title_mode: str = "name") -> DataFrame:
    """A row per <testcase>: identity_key, title, status, duration_ms, error_message, stack_trace, properties.

    skipped comes before failure before error; else the case passed. title_mode 'classname' takes the
    class name as title, as older title maps expect.
    """
    c = suites.select("path", "suite_name", F.explode("testcase").alias("c")).select("path", "suite_name", "c.*")
    identity = F.trim(F.concat(F.coalesce("_classname", F.lit("")), F.lit("::"), F.coalesce("_name", F.lit(""))))
    title = F.coalesce(F.nullif("_classname" if title_mode == "classname" else "_name", F.lit("")), identity)
    problem = F.get(F.coalesce("skipped", "failure", "error"), F.lit(0))
    trouble = F.when(F.col("skipped").isNull(), F.get(F.coalesce("failure", "error"), F.lit(0)))
    props = F.concat(F.coalesce("properties.property", F.array().cast(_PROPERTY)), F.coalesce("property", F.array().cast(_PROPERTY)))
    return c.select(
        "path", "suite_name", identity.alias("identity_key"), title.alias("title"),
        F.when(F.col("skipped").isNotNull(), "SKIPPED").when(F.col("failure").isNotNull(), "FAILED").when(F.col("error").isNotNull(), "ERROR").otherwise("PASSED").alias("status"),
        seconds_to_ms(F.col("_time")).alias("duration_ms"), problem["_message"].alias("error_message"), F.nullif(F.trim(trouble["_text"], F.lit(" \t\r\n")), F.lit("")).alias("stack_trace"),
        F.transform(props, lambda p: F.struct(p["_name"].alias("name"), F.coalesce(p["_value"], F.trim(p["_text"])).alias("value"))).alias("properties"),
    )


def property_values(names: list[str] | tuple[str, ...]) -> Column:
    """The values of a case's properties of the given names (in any case), with spaces between."""
    wanted = [n.lower() for n in names]
    return F.concat_ws(" ", F.transform(F.filter("properties", lambda p: F.lower(p["name"]).isin(*wanted)), lambda p: p["value"]))


def property_keys(cases: DataFrame, names: list[str]) -> DataFrame:
    """identity_key, issue_key of issue keys in the properties of the given names (in any case)."""
    return cases.select("identity_key", F.explode(issue_keys_strict(property_values(names))).alias("issue_key")).distinct()


def property_case_ids(cases: DataFrame, names: list[str]) -> DataFrame:
    """identity_key, tr_case_id of case ids in the properties of the given names (in any case)."""
    return cases.select("identity_key", F.explode(case_ids(property_values(names))).alias("tr_case_id")).distinct()


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, sha256, bytes and type (junit-xml, playwright-json, other, by the name's end) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    kind = F.when(F.lower("path").endswith(".xml"), "junit-xml").when(F.lower("path").endswith(".json"), "playwright-json").otherwise("other")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), kind.alias("type"))
