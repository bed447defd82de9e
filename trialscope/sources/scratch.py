"""Folders for tables that jobs write and read again, and small file operations in any store that Spark opens."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that the innermost scope has to drop; None outside of scopes.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one if unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the scope around drops it."""
    path, owned = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", _scope.get()
    if owned is not None:
        owned.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch paths inside goes at the end, also after an error.

    For jobs whose results are in tables of their own by then: frames over kept() tables can't be read afterwards.
    """
    owned: list[str] = []
    before = _scope.set(owned)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in owned:
            drop(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and nothing is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df for a join whose both sides grow with the input: they are shuffled, whatever sizes Spark takes them to have.

    A kept table counts by its compressed files, and rows that an explode makes of it don't count at all; so Spark
    would send to the driver, and to all tasks, what is many times larger than its limit for broadcasts.
    """
    return df.hint("shuffle_merge")


@functools.lru_cache(maxsize=1)
def _path_kind(context):
    """The class of paths and the configuration of a context: each look-up by name asks the JVM several times."""
    return context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()


def _hadoop(spark: SparkSession, path: str):
    kind, conf = _path_kind(spark.sparkContext)
    p = kind(path)
    return p.getFileSystem(conf), p


def qualified(spark: SparkSession, path: str) -> str:
    """The one spelling of a path, with its scheme: /a, file:/a and file:///a are the same; relative ones lie in the working folder."""
    local = "file:/" if path.startswith("file://localhost/") else ""
    store, p = _hadoop(spark, local + path.removeprefix("file://localhost/") if local else path)
    return store.makeQualified(p).toString()


def as_qualified(file_path: Column) -> Column:
    """What readers report as _metadata.file_path, in the spelling of qualified(): without escapes (as in URLs) and empty authority."""
    return F.url_decode(F.replace(F.regexp_replace(file_path, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/"), F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    store, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches, in order; none if there are none."""
    store, p = _hadoop(spark, pattern)
    return sorted(s.getPath().toString() for s in store.globStatus(p) or [])


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _hadoop(spark, path)
    return store.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    store, p = _hadoop(spark, path)
    store.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    store, p = _hadoop(spark, path)
    if not store.rename(p, _hadoop(spark, to)[1]):
        raise FileExistsError(to)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file."""
    store, p = _hadoop(spark, path)
    out = store.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """Read a small text file."""
    store, p = _hadoop(spark, path)
    found = store.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file that appears whole or not at all; an error if it is there already."""
    folder, name = path.rsplit("/", 1)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    put_text(spark, aside, text)
    store, p = _hadoop(spark, path)
    _, q = _hadoop(spark, aside)
    if store.exists(p) or not store.rename(q, p):
        store.delete(q, False)
        raise FileExistsError(path)
