"""Drains of result files by Structured Streaming: each file once, bad ones aside, repeats and late rows harmless."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.operators.ingest import ingest_batches, read_batches
from trialscope.sources.scratch import as_qualified, get_text, scope
from trialscope.streaming.tables import Change, Store, newest


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream of a checkpoint: a new checkpoint counts its batches anew, and has another one."""
    return json.loads(get_text(spark, f"{checkpoint}/metadata"))["id"]


def drain_json(store: Store, name: str, incoming: str, rejects: str, checkpoint: str, moment: str, files_per_batch: int = 1000, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merge all JSON lines that have come into `incoming` since the last drain into a table of a store.

    The checkpoint remembers files, so that each is read once; lines that don't parse go to `rejects`
    with their text. Of all rows of a key, in the table and the batch, the one of the newest moment holds: a row
    that comes again or late changes nothing. A batch that was committed before a failure isn't committed again.
    """
    spark, kind = store.spark, store.kinds[name]
    rows = spark.readStream.schema(f"{kind.schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).json(incoming)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        bad = batch.where("_corrupt is not null").select(F.col("_corrupt").alias("text"), F.lit(number).alias("batch"))
        bad.write.mode("overwrite").parquet(f"{rejects}/v={number}")
        good = batch.where("_corrupt is null").drop("_corrupt")
        order = [F.desc_nulls_last(moment)]
        store.commit({name: Change(prepare(good) if prepare else good, newest(kind.keys, order))}, _stream_id(spark, checkpoint), number)
        batch.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _texts(files: DataFrame) -> DataFrame:
    return files.select(as_qualified(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


_WHOLE = {"wholetext": True, "pathGlobFilter": "manifest*.json", "recursiveFileLookup": True}


def drain_manifests(store: Store, incoming: str, known_issues: DataFrame, known_cases: DataFrame, checkpoint: str, files_per_batch: int = 100) -> None:
    """Ingest the batches of result files whose manifests have come into `incoming` (at any depth) since the last drain.

    Each manifest is read once, `files_per_batch` of them at a time, and each time is one commit to the store (of
    ingest.KINDS). A batch that fails (an unreadable manifest, a file that is missing or has no tests) is left
    where it lies, with its error in the table `batch`; reprocess_failed() tries it again.
    """
    spark = store.spark
    files = _texts(spark.readStream.format("text").options(**_WHOLE).option("maxFilesPerTrigger", files_per_batch).load(incoming))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ingest_batches(batch, store, known_issues, known_cases, _stream_id(spark, checkpoint), number)
        batch.unpersist()

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pending_manifests(store: Store, incoming: str, limit: int | None = None) -> DataFrame:
    """path and text of the manifests in `incoming` of which the store has no status; the first `limit` by path."""
    files = _texts(store.spark.read.format("text").options(**_WHOLE).load(incoming))
    new = files.join(store.read("batch").select("path"), "path", "left_anti")
    return new if limit is None else new.orderBy("path").limit(limit)


def drain_some(store: Store, incoming: str, known_issues: DataFrame, known_cases: DataFrame, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Ingest the pending manifests, `limit` at most, in one commit; without a stream. Returns their status.

    With dry_run nothing is written, and the status is what it would have been; what can be read is 'dry'.
    """
    pending = pending_manifests(store, incoming, limit).persist()
    spark, columns = store.spark, store.kinds["batch"].columns
    if dry_run:
        with scope(spark):
            status = read_batches(pending, known_issues, known_cases)[1].withColumn("status", F.when(F.col("status") == "ok", "dry").otherwise(F.col("status")))
            rows = status.select(*columns).collect()
        return spark.createDataFrame(rows, store.kinds["batch"].schema)
    if pending.isEmpty():
        return spark.createDataFrame([], store.kinds["batch"].schema)
    ingest_batches(pending, store, known_issues, known_cases)
    return store.read("batch").join(pending.select("path"), "path", "left_semi").select(*columns)


def reprocess_failed(store: Store, known_issues: DataFrame, known_cases: DataFrame, limit: int = 100) -> None:
    """Try failed batches again, the first `limit` by path, as they lie now."""
    failed = [r["path"] for r in store.read("batch").where("status = 'failed'").select("path").orderBy("path").limit(limit).collect()]
    if failed:
        ingest_batches(_texts(store.spark.read.text(failed, wholetext=True)), store, known_issues, known_cases)


def reprocess(spark: SparkSession, rejects: str, schema: str, fix: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, still bad) of rejected texts after fix(rows with a text column)."""
    fixed = fix(spark.read.parquet(rejects)).select("text", F.from_json("text", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return fixed.where("r._corrupt is null").select("r.*").drop("_corrupt"), fixed.where("r._corrupt is not null").select("text")


def append_once(stream: DataFrame, keys: list[str], moment: str, late: str = "1 hour") -> DataFrame:
    """A stream of facts without the repeats that come within `late`."""
    return stream.withWatermark(moment, late).dropDuplicatesWithinWatermark(keys)


def drain_once(spark: SparkSession, incoming: str, schema: str, keys: list[str], moment: str, out: str, checkpoint: str, late: str = "1 hour", files_per_batch: int = 1000) -> dict[str, int]:
    """Append the JSON facts that have come into `incoming` to the Parquet files in `out`, each key once; returns rows read and rows too late.

    Keys are remembered in the state store until the watermark (the latest moment less `late`) has passed them, not
    looked up in the table. A row behind the watermark is dropped and counted. Read `out` as a stream's output
    (Spark then takes the files that its log names).
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(incoming)
    query = append_once(rows, keys, moment, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    told = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in told), "late": sum(s["numRowsDroppedByWatermark"] for p in told for s in p["stateOperators"])}
