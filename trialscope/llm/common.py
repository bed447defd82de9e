"""What the text operators share: the shared folder, table reading and batch helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.functions.names import fresh  # noqa: F401
from trialscope.sources.scratch import drop, scratch_path, spread  # noqa: F401

#: White space of the contracts: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


new_path = scratch_path


#: Spark's setting by which the shuffle files of a query go when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files of the write again, so they are freed at once.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that kept_table() wrote."""
    drop(spark, path)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect garbage now, as Spark's context cleaner does from time to time.

    Broadcasts and shuffles that nothing refers to any more are freed only then, on all executors.
    """
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text"):
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded number of rows and, but for single long rows, of bytes."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            part = batch.slice(start, n)
            while n > 1 and part.nbytes > size:
                n = max(1, n // 2)
                part = batch.slice(start, n)
            yield part
            start += n


def bounded_sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` rows, those of least hash of the id.

    Beyond that many rows, a threshold on the hash leaves about a tenth more than are wanted, so that
    what tasks hand to the last sort is bounded however many tasks there are.
    """
    n = df.count()
    if n > most:
        df = df.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.1 * most / n + 100 / n)))
    return df.orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), id_col).limit(most)


def _slots(keys: np.ndarray, n_bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n_bits)).astype(np.int64)


def key_bits(keys: DataFrame, n_bits: int) -> np.ndarray:
    """A bit per hash slot of the long keys in the only column; of fixed size, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_slots(b.column(0).to_numpy(zero_copy_only=False), n_bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (n_bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def has_bits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the slots of keys are set: true for all keys that are in the filter, and for a few others."""
    at = _slots(keys, (len(bits) << 6).bit_length() - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; it is installed on every machine and never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)
