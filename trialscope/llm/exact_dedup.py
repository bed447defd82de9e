"""Exact dedup by a 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import SPACE, text_of


#: Rows over group size from which a group counts as hot; so there are at most as many hot groups.
HOT_GROUPS = 1000


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def leading_128_bits(sha: Column, text: Column) -> Column:
    """The content hash: the first 16 bytes of the SHA-256 digest."""
    return F.substring(sha, 1, 16)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column, Column], Column] = leading_128_bits,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash *and* the normalised bytes, with map-side combining, so a
    group that holds a third of all rows sends one row per task and two texts with one hash never
    share a group. Only digests travel back to the documents: a document finds its group by hash,
    and, where several texts share the hash, by the full digest among them. Equal full digests of
    different bytes raise an error instead of merging texts.

    Defined cases: null text counts as empty, so empty and null texts are one group. A null id is
    never a group's smallest unless all its ids are null; then keep_id is null and kept is true.
    Repeated rows (same id and text) are one document given twice: each row is returned, counted in
    group_size, and kept alike. Very long texts are hashed and compared whole, as all others. Other
    columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    text = normalised(text_of(text_col))
    sha = F.unhex(F.sha2(F.col("_text"), 256))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    keyed = rows.select("_id", "_text", content_hash(sha, F.col("_text")).alias("_hash"))
    groups = keyed.groupBy("_hash", "_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = groups.select("_hash", F.struct(sha.alias("sha"), "keep_id", "group_size").alias("g")).groupBy("_hash").agg(F.collect_list("g").alias("_groups"))
    mine = rows.select("_id", sha.alias("_sha"), content_hash(sha, F.col("_text")).alias("_hash"))
    # Groups of over a thousandth of the rows are at most a thousand: they go to every task, and their
    # rows, with a key of their own instead of the hash, are spread over all tasks of the join.
    least = max(2, docs.count() // HOT_GROUPS)
    hot = by_hash.where(F.exists("_groups", lambda g: g["group_size"] > least)).select(F.col("_hash").alias("_hot"), F.col("_groups").alias("_hot_groups"))
    spread = F.when(F.col("_hot").isNull(), F.col("_hash")).otherwise(F.concat(F.lit(b"hot"), F.unhex(F.hex(F.xxhash64("_id")))))
    keyed_rows = mine.join(F.broadcast(hot), F.col("_hash") == F.col("_hot"), "left").withColumn("_key", spread).drop("_hash")
    found = keyed_rows.join(by_hash, F.col("_key") == F.col("_hash"), "left").withColumn("_groups", F.coalesce("_hot_groups", "_groups")).withColumn("_fit", F.filter("_groups", lambda g: g["sha"] == F.col("_sha")))
    one = F.when(F.size("_fit") == 1, F.col("_fit")[0]).otherwise(F.raise_error(F.lit("different texts share a SHA-256 digest")))
    return found.select("_id", "_sha", one.alias("_g")).select(
        F.col("_id").alias(id_col),
        F.col("_g.keep_id").alias("keep_id"),
        F.col("_g.group_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_g.keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
