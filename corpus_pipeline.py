"""A training-corpus pipeline of five stages, each over all that the stage before it kept.

quality, toxicity, exact_dedup and near_dedup return the columns of their input and only the rows
that stay; packing returns a row per piece of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialscope.llm.common import drop_path, fresh, kept_table, table, text_of, tokenizer_file
from trialscope.llm.exact_dedup import exact_dedup, normalised
from trialscope.llm.jaccard_join import jaccard_components
from trialscope.llm.packing import pack, tokenised_pieces
from trialscope.llm.quality_gam import keep_quality
from trialscope.llm.toxicity_lm import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject, with all their columns.

    Each row is judged by its own text, also where ids are null or repeat; null text counts as empty;
    texts are read whole; an empty table stays empty.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models don't reject, with all their columns; cases are defined as for quality()."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest doc_id; of repeated rows of it, one, the first by its columns as JSON.

    Null text counts as empty; a null id is greater than others; columns may have any names and types.
    """
    sha, number = fresh("_sha", docs.columns), fresh("_n", docs.columns)
    gone = exact_dedup(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    rows = docs.withColumn(sha, F.sha2(normalised(text_of("text")), 256))
    kept = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_gone"]) & (rows[sha] == gone["_gone_sha"]), "left_anti")
    once = Window.partitionBy("doc_id", sha).orderBy(F.to_json(F.struct(*docs.columns)))
    return kept.withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the document of the smallest doc_id.

    Rows that share an id are one document and stay or go together; rows without words or without an
    id stay; an empty table stays empty.
    """
    gone = jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens; null text is an end of text alone, ids may be null or repeat.

    Very long texts are cut into as many pieces as they take; an empty table has no pieces.
    """
    pieces, _ = kept_table(tokenised_pieces(docs, tokenizer_file("byte_bpe_50k.json")), "pieces")
    return pack(pieces, pieces.count())


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact_dedup", dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: The two trained stages have no SQL; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = kept_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
