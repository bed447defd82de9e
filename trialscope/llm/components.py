"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trialscope.llm.common import drop_path, kept_table


def _kept(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The edges, kept in the shared folder, its path, and their count and checksum, observed while they are written."""
    seen = Observation()
    observed = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    table, path = kept_table(observed, "edges")
    return table, path, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b: long).

    Every round is two joins on keys; the edges of a round are a table in the shared folder, and only
    their count and checksum come to the driver. The rounds end when the edges don't change, after
    about the logarithm of the longest path. Null ends and links to oneself are left out.
    """
    edges, path, before = _kept(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path, now = _kept(small)
        drop_path(edges.sparkSession, path)
        edges, path = new, new_path
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
