"""Counters of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def job_counters(chunks: DataFrame) -> DataFrame:
    """One row for each version: files, chunks, bytes, unique and rewritten ones, zero
    chunks. chunks: is_dup, rewritten, is_zero."""
    where = lambda c, x: F.sum(F.when(c, x).otherwise(0)).cast("bigint")
    return chunks.groupBy("version").agg(
        F.count_distinct("file_id").alias("files"),
        F.count("*").alias("chunks"),
        F.sum("size").cast("bigint").alias("bytes"),
        where(~F.col("is_dup"), F.lit(1)).alias("unique_chunks"),
        where(~F.col("is_dup"), F.col("size")).alias("unique_bytes"),
        where(F.col("rewritten"), F.lit(1)).alias("rewritten_chunks"),
        where(F.col("rewritten"), F.col("size")).alias("rewritten_bytes"),
        where(F.col("is_zero"), F.lit(1)).alias("zero_chunks"),
    )


def ratios(counters: DataFrame) -> DataFrame:
    """Deduplication ratio, factor and rewrite ratio; null where there are no bytes."""
    some = F.when(F.col("bytes") > 0, F.col("bytes"))
    written = F.col("unique_bytes") + F.col("rewritten_bytes")
    return counters.select(
        "version",
        F.round((F.col("bytes") - written) / some, 6).alias("dedup_ratio"),
        F.round(F.col("bytes") / F.when(written > 0, written), 6).alias("dedup_factor"),
        F.round(F.col("rewritten_bytes") / some, 6).alias("rewrite_ratio"),
    )


def cumulative(counters: DataFrame) -> DataFrame:
    """Totals after each job. There are as many rows as jobs."""
    upto = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return counters.select("version", F.sum("bytes").over(upto).alias("total_bytes"), F.sum("unique_bytes").over(upto).alias("stored_bytes"), F.sum("chunks").over(upto).alias("total_chunks"))


def segment_stats(chunks: DataFrame) -> DataFrame:
    """(segments, chunks, mean_chunks)."""
    per = chunks.groupBy("segment_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("segments"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 6).alias("mean_chunks"))
