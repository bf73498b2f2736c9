"""Grouping chunks into segments, and the features that stand for a segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalar import residue
from granary.operators.ordering import dense_index_within
from granary.operators.spans import carried, walk
from granary.sources.scratch import cut


def fixed_segments(chunks: DataFrame, n: int) -> DataFrame:
    """Adds segment_id: every n chunks of the stream."""
    return chunks.withColumn("segment_id", F.floor(F.col("seq") / n).cast("bigint"))


def file_segments(chunks: DataFrame) -> DataFrame:
    """Adds segment_id: one for each file."""
    return chunks.withColumn("segment_id", F.col("file_id"))


def content_segments(chunks: DataFrame, avg: int, least: int, most: int, stream: str = "version", span: int | None = None) -> DataFrame:
    """Adds segment_no within each stream: a chunk whose residue is 0 begins a segment
    once the last has `least` chunks (1 at least), and `most` chunks end one (but not
    before there are more than `least`). seq must have no gap within a stream."""
    keyed = chunks.withColumn("__s", F.xxhash64(stream))
    marked = cut(dense_index_within(keyed, "__s", ["seq"], "__at").withColumn("__mark", residue(F.col("fp"), avg) == 0))
    reach = max(most, least + 1)

    def following(part: pd.DataFrame) -> np.ndarray:
        at = np.arange(len(part))
        marks = np.append(np.flatnonzero(part["__mark"].to_numpy(bool)), len(part) + reach)
        return np.minimum(marks[np.searchsorted(marks, at + max(least, 1))], at + reach)

    starts = walk(marked, "__s", "__at", ["__mark"], following, reach, span)
    begun = dense_index_within(starts, "__s", ["__at"], "__no")
    return carried(marked.join(begun, ["__s", "__at"], "left"), "__s", "__at", "__no", "segment_no").drop("__s", "__at", "__mark", "__no")


def _rows(chunks: DataFrame):
    return Window.partitionBy("segment_id").orderBy("seq")


def sample_uniform(chunks: DataFrame, n: int) -> DataFrame:
    """(segment_id, feature): the first of every n chunks of a segment."""
    return chunks.withColumn("__rn", F.row_number().over(_rows(chunks)) - 1).where(F.col("__rn") % n == 0).select("segment_id", F.col("fp").alias("feature")).distinct()


def sample_random(chunks: DataFrame, n: int, zero: str = "0" * 40) -> DataFrame:
    """(segment_id, feature): fingerprints with residue 0; a segment without one has
    the all-zero feature."""
    hit = chunks.withColumn("f", F.when(residue(F.col("fp"), n) == 0, F.col("fp")))
    some = hit.where("f IS NOT NULL").select("segment_id", F.col("f").alias("feature")).distinct()
    none = hit.groupBy("segment_id").agg(F.max("f").alias("m")).where("m IS NULL").select("segment_id", F.lit(zero).alias("feature"))
    return some.unionByName(none)


def _how_many(n: int):
    """Features of a segment of `c` chunks: c / n, halves rounded down, at least 1. With
    n = 0, one."""
    return F.lit(1) if n == 0 else F.greatest(F.lit(1), F.floor(F.col("__c") / n).cast("int") + F.when(F.col("__c") % n > n / 2, 1).otherwise(0))


def _ranked(chunks: DataFrame, n: int) -> DataFrame:
    whole = Window.partitionBy("segment_id")
    return chunks.withColumn("__c", F.count("*").over(whole)).withColumn("__rank", F.row_number().over(whole.orderBy("fp", "seq"))).where(F.col("__rank") <= _how_many(n))


def sample_min(chunks: DataFrame, n: int) -> DataFrame:
    """(segment_id, feature): the least fingerprints of a segment."""
    return _ranked(chunks, n).select("segment_id", F.col("fp").alias("feature")).distinct()


def sample_optimized_min(chunks: DataFrame, n: int, offset: int = 8) -> DataFrame:
    """(segment_id, feature): the fingerprint `offset` chunks before each least one; the
    first of the segment where there are fewer."""
    moved = chunks.withColumn("__before", F.coalesce(F.lag("fp", offset).over(_rows(chunks)), F.first("fp").over(_rows(chunks))))
    return _ranked(moved, n).select("segment_id", F.col("__before").alias("feature")).distinct()


SEGMENTING = {"fixed": fixed_segments, "file-defined": file_segments, "content-defined": content_segments}
SAMPLING = {"uniform": sample_uniform, "random": sample_random, "min": sample_min, "optmin": sample_optimized_min}
