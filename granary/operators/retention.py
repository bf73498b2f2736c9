"""Expiring old versions, and keeping the index in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest(recipe: DataFrame) -> DataFrame:
    """(cid, last_version): the last version that uses each container."""
    return recipe.groupBy("cid").agg(F.max("version").alias("last_version"))


def reclaimed(manifest_: DataFrame, oldest_kept: int) -> DataFrame:
    """Containers that no kept version uses."""
    return manifest_.where(F.col("last_version") < oldest_kept)


def live(manifest_: DataFrame, oldest_kept: int) -> DataFrame:
    return manifest_.where(F.col("last_version") >= oldest_kept)


def index_after(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Index entries (fp, cid) whose container stays."""
    return index.join(gone.select("cid"), "cid", "left_anti")


def retention_due(version: int, keep: int) -> bool:
    """Whether a backup with this number makes an old one expire; keep < 0: never."""
    return keep >= 0 and version >= keep


def feature_queue(features: DataFrame, length: int, span: int = 1024) -> DataFrame:
    """(feature, ids): the last `length` segments with each feature, newest first; the
    newest of each span of ids are taken first, then the newest of those."""
    cut_ = features.withColumn("__r", F.floor(F.col("segment_id") / span))
    last = cut_.groupBy("feature", "__r").agg(F.slice(F.reverse(F.array_sort(F.collect_list("segment_id"))), 1, length).alias("last"))
    newest = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("__r")))
    kept = last.withColumn("__rn", newest).where(F.col("__rn") <= length)
    return kept.groupBy("feature").agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("last")))), 1, length).alias("ids"))


def upsert(index: DataFrame, fresh: DataFrame, length: int) -> DataFrame:
    """An index (feature, ids newest first) after new rows (feature, segment_id)."""
    old = index.select("feature", F.explode("ids").alias("segment_id"))
    return feature_queue(old.unionByName(fresh.select("feature", "segment_id")), length)


def delete_id(index: DataFrame, gone: DataFrame) -> DataFrame:
    """An index without the ids in `gone` (segment_id); keys without ids go."""
    kept = index.select("feature", F.posexplode("ids").alias("at", "segment_id")).join(gone.select("segment_id").distinct(), "segment_id", "left_anti")
    return kept.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "segment_id"))), lambda x: x["segment_id"]).alias("ids"))


def index_footprint(index: DataFrame, key_bytes: int, value_length: int) -> DataFrame:
    """(entries, bytes) of an in-memory index."""
    return index.agg(F.count("*").alias("entries")).withColumn("bytes", F.col("entries") * (key_bytes + 8 * value_length + 4))
