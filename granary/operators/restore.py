"""Bringing files back from containers and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.scratch import cut


def restore_chunks(recipe: DataFrame, entries: DataFrame) -> DataFrame:
    """Recipe rows with the bytes of their stored chunk: a join on container and
    fingerprint. entries: (cid, fp, data)."""
    return recipe.join(entries.select("cid", "fp", "data"), ["cid", "fp"])


def restore_files(recipe: DataFrame, entries: DataFrame) -> DataFrame:
    """(version, file_id, data): the chunks of each file in order. A file is one row, as
    it was when it was read."""
    whole = F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk_no)")
    return restore_chunks(recipe, entries).groupBy("version", "file_id").agg(whole.alias("data"))


def round_trip_difference(original: DataFrame, restored: DataFrame) -> DataFrame:
    """(side, files): files of one side without an equal on the other; no rows if all
    came back."""
    # Written, so that no file is read or restored for each of the two sides.
    a, b = (cut(files.select("file_id", F.sha2("data", 256).alias("h"))) for files in (original, restored))
    lost = a.join(b, ["file_id", "h"], "left_anti").agg(F.count("*").alias("files")).select(F.lit("lost").alias("side"), "files")
    new = b.join(a, ["file_id", "h"], "left_anti").agg(F.count("*").alias("files")).select(F.lit("new").alias("side"), "files")
    return lost.unionByName(new).where("files > 0")
