"""Containers, recipes and access records.

Where only the entry limit of a container can bind (small fixed chunks), the container
of a unique chunk is its rank divided by the limit. In general packing is next-fit: a
container closes when the next chunk would overflow its bytes or its entries. Where one
container starts, sizes alone tell where the next one does, so the starts are a walk
over the stream, which is taken in spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.config import CONTAINER_PAYLOAD
from granary.operators.dedup import stored_chunks
from granary.operators.ordering import dense_index, dense_index_within
from granary.operators.spans import carried, walk
from granary.sources.scratch import cut


def rank_uniques(chunks: DataFrame) -> DataFrame:
    """(fp, seq, size, urank): stored chunks in the order in which they are written."""
    return dense_index(stored_chunks(chunks), ["seq"], "urank")


def pack_by_rank(ranked: DataFrame, entries: int, name: str = "cid") -> DataFrame:
    return ranked.withColumn(name, F.floor(F.col("urank") / entries).cast("bigint"))


def pack_next_fit(uniques: DataFrame, entries: int, payload: int = CONTAINER_PAYLOAD, stream: str | None = None, span: int | None = None) -> DataFrame:
    """(fp, seq, size, cid, pos) by next-fit over chunks in seq order. With `stream`,
    each value of it fills containers of its own, which are numbered within it. A chunk
    of more than the payload has a container to itself."""
    keyed = uniques.withColumn("__s", F.xxhash64(stream) if stream else F.lit(0).cast("bigint"))
    # Places are counted from 0 in each stream.
    numbered = cut(dense_index_within(keyed, "__s", ["seq"], "__at"))

    def following(part: pd.DataFrame) -> np.ndarray:
        total = np.append(0, np.cumsum(part["size"].to_numpy(np.int64)))
        at = np.arange(len(part))
        full = np.searchsorted(total, total[:-1] + payload, "right") - 1
        return np.maximum(at + 1, np.minimum(at + entries, full))

    starts = walk(numbered, "__s", "__at", ["size"], following, entries, span)
    opened = dense_index_within(starts, "__s", ["__at"], "__cid")
    both = numbered.join(opened, ["__s", "__at"], "left").withColumn("__open", F.when(F.col("__cid").isNotNull(), F.struct("__cid", "__at")))
    placed = carried(both.drop("__cid"), "__s", "__at", "__open", "__in")
    kept = [F.col(f"`{c}`") for c in uniques.columns]
    return placed.select(*kept, F.col("__in.__cid").alias("cid"), (F.col("__at") - F.col("__in.__at")).cast("int").alias("pos"))


def containers(placed: DataFrame) -> DataFrame:
    """(cid, chunk_num, data_size)."""
    return placed.groupBy("cid").agg(F.count("*").alias("chunk_num"), F.sum("size").cast("bigint").alias("data_size"))


def recipe(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """Chunks with the container of their stored copy."""
    return chunks.join(placed.select("fp", "cid"), "fp")


def file_recipes(recipe_: DataFrame) -> DataFrame:
    """(version, file_id, chunk_num, file_size)."""
    return recipe_.groupBy("version", "file_id").agg(F.count("*").alias("chunk_num"), F.sum("size").cast("bigint").alias("file_size"))


def mark_runs(rows: DataFrame, column: str, span: int = 4096) -> DataFrame:
    """Adds run_start: the seq at which the run of equal `column` that a row belongs to
    begins, in each version. Runs are found inside spans of seq and carried over the
    seams between them, so no version has to fit into one task."""
    cut_ = rows.withColumn("__r", F.floor(F.col("seq") / span))
    inside = Window.partitionBy("version", "__r").orderBy("seq")
    spans = Window.partitionBy("version").orderBy("__r")
    last = cut_.groupBy("version", "__r").agg(F.max_by(column, "seq").alias("__last"))
    seams = last.select("version", "__r", F.lag("__last").over(spans).alias("__seam"), (F.row_number().over(spans) == 1).alias("__first"))
    head = F.row_number().over(inside) == 1
    before = F.when(head, F.col("__seam")).otherwise(F.lag(column).over(inside))
    new = (head & F.col("__first")) | ~before.eqNullSafe(F.col(column))
    marked = cut_.join(seams, ["version", "__r"]).withColumn("__head", F.when(new, F.col("seq")))
    heads = marked.groupBy("version", "__r").agg(F.max("__head").alias("__h"))
    carried = heads.select("version", "__r", F.max("__h").over(spans.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    own = F.max("__head").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__own", own).join(carried, ["version", "__r"]).withColumn("run_start", F.coalesce("__own", "__carried")).drop("__r", "__seam", "__first", "__head", "__own", "__carried")


def access_records(recipe_: DataFrame) -> DataFrame:
    """(version, seq, cid): chunks whose container differs from that of the chunk
    before in the same version."""
    return mark_runs(recipe_.select("version", "seq", "cid"), "cid").where("seq = run_start").select("version", "seq", "cid")


def container_utilization(recipe_: DataFrame) -> DataFrame:
    """(version, cid, size): bytes of each container that a version refers to."""
    return recipe_.groupBy("version", "cid").agg(F.sum("size").cast("bigint").alias("size"))
