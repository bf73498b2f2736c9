"""Relations over the driver's tables: one file for each document, three versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import entries_per_container
from granary.functions.scalar import sha1_fp
from granary.operators import layout
from granary.operators.chunking import fixed_chunks
from granary.operators.ordering import running_total
from granary.sources.scratch import cut

CHUNK, SEGMENT = 256, 128
OLD_ENTRIES, NEW_ENTRIES = entries_per_container(20), entries_per_container(32)
#: Chunks of 256 bytes fill so much of a container; thresholds are shares of it.
PAYLOAD = OLD_ENTRIES * CHUNK


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, version, data): the documents' UTF-8 bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").alias("file_id"), (F.col("doc_id") % 3).alias("version"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def chunks(spark: SparkSession, sf: str, size: int = CHUNK, data: bool = False) -> DataFrame:
    """(version, file_id, chunk_no, seq, size, fp[, data]); seq counts all chunks in the
    order of version, file and place. It is the file's first number, from a running
    total over files, plus the place in the file."""
    files = stream(spark, sf).select("version", "file_id", F.ceil(F.length("data") / size).cast("bigint").alias("n"))
    starts = running_total(files, ["version", "file_id"], "n", "start").select("file_id", "start")
    pieces = fixed_chunks(stream(spark, sf), size).withColumn("fp", sha1_fp(F.col("data")))
    keep = ["version", "file_id", "chunk_no", "seq", "size", "fp"] + ["data"] * data
    return pieces.join(starts, "file_id").withColumn("seq", F.col("start") + F.col("chunk_no")).select(*keep)


def placed(spark: SparkSession, sf: str, per_container: int = OLD_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Chunks, and stored chunks with their rank and container."""
    rows = cut(chunks(spark, sf))
    return rows, cut(layout.pack_by_rank(layout.rank_uniques(rows), per_container))


def _recipe(rows: DataFrame, stored: DataFrame) -> DataFrame:
    first = rows.groupBy("version").agg(F.min("seq").alias("__start"))
    full = rows.join(stored.select("fp", "cid", F.col("seq").alias("__first")), "fp").join(F.broadcast(first), "version")
    return cut(full.withColumn("is_dup", F.col("seq") > F.col("__first")).withColumn("pos", F.col("seq") - F.col("__start")).drop("__first", "__start"))


def recipe(spark: SparkSession, sf: str, per_container: int = OLD_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Recipe rows (with is_dup, and pos, the place in the version) and stored chunks."""
    rows, stored = placed(spark, sf, per_container)
    return _recipe(rows, stored), stored


def _entries(spark: SparkSession, sf: str, rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The bytes are read from the files again for the chunks that are stored, not carried
    through the steps that find out which those are. Hashes are taken where the bytes are
    read, so that only what is asked for is shuffled."""
    where = stored.join(rows.select("seq", "file_id", "chunk_no"), "seq")
    pieces = fixed_chunks(stream(spark, sf), CHUNK).select("file_id", "chunk_no", "data", F.unhex(F.sha2("data", 256)).alias("__new"))
    return where.join(pieces, ["file_id", "chunk_no"]).withColumn("new_fp", F.hex("__new")).drop("file_id", "chunk_no", "__new")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """(cid, fp, urank, size, new_fp, data) of stored chunks."""
    return _entries(spark, sf, *placed(spark, sf))


def whole(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Recipe rows and stored chunks with their bytes, from one pass of chunking."""
    rows, stored = placed(spark, sf)
    return _recipe(rows, stored), _entries(spark, sf, rows, stored)
