"""Files as streams: directories, lists of files, and text traces of chunk hashes."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.operators.ordering import dense_index


#: What opening a small file counts as, in bytes. Spark's own 4 MB deal out four files a task.
OPEN_COST = 1 << 16


def _binaries(spark: SparkSession, paths: str | list[str], **options: str) -> tuple[DataFrame, DataFrame]:
    """(p, data) of the files that have bytes, and (p) of all files found: Spark's scan
    leaves out files of length 0, but lists them. p is the path without its scheme."""
    own = spark.newSession()  # the scan is dealt out by the settings of its own session
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    found = own.read.format("binaryFile").options(**options).load(paths)
    listed = spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.join("\n", found._jdf.inputFiles())  # URIs, so without line ends
    names = pa.table({"p": pa.array([re.sub(r"^[a-z]+:/*", "/", unquote(x)) for x in listed.split("\n") if x], pa.string())})
    return found.select(F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("p"), F.col("content").alias("data")), spark.createDataFrame(names)


def _with_data(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the bytes of their p; none are those of an empty file."""
    return rows.join(found, "p", "left").withColumn("data", F.coalesce("data", F.lit(b"")))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file_name, data): all files below a folder, in the order of their
    names, which are relative to it."""
    found, every = _binaries(spark, path, recursiveFileLookup="true")
    root = re.sub(r"/+$", "", path.split(":", 1)[-1])
    name = F.regexp_replace("p", "^" + re.escape(re.sub(r"^/+", "/", root)) + "/*", "")
    numbered = dense_index(every.withColumn("file_name", name), ["file_name"], "file_id")
    return _with_data(numbered, found).select("file_id", "file_name", "data")


def read_file_list(spark: SparkSession, list_path: str) -> DataFrame:
    """(file_id, file_name, data) of the files that a list names, one a line. A file's
    name is its base name, so names may repeat; file_id is the line's number. A list in
    several parts is read in the order of their names."""
    place = [F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    paths = [r[0].strip() for r in spark.read.text(list_path).select("value", *place).orderBy("part", "block", "row").select("value").collect()]
    wanted = [p for p in paths if p]
    found, every = _binaries(spark, list(dict.fromkeys(wanted)))
    table = pa.table({"file_id": pa.array(range(len(wanted)), pa.int64()), "p": pa.array([re.sub(r"^[a-z]+:/*", "/", p) for p in wanted], pa.string())})
    lines = spark.createDataFrame(table).join(every.distinct(), "p", "left_semi")
    return _with_data(lines, found).select("file_id", F.concat(F.lit("/"), F.element_at(F.split("p", "/"), -1)).alias("file_name"), "data")


def trace_lines(chunks: DataFrame) -> DataFrame:
    """(value): the text trace of a stream, one row for each file and one for the end,
    in an order of their own (line_no). chunks: file_id, file_name, chunk_no, fp, size."""
    row = F.concat(F.upper("fp"), F.lit(" "), F.col("size").cast("string"))
    files = chunks.groupBy("file_id", "file_name").agg(F.array_sort(F.collect_list(F.struct("chunk_no", row.alias("line")))).alias("c"))
    body = F.array_join(F.transform("c", lambda c: c["line"]), "\n")
    head = F.concat(F.lit("file start "), F.octet_length("file_name").cast("string"), F.lit("\n"), F.col("file_name"), F.lit("\n"))
    text = F.concat(head, body, F.when(F.size("c") > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("file end"))
    spark = chunks.sparkSession
    end = spark.range(1).select(F.lit((1 << 63) - 1).alias("line_no"), F.lit("stream end").alias("value"))
    return files.select(F.col("file_id").alias("line_no"), text.alias("value")).unionByName(end)


def write_trace(chunks: DataFrame, path: str) -> None:
    """Writes a text trace in parts whose names sort in stream order."""
    trace_lines(chunks).repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)


def _parse(text: str):
    """(file number, name, chunk number, hash, size) of one trace."""
    lines = text.split("\n")
    at, number = 0, 0
    while at < len(lines):
        line = lines[at]
        if line.startswith("file start"):
            name, at, chunk = lines[at + 1], at + 2, 0
            while at < len(lines) and not lines[at].startswith("file end"):
                if lines[at]:
                    code, size = lines[at].split(" ")
                    yield number, name, chunk, code.upper(), int(size)
                    chunk += 1
                at += 1
            number += 1
        elif line.startswith("stream end"):
            return
        at += 1


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(trace, file_id, file_name, chunk_no, fp, size) of text traces; one file each, or
    parts of one trace, whose file numbers then begin anew with each part."""
    ship(spark)
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("trace"), F.col("value"))

    def run(batches):
        for batch in batches:
            for trace, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(trace, *r) for r in _parse(text)]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["trace", "file_id", "file_name", "chunk_no", "fp", "size"])

    return texts.mapInArrow(run, "trace string, file_id long, file_name string, chunk_no long, fp string, size long")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (file_name, data) as files below `folder`, a URI of a store that all
    executors reach. A file that is there is replaced, so a task may run again."""

    def save(rows):
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        for row in rows:
            path = f"{base}/{row.file_name.lstrip('/')}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(bytes(row.data))

    files.select("file_name", "data").foreachPartition(save)


def write_joined(parts: DataFrame, heads: list[tuple[str, bytes]], folder: str) -> None:
    """Writes files below `folder`: for each (file_name, head) the head, and the data of
    its rows (file_name, at, data) one after another in the order of `at`. A file has one
    writer, which holds a row at a time."""
    begin = dict(heads)

    def save(rows):
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        out = now = None
        for row in rows:
            if row.file_name != now:
                if out is not None:
                    out.close()
                store.create_dir(base, recursive=True)
                now, out = row.file_name, store.open_output_stream(f"{base}/{row.file_name}")
                out.write(bytes(begin[now]))
            out.write(bytes(row.data))
        if out is not None:
            out.close()

    parts.repartition("file_name").sortWithinPartitions("file_name", "at").select("file_name", "data").foreachPartition(save)
