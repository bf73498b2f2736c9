"""A store as Parquet tables under one folder, and the jobs that change it.

Every job writes its parts of tables into folders of their own, which nothing reads yet,
and then publishes them all by one entry of the log. Entries are numbered, and an entry
appears whole, by a rename that fails if the number is taken. So a job that breaks off at
any point has changed nothing, it can be run again, and of two jobs at a time
one fails. Tables are what the entries say, in order."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import StoreConfig, entries_per_container
from granary.functions.scalar import sha1_fp, sha256_fp
from granary.operators import layout, ordering, restore, retention
from granary.operators.chunking import content_chunks, file_chunks, fixed_chunks
from granary.operators.dedup import mark_duplicates
from granary.sources.scratch import cut

TABLES = {
    "container_entry": "cid long, fp string, size int, data binary",
    "recipe": "version long, file_id long, file_name string, chunk_no long, seq long, fp string, cid long, size int",
    "fp_index": "fp string, cid long",
}
#: Codec of tables with bytes of chunks.
CODEC = "zstd"


class Store:
    """Tables: container_entry (cid, fp, size, data), recipe (version, file_id, file_name,
    chunk_no, fp, cid, size) and fp_index (fp, cid); and the log of jobs, job_log."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), (config or StoreConfig()).resolved()

    # --- the log ---

    def _hadoop(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/{path}")
        return hadoop, at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry_names(self) -> list[str]:
        _, at, fs = self._hadoop("_log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
        return [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]

    def entries(self) -> list[dict]:
        """The entries of the log, in order; one of an upgrade brings those of the store
        that was upgraded."""
        _, _, fs = self._hadoop("_log")
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        out = []
        for n in self._entry_names():
            stream = fs.open(self._hadoop(f"_log/{n}")[1])
            try:
                entry = json.loads(read(stream, "UTF-8"))
            finally:
                stream.close()
            out += [*entry.pop("jobs", []), entry]
        return out

    def _publish(self, number: int, entry: dict) -> None:
        """Writes entry `number` (the next one when the job began); fails if there is one."""
        hadoop, draft, fs = self._hadoop(f"_log/_{uuid.uuid4().hex}")
        _, final, _ = self._hadoop(f"_log/{number:08d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        hadoop.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, none)

    def _write(self, name: str, df: DataFrame) -> str:
        """Writes a part of a table, for an entry to publish; returns its folder."""
        part = f"{name}/{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).parquet(f"{self.path}/{part}")
        return part

    def parts(self) -> dict[str, list[str]]:
        """The folders that make up each table."""
        out: dict[str, list[str]] = {name: [] for name in TABLES}
        for entry in self.entries():
            for name, parts in entry.get("replace", {}).items():
                out[name] = list(parts)
            for name, parts in entry.get("add", {}).items():
                out[name] += parts
        return out

    def vacuum(self) -> int:
        """Deletes the folders that no table is made of (of jobs that broke off, or that
        were replaced), and returns how many. No job may run meanwhile."""
        live, gone = {p for parts in self.parts().values() for p in parts}, 0
        for name in TABLES:
            _, at, fs = self._hadoop(name)
            for f in fs.listStatus(at) if fs.exists(at) else ():
                if f"{name}/{f.getPath().getName()}" not in live:
                    fs.delete(f.getPath(), True)
                    gone += 1
        return gone

    # --- reading ---

    def exists(self, name: str) -> bool:
        return bool(self.entries()) if name == "job_log" else bool(self.parts()[name])

    def table(self, name: str) -> DataFrame:
        if name == "job_log":
            rows = [(e["job"], e["version"], e["chunks"], e["bytes"], e["stored_bytes"]) for e in self.entries()]
            return self.spark.createDataFrame(rows, "job string, version long, chunks long, bytes long, stored_bytes long")
        parts = self.parts()[name]
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def versions(self) -> list[int]:
        """The backups that are not expired."""
        out: set[int] = set()
        for e in self.entries():
            if e["job"] == "backup":
                out.add(e["version"])
            elif e["job"] == "expire":
                out = {v for v in out if v >= e["version"]}
        return sorted(out)

    def _chunks(self, files: DataFrame) -> DataFrame:
        c = self.config
        if c.chunk_algorithm == "fixed":
            return fixed_chunks(files, c.chunk_avg_size).withColumn("fp", sha1_fp(F.col("data")))
        if c.chunk_algorithm == "file":
            return file_chunks(files).withColumn("fp", sha1_fp(F.col("data")))
        return content_chunks(files, c, with_data=True)

    def backup(self, files: DataFrame, note: str = "") -> int:
        """Stores files (file_id, file_name, data) as the next version; returns its number.
        note: kept with the log entry."""
        number, log = len(self._entry_names()), self.entries()
        seconds, began = {}, time.monotonic()

        def phase(name: str) -> None:
            nonlocal began
            seconds[name], began = round(time.monotonic() - began, 3), time.monotonic()

        version = max((e["version"] for e in log if e["job"] == "backup"), default=-1) + 1
        pieces = cut(self._chunks(files), CODEC)
        phase("chunk")
        numbered = cut(ordering.dense_index(pieces.select("file_id", "file_name", "chunk_no", "size", "fp"), ["file_id", "chunk_no"], "seq"))
        known = self.table("fp_index").select("fp", F.col("cid").alias("known"))
        new = mark_duplicates(numbered).where("NOT is_dup").join(known, "fp", "left_anti")
        start = max((e["next_cid"] for e in log if "next_cid" in e), default=0)  # ids of expired containers do not come again
        packed = layout.pack_next_fit(new.select("fp", "seq", "size", "file_id", "chunk_no"), entries_per_container(20), self.config.container_payload)
        placed = cut(packed.withColumn("cid", F.col("cid") + start))
        phase("dedup")
        data = placed.join(pieces.select("file_id", "chunk_no", "data"), ["file_id", "chunk_no"]).select("cid", "fp", "size", "data")
        fresh = placed.select("fp", "cid")
        where = fresh.unionByName(known.withColumnRenamed("known", "cid"))
        recipe = numbered.join(where, "fp").select(F.lit(version).cast("bigint").alias("version"), "file_id", "file_name", "chunk_no", "seq", "fp", "cid", "size")
        add = {"container_entry": [self._write("container_entry", data)], "fp_index": [self._write("fp_index", fresh)], "recipe": [self._write("recipe", recipe)]}
        phase("write")
        n, size = numbered.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        stored, last = placed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("cid")).first()
        self._publish(number, {"job": "backup", "version": version, "chunks": n, "bytes": size, "stored_bytes": stored, "next_cid": start if last is None else last + 1, "note": note, "seconds": seconds, "add": add})
        return version

    def restore(self, *versions: int) -> DataFrame:
        """(version, file_id, data) of versions that are not expired, in one pass over the
        containers that they refer to."""
        if not versions or (unknown := set(versions) - set(self.versions())):
            raise ValueError(f"no version {min(unknown)}" if versions else "no version is named")
        recipe = self.table("recipe").where(F.col("version").isin(*versions))
        entries = self.table("container_entry")
        if set(versions) != set(self.versions()):
            entries = entries.join(recipe.select("cid").distinct(), "cid", "left_semi")
        return restore.restore_files(recipe, entries)

    def upgrade(self, target: str) -> Store:
        """A store at `target` with SHA-256 fingerprints: stored chunks are hashed once,
        recipes are joined with the map."""
        other = Store(self.spark, target, self.config)
        entries = self.table("container_entry").withColumn("new_fp", sha256_fp(F.col("data")))
        ranked = ordering.dense_index(entries.select("cid", "fp", "new_fp"), ["cid", "fp"], "urank")
        mapping = cut(ranked.withColumn("new_cid", F.floor(F.col("urank") / entries_per_container(32)).cast("bigint")))
        add = {
            "container_entry": self.table("container_entry").join(mapping, ["cid", "fp"]).select(F.col("new_cid").alias("cid"), F.col("new_fp").alias("fp"), "size", "data"),
            "fp_index": mapping.select(F.col("new_fp").alias("fp"), F.col("new_cid").alias("cid")),
            "recipe": self.table("recipe").join(mapping, ["cid", "fp"]).select("version", "file_id", "file_name", "chunk_no", "seq", F.col("new_fp").alias("fp"), F.col("new_cid").alias("cid"), "size"),
        }
        parts = {name: [other._write(name, df)] for name, df in add.items()}
        top = mapping.agg(F.max("new_cid")).first()[0]
        jobs = [{k: v for k, v in e.items() if k not in ("add", "replace", "next_cid")} for e in self.entries()]
        other._publish(0, {"job": "upgrade", "version": -1, "chunks": 0, "bytes": 0, "stored_bytes": 0, "next_cid": 0 if top is None else top + 1, "jobs": jobs, "add": parts})
        return other

    def expire(self, oldest_kept: int) -> DataFrame:
        """(cid, last_version) of the containers that no kept version uses. What is left of
        the tables is written anew and takes their place by one entry of the log; the old
        folders stay until vacuum()."""
        number = len(self._entry_names())
        manifest = cut(retention.manifest(self.table("recipe")))
        gone = cut(retention.reclaimed(manifest, oldest_kept))
        left = {
            "fp_index": retention.index_after(self.table("fp_index"), gone),
            "container_entry": self.table("container_entry").join(gone.select("cid"), "cid", "left_anti"),
            "recipe": self.table("recipe").where(F.col("version") >= oldest_kept),
        }
        replace = {name: [self._write(name, df)] for name, df in left.items()}
        self._publish(number, {"job": "expire", "version": oldest_kept, "chunks": 0, "bytes": 0, "stored_bytes": 0, "replace": replace})
        return gone

    def throughput(self) -> DataFrame:
        """(version, phase, seconds, mb_per_s) of the backups: chunking and hashing;
        finding what is new and where it goes; writing."""
        rows = [(e["version"], p, float(t), e["bytes"] / 1e6 / max(t, 1e-3)) for e in self.entries() for p, t in e.get("seconds", {}).items()]
        return self.spark.createDataFrame(rows, "version long, phase string, seconds double, mb_per_s double")

    def stats(self) -> DataFrame:
        """(versions, chunks, bytes, stored_bytes) over the backups that are not expired."""
        kept = self.versions()
        return self.table("job_log").where((F.col("job") == "backup") & F.col("version").isin(kept)).agg(F.count("*").alias("versions"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"), F.sum("stored_bytes").alias("stored_bytes"))
