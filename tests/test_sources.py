"""Sources, sinks and whole jobs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from granary.config import StoreConfig
from granary.functions.compression import compressed_fp, zstd_compress, zstd_decompress
from granary.sources import files, hashfile
from granary.sources.store import Store
from granary.streaming.incremental import backup_stream, first_chunks, windowed_counts


def test_directory_and_list(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/b.txt").write_bytes(b"bb")
    (tmp_path / "in/sub/a.txt").write_bytes(b"a")
    got = [(r.file_id, r.file_name, bytes(r.data)) for r in files.read_directory(spark, str(tmp_path / "in")).orderBy("file_id").collect()]
    assert got == [(0, "b.txt", b"bb"), (1, "sub/a.txt", b"a")]
    (tmp_path / "list").write_text(f"{tmp_path}/in/sub/a.txt\n{tmp_path}/in/b.txt\n")
    got = [(r.file_id, r.file_name) for r in files.read_file_list(spark, str(tmp_path / "list")).orderBy("file_id").collect()]
    assert got == [(0, "/a.txt"), (1, "/b.txt")]


def test_empty_files_and_lists_in_parts(spark, tmp_path):
    """Files without bytes are files; lines are numbered in the order of parts and lines."""
    (tmp_path / "in").mkdir()
    for name, data in (("a", b""), ("b c%20", b"bb"), ("d", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    got = [(r.file_id, r.file_name, bytes(r.data)) for r in files.read_directory(spark, str(tmp_path / "in")).orderBy("file_id").collect()]
    assert got == [(0, "a", b""), (1, "b c%20", b"bb"), (2, "d", b"")]
    (tmp_path / "list").mkdir()
    (tmp_path / "list/part-0").write_text(f"{tmp_path}/in/d\n")
    (tmp_path / "list/part-1").write_text(f"{tmp_path}/in/b c%20\n{tmp_path}/in/d\n" + f"file:{tmp_path}/in/a\n" * 50)
    got = [(r.file_id, r.file_name, bytes(r.data)) for r in files.read_file_list(spark, str(tmp_path / "list")).orderBy("file_id").collect()]
    assert got == [(0, "/d", b""), (1, "/b c%20", b"bb"), (2, "/d", b"")] + [(i, "/a", b"") for i in range(3, 53)]


@pytest.mark.parametrize("name", ["directory_scan", "file_list_scan"])
def test_scans_of_empty_documents(spark, tmp_path, name):
    """Texts that are null or empty, and ids with gaps: as the SQL has it."""
    import duckdb

    from granary.plans.catalogue import ORACLES, QUERIES

    spark.createDataFrame([(4, "four"), (7, None), (12, ""), (5, "fünf")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path)).select("file_id", "file_name", "digest")
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(f"SELECT file_id, file_name, digest FROM ({ORACLES[name]})").fetchall())


def test_text_trace(spark, tmp_path):
    rows = [(0, "/x", 0, "AB" * 20, 10), (0, "/x", 1, "CD" * 20, 20), (1, "/y z", 0, "EF" * 20, 30)]
    df = spark.createDataFrame(rows, "file_id long, file_name string, chunk_no long, fp string, size long")
    text = "\n".join(r.value for r in files.trace_lines(df).orderBy("line_no").collect())
    assert text.startswith("file start 2\n/x\n" + "AB" * 20 + " 10\n")
    assert text.endswith("file end\nstream end")
    (tmp_path / "t").write_text(text.lower().replace("ab" * 20, "AB" * 20))
    got = sorted((r.file_id, r.file_name, r.chunk_no, r.fp, r["size"]) for r in files.read_trace(spark, str(tmp_path / "t")).collect())
    assert got == rows
    files.write_trace(df, str(tmp_path / "out"))
    assert "stream end" in "".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())


@pytest.mark.parametrize("version", range(1, 8))
@pytest.mark.parametrize("chunking", [hashfile.FIXED, hashfile.VARIABLE])
def test_hash_files(spark, tmp_path, version, chunking):
    r = random.Random(version)
    parts = lambda n, size: [(r.randbytes(6), size, 3) for _ in range(n)]
    written = [({"path": "/a/b", "file_size": 2500, "uid": 7}, parts(3, 900)), ({"path": "/link", "target": "/a/b", "perm": 0o120777, "file_size": 0}, []), ({"path": "/c", "file_size": 100}, parts(1, 100))]
    raw = hashfile.build(written, version, chunking, 1000)
    header, _ = hashfile.read_header(raw)
    assert (header.version, header.files, header.hash_bytes) == (version, 3, 6)
    got = list(hashfile.parse(raw))
    assert [f["path"] for f, _ in got] == ["/a/b", "/link", "/c"]
    assert got[1][0]["target"] == ("/a/b" if version >= 4 else "")
    assert [c[0] for c in got[0][1]] == [c[0] for c in written[0][1]]
    sizes = [c[1] for c in got[0][1]]
    assert sizes == ([1000, 1000, 500] if chunking == hashfile.FIXED else [900] * 3 if version >= 3 else [0] * 3)
    (tmp_path / "snap").write_bytes(raw)
    df = hashfile.read_hash_files(spark, str(tmp_path / "snap"))
    assert sorted((x.file_no, x.chunk_no) for x in df.collect()) == [(0, 0), (0, 1), (0, 2), (2, 0)]
    merged = hashfile.read_hash_files(spark, str(tmp_path / "snap"), one_file_per_trace=True)
    assert sorted((x.file_no, x.chunk_no) for x in merged.collect()) == [(0, 0), (0, 1), (0, 2), (0, 3)]
    with pytest.raises(ValueError):
        hashfile.read_header(b"\0" * 20)


def test_versions_are_restored_together(spark, tmp_path):
    """All versions, or some, from one pass over the containers."""
    schema, config = "file_id long, file_name string, data binary", StoreConfig(chunk_algorithm="fixed", chunk_avg_size=1024)
    store, r = Store(spark, f"file://{tmp_path}/store", config), random.Random(5)
    made = [r.randbytes(3000) for _ in range(3)]
    for v in range(3):
        store.backup(spark.createDataFrame([(0, "a", made[0]), (v, f"f{v}", made[v])][: 2 if v else 1], schema))
    got = lambda *versions: {(x.version, x.file_id, bytes(x.data)) for x in store.restore(*versions).collect()}
    want = {(0, 0, made[0]), (1, 0, made[0]), (1, 1, made[1]), (2, 0, made[0]), (2, 2, made[2])}
    assert got(0, 1, 2) == want
    assert got(0, 2) == {w for w in want if w[0] != 1}
    plan = store.restore(0, 1, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("data#") and plan.count("Relation") == 2
    for wrong in ((), (0, 3)):
        with pytest.raises(ValueError):
            store.restore(*wrong)


@pytest.mark.parametrize("chunking", [hashfile.FIXED, hashfile.VARIABLE])
def test_hash_files_of_many_files(spark, tmp_path, chunking, monkeypatch):
    """Rows of many files are made at once, and a file may fall into several batches."""
    monkeypatch.setattr(hashfile, "ROWS", 4)
    r = random.Random(3)
    written = [({"path": f"/f{i}", "file_size": 10 * n - 3 if n else 0, "uid": i}, [(r.randbytes(20), 10 - 3 * (j == n - 1), j) for j in range(n)]) for i, n in enumerate([1, 0, 2, 11, 0, 3])]
    raw = hashfile.build(written, 7, chunking, 10, 20, 6)
    want = [(i, f["path"], j, c[0].ljust(32, b"\0").hex().upper(), c[1], c[2], f["uid"]) for i, (f, chunks) in enumerate(written) for j, c in enumerate(chunks)]
    tables = [list(zip(*(c.to_pylist() for c in columns), strict=True)) for columns in hashfile._tables(raw, False)]
    assert len(tables) > 2 and max(map(len, tables)) < 9
    assert [(*row[:6], row[6 + hashfile.FILE_FIELDS.index("uid")]) for t in tables for row in t] == want
    assert [row[:3:2] for columns in hashfile._tables(raw, True) for row in zip(*(c.to_pylist() for c in columns), strict=True)] == [(0, i) for i in range(17)]
    with pytest.raises(ValueError):
        list(hashfile._tables(raw[:-1], False))


def test_files_are_joined_from_rows(spark, tmp_path):
    parts = spark.createDataFrame([("b", 2, b"2"), ("a", 1, b"x"), ("b", 10, b"3"), ("b", 1, b"1")], "file_name string, at long, data binary").repartition(3)
    files.write_joined(parts, [("a", b"<"), ("b", b">")], f"file://{tmp_path}/joined")
    assert {p.name: p.read_bytes() for p in (tmp_path / "joined").iterdir()} == {"a": b"<x", "b": b">123"}


def test_store_round_trip(spark, tmp_path):
    """a and b are random, c is a copy of a: a third of the bytes is saved, all comes
    back, before and after an upgrade, and expiring gives containers free."""
    r = random.Random(1)
    a, b = r.randbytes(102_400), r.randbytes(102_400)
    data = [(0, "a", a), (1, "b", b), (2, "c", a)]
    made = spark.createDataFrame(data, "file_id long, file_name string, data binary")
    config = StoreConfig(chunk_algorithm="rabin", chunk_avg_size=4096, chunk_min_size=512, chunk_max_size=65536)
    store = Store(spark, f"file://{tmp_path}/store", config)
    assert store.backup(made) == 0
    stats = store.stats().first()
    assert round(1 - stats.stored_bytes / stats.bytes, 4) == 0.3333
    assert {(x.version, x.phase) for x in store.throughput().where("seconds >= 0 AND mb_per_s > 0").collect()} == {(0, "chunk"), (0, "dedup"), (0, "write")}
    assert {(x.file_id, bytes(x.data)) for x in store.restore(0).collect()} == {(i, d) for i, _, d in data}
    d = r.randbytes(50_000)
    assert store.backup(spark.createDataFrame([(0, "b", b), (1, "d", d)], made.schema)) == 1
    assert {(x.file_id, bytes(x.data)) for x in store.restore(1).collect()} == {(0, b), (1, d)}
    new = store.upgrade(f"file://{tmp_path}/new")
    assert {(x.file_id, bytes(x.data)) for x in new.restore(0).collect()} == {(i, x) for i, _, x in data}
    assert new.table("recipe").select(F.max(F.length("fp"))).first()[0] == 64
    store.expire(1)
    assert {(x.file_id, bytes(x.data)) for x in store.restore(1).collect()} == {(0, b), (1, d)}
    with pytest.raises(ValueError):
        store.restore(0)


def _contents(store):
    return {v: sorted((x.file_id, bytes(x.data)) for x in store.restore(v).collect()) for v in store.versions()}


def test_a_job_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    """Each job fails before, between and after its writes; it can then be run again, what
    is stored is stored once, and vacuum leaves what is in use."""
    r = random.Random(3)
    schema = "file_id long, file_name string, data binary"
    a, b = r.randbytes(6_000), r.randbytes(9_000)
    store = Store(spark, f"file://{tmp_path}/store", StoreConfig(chunk_algorithm="fixed", chunk_avg_size=1000))
    first, second = (spark.createDataFrame(x, schema) for x in ([(0, "a", a), (1, "b", b)], [(0, "a", a + b"more")]))
    store.backup(first)

    def broken(job, steps):
        """Runs the job once for each step, failing there."""
        before = _contents(store)
        for step in range(steps):
            left = [step]
            write, publish = Store._write, Store._publish

            def check():
                if left[0] == 0:
                    raise OSError("gone")
                left[0] -= 1

            with monkeypatch.context() as m:
                m.setattr(Store, "_write", lambda self, name, df: (check(), write(self, name, df))[1])
                m.setattr(Store, "_publish", lambda self, n, e: (check(), publish(self, n, e))[1])
                with pytest.raises(OSError, match="gone"):
                    job()
            assert _contents(store) == before

    broken(lambda: store.backup(second), 4)
    assert store.backup(second) == 1
    assert _contents(store) == {0: [(0, a), (1, b)], 1: [(0, a + b"more")]}
    assert store.table("container_entry").count() == store.table("container_entry").select("cid", "fp").distinct().count() == 16
    broken(lambda: store.expire(1), 4)
    store.expire(1)
    assert _contents(store) == {1: [(0, a + b"more")]}
    assert store.vacuum() >= 6
    assert store.vacuum() == 0
    assert _contents(store) == {1: [(0, a + b"more")]}
    assert store.backup(first) == 2
    assert _contents(store)[2] == [(0, a), (1, b)]
    with pytest.raises(Exception, match="(?i)exists"):  # two jobs of one number
        store._publish(0, {"job": "backup"})


def test_written_files(spark, tmp_path):
    rows = [("a.txt", b"one"), ("sub/b.bin", bytes(range(256))), ("/c", b"")]
    files.write_files(spark.createDataFrame(rows, "file_name string, data binary"), f"file://{tmp_path}/out")
    assert [(tmp_path / "out" / n.lstrip("/")).read_bytes() for n, _ in rows] == [d for _, d in rows]


def test_hash_after_compression(spark):
    df = spark.createDataFrame([(b"x" * 99,), (b"x" * 99,), (b"y",)], "d binary").select(compressed_fp("d").alias("h"))
    assert df.distinct().count() == 2


def test_zstd(spark):
    df = spark.createDataFrame([(b"x" * 1000,), (None,), (b"",)], "d binary").withColumn("z", zstd_compress("d"))
    got = df.select("d", F.length("z").alias("n"), zstd_decompress("z", F.coalesce(F.length("d"), F.lit(0))).alias("back")).collect()
    assert all(r.d == r.back for r in got)
    assert got[0].n < 100


def test_streaming_dedup(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "fp string, size long").write.parquet(f"{tmp_path}/in")
    found = first_chunks(spark.readStream.schema("fp string, size long").parquet(f"{tmp_path}/in"))
    q = found.writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.fp for r in spark.table("firsts").collect()) == ["a", "b"]
    assert os.path.isdir(f"{tmp_path}/ck")


def test_streaming_backup(spark, tmp_path):
    r = random.Random(6)
    schema = "file_id long, file_name string, data binary"
    a, b = r.randbytes(20_000), r.randbytes(20_000)
    store = Store(spark, f"file://{tmp_path}/store", StoreConfig(chunk_algorithm="fixed", chunk_avg_size=1000))
    for rows in ([(0, "a", a)], [(0, "b", b), (1, "a", a)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        backup_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/ck").awaitTermination(120)
    assert store.versions() == [0, 1]
    stats = store.stats().first()
    assert (stats.bytes, stats.stored_bytes) == (60_000, 40_000)
    assert {(x.file_id, bytes(x.data)) for x in store.restore(1).collect()} == {(0, b), (1, a)}


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 5 AS size UNION ALL SELECT timestamp'2024-01-01 00:01:10', 7 UNION ALL SELECT timestamp'2024-01-01 00:00:50', 2").write.parquet(f"{tmp_path}/e")
    found = windowed_counts(spark.readStream.schema("ts timestamp, size int").parquet(f"{tmp_path}/e"), "ts", "1 minute", "10 minutes")
    found.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.chunks, r.bytes) for r in spark.table("counts").collect()) == [(1, 7), (2, 7)]


def test_command_line(capsys):
    from granary.__main__ import main

    with pytest.raises(SystemExit):
        main(["--help"])
    assert "back up" in capsys.readouterr().out
