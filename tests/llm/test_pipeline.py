"""The pipeline and the registered queries."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from granary.llm import decontaminate, langid, queries
from granary.llm.common import cut
from tests.llm.helpers import awkward
from tests.llm.test_native import slow_contamination
from tests.llm.test_neardup import slow

SF = "/root/testdata/sf0.001"


def test_names():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = c.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(json.dumps({k: str(v) for k, v in zip(names, r, strict=True)}, sort_keys=True) for r in found.fetchall())
    assert sorted(json.dumps({k: str(v) for k, v in r.asDict().items()}, sort_keys=True) for r in df.collect()) == want


def test_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, before, SF))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept = [r.doc_id for r in out.collect()]
        if name != "sharded":
            assert out.columns == docs.columns
        if name == "language":
            assert set(kept) <= {d for d, _ in rows}
            assert len(kept) >= 0.98 * len(rows)
        elif name == "near_duplicates":
            assert sorted(kept) == sorted(d for d, _, _, k in slow(rows, 5) if k)
        elif name == "decontaminated":
            assert sorted(kept) == sorted(x[0] for x in slow_contamination(rows, bench) if x[3] == 0)
        elif name == "mixed":
            assert set(kept) <= {d for d, _ in rows}
        else:
            assert sorted(kept) == sorted(d for d, _ in rows)
            assert out.select(F.max("shard")).first()[0] < 16
        before = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminated", "mixed", "sharded"]


def test_language_stage_drops_what_has_no_letter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9_000_001, "12345 !!", "en", "s", 8), (9_000_002, None, None, None, None)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(odd), SF).collect()}
    assert not kept & {9_000_001, 9_000_002}


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {1, 2, 3, 4, 5, 6, None, 8, 9, 10}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert langid.UNKNOWN == "und"
    assert decontaminate.WINDOW == 8


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    assert out.count() > 0
