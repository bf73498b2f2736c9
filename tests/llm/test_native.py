"""Sharding, mixing, decontamination and license scans."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, licenses, mixing, sharding
from granary.llm.common import rows_of
from tests.llm.helpers import SF, awkward, empty, prose

DIGEST = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def check_shards(rows, shards, slack):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards
        assert r.law == "bytes"
        assert r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total = sum(sizes.values())
    for s in range(shards):
        assert abs(sizes[s] - total / shards) <= slack, (s, sizes[s], total / shards)


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = r.text.encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    check_shards(rows, 16, 2 * max(r["size"] for r in rows) + 1)


def test_shards_split_a_hot_text(spark):
    """A third of the rows are copies of one text: shards stay even."""
    rows = [(i, "same words" if i % 3 == 0 else prose(i, 3)) for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16, 0.01).select(*DIGEST, "text").collect()
    total = sum(r["size"] for r in got)
    check_shards(got, 16, 0.03 * total / 16 + 50)
    where = defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    apart = sum(len(s) > 1 for s in where.values())
    assert apart <= 15  # only a splitter parts equal texts
    assert sorted(where["same words"]) == list(range(min(where["same words"]), max(where["same words"]) + 1))


def test_shards_of_awkward_rows(spark):
    got = sharding.shard_documents(awkward(spark)).collect()
    assert len(got) == 12
    assert {r.doc_id: r["size"] for r in got if r.text is None} == {1: 1, None: 1}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert got[0]["source"] in ("s", None)
    assert sharding.shard_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("doc_id", [7, None])
def test_shards_part_a_row_that_repeats(spark, doc_id):
    """Half of the rows are one row, with an id or without: shards and windows stay even."""
    rows = [(doc_id, "the same row over and over")] * 2000 + [(i, prose(i, 6)) for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16, 0.01).select(*DIGEST, "text").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    check_shards(got, 16, 0.03 * sum(r["size"] for r in got) / 16 + 60)


def test_splitters_meet_the_tolerance(spark):
    docs = spark.createDataFrame([(i, prose(i, i % 40)) for i in range(4000)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 7, 0.02).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    even = sum(sizes.values()) / 7
    assert all(abs(v - even) <= 0.02 * 2 * even + 300 for v in sizes.values())


# --- decontamination --------------------------------------------------------------


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_contamination(docs, items):
    grams = defaultdict(set)
    for item, text in items:
        if item is None:
            continue
        w = words_of(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in range(1, 9):
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= 2))
    return out


def test_contamination_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, prose(100 + i, r.randrange(9, 40))) for i in range(20)] + [(30, "tiny item"), (31, "ONE"), (32, ""), (33, None), (None, prose(5, 20)), (34, prose(101, 30)), (35, "five words are in here")]
    docs = []
    for i in range(120):
        text = prose(1000 + i, r.randrange(0, 200)).split()
        for _ in range(r.randrange(3)):
            w = words_of(items[r.randrange(len(items))][1])
            a = r.randrange(len(w) + 1)
            text[r.randrange(len(text) + 1) : 0] = w[a : a + r.randrange(4, 20)]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(text).title() if i % 4 else " ".join(text)))
    docs += [(200, None), (201, ""), (202, "The Tiny-ITEM one"), (202, "The Tiny-ITEM one"), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(map(str, map(tuple, decontaminate.contamination(df, bench).select(*cols).collect())))
    assert got == sorted(map(str, slow_contamination(docs, items)))


def test_contamination_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, prose(4, 80)), (2, prose(4, 20))], "item_id long, text string")
    got = decontaminate.contamination(awkward(spark), bench).collect()
    assert len(got) == 12
    assert {r.doc_id for r in got if r.contaminated} == {4, 5}
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    none = decontaminate.contamination(awkward(spark), bench.limit(0))
    assert none.where("n_items > 0").count() == 0
    assert none.count() == 12


def test_every_shared_span_of_eight_words_is_found(spark):
    """The guarantee of winnowing, for spans at all offsets."""
    item = prose(77, 60)
    w = item.split()
    docs = [(i, prose(900 + i, 30) + " | " + " ".join(w[i : i + 8]) + " | " + prose(1900 + i, 30)) for i in range(53)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), min_items=1)
    assert got.where("contaminated").count() == 53


# --- mixing -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = mixing.domains_of(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    return docs, labels, mixing.mix(docs, labels).cache()


def test_targets_are_met(mixture):
    docs, _, out = mixture
    total = out.agg(F.sum("n_tokens")).first()[0]
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.select("text").collect())
    sums = out.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.WEIGHTS]).first()
    for d, share in mixing.WEIGHTS.items():
        assert abs(sums[d] - share * total) < 1e-6 * total
    low, high = out.agg(F.min("rate"), F.max("rate")).first()
    assert 0 <= low < 1 < high


def test_posteriors_and_copies(mixture):
    docs, labels, out = mixture
    known = out.join(labels.withColumnRenamed("domain", "d"), "doc_id")
    right = known.where("d = domain").count() / known.count()
    most = max(r["count"] for r in labels.groupBy("domain").count().collect()) / known.count()
    assert right > most
    for r in out.select("p_high", "p_low", "p_toxic", "rate", "copies").collect():
        assert abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    expected, got = out.agg(F.sum("rate"), F.sum("copies")).first()
    assert abs(expected - got) < 4 * out.count() ** 0.5
    assert mixing.materialise(out, docs.columns).columns == docs.columns
    assert mixing.materialise(out, docs.columns).count() == got


def slow_rates(rows, targets):
    """Plain projected gradient descent with small steps."""
    import numpy as np

    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in sorted(targets)] for r in rows])
    want = np.array([targets[d] for d in sorted(targets)])
    rate = np.full(len(rows), want.sum() / n.sum())
    scale = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
    for _ in range(20_000):
        rate = np.maximum(0, rate - scale * p @ ((rate * n) @ p - want))
    return (rate * n) @ p


def test_unreachable_targets_come_nearest(mixture):
    docs, labels, _ = mixture
    out = mixing.mix(docs, labels, {"high": 0.0, "low": 0.2, "toxic": 0.8})
    rows = out.select("n_tokens", "p_high", "p_low", "p_toxic", "rate").collect()
    total = sum(r.n_tokens for r in rows)
    targets = {"high": 0.0, "low": 0.2 * total, "toxic": 0.8 * total}
    want = slow_rates(rows, targets)
    got = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in sorted(targets)]
    off = lambda x: sum((a - targets[d]) ** 2 for a, d in zip(x, sorted(targets), strict=True)) ** 0.5
    assert off(got) <= off(want) + 0.01 * total


def test_mixing_awkward_rows(spark):
    labels = rows_of(spark, "doc_id bigint, quality int, toxic int", [(4, 1, 0), (6, 0, 0), (9, None, 1), (None, 1, 0), (4, 1, None), (10, None, None)])
    labelled = mixing.domains_of(labels)
    assert {(r.doc_id, r.domain) for r in labelled.collect()} == {(4, "high"), (6, "low"), (9, "toxic")}
    out = mixing.mix(awkward(spark), labelled)
    assert out.count() == 12
    assert out.where("rate IS NULL OR copies IS NULL OR p_high IS NULL").count() == 0
    assert mixing.mix(awkward(spark), labelled.limit(0)).count() == 12
    assert mixing.mix(empty(spark), labelled).count() == 0


# --- licenses ---------------------------------------------------------------------


def slow_scan(docs, templates):
    def shingles(text):
        w = words_of(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    out = []
    for doc, text in docs:
        s = shingles(text)
        for t, _, body in templates:
            b = shingles(body)
            if b and 100 * len(s & b) >= 80 * len(b):
                out.append((doc, t, len(s & b), len(b)))
    return sorted(out, key=str)


def test_license_scan_against_brute_force(spark):
    r = random.Random(8)
    docs = []
    for i in range(150):
        body = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][2].split()
        if len(body) > 15 and i % 3 == 0:
            body[r.randrange(2)] = "changed"  # an edge word: one shingle or two are lost
        if i % 7 == 0:
            body[len(body) // 2] = "changed"
        docs.append((i, prose(i, r.randrange(60)) + ". " + " ".join(body) + "\n" + prose(i + 500, r.randrange(60))))
    docs += [(900, None), (901, ""), (902, "Released under the MIT License."), (902, "Released under the MIT License."), (None, "licensed under cc by 4.0")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = licenses.scan(df, licenses.default_templates(spark)).select("doc_id", "template_id", "n_shared", "n_template").collect()
    assert sorted(map(tuple, got), key=str) == slow_scan(docs, licenses.pack())


@pytest.mark.parametrize("filtered", [licenses.MOST_FILTERED, 0])
def test_edited_license_texts(spark, filtered):
    """Whole texts, headers and tags with words changed, left out and put in, at random
    and at the worst even spacing, up to and beyond what the threshold allows."""
    r = random.Random(21)
    pack = [p for p in licenses.pack() if len(p[2]) < 20_000]
    docs = []
    for k, (_, _, body) in enumerate(pack):
        for every in (0, 14, 22, 26, 40, 90):
            ws = body.split()
            for i in range(len(ws) - 1, -1, -1) if every else ():
                if i % every == every // 2 or (k % 2 and r.random() < 1 / every / 2):
                    ws[i : i + 1] = r.choice([["other"], [], ["put", ws[i]]])
            docs.append((len(docs), f"{prose(len(docs), r.randrange(9))} {' '.join(ws)}; {prose(len(docs) + 7, r.randrange(9))}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = licenses.scan(df, licenses.default_templates(spark), filtered=filtered).select("doc_id", "template_id", "n_shared", "n_template").collect()
    want = slow_scan(docs, licenses.pack())
    assert sorted(map(tuple, got), key=str) == want
    assert 2 * len(pack) < len(want) < 6 * len(pack) + 200


def test_license_scan_of_awkward_rows(spark):
    templates = licenses.default_templates(spark)
    assert licenses.scan(awkward(spark), templates).count() == 0
    assert licenses.scan(empty(spark), templates).count() == 0
    assert licenses.scan(awkward(spark), templates.limit(0)).count() == 0


@pytest.mark.parametrize("filtered", [decontaminate.MOST_FILTERED, 0])
def test_a_passage_in_many_texts_and_many_items(spark, filtered):
    """One passage is in a third of the documents and in all items; both ways of
    finding candidates agree with brute force."""
    passage = prose(42, 30)
    items = [(i, f"{prose(i, 5)} {passage} {prose(50 + i, 5)}") for i in range(60)] + [(90, "tiny item"), (91, None), (60, prose(60, 12)), (60, prose(60, 12))]
    docs = [(i, f"{prose(i + 300, 20)} {passage if i % 3 == 0 else ''} {prose(i + 900, 20)} {'a tiny item' if i % 5 == 0 else ''}") for i in range(150)]
    docs += [(500, f"{passage} {prose(60, 12)}"), (501, passage), (501, passage), (None, None), (502, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), filtered=filtered)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, slow_contamination(docs, items)))
