"""Quality, language, toxicity."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import langid, quality, textscan, toxicity
from granary.llm.common import rows_of
from tests.llm.helpers import awkward, empty, prose

TEXTS = ["", None, " ", "a", "a b", "one two\nthree  four\n\none two\n", "x y z x y z x y z", "é è # * $ | < > &&", "\n\n\n", "w " * 70, prose(1, 400), "a b c\r\na b c\r\n a b c", "日本 語 テスト"]


# --- text scanning ----------------------------------------------------------------


def test_spans_and_hashes():
    column = pa.array(TEXTS * 3)
    seen = 0
    for lo, hi, data, offsets in textscan.blocks(column):
        starts, ends, first = textscan.spans(~textscan.SPACES[data], offsets)
        hashes = textscan.span_hashes(data, starts, ends)
        by = {}
        for k in range(hi - lo):
            words = re.findall(rb"[^\x20\x09-\x0D]+", ((TEXTS * 3)[lo + k] or "").encode())
            got = [bytes(data[a:b]) for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert got == words
            for w, h in zip(got, hashes[first[k] : first[k + 1]], strict=True):
                assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)
        seen = hi
    assert seen == len(column)
    assert [b[:2] for b in textscan.blocks(pa.array(["a", "b", "c"]).slice(1))] == [(0, 2)]


def test_blocks_cut_between_rows(monkeypatch):
    monkeypatch.setattr(textscan, "BLOCK", 64)
    rows = [prose(i, i % 9) for i in range(50)] + [prose(99, 300)]
    parts = [bytes(d[a:b]).decode() for _, _, d, o in textscan.blocks(pa.array(rows)) for a, b in zip(o, o[1:], strict=False)]
    assert parts == rows


# --- quality ----------------------------------------------------------------------


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_statistics():
    r = random.Random(6)
    texts = TEXTS + ["".join(r.choice("ab \n#é") for _ in range(r.randrange(300))) for _ in range(200)]
    got = quality.statistics(pa.array(texts))
    for k, text in enumerate(texts):
        assert [int(got[c][k]) for c in quality.BASE[:-1]] == slow_statistics(text), text


def slow_model(texts):
    """Interpolated modified Kneser-Ney over byte 4-grams, with dictionaries."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    counts = {4: Counter()}
    for t in texts:
        b = t.encode().translate(low)
        counts[4].update(b[i : i + 4] for i in range(len(b) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        n = [0] + [max(1, sum(v == j for v in c.values())) for j in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0] + [min(j, max(0.1, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)]
        total, taken = Counter(), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            taken[g[:-1]] += d[min(v, 3)]
        tables[k] = (c, d, total, taken)

    def p(gram):
        if not gram:
            return 1 / 256
        c, d, total, taken = tables[len(gram)]
        lower = p(gram[1:])
        if gram[:-1] not in total:
            return lower
        return max(0, c[gram] - d[min(c[gram], 3)]) / total[gram[:-1]] + taken[gram[:-1]] / total[gram[:-1]] * lower

    def bits(text):
        b = text.encode().translate(low)
        grams = [b[i : i + 4] for i in range(len(b) - 3)]
        return -sum(math.log2(p(g)) for g in grams) / len(grams) if grams else None

    return bits


def test_repeats_do_not_depend_on_neighbours(monkeypatch):
    """A window that runs into the next row must not hide a repeat, however rows are batched."""
    texts = ["a b c p q a b c z a b", "c p q a b c z a b"] * 5
    r = random.Random(11)
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(800)]
    want = [slow_statistics(t)[-1] for t in texts]
    assert want[0] == 6
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(textscan, "BLOCK", size)
        assert quality.statistics(pa.array(texts))["n_repeat_words"].tolist() == want


@pytest.mark.parametrize("most_broadcast", [quality.MOST_BROADCAST, 120, 0])
def test_perplexity_against_dictionaries(spark, most_broadcast):
    """With the model in arrays, with its rare grams joined, and with all of it joined."""
    rows = [(i, prose(i, 60), ("aa", "bb", None, "")[i % 4]) for i in range(40)]
    rows += [(90, "Unseen QUEUE 0123456789 é", "aa"), (91, "abc", "aa"), (92, None, "bb"), (93, "lone text", "zz"), (94, prose(3, 60), "aa"), (94, prose(3, 60), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.assess(df, most_broadcast=most_broadcast).collect()
    assert len(got) == len(rows)
    models = {lang: slow_model([t or "" for _, t, x in rows if x == lang]) for lang in {x for _, _, x in rows}}
    for r in got:
        want = models[r.lang](r.text or "")
        assert (want is None and r.perplexity is None) or abs(want - math.log2(r.perplexity)) < 1e-4


def test_model_is_a_distribution(spark):
    """The probabilities of the bytes seen after a context, and the mass left to shorter
    contexts, make one: with each byte seen after it they sum up to one."""
    rows = [(0, bytes([65 + k % 20, 97, 98, c]).decode(), "x") for k in range(40) for c in range(128)]
    p = quality.estimate(quality.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("text IS NOT NULL")))
    sums = p.groupBy((F.shiftright("gram", 8)).alias("c")).agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert sums
    assert all(0 < r.s <= 1 + 1e-9 for r in sums)


def test_bands_reject_what_is_unlike(spark):
    rows = [(i, prose(i, 100), "aa") for i in range(200)] + [(900, " ".join(random.Random(k).choice("qxzjv") + str(k) + random.Random(k).choice("QWX") for k in range(100)), "aa"), (901, prose(5, 30), "aa"), (902, "ban dor mis " * 40, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert not got[900].base_failed
    assert not got[900].kept
    assert got[901].base_failed
    assert got[902].base_failed
    assert all(got[i].kept for i in range(200))


def test_each_band_rejects(spark):
    """A text that is somewhat unlike the others; and a skewed tail that widens its own side only."""
    mixed_ = lambda i: " ".join(w + random.Random(i).choice("qxzj") if k % 20 == 0 else w for k, w in enumerate(prose(i, 100).split()))
    rows = [(i, prose(i, 100), "aa") for i in range(200)] + [(900, mixed_(900), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert not got[900].base_failed
    assert not got[900].kept
    assert [tuple(r) for r in quality.rejections(df).collect()] == [("aa", 201, 0, 1)]
    measured = spark.createDataFrame([(5.0 + k / 100, False, "=aa") for k in range(-20, 21)] + [(5.0 + k / 10, False, "=aa") for k in range(1, 21)], "__gr_bits double, base_failed boolean, __gr_lang string")
    least, most = quality.bands(measured, 4, 4)["=aa"]
    mid = 5.10
    assert mid - least < most - mid


def test_quality_of_awkward_rows(spark):
    got = quality.assess(awkward(spark)).collect()
    assert len(got) == 12
    for r in got:
        assert [r[c] for c in quality.BASE[:-1]] == slow_statistics(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept in (True, False)
    assert quality.assess(empty(spark)).count() == 0


# --- language ---------------------------------------------------------------------


def slow_lengths(texts, probe):
    """Bits of a text by escaping from context to context, with dictionaries."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    seen = defaultdict(Counter)
    for t in texts:
        b = t.encode().translate(low)
        padded = b"\n\n\n" + b
        for i in range(3, len(padded)):
            for k in range(4):
                if k <= i - 3 + 3:
                    seen[padded[i - k : i]][padded[i]] += 1
    b = b"\n\n\n" + probe.encode().translate(low)
    total = 0.0
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0):
            c = seen.get(b[i - k : i])
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / whole)
                break
            total -= math.log2(len(c) / whole)
        else:
            total += 8
    return total


def test_code_lengths_against_dictionaries():
    texts = {"a": [prose(i, 30) for i in range(5)], "b": ["der die das und " * 5, "ein haus"], "c": ["été où ça"]}
    counts = langid._counter([pa.RecordBatch.from_pylist([{"lang": x, "text": t} for x, ts in texts.items() for t in ts])])
    together = pa.Table.from_batches(list(counts)).group_by(["lang", "k", "gram"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
    scorer = langid.Scorer(langid.train(langid.collected(together)))
    probes = [prose(9, 20), "und ein QUARK", "é", "x", "", "ça où haus 12"]
    joined = pa.array(probes)
    for lo, hi, data, offsets in textscan.blocks(joined):
        got = scorer.code_lengths(data, offsets)
        for k in range(lo, hi):
            for j, lang in enumerate(scorer.languages):
                assert abs(got[k, j] - slow_lengths(texts[lang], probes[k])) < 1e-2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_prediction_does_not_read_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    a = langid.identify(docs, model).select("text", "lang_pred", "score", "byte_bits").collect()
    b = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1), model).select("text", "lang_pred", "score", "byte_bits").collect()
    assert a == b


def test_texts_like_no_language(spark):
    rows = [(i, prose(i, 80), "aa") for i in range(200)]
    odd = ["".join(random.Random(k).choice("qxzjvwkyQXZ0123456789{}[]();=<>/+") for _ in range(400)) for k in range(20)]
    odd += ["これは日本語の文章です。" * 20, None, "", "12345 !!"]
    docs = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs))
    gone = {r.doc_id for r in found.where(langid.unlike(found)).collect()}
    assert gone == set(range(1000, 1000 + len(odd)))


def test_language_of_awkward_rows(spark):
    df = awkward(spark)
    out = langid.identify(df, langid.fit(df)).collect()
    assert len(out) == 12
    for r in out:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
        assert r.held_out is not None
    assert langid.identify(empty(spark), None).count() == 0
    assert langid.fit(empty(spark)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


# --- toxicity ---------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.assess(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    pairs = [(r.score, r.toxic) for r in out]
    rank = sorted(pairs)
    ones = sum(t for _, t in pairs)
    auc = (sum(i + 1 for i, (_, t) in enumerate(rank) if t) - ones * (ones + 1) / 2) / (ones * (len(pairs) - ones))
    caught = sum(r.predicted and r.toxic for r in out)
    assert auc > 0.9
    assert caught / ones > 0.75
    assert caught / max(1, sum(r.predicted for r in out)) > 0.9


def sentences(seed=0, n=600):
    """Toxic ones name one group more often than others; the insult makes them toxic."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.3
        words = prose(seed + i, 20).split()
        if r.random() < (0.7 if bad else 0.1):
            words.insert(r.randrange(20), "muslim")
        if bad:
            words.insert(r.randrange(20), r.choice(("gorblax", "snidwort", "fleem")))
        out.append((" ".join(words), int(bad)))
    return out


@pytest.mark.parametrize("fairness", [0.0, 5.0])
def test_counterfactual_penalty(fairness):
    rows = sentences()
    model = toxicity.train([toxicity.features_of(t) for t, _ in rows], np.array([y for _, y in rows]), fairness=fairness)
    named = pa.array([prose(9000 + i, 15) + " muslim" for i in range(50)])
    swapped = pa.array([prose(9000 + i, 15) + " hindu" for i in range(50)])
    a, b = toxicity.score(model, named), toxicity.score(model, swapped)
    logit = lambda x: np.log(x / (1 - x))
    gap = np.abs(logit(a) - logit(b)).mean()
    assert gap < 0.3 if fairness else gap > 0.6
    bad = toxicity.score(model, pa.array([prose(9000 + i, 15) + " gorblax" for i in range(50)]))
    assert (bad > 0.7).all()
    if fairness:
        assert (a < 0.5).all()


def test_penalty_covers_every_term_of_a_group():
    """No term of the group scores unlike another after the fit, also those never seen."""
    rows = sentences()
    model = toxicity.train([toxicity.features_of(t) for t, _ in rows], np.array([y for _, y in rows]), fairness=5.0)
    free = toxicity.train([toxicity.features_of(t) for t, _ in rows], np.array([y for _, y in rows]), fairness=0.0)
    terms = toxicity.IDENTITY_TERMS[1]
    odds = lambda m: np.array([toxicity.log_odds(m, [toxicity.features_of(f"{prose(9000 + i, 15)} {t}") for i in range(20)]).mean() for t in terms])
    assert np.ptp(odds(model)) < 0.4
    assert np.ptp(odds(free)) > 1.5 * np.ptp(odds(model))


def test_cross_validation_tells_settings_apart():
    rows = sentences(7, 300)
    texts, toxic = [toxicity.features_of(t) for t, _ in rows], np.array([y for _, y in rows])
    good, blind = toxicity.cross_validate(texts, toxic, [{"least_deviations": 3.0}, {"least_deviations": 99.0}], folds=3)
    assert good[0] < blind[0]
    assert good[2] > 0.9 > blind[2]


def test_toxicity_of_awkward_rows(spark):
    labels = rows_of(spark, "doc_id bigint, toxic int", [(4, 1), (5, 0), (6, None), (None, 1), (9, 1), (4, 0)])
    model = toxicity.fit(awkward(spark), labels)
    out = toxicity.assess(awkward(spark), model).collect()
    assert len(out) == 12
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    none = toxicity.fit(empty(spark), labels.limit(0))
    assert toxicity.assess(awkward(spark), none).where("predicted = 1").count() == 0
    assert toxicity.assess(empty(spark), none).count() == 0
