"""Near-duplicates against all pairs."""

import random
import re

from granary.llm import components, neardup
from tests.llm.helpers import awkward, empty, prose


def shingles(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def slow(docs, width=4, threshold=80):
    sets = [(d, shingles(t, width)) for d, t in docs]
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if a is None or b is None or not sa or not sb:
                continue
            inter = len(sa & sb)
            if 100 * inter >= threshold * (len(sa) + len(sb) - inter):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None, d == find(d) if d is not None else None) for d, s in sets), key=str)


def edited(text, rate, r):
    return " ".join(r.choice(("xa", "yo", "zu")) + str(r.randrange(99)) if r.random() < rate else w for w in text.split())


def near_copies(seed=2):
    r = random.Random(seed)
    docs, n = [], 0
    for g in range(25):
        base = prose(g, r.choice((3, 4, 5, 6, 8, 12, 20, 60, 200, 600)))
        for _ in range(r.randrange(1, 12)):
            docs.append((n, edited(base, r.choice((0, 0.005, 0.02, 0.04, 0.05, 0.06, 0.1)), r)))
            n += 1
    passage = prose(999, 60)
    for k in range(60):  # a passage that unrelated documents share
        docs.append((n, prose(5000 + k, 60) + " " + passage + " " + prose(6000 + k, 40)))
        n += 1
    return docs


def test_against_all_pairs(spark):
    docs = near_copies()
    docs += [(5000, None), (5001, ""), (5002, "  "), (5003, "Two Words"), (5004, "two\twords"), (5004, "two\twords"), (None, prose(3, 60)), (None, prose(3, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert got == slow(docs)
    assert any(not x[3] for x in got if x[3] is not None)


def test_a_large_group_around_no_centre(spark):
    """Copies of copies: links run along a chain, and no member is near all others."""
    r = random.Random(4)
    text, docs = prose(50, 150), []
    for n in range(150):
        docs.append((n, text))
        text = edited(text, 0.015, r)
    order = list(range(150))
    r.shuffle(order)
    docs = [(order[n], t) for n, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str) == slow(docs)


def test_awkward_rows(spark):
    got = neardup.near_duplicates(awkward(spark)).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4
    assert not by[5].kept
    assert by[6].kept
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, None, 8, 9, 10]))


def test_repeated_ids_leave_one_row(spark):
    df = spark.createDataFrame([(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50))], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 2]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[n] for n in (1, 2, 3)} == {1}
    assert {got[n] for n in (7, 8, 9)} == {7}
    assert {got[n] for n in range(20, 26)} == {20}
    assert {got[n] for n in range(100, 141)} == {100}
    assert 5 not in got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_rows_do_not_multiply(spark):
    """One row a thousand times over, and a near copy as often."""
    text = prose(8, 120)
    near = edited(text, 0.01, random.Random(0))
    rows = [(1, text)] * 1000 + [(2, near)] * 1000 + [(3, prose(9, 120))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1000), (2, 1, 1000), (3, 3, 1)]


def test_repeated_words_of_different_lengths(spark):
    """Sets of one to three shingles, equal though the word sequences are not."""
    texts = [" ".join(("ha", "la ba", "xa yo zu")[k] for _ in range(m)) for k in range(3) for m in range(2, 11)] + ["a b a b a b", "a b a b a b a b", "a b a b a c", "a b a b a c"]
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (4, 5):
        got = sorted(map(tuple, neardup.near_duplicates(df, width).collect()), key=str)
        assert got == slow(docs, width)
        assert {n for _, n, _, kept in got if not kept} == {1, 2, 3}
