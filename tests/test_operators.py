"""Operators on small inputs, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from granary.config import CONTAINER_PAYLOAD, PRESETS, StoreConfig, apply_overrides, entries_per_container, levels_agree, parse_config, yes
from granary.functions import scalar
from granary.operators import dedup, layout, ordering, restore, retention, rewriting, segmenting, simulation, spans, upgrade


def test_capacity():
    assert entries_per_container(20) == 1169
    assert entries_per_container(32) == 818


def test_numbering_across_partitions(spark):
    values = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 7) for v in values], "a long, w long")
    got = {r.a: (r.i, r.t) for r in ordering.running_total(ordering.dense_index(df, ["a"], "i"), ["a"], "w", "t").collect()}
    total = 0
    for i, v in enumerate(sorted(values)):
        assert got[v] == (i, total)
        total += v % 7
    assert ordering.dense_index(df.where("a < 0"), ["a"], "i").count() == 0


@pytest.mark.parametrize(("sizes", "entries", "containers"), [([1] * 1169, 1169, 1), ([1] * 1170, 1169, 2), ([1] * 819, 818, 2), ([CONTAINER_PAYLOAD - 5, 5], 9, 1), ([CONTAINER_PAYLOAD - 5, 6], 9, 2)])
def test_next_fit(spark, sizes, entries, containers):
    df = spark.createDataFrame([(f"{i:040X}", i, s) for i, s in enumerate(sizes)], "fp string, seq long, size int")
    assert layout.pack_next_fit(df, entries).agg(F.count_distinct("cid")).first()[0] == containers


def plain_next_fit(sizes, entries, payload):
    cid, used, count, out = 0, 0, 0, []
    for size in sizes:
        if count and (used + size > payload or count >= entries):
            cid, used, count = cid + 1, 0, 0
        out.append((cid, count))
        used, count = used + size, count + 1
    return out


@pytest.mark.parametrize("fan", [spans.FAN, 2])
def test_next_fit_over_spans(spark, monkeypatch, fan):
    """Containers go over the seams of spans, and of groups of spans."""
    monkeypatch.setattr(spans, "FAN", fan)
    r = random.Random(12)
    sizes = {s: [r.choice([1, 5, 30, 80, 200]) for _ in range(n)] for s, n in (("x", 700), ("y", 1), ("z", 130))}
    rows = [(f"{s}{i}", 3 * i + 1, size, s) for s, all_ in sizes.items() for i, size in enumerate(all_)]
    df = spark.createDataFrame(rows, "fp string, seq long, size int, s string").repartition(5)
    for entries, payload in ((9, 150), (3, 10_000), (50, 90)):
        got = {(x.s, x.seq): (x.cid, x.pos) for x in layout.pack_next_fit(df, entries, payload, "s", span=16).collect()}
        want = {(s, 3 * i + 1): place for s, all_ in sizes.items() for i, place in enumerate(plain_next_fit(all_, entries, payload))}
        assert got == want


def test_next_fit_keeps_streams_apart(spark):
    df = spark.createDataFrame([(f"{i}", i, 60, i % 2) for i in range(8)], "fp string, seq long, size int, s long")
    got = layout.pack_next_fit(df, 9, 100, "s").groupBy("s").agg(F.count_distinct("cid").alias("n")).collect()
    assert {r.s: r.n for r in got} == {0: 4, 1: 4}


def stream(n=600, seed=0, cids=12):
    r = random.Random(seed)
    out, now = [], 0
    for i in range(n):
        if r.random() < 0.2:
            now = r.randrange(cids)
        out.append((i // 300, i, now, r.randrange(50, 400), r.random() < 0.7))
    return out


def test_access_records(spark):
    rows = stream(9000, 4)
    df = spark.createDataFrame(rows, "version long, seq long, cid long, size int, is_dup boolean")
    want = [(v, s, c) for k, (v, s, c, _, _) in enumerate(rows) if not k or rows[k - 1][0] != v or rows[k - 1][2] != c]
    assert sorted(map(tuple, layout.access_records(df).collect())) == want


def plain_cbr(rows, buffer, minimal, limit, payload):
    threshold, seen, buckets, out, in_order = minimal, 0, [0] * 10000, {}, set()
    for at in range(len(rows) - buffer + 1):
        window = rows[at : at + buffer]
        here = {c for _, _, c, _, d in window if d}
        in_order &= here
        _, seq, cid, size, dup = rows[at]
        u = 0.0
        if dup and cid not in in_order:
            covered = (sum(s for _, _, c, s, d in window if d and c == cid) + size) / payload
            u = 0.0 if covered >= 1 else 1 - covered
            if u < minimal or u < threshold:
                in_order.add(cid)
            else:
                out[seq] = True
        seen += 1
        buckets[9999 if u >= 1 else int(u * 10000)] += 1
        if seen >= 100:
            count, i = 0, 9999
            while i >= int(minimal * 10000):
                count += buckets[i]
                if count >= int(seen * limit):
                    break
                i -= 1
            threshold = (i + 1) / 10000
        if not any(d and c == cid for _, _, c, _, d in rows[at + 1 : at + buffer]):
            in_order.discard(cid)
    return out


def test_cbr(spark):
    rows = [(0, *r[1:]) for r in stream(500, 9)]
    df = spark.createDataFrame(rows, "version long, seq long, cid long, size int, is_dup boolean")
    got = {r.seq for r in rewriting.cbr(df, 32, 0.3, 0.05, 20_000).where("out_of_order").collect()}
    assert got == set(plain_cbr(rows, 32, 0.3, 0.05, 20_000))
    assert got


def test_write_decision(spark):
    flags = [(a, b, c, d, e, f) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1) for e in (0, 1) for f in (0, 1)]
    df = spark.createDataFrame([tuple(map(bool, x)) for x in flags], "dup boolean, den boolean, sp boolean, ooo boolean, ic boolean, en boolean")
    got = df.withColumn("w", rewriting.write_decision(*[F.col(c) for c in df.columns])).collect()
    for r in got:
        assert r.w == (not r.dup or (not r.den and (r.sp or (r.en and r.ooo and not r.ic))))


def plain_opt(cids, size):
    runs = [c for k, c in enumerate(cids) if not k or c != cids[k - 1]]
    held, reads = [], 0
    for k, c in enumerate(runs):
        if c not in held:
            reads += 1
            if len(held) == size:
                held.remove(max(held, key=lambda h: runs[k:].index(h) if h in runs[k:] else len(runs)))
            held.append(c)
    return reads


def test_cache_policies():
    for seed in range(6):
        cids = [r[2] for r in stream(400, seed)]
        sizes = [r[3] for r in stream(400, seed)]
        lru, opt = simulation.lru_reads(cids, 4), simulation.opt_reads(cids, 4)
        assert opt == plain_opt(cids, 4) <= lru
        assert opt <= simulation.opt_reads(cids, 4, 20) <= len(cids)
        assert simulation.lru_reads(cids, 0) == len(set(cids))
        assert len(set(cids)) <= simulation.assembly_reads(cids, sizes, 2000) <= len(cids)
        assert simulation.assembly_reads(cids, sizes, 1 << 40) == len(set(cids))
    lru = simulation.ByteLru(3 * 60)
    lru.put("a", 1), lru.put("b", 1), lru.put("c", 1)
    assert not lru.get("a")
    assert lru.get("c")


@pytest.mark.parametrize("size", [0, 1, 3, 40])
def test_lru_over_spans(spark, size):
    rows = stream(900, 5)
    df = spark.createDataFrame(rows, "version long, seq long, cid long, size int, is_dup boolean").repartition(4)
    got = {r.seq: r.hit for r in simulation.lru_hits(df, size, span=7).collect()}
    want, caches = {}, {}
    for v, seq, cid, _, _ in rows:
        want[seq] = caches.setdefault(v, simulation.Lru(size)).touch(cid)
    assert got == want


@pytest.mark.parametrize("cache", [0, 61, 60 * 7, 60 * 40])
def test_upgrade_caches(spark, cache):
    r = random.Random(2)
    rows = [(5 * i, c := r.choice([r.randrange(12), 3]), f"{c}-{r.randrange(6)}") for i in range(500)]
    sizes = {c: r.randrange(1, 9) for c in range(12)}
    df, of = spark.createDataFrame(rows, "pos long, cid long, fp string"), spark.createDataFrame(sizes.items(), "cid long, chunk_num long")
    for by in ("fp", "cid"):
        lru, misses = simulation.ByteLru(cache), 0
        for _, cid, fp in rows:
            key = fp if by == "fp" else cid
            if not lru.get(key):
                misses += 1
                lru.put(key, 1 if by == "fp" else sizes[cid])
        assert [tuple(x) for x in simulation.upgrade_lookups(df, of, cache, by).collect()] == [(by, 500, misses)]


def test_switch_follows_the_level(spark):
    rows = stream(900, 6)
    df = spark.createDataFrame(rows, "version long, seq long, cid long, size int, is_dup boolean")
    got = {r.seq: (round(r.cfl, 9), r.enabled) for r in rewriting.cfl_switch(df, 0.5, 3, 1000).collect()}
    state = {}
    for v, seq, cid, size, _ in rows:
        lru, total, reads, on = state.get(v, (simulation.Lru(3), 0, 0, False))
        level = -(-total // 1000) / reads if reads else 0.0
        on = False if on and level > 0.5 else True if not on and level < 0.5 else on
        assert got[seq] == (round(level, 9), on)
        state[v] = (lru, total + size + 28, reads + (not lru.touch(cid)), on)


def test_carried_and_running_over_spans(spark):
    r = random.Random(8)
    rows = [(k, i, r.randrange(9), r.choice([None, None, None, i])) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, n long, mark long").repartition(3)
    got = spans.running(spans.carried(df, "k", "i", "mark", "last", 16), "k", "i", {"before": "n"}, 16).collect()
    by = {(x.k, x.i): (x.before, x["last"]) for x in got}
    for k in range(3):
        before, last = 0, None
        for _, i, n, mark in rows[200 * k : 200 * k + 200]:
            last = last if mark is None else mark
            assert by[k, i] == (before, last)
            before += n


def test_pairs_of_recipes(spark):
    """All pairs of representatives that share a feature, met in small blocks; the order
    is that of the plain greedy walk over all recipes."""
    r = random.Random(5)
    vectors = [[r.randrange(4) for _ in range(8)] for _ in range(25)]
    recipes = {i: vectors[r.randrange(25)] for i in range(60)}
    df = spark.createDataFrame([(i, k, f) for i, v in recipes.items() for k, f in enumerate(v)], "file_id long, k int, feature long")
    rep = {i: min(j for j, w in recipes.items() if w == v) for i, v in recipes.items()}
    assert {x.file_id: x.rep for x in upgrade.feature_classes(df).collect()} == rep
    reps = sorted(set(rep.values()))
    want = {(a, b): sum(x == y for x, y in zip(recipes[a], recipes[b], strict=True)) for a in reps for b in reps if a < b}
    for block in (3, 4096):
        assert {(x.a, x.b): x.shared for x in upgrade.similar_recipes(df, block=block).collect()} == {k: n for k, n in want.items() if n}
    left, order, now = set(recipes), [], None
    while left:
        score = lambda i: sum(x == y for x, y in zip(recipes[i], recipes[now], strict=True))
        near = [i for i in left if now is not None and score(i)]
        last = lambda i: max(k for k in range(8) if recipes[i][k] == recipes[now][k])
        now = min(near, key=lambda i: (-score(i), last(i), i)) if near else min(left)
        left.discard(now)
        order.append(now)
    assert [x.file_id for x in upgrade.similarity_order(df).orderBy("pos").collect()] == order


def test_segments_by_content(spark):
    r = random.Random(7)
    rows = [(0, i, f"{r.getrandbits(160):040X}") for i in range(400)]
    df = spark.createDataFrame(rows, "version long, seq long, fp string")
    got = [x.segment_no for x in segmenting.content_segments(df, 8, 5, 20).orderBy("seq").collect()]
    assert got == [x.segment_no for x in segmenting.content_segments(df, 8, 5, 20, span=32).orderBy("seq").collect()]
    number, count, want = 0, 0, []
    for _, _, fp in rows:
        mark = int.from_bytes(bytes.fromhex(fp[32:40]), "little", signed=True) % 8 == 0
        if count >= 5 and mark:
            number, count = number + 1, 0
            want.append(number)
            count = 1
            continue
        short = count < 5
        want.append(number)
        count += 1
        if not short and count >= 20:
            number, count = number + 1, 0
    assert got == want


def test_padded_hashes_are_always_hooks(spark):
    df = spark.createDataFrame([("ABCDEF012345",)], "fp string")
    assert df.select((scalar.residue(F.col("fp"), 97) == 0).alias("x")).first().x


def test_top_k_trims(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "c"), (4, "b"), (9, "a"), (9, "b"), (9, "c"), (9, "d")]
    df = spark.createDataFrame(rows, "segment_id long, feature string")
    got = [(r["rank"], r.candidate, r.shared) for r in dedup.top_k_segments(df, 4, 3).where("segment_id = 9").orderBy("rank").collect()]
    assert got == [(1, 1, 3), (2, 4, 0), (3, 3, 0)]
    best = dedup.top_segment(dedup.similar_segments(df, 4)).where("segment_id = 9").first()
    assert (best.candidate, best.shared) == (1, 3)


def test_near_exact_finds_no_more_than_exact(spark):
    r = random.Random(11)
    rows = [(i, f"{r.randrange(300):040d}", 100) for i in range(1000)]
    df = segmenting.fixed_segments(spark.createDataFrame(rows, "seq long, fp string, size int"), 16)
    exact = dedup.mark_duplicates(df).where("is_dup").count()
    assert exact == 1000 - len({x[1] for x in rows})
    chosen = dedup.top_segment(dedup.similar_segments(segmenting.sample_min(df, 4), 4))
    near = dedup.near_exact(df, chosen).where("is_dup").count()
    assert 0 < near <= exact


def test_split_recipe(spark):
    rows = [(0, i, c) for i, c in enumerate([1, 1, 2, 3, 4, 4, 3, 5, 6, 7, 7, 9])]
    df = spark.createDataFrame(rows, "file_id long, chunk_no long, cid long")
    got = [(r.first_chunk, r.chunks, r.containers) for r in upgrade.split_recipe(df, 2, 4, 6).orderBy("sub_id").collect()]
    assert sum(x[1] for x in got) == len(rows)
    assert got == [(0, 3, 2), (3, 4, 2), (7, 2, 2), (9, 3, 2)]


def test_similarity_order(spark):
    features = [(f, k, str(v[k])) for f, v in {0: [1, 2, 3, 4, 5, 6, 7, 8], 1: [9] * 8, 2: [1, 2, 3, 0, 0, 0, 0, 0], 3: [1, 2, 3, 4, 0, 0, 0, 0]}.items() for k in range(8)]
    df = spark.createDataFrame(features, "file_id long, k int, feature string")
    assert [r.file_id for r in upgrade.similarity_order(df).orderBy("pos").collect()] == [0, 3, 2, 1]


def test_modes_of_upgrade(spark):
    """A fingerprint in two containers: by container each copy keeps its place."""
    m = spark.createDataFrame([(0, "a", "A", 0), (5, "a", "A", 4), (1, "b", "B", 0)], "old_cid long, old_fp string, new_fp string, new_cid long")
    recipe = spark.createDataFrame([(0, "a"), (5, "a"), (1, "b")], "cid long, fp string")
    by_fp = sorted((r.cid, r.new_cid) for r in upgrade.upgrade_by_fingerprint(recipe, m).collect())
    by_cid = sorted((r.cid, r.new_cid) for r in upgrade.upgrade_by_container(recipe, m).collect())
    assert by_fp == [(0, 4), (1, 0), (5, 4)]
    assert by_cid == [(0, 0), (1, 0), (5, 4)]


def test_retention(spark):
    recipe = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "version long, cid long")
    m = retention.manifest(recipe)
    assert {r.cid for r in retention.reclaimed(m, 1).collect()} == {0}
    assert {r.cid for r in retention.live(m, 1).collect()} == {1, 2}
    assert not retention.retention_due(5, -1)
    assert retention.retention_due(5, 5)
    index = retention.feature_queue(spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("g", 1)], "feature string, segment_id long"), 2)
    more = retention.upsert(index, spark.createDataFrame([("f", 7)], "feature string, segment_id long"), 2)
    assert {r.feature: r.ids for r in more.collect()} == {"f": [7, 3], "g": [1]}
    less = retention.delete_id(more, spark.createDataFrame([(1,), (7,)], "segment_id long"))
    assert {r.feature: r.ids for r in less.collect()} == {"f": [3]}


def test_har_trims_the_largest(spark):
    u = spark.createDataFrame([(0, 1, 10), (0, 2, 20), (0, 3, 30), (0, 4, 940)], "version long, cid long, size long")
    assert {r.cid for r in rewriting.har_sparse(u, 0.5, 0.03, 1000).collect()} == {1, 2}
    assert {r.cid for r in rewriting.har_sparse(u, 0.5, 1.0, 1000).collect()} == {1, 2, 3}


def test_round_trip_difference(spark):
    a = spark.createDataFrame([(0, b"x"), (1, b"y")], "file_id long, data binary")
    b = spark.createDataFrame([(0, b"x"), (1, b"z")], "file_id long, data binary")
    assert restore.round_trip_difference(a, a).count() == 0
    assert {(r.side, r.files) for r in restore.round_trip_difference(a, b).collect()} == {("lost", 1), ("new", 1)}


def test_bloom_filter():
    bloom = scalar.BloomFilter(1 << 16)
    keys = [f"key{i}".encode() for i in range(500)]
    for k in keys:
        bloom.add(k)
    assert all(k in bloom for k in keys)
    assert sum(f"other{i}".encode() in bloom for i in range(500)) < 25
    assert scalar.STRING_HASHES["djb"](b"a") == 5381 * 33 + 97


def test_small_predicates(spark):
    row = spark.range(1).select(
        scalar.container_overflow(F.lit(10), F.lit(1), F.lit(5), 2, 15).alias("fits"),
        scalar.container_overflow(F.lit(10), F.lit(2), F.lit(1), 2, 15).alias("full"),
        scalar.container_overflow(F.lit(11), F.lit(1), F.lit(5), 2, 15).alias("over"),
        scalar.simulated_fp(F.lit("x")).alias("same"),
    ).first()
    assert tuple(row) == (False, True, True, "x")
    assert levels_agree("no", "restore")
    assert not levels_agree("append", "no")


def test_index_overhead(spark):
    rows = stream(600, 13)
    df = spark.createDataFrame(rows, "version long, seq long, cid long, size int, is_dup boolean")
    for r in simulation.index_overhead(df, 3).collect():
        mine = [x for x in rows if x[0] == r.version]
        dups = [x[2] for x in mine if x[4]]
        assert (r.lookups, r.unique_lookups) == (len(mine), len(mine) - len(dups))
        assert r.kv_hits == simulation.lru_reads(dups, 3)
        assert r.cache_hits + r.kv_lookups == r.lookups


def test_config():
    c = parse_config('# comment\nchunk-algorithm "normalized rabin"\nchunk-avg-size 4096 # more\nrewrite-algorithm cap 512\nfingerprint-index near-exact logical silo\nrewrite-enable-har yes\n')
    assert (c.chunk_algorithm, c.chunk_avg_size, c.rewrite_algorithm, c.rewrite_buffer, c.har) == ("normalized rabin", 4096, "cap", 512, True)
    assert c.resolved().segment_prefetch == 16
    assert not c.problems()
    assert apply_overrides(c, "chunk-avg-size 8192, restore-cache opt 30").restore_cache_containers == 30
    assert "chunk sizes" in StoreConfig(chunk_min_size=9999, chunk_avg_size=10).problems()
    assert len(PRESETS) == 6
    for bad in ("nonsense 1", "chunk-avg-size"):
        with pytest.raises(ValueError):
            parse_config(bad)
    with pytest.raises(ValueError):
        yes("maybe")


def test_earlier_segments_across_spans(spark):
    r = random.Random(12)
    rows = sorted({(r.randrange(4000), r.choice("abc")) for _ in range(900)})
    df = spark.createDataFrame(rows, "segment_id long, feature string")
    got = {(x.segment_id, x.feature): x.before for x in dedup.earlier_segments(df, 3, 64).collect()}
    for s, f in rows:
        assert got[s, f] == sorted((t for t, g in rows if g == f and t < s), reverse=True)[:3]
    queue = {x.feature: x.ids for x in retention.feature_queue(df, 5, 64).collect()}
    assert queue == {f: sorted((t for t, g in rows if g == f), reverse=True)[:5] for f in "abc"}


def test_runs_across_spans(spark):
    rows = [(v, s, c, z, d) for v, s, c, z, d in stream(900, 21)]
    df = spark.createDataFrame(rows, "version long, seq long, cid long, size int, is_dup boolean")
    got = {r.seq: r.run_start for r in layout.mark_runs(df, "cid", 16).collect()}
    start = None
    for k, (v, s, c, _, _) in enumerate(rows):
        if not k or rows[k - 1][0] != v or rows[k - 1][2] != c:
            start = s
        assert got[s] == start


def test_string_hashes_of_batches(spark):
    """Hex of any length and case, and null, as the functions of bytes have them."""
    texts = ["", "00", "FF", "deadBEEF", "0123456789ABCDEF" * 5, None]
    names = tuple(scalar.STRING_HASHES)
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", scalar.string_hashes(names, F.col("x")).alias("h")).collect()
    for r in got:
        assert [r.h[n] for n in names] == [None if r.x is None else scalar.STRING_HASHES[n](bytes.fromhex(r.x)) for n in names]


def test_places_within_a_key(spark):
    """Keys of one row, and one that goes on over several ranges, have no gap."""
    from granary.operators.ordering import dense_index_within

    rows = [(7, i) for i in range(0, 600, 3)] + [(k, -k) for k in range(5)] + [(9, 5), (9, 2)]
    got = dense_index_within(spark.createDataFrame(rows, "k long, x long").repartition(5), "k", ["x"], "n", 8)
    want = {(k, x, sorted(b for a, b in rows if a == k).index(x)) for k, x in rows}
    assert {(r.k, r.x, r.n) for r in got.collect()} == want
