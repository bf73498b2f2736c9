"""Cache policies of restore and upgrade. They never change what is restored; they
count how often containers are read. LRU is played in spans; the others are one ordered
pass over a version's container ids, as their state depends on all before."""

from __future__ import annotations

import heapq
from collections import OrderedDict, defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.config import CACHE_ENTRY_BYTES, CONTAINER_BYTES
from granary.operators.layout import access_records
from granary.operators.spans import SPAN
from granary.sources.scratch import cut


class Lru:
    """Keys, the least recently used of which go when there are more than `size`; no
    bound if size is not positive."""

    def __init__(self, size: int):
        self.size, self.held = size, OrderedDict()

    def touch(self, key) -> bool:
        """Whether the key is held; afterwards it is."""
        if key in self.held:
            self.held.move_to_end(key)
            return True
        self.held[key] = None
        if 0 < self.size < len(self.held):
            self.held.popitem(last=False)
        return False


class ByteLru:
    """Groups of entries, the least recently used of which go while the entries would
    fill the bytes."""

    def __init__(self, most: int):
        self.most, self.used, self.held = most, 0, OrderedDict()

    def get(self, key) -> bool:
        if key in self.held:
            self.held.move_to_end(key)
            return True
        return False

    def put(self, key, entries: int) -> None:
        cost = entries * CACHE_ENTRY_BYTES
        while self.most > 0 and self.held and self.used + cost >= self.most:
            _, gone = self.held.popitem(last=False)
            self.used -= gone
        self.held[key] = cost
        self.used += cost


def lru_reads(cids, size: int) -> int:
    lru = Lru(size)
    return sum(not lru.touch(c) for c in cids)


def opt_reads(cids, size: int, window: int | None = None) -> int:
    """Container reads when the container whose next use is farthest goes. Uses that lie
    more than `window` records ahead of the record in hand are not known."""
    uses = defaultdict(deque)
    runs = [c for k, c in enumerate(cids) if not k or c != cids[k - 1]]
    known, held, reads, heap = 0, {}, 0, []
    horizon = window or len(runs)
    buffered = 0

    def fill():
        nonlocal known, buffered
        while known < len(runs) and buffered < horizon:
            uses[runs[known]].append(known)
            known += 1
            buffered += 1

    fill()
    for record, cid in enumerate(runs):
        if buffered * 2 <= horizon:
            fill()
            for c in held:  # next uses may have become known
                heapq.heappush(heap, (-(uses[c][0] if uses[c] else 1 << 62), held[c], c))
        uses[cid].popleft()
        buffered -= 1
        if cid not in held:
            reads += 1
            while len(held) >= size:
                far, age, c = heapq.heappop(heap)
                if c in held and held[c] == age and -far == (uses[c][0] if uses[c] else 1 << 62):
                    del held[c]
        held[cid] = record
        heapq.heappush(heap, (-(uses[cid][0] if uses[cid] else 1 << 62), record, cid))
    return reads


def assembly_reads(cids, sizes, area: int) -> int:
    """Container reads of forward assembly: chunks are laid out in an area of bytes; the
    container of the first chunk is read and fills every place in the area that it can;
    the ready chunks at the front leave."""
    queue, used, reads = deque(), 0, 0  # [cid, size, ready]
    waiting = defaultdict(list)

    def assemble():
        nonlocal used, reads
        if not queue:
            return
        reads += 1
        for c in waiting.pop(queue[0][0]):
            c[2] = True
        while queue and queue[0][2]:
            used -= queue.popleft()[1]

    for cid, size in zip(cids, sizes, strict=True):
        c = [cid, int(size), False]
        queue.append(c)
        waiting[cid].append(c)
        used += c[1]
        if used >= area:
            assemble()
    while queue:
        assemble()
    return reads


def lru_hits(accesses: DataFrame, size: int, span: int = SPAN) -> DataFrame:
    """`accesses` (version, seq, cid, ...) with hit: whether an LRU cache of `size`
    containers (no bound if it is not positive) holds the container. What the cache holds
    at the start of a span are the last `size` different containers before it, so each
    span lists its own last ones, the lists are handed on, and spans are played alone."""
    if size <= 0:
        first = accesses.groupBy("version", "cid").agg(F.min("seq").alias("__first"))
        return accesses.join(first, ["version", "cid"]).withColumn("hit", F.col("seq") > F.col("__first")).drop("__first")
    ship(accesses.sparkSession)
    kind = accesses.schema["cid"].dataType.simpleString()
    part_of = accesses.select("version", "seq", "cid").withColumn("__r", F.floor(F.col("seq") / span).cast("bigint"))

    def recent(part: pd.DataFrame) -> pd.DataFrame:
        cids = part.sort_values("seq")["cid"].to_numpy()[::-1]
        _, at = np.unique(cids, return_index=True)
        return pd.DataFrame({"version": [part["version"].iloc[0]], "__r": [part["__r"].iloc[0]], "last": [cids[np.sort(at)[:size]]]})

    def hand_on(part: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for last in part.sort_values("__r")["last"]:
            out.append(held)
            own, known = last.tolist(), set(last.tolist())
            held = own + [x for x in held if x not in known][: size - len(own)]
        return pd.DataFrame({"version": part["version"], "__r": part.sort_values("__r")["__r"].to_numpy(), "held": out})

    lists = cut(part_of.groupBy("version", "__r").applyInPandas(recent, f"version long, __r long, last array<{kind}>"))
    # A row of `size` ids for each span goes through this.
    starts = cut(lists.groupBy("version").applyInPandas(hand_on, f"version long, __r long, held array<{kind}>"))

    def play(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        lru = Lru(size)
        for cid in reversed(start["held"].iloc[0].tolist()):
            lru.touch(cid)
        return pd.DataFrame({"version": part["version"], "seq": part["seq"], "hit": [lru.touch(c) for c in part["cid"].tolist()]})

    hits = part_of.groupBy("version", "__r").cogroup(starts.groupBy("version", "__r")).applyInPandas(play, "version long, seq long, hit boolean")
    return accesses.join(hits, ["version", "seq"])


def restore_cost(recipe: DataFrame, policy: str, cache: int, window: int | None = None, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """(version, chunks, bytes, container_reads, speed_factor): MiB per container read.
    Policies `opt` and `asm` are one ordered pass over a version's container ids."""
    rows = recipe.select("version", "seq", "cid", "size")
    factor = F.round(F.col("bytes") / (1 << 20) / F.greatest(F.col("container_reads"), F.lit(1)), 6).alias("speed_factor")
    if policy == "lru":
        out = lru_hits(rows, cache).groupBy("version").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"), F.count_if(~F.col("hit")).alias("container_reads"))
        return out.select("*", factor)
    if policy not in ("opt", "asm"):
        raise ValueError(f"no restore cache policy {policy}")
    ship(recipe.sparkSession)

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        reads = opt_reads(part["cid"].tolist(), cache, window) if policy == "opt" else assembly_reads(part["cid"].tolist(), part["size"].tolist(), max(1, (cache - 1) * container_bytes))
        return pd.DataFrame([(part["version"].iloc[0], reads)], columns=["version", "container_reads"])

    seen = access_records(rows) if policy == "opt" else rows  # Belady sees runs of one container as one use
    reads = seen.groupBy("version").applyInPandas(scan, "version long, container_reads long")
    total = rows.groupBy("version").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"))
    return total.join(reads, "version").select("version", "chunks", "bytes", "container_reads", factor)


def cfl(recipe: DataFrame, cache: int, container_bytes: int = CONTAINER_BYTES, entry: int = 28) -> DataFrame:
    """(version, ocf, ccf, cfl): containers that the bytes would fill, containers read
    under an LRU cache, and their ratio."""
    hits = lru_hits(recipe.select("version", "seq", "cid", "size"), cache)
    out = hits.groupBy("version").agg(F.ceil(F.sum(F.col("size") + entry) / container_bytes).cast("bigint").alias("ocf"), F.count_if(~F.col("hit")).alias("ccf"))
    return out.select("*", F.round(F.col("ocf") / F.col("ccf"), 6).alias("cfl"))


def upgrade_lookups(ordered: DataFrame, sizes: DataFrame, cache_bytes: int, by: str) -> DataFrame:
    """(mode, chunks, external_lookups) of the map from old to new fingerprints.

    ordered: (pos, cid, fp) in the order in which recipes are sent; sizes: (cid,
    chunk_num). by='fp' caches single entries, which are of one size, so that the cache is
    an LRU of so many; by='cid' whole containers. As containers differ in size, that is one
    pass in order over the runs of equal containers."""
    if by == "fp":
        most = max(1, -(-cache_bytes // CACHE_ENTRY_BYTES) - 1) if cache_bytes > 0 else 0
        hits = lru_hits(ordered.select(F.lit(0).cast("bigint").alias("version"), F.col("pos").alias("seq"), F.col("fp").alias("cid")), most)
        return hits.agg(F.count("*").alias("chunks"), F.count_if(~F.col("hit")).alias("external_lookups")).select(F.lit(by).alias("mode"), "chunks", "external_lookups")
    runs = access_records(ordered.select(F.lit(0).cast("bigint").alias("version"), F.col("pos").alias("seq"), "cid"))
    ship(ordered.sparkSession)

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        lru, misses = ByteLru(cache_bytes), 0
        for cid, entries in zip(part["cid"].tolist(), part["chunk_num"].tolist(), strict=True):
            if not lru.get(cid):
                misses += 1
                lru.put(cid, entries)
        return pd.DataFrame([(by, misses)], columns=["mode", "external_lookups"])

    found = runs.join(sizes.select("cid", "chunk_num"), "cid").groupBy("version").applyInPandas(scan, "mode string, external_lookups long")
    chunks = ordered.agg(F.count("*").alias("chunks")).select(F.lit(by).alias("mode"), "chunks")
    return found.join(chunks, "mode").select("mode", "chunks", "external_lookups")


def index_overhead(recipe: DataFrame, cache: int) -> DataFrame:
    """(version, lookups, cache_hits, kv_lookups, kv_hits, unique_lookups): what an exact
    index does with a stream. A duplicate is found in the cached lists of containers, or
    in the key-value store, whose hit brings its container's list into the cache; a
    unique chunk misses both. recipe: version, seq, cid, is_dup."""
    rows = recipe.select("version", "seq", "cid", "is_dup")
    found = lru_hits(rows.where("is_dup"), cache).groupBy("version").agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("kv_hits"))
    every = rows.groupBy("version").agg(F.count("*").alias("lookups"), F.count_if(~F.col("is_dup")).alias("unique_lookups"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = every.join(found, "version", "left").select("version", "lookups", none("cache_hits"), none("kv_hits"), "unique_lookups")
    return both.select("version", "lookups", "cache_hits", (F.col("kv_hits") + F.col("unique_lookups")).alias("kv_lookups"), "kv_hits", "unique_lookups")
