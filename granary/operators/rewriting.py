"""Finding fragmented chunks that are worth writing again.

Input is a recipe with seq, cid, size and is_dup; unique chunks have no container yet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.operators.layout import mark_runs
from granary.operators.spans import carried, running


def capping(chunks: DataFrame, buffer: int, level: int) -> DataFrame:
    """Adds out_of_order: in each window of `buffer` chunks of a version, duplicates in
    containers beyond the `level` that give most bytes to it (ties to the lower id)."""
    w = chunks.withColumn("win", F.floor((F.col("pos")) / buffer).cast("bigint"))
    per = w.where("is_dup").groupBy("version", "win", "cid").agg(F.sum("size").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("version", "win").orderBy(F.desc("bytes"), "cid"))
    top = per.withColumn("rank", rank).where(F.col("rank") <= level).select("version", "win", "cid", F.lit(True).alias("top"))
    return w.join(top, ["version", "win", "cid"], "left").withColumn("out_of_order", F.col("is_dup") & F.col("top").isNull()).drop("top")


def cfl_selective(chunks: DataFrame, threshold: float, payload: int) -> DataFrame:
    """Adds run and out_of_order: duplicates in a run of chunks of one container whose
    bytes are below threshold * payload. Unique chunks form runs of their own."""
    where = F.when(F.col("is_dup"), F.col("cid")).otherwise(F.lit(-1))
    runs = mark_runs(chunks.withColumn("__c", where), "__c").withColumnRenamed("run_start", "run")
    size = runs.groupBy("version", "run").agg(F.sum("size").alias("__size"))
    return runs.join(size, ["version", "run"]).withColumn("out_of_order", F.col("is_dup") & (F.col("__size") < F.lit(threshold * payload))).drop("__c", "__size")


def har_sparse(utilization: DataFrame, threshold: float, limit: float, payload: int) -> DataFrame:
    """(version, cid, size): containers that a version uses for less than `threshold`
    of their capacity, least first, as long as their bytes stay within `limit` of the
    version's (the largest are dropped)."""
    total = utilization.groupBy("version").agg(F.sum("size").alias("total"))
    sparse = utilization.where(F.col("size") / F.lit(float(payload)) < threshold)
    # The running sum goes over distinct sizes first, of which there are few, and over
    # containers only where the limit falls between some of equal size.
    sizes = sparse.groupBy("version", "size").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("version").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("below", below).join(total, "version").withColumn("fits", F.least(F.col("n"), F.floor((F.lit(limit) * F.col("total") - F.col("below")) / F.col("size"))))
    if limit >= 1:
        return sparse.select("version", "cid", "size")
    held = sparse.join(room.where("fits > 0").select("version", "size", "n", "fits"), ["version", "size"])
    whole = held.where("fits = n")
    part = held.where("fits < n").withColumn("rank", F.row_number().over(Window.partitionBy("version", "size").orderBy("cid"))).where("rank <= fits")
    return whole.select("version", "cid", "size").unionByName(part.select("version", "cid", "size"))


def har_mark(chunks: DataFrame, sparse: DataFrame) -> DataFrame:
    """Adds is_sparse: duplicates in containers that were sparse in the version before."""
    inherited = sparse.select((F.col("version") + 1).alias("version"), "cid", F.lit(True).alias("__sparse"))
    return chunks.join(inherited, ["version", "cid"], "left").withColumn("is_sparse", F.col("is_dup") & F.coalesce("__sparse", F.lit(False))).drop("__sparse")


def inherited_sparse(sparse: DataFrame) -> DataFrame:
    """(version, inherited): sparse containers that were sparse in the version before."""
    before = sparse.select((F.col("version") + 1).alias("version"), "cid")
    return sparse.join(before, ["version", "cid"], "left_semi").groupBy("version").agg(F.count("*").alias("inherited"))


def write_decision(is_dup: Column, denied: Column, sparse: Column, out_of_order: Column, in_cache: Column, enabled: Column) -> Column:
    """Whether a chunk is written: if it is new, or fragmented and not denied."""
    return ~is_dup | (~denied & (sparse | (enabled & out_of_order & ~in_cache)))


def deny_repeats(chunks: DataFrame) -> DataFrame:
    """Adds denied: an earlier copy of the chunk is rewritten already."""
    first = chunks.where("out_of_order").groupBy("fp").agg(F.min("seq").alias("__first"))
    return chunks.join(first, "fp", "left").withColumn("denied", F.coalesce(F.col("seq") > F.col("__first"), F.lit(False))).drop("__first")


class _Threshold:
    """The utility that the best `limit` of those seen so far reach, in steps of 1/10000
    and not below `least`; it counts once 100 are seen. The number of utilities at or
    above the threshold is kept, so that it moves by a few steps for each utility."""

    STEPS, FROM = 10_000, 100

    def __init__(self, least: float, limit: float):
        self.limit, self.lowest, self.value = limit, min(int(least * self.STEPS), self.STEPS - 1), least
        self.tally, self.seen = [0] * self.STEPS, 0
        self.at, self.above = self.STEPS - 1, 0  # utilities in steps from `at` up

    def add(self, utility: float, times: int = 1) -> None:
        step = min(int(utility * self.STEPS), self.STEPS - 1)
        self.tally[step] += times
        self.seen += times
        self.above += times * (step >= max(self.at, self.lowest))
        wanted, own = int(self.seen * self.limit), lambda: self.tally[self.at] if self.at >= self.lowest else 0
        while self.above < wanted and self.at >= self.lowest:
            self.at -= 1
            self.above += own()
        while self.at < self.STEPS - 1 and self.above - own() >= wanted:
            self.above -= own()
            self.at += 1
        if self.seen >= self.FROM:
            self.value = (self.at + 1) / self.STEPS


def cbr(chunks: DataFrame, buffer: int, minimal_utility: float, limit: float, payload: int) -> DataFrame:
    """(version, seq, out_of_order) by context-based rewriting: a look-ahead window of
    `buffer` chunks, a utility of 1 - (bytes of the chunk's container in the window,
    and its own once more) / payload, and a threshold that follows the utilities so
    far. The last buffer - 1 chunks of a version are not judged.

    A container that was found useful enough once stays so for as long as the window has
    chunks of it; such a chunk has utility 0. What depends on the window alone (the
    bytes, and whether the container was in it without a break) is found in Spark, span by
    span; only the flags and the threshold are one pass in order over the duplicates."""
    ship(chunks.sparkSession)
    rows = chunks.select("version", "seq", "cid", "size", "is_dup")
    first = rows.groupBy("version").agg(F.min("seq").alias("__first"), F.max("seq").alias("__last"))
    ahead = Window.partitionBy("version", "cid").orderBy("seq").rangeBetween(0, buffer - 1)
    in_order = Window.partitionBy("version", "cid").orderBy("seq")
    dups = rows.where("is_dup").withColumn("bytes", F.sum("size").over(ahead)).withColumn("before", F.lag("seq").over(in_order))
    judged = dups.join(F.broadcast(first), "version").where(F.col("seq") + (buffer - 1) <= F.col("__last"))
    utility = F.greatest(F.lit(0.0), 1 - (F.col("bytes") + F.col("size")) / payload)
    # The chunk before keeps its container in the window if it leaves after this one came in.
    held = F.coalesce(F.col("seq") - F.col("before") <= buffer - 1, F.lit(False))
    known = judged.select("version", "seq", "cid", utility.alias("utility"), held.alias("held"), (F.col("seq") - F.col("__first")).alias("place"))

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        threshold, useful, out, place = _Threshold(minimal_utility, limit), {}, [], 0
        for cid, u, held_, at in zip(part["cid"].tolist(), part["utility"].tolist(), part["held"].tolist(), part["place"].tolist(), strict=True):
            threshold.add(0.0, at - place)  # unique chunks between have utility 0
            place = at + 1
            flagged = held_ and useful.get(cid, False)
            now = 0.0 if flagged else u
            rewritten = not flagged and now >= minimal_utility and now >= threshold.value
            useful[cid] = flagged or not rewritten
            out.append(rewritten)
            threshold.add(now)
        return pd.DataFrame({"version": part["version"], "seq": part["seq"], "out": out})

    found = known.groupBy("version").applyInPandas(scan, "version long, seq long, out boolean")
    return rows.select("version", "seq").join(found, ["version", "seq"], "left").select("version", "seq", F.coalesce("out", F.lit(False)).alias("out_of_order"))


def cfl_switch(chunks: DataFrame, require: float, cache: int, container_bytes: int, entry: int = 28) -> DataFrame:
    """(version, seq, cfl, enabled): the restore-cost level along the stream, under an
    LRU cache of containers, and the rewrite switch that it turns on below `require`
    and off above. The level is that of the chunks before, 0 before the first; at
    `require` the switch stays as it is, and it is off at first."""
    from granary.operators.simulation import lru_hits

    hits = lru_hits(chunks.select("version", "seq", "cid", "size"), cache)
    counted = hits.select("version", "seq", (F.col("size") + entry).alias("__size"), F.when(F.col("hit"), 0).otherwise(1).alias("__read"))
    so_far = running(counted, "version", "seq", {"__total": "__size", "__reads": "__read"})
    level = F.when(F.col("__reads") > 0, F.ceil(F.col("__total") / container_bytes) / F.col("__reads")).otherwise(F.lit(0.0))
    turned = so_far.withColumn("cfl", level).withColumn("__turn", F.when(F.col("cfl") < require, True).when(F.col("cfl") > require, False))
    return carried(turned, "version", "seq", "__turn", "__on").select("version", "seq", "cfl", F.coalesce("__on", F.lit(False)).alias("enabled"))
