"""Changing the fingerprint function of a store.

Stored chunks are hashed once, container by container, which gives a map from old to
new fingerprints; recipes are then rewritten by a join with the map. Keyed by the old
fingerprint (PFU) or by container and fingerprint (Con-PFU, Sim-PFU), the join is the
same plan; the order in which recipes are handled matters to caches only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.config import FEATURES_PER_RECIPE
from granary.functions.scalar import lane, lane_constants
from granary.operators.ordering import dense_index
from granary.sources.scratch import cut


def fingerprint_map(entries: DataFrame, new_entries: int) -> DataFrame:
    """(old_cid, old_fp, new_fp, new_cid) of stored chunks (cid, fp, urank, new_fp)."""
    return entries.select(F.col("cid").alias("old_cid"), F.col("fp").alias("old_fp"), "new_fp", F.floor(F.col("urank") / new_entries).cast("bigint").alias("new_cid"))


def upgrade_by_fingerprint(recipe: DataFrame, fp_map: DataFrame) -> DataFrame:
    """PFU: the map is keyed by fingerprint; of several copies the last container wins."""
    last = fp_map.groupBy("old_fp").agg(F.max_by("new_fp", "old_cid").alias("new_fp"), F.max_by("new_cid", "old_cid").alias("new_cid"))
    return recipe.join(last, recipe["fp"] == last["old_fp"]).drop("old_fp")


def upgrade_by_container(recipe: DataFrame, fp_map: DataFrame) -> DataFrame:
    """Con-PFU and Sim-PFU: the map is keyed by container and fingerprint."""
    return recipe.join(fp_map, (recipe["cid"] == fp_map["old_cid"]) & (recipe["fp"] == fp_map["old_fp"])).drop("old_fp", "old_cid")


def recipe_features(recipe: DataFrame, key: str = "file_id", lanes: int = FEATURES_PER_RECIPE) -> DataFrame:
    """(key, k, feature): MinHash lanes over the container ids of a recipe."""
    # A container counts once; its lanes are wide numbers, and dear.
    minima = recipe.select(key, "cid").distinct().groupBy(key).agg(*[F.min(lane(F.col("cid"), k)).alias(f"f{k}") for k in range(lanes)])
    return minima.select(key, F.posexplode(F.array(*[f"f{k}" for k in range(lanes)])).alias("k", "feature"))


def feature_classes(features: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, rep): recipes of equal features are one class, named by its least member."""
    vectors = features.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "feature"))).alias("v")).select(key, F.sha2(F.to_json("v"), 256).alias("v"))
    return vectors.join(vectors.groupBy("v").agg(F.min(key).alias("rep")), "v").select(key, "rep")


def similar_recipes(features: DataFrame, key: str = "file_id", block: int = 4096) -> DataFrame:
    """(a, b, shared), a < b: how many features any two class representatives share, for
    all that share one. Which class a recipe belongs to is in feature_classes. The members of a
    feature that many have are met in blocks of about `block`, so no task has all of them."""
    reps = features.join(feature_classes(features, key).where(F.col(key) == F.col("rep")).select(key), key, "left_semi")
    rows = cut(reps.select("k", "feature", F.col(key).alias("a")))
    blocks = rows.groupBy("k", "feature").agg(F.count("*").alias("n")).where("n > 1").select("k", "feature", F.ceil(F.col("n") / block).cast("int").alias("s"))
    held = rows.join(blocks, ["k", "feature"])
    left = held.select("k", "feature", "a", F.pmod(F.xxhash64("a"), F.col("s")).cast("int").alias("block"))
    right = held.select("k", "feature", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("block"))
    return left.join(right, ["k", "feature", "block"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def inverted_features(features: DataFrame, key: str = "file_id") -> DataFrame:
    """(k, feature, recipes): how many recipes each feature has."""
    return features.groupBy("k", "feature").agg(F.count("*").alias("recipes"))


def unique_containers(recipe: DataFrame, key: str = "file_id") -> DataFrame:
    return recipe.groupBy(key).agg(F.count_distinct("cid").alias("containers"))


def split_recipe(recipe: DataFrame, least: int, expected: int, most: int, key: str = "file_id") -> DataFrame:
    """(key, sub_id, first_chunk, chunks, containers): recipes cut by content. A part
    ends at a container whose id is 0 modulo expected - least once it has `least`
    different ones, or at `most`; chunks of containers that it has already still join."""

    ship(recipe.sparkSession)

    def parts_of(cids: list[int]) -> Iterator[tuple[int, int, int]]:
        i = 0
        while i < len(cids):
            start, seen = i, set()
            while i < len(cids) and len(seen) < most:
                cid = cids[i]
                if cid not in seen:
                    seen.add(cid)
                    if len(seen) >= least and cid % (expected - least) == 0:
                        break
                i += 1
            while i < len(cids) and cids[i] in seen:
                i += 1
            yield start, i - start, len(seen)

    def scan(batches):
        for batch in batches:
            keys, out = [], []
            for name, cids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(sub, *part) for sub, part in enumerate(parts_of(cids.values.to_pylist()))]
                keys += [name] * len(found)
                out += found
            columns = [keys, *(zip(*out, strict=True) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[key, "sub_id", "first_chunk", "chunks", "containers"])

    # A row for each recipe: grouped rows in Python would cost a frame for each.
    held = recipe.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "cid"))).alias("c")).select(key, F.col("c.cid").alias("cids"))
    return held.mapInArrow(scan, f"{key} long, sub_id long, first_chunk long, chunks long, containers long")


def sub_recipes(recipe: DataFrame, parts: DataFrame, key: str = "file_id", most: int = 1 << 20) -> DataFrame:
    """`recipe` with sub, which names the part (of split_recipe) that a chunk is in: the
    recipe's key times `most` plus the part's number. Parts can be used as recipes."""
    numbers = F.explode(F.sequence(F.col("first_chunk"), F.col("first_chunk") + F.col("chunks") - 1)).alias("chunk_no")
    return recipe.join(parts.select(key, (F.col(key) * most + F.col("sub_id")).alias("sub"), numbers), [key, "chunk_no"])


def similarity_order(features: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, pos): recipes in the order in which each is the most similar to the last: the
    one with most shared features, of those the one whose last shared lane comes first, then
    the least id; the least id left where none shares any. Recipes of equal features follow
    each other, so the ordered pass sees one row of 8 numbers for each class of them."""
    lanes = len(lane_constants())
    classes = cut(feature_classes(features, key))
    wide = features.join(classes.where(F.col(key) == F.col("rep")).select("rep"), F.col(key) == F.col("rep"))
    rows = wide.groupBy("rep").pivot("k", list(range(lanes))).agg(F.first("feature")).select(F.lit(1).alias("one"), "rep", F.array(*[F.col(str(k)).cast("string") for k in range(lanes)]).alias("f"))

    ship(features.sparkSession)

    def order(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", ignore_index=True)
        codes = np.stack([pd.factorize(part["f"].str[k])[0] for k in range(lanes)], axis=1)
        by_lane = [pd.Series(np.arange(len(part))).groupby(codes[:, k]).indices for k in range(lanes)]
        left, taken = np.ones(len(part), bool), []
        lows = iter(range(len(part)))
        now = None
        while len(taken) < len(part):
            near = np.empty(0, np.int64)
            if now is not None:
                for k in range(lanes):
                    mine = by_lane[k][codes[now, k]]
                    by_lane[k][codes[now, k]] = mine[left[mine]]
                near = np.unique(np.concatenate([by_lane[k][codes[now, k]] for k in range(lanes)]))
            if len(near):
                same = codes[near] == codes[now]
                last = lanes - 1 - np.argmax(same[:, ::-1], axis=1)
                now = int(near[np.lexsort((near, last, -same.sum(axis=1)))[0]])
            else:
                now = next(i for i in lows if left[i])
            left[now] = False
            taken.append(now)
        return pd.DataFrame({"rep": part["rep"].to_numpy()[taken], "rank": range(len(taken))})

    ranked = rows.groupBy("one").applyInPandas(order, "rep long, rank long")
    return dense_index(classes.join(ranked, "rep").select(key, "rank"), ["rank", key], "pos").select(key, "pos")


def upgrade_counters(recipe: DataFrame, entries: DataFrame) -> DataFrame:
    """(mode, hashed): chunks that each way of upgrading has to hash."""
    logical = recipe.agg(F.count("*").alias("hashed"))
    stored = entries.agg(F.count("*").alias("hashed"))
    out = logical.select(F.lit("lfu").alias("mode"), "hashed")
    for mode in ("pfu", "con-pfu", "sim-pfu"):
        out = out.unionByName(stored.select(F.lit(mode).alias("mode"), "hashed"))
    return out
