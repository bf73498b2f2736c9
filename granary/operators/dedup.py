"""Finding duplicate chunks.

A chunk table has fp, seq (position in all streams together) and size. Exact
deduplication is one grouped minimum: a chunk is unique if it is the first of its
fingerprint. Grouping sums up on the map side, so a fingerprint that holds a third of
all chunks travels as one row a task, and the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.shipping import ship


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each fingerprint: fp, seq of its first chunk, and size."""
    return chunks.groupBy("fp").agg(F.min("seq").alias("seq"), F.min("size").alias("size"))


def mark_duplicates(chunks: DataFrame) -> DataFrame:
    """Adds is_dup: whether the fingerprint occurs earlier."""
    first = chunks.groupBy("fp").agg(F.min("seq").alias("__first"))
    return chunks.join(first, "fp").withColumn("is_dup", F.col("seq") > F.col("__first")).drop("__first")


def mark_known(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Adds is_dup: occurs earlier in the stream or in the index (column fp)."""
    known = index.select("fp").distinct().withColumn("__known", F.lit(True))
    return mark_duplicates(chunks).join(known, "fp", "left").withColumn("is_dup", F.col("is_dup") | F.coalesce("__known", F.lit(False))).drop("__known")


def totals(chunks: DataFrame) -> DataFrame:
    """chunks, unique_chunks, bytes, unique_bytes, and the share of bytes saved."""
    per = chunks.groupBy("fp").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("size").alias("u"))
    whole = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("unique_chunks"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("u"), F.lit(0)).cast("bigint").alias("unique_bytes"))
    saved = F.round((F.col("bytes") - F.col("unique_bytes")) / F.when(F.col("bytes") > 0, F.col("bytes")), 6)
    return whole.withColumn("dedup_ratio", saved)


def self_references(chunks: DataFrame) -> DataFrame:
    """Adds first_seq: the first copy of each chunk inside its segment."""
    own = chunks.groupBy("segment_id", "fp").agg(F.min("seq").alias("first_seq"))
    return chunks.join(own, ["segment_id", "fp"])


def earlier_segments(features: DataFrame, n: int, span: int = 1024) -> DataFrame:
    """(segment_id, feature, before): up to n earlier segments with the feature, the
    newest first. Found inside spans of ids and carried over their seams, so that a
    feature of all segments does not fall to one task.

    features: (segment_id, feature), distinct."""
    cut_ = features.withColumn("__r", F.floor(F.col("segment_id") / span))
    inside = Window.partitionBy("feature", "__r").orderBy("segment_id").rowsBetween(-n, -1)
    last = cut_.groupBy("feature", "__r").agg(F.slice(F.reverse(F.array_sort(F.collect_list("segment_id"))), 1, n).alias("last"))
    spans = Window.partitionBy("feature").orderBy("__r").rowsBetween(-n, -1)
    carried = last.select("feature", "__r", F.flatten(F.reverse(F.collect_list("last").over(spans))).alias("carried"))
    own = F.reverse(F.array_sort(F.collect_list("segment_id").over(inside)))
    joined = cut_.withColumn("own", own).join(carried, ["feature", "__r"])
    return joined.select("segment_id", "feature", F.slice(F.concat("own", "carried"), 1, n).alias("before"))


def similar_segments(features: DataFrame, value_length: int) -> DataFrame:
    """(segment_id, candidate, shared): earlier segments that the feature index names.
    The index keeps the last `value_length` segments of each feature, as a queue, so a
    segment finds at most so many for a feature, and pairs do not multiply.

    features: (segment_id, feature), distinct."""
    pairs = earlier_segments(features, value_length).select("segment_id", F.explode("before").alias("candidate"))
    return pairs.groupBy("segment_id", "candidate").agg(F.count("*").alias("shared"))


def top_segment(candidates: DataFrame) -> DataFrame:
    """The candidate with most shared features, ties going to the larger id."""
    best = F.max(F.struct("shared", "candidate")).alias("m")
    return candidates.groupBy("segment_id").agg(best).select("segment_id", F.col("m.candidate").alias("candidate"), F.col("m.shared").alias("shared"))


def top_k_segments(features: DataFrame, value_length: int, k: int) -> DataFrame:
    """(segment_id, rank, candidate, shared): k picks in turn; the features of a pick
    no longer count for the others. All candidates of a segment are few: at most
    value_length for each of its features."""
    pairs = earlier_segments(features, value_length).select("segment_id", "feature", F.explode("before").alias("candidate"))

    ship(features.sparkSession)

    def pick(part):
        import pandas as pd

        left = {c: set(g["feature"]) for c, g in part.groupby("candidate")}
        out = []
        for rank in range(1, k + 1):
            if not left:
                break
            best = max(left, key=lambda c: (len(left[c]), c))
            gone = left.pop(best)
            out.append((int(part["segment_id"].iloc[0]), rank, int(best), len(gone)))
            for f in left.values():
                f -= gone
        return pd.DataFrame(out, columns=["segment_id", "rank", "candidate", "shared"])

    return pairs.select("segment_id", "feature", "candidate").groupBy("segment_id").applyInPandas(pick, "segment_id long, rank int, candidate long, shared int")


def near_exact(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds is_dup under a similarity index: a chunk is a duplicate if it occurs earlier
    in its own segment, or in a segment chosen for it ((segment_id, candidate))."""
    own = chunks.groupBy("segment_id", "fp").agg(F.min("seq").alias("__first"))
    found = chosen.select("segment_id", "candidate").join(chunks.select(F.col("segment_id").alias("candidate"), "fp").distinct(), "candidate").select("segment_id", "fp").distinct().withColumn("__hit", F.lit(True))
    return (
        chunks.join(own, ["segment_id", "fp"]).join(found, ["segment_id", "fp"], "left")
        .withColumn("is_dup", (F.col("seq") > F.col("__first")) | F.coalesce("__hit", F.lit(False))).drop("__first", "__hit")
    )


def near_exact_mix(chunks: DataFrame, chosen: DataFrame, features: DataFrame) -> DataFrame:
    """near_exact, and a chunk that is itself a feature of an earlier segment is found in
    the index too (the mixed selection)."""
    first = features.groupBy(F.col("feature").alias("fp")).agg(F.min("segment_id").alias("__hook"))
    found = near_exact(chunks, chosen).join(first, "fp", "left")
    return found.withColumn("is_dup", F.col("is_dup") | F.coalesce(F.col("__hook") < F.col("segment_id"), F.lit(False))).drop("__hook")


def sampled_index(chunks: DataFrame, containers: DataFrame, ratio: int) -> DataFrame:
    """Adds is_dup under a near-exact physical index: it knows every ratio-th chunk of a
    container, and a hit prefetches that container's whole list for the segment that
    had it.

    chunks: segment_id, seq, fp; containers: (cid, pos, fp, seq of the stored chunk)."""
    hooks = containers.where(F.col("pos") % ratio == 0).select("fp", "cid", F.col("seq").alias("__stored"))
    hit = chunks.join(hooks, "fp").where(F.col("__stored") < F.col("seq")).select("segment_id", "cid").distinct()
    known = hit.join(containers.select("cid", "fp", F.col("seq").alias("__stored")), "cid").groupBy("segment_id", "fp").agg(F.min("__stored").alias("__stored"))
    own = chunks.groupBy("segment_id", "fp").agg(F.min("seq").alias("__first"))
    return (
        chunks.join(own, ["segment_id", "fp"]).join(known, ["segment_id", "fp"], "left")
        .withColumn("is_dup", (F.col("seq") > F.col("__first")) | F.coalesce(F.col("__stored") < F.col("seq"), F.lit(False))).drop("__first", "__stored")
    )
