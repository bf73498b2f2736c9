"""Connected components by alternating large and small stars.

Both steps are joins and grouped minima over the edge table; nothing of it comes
to the driver but its row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (columns u, v: bigint, both
    directions allowed, repeats and loops harmless); component is the least node
    that can be reached. Nodes without edges do not appear."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        # Minima are written, so that the joins do not share their grouping and a node with
        # very many links can be split.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", "m")).distinct()
        now = cut(small)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    members = now.toDF("node", "component")
    return members.union(now.select("v", "v").distinct().toDF("node", "component"))
