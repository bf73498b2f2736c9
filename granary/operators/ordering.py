"""Dense numbering and running sums over a whole table, without one task that sees all
of it: rows are ranged over partitions, numbered inside each, and moved up by the
totals of the partitions before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import cut


def _ranged(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order]
    # Written at once: the ranges are drawn from a sample and must not be drawn again.
    return cut(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))


def running_total(df: DataFrame, order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows that come before in `order`, which
    must order the rows fully."""
    rows = _ranged(df, order, partitions)
    totals = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__in")).cast("bigint")).drop("__part", "__in", "__start")


def dense_index(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`, the position of each row in `order`, from 0."""
    return running_total(df.withColumn("__one", F.lit(1)), order, "__one", name, partitions).drop("__one")


def dense_index_within(df: DataFrame, key: str, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`, the position of each row in `order` among those of its `key`, from 0. No
    key is null. A range of rows goes on with at most one key from the range before, so what
    is joined has a row for each range at most, and a key of all rows is not met in one task."""
    rows = _ranged(df, [key, *order], partitions)
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part", key).agg(F.count("*").alias("__n"))  # of a key a row for each range
    starts = totals.select("__part", key, F.sum("__n").over(before).alias("__start")).where("__start > 0")
    inside = Window.partitionBy("__part", key).orderBy(*order)
    numbered = rows.withColumn("__in", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["__part", key], "left")
    return numbered.withColumn(name, (F.coalesce("__start", F.lit(0)) + F.col("__in")).cast("bigint")).drop("__part", "__in", "__start")
