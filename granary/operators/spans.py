"""Scans over a stream in order, taken apart into spans, so that no stream has to fit
into one task. What a span needs to know of those before it is small, is found for each
span alone and is handed on over the spans.

Streams are told apart by the column `key` (a long); `at` orders a stream's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.sources.scratch import cut

#: Rows of a span, and spans of which one task takes the seams.
SPAN, FAN = 1 << 16, 1 << 10


def _span(at: Column, span: int) -> Column:
    return F.floor(at / span).cast("bigint")


def running(rows: DataFrame, key: str, at: str, sums: dict[str, str], span: int = SPAN) -> DataFrame:
    """Adds for each name in `sums` the total of its column over the rows that come before
    in the stream."""
    part = rows.withColumn("__r", _span(F.col(at), span))
    totals = part.groupBy(key, "__r").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    spans = Window.partitionBy(key).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "__r").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "__r", *[F.coalesce(F.sum(f"__t{i}").over(spans), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    own = part
    for i, c in enumerate(sums.values()):
        own = own.withColumn(f"__o{i}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = own.join(before, [key, "__r"])
    for i, name in enumerate(sums):
        out = out.withColumn(name, F.col(f"__o{i}") + F.col(f"__b{i}"))
    return out.drop("__r", *[f"__o{i}" for i in range(len(sums))], *[f"__b{i}" for i in range(len(sums))])


def carried(rows: DataFrame, key: str, at: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds `name`, the last `value` that is not null at or before a row in its stream."""
    part = rows.withColumn("__r", _span(F.col(at), span))
    lasts = part.where(F.col(value).isNotNull()).groupBy(key, "__r").agg(F.max_by(value, at).alias("__last"))
    spans = Window.partitionBy(key).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    every = part.select(key, "__r").distinct().join(lasts, [key, "__r"], "left")
    before = every.select(key, "__r", F.last("__last", ignorenulls=True).over(spans).alias("__before"))
    inside = Window.partitionBy(key, "__r").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumn("__own", F.last(value, ignorenulls=True).over(inside)).join(before, [key, "__r"])
    return out.withColumn(name, F.coalesce("__own", "__before")).drop("__r", "__own", "__before")


def _exits(following: np.ndarray, span: int, reach: int) -> np.ndarray:
    """Of each of the first `reach` places of a span, where the walk from it leaves the span,
    counted from its end. Steps are doubled until all are out."""
    n = len(following)
    inside = min(n, span)
    jump = np.append(following[:inside], np.arange(inside, max(n, span) + reach + 1))
    while True:
        further = jump[np.minimum(jump, len(jump) - 1)]
        if np.array_equal(further, jump):
            break
        jump = further
    return np.maximum(jump[: min(reach, inside)] - span, 0).astype(np.int32)


def _entries(maps: DataFrame, key: str) -> DataFrame:
    """(key, r, entry) from (key, r, exits): the place at which the walk enters each span.
    Beyond FAN spans maps are composed in groups, which are spans of their own."""

    def follow(part: pd.DataFrame, entry: int) -> tuple[list[int], int]:
        """The entries of consecutive spans, and the place at which the last is left."""
        out = []
        for exits in part["exits"]:
            out.append(entry)
            entry = int(exits[entry]) if entry < len(exits) else 0
        return out, entry

    schema = f"{key} long, r long, entry int"
    if (maps.agg(F.max("r")).first()[0] or 0) < FAN:
        def fold(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("r")
            return pd.DataFrame({key: part[key].tolist(), "r": part["r"].to_numpy(), "entry": follow(part, 0)[0]})

        return maps.groupBy(key).applyInPandas(fold, schema)

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        width = max(map(len, part["exits"]))
        whole = np.arange(width)
        for exits in part["exits"]:
            exits = np.append(np.asarray(exits), np.zeros(1, np.int64))
            whole = exits[np.minimum(whole, len(exits) - 1)]
        return pd.DataFrame({key: [part[key].iloc[0]], "r": [part["g"].iloc[0]], "exits": [whole.astype(np.int32)]})

    grouped = maps.withColumn("g", _span(F.col("r"), FAN))
    composed = cut(grouped.groupBy(key, "g").applyInPandas(compose, f"{key} long, r long, exits array<int>"))
    enter = _entries(composed, key).select(F.col(key), F.col("r").alias("g"), F.col("entry").alias("enter"))

    def fold_group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        return pd.DataFrame({key: part[key].tolist(), "r": part["r"].to_numpy(), "entry": follow(part, int(part["enter"].iloc[0]))[0]})

    return grouped.join(enter, [key, "g"]).groupBy(key, "g").applyInPandas(fold_group, schema)


def walk(rows: DataFrame, key: str, at: str, columns: list[str], following: Callable[[pd.DataFrame], np.ndarray], reach: int, span: int | None = None) -> DataFrame:
    """(key, at) of the places of a walk from the first row of each stream, where each
    place tells the next one. `at` counts each stream's rows from 0 without a gap, and is
    not null, nor is `key`. following: from consecutive rows (columns), numbered from 0, the
    next place of each, at most `reach` further; of rows near the end what lies beyond
    it may be missing.

    Each span finds where walks that enter it at any of its first `reach` places leave it,
    the spans are then linked, and each is walked from its own entry."""
    ship(rows.sparkSession)
    span = max(span or SPAN, reach)
    r = _span(F.col(at), span)
    # A span also sees the first rows of the next one.
    also = F.when((F.col(at) % span < reach) & (r > 0), F.array(r, r - 1)).otherwise(F.array(r))
    parts = rows.select(key, F.col(at).alias("__at"), *columns, F.explode(also).alias("r"))

    def exits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__at")
        return pd.DataFrame({key: [part[key].iloc[0]], "r": [part["r"].iloc[0]], "exits": [_exits(following(part), span, reach)]})

    maps = cut(parts.groupBy(key, "r").applyInPandas(exits, f"{key} long, r long, exits array<int>"))
    entries = cut(_entries(maps, key))

    def places(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__at")
        n = int((part["__at"] < (part["r"].iloc[0] + 1) * span).sum())
        steps, place, out = following(part).tolist(), int(part["entry"].iloc[0]), []
        while place < n:
            out.append(place)
            place = steps[place]
        first = int(part["__at"].iloc[0])
        return pd.DataFrame({key: [part[key].iloc[0]] * len(out), at: [first + x for x in out]})

    # A row for each span, so this is broadcast or split as Spark sees fit.
    return parts.join(entries, [key, "r"]).groupBy(key, "r").applyInPandas(places, f"{key} long, {at} long")
