"""Chat formatting with collapse of cumulative snapshots.

Services log a conversation again after each turn, so a table holds prefixes of
longer conversations. Each conversation gets a rolling hash of its turns; those of
its proper prefixes are the snapshots that it makes redundant. Distinct
conversations whose own hash is among them are removed by an anti-join, copies keep
the least conv_id, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, replacing

#: The template of a turn, and the marker that closes it; both are escaped in texts.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    """Markers inside a text lose their meaning."""
    text = F.coalesce(text, F.lit(""))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return text


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and turns (role, text), in the order of turn. A row without
    conv_id belongs to no conversation. A null role is `unknown` and a null text is
    empty. Null turns come first; rows of equal turn are ordered by role and text; exact
    repeats of a row count once."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        turns.where("conv_id IS NOT NULL").select("conv_id", one.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_set("x")).alias("x"))
        .select("conv_id", F.size("x").alias("n_turns"), F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def prefixes(conversations_: DataFrame) -> DataFrame:
    """(conv_id, n_turns, k, a, b): the hash of the first k turns of each conversation, for
    each k. It is the exclusive or of the hashes of the turns with their places, so it
    rolls on from turn to turn in one pass."""
    each = conversations_.select("conv_id", "n_turns", F.posexplode("turns").alias("at", "t"))
    hashed = lambda seed: F.xxhash64(F.lit(seed), "at", F.col("t.role"), F.col("t.text"))
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    narrow = each.select("conv_id", "n_turns", "at", hashed(1).alias("a"), hashed(2).alias("b"))
    return narrow.select("conv_id", "n_turns", (F.col("at") + 1).alias("k"), F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, n_turns, turns and n_collapsed, the other
    conversations that equal this one or a prefix of it."""
    whole = cut(conversations(turns))
    rolled = cut(prefixes(whole))
    distinct = cut(rolled.where("k = n_turns").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    kept = rolled.join(distinct.select("conv_id"), "conv_id", "left_semi")
    maximal = cut(distinct.join(kept.where("k < n_turns").select("a", "b").distinct(), ["a", "b"], "left_anti").select("conv_id"))
    alive = whole.join(maximal, "conv_id", "left_semi")
    own = kept.join(maximal, "conv_id", "left_semi").select(F.col("conv_id").alias("keeper"), "a", "b")
    inside = own.join(distinct.select("a", "b", "copies"), ["a", "b"]).groupBy("keeper").agg((F.sum("copies") - 1).alias("n_collapsed"))
    return alive.join(inside, F.col("conv_id") == F.col("keeper")).select("conv_id", "n_turns", "turns", "n_collapsed")


def render(conversations_: DataFrame) -> DataFrame:
    """Adds text: each turn as its role and text between markers, which are defused
    inside texts. A null role is `unknown`, a null text is empty."""
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), _escaped(t["text"]), F.lit(CLOSE + "\n"))
    return replacing(conversations_, "text").withColumn("text", F.array_join(F.transform("turns", one), ""))


def chat(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_collapsed, text. Other
    columns of the caller are not read. An empty table gives no rows."""
    return render(collapse(turns)).select("conv_id", "n_turns", F.col("n_collapsed").cast("bigint").alias("n_collapsed"), "text")
