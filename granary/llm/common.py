"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.scratch import cut  # noqa: F401  used by the operators

#: Word patterns of the contracts.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of the driver's own rows, as a constant of the plan."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to add; a caller's
    column of the same name (in any case) gives way to the result."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII only take the fast
    built-in; others are translated letter by letter, as `lower` would also
    change letters beyond A-Z."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column, separators: str) -> Column:
    """The words between `separators`; none for a null text."""
    found = F.array_remove(F.split(text, separators), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3: 1 marks the held-out documents."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """False where doc_id is null; such rows never train either."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, per: str, keep: list[str]) -> DataFrame:
    """About `rows` rows for each value of `per`, chosen by a hash of doc_id alone, so it
    is the same on every run. Used to fit classifiers; the bound is the caller's
    documented parameter."""
    share = F.lit(0.0)
    for value, n in df.groupBy(per).count().collect():
        share = F.when(F.col(per).eqNullSafe(F.lit(value)), F.lit(min(1.0, rows / n))).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return df.where(spread < share).select(*keep)


#: Where the three bits of a value in a bit set are read from the value.
SHIFTS = (0, 20, 40)


def _bit(value: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(bits - 1).cast("bigint")).cast("int")


def bit_set(values: DataFrame, name: str, bits: int) -> Column:
    """A set of hashes as an array of longs, three bits for each; `bits` is a power of two,
    and bits / 64 longs at most come to the driver."""
    each = values.select(F.explode(F.array(*[_bit(F.col(name), shift, bits) for shift in SHIFTS])).alias("b"))
    got = each.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, b & 63)").alias("m")).groupBy("w").agg(F.bit_or("m")).collect()
    full = [0] * (bits // 64)
    for w, m in got:
        full[w] = m
    return F.split(F.lit(",".join(map(str, full))), ",").cast("array<bigint>")


def in_bit_set(set_: Column, bits: int, value: Column) -> Column:
    """Whether a hash may be in the set; those that are in it always pass."""
    found = None
    for shift in SHIFTS:
        at = _bit(value, shift, bits)
        one = F.getbit(F.get(set_, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1
        found = one if found is None else found & one
    return found


def robust_bands(df: DataFrame, group: str, value: str, low: float, high: float, step: float = 1 / 256) -> dict[str, tuple[float, float]]:
    """For each value of `group` a least and a greatest value: `low` robust deviations
    below and `high` above the median of all its rows (nulls aside). Each side has its
    own deviation (1.4826 times the median distance from the median of the rows on that
    side), as tails differ. Medians are read from a histogram of steps of `step`, which
    is all that comes to the driver."""
    at = F.floor(F.col(value) / step).cast("bigint").alias("s")
    by: dict[str, list] = {}
    for name, s, n in df.where(F.col(value).isNotNull()).groupBy(group, at).count().collect():
        by.setdefault(name, []).append(((s + 0.5) * step, n))

    def median(pairs):
        pairs = sorted(pairs)
        half, so_far = sum(n for _, n in pairs) / 2, 0
        for x, n in pairs:
            so_far += n
            if so_far >= half:
                return x
        return 0.0

    out = {}
    for name, pairs in by.items():
        mid = median(pairs)
        below = max(1.4826 * median([(mid - x, n) for x, n in pairs if x <= mid]), 4 * step)
        above = max(1.4826 * median([(x - mid, n) for x, n in pairs if x >= mid]), 4 * step)
        out[name] = (mid - low * below, mid + high * above)
    return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row. A plain column would be
    inlined by the optimizer into lambdas and be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)
