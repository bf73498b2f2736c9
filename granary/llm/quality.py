"""Quality rules: plain text statistics and n-gram perplexity bands.

The language model is a modified Kneser-Ney model over byte 4-grams (A-Z
lower-cased), one for each value of `lang`. Every document is counted: tasks sort
the grams of their texts, and Spark adds the counts up. Continuation counts,
discounts and interpolated probabilities are joins and grouped sums over all counted
grams. As the documents that are scored were counted, all their 4-grams have a
probability of their own, so scoring is one lookup a byte: in sorted arrays of hashed
grams that are broadcast, and for rare grams beyond a bound by a join.

A document is rejected if its perplexity lies outside the band of its language, which
reaches a stated number of robust standard deviations below and above the language's
median.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.llm.common import cut, replacing, robust_bands
from granary.llm.textscan import BLOCK, CONTINUES, LOWER, SPACES, Index, blocks, per_row, scramble, span_hashes, spans

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULTS = (*BASE, "perplexity", "kept")
#: Fixed values of the contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
ORDER = 4
#: Working columns: the language, and the two hashes of a text.
LANG, T1, T2 = "__gr_lang", "__gr_t1", "__gr_t2"
#: 4-grams of the model that are broadcast (12 bytes each, so 48 MB at most): all, or the
#: most frequent of them. The rare ones then stay in Spark, and those of the documents'
#: grams that are among them, which are few, are joined with them.
MOST_BROADCAST = 1 << 22
#: Languages whose discounts (some 50 bytes each) are broadcast.
MOST_LANGUAGES = 100_000
#: Robust deviations from a language's median that the bands reach, below and above.
LOW, HIGH = 4.0, 4.0


# --- statistics ---------------------------------------------------------------


def _repeats(data, starts, ends, first, rows):
    """For each row the words inside a 3-word window that occurs twice or more in it."""
    out = np.zeros(rows, np.int64)
    n = len(starts)
    if n < 4:
        return out
    row = np.repeat(np.arange(rows), np.diff(first))
    h = span_hashes(data, starts, ends)
    key = h[:-2] * np.uint64(3) + scramble(h[1:-1] + np.uint64(1)) * np.uint64(5) + scramble(h[2:] ^ np.uint64(0x5555))
    key = scramble(key + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = np.flatnonzero(row[:-2] == row[2:])  # windows that reach into the next row are none
    order = np.argsort(key[own])
    sorted_ = key[own[order]]
    same = sorted_[1:] == sorted_[:-1]
    again = np.zeros(len(own), bool)
    again[1:] |= same
    again[:-1] |= same
    flag = np.zeros(n - 2, bool)
    flag[own[order]] = again
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= flag
    np.add.at(out, row[covered], 1)
    return out


def _dup_lines(data, offsets, starts, rows):
    """For each row the lines with a word that equal an earlier line of it."""
    lo, hi, first = spans(data != 0x0A, offsets)
    has = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    row = np.repeat(np.arange(rows), np.diff(first))[has]
    lo, hi = lo[has], hi[has]
    key = scramble(span_hashes(data, lo, hi) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[at], minlength=rows)


def statistics(column) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    out = {k: np.zeros(len(column), np.int64) for k in BASE[:-1]}
    for lo, hi, data, offsets in blocks(column):
        rows = hi - lo
        solid = ~SPACES[data]
        starts, ends, first = spans(solid, offsets)
        out["n_words"][lo:hi] = np.diff(first)
        out["word_chars"][lo:hi] = per_row(solid & ~CONTINUES[data], offsets)
        out["n_symbols"][lo:hi] = per_row(SYMBOLS[data], offsets)
        out["n_dup_lines"][lo:hi] = _dup_lines(data, offsets, starts, rows)
        out["n_repeat_words"][lo:hi] = _repeats(data, starts, ends, first, rows)
    return out


# --- language model -----------------------------------------------------------


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that lie inside a row, and for each row the first of them."""
    low = LOWER[data].astype(np.uint32)
    if len(low) < ORDER:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    keys = (low[:-3] << 24) | (low[1:-2] << 16) | (low[2:-1] << 8) | low[3:]
    inside = np.ones(len(keys), bool)
    for k in range(1, ORDER):  # grams that start in the last three bytes of a row
        at = offsets[1:] - k
        inside[at[(at >= 0) & (at < len(keys))]] = False
    at = np.zeros(len(keys) + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    return keys[inside], at[np.minimum(offsets, len(keys))]


def _counter(batches):
    """(lang, gram, count) of one partition's texts."""
    held: dict[str | None, list] = {}

    def merged(parts):
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        codes = np.asarray(pa.compute.fill_null(lang.indices, -1))
        names = [*lang.dictionary.to_pylist(), None]
        for lo, hi, data, offsets in blocks(batch.column("text")):
            keys, first = _grams(data, offsets)
            of = np.repeat(codes[lo:hi], np.diff(first))
            for code in np.unique(codes[lo:hi]):
                found = np.sort(keys[of == code])
                if not len(found):
                    continue
                at = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                parts = held.setdefault(names[code], [])
                parts.append((found[at], np.diff(np.append(at, len(found)))))
                if sum(len(p[0]) for p in parts) > 4 * BLOCK:
                    parts[:] = [merged(parts)]
    for name, parts in held.items():
        keys, counts = merged(parts)
        for at in range(0, len(keys), 1 << 16):
            k, c = keys[at : at + (1 << 16)], counts[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])


def hashed(lang: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
    """64-bit hash of a language's number and a 4-gram; one-to-one."""
    return scramble((np.asarray(lang, np.uint64) << np.uint64(32)) | gram.astype(np.uint64))


def _last(gram, k: int):
    """The last k bytes of a gram."""
    return gram.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("bigint"))


def _discounts(level: DataFrame) -> DataFrame:
    """(language, d1, d2, d3): the modified Kneser-Ney discounts of counts of 1, 2 and 3
    or more, from the numbers of grams that were counted once to four times."""
    n = [F.greatest(F.lit(1), F.count_if(F.col("n") == j)).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.lit(float(j)), F.greatest(F.lit(0.1), j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}"))).alias(f"d{j}") for j in (1, 2, 3)]
    return level.groupBy(LANG).agg(*n).select(LANG, *d)


def _probabilities(level: DataFrame, k: int, shorter: DataFrame | None, few: bool) -> DataFrame:
    """(language, gram, n, p) of the counted grams (language, gram, n) of k bytes, from p of
    the grams that are one byte shorter; before single bytes all bytes are even. few:
    whether a row for each language may be broadcast."""
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    discounts = _discounts(level)
    rows = level.join(F.broadcast(discounts) if few else discounts, LANG).select(LANG, "gram", "n", d.alias("d"), F.shiftright("gram", 8).alias("ctx"))
    contexts = rows.groupBy(LANG, "ctx").agg(F.sum("n").alias("total"), F.greatest(F.sum("d") / F.sum("n"), F.lit(1e-9)).alias("left"))
    rows = rows.join(contexts, [LANG, "ctx"])
    if shorter is None:
        rows = rows.withColumn("below", F.lit(1 / 256))
    else:
        rows = rows.withColumn("suffix", _last(F.col("gram"), k - 1)).join(shorter.select(LANG, F.col("gram").alias("suffix"), F.col("p").alias("below")), [LANG, "suffix"])
    return rows.select(LANG, "gram", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")).alias("p"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(language, gram, n): the 4-grams of all documents."""
    rows = docs.select("lang", "text").mapInArrow(_counter, "lang string, gram long, n long")
    return rows.select(language().alias(LANG), "gram", "n").groupBy(LANG, "gram").agg(F.sum("n").alias("n"))


def language(name: str = "lang"):
    """A key of the language that is never null; a null lang is one of its own."""
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name)))


def estimate(counted: DataFrame) -> DataFrame:
    """(language, gram, n, p): of each counted 4-gram (a written table) the probability of
    its last byte after the first three. Shorter grams count the distinct bytes before them."""
    levels = [counted]
    for k in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy(LANG, _last(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")))
    few, p = counted.select(LANG).distinct().count() <= MOST_LANGUAGES, None
    for k, level in enumerate(reversed(levels), 1):
        p = _probabilities(level, k, p, few)
    return p


class Scorer:
    """Grams of the model as sorted arrays of hashed (language, gram) and log2 of p."""

    def __init__(self, languages: list[str], keys: np.ndarray, logs: np.ndarray):
        self.numbers = {x: k for k, x in enumerate(languages)}
        self.index, self.logs = Index(keys), np.append(logs, np.float32(0))

    @classmethod
    def of(cls, model: DataFrame) -> Scorer:
        found = model.select(LANG, "gram", F.log2("p").alias("log")).toArrow()
        names = found.column(LANG).combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
        keys = hashed(np.asarray(names.indices).astype(np.uint64), np.asarray(found.column("gram")))
        order = np.argsort(keys)
        return cls(names.dictionary.to_pylist(), keys[order], np.asarray(found.column("log")).astype(np.float32)[order])

    def grams(self, texts, languages):
        """Of runs of rows: (first row, end row, grams, first gram of each row, whether the
        model has each, its log2 of p or 0)."""
        names = languages.dictionary_encode()
        numbers = np.array([self.numbers.get(x, len(self.numbers)) for x in names.dictionary.to_pylist()], np.int64)
        codes = numbers[np.asarray(names.indices)]
        for lo, hi, data, offsets in blocks(texts):
            keys, first = _grams(data, offsets)
            seen, at = self.index.find(hashed(np.repeat(codes[lo:hi], np.diff(first)), keys))
            yield lo, hi, keys, first, seen, np.where(seen, self.logs[at], np.float32(0))

    def sums(self, texts, languages) -> tuple[np.ndarray, np.ndarray]:
        """Of whole texts the sum of log2 of p over the grams that are here, and the number
        of all grams."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi, _, first, _, logs in self.grams(texts, languages):
            total[lo:hi], n[lo:hi] = per_row(logs.astype(np.float64), first), np.diff(first)
        return total, n


# --- the operator -------------------------------------------------------------


def _measure(docs: DataFrame, carry: list[str], scorer: Scorer | None) -> DataFrame:
    """The carried columns and the base columns; with a scorer also __gr_sum and __gr_n,
    its sums. Texts are read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # MOST_BROADCAST bounds it
    added = {**dict.fromkeys(BASE[:-1], "bigint"), **({"__gr_sum": "double", "__gr_n": "bigint"} if scorer else {})}
    schema = docs.select(*[F.col(f"`{c}`") for c in carry], *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def run(batches):
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            stats = statistics(column("text"))
            sums = shared.value.sums(column("text"), column(LANG)) if shared.value else ()
            columns = [*[column(c) for c in carry], *[pa.array(stats[c]) for c in BASE[:-1]], *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *added])

    return docs.mapInArrow(run, schema)


def base_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `docs` (all, if None) with the base columns, without the
    language model; as in assess()."""
    ship(docs.sparkSession)
    base = replacing(docs, *BASE)
    return _measure(base, base.columns if carry is None else carry, None).withColumn("base_failed", F.expr(FAILED))


def _joined_sums(docs: DataFrame, model: DataFrame, scorer: Scorer) -> DataFrame:
    """(language, text's hashes, sum): of each distinct text the sum of log2 of p over the
    grams that the scorer does not have, which are the rare ones, by a join."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            for lo, hi, keys, first, seen, _ in shared.value.grams(column("text"), column(LANG)):
                row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))[~seen]
                found, n = np.unique((row << np.uint64(32)) | keys[~seen].astype(np.uint64), return_counts=True)
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    of = pa.array((part >> np.uint64(32)).astype(np.int64) + lo)
                    yield pa.RecordBatch.from_arrays([*[column(c).take(of) for c in (LANG, T1, T2)], pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[at : at + (1 << 16)])], names=[LANG, T1, T2, "gram", "times"])

    sent = docs.select("text", LANG, T1, T2).mapInArrow(run, f"{LANG} string, {T1} long, {T2} long, gram long, times long").distinct()
    each = sent.join(model.select(LANG, "gram", F.log2("p").alias("log")), [LANG, "gram"])
    return each.groupBy(LANG, T1, T2).agg(F.sum(F.col("times") * F.col("log")).alias("__gr_rare"))


def _least_frequent(counted: DataFrame, most: int) -> int:
    """The least power of two so that `most` grams or fewer were counted as often or more;
    1 if there are no more in all."""
    tally = dict(counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect())
    least, left = 0, sum(tally.values())
    while left > most:
        left -= tally.get(least, 0)
        least += 1
    return 1 << least


def bands(measured: DataFrame, low: float, high: float) -> dict[str, tuple[float, float]]:
    """For each language the least and the greatest bits that are let through: those of
    robust_bands over the documents that pass the base rules."""
    return robust_bands(measured.where("NOT base_failed"), LANG, "__gr_bits", low, high)


def _banded(docs: DataFrame, low: float, high: float, carry: list[str] | None, most_broadcast: int) -> DataFrame:
    """The measured columns with __gr_side: -1 below the band of a document's language, 1 above it, else 0."""
    ship(docs.sparkSession)
    base = replacing(docs, *RESULTS)
    kept = base.columns if carry is None else carry
    counted = cut(count_grams(base))
    model, least = estimate(counted), _least_frequent(counted, most_broadcast)
    keyed = base.withColumn(LANG, language())
    if least > 1:
        model = cut(model)
    scorer = Scorer.of(model.where(F.col("n") >= least))
    if least == 1:
        measured = _measure(keyed, [*kept, LANG], scorer)
    else:
        keyed = keyed.withColumn(T1, F.xxhash64("text")).withColumn(T2, F.xxhash64(F.lit(1), "text"))
        rare = _joined_sums(keyed, model, scorer)
        measured = _measure(keyed, [*kept, LANG, T1, T2], scorer).join(rare, [LANG, T1, T2], "left")
        measured = measured.withColumn("__gr_sum", F.col("__gr_sum") + F.coalesce("__gr_rare", F.lit(0.0))).drop(T1, T2, "__gr_rare")
    measured = measured.withColumn("__gr_bits", F.when(F.col("__gr_n") > 0, -F.col("__gr_sum") / F.col("__gr_n"))).drop("__gr_sum", "__gr_n")
    measured = cut(measured.withColumn("base_failed", F.expr(FAILED)))
    side = F.lit(0)
    for lang, (least, most) in bands(measured, low, high).items():
        mine = F.when(F.col("__gr_bits") < least, -1).when(F.col("__gr_bits") > most, 1).otherwise(0)
        side = F.when(F.col(LANG) == lang, mine).otherwise(side)
    return measured.withColumn("__gr_side", side)


def assess(docs: DataFrame, low: float = LOW, high: float = HIGH, carry: list[str] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The columns `carry` of `docs` (all, if None) with the base columns, base_failed, perplexity (for
    a byte; null below 4 bytes) and kept. The caller's columns of these names are
    replaced. most_broadcast: see MOST_BROADCAST; results do not depend on it.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: false if
    base_failed, else whether the perplexity lies within its language's band. A null
    text has no words. A null lang is a language of its own. Repeated rows count as
    often as they occur. An empty table gives no rows.
    """
    return (
        _banded(docs, low, high, carry, most_broadcast)
        .withColumn("perplexity", F.pow(F.lit(2.0), F.col("__gr_bits")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("__gr_side") == 0))
        .drop("__gr_bits", LANG, "__gr_side")
    )


def rejections(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(lang, passed, below, above): of each language's documents that pass the base
    rules how many there are, and how many each band rejects."""
    side = F.col("__gr_side")
    rows = _banded(docs, low, high, ["lang"], MOST_BROADCAST).where("NOT base_failed")
    return rows.groupBy("lang").agg(F.count("*").alias("passed"), F.count_if(side < 0).alias("below"), F.count_if(side > 0).alias("above"))
