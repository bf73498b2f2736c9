"""Benchmark decontamination by winnowing.

Every window of 8 words holds five 4-word grams; its fingerprint is the least of
their hashes. Equal windows have equal fingerprints, so comparing a document's
fingerprints with those of the benchmark finds every shared span of 8 words or
more. Hits are then extended to whole windows and compared word by word.

Items of fewer than 8 words are one window each, and every gram of such a length
is its own fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import NOT_WORD, ascii_lower, bit_set, cut, in_bit_set, let, replacing, words

WINDOW, GRAM = 8, 4
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Filter bits for each fingerprint, and the fingerprints up to which a filter is made
#: (2**21 bits, a literal of 256 KB). Those of a larger benchmark are joined instead.
BITS_EACH, MOST_FILTERED = 256, 1 << 13
#: Rows of the result that are broadcast (one for each text that is hit, of 120 bytes,
#: so 12 MB at most); more are shuffled.
MOST_BROADCAST = 100_000
W, T1, T2, AT, GRAM_TEXT, LENGTH, SET = "__gr_words", "__gr_t1", "__gr_t2", "__gr_at", "__gr_gram", "__gr_length", "__gr_set"


def _gram(ws: Column, at: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(ws, at + j) for j in range(n)])


def _hash(ws: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + j) for j in range(n)])


def _starts(ws: Column, n: int) -> Column:
    """0-based starts of windows of n words."""
    return F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))


def _fingerprints(grams: Column, at: Column) -> Column:
    """The least gram hash in the window that starts at `at`."""
    # Not array_min(slice(...)): slice copies the whole array each time.
    return F.least(*[F.get(grams, at + j) for j in range(WINDOW - GRAM + 1)])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window length, window text and fingerprint. Items without words
    or without an id have none."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(ascii_lower(F.col("text")), NOT_WORD).alias(W))
    size = F.size(W)
    ws = F.col(W)

    def of(grams):
        return F.transform(_starts(ws, WINDOW), lambda i: F.struct(_gram(ws, i, WINDOW).alias("g"), _fingerprints(grams, i).alias("f")))

    long_ = (
        items.where(size >= WINDOW)
        .select("item_id", F.explode(let(F.transform(_starts(ws, GRAM), lambda i: _hash(ws, i, GRAM)), of)).alias("x"))
        .select("item_id", F.lit(WINDOW).alias(LENGTH), F.col("x.g").alias(GRAM_TEXT), F.col("x.f").alias("f"))
    )
    short = None
    for n in range(1, WINDOW):
        one = items.where(size == n).select("item_id", F.lit(n).alias(LENGTH), F.concat_ws(" ", ws).alias(GRAM_TEXT), _hash(ws, F.lit(0), n).alias("f"))
        short = one if short is None else short.unionByName(one)
    return long_.unionByName(short).distinct()


def _found(short: list[int], test) -> Column:
    """The windows (place, length, words) of a text whose fingerprint passes `test`."""

    def short_windows(ws, length):
        return F.transform(
            F.filter(_starts(ws, length), lambda i: test(_hash(ws, i, length))),
            lambda i: F.struct(i.alias(AT), F.lit(length).alias(LENGTH), _gram(ws, i, length).alias(GRAM_TEXT)),
        )

    def windows_of(ws):
        def long_(grams):
            return F.transform(
                F.filter(_starts(ws, WINDOW), lambda i: test(_fingerprints(grams, i))),
                lambda i: F.struct(i.alias(AT), F.lit(WINDOW).alias(LENGTH), _gram(ws, i, WINDOW).alias(GRAM_TEXT)),
            )

        found = [let(F.transform(_starts(ws, GRAM), lambda i: _hash(ws, i, GRAM)), long_)]
        return F.concat(*found, *[short_windows(ws, length) for length in short])

    return let(words(ascii_lower(F.col("text")), NOT_WORD), windows_of)


def _all_fingerprints(short: list[int]) -> Column:
    """The distinct fingerprints of a text's windows."""

    def grams_of(ws, n):
        return F.transform(_starts(ws, n), lambda i: _hash(ws, i, n))

    def of(ws):
        long_ = let(grams_of(ws, GRAM), lambda grams: F.transform(_starts(ws, WINDOW), lambda i: _fingerprints(grams, i)))
        return F.array_distinct(F.concat(long_, *[grams_of(ws, n) for n in short]))

    return let(words(ascii_lower(F.col("text")), NOT_WORD), of)


def _candidates(keyed: DataFrame, windows: DataFrame, limit: int) -> DataFrame:
    """(text, place, length, words) of windows that may be in the benchmark, written.

    Up to `limit` fingerprints are a bit set that is tested where the text is. More are
    joined: texts send their distinct fingerprints, and the windows of texts with a
    match are looked at."""
    prints = windows.select("f").distinct()
    n = prints.count()
    short = sorted(r[0] for r in windows.select(LENGTH).distinct().collect() if r[0] < WINDOW)
    if n <= limit:
        bits = 1 << 12
        while bits < n * BITS_EACH:
            bits *= 2
        set_ = bit_set(prints, "f", bits)
        rows = keyed.select(T1, T2, _found(short, lambda f: in_bit_set(set_, bits, f)).alias("c"))
        return cut(rows.where(F.size("c") > 0)).select(T1, T2, F.inline("c")).distinct()
    sent = keyed.select(T1, T2, F.explode(_all_fingerprints(short)).alias("f")).distinct()
    held = cut(sent.join(prints, "f", "left_semi").select(T1, T2).distinct())
    rows = keyed.join(held, [T1, T2], "left_semi").dropDuplicates([T1, T2])
    return cut(rows.select(T1, T2, F.inline(_found(short, lambda f: F.lit(True)))))


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, filtered: int = MOST_FILTERED) -> DataFrame:
    """`docs` with n_words, n_hit (words inside an occurrence of an item's window),
    n_items, items_sha256 and contaminated (n_items >= min_items).

    A null or empty text has no words, and the digest of no items is that of the
    empty string. Rows of equal text get equal results, so repeated rows and null
    ids are harmless. The caller's columns of these names are replaced.

    Each text is read once, and only windows with a fingerprint of the benchmark leave
    the row, once for each distinct text, to be joined on their words. filtered: see
    MOST_FILTERED; the results do not depend on it.

    A passage may be in many texts and many items. So the items of a window are one set
    with an identity of its own, a text has distinct sets, and items are listed once for
    each combination of sets that occurs, whatever the number of texts that have it.
    """
    windows = cut(benchmark_windows(benchmark))
    # A set of items is named by its size and two sums of hashes: none is gathered.
    item = lambda seed: F.xxhash64(F.lit(seed), F.col("item_id").cast("string"))
    name = F.struct(F.count("*").alias("n"), F.bit_xor(item(1)).alias("x"), F.bit_xor(item(2)).alias("y"))
    sets = windows.select(LENGTH, GRAM_TEXT, "item_id").distinct().groupBy(LENGTH, GRAM_TEXT).agg(name.alias(SET))
    members = windows.join(sets, [LENGTH, GRAM_TEXT]).select(SET, "item_id").distinct()

    keyed = replacing(docs, *RESULTS).withColumn(T1, F.xxhash64("text")).withColumn(T2, F.xxhash64(F.lit(1), "text"))
    hits = _candidates(keyed, windows, filtered).join(sets, [LENGTH, GRAM_TEXT]).select(T1, T2, AT, LENGTH, SET)
    by_text = Window.partitionBy(T1, T2).orderBy(AT, LENGTH)
    end = F.col(AT) + F.col(LENGTH)
    before = F.coalesce(F.max(end).over(by_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), end - F.greatest(before, F.col(AT)))
    # A text's sets, of which it has no more than windows; a combination is their digest.
    per_text = hits.withColumn("new", new).groupBy(T1, T2).agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(SET)).alias("sets"))
    texts = cut(per_text.withColumn("combo", F.sha2(F.to_json("sets"), 256)))
    combos = texts.groupBy("combo").agg(F.first("sets").alias("sets"))
    listed = combos.select("combo", F.explode("sets").alias(SET)).join(members, SET).select("combo", F.col("item_id").cast("string").alias("i"), "item_id").distinct()
    items = listed.groupBy("combo").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("i"))), 256).alias("items_sha256"))
    result = texts.select(T1, T2, "n_hit", "combo").join(items, "combo").drop("combo")
    few = texts.count() <= MOST_BROADCAST  # a row for each of them
    return (
        keyed.withColumn("n_words", F.size(words(ascii_lower(F.col("text")), NOT_WORD)).cast("bigint"))
        .join(F.broadcast(result) if few else result, [T1, T2], "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("bigint"))
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("bigint"))
        .withColumn("items_sha256", F.coalesce("items_sha256", F.sha2(F.lit(""), 256)))
        .withColumn("contaminated", F.col("n_items") >= min_items)
        .drop(T1, T2)
    )
