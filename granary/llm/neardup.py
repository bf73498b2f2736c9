"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of its distinct shingles; its sketch keeps the k least
hashes. Inverted lists are kept for runs of neighbouring retained values, not for
single ones (a passage that many documents share would put them all into one list,
and all their pairs would have to be counted): two sets that overlap by 0.8 or more share most of their least values, hence some
run, while a passage that unrelated documents share is interleaved with their own
values and rarely fills a run. A candidate pair must pass the estimate that the
sketch of the union gives, and then the exact Jaccard measure of the full sets.

Pairs are never expanded within a group of copies: equal texts form one class,
each inverted list first compares its members with its least one only, and
after that only members that are still in different components meet, inside a join
whose condition is the estimate.

Bounds. Sets that fit into the sketch (K shingles) share a run for certain. For
larger ones at a similarity of exactly 0.8, the chance that none of the runs of R
values is shared is about 0.85 ** K, 2e-7 for K = 96, and far less above it. The
estimate lies six standard deviations below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WHITE_SPACE, ascii_lower, cut, let, words
from granary.llm.components import components

K, R = 96, 4
#: Values of a wider sketch for members that meet after the first round.
WIDE = 256
#: Words of 64 parities for the same.
PARITY_WORDS = 16
THRESHOLD = 80
#: Ids whose texts are read a second time: that many are broadcast, more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _shingled(df: DataFrame, width: int) -> DataFrame:
    """Adds a struct of s (distinct shingle hashes) and 128 bits that name the word sequence."""
    def sets(ws):
        n = F.size(ws)
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(width)])))
        joined = F.concat_ws(" ", ws)
        s = F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(n, joined))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(s.alias("s"), F.xxhash64(joined).alias("c1"), F.xxhash64(F.lit(1), joined).alias("c2"))

    return df.withColumn("__gr_x", let(words(ascii_lower(F.col("text")), WHITE_SPACE), sets))


def profiles(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, the 128 bits that name a class of equal word sequences, and the sketch."""
    x = lambda name: F.col(f"__gr_x.{name}")
    return _shingled(docs.select("doc_id", "text"), width).select(
        "doc_id",
        F.size(x("s")).cast("bigint").alias("n_shingles"),
        x("c1").alias("c1"),
        x("c2").alias("c2"),
        F.slice(F.sort_array(x("s")), 1, k).alias("sketch"),
    )


def _runs(classes: DataFrame) -> DataFrame:
    """(key, rep): the inverted lists. Two sets of a union of U shingles share a run
    of 2 values if U < 10, of 3 if U < 16 and of 4 beyond, as long as they fit into
    the sketch: at most U / 5 values part the others into U / 5 + 1 runs. A set of 3
    or less reaches 0.8 with its equals only, so its key is the whole set."""
    sk, n = F.col("sketch"), F.col("n_shingles")

    def of(r: int, low: int, high: int | None):
        wanted = (n >= low) & (n <= high) if high else n >= low
        starts = F.when(wanted & (F.size(sk) >= r), F.sequence(F.lit(0), F.size(sk) - r)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(r), *[F.get(sk, i + j) for j in range(r)]))

    equal = F.when(n.between(1, 3), F.array(F.xxhash64(F.lit(1), sk))).otherwise(F.array().cast("array<bigint>"))
    keys = F.concat(equal, of(2, 4, 9), of(3, 8, 15), of(R, 13, None))
    return classes.select(F.explode(keys).alias("key"), "rep")


def _possible(sa: Column, na: Column, sb: Column, nb: Column, threshold: int) -> Column:
    """Whether the sketches (sets of the k least values, whole if they are smaller)
    leave it possible that the sets reach the threshold; exact for whole sets.

    The values up to the lesser of the two greatest retained ones are a sample,
    without replacement, of the union. At the threshold the union has
    (na + nb) / (1 + p) values, which gives the standard deviation of the share of
    common ones; six of them are allowed."""
    p = threshold / 100
    common = F.array_intersect(sa, sb)
    sized = F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold
    whole = F.size(common) * (100 + threshold) >= threshold * (na + nb)

    def sampled() -> Column:
        top = F.lit((1 << 63) - 1).cast("bigint")
        t = F.least(F.when(F.size(sa) < na, F.element_at(sa, -1)).otherwise(top), F.when(F.size(sb) < nb, F.element_at(sb, -1)).otherwise(top))

        def share(x: Column) -> Column:
            upto = lambda v: F.size(F.filter(v, lambda e: e <= F.get(x, 0)))
            i = upto(common)
            u = upto(sa) + upto(sb) - i
            left = F.greatest(F.lit(0.0), 1 - u / ((na + nb) / (1 + p)))
            return i / u >= F.lit(p) - 6 * F.sqrt(F.lit(p * (1 - p)) * (left + F.lit(0.02)) / u)

        return let(F.array(t), share)

    return sized & F.when((F.size(sa) == na) & (F.size(sb) == nb), whole).otherwise(sampled())


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sketches do not rule the threshold out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_possible(F.col("sa"), F.col("na"), F.col("sb"), F.col("nb"), threshold)).select("a", "b")


def _sets(ids: DataFrame, docs: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(doc_id, s): the full shingle sets of the documents in ids (doc_id, distinct), one
    row for each of a document's texts. repeated: whether rows repeat an id."""
    ids = cut(ids)
    few = ids.count() <= MOST_BROADCAST
    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    found = _shingled(wanted, width)
    if repeated:
        key = ["doc_id", F.col("__gr_x.c1").alias("c1"), F.col("__gr_x.c2").alias("c2")]
        return cut(found.groupBy(*key).agg(F.first("__gr_x.s").alias("s")).select("doc_id", "s"))
    return cut(found.select("doc_id", F.col("__gr_x.s").alias("s")))


def _parities(sets: DataFrame) -> DataFrame:
    """(rep, p0 ...): for each of 64 * PARITY_WORDS classes of hashes whether a set has
    an odd number of them. Two sets differ in at least as many values as in classes,
    so this rules pairs out for certain, at the cost of a few machine words."""
    v = F.col("v")
    bit = F.expr("shiftleft(1L, cast(v & 63 as int))")
    word = F.shiftrightunsigned(v, 6).bitwiseAND(F.lit(PARITY_WORDS - 1).cast("bigint"))
    each = [F.bit_xor(F.when(word == j, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"p{j}") for j in range(PARITY_WORDS)]
    return sets.select(F.col("doc_id").alias("rep"), F.explode("s").alias("v")).groupBy("rep").agg(*each)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return shared.where(100 * F.col("i") >= threshold * (F.col("n") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = THRESHOLD, k: int = K) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (the least
    doc_id that links reach) and kept (doc_id = component_id).

    Documents without words have an empty set and are linked with nothing. Rows of
    one doc_id are one node. A null doc_id has no place among components: its
    component_id and kept are null. An empty table gives no rows.
    """
    all_ = cut(profiles(docs, width, k))
    linked = all_.where("doc_id IS NOT NULL AND n_shingles > 0")
    repeated = not linked.groupBy("doc_id").count().where("count > 1").isEmpty()
    # One row for each class of equal word sequences, whatever the number of its copies.
    classes = cut(linked.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    member = cut(linked.select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).select("doc_id", "rep").distinct())
    runs = _runs(classes)
    lists = runs.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    multi = cut(runs.join(lists, "key"))

    # Each list's members against its least one.
    pairs = cut(multi.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    stars = cut(_estimated(pairs, classes, threshold).distinct())
    ends = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    edges = cut(_verified(stars, _sets(ends, docs, width, repeated), threshold))
    found = cut(components(edges))

    # Lists of one least member are one, so that a pair meets once. Where all members
    # are of one component, nothing is left to find.
    placed = cut(multi.select("lead", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("lead", "rep", F.coalesce("component", "rep").alias("comp")))
    per = placed.groupBy("lead", "comp").count()
    main = cut(per.groupBy("lead").agg(F.max_by("comp", "count").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("lead", "main"))
    rest = cut(placed.join(main, "lead"))
    sets = _sets(rest.select(F.col("rep").alias("doc_id")).distinct(), docs, width, repeated)
    wide = sets.select(F.col("doc_id").alias("rep"), F.size("s").cast("bigint").alias("n"), F.slice(F.sort_array("s"), 1, WIDE).alias("sk"))
    right = cut(rest.join(wide, "rep").join(_parities(sets), "rep"))
    left = right.where("comp <> main").select("lead", F.col("rep").alias("x"), F.col("comp").alias("xc"), F.col("n").alias("xn"), F.col("sk").alias("xs"), *[F.col(f"p{j}").alias(f"x{j}") for j in range(PARITY_WORDS)])
    # The test is part of the join, so pairs that fail it are never rows. A member of
    # the main component meets the others; two others meet once.
    apart = (F.col("xc") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("x") < F.col("rep")))
    differ = sum((F.bit_count(F.col(f"p{j}").bitwiseXOR(F.col(f"x{j}"))) for j in range(1, PARITY_WORDS)), F.bit_count(F.col("p0").bitwiseXOR(F.col("x0"))))
    few = differ * (100 + threshold) <= (F.col("xn") + F.col("n")) * (100 - threshold)
    test = apart & few & _possible(F.col("xs"), F.col("xn"), F.col("sk"), F.col("n"), threshold)
    # Written before it is made distinct, so that nothing keeps the join from being split.
    met = cut(left.alias("l").join(right.alias("r"), (F.col("l.lead") == F.col("r.lead")) & test).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")))
    more = _verified(met.distinct(), sets, threshold)
    final = cut(components(edges.union(more).union(member.where("doc_id <> rep").toDF("u", "v"))))

    none = F.col("doc_id").isNull()
    return (
        all_.select("doc_id", "n_shingles")
        .join(final, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.when(~none, F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def keep_one(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` without the near-duplicates of others: of each component the document
    with the least id stays. Rows with a null doc_id stay. If ids repeat, one row
    of each kept id stays: that of the least text, and of the least values as JSON."""
    dropped = cut(near_duplicates(docs, width, threshold).where("kept = false").select(F.col("doc_id").alias("__gr_gone")).distinct())
    few = dropped.count() <= MOST_BROADCAST
    left = docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col("__gr_gone"), "left_anti")
    repeated = cut(left.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__gr_again")))
    if repeated.isEmpty():
        return left
    again = F.col("doc_id") == F.col("__gr_again")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = left.join(repeated, again, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("__gr_row")).select("__gr_row.*")
    return left.join(repeated, again, "left_anti").unionByName(first)
