"""Sharding by histogram sort.

Rows are ordered by (hash of text, hash of doc_id and text). The splitters between
shards are found without sorting: each round counts the exact bytes that lie
below a grid of probe keys, across all partitions, and the grid of the next
round refines only the cells in which a splitter lies. When every splitter
meets the tolerance, rows are exchanged once.

The law is ``bytes``: sizes of shards are nearly equal. Equal texts are
neighbours in the order, so a group of copies stays in one shard unless a
splitter has to fall inside it; a group of any weight is split by the second
part of the key, which spreads its documents evenly. Where even that is too heavy,
because one row repeats very often, the rows are written once with a number of their
own, and its hash is the third part of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, replacing, rows_of

#: Bits of a key that one round of probes resolves: 2**BITS cells.
BITS = 12
KEY_BITS = 64
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Rows of one window, in multiples of an even part, from which repeated rows are numbered.
MOST_EVEN = 8
#: Names of working columns, unlikely in a caller's table.
H1, H2, H3, CELL, SUB, PARTS, START = "__gr_h1", "__gr_h2", "__gr_h3", "__gr_cell", "__gr_sub", "__gr_parts", "__gr_start"


def _digits(key, shift: int, bits: int):
    """`bits` bits of an unsigned 64-bit key above `shift`."""
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _signed(x: int) -> int:
    return x - (1 << KEY_BITS) if x >> (KEY_BITS - 1) else x


def _unsigned_less(col, value: int):
    """col < value as unsigned 64-bit numbers (both sides flipped by the sign bit)."""
    flip = F.lit(-(1 << 63)).cast("bigint")
    return col.bitwiseXOR(flip) < F.lit(_signed(value ^ (1 << 63))).cast("bigint")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds size, text_crc32 and the two parts of the sort key."""
    text = F.col("text").cast("binary")
    return (
        replacing(docs, *ADDED, H1, H2, H3)
        .withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint"))
        .withColumn("text_crc32", F.crc32(text))
        .withColumn(H1, F.xxhash64("text"))
        .withColumn(H2, F.xxhash64(F.lit(1), "doc_id", "text"))
    )


def _grid(rows: DataFrame, key: str, prefixes: dict[int, int], shift: int, bits: int):
    """Exact bytes and rows of each cell below the given prefixes.

    prefixes: id -> the key bits above shift + bits that its cells share. Returns
    {id: {cell: (bytes, rows, least key, greatest key)}}, at most
    len(prefixes) * 2**bits cells whatever the input."""
    top = shift + bits
    if top >= KEY_BITS:
        which, rows = F.lit(next(iter(prefixes))), rows
    else:
        above = F.shiftrightunsigned(F.col(key), top)
        which = F.lit(None).cast("int")
        for k, prefix in prefixes.items():
            which = F.when(above == F.lit(prefix).cast("bigint"), F.lit(k)).otherwise(which)
    got = (
        rows.select(which.alias("k"), _digits(F.col(key), shift, bits).alias("c"), F.col(key).alias("h"), "size")
        .where("k IS NOT NULL")
        .groupBy("k", "c")
        .agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"))
        .collect()
    )
    cells: dict[int, dict[int, tuple]] = {k: {} for k in prefixes}
    for k, c, size, n, low, high in got:
        cells[k][c] = (size, n, low, high)
    return cells


def _refine(rows: DataFrame, key: str, targets: dict[int, tuple[int, int]], start: dict[int, int], tolerance: float):
    """Finds, for each id, a boundary of `key` below which the target bytes lie.

    targets: id -> bytes wanted below the boundary, counted from the start of the
    key space. Returns id -> (boundary, bytes below, single), where single is the
    key of a group too heavy to stay whole (then the boundary lies inside it)."""
    open_, done = dict(targets), {}
    prefix = dict.fromkeys(targets, 0)
    below = dict(start)
    bits, shift = BITS, KEY_BITS - BITS
    while open_:
        shown: dict[int, int] = {}  # one grid for each distinct prefix
        for k in open_:
            shown.setdefault(prefix[k], k)
        cells = _grid(rows, key, {k: p for p, k in shown.items()}, shift, bits)
        for k in list(open_):
            mine, want, at = cells[shown[prefix[k]]], open_[k], below[k]
            best = (abs(at - want), prefix[k] << (shift + bits), at)
            inside = None
            for c in sorted(mine):
                size = mine[c][0]
                if at <= want < at + size:
                    inside = (c, at)
                at += size
                best = min(best, (abs(at - want), ((prefix[k] << bits) + c + 1) << shift, at))
            if best[0] <= tolerance or inside is None:
                done[k] = (best[1], best[2], None)
                del open_[k]
                continue
            c, at = inside
            if mine[c][2] == mine[c][3]:  # one key only: nothing finer in this part
                done[k] = (mine[c][2] % (1 << KEY_BITS), at, mine[c][2])
                del open_[k]
                continue
            prefix[k], below[k] = (prefix[k] << bits) + c, at
        if not shift:
            for k in open_:  # resolved to one key at the last bit
                done[k] = (prefix[k], below[k], _signed(prefix[k]))
            break
        bits = min(BITS, shift)
        shift -= bits
    return done


def splitters(rows: DataFrame, shards: int, tolerance: float, keys: list[str]) -> tuple[list[tuple[int, ...]], bool]:
    """Boundaries between `shards` shards, in order, and whether rows of one whole key
    would have to be parted. `rows` has the key columns and size. A boundary has a number
    for the first key column or for more; rows lie below it if they do so in the order of
    the (unsigned) key columns."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    out: dict[int, tuple[int, ...]] = {}
    repeated = False

    def find(part: DataFrame, depth: int, targets: dict[int, int], start: dict[int, int], prefix: tuple[int, ...]) -> None:
        nonlocal repeated
        found = _refine(part, keys[depth], targets, start, allowed)
        last = depth + 1 == len(keys)
        for k, (edge, _, single) in found.items():
            if single is None or last:
                out[k] = (*prefix, edge)
                repeated |= single is not None
        if not last:
            for single in {x for _, _, x in found.values() if x is not None}:
                inside = {k: targets[k] for k, v in found.items() if v[2] == single}
                find(part.where(F.col(keys[depth]) == F.lit(single).cast("bigint")), depth + 1, inside, {k: found[k][1] for k in inside}, (*prefix, single % (1 << KEY_BITS)))

    find(rows, 0, {k: total * k // shards for k in range(1, shards)}, dict.fromkeys(range(1, shards), 0), ())
    return [out[k] for k in sorted(out)], repeated


def _shard_of(edges: list[tuple[int, ...]], keys: list[str]):
    """The number of splitters at or below a row's key; 15 comparisons for 16 shards."""
    def below(edge: tuple[int, ...], depth: int):
        less = _unsigned_less(F.col(keys[depth]), edge[0]) if edge[0] < 1 << KEY_BITS else F.lit(True)
        if len(edge) == 1:
            return less
        return less | ((F.col(keys[depth]) == F.lit(_signed(edge[0])).cast("bigint")) & below(edge[1:], depth + 1))

    shard = F.lit(0)
    for edge in edges:
        shard = shard + F.when(below(edge, 0), 0).otherwise(1)
    return shard.cast("int")


def _placement(full: DataFrame, keys: list[str], shards: int, tolerance: float):
    """A function that adds shard, cell and part to rows with the key columns, the rows
    before each (shard, cell, part), and whether one key has too many rows for a task."""
    spark = full.sparkSession
    narrow = cut(full.select("size", *keys))
    n = narrow.count()
    edges, repeated = splitters(narrow, shards, tolerance, keys) if n else ([], False)
    cell = _digits(F.col(H1), KEY_BITS - BITS, BITS).cast("int").alias(CELL)
    # Cells of more than twice the mean, so at most half of them.
    even = max(1, n >> BITS)
    heavy = [(c, -(-m // even)) for c, m in narrow.groupBy(cell).count().where(F.col("count") > 2 * even).collect()]
    parts = rows_of(spark, f"{CELL} int, {PARTS} bigint", heavy)
    spread = F.col(H2) if len(keys) == 2 else F.xxhash64(*keys[1:])

    def placed(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("shard", _shard_of(edges, keys))
            .withColumn(CELL, cell)
            .join(F.broadcast(parts), CELL, "left")
            .withColumn(SUB, F.coalesce(F.pmod(spread, F.col(PARTS)), F.lit(0)).cast("int"))
            .drop(PARTS)
        )

    counts = sorted(tuple(r) for r in placed(narrow).groupBy("shard", CELL, SUB).count().collect())
    starts, shard_now, at = [], None, 0
    for shard, c, s, m in counts:  # at most 2**BITS cells, their parts, and one more for each splitter
        at = at if shard == shard_now else 0
        starts.append((shard, c, s, at))
        shard_now, at = shard, at + m
    most = max((m for *_, m in counts), default=0)
    return placed, rows_of(spark, f"shard int, {CELL} int, {SUB} int, {START} bigint", starts), repeated or most > MOST_EVEN * max(even, 16)


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002) -> DataFrame:
    """`docs` with size, text_crc32, law, shard, slot and grown_shard (null).

    tolerance: how far, as a share of an even shard, a splitter may lie from its
    place. Null texts have size 1; null doc_ids and repeated rows are rows like
    any other, and copies of one row may go to several shards. An empty table gives
    no rows. Columns of the caller with the names of results give way to them.

    slot numbers the rows of a shard from 0. The numbering takes no task over a
    whole shard: rows are numbered in cells of about 1/4096 of the table, heavier
    cells (copies of one text) in even parts by the other keys, and the cells'
    starts come from their exact counts.
    """
    full, keys = keyed(docs), [H1, H2]
    columns = [F.col(f"`{c}`") for c in full.columns if c not in (H1, H2)]
    placed, start, repeated = _placement(full, keys, shards, tolerance)
    if repeated:  # written, so that a row's number is the same wherever it is read
        full, keys = cut(full.withColumn(H3, F.xxhash64(F.monotonically_increasing_id()))), [H1, H2, H3]
        placed, start, _ = _placement(full, keys, shards, tolerance)
    own = Window.partitionBy("shard", CELL, SUB).orderBy(*keys, "doc_id")
    return (
        placed(full)
        .withColumn("slot", F.row_number().over(own).cast("bigint") - 1)
        .join(F.broadcast(start), ["shard", CELL, SUB], "left")
        .withColumn("slot", F.col("slot") + F.col(START))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*columns, "law", "shard", "slot", "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.002) -> None:
    """Writes the rows of each shard under its own folder. A shard has as many files as
    tasks had rows of it, each in slot order."""
    placed = shard_documents(docs, shards, tolerance)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
