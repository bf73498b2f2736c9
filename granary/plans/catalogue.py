"""Queries of the store's operators and, where it can be said in SQL, the SQL that must
give the same rows. Relations are those of granary.plans.relations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.config import CONTAINER_PAYLOAD, PRESETS, StoreConfig
from granary.functions import scalar
from granary.functions.shipping import ship
from granary.functions.compression import compressed_fp, zstd_compress, zstd_decompress
from granary.operators import chunking, dedup, layout, ordering, restore, retention, rewriting, segmenting, simulation, stats, upgrade
from granary.operators.ordering import dense_index
from granary.plans import relations as rel
from granary.plans.sql import base
from granary.sources import hashfile
from granary.sources.files import read_directory, read_file_list, read_trace, trace_lines, write_files, write_joined, write_trace
from granary.sources.scratch import cut, folder
from granary.sources.store import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RATIO, KEEP_FROM, FEATURES = 16, 2, 4
#: Chunks of a container where whole containers are to expire.
SMALL = 16
CAP_BUFFER, CAP_LEVEL = 64, 1
CFL_THRESHOLD, HAR_THRESHOLD, HAR_LIMIT = 0.01, 0.5, 0.4
CACHE, WINDOW = 4, 64
CDC = StoreConfig(chunk_avg_size=1024, chunk_min_size=256, chunk_max_size=8192)


def query(sql: str | None = None, size: int = 256, entries: int = 1169):
    """Registers a query; sql goes on after the shared relations."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = base(size, entries) + sql
        return f

    return add


# --- chunks and fingerprints ------------------------------------------------------


@query("SELECT file_id, chunk_no, CAST(size AS INTEGER) AS size, fp FROM chunk", size=1024)
def chunk_fixed(spark, sf):
    return chunking.fixed_chunks(rel.stream(spark, sf), 1024).select("file_id", "chunk_no", "size", scalar.sha1_fp(F.col("data")).alias("fp"))


@query("SELECT file_id, chunk_no, CAST(size AS INTEGER) AS size, fp FROM chunk", size=CONTAINER_PAYLOAD)
def chunk_file_level(spark, sf):
    return chunking.file_chunks(rel.stream(spark, sf)).select("file_id", "chunk_no", "size", scalar.sha1_fp(F.col("data")).alias("fp"))


def _cdc(name, algorithm):
    def run(spark, sf):
        from dataclasses import replace

        return chunking.content_chunks(rel.stream(spark, sf), replace(CDC, chunk_algorithm=algorithm))

    run.__name__ = name
    QUERIES[name] = run


def _rabin_sql(algorithm: str) -> str:
    """The content-defined cuts, file by file and cut by cut. What byte b adds to the low
    bits of the fingerprint k bytes later is entry 256 * k + b of a list."""
    least, most, avg, window = CDC.chunk_min_size, CDC.chunk_max_size, CDC.chunk_avg_size, chunking.WINDOW
    table = (chunking.rabin_tables() & np.uint64(2 * avg - 1)).ravel().tolist()
    # Lengths at which the window fills, and at which it is full, under a mask.
    filling = lambda mask: f"list_filter(list_transform(early, lambda f, j: CASE WHEN (f & {mask}) = {chunking.BREAK_MARK} AND {least} + j - 1 < stop - start THEN {least} + j - 1 ELSE -1 END), lambda x: x >= 0)"
    full = lambda mask: f"list_transform(list_filter(hits, lambda x: x[2] & {mask} = {chunking.BREAK_MARK} AND x[1] >= start + {least + window - 2} AND x[1] + 1 < stop), lambda x: x[1] + 1 - start)"
    found = lambda mask, low=0: f"list_filter(list_concat({filling(mask)}, {full(mask)}), lambda x: x >= {low})"
    main, small, large = avg - 1, 2 * avg - 1, avg // 2 - 1
    length = {
        "rabin": f"coalesce({found(main)}[1], stop - start)",
        "normalized rabin": f"CASE WHEN {found(small)}[1] < {avg} THEN {found(small)}[1] ELSE coalesce({found(large, max(avg, least))}[1], stop - start) END",
        "tttd": f"coalesce({found(main)}[1], {found(large)}[-1], stop - start)",
    }[algorithm]
    return f""", tab AS (SELECT {table} AS t),
byte AS (SELECT file_id, i - 1 AS p, CAST(('0x' || substr(h, 2 * i - 1, 2)) AS INTEGER) AS b FROM (SELECT file_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM stream)),
mark AS (SELECT file_id, p + k AS p, bit_xor(t[256 * k + b + 1]) AS f FROM byte, tab, (SELECT unnest(range({window})) AS k) GROUP BY 1, 2),
held AS (SELECT file_id, list([p, f] ORDER BY p) AS hits FROM mark WHERE f & {large} = {chunking.BREAK_MARK} GROUP BY 1),
file AS (SELECT file_id, version, h, length(h) // 2 AS n, coalesce(hits, []) AS hits FROM stream LEFT JOIN held USING (file_id) WHERE length(h) > 0),
cutting AS (SELECT file_id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, 0 AS chunk_no FROM file
  UNION ALL SELECT file_id, start + size, start + size, chunk_no + 1 FROM (
    SELECT file_id, start, chunk_no, CASE WHEN n - start <= {least} THEN n - start ELSE {length} END AS size FROM (
      SELECT c.file_id, c.start, c.chunk_no, f.n, f.hits, least(f.n, c.start + {most}) AS stop,
        list_transform(range(1, least({window - 1}, least(f.n, c.start + {most}) - c.start - {least - 1}) + 1), lambda j: list_reduce(list_transform(range(j), lambda k: tab.t[256 * k + CAST(('0x' || substr(f.h, 2 * (c.start + {least - 1} + j - 1 - k) + 1, 2)) AS INTEGER) + 1]), lambda x, y: xor(x, y))) AS early
      FROM cutting c JOIN file f USING (file_id), tab WHERE c.start < f.n))),
cdc AS (SELECT file_id, chunk_no - 1 AS chunk_no, lag(start) OVER (PARTITION BY file_id ORDER BY chunk_no) AS first, start AS past FROM cutting QUALIFY chunk_no > 0)
"""


def _ae_sql() -> str:
    """Asymmetric extremum: the place of the least key so far (the last of equal ones) is
    handed on from place to place until a cut is found."""
    window, most = int(CDC.chunk_avg_size / (chunking.E_ROUNDED - 1)), CDC.chunk_max_size
    key = "CAST(('0x' || substr(f.h, 2 * (c.start + i) + 1, 16)) AS UBIGINT)"
    step = f"CASE WHEN a.cut >= 0 THEN a WHEN x.low <= a.low THEN x WHEN x.place >= a.place + {window} OR x.place = {most} THEN {{'place': a.place, 'low': a.low, 'cut': x.place}} ELSE a END"
    scan = lambda n: f"list_reduce(list_transform(range(0, least(f.n - c.start - 8, {n}) + 1), lambda i: {{'place': i, 'low': {key}, 'cut': CAST(-1 AS BIGINT)}}), lambda a, x: {step})"
    return f""", file AS (SELECT file_id, version, h, length(h) // 2 AS n FROM stream WHERE length(h) > 0),
cutting AS (SELECT file_id, CAST(0 AS BIGINT) AS start, 0 AS chunk_no FROM file
  UNION ALL SELECT file_id, start + CASE WHEN n - start <= {window + 8} OR last.cut < 0 THEN n - start ELSE last.cut END, chunk_no + 1 FROM (
    SELECT c.file_id, c.start, c.chunk_no, f.n, CASE WHEN f.n - c.start <= {window + 8} THEN NULL WHEN near.cut >= 0 THEN near ELSE {scan(2 * most)} END AS last
    FROM (SELECT c.*, CASE WHEN f.n - c.start > {window + 8} THEN {scan(2 * window)} END AS near FROM cutting c JOIN file f USING (file_id) WHERE c.start < f.n) c JOIN file f USING (file_id)))
, cdc AS (SELECT file_id, chunk_no - 1 AS chunk_no, lag(start) OVER (PARTITION BY file_id ORDER BY chunk_no) AS first, start AS past FROM cutting QUALIFY chunk_no > 0)
"""


_CDC_ROWS = "SELECT file_id, version, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(past - first AS INTEGER) AS size, upper(sha1(unhex(substr(h, 2 * first + 1, 2 * (past - first))))) AS fp FROM cdc JOIN file USING (file_id)"
for _name, _algorithm in (("chunk_rabin", "rabin"), ("chunk_normalized", "normalized rabin"), ("chunk_tttd", "tttd"), ("chunk_ae", "ae")):
    _cdc(_name, _algorithm)
    ORACLES[_name] = base() + (_ae_sql() if _algorithm == "ae" else _rabin_sql(_algorithm)) + _CDC_ROWS


@query("SELECT file_id, upper(sha1(unhex(h))) AS fp FROM stream")
def fingerprint_sha1(spark, sf):
    return rel.stream(spark, sf).select("file_id", scalar.sha1_fp(F.col("data")).alias("fp"))


@query("SELECT file_id, upper(sha256(unhex(h))) AS fp FROM stream")
def fingerprint_sha256(spark, sf):
    return rel.stream(spark, sf).select("file_id", scalar.sha256_fp(F.col("data")).alias("fp"))


@query("SELECT file_id, min(file_id) OVER (PARTITION BY h) AS same_as FROM stream")
def fingerprint_compressed(spark, sf):
    """Fingerprints of compressed bytes tell the same files apart as the bytes do."""
    ship(spark)
    named = rel.stream(spark, sf).select("file_id", compressed_fp("data").alias("fp"))
    return named.join(named.groupBy("fp").agg(F.min("file_id").alias("same_as")), "fp").select("file_id", "same_as")


@query("SELECT file_id, h AS hex, true AS same FROM stream")
def hex_roundtrip(spark, sf):
    h = scalar.to_hex(F.col("data"))
    return rel.stream(spark, sf).select("file_id", h.alias("hex"), (scalar.from_hex(F.lower(h)) == F.col("data")).alias("same"))


@query("SELECT seq, ('0x' || substr(fp, 39, 2) || substr(fp, 37, 2) || substr(fp, 35, 2) || substr(fp, 33, 2))::UBIGINT % 128 = 0 AS hit FROM chunk")
def sampling_residue(spark, sf):
    return rel.chunks(spark, sf).select("seq", (scalar.residue(F.col("fp"), 128) == 0).alias("hit"))


@query("SELECT seq, CAST((CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END) AS BIGINT) AS prefix FROM (SELECT seq, CAST(('0x' || substr(fp, 15, 2) || substr(fp, 13, 2) || substr(fp, 11, 2) || substr(fp, 9, 2) || substr(fp, 7, 2) || substr(fp, 5, 2) || substr(fp, 3, 2) || substr(fp, 1, 2))::UBIGINT AS HUGEINT) AS v FROM chunk)")
def fingerprint_prefix(spark, sf):
    return rel.chunks(spark, sf).select("seq", scalar.fp_prefix(F.col("fp")).alias("prefix"))


@query("SELECT seq, regexp_full_match(x, '(00)+') AS is_zero FROM chunk")
def zero_chunks(spark, sf):
    return rel.chunks(spark, sf, data=True).select("seq", scalar.is_zero_chunk(F.col("data")).alias("is_zero"))


_BYTES = "list_transform(range(1, len(fp) // 2 + 1), lambda i: CAST(('0x' || substr(fp, 2 * i - 1, 2)) AS UBIGINT))"
_HASHES = {
    "rs": "list_reduce(list_prepend({'h': 0::UHUGEINT, 'a': 63689::UHUGEINT}, list_transform(b, lambda x: {'h': x::UHUGEINT, 'a': 0::UHUGEINT})), lambda s, x: {'h': (s.h * s.a + x.h) % 4294967296, 'a': s.a * 378551 % 4294967296}).h",
    "djb": "list_reduce(list_prepend(5381::UBIGINT, b), lambda h, x: (h * 33 + x) % 4294967296)",
    "fnv": "list_reduce(list_prepend(0::UBIGINT, b), lambda h, x: xor(CAST(h::UHUGEINT * 2166136261 % 4294967296 AS UBIGINT), x))",
    "js": "list_reduce(list_prepend(1315423911::UBIGINT, b), lambda h, x: xor(h, h * 32 + x + h // 4) % 4294967296)",
    "pjw": "list_reduce(list_prepend(0::UBIGINT, b), lambda h, x: CASE WHEN (h * 16 + x) % 4294967296 >= 268435456 THEN xor((h * 16 + x) % 4294967296, ((h * 16 + x) % 4294967296 // 268435456) * 16) % 268435456 ELSE (h * 16 + x) % 4294967296 END)",
    "sdbm": "list_reduce(list_prepend(0::UBIGINT, b), lambda h, x: (h * 65599 + x) % 4294967296)",
    "dek": "list_reduce(list_prepend(len(b)::UBIGINT, b), lambda h, x: xor((h * 32) % 4294967296 | (h // 134217728), x))",
}


@query(f", k AS (SELECT DISTINCT fp, {_BYTES} AS b FROM chunk) SELECT fp, " + ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in _HASHES.items()) + " FROM k")
def string_hashes(spark, sf):
    """The seven string hashes of a Bloom filter, of fingerprints."""
    ship(spark)
    return rel.chunks(spark, sf).select("fp").distinct().select("fp", scalar.string_hashes(tuple(scalar.STRING_HASHES), F.col("fp")).alias("h")).select("fp", "h.*")


@query(f", k AS (SELECT DISTINCT fp, {_BYTES} AS b FROM chunk WHERE version < {KEEP_FROM}), bit AS (SELECT DISTINCT unnest([" + ", ".join(f"CAST({_HASHES[h]} AS BIGINT) % 65536" for h in ("rs", "djb", "fnv", "js")) + "]) AS place FROM k) SELECT CAST(place // 64 AS INTEGER) AS word, CAST(bit_count(bit_or(CAST(1 AS UBIGINT) << CAST(place % 64 AS UBIGINT))) AS INTEGER) AS bits FROM bit GROUP BY 1")
def bloom_filter(spark, sf):
    """The bits that the fingerprints of old versions set in a Bloom filter, by word."""
    old = rel.chunks(spark, sf).where(F.col("version") < KEEP_FROM).select("fp").distinct()
    return scalar.bloom_words(F.col("fp"), old, 1 << 16).select("word", F.bit_count("mask").alias("bits"))


@query("SELECT seq, used + size > 65536 OR entries >= 100 AS overflows, fp AS simulated FROM (SELECT seq, size, fp, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS used, count(*) OVER w AS entries FROM stored WINDOW w AS (PARTITION BY urank // 128 ORDER BY urank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def overflow_and_simulated(spark, sf):
    """Whether a chunk would still fit behind those before it in a block of 128; and the
    fingerprint that a simulated upgrade gives it."""
    w = Window.partitionBy(F.floor(F.col("urank") / 128)).orderBy("urank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rel.placed(spark, sf)[1].withColumn("used", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("entries", F.count("*").over(w))
    return rows.select("seq", scalar.container_overflow(F.col("used"), F.col("entries"), F.col("size"), 100, 65536).alias("overflows"), scalar.simulated_fp(F.col("fp")).alias("simulated"))


@query("SELECT substr(fp, 1, 4) AS key, count(DISTINCT fp) AS fps FROM chunk GROUP BY 1 HAVING count(DISTINCT fp) > 1")
def truncated_keys(spark, sf):
    return rel.chunks(spark, sf).groupBy(scalar.truncated_key(F.col("fp"), 2).alias("key")).agg(F.count_distinct("fp").alias("fps")).where("fps > 1")


@query("SELECT file_id, (version << 48) | (length(h) // 2 << 16) | 7 AS key, CAST(version AS INTEGER) AS v, CAST(length(h) // 2 AS BIGINT) AS off, 7 AS n FROM stream")
def segment_key_pack(spark, sf):
    s = rel.stream(spark, sf).select("file_id", scalar.segment_key(F.col("version"), F.length("data"), F.lit(7)).alias("key")).withColumn("p", scalar.segment_parts(F.col("key")))
    return s.select("file_id", "key", F.col("p.version").alias("v"), F.col("p.offset").alias("off"), F.col("p.size").alias("n"))


@query("SELECT file_id, CAST(length(h) // 2 AS INTEGER) AS size, true AS same FROM stream")
def compress_roundtrip(spark, sf):
    ship(spark)
    packed = rel.stream(spark, sf).withColumn("z", zstd_compress("data"))
    return packed.select("file_id", F.length("data").alias("size"), (zstd_decompress("z", F.length("data")) == F.col("data")).alias("same"))


# --- exact deduplication ----------------------------------------------------------


@query("SELECT seq, fp, row_number() OVER (PARTITION BY fp ORDER BY seq) > 1 AS is_dup FROM chunk")
def dedup_exact(spark, sf):
    return dedup.mark_duplicates(rel.chunks(spark, sf)).select("seq", "fp", "is_dup")


@query("SELECT count(*) AS chunks, count(DISTINCT fp) AS unique_chunks, CAST(sum(size) AS BIGINT) AS bytes, CAST((SELECT sum(size) FROM stored) AS BIGINT) AS unique_bytes, round((sum(size) - (SELECT sum(size) FROM stored)) / CAST(sum(size) AS DOUBLE), 6) AS dedup_ratio FROM chunk", size=1024)
def dedup_ratio(spark, sf):
    chunks = chunking.fixed_chunks(rel.stream(spark, sf), 1024).select("size", scalar.sha1_fp(F.col("data")).alias("fp"))
    return dedup.totals(chunks)


@query("SELECT fp, seq, size FROM stored")
def first_occurrence(spark, sf):
    return dedup.stored_chunks(rel.chunks(spark, sf)).select("fp", "seq", F.col("size").cast("bigint").alias("size"))


@query("SELECT c.version, count(*) AS chunks, count(*) FILTER (s.v < c.version) AS known, CAST(sum(CASE WHEN s.v < c.version THEN size ELSE 0 END) AS BIGINT) AS known_bytes FROM chunk c JOIN (SELECT fp, min(version) AS v FROM chunk GROUP BY fp) s USING (fp) GROUP BY c.version")
def dedup_cross_version(spark, sf):
    chunks = rel.chunks(spark, sf)
    first = chunks.groupBy("fp").agg(F.min("version").alias("v"))
    old = F.col("v") < F.col("version")
    return chunks.join(first, "fp").groupBy("version").agg(F.count("*").alias("chunks"), F.count_if(old).alias("known"), F.sum(F.when(old, F.col("size")).otherwise(0)).alias("known_bytes"))


@query("SELECT c.seq, c.fp, c.seq > f.s OR k.fp IS NOT NULL AS is_dup FROM (SELECT * FROM chunk WHERE version = 2) c JOIN (SELECT fp, min(seq) AS s FROM chunk WHERE version = 2 GROUP BY fp) f USING (fp) LEFT JOIN (SELECT DISTINCT fp FROM chunk WHERE version < 2) k USING (fp)")
def dedup_against_index(spark, sf):
    chunks = rel.chunks(spark, sf)
    return dedup.mark_known(chunks.where("version = 2"), chunks.where("version < 2")).select("seq", "fp", "is_dup")


@query("SELECT count(*) AS files, count(DISTINCT h) AS distinct_files FROM stream")
def file_level_dedup(spark, sf):
    return rel.stream(spark, sf).agg(F.count("*").alias("files"), F.count_distinct("data").alias("distinct_files"))


@query("SELECT seq, segment_id, min(seq) OVER (PARTITION BY segment_id, fp) AS first_seq FROM seg")
def segment_self_references(spark, sf):
    return dedup.self_references(segmenting.fixed_segments(rel.chunks(spark, sf), rel.SEGMENT)).select("seq", "segment_id", "first_seq")


# --- segments and features --------------------------------------------------------


@query("SELECT seq, segment_id FROM seg")
def segment_fixed(spark, sf):
    return segmenting.fixed_segments(rel.chunks(spark, sf), rel.SEGMENT).select("seq", "segment_id")


@query("SELECT seq, file_id AS segment_id FROM chunk")
def segment_file(spark, sf):
    return segmenting.file_segments(rel.chunks(spark, sf)).select("seq", "segment_id")


_HIT = "('0x' || substr(fp, 39, 2) || substr(fp, 37, 2) || substr(fp, 35, 2) || substr(fp, 33, 2))::UBIGINT"
#: A walk: `step` has (version, at, following), `walk` the places that are reached from 0.
_WALK = """, walk AS (SELECT DISTINCT version, CAST(0 AS BIGINT) AS place FROM step UNION ALL SELECT walk.version, step.following FROM walk JOIN step ON step.version = walk.version AND step.place = walk.place WHERE step.following <= step.top)
"""
_CUTS = f""", marked AS (SELECT version, seq, seq - min(seq) OVER (PARTITION BY version) AS place, {_HIT} % 64 = 0 AS mark FROM chunk),
step AS (SELECT version, place, max(place) OVER (PARTITION BY version) AS top, least(place + 256, coalesce(min(CASE WHEN mark THEN place END) OVER (PARTITION BY version ORDER BY place ROWS BETWEEN 16 FOLLOWING AND UNBOUNDED FOLLOWING), place + 256)) AS following FROM marked)
{_WALK}"""


@query(_CUTS + "SELECT m.version, m.seq, count(walk.place) OVER (PARTITION BY m.version ORDER BY m.seq) - 1 AS segment_no FROM marked m LEFT JOIN walk USING (version, place)")
def segment_content_defined(spark, sf):
    return segmenting.content_segments(rel.chunks(spark, sf), 64, 16, 256).select("version", "seq", "segment_no")


def _segments(spark, sf):
    return segmenting.fixed_segments(rel.chunks(spark, sf), rel.SEGMENT)


@query(f"SELECT DISTINCT segment_id, fp AS feature FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY seq) - 1 AS k FROM seg) WHERE k % {RATIO} = 0")
def sample_uniform(spark, sf):
    return segmenting.sample_uniform(_segments(spark, sf), RATIO)


@query(f"SELECT DISTINCT segment_id, fp AS feature FROM seg WHERE {_HIT} % 128 = 0 UNION ALL SELECT segment_id, repeat('0', 40) FROM seg GROUP BY 1 HAVING count(*) FILTER ({_HIT} % 128 = 0) = 0")
def sample_random(spark, sf):
    return segmenting.sample_random(_segments(spark, sf), 128)


_RANKED = "(SELECT *, count(*) OVER (PARTITION BY segment_id) AS c, row_number() OVER (PARTITION BY segment_id ORDER BY fp, seq) AS r, coalesce(lag(fp, 8) OVER (PARTITION BY segment_id ORDER BY seq), first_value(fp) OVER (PARTITION BY segment_id ORDER BY seq)) AS before FROM seg)"
_MANY = "greatest(1, c // 32 + CASE WHEN c % 32 > 16 THEN 1 ELSE 0 END)"


@query(f"SELECT DISTINCT segment_id, fp AS feature FROM {_RANKED} WHERE r <= {_MANY}")
def sample_min(spark, sf):
    return segmenting.sample_min(_segments(spark, sf), 32)


@query(f"SELECT DISTINCT segment_id, before AS feature FROM {_RANKED} WHERE r <= {_MANY}")
def sample_optmin(spark, sf):
    return segmenting.sample_optimized_min(_segments(spark, sf), 32)


# --- index and similarity ---------------------------------------------------------

_SMALL = "(SELECT DISTINCT segment_id, fp AS feature FROM (SELECT segment_id, fp, count(*) OVER (PARTITION BY segment_id) AS c, row_number() OVER (PARTITION BY segment_id ORDER BY fp, seq) AS r FROM seg16) WHERE r <= greatest(1, c // 4 + CASE WHEN c % 4 > 2 THEN 1 ELSE 0 END))"
_SEG16 = ", seg16 AS (SELECT *, seq // 16 AS segment_id FROM chunk), feat AS (SELECT * FROM " + _SMALL + ")"
_PAIRS = _SEG16 + f""", pairs AS (SELECT a.segment_id, b.segment_id AS candidate, a.feature FROM
  (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY segment_id) AS k FROM feat) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY segment_id) AS k FROM feat) b
  ON a.feature = b.feature AND b.k < a.k AND b.k >= a.k - {FEATURES}),
cand AS (SELECT segment_id, candidate, count(*) AS shared FROM pairs GROUP BY 1, 2),
best AS (SELECT segment_id, candidate, shared FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY shared DESC, candidate DESC) AS r FROM cand) WHERE r = 1)
"""


def _small(spark, sf):
    """Chunks in segments of 16, and 4 features of each."""
    chunks = segmenting.fixed_segments(rel.chunks(spark, sf), 16)
    return chunks, segmenting.sample_min(chunks, 4)


@query(_SEG16 + f"SELECT feature, array_to_string(list(segment_id ORDER BY segment_id DESC)[1:{FEATURES}], ',') AS ids FROM feat GROUP BY feature")
def feature_index_last_n(spark, sf):
    return retention.feature_queue(_small(spark, sf)[1], FEATURES).select("feature", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(_PAIRS + "SELECT segment_id, candidate, shared FROM cand")
def similar_segments(spark, sf):
    return dedup.similar_segments(_small(spark, sf)[1], FEATURES)


@query(_PAIRS + "SELECT segment_id, candidate, shared FROM best")
def similar_segments_top1(spark, sf):
    return dedup.top_segment(dedup.similar_segments(_small(spark, sf)[1], FEATURES))


def _topk_sql(k: int) -> str:
    """Picks in turn: in each round the candidates left, by their features that no pick has."""
    parts, gone = [", taken0 AS (SELECT segment_id, candidate, feature FROM pairs WHERE false)"], "taken0"
    for r in range(1, k + 1):
        parts.append(f"""round{r} AS (SELECT segment_id, candidate, count(*) FILTER (feature NOT IN (SELECT t.feature FROM {gone} t WHERE t.segment_id = p.segment_id)) AS shared FROM pairs p
  WHERE candidate NOT IN (SELECT t.candidate FROM {gone} t WHERE t.segment_id = p.segment_id) GROUP BY 1, 2),
pick{r} AS (SELECT segment_id, {r} AS rank, candidate, shared FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY shared DESC, candidate DESC) AS n FROM round{r}) WHERE n = 1),
taken{r} AS (SELECT * FROM {gone} UNION ALL SELECT p.segment_id, p.candidate, p.feature FROM pairs p JOIN pick{r} USING (segment_id, candidate))""")
        gone = f"taken{r}"
    return ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT segment_id, rank, candidate, CAST(shared AS INTEGER) AS shared FROM pick{r}" for r in range(1, k + 1))


@query(_PAIRS + _topk_sql(3))
def similar_segments_topk(spark, sf):
    return dedup.top_k_segments(_small(spark, sf)[1], FEATURES, 3)


_NEAR = """, near AS (SELECT c.seq, c.segment_id, c.size, c.seq > min(c.seq) OVER (PARTITION BY c.segment_id, c.fp) OR h.fp IS NOT NULL AS is_dup FROM seg16 c
  LEFT JOIN (SELECT DISTINCT best.segment_id, seg16.fp FROM best JOIN seg16 ON seg16.segment_id = best.candidate) h ON h.segment_id = c.segment_id AND h.fp = c.fp)
"""


@query(_PAIRS + _NEAR + "SELECT seq, segment_id, is_dup FROM near")
def near_exact_dedup_top1(spark, sf):
    chunks, features = _small(spark, sf)
    chosen = dedup.top_segment(dedup.similar_segments(features, FEATURES))
    return dedup.near_exact(chunks, chosen).select("seq", "segment_id", "is_dup")


@query(_PAIRS + _NEAR + "SELECT near.seq, near.segment_id, is_dup OR coalesce(h.s < near.segment_id, false) AS is_dup FROM near JOIN chunk USING (seq) LEFT JOIN (SELECT feature, min(segment_id) AS s FROM feat GROUP BY 1) h ON h.feature = chunk.fp")
def near_exact_dedup_mix(spark, sf):
    chunks, features = _small(spark, sf)
    chosen = dedup.top_segment(dedup.similar_segments(features, FEATURES))
    return dedup.near_exact_mix(chunks, chosen, features).select("seq", "segment_id", "is_dup")


_SAMPLED = """, con AS (SELECT cid, fp, seq, urank % 1169 AS pos FROM stored),
hooked AS (SELECT DISTINCT seg.segment_id, con.cid FROM seg JOIN con USING (fp) WHERE con.pos % 16 = 0 AND con.seq < seg.seq),
known AS (SELECT segment_id, fp, min(con.seq) AS s FROM hooked JOIN con USING (cid) GROUP BY 1, 2)
SELECT seg.seq, seg.segment_id, seg.seq > min(seg.seq) OVER (PARTITION BY seg.segment_id, seg.fp) OR coalesce(known.s < seg.seq, false) AS is_dup
FROM seg LEFT JOIN known ON known.segment_id = seg.segment_id AND known.fp = seg.fp
"""


@query(_SAMPLED)
def sampled_index_dedup(spark, sf):
    rows, stored = rel.placed(spark, sf)
    held = stored.withColumn("pos", F.col("urank") % rel.OLD_ENTRIES)
    return dedup.sampled_index(segmenting.fixed_segments(rows, rel.SEGMENT), held, RATIO).select("seq", "segment_id", "is_dup")


def _preset_sql(x: str, chunks: str, features: str, top: bool) -> str:
    """near_{x}: chunks and unique chunks of a similarity index over segments of its own."""
    chosen = f"(SELECT segment_id, candidate FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY shared DESC, candidate DESC) AS r FROM cand_{x}) WHERE r = 1)" if top else f"cand_{x}"
    return f""", seg_{x} AS ({chunks}), feat_{x} AS ({features}),
turn_{x} AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY segment_id) AS k FROM feat_{x}),
cand_{x} AS (SELECT a.segment_id, b.segment_id AS candidate, count(*) AS shared FROM turn_{x} a JOIN turn_{x} b ON a.feature = b.feature AND b.k < a.k AND b.k >= a.k - {FEATURES} GROUP BY 1, 2),
near_{x} AS (SELECT count(*) AS chunks, count(*) FILTER (c.seq = c.f AND h.fp IS NULL) AS unique_chunks FROM (SELECT *, min(seq) OVER (PARTITION BY segment_id, fp) AS f FROM seg_{x}) c
  LEFT JOIN (SELECT DISTINCT p.segment_id, s.fp FROM {chosen} p JOIN seg_{x} s ON s.segment_id = p.candidate) h ON h.segment_id = c.segment_id AND h.fp = c.fp)
"""


_PRESETS = (
    _CUTS
    + _preset_sql("sparse", "SELECT m.seq, m.version * 1099511627776 + count(walk.place) OVER (PARTITION BY m.version ORDER BY m.seq) - 1 AS segment_id, chunk.fp FROM marked m JOIN chunk USING (seq) LEFT JOIN walk ON walk.version = m.version AND walk.place = m.place", f"SELECT DISTINCT segment_id, fp AS feature FROM seg_sparse WHERE {_HIT} % 8 = 0 UNION ALL SELECT segment_id, repeat('0', 40) FROM seg_sparse GROUP BY 1 HAVING count(*) FILTER ({_HIT} % 8 = 0) = 0", True)
    + _preset_sql("silo", "SELECT seq, seq // 16 AS segment_id, fp FROM chunk", "SELECT segment_id, min(fp) AS feature FROM seg_silo GROUP BY 1", True)
    + _preset_sql("bins", "SELECT seq, version * 1099511627776 + file_id AS segment_id, fp FROM chunk", "SELECT segment_id, min(fp) AS feature FROM seg_bins GROUP BY 1", False)
    + _SAMPLED.replace("\nSELECT seg.seq", "\n, sampled AS (SELECT seg.seq").rstrip() + ")"
    + """
SELECT unnest(['ddfs', 'block locality caching']) AS preset, count(*) AS chunks, count(DISTINCT fp) AS unique_chunks FROM chunk
UNION ALL SELECT 'sampled index', count(*), count(*) FILTER (NOT is_dup) FROM sampled
UNION ALL SELECT 'sparse index', * FROM near_sparse UNION ALL SELECT 'silo', * FROM near_silo UNION ALL SELECT 'extreme binning', * FROM near_bins
"""
)


@query(_PRESETS)
def index_presets(spark, sf):
    """What each index design finds on the same stream: (preset, chunks, unique_chunks)."""
    rows, stored = rel.placed(spark, sf)
    out = None
    for name, settings in PRESETS.items():
        c = StoreConfig(index_preset=name).resolved()
        if c.index_category == "exact":
            marked = dedup.mark_duplicates(rows)
        elif c.index_locality == "physical":
            held = stored.withColumn("pos", F.col("urank") % rel.OLD_ENTRIES)
            marked = dedup.sampled_index(segmenting.fixed_segments(rows, rel.SEGMENT), held, 16)
        else:
            if settings["segment_algorithm"] == "content-defined":
                cut = segmenting.content_segments(rows, 64, 16, 256).withColumn("segment_id", F.col("version") * (1 << 40) + F.col("segment_no"))
            elif settings["segment_algorithm"] == "file-defined":
                cut = segmenting.file_segments(rows).withColumn("segment_id", F.col("version") * (1 << 40) + F.col("file_id"))
            else:
                cut = segmenting.fixed_segments(rows, 16)
            features = segmenting.sample_random(cut, 8) if settings["sampling_method"] == "random" else segmenting.sample_min(cut, settings["sampling_ratio"])
            chosen = dedup.similar_segments(features, FEATURES)
            if settings["segment_top_k" if "segment_top_k" in settings else "segment_selection"] in (1, "top"):
                chosen = dedup.top_segment(chosen)
            marked = dedup.near_exact(cut, chosen)
        one = marked.agg(F.count("*").alias("chunks"), F.count_if(~F.col("is_dup")).alias("unique_chunks")).select(F.lit(name).alias("preset"), "chunks", "unique_chunks")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS entries, count(*) * (20 + 8 * 4 + 4) AS bytes FROM stored")
def index_footprint(spark, sf):
    return retention.index_footprint(dedup.stored_chunks(rel.chunks(spark, sf)), 20, FEATURES)


@query(_SEG16 + f"SELECT feature, array_to_string(list(segment_id ORDER BY segment_id DESC)[1:{FEATURES}], ',') AS ids FROM feat GROUP BY feature")
def index_upsert(spark, sf):
    features = _small(spark, sf)[1]
    half = features.agg(F.max("segment_id") / 2).first()[0]
    old = retention.feature_queue(features.where(F.col("segment_id") < half), FEATURES)
    return retention.upsert(old, features.where(F.col("segment_id") >= half), FEATURES).select("feature", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_GONE = f", gone AS (SELECT segment_id FROM seg16 GROUP BY 1 HAVING max(version) < {KEEP_FROM})"


@query(_SEG16 + _GONE + f", q AS (SELECT feature, unnest(list(segment_id ORDER BY segment_id DESC)[1:{FEATURES}]) AS id FROM feat GROUP BY feature) SELECT feature, array_to_string(list(id ORDER BY id DESC), ',') AS ids FROM q WHERE id NOT IN (SELECT segment_id FROM gone) GROUP BY feature")
def index_delete_id(spark, sf):
    """The index without the segments of expired versions."""
    chunks, features = _small(spark, sf)
    gone = chunks.groupBy("segment_id").agg(F.max("version").alias("v")).where(F.col("v") < KEEP_FROM).select("segment_id")
    return retention.delete_id(retention.feature_queue(features, FEATURES), gone).select("feature", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# --- containers and recipes -------------------------------------------------------


@query("SELECT fp, urank, cid FROM stored")
def pack_containers(spark, sf):
    return rel.placed(spark, sf)[1].select("fp", "urank", "cid")


@query("SELECT cid, count(*) AS chunk_num, CAST(sum(size) AS BIGINT) AS data_size FROM stored GROUP BY cid")
def container_meta(spark, sf):
    return layout.containers(rel.placed(spark, sf)[1])


@query("SELECT fp, urank // 1169 AS cid, CAST(urank % 1169 AS INTEGER) AS pos FROM stored")
def pack_next_fit(spark, sf):
    """The packing scan, where the entry limit is all that binds."""
    ranked = layout.rank_uniques(rel.chunks(spark, sf))
    return layout.pack_next_fit(ranked, rel.OLD_ENTRIES).select("fp", "cid", "pos")


_PACKED = """, ranked AS (SELECT fp, size, urank AS place, sum(size) OVER (ORDER BY urank) - size AS before FROM stored),
ends AS (SELECT place, before FROM ranked UNION ALL SELECT max(place) + 1, max(before + size) FROM ranked),
step AS (SELECT 0 AS version, place, (SELECT max(place) FROM ranked) AS top, greatest(place + 1, least(place + 1169, max(place) OVER (ORDER BY before RANGE BETWEEN UNBOUNDED PRECEDING AND 65536 FOLLOWING))) AS following FROM ends)
""" + _WALK


@query(_PACKED + "SELECT r.fp, CAST(r.size AS INTEGER) AS size, count(walk.place) OVER (ORDER BY r.place) - 1 AS cid, CAST(r.place - max(walk.place) OVER (ORDER BY r.place) AS INTEGER) AS pos FROM ranked r LEFT JOIN walk USING (place)", size=CONTAINER_PAYLOAD)
def pack_whole_files(spark, sf):
    """Next-fit where bytes bind: each distinct file is one chunk."""
    files = chunking.file_chunks(rel.stream(spark, sf)).withColumn("fp", scalar.sha1_fp(F.col("data"))).drop("data")
    numbered = ordering.dense_index(files, ["version", "file_id", "chunk_no"], "seq")
    return layout.pack_next_fit(dedup.stored_chunks(numbered), rel.OLD_ENTRIES, 65536).select("fp", "size", "cid", "pos")


_VARIABLE = """, parts AS (SELECT fp, size, row_number() OVER (ORDER BY version, file_id, chunk_no) AS seq FROM (""" + _CDC_ROWS + """)),
vstored AS (SELECT fp, size, row_number() OVER (ORDER BY seq) - 1 AS urank FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY seq) AS k FROM parts) WHERE k = 1)
""" + _PACKED.replace("FROM stored", "FROM vstored")


@query(_rabin_sql("rabin") + _VARIABLE + "SELECT r.fp, CAST(r.size AS INTEGER) AS size, count(walk.place) OVER (ORDER BY r.place) - 1 AS cid, CAST(r.place - max(walk.place) OVER (ORDER BY r.place) AS INTEGER) AS pos FROM ranked r LEFT JOIN walk USING (place)")
def pack_variable_chunks(spark, sf):
    chunks = chunking.content_chunks(rel.stream(spark, sf), CDC)
    numbered = ordering.dense_index(chunks, ["version", "file_id", "chunk_no"], "seq")
    return layout.pack_next_fit(dedup.stored_chunks(numbered), rel.OLD_ENTRIES, 65536).select("fp", "size", "cid", "pos")


@query("SELECT version, file_id, chunk_no, seq, fp, cid, CAST(size AS INTEGER) AS size FROM recipe")
def chunk_recipe(spark, sf):
    return rel.recipe(spark, sf)[0].select("version", "file_id", "chunk_no", "seq", "fp", "cid", "size")


@query("SELECT version, file_id, count(*) AS chunk_num, CAST(sum(size) AS BIGINT) AS file_size FROM recipe GROUP BY 1, 2")
def file_recipe(spark, sf):
    return layout.file_recipes(rel.recipe(spark, sf)[0])


@query("SELECT version, file_id, chunk_no, cid FROM recipe WHERE version = 1 AND pos BETWEEN 100 AND 299")
def recipe_slice(spark, sf):
    return rel.recipe(spark, sf)[0].where("version = 1 AND pos BETWEEN 100 AND 299").select("version", "file_id", "chunk_no", "cid")


@query("SELECT cid, fp, CAST(size AS INTEGER) AS size FROM stored WHERE cid IN (0, 2)")
def container_point_read(spark, sf):
    return rel.placed(spark, sf)[1].where(F.col("cid").isin(0, 2)).select("cid", "fp", "size")


@query("SELECT segment_id, fp, min(size) AS size FROM seg WHERE segment_id BETWEEN 3 AND 5 GROUP BY 1, 2")
def segment_prefetch(spark, sf):
    """A segment's recipe and those of the two that follow."""
    return _segments(spark, sf).where("segment_id BETWEEN 3 AND 5").groupBy("segment_id", "fp").agg(F.min("size").cast("bigint").alias("size"))


@query("SELECT version, seq, cid FROM (SELECT *, lag(cid) OVER (PARTITION BY version ORDER BY seq) AS l FROM recipe) WHERE cid IS DISTINCT FROM l")
def access_records(spark, sf):
    return layout.access_records(rel.recipe(spark, sf)[0])


@query("SELECT version, cid, CAST(sum(size) AS BIGINT) AS size FROM recipe GROUP BY 1, 2")
def container_utilization(spark, sf):
    return layout.container_utilization(rel.recipe(spark, sf)[0])


@query("SELECT file_id AS line_no, 'file start ' || length('/doc' || file_id) || chr(10) || '/doc' || file_id || chr(10) || string_agg(fp || ' ' || size, chr(10) ORDER BY chunk_no) || chr(10) || 'file end' AS value FROM chunk GROUP BY file_id UNION ALL SELECT 9223372036854775807, 'stream end'", size=1024)
def trace_text(spark, sf):
    """The text trace of the documents."""
    c = rel.chunks(spark, sf, 1024).withColumn("file_name", F.concat(F.lit("/doc"), F.col("file_id").cast("string")))
    return trace_lines(c.select("file_id", "file_name", "chunk_no", "fp", "size"))


# --- rewriting --------------------------------------------------------------------

_CAP = f""", w AS (SELECT *, pos // {CAP_BUFFER} AS win FROM recipe),
top AS (SELECT version, win, cid FROM (SELECT version, win, cid, row_number() OVER (PARTITION BY version, win ORDER BY sum(size) DESC, cid) AS r FROM w WHERE is_dup GROUP BY 1, 2, 3) WHERE r <= {CAP_LEVEL}),
cap AS (SELECT w.version, w.seq, w.fp, w.cid, w.size, w.is_dup, w.is_dup AND top.cid IS NULL AS out_of_order FROM w LEFT JOIN top ON w.version = top.version AND w.win = top.win AND w.cid = top.cid)
"""


def _capped(spark, sf):
    return rewriting.capping(rel.recipe(spark, sf)[0], CAP_BUFFER, CAP_LEVEL)


@query(_CAP + "SELECT version, seq, out_of_order FROM cap")
def capping_rewrite(spark, sf):
    return _capped(spark, sf).select("version", "seq", "out_of_order")


@query(f""", m AS (SELECT *, CASE WHEN is_dup THEN cid ELSE -1 END AS c FROM recipe),
n AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY version ORDER BY seq) THEN 1 ELSE 0 END AS b FROM m),
r AS (SELECT *, sum(b) OVER (PARTITION BY version ORDER BY seq) AS run FROM n)
SELECT version, seq, is_dup AND sum(size) OVER (PARTITION BY version, run) < {CFL_THRESHOLD * 1169 * 256} AS out_of_order FROM r""")
def cfl_rewrite(spark, sf):
    return rewriting.cfl_selective(rel.recipe(spark, sf)[0], CFL_THRESHOLD, rel.PAYLOAD).select("version", "seq", "out_of_order")


_HAR = f""", u AS (SELECT version, cid, sum(size) AS size FROM recipe GROUP BY 1, 2),
sparse AS (SELECT version, cid, CAST(size AS BIGINT) AS size FROM (SELECT u.*, sum(size) OVER (PARTITION BY version ORDER BY size, cid) AS upto FROM u WHERE size / {1169 * 256}.0 < {HAR_THRESHOLD}) x
  JOIN (SELECT version, sum(size) AS total FROM u GROUP BY 1) t USING (version) WHERE CAST(upto AS DOUBLE) / CAST(total AS DOUBLE) <= {HAR_LIMIT})
"""


def _sparse(recipe):
    return rewriting.har_sparse(layout.container_utilization(recipe), HAR_THRESHOLD, HAR_LIMIT, rel.PAYLOAD)


@query(_HAR + "SELECT version, cid, size FROM sparse")
def har_sparse(spark, sf):
    return _sparse(rel.recipe(spark, sf)[0])


@query(_HAR + "SELECT r.version, r.seq, r.is_dup AND s.cid IS NOT NULL AS is_sparse FROM recipe r LEFT JOIN sparse s ON s.version + 1 = r.version AND s.cid = r.cid")
def har_mark(spark, sf):
    recipe = rel.recipe(spark, sf)[0]
    return rewriting.har_mark(recipe, _sparse(recipe)).select("version", "seq", "is_sparse")


@query(_HAR + "SELECT a.version, count(*) AS inherited FROM sparse a JOIN sparse b ON a.version = b.version + 1 AND a.cid = b.cid GROUP BY 1")
def har_inherited(spark, sf):
    return rewriting.inherited_sparse(_sparse(rel.recipe(spark, sf)[0]))


_DECIDED = _CAP + """, den AS (SELECT cap.*, coalesce(seq > f, false) AS denied FROM cap LEFT JOIN (SELECT fp, min(seq) AS f FROM cap WHERE out_of_order GROUP BY fp) USING (fp)),
decided AS (SELECT *, NOT is_dup OR (NOT denied AND out_of_order) AS written FROM den)
"""


def _decided(spark, sf):
    denied = rewriting.deny_repeats(_capped(spark, sf))
    no = F.lit(False)
    return denied.withColumn("written", rewriting.write_decision(F.col("is_dup"), F.col("denied"), no, F.col("out_of_order"), no, F.lit(True)))


@query(_DECIDED + "SELECT version, seq, denied, written FROM decided")
def write_decision(spark, sf):
    return _decided(spark, sf).select("version", "seq", "denied", "written")


_UNION = _DECIDED + _SEG16 + """SELECT feature AS fp FROM feat UNION SELECT fp FROM decided WHERE NOT is_dup UNION SELECT fp FROM decided WHERE is_dup AND written"""


@query(_UNION)
def index_update_union(spark, sf):
    """What an update adds to the index: the sampled features of all segments, all unique
    fingerprints and those of all rewritten chunks, once each."""
    decided = _decided(spark, sf)
    written = decided.where("written").select("fp")  # unique or rewritten
    return _small(spark, sf)[1].select(F.col("feature").alias("fp")).unionByName(written).distinct()


@query(_DECIDED + _SEG16 + "SELECT kind, count(DISTINCT fp) AS fps FROM (SELECT 'feature' AS kind, feature AS fp FROM feat UNION ALL SELECT 'unique', fp FROM decided WHERE NOT is_dup UNION ALL SELECT 'rewritten', fp FROM decided WHERE is_dup AND written) GROUP BY 1")
def index_update_parts(spark, sf):
    """How many fingerprints each part of the update has."""
    decided = _decided(spark, sf)
    parts = decided.where("written").select(F.when(F.col("is_dup"), "rewritten").otherwise("unique").alias("kind"), "fp")
    every = parts.unionByName(_small(spark, sf)[1].select(F.lit("feature").alias("kind"), F.col("feature").alias("fp")))
    return every.groupBy("kind").agg(F.count_distinct("fp").alias("fps"))


#: Duplicates one after another: `useful` are containers that were found useful enough, `steps`
#: the utilities so far that the threshold can be about.
_CONTEXT = f""", judged AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY seq) AS i FROM (
  SELECT version, seq, cid, pos, greatest(0.0, 1 - (sum(size) OVER (PARTITION BY version, cid ORDER BY seq RANGE BETWEEN CURRENT ROW AND {CAP_BUFFER - 1} FOLLOWING) + size) / {1169 * 256}.0) AS u,
    coalesce(seq - lag(seq) OVER (PARTITION BY version, cid ORDER BY seq) < {CAP_BUFFER}, false) AS held FROM recipe WHERE is_dup)
  JOIN (SELECT version, max(seq) AS last FROM recipe GROUP BY 1) USING (version) WHERE seq + {CAP_BUFFER - 1} <= last),
cbr AS (SELECT DISTINCT version, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, false AS rewritten, CAST([] AS INTEGER[]) AS steps, CAST([] AS BIGINT[]) AS useful FROM judged
  UNION ALL SELECT version, i, seq, rewritten, CASE WHEN NOT flagged AND floor(u * 10000) >= 7000 THEN list_append(steps, CAST(least(floor(u * 10000), 9999) AS INTEGER)) ELSE steps END,
    CASE WHEN rewritten THEN list_filter(useful, lambda x: x <> cid) ELSE list_append(list_filter(useful, lambda x: x <> cid), cid) END FROM (
    SELECT *, NOT flagged AND u >= 0.7 AND u >= threshold AS rewritten FROM (
      SELECT c.version, j.i, j.seq, j.cid, j.u, c.steps, c.useful, j.held AND list_contains(c.useful, j.cid) AS flagged,
        CASE WHEN j.pos < 100 THEN 0.7 ELSE (coalesce(list_reverse_sort(c.steps)[CAST(floor(j.pos * 0.05) AS BIGINT)], 6999) + 1) / 10000 END AS threshold
      FROM cbr c JOIN judged j ON j.version = c.version AND j.i = c.i + 1)))
"""


@query(_CONTEXT + "SELECT r.version, r.seq, coalesce(c.rewritten, false) AS out_of_order FROM recipe r LEFT JOIN cbr c ON c.version = r.version AND c.seq = r.seq")
def cbr_rewrite(spark, sf):
    return rewriting.cbr(rel.recipe(spark, sf)[0], CAP_BUFFER, 0.7, 0.05, rel.PAYLOAD)


def _lru_sql(rows: str) -> str:
    """lru has, for each access of `rows` (version, seq, cid), whether an LRU cache of
    CACHE containers holds it: fewer others were used since it was last."""
    return f""", acc AS (SELECT *, lag(seq) OVER (PARTITION BY version, cid ORDER BY seq) AS prev FROM {rows}),
others AS (SELECT a.version, a.seq, a.prev, c.cid FROM acc a JOIN (SELECT DISTINCT version, cid FROM acc) c ON c.version = a.version AND c.cid <> a.cid WHERE a.prev IS NOT NULL),
since AS (SELECT o.version, o.seq, count(*) FILTER (b.seq > o.prev) AS n FROM others o ASOF LEFT JOIN acc b ON b.version = o.version AND b.cid = o.cid AND o.seq > b.seq GROUP BY 1, 2),
lru AS (SELECT acc.*, acc.prev IS NOT NULL AND coalesce(since.n, 0) < {CACHE} AS hit FROM acc LEFT JOIN since USING (version, seq))
"""


_LRU = _lru_sql("recipe")
_LEVEL = _LRU + f""", level AS (SELECT version, seq, coalesce(ceil(sum(size + 28) OVER w / {1169 * 256}.0) / nullif(sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w, 0), 0.0) AS cfl FROM lru WINDOW w AS (PARTITION BY version ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(_LEVEL + "SELECT version, seq, CAST(cfl AS DOUBLE) AS cfl, coalesce(last_value(CASE WHEN cfl < 0.6 THEN true WHEN cfl > 0.6 THEN false END IGNORE NULLS) OVER (PARTITION BY version ORDER BY seq), false) AS enabled FROM level")
def cfl_switch(spark, sf):
    return rewriting.cfl_switch(rel.recipe(spark, sf)[0], 0.6, CACHE, rel.PAYLOAD)


@query(_lru_sql("(SELECT * FROM recipe WHERE is_dup)") + "SELECT r.version, count(*) AS lookups, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT coalesce(hit, false)) AS kv_lookups, count(*) FILTER (r.is_dup AND NOT hit) AS kv_hits, count(*) FILTER (NOT r.is_dup) AS unique_lookups FROM recipe r LEFT JOIN lru ON lru.version = r.version AND lru.seq = r.seq GROUP BY 1")
def index_overhead(spark, sf):
    return simulation.index_overhead(rel.recipe(spark, sf)[0], CACHE)


# --- restore ----------------------------------------------------------------------


@query("SELECT r.version, r.file_id, r.chunk_no, s.x AS data FROM recipe r JOIN stored s ON r.cid = s.cid AND r.fp = s.fp")
def restore_join(spark, sf):
    return restore.restore_chunks(*rel.whole(spark, sf)).select("version", "file_id", "chunk_no", F.hex("data").alias("data"))


@query("SELECT version, file_id, upper(sha256(unhex(h))) AS digest FROM stream WHERE length(h) > 0")
def restore_files(spark, sf):
    whole = restore.restore_files(*rel.whole(spark, sf))
    return whole.select("version", "file_id", scalar.sha256_fp(F.col("data")).alias("digest"))


@query("SELECT 'lost' AS side, CAST(0 AS BIGINT) AS files WHERE false")
def restore_roundtrip_diff(spark, sf):
    whole = restore.restore_files(*rel.whole(spark, sf))
    return restore.round_trip_difference(rel.stream(spark, sf).where(F.length("data") > 0), whole)


def _restore(name, policy):
    def run(spark, sf):
        return simulation.restore_cost(rel.recipe(spark, sf)[0], policy, CACHE, WINDOW, rel.PAYLOAD)

    run.__name__ = name
    QUERIES[name] = run


for _name, _policy in (("restore_lru", "lru"), ("restore_opt", "opt"), ("restore_asm", "asm")):
    _restore(_name, _policy)
_REPLAYED = "SELECT version, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, any_value(n) AS container_reads, round(sum(size) / 1048576.0 / any_value(n), 6) AS speed_factor FROM recipe JOIN (SELECT version, max(reads) AS n FROM {0} GROUP BY 1) USING (version) GROUP BY 1"
#: Forward assembly, read by read: the queue goes from the front f to e; a chunk is ready if
#: its container was read while it was in the queue.
_ASSEMBLED = f""", all_ AS (SELECT version, list(cid ORDER BY seq) AS cids, list(upto ORDER BY seq) AS upto FROM (SELECT *, sum(size) OVER (PARTITION BY version ORDER BY seq) AS upto FROM recipe) GROUP BY 1),
asm AS (SELECT version, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS e, CAST([] AS STRUCT(cid BIGINT, e BIGINT)[]) AS done, 0 AS reads FROM all_
  UNION ALL SELECT version, coalesce(list_filter(range(f, e2), lambda j: len(list_filter(done2, lambda r: r.cid = cids[j + 1] AND r.e > j)) = 0)[1], e2), e2, done2, reads + 1 FROM (
    SELECT version, f, e2, cids, reads, list_append(done, {{'cid': cids[f + 1], 'e': e2}}) AS done2 FROM (
      SELECT q.*, a.cids, least(len(a.cids), greatest(q.e + 1, coalesce(list_filter(range(q.f, len(a.cids)), lambda i: a.upto[i + 1] - CASE WHEN q.f = 0 THEN 0 ELSE a.upto[q.f] END >= {(CACHE - 1) * 1169 * 256})[1] + 1, len(a.cids)))) AS e2
      FROM asm q JOIN all_ a USING (version) WHERE q.f < len(a.cids))))
"""
#: Belady, use by use: the container whose next known use is farthest goes, of several the one
#: used longest ago. Uses up to `known` are seen; half a window before that, it moves on.
_BELADY = f""", used AS (SELECT version, list(cid ORDER BY seq) AS cids FROM (SELECT *, lag(cid) OVER (PARTITION BY version ORDER BY seq) AS l FROM recipe) WHERE cid IS DISTINCT FROM l GROUP BY 1),
opt AS (SELECT version, CAST(-1 AS BIGINT) AS i, CAST([] AS STRUCT(cid BIGINT, age BIGINT)[]) AS held, CAST(least({WINDOW}, len(cids)) AS BIGINT) AS known, 0 AS reads FROM used
  UNION ALL SELECT version, i, list_append(list_filter(held, lambda h: h.cid <> c AND (hit OR len(held) < {CACHE} OR h.cid <> gone)), {{'cid': c, 'age': i}}), known, reads + CASE WHEN hit THEN 0 ELSE 1 END FROM (
    SELECT version, i, held, known, reads, c, len(list_filter(held, lambda h: h.cid = c)) > 0 AS hit,
      list_sort(list_transform(held, lambda h: [-coalesce(list_filter(range(i + 1, known), lambda p: cids[p + 1] = h.cid)[1], 1000000000), h.age, h.cid]))[1][3] AS gone FROM (
      SELECT o.version, o.i + 1 AS i, o.held, o.reads, u.cids, u.cids[o.i + 2] AS c, CAST(CASE WHEN (o.known - o.i - 1) * 2 <= {WINDOW} THEN least(len(u.cids), o.i + 1 + {WINDOW}) ELSE o.known END AS BIGINT) AS known
      FROM opt o JOIN used u USING (version) WHERE o.i + 1 < len(u.cids))))
"""
ORACLES["restore_asm"] = base() + _ASSEMBLED + _REPLAYED.format("asm")
ORACLES["restore_opt"] = base() + _BELADY + _REPLAYED.format("opt")
ORACLES["restore_lru"] = base() + _LRU + "SELECT version, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (NOT hit) AS container_reads, round(sum(size) / 1048576.0 / count(*) FILTER (NOT hit), 6) AS speed_factor FROM lru GROUP BY 1"


@query(_LRU + f"SELECT version, CAST(ceil(sum(size + 28) / {1169 * 256}.0) AS BIGINT) AS ocf, count(*) FILTER (NOT hit) AS ccf, round(ceil(sum(size + 28) / {1169 * 256}.0) / count(*) FILTER (NOT hit), 6) AS cfl FROM lru GROUP BY 1")
def cfl_monitor(spark, sf):
    return simulation.cfl(rel.recipe(spark, sf)[0], CACHE, rel.PAYLOAD)


# --- upgrade ----------------------------------------------------------------------

_MAP = ", fp_map AS (SELECT cid AS old_cid, fp AS old_fp, upper(sha256(unhex(x))) AS new_fp, new_cid FROM stored)"
_UPGRADED = _MAP + " SELECT r.version, r.file_id, r.chunk_no, m.new_fp, m.new_cid FROM recipe r JOIN fp_map m ON m.old_cid = r.cid AND m.old_fp = r.fp"


def _map(entries):
    return upgrade.fingerprint_map(entries, rel.NEW_ENTRIES)


@query(_MAP + " SELECT old_cid, old_fp, new_fp, new_cid FROM fp_map")
def fp_map(spark, sf):
    return _map(rel.entries(spark, sf))


@query(_UPGRADED)
def upgrade_pfu(spark, sf):
    recipe, entries = rel.whole(spark, sf)
    return upgrade.upgrade_by_fingerprint(recipe, _map(entries)).select("version", "file_id", "chunk_no", "new_fp", "new_cid")


@query(_UPGRADED)
def upgrade_conpfu(spark, sf):
    recipe, entries = rel.whole(spark, sf)
    return upgrade.upgrade_by_container(recipe, _map(entries)).select("version", "file_id", "chunk_no", "new_fp", "new_cid")


@query(_UPGRADED)
def upgrade_lfu(spark, sf):
    """Every logical chunk is fetched, hashed anew and deduplicated again."""
    data = restore.restore_chunks(*rel.whole(spark, sf)).withColumn("new_fp", scalar.sha256_fp(F.col("data"))).drop("data")
    again = cut(data.select("version", "file_id", "chunk_no", "seq", "size", F.col("new_fp").alias("fp")))  # else the bytes are fetched for each use
    where = layout.pack_by_rank(layout.rank_uniques(again), rel.NEW_ENTRIES, "new_cid").select("fp", "new_cid")
    return again.join(where, "fp").select("version", "file_id", "chunk_no", F.col("fp").alias("new_fp"), "new_cid")


_COPIES = _DECIDED + """, copy AS (SELECT fp, 0 AS n, seq FROM stored UNION ALL SELECT fp, 1, seq FROM decided WHERE is_dup AND written),
cc AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1169 AS c2, (row_number() OVER (ORDER BY seq) - 1) // 818 AS n2 FROM copy),
last AS (SELECT fp, max(c2) AS c2 FROM cc GROUP BY fp)
SELECT old.fp AS old_fp, old.c2 AS old_cid, old.n2 AS by_container, l.n2 AS by_fingerprint FROM cc old JOIN cc l ON l.fp = old.fp JOIN last ON last.fp = l.fp AND last.c2 = l.c2
"""


@query(_COPIES)
def upgrade_modes_differ(spark, sf):
    """With rewriting, a chunk lies in two containers: the map keyed by container tells
    its copies apart, the one keyed by fingerprint does not."""
    decided = _decided(spark, sf)
    copies = decided.where("written").select("fp", "seq")
    ranked = ordering.dense_index(copies, ["seq"], "rank")
    held = ranked.select("fp", F.floor(F.col("rank") / rel.OLD_ENTRIES).cast("bigint").alias("old_cid"), F.floor(F.col("rank") / rel.NEW_ENTRIES).cast("bigint").alias("by_container"))
    last = held.groupBy("fp").agg(F.max("old_cid").alias("c"))
    latest = held.join(last, "fp").where("old_cid = c").select("fp", F.col("by_container").alias("by_fingerprint"))
    return held.join(latest, "fp").select(F.col("fp").alias("old_fp"), "old_cid", "by_container", "by_fingerprint")




def _lanes_sql() -> str:
    lanes = " UNION ALL ".join(
        f"SELECT file_id, {k} AS k, min(((CAST(cid AS HUGEINT) * {a}) % 18446744073709551616 + {b}) % 18446744073709551616) AS feature FROM recipe GROUP BY file_id"
        for k, (a, b) in enumerate(scalar.lane_constants())
    )
    return f", feature AS ({lanes})"


_FEATURE = _lanes_sql()


def _recipe_features(spark, sf):
    return upgrade.recipe_features(rel.recipe(spark, sf)[0])


@query(_FEATURE + " SELECT file_id, k, CAST(feature AS VARCHAR) AS feature FROM feature")
def recipe_minhash(spark, sf):
    return _recipe_features(spark, sf).select("file_id", "k", F.col("feature").cast("string").alias("feature"))


_CLASSES = _FEATURE + """, vec AS (SELECT file_id, list(feature ORDER BY k) AS v FROM feature GROUP BY 1),
class AS (SELECT file_id, min(file_id) OVER (PARTITION BY v) AS rep FROM vec)
"""


@query(_CLASSES + "SELECT file_id, rep FROM class")
def recipe_classes(spark, sf):
    """Recipes of equal features, by their least member."""
    return upgrade.feature_classes(_recipe_features(spark, sf))


@query(_CLASSES + "SELECT x.file_id AS a, y.file_id AS b, count(*) AS shared FROM feature x JOIN feature y USING (k, feature) WHERE x.file_id < y.file_id AND x.file_id IN (SELECT rep FROM class) AND y.file_id IN (SELECT rep FROM class) GROUP BY 1, 2")
def recipe_similarity_pairs(spark, sf):
    """Shared features of all pairs of class representatives (see recipe_classes)."""
    return upgrade.similar_recipes(_recipe_features(spark, sf))


@query(_FEATURE + " SELECT k, CAST(feature AS VARCHAR) AS feature, count(*) AS recipes FROM feature GROUP BY 1, 2")
def recipe_feature_table(spark, sf):
    return upgrade.inverted_features(_recipe_features(spark, sf)).select("k", F.col("feature").cast("string").alias("feature"), "recipes")


@query("SELECT file_id, count(DISTINCT cid) AS containers FROM recipe GROUP BY 1")
def unique_containers_per_recipe(spark, sf):
    return upgrade.unique_containers(rel.recipe(spark, sf)[0])


def _parts_sql(least: int, expected: int, most: int) -> str:
    """part: the parts of each recipe, one after another. On the way the different
    containers are gathered; once they suffice, the next one that is new ends the part."""
    step = f"""CASE WHEN a.stop >= 0 OR list_contains(a.seen, x.seen[1]) THEN a
      WHEN a.closed THEN {{'seen': a.seen, 'closed': true, 'stop': x.place, 'place': x.place}}
      ELSE {{'seen': list_append(a.seen, x.seen[1]), 'closed': len(a.seen) + 1 >= {most} OR (len(a.seen) + 1 >= {least} AND x.seen[1] % {expected - least} = 0), 'stop': CAST(-1 AS BIGINT), 'place': x.place}} END"""
    return f""", held AS (SELECT file_id, list(cid ORDER BY chunk_no) AS cids FROM recipe GROUP BY 1),
parting AS (SELECT file_id, CAST(0 AS BIGINT) AS start, 0 AS n, CAST(0 AS BIGINT) AS first, 0 AS containers FROM held
  UNION ALL SELECT file_id, CASE WHEN r.stop >= 0 THEN r.stop ELSE len(cids) END, n + 1, start, CAST(len(r.seen) AS INTEGER) FROM (
    SELECT p.file_id, p.start, p.n, h.cids, list_reduce(list_transform(range(p.start, len(h.cids)), lambda i: {{'seen': [h.cids[i + 1]], 'closed': false, 'stop': CAST(-1 AS BIGINT), 'place': i}}), lambda a, x: {step}) AS r
    FROM parting p JOIN held h USING (file_id) WHERE p.start < len(h.cids))),
part AS (SELECT file_id, CAST(n - 1 AS BIGINT) AS sub_id, first AS first_chunk, start - first AS chunks, CAST(containers AS BIGINT) AS containers FROM parting WHERE n > 0)
"""


_PARTS = _parts_sql(2, 4, 6)


@query(_PARTS + "SELECT * FROM part")
def recipe_cdc(spark, sf):
    return upgrade.split_recipe(rel.recipe(spark, sf)[0], 2, 4, 6)


@query(_PARTS + ", sub AS (SELECT r.file_id * 1048576 + p.sub_id AS sub, r.cid FROM recipe r JOIN part p ON p.file_id = r.file_id AND r.chunk_no >= p.first_chunk AND r.chunk_no < p.first_chunk + p.chunks)" + _lanes_sql().replace("file_id", "sub").replace("FROM recipe", "FROM sub") + " SELECT sub, k, CAST(feature AS VARCHAR) AS feature FROM feature")
def sub_recipe_minhash(spark, sf):
    """Features of the parts of recipes, which stand for recipes of their own."""
    recipe = rel.recipe(spark, sf)[0]
    parts = upgrade.sub_recipes(recipe, upgrade.split_recipe(recipe, 2, 4, 6))
    return upgrade.recipe_features(parts, "sub").select("sub", "k", F.col("feature").cast("string").alias("feature"))


_ORDER = _CLASSES + """, kind AS (SELECT rep, any_value(v) AS v FROM vec JOIN class USING (file_id) GROUP BY 1),
going AS (SELECT 0 AS n, (SELECT min(rep) FROM kind) AS now, [(SELECT min(rep) FROM kind)] AS gone
  UNION ALL SELECT n + 1, best[3], list_append(gone, best[3]) FROM (
    SELECT g.n, g.gone, min([-list_sum(list_transform(range(1, 9), lambda i: CASE WHEN c.v[i] = o.v[i] THEN 1 ELSE 0 END)), list_max(list_transform(range(1, 9), lambda i: CASE WHEN c.v[i] = o.v[i] THEN i ELSE 0 END)), c.rep]) AS best
    FROM going g JOIN kind o ON o.rep = g.now JOIN kind c ON NOT list_contains(g.gone, c.rep) GROUP BY 1, 2))
"""


@query(_ORDER + "SELECT file_id, row_number() OVER (ORDER BY n, file_id) - 1 AS pos FROM class JOIN going ON going.now = class.rep")
def sim_order(spark, sf):
    return upgrade.similarity_order(_recipe_features(spark, sf))


@query("SELECT 'lfu' AS mode, count(*) AS hashed FROM recipe UNION ALL SELECT m, (SELECT count(*) FROM stored) FROM (VALUES ('pfu'), ('con-pfu'), ('sim-pfu')) t(m)")
def upgrade_hash_counts(spark, sf):
    recipe, stored = rel.recipe(spark, sf)
    return upgrade.upgrade_counters(recipe, stored)


_LOOKUP_CACHE = 4 * 1169 * 60
#: The cache by container holds the last used ones, of which the oldest go until the next
#: one leaves it short of full; the one by fingerprint is an LRU of entries.
_LOOKUPS = _ORDER + f""", place AS (SELECT file_id, row_number() OVER (ORDER BY n, file_id) - 1 AS rank FROM class JOIN going ON going.now = class.rep),
asked AS (SELECT 'con-pfu' AS mode, seq AS pos, cid FROM recipe UNION ALL SELECT 'sim-pfu', rank * 16777216 + chunk_no, cid FROM recipe JOIN place USING (file_id)),
turns AS (SELECT mode, cid, bytes, row_number() OVER (PARTITION BY mode ORDER BY pos) AS i FROM (SELECT *, lag(cid) OVER (PARTITION BY mode ORDER BY pos) AS l FROM asked) JOIN (SELECT cid, count(*) * 60 AS bytes FROM stored GROUP BY 1) USING (cid) WHERE cid IS DISTINCT FROM l),
kept AS (SELECT DISTINCT mode, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(cid BIGINT, bytes BIGINT)[]) AS held, 0 AS misses FROM turns
  UNION ALL SELECT mode, i, list_append(CASE WHEN hit THEN list_filter(held, lambda h: h.cid <> c) ELSE held[coalesce(list_filter(range(0, len(held)), lambda k: list_sum(list_transform(held[k + 1:], lambda h: h.bytes)) + b < {_LOOKUP_CACHE})[1], len(held)) + 1:] END, {{'cid': c, 'bytes': b}}), misses + CASE WHEN hit THEN 0 ELSE 1 END FROM (
    SELECT k.mode, t.i, k.held, k.misses, t.cid AS c, t.bytes AS b, len(list_filter(k.held, lambda h: h.cid = t.cid)) > 0 AS hit FROM kept k JOIN turns t ON t.mode = k.mode AND t.i = k.i + 1)),
again AS (SELECT seq, prev FROM (SELECT seq, lag(seq) OVER (PARTITION BY fp ORDER BY seq) AS prev FROM recipe) WHERE prev IS NOT NULL),
near AS (SELECT a.seq FROM again a LEFT JOIN recipe r ON r.seq > a.prev AND r.seq < a.seq GROUP BY 1 HAVING count(DISTINCT r.fp) < {_LOOKUP_CACHE // 60 - 1})
SELECT mode, (SELECT count(*) FROM recipe) AS chunks, CAST(max(misses) AS BIGINT) AS external_lookups FROM kept GROUP BY 1
UNION ALL SELECT 'pfu', count(*), count(*) - (SELECT count(*) FROM near) FROM recipe
"""


@query(_LOOKUPS)
def upgrade_cache_lookups(spark, sf):
    """External lookups at equal cache: by fingerprint, by container, and by container
    in similarity order."""
    recipe, stored = rel.recipe(spark, sf)
    sizes = layout.containers(stored)
    cache = 4 * rel.OLD_ENTRIES * 60
    plain = recipe.select(F.col("seq").alias("pos"), "cid", "fp")
    order = upgrade.similarity_order(_recipe_features(spark, sf))
    ranked = recipe.join(order.withColumnRenamed("pos", "rank"), "file_id").select((F.col("rank") * (1 << 24) + F.col("chunk_no")).alias("pos"), "cid", "fp")
    out = simulation.upgrade_lookups(plain, sizes, cache, "fp").withColumn("mode", F.lit("pfu"))
    out = out.unionByName(simulation.upgrade_lookups(plain, sizes, cache, "cid").withColumn("mode", F.lit("con-pfu")))
    return out.unionByName(simulation.upgrade_lookups(ranked, sizes, cache, "cid").withColumn("mode", F.lit("sim-pfu")))


# --- retention --------------------------------------------------------------------


@query("SELECT cid, max(version) AS last_version FROM recipe GROUP BY cid", entries=SMALL)
def manifest(spark, sf):
    return retention.manifest(rel.recipe(spark, sf, SMALL)[0])


@query(f"SELECT cid, max(version) AS last_version FROM recipe GROUP BY cid HAVING max(version) < {KEEP_FROM}", entries=SMALL)
def gc_reclaim(spark, sf):
    return retention.reclaimed(retention.manifest(rel.recipe(spark, sf, SMALL)[0]), KEEP_FROM)


@query(f"SELECT count(*) AS containers FROM (SELECT cid FROM recipe GROUP BY cid HAVING max(version) >= {KEEP_FROM})", entries=SMALL)
def live_containers(spark, sf):
    return retention.live(retention.manifest(rel.recipe(spark, sf, SMALL)[0]), KEEP_FROM).agg(F.count("*").alias("containers"))


@query(f"SELECT fp, cid FROM stored WHERE cid NOT IN (SELECT cid FROM recipe GROUP BY cid HAVING max(version) < {KEEP_FROM})", entries=SMALL)
def index_after_gc(spark, sf):
    recipe, stored = rel.recipe(spark, sf, SMALL)
    gone = retention.reclaimed(retention.manifest(recipe), KEEP_FROM)
    return retention.index_after(stored.select("fp", "cid"), gone)


# --- counters ---------------------------------------------------------------------

_COUNTERS = _DECIDED + """, counters AS (SELECT c.version, count(DISTINCT c.file_id) AS files, count(*) AS chunks, CAST(sum(c.size) AS BIGINT) AS bytes,
  count(*) FILTER (NOT is_dup) AS unique_chunks, CAST(coalesce(sum(c.size) FILTER (NOT is_dup), 0) AS BIGINT) AS unique_bytes,
  count(*) FILTER (is_dup AND written) AS rewritten_chunks, CAST(coalesce(sum(c.size) FILTER (is_dup AND written), 0) AS BIGINT) AS rewritten_bytes,
  count(*) FILTER (regexp_full_match(x, '(00)+')) AS zero_chunks FROM chunk c JOIN decided d ON d.seq = c.seq GROUP BY c.version)
"""


def _counters(spark, sf):
    zero = rel.chunks(spark, sf, data=True).select("seq", scalar.is_zero_chunk(F.col("data")).alias("is_zero"))
    return stats.job_counters(_decided(spark, sf).withColumn("rewritten", F.col("is_dup") & F.col("written")).join(zero, "seq"))


@query(_COUNTERS + "SELECT * FROM counters")
def job_counters(spark, sf):
    return _counters(spark, sf)


@query(_COUNTERS + "SELECT version, round((bytes - unique_bytes - rewritten_bytes) / CAST(bytes AS DOUBLE), 6) AS dedup_ratio, round(bytes / CAST(unique_bytes + rewritten_bytes AS DOUBLE), 6) AS dedup_factor, round(rewritten_bytes / CAST(bytes AS DOUBLE), 6) AS rewrite_ratio FROM counters")
def job_ratios(spark, sf):
    return stats.ratios(_counters(spark, sf))


@query(_COUNTERS + "SELECT version, CAST(sum(bytes) OVER (ORDER BY version) AS BIGINT) AS total_bytes, CAST(sum(unique_bytes) OVER (ORDER BY version) AS BIGINT) AS stored_bytes, CAST(sum(chunks) OVER (ORDER BY version) AS BIGINT) AS total_chunks FROM counters")
def cumulative_totals(spark, sf):
    return stats.cumulative(_counters(spark, sf))


@query("SELECT count(*) AS segments, CAST(sum(n) AS BIGINT) AS chunks, round(avg(n), 6) AS mean_chunks FROM (SELECT count(*) AS n FROM seg GROUP BY segment_id)")
def segment_stats(spark, sf):
    return stats.segment_stats(_segments(spark, sf))


@query("SELECT cid, round(sum(size) / 299264.0, 6) AS utilization FROM stored GROUP BY cid")
def utilization(spark, sf):
    used = layout.containers(rel.placed(spark, sf)[1])
    return used.select("cid", F.round(scalar.utilization(F.col("data_size"), rel.PAYLOAD), 6).alias("utilization"))


@query("SELECT r AS ratio, CAST(floor(s * 0.0025 * r / 100) AS BIGINT) AS cache_bytes FROM (SELECT sum(size) AS s FROM stored), (VALUES (10), (20), (40), (50), (60), (80), (100), (200)) t(r)")
def evaluation_cache_sizes(spark, sf):
    total = rel.placed(spark, sf)[1].agg(F.sum("size").alias("s"))
    ratios = F.explode(F.array(*[F.lit(r) for r in (10, 20, 40, 50, 60, 80, 100, 200)]))
    return total.select("s", ratios.alias("ratio")).select("ratio", F.floor(F.col("s") * 0.0025 * F.col("ratio") / 100).alias("cache_bytes"))


# --- the store, and files ---------------------------------------------------------

_DIGESTS = "SELECT version, file_id, upper(sha256(unhex(h))) AS digest FROM stream WHERE length(h) > 0"


def _named(spark, sf):
    return rel.stream(spark, sf).withColumn("file_name", F.concat(F.lit("/doc"), F.col("file_id").cast("string")))


def _store(spark, sf, config: StoreConfig) -> Store:
    """A store with the three versions backed up one after another."""
    store, files = Store(spark, folder(spark), config), _named(spark, sf)
    for v in range(3):
        store.backup(files.where(F.col("version") == v).select("file_id", "file_name", "data"))
    return store


def _restored(store: Store):
    return store.restore(*store.versions()).select("version", "file_id", scalar.sha256_fp(F.col("data")).alias("digest"))


@query(_DIGESTS)
def store_restore(spark, sf):
    """The whole way: content-defined chunks, exact index, next-fit containers, recipes
    and restore, for three backups."""
    return _restored(_store(spark, sf, CDC))


@query(_DIGESTS)
def store_upgrade_restore(spark, sf):
    """The same after the fingerprint function was changed."""
    return _restored(_store(spark, sf, CDC).upgrade(folder(spark)))


_FIXED = StoreConfig(chunk_algorithm="fixed", chunk_avg_size=1024)


@query("SELECT version, count(*) AS chunks, CAST(sum(c.size) AS BIGINT) AS bytes, CAST(coalesce(sum(s.size), 0) AS BIGINT) AS stored_bytes FROM chunk c LEFT JOIN (SELECT seq, size FROM stored) s USING (seq) GROUP BY 1", size=1024)
def store_job_log(spark, sf):
    return _store(spark, sf, _FIXED).table("job_log").select("version", "chunks", "bytes", "stored_bytes")


@query(f""", u AS (SELECT s.fp, c.version AS v0, (row_number() OVER (PARTITION BY c.version ORDER BY s.seq) - 1) // 1169 AS k FROM stored s JOIN chunk c USING (seq)),
used AS (SELECT u.v0, u.k, max(c.version) AS last FROM chunk c JOIN u USING (fp) GROUP BY 1, 2)
SELECT count(DISTINCT (v0, k)) AS containers, count(*) AS chunks FROM u JOIN used USING (v0, k) WHERE last >= {KEEP_FROM}""", size=1024)
def store_expire(spark, sf):
    """What is left in containers when old versions are gone."""
    store = _store(spark, sf, _FIXED)
    store.expire(KEEP_FROM)
    return store.table("container_entry").agg(F.count_distinct("cid").alias("containers"), F.count("*").alias("chunks"))


def _traced(spark, sf):
    return rel.chunks(spark, sf, 1024).withColumn("file_name", F.concat(F.lit("/doc"), F.col("file_id").cast("string")))


@query("SELECT '/doc' || file_id AS file_name, chunk_no, fp, CAST(size AS BIGINT) AS size FROM chunk", size=1024)
def trace_roundtrip(spark, sf):
    path = folder(spark)
    write_trace(_traced(spark, sf).select("file_id", "file_name", "chunk_no", "fp", "size"), path)
    return read_trace(spark, path).select("file_name", "chunk_no", "fp", "size")


def _hash_files(spark, sf) -> str:
    """A snapshot of each version, in a folder. What a file adds to it is made file by file;
    one task writes a snapshot, and only passes bytes on."""
    ship(spark)

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            bodies = []
            for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                bodies.append(hashfile.build_file({"path": name, "file_size": sum(c["size"] for c in parts)}, [(c["digest"], c["size"], 0) for c in parts]))
            yield pa.RecordBatch.from_arrays([batch.column("file_name"), batch.column("at"), pa.array(bodies, pa.binary())], names=["file_name", "at", "data"])

    pieces = chunking.fixed_chunks(rel.stream(spark, sf), 1024).select("version", "file_id", "chunk_no", "size", F.unhex(F.sha1("data")).alias("digest"))
    held = pieces.groupBy("version", "file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "size", "digest"))).alias("parts"))
    snapshot = F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(".hash")).alias("file_name")
    bodies = held.select(snapshot, F.col("file_id").alias("at"), F.concat(F.lit("/doc"), F.col("file_id").cast("string")).alias("name"), "parts").mapInArrow(made, "file_name string, at long, data binary")
    totals = pieces.groupBy("version").agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("chunks"), F.sum("size").alias("bytes")).select(snapshot, "files", "chunks", "bytes")
    heads = [(r.file_name, bytearray(hashfile.build_header(r.files, r.chunks, r.bytes, hash_bytes=20, hashing=6))) for r in totals.collect()]
    path = folder(spark)
    write_joined(bodies, heads, path if "://" in path else f"file://{path}")
    return path


@query("SELECT 'v' || version || '.hash' AS trace, '/doc' || file_id AS path, chunk_no, fp || repeat('0', 24) AS fp, CAST(size AS BIGINT) AS size FROM chunk", size=1024)
def hash_file_roundtrip(spark, sf):
    return hashfile.read_hash_files(spark, _hash_files(spark, sf)).select("trace", "path", "chunk_no", "fp", "size")


@query("SELECT 'v' || version || '.hash' AS trace, seq - min(seq) OVER (PARTITION BY version) AS chunk_no, fp || repeat('0', 24) AS fp, CAST(size AS BIGINT) AS size FROM chunk", size=1024)
def hash_file_list_mode(spark, sf):
    """All chunks of a snapshot as one file."""
    return hashfile.read_hash_files(spark, _hash_files(spark, sf), one_file_per_trace=True).select("trace", "chunk_no", "fp", "size")


def _folder_of_files(spark, sf) -> str:
    path = folder(spark)
    path = path if "://" in path else f"file://{path}"
    write_files(rel.stream(spark, sf).select(F.concat(F.lit("v"), F.col("version").cast("string"), F.lit("/doc"), F.col("file_id").cast("string")).alias("file_name"), "data"), path)
    return path


@query("SELECT row_number() OVER (ORDER BY 'v' || version || '/doc' || file_id) - 1 AS file_id, 'v' || version || '/doc' || file_id AS file_name, upper(sha256(unhex(h))) AS digest FROM stream")
def directory_scan(spark, sf):
    """Files that were written are read back from their folder."""
    return read_directory(spark, _folder_of_files(spark, sf)).select("file_id", "file_name", scalar.sha256_fp(F.col("data")).alias("digest"))


@query("SELECT file_id, '/doc' || file_id AS file_name, upper(sha256(unhex(h))) AS digest FROM stream")
def file_list_scan(spark, sf):
    """The same files by a list of their paths, in the order of their numbers. A line's
    number is the place of its file in that order."""
    path, listed = _folder_of_files(spark, sf), folder(spark)
    numbered = cut(dense_index(rel.stream(spark, sf).select("file_id", "version"), ["file_id"], "line"))
    lines = numbered.select("line", F.concat(F.lit(f"{path}/v"), F.col("version").cast("string"), F.lit("/doc"), F.col("file_id").cast("string")).alias("value"))
    lines.repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(listed)
    found = read_file_list(spark, listed).withColumnRenamed("file_id", "line")
    return found.join(numbered, "line").select("file_id", "file_name", scalar.sha256_fp(F.col("data")).alias("digest"))
