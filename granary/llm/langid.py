"""Language ID by prediction by partial matching.

For each language a tree of byte contexts of 0 to 3 bytes gives the next byte a
probability; a byte unseen in a context escapes to the next shorter one (method
C: escape mass D / (T + D) for D distinct bytes after T occurrences, without
exclusion), down to 1/256 for each byte. The statistics are frozen after fitting,
so the code length of a byte depends on it and the three bytes before it alone,
and whole batches are scored by table lookups that give the exact lengths. Contexts are
counted in Spark and all of them are kept.

The prediction is the language of the shortest code; the score is its posterior
under equal priors. As that compares learned languages only, the mean code length of a
byte is given too: it tells texts that are like none of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.llm.common import bounded_sample, held_out, remainder, replacing, robust_bands
from granary.llm.textscan import LOWER, Index, blocks, scramble

RESULTS = ("held_out", "lang_pred", "score", "byte_bits")
UNKNOWN = "und"
#: Bytes that stand before each text.
PAD = 10
#: Times the median bits of a byte of its language from which a text is like no language,
#: and the bytes that it takes to say so.
FACTOR, LEAST_BYTES = 2.0, 64


@dataclass
class Model:
    """Sorted keys and code lengths in bits, [entry, language]."""

    languages: list[str]
    grams3: np.ndarray  # distinct 3-byte grams
    bits3: np.ndarray  # code length of the last byte of each after the first two
    escape3: np.ndarray  # bits to escape from each, taken as a context
    grams4: np.ndarray  # distinct 4-byte grams
    bits4: np.ndarray
    bits2: np.ndarray  # [first * 256 + second, language]
    escape2: np.ndarray  # bits to escape from a context of two bytes


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with three pad bytes before each text, and the new starts."""
    rows = len(offsets) - 1
    out = np.full(len(data) + 3 * rows, PAD, np.uint8)
    shift = np.repeat(3 * np.arange(1, rows + 1), np.diff(offsets))
    out[np.arange(len(data)) + shift] = LOWER[data]
    return out, offsets + 3 * np.arange(rows + 1)


def _grams(padded: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n-byte grams that end at each byte of the texts, pads aside."""
    keys = padded.astype(np.uint32)
    out = keys.copy()
    for k in range(1, n):
        out[k:] |= keys[:-k] << np.uint32(8 * k)
    real = np.ones(len(padded), bool)
    real[(starts[:-1, None] + np.arange(3)).ravel()] = False
    return out[real]


def _contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (keys without the last byte) with T and D."""
    ctx, first = np.unique(keys >> np.uint32(8), return_index=True)
    total = np.add.reduceat(counts, first)
    distinct = np.diff(np.append(first, len(keys)))
    return ctx, total, distinct


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


def _lengths(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each wanted gram in the context before it; shorter:
    the bits in the next shorter context."""
    ctx, total, distinct = _contexts(keys, counts)
    at, seen = _lookup(keys, wanted)
    c_at, c_seen = _lookup(ctx, wanted >> np.uint32(8))
    whole = (total + distinct)[c_at]
    known = -np.log2(np.where(seen, counts[at], 1) / whole)
    return np.where(seen, known, shorter + np.where(c_seen, -np.log2(distinct[c_at] / whole), 0.0))


def _escapes(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ctx, total, distinct = _contexts(keys, counts)
    at, seen = _lookup(ctx, wanted)
    return np.where(seen, -np.log2(distinct[at] / (total + distinct)[at]), 0.0)


def _counter(batches):
    """(language, length, gram, count) of the grams of one partition's texts."""
    for batch in batches:
        lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        text = batch.column(batch.schema.get_field_index("text"))
        for lo, hi, data, offsets in blocks(text):
            names = np.array(lang[lo:hi])
            padded, starts = _padded(data, offsets)
            of = np.repeat(np.arange(hi - lo), np.diff(offsets))
            for n in (1, 2, 3, 4):
                grams = _grams(padded, starts, n)
                for name in np.unique(names):
                    keys, counts = np.unique(grams[(names == name)[of]], return_counts=True)
                    for at in range(0, len(keys), 1 << 16):
                        k, c = keys[at : at + (1 << 16)], counts[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(k), pa.string()), pa.array([n] * len(k), pa.int32()), pa.array(k.astype(np.int64)), pa.array(c)], names=["lang", "k", "gram", "n"])


Counts = dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]


def collected(found: pa.Table) -> Counts:
    """Of each language and length the sorted grams and their counts."""
    out: Counts = {}
    if not found.num_rows:
        return out
    names = found.column("lang").combine_chunks().dictionary_encode()
    code, k = np.asarray(names.indices), np.asarray(found.column("k"))
    gram, n = np.asarray(found.column("gram")).astype(np.uint32), np.asarray(found.column("n"))
    for c, name in enumerate(names.dictionary.to_pylist()):
        for length in (1, 2, 3, 4):
            mine = (code == c) & (k == length)
            order = np.argsort(gram[mine])
            out.setdefault(name, {})[length] = (gram[mine][order], n[mine][order])
    return out


def train(counted: Counts) -> Model:
    """The model of counted grams."""
    languages = sorted(counted)
    two = np.arange(1 << 16, dtype=np.uint32)
    union = lambda n: np.unique(np.concatenate([counted[x][n][0] for x in languages] + [np.empty(0, np.uint32)]))
    g4 = union(4)
    g3 = np.union1d(union(3), np.unique(g4 >> np.uint32(8)))  # with the pads, which no text has as a gram
    b2, b3, b4, e2, e3 = [], [], [], [], []
    for lang in languages:
        c = counted[lang]
        zero = np.zeros(256, np.int64)
        zero[c[1][0]] = c[1][1]
        total, distinct = zero.sum(), (zero > 0).sum()
        order0 = np.where(zero > 0, -np.log2(np.maximum(zero, 1) / (total + distinct)), -np.log2(distinct / (total + distinct)) + 8)
        order1 = _lengths(two, *c[2], order0[two & 255])
        order2 = _lengths(g3, *c[3], order1[g3 & 0xFFFF])
        # A 4-gram's last three bytes are a gram of the same text, so all are found.
        l3, _ = _lookup(g3, g4 & np.uint32(0xFFFFFF))
        order3 = _lengths(g4, *c[4], order2[l3])
        b2.append(order1), b3.append(order2), b4.append(order3)
        e2.append(_escapes(two, *c[3])), e3.append(_escapes(g3, *c[4]))
    pack = lambda x: np.stack(x, 1).astype(np.float32)
    return Model(languages, g3, pack(b3), pack(e3), g4, pack(b4), pack(b2), pack(e2))


class Scorer:
    """The model as tables: 3-byte grams are addressed directly, 4-byte grams by hash."""

    def __init__(self, model: Model):
        self.languages = model.languages
        none = np.zeros((1, len(model.languages)), np.float32)
        self.t3 = np.zeros(1 << 24, np.int32)
        self.t3[model.grams3] = np.arange(1, len(model.grams3) + 1)
        hashes = scramble(model.grams4.astype(np.uint64))
        order = np.argsort(hashes)
        self.grams4, self.bits4 = Index(hashes[order]), np.vstack([model.bits4[order], none])
        self.bits3, self.escape3 = np.vstack([none, model.bits3]), np.vstack([none, model.escape3])
        self.bits2, self.escape2 = model.bits2, model.escape2

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        padded, starts = _padded(data, offsets)
        keys = padded.astype(np.int32)
        k3 = keys.copy()
        k3[1:] |= keys[:-1] << 8
        k2 = k3 & 0xFFFF
        k3[2:] |= keys[:-2] << 16
        id3 = self.t3[k3]
        k4 = keys.astype(np.uint64)
        k4[1:] |= k3[:-1].astype(np.uint64) << np.uint64(8)
        real = np.ones(len(keys), bool)
        real[(starts[:-1, None] + np.arange(3)).ravel()] = False
        seen, at4 = self.grams4.find(scramble(k4))
        bits = self.bits4[at4]
        bits[~real] = 0
        new = np.flatnonzero(real & ~seen)
        if len(new):
            shorter = self.bits3[id3[new]]
            newer = np.flatnonzero(id3[new] == 0)
            at = new[newer]
            shorter[newer] = self.escape2[k2[at - 1]] + self.bits2[k2[at]]
            bits[new] = shorter + self.escape3[id3[new - 1]]
        return np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.float64)

    def predict(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the index of the language, its posterior, and the mean bits of a
        byte under it."""
        best, score, mean = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        for lo, hi, data, offsets in blocks(column):
            bits = self.code_lengths(data, offsets)
            least = bits.min(axis=1, keepdims=True)
            best[lo:hi] = bits.argmin(axis=1)
            score[lo:hi] = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
            mean[lo:hi] = least[:, 0] / np.maximum(np.diff(offsets), 1)
        return best, score, mean


_scorers: dict = {}


def _scorer(broadcast) -> Scorer:
    """One scorer for each worker and model."""
    key = broadcast._path or id(broadcast)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(broadcast.value)
    return _scorers[key]


def fit(docs: DataFrame, sample_rows: int = 1000) -> Model | None:
    """A model from labelled documents: for each lang, whole texts of `sample_rows`
    documents or so that are not held out. None if there is no labelled document. The
    training set has at most 8 * sample_rows rows in all, however many languages there
    are; their grams are counted in Spark, and the counts come to the driver."""
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id")) != 1))
    n = max(1, rows.select("lang").distinct().count())
    sample = bounded_sample(rows, min(sample_rows, max(1, 8 * sample_rows // n)), "lang", ["lang", "text"])
    grams = sample.mapInArrow(_counter, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    counted = collected(grams.toArrow())
    return train(counted) if counted else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with held_out, lang_pred, score and byte_bits (mean code length of a byte
    under that language, in bits); the caller's columns of these names are replaced. A
    text that is null or has no letter is `und` with score 0 and null bits, as is every
    text if there is no model. Equal code lengths go to the language that comes first in
    alphabetical order. An empty table gives no rows.

    Texts are read whole. Only the text enters a prediction.
    """
    ship(docs.sparkSession)
    base = replacing(docs, *RESULTS).withColumn("held_out", held_out(F.col("doc_id")))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return base.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0)).withColumn("byte_bits", F.lit(None).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    marked = base.withColumn("__gr_letters", letters)
    out = base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("byte_bits", F.lit(None).cast("double")).schema

    def run(batches):
        scorer = _scorer(shared)
        names = np.array([*scorer.languages, UNKNOWN], dtype=object)
        for batch in batches:
            has = np.asarray(batch.column(batch.num_columns - 1))
            best, score, mean = scorer.predict(batch.column(batch.schema.get_field_index("text")))
            pred = pa.array(names[np.where(has, best, len(names) - 1)], pa.string())
            columns = [*batch.columns[:-1], pred, pa.array(np.where(has, score, 0.0)), pa.array(mean, mask=~has)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score", "byte_bits"])

    return marked.mapInArrow(run, out)


def unlike(identified: DataFrame, factor: float = FACTOR, least_bytes: int = LEAST_BYTES) -> Column:
    """Whether an identified text (with its text column) is like no learned language: its
    bytes cost more than `factor` times the median of all texts of the language that was
    predicted. That can be said of texts of `least_bytes` or more; texts without a
    prediction are unlike any."""
    limit = F.lit(None).cast("double")
    for lang, (median, _) in robust_bands(identified, "lang_pred", "byte_bits", 0, 0).items():
        limit = F.when(F.col("lang_pred") == lang, factor * median).otherwise(limit)
    return F.col("byte_bits").isNull() | ((F.col("byte_bits") > limit) & (F.octet_length("text") >= least_bytes))
