"""Toxicity by a counterfactually regularised classifier.

Logistic regression over the presence of words and of word beginnings, chosen by
how much better they are found in toxic texts. Each labelled text is also seen with
each of its identity terms swapped for every other term of the same kind, and the fit
is penalised for the changes in score, so that naming a group does not by itself make a
text toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.llm.common import cut, held_out, remainder, replacing
from granary.llm.textscan import ALNUM, blocks, span_hashes, spans

RESULTS = ("held_out", "score", "predicted")
#: Bits of the hashed feature space.
BITS = 20
#: Lengths in bytes of word beginnings that are features.
BEGINNINGS = (5, 6, 7, 8)
THRESHOLD = 0.7
#: A feature is taken if so many texts have it, and toxic ones so many standard
#: deviations more often than evenly.
LEAST_TEXTS, LEAST_DEVIATIONS = 8, 3.0
#: The most features of a model, and the weight of the squared weights.
MOST_FEATURES, RIDGE = 4096, 0.05
#: Thinned copies of each text in the fit, and the share of features that they keep.
THINNED, KEPT = 1, 0.5
#: These settings were chosen by cross_validate() on the training rows of a table: the best
#: balance of precision and recall at the threshold among those of nearly least log loss.
#: Groups of identity terms; any may stand for any other of its group. A parameter of fit().
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "indian"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


@dataclass
class Model:
    features: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    bias: float


def _word_features(data, starts, ends, lower=True) -> np.ndarray:
    """Feature numbers: one column for the word and one for each beginning, -1 where
    the word is no longer than it."""
    out = np.full((len(starts), 1 + len(BEGINNINGS)), -1, np.int64)
    mask = np.uint64((1 << BITS) - 1)
    out[:, 0] = (span_hashes(data, starts, ends, 11, lower) & mask).astype(np.int64)
    for k, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(ends - starts > n)
        h = span_hashes(data, starts[longer], starts[longer] + n, 11 + k, lower)
        out[longer, k] = (h & mask).astype(np.int64)
    return out


def _distinct(column, wanted: np.ndarray | None):
    """(first row, end row, row number, feature) of the distinct features of each text;
    with `wanted`, a table that is True for the features to be looked at."""
    for lo, hi, data, offsets in blocks(column):
        starts, ends, first = spans(ALNUM[data], offsets)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        features = _word_features(data, starts, ends)
        r, f = np.broadcast_to(row[:, None], features.shape).ravel(), features.ravel()
        keep = (f >= 0) & (True if wanted is None else wanted[f])
        key = np.unique((r[keep] << BITS) | f[keep])
        yield lo, hi, key >> BITS, key & ((1 << BITS) - 1)


def features_of(text: str) -> np.ndarray:
    for _, _, _, f in _distinct(pa.array([text]), None):
        return f
    return np.empty(0, np.int64)


def _swaps(terms) -> dict[int, tuple[list[int], list[list[int]]]]:
    """Feature of an identity term's word -> all features of the term (of its word and
    beginnings), and those of each other term of its group."""

    def of(t: str) -> list[int]:
        raw = np.frombuffer(t.encode(), np.uint8)
        return [int(f) for f in _word_features(raw, np.array([0]), np.array([len(raw)]))[0] if f >= 0]

    return {of(a)[0]: (of(a), [of(b) for b in group if b != a]) for group in terms for a in group}


def telling(seen: np.ndarray, toxic: np.ndarray, n1: float, n0: float, least_texts: int, least_deviations: float, most: int) -> np.ndarray:
    """The features to be learned, from how many texts and how many toxic ones have each:
    those of `least_texts` that toxic ones have `least_deviations` standard deviations
    more often than evenly; the `most` telling of them."""
    share = n1 / (n1 + n0)
    z = (toxic - share * seen) / np.sqrt(np.maximum(share * (1 - share) * seen, 1e-9))
    good = np.flatnonzero((seen >= least_texts) & (z >= least_deviations))
    return good[np.argsort(-z[good], kind="stable")[:most]]


def train(texts: list[np.ndarray], toxic: np.ndarray, features: np.ndarray | None = None, terms=IDENTITY_TERMS, ridge: float = RIDGE, fairness: float = 1.0, least_texts: int = LEAST_TEXTS, least_deviations: float = LEAST_DEVIATIONS, thinned: int = THINNED, kept: float = KEPT, most: int = MOST_FEATURES, steps: int = 400) -> Model:
    """Fits the model to distinct features and labels (0 or 1) of texts.

    features: those to be learned beside those of identity terms (by default the telling
    ones of these texts); ridge: weight of the squared weights; fairness: weight of the
    mean squared change of the log-odds when an identity term is swapped for another."""
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    flat = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
    toxic = toxic.astype(float)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    if not n1 or not n0:  # nothing to tell apart
        share = (n1 + 0.5) / (n1 + n0 + 1) if len(toxic) else 0.0
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    seen = np.bincount(flat, minlength=1 << BITS)
    if features is None:
        features = telling(seen, np.bincount(flat, toxic[rows], 1 << BITS), n1, n0, least_texts, least_deviations, most)
    swap = _swaps(terms)
    identity = _identity(terms)
    features = np.union1d(features, identity[seen[identity] > 0])
    where = np.full(1 << BITS, -1, np.int64)
    where[features] = np.arange(len(features))
    held = where[flat] >= 0
    r, c = rows[held], where[flat[held]]
    # One swapped copy for each term of a text and each other term of its group, as
    # (copy, feature, -1 or 1) for what goes and what comes.
    changes, copies = [], 0
    for word in flat[np.isin(flat, list(swap))]:
        gone, others = swap[int(word)]
        for come in others:
            changes += [(copies, int(where[f]), sign) for sign, side in ((-1, gone), (1, come)) for f in side if where[f] >= 0]
            copies += 1
    sr, sf, sign = (np.array(x) for x in zip(*changes, strict=True)) if changes else (np.empty(0, np.int64),) * 3
    # Each text is also seen with most of its features left out, so that one that tells
    # is enough. A toxic text that has lost all of them says nothing.
    draw = np.random.default_rng(0)
    rs, cs, weight, label = [r], [c], [np.ones(len(texts))], [toxic]
    for k in range(1, thinned + 1):
        some = draw.random(len(r)) < kept
        left = np.bincount(r[some], minlength=len(texts)) > 0
        rs.append(r[some] + k * len(texts)), cs.append(c[some]), label.append(toxic)
        weight.append(np.where((toxic > 0) & ~left, 0.0, 1.0))
    r, c, weight, label = (np.concatenate(x) for x in (rs, cs, weight, label))
    weight /= weight.sum()
    m, n = len(features), len(texts)
    w = np.zeros(m + 1)  # the last is the bias
    w[m] = np.log(n1 / n0)
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):  # Adam over the whole sample, with a falling rate
        p = 1 / (1 + np.exp(-(np.bincount(r, w[c], len(weight)) + w[m])))
        err = (p - label) * weight
        grad = np.append(np.bincount(c, err[r], m) + ridge / n * w[:m], err.sum())
        if len(sr):
            change = np.bincount(sr, sign * w[sf], copies) * 2 * fairness / copies
            grad[:m] += np.bincount(sf, sign * change[sr], m)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        rate = 0.2 * (1 - (step - 1) / steps)
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Model(features, w[:m], float(w[m]))


def _identity(terms) -> np.ndarray:
    """The features of all identity terms."""
    return np.array(sorted({f for gone, others in _swaps(terms).values() for side in (gone, *others) for f in side}), np.int64)


def log_odds(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of texts given by their features."""
    table = np.zeros(1 << BITS)
    table[model.features] = model.weights
    return np.array([table[t].sum() for t in texts]) + model.bias


def cross_validate(texts: list[np.ndarray], toxic: np.ndarray, settings: list[dict], folds: int = 4, threshold: float = THRESHOLD) -> list[tuple[float, float, float]]:
    """For each setting of train() the mean log loss, and precision and recall at the
    threshold, over texts that a model of the other folds scores. Settings are chosen
    by this, from training texts alone."""
    fold = np.arange(len(texts)) % folds
    out = []
    for setting in settings:
        odds = np.zeros(len(texts))
        for f in range(folds):
            model = train([t for t, x in zip(texts, fold, strict=True) if x != f], toxic[fold != f], **setting)
            odds[fold == f] = log_odds(model, [t for t, x in zip(texts, fold, strict=True) if x == f])
        p = np.clip(1 / (1 + np.exp(-odds)), 1e-9, 1 - 1e-9)
        said = p >= threshold
        caught = float((said & (toxic > 0)).sum())
        out.append((float(-np.mean(np.where(toxic > 0, np.log(p), np.log(1 - p)))), caught / max(1, said.sum()), caught / max(1, (toxic > 0).sum())))
    return out


def score(model: Model, column) -> np.ndarray:
    """Probability that each text is toxic."""
    table = np.zeros(1 << BITS)
    table[model.features] = model.weights
    wanted = np.zeros(1 << BITS, bool)
    wanted[model.features] = True
    out = np.zeros(len(column))
    for lo, hi, row, feature in _distinct(column, wanted):
        out[lo:hi] = np.bincount(row, table[feature], hi - lo)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -500, 500)))


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(key, text, toxic) of about `sample_rows` labelled documents that are not held out.
    A doc_id with several labels counts as toxic if one of them says so, null labels are
    left out, and a text counts once."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__gr_toxic"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where(remainder(F.col("doc_id")) != 1)
    share = min(1.0, sample_rows / max(1, chosen.count()))
    # The sample is bounded by sample_rows, at 12 bytes a row.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.where(spread < share)), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.max("__gr_toxic").cast("int").alias("toxic"))


def texts_of(sample: DataFrame, wanted: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The features (all, or those wanted) and labels of a sample, in the order of keys."""
    keep = None
    if wanted is not None:
        keep = np.zeros(1 << BITS, bool)
        keep[wanted] = True

    def run(batches):
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            found = [np.empty(0, np.int64)] * batch.num_rows
            for lo, hi, row, feature in _distinct(column("text"), keep):
                cut_ = np.searchsorted(row, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    found[lo + k] = feature[cut_[k] : cut_[k + 1]]
            sizes = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column("k"), column("toxic"), lists], names=["k", "toxic", "f"])

    got = sample.mapInArrow(run, "k long, toxic int, f array<int>").toArrow()
    order = np.argsort(np.asarray(got.column("k")))
    lists = got.column("f").combine_chunks() if got.num_rows else None
    return [np.asarray(lists[int(k)].values) for k in order], np.asarray(got.column("toxic"))[order]


def _presence(batches):
    """(feature, texts, toxic texts) of one partition."""
    seen, bad = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        toxic = np.asarray(batch.column(batch.schema.get_field_index("toxic")))
        for lo, _, row, feature in _distinct(batch.column(batch.schema.get_field_index("text")), None):
            np.add.at(seen, feature, 1)
            np.add.at(bad, feature, (toxic[lo + row] > 0).astype(np.int64))
    some = np.flatnonzero(seen)
    for at in range(0, len(some), 1 << 16):
        f = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(seen[f]), pa.array(bad[f])], names=["f", "n", "bad"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, terms=IDENTITY_TERMS, least_texts: int = LEAST_TEXTS, least_deviations: float = LEAST_DEVIATIONS, most: int = MOST_FEATURES, **options) -> Model:
    """A model from the labelled documents that are not held out: whole texts of about
    `sample_rows` of them. Features are counted and chosen first; `most` (the size of the
    model) and the sample bound what comes to the driver."""
    ship(docs.sparkSession)
    sample = cut(sampled(docs, labels, sample_rows))
    counted = sample.mapInArrow(_presence, "f int, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow()
    seen, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    seen[np.asarray(counted.column("f"))], bad[np.asarray(counted.column("f"))] = np.asarray(counted.column("n")), np.asarray(counted.column("bad"))
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    features = telling(seen, bad, n1, n - n1, least_texts, least_deviations, most) if 0 < n1 < n else np.empty(0, np.int64)
    texts, toxic = texts_of(sample, np.union1d(features, _identity(terms)))
    return train(texts, (toxic > 0).astype(float), features, terms=terms, **options)


def assess(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with held_out, score and predicted (1 if score >= threshold). The
    caller's columns of these names are replaced.

    Only the text enters a score. A null or empty text has no features and scores as
    the model's bias says, as does any text without a known feature. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    base = replacing(docs, *RESULTS).withColumn("held_out", held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `most` features and the identity terms

    def run(batches):
        for batch in batches:
            s = score(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    scored = base.mapInArrow(run, base.withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
