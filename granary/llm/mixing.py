"""Mixing to target weights by soft membership.

A naive Bayes classifier, fitted on the labelled table, gives each document a
posterior over domains. Rates r >= 0 are then fitted to the documents by projected
gradient descent on the least squares of

    sum over documents of r * tokens * posterior[d]  -  target[d]

over all domains d: r <- max(0, r - step * posterior . miss), each document weighing as
its tokens. The miss is a number for each domain, so a pass over the data sums up a few
numbers, and a document's rate follows from its posterior and the misses so far. Steps
are the inverses of the eigenvalues of the documents' Gram matrix in turn, the shortest
first, each of which removes the miss in one direction as long as no rate is cut off at
0; a step that does not descend is taken back and the shortest one is made, which
always does. All of it is DataFrame work; the driver sees one row a domain.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WHITE_SPACE, cut, let, replacing, words

#: The default target: shares of tokens.
WEIGHTS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
#: Hash space of words, and the informative ones that the model keeps.
WORD_SPACE, MOST_WORDS = 1 << 24, 512
#: Bins of each plain statistic.
BINS = 12
#: Passes over the data at most, and the miss (as a share of all target tokens) that ends them.
PASSES, PRECISION = 60, 1e-9
RESULTS = ("n_tokens", "domain", "rate", "copies")


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic: toxic, else high or low by quality.
    Rows with a null where it matters are left out; of several labels of one
    document the last in alphabetical order counts."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _features(docs: DataFrame) -> DataFrame:
    """Adds __gr: n (tokens), b (distinct word hashes) and s (bins of statistics)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.size(F.split(text, pattern)) - 1

    def of(ws):
        n = F.size(ws)
        hashes = F.array_distinct(F.transform(ws, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(WORD_SPACE)).cast("int")))

        def packed(b):
            some = F.greatest(F.char_length(text), F.lit(1))
            lines = F.split(text, "\n")
            share = lambda x, of_: F.least(F.floor(x * F.lit(BINS) / of_), F.lit(BINS - 1)).cast("int")
            stats = F.array(
                share(count(r"[#*$%&|<>]") * 8, some),
                share(count(r"[A-Z]") * 2, some),
                share(F.size(b), F.greatest(n, F.lit(1))),
                share(F.size(F.array_distinct(lines)), F.size(lines)),
                F.least(F.floor(F.log2(n + F.lit(1.0))), F.lit(BINS - 1)).cast("int"),
                F.least(F.floor(F.char_length(text) / F.greatest(n, F.lit(1))), F.lit(BINS - 1)).cast("int"),
            )
            return F.struct(n.cast("bigint").alias("n"), b.alias("b"), stats.alias("s"))

        return let(hashes, packed)

    return docs.withColumn("__gr", let(words(text, WHITE_SPACE), of))


class Classifier:
    """Log-probabilities for each domain: of the prior and all informative words being
    absent, of the bins of each statistic, and the log-odds of a word's presence."""

    def __init__(self, domains: list[str], prior: list[float], stats: list[list[list[float]]], found: dict[int, list[float]]):
        self.domains, self.prior, self.stats, self.found = domains, prior, stats, found

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = 20_000, most_words: int = MOST_WORDS) -> Classifier:
        """Fits to about `sample_rows` labelled documents, chosen by a hash of doc_id. The
        model keeps the `most_words` most telling words."""
        n = labelled.count()
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        chosen = labelled.where(spread < min(1.0, sample_rows / max(n, 1))).where(F.col("domain").isin(domains))
        # The sample is bounded by sample_rows, at some 20 bytes a row.
        rows = cut(_features(docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("domain", "__gr_d")), "doc_id")).select(F.col("__gr_d").alias("d"), "__gr.b", "__gr.s"))
        size = dict(rows.groupBy("d").count().collect())
        total = sum(size.values())
        k = len(domains)
        prior = [math.log((size.get(d, 0) + 1) / (total + k)) for d in domains]
        width = 6
        stats = [[[math.log(1 / (size.get(d, 0) + BINS))] * BINS for d in domains] for _ in range(width)]
        for d, i, v, m in rows.select("d", F.posexplode("s").alias("i", "v")).groupBy("d", "i", "v").count().collect():
            stats[i][domains.index(d)][v] = math.log((m + 1) / (size[d] + BINS))
        each = [F.count_if(F.col("d") == d).alias(f"c{j}") for j, d in enumerate(domains)]
        seen = F.lit(0)
        for j in range(k):
            seen = seen + F.col(f"c{j}")
        score = F.lit(0.0)
        for j, d in enumerate(domains):
            share = size.get(d, 0) / max(total, 1)
            score = F.greatest(score, (F.col(f"c{j}") - seen * share) / F.sqrt(seen * (share * (1 - share)) + F.lit(1e-9)))
        words_ = rows.select("d", F.explode("b").alias("w")).groupBy("w").agg(*each).withColumn("seen", seen).where("seen >= 4").withColumn("score", score)
        top = words_.orderBy(F.desc("score"), "w").limit(most_words)  # the model's size, not a cut of data
        share = {r["w"]: [(r[f"c{j}"] + 0.5) / (size.get(d, 0) + 1) for j, d in enumerate(domains)] for r in top.collect()}
        # Absent words count too: all are taken as absent, and a present one makes up for it.
        prior = [prior[j] + sum(math.log(1 - v[j]) for v in share.values()) for j in range(k)]
        found = {w: [math.log(x / (1 - x)) for x in v] for w, v in share.items()}
        return cls(domains, prior, stats, found)

    def posterior(self) -> Column:
        """array<double> over the domains, from __gr."""
        b, s = F.col("__gr.b"), F.col("__gr.s")
        const = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
        k = len(self.domains)
        names = sorted(self.found)
        known = const(names, "array<int>")
        logs = const({str(w): self.found[w] for w in names}, "map<string,array<double>>")

        def word_part(present, j):
            return F.aggregate(present, F.lit(0.0), lambda acc, w: acc + F.get(F.element_at(logs, w.cast("string")), F.lit(j)))

        def of(present):
            scores = []
            for j in range(k):
                total = F.lit(self.prior[j])
                for i, table in enumerate(self.stats):
                    total = total + F.get(const(table[j], "array<double>"), F.get(s, F.lit(i)))
                if names:
                    total = total + word_part(present, j)
                scores.append(total)

            def softmax(x):
                e = [F.exp(F.get(x, F.lit(j)) - F.array_max(x)) for j in range(k)]
                return let(F.array(*e), lambda y: F.transform(y, lambda v: v / F.aggregate(y, F.lit(0.0), lambda a, c: a + c)))

            return let(F.array(*scores), softmax)

        return let(F.array_intersect(b, known), of)


def _rate(steps: list[list[float]], start: float) -> Column:
    """The rate of a posterior p: the starting rate, less p times each step and projected
    on what is not negative after each."""
    p, rate = F.col("__gr_p"), F.lit(float(start))
    for step in steps:
        moved = rate
        for j, m in enumerate(step):
            moved = moved - F.get(p, F.lit(j)) * F.lit(float(m))
        rate = F.greatest(F.lit(0.0), moved)
    return rate


def solve(rows: DataFrame, targets: list[float]) -> tuple[list[list[float]], float, list[float]]:
    """Steps, starting rate and token totals reached for rows of __gr_p and n_tokens.

    Projected gradient descent on half the squared miss; see the module. Two steps between
    which no rate was cut off are one, so the list stays short."""
    k = len(targets)
    n, p, want = F.col("n_tokens"), F.col("__gr_p"), np.array(targets, float)
    part = lambda j: F.get(p, F.lit(j))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    start = float(want.sum()) / total if total else 0.0

    def gram(values) -> np.ndarray:
        out = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                out[i, j] = out[j, i] = next(values)
        return out

    def measured(steps):
        """Token totals, the Gram matrices of documents with a rate above 0 and of all,
        and how many documents have none."""
        r = rows.withColumn("r", _rate(steps, start))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.sum(F.col("r") * n * part(j)) for j in range(k)]
        some = [F.sum(F.when(F.col("r") > 0, n * part(i) * part(j)).otherwise(0.0)) for i, j in pairs]
        every = [F.sum(n * part(i) * part(j)) for i, j in pairs]
        got = [float(x or 0.0) for x in r.agg(*sums, *some, *every, F.count_if((F.col("r") <= 0) & (n > 0))).first()]
        rest = iter(got[k:])
        return np.array(got[:k]), gram(rest), gram(rest), got[-1]

    steps: list[list[float]] = []
    reached, active, whole, cut_off = measured(steps)
    shortest = 1 / max(np.linalg.eigvalsh(whole).max(initial=0.0), 1e-300)
    lengths: list[float] = []
    for _ in range(PASSES):
        miss = reached - want
        if not total or np.abs(miss).max(initial=0.0) <= PRECISION * max(1.0, want.sum()):
            break
        if not lengths:
            eigen = np.linalg.eigvalsh(active)[::-1]
            lengths = [1 / x for x in eigen if x > 1e-9 * max(eigen[0], 1e-300)] or [shortest]
        length = lengths.pop(0)
        tried = measured([*steps, list(length * miss)])
        if length > shortest and np.sum((tried[0] - want) ** 2) >= np.sum(miss**2):
            length, lengths = shortest, []
            tried = measured([*steps, list(length * miss)])
        if np.sum((tried[0] - want) ** 2) >= np.sum(miss**2):
            break  # as near as numbers go
        step = list(length * miss)
        if steps and not cut_off and not tried[3]:
            step = [a + b for a, b in zip(steps.pop(), step, strict=True)]
        steps.append(step)
        reached, active, _, cut_off = tried
    return steps, start, [float(x) for x in reached]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, sample_rows: int = 20_000, most_words: int = MOST_WORDS, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `docs` (all, if None) with n_tokens (words), p_<domain> for each domain of `weights`, domain (the
    likeliest), rate and copies. The caller's columns of these names are replaced.

    labelled: (doc_id, domain). weights: shares of tokens, scaled to sum to 1; budget:
    expected tokens of the mixture, by default those of `docs`. Domains without a
    labelled document keep their prior of one pseudo-document. copies rounds the rate
    up or down by a hash of the document, so that its mean is the rate. If no
    rates reach the targets, the nearest in least squares are taken. Rows of equal id and
    text are rounded alike.

    A null or empty text has no tokens and any rate leaves the totals as they are; it
    gets one all the same. Rows of a null doc_id are never labelled. An empty table
    gives no rows.
    """
    weights = WEIGHTS if weights is None else weights
    domains = sorted(weights)
    whole = sum(weights.values())
    base = replacing(docs, *RESULTS, *[f"p_{d}" for d in domains])
    model = Classifier.fit(base, labelled, domains, sample_rows, most_words)
    spread = F.pmod(F.xxhash64(F.lit(2), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = cut(_features(base).select(*[F.col(f"`{c}`") for c in (base.columns if carry is None else carry)], F.col("__gr.n").alias("n_tokens"), model.posterior().alias("__gr_p"), spread.alias("__gr_h")))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    want = float(total if budget is None else budget)
    steps, start, _ = solve(rows, [want * weights[d] / whole for d in domains])
    p = F.col("__gr_p")
    for j, d in enumerate(domains):
        rows = rows.withColumn(f"p_{d}", F.get(p, F.lit(j)))
    names = F.array(*[F.lit(d) for d in domains])
    return (
        rows.withColumn("domain", F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int")))
        .withColumn("rate", _rate(steps, start))
        .withColumn("copies", (F.floor("rate") + F.when(F.col("__gr_h") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
        .drop("__gr_p", "__gr_h")
    )


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as its copies say, with the given columns."""
    return mixed.where("copies > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), "copies")).alias("__gr_copy")).drop("__gr_copy")
