"""The corpus pipeline, from raw documents to shards.

Each stage calls one operator on all that its predecessor kept, and its decisions
take effect: documents that a stage rejects are gone. All stages but the last return
the columns of `documents`.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, langid, mixing, neardup, sharding
from granary.llm.common import cut, table
from granary.sources.scratch import made, release

#: A prediction of less than this posterior leaves the language in doubt.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, those whose language is in doubt, and longer ones that
    cost far more bits than texts of the nearest language, so are in none that was learned."""
    found = cut(langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang"))))
    known = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & ~langid.unlike(found))
    return known.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (5-word shingles, 0.8)."""
    return neardup.keep_one(docs, width=5, threshold=80).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), min_items=1)
    return marked.where("NOT contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that domains reach their shares of tokens."""
    out = mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")))
    return mixing.materialise(out, docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows to 16 shards of nearly equal bytes."""
    return sharding.shard_documents(docs)


#: Intermediate tables of the last stages that were called, in order.
_left: list[list[str]] = []


def _alone(stage):
    """`stage`, which first deletes the intermediate tables of the stage before the last:
    what that returned is written by then, as is what the last one returned."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while len(_left) > 1:
            release(spark, _left.pop(0))
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _left.append([p for p in made() if p not in before])
        return out

    return run_stage


STAGES = [
    ("language", _alone(language)),
    ("near_duplicates", _alone(near_duplicates)),
    ("decontaminated", _alone(decontaminated)),
    ("mixed", _alone(mixed)),
    ("sharded", _alone(sharded)),
]

#: Code lengths, hashes and fitted rates are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written before the next stage reads it,
    and goes once that one's result is written."""
    docs, read = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        before = set(made())
        docs = cut(result)
        release(spark, read)
        read = [p for p in made() if p not in before]
    return STAGES[-1][1](spark, docs, sf_dir)
