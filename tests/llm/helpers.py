"""Small tables with every awkward row."""

import random

from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ba", "do", "mi", "re", "fa", "so", "la", "ti") for b in ("n", "r", "s", "k", "lo", "nu", "pe", "vi")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward(spark: SparkSession):
    """Nulls in any column, empty and very long texts, copies, repeated rows, and
    columns that clash with results in name."""
    long_ = prose(1, 30_000)
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n ", "de", None, None), (4, prose(4, 80), "en", "s", 1),
        (5, prose(4, 80), "en", "s", 1), (5, prose(4, 80), "en", "s", 1), (6, long_, None, "s", 2), (None, prose(7, 60), "de", "s", 3),
        (None, None, None, None, None), (8, "!!! ??? 123", "fr", "s", 4), (9, "éÉ ÀÉ straße", "fr", "s", 5), (10, "a", "en", "s", 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("Size", "shard", "score", "KEPT", "n_words", "law", "domain", "rate", "held_out", "predicted", "contaminated", "__x"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark: SparkSession):
    return awkward(spark).limit(0)
