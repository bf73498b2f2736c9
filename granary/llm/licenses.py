"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts are sequences of lower-cased words and are compared by 5-word shingles. Windows of
neighbouring shingles are compared by MinHash values, one for each band. What a window
is depends on the template's length (S shingles), so that a passage that keeps 80 % of
them shares a value for certain or almost so:

* S = 1: the shingle is the window.
* S = 2 to 8: windows of 2 shingles at every word, one band. At most one of five to
  eight shingles may be missing, so some pair is whole.
* longer ones up to 100 words: windows of 8 shingles, at every fourth word of a document
  and at every word of a template, 8 bands. A window with 80 of 100 shingles untouched
  has a Jaccard similarity of about 0.67 and misses all bands with a chance of
  0.33 ** 8, or 2e-4; such passages have several windows.
* above 100 words: the same windows and one band. An inserted, left out or changed word
  takes 4 or 5 shingles with it, so the losses allowed leave a run of 11 whole shingles
  (from 44 shingles on), and such a run has a window at a fourth word that is equal.

Documents that share a value with a template are then compared by exact containment:
the share of the template's distinct shingles that the document has.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import NOT_WORD, ascii_lower, bit_set, cut, in_bit_set, let, rows_of, words

WIDTH, THRESHOLD = 5, 80
#: Templates of up to so many shingles are looked up by pairs, and of up to so many words by all bands.
SHORT, LONG = 8, 100
#: Shingles of a window, words between the windows of a document, bands.
SHINGLES, STRIDE, BANDS = 8, 4, 8
#: The bit set of template values: so many bits for each, of which three are set, and
#: values up to which there is one (2**21 bits). Those of larger packs are joined.
BITS_EACH, MOST_FILTERED = 256, 1 << 13
T1, T2 = "__gr_t1", "__gr_t2"

#: Notices and first sentences of well-known licenses, and tags.
TEMPLATES = [
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-grant", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0-grant", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0-notice", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("unlicense-notice", "Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Tags of five words or more; a shorter one ("SPDX-License-Identifier: MIT") is less than a shingle.
TAGS = ("Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0")


def pack() -> list[tuple[str, str, str]]:
    """(template_id, license, text): the notices, the tags, and the whole texts and
    headers of the folder license_texts, whose files are named license--kind.txt."""
    rows = [*TEMPLATES, *((f"{tag.lower()}-tag", tag, f"SPDX-License-Identifier: {tag}") for tag in TAGS)]
    for f in sorted((Path(__file__).parent / "license_texts").glob("*--*.txt")):
        name, kind = f.stem.split("--")
        rows.append((f"{name}-{kind}".lower(), name, f.read_text(encoding="utf-8")))
    return rows


def default_templates(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "template_id string, license string, text string", pack())


def _shingles(ws: Column) -> Column:
    """Hashes of 5-word shingles in order; a shorter text is one shingle."""
    many = F.transform(F.sequence(F.lit(0), F.size(ws) - WIDTH), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(WIDTH)]))
    whole = F.array(F.xxhash64(F.size(ws), F.concat_ws(" ", ws)))
    return F.when(F.size(ws) >= WIDTH, many).when(F.size(ws) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _seed(band: int) -> int:
    x = (band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


#: One order of shingles for each band of long windows, and one for the pairs.
SEEDS, PAIR_SEED = [_seed(b) for b in range(BANDS)], _seed(BANDS)


def _windows(sh: Column, size: int, stride: int, seeds: list[int]) -> Column:
    """The MinHash values of all windows, bands after one another. A band orders shingles
    by xor with its seed, so a value tells its band as well."""
    starts = F.when(F.size(sh) >= size, F.sequence(F.lit(0), F.size(sh) - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))

    def band(seed: int) -> Column:
        flip = F.lit(seed).cast("bigint")
        return F.transform(starts, lambda i: F.least(*[F.get(sh, i + j).bitwiseXOR(flip) for j in range(size)]))

    return F.concat(*[band(seed) for seed in seeds])


def _text_words(text: str = "text") -> Column:
    return words(ascii_lower(F.col(text)), NOT_WORD)


def _values(sh: Column, test) -> Column:
    """A document's values that pass the test."""
    return F.concat(F.filter(sh, test), F.filter(_windows(sh, 2, 1, [PAIR_SEED]), test), F.filter(_windows(sh, SHINGLES, STRIDE, SEEDS), test))


def _retrieved(keyed: DataFrame, values: DataFrame, limit: int) -> DataFrame:
    """doc_id, text's hashes, values that may be of templates and distinct shingles, of
    documents with such a value. Up to `limit` values are a bit set that is tested where
    the text is; more are joined, and texts with a match are read again."""
    distinct = cut(values.select("v").distinct())
    n = distinct.count()
    of = lambda body: let(_text_words(), lambda ws: let(_shingles(ws), body))
    if n <= limit:
        bits = 1 << 12
        while bits < n * BITS_EACH:
            bits *= 2
        set_ = bit_set(distinct, "v", bits)
        found = of(lambda sh: let(_values(sh, lambda v: in_bit_set(set_, bits, v)), lambda h: F.struct(h.alias("hits"), F.when(F.size(h) > 0, F.array_distinct(sh)).alias("sh"))))
        return cut(keyed.select("doc_id", T1, T2, found.alias("x")).where(F.size("x.hits") > 0).select("doc_id", T1, T2, "x.hits", "x.sh"))
    sent = keyed.select(T1, T2, F.explode(F.array_distinct(of(lambda sh: _values(sh, lambda v: F.lit(True))))).alias("v")).distinct()
    held = cut(sent.join(distinct, "v", "left_semi").groupBy(T1, T2).agg(F.collect_list("v").alias("hits")))
    again = of(lambda sh: F.array_distinct(sh))
    return cut(keyed.join(held, [T1, T2]).select("doc_id", T1, T2, "hits", again.alias("sh")))


def scan(docs: DataFrame, templates: DataFrame, threshold: int = THRESHOLD, filtered: int = MOST_FILTERED) -> DataFrame:
    """(doc_id, template_id, license, n_shared, n_template) for each row of `docs` and
    each template of which it has at least `threshold` percent of the shingles.

    Null and empty texts, and templates without a word, match nothing. Rows of equal
    text match alike, so repeated rows and null ids keep their own result rows. Other
    columns of the caller are not read. Whole texts are scanned. filtered: see
    MOST_FILTERED; results do not depend on it.
    """
    t = templates.select("template_id", "license", _text_words().alias("ws")).where(F.size("ws") > 0).withColumn("sh", _shingles(F.col("ws")))
    t = cut(t.select("template_id", "license", F.size("ws").alias("n"), "sh"))
    sh, s, n = F.col("sh"), F.size("sh"), F.col("n")
    bands = F.when(s == 1, sh).when(s <= SHORT, _windows(sh, 2, 1, [PAIR_SEED])).when(n <= LONG, _windows(sh, SHINGLES, 1, SEEDS)).otherwise(_windows(sh, SHINGLES, 1, SEEDS[:1]))
    values = cut(t.select("template_id", F.explode(bands).alias("v")).distinct())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias(T1), F.xxhash64(F.lit(1), "text").alias(T2))
    hit = _retrieved(keyed, values, filtered)
    # One row for each distinct text from here on.
    texts = cut(hit.groupBy(T1, T2).agg(F.first("hits").alias("hits"), F.first("sh").alias("sh")))
    pairs = texts.select(T1, T2, F.explode("hits").alias("v")).join(values, "v").select(T1, T2, "template_id").distinct()
    shared = texts.select(T1, T2, F.explode("sh").alias("s")).join(t.select("template_id", F.explode(F.array_distinct("sh")).alias("s")), "s").groupBy(T1, T2, "template_id").agg(F.count("*").alias("n_shared"))
    sizes = t.select("template_id", "license", F.size(F.array_distinct("sh")).cast("bigint").alias("n_template"))
    matched = pairs.join(shared, [T1, T2, "template_id"]).join(sizes, "template_id").where(100 * F.col("n_shared") >= threshold * F.col("n_template"))
    return hit.select("doc_id", T1, T2).join(matched, [T1, T2]).select("doc_id", "template_id", "license", "n_shared", "n_template")
