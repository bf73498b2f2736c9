"""Queries of the training-data operators, as (spark, sf_dir) -> DataFrame, and SQL
for those that SQL can express."""

from __future__ import annotations

from granary.llm import chat, decontaminate, htmlextract, langid, licenses, mixing, neardup, quality, sharding, toxicity
from granary.llm.common import table


def op1_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")), carry=["doc_id"])


def op3_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_chat(spark, sf_dir):
    return chat.chat(table(spark, sf_dir, "conversations"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.assess(docs, carry=["doc_id"]).select("doc_id", *quality.BASE, "kept", "perplexity")


def quality_base(spark, sf_dir):
    """The columns of op5_quality that SQL can say."""
    return quality.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *quality.BASE)


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", *langid.RESULTS)


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.assess(docs, model).select("doc_id", *toxicity.RESULTS)


def op7_html(spark, sf_dir):
    return htmlextract.extract_articles(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def op9_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_shard, op2_mix, op3_decontaminate, op4_chat, op5_quality, quality_base, op6_language, op7_html, op8_licenses, op9_near_duplicates, op10_toxicity)
}
ORACLES: dict[str, str] = {}

ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM ds),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit GROUP BY doc_id),
pos AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit)),
cov AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id)
"""

ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM ov JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op4_chat"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id),
d AS (SELECT ts, len(ts) AS n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY ts),
longest AS (SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.ts[1] = a.ts[1] AND b.n > a.n AND b.ts[1:a.n] = a.ts)),
held AS (SELECT a.conv_id, sum(b.copies) - 1 AS n_collapsed FROM longest a JOIN d b ON a.ts[1] = b.ts[1] AND b.n <= a.n AND a.ts[1:b.n] = b.ts GROUP BY a.conv_id)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, CAST(n_collapsed AS BIGINT) AS n_collapsed,
  array_to_string(list_transform(ts, lambda x: '<|im_start|>' || x.role || chr(10) || replace(replace(x.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10)), '') AS text
FROM longest JOIN held USING (conv_id)
"""

ORACLES["quality_base"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM again GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
"""


def _license_sql() -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in licenses.pack())
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
    cut = "unnest(range(1, greatest(len(w) - 3, 2))) AS i"
    return f"""
WITH tw AS (SELECT template_id, license, {split} FROM (VALUES {quoted}) v(template_id, license, text)),
dw AS (SELECT doc_id, {split} FROM documents),
ts AS (SELECT DISTINCT template_id, license, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT template_id, license, w, {cut} FROM tw WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, {cut} FROM dw WHERE len(w) > 0)),
n AS (SELECT template_id, count(*) AS n_template FROM ts GROUP BY 1),
m AS (SELECT doc_id, template_id, license, count(*) AS n_shared FROM ds JOIN ts USING (g) GROUP BY ALL)
SELECT doc_id, template_id, license, n_shared, n_template FROM m JOIN n USING (template_id) WHERE 100 * n_shared >= 80 * n_template
"""


ORACLES["op8_licenses"] = _license_sql()
