"""SQL of the same relations, for an engine that checks the results."""

from __future__ import annotations

LANES = 8
BASE = """
WITH RECURSIVE stream AS (SELECT doc_id AS file_id, doc_id % 3 AS version, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT file_id, version, h, unnest(range(0, CAST(ceil(length(h) / (2.0 * {size})) AS BIGINT))) AS chunk_no FROM stream),
cut AS (SELECT file_id, version, chunk_no, substr(h, 2 * {size} * chunk_no + 1, 2 * {size}) AS x FROM pieces),
chunk AS (SELECT version, file_id, chunk_no, row_number() OVER (ORDER BY version, file_id, chunk_no) - 1 AS seq,
  length(x) // 2 AS size, upper(sha1(unhex(x))) AS fp, x FROM cut),
stored AS (SELECT *, urank // {entries} AS cid, urank // 818 AS new_cid FROM (
  SELECT fp, seq, size, x, row_number() OVER (ORDER BY seq) - 1 AS urank FROM (
    SELECT *, row_number() OVER (PARTITION BY fp ORDER BY seq) AS k FROM chunk) WHERE k = 1)),
recipe AS (SELECT c.version, c.file_id, c.chunk_no, c.seq, c.size, c.fp, s.cid, c.seq > s.seq AS is_dup,
  c.seq - min(c.seq) OVER (PARTITION BY c.version) AS pos FROM chunk c JOIN stored s USING (fp)),
seg AS (SELECT *, seq // 128 AS segment_id FROM chunk)
"""


def base(size: int = 256, entries: int = 1169) -> str:
    return BASE.replace("{size}", str(size)).replace("{entries}", str(entries))
