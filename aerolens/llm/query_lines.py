from pyspark.sql import functions as F

from aerolens.llm import lines
from aerolens.llm.queries import query, read

#: Runs are compared as texts here, without any naming: for each line the shortest runs of 10 words that start or end there.
SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), lined AS (
  SELECT doc_id, line, value, len(regexp_extract_all(value, '[^\x20\x09-\x0D]+')) AS words FROM split
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i,
    sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM lined WHERE words > 0
), runs AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 9
    AND b.upto - a.upto + a.words >= 10 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 9 AND b.i
    AND b.upto - a.upto + a.words >= 10 GROUP BY b.doc_id, b.i
), texts AS (
  SELECT r.doc_id, r.i, r.j, string_agg(p.value, chr(10) ORDER BY p.i) AS run FROM runs r JOIN placed p ON p.doc_id = r.doc_id AND p.i BETWEEN r.i AND r.j GROUP BY ALL
), later AS (
  SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM texts) WHERE n > 1
), gone AS (
  SELECT DISTINCT p.doc_id, p.line FROM later l JOIN placed p ON p.doc_id = l.doc_id AND p.i BETWEEN l.i AND l.j
), rebuilt AS (
  SELECT l.doc_id, count(*) FILTER (WHERE l.words > 0) AS n_lines, count(g.line) AS n_removed,
    coalesce(string_agg(l.value, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM lined l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN rebuilt r ON r.doc_id = d.doc_id
"""


@query("op2_line_dedup", SQL)
def op2_line_dedup(spark, sf_dir):
    rows = lines.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
