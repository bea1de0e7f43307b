from aerolens.llm import exact_dedup
from aerolens.llm.queries import query, read

SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
  sha256(t) AS text_sha256
FROM bare
"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(read(spark, sf_dir, "documents"))
