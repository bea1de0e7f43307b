from aerolens.llm import ngram_join
from aerolens.llm.queries import query, read

#: All pairs that share a shingle, as texts, are counted; links are followed from each document to all it reaches.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shares AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shares JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS origin, a AS node FROM ways UNION SELECT r.origin, e.b FROM reach r JOIN ways e ON e.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT origin, min(node) AS least FROM reach GROUP BY origin) c ON c.origin = d.doc_id
"""


@query("op12_ngram_jaccard_join", SQL)
def op12_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_components(read(spark, sf_dir, "documents"))
