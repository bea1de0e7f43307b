from pyspark.sql import functions as F

from aerolens.llm import lm_scores
from aerolens.llm.queries import query, read

SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
), pairs AS (
  SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words
), one AS (SELECT word, count(*) AS n FROM words GROUP BY 1), own_one AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY 1, 2),
two AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY 1, 2),
own_two AS (SELECT doc_id, before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY 1, 2, 3),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1), whole AS (SELECT count(*) AS n FROM words),
counted AS (
  SELECT p.doc_id, p.before, w.n - s.n AS others, o.n - oo.n AS c1, b.n - ob.n AS c2, f.n - of_.n AS c0
  FROM pairs p CROSS JOIN whole w JOIN sizes s ON s.doc_id = p.doc_id
  JOIN one o ON o.word = p.word JOIN own_one oo ON oo.doc_id = p.doc_id AND oo.word = p.word
  LEFT JOIN two b ON b.before = p.before AND b.word = p.word LEFT JOIN own_two ob ON ob.doc_id = p.doc_id AND ob.before = p.before AND ob.word = p.word
  LEFT JOIN one f ON f.word = p.before LEFT JOIN own_one of_ ON of_.doc_id = p.doc_id AND of_.word = p.before
), valued AS (
  SELECT doc_id, CASE WHEN c2 > 0 THEN c2 / c0::DOUBLE ELSE
    (CASE WHEN before IS NULL THEN 1.0 ELSE 0.4 END)::DOUBLE * (CASE WHEN c1 > 0 THEN c1 / others::DOUBLE ELSE 1 / (others + 1)::DOUBLE END) END AS v FROM counted
)
SELECT d.doc_id, coalesce(a.n_words, 0) AS n_words, round(a.score, 6) + 0e0 AS score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_words, avg(ln(v)) AS score FROM valued GROUP BY 1) a ON a.doc_id = d.doc_id
"""


@query("op4_lm_score", SQL)
def op4_lm_score(spark, sf_dir):
    rows = lm_scores.score(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", F.round("score", 6).alias("score"))
