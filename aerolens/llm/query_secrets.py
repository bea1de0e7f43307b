from pyspark.sql import functions as F

from aerolens.llm import secrets
from aerolens.llm.queries import query, read


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_letters, ("password", "passwd", "secret", "token"))) + "|" + _letters("api") + "_?" + _letters("key")
_FORMS = [
    (r"(" + _WORDS + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    (secrets.ACCESS, 0),
    (secrets.HEX, 0),
    (secrets.BARE, 0),
]
_EACH = "\nUNION ALL ".join(
    f"SELECT doc_id, source, {no} AS no, string_split_regex(t, '{form}') AS gaps, regexp_extract_all(t, '{form}', 0) AS ms, regexp_extract_all(t, '{form}', {group}) AS vs FROM texts"
    for no, (form, group) in enumerate(_FORMS)
)
#: Positions as running sums, owners and documents counted over all candidates. (Tests hold the patterns against the open ones in Python.)
SQL = f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), each AS ({_EACH}),
rows AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM each),
placed AS (
  SELECT doc_id, source, no, ms[i] AS m, vs[i] AS v, sum(length(gaps[i]) + length(ms[i])) OVER (PARTITION BY doc_id, no ORDER BY i) AS e FROM rows
), found AS (
  SELECT doc_id, source, no, v, e - length(m) AS s, e FROM placed WHERE CASE no WHEN 0 THEN length(v) >= 6 WHEN 1 THEN true WHEN 2 THEN true
    ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') END
), owners AS (SELECT v, count(DISTINCT coalesce('s' || source, 'none')) <= 2 AND count(DISTINCT coalesce('d' || doc_id, 'none')) <= 5 AS few FROM found GROUP BY 1),
spans AS (
  SELECT f.*, o.few AS live FROM found f JOIN owners o ON o.v = f.v
  WHERE f.no < 3 OR (o.few AND NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.no < 3 AND b.s < f.e AND f.s < b.e))
), listed AS (
  SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'bare'][no + 1] || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans,
    string_agg(['assign', 'access', 'hex'][no + 1] || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (WHERE no < 3) AS base,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM spans GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id
"""


@query("op3_secret_scan", SQL)
def op3_secret_scan(spark, sf_dir):
    rows = secrets.scan(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"), "n_live", "n_example",
    )
