import hashlib

from pyspark.sql import DataFrame, functions as F

from aerolens.llm import conversations
from aerolens.llm.queries import query, read


#: The least audit of each state, row by row, instead of any halving; the checksum is worked out bit by bit.
SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS name FROM conversations
), hit AS (
  SELECT * EXCLUDE name, xor(4294967295::BIGINT, list_reduce(name, lambda c, b: list_reduce(range(8),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END, xor(c, ascii(b)::BIGINT)), 4294967295::BIGINT)) % 20 AS hit
  FROM (SELECT * EXCLUDE name, list_transform(name, lambda b: b) AS name FROM given)
), kept AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE hit <> 0
), placed AS (
  SELECT conv_id, turn, role, text, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM kept
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id
), written AS (SELECT * FROM (VALUES ('', 'u', 'user:'), ('s', 'u', 'user:'), ('u', 'a', 'assistant:'), ('a', 'u', 'user:')) AS t(state, next, line)
), inserted AS (
  SELECT state AS start, state, 0 AS k, '' AS lines FROM written
  UNION ALL SELECT a.state, a.next, 1, a.line || chr(10) FROM written a
  UNION ALL SELECT a.state, b.next, 2, a.line || chr(10) || b.line || chr(10) FROM written a JOIN written b ON b.state = a.next
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'done': ''} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'done': done}) FROM (
    SELECT w.conv_id, w.i + 1 AS i, CASE e.edit WHEN 'D' THEN n.state WHEN 'R' THEN t.next ELSE f.initial END AS state,
      w.best.cost + 2 * n.k + CASE e.edit WHEN 'D' THEN 3 ELSE (e.edit = 'R')::BIGINT * 2 + (f.fault = 'truncated')::BIGINT END AS cost,
      w.best.audit || repeat('I', n.k) || e.edit AS audit,
      w.best.done || n.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'R' THEN t.line || f.text || chr(10) ELSE f.role || ':' || f.text || chr(10) END AS done
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserted n ON n.start = w.state
    JOIN written t ON t.state = n.state JOIN (VALUES ('D'), ('K'), ('R')) AS e(edit)
      ON e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR f.initial = t.next OR (n.state = '' AND f.initial = 's')))
  ) GROUP BY conv_id, i, state
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 2 * n.k, 'audit': w.best.audit || repeat('I', n.k), 'done': w.best.done || n.lines}) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserted n ON n.start = w.state AND n.state IN ('', 'a') GROUP BY w.conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(CASE WHEN e.best.done <> '' THEN left(e.best.done, length(e.best.done) - 1) ELSE '' END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as the contract damages them, by the remainder of a checksum of conversation and turn."""
    given = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = given.withColumn("hit", F.crc32(F.concat_ws(":", *name)) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "hit")
    return out.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "hit")


def _hashed(rows, task):
    conv, digest = None, None
    for row in rows:
        if row["conv"] != conv:
            if conv is not None:
                yield {"conv": conv, "repaired_sha256": digest.hexdigest()}
            conv, digest = row["conv"], hashlib.sha256()
        digest.update(("\n" * (row["place"] > 0) + row["role"] + ":" + row["text"]).encode())
    if conv is not None:
        yield {"conv": conv, "repaired_sha256": digest.hexdigest()}


@query("op11_repair_conversations", SQL)
def op11_repair_conversations(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    repair = conversations.Repair(damaged(rows))
    whole = rows.select("conv_id").distinct().withColumn("conv", conversations.conversation_key(F.col("conv_id")))
    # The repaired rows of a conversation lie together and in order, so that they are hashed as they pass.
    digests = conversations._mapped(repair.rows(), _hashed, "conv string, repaired_sha256 string")
    out = whole.join(repair.report(), "conv", "left").join(digests, "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
