import hashlib

from aerolens.llm import exact_dedup
from aerolens.llm.queries import ORACLES, QUERIES
from tests.llm import edge
from tests.oracle import compare, connect


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(b"".join((t or "").encode().split()), []).append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = []
    for bare, members in groups.items():
        best = min(members)
        keep = rows[best[3]][0]
        out += [(rows[m[3]][0], keep, len(members), hashlib.sha256(bare).hexdigest()) for m in members]
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str), rows


def test_small_blocks_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found, rows = got(exact_dedup.groups(docs, block_bytes=64))
    assert found == brute(plain)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_awkward_and_empty(spark):
    plain = list(zip(edge.IDS, edge.TEXTS))
    for size in (3, 4096):
        found, rows = got(exact_dedup.groups(edge.awkward(spark), block_bytes=size))
        assert found == brute(plain)
        assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert exact_dedup.groups(edge.empty(spark)).count() == 0


def test_query_against_sql(spark, sf):
    assert compare(QUERIES["op5_exact_dedup"](spark, sf), connect(sf), ORACLES["op5_exact_dedup"]) is None


def test_copies_in_many_batches(spark):
    """A block that several batches hold has one name, so copies meet across partitions."""
    plain = [(k, t) for k, t in enumerate(["same text", "other", "same\ttext ", "", None, "same text", "x" * 9, " ", "other"] * 3)]
    docs = spark.createDataFrame(plain, "doc_id long, text string").repartition(6, "doc_id")
    for size in (3, 4096):
        found, rows = got(exact_dedup.groups(docs, block_bytes=size))
        assert found == brute(plain)
        assert sum(r.kept for r in rows) == 4
