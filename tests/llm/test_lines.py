import random

from aerolens.llm import lines
from aerolens.llm.queries import ORACLES, QUERIES
from tests.llm import edge
from tests.oracle import compare, connect


def brute(rows, min_words):
    """Deletes every line of every run of at least `min_words` words that an earlier place has. rows: (doc_id, text), in order."""
    docs = []
    for i, t in rows:
        split = t.split("\n") if t is not None else []
        docs.append((i, t, split, [k for k, line in enumerate(split) if line.encode().split()]))
    first = {}
    runs = []
    for d, (_, _, split, places) in enumerate(docs):
        for a in range(len(places)):
            words = 0
            for b in range(a, len(places)):
                words += len(split[places[b]].encode().split())
                if words >= min_words:
                    key = tuple(split[p] for p in places[a : b + 1])
                    runs.append((d, a, b, key))
                    first.setdefault(key, (d, a))
                if b - a > 25:
                    break
    gone = {(d, p) for d, a, b, key in runs if first[key] != (d, a) for p in docs[d][3][a : b + 1]}
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(split) if (d, k) not in gone)) for d, (i, t, split, _) in enumerate(docs)]


def test_random_lines_against_all_runs(spark):
    rng = random.Random(5)
    pool = [" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 5))) + f" {k}" * (k % 3 > 0) for k in range(25)]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"only {d} {k}" for k in range(rng.randint(0, 14)))) for d in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1] + "\n" + rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for min_words in (1, 4, 10):
        got = {r.row.doc_id: r.text for r in lines.deduplicated(docs, min_words).collect()}
        assert got == dict(brute(rows, min_words))


def test_awkward_rows_and_empty(spark):
    copy = "\n".join(f"line number {k} of a copied text" for k in range(12))
    texts = [None, "", "\n\n", copy, copy, "own line here with many words so that it would count\n\n" + copy + "\n\nend", edge.LONG, edge.LONG]
    docs = spark.createDataFrame(edge.rows_of(texts), edge.SCHEMA)
    out = {r.row.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == "\n\n"
    assert out[3].text == copy and out[4].text == "" and out[4].n_removed == 12
    assert out[5].text == "own line here with many words so that it would count\n\n\nend" and out[5].n_lines == 14
    assert out[6].text == edge.LONG and out[7].text == ""
    assert lines.deduplicated(edge.empty(spark)).count() == 0
    assert lines.deduplicated(edge.awkward(spark)).count() == len(edge.TEXTS)


def test_query_against_sql(spark, sf):
    assert compare(QUERIES["op2_line_dedup"](spark, sf), connect(sf), ORACLES["op2_line_dedup"]) is None
