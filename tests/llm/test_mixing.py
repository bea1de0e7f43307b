import random

import pytest

from aerolens.llm import mixing
from aerolens.llm.queries import QUERIES
from tests.llm import edge


def highest_quotients(votes, caps, seats):
    ranked = sorted((-v / (2 * s - 1), i, s) for i, v in enumerate(votes) for s in range(1, caps[i] + 1))[:seats]
    out = [0] * len(votes)
    for _, i, _ in ranked:
        out[i] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_apportionment_is_highest_quotients(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    votes = [rng.choice([1.5, 10.0, 100.7, rng.random() * 50]) for _ in range(n)]
    caps = [rng.randint(1, 60) for _ in votes]
    seats = rng.randint(0, sum(caps))
    df = spark.createDataFrame([("g", i, v, c, float(seats)) for i, (v, c) in enumerate(zip(votes, caps))], "g string, i int, v double, c long, n double")
    got = [r.q for r in mixing.apportioned(df, ["g"], ["i"], "v", "c", "n", "q").orderBy("i").collect()]
    assert got == highest_quotients(votes, caps, seats)


def expected_targets(sizes):
    """Sources in order, sharing again and again what those above their cap leave over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {s: 0.0 for s in names}, set()
    while total > 1e-9 and len(full) < len(names):
        open_weight = sum(weights[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] += total * weights[s] / open_weight
        total = 0.0
        for s in names:
            if target[s] > 2 * sizes[s]:
                total += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def check(rows, words_of):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == words_of(r) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = expected_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= 64 + 0.02 * want[s]
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_mix_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = mixing.mix(docs).collect()
    check(rows, lambda r: len((texts[r.doc_id] or "").encode().split()))
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_many_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    check(mixing.mix(docs, block=4).collect(), lambda r: len((texts[r.doc_id] or "").encode().split()))


def test_awkward_and_empty(spark):
    rows = mixing.mix(edge.awkward(spark)).collect()
    assert len(rows) == len(edge.TEXTS)
    assert sum(r.taken for r in rows if r.size == 0) == 0
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert mixing.mix(edge.empty(spark)).count() == 0
    assert mixing.mixed(edge.empty(spark)).count() == 0
    nothing = mixing.mix(edge.awkward(spark).where("text IS NULL OR trim(text) = ''")).collect()
    assert nothing and all(r.target == 0 and r.taken == 0 for r in nothing)


def test_texts_follow_what_is_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {k: v for k, v in taken.items() if v}


def test_query_columns(spark, sf):
    assert QUERIES["op1_mix_sources"](spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]
