import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.llm import neighbours
from aerolens.llm.queries import QUERIES


def brute(ids, x, k=10, every=100):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = sorted((float(a), int(b)) for a, b in zip(d, ids) if b != i)[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute(rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float))
    got = answers(QUERIES["op8_nearest_vectors"](spark, sf))
    assert set(got) == set(want)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_all_lists_is_exact_with_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 6)).astype(float)
    x[100:220] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x) if r.any()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(neighbours.search(df, lambda i: i % 10 == 0, probes=1.0, epsilon=50.0, piece=16))
    want = brute([i for i, _ in rows], np.array([v for _, v in rows]), every=10)
    assert set(got) == set(want)
    for q in want:
        assert [v for _, v in got[q]] == [v for _, v in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [], 1), (7, [1.0, 3.0], 1), (None, [1.0, 2.5], 1), (0, [1.0, 2.0], 1), (100, [-1.0, 0.5], 1), (9, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, group int")
    got = answers(neighbours.search(df, lambda i: i % 100 == 0))
    assert {q: [v for _, v in a] for q, a in got.items()} == {0: [7, 100], 100: [0, 7]}
    assert neighbours.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert neighbours.search(df, lambda i: F.lit(False)).count() == 0
