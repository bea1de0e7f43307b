import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.llm import common, toxicity
from aerolens.llm.queries import QUERIES
from tests.llm import edge


@pytest.mark.parametrize("lengths", [[1], [4], [1, 3, 2], [5, 1]])
def test_marginals_against_all_tag_sequences(lengths):
    rng = np.random.default_rng(sum(lengths))
    n = sum(lengths)
    emission, moves, start = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.zeros(n, bool)
    first[np.cumsum([0, *lengths])[:-1]] = True
    weight, ones, steps = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        s = sum(emission[t] * y + (start[y] if first[t] else moves[tags[t - 1], y]) for t, y in enumerate(tags))
        w = math.exp(s)
        weight += w
        ones += w * np.array(tags)
        for t in range(n):
            if not first[t]:
                steps[t, tags[t - 1], tags[t]] += w
    p, pair, log_sum = toxicity.marginals(emission, first, moves, start)
    assert p == pytest.approx(ones / weight)
    assert pair == pytest.approx(steps / weight)
    assert log_sum == pytest.approx(math.log(weight))


def test_learns_words_and_beginnings(spark):
    rng = np.random.default_rng(1)
    clean = [f"c{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = [clean[k] for k in rng.integers(0, 400, 30)]
        bad = i % 4 == 0
        if bad:
            words[5] = "slurword"
            words[9] = "badstem" + str(rng.integers(10_000))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.row.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, y in labels)
    a, b = map(int, got[0].spans.split(",")[0].split(":"))
    assert rows[0][1][a:b] == "slurword"
    unseen = spark.createDataFrame([(1, "c1 c2 badstemxyz c3"), (2, "new clean words")], "doc_id long, text string")
    scores = {r.row.doc_id: r.score for r in toxicity.scored(unseen, model).collect()}
    assert scores[1] >= 0.7 and scores[2] < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert not any(p for p, y in held if y == 0)
    assert sum(p for p, y in held if y == 1) >= 0.75 * sum(y for _, y in held)


def test_awkward_rows_no_labels_and_empty(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = edge.awkward(spark)
    for marks in (labels, labels.limit(0)):
        rows = toxicity.scored(docs, toxicity.fit(docs, marks)).collect()
        assert len(rows) == len(edge.TEXTS) and all(r.score == 0.0 and r.spans == "" for r in rows)
    model = toxicity.Model({"=one": 5.0}, np.zeros((2, 2)), np.zeros(2), True)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(edge.TEXTS) and all(r.score == 0.0 for r in rows if not (r.text or "").strip())
    assert any(r.spans == "0:3" for r in rows if r.text == "one")
    assert toxicity.scored(edge.empty(spark), model).count() == 0


def test_fold_of_ids(spark):
    import zlib

    rows = spark.range(200).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
