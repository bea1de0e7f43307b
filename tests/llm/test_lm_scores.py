import math
from collections import Counter

import pytest

from aerolens.llm import lm_scores
from aerolens.llm.queries import ORACLES, QUERIES
from tests.llm import edge
from tests.oracle import compare, connect


def brute(texts, order, backoff=0.4):
    docs = [(t or "").encode().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(w) for w in docs]
    whole = Counter()
    for c in own:
        whole.update(c)
    total = sum(map(len, docs))
    out = []
    for w, mine in zip(docs, own):
        rest = lambda g: whole[g] - mine[g]  # noqa: E731, B023

        def value(i):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):  # noqa: B023
                g = tuple(w[i - n + 1 : i + 1])  # noqa: B023
                if n > 1 and rest(g) > 0:  # noqa: B023
                    return factor * rest(g) / rest(g[:-1])  # noqa: B023
                if n > 1:
                    factor *= backoff
            others = total - len(w)  # noqa: B023
            one = rest((w[i],))  # noqa: B023
            return factor * (one / others if one else 1 / (others + 1))

        out.append(sum(math.log(value(i)) for i in range(len(w))) / len(w) if w else None)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_awkward_rows_against_brute_force(spark, order):
    texts = [t for t in edge.TEXTS if t is None or len(t) < 1000] + ["a b c d x y", "a b c d a b c d", "one two one two three"]
    docs = spark.createDataFrame(edge.rows_of(texts), edge.SCHEMA).repartition(3)
    got = {r.doc_id: r.score for r in lm_scores.score(docs, order=order, chunk_words=7, bucket_words=20).collect()}
    for k, want in enumerate(brute(texts, order)):
        assert got[k] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_long_text_and_empty(spark):
    rows = lm_scores.score(edge.awkward(spark)).collect()
    assert len(rows) == len(edge.TEXTS)
    assert lm_scores.score(edge.empty(spark)).count() == 0
    alone = lm_scores.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert alone.score == pytest.approx((0 + math.log(0.4)) / 2)


def test_query_against_sql(spark, sf):
    assert compare(QUERIES["op4_lm_score"](spark, sf), connect(sf), ORACLES["op4_lm_score"]) is None
