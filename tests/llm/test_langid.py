import numpy as np
import pytest

from aerolens.llm import langid
from aerolens.llm.queries import QUERIES
from tests.llm import edge


def slow_profile(text, n, dims, seed):
    """Bound and bundled one n-gram at a time."""
    letters, points = "", [0]
    for c in text.lower():
        if c.isalpha():
            points.append(ord(c))
            letters += c
        elif points[-1]:
            points.append(0)
    if not letters:
        return None
    points += [0] if points[-1] else []
    vector = lambda p: np.random.default_rng([seed, p]).integers(0, 2, dims) * 2 - 1
    out = np.zeros(dims)
    for i in range(len(points) - n + 1):
        bound = np.ones(dims)
        for k in range(n):
            bound = bound * np.roll(vector(points[i + k]), k)
        out += bound
    return out


def test_cosines_against_brute_force(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat, et le chien!", "fr"), ("zwei Hunde", "de"), ("a", "en"), ("12 !", "en"), (None, "fr"), ("und so", None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.prototypes(docs, dims=128)
    import zlib

    sums = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang and t and (p := slow_profile(t, 3, 128, 42)) is not None:
            sums[lang] = sums.get(lang, 0) + p
    assert {k: v.tolist() for k, v in known.items()} == {k: v.tolist() for k, v in sums.items()}
    for r in langid.predict(docs, known).collect():
        p = slow_profile(rows[r.doc_id][1] or "", 3, 128, 42)
        if p is None:
            assert r.lang_pred == "und" and r.score == 0
        else:
            cos = {k: max(0.0, float(p @ v / np.linalg.norm(p) / np.linalg.norm(v))) for k, v in sums.items()}
            assert r.score == pytest.approx(max(cos.values()), abs=1e-4) and cos[r.lang_pred] == pytest.approx(max(cos.values()), abs=1e-4)


def test_held_out_accuracy(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, sf).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(langs) and np.mean(held) >= 0.97


def test_awkward_rows_and_empty(spark):
    docs = edge.awkward(spark)
    rows = langid.predict(docs, langid.prototypes(docs)).collect()
    assert len(rows) == len(edge.TEXTS)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 2)) and all(0 <= r.score <= 1 for r in rows)
    assert langid.prototypes(edge.empty(spark)) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(edge.empty(spark), {}).count() == 0
    assert langid.predict(edge.empty(spark), {"en": np.ones(8)}).count() == 0


def test_more_grams_than_a_task_keeps():
    vectors = langid.Vectors(3, 32, 42, keep=50)
    texts = ["".join(chr(97 + (k * 7 + j) % 26) for j in range(k % 40)) for k in range(30)]
    got = np.concatenate([p for _, p in langid._profiles(texts, 3, vectors)])
    for t, p in zip(texts, got):
        want = slow_profile(t, 3, 32, 42)
        assert p.tolist() == ([0.0] * 32 if want is None else want.tolist())
