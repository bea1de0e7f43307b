"""The n-gram join against all pairs of sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from aerolens.llm import ngram_join
from aerolens.llm.queries import QUERIES
from tests.llm import edge


def grams(text, n=5):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for a, b in {p for own in where.values() for p in combinations(own, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op12_ngram_jaccard_join"](spark, sf)) == brute(rows)


def crowds():
    """Families of near copies, an original in the middle of its copies, texts around the threshold, texts of shared passages alone."""
    rng = random.Random(11)
    word = lambda k=400: f"w{rng.randrange(k)}"
    texts = []
    for size, length, changes in ((60, 200, 3), (40, 80, 1), (30, 500, 12), (25, 12, 1), (20, 300, 4)):
        base = [word() for _ in range(length)]
        copies = []
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(changes + 1)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(3)] = [word() for _ in range(rng.randrange(3))]
            copies.append(" ".join(own))
        copies.insert(size // 2, " ".join(base))
        texts += copies
    passages = [" ".join(word() for _ in range(30)) for _ in range(8)]
    for _ in range(150):
        texts.append(" ".join(rng.sample(passages, rng.randrange(2, 6))))
    for k in range(40):  # pairs near the threshold
        base = [word(5000) for _ in range(104)]
        texts += [" ".join(base), " ".join(base[: 104 - rng.randrange(15, 26)] + [word(5000) for _ in range(rng.randrange(0, 5))])]
    texts += texts[:30] + ["", None, "a b c", "A b  c", "a b c d e", "e d c b a"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("sets, sent", [(64, 4_000_000), (3, 0)])
def test_crowds_in_small_tries(spark, monkeypatch, sets, sent):
    monkeypatch.setattr(ngram_join, "SETS", sets)
    monkeypatch.setattr(ngram_join, "SENT", sent)
    rows = crowds()
    df = spark.createDataFrame([(*r, 1, 1, "b", 1) for r in rows], "doc_id long, text string, row int, n int, digest string, rank int").repartition(5)
    assert result(ngram_join.near_components(df)) == brute(rows)


def test_awkward_rows_and_an_empty_table(spark):
    table = edge.awkward(spark)
    assert result(ngram_join.near_components(table)) == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert result(ngram_join.near_components(edge.empty(spark))) == []


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(2)
    for trial in range(60):
        base = rng.choice(80, 30, replace=False)
        rows = []
        for k in range(25):
            own = np.unique(np.concatenate([rng.choice(base, rng.integers(15, 31), replace=False), rng.choice(80, rng.integers(0, 4))]))
            rows.append({"id": k, "n": len(own) + int(rng.integers(0, 3)), "group": k, "build": trial % 2 == 0 or k < 10, "probe": trial % 2 == 0 or k >= 5, "ranks": own})
        seen = {frozenset(p) for p in ngram_join.links_of_unit([dict(r) for r in rows], 80)}
        alike = {frozenset((a["id"], b["id"])) for a, b in combinations(rows, 2) if (a["build"] and b["probe"] or a["probe"] and b["build"]) and 180 * len(np.intersect1d(a["ranks"], b["ranks"])) >= 80 * (a["n"] + b["n"])}

        def groups(links):
            name = list(range(25))
            for _ in range(25):
                for a, b in map(sorted, links):
                    name[a] = name[b] = min(name[a], name[b])
            return name

        assert groups(seen) == groups(alike) and seen <= alike
