import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from aerolens.llm import graph, simhash
from aerolens.llm.queries import QUERIES
from tests.llm import edge


def slow_fingerprint(text, n=3, seed=42):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def expected(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = components(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op6_simhash_near_dedup"](spark, sf)) == expected(rows)


def test_near_copies_awkward_rows_and_empty(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = list(edge.TEXTS[:3])
    for _ in range(40):
        words = list(base)
        words[rng.randrange(400)] = "changed"
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + list(zip(edge.IDS, edge.TEXTS))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = found(simhash.near_groups(docs))
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len(got) - 20
    assert simhash.near_groups(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 32])
def test_links_of_crowded_keys(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {x if x < 2**63 else x - 2**64: x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df, bucket).collect()]
    assert all((signed[a] ^ signed[b]).bit_count() <= 2 for a, b in edges)
    want = components(signed, lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    linked = set(edges)
    got = components(signed, lambda a, b: (a, b) in linked or (b, a) in linked)
    parts = lambda root: {frozenset(n for n in root if root[n] == r) for r in root.values()}
    assert parts(got) == parts(want)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(3, 3)]
    random.Random(1).shuffle(edges)
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 300)]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_each(spark, sf):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows, family = [], {}
    for f in range(12):
        base = [vocabulary[int(3000 * rng.random() ** 3)] for _ in range(rng.choice([60, 150, 700]))]
        for c in range(6 if f < 8 else 1):
            words = list(base)
            for _ in range(int(len(words) * 0.015) if c else 0):
                words[rng.randrange(len(words))] = "new" + str(rng.random())
            family[len(rows)] = f
            rows.append((len(rows), " ".join(words), 5))
    rows += [(1000, rows[0][1].upper(), 5), (1001, None, 5), (1002, " ", 5), (None, "some other short text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept)) and 1001 in kept and 1002 not in kept and None in kept and 1000 not in kept
    texts = {i: t for i, t, _ in rows if t and t.strip()}
    root = components([i for i in texts if i is not None], lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    left = [sum(i in kept for i in g) for g in groups.values()]
    assert min(left) >= 1  # no text without near copies goes
    assert np.mean([n == 1 for n in left]) >= 0.9  # fingerprints find nearly all
    assert simhash.one_of_each(edge.awkward(spark)).count() == 7
    assert simhash.one_of_each(edge.empty(spark)).count() == 0


def near_pairs(texts, low=0.8, high=1.01):
    """Pairs of numbers of texts whose five-word shingles are alike, found through the shingles they share."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holds, both = {}, Counter()
    for k, s in enumerate(sets):
        for x in s:
            for j in holds.setdefault(x, []):
                both[j, k] += 1
            holds[x].append(k)
    out = {}
    for (j, k), n in both.items():
        if low <= (v := n / (len(sets[j]) + len(sets[k]) - n)) < high:
            out[j, k] = v
    return out


def kept_of(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.one_of_each(docs, **more).select("doc_id").collect())


def changed(rng, words, n):
    out = list(words)
    for k in range(n):
        out[rng.randrange(k * len(out) // n, (k + 1) * len(out) // n)] = f"new{rng.random()}"
    return out


def test_recall_over_true_pairs_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 alone: at three bits more of them are found than at two."""
    rng = random.Random(17)
    texts = []
    for _ in range(300):
        base = [f"v{int(3000 * rng.random() ** 3)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(changed(rng, base, 4))]
    pairs = [p for p in near_pairs(texts, 0.8, 0.85)]
    assert len(pairs) >= 100
    recall = {}
    for name, more in (("default", {}), ("two", {"distance": 2}), ("three", {"distance": 3})):
        kept = set(kept_of(spark, texts, **more))
        recall[name] = np.mean([not (a in kept and b in kept) for a, b in pairs])
    assert recall["default"] == recall["three"] > recall["two"], recall


def star_of_copies(copies, words, seed=5):
    """Copies of a text, each about 0.86 alike to it and 0.73 to each other, the text itself in their middle; and its place."""
    rng = random.Random(seed)
    base = [f"v{int(3000 * rng.random() ** 3)}" for _ in range(words)]
    texts = [" ".join(changed(rng, base, words * 3 // 200)) for _ in range(copies)]
    return texts[: copies // 2] + [" ".join(base)] + texts[copies // 2 :], copies // 2


def reached(texts, bits, seeds=(42, 43, 44)):
    """How many are left if all pairs of alike texts whose fingerprints are near for one of the seeds are linked."""
    prints = [[slow_fingerprint(t, 1, s) for s in seeds] for t in texts]
    near = {p for p in near_pairs(texts) if any((a ^ b).bit_count() <= bits for a, b in zip(prints[p[0]], prints[p[1]]))}
    root = components(range(len(texts)), lambda a, b: (b, a) in near)
    return len(set(root.values()))


def test_original_in_the_middle_of_its_copies(spark):
    texts, _ = star_of_copies(60, 200)
    left = len(kept_of(spark, texts))
    assert left == reached(texts, 3), left


def crowd(n, words=200, shared=0.75, seed=8):
    """Texts that share so much of their words, and pairs of near copies among them."""
    rng = random.Random(seed)
    base = [f"v{int(3000 * rng.random() ** 3)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        own = changed(rng, base, int(words * (1 - shared) / 5))
        texts += [" ".join(own), " ".join(changed(rng, own, 2))]
    return texts


def test_few_texts_are_compared_in_a_crowd_that_is_not_alike(spark, monkeypatch):
    """Pairs that cannot be alike are ruled out by their sketches, and none that is alike; groups are joined all the same."""
    texts = crowd(30)
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    both = spark.createDataFrame(pairs, "x long, y long")
    sketches = simhash._sketches(rows, 5)
    alike = set(near_pairs(texts))
    likely = {(r.x, r.y) for r in simhash._likely(both, sketches, 0.8).collect()}
    assert alike <= likely and len(likely) < 0.2 * len(pairs) and len(alike) >= 30
    assert {(r.a, r.b) for r in simhash._alike(both, rows, 5, 0.8).collect()} == alike
    none = spark.createDataFrame([], "node long, root long")
    want = components(range(60), lambda a, b: (b, a) in alike or (a, b) in alike)
    for at_once, each in ((10_000, 64), (1, 1)):
        monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(simhash, "AT_ONCE", each)
        root = {k: k for k in range(60)} | {r.node: r.root for r in simhash._connected(both, none, rows, sketches, 5, 0.8).collect()}
        parts = lambda root: {frozenset(n for n in root if root[n] == r) for r in root.values()}
        assert parts(root) == parts(want)


def test_tables_too_long_to_be_sent_never_go_to_the_driver(spark, monkeypatch):
    """An index that is exploded from few bytes, and keys that are many: neither is gathered, and no row is lost."""
    texts = crowd(25)
    kept = kept_of(spark, texts)
    prints = spark.createDataFrame([(k, 0, slow_fingerprint(t, 1) - 2**63) for k, t in enumerate(texts)], "row long, seed int, fp long")
    few = sorted(map(tuple, simhash._crowds(prints, 3, 0).select("key", "fp").collect()))
    monkeypatch.setattr(simhash, "KEYS_SENT", 0)
    monkeypatch.setattr(simhash, "SIEVE_WORDS", 4)
    crowds = simhash._crowds(prints, 3, 0)
    index = simhash._of_keys(simhash.variants(prints.select("fp"), 3), crowds.select("key").distinct())
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, crowds.select("key", "fp").collect())) == few and few
    assert kept_of(spark, texts) == kept
