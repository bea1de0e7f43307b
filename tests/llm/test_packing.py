import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from aerolens.llm import packing
from aerolens.llm.queries import QUERIES
from tests.llm import edge

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, window=4096):
    """Every id in one piece, sequences without gaps; returns the share of padding."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    at, places = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(v) for i, v in ids.items()}
    padding = 0
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding / sum(map(len, ids.values()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(QUERIES["op9_pack_sequences"](spark, sf).collect(), texts) < 0.02


def test_awkward_rows_ids_and_empty(spark):
    texts = dict(enumerate([*edge.TEXTS, "<|endoftext|> x<|startoftext|>y", "Á é ́a ΑΣ ΑΣ\x1cb\x85c d", "don't 'S it's 123 4.5"]))
    docs = spark.createDataFrame(edge.rows_of(list(texts.values())), edge.SCHEMA)
    rows = packing.pack(docs, PATH, keep_ids=True).collect()
    check(rows, texts)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(edge.empty(spark), PATH).count() == 0
    assert packing.pack(edge.awkward(spark), PATH).count() >= len(edge.TEXTS)


def test_least_squares_is_the_non_negative_optimum():
    rng = np.random.default_rng(4)
    for bins in (6, 12, 24):
        supply = np.concatenate([[0], rng.integers(0, 50, bins)])
        supply[bins] = 0
        combos = packing.combinations(supply)
        x = packing.repeat_counts(combos, supply, at_once=4)
        a = np.zeros((bins + 1, len(combos)))
        np.add.at(a, (combos.T, np.arange(len(combos))), 1.0)
        a[0] = 0
        gradient = a.T @ (supply - a @ x)
        # The conditions of an optimum: no count is negative, no unused combination would help, used ones are balanced.
        assert (x >= 0).all() and gradient.max(initial=0) < 1e-3 and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-3


def test_combinations_and_plan_use_everything():
    rng = np.random.default_rng(5)
    for _ in range(5):
        supply = np.concatenate([[0], rng.integers(0, 40, 32)])
        combos = {tuple(sorted(int(b) for b in c if b)) for c in packing.combinations(supply)}
        some = [int(b) for b in np.flatnonzero(supply)]
        want = {tuple(sorted(c)) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(some, n) if sum(c) == 32}
        assert combos == want
        used = np.zeros_like(supply)
        for bins, n in packing.plan(supply):
            assert sum(bins) <= 32 and n > 0
            for b in bins:
                used[b] += n
        assert (used == supply).all()
