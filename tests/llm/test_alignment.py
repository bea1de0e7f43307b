"""Alignment of two tokenizers against whole texts encoded at once, with plain counts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolens.llm import alignment
from aerolens.llm.queries import QUERIES
from tests.llm import edge

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    both = alignment.Tokenizers(*PATHS)
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    found = []
    for text in texts:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            ab, bb = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                ends = [np.cumsum([len(t) for t in x]).tolist() for x in (ab, bb)]
                last = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    now = [ends[0].index(end, last[0]) + 1, ends[1].index(end, last[1]) + 1]
                    groups.append((a[last[0] : now[0]], b[last[1] : now[1]]))
                    last = now
        found.append(groups)
    counts = Counter(p for groups in found for p in {(x, y) for a, b in groups for x in a for y in b})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    for groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        name = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(name.encode()).hexdigest() if groups else "",
        )


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op13_align_tokenizers"](spark, sf)) == sorted((d.doc_id, *v) for d, v in zip(docs, brute([d.text for d in docs])))


ODD = [
    "a  b", " a", "a ", "  ", " ", "\n", "x\n y", "tab\t z", "  a b", "▁x y", "<s> </s> <|endoftext|> <0x41> <unk>", "don't we'll I'M", "1234 567,89", "　 日本語 中文", "a\r\nb \x0b\x0c c", "\x1c \x85 x",
    "\U0001f600\U0001f601 é ﬁ", "     five", "end   ", "=" * 300 + " " * 100 + "-" * 37, "Zz" * 5000, "\x00 a",
]


@pytest.mark.parametrize("slice_pairs, chunk", [(alignment.SLICE, alignment.CHUNK), (500, 40)])
def test_awkward_texts(spark, monkeypatch, slice_pairs, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    texts = [None, "", *ODD, *ODD[:5], *(t for t in edge.TEXTS if t is None or len(t) < 10_000)]
    table = spark.createDataFrame([(k, t, 1, "b", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, row int, bucket string, pairs string, n_a long").repartition(5)
    assert rows_of(alignment.align(table, *PATHS, slice_pairs)) == sorted((k, *v) for k, v in enumerate(brute(texts)))


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 1000)
    assert [p for parts in alignment.stretches(edge.LONG, 1000) for p in parts] == edge.LONG.split(" ")
    text = edge.LONG[:60_000] + "  \n end"
    table = spark.createDataFrame([(1, text), (None, text[:5000])], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(table, *PATHS).collect()}
    want = list(brute([text, text[:5000]]))
    assert got == {1: want[0], None: want[1]}


def test_parts_are_encoded_as_whole_texts_are(sf):
    import pyarrow.parquet as pq

    both = alignment.Tokenizers(*PATHS)
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    for text in [*ODD, *pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]:
        if "▁" not in text:
            a, b = both.encoded([p for parts in alignment.stretches(text) for p in parts])
            assert sum(a, []) == both.bytewise.encode(" " + text, add_special_tokens=False).ids and sum(b, []) == second.encode(text)


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 31, n).astype("<u4"))
        sizes, bits = alignment.perfect_hash(keys)
        at = alignment.Places([sizes], [bits])(keys, np.zeros(len(keys), np.int64))
        assert sorted(at.tolist()) == list(range(len(keys)))


def test_empty_table(spark):
    assert rows_of(alignment.align(edge.empty(spark), *PATHS)) == []


def test_merges_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "CHUNK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        texts = [f"one two {k % 3} three" for k in range(20)]
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        assert rows_of(alignment.align(table, *PATHS)) == sorted((k, *v) for k, v in enumerate(brute(texts)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
