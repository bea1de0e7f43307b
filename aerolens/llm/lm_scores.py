"""Stupid-backoff scores of documents from n-gram counts over all documents.

The count of every n-gram (orders 1 to `order`) is taken over the whole corpus. A word's score is the count of the longest
n-gram that ends with it, over the count of that n-gram without the word, with a factor `backoff` for each order given up; a
document's score is the mean logarithm. A document does not vouch for itself: its own counts are taken off first, so a text
that shares nothing with the rest scores lowest. A word the rest does not have counts as one in that many words plus one.

n-grams are 64-bit hashes. A chunk of documents (an Arrow batch, or part of one of about `chunk_words` words) lists its distinct
n-grams once, which is the exploded table after map-side combination; they are shuffled in blocks by the leading bits of the
hash, each bucket of the count table sums its n-grams over all chunks, and the sums go back to the chunks, where each document
adds up its own. A very common n-gram is one entry for each chunk. Buckets grow in number with the corpus, so that
one holds about `bucket_words` words' n-grams; a chunk's documents meet their counts in a group bounded by the chunk.

Defined cases: a null text, or one without words, has no words and a null score; repeated rows are documents that vouch for
one another; with one document alone all its words are unseen; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from aerolens.llm import common

KEPT_WORDS = 500_000
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _packed(values: np.ndarray) -> bytes:
    """The bytes of numbers, place by place, compressed: small numbers have mostly empty places."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def _unpacked(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[4]
    return h ^ (h >> np.uint64(29))


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hashes of the n-grams that end at each word; 0 where the document has too few words before it."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for n in range(1, order + 1):
        h = np.full(len(words), n, np.uint64)
        for k in range(n - 1, -1, -1):
            h = _mix(h * _ODD[0] + np.concatenate([np.zeros(k, np.uint64), words[: len(words) - k]]))
        h[h == 0] = np.uint64(1)
        h[place < n - 1] = 0
        out.append(h)
    return out


def chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """One row for each chunk: its documents' ids and numbers of words, and its words as places in a list of word hashes."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = StructType().add("chunk", LongType()).add("doc_ids", ArrayType(kind)).add("lengths", ArrayType(IntegerType())).add("hashes", BinaryType()).add("n", LongType()).add("words", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, known = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at, lengths, found, size = 0, [], [], 0
            for i, text in enumerate(texts):
                words = text.split() if text else []
                if len(known) > KEPT_WORDS:
                    known.clear()
                for w in set(words):
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w)
                found += [known[w] for w in words]
                lengths.append(len(words))
                size += len(words)
                if size >= chunk_words or i == len(texts) - 1:
                    hashes, places, n = np.unique(np.array(found, np.uint64), return_inverse=True, return_counts=True)
                    order = np.argsort(-n, kind="stable")  # common words get small places
                    rank = np.empty(len(order), np.int32)
                    rank[order] = np.arange(len(order), dtype=np.int32)
                    hashes, places = hashes[order], rank[places]
                    part = ids.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk], pa.int64()),
                            pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part),
                            pa.array([lengths], pa.list_(pa.int32())),
                            pa.array([hashes.tobytes()], pa.binary()),
                            pa.array([len(places)], pa.int64()),
                            pa.array([_packed(places)], pa.binary()),
                        ],
                        ["chunk", "doc_ids", "lengths", "hashes", "n", "words"],
                    )
                    chunk, at, lengths, found, size = chunk + 1, i + 1, [], [], 0

    return rows.mapInArrow(run, schema)


def _grams_of(hashes: bytes, words: bytes, lengths, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    lengths = np.asarray(lengths, np.int64)
    return grams(np.frombuffer(hashes, np.uint64)[_unpacked(words, np.int32)], lengths, order), lengths


def score(docs: DataFrame, order: int = 2, backoff: float = 0.4, chunk_words: int = 1_000_000, bucket_words: int = 2_000_000) -> DataFrame:
    """Every row with doc_id, n_words, and score: the mean log score of its words, null if it has none."""
    spark = docs.sparkSession
    table = common.stored(chunks(docs, chunk_words), "chunks")
    total = table.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(common.partitions(spark, total, bucket_words)))))
    shift = np.uint64(64 - bits)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, _ = _grams_of(row["hashes"], row["words"], row["lengths"], order)
                keys, n = np.unique(np.concatenate([g[g > 0] for g in found]), return_counts=True)
                if not len(keys):
                    continue
                n = n.astype(np.int32)
                steps = np.diff(keys, prepend=np.uint64(0))  # of sorted keys, smaller numbers than the keys
                bucket = (keys >> shift).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                some = bucket[np.concatenate([[0], cut])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array([row["chunk"]] * len(some), pa.int64()),
                        pa.array([k[0] for k in np.split(keys, cut)], pa.uint64()).view(pa.int64()),
                        pa.array([_packed(k[1:]) for k in np.split(steps, cut)], pa.binary()),
                        pa.array([_packed(k) for k in np.split(n, cut)], pa.binary()),
                    ],
                    ["bucket", "chunk", "first", "steps", "n"],
                )

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(np.concatenate([np.array([f], np.int64).view(np.uint64), _unpacked(k, np.uint64)])) for f, k in zip(rows["first"], rows["steps"])]
        keys = np.concatenate(parts)
        n = np.concatenate([_unpacked(k, np.int32) for k in rows["n"]])
        _, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, n)[place].astype(np.int64)
        cut = np.cumsum([len(k) for k in parts])[:-1]
        return pd.DataFrame({"bucket": rows["bucket"], "chunk": rows["chunk"], "sums": [_packed(s) for s in np.split(sums, cut)]})

    id_kind = table.schema["doc_ids"].dataType.elementType
    out_schema = StructType().add("doc_id", id_kind).add("n_words", LongType()).add("score", "double")

    def finished(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in left.itertuples():
            found, lengths = _grams_of(row.hashes, row.words, row.lengths, order)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            mean = np.full(len(lengths), np.nan)
            if len(doc):
                keys = np.unique(np.concatenate([g[g > 0] for g in found]))
                sums = np.concatenate([_unpacked(s, np.int64) for s in right.sort_values("bucket")["sums"]])
                rest = []  # for each order, the count of each word's n-gram in the other documents
                for g in found:
                    have = g > 0
                    at = np.searchsorted(keys, g[have])
                    _, same, own = np.unique(doc[have] * np.int64(len(keys)) + at, return_inverse=True, return_counts=True)
                    c = np.zeros(len(g))
                    c[have] = sums[at] - own[same]
                    rest.append(c)
                others = (total - lengths)[doc].astype(float)
                value = np.where(rest[0] > 0, rest[0] / np.maximum(others, 1), 1 / (others + 1))
                for n in range(2, order + 1):
                    before = np.concatenate([[0.0], rest[n - 2][:-1]])  # the n-gram without its last word
                    seen = rest[n - 1] > 0
                    value = np.where(seen, rest[n - 1] / np.where(seen, before, 1.0), np.where(found[n - 1] > 0, backoff * value, value))
                sums_of = np.bincount(doc, np.log(value), len(lengths))
                mean = np.divide(sums_of, lengths, out=mean, where=lengths > 0)
            parts.append(pd.DataFrame({"doc_id": pd.Series(list(row.doc_ids), dtype=object), "n_words": lengths, "score": pd.Series(mean).astype(object).where(lengths > 0, None)}))
        return pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "n_words": [], "score": []})

    blocks = table.mapInArrow(exploded, "bucket long, chunk long, first long, steps binary, n binary")
    counts = blocks.groupBy("bucket").applyInPandas(summed, "bucket long, chunk long, sums binary")
    return table.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(finished, out_schema)
