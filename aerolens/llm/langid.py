"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded by its code point. An n-gram is bound into one
vector: the letters' vectors, rolled by their place, are multiplied. A text's profile is the sum (bundle) of its n-grams'
vectors, a language's prototype the sum over its training texts; a text is given the language of the largest cosine.
Characters that are not letters become one blank, so n-grams see word ends.

Prototypes are sums over all training rows, made per task and added up by (language, place), which Spark combines before
the shuffle. Prototypes are `dims` numbers for each language, and go to the tasks with the code; languages are few by nature,
and more than `max_langs` raise an error. Texts are worked on whole, in Arrow batches.

Defined cases: a text that is null or has no letter is `und` with score 0; without any training row every text is `und`;
a null language is not learned from; a null doc_id is held out; equal cosines go to the first language in order; an empty
table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerolens.llm import common

UNKNOWN = "und"
BITS = 21
#: n-grams multiplied at once.
BLOCK = 16_384


def letters_only(text: str) -> np.ndarray:
    """Code points in lower case, each run of other characters one 0, a 0 at both ends; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, at = np.unique(points, return_inverse=True)
    alpha = np.fromiter((chr(k).isalpha() for k in kinds.tolist()), bool, len(kinds))
    if not alpha.any():
        return np.empty(0, np.int64)
    points = np.concatenate([[0], np.where(alpha[at], points, 0), [0]])
    return points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]


def grams_of(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed into whole numbers, and their counts."""
    points = letters_only(text) if text else np.empty(0, np.int64)
    if len(points) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    packed = np.zeros(len(points) - n + 1, np.int64)
    for k in range(n):
        packed = (packed << BITS) | points[k : len(points) - n + 1 + k]
    return np.unique(packed, return_counts=True)


class Vectors:
    """Vectors of letters and n-grams, made when they are first met; a task keeps at most `keep` n-grams."""

    def __init__(self, n: int, dims: int, seed: int, keep: int = 20_000):
        self.n, self.dims, self.seed, self.keep = n, dims, seed, keep
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((0, dims), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims).astype(np.int8) * 2 - 1
        return self.letters[point]

    def bound(self, gram: int) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for k in range(self.n):
            point = (gram >> (BITS * (self.n - 1 - k))) & ((1 << BITS) - 1)
            out = out * np.roll(self.letter(point), k)
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """One row for each of the distinct n-grams."""
        new = [g for g in grams.tolist() if g not in self.rows]
        if len(self.rows) + len(new) > self.keep:
            self.rows, self.table, self.letters, new = {}, self.table[:0], {}, grams.tolist()
        if new:
            self.rows |= {g: len(self.rows) + i for i, g in enumerate(new)}
            self.table = np.concatenate([self.table, np.stack([self.bound(g) for g in new]).astype(np.float32)])
        return self.table[[self.rows[g] for g in grams.tolist()]]


def _profiles(texts: list[str | None], n: int, vectors: Vectors) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, profiles) of groups of texts that are multiplied at once."""
    at, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(grams_of(text, n))
        size += len(group[-1][0])
        if size >= 60_000 or len(group) == 256 or i == len(texts) - 1:
            if size:
                grams, where = np.unique(np.concatenate([g for g, _ in group]), return_inverse=True)
                counts = np.zeros((len(group), len(grams)), np.float32)
                counts[np.repeat(np.arange(len(group)), [len(g) for g, _ in group]), where] = np.concatenate([c for _, c in group])
                profile = np.zeros((len(group), vectors.dims), np.float32)
                for a in range(0, len(grams), BLOCK):
                    profile += counts[:, a : a + BLOCK] @ vectors.of(grams[a : a + BLOCK])
                yield at, profile
            else:
                yield at, np.zeros((len(group), vectors.dims), np.float32)
            at, group, size = i + 1, [], 0


def prototypes(docs: DataFrame, n: int = 3, dims: int = 1024, seed: int = 42, max_langs: int = 512) -> dict[str, np.ndarray]:
    """Language to prototype, from the text and non-null lang of all rows that are not held out."""
    train = docs.where(~common.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(n, dims, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, rows in _profiles(batch.column("text").to_pylist(), n, vectors):
                for k, lang in enumerate(langs[at : at + len(rows)]):
                    sums[lang] = sums.get(lang, 0) + rows[k].astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dims), pa.array(range(dims), pa.int32()), pa.array(total, pa.int64())], ["lang", "place", "value"]
            )

    parts = train.mapInArrow(run, "lang string, place int, value long")
    table = common.stored(parts.groupBy("lang", "place").agg(F.sum("value").alias("value")), "prototypes")
    langs = table.select("lang").distinct().limit(max_langs + 1).count()
    if langs > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    out: dict[str, np.ndarray] = {}
    for row in table.collect():  # at most max_langs * dims numbers
        out.setdefault(row.lang, np.zeros(dims))[row.place] = row.value
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def predict(docs: DataFrame, known: dict[str, np.ndarray], n: int = 3, seed: int = 42) -> DataFrame:
    """Every row with doc_id, held_out, lang_pred, score (the cosine, at least 0) and margin over the next language."""
    names = list(known)
    dims = len(next(iter(known.values()))) if known else 1
    unit = np.stack([v / np.linalg.norm(v) for v in known.values()]).astype(np.float32) if known else np.zeros((0, dims), np.float32)
    rows = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("margin", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(n, dims, seed)
        for batch in batches:
            lang, score, margin = [], [], []
            for _, profile in _profiles(batch.column("text").to_pylist(), n, vectors):
                long = np.linalg.norm(profile, axis=1)
                some = (np.abs(profile).max(axis=1) > 0) & bool(names)
                cos = (profile @ unit.T) / np.maximum(long, 1e-9)[:, None] if names else np.zeros((len(profile), 1))
                cos = np.clip(cos.astype(float), 0.0, 1.0)
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(cos)), best]
                rest = np.partition(cos, -2, axis=1)[:, -2] if cos.shape[1] > 1 else np.zeros(len(cos))
                lang += [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
                score += np.where(some, top, 0.0).tolist()
                margin += np.where(some, top - rest, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "margin"],
            )

    return rows.mapInArrow(run, schema)
