"""Packing token sequences by non-negative least squares over shallow length combinations.

Documents are tokenised and closed with an end id; a document longer than the window is cut into full windows and a rest.
Piece lengths, counted in bins of `grain` tokens, make a histogram. All combinations of up to three bins that fill the window
exactly are the columns of a least-squares problem whose non-negative solution says how often each is repeated to use the
histogram up. The counts are rounded, held to what there is, and what is left over is packed greedily, largest first.

Only the histogram (window / grain bins) and the plan made from it pass through the driver. A piece knows its number among the
pieces of its bin: its number within its task, plus the pieces of earlier tasks (a window over tasks, one row for each). The
plan gives ranges of such numbers to the places of sequences. Offsets are sums within one sequence.

The tokeniser drops blanks, and none of its pieces spans one, so the ids of a text are those of its words in a row; a worker
keeps the ids of words it has met (up to a bound), which is what makes tokenising cheap.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows. Other
columns do not matter, whatever their names, unless they are carried.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aerolens.llm import common

END = 2
#: Words whose ids a worker process keeps, from task to task.
KEPT_WORDS = 1_000_000
#: Characters of the texts whose words are looked up at once.
TEXTS = 2_000_000


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by way of their words.

    Case does not matter to the tokeniser, so words are kept in lower case; texts with its special tokens keep their case. A word
    of ASCII letters is one piece of its pre-tokeniser and goes straight to the model, and so does one that a full stop or a
    comma follows, which are a piece of their own there; other words take the whole tokeniser.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, word: bytes) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(word.decode())])

    def _learn(self, words: Iterable[bytes]) -> None:
        known, other = self.known, []
        marks = dict(zip((b".", b","), self._whole([b".", b","])))
        for w in words:
            if w.isalpha() and w.islower():
                known[w] = self._letters(w)
            elif w[-1:] in marks and w[:-1].isalpha() and w[:-1].islower():
                known[w] = (known.get(w[:-1]) or self._letters(w[:-1])) + marks[w[-1:]]
            else:
                other.append(w)
        for at in range(0, len(other), 4096):
            known.update(zip(other[at : at + 4096], self._whole(other[at : at + 4096])))

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        words = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        met = set().union(*words)
        new = met.difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, new = {}, met
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def _in_groups(texts: list[bytes | None], ids_of: WordIds) -> Iterator[bytes]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= TEXTS or i == len(texts) - 1:
            yield from ids_of(texts[at : i + 1])
            at, size = i + 1, 0


def pieces(docs: DataFrame, path: str, window: int = 4096, grain: int = 8, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, its bin, task and number among the task's bin."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = rows.select("doc_id").schema
    for name, kind in _PIECE + ([("ids", "array<int>")] if keep_ids else []):
        schema = schema.add(name, _type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ids_of, seen = TaskContext.get().partitionId(), word_ids(path), np.zeros(window // grain + 2, np.int64)
        for batch in batches:
            out: dict[str, list] = {k: [] for k, _ in _PIECE}
            source, kept = [], []
            for i, found in enumerate(_in_groups(batch.column("text").to_pylist(), ids_of)):
                ids = np.frombuffer(found + END.to_bytes(4, "little"), "<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    b = -(-len(part) // grain)
                    for k, v in zip(out, (start, len(part), zlib.crc32(part.tobytes()), len(ids), b, task, seen[b])):
                        out[k].append(int(v))
                    seen[b] += 1
                    source.append(i)
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            arrays = [batch.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(out[k], pa.int64() if t == "long" else pa.int32()) for k, t in _PIECE)]
            names = ["doc_id", *out]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


_PIECE = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("bin", "int"), ("task", "int"), ("number", "long")]


def _type(kind: str):
    from pyspark.sql.types import ArrayType, IntegerType, LongType

    return {"long": LongType(), "int": IntegerType(), "array<int>": ArrayType(IntegerType())}[kind]


def combinations(supply: np.ndarray) -> np.ndarray:
    """All ways to fill a window of len(supply) - 1 bins with one, two or three bins that have pieces; 0 fills up the row."""
    w = len(supply) - 1
    some = np.flatnonzero(supply[1:]) + 1
    a, b = (x.ravel() for x in np.meshgrid(some, some, indexing="ij"))
    c = w - a - b
    three = (a >= b) & (b >= c) & (c > 0)
    three[three] = supply[c[three]] > 0
    two = (a >= b) & (a + b == w)
    rows = [np.column_stack([a[three], b[three], c[three]]), np.column_stack([a[two], b[two], 0 * a[two]])]
    if supply[w]:
        rows.append(np.array([[w, 0, 0]]))
    return np.concatenate(rows)


def repeat_counts(combos: np.ndarray, supply: np.ndarray, at_once: int = 32, rounds: int = 400, tolerance: float = 1e-6) -> np.ndarray:
    """Non-negative least squares by an active set: how often each combination is used to match the supply.

    Columns of the largest gradients join the active set, the set is solved, and a step towards that solution stops where a
    count reaches zero, which takes its column out again. The error falls with every step; `rounds` bounds their number.
    """
    h = supply.astype(float).copy()
    h[0] = 0.0
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    active: list[int] = []
    banned: set[int] = set()
    residual, width = h.copy(), at_once
    for _ in range(rounds):
        gradient = residual[combos].sum(axis=1)
        gradient[active] = 0.0
        gradient[list(banned)] = 0.0
        best = np.argsort(-gradient, kind="stable")[:width]
        best = [int(k) for k in best if gradient[k] > tolerance * max(1.0, h.max())]
        if not best:
            break
        active += best
        fresh = set(best)
        while active:
            a = np.zeros((len(h), len(active)))
            np.add.at(a, (combos[active].T, np.arange(len(active))), 1.0)
            a[0] = 0.0
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-9
            z = np.linalg.solve(gram, a.T @ h)
            if (z > 0).all():
                x[:] = 0.0
                x[active] = z
                break
            now = x[active]
            down = z <= 0
            new = np.array([k in fresh for k in active]) & down & (now == 0)
            if new.any():
                active = [k for k, out in zip(active, new) if not out]
                continue
            step = (now[down] / (now[down] - z[down])).min()
            now = np.maximum(now + step * (z - now), 0.0)
            now[down & (now < 1e-9)] = 0.0
            x[:] = 0.0
            x[active] = now
            active = [k for k, v in zip(active, now) if v > 0]
        # One column alone always joins, several may stand in each other's way; one that rounding keeps out is left out.
        joined = bool(fresh.intersection(active))
        if not joined and width == 1:
            banned |= fresh
        width = at_once if joined else 1
        a = x[active]
        residual = h.copy()
        np.add.at(residual, combos[active], -a[:, None])
        residual[0] = 0.0
    return x


def plan(supply: np.ndarray) -> list[tuple[list[int], int]]:
    """(bins of a sequence, repeats) that use the supply up; supply[b] pieces have bin b, the last bin fills a window."""
    w = len(supply) - 1
    left = supply.astype(np.int64).copy()
    combos = combinations(left)
    counts = repeat_counts(combos, left, tolerance=1e-3)
    out: list[tuple[list[int], int]] = []
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < 0.5:
            break
        bins = [int(b) for b in combos[k] if b]
        most = min(int(left[b]) // bins.count(b) for b in bins)
        n = min(int(round(counts[k])), most)
        if n:
            out.append((bins, n))
            for b in bins:
                left[b] -= n
    while left.any():  # the rest: the largest piece, then the largest that still fits
        bins, room, used = [], w, np.zeros_like(left)
        while room:
            fits = np.flatnonzero(left[: room + 1] > used[: room + 1])
            if not len(fits):
                break
            b = int(fits[-1])
            times = min(room // b, int(left[b] - used[b]))
            bins += [b] * times
            used[b] += times
            room -= b * times
        n = max(1, int((left[used > 0] // used[used > 0]).min()))
        left -= used * n
        out.append((bins, n))
    return out


def pack(docs: DataFrame, path: str, window: int = 4096, grain: int = 8, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    rows = common.stored(pieces(docs, path, window, grain, keep_ids), "pieces")
    per_task = common.stored(rows.groupBy("bin", "task").agg(F.count("*").alias("n")), "piece-counts")
    supply = np.zeros(window // grain + 1, np.int64)
    for row in per_task.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most window / grain rows
        supply[row.bin] = row.n
    places, first, used = [], 0, np.zeros_like(supply)
    for bins, n in plan(supply):
        for slot, b in enumerate(bins):
            places.append((b, int(used[b]), int(used[b] + n), first, slot))
            used[b] += n
        first += n
    earlier = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("bin", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = rows.join(common.small(offsets, per_task.count()), ["bin", "task"]).withColumn("number", F.col("number") + F.col("before"))
    # A bin's ranges in order, so that a piece looks its own up; the plan has a few places for each bin and combination.
    table: dict[int, list[tuple]] = {}
    for place in sorted(places):
        table.setdefault(place[0], []).append(place)
    known = spark.createDataFrame(
        [(b, [p[1] for p in t], [p[3] for p in t], [p[4] for p in t]) for b, t in table.items()],
        "bin int, starts array<long>, firsts array<long>, slots array<int>",
    )
    rows = rows.join(F.broadcast(known), "bin")
    at = F.size(F.filter("starts", lambda s: s <= F.col("number")))
    rows = rows.withColumn("__at", at)
    rows = rows.withColumns(
        {
            "sequence_id": F.element_at("firsts", F.col("__at")) + F.col("number") - F.element_at("starts", F.col("__at")),
            "slot": F.element_at("slots", F.col("__at")),
        }
    ).drop("starts", "firsts", "slots", "__at")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
