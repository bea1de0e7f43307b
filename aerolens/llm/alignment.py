"""Cross-tokenizer alignment: counts of linked token pairs in dense vectors, addressed by minimal perfect hashing.

Two tokenizers cut the same bytes; where tokens of both end, the text falls into groups, and all tokens of a group are linked. A
pair of ids is one number. The first pass aligns all documents and gives, for chunks of documents, each pair's number of
documents, dealt by the first id into buckets. A bucket's distinct pairs get a minimal perfect hash: in level after level of bits
a pair that falls alone keeps its bit, others go on, and the rank of a pair's bit is its place. Chunks become dense vectors of
counts by place, which are summed as a tree of bounded fan; the pairs themselves stand at their places too, so that a pair which
is not in the table is told from those that are. The second pass aligns the documents again and looks counts up.

The table is sent to tasks in slices of a bounded number of pairs, one pass over the documents for each slice; the sums of a
document's slices are added. A bucket has no more pairs than its first ids times all second ids, whatever the corpus.

Texts are cut before single spaces that follow no white space: neither tokenizer has a token across such a place, so both give
the ids of the parts in a row, and what is known of a part is kept by a worker, up to a bound. Very long texts are worked through
in stretches.

Defined cases: a null or empty text, and one whose bytes either tokenizer does not give back, has no tokens: zeros and an empty
string; repeated rows count as documents each; an empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerolens.llm import common

BUCKETS = 256
#: Pairs of one slice of the table, at most, unless a single bucket has more.
SLICE = 2_000_000
#: Rows merged at once, in every round of a tree.
FAN = 32
#: Pairs of documents that a task holds before it gives a chunk.
CHUNK = 4_000_000
#: Parts of texts that a worker keeps.
KEPT = 800_000
#: Characters of texts looked at together, and of one stretch of a text.
TOGETHER, STRETCH = 1_000_000, 1_000_000
#: Bits of a level for each pair in it.
ROOM = 1.5
PLACES = re.compile(r"(?<=\S) ")
#: Parts encoded and aligned at once; longer parts than `SHORT` go to the library whose time does not grow with their square.
TOGETHER_PARTS, SHORT = 20_000, 256
#: The byte-level tokenizer's own pattern (a fixed value).
PARTS_OF_BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Tokenizers:
    """Both tokenizers, on parts of texts that begin with a space."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.bytewise = Tokenizer.from_file(byte_path)
        self.bytewise.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # Byte-level entries are written in printable characters: bytes that have none follow from 256 on, in order.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        size = self.bytewise.get_vocab_size()
        names = [self.bytewise.id_to_token(i) for i in range(size)]
        self.a_bytes = [bytes(shown[c] for c in n) if all(c in shown for c in n) else n.encode() for n in names]
        # Merges are made in the order of ids, so that ids are ranks, and short parts go to the quicker library.
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(model["vocab"][m.replace(" ", "")] != 256 + k for k, m in enumerate(merges)):
            raise ValueError("ids are not in the order of merges")
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        self.short = tiktoken.Encoding("parts", pat_str=PARTS_OF_BYTES, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.n_b = self.pieces.vocab_size()
        names = [self.pieces.id_to_piece(i) for i in range(self.n_b)]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece goes on after a space: texts cannot be cut before spaces")
        if size * self.n_b >= 1 << 32:
            raise ValueError("pairs of ids do not fit 32 bits")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.pieces.piece_to_id("▁")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # Ids as they are written within a group and at its end.
        self.text = [x for i in range(size) for x in (f"{i},", f"{i}|")] + [x for i in range(self.n_b) for x in (f"{i},", f"{i};")]

    def encoded(self, parts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by both tokenizers of a space and each part."""
        short, whole = self.short.encode_ordinary, self.bytewise.encode
        first = [short(" " + p) if len(p) < SHORT else whole(" " + p, add_special_tokens=False).ids for p in parts]
        # The piece model puts a space before what it is given, except before nothing.
        second = self.pieces.encode(list(parts), num_threads=1)
        return first, [b if p else [self.space] for p, b in zip(parts, second)]


class Parts:
    """What a worker knows of parts of texts: numbers of ids, groups and links, the links, and the groups' text if `names`."""

    def __init__(self, both: Tokenizers, names: bool):
        self.both, self.named = both, names
        self.clear(1024)

    def clear(self, size: int) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.table = np.zeros((size, len(_COLUMNS)), np.int64)
        self.start = np.zeros(size + 1, np.int64)
        self.codes = np.empty(size * 4, "<u4")

    def learn(self, met: set[str]) -> tuple[int, int]:
        """Looks at parts that are not known yet; the numbers of the first and after the last."""
        new = list(met.difference(self.index))
        if len(self.index) + len(new) > KEPT:
            self.clear(max(1024, len(met)))
            new = list(met)
        first = len(self.index)
        while len(self.table) < first + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.start = np.concatenate([self.start, np.zeros(len(self.start) - 1, np.int64)])
        for at in range(0, len(new), TOGETHER_PARTS):
            self._add(new[at : at + TOGETHER_PARTS])
        return first, len(self.index)

    def _add(self, parts: list[str]) -> None:
        both, first = self.both, len(self.index)
        self.index.update(zip(parts, range(first, first + len(parts))))
        a, b = both.encoded(parts)
        good = np.ones(len(parts), bool)
        whole = "".join([" " + p for p in parts]).encode()
        if not whole == b"".join([both.a_bytes[i] for x in a for i in x]) == b"".join([both.b_bytes[i] for x in b for i in x]):
            for k, (p, x, y) in enumerate(zip(parts, a, b)):
                good[k] = (" " + p).encode() == b"".join([both.a_bytes[i] for i in x]) == b"".join([both.b_bytes[i] for i in y])
            a, b = ([x for x, g in zip(xs, good) if g] for xs in (a, b))
        self.table[first : first + len(parts)] = -1
        ours = first + np.flatnonzero(good)
        codes, links, names = self._aligned(a, b, ours)
        self.start[first + 1 : first + len(parts) + 1] = 0
        self.start[ours + 1] = links
        self.start[first + 1 : first + len(parts) + 1] = self.start[first] + np.cumsum(self.start[first + 1 : first + len(parts) + 1])
        end = self.start[first + len(parts)]
        while len(self.codes) < end:
            self.codes = np.concatenate([self.codes, np.empty_like(self.codes)])
        self.codes[self.start[first] : end] = codes
        if self.named:
            out = iter(names)
            self.names += [next(out) if g else "" for g in good]

    def _aligned(self, a: list[list[int]], b: list[list[int]], ours: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The links of parts in a row, their number by part, and the groups' texts."""
        both, n = self.both, len(a)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
        ids_a, ids_b = (np.fromiter((i for x in xs for i in x), np.int64, int(m.sum())) for xs, m in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(both.a_size[ids_a]), np.cumsum(both.b_size[ids_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        part_of = np.searchsorted(end_a[np.cumsum(n_a) - 1], ends) if n else ends
        links = np.bincount(part_of, weights=size_a * size_b, minlength=n).astype(np.int64)
        # Each first token meets all second ones of its group.
        times = size_b[group_a]
        left = np.repeat(ids_a, times)
        right = np.repeat(start_b[group_a] - (np.cumsum(times) - times), times) + np.arange(len(left))
        self.table[ours] = 0
        self.table[ours, :4] = np.stack([n_a, n_b, np.bincount(part_of, minlength=n), links], 1)
        names: list[str] = []
        if self.named and n:
            last_a, last_b = end_a == ends[group_a], end_b == ends[group_b]
            order = np.empty(len(ids_a) + len(ids_b), np.int64)
            order[np.arange(len(ids_a)) + start_b[group_a]] = ids_a * 2 + last_a
            order[np.arange(len(ids_b)) + (start_a + size_a)[group_b]] = 2 * len(both.a_bytes) + ids_b * 2 + last_b
            words = [both.text[k] for k in order.tolist()]
            cuts = np.cumsum(n_a + n_b).tolist()
            names = ["".join(words[x:y]) for x, y in zip([0, *cuts], cuts)]
        return (left * both.n_b + ids_b[right]).astype("<u4"), links, names

    def numbers(self, parts) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

    def links(self, at: np.ndarray) -> np.ndarray:
        """The links of some parts, one after another."""
        size = self.start[at + 1] - self.start[at]
        return self.codes[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def stretches(text: str, size: int = STRETCH) -> Iterator[list[str]]:
    """The parts of a text, so many characters of it at a time."""
    at = 0
    while len(text) - at > size:
        place = PLACES.search(text, at + size)
        if place is None:
            break
        yield PLACES.split(text[at : place.start()])
        at = place.end()
    yield PLACES.split(text[at:] if at else text)


def _together(texts: Sequence[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """(number of the text, parts of a stretch of it), in order, several short texts at once; nothing for empty ones."""
    out, size = [], 0
    for k, text in enumerate(texts):
        for parts in stretches(text) if text else ():
            out.append((k, parts))
            size += min(len(text), STRETCH)
            if size >= TOGETHER:
                yield out
                out, size = [], 0
    if out:
        yield out


def mixed(keys: np.ndarray, level) -> np.ndarray:
    """64 bits of each number, others on each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + (np.asarray(level, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all bits in a row) for distinct numbers."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(int(ROOM * len(left)), 2)
        at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.empty(0, bool)


class Places:
    """Places of numbers in the minimal perfect hashes of several buckets; each bucket's places follow those of the one before."""

    def __init__(self, sizes: Sequence[Sequence[int]], bits: Sequence[np.ndarray]):
        levels = max(map(len, sizes), default=0)
        self.size, self.start = np.zeros((levels, len(sizes)), np.int64), np.zeros((levels, len(sizes)), np.int64)
        at = 0
        for b, own in enumerate(sizes):
            for k, s in enumerate(own):
                self.size[k, b], self.start[k, b] = s, at
                at += s
        self.bits = np.concatenate(bits) if len(bits) else np.empty(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - self.bits

    def __call__(self, keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The place of each number, -1 if no bit is its own; a number that was not hashed may get the place of another."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k in range(len(self.size)):
            left = left[self.size[k, buckets[left]] > 0]
            if not len(left):
                break
            b = buckets[left]
            at = self.start[k, b] + (mixed(keys[left], k) % self.size[k, b].astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def _chunks(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(bucket, chunk, pairs, counts): distinct pairs of a chunk of documents, and in how many of these each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, task, chunk = Tokenizers(*paths), TaskContext.get().partitionId(), 0
        known = Parts(both, False)
        held: list[np.ndarray] = []

        def given() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (pairs // both.n_b) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            pairs, counts, bucket = pairs[order], counts[order].astype("<u8"), bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            names = bucket[np.concatenate([[0], cuts])].astype(np.int32)
            rows = [pa.array(names), pa.array([f"{task}-{chunk}"] * len(names)), pa.array([p.tobytes() for p in np.split(pairs, cuts)], pa.binary()), pa.array([c.tobytes() for c in np.split(counts, cuts)], pa.binary())]
            return pa.RecordBatch.from_arrays(rows, ["bucket", "chunk", "pairs", "counts"])

        for batch in batches:
            mine: dict[int, np.ndarray | None] = {}
            for some in _together(batch.column("text").to_pylist()):
                distinct = [(k, set(parts)) for k, parts in some]
                known.learn(set().union(*(d for _, d in distinct)))
                for k, parts in distinct:
                    if k in mine and mine[k] is None:
                        continue
                    at = known.numbers(parts)
                    if (known.table[at, 0] < 0).any():
                        mine[k] = None
                    else:
                        links = known.links(at)
                        mine[k] = np.unique(np.concatenate([links, mine[k]]) if k in mine else links)
            held += [m for m in mine.values() if m is not None and len(m)]
            if sum(map(len, held)) >= CHUNK:
                yield given()
                held, chunk = [], chunk + 1
        if held:
            yield given()

    return texts.select("text").mapInArrow(run, "bucket int, chunk string, pairs binary, counts binary")


def _added(group: pd.DataFrame) -> pd.DataFrame:
    pairs = np.concatenate([np.frombuffer(x, "<u4") for x in group["pairs"]])
    counts = np.concatenate([np.frombuffer(x, "<u8") for x in group["counts"]])
    keys, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(keys), "<u8")
    np.add.at(total, at, counts)
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "part": [group["part"].iloc[0]], "pairs": [keys.tobytes()], "counts": [total.tobytes()]})


def _all_keys(group: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in group["pairs"]]))
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "part": [group["part"].iloc[0]], "pairs": [keys.tobytes()]})


def _vector_sum(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<u8") for x in group["counts"])
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "part": [group["part"].iloc[0]], "counts": [total.astype("<u8").tobytes()]})


def _tree(rows: DataFrame, parts: int, merge, schema: str, what: str) -> DataFrame:
    """One row for each bucket: parts are merged, `FAN` at a time, until one is left."""
    while parts > 1:
        parts = math.ceil(parts / FAN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        rows = common.stored(rows.groupBy("bucket", "part").applyInPandas(merge, schema), what)
    return rows


def pair_counts(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(bucket, sizes, bits, pairs, counts, best): a bucket's hash, and by place its pairs, their numbers of documents, and
    whether no pair of the same first id has more."""
    n_b = Tokenizers(*paths).n_b
    chunks = common.stored(_chunks(texts, paths), "alignment-chunks")
    parts = max(math.ceil(chunks.select("chunk").distinct().count() / FAN), 1)
    chunks = chunks.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    merged = common.stored(chunks.groupBy("bucket", "part").applyInPandas(_added, "bucket int, part int, pairs binary, counts binary"), "alignment-parts")
    keys = _tree(merged.select("bucket", "part", "pairs"), parts, _all_keys, "bucket int, part int, pairs binary", "alignment-keys")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits, placed = [], [], []
            for raw in batch.column("pairs").to_pylist():
                own = np.frombuffer(raw, "<u4")
                s, b = perfect_hash(own)
                at = Places([s], [b])(own, np.zeros(len(own), np.int64))
                order = np.empty(len(own), "<u4")
                order[at] = own
                sizes.append(s)
                bits.append(np.packbits(b).tobytes())
                placed.append(order.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(sizes, pa.list_(pa.int32())), pa.array(bits, pa.binary()), pa.array(placed, pa.binary())], ["bucket", "sizes", "bits", "places"])

    table = common.stored(keys.select("bucket", "pairs").mapInArrow(hashed, "bucket int, sizes array<int>, bits binary, places binary"), "alignment-hashes")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs, counts, sizes, bits, places in zip(*[batch.column(c).to_pylist() for c in ("pairs", "counts", "sizes", "bits", "places")]):
                own, at_place = np.frombuffer(pairs, "<u4"), np.frombuffer(places, "<u4")
                at = Places([sizes], [_unpacked(bits, sizes)])(own, np.zeros(len(own), np.int64))
                assert np.array_equal(at_place[at], own)
                vector = np.zeros(len(at_place), "<u8")
                vector[at] = np.frombuffer(counts, "<u8")
                out.append(vector.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("part"), pa.array(out, pa.binary())], ["bucket", "part", "counts"])

    vectors = common.stored(merged.join(table, "bucket").select("bucket", "part", "pairs", "counts", "sizes", "bits", "places").mapInArrow(dense, "bucket int, part int, counts binary"), "alignment-vectors")
    summed = _tree(vectors, parts, _vector_sum, "bucket int, part int, counts binary", "alignment-sums")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for places, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
                ids, counts = np.frombuffer(places, "<u4") // n_b, np.frombuffer(counts, "<u8")
                names, at = np.unique(ids, return_inverse=True)
                most = np.zeros(len(names), "<u8")
                np.maximum.at(most, at, counts)
                best.append(np.packbits(counts == most[at]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "sizes", "bits", "pairs", "counts")), pa.array(best, pa.binary())], ["bucket", "sizes", "bits", "pairs", "counts", "best"])

    rows = table.join(summed.select("bucket", "counts"), "bucket").select("bucket", "sizes", "bits", F.col("places").alias("pairs"), "counts")
    return common.stored(rows.mapInArrow(judged, "bucket int, sizes array<int>, bits binary, pairs binary, counts binary, best binary"), "alignment-counts")


def _unpacked(bits: bytes, sizes: Sequence[int]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)


class Lookup:
    """Counts of the pairs of some buckets, from rows of `pair_counts`."""

    def __init__(self, rows: Sequence[tuple]):
        self.number = np.full(BUCKETS, -1, np.int64)
        for k, row in enumerate(rows):
            self.number[row[0]] = k
        self.places = Places([r[1] for r in rows], [_unpacked(r[2], r[1]) for r in rows])
        joined = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows]) if rows else np.empty(0, kind)
        self.pairs, self.counts = joined(3, "<u4"), joined(4, "<u8").astype(np.int64)
        self.best = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=len(r[3]) // 4) for r in rows]) if rows else np.empty(0, np.uint8)

    def __call__(self, pairs: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the best of its first id) of each pair; zeros for pairs that are not in these buckets."""
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        bucket = self.number[(pairs // n_b) % BUCKETS]
        ours = np.flatnonzero(bucket >= 0)
        at = self.places(pairs[ours], bucket[ours])
        there = at >= 0
        there[there] = self.pairs[at[there]] == pairs[ours[there]]
        counts[ours[there]], best[ours[there]] = self.counts[at[there]], self.best[at[there]]
        return counts, best


def _looked_up(texts: DataFrame, paths: tuple[str, str], sent, whole: bool) -> DataFrame:
    """Per row: the sums of its links over a slice of the table and, if `whole`, its own numbers and the digest of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, lookup = Tokenizers(*paths), Lookup(sent.value)
        known = Parts(both, whole)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = np.zeros((len(texts), len(_COLUMNS)), np.int64)
            digests, bad = [None] * len(texts), set()
            # Every group ends with a semicolon but the last one of a text.
            waiting = [""] * len(texts)
            for some in _together(texts):
                first, end = known.learn(set().union(*(parts for _, parts in some)))
                if end > first:
                    counts, best = lookup(known.codes[known.start[first] : known.start[end]], both.n_b)
                    owner = np.repeat(np.arange(end - first), np.diff(known.start[first : end + 1]))
                    for column, values in ((4, best), (5, counts)):
                        fresh = known.table[first:end, column]
                        np.add.at(fresh, owner, values)
                for k, parts in some:
                    if k in bad:
                        continue
                    at = known.numbers(parts)
                    rows = known.table[at]
                    if (rows[:, 0] < 0).any():
                        bad.add(k)
                        continue
                    sums[k] += rows.sum(0)
                    if whole:
                        digests[k] = digests[k] or hashlib.sha256()
                        digests[k].update(waiting[k].encode())
                        waiting[k] = "".join([known.names[i] for i in at.tolist()])
            for k, digest in enumerate(digests):
                if digest is not None:
                    digest.update(waiting[k][:-1].encode())
            if bad:
                sums[list(bad)] = 0
            out = {"row": batch.column("row")}
            for j, c in enumerate(_COLUMNS):
                own = whole or c in ("n_best", "count_sum")
                out[c] = pa.array(sums[:, j]) if own else pa.nulls(len(texts), pa.int64())
            out["groups_sha256"] = pa.array(["" if d is None or k in bad else d.hexdigest() for k, d in enumerate(digests)] if whole else [None] * len(texts), pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return texts.select("row", "text").mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", groups_sha256 string")


def align(docs: DataFrame, byte_path: str, piece_path: str, slice_pairs: int = SLICE) -> DataFrame:
    """Every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths, spark = (byte_path, piece_path), docs.sparkSession
    texts = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], docs["text"]), "alignment-texts")
    table = pair_counts(texts, paths)
    sizes = sorted((r.bucket, r.n // 4) for r in table.select("bucket", F.octet_length("pairs").alias("n")).collect())
    slices: list[list[int]] = [[]]
    room = slice_pairs
    for bucket, n in sizes:
        if n > room and slices[-1]:
            slices.append([])
            room = slice_pairs
        slices[-1].append(bucket)
        room -= n
    parts = None
    for k, buckets in enumerate(slices):
        # No more than `slice_pairs` pairs, or one bucket.
        rows = [tuple(r) for r in table.where(F.col("bucket").isin(buckets)).orderBy("bucket").collect()] if buckets else []
        sent = spark.sparkContext.broadcast(rows)
        part = _looked_up(texts, paths, sent, k == 0)
        if len(slices) > 1:
            part = common.stored(part, "alignment-slices")
            sent.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    whole = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in _COLUMNS], F.max("groups_sha256").alias("groups_sha256"))
    return texts.select("row", "doc_id").join(whole, "row").select("doc_id", *_COLUMNS, "groups_sha256")
