"""Toxicity: a linear-chain conditional random field tags toxic words, and its marginals make document scores and offsets.

Fit, on a bounded sample of labelled training rows (`max_docs` of each class, in the order of a hash, texts of at most
`max_chars` characters, so at most 2 * max_docs * max_chars characters reach the driver): a word of a toxic document is tagged
toxic where the word or one of its beginnings is far commoner in toxic documents than in clean ones (in at least `min_docs`, at
log odds of `min_odds`, beyond what chance gives among all that are tested); all other words are tagged clean. Of near copies
within the sample one is used. A two-tag chain with features for the word, its beginnings and its
length is trained on those tags by gradient descent on the exact log likelihood.

Scoring runs over every whole text: forward-backward gives each word the probability of the toxic tag, a document's score
is the probability that at least one word has it (words taken as independent), and runs of words above one half are the
offending spans. The chain of a batch is one sequence in which documents are cut apart; its recursion runs over columns of
equal blocks at once and then joins the blocks, so no loop is as long as a text.

Defined cases: a null or empty text, or one without words, scores 0; without labelled rows of both classes nothing is toxic and
all scores are 0; a null doc_id is held out; rows whose labels disagree count for each label; repeated rows score alike; an
empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from aerolens.llm import common

WORDS = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
KEPT_WORDS = 500_000


def features(word: str) -> list[str]:
    """Names of a word's features; a beginning is one only of a longer word."""
    return [f"={word}", *(f"{k}^{word[:k]}" for k in PREFIXES if len(word) > k), f"#{min(len(word), 12)}"]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: Log potentials of (tag before, tag), and of the first tag.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    fitted: bool = False

    def score(self, word: str) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(word))


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(tag 1) of each word, P(tag before, tag) of each step, and the log partition sum.

    `emission` is the log potential of tag 1 over tag 0; `first` marks the words that begin a document. The forward and the
    backward vectors of all documents are products of two-by-two matrices; those of a document's first word have equal rows,
    which cuts documents apart.
    """
    n = len(emission)
    if not n:
        return np.empty(0), np.empty((0, 2, 2)), 0.0
    e = np.stack([np.zeros(n), np.clip(emission, -60, 60)], 1)
    top = e.max(axis=1)
    e = np.exp(e - top[:, None])
    step = np.exp(moves)[None] * e[:, None, :]
    step[first] = np.exp(start)[None, None, :] * e[first][:, None, :]
    forward, logs = _run(step, np.array([1.0, 0.0]))
    # Backwards: what comes after word t, for each tag of t; a document's end gives (1, 1).
    back = np.zeros_like(step)
    back[:-1] = step[1:].transpose(0, 2, 1)
    last = np.append(first[1:], True)
    back[last] = 1.0
    backward, _ = _run(back[::-1], np.array([1.0, 1.0]))
    backward = backward[::-1]
    both = forward * backward
    p = both[:, 1] / both.sum(axis=1)
    pair = np.zeros((n, 2, 2))
    pair[1:] = forward[:-1, :, None] * step[1:] * backward[1:, None, :]
    pair[first] = 0.0
    total = pair.sum(axis=(1, 2), keepdims=True)
    pair = np.divide(pair, total, out=pair, where=total > 0)
    return p, pair, float(logs + top.sum())


def _run(step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, float]:
    """Normalised begin @ step[0] @ ... @ step[t] for every t, and the log of the whole product's sum."""
    n = len(step)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    m = np.tile(np.eye(2), (blocks * size, 1, 1))
    m[:n] = step
    m = m.reshape(blocks, size, 2, 2)
    product = np.empty_like(m)
    logs = np.zeros(blocks)
    now = np.tile(np.eye(2), (blocks, 1, 1))
    a, b, c, d = (now[:, i, j].copy() for i in (0, 1) for j in (0, 1))
    for t in range(size):
        s = m[:, t]
        a, b = a * s[:, 0, 0] + b * s[:, 1, 0], a * s[:, 0, 1] + b * s[:, 1, 1]
        c, d = c * s[:, 0, 0] + d * s[:, 1, 0], c * s[:, 0, 1] + d * s[:, 1, 1]
        norm = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / norm, b / norm, c / norm, d / norm
        logs += np.log(norm)
        product[:, t, 0, 0], product[:, t, 0, 1], product[:, t, 1, 0], product[:, t, 1, 1] = a, b, c, d
    starts = np.empty((blocks, 2))
    v, total = begin.astype(float), 0.0
    for k in range(blocks):
        starts[k] = v
        v = v @ product[k, -1]
        s = v.sum()
        total += math.log(s) + logs[k]
        v = v / s
    out = (starts[:, None, None, :] @ product)[:, :, 0, :].reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True), total


def _families(texts: list[list[str]], labels: list[int]) -> list[int]:
    """One text, the first, of each family of near copies in the sample: those that share a smallest 5-word hash of four kinds.

    Copies of one toxic document would otherwise make every word of it look toxic.
    """
    mixers = np.random.default_rng(1).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)
    seen: set[tuple[int, int, int]] = set()
    keep = []
    for k, (words, y) in enumerate(zip(texts, labels)):
        hashes = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
        marks = {(y, j, int((hashes * m).min())) for j, m in enumerate(mixers)}
        if not marks & seen:
            keep.append(k)
        seen |= marks
    return keep


def _labelled(docs: list[list[str]], toxic: np.ndarray, min_docs: int, min_odds: float) -> list[np.ndarray]:
    """Tags of the words of each document."""
    counts = {True: Counter(), False: Counter()}
    for words, y in zip(docs, toxic):
        counts[bool(y)].update({f for w in set(words) for f in features(w)[:-1]})
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    share = n1 / (n1 + n0)
    tested = [(f, n, counts[False][f]) for f, n in counts[True].items() if n >= min_docs]
    bad = set()
    for f, n, m in tested:
        odds = math.log((n + 0.5) / (n1 + 1)) - math.log((m + 0.5) / (n0 + 1))
        # The chance of so few clean documents if the feature had nothing to do with the label, for all that are tested.
        if odds >= min_odds and sum(math.comb(n + m, k) * share ** (n + m - k) * (1 - share) ** k for k in range(m + 1)) * len(tested) < 0.01:
            bad.add(f)
    known: dict[str, int] = {}

    def tag(word: str) -> int:
        if word not in known:
            known[word] = int(any(f in bad for f in features(word)[:-1]))
        return known[word]

    return [np.array([tag(w) for w in words] if y else [0] * len(words), np.int64) for words, y in zip(docs, toxic)]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_chars: int = 5000, min_docs: int = 5, min_odds: float = 3.0, rounds: int = 40, seed: int = 42) -> Model:
    """The chain, from labelled rows of the training folds."""
    marks = labels.where("toxic IN (0, 1)").select(F.col("doc_id").alias("__id"), "toxic")
    rows = docs.where(~common.held_out(F.col("doc_id")) & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = rows.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id").alias("__h"))
    # Which documents, from slim rows; then their texts.
    known = rows.select("doc_id", "__h").join(marks.hint("merge"), F.col("doc_id") == F.col("__id")).select("__id", "__h", "toxic")
    chosen = [tuple(r) for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy("__h", "__id").limit(max_docs).collect()]
    chosen = docs.sparkSession.createDataFrame(list(dict.fromkeys((r[0], r[2]) for r in chosen)), marks.schema)
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "toxic", "__h")
    taken = [r for y in (0, 1) for r in rows.where(F.col("toxic") == y).orderBy("__h", "text").limit(max_docs).collect()]
    texts = [WORDS.findall(r.text.lower()) for r in taken]
    one = _families(texts, [r.toxic for r in taken])
    taken, texts = [taken[k] for k in one], [texts[k] for k in one]
    toxic = np.array([r.toxic == 1 for r in taken], bool)
    if not toxic.any() or toxic.all():
        return Model()
    tags = _labelled(texts, toxic, min_docs, min_odds)
    keep = [k for k, words in enumerate(texts) if words]
    words = [w for k in keep for w in texts[k]]
    y = np.concatenate([tags[k] for k in keep]) if keep else np.empty(0, np.int64)
    if not y.any():
        return Model(fitted=False)
    first = np.zeros(len(words), bool)
    first[np.cumsum([0, *(len(texts[k]) for k in keep)])[:-1]] = True
    # Features that are seen once only teach nothing about other words.
    vocabulary = Counter(words)
    seen = Counter(f for w in vocabulary for f in features(w) for _ in range(min(2, vocabulary[w])))
    ids = {f: k for k, f in enumerate(f for f, n in seen.items() if n > 1)}
    index = {w: k for k, w in enumerate(vocabulary)}
    of_word = np.fromiter((index[w] for w in words), np.int64, len(words))
    pairs = np.array([(k, ids[f]) for w, k in index.items() for f in features(w) if f in ids], np.int64).reshape(-1, 2)

    weights, bias = np.zeros(len(ids)), 0.0
    moves, start = np.zeros((2, 2)), np.zeros(2)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("w", weights), ("b", np.zeros(1)), ("m", moves), ("s", start))}
    inner = ~first
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1.0)
    seen_start = np.bincount(y[first], minlength=2).astype(float)
    rare = max(1.0, float(y.sum()))
    for t in range(1, rounds + 1):
        of_vocabulary = bias + np.bincount(pairs[:, 0], weights[pairs[:, 1]], len(index))
        p, pair, _ = marginals(of_vocabulary[of_word], first, moves, start)
        per_word = np.bincount(of_word, y - p, len(index))
        p_first = p[first]
        gradients = {
            "w": np.bincount(pairs[:, 1], per_word[pairs[:, 0]], len(ids)) / rare - 1e-4 * weights,
            "b": np.array([per_word.sum() / rare]),
            "m": (seen_moves - pair.sum(axis=0)) / rare - 1e-4 * moves,
            "s": (seen_start - np.array([(1 - p_first).sum(), p_first.sum()])) / rare - 1e-4 * start,
        }
        steps = {}
        for k, g in gradients.items():
            one, two = state[k]
            state[k] = one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
            steps[k] = 0.25 * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-8)
        weights, bias, moves, start = weights + steps["w"], bias + steps["b"][0], moves + steps["m"], start + steps["s"]
    # Weights this small change no score that matters; the bias goes with the length feature every word has.
    kept = {f: float(weights[k]) for f, k in ids.items() if abs(weights[k]) > 0.02}
    for n in range(1, 13):
        kept[f"#{n}"] = kept.get(f"#{n}", 0.0) + float(bias)
    return Model(kept, moves, start, True)


def score_texts(texts: list[str | None], model: Model, known: dict[str, float]) -> tuple[list[float], list[str]]:
    """The score of each text, and its offending spans as start:end in code points, ends exclusive, joined with commas."""
    lowered = [t.lower() if t else "" for t in texts]
    words = [WORDS.findall(t) for t in lowered]
    lengths = np.array([len(w) for w in words], np.int64)
    scores, spans = [0.0] * len(texts), [""] * len(texts)
    if not model.fitted or not lengths.sum():
        return scores, spans
    flat: list[float] = []
    for ws in words:
        for w in set(ws):
            if w not in known:
                known[w] = model.score(w)
        flat += [known[w] for w in ws]
        if len(known) > KEPT_WORDS:
            known.clear()
    ends = np.cumsum(lengths)
    first = np.zeros(len(flat), bool)
    first[(ends - lengths)[lengths > 0]] = True
    p, _, _ = marginals(np.array(flat), first, model.moves, model.start)
    clean = np.log1p(-np.minimum(p, 1 - 1e-12))
    sums = np.concatenate([[0.0], np.cumsum(clean)])
    for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
        if b > a:
            scores[i] = float(-np.expm1(min(0.0, sums[b] - sums[a])))
            hot = np.flatnonzero(p[a:b] > 0.5)
            if len(hot):
                # Lower case can change lengths, so positions are looked up in the text itself.
                at = [m.span() for m in WORDS.finditer(texts[i])]
                if len(at) == b - a:
                    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
                    spans[i] = ",".join(f"{at[r[0]][0]}:{at[r[-1]][1]}" for r in runs)
                else:
                    spans[i] = f"0:{len(texts[i])}"
    return scores, spans


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with all its columns in a struct `row`, score, and spans."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"], F.lit(0).alias("__")).alias("row"), docs["text"].alias("text"))
    schema = StructType([*rows.schema.fields]).add("score", DoubleType()).add("spans", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            texts = whole.column("text").to_pylist()
            scores, spans, at, size = [], [], 0, 0
            for i, t in enumerate(texts):  # about a million characters at once
                size += len(t) if t else 0
                if size >= 1_000_000 or i == len(texts) - 1:
                    s, o = score_texts(texts[at : i + 1], model, known)
                    scores, spans, at, size = scores + s, spans + o, i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [whole.column("row"), whole.column("text"), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["row", "text", "score", "spans"]
            )

    return rows.mapInArrow(run, schema)
