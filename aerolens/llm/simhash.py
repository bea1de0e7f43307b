"""SimHash near-deduplication with deletion-variant signatures.

A text's words (A-Z lower-cased) give shingles, each shingle 64 hash bits, and a fingerprint bit is set if it is set in over
half of them. Fingerprints that differ in at most d bits agree, in one of d // 2 + 1 segments, up to a single bit. So every
distinct fingerprint is indexed under each segment with each one of its bits deleted; fingerprints under the same key are
compared. Only distinct fingerprints take part, copies of a text follow theirs.

A key of few fingerprints gives its pairs. Under a key of more than `bucket` no pairs are formed: its fingerprints are keyed
again, by one deleted bit of the other segments, or by two where the first segment is the same in full. All under such a key
differ in at most two bits, so each is linked to the smallest one alone. Links grow with the fingerprints, and no group that
the links connect is lost. Components are found by rounds of grouped minima.

Defined cases: null and blank texts have no words and the fingerprint zero, linked like any other; fewer words than a shingle
has are one shingle; repeated rows share a fingerprint; the component of rows without any doc_id is null; an empty table
gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from aerolens.llm import common, graph

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 65_536
#: Words whose hashes a task keeps; more than that and it starts afresh.
KEPT_WORDS = 500_000
#: At most so many keys, rows of a few numbers, are sent to every executor. The driver holds each such table in several forms.
KEYS_SENT = 200_000
#: Words of 64 bits that tell which of more keys than that there may be.
SIEVE_WORDS = 1 << 20
#: Bits of a shingle set's sketch: at least so many, and so many for each shingle.
SKETCH_BITS, BITS_EACH = 512, 2
#: Texts that are compared with one text in one task, and pairs of texts that are compared without asking which could be spared.
AT_ONCE, PAIRS_AT_ONCE = 64, 10_000


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included; of the whole sequence if there are fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - n] + 1).tolist()]
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number; zero for none."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def words_of(text: bytes | None) -> list[bytes]:
    """Words between characters of [\\x20\\x09-\\x0D], A-Z in lower case; bytes.split and bytes.lower do just that."""
    return text.lower().split() if text else []


def with_fingerprints(docs: DataFrame, words: int = 3, seeds: Sequence[int] = (SEED,)) -> DataFrame:
    """`docs` with its column `text` replaced by `fps`, one fingerprint for each seed."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep).schema.add("fps", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                w = words_of(text)
                if words == 1:
                    if len(known) > KEPT_WORDS:
                        known.clear()
                    for x in w:
                        if x not in known:
                            known[x] = [xxhash.xxh64_intdigest(x, s) for s in seeds]
                    grid = np.array([known[x] for x in w], np.uint64).reshape(len(w), len(seeds))
                    out.append([fingerprint(grid[:, k]) for k in range(len(seeds))])
                else:
                    out.append([fingerprint(shingle_hashes(w, words, s)) for s in seeds])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.int64()))], [*keep, "fps"])

    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, from the lowest bit."""
    n = distance // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(first: int, bits: int) -> int:
    m = ((1 << bits) - 1) << first
    return m - (1 << 64) if m >> 63 else m


def _without(fp: Column, bit: Column | int) -> Column:
    return fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit if isinstance(bit, Column) else F.lit(bit))))


def variants(fps: DataFrame, distance: int, keep: Sequence[str] = ("fp",), seed_no: int = 0) -> DataFrame:
    """(key, bit, *keep): each segment of each fingerprint with each one of its bits deleted.

    The key is a hash of the seed's number, the deleted bit (which tells the segment) and what is left of the segment; that two
    of them collide only adds a pair to be verified.
    """
    each = []
    for first, bits in _segments(distance):
        rows = fps.select(*keep, F.explode(F.sequence(F.lit(first), F.lit(first + bits - 1))).alias("bit"))
        left = _without(F.col("fp"), F.col("bit")).bitwiseAND(F.lit(_mask(first, bits)))
        each.append(rows.select(F.xxhash64(F.lit(seed_no), "bit", left).alias("key"), F.col("bit").cast("byte").alias("bit"), *keep))
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def _members(index: DataFrame) -> DataFrame:
    """(key, bit, fp, n) of the keys that n > 1 fingerprints share; where these keys are few, the index is shuffled only once."""
    keys = common.stored(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    return common.stored(_of_keys(index, keys).select("key", "bit", "fp", "n"), "simhash-members")


def _pairs(members: DataFrame, bucket: int) -> DataFrame:
    """(a, b), a < b, of all keys of at most `bucket` fingerprints; `bucket` bounds the partners of each."""
    some = members.where(f"n <= {bucket}").select("key", "fp")
    return some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), "key").where("a < b").select("a", "b")


def links(fps: DataFrame, bucket: int = 32) -> DataFrame:
    """Links (a, b) between distinct fingerprints at two or fewer bits; they connect just what all such pairs connect."""
    members = _members(variants(fps, 2))
    close = _pairs(members, bucket).where(F.bit_count(F.expr("a ^ b")) <= 2)
    many = members.where(f"n > {bucket}")
    stars = []
    for first, bits in _segments(2):
        own = many.where(F.col("bit").between(first, first + bits - 1))
        others = [b for b in range(64) if not first <= b < first + bits]
        one = own.withColumn("x", F.explode(F.array(*[F.lit(b) for b in others])))
        stars.append(one.select("fp", "bit", "x", F.lit(-1).alias("y"), _without(_without(F.col("fp"), F.col("bit").cast("int")), F.col("x")).alias("left")))
        # Two deleted bits outside the segment serve those that agree in it, which all meet under its first bit.
        two = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for i, a in enumerate(others) for b in others[:i]]
        same = own.where(F.col("bit") == first).withColumn("xy", F.explode(F.array(*two)))
        stars.append(same.select("fp", F.lit(-1).cast("byte").alias("bit"), "xy.x", "xy.y", _without(_without(F.col("fp"), F.col("xy.x")), F.col("xy.y")).alias("left")))
    star = stars[0]
    for more in stars[1:]:
        star = star.unionByName(more)
    key = ["bit", "x", "y", "left"]
    # All under one key differ in its two deleted bits at most.
    heads = common.stored(star.groupBy(*key).agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1").drop("n"), "simhash-heads")
    starred = star.join(heads, key).where("a < fp").select("a", F.col("fp").alias("b"))
    return close.unionByName(starred).distinct()


def near_groups(docs: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """Every row with doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that links reach."""
    rows = with_fingerprints(docs.select("doc_id", "text"), words, (seed,)).select("doc_id", F.col("fps")[0].alias("fp"))
    rows = common.stored(rows, "fingerprints")
    heads = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-heads")
    roots = graph.components(links(heads.select("fp")))
    heads = heads.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = common.stored(heads, "fingerprint-roots")
    least = common.stored(heads.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    known = common.stored(heads.join(least.hint("merge"), "root").select("fp", "component_id"), "fingerprint-components")
    out = rows.join(known.hint("merge"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    """(row, n, bits): how many distinct n-word shingles a text has, and the bits that their hashes set."""

    def bits(hashes: np.ndarray) -> np.ndarray:
        size = SKETCH_BITS
        while size < BITS_EACH * len(hashes):
            size *= 2
        out = np.zeros(size, np.uint8)
        out[(hashes % np.uint64(size)).astype(np.int64)] = 1
        return np.packbits(out, bitorder="little").view("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(words_of(t), n)) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("row"), pa.array([len(x) for x in sets], pa.int32()), pa.array([bits(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n", "bits"])

    rows = texts.select("row", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, n int, bits array<long>")


def _enough(both: Column, a: Column, b: Column, similarity: float) -> Column:
    return both >= F.lit(similarity) * (a + b - both)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) that may have the Jaccard similarity, by their sets' sizes and then by their sketches.

    A bit that one sketch alone has set stands for a shingle at least that the other text has not. Sizes of alike sets differ
    by less than twice, and so do their sketches; the larger one is folded.
    """
    sizes = sketches.select("row", "n")
    may = pairs.join(sizes.toDF("x", "m").hint("merge"), "x").join(sizes.toDF("y", "n").hint("merge"), "y")
    may = common.stored(may.where(_enough(F.least("m", "n"), F.col("m"), F.col("n"), similarity)).select("x", "y"), "near-sized")
    slim = _of_pairs(sketches, may)
    may = may.join(slim.toDF("x", "m", "s").hint("merge"), "x").join(slim.toDF("y", "n", "t").hint("merge"), "y")
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c, other: F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, 1, half(c)), F.slice(c, half(c) + 1, half(c)), lambda a, b: a.bitwiseOR(b))).otherwise(F.col(c))
    may = may.select("x", "y", "m", "n", folded("s", "t").alias("s"), folded("t", "s").alias("t"))
    # One walk over both: the bits that one alone has set.
    own = F.zip_with("s", "t", lambda a, b: F.struct(F.bit_count(a.bitwiseAND(F.bitwise_not(b))).alias("a"), F.bit_count(b.bitwiseAND(F.bitwise_not(a))).alias("b")))
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    add = lambda z, e: F.struct((z["a"] + e["a"]).alias("a"), (z["b"] + e["b"]).alias("b"))
    may = may.select("x", "y", "m", "n", F.explode(F.array(F.aggregate(own, zero, add))).alias("own"))
    most = F.least(F.col("m") - F.col("own.a"), F.col("n") - F.col("own.b"))
    return common.stored(may.where(_enough(most, F.col("m"), F.col("n"), similarity)).select("x", "y"), "near-likely")


def _alike(may: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (x, y) whose texts' shingle sets have the Jaccard similarity.

    Texts are shuffled, not their sets, which are several times as large; a text goes once to each `AT_ONCE` texts that it is
    compared with.
    """
    crowded = common.stored(may.groupBy("x").agg(F.count("*").alias("n")).where(f"n > {AT_ONCE}"), "near-crowded")
    dealt = F.pmod(F.xxhash64("y"), F.coalesce(F.ceil(F.col("n") / AT_ONCE), F.lit(1))).cast("int")
    dealt = common.stored(may.join(_sent(crowded), "x", "left").select("x", dealt.alias("part"), "y"), "near-dealt")
    heads = dealt.select("x", "part").distinct().select("x", "part", F.lit(0).alias("member"), F.col("x").alias("row"))
    places = common.stored(heads.unionByName(dealt.select("x", "part", F.lit(1).alias("member"), F.col("y").alias("row"))), "near-places")
    placed = _of_pairs(texts, may).join(_sent(places), "row").select("x", "part", "member", "row", F.col("text").cast("binary").alias("text"))
    placed = placed.repartition("x", "part").sortWithinPartitions("x", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, member, row, text in zip(*(batch.column(c).to_pylist() for c in ("x", "member", "row", "text"))):
                own = np.unique(shingle_hashes(words_of(text), shingle))
                if not member:
                    head = own
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both >= similarity * (len(head) + len(own) - both):
                    a.append(x)
                    b.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows that pairs (x, y) name, so that a join with the pairs does not shuffle all others."""
    named = pairs.select(F.col("x").alias("row")).unionByName(pairs.select(F.col("y").alias("row"))).distinct()
    return rows.join(_sent(common.stored(named, "near-named-rows")), "row", "left_semi")


def _sent(rows: DataFrame) -> DataFrame:
    """Numbers of rows: where they are few they are sent to the texts, else both sides are shuffled.

    Never left to Spark, which would take a table that it cannot size, as after an explode or of few bytes on disk, for a
    small one and gather it in the driver.
    """
    return F.broadcast(rows) if rows.count() <= KEYS_SENT else rows.hint("merge")


def _of_keys(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index joined with some of its keys: where these are too many to be sent, a sieve of their bits is, of one size
    whatever their number, so that little else of the index is shuffled."""
    if keys.count() <= KEYS_SENT:
        return index.join(F.broadcast(keys), "key")
    words = SIEVE_WORDS
    place = lambda: F.pmod("key", F.lit(words * 64))
    word = lambda: F.expr(f"CAST(pmod(key, {words * 64}L) div 64 AS INT)")
    bits = keys.groupBy(word().alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place() % 64).cast("int"))).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(words, np.int64)
        for batch in batches:
            out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.int64()))], ["sieve"])

    sieve = common.stored(bits.coalesce(1).mapInArrow(run, "sieve array<long>"), "near-sieve")
    met = F.call_function("shiftright", F.get("sieve", word()), (place() % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    some = index.crossJoin(F.broadcast(sieve)).where(met).select(*index.columns)
    return some.join(keys.hint("merge"), "key")


def _crowds(prints: DataFrame, distance: int, seed_no: int) -> DataFrame:
    """(key, seed, fp, n, rows, first): variant keys of one seed that several rows of (row, seed, fp) share, with their fingerprints.

    `n` rows have the fingerprint, the smallest is `first`; `rows` have one of the key's fingerprints. Of keys with the same
    fingerprints one is enough; they are told by their numbers and two hashes.
    """
    own = prints.where(F.col("seed") == seed_no).groupBy("fp").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    own = common.stored(own, "near-prints")
    index = variants(own, distance, ("fp", "n", "first"), seed_no)
    # The marks of all keys would be most of the disk; only shared keys have them.
    keys = common.stored(index.groupBy("key").agg(F.sum("n").alias("rows")).where("rows > 1"), "near-keys")
    shared = common.stored(_of_keys(index, keys).select("key", "fp", "n", "rows", "first"), "near-shared-keys")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "fp")).alias(f"mark{k}") for k in (1, 2)]
    each = shared.groupBy("key").agg(F.count("*").alias("prints"), F.first("rows").alias("rows"), *marks)
    each = common.stored(each.groupBy("prints", "rows", "mark1", "mark2").agg(F.min("key").alias("key")).select("key"), "near-distinct-keys")
    return shared.join(_sent(each), "key").select("key", F.lit(seed_no).alias("seed"), "fp", "n", "rows", "first")


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.expr(f"{a} ^ {b}")) <= distance


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _first_candidates(crowds: DataFrame, prints: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(x, y): all pairs under keys of at most `bucket` rows; under others each fingerprint's first row with the smallest
    fingerprint's, and each row with its fingerprint's first."""
    few, many = crowds.where(f"rows <= {bucket}"), crowds.where(f"rows > {bucket}")
    one = few.select("key", F.col("seed").alias("s"), F.col("fp").alias("a"))
    close = one.join(few.select("key", F.col("fp").alias("b")).hint("merge"), "key").where("a <= b").where(_near("a", "b", distance)).select("s", "a", "b").distinct()
    left, right = prints.select(F.col("row").alias("x"), F.col("seed").alias("s"), F.col("fp").alias("a")), prints.select(F.col("row").alias("y"), F.col("seed").alias("s"), F.col("fp").alias("b"))
    pairs = close.join(left.hint("merge"), ["s", "a"]).join(right.hint("merge"), ["s", "b"]).where("a < b OR x < y").select("x", "y")
    least = common.stored(many.groupBy("key").agg(F.min(F.struct("fp", "first")).alias("least")).select("key", F.col("least.fp").alias("a"), F.col("least.first").alias("x")), "near-least")
    starred = many.join(_sent(least), "key").where(_near("a", "fp", distance)).select("x", F.col("first").alias("y"))
    shared = many.where("n > 1").select("seed", "fp", "first").distinct()
    shared = prints.join(_sent(common.stored(shared, "near-shared")), ["seed", "fp"]).select(F.col("first").alias("x"), F.col("row").alias("y"))
    return common.stored(_ordered(pairs.unionByName(starred).unionByName(shared)), "near-candidates")


def _grouped(rows: DataFrame, row: str, roots: DataFrame, group: str) -> DataFrame:
    """`rows` with the group of the row that a column names; a row without a root is a group of its own."""
    return rows.join(roots.select(F.col("node").alias(row), F.col("root").alias("__root")).hint("merge"), row, "left").withColumn(group, F.coalesce("__root", row)).drop("__root")


def _connected(pairs: DataFrame, roots: DataFrame, texts: DataFrame, sketches: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of `roots` joined further by the pairs (x, y) that are alike.

    Only what connects is looked for: while there are many pairs, every group is compared with one other by a single pair, then
    with up to sixteen times as many, and pairs that have come into one group meanwhile are left out. So the texts that a step
    shuffles are about as many as the groups, however many pairs a group of near copies has.
    """
    left, tries = _likely(pairs, sketches, similarity), 1
    while True:
        left = _grouped(_grouped(left.select("x", "y"), "x", roots, "gx"), "y", roots, "gy").where("gx <> gy")
        left = common.stored(left, "near-left")
        n = left.count()
        if not n:
            return roots
        low, high = F.least("gx", "gy"), F.greatest("gx", "gy")
        chosen = left.select("x", "y", low.alias("low"), high.alias("high"))
        if n > PAIRS_AT_ONCE:
            part = F.pmod(F.xxhash64("low", "x", "y"), F.lit(tries)).alias("part")
            chosen = common.stored(chosen.groupBy("high", part).agg(F.min(F.struct("low", "x", "y")).alias("one")).select("one.*", "high"), "near-chosen")
        found = _alike(chosen.select("x", "y"), texts, shingle, similarity)
        found = common.stored(chosen.join(found.toDF("x", "y").hint("merge"), ["x", "y"]).select(F.col("low").alias("a"), F.col("high").alias("b")), "near-found")
        if not found.isEmpty():
            linked = common.stored(graph.components(found, "near-components"), "near-linked")
            moved = roots.join(linked.toDF("root", "__to").hint("merge"), "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
            alone = linked.join(roots.select("node").hint("merge"), "node", "left_anti")
            roots = common.stored(moved.unionByName(alone.select("node", "root")), "near-roots")
        if n <= PAIRS_AT_ONCE:
            return roots
        left = left.join(chosen.select("x", "y").hint("merge"), ["x", "y"], "left_anti")
        tries *= 16


def _linked(crowds: DataFrame, prints: DataFrame, texts: DataFrame, sketches: DataFrame, shingle: int, similarity: float, distance: int, bucket: int, found: DataFrame) -> DataFrame:
    """(node, root) of the rows that alike candidates connect, all candidates of crowded keys included.

    Under a key of more than `bucket` rows pairs are not formed at once. In each round it names rows outside its largest group,
    which are compared with all its rows of other groups, eight times as many in each round, until every row outside the
    largest group has been named. A pair that was never compared is then of one group already.
    """
    none = found.select(F.col("x").alias("node"), F.col("x").alias("root")).limit(0)
    roots = _connected(found, none, texts, sketches, shingle, similarity)
    many = common.stored(crowds.where(f"rows > {bucket}").select("key", "seed", "fp"), "near-many")
    if many.isEmpty():
        return roots
    inside = common.stored(prints.join(_sent(common.stored(many.select("seed", "fp").distinct(), "near-inside")), ["seed", "fp"]), "near-inside-rows")
    done, names = None, 8
    while True:
        placed = common.stored(_grouped(inside, "row", roots, "group").select("row", "seed", "fp", "group"), "near-placed")
        cells = common.stored(placed.groupBy("seed", "fp", "group").agg(F.count("*").alias("n")), "near-cells")
        held = many.join(cells.hint("merge"), ["seed", "fp"])
        groups = held.groupBy("key", "group").agg(F.sum("n").alias("n"))
        largest = groups.groupBy("key").agg(F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
        largest = common.stored(largest.select("key", F.col("most.group").alias("largest")), "near-largest")
        # Only keys of several groups are left.
        held = common.stored(held.join(_sent(largest), "key").select("key", "seed", "fp", "group", "largest"), "near-held")
        fresh = placed if done is None else placed.join(_sent(done), "row", "left_anti")
        outside = held.where("group <> largest").select("key", "seed", "fp", "group").join(fresh.hint("merge"), ["seed", "fp", "group"])
        named = outside.groupBy("key", F.pmod(F.xxhash64("row"), F.lit(names)).alias("part")).agg(F.min("row").alias("row"))
        named = common.stored(named.select("row").distinct(), "near-named")
        if named.isEmpty():
            return roots
        mine = placed.join(_sent(named), "row").select(F.col("row").alias("x"), "seed", F.col("fp").alias("a"), F.col("group").alias("own"))
        mine = common.stored(mine.join(held.select("key", "seed", F.col("fp").alias("a"), F.col("group").alias("own")).hint("merge"), ["seed", "a", "own"]).select("key", "x", "a", "own"), "near-mine")
        meets = held.join(_sent(mine), "key").where("group <> own").where(_near("a", "fp", distance)).select("x", "seed", "fp", "group").distinct()
        pairs = common.stored(_ordered(placed.join(_sent(common.stored(meets, "near-meets")), ["seed", "fp", "group"]).select("x", F.col("row").alias("y"))), "near-pairs")
        roots = _connected(pairs, roots, texts, sketches, shingle, similarity)
        done = named if done is None else common.stored(done.unionByName(named), "near-done")
        names *= 8


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seeds: Sequence[int] = (42, 43, 44), distance: int = 3, bucket: int = 32) -> DataFrame:
    """`docs` without near copies: of each group the row with the smallest doc_id stays.

    Texts are near copies if their sets of `shingle`-word shingles have a Jaccard similarity of at least `similarity`, which is
    verified for every candidate. Candidates come from fingerprints of single words, which hardly move when a few words of a
    text change, one for each seed: texts whose fingerprints differ in at most `distance` bits for one of the seeds. Texts of
    the same words in the same order are one from the start. Pairs under a key of more than `bucket` rows are compared in
    rounds (`_linked`), which leave out only pairs of rows that are in one group already.
    """
    stored = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "near-texts")
    text = F.coalesce("doc.text", F.lit(""))
    words = F.lower(F.trim(F.regexp_replace(text, common.BLANK, " ")))
    named = common.stored(stored.select("row", F.col("doc.doc_id").alias("doc_id"), F.md5(words).alias("digest")), "near-digests")
    same = common.stored(named.groupBy("digest").agg(F.min("row").alias("head")), "near-heads")
    named = common.stored(named.join(same.hint("merge"), "digest").select("row", "doc_id", "head"), "near-rows")
    texts = stored.select("row", F.col("doc.text").alias("text"))
    prints = with_fingerprints(texts, 1, seeds).join(same.select(F.col("head").alias("row")).hint("merge"), "row", "left_semi")
    prints = common.stored(prints.select("row", F.posexplode("fps").alias("seed", "fp")), "near-fingerprints")

    crowds = None
    for k in range(len(seeds)):
        own = _crowds(prints, distance, k)
        crowds = own if crowds is None else crowds.unionByName(own)
    crowds = common.stored(crowds, "near-crowds")
    found = _first_candidates(crowds, prints, distance, bucket)
    some = found.select(F.col("x").alias("row")).unionByName(found.select(F.col("y").alias("row")))
    crowded = crowds.where(f"rows > {bucket}").select("seed", "fp").distinct()
    some = some.unionByName(prints.join(_sent(common.stored(crowded, "near-crowded-prints")), ["seed", "fp"]).select("row")).distinct()
    sketches = common.stored(_sketches(texts.join(_sent(common.stored(some, "near-some")), "row", "left_semi"), shingle), "near-sketches")
    # Texts without words have no shingles and one digest; they never meet here.
    roots = _linked(crowds, prints, texts, sketches, shingle, similarity, distance, bucket, found)
    groups = named.join(roots.select(F.col("node").alias("head"), "root").hint("merge"), "head", "left").select("row", "doc_id", F.coalesce("root", "head").alias("root"))
    groups = common.stored(groups, "near-groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = common.stored(groups.groupBy("root").agg(least.alias("best")).select("root", F.col("best.row").alias("stays")), "near-best")
    gone = common.stored(groups.join(best.hint("merge"), "root").where("row <> stays").select("row"), "near-gone")
    kept = stored.join(_sent(gone), "row", "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
