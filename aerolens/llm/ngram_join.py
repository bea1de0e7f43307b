"""N-gram Jaccard join with prefix trees.

A document's set is its distinct word n-grams, as 64-bit hashes; documents of one set are one from the start. N-grams are ordered
over all documents, the rarest first. Two sets of sizes m and n that are alike to p percent share at least p(m+n)/(100+p) n-grams,
so they share one among the first few of each (a prefix), and the sets that have a prefix n-gram in common are a group.

Sets of a group are stored in a trie, in the order of falling frequency, so that near copies share long ways. A set that is looked
up walks down from the root with what it shares so far, which all sets below a node have in common; a subtree is left as soon as
what is still to come, there or in the set itself, cannot suffice, or when all in it is linked to the set already.

Before that, sets which have no partner go by counts alone: of any order's first n-grams, k more than a prefix has, two such sets
share k; a set with fewer that any other set has among its first is out. The n-grams' hashes serve as the order there.

First, random parts of the sets that have a least hash in common are compared, which joins most near copies. Then, of every group
that still has several components, the sets outside its largest one are stored in tries and all sets of the group are looked up
there; what one set is to be compared with, for all its groups, meets it in one place. Large groups take rounds, each with eight
times as many sets stored, until every set outside the largest component has been stored once. Links are those that connect; a pair
that was never compared is in one component already, or cannot be alike.

Defined cases: a null, empty or blank text has no set, is linked with nothing and its component is its own doc_id; fewer words than
an n-gram has are one; the component of rows without any doc_id is null; repeated rows are linked; an empty table gives no rows.
Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from aerolens.llm import common, graph

#: At most so many rows of a number or two are sent to every executor; n-grams never are, whatever their number.
SENT = 4_000_000
#: Sets and n-grams of one trie, about.
SETS, GRAMS = 64, 1 << 19
#: Least hashes tried before the prefixes.
CHANCES = 2
#: One in so many n-grams is asked for beyond a prefix by the counts.
EXTRA = 10
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)


def least_overlap(n, percent: int):
    """What a set of n shares at least with a set that is alike to it."""
    return (percent * n + 99) // 100


def grams_of(text: bytes | None, n: int) -> np.ndarray:
    """The distinct n-gram hashes of a text, sorted; of the whole sequence if it has fewer words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size, k = max(len(words) - n + 1, 1), min(n, len(words))
    out = np.full(size, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * MULTIPLIERS[0] + values[j : j + size] * MULTIPLIERS[1]
    out = (out ^ (out >> np.uint64(32))) * MULTIPLIERS[2]
    return np.unique(out ^ (out >> np.uint64(29)))


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SENT else rows


def _named(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(row, doc_id, n_grams, digest, first) of all rows: sets of one digest are equal; `first` are the least n-grams."""
    extra = EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams_of(t, n) for t in batch.column("text").to_pylist()]
            first = [s[: len(s) - least_overlap(len(s), percent) + max(len(s) // extra, 1)].view(np.int64) for s in sets]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), digests, pa.array(first, pa.list_(pa.int64()))], ["row", "doc_id", "n_grams", "digest", "first"])

    given = texts.select("row", "doc_id", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, given.select("row", "doc_id").schema.add("n_grams", "long").add("digest", "binary").add("first", ArrayType(LongType())))


def _likely(named: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows (row, n_grams) of `heads` that share enough of their first n-grams with any others."""
    n_heads = heads.count()
    grams = named.select("row", "first").join(_sent(heads.select("row"), n_heads), "row", "left_semi").select("row", F.explode("first").alias("gram"))
    shared = common.stored(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "join-shared")
    hits = grams.join(shared.hint("merge"), "gram", "left_semi").groupBy("row").agg(F.count("*").alias("hits"))
    return heads.join(hits, "row").where(F.col("hits") >= F.greatest(F.floor(F.col("partner") / EXTRA), F.lit(1))).select("row", "n_grams", "partner")


def _grams(texts: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(gram, row): the n-grams of some rows of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column("row").to_pylist(), batch.column("text").to_pylist()
            held, owners, size = [], [], 0
            for k, text in enumerate(texts):
                held.append(grams_of(text, n))
                owners.append(rows[k])
                size += len(held[-1])
                if size > 1_000_000 or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(owners, [len(h) for h in held]).astype(np.int64))], ["gram", "row"])
                    held, owners, size = [], [], 0

    ours = texts.join(_sent(rows.select("row"), rows.count()), "row", "left_semi")
    return ours.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, "gram long, row long")


def _lists(texts: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """(id, n, partner, ranks): per set its size, what a partner shares, and the ranks of its shared n-grams, the rarest first."""
    grams = _grams(texts, heads, n)
    counts = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    counts = common.stored(counts, "join-counts")
    n_grams = counts.count()
    parts = common.partitions(texts.sparkSession, n_grams, 1_000_000)
    ranks = counts.repartitionByRange(parts, "df", "gram").sortWithinPartitions("df", "gram").select("gram", F.monotonically_increasing_id().alias("rank"))
    ranks = common.stored(ranks, "join-ranks")
    own = grams.join(ranks.hint("merge"), "gram").groupBy("row").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    lists = own.join(heads, "row").select(F.col("row").alias("id"), F.col("n_grams").alias("n"), "partner", "ranks")
    return common.stored(lists.where(F.size("ranks") >= F.col("partner")), "join-lists")


class Node:
    """A stretch of the ways of some sets: what of it they have in common, and what lies below."""

    def __init__(self, grams: np.ndarray, start: int, depth: int):
        self.grams, self.start, self.depth, self.below, self.sets = grams, start, depth, [], []

    def close(self, sets) -> None:
        """Bounds over all sets at and below the node."""
        own = [sets[k] for k in self.sets]
        self.least = min([s["n"] for s in own] + [c.least for c in self.below])
        self.longest = max([self.depth] * bool(own) + [c.longest for c in self.below])
        self.first = min(self.sets + [c.first for c in self.below])
        self.groups = {s["group"] for s in own}.union(*(c.groups for c in self.below))


class Trie:
    """Sets in the order of falling rank, stretches without a branch in one node."""

    def __init__(self, sets: list[dict]):
        order = sorted(range(len(sets)), key=lambda k: sets[k]["way"].astype(">u8").tobytes())
        self.sets = [sets[k] for k in order]
        self.root = Node(np.empty(0, np.int64), 0, 0)
        path, before = [self.root], np.empty(0, np.int64)
        for k, s in enumerate(self.sets):
            way = s["way"]
            m = min(len(way), len(before))
            other = np.flatnonzero(way[:m] != before[:m])
            common_part = int(other[0]) if len(other) else m
            last = None
            while path[-1].depth > common_part:
                last = path.pop()
                last.close(self.sets)
            top = path[-1]
            if top.depth < common_part:
                # The way leaves within a stretch: it is cut there.
                branch = Node(before[top.depth : common_part], top.depth, common_part)
                top.below[-1] = branch
                last.grams, last.start = before[common_part : last.depth], common_part
                branch.below.append(last)
                path.append(branch)
                top = branch
            if top.depth == len(way):
                top.sets.append(k)
            else:
                leaf = Node(way[common_part:], common_part, len(way))
                leaf.sets.append(k)
                top.below.append(leaf)
                path.append(leaf)
            before = way
        while path:
            path.pop().close(self.sets)
        self.vocabulary = np.unique(np.concatenate([s["way"] for s in self.sets]))
        todo = [self.root]
        while todo:
            node = todo.pop()
            node.end = int(node.grams[-1]) if len(node.grams) else None
            node.grams = np.searchsorted(self.vocabulary, node.grams)
            todo += node.below
        self.present = np.zeros(len(self.vocabulary), bool)

    def alike(self, s: dict, percent: int, root_of, own: int | None) -> Iterator[int]:
        """Numbers of the sets that `s` is alike to and not yet in one component with; `own`: only those before it."""
        ranks = s["way"][::-1]
        at = np.searchsorted(self.vocabulary, ranks)
        at = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == ranks)]
        self.present[at] = True
        todo = [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            mine = root_of(s["group"])
            if (own is not None and node.first >= own) or all(root_of(g) == mine for g in node.groups):
                continue
            left = len(ranks)
            if node.end is not None:
                shared += int(np.count_nonzero(self.present[node.grams]))
                left = int(np.searchsorted(ranks, node.end))
            most = shared + min(left, node.longest - node.depth)
            if (100 + percent) * most < percent * (s["n"] + node.least):
                continue
            for k in node.sets:
                other = self.sets[k]
                if (own is None or k < own) and root_of(other["group"]) != root_of(s["group"]) and (100 + percent) * shared >= percent * (s["n"] + other["n"]):
                    yield k
            todo += [(child, shared) for child in node.below]
        self.present[at] = False


def links_of_unit(rows: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets that are stored and sets that are looked up, enough of them to connect all that are alike."""
    parent: dict[int, int] = {}

    def root_of(g: int) -> int:
        while parent.get(g, g) != g:
            parent[g] = parent.get(parent[g], parent[g])
            g = parent[g]
        return g

    for r in rows:
        r["way"] = np.asarray(r["ranks"], np.int64)[::-1]
    stored = [r for r in rows if r["build"]]
    if not stored:
        return
    trie = Trie(stored)
    # Where all sets are both stored and looked up, a pair is met from one side.
    number = {s["id"]: k for k, s in enumerate(trie.sets)} if all(r["build"] and r["probe"] for r in rows) else {}
    for r in rows:
        if not r["probe"]:
            continue
        for k in trie.alike(r, percent, root_of, number.get(r["id"])):
            other = trie.sets[k]
            a, b = root_of(r["group"]), root_of(other["group"])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield r["id"], other["id"]


_UNIT = ["home", "b", "p"]


def _compared(units: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in units (home, b, p, id, group, build, probe), each a trie and the sets looked up in it."""
    units = common.stored(units, "join-units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def found() -> pa.RecordBatch:
            pairs = list(links_of_unit(held, percent))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*_UNIT, "id", "group", "build", "probe", "n")}
            ranks = batch.column("ranks")
            for k in range(batch.num_rows):
                name = tuple(columns[c][k] for c in _UNIT)
                if name != unit:
                    if held:
                        yield found()
                    unit, held = name, []
                row = {c: columns[c][k] for c in ("id", "group", "build", "probe", "n")}
                held.append(row | {"ranks": ranks[k].values.to_numpy()})
        if held:
            yield found()

    rows = lists.select("id", "n", "ranks").join(_sent(units, units.count()), "id").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    spark = lists.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    # Sets may be long: few rows to a batch.
    spark.conf.set(key, "256")
    try:
        return common.stored(rows.mapInArrow(run, "a long, b long"), "join-links")
    finally:
        spark.conf.set(key, before)


def _room(percent: int) -> Column:
    """Sets of one trie in a class of sets."""
    most = F.exp((F.col("class") + 1) * _base(percent))
    return F.greatest(F.least(F.lit(SETS), F.floor(F.lit(GRAMS) / most)), F.lit(2)).cast("int")


def _base(percent: int) -> float:
    """Sets that are alike are of one size class or of neighbours, if a class spans this in the logarithm."""
    return math.log(100 / percent) * 1.0001


def _roots(edges: DataFrame) -> DataFrame:
    return common.stored(graph.components(edges, "join-components"), "join-roots")


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ids with their component, `group`."""
    found = _sent(roots.withColumnRenamed("node", "id"), roots.count())
    return rows.join(found, "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root")


def _by_chance(lists: DataFrame, percent: int) -> DataFrame:
    """(node, root): what random parts of the sets that have one least n-gram hash in common connect, for several hashes."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / _base(percent)).cast("int")
    least = [F.expr(f"struct({seed} as seed, array_min(transform(ranks, r -> named_struct('h', xxhash64(r, {seed}), 'r', r))).r as rank)") for seed in range(CHANCES)]
    keyed = lists.select("id", size_class.alias("class"), F.explode(F.array(*least)).alias("key"))
    keyed = common.stored(keyed.select("id", "class", F.xxhash64("class", "key.seed", "key.rank").alias("home")), "join-keys")
    sizes = keyed.groupBy("home").agg(F.count("*").alias("m"), F.first("class").alias("class")).where("m > 1")
    sizes = common.stored(sizes.select("home", F.ceil(F.col("m") / _room(percent)).alias("parts")), "join-sizes")
    yes = F.lit(True)
    units = keyed.join(_sent(sizes, sizes.count()), "home")
    units = units.select("home", F.pmod(F.xxhash64("id", "home"), "parts").cast("int").alias("b"), F.lit(0).alias("p"), "id", F.col("id").alias("group"), yes.alias("build"), yes.alias("probe"))
    return _roots(_compared(units, lists, percent))


def _linked(lists: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets that links connect."""
    roots = _by_chance(lists, percent)
    size_class = F.floor(F.log(F.col("n").cast("double")) / _base(percent)).cast("int")
    prefix = F.expr("slice(ranks, 1, cast(size(ranks) - partner + 1 as int))")
    members = lists.select("id", F.explode(F.array(size_class, size_class + 1)).alias("class"), prefix.alias("prefix")).select("id", "class", F.explode("prefix").alias("rank"))
    # Groups of one component are settled. Those of the same sets are one: they are told by their number and two hashes.
    members = common.stored(_placed(members, roots), "join-prefixes")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"mark{k}") for k in (1, 2)]
    several = members.groupBy("rank", "class").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("rank", "class")
    several = common.stored(several, "join-several")
    members = common.stored(members.select("rank", "class", "id").join(_sent(several, several.count()), ["rank", "class"]), "join-unsettled")
    groups = members.groupBy("rank", "class").agg(F.count("*").alias("m"), *marks).groupBy("class", "m", "mark1", "mark2").agg(F.min("rank").alias("rank"))
    groups = common.stored(groups.select("rank", "class", "m", _room(percent).alias("room"), F.xxhash64("rank", "class").alias("held")), "join-groups")
    members = common.stored(members.join(_sent(groups, groups.count()), ["rank", "class"]).select("held", "m", "room", "id"), "join-members")
    done, names = None, 8
    yes, no = F.lit(True), F.lit(False)
    while True:
        placed = common.stored(_placed(members, roots), "join-placed")
        top = placed.groupBy("held", "group").agg(F.count("*").alias("k")).groupBy("held").agg(F.max(F.struct("k", "group")).alias("top"), F.count("*").alias("groups"))
        top = common.stored(top.where("groups > 1").select("held", F.col("top.group").alias("largest")), "join-open")
        ours = placed.join(_sent(top, top.count()), "held")
        outside = ours.where(F.col("group") != F.col("largest"))
        if done is not None:
            outside = outside.join(done, ["held", "id"], "left_anti")
        # Of a large group, so many at a time.
        part = F.when(F.col("m") <= F.col("room"), F.xxhash64("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(names)))
        named = common.stored(outside.groupBy("held", part.alias("part")).agg(F.min("id").alias("id")).select("held", "id"), "join-named")
        if named.isEmpty():
            return roots
        # All that a named set is to be compared with, in whichever group, meets it in one place.
        homes = common.stored(named.groupBy("id").agg(F.min("held").alias("home")), "join-homes")
        where = common.stored(named.join(homes, "id").select("held", "home").distinct(), "join-where")
        probe = ours.join(_sent(where, where.count()), "held").select("home", "id", "group", "room").groupBy("home", "id").agg(F.first("group").alias("group"), F.min("room").alias("room"))
        probe = common.stored(probe, "join-probes")
        counts = probe.groupBy("home").agg(F.count("*").alias("m"), F.min("room").alias("room"))
        counts = counts.join(homes.groupBy("home").agg(F.count("*").alias("k")), "home")
        counts = common.stored(counts.select("home", F.ceil(F.col("k") / F.col("room")).cast("int").alias("tries"), F.ceil(F.col("m") / (8 * F.col("room"))).cast("int").alias("parts")), "join-tries")
        build = _placed(homes, roots).join(_sent(counts, counts.count()), "home")
        each = lambda upto: F.explode(F.sequence(F.lit(0), F.col(upto) - 1))
        build = build.select("home", F.pmod(F.xxhash64("id", F.lit(1)), "tries").cast("int").alias("b"), each("parts").alias("p"), "id", "group", yes.alias("build"), no.alias("probe"))
        probe = probe.join(_sent(counts, counts.count()), "home")
        probe = probe.select("home", each("tries").alias("b"), F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int").alias("p"), "id", "group", no.alias("build"), yes.alias("probe"))
        links = _compared(build.unionByName(probe), lists, percent)
        roots = _roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        done = common.stored(named if done is None else done.unionByName(named), "join-done")
        names *= 8


def near_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    texts = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], docs["text"]), "join-texts")
    named = common.stored(_named(texts, n, percent), "join-named-sets")
    some = named.where("n_grams > 0")
    same = some.groupBy("digest").agg(F.min("row").alias("head"), F.first("n_grams").alias("n_grams"), F.min("doc_id").alias("least"))
    same = common.stored(same, "join-heads")
    heads = same.select(F.col("head").alias("row"), "n_grams", F.floor((F.col("n_grams") * percent + 99) / 100).alias("partner"))
    likely = common.stored(_likely(named, heads), "join-likely")
    roots = _linked(_lists(texts, likely, n), percent)
    rooted = same.join(roots.withColumnRenamed("node", "head"), "head", "left").select("digest", "least", F.coalesce("root", "head").alias("root"))
    rooted = common.stored(rooted, "join-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = common.stored(rooted.join(least, "root").select("digest", "component_id"), "join-component-ids")
    out = some.join(known, "digest").select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")
    return out.unionByName(named.where("n_grams = 0").select("doc_id", F.col("n_grams").alias("n_shingles"), F.col("doc_id").alias("component_id")))
