"""Conversation structure repair by Hirschberg's divide and conquer.

Rows of a conversation, in order, are edited until the initials of their roles read (s?(ua)+)?: a row is kept (K), given the role
user or assistant (R), or deleted (D); rows of empty text may be inserted (I). What has been written so far is one of four
states: nothing, a system row, a user row, an assistant row. A row only matters by its role's initial and its fault, so it is a
small table of moves between states: for each pair the cheapest edits, of these the ASCII-least.

Between two known states the rows are halved: a four-state vector of costs runs forward over the first half, another backward
over the second, and where they meet the cheapest crossing is chosen, of these the one of the least audit; both halves are then
solved likewise. Forward costs carry the rank of their audits: those that end in different states differ in a letter that both
have, so ranks keep their order whatever follows, and no audit is held to be compared. Space is linear.

Rows are sorted and cut into blocks by range, wherever conversations end, so a long one is spread over tasks. A block is a table
of moves itself; tables of `fan` blocks are joined to that of their parent, level by level, and the states chosen at the top are
handed down by the same halving. Short conversations are one block and need no levels.

Defined cases: a null role or text is one space, a null conv_id is a conversation of its own, a null turn comes first. Rows of one
turn are ordered by role, then by the MD5 of the text. A row is at fault if it is blank, repeats an earlier role and text, or
does not end with a sentence mark, whichever is first; the former two must be deleted. A role of another initial than s, u or a,
or an empty one, cannot be kept. An empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from aerolens.llm import common

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The only role that may be written next, unless a conversation starts with a system row.
NEXT = (USER, USER, ASSISTANT, USER)
#: Rows to insert at the end.
MISSING = (0, 2, 1, 0)
#: A row that must go; other rows are numbered by role and by whether they are cut off.
DEAD = 8
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a block, and blocks of one parent.
BLOCK, FAN = 1024, 256

Moves = tuple[tuple[tuple[int, object], ...], ...]


def _row_moves(kind: int) -> Moves:
    """For each state before and after the row: (cost, edits), the cheapest and of these the least."""
    table = []
    for state in range(4):
        best: list[tuple[int, str]] = [(FAR, "")] * 4
        at, cost, role, cut = state, 0, kind // 2, kind % 2 * CUT
        for edits in ("", "I", "II"):
            ways = [(at, DELETE, "D")]
            if kind != DEAD:
                ways.append((NEXT[at], REROLE + cut, "R"))
                if role == NEXT[at] or (role == SYSTEM and at == START):
                    ways.append((role, KEEP + cut, "K"))
            for to, more, letter in ways:
                best[to] = min(best[to], (cost + more, edits + letter))
            at, cost = NEXT[at], cost + INSERT
        table.append(tuple(best))
    return tuple(table)


ROW_MOVES = tuple(_row_moves(k) for k in range(DEAD + 1))
Ahead = tuple[tuple[int, int], ...]


#: Steps that a task has taken before; vectors differ little, so there are few.
_STEPS: dict[tuple, tuple] = {}
KEPT_STEPS = 50_000


def _step(kind, vector: tuple, moves: Moves) -> tuple:
    found = _STEPS.get((kind, vector, moves))
    if found is None:
        if len(_STEPS) >= KEPT_STEPS:
            _STEPS.clear()
        found = _STEPS[kind, vector, moves] = _ahead(vector, moves) if kind else _to_go(vector, moves)
    return found


def _forward(ahead: Ahead, moves: Moves) -> tuple[int, Ahead]:
    return _step(True, ahead, moves)


def _backward(moves: Moves, to_go: tuple[int, ...]) -> tuple[int, ...]:
    return _step(False, to_go, moves)


def _ahead(ahead: Ahead, moves: Moves) -> tuple[int, Ahead]:
    """One step of a forward vector of (cost, rank of the audit); what its least cost has grown by, and the rest."""
    best = []
    for to in range(4):
        ways = [(cost + moves[at][to][0], rank, moves[at][to][1]) for at, (cost, rank) in enumerate(ahead) if cost < FAR and moves[at][to][0] < FAR]
        best.append(min(ways) if ways else None)
    order = sorted({b[1:] for b in best if b})
    least = min(b[0] for b in best if b)
    return least, tuple((b[0] - least, order.index(b[1:])) if b else (FAR, 9) for b in best)


def _to_go(to_go: tuple[int, ...], moves: Moves) -> tuple[int, ...]:
    """One step of a backward vector of costs, its least taken off."""
    costs = [min(min(cost, FAR) + more for (cost, _), more in zip(row, to_go)) for row in moves]
    return tuple(min(c - min(costs), FAR) for c in costs)


def _only(state: int) -> Ahead:
    return tuple((0, 0) if k == state else (FAR, 9) for k in range(4))


def run_over(state: int, tables: Sequence[Moves]) -> list[tuple[int, int]]:
    """(cost, rank) of each state after all tables, from one state."""
    ahead, total = _only(state), 0
    for moves in tables:
        more, ahead = _forward(ahead, moves)
        total += more
    return [(c + total, r) if c < FAR else (FAR, r) for c, r in ahead]


def joined_moves(tables: Sequence[Moves]) -> Moves:
    """The moves over all tables in a row; ranks order the audits that leave one state."""
    return tuple(tuple(run_over(state, tables)) for state in range(4))


def last_state(moves: Moves) -> int:
    """The state in which a whole conversation ends before rows are inserted at its end."""
    return min((cost + INSERT * MISSING[k], rank, k) for k, (cost, rank) in enumerate(moves[START]) if cost < FAR)[2]


def crossings(tables: Sequence[Moves], first: int, last: int) -> list[int]:
    """The states before, between and after the tables on the least audit of the cheapest edits."""
    states = [first] * len(tables) + [last]
    todo = [(0, len(tables))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        ahead = _only(states[low])
        for moves in tables[low:middle]:
            ahead = _forward(ahead, moves)[1]
        to_go = tuple(0 if k == states[high] else FAR for k in range(4))
        for moves in reversed(tables[middle:high]):
            to_go = _backward(moves, to_go)
        states[middle] = min((cost + more, rank, k) for k, ((cost, rank), more) in enumerate(zip(ahead, to_go)) if cost < FAR and more < FAR)[2]
        todo += [(low, middle), (middle, high)]
    return states


def _packed(moves: Moves) -> list[int]:
    return [x for row in moves for pair in row for x in pair]


def _unpacked(flat: Sequence[int]) -> Moves:
    return tuple(tuple((flat[k + j], flat[k + j + 1]) for j in range(0, 8, 2)) for k in range(0, 32, 8))


_COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
_EDGES = "first string, last string, low long, high long"
_SUMMARY = "moves array<long>, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + _EDGES
_KEY = "struct<turn:long,role:string,digest:binary>"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au") and len(a) == 1


def _in_sequence(parts: Sequence[Row]) -> dict:
    """One summary of neighbouring ones; turns are in order, so a turn that two share is the last of one and the next one's first."""
    out = {c: sum(p[c] for p in parts) for c in _COUNTS}
    out["moves"] = _packed(joined_moves([_unpacked(p["moves"]) for p in parts]))
    for a, b in zip(parts, parts[1:]):
        out["illegal"] += not _legal(a["last"], b["first"])
        out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    known = [p for p in parts if p["high"] is not None]
    return out | {"first": parts[0]["first"], "last": parts[-1]["last"], "low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None}


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: str, seq: int):
        self.conv, self.seq, self.kinds, self.keys = conv, seq, bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, row: dict, n: int, fresh: bool) -> None:
        """`n` copies of a row, of which the first is no copy if it is `fresh`."""
        initial = row["role"][:1]
        self.illegal += (self.last is not None and not _legal(self.last, initial)) + n - 1
        if self.last is None:
            self.first = initial
        self.last = initial
        if row["turn"] is not None:
            self.turns += self.high != row["turn"]
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]
        if row["blank"]:
            self.blank += n
        else:
            self.duplicate += n - fresh
            self.truncated += fresh and row["cut"]
        if fresh and not row["blank"]:
            self.kinds.append(INITIALS.get(initial, 0) * 2 + row["cut"])
            self.keys.append({"turn": row["turn"], "role": row["role"], "digest": row["digest"]})
            n -= 1
        self.kinds += bytes([DEAD]) * n

    def row(self, task: int) -> dict:
        out = {"conv": self.conv, "task": task, "seq": self.seq, "kinds": bytes(self.kinds), "keys": self.keys, "n": len(self.kinds)}
        out |= {c: int(getattr(self, c)) for c in _COUNTS[1:]} | {c: getattr(self, c) for c in ("first", "last", "low", "high")}
        return out | {"moves": _packed(joined_moves([ROW_MOVES[k] for k in self.kinds]))}


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, each, schema) -> DataFrame:
    """`each(rows, task)` over the rows of a partition, as dicts; it may give any number of rows."""
    from pyspark.sql.types import StructType

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow, out = _arrow(kind), []
        for row in each((r for b in batches for r in b.to_pylist()), TaskContext.get().partitionId()):
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, kind)


def conversation_key(conv_id: Column) -> Column:
    """A conversation's id as text that tells null from all others."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _prepared(rows: DataFrame) -> DataFrame:
    given = rows.select(conversation_key(rows["conv_id"]).alias("conv"), rows["turn"].cast("long").alias("turn"), *[F.coalesce(rows[c], F.lit(" ")).alias(c) for c in ("role", "text")])
    return given.withColumn("digest", F.unhex(F.md5("text")))


class Repair:
    """The repair of all conversations: `report`, one row for each, and `rows`, what they are repaired to."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, fan: int = FAN):
        self.given, self.block, self.fan = _prepared(rows), block, fan
        self.spark = rows.sparkSession
        self.blocks = self._blocks()
        self.nodes, self.groups = [self.blocks], []
        self._up()
        self.aligned = self._down()

    def _blocks(self) -> DataFrame:
        """Blocks of neighbouring rows with their summaries; numbered within the conversation by task, then within the task."""
        end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
        slim = self.given.select("conv", "turn", "role", "digest", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
        # Equal rows of one turn follow each other: one row stands for them.
        slim = common.stored(slim.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies")), "turns")
        where = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        firsts = slim.groupBy("conv", "role", "digest").agg(F.min(where).alias("at"))
        marked = slim.join(firsts, ["conv", "role", "digest"]).withColumn("fresh", where.eqNullSafe(F.col("at"))).drop("at")
        order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
        n = common.partitions(self.spark, slim.count(), 200_000)
        marked = marked.repartitionByRange(n, *order).sortWithinPartitions(*order)
        block = self.block

        def each(rows, task):
            at = None
            for row in rows:
                if at is None or at.conv != row["conv"]:
                    if at is not None:
                        yield at.row(task)
                    at = _Block(row["conv"], 0)
                left, fresh = row["copies"], row["fresh"]
                while left:
                    if len(at.kinds) >= block:
                        yield at.row(task)
                        at = _Block(row["conv"], at.seq + 1)
                    some = min(left, block - len(at.kinds))
                    at.add(row, some, fresh)
                    left, fresh = left - some, False
            if at is not None:
                yield at.row(task)

        cut = _mapped(marked, each, f"conv string, task int, seq int, kinds binary, keys array<{_KEY}>, {_SUMMARY}")
        cut = common.stored(cut, "turn-blocks")
        # A conversation has blocks in several tasks only where these begin or end with it.
        own = cut.groupBy("conv", "task").agg(F.count("*").alias("k"))
        from pyspark.sql import Window

        so_far = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        own = own.select("conv", "task", F.coalesce(F.sum("k").over(so_far), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy("conv")).alias("blocks"))
        return common.stored(cut.join(own, ["conv", "task"]).withColumn("no", F.col("before") + F.col("seq")).drop("before", "seq", "task"), "numbered-blocks")

    def _up(self) -> None:
        """Levels of parents, each of up to `fan` neighbours, until every conversation has a single top."""
        most = self.blocks.agg(F.max("blocks")).first()[0] or 0
        size = 1
        fields = [c.strip().split()[0] for c in _SUMMARY.split(",")]
        while size < most:
            many = self.nodes[-1].where(F.col("blocks") > size)
            group = many.groupBy("conv", "blocks", F.floor(F.col("no") / self.fan).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("no", *fields))).alias("children"))
            self.groups.append(common.stored(group, "block-groups"))

            def each(rows, task):
                for row in rows:
                    yield {"conv": row["conv"], "blocks": row["blocks"], "no": row["parent"]} | _in_sequence(row["children"])

            self.nodes.append(common.stored(_mapped(self.groups[-1], each, f"conv string, blocks long, no long, {_SUMMARY}"), "block-parents"))
            size *= self.fan

    def tops(self) -> DataFrame:
        """One row for each conversation that has rows: the summary of all of them."""
        out, size = None, 1
        fields = ["conv"] + [c.strip().split()[0] for c in _SUMMARY.split(",")]
        for level in self.nodes:
            own = F.col("blocks") == 1 if size == 1 else (F.col("blocks") > size // self.fan) & (F.col("blocks") <= size)
            top = level.where(own).select(*fields)
            out, size = top if out is None else out.unionByName(top), size * self.fan
        return out

    def _down(self) -> DataFrame:
        """Per block: the letters of its edits, their cost, the rows that stay, and the roles inserted at the conversation's end."""
        states = None
        size = self.fan ** len(self.groups)
        for group in reversed(self.groups):
            size //= self.fan
            top = group.where(F.col("blocks") <= size * self.fan).withColumns({"s": F.lit(START), "e": F.lit(-1)})
            if states is not None:
                top = top.unionByName(group.join(states.withColumnRenamed("no", "parent"), ["conv", "parent"]).select(*top.columns))

            def each(rows, task):
                for row in rows:
                    tables = [_unpacked(c["moves"]) for c in row["children"]]
                    e = last_state(joined_moves(tables)) if row["e"] < 0 else row["e"]
                    found = crossings(tables, row["s"], e)
                    for child, s, t in zip(row["children"], found, found[1:]):
                        yield {"conv": row["conv"], "no": child["no"], "s": s, "e": t}

            states = common.stored(_mapped(top, each, "conv string, no long, s int, e int"), "block-states")
        placed = self.blocks.where("blocks = 1").withColumns({"s": F.lit(START), "e": F.lit(-1)})
        if states is not None:
            placed = placed.unionByName(self.blocks.where("blocks > 1").join(states, ["conv", "no"]).select(*placed.columns))

        def each(rows, task):
            for row in rows:
                tables = [ROW_MOVES[k] for k in row["kinds"]]
                e = last_state(_unpacked(row["moves"])) if row["e"] < 0 else row["e"]
                states = crossings(tables, row["s"], e)
                keys, audit, edits, cost = iter(row["keys"]), [], [], 0
                for k, s, t in zip(row["kinds"], states, states[1:]):
                    price, letters = ROW_MOVES[k][s][t]
                    cost += price
                    audit.append(letters)
                    key = next(keys) if k != DEAD else None
                    if letters[-1] != "D":
                        before = []
                        for _ in letters[:-1]:
                            s = NEXT[s]
                            before.append(ROLES[s])
                        edits.append(key | {"before": before, "new_role": ROLES[t] if letters[-1] == "R" else None})
                end = []
                if row["no"] == row["blocks"] - 1:
                    s = e
                    for _ in range(MISSING[e]):
                        s = NEXT[s]
                        end.append(ROLES[s])
                    cost += INSERT * len(end)
                    audit.append("I" * len(end))
                yield {"conv": row["conv"], "no": row["no"], "audit": "".join(audit), "cost": cost, "edits": edits, "ending": end}

        edit = "array<struct<turn:long,role:string,digest:binary,before:array<string>,new_role:string>>"
        return common.stored(_mapped(placed, each, f"conv string, no long, audit string, cost long, edits {edit}, ending array<string>"), "block-edits")

    def report(self) -> DataFrame:
        """conv (`conversation_key`), gaps, blank, duplicate, truncated, illegal, cost, audit."""
        audits = self.aligned.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
        return self.tops().join(audits, "conv").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def rows(self) -> DataFrame:
        """conv, place, role, text of the repaired conversations.

        The edits of a row and the row itself meet in one sorted stream; no conversation is held whole, and its rows come out next
        to each other, in order, in one partition.
        """
        edits = self.aligned.select("conv", F.lit(0).alias("ended"), F.explode("edits").alias("x")).select("conv", "ended", "x.*", F.lit(0).alias("given"), F.lit(None).cast("string").alias("text"))
        blank = {"turn": "long", "role": "string", "digest": "binary", "new_role": "string", "text": "string"}
        ends = self.aligned.where(F.size("ending") > 0).select("conv", F.lit(1).alias("ended"), F.col("ending").alias("before"), F.lit(0).alias("given"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
        texts = self.given.select("conv", F.lit(0).alias("ended"), "turn", "role", "digest", F.lit(1).alias("given"), "text", F.lit(None).cast("array<string>").alias("before"), F.lit(None).cast("string").alias("new_role"))
        stream = edits.unionByName(ends).unionByName(texts).repartition("conv")
        stream = stream.sortWithinPartitions("conv", "ended", F.asc_nulls_first("turn"), "role", "digest", "given")

        def each(rows, task):
            conv, place, edit = None, 0, None
            for row in rows:
                if row["conv"] != conv:
                    conv, place, edit = row["conv"], 0, None
                key = (row["turn"], row["role"], row["digest"])
                if not row["given"]:
                    for role in row["before"]:
                        yield {"conv": conv, "place": place, "role": role, "text": ""}
                        place += 1
                    edit = None if row["ended"] else (key, row["new_role"] or row["role"])
                elif edit is not None and edit[0] == key:
                    yield {"conv": conv, "place": place, "role": edit[1], "text": row["text"]}
                    place, edit = place + 1, None

        return _mapped(stream, each, "conv string, place long, role string, text string")
