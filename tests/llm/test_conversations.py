"""Conversation repair against all edits of short conversations, in one block and in many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from aerolens.llm import conversations, query_conversations
from aerolens.llm.queries import QUERIES

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, conv string, n long, audit string, task int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        hit = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def shortest(rows):
    """(cost, audit, repaired) by a whole table of the least (cost, audit) over states, row by row."""
    best = {"": (0, "", ())}  # by the initial of the last row written
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for at, (cost, audit, done) in list(out.items()):
                to = nexts[at]
                new = (cost + 2, audit + "I", done + ((names[to], ""),))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    # Each state keeps every cheapest audit's least; a dearer or later one never leads to the least result.
    for role, text, fault in rows:
        after = {}

        def put(to, new):
            if to not in after or new[:2] < after[to][:2]:
                after[to] = new

        for at, (cost, audit, done) in with_inserts(best).items():
            put(at, (cost + 3, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            to = nexts[at]
            put(to, (cost + 2 + cut, audit + "R", done + ((names[to], text),)))
            if role[:1] == to or (at == "" and role[:1] == "s"):
                put(role[:1], (cost + cut, audit + "K", done + ((role, text),)))
        best = after
    return min(v for at, v in with_inserts(best).items() if at in ("", "a"))


def brute(rows):
    """The contract, conversation by conversation; `rows` before the damage."""
    kept = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = BLANK.sub("", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, done = shortest([(r[2], r[3], f) for r, f in zip(own, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op11_repair_conversations"](spark, sf).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == brute([tuple(r) for r in rows])
    assert len(got) == len({r.conv_id for r in rows})


def awkward():
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 4, "", "x."), (2, 7, "tool", "y"), (2, 7, "assistant", "long " * 50_000), (3, 1, "User", "é ü "), (5, 0, "system", "s."), (6, 5, "user", "same."), (6, 5, "user", "same."), (6, 9, "user", "same.")]
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 40)):
            rows.append((conv, rng.choice([turn, turn, turn, turn // 3, None]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a.", "b?", "", " \t", "cut", "word " * rng.randrange(5) + "end!"])))
    return rows


@pytest.mark.parametrize("block, fan", [(1024, 256), (3, 2), (1, 3)])
def test_awkward_rows_in_blocks_of_any_size(spark, block, fan):
    rows = awkward()
    table = spark.createDataFrame([(*r, "c", 1, "a", 2) for r in rows], SCHEMA).repartition(3)
    repair = conversations.Repair(query_conversations.damaged(table), block, fan)
    report = {r.conv: r for r in repair.report().collect()}
    texts = {}
    for r in repair.rows().collect():
        texts.setdefault(r.conv, []).append((r.place, f"{r.role}:{r.text}"))
    want = brute(rows)
    for conv, values in want.items():
        key = "" if conv is None else f"={conv}"
        lines = [t for _, t in sorted(texts.get(key, []))]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == values[-1], conv
        assert (tuple(report[key][f] for f in FIELDS[:-1]) if key in report else (0, 0, 0, 0, 0, 0, "")) == values[:-1], conv


def test_one_long_conversation_is_cut_into_blocks(spark):
    n = 30_000
    rows = spark.range(0, n, 1, 7).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 5 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    repair = conversations.Repair(rows.withColumnRenamed("id", "turn"), 100, 8)
    assert repair.blocks.count() >= n // 100 and len(repair.groups) >= 3
    cost, audit, _ = shortest([("user" if k % 5 == 0 else "assistant", f"{k}.", "") for k in range(2_000)])
    short = conversations.Repair(rows.withColumnRenamed("id", "turn").where("turn < 2000"), 100, 8).report().first()
    assert (short.cost, short.audit) == (cost, audit)
    got = repair.report().first()
    assert len(got.audit) - got.audit.count("I") == n


def test_crossings_are_the_least_of_all_edits():
    """All kinds of three rows: the least audit of the cheapest, found by trying every path through the moves."""
    for kinds in itertools.product((2, 4, 5, 6, 8), repeat=3):
        tables = [conversations.ROW_MOVES[k] for k in kinds]
        end = conversations.last_state(conversations.joined_moves(tables))
        states = conversations.crossings(tables, conversations.START, end)
        ways = []
        for path in itertools.product(range(4), repeat=3):
            steps = [t[a][b] for t, a, b in zip(tables, (0, *path), path)]
            if all(c < conversations.FAR for c, _ in steps):
                missing = conversations.MISSING[path[-1]]
                ways.append((sum(c for c, _ in steps) + 2 * missing, "".join(w for _, w in steps) + "I" * missing))
        assert min(ways)[1] == "".join(t[a][b][1] for t, a, b in zip(tables, states, states[1:])) + "I" * conversations.MISSING[end]


def test_empty_table(spark):
    repair = conversations.Repair(spark.createDataFrame([], SCHEMA))
    assert repair.report().count() == 0 and repair.rows().count() == 0
