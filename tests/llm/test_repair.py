"""Conversation repair against a shortest-path search in plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from georesolve.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLES, TEXTS = ["user", "assistant", "system", None, "", "umpire"], ["Yes.", "No", "  ", "", "Why?", "ok ok. \n", None, "a!b", "no end " * 3]


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[c] += [] if code == 0 else [(t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(turns, faults):
    """Cost, audit and text of the cheapest repair: edits are edges, the first to arrive is cheapest and ASCII-least."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, text = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, "\n".join(text)
        if (i, state) in done:
            continue
        done.add((i, state))
        roles = [r for r in ("user", "assistant") if r[0] in NEXT[state]]
        for r in roles:
            heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state][r[0]], (*text, r + ":")))
        if i == len(turns):
            continue
        _, role, said = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, text))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 3 * (faults[i] == "truncated")
        if role[:1] in NEXT[state]:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state][role[:1]], (*text, f"{role}:{said}")))
        for r in roles:
            heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, NEXT[state][r[0]], (*text, f"{r}:{said}")))


def expected(rows):
    out = {}
    for c, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            rest = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers, initials = {t for t, _, _ in turns if t is not None}, [r[:1] for _, r, _ in turns]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(turns, faults)
        out[c] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made_up(seed):
    rng = random.Random(seed)
    return [(c, rng.choice([None, *range(12)]), rng.choices(ROLES, [5, 5, 2, 1, 1, 1])[0], rng.choice(TEXTS)) for c in [None, *range(150)] for _ in range(rng.randint(1, 9))]


@pytest.mark.parametrize("block", [512, 3])
def test_reports_are_those_of_a_shortest_path(spark, monkeypatch, block):
    """Conversations of one block and of many."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made_up(block)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("block"), F.lit("x").alias("fault"), F.lit(2).alias("turns")).repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.reported(df).collect()}
    assert got == expected(rows)


def test_given_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.reported(df).collect()}
    assert got == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversation_in_blocks(spark):
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 11 else "system", f"turn {i % 900}" + "." * (i % 3 > 0)) for i in range(2500)]
    (got,) = repair.reported(spark.createDataFrame(rows, SCHEMA)).collect()
    assert tuple(got[c] for c in COLUMNS) == expected(rows)[7]


def test_no_rows_and_nothing_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.reported(empty).count() == 0 and repair.repaired(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = repair.reported(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_alternating(spark):
    turns = repair.blocks(repair.with_faults(spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B.")], SCHEMA)))
    (r,) = turns.select(repair.repaired_turns(F.col("turns"), F.lit("KRK"), F.lit(0)).alias("out")).collect()
    assert [(t["edit"], t["turn"], t["role"], t["text"]) for t in r["out"]] == [("K", 0, "system", "S."), ("R", 1, "user", "A."), ("K", 2, "assistant", "B.")]
