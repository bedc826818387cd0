"""Repair of conversations: the cheapest edits that make roles alternate, as a fold of native expressions.

The roles of a sound conversation are an optional system turn, then pairs of user and assistant. A
turn's faults come from windows (what was said before) and patterns; a conversation's sorted turns are
folded by ``aggregate()``, which carries for each of four states (nothing yet, after the system turn,
after a user's, after an assistant's) the cheapest cost and, of equally cheap ones, the ASCII-least
audit: the initials of Keep, Rerole, Delete and Insert. Costs follow from the audit and the rows alone,
so two audits of one state and cost never are each other's prefix, and the least one stays the least
whatever follows.

Turns are folded in blocks of BLOCK turn numbers. A conversation of several blocks is folded a block at
a time from each of the four states, and a second fold chains the blocks' sixteen results; texts stay
in their blocks, and what travels for each conversation is its audit. No step holds a whole conversation's
texts: the digest of many blocks is taken piece by piece.

Defined results: null roles and texts are one space (such a text is blank, such a role never legal); null
conversations are one conversation; null turns come first, in one block. Turns of one number are ordered by role
and text, equal rows side by side; many rows of one turn number are one block whatever their number. No rows: nothing
to repair, an empty audit. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, for_python

#: Turn numbers of one block.
BLOCK = 512
# Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ["su", "ua", "au"]
# States of the fold: what the repaired turns end with so far.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
PATH = "struct<cost:bigint,audit:string>"
TURN = "struct<edit:string,turn:bigint,role:string,text:string>"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after damage by crc32 of conv_id:turn: dropped, emptied, unpunctuated, repeated, made a user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.pmod(F.crc32(key), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("__copies"),
        code.alias("__code"),
    )
    return hurt.where("__code <> 0").select("conv_id", "turn", "role", "text", F.explode("__copies").alias("__copy")).drop("__copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault: the first that counts of blank, duplicate, truncated; else null."""
    said = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    text = F.coalesce("text", F.lit(" "))
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.row_number().over(said) > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return clean.withColumn("fault", fault)


def block_of(turn: Column) -> Column:
    return F.floor(turn.cast("long") / BLOCK).cast("long")


def blocks(faulted: DataFrame) -> DataFrame:
    """conv_id, block, turns: the turns of each block in order, as structs turn, role, text, later, fault."""
    turn = F.struct("turn", "role", "text", (F.col("fault") == "duplicate").eqNullSafe(True).alias("later"), "fault")
    return faulted.groupBy("conv_id", block_of(F.col("turn")).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _edited(path: Column, cost: Column | int, letter: str, allowed: Column | bool = True) -> Column:
    """The path with one more edit; null if there is none or the edit isn't allowed."""
    more = F.struct((path["cost"] + cost).cast("long").alias("cost"), F.concat(path["audit"], F.lit(letter)).alias("audit"))
    return F.when(path.isNotNull() & F.lit(allowed), more)


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _states(*q: Column) -> Column:
    return F.struct(*[c.cast(PATH).alias(f"q{i}") for i, c in enumerate(q)])


def _inserted(s: Column) -> Column:
    """The states after inserts: a user's turn from anywhere but behind one, then an assistant's behind it."""
    user = F.least(s["q2"], *[_edited(s[f"q{e}"], INSERT, "I") for e in (EMPTY, SYSTEM, ASSISTANT)])
    return _let(_states(s["q0"], s["q1"], user, s["q3"]), lambda t: _states(t["q0"], t["q1"], t["q2"], F.least(t["q3"], _edited(t["q2"], INSERT, "I"))))


def _advanced(s: Column, turn: Column) -> Column:
    """The states after one turn was kept, given another role or deleted."""
    kept = F.coalesce(~turn["fault"].isin("blank", "duplicate"), F.lit(True))
    cut = F.when(turn["fault"].eqNullSafe(F.lit("truncated")), TRUNCATED).otherwise(0)
    is_ = lambda letter: kept & (initial(turn["role"]) == letter)
    before_user = [s["q0"], s["q1"], s["q3"]]
    return _states(
        _edited(s["q0"], DELETE, "D"),
        F.least(_edited(s["q1"], DELETE, "D"), _edited(s["q0"], cut, "K", is_("s"))),
        F.least(_edited(s["q2"], DELETE, "D"), *[_edited(q, cut, "K", is_("u")) for q in before_user], *[_edited(q, cut + REROLE, "R", kept) for q in before_user]),
        F.least(_edited(s["q3"], DELETE, "D"), _edited(s["q2"], cut, "K", is_("a")), _edited(s["q2"], cut + REROLE, "R", kept)),
    )


def folded(turns: Column, entry: int = EMPTY) -> Column:
    """The four states after the turns, from one state before them: structs cost, audit; null where none leads there."""
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    nothing = F.lit(None).cast(PATH)
    begin = _inserted(_states(*[start if s == entry else nothing for s in STATES]))
    return F.aggregate(turns, begin, lambda s, t: _inserted(_advanced(s, t)))


def _ends(states: Column) -> Column:
    """Where a sound conversation may end: nowhere yet, or behind an assistant's turn."""
    return F.least(states["q0"], states["q3"])


def repaired_turns(turns: Column, audit: Column, entry: Column) -> Column:
    """What the audit makes of the turns: structs edit, turn, role, text of those that are left or new."""
    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    none = F.struct(F.lit(0).alias("at"), entry.cast("int").alias("state"), F.array().cast(f"array<{TURN}>").alias("out"))

    def step(s: Column, edit: Column) -> Column:
        old = F.try_element_at(turns, s["at"] + 1)
        keeps, inserts = edit == "K", edit == "I"
        role = F.when(keeps, old["role"]).when(s["state"] == USER, "assistant").otherwise("user")
        state = F.when(initial(role) == "s", SYSTEM).when(initial(role) == "u", USER).otherwise(ASSISTANT)
        new = F.struct(edit.alias("edit"), F.when(~inserts, old["turn"]).alias("turn"), role.alias("role"), F.when(inserts, "").otherwise(old["text"]).alias("text")).cast(TURN)
        return F.struct(
            (s["at"] + F.when(inserts, 0).otherwise(1)).cast("int").alias("at"),
            F.when(edit == "D", s["state"]).otherwise(state).cast("int").alias("state"),
            F.when(edit == "D", s["out"]).otherwise(F.concat(s["out"], F.array(new))).alias("out"),
        )

    return F.aggregate(letters, none, step, lambda s: s["out"])


def rendered(out: Column) -> Column:
    """role:text of repaired turns, a line each."""
    return F.array_join(F.transform(out, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def counted(blocks_: DataFrame) -> DataFrame:
    """blocks with what a conversation's counts add up from."""
    turns, numbers = F.col("turns"), F.col("turns.turn")
    n = lambda fault: F.size(F.filter(turns, lambda t: t["fault"] == fault)).cast("long")
    letters = F.transform(turns, lambda t: initial(t["role"]))
    # A role with no initial still stands between its neighbours.
    pairs = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1), lambda a, b: F.concat(a, b))
    return blocks_.withColumns(
        {
            "low": F.array_min(numbers),
            "high": F.array_max(numbers),
            "distinct": F.size(F.array_distinct(F.filter(numbers, lambda t: t.isNotNull()))).cast("long"),
            "blank": n("blank"),
            "duplicate": n("duplicate"),
            "truncated": n("truncated"),
            "illegal": F.when(F.size(letters) > 1, F.size(F.filter(pairs, lambda p: ~p.isin(LEGAL)))).otherwise(0).cast("long"),
            "first": F.element_at(letters, 1),
            "last": F.element_at(letters, -1),
        }
    )


def gaps(low: Column, high: Column, distinct: Column) -> Column:
    return F.coalesce(high - low + 1 - distinct, F.lit(0)).cast("long")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows."""
    spread = rows.select("conv_id", block_of(F.col("turn")).alias("block")).distinct().groupBy("conv_id").count().where("count > 1")
    several = checkpointed(spread.select(F.col("conv_id").alias("__several")))
    parts = blocks(with_faults(rows))
    if several.isEmpty():
        return _of_one_block(parts)
    parts = checkpointed(parts)
    long = F.col("conv_id").eqNullSafe(F.col("__several"))
    return _of_one_block(parts.join(several, long, "left_anti")).unionByName(_of_blocks(parts.join(several, long, "left_semi")))


def _of_one_block(parts: DataFrame) -> DataFrame:
    best = counted(parts).withColumn("best", _ends(folded(F.col("turns"))))
    text = rendered(repaired_turns(F.col("turns"), F.col("best.audit"), F.lit(EMPTY)))
    return best.select("conv_id", gaps(F.col("low"), F.col("high"), F.col("distinct")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.sha2(text, 256).alias("repaired_sha256"))


def chained(parts: Column) -> Column:
    """Struct cost, audit, exits of the best way through blocks (structs block, ways: sixteen results by entry and exit state)."""
    path = "struct<cost:bigint,audit:string,exits:string>"
    nothing = F.lit(None).cast(path)
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("exits"))
    begin = F.struct(*[(start if s == EMPTY else nothing).alias(f"q{s}") for s in STATES])

    def step(s: Column, part: Column) -> Column:
        def through(e: int, x: int) -> Column:
            old, way = s[f"q{e}"], part["ways"][4 * e + x]
            more = F.struct((old["cost"] + way["cost"]).alias("cost"), F.concat(old["audit"], way["audit"]).alias("audit"), F.concat(old["exits"], F.lit(str(x))).alias("exits"))
            return F.when(old.isNotNull() & way.isNotNull(), more).cast(path)

        return F.struct(*[F.least(*[through(e, x) for e in STATES]).alias(f"q{x}") for x in STATES])

    return F.aggregate(parts, begin, step, _ends)


def _of_blocks(parts: DataFrame) -> DataFrame:
    """The same for conversations of several blocks."""
    ways = F.flatten(F.array(*[_let(folded(F.col("turns"), e), lambda s: F.array(*[s[f"q{x}"] for x in STATES])) for e in STATES]))
    known = checkpointed(counted(parts).withColumn("ways", ways))
    border = lambda a, b: F.when(F.concat(a, b).isin(LEGAL), 0).otherwise(1)
    ordered = F.sort_array(F.collect_list(F.struct("block", "ways", "first", "last")))
    sums = [F.sum(c).alias(c) for c in ("distinct", "blank", "duplicate", "truncated", "illegal")]
    whole = known.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *sums, ordered.alias("parts"))
    nxt = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts") - 1), lambda a, b: border(a["last"], b["first"]))
    between = F.when(F.size("parts") > 1, F.aggregate(nxt, F.lit(0), lambda a, x: a + x)).otherwise(0)
    whole = checkpointed(whole.withColumns({"best": chained(F.col("parts")), "illegal": F.col("illegal") + between, "order": F.col("parts.block")}).drop("parts"))
    # Each block gets the states before and behind it back, and shows its own turns.
    at = whole.select(F.col("conv_id").alias("__c"), F.concat(F.lit(str(EMPTY)), "best.exits").alias("__x"), F.posexplode("order").alias("__i", "__b"))
    met = known.join(at, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("block").eqNullSafe(F.col("__b")))
    state = lambda i: F.substring(F.col("__x"), i, 1).cast("int")
    entry, exit_ = state(F.col("__i") + 1), state(F.col("__i") + 2)
    audit = F.element_at("ways", 4 * entry + exit_ + 1)["audit"]
    pieces = met.select("conv_id", "__i", repaired_turns(F.col("turns"), audit, entry).alias("out")).where(F.size("out") > 0)
    digest = digests(pieces.select("conv_id", F.col("__i").alias("at"), rendered(F.col("out")).alias("piece")))
    digest = digest.withColumnRenamed("conv_id", "__d")
    joined = whole.join(digest, F.col("conv_id").eqNullSafe(F.col("__d")), "left")
    empty = F.sha2(F.lit(""), 256)
    return joined.select("conv_id", gaps(F.col("low"), F.col("high"), F.col("distinct")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.coalesce("sha", empty).alias("repaired_sha256"))


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, sha: SHA-256 of each conversation's pieces (conv_id, at, piece) joined by newlines; one piece is held at a time."""

    schema = pa.schema([pa.field("conv_id", to_arrow_type(pieces.schema["conv_id"].dataType)), pa.field("sha", pa.string())])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            done = []
            for own, piece in zip(b["conv_id"].to_pylist(), b["piece"].to_pylist(), strict=True):
                if h is not None and own == key:
                    h.update(b"\n" + piece.encode())
                    continue
                if h is not None:
                    done.append({"conv_id": key, "sha": h.hexdigest()})
                key, h = own, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if h is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "sha": h.hexdigest()}], schema)

    for_python(pieces.sparkSession)
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.mapInArrow(of, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, sha string")


def reported(rows: DataFrame) -> DataFrame:
    """What the damage of rows did to each of their conversations, and its repair; conversations that lost all turns too."""
    found = repaired(damaged(rows)).withColumnRenamed("conv_id", "__c")
    every = rows.select("conv_id").distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
