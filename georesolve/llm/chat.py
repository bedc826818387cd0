"""Chat formatting: roles of transcript utterances by a hidden Markov model, then canonical turns.

States are roles; an utterance is observed by features: the speaker marker it opens with, buckets of
its words and lines, whether it asks or lists or quotes code. Feature and transition counts come from
Spark aggregations over utterances with known roles. Roles of a transcript are recovered by Viterbi.

A transcript may be of any length: it is cut into blocks of ``BLOCK`` turns. Where a transcript has
several, each is reduced to the matrix of best scores between the state before it and its last state, and
the matrices of a transcript are chained; each block is then decoded between its fixed ends. The result
is that of one pass. A task decodes many short transcripts at once, turn by turn.

Rendering drops nothing: a marker is taken off only where it names the recovered role, and then stands in
a column of its own; what looks like a mark of the format inside a text gets a backslash (``<|`` becomes
``<\\|``, ``<\\|`` becomes ``<\\\\|``), so texts can be read back.

Defined results: null and empty texts are utterances without words; an utterance with a null transcript
or turn has no neighbours and is decoded alone; utterances of one turn number are taken in the order of
their parts, then of their texts' hashes; ties go to the role that sorts first; without any labelled
utterance every role is ``user``. Columns of other names are not read or returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, for_python

BLOCK = 512
#: Rows of one Arrow batch: utterances are short.
ROWS = 4096
#: Words that open an utterance and the speaker they stand for.
MARKERS = {"user": "user", "human": "user", "question": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "system": "system", "instructions": "system"}
NAMES = "|".join(sorted(MARKERS, key=len, reverse=True))
MARKER = rf"(?i)^\s*(?:#{{1,3}}\s*|<\|)?({NAMES})(?:\|>|\s*:)\s*"
FEATURES = ["marker", "words", "lines", "asks", "lists", "code"]


@dataclass
class Model:
    roles: list[str]
    start: list[float] = field(default_factory=list)
    step: list[list[float]] = field(default_factory=list)
    #: By feature: log probabilities of its values for each role.
    emit: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    unseen: dict[str, list[float]] = field(default_factory=dict)

    def emissions(self, rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(rows), len(self.roles)))
        for f in self.emit:
            at, values = pd.factorize(rows[f"f_{f}"].astype(object))
            logs = [self.emit[f].get(v, self.unseen[f]) for v in values]
            out += np.array([*logs, self.unseen[f]])[at]
        return out


def utterances(transcripts: DataFrame, id_col: str = "conv_id", text_col: str = "text", turn_col: str | None = None, blank_lines: bool = True) -> DataFrame:
    """conv_id, turn, text of raw transcripts: cut before speaker markers and (if asked) at blank lines.

    With turn_col a row is a turn that may hold more than one utterance: turn keeps its number, and part
    is the place in the row.
    """
    cut = rf"\n(?=(?i:#{{1,3}}\s*|<\|)?(?i:{NAMES})(?:\|>|\s*:))"
    pieces = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), rf"\n\s*\n|{cut}" if blank_lines else cut))
    if turn_col is None:
        return transcripts.select(F.col(id_col).alias("conv_id"), pieces.alias("turn", "text"))
    return transcripts.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), pieces.alias("part", "text"))


def speaker(text: Column) -> Column:
    """The speaker that an opening marker names, or none."""
    marker = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), MARKER, 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv], F.lit(""), F.lit("none")), marker)


def features(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))
    lines = F.size(F.regexp_extract_all(text, F.lit("([^\n]+)"), F.lit(1)))
    flag = lambda c: F.when(c, "yes").otherwise("no")
    return {
        "marker": speaker(text),
        "words": F.floor(F.log2(words + 1) * 2).cast("string"),
        "lines": F.least(lines, F.lit(8)).cast("string"),
        "asks": flag(text.rlike(r"\?\s*$")),
        "lists": flag(text.rlike(r"(?m)^\s*(?:[-*]|\d+[.)])\s")),
        "code": flag(text.contains("```")),
    }


def observed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, part, text, h (order within a part), role if there is one, and the features."""
    part = F.col("part").cast("int") if "part" in rows.columns else F.lit(0)
    role = [F.col("role")] if "role" in rows.columns else []
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part.alias("part"), F.col("text").cast("string").alias("text"), *role)
    return own.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *[c.alias(f"f_{n}") for n, c in features(F.col("text")).items()])


def fit(rows: DataFrame) -> Model:
    """A model from conv_id, turn, text, role; only sums by role and feature value reach the driver."""
    seen = observed(rows.where(F.col("role").isNotNull()))
    counts = seen.select("role", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"f_{n}").alias("value")) for n in FEATURES])).alias("f")).groupBy("role", "f.name", "f.value").count().collect()
    roles = sorted({r["role"] for r in counts})
    if not roles:
        return Model(["user"], [0.0], [[0.0]])
    at = {r: i for i, r in enumerate(roles)}
    # A turn meets the one before it under (conversation, turn), which no conversation can skew.
    placed = rows.where("role is not null and conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    sides = F.array(F.struct(F.col("turn").alias("turn"), F.col("role").alias("own"), F.lit(None).cast("string").alias("before")), F.struct((F.col("turn") + 1).alias("turn"), F.lit(None).cast("string").alias("own"), F.col("role").alias("before")))
    met = placed.select("conv_id", F.explode(sides).alias("s")).groupBy("conv_id", "s.turn").agg(F.min("s.own").alias("own"), F.min("s.before").alias("before"))
    pairs = met.where("own is not null").groupBy("before", "own").count().collect()
    start, step = np.full(len(roles), 0.5), np.full((len(roles), len(roles)), 0.5)
    for r in pairs:
        if r["before"] is None:
            start[at[r["own"]]] += r["count"]
        else:
            step[at[r["before"]], at[r["own"]]] += r["count"]
    model = Model(roles, np.log(start / start.sum()).tolist(), np.log(step / step.sum(axis=1, keepdims=True)).tolist())
    for n in FEATURES:
        values = sorted({r["value"] for r in counts if r["name"] == n}, key=str)
        table = np.full((len(values) + 1, len(roles)), 0.5)
        for r in counts:
            if r["name"] == n:
                table[values.index(r["value"]), at[r["role"]]] += r["count"]
        logs = np.log(table / table.sum(axis=0))
        model.emit[n] = {v: logs[i].tolist() for i, v in enumerate(values)}
        model.unseen[n] = logs[-1].tolist()
    return model


def by_length(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step from the second: which groups (longest first) have it, and its rows."""
    for t in range(1, int(lengths.max(initial=0))):
        own = np.flatnonzero(lengths > t)
        yield own, starts[own] + t


def viterbi(model: Model, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """State of each row on the best path of its group; first: state before the group, last: its last state, or -1."""
    step, steps = np.array(model.step).reshape(len(model.roles), -1), list(by_length(starts, lengths))
    score = np.where(first[:, None] < 0, np.array(model.start)[None, :], step[first]) + e[starts]
    back, states = np.zeros(e.shape, dtype=np.int32), np.zeros(len(e), dtype=np.int32)
    for own, rows in steps:
        through = score[own][:, :, None] + step[None]
        back[rows] = through.argmax(axis=1)
        score[own] = through.max(axis=1) + e[rows]
    now = np.where(last < 0, score.argmax(axis=1), last)
    for own, rows in reversed(steps):
        states[rows] = now[own]
        now[own] = back[rows, now[own]]
    states[starts] = now
    return states


def best_between(model: Model, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per group the best score from each state before it (row 0: none) to each last state."""
    step = np.array(model.step).reshape(len(model.roles), -1)
    best = np.vstack([np.array(model.start)[None, :], step])[None] + e[starts][:, None, :]
    for own, rows in by_length(starts, lengths):
        best[own] = (best[own][:, :, :, None] + step[None, None]).max(axis=2) + e[rows][:, None, :]
    return best


def chained(best: np.ndarray) -> list[int]:
    """Last state of each block on the best path through all blocks of a transcript."""
    score, back = best[0, 0], []
    for m in best[1:]:
        through = score[:, None] + m[1:]
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    last = [int(score.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    return last[::-1]


def recover(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, part, text, role_pred of utterances (conv_id, turn, text, and part if turns were cut)."""
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    # Rows that are decoded alone are dealt by their texts, the rest by transcript and block.
    seen = observed(rows).withColumns({"block": F.when(~alone, F.floor(F.col("turn") / BLOCK).cast("long")), "deal": F.when(alone, F.col("h")).otherwise(0)})
    cols = [f"f_{f}" for f in FEATURES]
    conv = seen.schema["conv_id"].dataType.simpleString()
    blocks = rows.select("conv_id", F.floor(F.col("turn").cast("long") / BLOCK).cast("long").alias("block")).where("conv_id is not null and block is not null").distinct()
    several = blocks.join(blocks.groupBy("conv_id").count().where("count > 1").select("conv_id"), "conv_id", "left_semi")
    several = checkpointed(several)

    def matrices(g: pd.DataFrame, starts: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
        best = best_between(model, model.emissions(g), starts, lengths)
        return pd.DataFrame({"conv_id": g["conv_id"].to_numpy()[starts], "block": g["block"].to_numpy()[starts], "best": [b.ravel().tolist() for b in best]})

    def ends(g: pd.DataFrame, starts: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
        best = np.array(g["best"].tolist()).reshape(len(g), -1, len(model.roles))
        last = [chained(best[s : s + n]) for s, n in zip(starts, lengths, strict=True)]
        before = [x for own in last for x in [-1, *own[:-1]]]
        return pd.DataFrame({"conv_id": g["conv_id"], "block": g["block"], "first": before, "last": [x for own in last for x in own]})

    def decoded(g: pd.DataFrame, starts: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
        states = viterbi(model, model.emissions(g), starts, lengths, g["first"].to_numpy(dtype=np.int64)[starts], g["last"].to_numpy(dtype=np.int64)[starts])
        return g[["conv_id", "turn", "part", "text"]].assign(role_pred=np.array(model.roles, dtype=object)[states])

    if several.isEmpty():
        seen = seen.withColumns({"first": F.lit(-1), "last": F.lit(-1)})
    else:
        long = seen.join(several, ["conv_id", "block"])
        best = _by_group(long.select("conv_id", "block", "turn", "part", "h", *cols), ["conv_id", "block"], ["turn", "part", "h"], matrices, f"conv_id {conv}, block long, best array<double>")
        fixed = checkpointed(_by_group(best, ["conv_id"], ["block"], ends, f"conv_id {conv}, block long, first int, last int"))
        seen = seen.join(fixed, ["conv_id", "block"], "left").fillna(-1, ["first", "last"])
    of = seen.select("conv_id", "block", "deal", "turn", "part", "h", "text", "first", "last", *cols)
    return _by_group(of, ["conv_id", "block", "deal"], ["turn", "part", "h"], decoded, f"conv_id {conv}, turn long, part int, text string, role_pred string", alone)


def _by_group(rows: DataFrame, keys: list[str], order: list[str], of: Callable, schema: str, alone: Column | None = None) -> DataFrame:
    """of(rows, starts, lengths) over whole groups of rows with one key, many together; rows that are alone are groups of their own."""
    # Two hashes stand for the key: comparing them needs no Python object a row.
    marked = rows.withColumns({"__g": F.xxhash64(*keys), "__k": F.hash(F.lit(1), *keys), "__alone": alone if alone is not None else F.lit(False)})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in itertools.chain(batches, [None]):
            if b is None:
                if held:
                    yield whole(pd.concat(held, ignore_index=True))
                return
            if not len(b):
                continue
            opens = _opens(b)
            if held and not opens[1:].any() and not _opens(pd.concat([held[-1].tail(1), b.head(1)]))[1]:
                held.append(b)  # the group goes on
                continue
            b = pd.concat([*held, b], ignore_index=True) if held else b.reset_index(drop=True)
            end = int(np.flatnonzero(_opens(b))[-1])
            if end:
                yield whole(b.iloc[:end])
            held = [b.iloc[end:]]

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(_opens(g))
        return of(g.reset_index(drop=True), starts, np.diff(np.append(starts, len(g))))

    for_python(rows.sparkSession, ROWS)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return marked.repartition(parts, *keys).sortWithinPartitions("__g", "__k", *order).mapInPandas(run, schema)


def _opens(b: pd.DataFrame) -> np.ndarray:
    """Whether each row opens a group."""
    g, k, alone = b["__g"].to_numpy(), b["__k"].to_numpy(), b["__alone"].to_numpy(dtype=bool)
    out = np.ones(len(b), dtype=bool)
    out[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | alone[1:]
    return out


def rendered(rows: DataFrame) -> DataFrame:
    """rows (text, role_pred, others) with marker (what was taken off the text) and rendered: role header, text, end mark."""
    text = F.coalesce("text", F.lit(""))
    named = speaker(text) == F.col("role_pred")
    marker = F.when(named, F.regexp_extract(text, MARKER, 0)).otherwise("")
    body = F.regexp_replace(F.when(named, F.regexp_replace(text, MARKER, "")).otherwise(text), r"<(\\*)\|", r"<\\$1|")
    return rows.withColumns({"marker": marker, "rendered": F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"), body, F.lit("\n<|end|>"))})


def with_markers(rows: DataFrame, share: int = 2) -> DataFrame:
    """rows (conv_id, turn, role, text) as raw transcripts have them: two of three conversations mark one turn of ``share``."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(3))
    initial = {"user": "Q", "assistant": "A", "system": "Instructions"}
    short = F.element_at(F.create_map(*[F.lit(x) for kv in initial.items() for x in kv]), F.col("role"))
    name = F.when(style == 1, F.initcap("role")).when(style == 2, short)
    marked = F.pmod(F.crc32(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), F.lit(share)) == 0
    return rows.withColumn("text", F.when(marked & name.isNotNull(), F.concat(name, F.lit(": "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
