"""Exact deduplication: a tree merge of sorted digest runs.

Every input partition turns its rows into a sorted run of (digest, kept identifier, rows). Runs then
move through ``rounds`` exchange rounds over ``fan_in ** rounds`` lanes. A binomial round pairs the
lanes that differ in one bit; a round here takes ``log2(fan_in)`` of them at once: the ``fan_in`` lanes
that differ only in digit r swap parts, so that afterwards digit r of a lane is digit r of the digests
it holds. The halves that binomial rounds would send on whole are so divided that no lane becomes the
root of all. Each lane merges the sorted runs it receives, pair by pair up a tree (an entry's place is
its rank in its own run plus its rank in the other), and equal digests collapse to one entry at every
level. A text that makes up a third of all rows is thus one entry per partition after the first level,
and no lane ever holds more than its share of the distinct digests.

A digest is SHA-256 followed by the XXH64 of the same normalised text; two rows count as copies only
if both agree.

Defined results: a null text counts as empty and equals the empty text; upper-case A-Z equals
lower-case; of rows with a null identifier any other identifier wins; repeated rows with one
identifier form a group of their count and are all marked as kept (``deduplicate`` keeps one).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, ship

#: Entries of a lane that the number of rounds aims at: 64 bytes each.
LANE_ENTRIES = 1_000_000
FAN_IN = 8
#: Rows that one sorted run of the first level takes at most.
RUN_ROWS = 500_000
DIGEST = 40
NO_ID = np.iinfo(np.int64).min
RUN_SCHEMA = "lane int, entries int, digests binary, ids binary, sizes binary, at_id binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha (hex of the normalised text's SHA-256), xxh (its XXH64)."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.sha2("t", 256).alias("sha"), F.xxhash64("t").alias("xxh"))


def merged_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN, lane_entries: int = LANE_ENTRIES) -> DataFrame:
    """One row per distinct digest: sha, xxh, keep_id, group_size, rows_at_keep.

    rows: as ``digests`` returns it. keep: smallest or largest identifier.
    """
    ship(rows.sparkSession)
    largest = {"smallest": False, "largest": True}[keep]
    rounds, n = 1, rows.count()
    while fan_in**rounds * lane_entries < n or rounds < 2:
        rounds += 1
    lanes = fan_in**rounds

    def first_level(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0
        for b in batches:
            if len(b):
                held.append((b["lane"].iloc[0], *_sorted_run(*_entries(b), largest)))
                n_held += len(b)
            if n_held >= RUN_ROWS:
                yield _dealt(held[0][0], *_merge([x[1:] for x in held], largest), 0, rounds, fan_in)
                held, n_held = [], 0
        if held:
            yield _dealt(held[0][0], *_merge([x[1:] for x in held], largest), 0, rounds, fan_in)

    def level(r: int):
        def merge(group: pd.DataFrame) -> pd.DataFrame:
            runs = [_unpacked(x) for x in group.itertuples(index=False)]
            return _dealt(int(group["lane"].iloc[0]), *_merge(runs, largest), r, rounds, fan_in)

        return merge

    def opened(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                d, ids, sizes, at_id = _unpacked(x)
                raw = d.tobytes()
                sha = [raw[i : i + 32].hex() for i in range(0, len(raw), DIGEST)]
                xxh = d[:, 4].astype(np.uint64).view(np.int64)
                keep_id = pd.array(ids, dtype="Int64")
                keep_id[ids == NO_ID] = pd.NA
                yield pd.DataFrame({"sha": sha, "xxh": xxh, "keep_id": keep_id, "group_size": sizes, "rows_at_keep": at_id})

    runs = rows.withColumn("lane", F.spark_partition_id() % F.lit(lanes)).mapInPandas(first_level, RUN_SCHEMA)
    for r in range(1, rounds + 1):
        runs = runs.groupBy("lane").applyInPandas(level(r), RUN_SCHEMA)
    return runs.mapInPandas(opened, "sha string, xxh long, keep_id long, group_size long, rows_at_keep long")


def groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, rows_at_keep, text_sha256."""
    rows = checkpointed(digests(docs, id_col, text_col))
    merged = merged_runs(rows, keep)
    # A copy group of any size meets one row here; a hot digest is split by the adaptive skew join.
    return rows.join(merged, ["sha", "xxh"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "rows_at_keep", F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts; columns unchanged."""
    rows = checkpointed(digests(docs, id_col, text_col))
    merged = checkpointed(merged_runs(rows, keep))
    losers = rows.join(merged, ["sha", "xxh"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("__lost_id"), F.col("sha").alias("__lost_sha"))
    text = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    kept = docs.join(losers.distinct(), docs[id_col].cast("long").eqNullSafe(F.col("__lost_id")) & (text == F.col("__lost_sha")), "left_anti")
    if not merged.where("rows_at_keep > 1").isEmpty():  # repeated rows with one identifier and one text
        kept = kept.withColumn("__sha", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).dropDuplicates([id_col, "__sha"]).drop("__sha")
    return kept


def _entries(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Digests as five big-endian words a row, identifiers, rows, rows that have the identifier."""
    raw = np.frombuffer(bytes.fromhex("".join(b["sha"])), dtype=">u8").reshape(-1, 4).astype(np.uint64)
    xxh = b["xxh"].to_numpy(dtype=np.int64).view(np.uint64).reshape(-1, 1)
    ids = b["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64)
    one = np.ones(len(b), dtype=np.int64)
    return np.hstack([raw, xxh]), ids, one, one


Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _sorted_run(d: np.ndarray, ids: np.ndarray, sizes: np.ndarray, at_id: np.ndarray, largest: bool) -> Run:
    order = np.lexsort((d[:, 4], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    return _collapsed(d[order], ids[order], sizes[order], at_id[order], largest)


def _merge(runs: list[Run], largest: bool) -> Run:
    """One sorted run of several sorted ones: neighbours are merged in pairs until one is left."""
    while len(runs) > 1:
        runs = [_merge_two(*runs[i : i + 2], largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _merge_two(a: Run, b: Run, largest: bool) -> Run:
    """An entry's place is its rank in its own run plus its rank in the other, by the digests' first words."""
    x, y = np.ascontiguousarray(a[0][:, 0]).astype(np.uint64), np.ascontiguousarray(b[0][:, 0]).astype(np.uint64)
    at_a = np.arange(len(x)) + np.searchsorted(y, x, "left")
    at_b = np.arange(len(y)) + np.searchsorted(x, y, "right")
    both = []
    for u, v in zip(a, b, strict=True):
        out = np.empty((len(x) + len(y), *u.shape[1:]), dtype=u.dtype.newbyteorder("="))
        out[at_a], out[at_b] = u, v
        both.append(out)
    d = both[0]
    tied = d[1:, 0] == d[:-1, 0]
    if (tied & (d[1:] != d[:-1]).any(axis=1)).any():  # different digests with one first word: order by all words
        return _sorted_run(*both, largest)
    return _collapsed(*both, largest)


def _collapsed(d: np.ndarray, ids: np.ndarray, sizes: np.ndarray, at_id: np.ndarray, largest: bool) -> Run:
    """Equal digests of a sorted run become one entry, with the identifier that stays and the rows that have it."""
    if not len(d):
        return d, ids, sizes, at_id
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    if largest:
        best = np.maximum.reduceat(ids, starts)
    else:  # any other identifier wins over none
        rank = np.minimum.reduceat(np.where(ids == NO_ID, np.iinfo(np.int64).max, ids), starts)
        some = np.maximum.reduceat((ids != NO_ID).astype(np.int8), starts) > 0
        best = np.where(some, rank, NO_ID)
    same = np.where(ids == best[np.cumsum(new) - 1], at_id, 0)
    return d[starts], best, np.add.reduceat(sizes, starts), np.add.reduceat(same, starts)


def _dealt(lane: int, d: np.ndarray, ids: np.ndarray, sizes: np.ndarray, at_id: np.ndarray, done: int, rounds: int, fan_in: int) -> pd.DataFrame:
    """The run cut by the digit that the next round exchanges; after the last round, whole."""
    if done == rounds:
        return _packed([(lane, d, ids, sizes, at_id)])
    unit = fan_in**done
    digit = ((d[:, 0] // np.uint64(unit)) % np.uint64(fan_in)).astype(np.int64)
    base = lane - (lane // unit % fan_in) * unit
    parts = ((base + k * unit, digit == k) for k in range(fan_in))
    return _packed([(to, d[m], ids[m], sizes[m], at_id[m]) for to, m in parts if m.any()])


def _packed(parts: list[tuple]) -> pd.DataFrame:
    rows = [(to, len(ids), d.astype(">u8").tobytes(), ids.tobytes(), sizes.tobytes(), at_id.tobytes()) for to, d, ids, sizes, at_id in parts]
    return pd.DataFrame(rows, columns=["lane", "entries", "digests", "ids", "sizes", "at_id"])


def _unpacked(x) -> tuple[np.ndarray, ...]:
    return np.frombuffer(x.digests, dtype=">u8").reshape(-1, 5), *(np.frombuffer(v, dtype=np.int64) for v in (x.ids, x.sizes, x.at_id))
