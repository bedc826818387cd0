"""Packing of documents into training sequences of a fixed number of tokens.

A document is encoded once and cut into pieces of at most ``capacity`` tokens. Pieces are dealt into
randomised groups of about ``group_pieces`` pieces at most; each group is packed on its own by first-fit
decreasing over a tournament tree of bin capacities, so a group's work and memory follow its pieces,
however long or many the documents are, and groups run in parallel.

Defined results: a null text is empty; every document ends with ``end_id``, so an empty one is a
single piece of one token; repeated rows are packed as often as they occur: they are counted before they
are shuffled and travel as a number, ``COPIES`` to a group at a time; a text of any length is cut, never dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE
from .common import for_python, release_memory

#: Pieces of a group at most, on average; the last bins of a group stay partly empty, so larger groups pad less.
GROUP_PIECES = 8192
#: Copies of one piece that are dealt together.
COPIES = 1024
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECES = ", ".join(f"{c} long" for c in PIECE)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBPE.loaded(tokenizer), end_id.to_bytes(4, "little")
        schema = pa.schema([(c, pa.int64()) for c in PIECE])
        try:
            for b in batches:
                out = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = bpe.encode_bytes(text or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                columns = list(zip(*out, strict=True)) or [()] * len(PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
        finally:
            bpe.forget()
            release_memory()

    for_python(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def most_pieces(docs: DataFrame, capacity: int = 1024, text_col: str = "text") -> int:
    """No fewer than the pieces of docs: a token has a byte at least."""
    tokens = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)
    return docs.agg(F.sum(F.ceil(tokens / capacity))).first()[0] or 0


def pack(parts: DataFrame, most: int, capacity: int = 1024, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """parts with sequence_id and offset; most: what parts has no more rows than, for the number of groups."""
    n_groups, together = max(1, math.ceil(most / group_pieces)), min(COPIES, group_pieces)

    def ffd(group: pa.Table) -> pa.Table:
        first = group.column("pack_group")[0].as_py() << 32
        group = group.sort_by([("length", "descending"), *((c, "ascending") for c in PIECE if c != "length"), ("batch", "ascending")])
        group = group.take(np.repeat(np.arange(len(group)), group.column("copies").to_numpy())).select(PIECE)
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), capacity)
        sequences = pa.array(first + np.array(bins, dtype=np.int64))
        return group.append_column("sequence_id", sequences).append_column("offset", pa.array(offsets, pa.int64()))

    alike = parts.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("alike"))
    batches = alike.withColumn("batch", F.explode(F.sequence(F.lit(0), F.expr(f"(alike - 1) div {together}"))))
    dealt = batches.select(
        *PIECE,
        "batch",
        F.least(F.lit(together), F.col("alike") - F.col("batch") * together).alias("copies"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "batch"), F.lit(n_groups)).alias("pack_group"),
    )
    return dealt.groupBy("pack_group").applyInArrow(ffd, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, end_id), most_pieces(docs, capacity), capacity, group_pieces)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, longest first; a tournament tree finds the first bin that fits.

    Each inner node holds the larger capacity of its two children; going down, the left child wins
    whenever it can take the piece.
    """
    leaves = 1 << max(0, (max(1, len(lengths)) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < n:
                at += 1
        bins.append(at - leaves)
        offsets.append(capacity - tree[at])
        tree[at] -= n
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets
