"""Alignment of two tokenizers over the bytes of each text.

A text's bytes get a label each: no token ends there, one of A does, one of B, or both. A pattern cuts
the label string behind every label of both; the labels of a span count the tokens of a group, the
fewest tokens of A and of B that cover the same bytes. The two tokens that end at a cut are linked.
How often an id pair is linked in the whole corpus tells which of A's ids is B's best match.

Encoding is one pass over whole texts, written to the shared folder: a row per document with its groups'
digest and its distinct links with their numbers. Pairs are counted from there (summed in the tasks that
read them, so a pair that every document has is shuffled once a task), and the counts come back to the
documents by a join. There are at most as many pairs as both vocabularies allow; they are broadcast only
if fewer than MAX_BROADCAST, which bounds the broadcast by some 100 MB, and joined by a shuffle otherwise.

Defined results: null and empty texts have no tokens, nor have texts whose tokens don't spell a space
and the text (a normalizer changed them): zeros and an empty string. Repeated rows and null identifiers
are counted as rows of their own; very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE
from .common import for_python, scratch_path

#: Labels of a byte: what ends there.
A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[\x00-\x02]*\x03")
#: Id pairs up to which their counts are broadcast; a pair takes some 50 bytes of a task's table.
MAX_BROADCAST = 2_000_000
FOUND = "n_a long, n_b long, n_groups long, groups string, groups_sha256 string, pairs array<bigint>, times array<int>"


class Aligner:
    """Both tokenizers; one a worker process."""

    _by_paths: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        self.a = ByteBPE(path_a, special={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, "rb") as f:
            ranks = {int(i): base64.b64decode(token) for token, i in (line.split() for line in f)}
        bytes_a = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.tables = [_Table(bytes_a, "|"), _Table(bytes_b, ";")]

    @classmethod
    def loaded(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._by_paths:
            cls._by_paths[path_a, path_b] = cls(path_a, path_b)
        return cls._by_paths[path_a, path_b]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def aligned(self, text: str | None, with_groups: bool) -> dict:
        if text:
            a, b = np.frombuffer(self.a.encode_bytes(" " + text), dtype="<u4"), np.array(self.b.encode(text, num_threads=1), dtype=np.int64)
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if all(t.spelled(ids) == whole for t, ids in zip(self.tables, (a, b), strict=True)):
                return self._groups(a, b, len(whole), with_groups)
        return {"n_a": 0, "n_b": 0, "n_groups": 0, "groups": "" if with_groups else None, "groups_sha256": "", "pairs": [], "times": []}

    def _groups(self, a: np.ndarray, b: np.ndarray, size: int, with_groups: bool) -> dict:
        label = np.zeros(size, dtype=np.uint8)
        for t, ids, mark in zip(self.tables, (a, b), (A_END, B_END), strict=True):
            label[np.cumsum(t.sizes[ids]) - 1] |= mark
        ends = np.array([m.end() for m in SPAN.finditer(label.tobytes())])
        # A span's tokens are as many as the labels in it; both tokens of its last label end the group.
        last_a, last_b = (np.cumsum(label & mark != 0)[ends - 1] - 1 for mark in (A_END, B_END))
        of_a, of_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text = self._written(a, b, of_a, of_b, last_a, last_b)
        pairs, times = np.unique(a[last_a].astype(np.int64) << 32 | b[last_b], return_counts=True)
        return {"n_a": len(a), "n_b": len(b), "n_groups": len(ends), "groups": text if with_groups else None, "groups_sha256": hashlib.sha256(text.encode()).hexdigest(), "pairs": pairs, "times": times.astype(np.int32)}

    def _written(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: each id with the sign behind it, put in its place."""
        n, place = np.arange(len(of_a)), np.empty(len(a) + len(b), dtype=object)
        for t, ids, group, last, before in ((self.tables[0], a, np.repeat(n, of_a), last_a, np.cumsum(of_b) - of_b), (self.tables[1], b, np.repeat(n, of_b), last_b, np.cumsum(of_a))):
            words = t.inner[ids]
            words[last] = t.outer[ids[last]]
            place[np.arange(len(ids)) + before[group]] = words
        return "".join(place.tolist())[:-1]


class _Table:
    """A tokenizer's ids: their bytes, and how they are written within a group and at its end."""

    def __init__(self, tokens: list[bytes], sign: str):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.bytes, self.inner, self.outer = (np.empty(len(tokens), dtype=object) for _ in range(3))
        self.bytes[:] = tokens
        self.inner[:] = [f"{i}," for i in range(len(tokens))]
        self.outer[:] = [f"{i}{sign}" for i in range(len(tokens))]

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())


def encoded(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = False) -> DataFrame:
    """keep and n_a, n_b, n_groups, groups (or null), groups_sha256, and the distinct links: pairs (A's id << 32 | B's) and times."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner.loaded(path_a, path_b)
        types = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
        for b in batches:
            rows = [both.aligned(t, with_groups) for t in b["__text"].to_pylist()]
            columns = [b[c] for c in keep] + [pa.array([r[n] for r in rows], t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *types])

    for_python(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(of, f"{schema}, {FOUND}")


def counted(links: DataFrame) -> DataFrame:
    """pair, count, best of all id pairs of links (pair, times): whether no other of A's ids is linked to the pair's B id more often."""
    sums = links.groupBy("pair").agg(F.sum("times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return sums.withColumn("best", F.col("count") == most)


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    place = scratch_path(spark, "alignment")
    # Numbered when written: repeated rows and null identifiers stay apart, and what is reread has the numbers that were written.
    encoded(docs, path_a, path_b, text_col, keep).drop("groups").withColumn("__row", F.monotonically_increasing_id()).write.parquet(f"{place}/documents")
    found = spark.read.parquet(f"{place}/documents")
    each = found.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("__row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counted(each).write.parquet(f"{place}/pairs")
    pairs = spark.read.parquet(f"{place}/pairs")
    if pairs.count() <= MAX_BROADCAST:
        pairs = F.broadcast(pairs)
    sums = each.join(pairs, "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.join(sums, "__row", "left").select(*keep, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *zero, "groups_sha256")
