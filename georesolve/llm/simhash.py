"""SimHash fingerprints and exact linking within a Hamming radius.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts. Which tiles meet is decided
twice, both times without loss:

* keys: the 64 bits are cut into blocks; two fingerprints within the radius agree on all bits of some
  ``blocks - radius`` blocks, so each fingerprint is filed under every such choice of blocks. The
  number of blocks grows with the number of distinct fingerprints, which keeps a key's share small.
* population counts: rows of a key are sorted by their number of set bits, and two tiles whose counts
  differ beyond the radius are skipped.

A key with more than ``TILE`` fingerprints is cut into parts, and every pair of parts is a task of its
own. Only a spanning star of each linked set leaves a task, never all its pairs. Equal fingerprints
are one row throughout, so copies cost nothing. Components come from alternating large-star and
small-star rounds over the stars.

``keep_one`` uses fingerprints only to propose pairs, and only pairs whose shingle sets have the asked
Jaccard likeness are links. Its keys are MinHash bands: ``BANDS`` keys of ``BAND_ROWS`` least hashes each,
so that a pair of likeness 0.8 meets under one with probability 0.9994, and a key holds texts that share
shingles, however many others there are. Texts with one shingle set are one node. Within a key tiles are
compared as above; pairs within the radius are then counted on the ``LOWEST`` least shingle hashes of both
sets by a matrix product; a set of no more is counted whole. A task hands on a spanning forest of what
that count makes sure, and every pair that it leaves open, so dense groups of texts below the likeness hand
on nothing. Pairs handed on are tested on the whole sets. This is done twice: first each node with the key's
most central one, then everything that the first links left apart.

Defined results: a null or blank text has fingerprint zero and links like any other; repeated rows and
ties share a component; rows with a null identifier are linked, and a component of such rows alone
has a null component_id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped, for_python, releasing, scratch_path

#: Fingerprints of a key that one task compares whole; larger keys are cut into parts of this size.
TILE = 4096
#: Side of the blocks that numpy compares at once.
SIDE = 512
#: Fingerprints that a key should hold on average.
KEY_ROWS = 256
#: Keys that a fingerprint is filed under at most.
MAX_CHOICES = 120
#: Shingle hashes whose bits are counted at once.
HASHES = 65_536
#: Rows of a frame that a comparing task hands on at least, if it has as many.
PAIRS = 65_536
#: MinHash keys of a text, and least hashes in each.
BANDS, BAND_ROWS = 14, 4
#: Of the 56 least hashes two sets of likeness 0.8 agree on 45 (deviation 3); a pair that agrees on fewer
#: than this, or share of it for another likeness, is not proposed.
LEAST_AGREE = 36
#: Shingle hashes that are multiplied at once.
MULTIPLIED = 8_192
#: Least shingle hashes of a set (their upper halves) that a comparing task has, and columns of a matrix product.
LOWEST, COLUMNS = 256, 4096
#: Four deviations of a likeness that is counted on LOWEST hashes of longer sets: beyond it a pair is sure.
SLACK = 0.1
#: Partners that a node is tested with in the passes of keep_one: the central node of its key, all that are left.
CENTRAL, EVERY = 0, None
PASSES = (CENTRAL, EVERY)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (XXH64 of the text), fp (the fingerprint as a signed 64-bit integer)."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in b["text"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "fp": fps.view(np.int64)})

    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInPandas(releasing(of), "doc_id long, h long, fp long")


def shingled(docs: DataFrame, shingle: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, fp as in fingerprints, node (hash of the set of shingle hashes), size, MinHash bands, bytes of its least hashes and its lowest."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [shingle_hashes(t, shingle, seed) for t in b["text"]]
            fps = np.fromiter(map(majority, hashes), dtype=np.uint64, count=len(b))
            sets = [np.unique(x) for x in hashes]
            keys = [bands(x) for x in sets]
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "fp": fps.view(np.int64), "node": nodes.view(np.int64), "size": [len(x) for x in sets], "bands": [b for b, _ in keys], "mins": [m for _, m in keys], "low": [lowest(x) for x in sets]})

    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInPandas(releasing(of), "doc_id long, h long, fp long, node long, size long, bands array<long>, mins binary, low binary")


#: Odd factors and addends of the MinHash functions: the digests of their numbers.
FACTORS, ADDENDS = (np.array([xxhash.xxh64_intdigest(f"{name}{i}") for i in range(BANDS * BAND_ROWS)], dtype=np.uint64)[:, None] | np.uint64(low) for name, low in (("factor", 1), ("addend", 0)))


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of the set's least hashes (none of an empty set), and a byte of each least hash."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64), bytes(BANDS * BAND_ROWS)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), MULTIPLIED):
        mixed = hashes[None, at : at + MULTIPLIED] * FACTORS + ADDENDS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)
    return keys, (least >> np.uint64(8)).astype(np.uint8).tobytes()


def lowest(hashes: np.ndarray) -> bytes:
    """Upper halves of the LOWEST least of sorted hashes."""
    return (hashes[:LOWEST] >> np.uint64(32)).astype(np.uint32).tobytes()


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of shingle words; a shorter text is one run."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES):
        h = hashes[at : at + HASHES].astype(">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def key_choices(n: int, radius: int, bits: int = 64, key_rows: int = KEY_ROWS) -> list[int]:
    """Masks of the block choices: for n fingerprints, the fewest blocks that keep keys small.

    Any two fingerprints within the radius agree on one of the choices, however many blocks there are.
    """
    for blocks in range(radius + 1, bits):
        if blocks > radius + 1 and math.comb(blocks, radius) > MAX_CHOICES:
            blocks -= 1
            size = bits * (blocks - radius) // blocks
            cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
            break
        cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
        size = bits * (blocks - radius) // blocks
        if n / 2**size <= key_rows:
            break
    parts = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(parts, blocks - radius)]


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, every: bool = False) -> DataFrame:
    """a, b (a < b): spanning stars of fingerprints within the radius, or every such pair. fps: distinct fp."""
    spark, n = fps.sparkSession, fps.count()
    masks = key_choices(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    filed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    large = filed.groupBy("choice", "key").count().where(F.col("count") > tile).select("choice", "key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = (
        filed.join(large, ["choice", "key"], "left")
        .withColumn("part", F.coalesce(part, F.lit(0)))
        .withColumn("other", other)
        .select("choice", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp")
    )
    shuffle = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = dealt.repartition(shuffle, "choice", "key", "p", "q").sortWithinPartitions("choice", "key", "p", "q")

    def compared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for choice, fp, part in _groups(batches):
            for a, b in near_pairs(fp, part, radius, masks[:choice]) if every else [linked(fp, part, radius)]:
                if len(a):
                    held.append((a, b))
                    n += len(a)
                if n >= PAIRS:
                    yield _framed(held)
                    held, n = [], 0
        if held:
            yield _framed(held)

    found = sorted_rows.mapInPandas(releasing(compared), "a long, b long")
    return found if every else found.distinct()


def _framed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _groups(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Choice, fingerprints and (if two parts meet) parts of each group; a group may run over several batches."""
    held: list[pd.DataFrame] = []
    for b in itertools.chain(batches, [None]):
        if b is not None and not len(b):
            continue
        rows = pd.concat([*held, b]) if held and b is not None else (b if b is not None else (pd.concat(held) if held else None))
        if rows is None:
            return
        ids = rows[["choice", "key", "p", "q"]].to_numpy(dtype=np.int64)
        starts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]])
        last = len(starts) - 1 if b is None else len(starts) - 2  # the last group may go on
        fp, part = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64), rows["part"].to_numpy()
        for k in range(last):
            s, e = starts[k], starts[k + 1]
            if e - s > 1:
                yield int(ids[s, 0]), fp[s:e], part[s:e] if ids[s, 2] != ids[s, 3] else None
        held = [] if b is None else [rows.iloc[starts[-2] :]]
        if b is None:
            return


def near_pairs(fp: np.ndarray, part: np.ndarray | None, radius: int, earlier: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius, but for those that agree on an earlier choice."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, ones = fp[order], np.bitwise_count(fp[order]).astype(np.int64)
    side, n, masks = part[order] if part is not None else None, len(fp), [np.uint64(m) for m in earlier]
    for i in range(0, n, SIDE):
        for j in range(i, n, SIDE):
            if ones[j] - ones[min(i + SIDE, n) - 1] > radius:
                break
            near = np.bitwise_count(fp[i : i + SIDE, None] ^ fp[None, j : j + SIDE]) <= radius
            if i == j:
                near = np.triu(near, 1)
            if side is not None:
                near &= side[i : i + SIDE, None] != side[None, j : j + SIDE]
            x, y = np.nonzero(near)
            a, b = fp[x + i], fp[y + j]
            for m in masks:
                if not len(a):
                    break
                new = ((a ^ b) & m) != 0
                a, b = a[new], b[new]
            yield np.minimum(a, b), np.maximum(a, b)


def linked(fp: np.ndarray, part: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest fingerprint of its set, fingerprint) of the sets that links join in fp."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, ones = fp[order], np.bitwise_count(fp[order]).astype(np.int64)
    side = part[order] if part is not None else None
    n, root = len(fp), np.arange(len(fp))
    if n > SIDE:
        _balls(fp, root, radius)
    for i in range(0, n, SIDE):
        for j in range(i, n, SIDE):
            if ones[j] - ones[min(i + SIDE, n) - 1] > radius:
                break  # population counts differ beyond the radius, here and further on
            ri, rj = root[i : i + SIDE], root[j : j + SIDE]
            if n > SIDE and ri.min() == ri.max() == rj.min() == rj.max():
                continue  # already one set
            near = np.bitwise_count(fp[i : i + SIDE, None] ^ fp[None, j : j + SIDE]) <= radius
            if side is not None:
                near &= side[i : i + SIDE, None] != side[None, j : j + SIDE]
            near &= ri[:, None] != rj[None, :]
            if near.any():
                x, y = np.nonzero(near)
                _union(root, x + i, y + j)
    values, sets = np.unique(root, return_inverse=True)
    if len(values) == n:
        return fp[:0], fp[:0]
    least = np.full(len(values), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, sets, fp)
    star = least[sets]
    return star[star != fp], fp[star != fp]


def _balls(fp: np.ndarray, root: np.ndarray, radius: int, pivots: int = 64) -> None:
    """Join what lies within the radius of a few pivots; dense groups need no comparison inside."""
    for _ in range(pivots):
        alone = np.flatnonzero(root == np.arange(len(root)))
        counts = np.bincount(root, minlength=len(root))
        alone = alone[counts[alone] == 1]
        if not len(alone):
            return
        p = alone[len(alone) // 2]
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[p]) <= radius)
        _union(root, np.full(len(near), p), near)


def _union(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x[i] and y[i]; root keeps the smallest position of each set."""
    while True:
        a, b = root[x], root[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low != high).any():
            return
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: connected components of a, b by alternating stars; root is the smallest node."""
    edges, mark = checkpointed(edges.where("a <> b").select("a", "b")), None
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return tied.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def _linked_rows(docs: DataFrame, radius: int, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), fp and first: the row of the component with the smallest identifier."""
    rows = checkpointed(fingerprints(docs, shingle, seed, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(row).alias("first")))
    roots = components(links(nodes.select("fp"), radius))
    of = checkpointed(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # Apart from the sum before it, the join of a large component's rows can be split.
    least = checkpointed(of.groupBy("root").agg(F.min("first").alias("least")))
    named = of.join(least, "root").select("fp", F.col("least").alias("first"))
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    rows = _linked_rows(docs, radius, shingle, seed, id_col, text_col)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def proposed(met: DataFrame, nodes: DataFrame, roots: DataFrame, radius: int, likeness: float, most: int | None, seed: int, tile: int = TILE) -> DataFrame:
    """a, b (a < b): pairs of one key within the radius, with different roots, that are likely alike.

    met: key, band, node of keys with several nodes; nodes: node, fp, size, mins, low; roots: node, root. most: CENTRAL or EVERY.
    """
    rows = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    large = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts")).cast("int")
    # What is compared of a node travels only where its key is still open.
    dealt = rows.join(large, "key").join(nodes.select("node", "fp", "size", "mins", "low"), "node").withColumn("part", part)
    p = q = F.col("part")
    if most is EVERY:  # every part of a large key meets every other
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        p, q = F.least("part", "other"), F.greatest("part", "other")
    dealt = dealt.select("key", p.alias("p"), q.alias("q"), "part", "band", "node", "fp", "size", "mins", "low", "root")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _whole_groups(batches):
            for a, b in _Key(g, radius, likeness).links(most):
                if len(a):
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    for_python(rows.sparkSession, TILE)
    return dealt.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInPandas(releasing(compared), "a long, b long").distinct()


def _whole_groups(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each (key, p, q) with more than one row; a group may run over several batches."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None and not len(b):
            continue
        rows = b if held is None else held if b is None else pd.concat([held, b], ignore_index=True)
        if rows is None:
            return
        ids = rows[["key", "p", "q"]].to_numpy(dtype=np.int64)
        starts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]])
        for s, e in itertools.pairwise(starts if b is None else starts[:-1]):
            if e - s > 1:
                yield rows.iloc[s:e]
        held = None if b is None else rows.iloc[starts[-2] :]


class _Key:
    """The nodes of a key, or of two of its parts, by their number of set bits."""

    def __init__(self, g: pd.DataFrame, radius: int, likeness: float):
        order = np.argsort(np.bitwise_count(g["fp"].to_numpy().view(np.uint64)), kind="stable")
        g = g.iloc[order]
        self.radius, self.likeness, self.n, self.band = radius, likeness, len(g), int(g["band"].iloc[0])
        self.node, self.fp, self.size = g["node"].to_numpy(), g["fp"].to_numpy().view(np.uint64), g["size"].to_numpy()
        self.ones = np.bitwise_count(self.fp).astype(np.int64)
        self.root = np.unique(g["root"].to_numpy(), return_inverse=True)[1]
        self.side = g["part"].to_numpy() if g["p"].iloc[0] != g["q"].iloc[0] else None
        self.mins = np.frombuffer(b"".join(g["mins"]), dtype=np.uint8).reshape(self.n, -1)
        self.low = [np.frombuffer(x, dtype=np.uint32) for x in g["low"]]

    def links(self, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if most == CENTRAL:
            bits = np.unpackbits(self.fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
            centre = np.uint64(int.from_bytes(np.packbits(2 * bits > self.n).tobytes(), "big"))
            c = int(np.argmin(np.bitwise_count(self.fp ^ centre)))
            yield from self.between(c, c + 1, 0, self.n, most)
            return
        for i in range(0, self.n, SIDE):
            end = min(i + SIDE, self.n)
            # Tiles whose population counts differ beyond the radius are skipped: they are at the end.
            for j in range(i, int(np.searchsorted(self.ones, self.ones[end - 1] + self.radius, "right")), SIDE):
                yield from self.between(i, end, j, min(j + SIDE, self.n), most)

    def between(self, i: int, end: int, j: int, to: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of two tiles: a forest of the sure ones, and the open ones that it leaves apart."""
        if (self.root[i:end] == self.root[i]).all() and (self.root[j:to] == self.root[i]).all():
            return
        small, great = (f(self.size[i:end, None], self.size[None, j:to]) for f in (np.minimum, np.maximum))
        ok = (np.bitwise_count(self.fp[i:end, None] ^ self.fp[None, j:to]) <= self.radius) & (small >= self.likeness * great)
        ok &= self.root[i:end, None] != self.root[None, j:to]
        if self.side is not None:
            ok &= self.side[i:end, None] != self.side[None, j:to]
        x, y = np.nonzero(np.triu(ok, 1) if i == j and most is EVERY else ok)
        x, y = x + i, y + j
        equal = self.mins[x] == self.mins[y]
        keep = equal.sum(axis=1) >= LEAST_AGREE * self.likeness / 0.8
        if most is EVERY:  # a pair is compared under the first key it shares
            keep &= ~equal.reshape(len(x), BANDS, BAND_ROWS)[:, : self.band].all(axis=2).any(axis=1)
        x, y = x[keep], y[keep]
        if not len(x):
            return
        likely, sure = self.counted(x, y)
        a, b = x[likely & sure], y[likely & sure]
        forest = list(self.joined(a, b))
        if forest:
            yield tuple(self.node[np.concatenate(v)] for v in zip(*forest, strict=True))
        a, b = x[likely & ~sure], y[likely & ~sure]
        apart = self.root[a] != self.root[b]
        yield self.node[a[apart]], self.node[b[apart]]

    def joined(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs (sorted by x) those that join sets which are apart."""
        starts = np.flatnonzero(np.diff(x, prepend=-1))
        for s, e in itertools.pairwise([*starts, len(x)]):
            ys, own = y[s:e], self.root[x[s]]
            ys = ys[self.root[ys] != own]
            if len(ys):
                sets, first = np.unique(self.root[ys], return_index=True)
                self.root[np.isin(self.root, sets)] = own
                yield np.full(len(first), x[s]), ys[first]

    def counted(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs may have the likeness by their lowest hashes, and whether that is sure."""
        (ux, xi), (uy, yi) = (np.unique(v, return_inverse=True) for v in (x, y))
        common = np.intersect1d(*(np.concatenate([self.low[k] for k in u]) for u in (ux, uy)))
        shared = np.zeros((len(ux), len(uy)), dtype=np.float32)
        for at in range(0, len(common), COLUMNS):
            columns = common[at : at + COLUMNS]
            shared += self._marks(ux, columns) @ self._marks(uy, columns).T
        both, whole = shared[xi, yi].astype(np.float64), (self.size[x] <= LOWEST) & (self.size[y] <= LOWEST)
        either = (self.size[x] + self.size[y]).astype(np.float64)
        for k in np.flatnonzero(~whole).tolist():  # both sketches are whole up to the lesser of their ends
            a, b = self.low[x[k]], self.low[y[k]]
            end = min(v[-1] for v, n in ((a, self.size[x[k]]), (b, self.size[y[k]])) if n > LOWEST)
            either[k] = np.searchsorted(a, end, "right") + np.searchsorted(b, end, "right")
        share = both / np.maximum(either - both, 1)
        return share >= np.where(whole, self.likeness - 1e-9, self.likeness - SLACK), whole | (share >= self.likeness + SLACK)

    def _marks(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which of the sorted columns each row's lowest hashes have."""
        held = [self.low[k] for k in rows]
        values, of = np.concatenate(held), np.repeat(np.arange(len(rows)), [len(v) for v in held])
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        hit = columns[at] == values
        marks = np.zeros((len(rows), len(columns)), dtype=np.float32)
        marks[of[hit], at[hit]] = 1
        return marks


def alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) with ok: whether their shingle sets have the Jaccard likeness. sets: node, s (sorted hashes as bytes)."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ok = []
            for sa, sb in zip(rows.pop("sa"), rows.pop("sb"), strict=True):
                a, b = np.frombuffer(sa, dtype=np.uint64), np.frombuffer(sb, dtype=np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(shared >= likeness * (len(a) + len(b) - shared))
            yield rows.assign(ok=ok)

    for_python(pairs.sparkSession)
    sa, sb = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInPandas(releasing(of), "a long, b long, ok boolean")


def shingle_sets(docs: DataFrame, firsts: DataFrame, shingle: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, s of the rows that stand for nodes. firsts: node, doc_id, h."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "s": [np.unique(shingle_hashes(t, shingle, seed)).tobytes() for t in b["text"]]})

    for_python(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_h"), F.col(text_col).alias("text"))
    named = text.join(firsts, (F.col("own_h") == F.col("h")) & F.col("own").eqNullSafe(F.col("doc_id")))
    return named.select("node", "text").mapInPandas(releasing(of), "node long, s binary").groupBy("node").agg(F.min("s").alias("s"))


def linked_nodes(docs: DataFrame, nodes: DataFrame, radius: int, likeness: float, shingle: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, root: components over the proposed pairs that are alike. nodes: node, fp, size, bands, mins, low, first (with doc_id and h)."""
    filed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = filed.groupBy("key").count().where("count > 1").select("key")
    met = checkpointed(filed.join(shared, "key"))
    # Made by Spark alone: an empty frame from Python rows starts a second set of Python workers on every executor.
    roots = nodes.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))
    for k, most in enumerate(PASSES):
        pairs = checkpointed(proposed(met, nodes, roots, radius, likeness, most, k))
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first.doc_id", "first.h"), "node")
        sets = checkpointed(shingle_sets(docs, named, shingle, seed, id_col, text_col))
        links = alike(pairs, sets, likeness).where("ok").select("a", "b")
        # Sets that earlier links joined are one node each.
        for end in "ab":
            own = roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
            links = links.join(own, end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
        new = components(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if k == 0:
            roots = checkpointed(new)
            continue
        moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = checkpointed(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")))
    return roots


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each component of texts that are alike, the one with the smallest identifier.

    Links are pairs that share a MinHash key, within the radius, whose shingle sets have the Jaccard likeness. Of rows with one
    identifier the one whose text has the smaller hash stays; rows alike in both stay together, as exact
    deduplication comes before.
    """
    spark = docs.sparkSession
    shingled(docs, shingle, seed, id_col, text_col).write.parquet(path := scratch_path(spark, "shingled"))
    wide = spark.read.parquet(path)
    rows = checkpointed(wide.select("doc_id", "h", "node"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    nodes = checkpointed(wide.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("mins").alias("mins"), F.min("low").alias("low"), F.min(row).alias("first")))
    dropped(spark, path)  # what is compared is kept once, by node
    roots = linked_nodes(docs, nodes, radius, likeness, shingle, seed, id_col, text_col)
    of = checkpointed(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Apart from the sum before it, the join of a large component's rows can be split.
    least = checkpointed(of.groupBy("root").agg(F.min("first").alias("least")))
    rows = rows.join(of.join(least, "root").select("node", F.col("least").alias("first")), "node")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    lost = rows.where(~stays).select(F.col("doc_id").alias("__lost_id"), F.col("h").alias("__lost_h")).distinct()
    own_h = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(lost, docs[id_col].cast("long").eqNullSafe(F.col("__lost_id")) & (own_h == F.col("__lost_h")), "left_anti")
