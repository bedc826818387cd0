"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every labelled row of the bounded sample is an example: the unit vector of all its terms, weighted by
TF-IDF times how much the term goes with the label. Terms are the words, and the stems (first ``STEM``
letters) of longer ones, so that an unseen form of a known word tells too. The label weight is a floor
for every term, so no term and no example leaves the index, plus the root of the term's log-likelihood
ratio with the label as far as it is beyond what chance reaches among so many terms. Without it the few
words that tell are lost among hundreds of rarer ones (README has the figures).

The inverted index is cut into blocks of examples with like common words. Rare words come first: their
postings are summed exactly. What common words can still add is bounded by their largest weight in each
block, and only blocks whose bound reaches the neighbours found so far are completed: the result is that
of a full scan. The neighbours' labels, weighted by squared cosine, are the raw score; a monotone curve,
fitted on examples that are scored without themselves, turns it into a calibrated one. The neighbours
are also its evidence.

Bounds: at most ``MAX_EXAMPLES`` labelled rows in expectation (drawn by a hash of the row's id) make the
index that tasks receive, ``CALIBRATED`` of them the curve. Everything is scored.

Defined results: a text without a known word (null and empty texts too) scores the label's rate; without
labelled rows every text scores 0. Rows with a null label or identifier teach nothing; of rows with one
identifier one teaches, with the larger of its labels. Equal cosines are taken in the order of the
examples. Repeated rows score alike, and texts of any length are scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpointed, drawn, for_python, kept_rows, releasing, word_hash

MAX_EXAMPLES, CALIBRATED = 8_000, 1_500
#: Letters of a stem.
STEM = 6
#: Least share of a word's TF-IDF weight that it keeps, however little it says about the label.
FLOOR = 0.02
NEIGHBOURS, PRIOR_WEIGHT = 16, 0.5
#: Examples of a block, words that are kept as dense rows of a block, queries that are answered together.
BLOCK, COMMON, TOGETHER = 256, 512, 64
#: Words whose terms a Python worker keeps, and the longest that lets it keep them.
STORE, LONGEST_STORED = 100_000, 256
#: Rounding of single-precision sums: bounds are widened by it, and nearer cosines are equal.
SLACK = 1e-5


def label_weights(df: np.ndarray, df1: np.ndarray, n: int, pos: int) -> np.ndarray:
    """FLOOR to 1 for each word; df, df1: examples with the word, and those of them with the label."""
    if not 0 < pos < n:
        return np.ones(len(df))
    g2 = np.zeros(len(df))
    for cell, row, column in ((df1, df, pos), (df - df1, df, n - pos), (pos - df1, n - df, pos), (n - pos - df + df1, n - df, n - pos)):
        expected = row * (column / n)
        g2 += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1) / np.maximum(expected, 1e-12)), 0.0)
    more = np.sum(df >= 2)
    beyond = np.sqrt(np.maximum(g2, 0)) - np.sqrt(2 * np.log(max(2, more)))
    beyond = np.where((df >= 2) & (df1 > df * (pos / n)), np.maximum(0, beyond), 0.0)
    return FLOOR + (1 - FLOOR) * beyond / beyond.max() if beyond.max() > 0 else np.full(len(df), FLOOR)


class Index:
    """Block-max inverted index over unit vectors of the examples."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, counts: np.ndarray, common: int = COMMON):
        """Of each example its identifier, label and number of words; hashes and counts of all its words, one after another."""
        n = len(ids)
        self.keys, term = np.unique(hashes, return_inverse=True)
        term, doc, size = term.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), lengths), len(self.keys)
        df = np.bincount(term, minlength=size)
        df1 = np.bincount(term[labels[doc] > 0], minlength=size)
        g = label_weights(df, df1, n, int(labels.sum()))
        self.rate = float(labels.mean()) if n else 0.0
        self.weight = ((np.log((1 + n) / (1 + df)) + 1) * g).astype(np.float32)
        self.telling = g > FLOOR * (1 + 1e-9)
        w = (1 + np.log(counts, dtype=np.float32)) * self.weight[term]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n)).astype(np.float32)
        w /= np.maximum(norm, np.float32(1e-30))[doc]
        top = np.argsort(-df, kind="stable")[:common]
        self.column = np.full(size, -1, dtype=np.int32)
        self.column[top] = np.arange(len(top))
        # Examples whose most frequent common word is the same share blocks, which makes the bounds tight.
        is_common = self.column[term] >= 0
        d, c, col = doc[is_common], counts[is_common], self.column[term[is_common]]
        kind = np.full(n, len(top))
        order = np.lexsort((col, -c, d))
        first = np.unique(d[order], return_index=True)
        kind[first[0]] = col[order][first[1]]
        moved = np.lexsort((ids, kind))
        place = np.empty(n, dtype=np.int32)
        place[moved] = np.arange(n)
        self.ids, self.labels = ids[moved], labels[moved].astype(np.float64)
        self.place = dict(zip(ids.tolist(), place.tolist(), strict=True))
        self.blocks = max(1, -(-n // BLOCK))
        self.dense = np.zeros((self.blocks, max(1, len(top)), BLOCK), dtype=np.float32)
        self.dense[place[d] // BLOCK, col, place[d] % BLOCK] = w[is_common]
        self.largest = np.ascontiguousarray(self.dense.max(axis=2))
        at, term, w = place[doc][~is_common], term[~is_common], w[~is_common]
        order = np.lexsort((at, term))
        self.at, self.w = at[order], w[order]
        self.start = np.searchsorted(term[order], np.arange(size + 1)).astype(np.int64)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return (w / np.sqrt(w @ w)).astype(np.float32)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, leave_out: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query (terms, counts): places and cosines of the k nearest examples that share a word with it.

        leave_out: a place for each query that is no neighbour of it, or -1.
        """
        for s in range(0, len(queries), TOGETHER):
            yield from self._some(queries[s : s + TOGETHER], k, leave_out[s : s + TOGETHER] if leave_out else None)

    def _some(self, queries, k, leave_out) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, size = len(queries), self.blocks * BLOCK
        found, common = np.zeros((n, size), dtype=np.float32), np.zeros((n, self.dense.shape[1]), dtype=np.float32)
        for i, (terms, counts) in enumerate(queries):
            if len(terms):
                w, column = self.unit(terms, counts), self.column[terms]
                common[i, column[column >= 0]] = w[column >= 0]
                self._add_rare(found[i], terms[column < 0], w[column < 0])
            if leave_out and leave_out[i] >= 0:
                found[i, leave_out[i]] = -9
        best = found.reshape(n, self.blocks, BLOCK).max(axis=2)
        bound = best + common @ self.largest.T
        # Each block has one example with its best sum so far: k of them are as near at least.
        least = np.partition(best, self.blocks - k, axis=1)[:, self.blocks - k] if self.blocks >= k else np.zeros(n, dtype=np.float32)
        least, done = np.maximum(least, 0), np.zeros((n, self.blocks), dtype=bool)
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            q = np.flatnonzero((bound[:, b] >= least - SLACK) & (bound[:, b] > 0))
            if not len(q):
                continue
            sums = found[q, b * BLOCK : (b + 1) * BLOCK] + common[q] @ self.dense[b]
            found[q, b * BLOCK : (b + 1) * BLOCK] = sums
            done[q, b] = True
            if k <= BLOCK:
                least[q] = np.maximum(least[q], np.partition(sums, BLOCK - k, axis=1)[:, BLOCK - k])
        found.reshape(n, self.blocks, BLOCK)[~done] = 0
        row, place = np.nonzero(found > np.maximum(least - SLACK, 0)[:, None])
        ends = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            at = place[ends[i] : ends[i + 1]]
            cos = found[i, at].astype(np.float64)
            order = np.lexsort((at, -np.round(cos, 5)))[:k]
            yield at[order], cos[order]

    def _add_rare(self, into: np.ndarray, terms: np.ndarray, w: np.ndarray) -> None:
        start, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        total = int(n.sum())
        if total:
            own = np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)
            into += np.bincount(self.at[own], weights=self.w[own] * np.repeat(w, n), minlength=len(into))

    def raw(self, at: np.ndarray, cos: np.ndarray) -> float:
        """Vote of the neighbours, each weighted by its squared cosine, and a little by the label's rate."""
        if not len(at):
            return self.rate
        votes = cos * cos
        prior = PRIOR_WEIGHT * votes.mean()
        return float((votes @ self.labels[at] + prior * self.rate) / (votes.sum() + prior))


@dataclass
class Curve:
    """Monotone map of raw scores to probabilities; without points, the raw score itself."""

    x: list[float] = field(default_factory=list)
    y: list[float] = field(default_factory=list)

    def __call__(self, raw: float) -> float:
        return float(np.clip(np.interp(raw, self.x, self.y) if self.x else raw, 0, 1))


def curve_of(raw: np.ndarray, y: np.ndarray, rate: float) -> Curve:
    """Isotonic regression by pooling neighbours; each pool counts one example at the label's rate more."""
    pools: list[list[float]] = []
    for x, v in sorted(zip(raw.tolist(), y.tolist(), strict=True)):
        pools.append([v, 1, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, x2 = pools.pop()
            v1, n1, x1 = pools[-1]
            pools[-1] = [v1 + v2, n1 + n2, (x1 * n1 + x2 * n2) / (n1 + n2)]
    values = np.maximum.accumulate([(v + rate) / (n + 1) for v, n, _ in pools]) if pools else []
    return Curve([x for _, _, x in pools], list(map(float, values)))


@dataclass
class Model:
    index: Broadcast
    curve: Curve


def terms_of(text: str | None) -> Counter:
    """How often each word, and each stem (marked by ^), occurs."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    stems: Counter = Counter()
    for w, n in words.items():
        if len(w) > STEM:
            stems["^" + w[:STEM]] += n
    return words + stems


def packed(docs: DataFrame, some: DataFrame) -> DataFrame:
    """doc_id, y, hashes and counts (as bytes) of the words of the labelled texts. some: doc_id, y."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [terms_of(t) for t in b["text"]]
            hashes = [np.array([word_hash(w) for w in c], dtype=np.uint64).tobytes() for c in own]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "hashes": hashes, "counts": [np.array(list(c.values()), dtype=np.int32).tobytes() for c in own]})

    for_python(docs.sparkSession)
    # some is bounded by max_examples: 12 bytes a row.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInPandas(releasing(of), "doc_id long, y int, hashes binary, counts binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("y", "hashes", "counts")).alias("r")).select("doc_id", "r.*")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from docs and the labels (id_col, label_col) of some of them."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    some = some.where(drawn(F.col("doc_id"), some.count(), max_examples))
    rows = checkpointed(packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), some))
    got = rows.toArrow().combine_chunks().sort_by("doc_id")
    bytes_of = lambda name, kind: np.frombuffer(b"".join(got.column(name).to_pylist()), dtype=kind)
    lengths = np.array([len(c) // 4 for c in got.column("counts").to_pylist()], dtype=np.int64)
    index = Index(got.column("doc_id").to_numpy(), got.column("y").to_numpy().astype(np.float64), lengths, bytes_of("hashes", np.uint64), bytes_of("counts", np.int32).astype(np.float32))
    n = got.num_rows
    del got
    sent = docs.sparkSession.sparkContext.broadcast(index)
    if not 0 < index.labels.sum() < n:
        return Model(sent, Curve())

    def without_itself(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for b in batches:
            queries = [(np.searchsorted(index.keys, np.frombuffer(h, dtype=np.uint64)), np.frombuffer(c, dtype=np.int32).astype(np.float64)) for h, c in zip(b["hashes"], b["counts"], strict=True)]
            places = [index.place[i] for i in b["doc_id"]]
            yield pd.DataFrame({"raw": [index.raw(*x) for x in index.nearest(queries, leave_out=places)], "y": b["y"]})

    of = rows.where(drawn(F.concat(F.lit("curve"), F.col("doc_id").cast("string")), n, CALIBRATED))
    points = of.mapInPandas(releasing(without_itself), "raw double, y int").collect()
    return Model(sent, curve_of(np.array([p["raw"] for p in points]), np.array([p["y"] for p in points]), index.rate))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, terms (words found that go with the label), evidence (example ids) and their cosines."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            out = pd.DataFrame(scorer.score(b["text"].tolist()), columns=["score", "terms", "evidence", "cosines"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(releasing(of), "doc_id long, score double, terms array<string>, evidence array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, model: Model, reject_at: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below reject_at; columns unchanged."""

    def tester():
        scorer = Scorer(model)
        return lambda texts: [x[0] < reject_at for x in scorer.score(texts)]

    return kept_rows(docs, text_col, tester)


class Scorer:
    """A model with the terms of the words that one task has met."""

    def __init__(self, model: Model):
        self.index, self.curve = model.index.value, model.curve
        self.unknown = self.index.rate if len(self.index.ids) else 0.0
        self._forget()

    def _forget(self) -> None:
        #: Of each word met its position, and by position its own and its stem's number (or -1).
        self.met, self.numbers = {}, np.empty((0, 2), dtype=np.int64)

    def score(self, texts: list[str | None]) -> list[tuple[float, list[str], list[int], list[float]]]:
        """Per text the score, the telling words, the neighbours' identifiers and their cosines."""
        index, found = self.index, [WORD.findall(t.lower()) if t else [] for t in texts]
        self._learn({w for words in found for w in words} - self.met.keys())
        met, queries, telling = self.met, [], []
        for words in found:
            own = self.numbers[[met[w] for w in words]] if words else self.numbers[:0]
            terms, counts = np.unique(own, return_counts=True)
            known = np.searchsorted(terms, 0)
            queries.append((terms[known:], counts[known:].astype(np.float64)))
            tells = index.telling[terms[known:]].any()
            telling.append(sorted({w for w, t in zip(words, self.tells[own].any(axis=1), strict=True) if t}) if tells else [])
        out = []
        for words, (at, cos) in zip(telling, index.nearest(queries), strict=True):
            out.append((self.curve(index.raw(at, cos)) if len(at) else self.unknown, words, index.ids[at].tolist(), cos.tolist()))
        if len(met) > STORE or any(len(w) > LONGEST_STORED for w in met):
            self._forget()
        return out

    def _learn(self, new: set[str]) -> None:
        words, keys = list(new), self.index.keys
        hashes = np.array([[word_hash(w), word_hash("^" + w[:STEM])] for w in words], dtype=np.uint64).reshape(-1, 2)
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        known = keys[at] == hashes if len(keys) else np.zeros(hashes.shape, dtype=bool)
        known[:, 1] &= np.array([len(w) > STEM for w in words], dtype=bool)
        self.met.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        self.numbers = np.vstack([self.numbers, np.where(known, at, -1)])
        self.tells = np.append(self.index.telling, False)  # the last for -1
