"""Language identification by words, backing off to shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by its character
n-grams: the longest length at which any of its n-grams is known decides, and their log frequencies
are averaged. The score is the posterior probability of the best language.

All words and n-grams of the labelled sample are kept: workers receive their 64-bit hashes in order and
the languages that have them, in a few bytes each. The sample is bounded: ``MAX_DOCS`` labelled documents
in expectation, drawn by a hash of the row's id. Counts are summed by Spark, n-grams of all lengths
in one pass over the distinct words.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing was learned. Rows with a null language teach nothing. Ties go to the language that sorts first.
Any length of text is scored whole; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, drawn, for_python, kept_rows, releasing, word_hash

#: Labelled documents that a model is fitted on at most (in expectation).
MAX_DOCS = 20_000
LONGEST_GRAM = 5
#: What a word or n-gram that a language doesn't have counts there.
UNSEEN = 0.5
#: Words that a Python worker keeps with their log frequencies, and numbers (one a word and language) that it keeps of them at most.
STORE, STORED_NUMBERS = 100_000, 4_000_000
#: Words whose n-grams a Python worker sums before it hands them on.
WORDS_TOGETHER = 50_000
#: Stands for a document among the words that are counted; no word has a space.
DOCUMENT = " "
UNDETERMINED = "und"


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def letters(text: str | None) -> list[str]:
    """The words of a text, lower-cased; none if it has no letter."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


class Model:
    """Log frequencies by language of words (length 0) and of n-grams of each length."""

    def __init__(self, languages: list[str], docs: list[int], rows: dict[str, np.ndarray]):
        """docs: documents of each language. rows: columns kind (0 or a length), h, lang (position), n."""
        self.languages, k = languages, len(languages)
        self.prior = np.log((np.array(docs, dtype=np.float64) + 1) / (sum(docs) + max(1, k)))
        self.tables = {}
        for kind in range(LONGEST_GRAM + 1):
            own = rows["kind"] == kind
            h, lang, n = rows["h"][own].view(np.uint64), rows["lang"][own], rows["n"][own].astype(np.float64)
            order = np.lexsort((lang, h))
            keys, start = np.unique(h[order], return_index=True)
            total = np.log(np.maximum(1, np.bincount(lang, weights=n, minlength=k) + UNSEEN * len(keys)))
            self.tables[kind] = keys, np.append(start, len(order)), lang[order], np.log(n[order] + UNSEEN).astype(np.float32), np.log(UNSEEN) - total, total

    def logs(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the log frequencies by language of each that is."""
        keys, start, lang, log, unseen, total = self.tables[kind]
        if not len(keys) or not len(hashes):
            return np.zeros(len(hashes), dtype=bool), np.empty((0, len(self.languages)))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[at] == hashes
        at = at[known]
        n = start[at + 1] - start[at]
        own = np.arange(n.sum()) + np.repeat(start[at] - (np.cumsum(n) - n), n)
        out = np.tile(unseen, (len(at), 1))
        out[np.repeat(np.arange(len(at)), n), lang[own]] = log[own] - total[lang[own]]
        return known, out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Log frequencies by language of each word, by n-grams where it is unseen."""
        out = np.zeros((len(words), len(self.languages)))
        known, logs = self.logs(0, np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words)))
        out[known] = logs
        left = np.flatnonzero(~known)
        for n in range(LONGEST_GRAM, 0, -1):
            cut = [grams(words[i], n) for i in left]
            of = np.repeat(np.arange(len(left)), [len(c) for c in cut])
            known, logs = self.logs(n, np.fromiter((word_hash(g) for c in cut for g in c), dtype=np.uint64, count=len(of)))
            found = np.bincount(of[known], minlength=len(left))
            sums = np.zeros((len(left), len(self.languages)))
            np.add.at(sums, of[known], logs)
            out[left[found > 0]] = sums[found > 0] / found[found > 0, None]
            left = left[found == 0]
        return out


def held_out(doc_id: Column, of: int = 5, at: int = 0) -> Column:
    """Whether a row's id falls to the part that nothing is learned from; a null id does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == at, F.lit(True))


def counted(rows: DataFrame) -> DataFrame:
    """lang, kind, h, n: how often words and n-grams occur in each language, and (kind -1) its documents. rows: lang, text."""

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b["lang"], b["text"], strict=True):
                own[lang].update(letters(text))
                own[lang][DOCUMENT] += 1
            for lang, n in own.items():
                yield pd.DataFrame({"lang": lang, "w": list(n), "n": list(n.values())})

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, list[Counter]] = defaultdict(lambda: [Counter() for _ in range(LONGEST_GRAM + 1)])
        for b in batches:
            for lang, w, n in zip(b["lang"], b["w"], b["n"], strict=True):
                counts = own[lang]
                if w == DOCUMENT:
                    yield pd.DataFrame({"lang": [lang], "kind": [-1], "h": [0], "n": [n]})
                    continue
                counts[0][w] = n
                for k in range(1, LONGEST_GRAM + 1):
                    many = counts[k]
                    for g in grams(w, k):
                        many[g] += n
            if sum(len(c[0]) for c in own.values()) >= WORDS_TOGETHER:
                yield from emptied(own)
        yield from emptied(own)

    def emptied(own: dict[str, list[Counter]]) -> Iterator[pd.DataFrame]:
        for lang, counts in own.items():
            kinds = np.repeat(np.arange(LONGEST_GRAM + 1), [len(c) for c in counts])
            h = np.fromiter((word_hash(x) for c in counts for x in c), dtype=np.uint64, count=len(kinds)).view(np.int64)
            yield pd.DataFrame({"lang": lang, "kind": kinds, "h": h, "n": [n for c in counts for n in c.values()]})
        own.clear()

    for_python(rows.sparkSession)
    summed = rows.mapInPandas(releasing(words), "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    return summed.mapInPandas(releasing(cut), "lang string, kind int, h long, n long").groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with text and language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = counted(rows.where(drawn(F.col("doc_id"), rows.count(), max_docs)).select("lang", "text")).toArrow()
    got = {name: got.column(name).to_numpy() for name in got.column_names}
    docs = got["kind"] == -1
    languages, at = np.unique(got["lang"].astype(str), return_inverse=True) if len(docs) else (np.empty(0, dtype=str), np.empty(0, dtype=np.int64))
    count = np.zeros(len(languages), dtype=np.int64)
    count[at[docs]] = got["n"][docs]
    return Model(languages.tolist(), count.tolist(), {"kind": got["kind"][~docs], "h": got["h"][~docs].astype(np.int64), "lang": at[~docs], "n": got["n"][~docs]})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for b in batches:
            out = pd.DataFrame(scorer.score(b["text"].tolist()), columns=["lang_pred", "score", "n_words"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(releasing(of), "doc_id long, lang_pred string, score double, n_words long")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is determined with at least least_score; columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tester():
        scorer = Scorer(sent.value)
        return lambda texts: [language != UNDETERMINED and score >= least_score for language, score, _ in scorer.score(texts)]

    return kept_rows(docs, text_col, tester)


class Scorer:
    """A model with the log frequencies of the words that one task has met."""

    def __init__(self, model: Model):
        self.model, self.met, self.logs = model, {}, np.empty((0, len(model.languages)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Per text the language, its probability and the number of words."""
        m = self.model
        if not m.languages:
            return [(UNDETERMINED, 0.0, 0)] * len(texts)
        found = [letters(t) for t in texts]
        if len(self.met) > min(STORE, STORED_NUMBERS // len(m.languages)):
            self.met, self.logs = {}, self.logs[:0]
        new = list({w for words in found for w in words} - self.met.keys())
        self.met.update(zip(new, range(len(self.met), len(self.met) + len(new)), strict=True))
        self.logs = np.vstack([self.logs, m.of_words(new)])
        met, out = self.met, []
        for words in found:
            if not words:
                out.append((UNDETERMINED, 0.0, 0))
                continue
            logs = m.prior + self.logs[[met[w] for w in words]].sum(axis=0)
            p = np.exp(logs - logs.max())
            best = int(p.argmax())
            out.append((m.languages[best], float(p[best] / p.sum()), len(words)))
        return out
