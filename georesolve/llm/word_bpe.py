"""BPE with word ends: ids of whole texts by a prefix-sharing trie of their distinct words.

A word's ids follow from the last token of each of its prefixes. For byte-pair encoding with ranked
merges, a token sequence is the encoding of its text exactly if each neighbouring pair is the encoding
of its own text; so the last token of a prefix is the one token that ends there and forms such a pair
with the last token of the prefix before it. The words of a block of documents are inserted into a
trie and the last tokens are propagated depth-first: a prefix that many words share is encoded once.
The last symbol of a word carries the word-end mark and is settled per word from the state above it.

White space never lies inside a word, so a text is cut at its white space and each distinct chunk is
normalised, split into words and looked up once; texts then only join stored bytes. The store and the
trie of a worker are emptied when they reach their bounds, which changes time, not results.

Defined results: null and empty texts, and texts of white space only, have no ids and decode to nothing;
the file's special tokens are recognised in a text; texts of any length are encoded whole; repeated rows
and rows with a null identifier each give a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import for_python

#: Chunks, words and trie nodes that a Python worker keeps, and the longest chunk or word that stays:
#: unspaced scripts make a chunk of a line or a text.
STORE, WORDS, NODES = 400_000, 400_000, 600_000
LONGEST = 64
NEVER = 1 << 60
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
#: Where Python's white space and case agree with the tokenizer's, and NFC changes nothing.
PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\\xa0-\\u024f]*")
LETTERS = re.compile("[A-Za-z\xdf-\xf6\xf8-\xff]+")
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordBPE:
    _by_path: dict[str, WordBPE] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.symbols = spec["model"], byte_symbols()
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        byte_of = self.byte_of = {c: b for b, c in enumerate(self.symbols)}
        #: Used for its normalizer and pre-tokenizer only.
        self.library = Tokenizer.from_file(path)
        self.text_of: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for k, (x, y) in enumerate(model["merges"]):
            pair = self.vocab[x], self.vocab[y]
            self.ranks[pair] = k
            self.split[self.vocab[x + y]] = pair
        #: Tokens by their bytes: those inside a word, and those that end one.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in self.vocab.items():
            stem = token.removesuffix(self.end)
            if stem and all(c in byte_of for c in stem) and (i in self.split or len(stem) == 1):
                (self.final if stem != token else self.inner)[bytes(byte_of[c] for c in stem)] = i
        self.size = {i: len(t) for d in (self.inner, self.final) for t, i in d.items()}
        self.longest = max(map(len, self.inner)), max(map(len, self.final))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spines: tuple[dict, dict] = {}, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.empty()

    @classmethod
    def loaded(cls, path: str) -> WordBPE:
        """One instance a worker process and file."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def empty(self) -> None:
        """An empty trie: nodes by (parent, byte), and the last token of each node's prefix."""
        self.below: dict[int, int] = {}
        self.last: list[int] = [-1]

    # -- the trie --------------------------------------------------------------------------------

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct words, each given as its UTF-8 bytes.

        In sorted order the walk over the words is the depth-first traversal of their trie: path holds
        the nodes of the prefixes of the word at hand, and only what a word doesn't share is settled.
        """
        if len(self.last) > NODES:
            self.empty()
        below, last, out = self.below, self.last, {}
        path, above = [0], b""
        for w in sorted(words):
            shared, most = 0, min(len(w) - 1, len(above))
            while shared < most and w[shared] == above[shared]:
                shared += 1
            del path[shared + 1 :]
            node, above = path[shared], w[:-1]
            for at in range(shared, len(above)):
                key = node << 8 | above[at]
                node = below.get(key)
                if node is None:
                    last.append(self._ending(self.inner, self.longest[0], above, at + 1, path))
                    node = below[key] = len(last) - 1
                path.append(node)
            out[w] = self._ids(w, path)
        return out

    def _ending(self, tokens: dict[bytes, int], longest: int, w: bytes, end: int, path: list[int]) -> int:
        """The token that ends w[:end] and goes with the last token before it; -1 if there is none."""
        last, pairs = self.last, self.pairs
        for start in range(max(0, end - longest), end):
            token = tokens.get(w[start:end])
            if token is None:
                continue
            if start == 0:
                return token
            before = last[path[start]]
            if before >= 0:
                fits = pairs.get((before, token))
                if fits is None:
                    fits = pairs[before, token] = self._pair(before, token)
                if fits:
                    return token
        return -1

    def _ids(self, w: bytes, path: list[int]) -> list[int]:
        """Back from the token that ends the word, over the states of its prefixes."""
        token, at, out = self._ending(self.final, self.longest[1], w, len(w), path), len(w), []
        while token >= 0:
            out.append(token)
            at -= self.size[token]
            if not at:
                return out[::-1]
            token = self.last[path[at]]
        return self.plain(w)  # a byte outside the vocabulary

    # -- what decides a pair ---------------------------------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one edge of token while it is merged, each with the rank that ends it."""
        out = self.spines[side].get(token)
        if out is None:
            out, ends = [(token, NEVER)], token
            while (pair := self.split.get(ends)) is not None:
                ends = pair[side]
                out.append((ends, self.ranks[pair]))
            self.spines[side][token] = out = out[::-1]
        return out

    def _pair(self, a: int, b: int) -> bool:
        """Whether merging a's and b's symbols together gives a and b.

        Merges happen in order of rank, leftmost first. Over time the right edge of a and the left edge
        of b climb their spines; a and b stay apart unless the two tokens at the edge merge first.
        """
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends and rank != NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def plain(self, w: bytes) -> list[int]:
        """A word's ids by the merges alone; symbols outside the vocabulary give none."""
        parts = [self.symbols[b] for b in w]
        parts[-1] += self.end
        ids = [self.vocab[p] for p in parts if p in self.vocab]
        while len(ids) > 1:
            rank, at = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == NEVER:
                break
            ids = ids[:at] + [self.vocab[self.text_of[ids[at]] + self.text_of[ids[at + 1]]]] + ids[at + 2 :]
        return ids

    # -- texts -----------------------------------------------------------------------------------

    def words(self, chunk: str) -> list[bytes]:
        if LETTERS.fullmatch(chunk):
            return [chunk.lower().encode()]
        if PLAIN.fullmatch(chunk):
            return [m.encode() for m in WORD.findall(chunk.lower())]
        # Other scripts: which characters are letters depends on the library's Unicode version.
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(self.byte_of[c] for c in word) for word, _ in parts]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Per text: the ids as little-endian unsigned 32-bit integers, and the decoded text."""
        cut = [self.cut.split(t) if "<|" in t else [t] for t in texts]
        chunked = [[p.split() if PLAIN.fullmatch(p) else [c for c in SPACES.split(p) if c] for p in parts[::2]] for parts in cut]
        new = {c for doc in chunked for part in doc for c in part} - self.chunks.keys()
        if len(self.chunks) + len(new) > STORE:
            self.chunks.clear()
            new = {c for doc in chunked for part in doc for c in part}
        split = {c: self.words(c) for c in new}
        words = {w for ws in split.values() for w in ws}
        unseen = words - self.known.keys()
        if len(self.known) + len(unseen) > WORDS:
            self.known.clear()
            unseen = words
        for w, ids in self.encode_words(unseen).items():
            self.known[w] = b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.text_of[i] for i in ids])
        for c, ws in split.items():
            if len(ws) == 1:
                self.chunks[c] = self.known[ws[0]]
            else:
                found = [self.known[w] for w in ws]
                self.chunks[c] = b"".join([x for x, _ in found]), " ".join([y for x, y in found if x])
        for parts, doc in zip(cut, chunked, strict=True):
            out, decoded = [], []
            for k, part in enumerate(doc):
                found = [self.chunks[c] for c in part]
                out += [x for x, _ in found]
                decoded += [y for x, y in found if x]
                if 2 * k + 1 < len(parts):
                    out.append(self.special[parts[2 * k + 1]].to_bytes(4, "little"))
                    decoded.append(parts[2 * k + 1])
            yield b"".join(out), " ".join(decoded)
        for kept, seen in ((self.chunks, new), (self.known, unseen)):
            for c in [c for c in seen if len(c) > LONGEST]:
                kept.pop(c, None)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text is empty: no ids."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBPE.loaded(tokenizer)
        for b in batches:
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, d in bpe.encode([t or "" for t in b["text"]])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=b["doc_id"].astype("Int64").to_numpy())[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    for_python(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(of, OUT)


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of integers), decoded."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBPE.loaded(tokenizer)
        for b in batches:
            rows = [(memoryview(i).cast("I").tolist(), d) for i, d in bpe.encode([t or "" for t in b["text"]])]
            yield pd.DataFrame(rows, columns=["ids", "decoded"]).assign(doc_id=b["doc_id"].astype("Int64").to_numpy())[["doc_id", "ids", "decoded"]]

    for_python(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(of, "doc_id long, ids array<int>, decoded string")
