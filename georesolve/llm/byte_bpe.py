"""Byte-level BPE ids of whole texts, with a bounded store of the ids of short chunks seen before.

The pre-tokenizer always cuts before a space that follows a non-space character. A text whose only
white space before a space is none can thus be cut at its spaces, and every chunk encoded on its own;
chunks repeat, so most come from the store. Other texts are encoded whole. Both ways give the same
ids; only the time differs.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"
#: Chunks that a Python worker keeps, and their longest: with its ids one takes some 150 to 400 bytes.
STORE, LONGEST = 400_000, 64
SPACE_RUN = re.compile(r"\s ")


class ByteBPE:
    _by_path: dict[str, ByteBPE] = {}

    def __init__(self, path: str, special: dict[str, int] | None = None):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {END_OF_TEXT: len(ranks)} if special is None else special
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.store: dict[str, bytes] = {}

    @classmethod
    def loaded(cls, path: str) -> ByteBPE:
        """One instance a worker process and file."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def forget(self) -> None:
        """Empty the store at a task's end: the worker goes on with other stages, which need its memory."""
        self.store = {}

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut and "<|" in text:
            parts = self.cut.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if SPACE_RUN.search(text) or text[0] == " ":
            return self._ids(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._ids(first)
        store = self.store
        try:
            return self._ids(first) + b"".join([store[c] for c in rest])
        except KeyError:
            new = [c for c in set(rest) if c not in store]
        if len(store) + len(new) > STORE:
            store.clear()
            new = list(set(rest))
        own = {c: self._ids(" " + c) for c in new}
        store.update((c, ids) for c, ids in own.items() if len(c) <= LONGEST)
        return self._ids(first) + b"".join([own[c] if c in own else store[c] for c in rest])

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
