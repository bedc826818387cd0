"""Alignment of two tokenizers against the libraries and plain Python."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece
from odd_rows import ODD
from tokenizers import Tokenizer

from georesolve.llm import alignment
from georesolve.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = ["a▁b", " x  y\n\n\tz<0x41></s>", "<s> <unk> <|endoftext|>", "don't stop, naïve 日本語 😀😀", "x" * 300, "\r\n", " ", "token token tokens"]


def byte_of():
    """Byte-level tokenizers write bytes that print as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def expected(rows):
    tok, piece, chars = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    tok.encode_special_tokens = True
    found, counts = [], Counter()
    for i, text in rows:
        links, written, n = [], [], (0, 0)
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
            of_a = [bytes(chars[c] for c in tok.id_to_token(x)) for x in a]
            of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(piece.id_to_piece, b)]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                ends = [[len(b"".join(of[: k + 1])) for k in range(len(of))] for of in (of_a, of_b)]
                n, at = (len(a), len(b)), 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    ga, gb = ([x for x, e in zip(ids, es, strict=True) if at < e <= cut] for ids, es in zip((a, b), ends, strict=True))
                    written.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                    links.append((ga[-1], gb[-1]))
                    at = cut
        counts.update(links)
        found.append((i, *n, len(written), links, hashlib.sha256(";".join(written).encode()).hexdigest() if written else ""))
    most = Counter()
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    return Counter((*r[:4], len(r[4]), sum(counts[p] == most[p[1]] for p in r[4]), sum(counts[p] for p in r[4]), r[5]) for r in found)


@pytest.mark.parametrize("broadcast", [alignment.MAX_BROADCAST, 0])
def test_odd_rows(spark, odd, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "MAX_BROADCAST", broadcast)
    rows = [(r[0], (r[1] or "")[:2000] if r[0] == 5 else r[1]) for r in ODD] + [(100 + i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as pairs", "3 as n_a", "4 as times").repartition(3)
    assert Counter(map(tuple, alignment.aligned(df, A, B).select(COLUMNS).collect())) == expected(rows)


def test_very_long_text_and_no_rows(spark, odd, empty):
    r = alignment.aligned(odd.where("doc_id = 5"), A, B).first()
    assert r["n_a"] > 40_000 and r["n_links"] == r["n_groups"] > 30_000
    assert alignment.aligned(empty, A, B).count() == 0


def test_groups_are_readable(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.encoded(df, A, B, with_groups=True).collect()}
    tok, piece = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=B)
    a, b = tok.encode(" Hello world", add_special_tokens=False).ids, piece.encode("Hello world")
    assert rows[1]["groups"] == ";".join(f"{x}|{y}" for x, y in zip(a, b, strict=True)) and rows[2]["groups"] == ""
    assert rows[1]["groups_sha256"] == hashlib.sha256(rows[1]["groups"].encode()).hexdigest()
