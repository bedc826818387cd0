import hashlib
import zlib

import pytest
from odd_rows import ODD, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from georesolve.llm import packing, token_counts, word_bpe
from georesolve.llm.byte_bpe import ByteBPE
from georesolve.llm.common import scratch_path, tokenizer_path

BYTE, WORD = (Tokenizer.from_file(tokenizer_path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
OURS_BYTE, OURS_WORD = ByteBPE(tokenizer_path("byte_bpe_50k.tiktoken")), word_bpe.WordBPE(tokenizer_path("word_bpe_49k.json"))
TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="aAbé'st 1.\n\t Σİ̈ ½", max_size=40), st.lists(st.sampled_from(["the", " ", "  ", "\n", "don't", "<|endoftext|>", "<|startoftext|>", "Straße", "日本", "x" * 30]), max_size=12).map("".join))


def ids(raw):
    return memoryview(raw).cast("I").tolist()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_ids_are_the_library_s(text):
    assert ids(OURS_BYTE.encode_bytes(text)) == BYTE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_ids_and_decoding_are_the_library_s(text):
    ((raw, decoded),) = OURS_WORD.encode([text])
    want = WORD.encode(text, add_special_tokens=False).ids
    assert ids(raw) == want and decoded == WORD.decode(want, skip_special_tokens=False)


def test_trie_gives_what_the_merges_give():
    words = {w.encode() for w in prose(5, 3000).split()} | {b"a" * n for n in range(1, 40)}
    for w, got in OURS_WORD.encode_words(words).items():
        assert got == OURS_WORD.plain(w)


def test_word_bpe_of_odd_rows(odd, empty):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.encoded(odd, tokenizer_path("word_bpe_49k.json")).collect())
    want = []
    for _, text, *_ in ODD:
        i = WORD.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in i)
        want.append((len(i), hashlib.sha256(raw).hexdigest(), hashlib.sha256(WORD.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert word_bpe.encoded(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def brute_first_fit(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        k = next((i for i, b in enumerate(bins) if b + n <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out.append((k, bins[k]))
        bins[k] += n
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_tree_is_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    assert list(zip(*packing.first_fit_decreasing(lengths, 64), strict=True)) == brute_first_fit(lengths, 64)


@pytest.mark.parametrize("group_docs", [2, 4096])
def test_packing_of_odd_rows(odd, empty, group_docs):
    rows = packing.pack_documents(odd, tokenizer_path("byte_bpe_50k.tiktoken"), 1024, 0, group_docs).collect()
    want = []
    for doc_id, text, *_ in ODD:
        i = [*BYTE.encode(text or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(i), 1024):
            part = i[s : s + 1024]
            want.append((str(doc_id), s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(i)))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty, tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_rollup_counts_once(spark, odd, empty):
    rows = odd.select("source", "lang", token_counts.count_spaces(odd["text"]).alias("n"))
    roll = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    roll.commit("a", token_counts.inserted(rows, "n", "v1"))
    roll.commit("a", token_counts.inserted(rows, "n", "v1"))
    roll.commit("nothing", token_counts.inserted(rows.limit(0), "n", "v1"))
    want = {}
    for _, text, lang, source in ODD:
        d, n = want.get((source, lang, "v1"), (0, 0))
        want[source, lang, "v1"] = d + 1, n + len((text or "").split())
    got = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in roll.totals().collect()}
    assert got() == want
    roll.compact(scratch_path(spark, "fold"))
    roll.commit("a", token_counts.inserted(rows, "n", "v1"))  # a replay after folding
    assert got() == want
    roll.commit("b", token_counts.deleted(rows.where("lang = 'fr'"), "n", "v1"))
    assert got() == {k: v for k, v in want.items() if k[1] != "fr"}
    roll.commit("c", token_counts.revised(rows.where("lang = 'de'").withColumn("m", rows["n"] + 1), "n", "v1", "m", "v2"))
    roll.compact(scratch_path(spark, "fold"))
    assert ("s", "de", "v1") not in got() and got()["s", "de", "v2"][1] == want["s", "de", "v1"][1] + 1


def test_copies_are_packed_as_often_as_they_occur(spark):
    """Thousands of equal rows without an identifier, beside identifiers that no double holds and one long text."""
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(None, None)] * 2500 + [(big, "a b c"), (big + 2, "a b c")] + [(7, "word " * 9000)], "doc_id long, text string")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    rows = packing.pack_documents(docs.repartition(3), path, 1024, 0, 512).collect()
    assert sum(r.doc_id is None for r in rows) == 2500 and {r.doc_id for r in rows} == {None, big, big + 2, 7}
    assert packing.most_pieces(docs) >= len(rows) == 2502 + -(-next(r.doc_tokens for r in rows if r.doc_id == 7) // 1024)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 1024 for a, b in zip(places, places[1:]))
    assert len({s >> 32 for s, _, _ in places}) > 1


def test_sequences_do_not_depend_on_the_split(spark, odd):
    rows = odd.select("doc_id", "text")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    a, b = (sorted(map(str, packing.pack_documents(rows.repartition(n), path).collect())) for n in (1, 5))
    assert a == b


def test_rollup_survives_replays_and_shrinks(spark):
    rows = lambda n: spark.createDataFrame([("s", "en", "t", 1, n)], token_counts.BATCH_SCHEMA)
    r = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    total = lambda: [(x.docs, x.tokens) for x in r.totals().collect()]
    assert total() == []
    r.commit("a", rows(5))
    r.commit("b", rows(7))
    r.commit("a", rows(6))  # replaces
    assert total() == [(2, 13)]

    def dies(batches):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        r.commit("a", rows(99).mapInPandas(dies, token_counts.BATCH_SCHEMA))
    assert total() == [(2, 13)]  # a commit that died took nothing away
    r.compact()
    assert total() == [(2, 13)] and r._batches(r._generation()).count() == 0
    r.commit("a", rows(50))  # the base covers it
    r.commit("c", rows(1))
    assert total() == [(3, 14)]
    r.compact()
    assert total() == [(3, 14)]


def test_packing_leaves_no_chunks_in_its_workers(spark, odd):
    """Workers go on with other stages: what one keeps beyond its task is memory that these lack."""
    rows = odd.unionByName(odd.withColumn("text", F.concat_ws(" ", *[F.concat(F.lit(f"word{i}x"), F.col("doc_id").cast("string")) for i in range(50)])))
    assert packing.pieces(rows, tokenizer_path("byte_bpe_50k.tiktoken")).count() > 0

    def left(batches):
        yield from ({"n": [sum(len(b.store) for b in ByteBPE._by_path.values())]} for _ in batches)

    import pandas as pd

    kept = spark.range(8).repartition(8).mapInPandas(lambda bs: (pd.DataFrame(x) for x in left(bs)), "n long")
    assert {r.n for r in kept.collect()} == {0}
