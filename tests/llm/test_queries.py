"""The registered queries: their columns, and what their contracts fix."""

import hashlib
import zlib

import pytest

from georesolve.llm import queries

COLUMNS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_token_counts": {"source": "string", "lang": "string", "tokenizer": "string", "docs": "bigint", "tokens": "bigint"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_chat": {"conv_id": "bigint", "turn": "bigint", "role_pred": "string", "rendered": "string"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op11_repair": {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"},
    "op12_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op13_alignment": {"doc_id": "bigint", **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"},
}


@pytest.mark.parametrize("name", queries.queries())
def test_query_returns_its_whole_table(spark, data, name):
    df = queries.queries()[name](spark, data)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    if "doc_id" in types:
        assert {r.doc_id for r in rows} == docs.keys() and (name == "op7_packing" or len(rows) == len(docs))
    held = lambda i, of, at: zlib.crc32(str(i).encode()) % of == at
    if name == "op3_language":
        assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in rows)
    if name == "op4_toxicity":
        assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert sum(not r.evidence for r in rows) <= 0.02 * len(rows)
    if name == "op7_packing":
        of = {}
        for r in rows:
            of.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in of.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert sum(r.length for r in rows if r.doc_id == 0) == next(r.doc_tokens for r in rows if r.doc_id == 0)
    if name == "op10_fingerprint":
        order = sorted(docs, reverse=True)
        after = dict(zip(order, [*order[1:], order[0]], strict=True))
        for r in rows:
            t, nxt = docs[r.doc_id], docs[after[r.doc_id]]
            k = len(t) // 3
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        by_text = {}
        for r in rows:
            assert by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint
