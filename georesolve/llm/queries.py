"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, exact_dedup, fingerprint, language, packing, repair, secrets, simhash, token_counts, toxicity, url_filter, word_bpe
from .common import checkpointed, scratch_path, table, tokenizer_path
from .sql import OP9_SQL, OP11_SQL, OP12_SQL


#: The rules that op1 is asked to apply.
URL_RULES = [
    url_filter.Rule.parse("block", "com/en/"),
    url_filter.Rule.parse("allow", "example.com/en/7"),
    url_filter.Rule.parse("block", "net/"),
    url_filter.Rule.parse("allow", "net/de/"),
    url_filter.Rule.parse("block", "example.net/de/8"),
    url_filter.Rule.parse("block", "org/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path has the number of its document, whose label it shares."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/(\d{1,18})(?:\D|$)", 1).try_cast("long")
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return url_filter.judge(pages, URL_RULES, url_filter.mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "matched")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, withdraw those labelled as poor, then recount the rest with another tokenizer."""
    docs = table(spark, sf_dir, "documents")
    plain = docs.select("doc_id", "source", "lang", "text", token_counts.count_spaces(F.col("text")).alias("n_spaces"))
    counts = checkpointed(token_counts.with_bpe_counts(plain, tokenizer_path("byte_bpe_50k.tiktoken"), keep=("doc_id", "source", "lang", "n_spaces")))
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    rollup = token_counts.Rollup(spark, scratch_path(spark, "token-counts"))
    load = token_counts.inserted(counts, "n_spaces", "spaces-1")
    rollup.commit("load", load)
    rollup.commit("withdraw", token_counts.deleted(counts.join(poor, "doc_id", "left_semi"), "n_spaces", "spaces-1"))
    kept = counts.join(poor, "doc_id", "left_anti")
    rollup.commit("recount", token_counts.revised(kept, "n_spaces", "spaces-1", "n_bpe", "byte-bpe-50k"))
    rollup.commit("load", load)  # a replay changes nothing
    return rollup.totals()


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"), 5, 0)))
    return language.identify(docs, model).select("doc_id", language.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, labels.where(~out))
    return toxicity.scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "terms", "evidence")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4, seed=42)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are marked as raw transcripts do, cut at the markers and recovered; a fifth of the conversations teaches nothing."""
    rows = chat.with_markers(table(spark, sf_dir, "conversations"))
    out = language.held_out(F.col("conv_id"), 5, 0)
    turns = chat.recover(chat.utterances(rows, turn_col="turn", blank_lines=False), chat.fit(rows.where(~out)))
    return chat.rendered(turns).select("conv_id", "turn", "part", out.alias("held_out"), "role_pred", "marker", "rendered")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest").drop("rows_at_keep")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.versions(table(spark, sf_dir, "documents"), by_content=True)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reported(table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are one batch of a new ledger; the base rules are the only ones, so all spans are base ones."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, scratch_path(spark, "secrets"), path_type="bigint")
    ledger.scan(secrets.BASE, docs)
    ledger.commit("documents", docs, path_col="doc_id")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in secrets.BASE.rules]))
    numbers = [secrets.number_of(spans, r.kind).alias(f"n_{r.kind}") for r in secrets.BASE.rules]
    return ledger.findings(secrets.BASE).select(F.col("path").alias("doc_id"), *numbers, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_counts": op2_token_counts,
        "op3_language": op3_language,
        "op4_toxicity": op4_toxicity,
        "op5_simhash": op5_simhash,
        "op6_bpe": op6_bpe,
        "op7_packing": op7_packing,
        "op8_chat": op8_chat,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_fingerprint": op10_fingerprint,
        "op11_repair": op11_repair,
        "op12_secrets": op12_secrets,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL, "op11_repair": OP11_SQL, "op12_secrets": OP12_SQL}
