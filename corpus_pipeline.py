"""A corpus pipeline over ``documents``: language, toxicity, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last return
the columns of docs. What the stages learn (languages, toxic terms) comes from the rows they are given
and the table ``labels``. Results of odd rows are those of the operators; rows without a letter are
rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from georesolve.llm import exact_dedup, language, packing, simhash, toxicity
from georesolve.llm.common import dropped, scratch_path, table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those whose language is a toss-up (score under 0.5)."""
    return language.keep_identified(docs, language.fit(docs), least_score=0.5)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score 0.4 or more."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), reject_at=0.4)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles have a Jaccard likeness of 0.8 the row with the smallest identifier stays.

    Texts that share a MinHash key and have fingerprints within 14 of 64 bits are tested on their shingles:
    texts of that likeness differ in about 10 bits, unrelated ones in about 30.
    """
    return simhash.keep_one(docs, radius=14, shingle=5, seed=42, likeness=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The learned stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what no later stage reads is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            dropped(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
