"""Token counts as delta-maintained rollups.

A batch is a set of signed rows (source, lang, tokenizer, docs, tokens): +1 document and its tokens for
an insert, the same negated for a delete, and for a revised count the old row negated beside the new
one. A batch is summed by (source, lang, tokenizer) before it is stored, so storage and readers see a
few rows a batch whatever its size. Totals are the sum over batches.

Every commit writes one file into a fresh folder, which becomes visible when it is whole: a replay, or a
run that dies half-way, never takes away what was committed before. Of several commits under one
identifier the newest counts. ``compact`` sums the committed batches into a base that remembers their
identifiers and starts a new generation: readers read the newest base and the batches of its generation
only, and a batch that the base covers is final, so that committing it again changes nothing. One
program writes to a rollup at a time; older generations may be deleted.

Defined results: a null text has no tokens; null sources, languages and versions are groups of their
own; groups whose documents and tokens are both zero are left out; an empty batch changes nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE
from .common import for_python

KEYS = ["source", "lang", "tokenizer"]
BATCH_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
BASE_SCHEMA = f"{BATCH_SCHEMA}, batch string, generation long"
#: Keys and counts of a row that only names a batch.
MARK = [*[f"cast(null as string) as {k}" for k in KEYS], "0L as docs", "0L as tokens"]


def count_spaces(text: Column) -> Column:
    """Tokens of the version that splits at white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))).cast("long")


def with_bpe_counts(docs: DataFrame, path: str, name: str = "n_bpe", text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """keep and the number of byte-level BPE tokens of the whole text."""

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBPE.loaded(path)
        for b in batches:
            b[name] = [len(bpe.encode_bytes(t or "")) // 4 for t in b.pop("__text")]
            yield b

    for_python(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInPandas(of, f"{schema}, `{name}` long")


def signed(rows: DataFrame, tokens: str, tokenizer: str, sign: int = 1) -> DataFrame:
    """A row per document: +1 or -1 documents, and its tokens likewise."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("tokens"))


def inserted(rows: DataFrame, tokens: str, tokenizer: str) -> DataFrame:
    return signed(rows, tokens, tokenizer, 1)


def deleted(rows: DataFrame, tokens: str, tokenizer: str) -> DataFrame:
    return signed(rows, tokens, tokenizer, -1)


def revised(rows: DataFrame, old_tokens: str, old_tokenizer: str, tokens: str, tokenizer: str) -> DataFrame:
    return signed(rows, old_tokens, old_tokenizer, -1).unionByName(signed(rows, tokens, tokenizer, 1))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals below a folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch_id: str, rows: DataFrame) -> None:
        """Store a batch of signed rows; a later commit under the same identifier replaces it."""
        at = F.lit(time.time_ns())
        marked = summed(rows).select(*KEYS, "docs", "tokens", F.lit(batch_id).alias("batch"), at.alias("at"))
        mark = self.spark.range(1).select(*map(F.expr, MARK), F.lit(batch_id).alias("batch"), at.alias("at"))  # an empty batch is a committed one
        marked.unionByName(mark).coalesce(1).write.parquet(f"{self.path}/batches/g{self._generation()}/{uuid.uuid4().hex}")

    def _stored(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was stored yet

    def _generation(self) -> int:
        return self._stored("bases", BASE_SCHEMA).agg(F.max("generation")).first()[0] or 0

    def _base(self, generation: int) -> DataFrame:
        return self._stored("bases", BASE_SCHEMA).where(F.col("generation") == generation)

    def _batches(self, generation: int) -> DataFrame:
        """Rows of the newest commit of each batch that the base doesn't cover."""
        rows = self._stored(f"batches/g{generation}", f"{BATCH_SCHEMA}, batch string, at long")
        newest = rows.groupBy("batch").agg(F.max("at").alias("at"))
        covered = self._base(generation).where("batch is not null").select("batch")
        return rows.join(newest, ["batch", "at"]).join(covered, "batch", "left_anti")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        g = self._generation()
        rows = self._batches(g).select(*KEYS, "docs", "tokens").unionByName(self._base(g).select(*KEYS, "docs", "tokens"))
        return summed(rows).where("docs <> 0 or tokens <> 0")

    def compact(self, scratch: str | None = None) -> None:
        """Fold the committed batches into the base of a new generation (scratch is no longer needed)."""
        g = self._generation()
        covers = self._batches(g).select("batch").union(self._base(g).where("batch is not null").select("batch")).distinct()
        folded = self.totals().withColumn("batch", F.lit(None).cast("string")).unionByName(covers.select(*map(F.expr, MARK), "batch"))
        folded.withColumn("generation", F.lit(g + 1).cast("long")).coalesce(1).write.parquet(f"{self.path}/bases/{uuid.uuid4().hex}")
