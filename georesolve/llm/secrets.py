"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is recorded under the SHA-256 of its text. A scan takes the texts whose pair
of digest and rule version the ledger has not seen yet, each once however many paths and versions have
it, and stores their findings; findings of paths are joined from there. So a replayed batch, a copied
file or a reverted edit is never scanned again, and a new version of the rules scans the history that it
is given once. The ledger keeps digests and spans and no texts: secrets stay where they were found.
Batches are idempotent: each is written whole into a folder of its own name and seen once it is marked.

Rules are patterns with a least length of one of their groups. Of a pattern the leftmost matches that
don't overlap are taken first and those too short dropped afterwards: a match that fails still uses up
its text. Offsets are code points, ends exclusive.

Defined results: null texts are empty ones and have no findings; null paths are paths; repeated rows
give repeated results; very long texts are scanned whole; an empty batch is a committed one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_python

SCANS = "blob string, rules string, spans array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose ``group`` has fewer characters are dropped.
    least: int
    group: int = 0
    #: Letters of the pattern in either case; of ASCII only.
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


@dataclass(frozen=True)
class Rules:
    """A named version of the rules; their order is that of findings that start together."""

    version: str
    rules: tuple[Rule, ...]


BASE = Rules(
    "base-1",
    (
        Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, any_case=True),
        Rule("access", r"AKIA[A-Z0-9]+", 16),
        Rule("hex", r"[0-9a-f]+", 32),
    ),
)


class Scanner:
    """Finds a version's spans in texts; one a task."""

    def __init__(self, rules: Rules):
        # A run of one class of characters is matched whole or not at all, so its least length may join the pattern.
        self.finders = [(i, r, re.compile(r.pattern.removesuffix("+") + f"{{{r.least},}}", re.ASCII) if re.fullmatch(r"\[[^\]]*\]\+", r.pattern) else r.compiled()) for i, r in enumerate(rules.rules)]

    def spans(self, text: str) -> list[dict]:
        found = [(m.start(), i, r.kind, m.end()) for i, r, p in self.finders for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
        return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """Paths and scans below a folder of shared storage; one program writes at a time."""

    def __init__(self, spark: SparkSession, folder: str, path_type: str = "string"):
        self.spark, self.folder, self.path_type = spark, folder.rstrip("/"), path_type

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was stored yet

    def _folder(self, name: str, key: str) -> str:
        return f"{self.folder}/{name}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def _committed(self) -> DataFrame:
        return self._stored("batches", "batch string")

    def paths(self) -> DataFrame:
        """path, blob, batch of every version of every path."""
        return self._stored("paths", f"path {self.path_type}, blob string, batch string").join(self._committed(), "batch", "left_semi")

    def scans(self) -> DataFrame:
        """blob, rules, spans of every pair that was scanned."""
        return self._stored("scans", SCANS)

    def commit(self, batch: str, rows: DataFrame, path_col: str = "path", text_col: str = "text") -> None:
        """Record a batch of versions; the same batch again changes nothing."""
        if not self._committed().where(F.col("batch") == batch).isEmpty():
            return
        versions = rows.select(F.col(path_col).cast(self.path_type).alias("path"), blob_of(F.col(text_col)).alias("blob"), F.lit(batch).alias("batch"))
        versions.write.mode("overwrite").parquet(self._folder("paths", batch))
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(self._folder("batches", batch))

    def scan(self, rules: Rules, rows: DataFrame, text_col: str = "text") -> int:
        """Scan the texts of rows (a batch, or all history) that this version of the rules has not seen; how many there were."""
        texts = rows.select(F.coalesce(text_col, F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
        # Copies meet in the task that reads them before any of them is shuffled.
        unseen = texts.groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.scans().where(F.col("rules") == rules.version).select("blob")
        if not seen.isEmpty():
            unseen = unseen.join(seen, "blob", "left_anti")
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

        def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(rules)
            for b in batches:
                spans = [scanner.spans(t) for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["blob"], pa.array([rules.version] * len(spans), pa.string()), pa.array(spans, pa.list_(span))], names=["blob", "rules", "spans"])

        for_python(self.spark)
        folder = self._folder("scans", uuid.uuid4().hex)
        unseen.select("blob", "text").mapInArrow(of, SCANS).write.parquet(folder)
        return self.spark.read.schema(SCANS).parquet(folder).count()

    def findings(self, rules: Rules) -> DataFrame:
        """path, blob, batch, spans of every version; spans are null where the version of the rules has not seen the blob."""
        found = self.scans().where(F.col("rules") == rules.version).select("blob", "spans")
        return self.paths().join(found, "blob", "left").select("path", "blob", "batch", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
