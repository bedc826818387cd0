"""What the training-data operators share: table reading, scratch folders, text normalisation."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of prose: a run of letters (and other numerals), as the fits and the scorers cut them.
WORD = re.compile(r"[^\W\d_]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_SHIPPED: set[str] = set()

#: Rows of one Arrow batch that goes to a Python worker: whole texts travel, so batches stay short.
BATCH_ROWS = 512
#: Texts of a batch that are Python strings, with their words, at once.
TEXTS_TOGETHER = 128
#: Whether an action's shuffle files go when it ends; else they stay until the driver's garbage collector finds its plan.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it.

    Only a local session may have none (tests, a laptop): a temporary folder is set, once.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder; its lineage ends there, so nothing reads its shuffle files again and they go at once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once; clusters need not have it installed."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId not in _SHIPPED:
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)


def for_python(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before a Python stage: ship the package, and bound the texts that one Arrow batch holds."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_memory() -> None:
    """At a Python task's end: Arrow and the C library give back what was freed, as the worker goes on with other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(of: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """of, a function of a task's batches, that gives memory back when the task is through."""

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from of(batches)
        finally:
            release_memory()

    return wrapped


def kept_rows(docs: DataFrame, text_col: str, tester: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows whose text passes; every column goes through untouched, and nothing is shuffled.

    tester: called once in each task, gives the test of some texts.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester()
        for b in batches:
            texts = b.column(text_col)
            kept = [k for s in range(0, len(texts), TEXTS_TOGETHER) for k in test(texts.slice(s, TEXTS_TOGETHER).to_pylist())]
            yield b.filter(pa.array(kept, pa.bool_()))

    for_python(docs.sparkSession)
    return docs.mapInArrow(releasing(of), docs.schema)


def drawn(key: Column, n: int, most: int) -> Column:
    """Whether a row of n is drawn by its key's hash so that about ``most`` are; all are if n is no more."""
    if n <= most:
        return F.lit(True)
    return F.xxhash64(key) < F.lit(-(1 << 63) + (most << 64) // n)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file: $TOKENIZER_DIR, else the installed public_tokenizers."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
