"""Streaming ingest of listing snapshots, beyond the batch runs: the natural form of a repeated crawl.

Each micro-batch's snapshots are stored under its number, so that a batch which runs again after a failure
replaces itself; ``current`` and ``price_history`` read them all. With ``tables``, each batch is also merged
into the stored listing, price and photo tables, where only the buckets of its keys are rewritten and a
repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..operators.tables import Tables


def start(snapshots: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, tables: Tables | None = None) -> StreamingQuery:
    """snapshots: a stream of key, seen_at, price and listing fields."""

    def write(batch: DataFrame, number: int) -> None:
        if tables is not None:
            tables.put_listings(batch)
        batch.write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The listing table of all committed snapshots: last fields, first price, first sighting."""
    snapshots = spark.read.parquet(f"{path}/snapshots").drop("batch")
    first = snapshots.groupBy("key").agg(F.min("seen_at").alias("first_seen"), F.min_by("price", "seen_at").alias("price_first"))
    return store.latest(snapshots, ["key"], ["seen_at"]).join(first, "key")


def price_history(spark: SparkSession, path: str) -> DataFrame:
    return store.price_changes(spark.read.parquet(f"{path}/snapshots"))


def windowed_prices(snapshots: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sightings and mean price by window and source, with a watermark for late snapshots."""
    return snapshots.withWatermark("seen_at", late).groupBy(F.window("seen_at", width), "source").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"))
