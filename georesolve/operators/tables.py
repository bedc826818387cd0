"""Stored tables: declared schemas, Parquet partitioned by a bucket of the key, merged bucket by bucket.

A batch is merged with the buckets that its keys fall into, read by partition pruning, and only those
are written again, by dynamic partition overwrite. The merged rows are checkpointed first, so that the
write reads nothing that it replaces. Each merge gives the same table when its batch comes again, so a
run that died half-way is repaired by running it again. One program writes to a table at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import store

#: Key columns and columns of each table.
TABLES = {
    "listing": (["key"], "key string, source string, source_id string, url string, title string, description string, price int, fees_included boolean, area_m2 double, land_m2 double, rooms int, bedrooms int, commune_name string, commune_code string, postcode string, address string, lat double, lon double, geo_precision string, dpe string, year_built int, has_terrace boolean, has_pool boolean, has_garage boolean, condition_hint string, agency string, agency_ref string, place_score double, place_zone string, zone_communes string, place_note string, first_seen timestamp, seen_at timestamp, active boolean, price_first int, raw string"),
    "photo": (["key"], "key string, url string, ord int, phash string, dhash string, width int, height int"),
    "price_history": (["key"], "key string, seen_at timestamp, price int"),
    "dup_link": (["key"], "key string, group_id string, method string, confidence double"),
    "review": (["key"], "key string, status string, note string, rating int, updated_at timestamp"),
    "ai_eval": (["key"], "key string, model string, condition_score double, needs_work string, has_terrace boolean, has_pool boolean, price_fairness string, summary string, raw string, created_at timestamp"),
    "person": (["name"], "name string, emoji string, active boolean"),
    "vote": (["group_id", "person"], "group_id string, person string, vote string, ts timestamp"),
    "dup_decision": (["a", "b"], "a string, b string, same int, ts timestamp"),
    "dup_candidate": (["a", "b"], "a string, b string, reason string, score double"),
    "hidden": (["key"], "key string, hidden_by string, reason string, hidden_at timestamp"),
    "run_log": (["source"], "source string, started_at timestamp, finished_at timestamp, found int, new int, errors string"),
}


def _replaced(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of arriving keys take the place of stored ones."""
    return lambda old, new: old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def _prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of all prices seen, late ones in their place; a repeated price of one moment is one."""
    return store.price_changes(old.unionByName(new).where("price is not null").distinct())


#: How a batch meets what is stored; tables that aren't named replace rows by key.
MERGES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "listing": lambda old, new: store.upserted(old, new.drop("first_seen", "price_first", "active")),
    "photo": lambda old, new: old.unionByName(store.new_photos(old, new)),
    "price_history": _prices,
    "review": store.merged_reviews,
    "vote": lambda old, new: store.votes_after(old.unionByName(new)),
    "dup_decision": lambda old, new: store.decisions_after(old.unionByName(new)),
}


class Tables:
    """The tables below a folder of shared storage; buckets is fixed for a folder's life."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.buckets}"

    def bootstrap(self) -> None:
        """Make the tables that are not there yet; those that are stay as they are."""
        for name, (_, ddl) in TABLES.items():
            self.spark.createDataFrame([], f"{ddl}, bucket int").write.mode("ignore").partitionBy("bucket").parquet(self.path(name))

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name][1]}, bucket int").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self._rows(name).drop("bucket")

    def put(self, name: str, rows: DataFrame) -> None:
        """Merge rows into a table; columns that it doesn't declare are left out, those that are missing are null."""
        keys, ddl = TABLES[name]
        declared = self.spark.createDataFrame([], ddl).schema
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in declared])
        if name == "dup_decision":
            new = new.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
        new = checkpointed(new.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("int")))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most one row a bucket
        if not touched:
            return
        old = self._rows(name).where(F.col("bucket").isin(touched)).drop("bucket")
        after = MERGES.get(name, _replaced(keys))(old, new.drop("bucket")).select(*declared.names)
        after = checkpointed(after.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("int")))
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))

    def put_listings(self, found: DataFrame) -> None:
        """A batch of listings (key, seen_at, price, photos as URLs, others): the listing table, new photos and price changes."""
        self.put("listing", found)
        self.put("price_history", found.select("key", "seen_at", "price"))
        if "photos" in found.columns:
            self.put("photo", found.select("key", F.posexplode("photos").alias("ord", "url")))


def totals(tables: Tables) -> DataFrame:
    """table, n of every table."""
    return reduce(DataFrame.unionByName, [tables.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n in TABLES])
