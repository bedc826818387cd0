"""Registry of the queries, and inputs that both Spark and SQL derive from the driver's tables.

Inputs use integer arithmetic, so that both sides start from the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to all cores: a small file of long work is read by one task. An explicit number of partitions is not coalesced."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row: the generator keeps the optimizer from copying them into each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A raster of 50 columns from part: row, col, z and a few metrics."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        F.expr("cast(p_partkey div 50 as int)").alias("row"),
        (k % 50).cast("int").alias("col"),
        ((s * 7 + k * 13) % 101).cast("double").alias("z"),
        s.cast("int").alias("size"),
        k.alias("key"),
    )


CELLS = """g AS (SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
  CAST((p_size * 7 + p_partkey * 13) % 101 AS DOUBLE) AS z, CAST(p_size AS INT) AS size, p_partkey AS key FROM part)"""


def rc(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.col("row").alias("r"), F.col("col").alias("c"), *cols)


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per part a row of metrics, some null."""
    k, s = F.col("p_partkey"), F.col("p_size")
    some = lambda c, m: F.when(k % m != 0, c.cast("double"))
    return table(spark, d, "part").select(
        k.alias("key"),
        some((k * 37) % 2000, 7).alias("dist_motorway"),
        some(s, 11).alias("slope_pct"),
        some(150 + (k * 3) % 120, 13).alias("elev"),
        (((k * 7) % 100) / 100.0).alias("farm_share_800m"),
        some((k * 11) % 40, 17).alias("rel_elev_2km"),
        ((k * 19) % 900).cast("double").alias("pop_2km"),
        some(15000 + (k * 91) % 20000, 5).alias("income_1km"),
        (k % 3 != 0).alias("inside"),
    )


METRICS = """m AS (SELECT p_partkey AS key,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST((p_partkey * 37) % 2000 AS DOUBLE) END AS dist_motorway,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS slope_pct,
  CASE WHEN p_partkey % 13 <> 0 THEN CAST(150 + (p_partkey * 3) % 120 AS DOUBLE) END AS elev,
  CAST((p_partkey * 7) % 100 AS DOUBLE) / 100.0::DOUBLE AS farm_share_800m,
  CASE WHEN p_partkey % 17 <> 0 THEN CAST((p_partkey * 11) % 40 AS DOUBLE) END AS rel_elev_2km,
  CAST((p_partkey * 19) % 900 AS DOUBLE) AS pop_2km,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(15000 + (p_partkey * 91) % 20000 AS DOUBLE) END AS income_1km,
  p_partkey % 3 <> 0 AS inside FROM part)"""


def _photos(k: Column) -> Column:
    """No, one or two photos: the first shared with one other listing, but for some bits; the second a listing's own.

    Listings 180 apart have one commune and area; those without either share photos with their neighbour of that kind.
    """
    own = F.when(k % 41 == 0, F.concat(F.lit("q"), F.expr("cast(p_partkey div 82 as string)"))).otherwise(F.concat((k % 180).cast("string"), F.lit("/"), F.expr("cast(p_partkey div 360 as string)")))
    tail = lambda h, turned: F.lpad(F.lower(F.hex(F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint").bitwiseXOR(F.expr(f"shiftleft(1L, cast({turned} as int)) - 1")))), 8, "0")
    hashed = lambda h, turned: F.concat(F.substring(h, 1, 8), tail(h, turned))
    shared = F.struct(F.lit(0).alias("ord"), hashed(F.md5(own), "(p_partkey * 7) % 20").alias("phash"), F.when(k % 5 != 0, hashed(F.md5(F.concat(F.lit("d"), own)), "(p_partkey * 11) % 23")).alias("dhash"))
    alone = F.md5(F.concat(F.lit("x"), k.cast("string")))
    second = F.struct(F.lit(1).alias("ord"), F.substring(alone, 1, 16).alias("phash"), F.substring(alone, 17, 16).alias("dhash"))
    return F.when(k % 7 == 0, F.array().cast("array<struct<ord:int,phash:string,dhash:string>>")).when(k % 7 < 3, F.array(shared, second)).otherwise(F.array(shared))


PHOTOS = """po AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 41 = 0 THEN 'q' || CAST(p_partkey // 82 AS VARCHAR) ELSE CAST(p_partkey % 180 AS VARCHAR) || '/' || CAST(p_partkey // 360 AS VARCHAR) END AS own FROM part),
  pv AS (SELECT k, ('0x' || md5(own)[1:16])::UBIGINT AS p0, ('0x' || md5('d' || own)[1:16])::UBIGINT AS d0, ('0x' || md5('x' || CAST(k AS VARCHAR))[1:16])::UBIGINT AS p1, ('0x' || md5('x' || CAST(k AS VARCHAR))[17:32])::UBIGINT AS d1 FROM po),
  ph AS (SELECT 'L' || lpad(CAST(k AS VARCHAR), 7, '0') AS key, CASE WHEN k % 7 = 0 THEN [] WHEN k % 7 < 3 THEN [shared, {'p': p1, 'd': d1}] ELSE [shared] END AS photos
    FROM (SELECT *, {'p': xor(p0, (1::UBIGINT << ((k * 7) % 20)::UBIGINT) - 1::UBIGINT), 'd': CASE WHEN k % 5 <> 0 THEN xor(d0, (1::UBIGINT << ((k * 11) % 23)::UBIGINT) - 1::UBIGINT) END} AS shared FROM pv))"""


def listings(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Listings from part, with nulls and zeros for what is missing; every 41st has neither commune nor area."""
    k, s = F.col("p_partkey"), F.col("p_size")
    part = table(spark, d, "part")
    return (spread(part, "p_partkey") if dealt else part).select(
        F.concat(F.lit("L"), F.lpad(k.cast("string"), 7, "0")).alias("key"),
        k.alias("ord"),
        F.concat(F.lit("src"), (k % 4).cast("string")).alias("source"),
        F.when(k % 41 != 0, (k % 60).cast("string")).alias("commune_code"),
        F.when(k % 41 != 0, F.concat(F.lit("Commune "), (k % 60).cast("string"))).alias("commune_name"),
        F.when((k % 19 != 0) & (k % 41 != 0), (60 + (k * 17) % 90).cast("double")).alias("area_m2"),
        F.when(k % 23 == 0, 0).otherwise(2 + s % 5).cast("int").alias("rooms"),
        F.when(k % 3 == 0, None).otherwise((k * 31) % 1500).cast("double").alias("land_m2"),
        F.when(k % 29 != 0, 150000 + ((k * 7919) % 60) * 2000).cast("int").alias("price"),
        F.when(k % 3 == 0, F.concat(F.lit("belle maison au calme avec jardin numero "), (k % 20).cast("string"))).otherwise(F.col("p_name")).alias("title"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        _photos(k).alias("photos"),
        F.when(k % 31 != 0, ((k * 13) % 100).cast("double")).alias("place_score"),
        (k % 10 != 0).alias("active"),
        (160000 + ((k * 7919) % 50) * 2000).cast("int").alias("price_first"),
        (k * 86400).alias("first_seen"),
        (s % 6).cast("int").alias("bedrooms"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("has_pool"),
    )


LISTINGS = """l AS (SELECT 'L' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS key, p_partkey AS ord,
  'src' || CAST(p_partkey % 4 AS VARCHAR) AS source, CASE WHEN p_partkey % 41 <> 0 THEN CAST(p_partkey % 60 AS VARCHAR) END AS commune_code,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 41 <> 0 THEN CAST(60 + (p_partkey * 17) % 90 AS DOUBLE) END AS area_m2,
  CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 2 + p_size % 5 END AS rooms,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST((p_partkey * 31) % 1500 AS DOUBLE) END AS land_m2,
  CASE WHEN p_partkey % 29 <> 0 THEN CAST(150000 + ((p_partkey * 7919) % 60) * 2000 AS INT) END AS price,
  CASE WHEN p_partkey % 3 = 0 THEN 'belle maison au calme avec jardin numero ' || CAST(p_partkey % 20 AS VARCHAR) ELSE p_name END AS title, p_type || ' ' || p_brand AS description,
  CASE WHEN p_partkey % 31 <> 0 THEN CAST((p_partkey * 13) % 100 AS DOUBLE) END AS place_score,
  p_partkey % 10 <> 0 AS active, CAST(160000 + ((p_partkey * 7919) % 50) * 2000 AS INT) AS price_first,
  p_partkey * 86400 AS first_seen, CAST(p_size % 6 AS INT) AS bedrooms,
  CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false END AS has_pool FROM part)"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of three people on groups G0..: the last of each person and group counts."""
    vote = F.element_at(F.array(F.lit("like"), F.lit("maybe"), F.lit("pass"), F.lit("like")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.concat(F.lit("G"), (F.col("user_id") % 100).cast("string")).alias("group_id"), F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string")).alias("person"), vote.alias("vote"), F.struct("ts", "event_id").alias("ts")).where("event_id % 5 <> 0")


VOTES = """v AS (SELECT group_id, person, vote FROM (SELECT 'G' || CAST(user_id % 100 AS VARCHAR) AS group_id,
  'P' || CAST(event_id % 3 AS VARCHAR) AS person, (['like', 'maybe', 'pass', 'like'])[event_id % 4 + 1] AS vote,
  row_number() OVER (PARTITION BY user_id % 100, event_id % 3 ORDER BY ts DESC, event_id DESC) AS i
  FROM events WHERE event_id % 5 <> 0) WHERE i = 1)"""


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups G0 to G109; some without a score."""
    k = F.col("id")
    return spark.range(110).select(F.concat(F.lit("G"), k.cast("string")).alias("group_id"), F.when(k % 9 != 0, ((k * 37) % 100).cast("double")).alias("place_score"))


GROUPS = """gr AS (SELECT 'G' || CAST(i AS VARCHAR) AS group_id,
  CASE WHEN i % 9 <> 0 THEN CAST((i * 37) % 100 AS DOUBLE) END AS place_score FROM range(110) t(i))"""


def people(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("P0", True), ("P1", True), ("P2", False)], "name string, active boolean")
