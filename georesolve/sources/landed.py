"""Landed inputs: elevation tiles, map features, census, communes, pages, geocodes. Fetching is not done here."""

from __future__ import annotations

import gzip
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import to_l93, to_wgs
from ..operators.layers import CENSUS, tag
from ..operators.vector import point_of

TILE = 3601
VOID = -32768

POINT = "struct<lat:double,lon:double>"
FEATURES = f"elements array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,geometry:array<{POINT}>,members:array<struct<role:string,geometry:array<{POINT}>>>,bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>>>"
COMMUNES = "nom string, code string, codesPostaux array<string>, population long, surface double, centre struct<coordinates:array<double>>, contour struct<type:string,coordinates:string>, departement struct<code:string>"


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree tile that holds a point, such as N46E004."""
    a, o = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.format_string("%s%02d%s%03d", F.when(a >= 0, "N").otherwise("S"), F.abs(a), F.when(o >= 0, "E").otherwise("W"), F.abs(o))


def elevation_tiles(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """tile, r, c, z of gzipped or plain big-endian 16-bit tiles; r 0 is north; voids are null. One tile is one task's batch."""

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["tile"], b["content"], strict=True):
                try:
                    raw = gzip.decompress(raw)
                except (OSError, zlib.error):
                    pass
                side = int(round((len(raw) // 2) ** 0.5))
                z = np.frombuffer(raw, dtype=">i2", count=side * side).reshape(side, side)[::stride, ::stride].astype(float)
                z[z == VOID] = np.nan
                r, c = np.indices(z.shape)
                yield pd.DataFrame({"tile": name, "r": (r * stride).ravel(), "c": (c * stride).ravel(), "z": z.ravel()})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([NS]\d{2}[EW]\d{3})", 1).alias("tile"), "content")
    return files.mapInPandas(decode, "tile string, r int, c int, z double").withColumn("z", F.when(F.isnan("z"), None).otherwise(F.col("z")))


def sampled(points: DataFrame, tiles: DataFrame, keys: list[str], side: int = TILE) -> DataFrame:
    """keys and z: bilinear elevation at lon, lat; null without a tile or next to a void. The last row and column are the next tile's."""
    lat0, lon0 = F.floor("lat"), F.floor("lon")
    fr, fc = (lat0 + 1 - F.col("lat")) * (side - 1), (F.col("lon") - lon0) * (side - 1)
    r0, c0 = F.least(F.lit(side - 2), F.floor(fr)).cast("int"), F.least(F.lit(side - 2), F.floor(fc)).cast("int")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = points.select(*keys, tile_name(F.col("lat"), F.col("lon")).alias("tile"), (fr - r0).alias("__u"), (fc - c0).alias("__v"), r0.alias("__r"), c0.alias("__c"), corner.alias("__k"))
    t = t.withColumn("r", F.col("__r") + F.col("__k.i")).withColumn("c", F.col("__c") + F.col("__k.j"))
    weight = F.when(F.col("__k.i") == 1, F.col("__u")).otherwise(1 - F.col("__u")) * F.when(F.col("__k.j") == 1, F.col("__v")).otherwise(1 - F.col("__v"))
    got = t.join(tiles.where("z is not null"), ["tile", "r", "c"]).groupBy(*keys).agg(F.sum(weight * F.col("z")).alias("z"), F.count("*").alias("__n")).where("__n = 4").drop("__n")
    return points.select(*keys).join(got, keys, "left")


#: Samples along a block's side; a block holds one more row and column, so a point finds its four neighbours in it.
BLOCK = 64


def lon_lat_box(spark: SparkSession, bounds: tuple[float, float, float, float], pad: float = 0.0) -> tuple[float, float, float, float]:
    """lon and lat bounds (lon0, lat0, lon1, lat1) that hold a projected box (x0, y0, x1, y1) widened by pad metres; its edges are curves, so points along them are taken."""
    x0, y0, x1, y1 = bounds[0] - pad, bounds[1] - pad, bounds[2] + pad, bounds[3] + pad
    at = [i / 8 for i in range(9)]
    edge = [(x0 + (x1 - x0) * t, float(y)) for t in at for y in (y0, y1)] + [(float(x), y0 + (y1 - y0) * t) for t in at for x in (x0, x1)]
    lon, lat = to_wgs(F.col("x"), F.col("y"))
    r = spark.createDataFrame(edge, "x double, y double").select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    return r[0] - 1e-3, r[1] - 1e-3, r[2] + 1e-3, r[3] + 1e-3


def tile_glob(box: tuple[float, float, float, float]) -> str:
    """File name pattern of the one-degree tiles that a lon-lat box touches."""
    names = [f"{'N' if a >= 0 else 'S'}{abs(a):02d}{'E' if o >= 0 else 'W'}{abs(o):03d}" for a in range(math.floor(box[1]), math.floor(box[3]) + 1) for o in range(math.floor(box[0]), math.floor(box[2]) + 1)]
    return f"*{{{','.join(names)}}}*"


def elevation_blocks(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """tile, side, br, bc, z: square blocks of BLOCK + 1 samples a side of each tile, as arrays by rows from the north; voids are NaN.

    A block goes out as one row, so a tile is never a frame of its samples. With a lon-lat box, only tiles
    that it touches are opened, and only blocks that it touches go out.
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b["tile"].to_pylist(), b["content"], strict=True):
                raw = raw.as_py()
                try:
                    raw = gzip.decompress(raw)
                except (OSError, zlib.error):
                    pass
                side = int(round((len(raw) // 2) ** 0.5))
                z = np.frombuffer(raw, dtype=">i2", count=side * side).reshape(side, side)
                lat1, lon0 = (1 if name[0] == "N" else -1) * int(name[1:3]) + 1, (1 if name[3] == "E" else -1) * int(name[4:7])
                step = BLOCK / (side - 1)
                for br in range(-(-(side - 1) // BLOCK)):
                    if box and not (lat1 - (br + 1) * step <= box[3] and lat1 - br * step >= box[1]):
                        continue
                    at = [bc for bc in range(-(-(side - 1) // BLOCK)) if not box or (lon0 + bc * step <= box[2] and lon0 + (bc + 1) * step >= box[0])]
                    if at:
                        part = [np.where(w == VOID, np.nan, w).ravel() for w in (z[br * BLOCK : (br + 1) * BLOCK + 1, bc * BLOCK : (bc + 1) * BLOCK + 1].astype(np.float64) for bc in at)]
                        yield pa.RecordBatch.from_pydict({"tile": [name] * len(at), "side": pa.array([side] * len(at), pa.int32()), "br": pa.array([br] * len(at), pa.int32()), "bc": pa.array(at, pa.int32()), "z": part})

    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", tile_glob(box)) if box else reader).load(path).select(F.regexp_extract("path", r"([NS]\d{2}[EW]\d{3})[^/]*$", 1).alias("tile"), "content")
    return files.mapInArrow(decode, "tile string, side int, br int, bc int, z array<double>")


def sampled_in_blocks(points: DataFrame, blocks: DataFrame, keys: list[str], side: int = TILE) -> DataFrame:
    """keys and z: bilinear elevation at lon, lat from the one block that holds a point's four neighbours; null without a tile or next to a void."""
    fr, fc = (F.floor("lat") + 1 - F.col("lat")) * (side - 1), (F.col("lon") - F.floor("lon")) * (side - 1)
    r0, c0 = F.least(F.lit(side - 2), F.floor(fr)).cast("int"), F.least(F.lit(side - 2), F.floor(fc)).cast("int")
    t = points.select(*keys, tile_name(F.col("lat"), F.col("lon")).alias("tile"), (fr - r0).alias("__u"), (fc - c0).alias("__v"), r0.alias("__r"), c0.alias("__c"))
    t = t.withColumns({"br": F.floor(F.col("__r") / BLOCK).cast("int"), "bc": F.floor(F.col("__c") / BLOCK).cast("int")})
    met = t.join(blocks.select("tile", "br", "bc", F.col("z").alias("__z")), ["tile", "br", "bc"], "left")
    wide = F.least(F.lit(BLOCK + 1), F.lit(side) - F.col("bc") * BLOCK)
    at = lambda i, j: F.get("__z", (F.col("__r") - F.col("br") * BLOCK + i) * wide + F.col("__c") - F.col("bc") * BLOCK + j)
    u, v = F.col("__u"), F.col("__v")
    z = at(0, 0) * (1 - u) * (1 - v) + at(0, 1) * (1 - u) * v + at(1, 0) * u * (1 - v) + at(1, 1) * u * v
    return met.select(*keys, z.alias("z")).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def map_features(spark: SparkSession, path: str) -> DataFrame:
    """fid, type, tags, node, geometry, members, bounds of map JSON files."""
    e = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    node = F.when(F.col("e.lat").isNotNull(), F.struct("e.lat", "e.lon"))
    return e.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("fid"), "e.type", F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"), node.alias("node"), "e.geometry", "e.members", "e.bounds")


# How far beyond the grid each layer of the map is of use, in metres.
LAYERS = {
    "motorway": (8000, lambda: tag("highway").isin("motorway", "motorway_link")),
    "trunk_primary": (6000, lambda: tag("highway").isin("trunk", "trunk_link", "primary", "primary_link")),
    "rail": (6000, lambda: tag("railway").isin("rail", "light_rail", "narrow_gauge")),
    "junction": (22000, lambda: tag("highway") == "motorway_junction"),
    "places": (8000, lambda: tag("place").isin("city", "town", "village", "hamlet", "isolated_dwelling", "suburb")),
    "services": (8000, lambda: tag("amenity").isin("school", "kindergarten", "college", "pharmacy", "doctors") | tag("shop").isin("bakery", "supermarket", "convenience", "butcher")),
    "nature": (2500, lambda: tag("landuse").isin("vineyard", "farmland", "meadow", "orchard", "forest", "allotments", "greenhouse_horticulture", "plant_nursery", "grass") | tag("natural").isin("wood", "scrub", "water", "wetland", "grassland", "heath")),
    "built": (2500, lambda: tag("landuse").isin("residential", "industrial", "commercial", "retail", "quarry", "farmyard", "landfill", "military", "construction", "cemetery") | (tag("man_made") == "wastewater_plant") | tag("amenity").isin("waste_transfer_station", "waste_disposal") | (tag("aeroway") == "aerodrome") | (tag("power") == "plant") | (tag("generator:source") == "wind")),
}


def near_grid(features: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Features of some layer whose own box meets the grid's, widened by what the layer needs."""
    spark = features.sparkSession
    corners = F.concat(F.coalesce("geometry", F.array().cast(f"array<{POINT}>")), F.flatten(F.transform(F.coalesce("members", F.array().cast(f"array<struct<role:string,geometry:array<{POINT}>>>")), lambda m: F.coalesce(m["geometry"], F.array().cast(f"array<{POINT}>")))))
    edge = lambda of, k, side: F.coalesce(F.col(f"node.{k}"), of(F.transform(corners, lambda p: p[k])), F.col(f"bounds.{side}{k}"))
    rows = features.withColumn("__box", F.struct(edge(F.array_min, "lon", "min").alias("w"), edge(F.array_min, "lat", "min").alias("s"), edge(F.array_max, "lon", "max").alias("e"), edge(F.array_max, "lat", "max").alias("n")))
    wanted = F.lit(False)
    for pad, of in LAYERS.values():
        w, s, e, n = lon_lat_box(spark, bounds, pad)
        wanted = wanted | (of() & (F.col("__box.w") <= e) & (F.col("__box.e") >= w) & (F.col("__box.s") <= n) & (F.col("__box.n") >= s))
    return rows.where(wanted).drop("__box")


def feature_points(features: DataFrame) -> DataFrame:
    """fid, tags, x, y of any feature."""
    p = features.withColumn("p", point_of(F.col("node"), F.col("geometry"), F.col("bounds"))).where("p is not null")
    x, y = to_l93(F.col("p.lon"), F.col("p.lat"))
    return p.select("fid", "tags", x.alias("x"), y.alias("y"))


def feature_lines(features: DataFrame) -> DataFrame:
    """fid, tags, seq, x, y of ways."""
    v = features.where((F.col("type") == "way") & (F.size("geometry") > 0)).select("fid", "tags", F.posexplode("geometry").alias("seq", "p"))
    x, y = to_l93(F.col("p.lon"), F.col("p.lat"))
    return v.select("fid", "tags", "seq", x.alias("x"), y.alias("y"))


def relation_pieces(features: DataFrame) -> DataFrame:
    """relation, way, seq, x, y of outer members, for ring assembly."""
    m = features.where("type = 'relation'").select(F.regexp_extract("fid", r"(\d+)$", 1).cast("long").alias("relation"), F.posexplode("members").alias("way", "m")).where(F.col("m.role").isin("outer", ""))
    v = m.select("relation", "way", F.posexplode("m.geometry").alias("seq", "p"))
    x, y = to_l93(F.col("p.lon"), F.col("p.lat"))
    return v.select("relation", "way", "seq", x.alias("x"), y.alias("y"))


def space_key(lon: Column, lat: Column, bits: int = 16) -> Column:
    """Bits of longitude and latitude in turn: places near each other mostly have near keys."""
    key = F.lit(0).cast("bigint")
    for v, low, span, odd in ((lon, -180.0, 360.0, 0), (lat, -90.0, 180.0, 1)):
        q = F.floor((v - low) / span * (1 << bits)).cast("bigint")
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1)), 2 * b + odd))
    return key


CENSUS_SCHEMA = "geo_point_2d struct<lon:double,lat:double>, " + ", ".join(f"{c} double" for c in CENSUS)


def land_census(spark: SparkSession, path: str, out: str, files: int | None = None) -> None:
    """Census JSON as Parquet ordered by place (in so many files, else as many as its size asks for): longitudes and latitudes of a file and of a row group lie close together, so a reader of a box skips the others."""
    rows = spark.read.schema(CENSUS_SCHEMA).json(path).select(F.col("geo_point_2d.lon").alias("lon"), F.col("geo_point_2d.lat").alias("lat"), *CENSUS)
    rows.withColumn("__key", space_key(F.col("lon"), F.col("lat"))).repartitionByRange(*([files] if files else []), "__key").sortWithinPartitions("__key").drop("__key").write.parquet(out)


def census(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, ordered: bool = False) -> DataFrame:
    """x, y and the census fields of each square, cut to bounds (x0, y0, x1, y1). ordered: path was written by land_census.

    The box in longitude and latitude goes to the scan; the exact bounds are tested on what it returns.
    """
    rows = spark.read.parquet(path) if ordered else spark.read.schema(CENSUS_SCHEMA).json(path).select(F.col("geo_point_2d.lon").alias("lon"), F.col("geo_point_2d.lat").alias("lat"), *CENSUS)
    if bounds is not None:
        w, s, e, n = lon_lat_box(spark, bounds)
        rows = rows.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))
    x, y = to_l93(F.col("lon"), F.col("lat"))
    rows = rows.select(x.alias("x"), y.alias("y"), *CENSUS)
    return rows if bounds is None else rows.where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))


def communes(spark: SparkSession, path: str, cx: float, cy: float, limit: float) -> DataFrame:
    """code, name, postcodes, population, x, y, idx of communes whose centre lies within limit metres."""
    rows = spark.read.schema(COMMUNES).json(path)
    x, y = to_l93(F.col("centre.coordinates")[0], F.col("centre.coordinates")[1])
    out = rows.select("code", F.col("nom").alias("name"), F.col("codesPostaux").alias("postcodes"), "population", x.alias("x"), y.alias("y"), "contour")
    return out.where(F.hypot(F.col("x") - cx, F.col("y") - cy) <= limit)


def outer_rings(communes_df: DataFrame) -> DataFrame:
    """code, fid, seq, x, y: first ring of each polygon of a contour."""
    polys = F.when(F.col("contour.type") == "Polygon", F.array(F.from_json("contour.coordinates", "array<array<array<double>>>"))).otherwise(F.from_json("contour.coordinates", "array<array<array<array<double>>>>"))
    p = communes_df.select("code", F.posexplode(polys).alias("n", "poly")).select("code", F.concat_ws("/", "code", F.col("n").cast("string")).alias("fid"), F.posexplode(F.col("poly")[0]).alias("seq", "v"))
    x, y = to_l93(F.col("v")[0], F.col("v")[1])
    return p.select("code", "fid", "seq", x.alias("x"), y.alias("y"))


def geocoded(queries: DataFrame, geocodes: DataFrame) -> DataFrame:
    """queries (query, postcode) with the landed geocoder's answer; misses are stored as nulls too."""
    return queries.join(geocodes, ["query", "postcode"], "left")


def commune_index(files: DataFrame) -> DataFrame:
    """slug, code, name; of communes with one slug, the first file's. files: file, code, name."""
    from ..functions.text import slug

    return files.groupBy(slug(F.col("name")).alias("slug")).agg(F.min(F.struct("file", "code", "name")).alias("c")).select("slug", "c.code", "c.name")
