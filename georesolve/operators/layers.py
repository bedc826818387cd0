"""Assembly of the metric layers from features, census and terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..session import checkpointed
from . import focal, vector

# Tag values that classes are made of.
FARM, FARM_NATURAL = ["farmland", "meadow"], ["grassland"]
WOOD, WOOD_NATURAL = ["forest"], ["wood", "scrub", "heath"]
RAIL, RAIL_GONE, RAIL_SERVICE, RAIL_USAGE = ["rail", "light_rail", "narrow_gauge"], ["yes", "rail"], ["yard", "spur", "siding", "crossover"], ["industrial", "military", "tourism"]
INDUSTRY, LARGE_INDUSTRY_M2 = ["industrial", "military", "construction"], 30_000
CENSUS = ["pop_carr", "ind_snv", "men", "men_pauv", "men_surf", "men_mais", "men_coll", "log_soc", "log_av45", "log_45_70", "log_70_90", "log_ap_90", "log_inc"]
DWELLINGS = ["log_av45", "log_45_70", "log_70_90", "log_ap_90", "log_inc"]


def tag(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("tags"), F.lit(name)), F.lit(""))


def active_rail() -> Column:
    gone = F.lit(False)
    for k in ("disused", "abandoned", "razed"):
        gone = gone | tag(k).isin(RAIL_GONE)
    return tag("railway").isin(RAIL) & ~gone & ~tag("service").isin(RAIL_SERVICE) & ~tag("usage").isin(RAIL_USAGE)


def highspeed_rail() -> Column:
    return active_rail() & ((tag("highspeed") == "yes") | (tag("usage") == "highspeed"))


#: Feature classes by name; each a predicate over the column tags.
CLASSES = {
    "motorway": lambda: tag("highway").isin("motorway", "motorway_link"),
    "trunk_primary": lambda: tag("highway").isin("trunk", "trunk_link", "primary", "primary_link"),
    "junction": lambda: tag("highway") == "motorway_junction",
    "rail": active_rail,
    "rail_highspeed": highspeed_rail,
    "farm": lambda: tag("landuse").isin(FARM) | tag("natural").isin(FARM_NATURAL),
    "vineyard": lambda: tag("landuse") == "vineyard",
    "orchard": lambda: tag("landuse") == "orchard",
    "forest": lambda: tag("landuse").isin(WOOD) | tag("natural").isin(WOOD_NATURAL),
    "water": lambda: tag("natural").isin("water", "wetland"),
    "residential": lambda: tag("landuse") == "residential",
    "farmyard": lambda: tag("landuse") == "farmyard",
    "heavy": lambda: tag("landuse").isin("quarry", "landfill") | (tag("man_made") == "wastewater_plant") | tag("amenity").isin("waste_transfer_station", "waste_disposal") | (tag("aeroway") == "aerodrome") | (tag("power") == "plant"),
    "industrial": lambda: tag("landuse").isin(INDUSTRY),
    "plant": lambda: (tag("power") == "plant") | (tag("generator:source") == "wind"),
    "school": lambda: tag("amenity").isin("school", "kindergarten"),
    "bakery": lambda: tag("shop") == "bakery",
    "market": lambda: tag("shop").isin("supermarket", "convenience"),
    "pharmacy": lambda: tag("amenity") == "pharmacy",
    "village": lambda: tag("place").isin("village", "town", "city"),
}


def of_class(features: DataFrame, name: str) -> DataFrame:
    return features.where(CLASSES[name]())


#: What is measured to lines, to points and to contours of polygons; and shares of polygons with their radii in metres.
LINE_CLASSES = ["motorway", "trunk_primary", "rail", "rail_highspeed"]
POINT_CLASSES = ["junction", "plant", "school", "bakery", "market", "pharmacy", "village"]
AREA_CLASSES = ["farmyard", "heavy", "large_industry", "light_industry"]
SHARES = {"farm_share_800m": ("farm", 800), "vineyard_share_1km": ("vineyard", 1000), "orchard_share_1km": ("orchard", 1000), "forest_share_1km": ("forest", 1000), "water_share_500m": ("water", 500), "resid_share_1km": ("residential", 1000)}


def classed(features: DataFrame, names: list[str]) -> DataFrame:
    """features (tags, others) once for each class that they are of, with its name in cls."""
    return features.withColumn("cls", F.explode(F.array_compact(F.array(*[F.when(CLASSES[n](), n) for n in names]))))


def industry(rings: DataFrame) -> DataFrame:
    """Rings (cls, fid, seq, x, y) with industrial areas told apart by the area of each ring."""
    area = vector.shoelace(rings.where("cls = 'industrial'").select("fid", "seq", "x", "y"))
    size = F.when(F.col("area") >= LARGE_INDUSTRY_M2, "large_industry").otherwise("light_industry")
    return rings.join(area, "fid", "left").withColumn("cls", F.when(F.col("cls") == "industrial", size).otherwise(F.col("cls"))).drop("area")


def distance_and_share_layers(cells: DataFrame, grid: Grid, points: DataFrame, lines: DataFrame, rings: DataFrame, bucket: float = 600.0) -> DataFrame:
    """cells (row, col, x, y, others) with every layer that map features give.

    points: tags, x, y; lines: fid, tags, seq, x, y; rings: the same, one fid a closed ring. All distances
    are one search keyed by class, all shares one scan-line pass keyed by class and one pair of windows.
    A class without features is NO_FEATURE away and has no share.
    """
    wanted = [c for c, _ in SHARES.values()]
    polygons = checkpointed(industry(classed(rings, [*wanted, "farmyard", "heavy", "industrial"]).select("cls", F.concat_ws("/", "cls", "fid").alias("fid"), "seq", "x", "y")))
    ways = classed(lines, LINE_CLASSES).select("cls", F.concat_ws("/", "cls", "fid").alias("fid"), "seq", "x", "y").unionByName(polygons.where(F.col("cls").isin(AREA_CLASSES)))
    lone = F.count("*").over(Window.partitionBy("fid")) < 2  # no line
    dense = vector.densified(ways.withColumn("__lone", lone).where("not __lone"), keep=["cls"]).select("cls", "x", "y")
    all_points = dense.unionByName(classed(points, POINT_CLASSES).select("cls", "x", "y"))
    out = vector.nearest_of_classes(cells, all_points, ["row", "col"], [*LINE_CLASSES, *POINT_CLASSES, *AREA_CLASSES], bucket)
    covered = vector.rasterized(polygons, grid, keys=["cls"]).groupBy("row", "col").agg(*[F.max(F.when(F.col("cls") == c, F.col("share"))).alias(f"__{c}") for c in [*wanted, *AREA_CLASSES]])
    out = out.join(covered, ["row", "col"], "left").fillna(0.0, [f"__{c}" for c in [*wanted, *AREA_CLASSES]])
    for c in AREA_CLASSES:
        out = out.withColumn(f"dist_{c}", vector.polygon_distance(out, f"__{c}", f"dist_{c}"))
    means = focal.disk_means(out.select("row", "col", *[f"__{c}" for c in wanted]), {name: (f"__{c}", grid.px(r)) for name, (c, r) in SHARES.items()})
    out = out.drop(*[c for c in out.columns if c.startswith("__")]).join(means.select("row", "col", *SHARES), ["row", "col"])
    return out.withColumn("dist_nuisance", F.least("dist_heavy", "dist_large_industry", "dist_plant")).withColumn("dist_services", F.greatest("dist_school", "dist_bakery", "dist_market"))


def ratio(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a / F.greatest(b, F.lit(1e-6))))


def income(snv1: Column, pop1: Column, snv3: Column, pop3: Column) -> Column:
    """Income per head within 1 km; within 3 km where fewer than 31 live; unknown where still fewer do."""
    return F.when(pop1 > 30, snv1 / pop1).when(pop3 > 30, snv3 / pop3)


def census_layers(cells: DataFrame, census: DataFrame, grid: Grid) -> DataFrame:
    """cells with populations, income and housing shares around. census: x, y and the fields of CENSUS."""
    per_cell = vector.scattered(census, grid, cells.select("row", "col"), CENSUS)
    per_cell = per_cell.withColumn("dwellings", sum((F.col(c) for c in DWELLINGS), F.lit(0.0)))
    near = {"pop_carr": (1000, 2000, 3000), "ind_snv": (1000, 3000), "men": (1000,), "men_pauv": (1000,), "men_surf": (1000,), "men_mais": (1000,), "log_soc": (1000,), "dwellings": (1000,)}
    sums = focal.disk_sums(per_cell.select("row", "col", *near), {f"__{name}_{r}": (name, grid.px(r)) for name, radii in near.items() for r in radii})
    out = cells.join(sums.drop(*near), ["row", "col"])
    s = lambda n, r=1000: F.col(f"__{n}_{r}")
    out = (
        out.withColumn("pop_1km", s("pop_carr"))
        .withColumn("pop_2km", s("pop_carr", 2000))
        .withColumn("income_1km", income(s("ind_snv"), s("pop_carr"), s("ind_snv", 3000), s("pop_carr", 3000)))
        .withColumn("social_housing_share_1km", ratio(s("log_soc"), s("dwellings")))
        .withColumn("poor_share_1km", ratio(s("men_pauv"), s("men")))
        .withColumn("house_share_1km", ratio(s("men_mais"), s("men")))
        .withColumn("mean_house_m2", s("men_surf") / F.greatest(s("men"), F.lit(1e-6)))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])
