"""Roll-ups of scored cells: zones, communes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import from_mercator, to_l93
from ..functions.scoring import NO_LIMIT

DETAIL = ["elev", "rel_elev_2km", "rel_elev_5km", "tpi_1km", "slope_pct", "southness", "farm_share_800m", "vineyard_share_1km", "forest_share_1km", "dist_motorway", "dist_rail", "dist_school", "dist_bakery", "dist_services", "pop_2km", "income_1km", "mean_house_m2"]
#: Cells of the best that one limiting factor must hold back to count as a weak spot.
WEAK_SHARE = 0.15


def zone_rollup(cells: DataFrame, cell_ha: float, value: str = "field", zone: str = "part", details: list[str] | None = None) -> DataFrame:
    """Per zone: cells, area_ha, score_max, score_mean, centroid and distance of its top quartile, metric means, rank.

    The top quartile is what scores at least the zone's exact 75th percentile.
    """
    details = [m for m in (details if details is not None else DETAIL) if m in cells.columns]
    p75 = cells.groupBy(zone).agg(F.percentile(value, 0.75).alias("p75"))
    c = cells.join(p75, zone)
    best = F.col(value) >= F.col("p75")
    out = c.groupBy(zone).agg(
        F.count("*").alias("cells"),
        (F.count("*") * cell_ha).alias("area_ha"),
        F.bround(F.max(value), 1).alias("score_max"),
        F.bround(F.avg(value), 1).alias("score_mean"),
        F.avg(F.when(best, F.col("x"))).alias("x"),
        F.avg(F.when(best, F.col("y"))).alias("y"),
        *[F.bround(F.avg(F.when(best, F.col(m))), 4).alias(m) for m in details],
    )
    # Zones are few; their rank needs them together.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score_max").desc(), F.col("cells").desc(), zone)))


def top_areas(cells: DataFrame, zone: str = "part", area: str = "commune", k: int = 3) -> DataFrame:
    """Per zone: its k areas with most cells, as an ordered list; the first by name of equals."""
    counts = cells.where(F.col(area).isNotNull()).groupBy(zone, area).count()
    ranked = counts.withColumn("i", F.row_number().over(Window.partitionBy(zone).orderBy(F.col("count").desc(), area))).where(F.col("i") <= k)
    return ranked.groupBy(zone).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", area))), lambda s: s[area]).alias("areas"))


def weak_spot(cells: DataFrame, value: str = "field", zone: str = "part") -> DataFrame:
    """zone, limiting, share: what holds back most of the zone's best cells, if at least 15% of them."""
    p75 = cells.groupBy(zone).agg(F.percentile(value, 0.75).alias("p75"))
    best = cells.join(p75, zone).where(F.col(value) >= F.col("p75"))
    total = best.groupBy(zone).agg(F.count("*").alias("n"))
    held = best.where((F.col("feasibility") < 0.995) & (F.col("limiting") != NO_LIMIT))
    counts = held.groupBy(zone, "limiting").count()
    all_held = counts.groupBy(zone).agg(F.sum("count").alias("held"))
    first = counts.withColumn("i", F.row_number().over(Window.partitionBy(zone).orderBy(F.col("count").desc(), "limiting"))).where("i = 1")
    out = first.join(all_held, zone).join(total, zone).where(F.col("held") >= WEAK_SHARE * F.col("n"))
    return out.select(zone, "limiting", F.bround(F.col("count") / F.col("n"), 2).alias("share"))


def commune_rollup(cells: DataFrame, cell_ha: float, least_score: float, area: str = "commune", value: str = "field", metrics: list[str] | None = None) -> DataFrame:
    """Per commune over its good cells: cells_good, area_good_ha, best, p90, hotspot (x, y), metric means."""
    metrics = [m for m in (metrics if metrics is not None else ["income_1km", "vineyard_share_1km", "rel_elev_5km", "dist_services"]) if m in cells.columns]
    good = F.col(value) >= least_score
    stats = cells.groupBy(area).agg(
        F.count("*").alias("cells"),
        F.count_if(good).alias("cells_good"),
        (F.count_if(good) * cell_ha).alias("area_good_ha"),
        F.max(value).alias("best"),
        F.percentile(F.when(good, F.col(value)), 0.9).alias("p90"),
        F.percentile(F.when(good, F.col(value)), 0.75).alias("p75"),
        *[F.bround(F.avg(F.when(good, F.col(m))), 3).alias(m) for m in metrics],
    )
    hot = cells.join(stats.select(area, "p75"), area).where(good & (F.col(value) >= F.col("p75"))).groupBy(area).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return stats.drop("p75").join(hot, area, "left")


def commune_status(cells_good: Column, p90: Column, least_cells: int = 6, green: float = 60, amber: float = 48) -> Column:
    return F.when(cells_good == 0, "excluded").when(cells_good < least_cells, "marginal").when(p90 >= green, "green").when(p90 >= amber, "amber").otherwise("marginal")


def commune_stats(cells: DataFrame, least_score: float, area: str = "commune", value: str = "field") -> DataFrame:
    """Per commune over all its cells: total, good, best, p90, median."""
    return cells.groupBy(area).agg(F.count("*").alias("total"), F.count_if(F.col(value) >= least_score).alias("good"), F.max(value).alias("best"), F.percentile(value, 0.9).alias("p90"), F.percentile(value, 0.5).alias("median"))


def field_summary(cells: DataFrame, cell_ha: float, least_score: float, value: str = "field") -> DataFrame:
    good = F.col(value) >= least_score
    return cells.agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("best"), (F.count_if(good) * cell_ha / 100).alias("good_km2"), (F.count_if(good) * 100.0 / F.count("*")).alias("good_pct"))


def named(areas: DataFrame, text: str) -> DataFrame:
    """Areas of a name: exact without case, else those that contain it."""
    t = F.lower(F.lit(text))
    exact = areas.where(F.lower("name") == t)
    return exact.unionByName(areas.where(F.lower("name").contains(t)).join(exact.select(F.lit(1).alias("__e")).limit(1), F.lit(True), "left_anti"))


def cell_at(clicks: DataFrame, grid, cells: DataFrame) -> DataFrame:
    """clicks (mx, my in Web Mercator metres) with the cell under each; null outside the grid."""
    lon, lat = from_mercator(F.col("mx"), F.col("my"))
    at = clicks.withColumn("__lon", lon).withColumn("__lat", lat)
    x, y = to_l93(F.col("__lon"), F.col("__lat"))
    row, col = grid.bin(x, y)
    return at.withColumn("row", row).withColumn("col", col).drop("__lon", "__lat").join(cells, ["row", "col"], "left")


def nearest_areas(areas: DataFrame, x: float, y: float, k: int = 15) -> DataFrame:
    return areas.withColumn("dist", F.hypot(F.col("x") - x, F.col("y") - y)).orderBy("dist", "name").limit(k)
