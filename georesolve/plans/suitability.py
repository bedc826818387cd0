"""Stage 1: from landed layers to scored cells, zones and communes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid, to_l93
from ..functions.scoring import Scoring, attractiveness, feasibility
from ..operators import focal, graph, layers, vector, zones
from ..session import checkpointed
from ..sources import landed

#: Communes whose centre lies so far beyond the circle still count, in metres.
COMMUNE_REACH = 15_000


@dataclass(frozen=True)
class Config:
    """Parameters of a run; the defaults are the engine's fixed values."""

    lat: float = 46.3069
    lon: float = 4.8283
    radius: float = 25_000
    cell: float = 200
    smooth: float = 400
    least_score: float = 52
    least_cells: int = 15
    peak_distance: float = 3000
    least_good_cells: int = 6
    green: float = 60
    amber: float = 48
    scoring: Scoring = field(default_factory=Scoring)

    def grid(self, spark: SparkSession) -> Grid:
        x, y = to_l93(F.lit(self.lon), F.lit(self.lat))
        c = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        return Grid(c["x"], c["y"], self.radius, self.cell)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """Overrides of the defaults from a YAML mapping of the same names; rules by key, null switches a rule off."""
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        scoring = Scoring()
        thresholds, margins, tolerance = raw.pop("thresholds", {}), raw.pop("margins", {}), raw.pop("tolerance", 0.0)
        rules = [replace(r, threshold=thresholds.get(r.key, r.threshold), margin=margins.get(r.key, r.margin)) for r in Scoring().rules]
        return cls(**raw, scoring=Scoring(rules=rules, tolerance=tolerance))


#: Cells around the grid that terrain windows look at, in metres.
TERRAIN_PAD = 5200


@dataclass(frozen=True)
class Inputs:
    """What stage 1 starts from, as DataFrames."""

    elevation: DataFrame  # row, col, z on the grid padded by terrain_pad cells; null where unknown
    points: DataFrame  # tags, x, y of any feature
    lines: DataFrame  # fid, tags, seq, x, y
    rings: DataFrame  # fid, tags, seq, x, y: closed outer rings
    census: DataFrame  # x, y and the census fields
    communes: DataFrame  # idx, name, x, y of centres
    commune_rings: DataFrame  # idx, fid, seq, x, y


def terrain_pad(grid: Grid) -> int:
    return math.ceil(TERRAIN_PAD / grid.cell)


def metric_cells(spark: SparkSession, grid: Grid, inputs: Inputs) -> DataFrame:
    """The grid's cells with every metric layer and the commune: terrain, distances, shares, census."""
    ground = vector.filled(inputs.elevation, "z") if not inputs.elevation.where("z is null").isEmpty() else inputs.elevation
    terrain = focal.terrain(ground.select("row", "col", "z"), "z", grid.cell, grid.px).drop("z")
    terrain = terrain.where(F.col("row").between(0, grid.n - 1) & F.col("col").between(0, grid.n - 1))
    cells = layers.distance_and_share_layers(grid.cells(spark), grid, inputs.points, inputs.lines, inputs.rings)
    cells = layers.census_layers(cells, inputs.census, grid).join(terrain, ["row", "col"])
    cells = vector.assigned(cells, inputs.commune_rings, inputs.communes, grid)
    return cells.join(inputs.communes.select("idx", F.col("name").alias("commune")), "idx", "left")


def landed_inputs(spark: SparkSession, folder: str, grid: Grid, side: int = landed.TILE) -> Inputs:
    """Inputs from the landed files: elevation/ tiles of side samples, features/, census/ and communes/ as JSON."""
    padded = grid.with_wgs(grid.cells(spark, terrain_pad(grid))).select("row", "col", "lon", "lat")
    box = landed.lon_lat_box(spark, grid.bounds(), TERRAIN_PAD + grid.cell)
    blocks = landed.elevation_blocks(spark, f"{folder}/elevation", box)
    elevation = landed.sampled_in_blocks(padded, blocks, ["row", "col"], side)
    features = landed.near_grid(landed.map_features(spark, f"{folder}/features"), grid.bounds())
    ways = landed.feature_lines(features)
    relations = features.where("type = 'relation'").select(F.col("fid").alias("relation"), "tags")
    pieces = vector.assembled_rings(landed.relation_pieces(features)).withColumn("relation", F.concat(F.lit("relation/"), F.col("relation").cast("string")))
    rings = ways.join(features.where("type = 'way' and size(geometry) >= 3").select("fid"), "fid", "left_semi")
    rings = rings.unionByName(pieces.join(relations, "relation").select("fid", "tags", "seq", "x", "y"))
    communes = landed.communes(spark, f"{folder}/communes", grid.cx, grid.cy, grid.radius + COMMUNE_REACH)
    ranked = graph.numbered(communes.select("code", "name", "x", "y"), ["code"], "idx")
    outer = landed.outer_rings(communes).join(ranked.select("code", "idx"), "code").select("idx", "fid", "seq", "x", "y")
    bounds = grid.bounds()
    return Inputs(elevation, landed.feature_points(features), ways, rings, landed.census(spark, f"{folder}/census", bounds), ranked.select("idx", "name", "x", "y"), outer)


def scored(cells: DataFrame, config: Config, grid: Grid) -> DataFrame:
    """cells (row, col, x, y, inside, metrics) with feasibility, limiting, attract and the smoothed field."""
    out = feasibility(cells, config.scoring)
    out = out.withColumn("attract", attractiveness(out, config.scoring)).withColumn("raw", F.col("attract") * F.col("feasibility"))
    radius = grid.px(config.smooth) if config.smooth > 0 else 0
    field_ = focal.smooth(out.select("row", "col", "raw"), "raw", radius, "field").select("row", "col", "field")
    return out.join(field_, ["row", "col"]).withColumn("field", F.when(F.col("inside"), F.col("field")).otherwise(0.0))


def published(cells: DataFrame, config: Config, grid: Grid) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells with part, zones, communes). cells need x, y, inside, commune and the metrics."""
    s = checkpointed(scored(cells, config, grid))
    ha = grid.cell * grid.cell / 10_000
    parts = checkpointed(graph.zones(s, "field", config.least_score, config.least_cells, grid.px(config.peak_distance)))
    c = s.join(parts.select("row", "col", "part"), ["row", "col"], "left").withColumn("in_mask", F.col("part").isNotNull()).withColumn("score", F.col("field"))
    z = zones.zone_rollup(c.where("in_mask"), ha)
    z = z.join(zones.top_areas(c.where("in_mask")), "part", "left").join(zones.weak_spot(c.where("in_mask")), "part", "left")
    m = zones.commune_rollup(c.where(F.col("commune").isNotNull() & F.col("inside")), ha, config.least_score)
    m = m.withColumn("status", zones.commune_status(F.col("cells_good"), F.col("p90"), config.least_good_cells, config.green, config.amber))
    return c, z, m.orderBy(F.col("p90").desc_nulls_last(), F.col("cells_good").desc(), "commune")
