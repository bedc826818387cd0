"""Projection, grid and raster arithmetic as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# GRS80 and the conic of EPSG:2154.
_A, _E = 6378137.0, 0.0818191910428158
_LON0, _LAT0, _LAT1, _LAT2, _X0, _Y0 = math.radians(3.0), math.radians(46.5), math.radians(44.0), math.radians(49.0), 700000.0, 6600000.0


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


def _t(lat: float) -> float:
    return math.tan(math.pi / 4 - lat / 2) / ((1 - _E * math.sin(lat)) / (1 + _E * math.sin(lat))) ** (_E / 2)


_N = math.log(_m(_LAT1) / _m(_LAT2)) / math.log(_t(_LAT1) / _t(_LAT2))
_F = _m(_LAT1) / (_N * _t(_LAT1) ** _N)
_R0 = _A * _F * _t(_LAT0) ** _N


def to_l93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to Lambert-93 metres."""
    phi, s = F.radians(lat), F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - _E * s) / (1 + _E * s), _E / 2)
    r, theta = F.lit(_A * _F) * F.pow(t, _N), F.lit(_N) * (F.radians(lon) - _LON0)
    return F.lit(_X0) + r * F.sin(theta), F.lit(_Y0 + _R0) - r * F.cos(theta)


def to_wgs(x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
    """Lambert-93 metres to WGS84 degrees (lon, lat); the latitude by a few fixed-point steps."""
    dx, dy = x - _X0, F.lit(_Y0 + _R0) - y
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_A * _F), 1 / _N)
    # The steps run inside one fold, as an expression of nested copies would double with each.
    first = F.lit(math.pi / 2) - 2 * F.atan(t)
    step = lambda lat, _: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - _E * F.sin(lat)) / (1 + _E * F.sin(lat)), _E / 2))
    return F.degrees(F.atan2(dx, dy) / _N + _LON0), F.degrees(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; the latitude clipped to ±85.05."""
    lat = F.greatest(F.lit(-85.05), F.least(F.lit(85.05), lat))
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * 6378137.0


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / 6378137.0), F.degrees(2 * F.atan(F.exp(y / 6378137.0)) - math.pi / 2)


@dataclass(frozen=True)
class Grid:
    """A regular grid of cell metres around a centre; row 0 is the southernmost, the origin a multiple of cell."""

    cx: float
    cy: float
    radius: float
    cell: float

    @property
    def x0(self) -> float:
        return math.floor((self.cx - self.radius) / self.cell) * self.cell

    @property
    def y0(self) -> float:
        return math.floor((self.cy - self.radius) / self.cell) * self.cell

    @property
    def n(self) -> int:
        return math.ceil(2 * self.radius / self.cell) + 1

    def px(self, metres: float) -> int:
        """Cells of a radius: half-even, at least 1."""
        return max(1, round(metres / self.cell))

    def cells(self, spark: SparkSession, pad: int = 0) -> DataFrame:
        """row, col, x, y (centres), dist_center, inside."""
        side = self.n + 2 * pad
        ids = spark.range(side * side).select((F.floor(F.col("id") / side) - pad).cast("int").alias("row"), (F.col("id") % side - pad).cast("int").alias("col"))
        x, y = F.lit(self.x0) + (F.col("col") + 0.5) * self.cell, F.lit(self.y0) + (F.col("row") + 0.5) * self.cell
        d = F.hypot(F.col("x") - self.cx, F.col("y") - self.cy)
        return ids.select("row", "col", x.alias("x"), y.alias("y")).withColumn("dist_center", d).withColumn("inside", F.col("dist_center") <= self.radius)

    def bounds(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0, self.x0 + self.n * self.cell, self.y0 + self.n * self.cell

    def bin(self, x: Column, y: Column) -> tuple[Column, Column]:
        """row and col of a point; null outside the grid."""
        row, col = F.floor((y - self.y0) / self.cell).cast("int"), F.floor((x - self.x0) / self.cell).cast("int")
        on = row.between(0, self.n - 1) & col.between(0, self.n - 1)
        return F.when(on, row), F.when(on, col)

    def fractional(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional pixel of a point, whole at cell centres."""
        return (y - self.y0) / self.cell - 0.5, (x - self.x0) / self.cell - 0.5

    def with_wgs(self, cells: DataFrame) -> DataFrame:
        lon, lat = to_wgs(F.col("x"), F.col("y"))
        return cells.withColumn("lon", lon).withColumn("lat", lat)

    def bbox_wgs(self, spark: SparkSession) -> DataFrame:
        """One row: the least and largest longitude and latitude of the grid's corners."""
        ax, ay, bx, by = self.bounds()
        lon, lat = to_wgs(F.col("x"), F.col("y"))
        corners = spark.createDataFrame([(ax, ay), (ax, by), (bx, ay), (bx, by)], "x double, y double").select(lon.alias("lon"), lat.alias("lat"))
        return corners.agg(F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"))


def px(metres: Column, cell: float) -> Column:
    return F.greatest(F.lit(1), F.bround(metres / cell).cast("int"))


#: Colour ramp of the score map: value and red, green, blue; piecewise linear between.
RAMP = [(0.0, (165, 0, 38)), (0.17, (215, 48, 39)), (0.34, (253, 174, 97)), (0.5, (255, 255, 191)), (0.67, (166, 217, 106)), (0.84, (26, 152, 80)), (1.0, (0, 104, 55))]


def ramp_color(v: Column) -> Column:
    """Struct r, g, b of a value from 0 to 1; null stays null."""
    v = F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))

    def channel(k: int) -> Column:
        out = None
        for (a, ca), (b, cb) in zip(RAMP, RAMP[1:], strict=False):
            value = ca[k] + (v - a) / (b - a) * (cb[k] - ca[k])
            out = F.when(v <= b, value) if out is None else out.when(v <= b, value)
        return F.bround(out).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def quantized(v: Column, low: float, high: float) -> Column:
    """1 to 255 over a range, 0 for no data."""
    return F.when(v.isNull(), 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - low) / (high - low) * 254 + 1)).cast("int"))


def dequantized(q: Column, low: float, high: float) -> Column:
    return F.when(q > 0, (q - 1) / 254 * (high - low) + low)


def quantized_int(v: Column) -> Column:
    """0 to 254 as is, 255 for none; categories are looked up, never blended."""
    return F.when(v.isNull(), 255).otherwise(F.least(F.lit(254), v.cast("int")))
