"""Outputs: GeoJSON, zone and whitelist JSON, delimited text, raster tables, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid, to_wgs


def geojson_features(cells: DataFrame, half: float, score: str = "score") -> DataFrame:
    """feature: a GeoJSON polygon (closed, 5 vertices, 5 decimals) of each cell, written as text lines."""

    def corner(dx: float, dy: float) -> Column:
        lon, lat = to_wgs(F.col("x") + dx, F.col("y") + dy)
        return F.array(F.round(lon, 5), F.round(lat, 5))

    ring = F.array(*[corner(a * half, b * half) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return cells.select("row", "col", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.round(score, 1).alias("score")).alias("properties"), shape.alias("geometry"))).alias("feature"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """One feature a line (GeoJSON text sequence), so that a large map needs no single writer."""
    features.select("feature").write.mode("overwrite").text(path)


def feature_collection(features: DataFrame) -> DataFrame:
    """One row: the whole collection. For maps that fit one document."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "feature"))), lambda s: s["feature"]), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


def delimited(rows: DataFrame, sep: str = ";") -> DataFrame:
    """One column line: lists joined by ", ", the separator inside values a comma, nulls empty."""

    def cell(name: str, kind: str) -> Column:
        value = F.array_join(F.col(name), ", ") if kind.startswith("array") else F.col(name).cast("string")
        return F.translate(F.coalesce(value, F.lit("")), sep, ",")

    return rows.select(F.concat_ws(sep, *[cell(n, t) for n, t in rows.dtypes]).alias("line"))


def whitelist(communes: DataFrame, zones: DataFrame) -> DataFrame:
    """One row: green and amber codes, communes by code (without excluded ones), zones; as JSON."""
    kept = communes.where("status <> 'excluded'")
    c = kept.agg(
        F.array_sort(F.collect_list(F.when(F.col("status") == "green", F.col("code")))).alias("green"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "amber", F.col("code")))).alias("amber"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", F.struct(*[x for x in kept.columns if x != "code"]))))).alias("communes"),
    )
    z = zones.agg(F.array_sort(F.collect_list(F.struct(*zones.columns))).alias("zones"))
    return c.join(F.broadcast(z)).select(F.to_json(F.struct("green", "amber", "communes", "zones")).alias("whitelist"))  # one row each


def write_field(cells: DataFrame, meta: DataFrame, path: str) -> None:
    """The published raster: cells (row, col, score, in_mask, part) and one row of grid parameters."""
    cells.select("row", "col", "score", "in_mask", "part").write.mode("overwrite").parquet(f"{path}/cells")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_field(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """(cells, grid) of what write_field published."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/cells"), Grid(meta["cx"], meta["cy"], meta["radius"], meta["cell"])


def grid_meta(spark: SparkSession, grid: Grid) -> DataFrame:
    """The row of grid parameters that write_field takes."""
    return spark.createDataFrame([(grid.x0, grid.y0, float(grid.cell), grid.n, float(grid.cx), float(grid.cy), float(grid.radius))], "x0 double, y0 double, cell double, n int, cx double, cy double, radius double")


def stored_once(spark: SparkSession, folder: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of build under a digest of its parameters (inputs' names among them): read if it was stored whole, else computed and stored.

    Spark moves a result's files into place when all are written and marks them, so a run that dies leaves nothing that would be read.
    """
    digest = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{digest}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_zones(zones: DataFrame, path: str) -> None:
    zones.write.mode("overwrite").json(path)


def report(zones: DataFrame, communes: DataFrame, top: int = 40, rules: DataFrame | None = None) -> str:
    """Markdown of the best zones and communes, and of what each rule kills and touches (scoring.rule_report); only the rows it prints are fetched."""

    def part(df: DataFrame, cols: list[str]) -> list[str]:
        lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
        return lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in df.limit(top).collect()]

    z = part(zones.orderBy("rank"), [c for c in ("rank", "cells", "area_ha", "score_max", "score_mean") if c in zones.columns])
    c = part(communes.orderBy(F.col("p90").desc_nulls_last(), F.col("cells_good").desc()), [c for c in ("commune", "status", "p90", "best", "cells_good") if c in communes.columns])
    r = ["# Rules", "", *part(rules.orderBy("rank"), ["kind", "key", "threshold", "margin", "killed_pct", "touched_pct"]), ""] if rules is not None else []
    return "\n".join([*r, "# Zones", "", *z, "", "# Communes", "", *c, ""])
