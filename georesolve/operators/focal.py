"""Focal (raster neighbourhood) operators over cells (row, col, value).

Windows of a box or disk are separable: one window over each row, one over each column, so a cell meets
only its row and its column, whatever the radius. Disks use, per distinct half-width, the sum over that
span of a row, and add the spans of the rows above and below. Frames are ranges, so sparse grids work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disk_spans(r: int) -> list[int]:
    """Half-width of the disk x² + y² <= r² at each distance in rows, 0 to r."""
    return [math.isqrt(r * r - dy * dy) for dy in range(r + 1)]


def disk_size(r: int) -> int:
    return sum((2 * w + 1) * (1 if dy == 0 else 2) for dy, w in enumerate(disk_spans(r)))


def padded(cells: DataFrame, value: str | list[str], r: int) -> DataFrame:
    """row, col and the values with the border repeated r cells outwards."""
    values = [value] if isinstance(value, str) else value
    e = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if e["r0"] is None:
        return cells.select("row", "col", *values)

    def copies(at: Column, low: int, high: int) -> Column:
        out = F.when((at == low) & (at == high), F.sequence(F.lit(low - r), F.lit(high + r)))
        return F.explode(out.when(at == low, F.sequence(F.lit(low - r), F.lit(low))).when(at == high, F.sequence(F.lit(high), F.lit(high + r))).otherwise(F.array(at)))

    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *values)
    rows = rows.select(copies(F.col("row"), e["r0"], e["r1"]).alias("row"), "col", *values)
    return rows.select("row", copies(F.col("col"), e["c0"], e["c1"]).alias("col"), *values)


def _row(a: int, b: int):
    return Window.partitionBy("row").orderBy("col").rangeBetween(a, b)


def _col(a: int, b: int):
    return Window.partitionBy("col").orderBy("row").rangeBetween(a, b)


def _extreme(cells: DataFrame, value: str, r: int, out: str, of) -> DataFrame:
    return cells.withColumn(out, of(value).over(_row(-r, r))).withColumn(out, of(out).over(_col(-r, r)))


def box_min(cells: DataFrame, value: str, r: int, out: str) -> DataFrame:
    """cells with the least value within r rows and columns. The border repeats, which changes no minimum."""
    return _extreme(cells, value, r, out, F.min)


def box_max(cells: DataFrame, value: str, r: int, out: str) -> DataFrame:
    return _extreme(cells, value, r, out, F.max)


def box_mean(cells: DataFrame, value: str, r: int, out: str) -> DataFrame:
    """cells with the mean over the box; beyond the border the nearest cell counts."""
    wide = padded(cells, value, r)
    # A border cell's copies have as many values as cells, so the mean of means is the mean.
    mean = wide.withColumn("__m", F.avg(value).over(_row(-r, r))).withColumn("__m", F.avg("__m").over(_col(-r, r)))
    return cells.join(mean.select("row", "col", F.col("__m").alias(out)), ["row", "col"])


def _disks(cells: DataFrame, of: dict[str, tuple[str, int]]) -> DataFrame:
    """row, col and for each name the sum of its value over the disk of its radius; all in one window over rows and one over columns."""
    spans = {name: (value, disk_spans(r)) for name, (value, r) in of.items()}
    widths = sorted({(value, w) for value, s in spans.values() for w in s})
    rows = cells.select("row", "col", *[F.sum(value).over(_row(-w, w)).alias(f"__{value}_{w}") for value, w in widths])

    def total(value: str, s: list[int]) -> Column:
        at = lambda dy: F.coalesce(F.sum(f"__{value}_{s[abs(dy)]}").over(_col(dy, dy)), F.lit(0.0))
        return sum((at(dy) + at(-dy) for dy in range(1, len(s))), at(0))

    return rows.select("row", "col", *[total(value, s).alias(name) for name, (value, s) in spans.items()])


def disk_sums(cells: DataFrame, of: dict[str, tuple[str, int]]) -> DataFrame:
    """cells with, for each name: (value, radius) of ``of``, the sum over the disk; nothing lies beyond the border."""
    return cells.join(_disks(cells, of), ["row", "col"])


def disk_means(cells: DataFrame, of: dict[str, tuple[str, int]]) -> DataFrame:
    """cells with, for each name: (value, radius) of ``of``, the mean over the disk; beyond the border the nearest cell counts."""
    values = list(dict.fromkeys(value for value, _ in of.values()))
    wide = padded(cells.select("row", "col", *values), values, max(r for _, r in of.values()))
    mean = _disks(wide, of).select("row", "col", *[(F.col(name) / disk_size(r)).alias(name) for name, (_, r) in of.items()])
    return cells.join(mean, ["row", "col"])


def disk_sum(cells: DataFrame, value: str, r: int, out: str) -> DataFrame:
    return disk_sums(cells, {out: (value, r)})


def disk_mean(cells: DataFrame, value: str, r: int, out: str) -> DataFrame:
    return disk_means(cells, {out: (value, r)})


def smooth(cells: DataFrame, value: str, r: int, out: str) -> DataFrame:
    return cells.withColumn(out, F.col(value)) if r <= 0 else disk_mean(cells, value, r, out)


def gradient(cells: DataFrame, value: str, cell: float) -> DataFrame:
    """cells with gx and gy: central differences, one-sided at the border."""

    def along(w) -> Column:
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull(), (after - here) / cell).when(after.isNull(), (here - before) / cell).otherwise((after - before) / (2 * cell))

    return cells.withColumn("gx", along(Window.partitionBy("row").orderBy("col"))).withColumn("gy", along(Window.partitionBy("col").orderBy("row")))


def slope_and_southness(cells: DataFrame, value: str, cell: float) -> DataFrame:
    """cells with slope_pct and southness: 1 on ground that falls to the south (row 0 is south)."""
    g, size = gradient(cells, value, cell), F.hypot("gx", "gy")
    return g.withColumn("slope_pct", size * 100).withColumn("southness", F.when(size > 1e-6, F.col("gy") / size).otherwise(0.0)).drop("gx", "gy")


def terrain(cells: DataFrame, value: str, cell: float, px) -> DataFrame:
    """elev, tpi_1km, tpi_3km, rel_elev_2km, rel_elev_5km, slope_pct, southness of an elevation raster without gaps."""
    out = cells.withColumn("elev", F.col(value))
    for name, metres in (("1km", 1000), ("3km", 3000)):
        out = box_mean(out, "elev", px(metres), f"__{name}").withColumn(f"tpi_{name}", F.col("elev") - F.col(f"__{name}")).drop(f"__{name}")
    for name, metres in (("2km", 2000), ("5km", 5000)):
        out = box_min(out, "elev", px(metres), f"__{name}").withColumn(f"rel_elev_{name}", F.col("elev") - F.col(f"__{name}")).drop(f"__{name}")
    out = slope_and_southness(out, "elev", cell).withColumnsRenamed({"slope_pct": "__s", "southness": "__o"})
    return box_mean(box_mean(out, "__s", px(300), "slope_pct"), "__o", px(400), "southness").drop("__s", "__o")


def cropped(cells: DataFrame, pad: int, n: int) -> DataFrame:
    """The interior of a frame padded by pad cells, renumbered from 0."""
    inner = cells.where(F.col("row").between(pad, pad + n - 1) & F.col("col").between(pad, pad + n - 1))
    return inner.withColumn("row", F.col("row") - pad).withColumn("col", F.col("col") - pad)
