"""Stage 1 from landed files to metric cells, and the class-keyed search against brute force."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from georesolve.functions.geo import Grid
from georesolve.functions.scoring import CRITERIA, RULES
from georesolve.operators import layers, vector
from georesolve.plans import suitability

LON, LAT = 4.8283, 46.3069


@pytest.mark.parametrize("bucket", [50.0, 700.0])
def test_nearest_of_classes_is_exact(spark, bucket):
    """A dense class, a lone far point, a class on one spot and one without points."""
    rng = random.Random(5)
    targets = [(i, rng.uniform(0, 5000), rng.uniform(-5000, 5000)) for i in range(120)]
    points = [("dense", rng.uniform(0, 5000), rng.uniform(-5000, 0)) for _ in range(1500)] + [("far", 90_000.0, -70_000.0)] + [("spot", 10.0, 10.0)] * 3
    t, p = spark.createDataFrame(targets, "k int, x double, y double"), spark.createDataFrame(points, "cls string, x double, y double")
    got = {r["k"]: r for r in vector.nearest_of_classes(t, p, ["k"], ["dense", "far", "spot", "none"], bucket).collect()}
    for k, x, y in targets:
        for c in ("dense", "far", "spot"):
            assert got[k][f"dist_{c}"] == pytest.approx(min(math.hypot(x - a, y - b) for cls, a, b in points if cls == c), abs=1e-9)
        assert got[k]["dist_none"] == vector.NO_FEATURE and got[k]["x"] == x
    assert len(got) == len(targets)
    assert vector.nearest_of_classes(t.limit(0), p, ["k"], ["far"], bucket).count() == 0
    assert {r["dist_far"] for r in vector.nearest_of_classes(t, p.limit(0), ["k"], ["far"], bucket).collect()} == {vector.NO_FEATURE}


def test_classes_overlap_and_industry_is_told_apart_by_size(spark):
    square = lambda fid, side: [(fid, {"landuse": "military"}, i, float(x * side), float(y * side)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    rings = spark.createDataFrame(square("big", 200) + square("small", 100), "fid string, tags map<string,string>, seq int, x double, y double")
    got = {(r["fid"], r["cls"]) for r in layers.industry(layers.classed(rings, ["industrial"])).select("fid", "cls").collect()}
    assert got == {("big", "large_industry"), ("small", "light_industry")}
    rail = spark.createDataFrame([({"railway": "rail", "usage": "highspeed"},), ({"railway": "rail", "service": "spur"},)], "tags map<string,string>")
    assert {r["cls"] for r in layers.classed(rail, layers.LINE_CLASSES).collect()} == {"rail", "rail_highspeed"}


def _landed(folder, grid):
    """A slope to the north, one motorway, one school, a vineyard, a relation of two ways, two communes and some squares."""
    at = lambda dx, dy: {"lon": LON + dx / 77_000, "lat": LAT + dy / 111_000}
    box = lambda x0, y0, x1, y1: [at(*p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    elements = [
        {"type": "way", "id": 1, "tags": {"highway": "motorway"}, "geometry": [at(-1500, -900), at(1500, -900)]},
        {"type": "node", "id": 2, "tags": {"amenity": "school"}, **at(300, 300)},
        {"type": "way", "id": 3, "tags": {"landuse": "vineyard"}, "geometry": box(-700, -500, 100, 300)},
        {"type": "relation", "id": 4, "tags": {"natural": "wood"}, "members": [{"role": "outer", "geometry": box(200, 200, 900, 900)[:3]}, {"role": "outer", "geometry": box(200, 200, 900, 900)[2:]}]},
        {"type": "way", "id": 5, "tags": {"landuse": "quarry"}, "geometry": box(-900, 500, -500, 900)},
    ]
    ring = lambda *b: [[[p["lon"], p["lat"]] for p in box(*b)]]
    communes = [
        {"nom": "Est", "code": "71002", "centre": {"coordinates": [at(800, 0)["lon"], LAT]}, "contour": {"type": "Polygon", "coordinates": ring(0, -3000, 3000, 3000)}},
        {"nom": "Ouest", "code": "71001", "centre": {"coordinates": [at(-800, 0)["lon"], LAT]}, "contour": {"type": "Polygon", "coordinates": ring(-3000, -3000, 0, 3000)}},
    ]
    squares = [{"geo_point_2d": at(x, y), **dict.fromkeys(layers.CENSUS, 40.0)} for x in (-400, 0, 400) for y in (-400, 0, 400)]
    for name, text in (("features/f.json", json.dumps({"elements": elements})), ("communes/c.json", "\n".join(map(json.dumps, communes))), ("census/c.json", "\n".join(map(json.dumps, squares)))):
        (folder / name).parent.mkdir()
        (folder / name).write_text(text)
    (folder / "elevation").mkdir()
    side = 121
    (folder / "elevation" / "N46E004.hgt").write_bytes(b"".join(struct.pack(">h", 1000 - 5 * r) for r in range(side) for _ in range(side)))
    return side


def test_landed_files_to_scored_cells(spark, tmp_path):
    config = suitability.Config(lat=LAT, lon=LON, radius=1000, cell=200)
    grid = config.grid(spark)
    side = _landed(tmp_path, grid)
    cells = suitability.metric_cells(spark, grid, suitability.landed_inputs(spark, f"file://{tmp_path}", grid, side)).cache()
    assert {r.metric for r in RULES} | {c.metric for c in CRITERIA} <= set(cells.columns)
    rows = {(r["row"], r["col"]): r for r in cells.collect()}
    assert len(rows) == grid.n**2
    mid = rows[math.floor((grid.cy - grid.y0) / grid.cell), math.floor((grid.cx - grid.x0) / grid.cell)]
    assert mid["dist_motorway"] == pytest.approx(900, abs=150) and mid["dist_school"] == pytest.approx(424, abs=150) and mid["dist_pharmacy"] == vector.NO_FEATURE
    assert mid["vineyard_share_1km"] > 0.1 and mid["forest_share_1km"] > 0.1 and mid["farm_share_800m"] == 0
    assert min(r["dist_heavy"] for r in rows.values()) == 0.0  # inside the quarry
    assert mid["pop_1km"] == 9 * 40 and mid["income_1km"] == 1.0
    assert {r["commune"] for r in rows.values()} == {"Est", "Ouest"} and all((r["commune"] == "Est") == (r["x"] > grid.cx) for r in rows.values() if abs(r["x"] - grid.cx) > 250)
    # 5 m every 1/120 degree, falling to the south (the last sample is the southern edge).
    assert all(r["elev"] == pytest.approx(1000 - 5 * 120 * (47 - LAT) + 600 / 111_140 * (r["y"] - grid.cy), abs=1.0) for r in rows.values())
    assert all(r["southness"] == pytest.approx(1.0, abs=0.01) and r["slope_pct"] == pytest.approx(0.54, abs=0.01) for r in rows.values())
    scored = suitability.scored(cells, config, grid)
    assert scored.where(F.col("field").isNull() | (F.col("feasibility") < 0) | (F.col("feasibility") > 1)).count() == 0


def _tile(folder, name, side, z):
    (folder / f"{name}.hgt").write_bytes(b"".join(struct.pack(">h", z(r, c)) for r in range(side) for c in range(side)))


def test_blocks_give_what_single_samples_give(spark, tmp_path, monkeypatch):
    """At voids, block and tile borders, and beyond the tiles; only blocks of the box are made."""
    from georesolve.sources import landed

    monkeypatch.setattr(landed, "BLOCK", 8)
    side, rng = 21, random.Random(2)
    for name in ("N46E004", "N45E004"):
        _tile(tmp_path, name, side, lambda r, c: landed.VOID if (r, c) == (5, 7) else rng.randint(-400, 900))
    at = [(i, 4 + rng.random(), 45 + 2 * rng.random()) for i in range(300)] + [(900 + i, 4 + a / 20, 45 + b / 20) for i, (a, b) in enumerate([(0, 0), (8, 8), (16, 4), (19, 19), (20 - 1e-9, 1e-9), (8, 20), (7.5, 35.5)])] + [(999, 5.5, 46.5)]
    points = spark.createDataFrame(at, "k int, lon double, lat double")
    want = {r["k"]: r["z"] for r in landed.sampled(points, landed.elevation_tiles(spark, f"file://{tmp_path}"), ["k"], side).collect()}
    got = landed.sampled_in_blocks(points, landed.elevation_blocks(spark, f"file://{tmp_path}"), ["k"], side)
    assert sum(v is None for v in want.values()) >= 2 and {r["k"]: r["z"] if r["z"] is None else pytest.approx(r["z"], abs=1e-9) for r in got.collect()} == want
    box = (4.0, 46.0, 4.35, 46.35)
    few = landed.elevation_blocks(spark, f"file://{tmp_path}", box)
    assert {(r["tile"], r["br"], r["bc"]) for r in few.collect()} == {("N46E004", br, 0) for br in (1, 2)}


def test_census_box_reaches_the_scan_and_layers_have_their_own_reach(spark, tmp_path):
    from georesolve.sources import landed

    squares = [{"geo_point_2d": {"lon": 3 + i / 50, "lat": 45 + j / 50}, **dict.fromkeys(layers.CENSUS, 1.0)} for i in range(100) for j in range(100)]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, squares)))
    landed.land_census(spark, f"file://{tmp_path}/c.json", f"file://{tmp_path}/ordered", files=8)
    bounds = Grid(835000.0, 6580000.0, 10_000.0, 200.0).bounds()
    plain = landed.census(spark, f"file://{tmp_path}/c.json").where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))
    cut = landed.census(spark, f"file://{tmp_path}/ordered", bounds, ordered=True)
    assert 0 < cut.count() == plain.count() == landed.census(spark, f"file://{tmp_path}/c.json", bounds).count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = landed.census(spark, f"file://{tmp_path}/ordered", bounds, ordered=True)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lon" in plan and "LessThanOrEqual(lat" in plan
    # Files hold places that lie close together: few of them have any within the box.
    files = spark.read.parquet(f"file://{tmp_path}/ordered").groupBy(F.input_file_name()).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).collect()
    w, s, e, n = landed.lon_lat_box(spark, bounds)
    assert len(files) > 1 and sum(f[1] <= e and f[2] >= w and f[3] <= n and f[4] >= s for f in files) < len(files)
    grid = Grid(835000.0, 6580000.0, 1000.0, 200.0)
    box = landed.lon_lat_box(spark, grid.bounds())
    east = lambda metres: {"lat": (box[1] + box[3]) / 2, "lon": box[2] + metres / 77_000}
    (tmp_path / "f.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 1, "tags": {"highway": "motorway_junction"}, **east(20_000)},
        {"type": "node", "id": 2, "tags": {"amenity": "school"}, **east(20_000)},
        {"type": "node", "id": 3, "tags": {"amenity": "school"}, **east(7_000)},
        {"type": "way", "id": 4, "tags": {"landuse": "vineyard"}, "geometry": [east(2_000), east(9_000), east(5_000)]},
        {"type": "way", "id": 5, "tags": {"landuse": "vineyard"}, "geometry": [east(4_000), east(9_000), east(5_000)]},
        {"type": "node", "id": 6, "tags": {"amenity": "bench"}, **east(0)},
    ]}))
    kept = landed.near_grid(landed.map_features(spark, f"file://{tmp_path}/f.json"), grid.bounds())
    assert {r["fid"] for r in kept.collect()} == {"node/1", "node/3", "way/4"}
