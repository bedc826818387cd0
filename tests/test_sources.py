import gzip
import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from georesolve.functions import imagehash
from georesolve.operators import resolution, vector
from georesolve.sources import demo, landed, sinks


def png(path, a):
    h, w = a.shape
    raw = b"".join(b"\0" + bytes(np.repeat(row, 3)) for row in a.astype(np.uint8))
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def scene(seed, n):
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(0, 255, (12, 12))
    at = np.linspace(0, 11, n)
    rows = np.array([np.interp(at, range(12), r) for r in coarse])
    return np.array([np.interp(at, range(12), c) for c in rows.T]).T


def test_photo_hashes_survive_resizing_and_tell_scenes_apart(spark, tmp_path):
    for name, seed, n in (("a", 1, 400), ("b", 1, 260), ("c", 999, 400)):
        a = scene(seed, n)
        if name == "b":
            a[-20:, -60:] = 255  # a mark in the corner
        png(tmp_path / f"{name}.png", a)
    h = {r.origin[-5]: r for r in imagehash.hashed(spark.read.format("image").load(str(tmp_path))).collect()}
    bits = lambda x, y: (int(h[x].phash, 16) ^ int(h[y].phash, 16)).bit_count()
    assert bits("a", "b") <= 8 < bits("a", "c")


def test_demo_facts(spark):
    hex16 = lambda s, m: F.lower(F.lpad(F.hex(F.xxhash64(F.lit(m), s)), 16, "0"))
    df = demo.listings(spark).withColumn("photos", F.transform("photo_seeds", lambda s, i: F.struct(i.alias("ord"), hex16(s, 1).alias("phash"), hex16(s, 2).alias("dhash"))))
    g = {r.key: r.group_id for r in resolution.grouped(df)[0].collect()}
    assert g["d1"] == g["d2"] == "d1" and len(set(g.values())) == 6


def test_elevation_tile_is_sampled_bilinearly(spark, tmp_path):
    z = np.arange(25, dtype=">i2").reshape(5, 5)
    z[4, 4] = landed.VOID
    (tmp_path / "N46E004.hgt.gz").write_bytes(gzip.compress(z.tobytes()))
    tiles = landed.elevation_tiles(spark, str(tmp_path))
    points = spark.createDataFrame([(1, 4.125, 46.875), (2, 4.99, 46.01), (3, 9.5, 46.5)], "k int, lon double, lat double")
    assert {r.k: r.z for r in landed.sampled(points, tiles, ["k"], side=5).collect()} == {1: 3.0, 2: None, 3: None}


def test_map_features_and_census(spark, tmp_path):
    square = [{"lat": 46.0 + a, "lon": 4.0 + b} for a, b in ((0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0), (0, 0))]
    doc = {"elements": [{"type": "node", "id": 1, "lat": 46.1, "lon": 4.1, "tags": {"shop": "bakery"}}, {"type": "way", "id": 2, "tags": {"landuse": "forest"}, "geometry": square}, {"type": "relation", "id": 3, "members": [{"role": "outer", "geometry": square[:3]}, {"role": "outer", "geometry": square[2:]}, {"role": "inner", "geometry": square}], "bounds": {"minlat": 46, "maxlat": 47, "minlon": 4, "maxlon": 5}}]}
    (tmp_path / "map.json").write_text(json.dumps(doc))
    f = landed.map_features(spark, str(tmp_path / "map.json"))
    assert landed.feature_points(f).count() == 3 and landed.feature_lines(f).count() == 5
    assert vector.assembled_rings(landed.relation_pieces(f)).count() == 5
    (tmp_path / "census.json").write_text(json.dumps({"geo_point_2d": {"lon": 4.0, "lat": 46.0}, "pop_carr": 12}))
    assert landed.census(spark, str(tmp_path / "census.json")).first().pop_carr == 12
    ring = [[4.0, 46.0], [4.1, 46.0], [4.1, 46.1]]
    commune = {"nom": "X", "code": "71001", "codesPostaux": ["71000"], "centre": {"coordinates": [4.05, 46.05]}, "contour": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "communes.json").write_text(json.dumps(commune))
    c = landed.communes(spark, str(tmp_path / "communes.json"), 780000, 6550000, 1e6)
    assert landed.outer_rings(c).count() == 3


def test_feature_collection_is_json(spark):
    cells = spark.createDataFrame([(0, 0, 700000.0, 6600000.0, 55.55), (0, 1, 700200.0, 6600000.0, 60.0)], "row int, col int, x double, y double, score double")
    doc = json.loads(sinks.feature_collection(sinks.geojson_features(cells, 100.0)).first().geojson)
    ring = doc["features"][0]["geometry"]["coordinates"][0]
    assert len(doc["features"]) == 2 and len(ring) == 5 and ring[0] == ring[-1]
