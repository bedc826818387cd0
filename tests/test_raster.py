import math

import pytest
from pyspark.sql import functions as F

from georesolve.functions import geo, scoring
from georesolve.operators import focal, graph, vector


def grid(spark, n, value):
    return spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("row"), (F.col("id") % n).cast("int").alias("col")).withColumn("v", value)


@pytest.mark.parametrize("r,size", [(2, 13), (4, 49), (5, 81), (10, 317), (15, 709)])
def test_disk_sizes(r, size):
    assert focal.disk_size(r) == size


def test_constant_raster_keeps_its_mean(spark):
    g = grid(spark, 12, F.lit(7.0))
    for op in (focal.box_mean, focal.disk_mean):
        assert {round(x.m, 9) for x in op(g, "v", 3, "m").collect()} == {7.0}


def test_impulse_gives_the_kernel(spark):
    g = grid(spark, 21, F.when((F.col("row") == 10) & (F.col("col") == 10), 1.0).otherwise(0.0))
    assert focal.disk_sum(g, "v", 4, "s").agg(F.sum("s")).first()[0] == 49


def test_projection_origin_and_inverse(spark):
    x, y = geo.to_l93(F.lit(3.0), F.lit(46.5))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (round(r.x, 6), round(r.y, 6)) == (700000, 6600000)
    lon, lat = geo.to_wgs(F.lit(r.x + 1000), F.lit(r.y - 5000))
    back = spark.range(1).select(*geo.to_l93(lon, lat)).first()
    assert abs(back[0] - r.x - 1000) < 1e-6 and abs(back[1] - r.y + 5000) < 1e-6


def test_membership_points(spark):
    v = spark.createDataFrame([(800.0,), (450.0,), (625.0,), (None,), (2000.0,)], "v double")
    got = [round(x[0], 6) for x in v.select(scoring.membership(F.col("v"), "min", 800, 350)).collect()]
    assert got == [1.0, 0.0, 0.5, 0.6, 1.0]


def test_components_touch_diagonally_and_small_ones_drop(spark):
    cells = [(0, 0), (1, 1), (5, 5)] + [(10, c) for c in range(15)]
    labels = graph.labelled_cells(spark.createDataFrame(cells, "row int, col int"))
    sizes = sorted(r["count"] for r in labels.groupBy("label").count().collect())
    assert sizes == [1, 2, 15]
    assert graph.drop_small(labels, 15).count() == 15
    assert graph.drop_small(labels, 16).count() == 0


def test_snake_is_one_component(spark):
    n = 30
    cells = [(r, c) for r in range(n) for c in range(n) if r % 2 == 0 or c == (n - 1 if r % 4 == 1 else 0)]
    assert graph.labelled_cells(spark.createDataFrame(cells, "row int, col int")).select("label").distinct().count() == 1


def test_suppression_is_greedy(spark):
    peaks = spark.createDataFrame([(1, 0, 0, 9.0), (1, 0, 3, 8.0), (1, 0, 6, 7.0), (2, 0, 1, 5.0)], "label int, row int, col int, v double")
    kept = {(r.label, r.col) for r in graph.suppressed(peaks, "v", 5.0).collect()}
    assert kept == {(1, 0), (1, 6), (2, 1)}


def test_nearest_is_exact_far_away_and_without_points(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 90000.0, 0.0)], "k int, x double, y double")
    p = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    assert {r.k: round(r.dist, 6) for r in vector.nearest(t, p, ["k"], 10.0).collect()} == {1: 5.0, 2: round(math.hypot(89997, 4), 6)}
    assert {r.dist for r in vector.nearest(t, p.limit(0), ["k"], 10.0).collect()} == {1e9}


def test_rings_are_assembled_from_ways_in_any_direction(spark):
    ways = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 4.0, 0.0), (1, 1, 0, 0.0, 4.0), (1, 1, 1, 4.0, 4.0), (1, 1, 2, 4.0, 0.0), (1, 2, 0, 0.0, 4.0), (1, 2, 1, 0.0, 0.0)]
    rings = vector.assembled_rings(spark.createDataFrame(ways, "relation long, way int, seq int, x double, y double"))
    assert vector.shoelace(rings.select("fid", "seq", "x", "y")).first().area == 16.0


def _greedy(peaks, d):
    kept = []
    for g, r, c, v in sorted(peaks, key=lambda p: (-p[3], p[1], p[2])):
        if all(g != h or math.hypot(r - a, c - b) >= d for h, a, b, _ in kept):
            kept.append((g, r, c, v))
    return {k[:3] for k in kept}


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_suppression_equals_the_plain_greedy(spark, tile):
    """Random peaks, a plateau and two groups in one place."""
    import random

    rng = random.Random(tile)
    at = rng.sample([(r, c) for r in range(60) for c in range(60)], 500)
    peaks = [(1, r, c, float(rng.randint(0, 40))) for r, c in at] + [(2, r, c, 1.0) for r in range(20) for c in range(20)]
    got = graph.suppressed(spark.createDataFrame(peaks, "label int, row int, col int, v double"), "v", 5.0, tile=tile)
    assert {(r.label, r.row, r.col) for r in got.collect()} == _greedy(peaks, 5.0)


def test_falling_ridge_takes_few_rounds(spark, monkeypatch):
    rounds, settle = [], graph._settled
    monkeypatch.setattr(graph, "_settled", lambda *a: rounds.append(1) or settle(*a))
    n = 10_000
    ridge = spark.range(n).select(F.lit(1).alias("label"), F.lit(3).alias("row"), F.col("id").cast("int").alias("col"), (-F.col("id")).cast("double").alias("v"))
    assert {r.col for r in graph.suppressed(ridge, "v", 7.0).collect()} == set(range(0, n, 7))
    assert len(rounds) <= 6
    assert graph.suppressed(ridge.limit(0), "v", 7.0).count() == 0


def test_split_equals_brute_force_on_a_snake_and_a_giant_component(spark):
    """Peaks far apart, ties, a component without peaks and one with a single peak."""
    n = 40
    snake = [(r, c, 1) for r in range(n) for c in range(n) if r % 2 == 0 or c == (n - 1 if r % 4 == 1 else 0)]
    other = [(r, c, 2) for r in range(100, 104) for c in range(4)] + [(r, c, 3) for r in range(200, 203) for c in range(3)]
    peaks = [(1, 0, 0, 9.0), (1, 0, 2, 9.0), (1, 38, 39, 5.0), (1, 20, 20, 7.0), (3, 201, 1, 2.0)]
    labels = spark.createDataFrame(snake + other, "row int, col int, label long")
    got = {(r.row, r.col): (r.label, r.part) for r in graph.split_by_peaks(labels, spark.createDataFrame(peaks, "label long, row int, col int, v double"), "v", 3.0).collect()}
    order = sorted((p for p in peaks if p[0] == 1), key=lambda p: (-p[3], p[1], p[2]))
    owner = lambda r, c: min(range(len(order)), key=lambda i: ((r - order[i][1]) ** 2 + (c - order[i][2]) ** 2, i))
    want = {(r, c): (1, 1 + owner(r, c)) for r, c, _ in snake} | {(r, c): (x, 3 + x) for r, c, x in other}
    assert got == want


def _joined_one_by_one(lines, atol, rtol):
    """Each joint looks at every way that is left."""
    import numpy as np

    meets, rings, lines = lambda a, b: np.allclose(a, b, atol=atol, rtol=rtol), [], list(lines)
    while lines:
        ring = lines.pop(0)
        while not meets(ring[0], ring[-1]):
            for i, w in enumerate(lines):
                grown = [w2 for ok, w2 in ((meets(ring[-1], w[0]), lambda: [ring, w[1:]]), (meets(ring[-1], w[-1]), lambda: [ring, w[::-1][1:]]), (meets(ring[0], w[-1]), lambda: [w[:-1], ring]), (meets(ring[0], w[0]), lambda: [w[::-1][:-1], ring])) if ok]
                if grown:
                    ring = np.vstack(grown[0]())
                    lines.pop(i)
                    break
            else:
                break
        if len(ring) >= 3:
            rings.append(ring)
    return rings


def test_rings_equal_those_joined_one_by_one_and_grow_linearly():
    import random
    import time

    import numpy as np

    def circle(n, per, cx, rng):
        """A circle of n ways in random order and direction, ends shifted within the tolerance."""
        t = np.linspace(0, 2 * np.pi, n * per + 1)
        at = np.column_stack([cx + 5000 * np.cos(t), 6_500_000 + 5000 * np.sin(t)])
        ways = [at[i * per : (i + 1) * per + 1] + rng.uniform(-0.1, 0.1) for i in range(n)]
        return [w[::-1] if rng.random() < 0.5 else w for w in ways]

    rng = random.Random(4)
    for n in (1, 2, 7, 50):
        ways = circle(n, 5, 0.0, rng) + circle(3, 4, 30_000.0, rng) + [np.array([[90_000.0, 1.0], [90_500.0, 1.0]])]
        rng.shuffle(ways)
        for rtol in (0.0, 1e-5):
            got, want = vector.joined_ways(ways, 0.5, rtol), _joined_one_by_one(ways, 0.5, rtol)
            assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    ways = circle(50_000, 1, 0.0, rng)
    rng.shuffle(ways)
    start = time.time()
    assert sum(len(r) for r in vector.joined_ways(ways, 0.05, 0.0)) > 0
    assert time.time() - start < 30


def _frames(monkeypatch):
    """What the searches materialise, with the plans by which they do."""
    found, keep = [], vector.checkpointed

    def recorded(df):
        out = keep(df)
        found.append((out, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(vector, "checkpointed", recorded)
    return found


def test_nearest_searches_once_a_place_and_in_narrower_buckets_where_points_are_dense(spark, monkeypatch):
    frames = _frames(monkeypatch)
    t = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 * 40.0).alias("x"), F.lit(0.0).alias("y"))
    p = spark.range(3000).select((F.col("id") % 30 * 0.5).alias("x"), F.lit(3.0).alias("y"), F.col("id").alias("c"))
    got = vector.nearest(t, p, ["k"], 10.0, "c").collect()
    assert len(got) == 3000 and {(r.k % 3, round(r.dist, 9), r.c) for r in got} == {(0, 3.0, 0), (1, round(math.hypot(25.5, 3), 9), 29), (2, round(math.hypot(65.5, 3), 9), 29)}
    counts = [f.count() for f, _ in frames if {"px", "py"} <= set(f.columns)]
    assert counts[-1] == 30 and max(f.count() for f, _ in frames if f.columns == ["x", "y"]) == 3
    assert not any("Broadcast" in plan for _, plan in frames)
    rows = t.where("k < 3").select("x", "y")
    assert vector._first_width(rows, p.select(F.col("x").alias("px"), F.col("y").alias("py")), 10.0) < 10


def test_voids_are_filled_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    frames = _frames(monkeypatch)
    g = spark.range(400).select(F.expr("cast(id div 20 as int)").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") % 7 < 3, F.col("id").cast("double")).alias("z"))
    got = {(r.row, r.col): r.z for r in vector.filled(g, "z", 2.0).collect()}
    full = [(i // 20, i % 20) for i in range(400) if i % 7 < 3]
    assert got == {(i // 20, i % 20): float((lambda c: c[1] * 20 + c[2])(min((math.hypot(i // 20 - r, i % 20 - c), r, c) for r, c in full))) for i in range(400)}
    assert not any("Broadcast" in plan for _, plan in frames)
    assert any("SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan for _, plan in frames)


def test_components_link_runs_and_a_field_is_worked_out_once(spark, monkeypatch):
    handed = []
    keep = graph.components
    monkeypatch.setattr(graph, "components", lambda nodes, edges: handed.append((nodes.count(), dict(nodes.dtypes)["node"])) or keep(nodes, edges))
    cells = {(r, c) for r in range(-3, 9) for c in range(-20, 20) if (r * 7 + c * c) % 5 < 2 or c % 13 == 0}
    got = {(x.row, x.col): x.label for x in graph.labelled_cells(spark.createDataFrame(sorted(cells), "row int, col int")).collect()}
    want, n = {}, 0
    for first in sorted(cells):
        if first not in want:
            n, todo = n + 1, [first]
            while todo:
                r, c = todo.pop()
                if (r, c) in cells and (r, c) not in want:
                    want[r, c] = n
                    todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert got == want
    assert handed == [(sum((r, c - 1) not in cells for r, c in cells), "bigint")]
