"""Vector features on the grid: vertices, distances, shares and assignment."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Grid, to_l93
from ..session import checkpointed

#: Distance where there is no feature at all.
NO_FEATURE = 1e9
DENSIFY_STEP = 60.0


def projected(vertices: DataFrame) -> DataFrame:
    """fid, seq, x, y from fid, seq, lon, lat."""
    x, y = to_l93(F.col("lon"), F.col("lat"))
    return vertices.select("fid", "seq", x.alias("x"), y.alias("y"))


def densified(vertices: DataFrame, step: float = DENSIFY_STEP, keep: list[str] | None = None) -> DataFrame:
    """keep, fid, seq, part, x, y: segments longer than step get floor(length / step) inner points."""
    w = Window.partitionBy("fid").orderBy("seq")
    seg = vertices.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    d = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    k = F.when(d > step, F.floor(d / step)).otherwise(F.lit(0)).cast("int")
    seg = seg.withColumn("k", F.coalesce(k, F.lit(0))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k"))))
    at = F.col("part") / (F.col("k") + 1)
    between = lambda a, b: F.when(F.col("part") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * at)
    return seg.select(*(keep or []), "fid", "seq", "part", between("x", "nx").alias("x"), between("y", "ny").alias("y"))


def shoelace(vertices: DataFrame) -> DataFrame:
    """fid, area of each ring (closed or not)."""
    w = Window.partitionBy("fid").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    cross = vertices.select("fid", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("c"))
    return cross.groupBy("fid").agg((F.abs(F.sum("c")) / 2).alias("area"))


def shoelace_array(ring: Column) -> Column:
    """Area of a ring given as an array of structs x, y."""
    n = F.size(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, ((i + 1) % n) + 1)["y"] - F.element_at(ring, ((i + 1) % n) + 1)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def rasterized(rings: DataFrame, grid: Grid, ss: int = 4, keys: list[str] | None = None) -> DataFrame:
    """keys, row, col, share: part of each cell that the rings (fid, seq, x, y) cover, on ss × ss sub-cells.

    Scan lines: each edge meets the centres of sub-rows it spans; crossings of a ring and sub-row pair up
    to spans; spans cover the sub-cells whose centre they hold. Rings overlap without counting twice.
    Rings of fewer than three vertices, and what lies off the grid, add nothing.
    """
    keys = keys or []
    step, n = grid.cell / ss, grid.n * ss
    w = Window.partitionBy("fid").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    e = rings.withColumn("m", F.count("*").over(Window.partitionBy("fid"))).withColumn("x2", nxt("x")).withColumn("y2", nxt("y")).where("m >= 3 and y <> y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    first = F.greatest(F.lit(0), F.ceil((low - grid.y0) / step - 0.5)).cast("int")
    last = F.least(F.lit(n - 1), F.ceil((high - grid.y0) / step - 0.5) - 1).cast("int")
    e = e.withColumn("a", first).withColumn("b", last).where("a <= b").withColumn("sub", F.explode(F.sequence("a", "b")))
    yc = F.lit(grid.y0) + (F.col("sub") + 0.5) * step
    crossing = e.select(*keys, "fid", "sub", (F.col("x") + (yc - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))).alias("cx"))
    order = Window.partitionBy("fid", "sub").orderBy("cx")
    spans = crossing.withColumn("i", F.row_number().over(order)).withColumn("to", F.lead("cx").over(order)).where("i % 2 = 1 and to is not null")
    a = F.greatest(F.lit(0), F.ceil((F.col("cx") - grid.x0) / step - 0.5)).cast("int")
    b = F.least(F.lit(n - 1), F.ceil((F.col("to") - grid.x0) / step - 0.5) - 1).cast("int")
    cells = spans.withColumn("a", a).withColumn("b", b).where("a <= b").select(*keys, "sub", F.explode(F.sequence("a", "b")).alias("sc")).distinct()
    return cells.groupBy(*keys, F.floor(F.col("sub") / ss).cast("int").alias("row"), F.floor(F.col("sc") / ss).cast("int").alias("col")).agg((F.count("*") / (ss * ss)).alias("share"))


#: Rows of a task that joins buckets, and points that a target's own bucket holds at first, on average.
DEALT, MET = 250_000, 8


def _dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df in partitions by its number of rows: an explicit number is not coalesced for the few bytes there are before a join."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sc.defaultParallelism, -(-rows // DEALT)), *by)


def _first_width(places: DataFrame, pts: DataFrame, width: float, most: int = 16) -> float:
    """width, or a quarter of it again and again, so that the buckets of the targets hold MET points on average at most."""
    for _ in range(most):
        met = places.groupBy(_here("x", width).alias("bx"), _here("y", width).alias("by")).agg(F.count("*").alias("t"))
        of = pts.groupBy(_here("px", width).alias("bx"), _here("py", width).alias("by")).agg(F.count("*").alias("p"))
        mean = met.join(of.hint("merge"), ["bx", "by"]).agg(F.sum(F.col("t") * F.col("p").cast("double")) / F.sum("t")).first()[0]
        if mean is None or mean <= MET:
            break
        width /= 4
    return width


def nearest(targets: DataFrame, points: DataFrame, keys: list[str], bucket: float, carry: str | None = None, levels: int = 28) -> DataFrame:
    """keys, dist (and the nearest point's carry, the least of equals) of each target x, y; exact.

    Targets and points meet in buckets: a target looks at its bucket and the eight around it, which
    hold every point within one bucket's width. Targets that find none so near go on with buckets
    four times as wide. ``bucket`` is the widest that the first may be: where points lie denser they are narrower,
    so that points of a bucket are few at first, and targets are few at last. Targets of one place
    search once, and points of one place are one. Both sides are dealt by the number of their rows.
    """
    every = checkpointed(targets.select(*keys, "x", "y"))
    pts = checkpointed(points.select(F.col("x").alias("px"), F.col("y").alias("py"), *([F.col(carry).alias("__carry")] if carry else [])))
    n_targets, n_pts = every.count(), pts.count()
    if not n_pts:
        return targets.select(*keys, F.lit(NO_FEATURE).alias("dist"), *([F.lit(None).cast(points.schema[carry].dataType).alias(carry)] if carry else []))
    every, pts = _dealt(every, n_targets, "x", "y"), _dealt(pts, n_pts, "px", "py")
    pts = checkpointed(pts.groupBy("px", "py").agg(F.min("__carry").alias("__carry")) if carry else pts.distinct())
    rest, done = checkpointed(every.select("x", "y").distinct()), []
    best = F.min(F.struct("d", "__carry") if carry else F.col("d"))
    width = _first_width(rest, pts, float(bucket))
    near3 = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for _ in range(levels):
        rows = 9 * rest.count() + n_pts
        t = rest.withColumn("bx", F.explode(F.transform(near3, lambda o: F.floor(F.col("x") / width) + o))).withColumn("by", F.explode(F.transform(near3, lambda o: F.floor(F.col("y") / width) + o)))
        p = pts.withColumn("bx", F.floor(F.col("px") / width)).withColumn("by", F.floor(F.col("py") / width))
        met = _dealt(t, rows, "bx", "by").hint("merge").join(_dealt(p, rows, "bx", "by"), ["bx", "by"])
        met = met.withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("d") <= width)
        found = checkpointed(met.groupBy("x", "y").agg(best.alias("b")))
        done.append(found)
        rest = checkpointed(rest.join(found.hint("merge"), ["x", "y"], "left_anti"))
        if rest.isEmpty():
            break
        width *= 4
    else:
        raise ValueError(f"some target lies further than {width / 4} from every point")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    got = every.distinct().join(out.hint("merge"), ["x", "y"])
    return got.select(*keys, *([F.col("b.d").alias("dist"), F.col("b.__carry").alias(carry)] if carry else [F.col("b").alias("dist")]))


#: Boxes along a bucket's side, when far targets look for their nearest points.
BOXES = 8


def nearest_of_classes(targets: DataFrame, points: DataFrame, keys: list[str], classes: list[str], bucket: float, levels: int = 10) -> DataFrame:
    """targets with, for each class, the distance to its nearest point (cls, x, y); NO_FEATURE where the class has none. Exact.

    One search for all classes. Near points are found in one join on buckets, for every class at once:
    points go to their bucket and the eight around it, targets only to their own. What a target has not found
    within a bucket's width it looks for in buckets four times as wide, under (class, bucket), but there
    it first meets boxes of an eighth of the width, each with one of its points: the nearest of those bounds
    the distance, and only boxes that come nearer than the bound hand out their points. So far targets
    meet a bounded number of boxes and few points, however many points a wide bucket holds.
    """
    pts = checkpointed(points.where(F.col("cls").isin(classes)).select("cls", F.col("x").alias("px"), F.col("y").alias("py")).distinct())
    known = {r["cls"] for r in pts.select("cls").distinct().collect()}  # at most one row a class
    width = float(bucket)
    near = pts.withColumn("bx", _around("px", width)).withColumn("by", _around("py", width))
    own = targets.select(*keys, "x", "y").withColumn("bx", _here("x", width)).withColumn("by", _here("y", width))
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    found = own.join(near, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= width).groupBy(*keys).agg(*[F.min(F.when(F.col("cls") == c, F.col("d"))).alias(f"dist_{c}") for c in classes])
    first = checkpointed(targets.select(*keys, "x", "y").join(found, keys, "left"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"dist_{c}").isNull(), c) for c in classes if c in known])) if known else F.array().cast("array<string>")
    rest, far = checkpointed(first.select(*keys, "x", "y", F.explode(missing).alias("cls"))), []
    for _ in range(levels):
        if rest.isEmpty():
            break
        width *= 4
        rest, got = _nearest_by_boxes(rest, pts, keys, width, d)
        far.append(got)
    else:
        if not rest.isEmpty():
            raise ValueError(f"some target lies further than {width} from every point of a class")
    out = first.select(*keys, *[f"dist_{c}" for c in classes])
    if far:
        later = far[0]
        for f in far[1:]:
            later = later.unionByName(f)
        wide = later.groupBy(*keys).agg(*[F.min(F.when(F.col("cls") == c, F.col("d"))).alias(f"__{c}") for c in classes])
        out = out.join(wide, keys, "left").select(*keys, *[F.coalesce(f"dist_{c}", f"__{c}").alias(f"dist_{c}") for c in classes])
    return targets.join(out.fillna(NO_FEATURE, [f"dist_{c}" for c in classes]), keys)


def _here(name: str, width: float) -> Column:
    return F.floor(F.col(name) / width).cast("long")


def _around(name: str, width: float) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: _here(name, width) + o))


def _nearest_by_boxes(rest: DataFrame, pts: DataFrame, keys: list[str], width: float, best: Column) -> tuple[DataFrame, DataFrame]:
    """(what is left, keys with cls and d: the least ``best`` of the points within width) of targets (keys, x, y, cls)."""
    side = width / BOXES
    boxes = pts.withColumn("sx", _here("px", side)).withColumn("sy", _here("py", side)).groupBy("cls", "sx", "sy").agg(F.min(F.struct("px", "py")).alias("p"))
    boxes = boxes.withColumn("px", (F.col("sx") + 0.5) * side).withColumn("py", (F.col("sy") + 0.5) * side)
    # A bucket's list: the boxes in it and around it, at most 9 * BOXES * BOXES.
    lists = boxes.withColumn("bx", _around("px", width)).withColumn("by", _around("py", width)).groupBy("cls", "bx", "by").agg(F.collect_list(F.struct("sx", "sy", "p")).alias("boxes"))
    met = rest.withColumn("bx", _here("x", width)).withColumn("by", _here("y", width)).join(lists, ["cls", "bx", "by"])
    gap = lambda v, low: F.greatest(F.lit(0.0), low - v, v - (low + side))
    bound = F.array_min(F.transform("boxes", lambda b: F.hypot(F.col("x") - b["p"]["px"], F.col("y") - b["p"]["py"])))
    # A little more than the bound: a box whose edge holds the point must not be lost to rounding.
    close = F.filter("boxes", lambda b: F.hypot(gap(F.col("x"), b["sx"] * side), gap(F.col("y"), b["sy"] * side)) <= F.col("bound") * (1 + 1e-12) + 1e-9)
    asked = met.withColumn("bound", bound).select(*keys, "x", "y", "cls", F.explode(close).alias("b")).select(*keys, "x", "y", "cls", F.col("b.sx").alias("sx"), F.col("b.sy").alias("sy"))
    inside = pts.withColumn("sx", _here("px", side)).withColumn("sy", _here("py", side))
    within = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= width
    got = checkpointed(asked.join(inside, ["cls", "sx", "sy"]).where(within).groupBy(*keys, "cls").agg(F.min(best).alias("d")))
    return checkpointed(rest.join(got.select(*keys, "cls"), [*keys, "cls"], "left_anti")), got


def nearest_of_group(targets: DataFrame, points: DataFrame, keys: list[str], bucket: float, best: Column, levels: int = 16) -> DataFrame:
    """keys, cls, d of targets (keys, x, y, cls): the least ``best`` of the points (cls, x, y, others) of the target's own group.

    best is a column of x, y, px, py and the points' further columns that grows with the distance: a
    struct that starts with it breaks ties. Groups may be of any size; targets of groups without points are left out.
    """
    pts = checkpointed(points.withColumnsRenamed({"x": "px", "y": "py"}))
    rest, width, found = checkpointed(targets.select(*keys, "x", "y", "cls").join(pts.select("cls").distinct(), "cls", "left_semi")), float(bucket), []
    for _ in range(levels):
        rest, got = _nearest_by_boxes(rest, pts, keys, width, best)
        found.append(got)
        if rest.isEmpty():
            break
        width *= 4
    else:
        raise ValueError(f"some target lies further than {width / 4} from every point of its group")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def polygon_distance(cells: DataFrame, share: str, dist: str) -> Column:
    """0 inside a polygon (share over a half), else the distance to its contour."""
    return F.when(F.col(share) > 0.5, 0.0).otherwise(F.col(dist))


def filled(cells: DataFrame, value: str, bucket: float = 4.0) -> DataFrame:
    """cells with nulls of value taken from the nearest cell that has one; the least row and column of equals."""
    empty = cells.where(F.col(value).isNull()).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    valid = cells.where(F.col(value).isNotNull()).select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.struct(F.col("row"), F.col("col"), F.col(value).alias("v")).alias("cell"))
    fill = nearest(empty, valid, ["row", "col"], bucket, "cell").select("row", "col", F.col("cell.v").alias("__fill"))
    return cells.join(fill, ["row", "col"], "left").withColumn(value, F.coalesce(value, "__fill")).drop("__fill")


def first_ring(cells: DataFrame, rings: DataFrame, grid: Grid) -> DataFrame:
    """row, col, idx: the first area (least idx) whose ring covers the cell's centre. rings: idx, fid, seq, x, y."""
    return rasterized(rings, grid, 1, ["idx"]).groupBy("row", "col").agg(F.min("idx").alias("idx"))


def assigned(cells: DataFrame, rings: DataFrame, centres: DataFrame, grid: Grid, bucket: float = 5000.0) -> DataFrame:
    """cells with idx: the area that covers them, else (inside the circle) the area of the nearest centre."""
    covered = cells.join(first_ring(cells, rings, grid), ["row", "col"], "left")
    left = covered.where(F.col("idx").isNull() & F.col("inside"))
    near = nearest(left, centres.select("x", "y", "idx"), ["row", "col"], bucket, "idx").select("row", "col", F.col("idx").alias("__near"))
    return covered.join(near, ["row", "col"], "left").withColumn("idx", F.coalesce("idx", "__near")).drop("__near")


def point_of(node: Column, ring: Column, bounds: Column) -> Column:
    """Struct lat, lon of a feature: its own position, else the mean of its vertices, else the middle of its bounds."""
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k]), F.lit(0.0), lambda a, v: a + v) / F.size(ring)
    of_ring = F.when(F.size(ring) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))
    middle = F.when(bounds.isNotNull(), F.struct(((bounds["minlat"] + bounds["maxlat"]) / 2).alias("lat"), ((bounds["minlon"] + bounds["maxlon"]) / 2).alias("lon")))
    return F.coalesce(node, of_ring, middle)


def joined_ways(lines: list[np.ndarray], atol: float, rtol: float) -> list[np.ndarray]:
    """Rings of ways joined end to end: a ring takes the first way left that meets one of its ends, until it closes or none does.

    Ends are filed in a grid as wide as the tolerance, so a joint is a lookup among few ends whatever the number of ways.
    """
    ends = np.array([[w[0], w[-1]] for w in lines])
    slack = atol + rtol * np.abs(ends).max(axis=(0, 1))
    meets = lambda a, b: bool((np.abs(a - b) <= atol + rtol * np.abs(b)).all())
    filed, cells = defaultdict(list), np.floor(ends / slack).astype(np.int64)
    for i, own in enumerate(cells.tolist()):
        for x, y in dict.fromkeys(map(tuple, own)):
            filed[x, y].append(i)
    left = [True] * len(lines)

    def beside(point: np.ndarray) -> list[int]:
        x, y = np.floor(point / slack).astype(np.int64).tolist()
        found = []
        for key in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if key in filed:
                filed[key] = [i for i in filed[key] if left[i]]
                found += filed[key]
        return found

    rings = []
    for first in range(len(lines)):
        if not left[first]:
            continue
        left[first] = False
        parts, head, tail = deque([lines[first]]), lines[first][0], lines[first][-1]
        while not meets(head, tail):
            for i in sorted({*beside(head), *beside(tail)}):
                a, b = ends[i]
                if meets(tail, a):
                    parts.append(lines[i][1:])
                    tail = b
                elif meets(tail, b):
                    parts.append(lines[i][::-1][1:])
                    tail = a
                elif meets(head, b):
                    parts.appendleft(lines[i][:-1])
                    head = a
                elif meets(head, a):
                    parts.appendleft(lines[i][::-1][:-1])
                    head = b
                else:
                    continue
                left[i] = False
                break
            else:
                break
        ring = np.vstack(parts)
        if len(ring) >= 3:
            rings.append(ring)
    return rings


def assembled_rings(pieces: DataFrame, atol: float = 0.5, rtol: float = 1e-5) -> DataFrame:
    """relation, fid, seq, x, y: closed rings from a relation's outer ways (relation, way, seq, x, y).

    Ways are joined end to end, in either direction, while ends lie within atol + rtol times the coordinate; a ring has at least
    three vertices; inner rings are not subtracted. One relation is one group; its work is linear in its ways.
    """

    def assemble(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["way", "seq"])
        at = g[["x", "y"]].to_numpy(dtype=float)
        rings = joined_ways(np.split(at, np.flatnonzero(np.diff(g["way"].to_numpy())) + 1), atol, rtol)
        out = [pd.DataFrame({"relation": key[0], "fid": f"{key[0]}/{n}", "seq": range(len(r)), "x": r[:, 0], "y": r[:, 1]}) for n, r in enumerate(rings)]
        return pd.concat(out) if out else pd.DataFrame({"relation": [], "fid": [], "seq": [], "x": [], "y": []})

    return pieces.groupBy("relation").applyInPandas(assemble, "relation long, fid string, seq int, x double, y double")


def scattered(points: DataFrame, grid: Grid, cells: DataFrame, fields: list[str]) -> DataFrame:
    """cells with the sum of each field over the points (x, y) of the cell; no point, and null, is 0."""
    row, col = grid.bin(F.col("x"), F.col("y"))
    sums = points.withColumn("row", row).withColumn("col", col).where("row is not null and col is not null").groupBy("row", "col").agg(*[F.sum(F.coalesce(F.col(f), F.lit(0)).cast("double")).alias(f) for f in fields])
    return cells.join(sums, ["row", "col"], "left").fillna(0.0, fields)


def bilinear(field: DataFrame, value: str, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys and value at fractional pixels fr, fc of targets; null unless all four neighbours have a value."""
    fr, fc = F.floor("fr").cast("int"), F.floor("fc").cast("int")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = targets.select(*keys, (F.col("fr") - fr).alias("__u"), (F.col("fc") - fc).alias("__v"), fr.alias("__r"), fc.alias("__c"), corner.alias("__k"))
    t = t.withColumn("row", F.col("__r") + F.col("__k.i")).withColumn("col", F.col("__c") + F.col("__k.j"))
    weight = F.when(F.col("__k.i") == 1, F.col("__u")).otherwise(1 - F.col("__u")) * F.when(F.col("__k.j") == 1, F.col("__v")).otherwise(1 - F.col("__v"))
    got = t.join(field.select("row", "col", value), ["row", "col"]).where(F.col(value).isNotNull())
    return got.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias(value), F.count("*").alias("__n")).where("__n = 4").drop("__n")


def to_mercator_pixels(grid: Grid, field: DataFrame, value: str, bounds: tuple[float, float, float, float], width: int, height: int, from_merc: Callable) -> DataFrame:
    """px, py, value: the field resampled bilinearly on a Web Mercator image (py 0 is north)."""
    spark, (ax, ay, bx, by) = field.sparkSession, bounds
    ids = spark.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    lon, lat = from_merc(F.lit(ax) + (F.col("px") + 0.5) * ((bx - ax) / width), F.lit(by) - (F.col("py") + 0.5) * ((by - ay) / height))
    at = ids.withColumn("lon", lon).withColumn("lat", lat)
    x, y = to_l93(F.col("lon"), F.col("lat"))
    fr, fc = grid.fractional(F.col("x"), F.col("y"))
    at = at.withColumn("x", x).withColumn("y", y).where(F.hypot(F.col("x") - grid.cx, F.col("y") - grid.cy) <= grid.radius).withColumn("fr", fr).withColumn("fc", fc)
    return ids.join(bilinear(field, value, at, ["px", "py"]), ["px", "py"], "left")


