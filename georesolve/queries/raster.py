"""Queries of scoring, grid, focal, vector and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..operators import focal, graph, layers, vector, zones
from .base import CELLS, METRICS, cells, metrics, query, rc, table

RULE_KEYS = ["dist_motorway_min_m", "slope_max_pct", "elev_min_m", "farm_share_800m_max", "rel_elev_2km_min_m", "pop_2km_min", "income_1km_min_eur"]
SCORING = scoring.Scoring()


def _p(value: str, direction: str, thr: float, margin: float) -> str:
    raw = f"({value} - {thr - margin}::DOUBLE) / {margin}::DOUBLE" if direction == "min" else f"({thr + margin}::DOUBLE - {value}) / {margin}::DOUBLE"
    return f"coalesce(CASE WHEN {value} IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {raw})) END, 0.6::DOUBLE)"


_RULES = [r for r in scoring.RULES if r.key in RULE_KEYS]
_PREFS = [r for r in _RULES if r.kind == "pref"]
_W = sum(r.weight for r in _PREFS)
_MEMBERS = ", ".join(f"{_p(r.metric, r.direction, r.threshold, r.margin)} AS p_{r.key}" for r in _RULES)
_VETO = "least(" + ", ".join(f"p_{r.key}" for r in _RULES if r.kind == "veto") + ")"
_PREF = "exp(" + " + ".join(f"{r.weight / _W}::DOUBLE * ln(0.08::DOUBLE + 0.92::DOUBLE * p_{r.key})" for r in _PREFS) + ")"
_ALL = "least(" + ", ".join(f"p_{r.key}" for r in _RULES) + ")"


def _first(rules) -> str:
    low = "least(" + ", ".join(f"p_{r.key}" for r in rules) + ")"
    return "CASE " + " ".join(f"WHEN p_{r.key} = {low} THEN {scoring.RULES.index(r)}" for r in rules) + " END"


_SOFT = [c for c in scoring.CRITERIA if c.metric in ("dist_motorway", "income_1km", "farm_share_800m")]
_ATTRACT = " + ".join(f"{c.weight}::DOUBLE * coalesce(CASE WHEN {c.metric} IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({c.metric} - {c.bad}::DOUBLE) / {c.good - c.bad}::DOUBLE)) END, 0.35::DOUBLE)" for c in _SOFT)
SCORED = f"""{METRICS}, s AS (SELECT m.*, {_MEMBERS} FROM m), f AS (SELECT s.*, {_VETO} AS veto, {_PREF} AS pref, ({_ATTRACT}) AS attract FROM s),
  sc AS (SELECT f.*, veto * pref AS feasibility, CASE WHEN {_ALL} >= 0.995 THEN 250 WHEN veto < 0.75 THEN {_first([r for r in _RULES if r.kind == "veto"])} ELSE {_first(_RULES)} END AS limiting FROM f)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.feasibility(metrics(spark, d), SCORING)
    return s.withColumn("attract", scoring.attractiveness(s, SCORING))


@query("veto_pref_score", f"WITH {SCORED} SELECT key, round(veto, 6) AS veto, round(pref, 6) AS pref, round(feasibility, 6) AS feasibility, limiting, round(attract, 6) AS attract FROM sc")
def veto_pref_score(spark, d):
    return scored(spark, d).select("key", *[F.round(c, 6).alias(c) for c in ("veto", "pref", "feasibility")], "limiting", F.round("attract", 6).alias("attract"))


@query("fuzzy_membership", f"WITH {METRICS} SELECT key, round({_p('dist_motorway', 'min', 800, 350)}, 6) AS p_min, round({_p('slope_pct', 'max', 25, 8)}, 6) AS p_max, CASE WHEN {_p('slope_pct', 'max', 25, 8)} >= 0.999 THEN 'ok' WHEN {_p('slope_pct', 'max', 25, 8)} >= 0.5 THEN 'nearly' WHEN {_p('slope_pct', 'max', 25, 8)} > 0 THEN 'weak' ELSE 'no' END AS verdict FROM m")
def fuzzy_membership(spark, d):
    p = scoring.membership(F.col("slope_pct"), "max", 25, 8)
    return metrics(spark, d).select("key", F.round(scoring.membership(F.col("dist_motorway"), "min", 800, 350), 6).alias("p_min"), F.round(p, 6).alias("p_max"), scoring.verdict(p).alias("verdict"))


@query("rule_stats", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{r.key}' AS key, count(*) FILTER (WHERE inside AND p_{r.key} <= 0.001) AS killed, count(*) FILTER (WHERE inside AND p_{r.key} < 1) AS touched FROM sc" for r in _RULES))
def rule_stats(spark, d):
    return scoring.rule_stats(scored(spark, d), SCORING)


_SHARES = " UNION ALL ".join(f"SELECT {i} AS i, '{r.kind}' AS kind, '{r.key}' AS key, {float(r.threshold)}::DOUBLE AS threshold, {float(r.margin)}::DOUBLE AS margin, count(*) FILTER (WHERE inside AND p_{r.key} <= 0.001) AS killed, count(*) FILTER (WHERE inside AND p_{r.key} < 1) AS touched, count(*) FILTER (WHERE inside) AS n FROM sc" for i, r in enumerate(_RULES))


@query("rule_report", f"WITH {SCORED}, sh AS ({_SHARES}) SELECT CAST(row_number() OVER (ORDER BY kind <> 'veto', killed DESC, i) AS INT) AS rank, kind, key, threshold, margin, round(killed * 100.0::DOUBLE / n, 4) AS killed_pct, round(touched * 100.0::DOUBLE / n, 4) AS touched_pct FROM sh")
def rule_report(spark, d):
    r = scoring.rule_report(scored(spark, d), SCORING)
    return r.select("rank", "kind", "key", "threshold", "margin", F.round("killed_pct", 4).alias("killed_pct"), F.round("touched_pct", 4).alias("touched_pct"))


@query("explain_point", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT key, '{r.key}' AS rule, {r.metric} AS value, {float(r.threshold)}::DOUBLE AS threshold, round(p_{r.key}, 6) AS membership FROM sc" for r in _RULES))
def explain_point(spark, d):
    return scoring.explained(scored(spark, d), SCORING, ["key"]).select("key", "rule", "value", "threshold", F.round("membership", 6).alias("membership"))


@query("explain_area", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{r.key}' AS rule, median({r.metric}) AS median, {'max' if r.direction == 'min' else 'min'}({r.metric}) AS best, round(avg(p_{r.key}), 6) AS membership FROM sc" for r in _RULES))
def explain_area(spark, d):
    return scoring.explained_area(scored(spark, d), SCORING).select("rule", "median", "best", F.round("membership", 6).alias("membership"))


# -- grid and projection ---------------------------------------------------------------------------

GRID = geo.Grid(5000.0, 5000.0, 4900.0, 200.0)


@query("grid_build", f"""SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, {GRID.x0}::DOUBLE + (c + 0.5) * 200 AS x, {GRID.y0}::DOUBLE + (r + 0.5) * 200 AS y,
  sqrt(({GRID.x0} + (c + 0.5) * 200 - 5000) ** 2 + ({GRID.y0} + (r + 0.5) * 200 - 5000) ** 2) <= 4900 AS inside FROM range({GRID.n}) a(r), range({GRID.n}) b(c)""")
def grid_build(spark, d):
    return rc(GRID.cells(spark), "x", "y", "inside")


_LON, _LAT = "4.0::DOUBLE + (c_custkey % 400) / 200.0::DOUBLE", "45.5::DOUBLE + (c_custkey % 370) / 200.0::DOUBLE"
_TT = f"tan(pi() / 4 - radians({_LAT}) / 2) / pow((1 - {geo._E} * sin(radians({_LAT}))) / (1 + {geo._E} * sin(radians({_LAT}))), {geo._E / 2})"
_RR = f"({geo._A * geo._F!r}::DOUBLE * pow({_TT}, {geo._N!r}::DOUBLE))"
_TH = f"({geo._N!r}::DOUBLE * (radians({_LON}) - {geo._LON0!r}::DOUBLE))"


@query("lambert93", f"SELECT c_custkey, round(700000 + {_RR} * sin({_TH}), 3) AS x, round({geo._Y0 + geo._R0!r}::DOUBLE - {_RR} * cos({_TH}), 3) AS y, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM customer")
def lambert93(spark, d):
    """Forward, then back again: the inverse must give the degrees that went in."""
    c = table(spark, d, "customer").select("c_custkey", (4.0 + (F.col("c_custkey") % 400) / 200.0).alias("lon"), (45.5 + (F.col("c_custkey") % 370) / 200.0).alias("lat"))
    x, y = geo.to_l93(F.col("lon"), F.col("lat"))
    p = c.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_wgs(F.col("x"), F.col("y"))
    return p.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), ((k * 71) % 10400 - 200).cast("double").alias("x"), ((k * 53) % 10400 - 200).cast("double").alias("y"), F.col("c_nationkey").alias("n"))


POINTS = "p AS (SELECT c_custkey AS key, CAST((c_custkey * 71) % 10400 - 200 AS DOUBLE) AS x, CAST((c_custkey * 53) % 10400 - 200 AS DOUBLE) AS y, c_nationkey AS n FROM customer)"
_BIN = f"CAST(floor((y - {GRID.y0}) / 200) AS INT) AS r, CAST(floor((x - {GRID.x0}) / 200) AS INT) AS c"


@query("point_bin", f"WITH {POINTS}, b AS (SELECT key, {_BIN} FROM p) SELECT key, CASE WHEN ok THEN r END AS r, CASE WHEN ok THEN c END AS c FROM (SELECT *, r BETWEEN 0 AND {GRID.n - 1} AND c BETWEEN 0 AND {GRID.n - 1} AS ok FROM b)")
def point_bin(spark, d):
    row, col = GRID.bin(F.col("x"), F.col("y"))
    return points(spark, d).select("key", row.alias("r"), col.alias("c"))


@query("mercator", f"WITH q AS (SELECT c_custkey, {_LON} AS lon, {_LAT} AS lat FROM customer) SELECT c_custkey, round(radians(lon) * 6378137.0::DOUBLE, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE, 3) AS my FROM q")
def mercator(spark, d):
    x, y = geo.mercator(4.0 + (F.col("c_custkey") % 400) / 200.0, 45.5 + (F.col("c_custkey") % 370) / 200.0)
    return table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query("quantise", f"WITH {METRICS} SELECT key, CASE WHEN elev IS NULL THEN 0 ELSE CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (elev - 160.0::DOUBLE) / 80.0::DOUBLE * 254 + 1))) AS INT) END AS q, CASE WHEN slope_pct IS NULL THEN 255 ELSE least(254, CAST(slope_pct AS INT)) END AS qi FROM m")
def quantise(spark, d):
    return metrics(spark, d).select("key", geo.quantized(F.col("elev"), 160, 240).alias("q"), geo.quantized_int(F.col("slope_pct")).alias("qi"))


def _channel(k: int, name: str) -> str:
    steps = " ".join(f"WHEN v <= {b}::DOUBLE THEN {ca[k]} + (v - {a}::DOUBLE) / {b - a!r}::DOUBLE * {cb[k] - ca[k]}" for (a, ca), (b, cb) in zip(geo.RAMP, geo.RAMP[1:], strict=False))
    return f"CAST(round_even(CASE {steps} END, 0) AS INT) AS {name}"


@query("colour_ramp", f"WITH {METRICS}, v AS (SELECT key, least(1.0::DOUBLE, greatest(0.0::DOUBLE, elev / 300)) AS v FROM m) SELECT key, " + ", ".join(_channel(k, n) for k, n in enumerate("rgb")) + " FROM (SELECT m.key, CASE WHEN m.elev IS NOT NULL THEN v.v END AS v FROM m JOIN v USING (key))")
def colour_ramp(spark, d):
    return metrics(spark, d).select("key", geo.ramp_color(F.col("elev") / 300).alias("rgb")).select("key", "rgb.r", "rgb.g", "rgb.b")


# -- focal -----------------------------------------------------------------------------------------

_CLAMP = f"{CELLS}, e AS (SELECT max(r) AS r1, max(c) AS c1 FROM g), o AS (SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc FROM range(-3, 4) x(a), range(-3, 4) y(b))"


@query("box_mean", f"WITH {_CLAMP} SELECT g.r, g.c, round(avg(h.z), 4) AS m FROM g, e, o JOIN g h ON h.r = least(greatest(g.r + o.dr, 0), e.r1) AND h.c = least(greatest(g.c + o.dc, 0), e.c1) GROUP BY g.r, g.c")
def box_mean(spark, d):
    return rc(focal.box_mean(cells(spark, d), "z", 3, "m"), F.round("m", 4).alias("m"))


@query("box_min", f"WITH {_CLAMP} SELECT g.r, g.c, min(h.z) AS m FROM g, o JOIN g h ON h.r = g.r + o.dr AND h.c = g.c + o.dc GROUP BY g.r, g.c")
def box_min(spark, d):
    return rc(focal.box_min(cells(spark, d), "z", 3, "m"), "m")


@query("box_max", f"WITH {_CLAMP} SELECT g.r, g.c, max(h.z) AS m FROM g, o JOIN g h ON h.r = g.r + o.dr AND h.c = g.c + o.dc GROUP BY g.r, g.c")
def box_max(spark, d):
    return rc(focal.box_max(cells(spark, d), "z", 3, "m"), "m")


@query("tpi", f"WITH {_CLAMP} SELECT g.r, g.c, round(any_value(g.z) - avg(h.z), 4) AS tpi, any_value(g.z) - min(h.z) AS rel_elev FROM g, e, o JOIN g h ON h.r = least(greatest(g.r + o.dr, 0), e.r1) AND h.c = least(greatest(g.c + o.dc, 0), e.c1) GROUP BY g.r, g.c")
def tpi(spark, d):
    g = focal.box_min(focal.box_mean(cells(spark, d), "z", 3, "mean"), "z", 3, "low")
    return rc(g, F.round(F.col("z") - F.col("mean"), 4).alias("tpi"), (F.col("z") - F.col("low")).alias("rel_elev"))


@query("disk_sum", f"WITH {_CLAMP} SELECT g.r, g.c, sum(h.z) AS s FROM g, o JOIN g h ON h.r = g.r + o.dr AND h.c = g.c + o.dc WHERE o.dr * o.dr + o.dc * o.dc <= 9 GROUP BY g.r, g.c")
def disk_sum(spark, d):
    return rc(focal.disk_sum(cells(spark, d), "z", 3, "s"), "s")


@query("disk_mean", f"WITH {_CLAMP} SELECT g.r, g.c, round(avg(h.z), 4) AS m FROM g, e, o JOIN g h ON h.r = least(greatest(g.r + o.dr, 0), e.r1) AND h.c = least(greatest(g.c + o.dc, 0), e.c1) WHERE o.dr * o.dr + o.dc * o.dc <= 9 GROUP BY g.r, g.c")
def disk_mean(spark, d):
    return rc(focal.disk_mean(cells(spark, d), "z", 3, "m"), F.round("m", 4).alias("m"))


_SLOPES = """n AS (SELECT r, c, z, lag(z) OVER h AS w, lead(z) OVER h AS e, lag(z) OVER v AS s, lead(z) OVER v AS n FROM g WINDOW h AS (PARTITION BY r ORDER BY c), v AS (PARTITION BY c ORDER BY r)),
  gr AS (SELECT r, c, CASE WHEN w IS NULL THEN (e - z) / 200.0::DOUBLE WHEN e IS NULL THEN (z - w) / 200.0::DOUBLE ELSE (e - w) / 400.0::DOUBLE END AS gx, CASE WHEN s IS NULL THEN (n - z) / 200.0::DOUBLE WHEN n IS NULL THEN (z - s) / 200.0::DOUBLE ELSE (n - s) / 400.0::DOUBLE END AS gy FROM n)"""
_GRAD = f"{CELLS}, {_SLOPES}"


@query("slope", f"WITH {_GRAD} SELECT r, c, round(sqrt(gx * gx + gy * gy) * 100, 6) AS slope_pct, round(CASE WHEN sqrt(gx * gx + gy * gy) > 1e-6 THEN gy / sqrt(gx * gx + gy * gy) ELSE 0 END, 6) AS southness FROM gr")
def slope(spark, d):
    return rc(focal.slope_and_southness(cells(spark, d), "z", 200.0), F.round("slope_pct", 6).alias("slope_pct"), F.round("southness", 6).alias("southness"))


_CLAMPED = lambda at, by, end: f"least(greatest({at} + {by}, 0), {end})"


@query("terrain_layers", f"""WITH {CELLS}, e AS (SELECT max(r) AS r1, max(c) AS c1 FROM g), o AS (SELECT CAST(d AS INT) AS d FROM range(-25, 26) t(d)),
  h AS (SELECT g.r, g.c, any_value(g.z) AS z, avg(x.z) FILTER (WHERE abs(d) <= 5) AS a1, avg(x.z) FILTER (WHERE abs(d) <= 15) AS a3, min(x.z) FILTER (WHERE abs(d) <= 10) AS l2, min(x.z) AS l5 FROM g, e, o JOIN g x ON x.r = g.r AND x.c = {_CLAMPED("g.c", "d", "e.c1")} GROUP BY g.r, g.c),
  t AS (SELECT h.r, h.c, any_value(h.z) AS elev, avg(x.a1) FILTER (WHERE abs(d) <= 5) AS m1, avg(x.a3) FILTER (WHERE abs(d) <= 15) AS m3, min(x.l2) FILTER (WHERE abs(d) <= 10) AS l2, min(x.l5) AS l5 FROM h, e, o JOIN h x ON x.c = h.c AND x.r = {_CLAMPED("h.r", "d", "e.r1")} GROUP BY h.r, h.c),
  {_SLOPES}, sl AS (SELECT r, c, sqrt(gx * gx + gy * gy) * 100 AS s, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-6 THEN gy / sqrt(gx * gx + gy * gy) ELSE 0 END AS w FROM gr), o2 AS (SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc FROM range(-2, 3) x(a), range(-2, 3) y(b)),
  sm AS (SELECT a.r, a.c, avg(x.s) AS slope_pct, avg(x.w) AS southness FROM sl a, e, o2 JOIN sl x ON x.r = {_CLAMPED("a.r", "dr", "e.r1")} AND x.c = {_CLAMPED("a.c", "dc", "e.c1")} GROUP BY a.r, a.c)
  SELECT r, c, elev, round(elev - m1, 4) AS tpi_1km, round(elev - m3, 4) AS tpi_3km, elev - l2 AS rel_elev_2km, elev - l5 AS rel_elev_5km, round(slope_pct, 4) AS slope_pct, round(southness, 4) AS southness FROM t JOIN sm USING (r, c)""")
def terrain_layers(spark, d):
    rounded = [F.round(c, 4).alias(c) for c in ("tpi_1km", "tpi_3km", "slope_pct", "southness")]
    return rc(focal.terrain(cells(spark, d).select("row", "col", "z"), "z", 200.0, GRID.px), "elev", "rel_elev_2km", "rel_elev_5km", *rounded)


@query("void_fill", f"""WITH {CELLS}, h AS (SELECT r, c, CASE WHEN key % 4 <> 0 THEN z END AS z FROM g),
  f AS (SELECT h.r, h.c, v.z, row_number() OVER (PARTITION BY h.r, h.c ORDER BY sqrt((h.r - v.r) ** 2 + (h.c - v.c) ** 2), v.r, v.c) AS i FROM h JOIN h v ON v.z IS NOT NULL AND abs(v.r - h.r) <= 6 AND abs(v.c - h.c) <= 6 WHERE h.z IS NULL)
  SELECT r, c, z FROM h WHERE z IS NOT NULL UNION ALL SELECT r, c, z FROM f WHERE i = 1""")
def void_fill(spark, d):
    g = cells(spark, d).withColumn("z", F.when(F.col("key") % 4 != 0, F.col("z"))).select("row", "col", "z")
    return rc(vector.filled(g, "z", 2.0), "z")


# -- vector ----------------------------------------------------------------------------------------


def shops(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(((k * 977) % 10000).cast("double").alias("x"), ((k * 613) % 10000).cast("double").alias("y"), k.alias("sid"))


SHOPS = "sh AS (SELECT CAST((s_suppkey * 977) % 10000 AS DOUBLE) AS sx, CAST((s_suppkey * 613) % 10000 AS DOUBLE) AS sy, s_suppkey AS sid FROM supplier)"


@query("nearest_distance", f"WITH {POINTS}, {SHOPS} SELECT key, round(min(sqrt((x - sx) ** 2 + (y - sy) ** 2)), 4) AS dist FROM p, sh GROUP BY key")
def nearest_distance(spark, d):
    return vector.nearest(points(spark, d), shops(spark, d), ["key"], 300.0).select("key", F.round("dist", 4).alias("dist"))


def lines(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(k.alias("fid"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"))
    return n.select("fid", "seq", ((F.col("fid") * 331 + F.col("seq") * 97) % 1000).cast("double").alias("x"), ((F.col("fid") * 177 + F.col("seq") * 59) % 1000).cast("double").alias("y"))


LINES = "ln AS (SELECT n_nationkey AS fid, CAST(s AS INT) AS seq, CAST((n_nationkey * 331 + s * 97) % 1000 AS DOUBLE) AS x, CAST((n_nationkey * 177 + s * 59) % 1000 AS DOUBLE) AS y FROM nation, range(5) t(s))"


@query("densify", f"""WITH {LINES}, s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ln WINDOW w AS (PARTITION BY fid ORDER BY seq)),
  k AS (SELECT *, CASE WHEN nx IS NOT NULL AND sqrt((nx - x) ** 2 + (ny - y) ** 2) > 60 THEN CAST(floor(sqrt((nx - x) ** 2 + (ny - y) ** 2) / 60) AS INT) ELSE 0 END AS k FROM s)
  SELECT fid, seq, CAST(i AS INT) AS part, round(CASE WHEN i = 0 THEN x ELSE x + (nx - x) * (CAST(i AS DOUBLE) / (k + 1)) END, 4) AS x, round(CASE WHEN i = 0 THEN y ELSE y + (ny - y) * (CAST(i AS DOUBLE) / (k + 1)) END, 4) AS y FROM k, range(40) t(i) WHERE i <= k""")
def densify(spark, d):
    return vector.densified(lines(spark, d), 60.0).select("fid", "seq", "part", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("shoelace", f"WITH {LINES}, s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM ln WINDOW w AS (PARTITION BY fid ORDER BY seq)) SELECT fid, abs(sum(x * ny - nx * y)) / 2 AS area FROM s GROUP BY fid")
def shoelace(spark, d):
    return vector.shoelace(lines(spark, d))


def quads(spark, d):
    """Convex quadrilaterals, one per nation, that overlap."""
    k = F.col("n_nationkey")
    corner = F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (900, 130), (770, 1010), (-110, 830))]))
    q = table(spark, d, "nation").select(k.alias("fid"), corner.alias("seq", "p"))
    return q.select(F.col("fid").alias("idx"), "fid", "seq", ((F.col("fid") * 1237) % 9000 + F.col("p.a") + 0.37).alias("x"), ((F.col("fid") * 2311) % 9000 + F.col("p.b") + 0.41).alias("y"))


_QUADS = "q AS (SELECT n_nationkey AS fid, i, CAST((n_nationkey * 1237) % 9000 + ([0, 900, 770, -110])[i + 1] AS DOUBLE) + 0.37::DOUBLE AS x, CAST((n_nationkey * 2311) % 9000 + ([0, 130, 1010, 830])[i + 1] AS DOUBLE) + 0.41::DOUBLE AS y FROM nation, range(4) t(i)), ed AS (SELECT a.fid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM q a JOIN q b ON a.fid = b.fid AND b.i = (a.i + 1) % 4)"


def _inside(ss: int) -> str:
    n, step = GRID.n * ss, GRID.cell / ss
    return f"""{_QUADS}, sub AS (SELECT CAST(sr AS INT) AS sr, CAST(sc AS INT) AS sc, {GRID.y0}::DOUBLE + (sr + 0.5::DOUBLE) * {step}::DOUBLE AS py, {GRID.x0}::DOUBLE + (sc + 0.5::DOUBLE) * {step}::DOUBLE AS px FROM range({n}) a(sr), range({n}) b(sc)),
  hit AS (SELECT sr, sc, fid FROM sub JOIN ed ON (y1 > py) <> (y2 > py) AND x1 + (py - y1) / (y2 - y1) * (x2 - x1) > px GROUP BY sr, sc, fid HAVING count(*) % 2 = 1)"""


@query("rasterize_share", f"WITH {_inside(4)} SELECT sr // 4 AS r, sc // 4 AS c, count(*) / 16.0::DOUBLE AS share FROM (SELECT DISTINCT sr, sc FROM hit) GROUP BY sr // 4, sc // 4")
def rasterize_share(spark, d):
    return rc(vector.rasterized(quads(spark, d), GRID, 4), "share")


@query("commune_index", f"""WITH {_inside(1)}, ce AS (SELECT sr AS r, sc AS c, px AS x, py AS y, sqrt((px - 5000) ** 2 + (py - 5000) ** 2) <= 4900 AS inside FROM sub),
  cov AS (SELECT sr AS r, sc AS c, min(fid) AS idx FROM hit GROUP BY sr, sc), {SHOPS},
  nr AS (SELECT r, c, sid, row_number() OVER (PARTITION BY r, c ORDER BY sqrt((x - sx) ** 2 + (y - sy) ** 2), sid) AS i FROM (SELECT * FROM ce LEFT JOIN cov USING (r, c) WHERE idx IS NULL AND inside), sh)
  SELECT ce.r, ce.c, coalesce(cov.idx, nr.sid) AS idx FROM ce LEFT JOIN cov USING (r, c) LEFT JOIN (SELECT * FROM nr WHERE i = 1) nr USING (r, c)""")
def commune_index(spark, d):
    centres = shops(spark, d).select("x", "y", F.col("sid").alias("idx"))
    return rc(vector.assigned(GRID.cells(spark), quads(spark, d).withColumn("idx", F.col("idx").cast("long")), centres, GRID, 500.0), "idx")


@query("scatter_add", f"WITH {POINTS}, b AS (SELECT n, {_BIN} FROM p) SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, coalesce(sum(n), 0)::DOUBLE AS pop FROM range({GRID.n}) x(i) CROSS JOIN range({GRID.n}) y(j) LEFT JOIN b ON b.r = i AND b.c = j GROUP BY i, j")
def scatter_add(spark, d):
    return rc(vector.scattered(points(spark, d).withColumnRenamed("n", "pop"), GRID, GRID.cells(spark).select("row", "col"), ["pop"]), "pop")


@query("income_fallback", f"WITH {METRICS} SELECT key, CASE WHEN pop_2km > 30 THEN round(income_1km / pop_2km, 4) WHEN pop_2km + 20 > 30 THEN round(elev / (pop_2km + 20), 4) END AS income FROM m")
def income_fallback(spark, d):
    return metrics(spark, d).select("key", F.round(layers.income(F.col("income_1km"), F.col("pop_2km"), F.col("elev"), F.col("pop_2km") + 20), 4).alias("income"))


_IS = {"farm": "p_size % 6 = 0", "vineyard": "p_size % 6 = 1", "forest": "p_size % 6 = 2", "heavy": "p_size % 6 = 3", "industrial": "p_size % 6 = 4", "residential": "p_size % 6 = 5", "rail": "p_partkey % 8 = 4"}


@query("feature_classes", "SELECT p_partkey, " + ", ".join(f"{_IS.get(n, 'false')} AS is_{n}" for n in sorted(layers.CLASSES)) + " FROM part")
def feature_classes(spark, d):
    tags = F.create_map(F.lit("landuse"), F.element_at(F.array(*map(F.lit, ["farmland", "vineyard", "forest", "quarry", "industrial", "residential"])), (F.col("p_size") % 6 + 1).cast("int")), F.lit("railway"), F.when(F.col("p_partkey") % 4 == 0, "rail").otherwise("none"), F.lit("service"), F.when(F.col("p_partkey") % 8 == 0, "yard").otherwise("main"))
    f = table(spark, d, "part").select("p_partkey", tags.alias("tags"))
    return f.select("p_partkey", *[p().alias(f"is_{n}") for n, p in sorted(layers.CLASSES.items())])


_FAR = geo.Grid(835000.0, 6580000.0, 5000.0, 200.0)
_MX, _MY = "(525000.0::DOUBLE + (px + 0.5::DOUBLE) * 250)", "(5835000.0::DOUBLE - (py + 0.5::DOUBLE) * 250)"
_MLON, _MLAT = f"degrees({_MX} / 6378137.0::DOUBLE)", f"degrees(2 * atan(exp({_MY} / 6378137.0::DOUBLE)) - pi() / 2)"


def _l93(lon: str, lat: str) -> tuple[str, str]:
    t = f"tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {geo._E} * sin(radians({lat}))) / (1 + {geo._E} * sin(radians({lat}))), {geo._E / 2})"
    r, th = f"({geo._A * geo._F!r}::DOUBLE * pow({t}, {geo._N!r}::DOUBLE))", f"({geo._N!r}::DOUBLE * (radians({lon}) - {geo._LON0!r}::DOUBLE))"
    return f"700000 + {r} * sin({th})", f"{geo._Y0 + geo._R0!r}::DOUBLE - {r} * cos({th})"


@query("mercator_resample", f"""WITH f AS (SELECT CAST(p_partkey // {_FAR.n} AS INT) AS r, CAST(p_partkey % {_FAR.n} AS INT) AS c, CAST((p_size * 7 + p_partkey * 13) % 101 AS DOUBLE) AS v FROM part WHERE p_partkey < {_FAR.n ** 2}),
  p AS (SELECT CAST(i AS INT) AS px, CAST(j AS INT) AS py FROM range(60) a(i), range(60) b(j)), ll AS (SELECT px, py, {_MLON} AS lon, {_MLAT} AS lat FROM p), xy AS (SELECT px, py, {_l93("lon", "lat")[0]} AS x, {_l93("lon", "lat")[1]} AS y FROM ll),
  spot AS (SELECT px, py, (y - {_FAR.y0}::DOUBLE) / 200 - 0.5::DOUBLE AS fr, (x - {_FAR.x0}::DOUBLE) / 200 - 0.5::DOUBLE AS fc FROM xy WHERE sqrt((x - 835000) ** 2 + (y - 6580000) ** 2) <= 5000),
  got AS (SELECT px, py, sum(v * (1 - abs(fr - r)) * (1 - abs(fc - c))) AS v FROM spot, range(2) u(i), range(2) w(j) JOIN f ON r = CAST(floor(fr) AS INT) + i AND c = CAST(floor(fc) AS INT) + j GROUP BY px, py HAVING count(*) = 4)
  SELECT px, py, round(v, 4) AS v FROM p LEFT JOIN got USING (px, py)""")
def mercator_resample(spark, d):
    """A field whose last rows may be missing, as a Web Mercator image: pixels next to a gap stay empty."""
    k = F.col("p_partkey")
    field = table(spark, d, "part").where(k < _FAR.n**2).select(F.expr(f"cast(p_partkey div {_FAR.n} as int)").alias("row"), (k % _FAR.n).cast("int").alias("col"), ((F.col("p_size") * 7 + k * 13) % 101).cast("double").alias("v"))
    image = vector.to_mercator_pixels(_FAR, field, "v", (525000.0, 5820000.0, 540000.0, 5835000.0), 60, 60, geo.from_mercator)
    return image.select("px", "py", F.round("v", 4).alias("v"))


# -- graph and zones -------------------------------------------------------------------------------

_MASK = f"{CELLS}, k AS (SELECT r, c FROM g WHERE size > 28)"
_ROOTS = """nb AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2 FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
  reach(r, c, ro, co) AS (SELECT r, c, r, c FROM k UNION SELECT nb.r2, nb.c2, ro, co FROM reach JOIN nb USING (r, c)),
  root AS (SELECT r, c, min(ro * 100000 + co) AS root FROM reach GROUP BY r, c)"""
_REACH = f"{_MASK}, {_ROOTS}"


@query("components", f"WITH RECURSIVE {_REACH} SELECT r, c, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS label FROM root")
def components(spark, d):
    return graph.labelled_cells(cells(spark, d).where("size > 28")).select(F.col("row").alias("r"), F.col("col").alias("c"), "label")


@query("drop_small", f"WITH RECURSIVE {_REACH} SELECT r, c, label FROM (SELECT r, c, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS label, count(*) OVER (PARTITION BY root) AS n FROM root) WHERE n >= 15")
def drop_small(spark, d):
    return rc(graph.drop_small(graph.labelled_cells(cells(spark, d).where("size > 28")), 15), "label")


@query("local_peaks", f"WITH {_CLAMP} SELECT g.r, g.c, any_value(g.z) AS z FROM g, o JOIN g h ON h.r = g.r + o.dr AND h.c = g.c + o.dc GROUP BY g.r, g.c HAVING any_value(g.z) >= max(h.z) - 1e-6")
def local_peaks(spark, d):
    return rc(graph.local_peaks(cells(spark, d), "z", 6), "z")


@query("peak_zones", f"""WITH RECURSIVE {CELLS}, e AS (SELECT max(r) AS r1, max(c) AS c1 FROM g), o AS (SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc FROM range(-3, 4) x(a), range(-3, 4) y(b)),
  fl AS (SELECT g.r, g.c, avg(h.z) AS f FROM g, e, o JOIN g h ON h.r = least(greatest(g.r + o.dr, 0), e.r1) AND h.c = least(greatest(g.c + o.dc, 0), e.c1) WHERE dr * dr + dc * dc <= 4 GROUP BY g.r, g.c),
  k AS (SELECT r, c FROM fl WHERE f >= 48), nb AS MATERIALIZED (SELECT a.r, a.c, b.r AS r2, b.c AS c2 FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
  spread(i, r, c, root) AS (SELECT 0, r, c, r * 100000 + c FROM k UNION ALL SELECT any_value(i) + 1, nb.r, nb.c, min(root) FROM spread JOIN nb ON nb.r2 = spread.r AND nb.c2 = spread.c WHERE i < 400 GROUP BY nb.r, nb.c),
  root AS (SELECT r, c, root FROM spread WHERE i = 400),
  lb AS MATERIALIZED (SELECT r, c, label FROM (SELECT r, c, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS label, count(*) OVER (PARTITION BY root) AS n FROM root) WHERE n >= 15),
  pk AS (SELECT g.r, g.c, any_value(g.f) AS f FROM fl g, o JOIN fl h ON h.r = g.r + o.dr AND h.c = g.c + o.dc GROUP BY g.r, g.c HAVING any_value(g.f) >= max(h.f) - 1e-6),
  od AS MATERIALIZED (SELECT label, r, c, f, row_number() OVER (ORDER BY f DESC, r, c) AS i FROM pk JOIN lb USING (r, c)),
  greedy(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(label BIGINT, r INT, c INT, f DOUBLE)[]) UNION ALL
    SELECT od.i, CASE WHEN len(list_filter(kept, lambda q: q.label = od.label AND sqrt((q.r - od.r) ** 2 + (q.c - od.c) ** 2) < 6)) = 0 THEN list_append(kept, {{'label': od.label, 'r': od.r, 'c': od.c, 'f': od.f}}) ELSE kept END FROM greedy JOIN od ON od.i = greedy.i + 1),
  kp AS (SELECT q.* FROM (SELECT unnest(arg_max(kept, i)) AS q FROM greedy)),
  near AS (SELECT lb.r, lb.c, lb.label, kp.f, kp.r AS pr, kp.c AS pc, row_number() OVER (PARTITION BY lb.r, lb.c ORDER BY (lb.r - kp.r) ** 2 + (lb.c - kp.c) ** 2, kp.f DESC, kp.r, kp.c) AS j FROM lb LEFT JOIN kp ON kp.label = lb.label)
  SELECT r, c, label, CAST(dense_rank() OVER (ORDER BY label, f DESC, pr, pc) AS BIGINT) AS part FROM near WHERE j = 1""")
def peak_zones(spark, d):
    """Zones of a smoothed field: components, small ones dropped, split by suppressed peaks."""
    field = focal.smooth(cells(spark, d), "z", 2, "field").select("row", "col", "field")
    return graph.zones(field, "field", 48.0, 15, 6).select(F.col("row").alias("r"), F.col("col").alias("c"), "label", "part")


def zoned(spark, d):
    """Cells with a zone, a commune, a field and what limits them."""
    k = F.col("key")
    return cells(spark, d).select("row", "col", (k % 37).alias("part"), F.concat(F.lit("c"), (k % 11).cast("string")).alias("commune"), F.col("z").alias("field"), F.when(k % 5 != 0, F.col("size").cast("double")).alias("elev"), (F.col("col") * 200.0).alias("x"), (F.col("row") * 200.0).alias("y"), ((k % 4) / 4.0).alias("feasibility"), (k % 6).cast("int").alias("limiting"))


ZONED = f"{CELLS}, zo AS (SELECT r, c, key % 37 AS part, 'c' || CAST(key % 11 AS VARCHAR) AS commune, z AS field, CASE WHEN key % 5 <> 0 THEN CAST(size AS DOUBLE) END AS elev, c * 200.0::DOUBLE AS x, r * 200.0::DOUBLE AS y, (key % 4) / 4.0::DOUBLE AS feasibility, CAST(key % 6 AS INT) AS limiting FROM g), q75 AS (SELECT part, quantile_cont(field, 0.75) AS p75 FROM zo GROUP BY part)"


@query("zone_rollup", f"""WITH {ZONED}, a AS (SELECT part, count(*) AS cells, count(*) * 4.0::DOUBLE AS area_ha, max(field) AS score_max, avg(CASE WHEN field >= p75 THEN x END) AS x, avg(CASE WHEN field >= p75 THEN y END) AS y, avg(CASE WHEN field >= p75 THEN elev END) AS elev FROM zo JOIN q75 USING (part) GROUP BY part)
  SELECT part, cells, area_ha, score_max, round(x, 3) AS x, round(y, 3) AS y, round(elev, 2) AS elev, CAST(row_number() OVER (ORDER BY score_max DESC, cells DESC, part) AS INT) AS rank FROM a""")
def zone_rollup(spark, d):
    z = zones.zone_rollup(zoned(spark, d), 4.0)
    return z.select("part", "cells", "area_ha", "score_max", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("elev", 2).alias("elev"), "rank")


@query("top_areas", f"WITH {ZONED}, n AS (SELECT part, commune, count(*) AS k FROM zo GROUP BY part, commune), t AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k DESC, commune) AS i FROM n) SELECT part, string_agg(commune, ', ' ORDER BY i) AS areas FROM t WHERE i <= 3 GROUP BY part")
def top_areas(spark, d):
    return zones.top_areas(zoned(spark, d)).select("part", F.array_join("areas", ", ").alias("areas"))


@query("weak_spot", f"""WITH {ZONED}, b AS (SELECT zo.* FROM zo JOIN q75 USING (part) WHERE field >= p75), n AS (SELECT part, count(*) AS n FROM b GROUP BY part),
  h AS (SELECT part, limiting, count(*) AS k FROM b WHERE feasibility < 0.995 AND limiting <> 250 GROUP BY part, limiting), t AS (SELECT part, limiting, k, sum(k) OVER (PARTITION BY part) AS held, row_number() OVER (PARTITION BY part ORDER BY k DESC, limiting) AS i FROM h)
  SELECT part, limiting, round(k / n::DOUBLE, 2) AS share FROM t JOIN n USING (part) WHERE i = 1 AND held >= 0.15 * n""")
def weak_spot(spark, d):
    return zones.weak_spot(zoned(spark, d)).select("part", "limiting", F.round("share", 2).alias("share"))


@query("commune_status", f"""WITH {ZONED}, a AS (SELECT commune, count(*) FILTER (WHERE field >= 52) AS cells_good, max(field) AS best, quantile_cont(field, 0.9) FILTER (WHERE field >= 52) AS p90, quantile_cont(field, 0.75) FILTER (WHERE field >= 52) AS p75 FROM zo GROUP BY commune),
  h AS (SELECT commune, avg(x) AS x, avg(y) AS y FROM zo JOIN a USING (commune) WHERE field >= 52 AND field >= p75 GROUP BY commune)
  SELECT commune, cells_good, best, round(p90, 4) AS p90, round(x, 3) AS x, round(y, 3) AS y, CASE WHEN cells_good = 0 THEN 'excluded' WHEN cells_good < 6 THEN 'marginal' WHEN p90 >= 60 THEN 'green' WHEN p90 >= 48 THEN 'amber' ELSE 'marginal' END AS status FROM a LEFT JOIN h USING (commune)""")
def commune_status(spark, d):
    m = zones.commune_rollup(zoned(spark, d), 4.0, 52)
    return m.select("commune", "cells_good", "best", F.round("p90", 4).alias("p90"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), zones.commune_status(F.col("cells_good"), F.col("p90")).alias("status"))


@query("commune_stats", f"WITH {ZONED} SELECT commune, count(*) AS total, count(*) FILTER (WHERE field >= 52) AS good, max(field) AS best, round(quantile_cont(field, 0.9), 4) AS p90, round(quantile_cont(field, 0.5), 4) AS median FROM zo GROUP BY commune")
def commune_stats(spark, d):
    return zones.commune_stats(zoned(spark, d), 52).select("commune", "total", "good", "best", F.round("p90", 4).alias("p90"), F.round("median", 4).alias("median"))


@query("field_summary", f"WITH {ZONED} SELECT round(quantile_cont(field, 0.5), 4) AS median, round(quantile_cont(field, 0.95), 4) AS p95, max(field) AS best, round(count(*) FILTER (WHERE field >= 52) * 4.0 / 100, 4)::DOUBLE AS good_km2, round(count(*) FILTER (WHERE field >= 52) * 100.0::DOUBLE / count(*), 4) AS good_pct FROM zo")
def field_summary(spark, d):
    return zones.field_summary(zoned(spark, d), 4.0, 52).select(*[F.round(c, 4).alias(c) for c in ("median", "p95", "best", "good_km2", "good_pct")])


@query("nearest_areas", f"WITH {SHOPS} SELECT sid, round(sqrt((sx - 5000) ** 2 + (sy - 5000) ** 2), 4) AS dist FROM sh ORDER BY sqrt((sx - 5000) ** 2 + (sy - 5000) ** 2), lpad(CAST(sid AS VARCHAR), 9, '0') LIMIT 15")
def nearest_areas(spark, d):
    a = shops(spark, d).withColumn("name", F.lpad(F.col("sid").cast("string"), 9, "0"))
    return zones.nearest_areas(a, 5000.0, 5000.0).select("sid", F.round("dist", 4).alias("dist"))


@query("flagship", f"""WITH {SCORED}, {CELLS}, raw AS (SELECT g.r, g.c, sc.attract * sc.feasibility AS v, sc.limiting FROM g JOIN sc USING (key)), e AS (SELECT max(r) AS r1, max(c) AS c1 FROM raw), o AS (SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc FROM range(-2, 3) x(a), range(-2, 3) y(b)),
  fl AS (SELECT g.r, g.c, any_value(g.limiting) AS limiting, avg(h.v) AS field FROM raw g, e, o JOIN raw h ON h.r = least(greatest(g.r + o.dr, 0), e.r1) AND h.c = least(greatest(g.c + o.dc, 0), e.c1) WHERE o.dr * o.dr + o.dc * o.dc <= 4 GROUP BY g.r, g.c)
  SELECT r, c, round(field, 4) AS field, limiting FROM fl""")
def flagship(spark, d):
    """Score every cell, smooth the field, and say what holds each cell back."""
    s = scored(spark, d).withColumn("row", F.expr("cast(key div 50 as int)")).withColumn("col", (F.col("key") % 50).cast("int"))
    raw = s.withColumn("raw", F.col("attract") * F.col("feasibility")).select("row", "col", "raw", "limiting")
    return rc(focal.smooth(raw, "raw", 2, "field"), F.round("field", 4).alias("field"), "limiting")




@query("area_lookup", f"WITH {SHOPS} SELECT sid FROM sh WHERE 'area ' || CAST(sid AS VARCHAR) LIKE '%rea 1%'")
def area_lookup(spark, d):
    """No area has that very name, so those that contain it are found."""
    a = shops(spark, d).select("sid", F.concat(F.lit("Area "), F.col("sid").cast("string")).alias("name"))
    return zones.named(a, "rea 1").select("sid")


@query("click_lookup", f"WITH p AS (SELECT c_custkey, CAST((c_custkey * 71) % 10900 - 450 AS DOUBLE) + 829900.25::DOUBLE AS x, CAST((c_custkey * 53) % 10900 - 450 AS DOUBLE) + 6574900.25::DOUBLE AS y FROM customer), b AS (SELECT c_custkey, CAST(floor((y - {_FAR.y0}) / 200) AS INT) AS r, CAST(floor((x - {_FAR.x0}) / 200) AS INT) AS c FROM p) SELECT c_custkey, CASE WHEN ok THEN r END AS r, CASE WHEN ok THEN c END AS c, CASE WHEN ok THEN r * 1000 + c END AS v FROM (SELECT *, r BETWEEN 0 AND {_FAR.n - 1} AND c BETWEEN 0 AND {_FAR.n - 1} AS ok FROM b)")
def click_lookup(spark, d):
    """Clicks on the map, some beyond its edge, find their cells again."""
    k = F.col("c_custkey")
    lon, lat = geo.to_wgs((k * 71) % 10900 - 450 + 829900.25, (k * 53) % 10900 - 450 + 6574900.25)
    mx, my = geo.mercator(F.col("lon"), F.col("lat"))
    clicks = table(spark, d, "customer").select(k, lon.alias("lon"), lat.alias("lat")).select("c_custkey", mx.alias("mx"), my.alias("my"))
    found = zones.cell_at(clicks, _FAR, _FAR.cells(spark).select("row", "col", (F.col("row") * 1000 + F.col("col")).alias("v")))
    return rc(found, "c_custkey", "v")


@query("census_layers", f"""WITH cu AS (SELECT CAST(floor(((c_custkey * 53) % 10000 - {GRID.y0}) / 200) AS INT) AS r, CAST(floor(((c_custkey * 71) % 10000 - {GRID.x0}) / 200) AS INT) AS c, {", ".join(f"CAST((c_custkey * {7 + i}) % 50 AS DOUBLE) AS {n}" for i, n in enumerate(layers.CENSUS))} FROM customer),
  pc AS (SELECT r, c, {", ".join(f"sum({n}) AS {n}" for n in layers.CENSUS)} FROM cu GROUP BY r, c), ce AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM range({GRID.n}) a(r), range({GRID.n}) b(c)),
  o AS (SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc, a * a + b * b AS d2 FROM range(-15, 16) x(a), range(-15, 16) y(b) WHERE a * a + b * b <= 225),
  s AS (SELECT ce.r, ce.c, {", ".join(f"coalesce(sum({n}) FILTER (WHERE d2 <= 25), 0) AS {n}" for n in layers.CENSUS)}, {" + ".join(f"coalesce(sum({n}) FILTER (WHERE d2 <= 25), 0)" for n in layers.DWELLINGS)} AS dw,
    coalesce(sum(pop_carr) FILTER (WHERE d2 <= 100), 0) AS pop2, coalesce(sum(pop_carr), 0) AS pop3, coalesce(sum(ind_snv), 0) AS snv3 FROM ce, o LEFT JOIN pc ON pc.r = ce.r + dr AND pc.c = ce.c + dc GROUP BY ce.r, ce.c)
  SELECT r, c, round(pop_carr, 4) AS pop_1km, round(pop2, 4) AS pop_2km, CASE WHEN pop_carr > 30 THEN round(ind_snv / pop_carr, 4) WHEN pop3 > 30 THEN round(snv3 / pop3, 4) END AS income_1km,
    {", ".join(f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {a} / greatest({b}, 1e-6))), 4) AS {n}" for a, b, n in (("log_soc", "dw", "social_housing_share_1km"), ("men_pauv", "men", "poor_share_1km"), ("men_mais", "men", "house_share_1km")))}, round(men_surf / greatest(men, 1e-6), 4) AS mean_house_m2 FROM s""")
def census_layers(spark, d):
    k = F.col("c_custkey")
    fields = [((k * (7 + i)) % 50).cast("double").alias(c) for i, c in enumerate(layers.CENSUS)]
    census = table(spark, d, "customer").select(((k * 71) % 10000).cast("double").alias("x"), ((k * 53) % 10000).cast("double").alias("y"), *fields)
    out = layers.census_layers(GRID.cells(spark).select("row", "col"), census, GRID)
    return rc(out, *[F.round(c, 4).alias(c) for c in ("pop_1km", "pop_2km", "income_1km", "social_housing_share_1km", "poor_share_1km", "house_share_1km", "mean_house_m2")])


# -- stage 1 from features to layers -----------------------------------------------------------------

_POINT_TAGS = [("highway", "motorway_junction"), ("amenity", "school"), ("shop", "bakery"), ("shop", "convenience"), ("amenity", "pharmacy"), ("place", "village"), ("generator:source", "wind"), ("amenity", "bench")]
_POINT_CLASS = ["junction", "school", "bakery", "market", "pharmacy", "village", "plant", None]
_LINE_TAGS = [("highway", "motorway_link"), ("highway", "primary"), ("railway", "rail"), ("highway", "footway")]
_RING_TAGS = [("landuse", "farmland"), ("landuse", "vineyard"), ("landuse", "orchard"), ("natural", "wood"), ("natural", "water"), ("landuse", "residential"), ("landuse", "farmyard"), ("man_made", "wastewater_plant"), ("landuse", "industrial"), ("landuse", "grass")]
_RING_CLASS = ["farm", "vineyard", "orchard", "forest", "water", "residential", "farmyard", "heavy", "industry", None]


def _tags(key, pairs):
    return F.element_at(F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v in pairs]), (key % len(pairs) + 1).cast("int"))


def map_points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(_tags(k, _POINT_TAGS).alias("tags"), ((k * 71) % 10400 - 200).cast("double").alias("x"), ((k * 53) % 10400 - 200).cast("double").alias("y"))


def map_lines(spark, d):
    """Three vertices from each supplier on; every other railway is a fast one."""
    k, s = F.col("s_suppkey"), F.col("seq")
    tags = F.when(k % 8 == 2, F.map_concat(_tags(k, _LINE_TAGS), F.create_map(F.lit("highspeed"), F.lit("yes")))).otherwise(_tags(k, _LINE_TAGS))
    v = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    return v.select(k.cast("string").alias("fid"), tags.alias("tags"), "seq", ((k * 977) % 10000 + s * 311).cast("double").alias("x"), ((k * 613) % 10000 + s * s * 97).cast("double").alias("y"))


def map_rings(spark, d):
    """Closed quadrilaterals that grow with the supplier's number."""
    k = F.col("s_suppkey")
    corner = F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (90, 13), (77, 101), (-11, 83), (0, 0))]))
    v = table(spark, d, "supplier").select("s_suppkey", corner.alias("seq", "p"))
    at = lambda m, c: (k * m) % 9000 + F.col(f"p.{c}") * (1 + k % 9) + 0.37
    return v.select(k.cast("string").alias("fid"), _tags(k, _RING_TAGS).alias("tags"), "seq", at(1237, "a").alias("x"), at(2311, "b").alias("y"))


def _case(key, names):
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names) if n) + " END"


_STAGE1 = f"""pt AS (SELECT {_case("c_custkey", _POINT_CLASS)} AS cls, CAST((c_custkey * 71) % 10400 - 200 AS DOUBLE) AS x, CAST((c_custkey * 53) % 10400 - 200 AS DOUBLE) AS y FROM customer),
  lv AS (SELECT unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['motorway'] WHEN s_suppkey % 4 = 1 THEN ['trunk_primary'] WHEN s_suppkey % 8 = 2 THEN ['rail', 'rail_highspeed'] WHEN s_suppkey % 4 = 2 THEN ['rail'] ELSE [] END) AS cls,
    s_suppkey AS fid, s, CAST((s_suppkey * 977) % 10000 + s * 311 AS DOUBLE) AS x, CAST((s_suppkey * 613) % 10000 + s * s * 97 AS DOUBLE) AS y FROM supplier, range(3) t(s)),
  rv AS (SELECT {_case("s_suppkey", _RING_CLASS)} AS c0, s_suppkey AS fid, s, CAST((s_suppkey * 1237) % 9000 + ([0, 90, 77, -11, 0])[s + 1] * (1 + s_suppkey % 9) AS DOUBLE) + 0.37::DOUBLE AS x,
    CAST((s_suppkey * 2311) % 9000 + ([0, 13, 101, 83, 0])[s + 1] * (1 + s_suppkey % 9) AS DOUBLE) + 0.37::DOUBLE AS y FROM supplier, range(5) t(s)),
  re AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rv WHERE c0 IS NOT NULL WINDOW w AS (PARTITION BY fid ORDER BY s)),
  ar AS (SELECT fid, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM re WHERE x2 IS NOT NULL GROUP BY fid),
  rc AS (SELECT re.*, CASE WHEN c0 <> 'industry' THEN c0 WHEN area >= 30000 THEN 'large_industry' ELSE 'light_industry' END AS cls FROM re JOIN ar USING (fid)),
  sg AS (SELECT cls, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (SELECT cls, 'l' || fid AS fid, s, x, y FROM lv UNION ALL SELECT cls, 'r' || fid, s, x, y FROM rc WHERE cls IN ('farmyard', 'heavy', 'large_industry', 'light_industry')) WINDOW w AS (PARTITION BY cls, fid ORDER BY s)),
  sk AS (SELECT *, CASE WHEN nx IS NOT NULL AND sqrt((nx - x) ** 2 + (ny - y) ** 2) > 60 THEN CAST(floor(sqrt((nx - x) ** 2 + (ny - y) ** 2) / 60) AS INT) ELSE 0 END AS k FROM sg),
  ap AS (SELECT DISTINCT * FROM (SELECT cls, x, y FROM pt WHERE cls IS NOT NULL UNION ALL SELECT cls, CASE WHEN i = 0 THEN x ELSE x + (nx - x) * (CAST(i AS DOUBLE) / (k + 1)) END, CASE WHEN i = 0 THEN y ELSE y + (ny - y) * (CAST(i AS DOUBLE) / (k + 1)) END FROM sk, range(40) t(i) WHERE i <= k)),
  ce AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, {GRID.x0}::DOUBLE + (c + 0.5::DOUBLE) * 200 AS x, {GRID.y0}::DOUBLE + (r + 0.5::DOUBLE) * 200 AS y FROM range({GRID.n}) a(r), range({GRID.n}) b(c)),
  di AS (SELECT r, c, cls, min(sqrt((ce.x - ap.x) ** 2 + (ce.y - ap.y) ** 2)) AS dist FROM ce, ap GROUP BY r, c, cls),
  sb AS (SELECT CAST(sr AS INT) AS sr, CAST(sc AS INT) AS sc, {GRID.y0}::DOUBLE + (sr + 0.5::DOUBLE) * 50 AS py, {GRID.x0}::DOUBLE + (sc + 0.5::DOUBLE) * 50 AS px FROM range({GRID.n * 4}) a(sr), range({GRID.n * 4}) b(sc)),
  hi AS (SELECT DISTINCT cls, sr, sc FROM (SELECT cls, fid, sr, sc FROM sb JOIN rc ON (y > py) <> (y2 > py) AND x + (py - y) / (y2 - y) * (x2 - x) > px GROUP BY cls, fid, sr, sc HAVING count(*) % 2 = 1)),
  ss AS (SELECT cls, sr // 4 AS r, sc // 4 AS c, count(*) / 16.0::DOUBLE AS share FROM hi GROUP BY cls, sr // 4, sc // 4),
  sf AS (SELECT ce.r, ce.c, k.cls, coalesce(share, 0) AS share FROM ce CROSS JOIN (SELECT unnest(['farm', 'vineyard', 'orchard', 'forest', 'water', 'residential', 'farmyard', 'heavy', 'large_industry', 'light_industry']) AS cls) k LEFT JOIN ss ON ss.r = ce.r AND ss.c = ce.c AND ss.cls = k.cls),
  rad AS (SELECT * FROM (VALUES ('farm', 4), ('vineyard', 5), ('orchard', 5), ('forest', 5), ('water', 2), ('residential', 5)) t(cls, rad)),
  oo AS (SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc FROM range(-5, 6) x(a), range(-5, 6) y(b)),
  fm AS (SELECT ce.r, ce.c, rad.cls, avg(sf.share) AS m FROM ce, rad JOIN oo ON dr * dr + dc * dc <= rad * rad JOIN sf ON sf.cls = rad.cls AND sf.r = least(greatest(ce.r + dr, 0), {GRID.n - 1}) AND sf.c = least(greatest(ce.c + dc, 0), {GRID.n - 1}) GROUP BY ce.r, ce.c, rad.cls),
  dd AS (SELECT ce.r, ce.c, k.cls, CASE WHEN coalesce(sf.share, 0) > 0.5 AND k.cls IN ('farmyard', 'heavy', 'large_industry', 'light_industry') THEN 0 ELSE coalesce(dist, 1e9) END AS dist FROM ce CROSS JOIN (SELECT unnest({layers.LINE_CLASSES + layers.POINT_CLASSES + layers.AREA_CLASSES}) AS cls) k LEFT JOIN di ON di.r = ce.r AND di.c = ce.c AND di.cls = k.cls LEFT JOIN sf ON sf.r = ce.r AND sf.c = ce.c AND sf.cls = k.cls)"""
_DISTS = [*layers.LINE_CLASSES, *layers.POINT_CLASSES, *layers.AREA_CLASSES]
_D = {c: f"max(CASE WHEN cls = '{c}' THEN dist END)" for c in _DISTS}


@query("stage1_layers", f"""WITH {_STAGE1}, dw AS (SELECT r, c, {", ".join(f"{e} AS dist_{c}" for c, e in _D.items())} FROM dd GROUP BY r, c),
  fw AS (SELECT r, c, {", ".join(f"max(CASE WHEN cls = '{cls}' THEN m END) AS {name}" for name, (cls, _) in layers.SHARES.items())} FROM fm GROUP BY r, c)
  SELECT r, c, {", ".join(f"round(dist_{c}, 4) AS dist_{c}" for c in _DISTS)}, round(least(dist_heavy, dist_large_industry, dist_plant), 4) AS dist_nuisance, round(greatest(dist_school, dist_bakery, dist_market), 4) AS dist_services,
  {", ".join(f"round({name}, 6) AS {name}" for name in layers.SHARES)} FROM dw JOIN fw USING (r, c)""")
def stage1_layers(spark, d):
    """Every layer that map features give, in one search of distances and one pass of shares."""
    out = layers.distance_and_share_layers(GRID.cells(spark).select("row", "col", "x", "y"), GRID, map_points(spark, d), map_lines(spark, d), map_rings(spark, d))
    return rc(out, *[F.round(f"dist_{c}", 4).alias(f"dist_{c}") for c in [*_DISTS, "nuisance", "services"]], *[F.round(c, 6).alias(c) for c in layers.SHARES])


@query("ring_shoelace", f"WITH {LINES}, s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM ln WINDOW w AS (PARTITION BY fid ORDER BY seq)) SELECT fid, abs(sum(x * ny - nx * y)) / 2 AS area FROM s GROUP BY fid")
def ring_shoelace(spark, d):
    rings = lines(spark, d).groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return rings.select("fid", vector.shoelace_array(F.col("ring")).alias("area"))
