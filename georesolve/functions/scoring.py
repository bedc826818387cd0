"""Fuzzy multi-criteria scoring: vetoes by the least, preferences by a weighted geometric mean."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_LIMIT = 250
UNKNOWN_MEMBERSHIP, UNKNOWN_ATTRACTION = 0.6, 0.35
PREFERENCE_FLOOR = 0.08


@dataclass(frozen=True)
class Rule:
    key: str
    metric: str
    direction: str  # min or max
    threshold: float | None
    margin: float | None
    kind: str = "veto"  # or pref
    weight: float = 0.0


@dataclass(frozen=True)
class Soft:
    name: str
    weight: float
    metric: str
    bad: float
    good: float


# The default rules and criteria, in the order that a limiting factor's number refers to.
RULES = [
    Rule("dist_motorway_min_m", "dist_motorway", "min", 800, 350),
    Rule("dist_trunk_primary_min_m", "dist_trunk_primary", "min", 300, 150),
    Rule("dist_rail_min_m", "dist_rail", "min", 800, 350),
    Rule("dist_rail_highspeed_min_m", "dist_rail_highspeed", "min", 1500, 600),
    Rule("dist_nuisance_min_m", "dist_nuisance", "min", 700, 300),
    Rule("dist_farmyard_min_m", "dist_farmyard", "min", 300, 150),
    Rule("dist_light_industry_min_m", "dist_light_industry", "min", 250, 150),
    Rule("slope_max_pct", "slope_pct", "max", 25, 8),
    Rule("elev_min_m", "elev", "min", 195, 25),
    Rule("farm_share_800m_max", "farm_share_800m", "max", 0.62, 0.18, "pref", 3.0),
    Rule("rel_elev_2km_min_m", "rel_elev_2km", "min", 12, 12, "pref", 3.0),
    Rule("tpi_1km_min_m", "tpi_1km", "min", 2, 6, "pref", 1.5),
    Rule("pop_2km_min", "pop_2km", "min", 300, 250, "pref", 2.0),
    Rule("dist_bakery_max_m", "dist_bakery", "max", 5000, 2500, "pref", 1.5),
    Rule("dist_school_max_m", "dist_school", "max", 5000, 2500, "pref", 1.5),
    Rule("income_1km_min_eur", "income_1km", "min", 20000, 2500, "pref", 1.5),
    Rule("social_housing_share_1km_max", "social_housing_share_1km", "max", 0.30, 0.15, "pref", 1.0),
    Rule("dist_motorway_junction_max_m", "dist_junction", "max", 18000, 5000, "pref", 1.0),
]
CRITERIA = [
    Soft("view", 18, "rel_elev_5km", 10, 120),
    Soft("vineyard", 14, "vineyard_share_1km", 0.0, 0.35),
    Soft("quiet", 12, "dist_motorway", 800, 4000),
    Soft("income", 12, "income_1km", 20000, 32000),
    Soft("no_farm", 10, "farm_share_800m", 0.62, 0.0),
    Soft("services", 10, "dist_services", 5000, 800),
    Soft("sun", 8, "southness", -0.5, 1.0),
    Soft("forest", 6, "forest_share_1km", 0.0, 0.30),
    Soft("rail_far", 5, "dist_rail", 800, 5000),
    Soft("house_area", 5, "mean_house_m2", 85, 140),
]


@dataclass(frozen=True)
class Scoring:
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    criteria: list[Soft] = field(default_factory=lambda: list(CRITERIA))
    tolerance: float = 0.0

    def active(self, columns: list[str]) -> list[Rule]:
        """Rules with a threshold whose metric exists."""
        return [r for r in self.rules if r.threshold is not None and r.metric in columns]

    def margin(self, rule: Rule) -> float:
        m = abs(rule.threshold) * self.tolerance if rule.margin is None else rule.margin
        return m * (1 + self.tolerance) if self.tolerance else m


def membership(value: Column, direction: str, threshold: float, margin: float) -> Column:
    """1 on the good side of the threshold, falling to 0 over the margin beyond; unknown is 0.6."""
    m = max(margin, 1e-9)
    raw = (value - (threshold - m)) / m if direction == "min" else ((threshold + m) - value) / m
    # least and greatest pass over nulls, so the unknown is told apart first.
    return F.when(value.isNull(), UNKNOWN_MEMBERSHIP).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw.cast("double"))))


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def feasibility(cells: DataFrame, scoring: Scoring) -> DataFrame:
    """cells with a membership p_<key> per active rule, veto, pref, feasibility and limiting."""
    rules = scoring.active(cells.columns)
    out = cells.withColumns({f"p_{r.key}": membership(F.col(r.metric), r.direction, r.threshold, scoring.margin(r)) for r in rules})
    vetoes, prefs = [r for r in rules if r.kind == "veto"], [r for r in rules if r.kind == "pref"]
    veto = _least([F.col(f"p_{r.key}") for r in vetoes]) if vetoes else F.lit(1.0)
    total = sum(r.weight for r in prefs)
    pref = F.exp(sum((F.lit(r.weight / total) * F.log(F.lit(PREFERENCE_FLOOR) + (1 - PREFERENCE_FLOOR) * F.col(f"p_{r.key}")) for r in prefs), F.lit(0.0))) if total else F.lit(1.0)
    out = out.withColumn("veto", veto).withColumn("pref", pref).withColumn("feasibility", F.col("veto") * F.col("pref"))
    return out.withColumn("limiting", limiting(rules, scoring.rules))


def limiting(active: list[Rule], numbered: list[Rule]) -> Column:
    """The number of the rule that holds a cell back most, the first of equals; 250 if none does.

    While a veto bites (least veto under 0.75) only vetoes count.
    """
    if not active:
        return F.lit(NO_LIMIT)

    def first(rules: list[Rule]) -> Column:
        p = F.array(*[F.col(f"p_{r.key}") for r in rules])
        numbers = F.array(*[F.lit(numbered.index(r)) for r in rules])
        return F.element_at(numbers, F.array_position(p, F.array_min(p)).cast("int"))

    vetoes = [r for r in active if r.kind == "veto"]
    out = F.when(_least([F.col(f"p_{r.key}") for r in active]) >= 0.995, NO_LIMIT)
    if vetoes:
        out = out.when(F.col("veto") < 0.75, first(vetoes))
    return out.otherwise(first(active))


def rule_stats(scored: DataFrame, scoring: Scoring, inside: str = "inside") -> DataFrame:
    """Per active rule: key, killed and touched cells inside, counted in one pass."""
    rules = [r for r in scoring.active(scored.columns) if f"p_{r.key}" in scored.columns]
    counts = scored.where(inside).agg(*[F.count_if(F.col(f"p_{r.key}") <= 0.001).alias(f"k{i}") for i, r in enumerate(rules)], *[F.count_if(F.col(f"p_{r.key}") < 1).alias(f"t{i}") for i, r in enumerate(rules)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r.key).alias("key"), F.col(f"k{i}").alias("killed"), F.col(f"t{i}").alias("touched")) for i, r in enumerate(rules)])).alias("s")).select("s.*")


def rule_report(scored: DataFrame, scoring: Scoring, inside: str = "inside") -> DataFrame:
    """rank, kind, key, threshold, margin, killed_pct, touched_pct of the cells inside: vetoes first, then by what they kill."""
    rules = scored.sparkSession.createDataFrame([(i, r.key, r.kind, float(r.threshold), float(r.margin)) for i, r in enumerate(scoring.active(scored.columns))], "i int, key string, kind string, threshold double, margin double")
    share = lambda c: (F.col(c) * 100.0 / F.col("__n")).alias(f"{c}_pct")
    counts = rule_stats(scored, scoring, inside).join(F.broadcast(scored.where(inside).agg(F.greatest(F.lit(1), F.count("*")).alias("__n"))))  # one row
    out = counts.join(F.broadcast(rules), "key").select("kind", "key", "threshold", "margin", "killed", share("killed"), share("touched"), "i")
    order = Window.orderBy(F.col("kind") != "veto", F.col("killed").desc(), "i")  # as many rows as there are rules
    return out.withColumn("rank", F.row_number().over(order)).drop("killed", "i")


def normalized(value: Column, bad: float, good: float) -> Column:
    """0 at bad to 1 at good, whichever is larger; unknown is 0.35."""
    return F.when(value.isNull(), UNKNOWN_ATTRACTION).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value.cast("double") - bad) / (good - bad))))


def attractiveness(cells: DataFrame, scoring: Scoring) -> Column:
    """0 to 100; a criterion whose metric is missing adds nothing, but its weight stays in the total."""
    total = sum(c.weight for c in scoring.criteria)
    parts = [F.lit(c.weight / total * 100) * normalized(F.col(c.metric), c.bad, c.good) for c in scoring.criteria if c.metric in cells.columns]
    return sum(parts, F.lit(0.0))


def verdict(p: Column) -> Column:
    return F.when(p >= 0.999, "ok").when(p >= 0.5, "nearly").when(p > 0, "weak").otherwise("no")


def bar(p: Column, width: int = 12) -> Column:
    full = F.bround(p * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def explained(scored: DataFrame, scoring: Scoring, keys: list[str]) -> DataFrame:
    """scored unpivoted: keys, rule, value, threshold, membership, verdict."""
    rules = [r for r in scoring.active(scored.columns) if f"p_{r.key}" in scored.columns]
    one = lambda r: F.struct(F.lit(r.key).alias("rule"), F.col(r.metric).cast("double").alias("value"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"p_{r.key}").alias("membership"))
    return scored.select(*keys, F.explode(F.array(*map(one, rules))).alias("e")).select(*keys, "e.*").withColumn("verdict", verdict(F.col("membership")))


def explained_area(scored: DataFrame, scoring: Scoring) -> DataFrame:
    """Per rule over all given cells: median, best (by direction) and mean membership."""
    rules = [r for r in scoring.active(scored.columns) if f"p_{r.key}" in scored.columns]
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(r.direction).alias("direction"), F.col(r.metric).cast("double").alias("value"), F.col(f"p_{r.key}").alias("p")) for r in rules])).alias("e")).select("e.*")
    best = F.when(F.col("direction") == "min", F.max("value")).otherwise(F.min("value"))
    return long.groupBy("rule", "direction").agg(F.median("value").alias("median"), best.alias("best"), F.avg("p").alias("membership"))
