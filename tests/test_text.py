import pytest
from pyspark.sql import functions as F

from georesolve.functions import html as H
from georesolve.functions import text as T

LISTINGS = [
    ("Maison 145 m² 349 000 € FAI, 5 pièces, 4 chambres, terrain 1 200 m², terrasse, piscine", 145, 1200, 349000, 5, 4),
    ("T6 210m2 terrain de 1,5 ha, 320.000 euros hors honoraires, à rénover", 210, 15000, 320000, 6, None),
    ("Maison 98 m² 285000 €, terrain 2.500 m2, cave 30 m²", 98, 2500, 285000, None, None),
    ("Villa T4 120 m2 sur 850 m² de terrain, 3 chambres, 275 000 €", 120, 850, 275000, 4, 3),
    ("Propriété 320 m² habitables, parcelle 12 500 m2, piscine, 690 000 € FAI", 320, 12500, 690000, None, None),
    ("Maison 160 m² avec grange de 80 m², 1 ha de terrain, 340 000 €", 160, 10000, 340000, None, None),
    ("Charmante maison de 112 m2, jardin de 600 m², 4 pièces, DPE D, 249 000 €", 112, 600, 249000, 4, None),
]


def one(spark, text, **cols):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(*[c(F.col("t")).alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("text,area,land,price,rooms,beds", LISTINGS)
def test_listing_fields(spark, text, area, land, price, rooms, beds):
    r = one(spark, text, area=T.area_m2, land=T.land_m2, price=T.price, rooms=T.rooms, beds=T.bedrooms)
    assert (r.area, r.land, r.price, r.rooms, r.beds) == (area, land, price, rooms, beds)


@pytest.mark.parametrize("space", [" ", " ", " ", " ", " "])
def test_price_separators(spark, space):
    assert one(spark, f"Prix : 220{space}000 €", p=T.price).p == 220000


def test_tri_state_and_codes(spark):
    fees = [("349 000 € FAI", True), ("320 000 € hors honoraires", False), ("honoraires à la charge de l'acquéreur", False), ("285 000 €", None), ("", None), (None, None)]
    for text, want in fees:
        assert one(spark, text, v=T.fees_included).v is want
    for text, name, want in [("belle terrasse plein sud", "terrace", True), ("maison sans piscine", "pool", False), ("avec piscine chauffée", "pool", True), ("garage double", "garage", True), ("maison lumineuse", "pool", None)]:
        assert one(spark, text, v=lambda c, n=name: T.feature(c, n)).v is want
    assert "needs_work" in one(spark, "maison à rénover, travaux à prévoir", v=T.condition_hint).v
    assert one(spark, "maison rénovée en bon état", v=T.condition_hint).v == "renovated,good_state"
    assert [one(spark, t, v=T.dpe).v for t in ("DPE : C", "classe énergétique D", "maison agréable")] == ["C", "D", ""]
    assert one(spark, "garage 3 000 €", v=T.price).v is None
    assert one(spark, "1 200 m² de terrain", v=T.price).v is None


def test_slug_and_shingles(spark):
    assert one(spark, "Saint-Étienne / Mâcon!", v=T.slug).v == "saint etienne macon"
    assert one(spark, "un deux", v=T.shingles).v == ["un", "deux"]
    assert one(spark, "a b c d", v=T.shingles).v == ["a b c", "b c d"]


def test_rows_of_long_work_are_dealt_to_several_tasks_and_their_pages_built_once(spark, data):
    from georesolve.queries import text

    for made, column in ((text.phrases, "t"), (text._page, "html"), (text._portal_pages, "html")):
        rows = made(spark, data)
        assert rows.rdd.getNumPartitions() > 1
        used_twice = rows.selectExpr(f"length({column}) a", f"upper({column}) b")
        assert "Generate" in used_twice._jdf.queryExecution().optimizedPlan().toString()


def test_first_and_last_of_repeated_tags_and_plots_in_hectares(spark):
    page = '<meta property="og:title" content="a"><meta content="b" name="og:title"><meta property="og:image" content="i">'
    rows = spark.createDataFrame([(page, "terrain de 2,5 ha"), ("", "terrain 40 m2"), (None, None), (page, "1 200 m2 de jardin")], "html string, t string")
    got = rows.select(H.meta_tags(F.col("html")).alias("f"), H.meta_tags(F.col("html"), last_wins=True).alias("l"), T.land_m2(F.col("t")).alias("land")).collect()
    assert [(r.f, r.l, r.land) for r in got] == [({"og:title": "a", "og:image": "i"}, {"og:title": "b", "og:image": "i"}, 25_000.0), ({}, {}, None), (None, None, None), ({"og:title": "a", "og:image": "i"}, {"og:title": "b", "og:image": "i"}, 1200.0)]
