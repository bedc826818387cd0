"""Pages of the six portal forms, and windows around links against plain Python."""

import json
import re

from pyspark.sql import functions as F

from georesolve.functions import html as H
from georesolve.functions import text as T
from georesolve.sources import portals

ABOUT = "Belle maison de 145 m² avec 3 chambres et terrasse. Terrain de 1 200 m². Chauffage au bois. Vue sur les vignes. Au calme, sans vis à vis."
OG = lambda title, about: f'<meta property="og:title" content="{title}"><meta property="og:description" content="{about}">'
PAGES = [
    ("orpi", "https://www.orpi.com/annonce-vente-maison-t5-cluny-71250-0a1b2c3d-11/", OG("Maison 145 m² - 349 000 € | Orpi", "x") + f"<p>{ABOUT} {ABOUT}</p><div>RGPD {ABOUT * 4}</div>" + "".join(f'"https://abc.cloudimg.io/v7/{i}/0a1b2c3d-11?w={w}&amp;ci_sign={i}"' for i, w in (("p1", 10), ("p1", 20), ("p2", 10))) + '"https://abc.cloudimg.io/v7/other?ci_sign=zz"'),
    ("safti", "https://www.safti.fr/annonces/achat/maison/saint-gengoux-71460/998877", OG("", "") + f"<h1>Maison</h1> 275 000 € Surface habitable : 98m² Chambres : 4 <p>{ABOUT}</p>" + 'https://cdn.safti.fr/bien-photo/12/998877/0a0b0c0d/rn.jpg https://cdn.safti.fr/bien-photo/12/998877/0a0b0c0d/rg.jpg https://cdn.safti.fr/bien-photo/12/5/0a0b0c0e/rn.jpg'),
    ("laforet", "https://www.laforet.com/agence-immobiliere/macon/acheter/hurigny/maison-5-pieces-4455", OG("Maison 5 pièces 199 000 € | Laforêt Mâcon", "court") + f"<section>{ABOUT}</section> https://cdn.x/4455-a.jpg?w=2 https://cdn.x/4455-a.jpg?w=3 https://cdn.x/agence-4455.jpg https://cdn.x/other.jpg"),
    ("century21", "https://www.century21.fr/trouver_logement/detail/1234567/", OG("Maison à vendre - 4 pièces - 83 m2 - Grieges - 01 - RHONE-ALPES", ABOUT) + "<p>6298 245 000 €</p> <img src='/img/a.png'> https://x.y/b.webp?quality=9"),
    ("century21", "https://www.century21.fr/trouver_logement/detail/7654321/", OG("Appartement 145 000 €", "deux pièces")),
    ("paruvendu", "https://www.paruvendu.fr/immobilier/vente/maison/1294203342A1", "<title>Maison Uchizy - ParuVendu</title><meta name=\"description\" content=\"maison à vendre de 154m2 au prix de 399 000€\"><script>dataLayer = [{'gtm_var_prix':'398000','gtm_lib_ville':'Uchizy'}];setTargeting('nbpces', ['60'])setTargeting('DPE', ['C'])</script><img src='https://img.paruvendu.fr/photo1.jpg'> 3 chambres"),
    ("paruvendu", "https://www.paruvendu.fr/immobilier/vente/maison/2", "<p>no price</p>"),
    ("elsewhere", "https://e.org", OG("Maison 100 000 €", ABOUT)),
]


def test_pages_of_each_form(spark):
    got = {r["source"]: r for r in portals.portal_listings(spark.createDataFrame(PAGES, "source string, url string, html string")).collect()}
    assert sorted(got) == ["century21", "laforet", "orpi", "paruvendu", "safti"]
    o, s, la, c, p = (got[n] for n in ("orpi", "safti", "laforet", "century21", "paruvendu"))
    assert (o.price, o.title, o.area_m2, o.land_m2, o.rooms, o.bedrooms, o.commune_name, o.postcode, o.source_id, o.has_terrace) == (349000, "Maison 145 m² - 349 000 €", 145.0, 1200.0, 5, 3, "Cluny", "71250", "0a1b2c3d-11", True)
    assert o.description == f"{ABOUT} {ABOUT}" and [u.split("/")[4] for u in o.photos] == ["p1", "p2"] and "&amp;" not in o.photos[0]
    assert (s.price, s.title, s.area_m2, s.bedrooms, s.commune_name, s.postcode, s.source_id, len(s.key)) == (275000, "Maison Saint Gengoux", 98.0, 4, "Saint Gengoux", "71460", "998877", 20)
    assert s.photos == ["https://cdn.safti.fr/bien-photo/12/998877/0a0b0c0d/rn.jpg"]
    assert (la.price, la.title, la.rooms, la.commune_name, la.photos) == (199000, "Maison 5 pièces 199 000 €", 5, "Hurigny", ["https://cdn.x/4455-a.jpg?w=2"])
    assert (c.price, c.area_m2, c.rooms, c.commune_name, c.source_id, c.photos) == (245000, 83.0, 4, "Grieges", "1234567", ["https://x.y/b.webp?quality=9", "/img/a.png"])
    assert (p.price, p.area_m2, p.rooms, p.bedrooms, p.commune_name, p.dpe, p.title, p.photos) == (398000, 154.0, 6, 3, "Uchizy", "C", "Maison Uchizy", ["https://img.paruvendu.fr/photo1.jpg"])


def test_windows_of_near_links_overlap(spark):
    page = "".join(f"{'ab' * (i % 7)}<a href='/d/{i}0'>{'Maison' if i % 3 else 'Garage'}</a>" for i in range(12)) + " end"
    for reach in (0, 5, 40, 5000):
        (r,) = spark.createDataFrame([(page,)], "html string").select(H.around(F.col("html"), r"/d/\d+", reach).alias("w")).collect()
        assert [(x["link"], x["window"]) for x in r["w"]] == [(m.group(), page[max(0, m.start() - reach) : m.end() + reach]) for m in re.finditer(r"/d/\d+", page)]
    assert spark.createDataFrame([("none",)], "html string").select(H.around(F.col("html"), r"/d/\d+", 5).alias("w")).first()["w"] == []


def test_links_are_kept_by_what_stands_around_them(spark):
    far = "." * 1300
    c21 = f"<a href='/trouver_logement/detail/1111111/'>Maison</a>{far}<a href='/trouver_logement/detail/2222222/'>Appartement</a><a href='/trouver_logement/detail/3333333/'></a>{far}"
    rows = [
        ("century21", c21),
        ("paruvendu", "/immobilier/vente/maison/12345678A1 une villa"),
        ("safti", "<a href='/annonces/achat/maison/cluny-71250/77'/><a href='/annonces/achat/terrain/cluny-71250/78'/>"),
        ("orpi", "<a href=\"/annonce-vente-maison-t5-cluny-71250-0a1b2c3d\"><a href='/annonce-location-maison-t5-cluny-71250-0a1b2c3e'>"),
    ]
    got = {(r.source, r.url) for r in portals.portal_links(spark.createDataFrame(rows, "source string, html string")).collect()}
    assert got == {("century21", "https://www.century21.fr/trouver_logement/detail/1111111/"), ("paruvendu", "https://www.paruvendu.fr/immobilier/vente/maison/12345678A1"), ("safti", "https://www.safti.fr/annonces/achat/maison/cluny-71250/77"), ("orpi", "https://www.orpi.com/annonce-vente-maison-t5-cluny-71250-0a1b2c3d")}


def test_api_listings(spark):
    item = {"typeBien": "MAI", "typeTransaction": "VENTE", "prixAffiche": 200000.0, "nbChambres": 3, "surface": "120", "descriptionFr": "Maison ancienne\nde 5 pièces avec piscine", "localiteNom": "MACON", "urlPhotoPrincipale": "https://p/1.jpg", "urlDetailAnnonceFr": "https://n/1"}
    bodies = [json.dumps({"annonceResumeDto": [item, item | {"typeBien": "APP"}, item | {"prixAffiche": 900000}, item | {"nbChambres": 1}, item | {"urlDetailAnnonceFr": ""}]}), "not json", json.dumps({})]
    (r,) = portals.notary_listings(spark.createDataFrame([(b,) for b in bodies], "body string"), 250_000, 2).collect()
    assert (r.price, r.title, r.area_m2, r.rooms, r.bedrooms, r.commune_name, r.has_pool, r.photos, r.url) == (200000, "Maison ancienne", 120.0, 5, 3, "Mâcon", True, ["https://p/1.jpg"], "https://n/1")


def test_commune_from_titles_and_capitals(spark):
    rows = [("Maison - 83 m2 - Grieges - 01 - RHONE-ALPES", "", "Grieges", "Rhone-Alpes"), ("Maison 4 pièces GRIEGES (01290)", "", "", "Grieges"), ("MAISON à vendre", "A SAINT-AMOUR dans le bourg", "", "Saint-Amour"), ("rien", "rien", "", "")]
    df = spark.createDataFrame(rows, "t string, b string, a string, c string")
    for r in df.select("a", "c", T.commune_in_title(F.col("t")).alias("x"), T.commune_in_capitals(F.col("t"), F.col("b")).alias("y")).collect():
        assert (r.x, r.y.lower()) == (r.a, r.c.lower())
