"""Queries of text and page functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..sources import listings as sources
from ..sources import portals
from .base import held, query, spread, table


def _k():
    return F.col("p_partkey")


def _s():
    return F.col("p_size")


def phrases(spark, d):
    """French listing phrases from part; numbers with plain, no-break and thin spaces."""
    space = F.element_at(F.array(F.lit(" "), F.lit(" "), F.lit(" "), F.lit(" ")), (_k() % 4 + 1).cast("int"))
    price = F.concat((150 + (_k() * 7) % 500).cast("string"), space, F.lpad(((_k() * 13) % 10 * 100).cast("string"), 3, "0"), F.lit(" €"))
    extra = F.element_at(F.array(*map(F.lit, ["FAI", "hors honoraires", "", "honoraires à la charge de l'acquéreur"])), (_s() % 4 + 1).cast("int"))
    feat = F.element_at(F.array(*map(F.lit, ["belle terrasse", "sans piscine", "avec piscine", "garage double", "pas de terrasse", "lumineuse"])), (_k() % 6 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ["à rénover", "rénovée en bon état", "neuve", "travaux à prévoir", "lumineuse"])), (_k() % 5 + 1).cast("int"))
    dpe = F.element_at(F.array(*map(F.lit, ["DPE : C", "classe énergétique D", "", "DPE G"])), (_s() % 4 + 1).cast("int"))
    text = F.concat_ws(
        " ", F.lit("Maison"), (40 + (_k() * 3) % 200).cast("string"), F.lit("m²"), price, extra, F.lit(","), (1 + _s() % 9).cast("string"), F.lit("pièces,"), (1 + _s() % 5).cast("string"), F.lit("chambres, terrain"), (200 + (_k() * 17) % 800).cast("string"), F.lit("m2,"), feat, F.lit(","), state, F.lit(","), dpe
    )
    return held(spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), t=text).select(_k().alias("key"), "t")


PHRASES = """ph AS (SELECT p_partkey AS key, concat_ws(' ', 'Maison', CAST(40 + (p_partkey * 3) % 200 AS VARCHAR), 'm²',
  CAST(150 + (p_partkey * 7) % 500 AS VARCHAR) || ([' ', chr(160), chr(8239), chr(8201)])[p_partkey % 4 + 1] || lpad(CAST((p_partkey * 13) % 10 * 100 AS VARCHAR), 3, '0') || ' €',
  (['FAI', 'hors honoraires', '', 'honoraires à la charge de l''acquéreur'])[p_size % 4 + 1], ',', CAST(1 + p_size % 9 AS VARCHAR), 'pièces,', CAST(1 + p_size % 5 AS VARCHAR), 'chambres, terrain',
  CAST(200 + (p_partkey * 17) % 800 AS VARCHAR), 'm2,', (['belle terrasse', 'sans piscine', 'avec piscine', 'garage double', 'pas de terrasse', 'lumineuse'])[p_partkey % 6 + 1], ',',
  (['à rénover', 'rénovée en bon état', 'neuve', 'travaux à prévoir', 'lumineuse'])[p_partkey % 5 + 1], ',', (['DPE : C', 'classe énergétique D', '', 'DPE G'])[p_size % 4 + 1]) AS t, p_partkey, p_size FROM part),
  n AS (SELECT *, replace(replace(replace(t, chr(160), ' '), chr(8239), ' '), chr(8201), ' ') AS u FROM ph)"""


@query("price_parse", f"WITH {PHRASES} SELECT key, CAST(replace(regexp_extract(u, '(\\d[\\d ]{{2,}})\\s*€', 1), ' ', '') AS INT) AS price FROM n")
def price_parse(spark, d):
    return phrases(spark, d).select("key", T.price(F.col("t")).alias("price"))


@query("fees", f"WITH {PHRASES} SELECT key, CASE p_size % 4 WHEN 0 THEN true WHEN 2 THEN NULL ELSE false END AS fees FROM n")
def fees(spark, d):
    return phrases(spark, d).select("key", T.fees_included(F.col("t")).alias("fees"))


@query("area_parse", f"WITH {PHRASES}, v AS (SELECT key, CAST(40 + (p_partkey * 3) % 200 AS DOUBLE) AS a FROM n) SELECT key, CASE WHEN a BETWEEN 20 AND 1000 THEN a END AS area FROM v")
def area_parse(spark, d):
    return phrases(spark, d).select("key", T.area_m2(F.col("t")).alias("area"))


@query("land_parse", f"WITH {PHRASES} SELECT key, CAST(regexp_extract(u, 'terrain (\\d+) m2', 1) AS DOUBLE) AS land FROM n")
def land_parse(spark, d):
    return phrases(spark, d).select("key", T.land_m2(F.col("t")).alias("land"))


@query("rooms_parse", f"WITH {PHRASES} SELECT key, CAST(regexp_extract(u, '(\\d+) pièces', 1) AS INT) AS rooms, CAST(regexp_extract(u, '(\\d+) chambres', 1) AS INT) AS bedrooms FROM n")
def rooms_parse(spark, d):
    return phrases(spark, d).select("key", T.rooms(F.col("t")).alias("rooms"), T.bedrooms(F.col("t")).alias("bedrooms"))


_FEAT = lambda word: f"CASE WHEN regexp_matches(u, '(sans|pas de) {word}') THEN false WHEN regexp_matches(u, '{word}') THEN true END"


@query("features", f"WITH {PHRASES} SELECT key, {_FEAT('terrasse')} AS terrace, {_FEAT('piscine')} AS pool, {_FEAT('garage')} AS garage FROM n")
def features(spark, d):
    return phrases(spark, d).select("key", *[T.feature(F.col("t"), n).alias(n) for n in ("terrace", "pool", "garage")])


@query("condition", f"WITH {PHRASES} SELECT key, (['needs_work', 'renovated,good_state', 'recent', 'needs_work', ''])[p_partkey % 5 + 1] AS condition FROM n")
def condition(spark, d):
    return phrases(spark, d).select("key", T.condition_hint(F.col("t")).alias("condition"))


@query("dpe", f"WITH {PHRASES} SELECT key, (['C', 'D', '', 'G'])[p_size % 4 + 1] AS dpe FROM n")
def dpe(spark, d):
    return phrases(spark, d).select("key", T.dpe(F.col("t")).alias("dpe"))


_SLUG = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'), '^ +| +$', '', 'g'))"


#: Letters without a base form are separators, whatever strip_accents makes of them.
_NO_BASE = "regexp_replace(coalesce(text, ''), '[ßẞœŒæÆøØłŁ]', ' ', 'g')"


@query("slug", f"SELECT doc_id, {_SLUG.format(_NO_BASE)} AS slug FROM documents")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("shingles", f"""WITH w AS (SELECT p_partkey, list_filter(string_split({_SLUG.format("p_name || ' ' || p_type || ' ' || p_brand")}, ' '), lambda x: x <> '') AS w FROM part)
  SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) ELSE w END)), '|') AS s FROM w""")
def shingles(spark, d):
    s = T.shingles(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(s), "|").alias("s"))


@query("formatters", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE replace(format('{:,}', CAST(p_size * 12345 AS BIGINT)), ',', ' ') || ' €' END AS eur, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS num, CASE WHEN p_size > 5 THEN round(p_size * 1000.0::DOUBLE / (p_size + 3)) END AS per_m2 FROM part")
def formatters(spark, d):
    return table(spark, d, "part").select("p_partkey", T.eur(F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 12345)).alias("eur"), T.plain_number(F.col("p_size") / 2).alias("num"), T.price_per_m2(F.when(F.col("p_size") > 5, F.col("p_size") * 1000.0), F.col("p_size") + 3).alias("per_m2"))


@query("condition_labels", "SELECT p_partkey, (['à rénover, neuf', 'neuf', 'x', ''])[p_partkey % 4 + 1] AS labels, (['nouveau', 'визит', 'autre', 'nouveau'])[p_partkey % 4 + 1] AS label FROM part")
def condition_labels(spark, d):
    codes = F.element_at(F.array(*map(F.lit, ["needs_work,recent", "recent", "x", ""])), (_k() % 4 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, ["new", "visit", "autre", "new"])), (_k() % 4 + 1).cast("int"))
    tables = {"fr": {"new": "nouveau"}, "ru": {"new": "новый", "visit": "визит"}}
    return table(spark, d, "part").select("p_partkey", T.condition_labels(codes, {"needs_work": "à rénover", "recent": "neuf"}).alias("labels"), T.label(code, "fr", tables).alias("label"))


@query("commune_mentions", "SELECT p_partkey, (['macon', 'saint point', 'cluny', 'hurigny'])[p_partkey % 4 + 1] AS first FROM part")
def commune_mentions(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["Maison sur la commune de Mâcon.", "Au village de Saint-Point, maison.", "Villa située à Cluny, calme.", "HURIGNY – Chalet suisse"])), (_k() % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.element_at(T.commune_mentions(text), 1).alias("first"))


# -- pages -----------------------------------------------------------------------------------------


@query("page_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("html_text_native", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_text_native(spark, d):
    return table(spark, d, "pages").select("page_id", H.text_of(F.col("html"), decoded=False).alias("body"))


@query("html_text")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.text_of(H.own_section(F.col("html"))).alias("body"))


@query("own_section", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2500 ELSE 1500 + 17 + 300 END AS n FROM pages")
def own_section(spark, d):
    page = F.concat(F.repeat(F.lit("x"), F.when(F.col("page_id") % 2 == 0, 2500).otherwise(1500)), F.lit("Biens  similaires"), F.repeat(F.lit("y"), F.lit(300)))
    return table(spark, d, "pages").select("page_id", F.length(H.own_section(page)).alias("n"))


def _page(spark, d):
    """Synthetic listing pages from part: og: tags, images and JSON-LD."""
    k = _k().cast("string")
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat(F.lit("Maison "), k).alias("name"), F.struct((100000 + _k() * 10).cast("string").alias("price")).alias("offers"), F.struct((50 + _s()).alias("value")).alias("floorSize"), F.array(F.concat(F.lit("https://cdn.example.org/"), k, F.lit(".jpg"))).alias("image"), F.struct(F.lit("Cluny").alias("addressLocality"), F.lit("71250").alias("postalCode")).alias("address")))
    wrapped = F.when(_k() % 3 == 0, F.concat(F.lit('{"@graph":['), ld, F.lit("]}"))).when(_k() % 3 == 1, F.concat(F.lit("["), ld, F.lit("]"))).otherwise(ld)
    html = F.concat(
        F.lit('<html><head><meta property="og:title" content="Maison '), k, F.lit(' | Portail"><meta content="second" name="og:title"><meta property="og:image" content="https://cdn.example.org/a-'), k, F.lit('.jpg"><script type="application/ld+json">'), wrapped,
        F.lit('</script></head><body><img src="/img/b-'), k, F.lit('.png"><img src="//cdn.example.org/c.webp?w=2"><img src="https://x.example.org/logo.png"><p>'), F.repeat(F.lit("Une belle maison au calme. "), F.lit(6)), F.lit("</p></body></html>"),
    )
    url = F.concat(F.lit("https://www.example.org/annonces/vente-maison-t"), (1 + _s() % 6).cast("string"), F.lit("-cluny-71250-"), k)
    return held(spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), url=url, html=html).select("p_partkey", "url", "html")


@query("meta_tags", "SELECT p_partkey, 'Maison ' || CAST(p_partkey AS VARCHAR) || ' | Portail' AS first, 'second' AS last, 'Maison ' || CAST(p_partkey AS VARCHAR) AS title FROM part")
def meta_tags(spark, d):
    p = _page(spark, d)
    first = F.element_at(H.meta_tags(F.col("html")), "og:title")
    return p.select("p_partkey", first.alias("first"), F.element_at(H.meta_tags(F.col("html"), last_wins=True), "og:title").alias("last"), H.clean_title(first).alias("title"))


@query("image_urls", "SELECT p_partkey, 'https://cdn.example.org/a-' || CAST(p_partkey AS VARCHAR) || '.jpg https://www.example.org/img/b-' || CAST(p_partkey AS VARCHAR) || '.png https://cdn.example.org/c.webp?w=2' AS urls FROM part")
def image_urls(spark, d):
    return _page(spark, d).select("p_partkey", F.array_join(H.image_urls(F.col("html"), F.col("url")), " ").alias("urls"))


@query("description_block", "SELECT p_partkey, rtrim(repeat('Une belle maison au calme. ', 6)) AS about FROM part")
def description_block(spark, d):
    return _page(spark, d).select("p_partkey", H.description(F.col("html")).alias("about"))


@query("jsonld_extract", "SELECT p_partkey, CAST(100000 + p_partkey * 10 AS INT) AS price, CAST(50 + p_size AS DOUBLE) AS area, 'Cluny' AS city, '71250' AS postcode, 'https://cdn.example.org/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image FROM part")
def jsonld_extract(spark, d):
    b = _page(spark, d).withColumn("b", H.ld_listing_block(H.ld_blocks(F.col("html"))))
    a = H.ld_address(F.col("b"))
    return b.select("p_partkey", H.ld_price(F.col("b")).alias("price"), H.ld_area(F.col("b")).alias("area"), a["city"].alias("city"), a["postcode"].alias("postcode"), F.array_join(H.ld_images(F.col("b")), " ").alias("image"))


@query("listing_pages")
def listing_pages(spark, d):
    """Pages of two sources through their adapters."""
    p = _page(spark, d).select(F.when(_k() % 2 == 0, "jsonld").otherwise("urlmeta").alias("source"), "url", "html")
    return sources.parsed(p).select("key", "source", "url", "title", "price", "area_m2", "rooms", "commune_name", "postcode", "photos")


@query("url_fields", "SELECT p_partkey, CAST(1 + p_size % 6 AS VARCHAR) AS rooms, 'Cluny' AS commune, '71250' AS postcode FROM part")
def url_fields(spark, d):
    u = H.listing_url_fields(F.col("url"), r"/vente-(\w+)-t(\d+)-([a-z-]+)-(\d{5})-(\w+)", ["kind", "rooms", "commune", "postcode", "id"])
    return _page(spark, d).select("p_partkey", u["rooms"].alias("rooms"), H.commune_from_slug(u["commune"]).alias("commune"), u["postcode"].alias("postcode"))


@query("data_layer", "SELECT p_partkey, CAST(100000 + p_partkey AS INT) AS price, CAST(p_size % 9 AS INT) AS rooms FROM part")
def data_layer(spark, d):
    html = F.concat(F.lit("<script>dataLayer = [{'prix':'"), (100000 + _k()).cast("string"), F.lit("','nbpces':'"), ((_s() % 9) * 10).cast("string"), F.lit("','id':'"), _k().cast("string"), F.lit("'}];</script>"))
    p = table(spark, d, "part").select(html.alias("html"), F.lit("u").alias("url"))
    return sources.data_layer_listings(p).select(F.col("source_id").cast("long").alias("p_partkey"), "price", "rooms")


@query("search_urls", "SELECT 'https://www.example.org/' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0') || '?page=' || CAST(page AS VARCHAR) AS url FROM supplier, range(1, 4) p(page) WHERE s_suppkey < 96")
def search_urls(spark, d):
    """Departments are the suppliers with a number of two digits."""
    departments = table(spark, d, "supplier").where("s_suppkey < 96").select(F.lpad(F.col("s_suppkey").cast("string"), 2, "0").alias("dept"))
    return sources.search_pages(departments, "https://www.example.org/%s?page=%d", 3)


@query("spec_number", "SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(p_size AS DOUBLE) END AS v, CAST(45000 + p_size * 1000 AS INT) AS amount FROM part")
def spec_number(spark, d):
    text = F.concat(F.lit("Surface habitable : "), _s().cast("string"), F.lit(" m. Prix 12 000 puis "), (45 + _s()).cast("string"), F.lit(" 000"))
    return table(spark, d, "part").select("p_partkey", H.spec_number(text, "surface habitable").alias("v"), H.first_amount(text, 40_000, 2_000_000).alias("amount"))


# -- portal forms ------------------------------------------------------------------------------------

_HTML = """<meta property="og:title" content="{title}"><meta property="og:description" content="{about}"><title>{title} - ParuVendu</title><meta name="description" content="maison de {area}m2 au prix de {price} 000€">
<script>setTargeting('nbpces', ['{rooms}0'])</script><p>Une maison de {area} m² au calme. Vue sur les vignes. Jardin clos. Terrain de 2 500 m². Chauffage au bois. Garage double. Prix {price} 000 €</p>
https://abc.cloudimg.io/v7/{key}-00000000?ci_sign=1 https://cdn.safti.fr/bien-photo/1/{key}/0a0b0c0d/rn.jpg https://cdn.example.org/{key}-a.jpg?w=10 https://cdn.example.org/{key}-a.jpg?w=20"""
_URLS = ["https://www.orpi.com/annonce-vente-maison-t4-saint-amour-71570-{key}-00000000", "https://www.safti.fr/annonces/achat/maison/saint-amour-71570/{key}", "https://www.laforet.com/agence-immobiliere/macon/acheter/saint-amour/maison-4-pieces-{key}", "https://www.century21.fr/trouver_logement/detail/{key}/", "https://www.paruvendu.fr/immobilier/vente/maison/{key}A"]
_FORMS = ["orpi", "safti", "laforet", "century21", "paruvendu"]


def _filled(template: str, **values) -> Column:
    """A template with columns in its places."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _portal_pages(spark, d):
    price, area, rooms, key = 100 + _k() % 900, 60 + _k() % 90, 1 + _s() % 9, 10_000_000 + _k()
    title = F.concat(F.lit("Maison à vendre - "), rooms.cast("string"), F.lit(" pièces - "), area.cast("string"), F.lit(" m2 - Saint Amour - 71 - "), price.cast("string"), F.lit(" 000 €"))
    at = (_k() % 5 + 1).cast("int")
    url = F.replace(F.element_at(F.array(*map(F.lit, _URLS)), at), F.lit("{key}"), key.cast("string"))
    html = _filled(_HTML, title=title, about=F.lit("court"), area=area, price=price, rooms=rooms, key=key)
    source = F.element_at(F.array(*map(F.lit, _FORMS)), at)
    return held(spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), source=source, url=url, html=html).select("p_partkey", "source", "url", "html")


@query("portal_listings", """WITH p AS (SELECT *, CAST((100 + p_partkey % 900) * 1000 AS INT) AS price, 60 + p_partkey % 90 AS area, CAST(1 + p_size % 9 AS INT) AS rooms, CAST(10000000 + p_partkey AS VARCHAR) AS k, p_partkey % 5 AS f FROM part)
  SELECT (['orpi', 'safti', 'laforet', 'century21', 'paruvendu'])[f + 1] AS source, (['orpi', 'safti', 'laforet', 'century21', 'paruvendu'])[f + 1] || '/' || k AS page, CASE f WHEN 0 THEN k || '-00000000' WHEN 4 THEN '' ELSE k END AS source_id, price, CAST(area AS DOUBLE) AS area_m2, CASE WHEN f = 0 THEN 4 ELSE rooms END AS rooms,
    CASE f WHEN 4 THEN '' ELSE 'Saint Amour' END AS commune_name, CASE WHEN f < 2 THEN '71570' ELSE '' END AS postcode, CASE f WHEN 0 THEN 'https://abc.cloudimg.io/v7/' || k || '-00000000?ci_sign=1' WHEN 1 THEN 'https://cdn.safti.fr/bien-photo/1/' || k || '/0a0b0c0d/rn.jpg'
      WHEN 2 THEN 'https://cdn.safti.fr/bien-photo/1/' || k || '/0a0b0c0d/rn.jpg https://cdn.example.org/' || k || '-a.jpg?w=10' WHEN 3 THEN 'https://cdn.safti.fr/bien-photo/1/' || k || '/0a0b0c0d/rn.jpg https://cdn.example.org/' || k || '-a.jpg?w=10' ELSE '' END AS photos FROM p""")
def portal_listings(spark, d):
    """Pages of five portals in one scan."""
    found = portals.portal_listings(_portal_pages(spark, d).select("source", "url", "html"))
    page = F.concat(F.col("source"), F.lit("/"), F.regexp_extract("url", r"(\d{8})", 1))
    return found.select("source", page.alias("page"), "source_id", "price", "area_m2", "rooms", "commune_name", "postcode", F.array_join("photos", " ").alias("photos"))


@query("portal_links", """WITH l AS (SELECT s_suppkey AS s, i, i // 2 AS half, (s_suppkey + i * i) % 3 = 0 AS house FROM supplier, range(4) t(i)), h AS (SELECT s, half, bool_or(house) AS any_house FROM l GROUP BY s, half)
  SELECT 'https://www.century21.fr/trouver_logement/detail/' || CAST(1000000 + l.s * 10 + l.i AS VARCHAR) || '/' AS url FROM l JOIN h USING (s, half) WHERE any_house""")
def portal_links(spark, d):
    """Search pages of four links: two near each other, two beyond the reach of those; what is kept is written beside it or its neighbour."""
    s = F.col("s_suppkey")
    link = lambda i: [F.lit("<a href='/trouver_logement/detail/"), (1_000_000 + s * 10 + i).cast("string"), F.lit("/'>"), F.when((s + i * i) % 3 == 0, "Maison").otherwise("Garage"), F.lit("</a>"), F.lit("." * (1300 if i == 1 else 5))]
    pages = table(spark, d, "supplier").select(F.lit("century21").alias("source"), F.concat(*[c for i in range(4) for c in link(i)]).alias("html"))
    return portals.portal_links(pages).select("url")


@query("notary_listings", "SELECT 'https://n.example.org/' || CAST(p_partkey AS VARCHAR) AS url, CAST((100 + p_partkey % 200) * 1000 AS INT) AS price, CAST(50 + p_size AS DOUBLE) AS area_m2, CAST(1 + p_size % 7 AS INT) AS bedrooms, 'Mâcon' AS commune_name FROM part WHERE p_size % 4 <> 0 AND (100 + p_partkey % 200) * 1000 <= 1.15::DOUBLE * 200000 AND 1 + p_size % 7 >= 2")
def notary_listings(spark, d):
    item = F.to_json(F.struct(F.when(_s() % 4 == 0, "APP").otherwise("MAI").alias("typeBien"), F.lit("VENTE").alias("typeTransaction"), ((100 + _k() % 200) * 1000).alias("prixAffiche"), (1 + _s() % 7).alias("nbChambres"), (50 + _s()).alias("surface"), F.lit("MACON").alias("localiteNom"), F.concat(F.lit("https://n.example.org/"), _k().cast("string")).alias("urlDetailAnnonceFr")))
    bodies = table(spark, d, "part").select(F.concat(F.lit('{"annonceResumeDto":['), item, F.lit("]}")).alias("body"))
    return portals.notary_listings(bodies, 200_000, 2).select("url", "price", "area_m2", "bedrooms", "commune_name")
