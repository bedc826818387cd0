"""Portal pages and search pages: a table of forms, applied in one scan of the pages.

Each form says where a portal states what: its page's address, og: tags, description block, scripts and
photo addresses. ``portal_listings`` and ``portal_links`` read the pages once and take, row by row, the
form of the row's source; pages of other sources, and pages without a price, give nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators.resolution import known, stated
from ..operators.store import listing_key

# Addresses, patterns and junk words of the portals' pages.
BLOCK_TAGS = "div|section|article|p"
JUNK = r"cookie|donn[ée]es personnelles|newsletter|RGPD|mentions l[ée]gales|frais de notaire|politique de confidentialit"
JUNK_SAFTI = JUNK + r"|partenaires utilisent|capacit[ée] d.emprunt"
JUNK_ORPI = r"informations recueillies|trait[ée]es par|RGPD|cookie|newsletter|d[ée]sabonn|politique de confidentialit|mentions l[ée]gales|capacit[ée] d.emprunt|frais de notaire|je m.inscris|communications commerciales"
JUNK_CENTURY = JUNK + r"|capacit[ée] d.emprunt|ventes?\s+priv[ée]es|avant-premi[èe]re|compl[ée]ter\s+le\s+profil|souhaite\s+[êe]tre\s+informé|actualit[ée]s|pixel\s+de\s+suivi|votre\s+compte|setAttribute|x-title|\$el\b|=>"
ORPI_URL = r"(?i)/annonce-(vente|location)-(maison|appartement|terrain|immeuble)-t(\d+)-([a-z0-9-]+?)-(\d{5})-([0-9a-f-]{8,})"
SAFTI_URL = r"(?i)/annonces/achat/(maison|appartement|terrain)/([a-z0-9-]+?)-(\d{5})/(\d+)"
LAFORET_URL = r"(?i)/agence-immobiliere/([a-z0-9-]+)/acheter/([a-z0-9-]+)/(maison|appartement|terrain|immeuble|local-commercial|fonds-de-commerce)[a-z0-9-]*-(\d{3,})"
CENTURY_URL = r"(?i)/trouver_logement/detail/(\d{6,})/?"
PARUVENDU_URL = r"(?i)/immobilier/vente/maison/(\d{8,}[A-Z0-9]+)"
ORPI_PRICE = "([\\d   ]{4,})\\s*€"
SAFTI_PRICE = "[\\d\\s   .]{4,}€"
CENTURY_PRICE = r"(?U)((?:\d{1,3}\s)?\d{3})\s*€"
CDN_SIGNED = r"""(?i)https://[a-z0-9.-]*cloudimg\.io/[^\s"'<>\\]+"""
CDN_BY_ID = r"""(?i)https://cdn\.safti\.fr/bien-photo/[\d/]+/([0-9a-f]{8,})/[^\s"'<>\\]+"""
RAW_PHOTO = r"""(?i)https://[^\s"'<>\\]+\.(?:jpe?g|webp)(?:\?[^\s"'<>\\]*)?"""
TAG_PHOTO = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
OWN_CDN = r"""(?i)https?://img\.paruvendu\.fr/[^\s"'<>\\]+\.(?:jpe?g|png|webp)"""
BAD_PHOTO = "logo|icon|avatar|placeholder|sprite|picto"
LEAST_PRICE, MOST_PRICE = 40_000, 2_000_000


def _unsized(extra: str) -> Callable[[Column], Column]:
    return lambda u: F.regexp_replace(u, rf"[?&](?:w|h|width|height{extra})=[^&]*", "")


def _has(text: Column, part: Column) -> Column:
    """Whether a text contains a part; any text an empty one."""
    return F.contains(text, F.coalesce(part, F.lit("")))


def _first_price(text: Column, pattern: str, high: int | None = None) -> Column:
    """The first price from LEAST_PRICE on (to high) among a pattern's matches."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), T.price)
    return F.try_element_at(F.filter(found, lambda v: (v >= LEAST_PRICE) & (v <= high if high else F.lit(True))), F.lit(1))


def _spec(text: Column, label: str) -> Column:
    value = F.regexp_extract(text, rf"(?iuU){label}\s*:?\s*(\d{{1,4}})", 1).try_cast("int")
    return F.when((value > 0) & (value < 2000), value)


def _url(pattern: str, group: int) -> Column:
    return F.regexp_extract("url", pattern, group)


def _targeted(name: str, value: str) -> Column:
    return F.regexp_extract("html", rf"setTargeting\('{name}',\s*\['({value})'\]\)", 1)


def _signed_photos() -> Column:
    urls = F.transform(F.regexp_extract_all("html", F.lit(CDN_SIGNED), F.lit(0)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    own = H.picked(urls, lambda u: u.contains("ci_sign=") & _has(u, _url(ORPI_URL, 6)), _unsized("|func|org_if_sml"), 10)
    image = F.try_element_at("meta", F.lit("og:image"))
    return F.when(F.size(own) > 0, own).when(F.coalesce(image, F.lit("")) != "", F.array(image)).otherwise(F.array().cast("array<string>"))


def _photos_by_id() -> Column:
    urls = F.transform(F.regexp_extract_all("html", F.lit(CDN_BY_ID), F.lit(0)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    listing = _url(SAFTI_URL, 4)
    return H.picked(urls, lambda u: (listing == "") | F.contains(u, F.concat(F.lit("/"), listing, F.lit("/"))), lambda u: F.regexp_extract(u, CDN_BY_ID, 1), 12)


def _raw_photos(bad: str, size: str, listing: Column | None = None, tags: bool = False) -> Column:
    urls = F.regexp_extract_all("html", F.lit(RAW_PHOTO), F.lit(0))
    if tags:
        urls = F.concat(urls, F.filter(F.regexp_extract_all("html", F.lit(TAG_PHOTO), F.lit(1)), lambda u: u.rlike(r"(?i)\.(jpe?g|webp|png)(\?|$)")))
    return H.picked(urls, lambda u: ~u.rlike(f"(?i){bad}") & (_has(u, listing) if listing is not None else F.lit(True)), _unsized(size), 12)


def _other_photos() -> Column:
    named = F.slice(H.image_urls(F.col("html"), F.col("url"), ["paruvendu", "photo", "annonce"]), 1, 12)
    return F.when(F.size(named) > 0, named).otherwise(F.slice(F.regexp_extract_all("html", F.lit(OWN_CDN), F.lit(0)), 1, 12))



@dataclass(frozen=True)
class Form:
    """Where a portal states what: functions of no argument that give Columns of the page's context.

    The context: url, html, meta, title (og:title), og (og:description), about, own (title and about), body
    (text of the page's own part), text (text of the whole page), described (the description's meta tag), and the
    areas area_title, area_own and area_body.
    """

    agency: str
    base: str
    link: str
    price: Callable[[], Column]
    photos: Callable[[], Column]
    junk: str = JUNK
    first_meta: bool = True
    meta_about_first: bool = False
    suffix: str = ""
    where: Callable[[], Column] = lambda: F.lit(True)
    fields: dict[str, Callable[[], Column]] = field(default_factory=dict)
    keep_link: Callable[[Column, Column], Column] = lambda link, window: F.lit(True)
    reach: int = 0


def _text_price() -> Column:
    return F.coalesce(T.price(F.col("title")), T.price(F.col("og")))


FORMS = {
    "orpi": Form(
        "Orpi", "https://www.orpi.com", r"(?<=href=[\"'])(?:https://www\.orpi\.com)?/annonce-[^\"'#?]+",
        price=lambda: T.price(F.coalesce(*[F.nullif(F.regexp_extract(t, ORPI_PRICE, 0), F.lit("")) for t in ("title", "og")])),
        photos=_signed_photos, junk=JUNK_ORPI, suffix=r"\s*\|\s*Orpi\s*$",
        fields={
            "source_id": lambda: _url(ORPI_URL, 6),
            "rooms": lambda: F.coalesce(known(_url(ORPI_URL, 3).try_cast("int")), T.rooms(F.col("own"))),
            "commune_name": lambda: H.commune_from_slug(_url(ORPI_URL, 4)),
            "postcode": lambda: _url(ORPI_URL, 5),
            "dpe": lambda: T.dpe(F.col("own")),
            "land_m2": lambda: T.land_plausible(F.coalesce(T.land_m2(F.col("own")), T.land_m2(F.col("body"))), F.coalesce("area_title", "area_own", "area_body")),
        },
        keep_link=lambda link, window: (F.lower(F.regexp_extract(link, ORPI_URL, 1)) == "vente") & F.lower(F.regexp_extract(link, ORPI_URL, 2)).isin("maison", "immeuble"),
    ),
    "safti": Form(
        "Safti", "https://www.safti.fr", SAFTI_URL[4:],
        price=lambda: F.coalesce(_text_price(), _first_price(F.left("body", F.lit(1500)), SAFTI_PRICE)),
        photos=_photos_by_id, junk=JUNK_SAFTI, suffix=r"\s*[|-]\s*SAFTI\s*$",
        fields={
            "source_id": lambda: _url(SAFTI_URL, 4),
            "area_m2": lambda: F.coalesce("area_title", _spec(F.col("body"), "Surface habitable").cast("double"), "area_own"),
            "bedrooms": lambda: F.coalesce(_spec(F.col("body"), "Chambres"), T.bedrooms(F.col("about"))),
            "commune_name": lambda: H.commune_from_slug(_url(SAFTI_URL, 2)),
            "postcode": lambda: _url(SAFTI_URL, 3),
        },
        keep_link=lambda link, window: F.lower(F.regexp_extract(link, SAFTI_URL, 1)) == "maison",
    ),
    "laforet": Form(
        "Laforêt", "https://www.laforet.com", LAFORET_URL[4:],
        price=lambda: F.coalesce(_text_price(), T.price(F.left("body", F.lit(2500)))),
        photos=lambda: _raw_photos("logo|icon|avatar|placeholder|sprite|agence|picto", "|size", _url(LAFORET_URL, 4)), first_meta=False, suffix=r"\s*[|-]\s*Laforêt.*$",
        fields={"source_id": lambda: _url(LAFORET_URL, 4), "commune_name": lambda: H.commune_from_slug(_url(LAFORET_URL, 2))},
        keep_link=lambda link, window: F.lower(F.regexp_extract(link, LAFORET_URL, 3)).isin("maison", "immeuble"),
    ),
    "century21": Form(
        "Century 21", "https://www.century21.fr", CENTURY_URL[4:],
        price=lambda: F.coalesce(_text_price(), _first_price(F.col("body"), CENTURY_PRICE, MOST_PRICE)),
        photos=lambda: _raw_photos(BAD_PHOTO + "|favicon|badge|marker", "|size|crop|quality", tags=True), junk=JUNK_CENTURY, first_meta=False, meta_about_first=True, suffix=r"(?i)\s*[|-]\s*CENTURY\s*21.*$",
        where=lambda: F.concat_ws(" ", "own", F.left("body", F.lit(600))).rlike(r"(?iuU)\bmaison\b"),
        fields={
            "source_id": lambda: _url(CENTURY_URL, 1),
            "commune_name": lambda: F.coalesce(F.nullif(T.commune_in_title(F.col("title")), F.lit("")), T.commune_in_capitals(F.col("title"), F.col("body"))),
        },
        keep_link=lambda link, window: window.rlike(r"(?iuU)\bMaison\b"), reach=1200,
    ),
    "paruvendu": Form(
        "ParuVendu", "https://www.paruvendu.fr", PARUVENDU_URL[4:],
        price=lambda: F.coalesce(F.regexp_extract("html", r"(?s)dataLayer\s*=\s*\[.*?['\"]gtm_var_prix['\"]\s*:\s*['\"]?(\d+)", 1).try_cast("int"), F.replace(F.regexp_extract("described", r"(\d[\d\s]*\d)\s*€", 1), F.lit(" "), F.lit("")).try_cast("int")),
        photos=_other_photos, suffix=r"(?i)\s*[-|].*paruvendu.*$",
        fields={
            "title": lambda: F.trim(H.decoded(F.regexp_extract("html", r"(?i)<title>([^<]+)</title>", 1))),
            "description": lambda: F.left(F.when(F.col("described") != "", F.col("described")).otherwise(F.col("title")), F.lit(2000)),
            "fees_included": lambda: F.lit(None).cast("boolean"),
            "area_m2": lambda: F.coalesce(_targeted("surfmax", r"\d+").try_cast("double"), F.regexp_extract("described", r"(\d+)\s*m[²2]", 1).try_cast("double")),
            "land_m2": lambda: T.land_m2(F.left("text", F.lit(3000))),
            "rooms": lambda: F.floor(_targeted("nbpces", r"\d+").try_cast("int") / 10).cast("int"),
            "bedrooms": lambda: T.bedrooms(F.concat_ws(" ", "title", F.left("text", F.lit(2000)))),
            "commune_name": lambda: F.regexp_extract("html", r"(?s)dataLayer\s*=\s*\[.*?['\"]gtm_lib_ville['\"]\s*:\s*['\"]([^'\"]*)", 1),
            "dpe": lambda: F.coalesce(stated(_targeted("DPE", "[A-G]")), T.dpe(F.left("text", F.lit(3000)))),
            "agency": lambda: F.coalesce(stated(F.left(F.trim(F.regexp_extract(F.left("text", F.lit(3000)), r"(?iuU)Agence immobilière\s*(?:à|:)\s*([A-Z][\w\s\-&]+?)(?:\s*\(|\s*$|\s*Agence)", 1)), F.lit(60))), F.lit("ParuVendu")),
            **{f"has_{n}": (lambda n=n: T.feature(F.left("text", F.lit(3000)), n)) for n in T.FEATURES},
            "condition_hint": lambda: T.condition_hint(F.left("text", F.lit(3000))),
        },
        keep_link=lambda link, window: window.rlike(r"(?U)\b[Mm]aison\b|\b[Vv]illa\b"), reach=2000,
    ),
}

#: What a form states of a field where it has no rule of its own.
FIELDS: dict[str, Callable[[], Column]] = {
    "source_id": lambda: F.lit(""),
    "description": lambda: F.col("about"),
    "fees_included": lambda: T.fees_included(F.col("own")),
    "area_m2": lambda: F.coalesce("area_title", "area_own", "area_body"),
    "land_m2": lambda: F.coalesce(T.land_m2(F.col("own")), T.land_m2(F.col("body"))),
    "rooms": lambda: F.coalesce(T.rooms(F.col("title")), T.rooms(F.col("own"))),
    "bedrooms": lambda: T.bedrooms(F.col("own")),
    "postcode": lambda: F.lit(""),
    "dpe": lambda: F.coalesce(stated(T.dpe(F.col("own"))), T.dpe(F.col("body"))),
    **{f"has_{n}": (lambda n=n: T.feature(F.col("own"), n)) for n in T.FEATURES},
    "condition_hint": lambda: T.condition_hint(F.col("own")),
}


def _of_source(of: Callable[[str, Form], Column]) -> Column:
    """of(name, form) of the row's source; null for other sources."""
    out = None
    for name, form in FORMS.items():
        out = F.when(F.col("source") == name, of(name, form)) if out is None else out.when(F.col("source") == name, of(name, form))
    return out


def _field(name: str, default: Callable[[], Column]) -> Column:
    """A field by the rule of the row's form; the default, once, for all forms without a rule."""
    out = None
    for source, form in FORMS.items():
        if name in form.fields:
            value = form.fields[name]()
            out = F.when(F.col("source") == source, value) if out is None else out.when(F.col("source") == source, value)
    return default() if out is None else out.otherwise(default())


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that later ones refer to by name: the generator keeps the optimizer from copying their expressions into each of those."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def portal_listings(pages: DataFrame) -> DataFrame:
    """Listings of pages (source, url, html) of the portals in FORMS."""
    p = pages.where(F.col("source").isin(list(FORMS))).select("source", "url", F.coalesce("html", F.lit("")).alias("html"))
    first = F.col("source").isin([n for n, f in FORMS.items() if f.first_meta])
    p = _held(p, meta=F.when(first, H.meta_tags(F.col("html"))).otherwise(H.meta_tags(F.col("html"), last_wins=True, either_order=False)), own_html=H.own_section(F.col("html")))
    of_meta = lambda name: F.coalesce(F.try_element_at("meta", F.lit(name)), F.lit(""))
    p = _held(p, title0=of_meta("og:title"), og0=of_meta("og:description"), described0=F.regexp_extract("html", r"""(?i)<meta[^>]+name="description"[^>]+content="([^"]+)\"""", 1), block=_of_source(lambda n, f: H.description(F.col("own_html"), BLOCK_TAGS, junk=f.junk)))
    p = _held(p, title1=H.decoded(F.col("title0")), og=H.decoded(F.col("og0")), described=H.decoded(F.col("described0")), text=H.text_of(F.col("html")), body=H.text_of(F.col("own_html")))
    meta_first = F.col("source").isin([n for n, f in FORMS.items() if f.meta_about_first])
    og, block = stated(F.col("og")), stated(F.col("block"))
    p = _held(p, about=F.coalesce(F.when(meta_first, og), block, og, F.lit("")), title=_field("title", lambda: F.col("title1")))
    p = _held(p, own=F.concat_ws(" ", "title", "about"))
    areas = {f"area_{c}": T.area_m2(F.col(c)) for c in ("title", "own", "body")}
    p = _held(p, price=_of_source(lambda n, f: known(f.price())), commune_name=_field("commune_name", lambda: F.lit("")), wanted=_of_source(lambda n, f: f.where()), **areas)
    p = p.where("price is not null and wanted")
    stripped = F.trim(_of_source(lambda n, f: F.regexp_replace("title", f.suffix, "")))
    titled = F.when((stripped == "") & F.col("source").isin("safti", "laforet"), F.concat(F.lit("Maison "), F.col("commune_name"))).otherwise(stripped)
    rest = {n: _field(n, default) for n, default in FIELDS.items()}
    out = p.select("source", "url", titled.alias("title"), "price", "commune_name", _field("agency", lambda: _of_source(lambda n, f: F.lit(f.agency))).alias("agency"), *[c.alias(n) for n, c in rest.items()], _of_source(lambda n, f: f.photos()).alias("photos"))
    return out.withColumn("key", listing_key(F.col("source"), F.col("source_id"), F.col("url")))


def portal_links(pages: DataFrame) -> DataFrame:
    """source, url: the listing pages that search pages (source, html) of the portals lead to, each once."""
    p = pages.where(F.col("source").isin(list(FORMS))).select("source", F.coalesce("html", F.lit("")).alias("html"))
    found = p.select("source", F.explode(_of_source(lambda n, f: H.around(F.col("html"), f"(?i){f.link}", f.reach))).alias("l")).select("source", "l.*")
    # A portal's first mention of a listing decides, by its surroundings, where a form looks at them.
    address = _of_source(lambda n, f: F.concat(F.lit(f"{f.base}/trouver_logement/detail/"), F.regexp_extract("link", CENTURY_URL, 1), F.lit("/")) if n == "century21" else F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(f.base), F.col("link"))))
    return found.where(_of_source(lambda n, f: f.keep_link(F.col("link"), F.col("window")))).select("source", address.alias("url")).distinct()


NOTARY_ITEM = "struct<typeBien:string,typeTransaction:string,prixAffiche:string,nbChambres:string,nbPieces:string,surface:string,surfaceTerrain:string,descriptionFr:string,communeNom:string,localiteNom:string,urlPhotoPrincipale:string,urlDetailAnnonceFr:string>"


def notary_listings(bodies: DataFrame, max_price: float, min_bedrooms: int) -> DataFrame:
    """Listings of an API's JSON bodies (column body): houses for sale within reach, without a page for each."""
    items = bodies.select(F.explode(F.from_json(F.get_json_object("body", "$.annonceResumeDto"), f"array<{NOTARY_ITEM}>")).alias("a")).select("a.*")
    number = lambda c: F.col(c).try_cast("double")
    price, beds = number("prixAffiche").cast("int"), number("nbChambres").cast("int")
    wanted = (F.col("typeBien") == "MAI") & F.col("typeTransaction").isin("VENTE", "VNI") & (price > 0) & (price <= max_price * 1.15) & (beds.isNull() | (beds >= min_bedrooms)) & (F.coalesce("urlDetailAnnonceFr", F.lit("")) != "")
    about = F.coalesce("descriptionFr", F.lit(""))
    title = F.left(F.substring_index(about, "\n", 1), F.lit(120))
    p = items.where(wanted).withColumns({"title": title, "about": about}).withColumn("own", F.concat_ws(" ", "title", "about"))
    photo = F.coalesce("urlPhotoPrincipale", F.lit(""))
    out = p.select(
        F.lit("notaires").alias("source"),
        F.col("urlDetailAnnonceFr").alias("url"),
        "title",
        F.col("about").alias("description"),
        price.alias("price"),
        known(number("surface")).alias("area_m2"),
        known(number("surfaceTerrain")).alias("land_m2"),
        F.coalesce(known(number("nbPieces").cast("int")), T.rooms(F.col("own"))).alias("rooms"),
        F.coalesce(known(beds), T.bedrooms(F.col("own"))).alias("bedrooms"),
        F.coalesce(stated(F.col("communeNom")), F.replace(F.coalesce("localiteNom", F.lit("")), F.lit("MACON"), F.lit("Mâcon"))).alias("commune_name"),
        T.dpe(F.col("own")).alias("dpe"),
        *[T.feature(F.col("own"), n).alias(f"has_{n}") for n in T.FEATURES],
        T.condition_hint(F.col("own")).alias("condition_hint"),
        F.lit("Notaire").alias("agency"),
        F.when(photo != "", F.array(photo)).otherwise(F.array().cast("array<string>")).alias("photos"),
    )
    return out.withColumn("key", listing_key(F.col("source"), F.lit(""), F.col("url")))
