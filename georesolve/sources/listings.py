"""Listing sources: a registry of adapters from pages or API records to listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators.resolution import known
from ..operators.store import listing_key
from .portals import portal_listings

#: Adapters by source: pages (url, html) to listings.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def add(adapter: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        ADAPTERS[name] = adapter
        return adapter

    return add


def parsed(pages: DataFrame) -> DataFrame:
    """Listings of all registered sources: pages (source, url, html) go to their source's adapter.

    The portals that have a form are read in one scan; an adapter of its own takes a scan.
    """
    out = portal_listings(pages)
    for name, adapter in sorted(ADAPTERS.items()):
        rows = adapter(pages.where(F.col("source") == name).select("url", "html"))
        rows = rows.withColumn("source", F.lit(name)).withColumn("key", listing_key(F.col("source"), F.col("source_id"), F.col("url")))
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def search_urls(spark: SparkSession, template: str, departments: list[str], pages: int) -> DataFrame:
    """url of each search page: departments by pages."""
    return search_pages(spark.createDataFrame([(x,) for x in departments], "dept string"), template, pages)


def search_pages(departments: DataFrame, template: str, pages: int) -> DataFrame:
    """url of each search page of departments (dept)."""
    return departments.select("dept", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page")).select(F.format_string(template, "dept", "page").alias("url"))


def text_fields(text: Column) -> dict[str, Column]:
    """What every adapter reads from a listing's text."""
    return {
        "price_text": T.price(text),
        "fees_included": T.fees_included(text),
        "area_text": T.area_m2(text),
        "land_m2": T.land_m2(text),
        "rooms": T.rooms(text),
        "bedrooms": T.bedrooms(text),
        "dpe": T.dpe(text),
        **{f"has_{n}": T.feature(text, n) for n in T.FEATURES},
        "condition_hint": T.condition_hint(text),
    }


@register("jsonld")
def from_jsonld(pages: DataFrame) -> DataFrame:
    """Listings from JSON-LD, with what it lacks taken from the page's text; pages without price and area are none."""
    p = pages.withColumn("block", H.ld_listing_block(H.ld_blocks(F.col("html")))).withColumn("page_text", H.text_of(F.col("html")))
    name, about = F.coalesce(F.get_json_object("block", "$.name"), F.lit("")), F.coalesce(F.get_json_object("block", "$.description"), F.lit(""))
    p = p.withColumn("title", F.left(name, F.lit(300))).withColumn("about", about)
    p = p.withColumn("body", F.when(F.col("about") != "", F.concat_ws(" ", "title", "about")).otherwise(F.left("page_text", F.lit(4000))))
    body, whole = text_fields(F.col("body")), text_fields(F.col("page_text"))
    both = {n: F.coalesce(known(body[n]) if n in ("rooms", "bedrooms") else body[n], whole[n]) for n in ("fees_included", "land_m2", "rooms", "bedrooms")}
    price = F.coalesce(known(H.ld_price(F.col("block"))), whole["price_text"])
    area = F.coalesce(known(H.ld_area(F.col("block"))), body["area_text"], whole["area_text"])
    photos = H.ld_images(F.col("block"))
    address = H.ld_address(F.coalesce("block", F.lit("{}")))
    lat, lon = (F.get_json_object("block", f"$.geo.{k}").try_cast("double") for k in ("latitude", "longitude"))
    out = p.select(
        "url",
        F.coalesce(*[F.get_json_object("block", f"$['{k}']") for k in ("sku", "productID", "@id")], F.lit("")).alias("source_id"),
        F.when(F.col("title") != "", F.col("title")).otherwise(F.left("page_text", F.lit(120))).alias("title"),
        F.when(F.col("about") != "", F.col("about")).otherwise(F.left("page_text", F.lit(2000))).alias("description"),
        price.alias("price"),
        area.alias("area_m2"),
        *[c.alias(n) for n, c in both.items()],
        F.coalesce(F.nullif(body["dpe"], F.lit("")), whole["dpe"]).alias("dpe"),
        *[body[f"has_{n}"].alias(f"has_{n}") for n in T.FEATURES],
        body["condition_hint"].alias("condition_hint"),
        address["city"].alias("commune_name"),
        address["postcode"].alias("postcode"),
        address["street"].alias("address"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.when(known(lat).isNotNull() & known(lon).isNotNull(), "address").otherwise("none").alias("geo_precision"),
        F.slice(F.when(F.size(photos) > 0, photos).otherwise(H.image_urls(F.col("html"), F.col("url"))), 1, 12).alias("photos"),
    )
    return out.where("price is not null or area_m2 is not null")


def from_meta(pages: DataFrame, url_pattern: str, url_names: list[str], head: int | None = None, last_wins: bool = False) -> DataFrame:
    """Listings of portals that state a listing in og: tags and in the URL, and describe it in the page."""
    p = pages.withColumn("own", H.own_section(F.col("html"))).withColumn("meta", H.meta_tags(F.col("html"), last_wins)).withColumn("u", H.listing_url_fields(F.col("url"), url_pattern, url_names))
    p = p.withColumn("title", H.clean_title(F.coalesce(F.try_element_at("meta", F.lit("og:title")), F.lit("")))).withColumn("page_text", H.text_of(F.col("own")))
    p = p.withColumn("about", F.coalesce(F.nullif(H.description(F.col("own")), F.lit("")), F.try_element_at("meta", F.lit("og:description")), F.lit(""))).withColumn("body", F.concat_ws(" ", "title", "about"))
    body, whole = text_fields(F.col("body")), text_fields(F.col("page_text"))
    field = lambda n: F.col(f"u.{n}") if n in url_names else F.lit(None).cast("string")
    area = F.coalesce(body["area_text"], H.spec_number(F.col("page_text"), "surface habitable"), whole["area_text"])
    land = F.coalesce(body["land_m2"], whole["land_m2"])
    return p.select(
        "url",
        F.coalesce(field("id"), F.lit("")).alias("source_id"),
        "title",
        F.col("about").alias("description"),
        F.coalesce(body["price_text"], whole["price_text"], H.first_amount(F.col("page_text"), 40_000, 2_000_000, head)).alias("price"),
        area.alias("area_m2"),
        T.land_plausible(land, area).alias("land_m2"),
        F.coalesce(field("rooms").try_cast("int"), body["rooms"], whole["rooms"]).alias("rooms"),
        F.coalesce(body["bedrooms"], whole["bedrooms"]).alias("bedrooms"),
        body["fees_included"].alias("fees_included"),
        F.coalesce(F.nullif(body["dpe"], F.lit("")), whole["dpe"]).alias("dpe"),
        *[body[f"has_{n}"].alias(f"has_{n}") for n in T.FEATURES],
        body["condition_hint"].alias("condition_hint"),
        H.commune_from_slug(field("commune")).alias("commune_name"),
        field("postcode").alias("postcode"),
        H.distinct_photos(H.image_urls(F.col("own"), F.col("url"))).alias("photos"),
    )


@register("urlmeta")
def url_and_meta(pages: DataFrame) -> DataFrame:
    """Portals whose URL reads .../<deal>-<kind>-<rooms>-pieces-<commune>-<postcode>-<id>."""
    return from_meta(pages, r"/(?:annonce-)?(?:vente|achat)-(\w+)-(?:t|f)?(\d+)?(?:-pieces?)?-?([a-z][a-z-]*?)-(\d{5})-([\w]+)", ["kind", "rooms", "commune", "postcode", "id"])


def api_listings(records: DataFrame, list_field: str, item_schema: str, where: Column, fields: dict[str, Column]) -> DataFrame:
    """Listings straight from an API's JSON lists (column body), without a page for each."""
    items = records.select(F.explode(F.from_json(F.get_json_object("body", f"$.{list_field}"), f"array<{item_schema}>")).alias("r"))
    return items.where(where).select(*[c.alias(n) for n, c in fields.items()])


def data_layer_listings(pages: DataFrame) -> DataFrame:
    """Listings of portals that state them in a dataLayer object; rooms are given tenfold."""
    p = pages.withColumn("d", H.data_layer(F.col("html"), "prix string, surface string, nbpces string, codepostal string, ville string, id string"))
    n = lambda c: F.col(f"d.{c}").try_cast("double")
    return p.where("d is not null").select("url", F.coalesce("d.id", F.lit("")).alias("source_id"), n("prix").cast("int").alias("price"), n("surface").alias("area_m2"), F.floor(n("nbpces") / 10).cast("int").alias("rooms"), F.col("d.codepostal").alias("postcode"), F.col("d.ville").alias("commune_name"))
