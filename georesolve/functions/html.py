"""Listing pages: text, metadata, images, JSON-LD. Column expressions, but for entity decoding."""

from __future__ import annotations

import html as _html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import bound

# Markers and words that results depend on.
UNSEEN = r"(?is)<(script|style|noscript)[^>]*>.*?</\1>"
BLOCK_ENDS = r"(?i)<br\s*/?>|</p>|</div>|</li>"
OTHER_LISTINGS = (
    r"(?iuU)annonces?\s+similaires|biens?\s+similaires|nos\s+autres\s+biens|vous\s+pourriez\s+aussi\s+aimer"
    r"|autres\s+annonces|derni[èe]rement\s+consult[ée]|recherches\s+similaires|ces\s+biens\s+pourraient"
)
OWN_SECTION_LEAST = 2000
NOT_PHOTOS = ["logo", "icon", "sprite", "placeholder", "avatar", "pixel", "blank", "loader"]
LISTING_TYPES = ["realestatelisting", "product", "offer", "house", "residence", "singlefamilyresidence", "apartment", "accommodation"]
LD_BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
IMAGE = r"""(?i)(?:src|data-src|data-lazy|content)=["']([^"']+\.(?:jpe?g|png|webp)[^"']*)"""
LISTING_JUNK = ["cookie", "javascript", "navigateur", "mentions légales"]


def _python_functions():
    """Defined inside a function, so that workers get their code and need not have this package."""

    def decode(s: pd.Series) -> pd.Series:
        return s.fillna("").map(_html.unescape)

    def join(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b or "", h or "") for b, h in zip(base, href, strict=True)])

    return pandas_udf(decode, StringType()), pandas_udf(join, StringType())


#: HTML entities to text (Spark has no function for the full table of names), and URLs against their page's.
unescape, absolutize = _python_functions()


def text_of(html: Column, decoded: bool = True) -> Column:
    """Visible text: scripts and styles out, block ends as spaces, entities decoded before tags go."""
    body = F.regexp_replace(html, UNSEEN, " ")
    body = F.regexp_replace(body, BLOCK_ENDS, "\n")
    coded = body.contains("&")
    body = F.when(coded, unescape(F.when(coded, body))).otherwise(body) if decoded else body  # what Python decodes has entities
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"(?U)\s+", " "))


def own_section(html: Column) -> Column:
    """What precedes the first marker of other listings, if that lies deep enough in the page."""
    at = F.regexp_instr(html, F.lit(OTHER_LISTINGS))
    return F.when(at > OWN_SECTION_LEAST + 1, F.substring(html, F.lit(1), at - 1)).otherwise(html)


def image_urls(html: Column, base: Column | None = None, only: list[str] | None = None) -> Column:
    """Distinct photo URLs in order of appearance, without icons and the like."""
    found = F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1))
    if base is not None:
        origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
        folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
        scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
        found = F.transform(found, lambda u: F.when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(folder, u)))
    bad = "(?i)" + "|".join(NOT_PHOTOS)
    kept = F.filter(found, lambda u: ~u.rlike(bad))
    if only:
        kept = F.filter(kept, lambda u: F.lower(u).rlike("|".join(f"\\Q{p}\\E" for p in only)))
    return F.array_distinct(kept)


def picked(urls: Column, keep, key, most: int) -> Column:
    """The first URL of each key among those to keep, at most so many."""
    firsts = lambda kept: bound(F.transform(kept, key), lambda keys: F.filter(kept, lambda u, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))
    return F.slice(bound(F.filter(urls, keep), firsts), 1, most)


def decoded(text: Column) -> Column:
    """Text with its entities decoded, where it has any."""
    return F.when(text.contains("&"), unescape(F.when(text.contains("&"), text))).otherwise(text)


def photo_key(url: Column) -> Column:
    """A photo's identity: its URL without size parameters and query."""
    return F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), r"[-_/](?:\d{2,4}x\d{2,4}|w\d{2,4}|h\d{2,4})(?=[./_-])", "")


def distinct_photos(urls: Column, most: int = 12) -> Column:
    """The first URL of each photo, at most so many."""
    return picked(urls, lambda u: F.lit(True), photo_key, most)


def meta_tags(html: Column, last_wins: bool = False, either_order: bool = True) -> Column:
    """Map of og: and twitter: properties, in either order of attributes; the first value wins unless told otherwise."""
    names = r"((?:og|twitter):[\w:]+)"
    one = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(rf"""(?i)<meta[^>]+(?:property|name)=["']{names}["'][^>]+content=["']([^"']*)["']"""), F.lit(1)).alias("k"),
        F.regexp_extract_all(html, F.lit(rf"""(?i)<meta[^>]+(?:property|name)=["']{names}["'][^>]+content=["']([^"']*)["']"""), F.lit(2)).alias("v"),
    )
    two = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+(?:property|name)=["']{names}["']"""), F.lit(2)).alias("k"),
        F.regexp_extract_all(html, F.lit(rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+(?:property|name)=["']{names}["']"""), F.lit(1)).alias("v"),
    )
    all_pairs = F.concat(one, two) if either_order else one
    if last_wins:
        all_pairs = F.reverse(all_pairs)
    # Bound, as each element of a filter would work out again what its condition names.
    firsts = lambda pairs: bound(F.transform(pairs, lambda p: p["k"]), lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))
    return F.map_from_entries(bound(all_pairs, firsts))


def clean_title(title: Column) -> Column:
    """A page title without the portal's suffix."""
    return F.trim(F.regexp_replace(title, r"\s*[|–—]\s*[^|–—]*$", ""))


def description(html: Column, tag: str = "p", least: int = 120, most: int = 4000, junk: str | None = None) -> Column:
    """The longest block of a tag (or tags, as a|b) within bounds, without junk words and with enough full stops; the first of equals.

    A block ends at its first closing tag, so nested blocks are cut there. Entities are left as they are.
    """
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<({tag})\b[^>]*>(.*?)</\1>"), F.lit(2))
    blocks = F.transform(inner, lambda b: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(b, UNSEEN, " "), "<[^>]+>", " "), r"(?U)\s+", " ")))
    unwanted = "(?iu)" + (junk or "|".join(LISTING_JUNK))
    good = F.filter(blocks, lambda b: (F.length(b) > least) & (F.length(b) < most) & ~b.rlike(unwanted) & ((F.length(b) - F.length(F.translate(b, ".", ""))) >= F.length(b) / 400))
    first = lambda g: bound(F.array_max(F.transform(g, F.length)), lambda longest: F.try_element_at(F.filter(g, lambda b: F.length(b) == longest), F.lit(1)))
    return F.coalesce(bound(good, first), F.lit(""))


def listing_url_fields(url: Column, pattern: str, names: list[str]) -> Column:
    """A struct of a URL pattern's groups; empty groups are null."""
    return F.struct(*[F.nullif(F.regexp_extract(url, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def commune_from_slug(part: Column) -> Column:
    return F.initcap(F.translate(part, "-", " "))


def first_amount(text: Column, low: int, high: int, head: int | None = None) -> Column:
    """The first grouped number within bounds, for pages whose price has no currency sign near it."""
    text = F.left(text, F.lit(head)) if head else text
    found = F.transform(F.regexp_extract_all(text, F.lit("(?U)(\\d{1,3}(?:[\\s.]\\d{3}){1,2})"), F.lit(1)), lambda s: F.regexp_replace(s, r"(?U)[\s.]", "").try_cast("int"))
    return F.try_element_at(F.filter(found, lambda v: v.between(low, high)), F.lit(1))


def spec_number(text: Column, label: str, high: float = 2000) -> Column:
    """The number after a label of a specification table, above 0 and below high."""
    value = F.replace(F.regexp_extract(text, rf"(?iuU)\b{label}\W{{0,20}}?(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value > 0) & (value < high), value)


def around(html: Column, link: str, reach: int) -> Column:
    """Structs link, window of each occurrence of a link pattern: the page from reach characters before to reach after it.

    Windows follow from positions, so those of neighbouring links overlap and none is used up by another.
    """
    page = F.translate(html, "\x01\x02", "")
    parts = F.split(F.regexp_replace(page, f"({link})", "\x01$1\x02"), "\x01")

    def windows(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.length(F.translate(x, "\x02", "")))

        def one(i: Column) -> Column:
            found = F.substring_index(F.element_at(p, i + 1), "\x02", 1)
            start = F.aggregate(F.slice(sizes, 1, i), F.lit(1), lambda a, n: a + n)
            first = F.greatest(F.lit(1), start - reach)
            return F.struct(found.alias("link"), F.substring(page, first, start + F.length(found) + reach - first).alias("window"))

        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), one)).otherwise(F.array().cast("array<struct<link:string,window:string>>"))

    return F.element_at(F.transform(F.array(parts), windows), 1)


def data_layer(html: Column, schema: str) -> Column:
    """A page's dataLayer object, whose quotes may be single."""
    raw = F.regexp_extract(html, r"(?s)dataLayer\s*=\s*\[?\s*(\{.*?\})\s*\]?\s*;", 1)
    return F.from_json(F.translate(raw, "'", '"'), schema)


# -- JSON-LD ---------------------------------------------------------------------------------------


def ld_blocks(html: Column) -> Column:
    """Top-level JSON-LD objects as VARIANT, unreadable blocks left out; @graph and arrays opened two levels deep."""
    raw = F.transform(F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1)), lambda s: F.trim(s))
    level0 = F.flatten(F.transform(raw, _opened))
    level1 = F.flatten(F.transform(level0, _graph))
    return F.filter(level1, lambda s: s.startswith("{"))


def _opened(s: Column) -> Column:
    """A JSON text as an array of JSON texts: the elements of an array, or itself."""
    return F.when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(s))


def _graph(s: Column) -> Column:
    inner = F.get_json_object(s, "$.@graph")
    return F.when(inner.isNotNull(), F.concat(_opened(inner), F.array(s))).otherwise(F.array(s))


def ld_types(block: Column) -> Column:
    raw = F.coalesce(F.get_json_object(block, "$.@type"), F.get_json_object(block, "$.type"), F.lit(""))
    return F.transform(F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw)), F.lower)


def ld_price(block: Column) -> Column:
    """offers.price, offers.lowPrice, price; of an array its first, of an object its price."""
    options = []
    for path in ("offers.price", "offers[0].price", "offers.lowPrice", "price[0]", "price.price", "price"):
        raw = F.get_json_object(block, f"$.{path}")
        options.append(F.replace(F.translate(raw, " ", ""), F.lit(","), F.lit(".")).try_cast("double").cast("int"))
    return F.coalesce(*options)


def ld_area(block: Column) -> Column:
    options = [F.get_json_object(block, f"$.{k}.{v}") for k in ("floorSize", "size") for v in ("value", "maxValue")]
    return F.replace(F.coalesce(*options), F.lit(","), F.lit(".")).try_cast("double")


def ld_images(block: Column) -> Column:
    raw = F.coalesce(F.get_json_object(block, "$.image"), F.get_json_object(block, "$.photo"))
    many = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    url = lambda s: F.when(s.startswith("{"), F.coalesce(F.get_json_object(s, "$.url"), F.get_json_object(s, "$.contentUrl"))).otherwise(s)
    return F.coalesce(F.filter(F.transform(many, url), lambda u: u.isNotNull()), F.array().cast("array<string>"))


def ld_address(block: Column) -> Column:
    """Struct street, city, postcode; of several addresses the first."""
    part = lambda n: F.coalesce(F.get_json_object(block, f"$.address.{n}"), F.get_json_object(block, f"$.address[0].{n}"), F.lit(""))
    return F.struct(part("streetAddress").alias("street"), part("addressLocality").alias("city"), part("postalCode").alias("postcode"))


def ld_listing_block(blocks: Column) -> Column:
    """The first listing block with a price or an area, else the first listing block."""
    wanted = F.filter(blocks, lambda b: F.arrays_overlap(ld_types(b), F.array(*map(F.lit, LISTING_TYPES))))
    rich = F.filter(wanted, lambda b: (F.coalesce(ld_price(b), F.lit(0)) > 0) | (F.coalesce(ld_area(b), F.lit(0.0)) > 0))
    return F.coalesce(F.try_element_at(rich, F.lit(1)), F.try_element_at(wanted, F.lit(1)))
