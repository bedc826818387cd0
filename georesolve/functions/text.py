"""French listing text: prices, areas, rooms, features, slugs. All as Column expressions.

Patterns run with Java's Unicode classes and case folding, so no-break and thin spaces count as white
space and accented capitals match. Null and empty texts give null (condition and dpe: empty).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces, patterns and word lists that results depend on.
SPACES = "     "
FLAGS = "(?iuU)"
PRICE = r"(\d[\d\s.,]{2,})\s*(?:€|eur|euros)"
FEES_INCLUDED = r"\b(f\.?a\.?i\.?|frais\s+d.agence\s+inclus|honoraires\s+inclus|charge\s+vendeur)\b"
FEES_EXTRA = r"\b(hors\s+honoraires|honoraires\s+(?:à\s+la\s+)?charge\s+(?:de\s+l.)?acqu[ée]reur|hors\s+frais)\b"
NUMBER = r"(?<![\w.,])(?:\d{1,3}(?:[\s.]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
AREA = rf"({NUMBER})\s*(?:m²|m2|m\s?carr[ée]s?|mètres?\s+carr[ée]s?)"
PLOT = "(?:terrain|parcelle|jardin)"
LAND = rf"{PLOT}[^.\d]{{0,30}}({NUMBER})\s*(?:m²|m2|ha\b)"
LAND_HA = rf"(?:terrain|parcelle)[^.\d]{{0,30}}({NUMBER})\s*ha\b"
LAND_AFTER = rf"({NUMBER})\s*(?:m²|m2)\s+(?:de\s+|d.){PLOT}"
LAND_AFTER_HA = rf"({NUMBER})\s*ha\s+(?:de\s+|d.){PLOT}"
NOT_LIVING = "terrain|parcelle|jardin|cave|garage|grange|d[ée]pendance|combles|sous-sol"
ROOMS = r"(\d{1,2})\s*(?:pi[èe]ces?|p\.\b)|(?:^|\W)T\s?(\d)\b"
BEDROOMS = r"(\d{1,2})\s*chambres?"
FEATURES = {"terrace": r"\bterrasse[s]?\b", "pool": r"\bpiscine\b", "garage": r"\b(garage|box\s+ferm[ée])\b"}
NEGATION = r"(?:sans|pas\s+de|aucune?)\s+"
CONDITIONS = {
    "needs_work": r"\b(à\s+r[ée]nover|travaux\s+[àa]\s+pr[ée]voir|gros\s+œuvre|rafra[îi]chir|[àa]\s+rafra[îi]chissement|restaurer)\b",
    "renovated": r"\b(r[ée]nov[ée]e?|refait[e]?\s+[àa]\s+neuf|remis\s+au\s+go[ûu]t)\b",
    "good_state": r"\b(bon\s+[ée]tat|excellent\s+[ée]tat|tr[èe]s\s+bon\s+[ée]tat)\b",
    "recent": r"\b(neuf|neuve|r[ée]cent[e]?)\b",
}
DPE = r"\bDPE\W{0,12}([A-G])\b|classe\s+[ée]nerg[ée]tique\W{0,12}([A-G])\b"
ACCENTED = "àáâãäåāăąçćčďèéêëēĕėęěìíîïĩīĭįñńňòóôõöōŏőŕřśşšţťùúûüũūŭůűųýÿžźż"
UNACCENTED = "aaaaaaaaacccdeeeeeeeeeiiiiiiiinnnooooooooorrsssttuuuuuuuuuuyyzzz"

_OPEN, _NUM, _CLOSE = "\u0001", "\u0003", "\u0002"


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once however often of names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _some(text: Column, value: Column) -> Column:
    """value, but null for a null or empty text."""
    return F.when(text != "", value)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return bound(F.regexp_extract(text, FLAGS + pattern, group), lambda got: F.when(got != "", got))


def strip_spaces(s: Column) -> Column:
    return F.translate(s, SPACES, "")


def price(text: Column) -> Column:
    raw = F.split(F.translate(strip_spaces(_found(text, PRICE)), ".", ""), ",")[0]
    return bound(raw.try_cast("int"), lambda value: F.when(value.between(10_000, 5_000_000), value))


def fees_included(text: Column) -> Column:
    return _some(text, F.when(text.rlike(FLAGS + FEES_EXTRA), False).when(text.rlike(FLAGS + FEES_INCLUDED), True))


def number(s: Column) -> Column:
    """A French number: a comma is decimal (dots then group), dots alone group by three."""
    grouped = lambda s: F.when(s.contains(","), F.replace(F.translate(s, ".", ""), F.lit(","), F.lit("."))).when(s.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.translate(s, ".", "")).otherwise(s)
    return bound(strip_spaces(s), grouped).try_cast("double")


def area_m2(text: Column) -> Column:
    """The largest living area of 20 to 1000 m²: no non-living word within 40 characters before it, nor one it is said to be of within 30 after.

    Every match is marked in place; contexts are cut from the text with the marks taken out again.
    """
    marked = F.regexp_replace(text, FLAGS + AREA, f"{_OPEN}$0{_NUM}$1{_CLOSE}")
    parts = F.split(marked, _OPEN)

    def pick(p: Column) -> Column:
        clean = F.transform(p, lambda x: F.regexp_replace(x, f"{_NUM}[^{_CLOSE}]*{_CLOSE}", ""))

        def judge(i: Column) -> Column:
            before = F.right(F.array_join(F.slice(clean, 1, i), ""), F.lit(40))
            after = F.concat(F.substring_index(F.element_at(p, i + 1), _CLOSE, -1), F.array_join(F.slice(clean, i + 2, F.size(p)), ""))
            value = number(F.regexp_extract(F.element_at(p, i + 1), f"{_NUM}([^{_CLOSE}]*){_CLOSE}", 1))
            living = ~F.lower(before).rlike("(?uU)" + NOT_LIVING) & ~F.lower(F.left(after, F.lit(30))).rlike(rf"(?uU)^\s*(?:de\s+|d.)(?:{NOT_LIVING})")
            return F.when(living & value.between(20, 1000), value)

        return F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.size(p) - 1), judge), lambda v: v.isNotNull()))

    found = F.element_at(F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, pick(p))), 1)
    return _some(text, found)


def land_m2(text: Column) -> Column:
    """Hectares first, unbounded; then square metres (or hectares by the short pattern), 50 to 500,000."""
    hectares = F.coalesce(number(_found(text, LAND_HA)), number(_found(text, LAND_AFTER_HA))) * 10_000
    whole = F.coalesce(_found(text, LAND, 0), _found(text, LAND_AFTER, 0))
    value = F.coalesce(number(_found(text, LAND)), number(_found(text, LAND_AFTER)))
    scaled = F.when(F.lower(whole).contains("ha"), F.lit(10_000.0)).otherwise(F.lit(1.0))
    plain = bound(F.struct(value.alias("v"), scaled.alias("by")), lambda f: bound(f["v"] * f["by"], lambda v: F.when(v.between(50, 500_000), v)))
    return F.coalesce(hectares, plain)


def _within(value: Column, low: int, high: int) -> Column:
    return bound(value.try_cast("int"), lambda v: F.when(v.between(low, high), v))


def rooms(text: Column) -> Column:
    return _within(F.coalesce(_found(text, ROOMS, 1), _found(text, ROOMS, 2)), 1, 20)


def bedrooms(text: Column) -> Column:
    return _within(_found(text, BEDROOMS), 1, 15)


def feature(text: Column, name: str) -> Column:
    """False if negated, true if mentioned, else null: not mentioned is not absent."""
    pattern = FEATURES[name]
    return _some(text, F.when(text.rlike(FLAGS + NEGATION + pattern), False).when(text.rlike(FLAGS + pattern), True))


def condition_hint(text: Column) -> Column:
    return F.concat_ws(",", *[F.when(text.rlike(FLAGS + p), name) for name, p in CONDITIONS.items()])


def dpe(text: Column) -> Column:
    return F.upper(F.coalesce(_found(text, DPE, 1), _found(text, DPE, 2), F.lit("")))


def slug(s: Column) -> Column:
    """Lower case without accents, runs of anything else one space. Letters without a base form are separators."""
    plain = F.translate(F.lower(F.coalesce(s, F.lit(""))), ACCENTED, UNACCENTED)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[̀-ͯ]", ""), "[^a-z0-9]+", " "))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct word n-grams of the slug; of fewer than n words, the words."""
    words = F.filter(F.split(slug(text), " "), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, grams).otherwise(words))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def eur(value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.replace(F.format_number(value, 0), F.lit(","), F.lit(" ")), F.lit(" €"))).otherwise("")


def plain_number(value: Column) -> Column:
    """Up to one decimal, without a trailing zero."""
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", ""))


def price_per_m2(price_col: Column, area: Column) -> Column:
    return F.when((price_col > 0) & (area > 0), F.round(price_col / area))


def land_plausible(land: Column, area: Column) -> Column:
    """A plot smaller than the house is a misreading."""
    return F.when((land < area), None).otherwise(land)


#: Phrases that name the commune a listing lies in; matched over the text's head only.
# The phrases and the leading capitals that name a commune.
COMMUNE_PHRASES = [
    r"(?:sur\s+la\s+)?commune\s+d[eu']\s*([A-ZÀ-Ÿ][\wÀ-ÿ' \-]{2,32})",
    r"village\s+d[eu']\s*([A-ZÀ-Ÿ][\wÀ-ÿ' \-]{2,32})",
    r"(?:situ[ée]e?|sise?)\s+[àa]\s+([A-ZÀ-Ÿ][\wÀ-ÿ' \-]{2,32})",
    r"bourg\s+d[eu']\s*([A-ZÀ-Ÿ][\wÀ-ÿ' \-]{2,32})",
]
CAPITALS = r"^\s*([A-ZÀ-Ÿ][A-ZÀ-Ÿ' \-]{2,32})\s*[–—\-:,]"


def commune_mentions(text: Column, head: int = 700) -> Column:
    """Slugs of what the phrases name, in order of phrase, then position; then leading capitals."""
    text = F.left(F.coalesce(text, F.lit("")), F.lit(head))
    named = [F.regexp_extract_all(text, F.lit(FLAGS + p), F.lit(1)) for p in COMMUNE_PHRASES]
    lead = F.regexp_extract(text, "(?uU)" + CAPITALS, 1)
    return F.filter(F.transform(F.concat(*named, F.array(lead)), slug), lambda s: s != "")


def commune_in_title(title: Column) -> Column:
    """The part of "... - Commune - 01 - ..." before the first two-digit department; else empty."""
    parts = F.transform(F.split(title, " - "), lambda p: F.trim(p))
    at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i > 1) & F.element_at(parts, i).rlike(r"^\d{2}$"))
    return F.coalesce(F.initcap(F.try_element_at(parts, F.try_element_at(at, F.lit(1)) - 1)), F.lit(""))


# A name in capitals before a postcode, or alone.
BEFORE_POSTCODE = r"(?u)\b([A-ZÀ-Ÿ][A-ZÀ-Ÿ' \-]{2,30})\s*\(?\d{5}\)?"
IN_CAPITALS = r"(?u)\b([A-ZÀ-Ÿ]{3,}(?:[ \-][A-ZÀ-Ÿ]{2,}){0,3})\b"
NO_COMMUNE = ["CENTURY", "MAISON", "VENTE"]


def commune_in_capitals(title: Column, body: Column, head: int = 400) -> Column:
    """A name in capitals: before a postcode, else alone; of the title, else of the body's head."""
    found = []
    for text in (title, F.left(body, F.lit(head))):
        alone = F.regexp_extract(text, "(?U)" + IN_CAPITALS, 1)
        found += [F.nullif(F.trim(F.regexp_extract(text, "(?U)" + BEFORE_POSTCODE, 1)), F.lit("")), F.when(~alone.isin("", *NO_COMMUNE), alone)]
    return F.coalesce(F.initcap(F.lower(F.coalesce(*found))), F.lit(""))


def condition_labels(codes: Column, labels: dict[str, str]) -> Column:
    """Comma list of codes to labels; unknown codes stay."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(codes, ","), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ", ")


def label(code: Column, language: str, tables: dict[str, dict[str, str]], fallback: str = "ru") -> Column:
    """A code's label in a language, else in the fallback language, else the code."""
    options = []
    for name in (language, fallback):
        if tables.get(name):
            options.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in tables[name].items() for x in kv]), code))
    return F.coalesce(*options, code)


def least_of(columns: list[Column]) -> Column:
    """least, which needs two arguments, of any number of columns."""
    return reduce(lambda a, b: F.least(a, b), columns)
