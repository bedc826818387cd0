"""Listing tables over time: upserts, price history, photos, reviews, votes, decisions, placement.

Each function takes the stored and the arriving rows and returns the rows to store: Parquet tables are
rewritten or appended to by the caller, and a row is identified by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from .resolution import known, stated

KEPT_ON_UPDATE = ["first_seen", "price_first", "place_score", "place_note", "place_zone"]
VOTES = ["like", "maybe", "pass"]
PRECISE = ["housenumber", "street"]


def listing_key(source: Column, source_id: Column, url: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, F.coalesce(F.nullif(source_id, F.lit("")), url))), 1, 20)


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a grouped maximum, which is partly summed before the shuffle."""
    rest = [c for c in events.columns if c not in keys and c not in order]
    top = events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__l"))
    return top.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in events.columns if c not in keys])


def upserted(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Listings after a batch (key, seen_at, price, ...): new keys set first_seen and price_first; known ones take
    the batch's fields but keep those, and their place; whatever arrives is active again."""
    first = arrived.groupBy("key").agg(F.min("seen_at").alias("first_seen"), F.min_by("price", "seen_at").alias("price_first"))
    new = latest(arrived, ["key"], ["seen_at"]).join(first, "key").withColumn("active", F.lit(True))
    return merged(stored, new, KEPT_ON_UPDATE)


def merged(stored: DataFrame, new: DataFrame, kept: list[str]) -> DataFrame:
    """Full outer merge by key: new fields win, kept ones stay where they are stored."""
    cols = list(dict.fromkeys([*stored.columns, *new.columns]))
    s, n = stored.withColumn("__s", F.lit(True)).alias("s"), new.withColumn("__n", F.lit(True)).alias("n")
    out = []
    for c in cols:
        if c == "key":
            out.append(F.coalesce(F.col("s.key"), F.col("n.key")).alias("key"))
        elif c not in new.columns:
            out.append(F.col(f"s.{c}").alias(c))
        elif c not in stored.columns:
            out.append(F.col(f"n.{c}").alias(c))
        elif c in kept:
            out.append(F.when(F.col("s.__s"), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(F.col("n.__n"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return s.join(n, F.col("s.key") == F.col("n.key"), "full").select(*out)


def price_changes(snapshots: DataFrame) -> DataFrame:
    """key, seen_at, price where the price is known and differs from the one before."""
    w = Window.partitionBy("key").orderBy("seen_at")
    priced = snapshots.where("price is not null").select("key", "seen_at", "price")
    return priced.withColumn("before", F.lag("price").over(w)).where(~F.col("price").eqNullSafe(F.col("before"))).drop("before")


def new_photos(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Photos to append: those of a listing and URL not stored yet, the first of repeats."""
    return latest(arrived.withColumn("__o", -F.col("ord")), ["key", "url"], ["__o"]).drop("__o").join(stored.select("key", "url"), ["key", "url"], "left_anti")


def to_hash(photos: DataFrame, hashed: DataFrame, most: int = 6) -> DataFrame:
    """The first photos of each listing that have no hash yet."""
    ranked = photos.withColumn("__i", F.row_number().over(Window.partitionBy("key").orderBy("ord", "url"))).where(F.col("__i") <= most).drop("__i")
    return ranked.join(hashed.select("key", "url"), ["key", "url"], "left_anti")


def with_photos(listings: DataFrame, photos: DataFrame) -> DataFrame:
    """listings with their photos nested in order."""
    fields = [c for c in photos.columns if c != "key"]
    nested = photos.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"]))).alias("photos"))
    return listings.join(nested, "key", "left")


def marked_inactive(stored: DataFrame, source: str, seen: DataFrame) -> DataFrame:
    """Active listings of a source that were not seen become inactive."""
    gone = stored.where((F.col("source") == source) & F.col("active")).join(seen.select("key"), "key", "left_anti").select("key", F.lit(True).alias("__gone"))
    return stored.join(gone, "key", "left").withColumn("active", F.when(F.col("__gone"), False).otherwise(F.col("active"))).drop("__gone")


def merged_reviews(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Reviews by key: each column takes the new value where there is one."""
    cols = [c for c in stored.columns if c != "key"]
    s, n = stored.alias("s"), new.alias("n")
    return s.join(n, F.col("s.key") == F.col("n.key"), "full").select(F.coalesce("s.key", "n.key").alias("key"), *[F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) for c in cols])


def hidden_after(hidden: DataFrame, hide: DataFrame, unhide: DataFrame) -> DataFrame:
    return hidden.select("key").union(hide.select("key")).distinct().join(unhide.select("key"), "key", "left_anti")


def votes_after(votes: DataFrame) -> DataFrame:
    """The last vote of each person and group; a vote of another kind is an error."""
    checked = votes.withColumn("vote", F.when(F.col("vote").isin(VOTES), F.col("vote")).otherwise(F.raise_error(F.concat(F.lit("unknown vote: "), F.coalesce("vote", F.lit("null"))))))
    return latest(checked, ["group_id", "person"], ["ts"])


def decisions_after(decisions: DataFrame) -> DataFrame:
    """The last decision of each pair, whichever way round it was given."""
    pair = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same", "ts")
    return latest(pair, ["a", "b"], ["ts"])


def people_after(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """People by name: those listed are active, others are not."""
    s, n = stored.alias("s"), listed.select("name").distinct().withColumn("__in", F.lit(True)).alias("n")
    return s.join(n, F.col("s.name") == F.col("n.name"), "full").select(F.coalesce("s.name", "n.name").alias("name"), F.coalesce("n.__in", F.lit(False)).alias("active"))


def wanted(listings: DataFrame, max_price: float = 350_000, min_area: float = 100, min_bedrooms: int = 3) -> DataFrame:
    """Houses near the wishes; what is missing passes."""
    price, area, beds = known(F.col("price")), known(F.col("area_m2")), known(F.col("bedrooms"))
    return listings.where(F.coalesce(price <= 1.15 * max_price, F.lit(True)) & F.coalesce(area >= 0.85 * min_area, F.lit(True)) & F.coalesce(beds >= min_bedrooms, F.lit(True)))


def well_placed(listings: DataFrame, least: float) -> DataFrame:
    return listings.where(F.col("place_score") >= least)


def without(children: DataFrame, listings: DataFrame) -> DataFrame:
    """Child rows (photos, prices) whose listing is still there."""
    return children.join(listings.select("key"), "key", "left_semi")


def url_set(urls: DataFrame, limit: int | None = None) -> DataFrame:
    out = urls.select("url").distinct().orderBy("url")
    return out.limit(limit) if limit else out


def search_area(communes: DataFrame) -> DataFrame:
    """One row: sorted codes and distinct postcodes of green and amber communes."""
    good = communes.where(F.col("status").isin("green", "amber"))
    return good.select("code", F.explode_outer("postcodes").alias("p")).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("p")).alias("postcodes"))


def in_area(rows: DataFrame, area: DataFrame, postcode: str = "postcode") -> DataFrame:
    return rows.join(area.select(F.explode("postcodes").alias(postcode)), postcode, "left_semi")


def reconciled(listings: DataFrame, mentions: DataFrame, communes: DataFrame) -> DataFrame:
    """listings with found_code, found_name, mismatch. mentions: key, mentions (slugs in order); communes: code, name.

    Of communes with one slug the first code counts; "st" stands for "saint".
    """
    names = communes.select(slug(F.col("name")).alias("s"), "code", "name").groupBy("s").agg(F.min(F.struct("code", "name")).alias("c"))
    long = mentions.select("key", F.posexplode("mentions").alias("pos", "m")).select("key", "pos", F.explode(F.array_distinct(F.array(F.col("m"), F.replace("m", F.lit("st "), F.lit("saint "))))).alias("s"))
    hit = long.join(names, "s").groupBy("key").agg(F.min(F.struct("pos", "c")).alias("h")).select("key", F.col("h.c.code").alias("found_code"), F.col("h.c.name").alias("found_name"))
    out = listings.join(hit, "key", "left")
    differs = F.col("found_name").isNotNull() & (F.coalesce("commune_name", F.lit("")) != "") & (slug(F.col("found_name")) != slug(F.col("commune_name")))
    return out.withColumn("mismatch", differs)


def located(listings: DataFrame, geocodes: DataFrame, communes: DataFrame) -> DataFrame:
    """listings with code, lat, lon, geo_precision filled in.

    An address found in the claimed commune places a listing; one found elsewhere is dropped, and the
    commune's centre stands in. geocodes: query, lat, lon, type, citycode; communes: code, lat, lon.
    """
    g = geocodes.select("query", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), F.col("type").alias("g_type"), F.col("citycode").alias("g_code"))
    c = communes.select(F.col("code").alias("c_code"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    out = listings.join(g, F.col("address") == F.col("query"), "left")
    ok = F.col("g_lat").isNotNull() & (stated(F.col("commune_code")).isNull() | (F.col("g_code") == F.col("commune_code")))
    out = out.withColumn("commune_code", F.coalesce(stated(F.col("commune_code")), F.when(ok, F.col("g_code")))).join(c, F.col("commune_code") == F.col("c_code"), "left")
    lat = F.coalesce(known(F.col("lat")), F.when(ok, F.col("g_lat")), F.col("c_lat"))
    lon = F.coalesce(known(F.col("lon")), F.when(ok, F.col("g_lon")), F.col("c_lon"))
    precision = F.when(known(F.col("lat")).isNotNull(), F.col("geo_precision")).when(ok, F.col("g_type")).when(F.col("c_lat").isNotNull(), "commune").otherwise("none")
    return out.withColumns({"geo_precision": precision, "lat": lat, "lon": lon}).drop("query", "g_lat", "g_lon", "g_type", "g_code", "c_code", "c_lat", "c_lon")


def placed(listings: DataFrame, cells: DataFrame, zones: DataFrame, communes: DataFrame, grid) -> DataFrame:
    """listings (x, y, geo_precision, commune_code) with place_score, place_note and place_zone.

    A precise point has its cell's score; else the commune's 90th percentile stands in; else an
    approximate point its cell's; else the listing is outside. cells: row, col, score, part.
    """
    row, col = grid.bin(F.col("x"), F.col("y"))
    inside = F.hypot(F.col("x") - grid.cx, F.col("y") - grid.cy) <= grid.radius
    at = listings.withColumn("__row", F.when(inside, row)).withColumn("__col", F.when(inside, col))
    c = cells.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("score").alias("__score"), F.col("part").alias("__part"))
    m = communes.select(F.col("code").alias("commune_code"), "status", "p90", "area_good_ha")
    out = at.join(c, ["__row", "__col"], "left").join(m, "commune_code", "left").join(zones.select(F.col("part").alias("__part"), F.col("rank").alias("__zone")), "__part", "left")
    precise = F.col("geo_precision").isin(PRECISE) & F.col("__score").isNotNull()
    by_commune = F.col("status").isNotNull() & (F.col("status") != "excluded")
    score = F.when(precise, F.col("__score")).when(by_commune, F.col("p90")).when(F.col("__score").isNotNull(), F.col("__score"))
    exact = F.when(F.col("__zone").isNotNull(), "exact_zone").when(F.col("__score") > 0, "exact_ok").otherwise("exact_out")
    note = F.when(precise, exact).when(by_commune, F.concat(F.lit("commune:"), "status", F.lit(":"), F.bround("area_good_ha").cast("long").cast("string"))).when(F.col("__score").isNotNull(), "approx_coords").otherwise("outside")
    zone = F.when(precise | (~F.coalesce(by_commune, F.lit(False)) & F.col("__score").isNotNull()), F.col("__zone"))
    return out.withColumns({"place_score": score, "place_note": note, "place_zone": zone}).drop("__row", "__col", "__score", "__part", "__zone", "status", "p90", "area_good_ha")


def place_note_parts(note: Column) -> Column:
    """Struct kind, status, ha of a place note."""
    p = F.split(note, ":")
    return F.struct(F.try_element_at(p, F.lit(1)).alias("kind"), F.try_element_at(p, F.lit(2)).alias("status"), F.try_element_at(p, F.lit(3)).try_cast("int").alias("ha"))
