"""Entity resolution of listings: hashes, blocking, pair decisions, groups, canonical members."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, shingles, slug
from ..session import checkpointed
from . import pairtiles
from .graph import group_edges

# Thresholds of the pair rules.
PHOTO_BITS, PHOTO_NEAR_BITS = 8, 14
AREA_M2, LAND_SHARE, PRICE_SHARE = 2.0, 0.10, 0.08
TEXT_LEAST, TEXT_STRICT, SHINGLE = 0.30, 0.45, 3
NO_HASH = 999
AREA_BLOCK = 10
#: Hashes of a place that are compared with their blocks; more are compared in tiles of this size.
DIRECT = 4096
#: Compared pairs that cost as much as one key; keys and compared pairs of a task.
KEY_COST, KEYS, STRANGERS = 20, 250_000, 20_000_000
#: Listings of a block that one group of a join has on its left side. The right side is shuffled once for each part, so the disk it takes grows with a block's parts.
PART = 4096
#: Listings of a place that meet by joins; those of a place with more meet in pairs of tiles.
JOINED = 1024


def known(c: Column) -> Column:
    """Null for 0 and blank too: all three mean missing. Of numbers; a text may well be 0."""
    return F.when(c.cast("string").isin("", "0", "0.0"), None).otherwise(c)


def stated(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def packed(bits: Column) -> Column:
    """16 hexadecimal digits of an array of 64 bits (0 or 1)."""
    half = lambda a: F.lpad(F.lower(F.conv(F.array_join(F.slice(bits, a, 32), ""), 2, 16)), 8, "0")
    return F.concat(half(1), half(33))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hashes; 999 where one is missing."""
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    bits = F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 9).bitwiseXOR(part(b, 9)))
    return F.when(stated(a).isNull() | stated(b).isNull(), NO_HASH).otherwise(bits)


def hash_value(h: Column) -> Column:
    """The 64 bits of a 16-digit hash as a number."""
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _keys_and_strangers(n: int, radius: int, pieces: int) -> tuple[float, float]:
    """Keys of n hashes of random bits, and pairs that meet at one."""
    bits, slack = 64 / pieces, radius // pieces
    keys = pieces * sum(math.comb(round(bits), i) for i in range(slack + 1))
    return float(n * keys), n * n * keys / 2**bits


def pieces_for(n: int, radius: int) -> int:
    """The number of pieces with which n hashes cost least: a key is sorted and shuffled, a pair only compared."""

    def cost(pieces: int) -> float:
        keys, strangers = _keys_and_strangers(n, radius, pieces)
        return KEY_COST * keys + strangers

    return min((p for p in range(1, radius + 2) if radius // p <= 2), key=lambda p: (cost(p), -p))


def near_hashes(hashes: DataFrame, key: str, h: str, radius: int = PHOTO_BITS, pieces: int | None = None, within: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """a, b (a < b), bits: pairs of 16-digit hashes within the radius; of rows that agree in ``within`` only.

    The 64 bits are cut into pieces; two hashes within the radius differ in one of them by at most
    radius div pieces bits. One side is filed under its pieces, the other under all pieces so near, and
    they meet by an equi-join; none is lost, and a pair is taken at the first piece where it meets. Of radius + 1
    pieces one is equal; fewer and longer pieces have more keys a hash and meet far fewer strangers. By default the number of
    hashes decides, and both sides are dealt by what they will meet.
    ``where`` is a condition on the further columns of both rows, named with _a and _b behind.
    """
    further = [c for c in hashes.columns if c not in (key, h, *within)]
    rows = checkpointed(hashes.where(stated(F.col(h)).isNotNull()).select(F.col(key).alias("k"), hash_value(F.col(h)).alias("v"), *within, *further))
    n, spark = rows.count(), hashes.sparkSession
    pieces = pieces or pieces_for(n, radius)
    filed, strangers = _keys_and_strangers(n, radius, pieces)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # Each row becomes many: an explicit number of partitions is not coalesced for the few bytes there are before.
    rows, parts = rows.repartition(least, "k"), max(least, min(4096, math.ceil(max(filed / KEYS, strangers / STRANGERS))))
    slack, cuts = radius // pieces, [round(i * 64 / pieces) for i in range(pieces + 1)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    piece = lambda v, i: F.shiftrightunsigned(v, spans[i][0]).bitwiseAND(F.lit((1 << (spans[i][1] - spans[i][0])) - 1))
    flips = [F.array(*[F.lit(sum(1 << i for i in on)).cast("bigint") for n in range(slack + 1) for on in itertools.combinations(range(b - a), n)]) for a, b in spans]

    def probes(i: int) -> Column:
        return F.transform(flips[i], lambda m: F.struct(F.lit(i).alias("piece"), piece(F.col("v"), i).bitwiseXOR(m).alias("bits")))

    named = lambda x: [F.col("k").alias(x), F.col("v").alias(f"v{x}"), *within, *[F.col(c).alias(f"{c}_{x}") for c in further]]
    left = rows.select(*named("a"), F.posexplode(F.array(*[piece(F.col("v"), i) for i in range(pieces)])).alias("piece", "bits"))
    right = rows.select(*named("b"), F.inline(F.flatten(F.array(*map(probes, range(pieces))))))
    on = [*within, "piece", "bits"]
    met = left.repartition(parts, *on).hint("merge").join(right.repartition(parts, *on), on).where("a < b")
    met = met if where is None else met.where(where)
    differ = lambda i: F.bit_count(piece(F.col("va"), i).bitwiseXOR(piece(F.col("vb"), i))) > slack
    first = F.lit(True)
    for i in range(pieces - 1):
        first = first & ((F.col("piece") <= i) | differ(i))
    return met.withColumn("bits", F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))).where((F.col("bits") <= radius) & first).select("a", "b", "bits")


def photo_distance(p: Column, q: Column) -> Column:
    return F.least(hamming(p["phash"], q["phash"]), hamming(p["dhash"], q["dhash"]))


def photo_hits(a: Column, b: Column) -> Column:
    """How many of a's photos have one of b's within the limit; not symmetric."""
    return F.size(F.filter(a, lambda p: F.exists(b, lambda q: photo_distance(p, q) <= PHOTO_BITS)))


def photo_best(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: photo_distance(p, q))))), F.lit(NO_HASH))


def attributes_match(a, b) -> Column:
    """Same commune, both areas within 2 m², rooms equal and plots within 10% where both are known. a, b: name -> Column."""
    codes = stated(a("commune_code")).isNotNull() & stated(b("commune_code")).isNotNull()
    place = F.when(codes, a("commune_code") == b("commune_code")).otherwise(slug(a("commune_name")) == slug(b("commune_name")))
    return place & _sizes_match(*(lambda n, x=x: known(x(n)) for x in (a, b)))


def _sizes_match(a, b) -> Column:
    """Areas, rooms and plots as ``attributes_match`` compares them; unknown ones are null."""
    area = F.coalesce(F.abs(a("area_m2") - b("area_m2")) <= AREA_M2, F.lit(False))
    rooms = F.coalesce(a("rooms") == b("rooms"), F.lit(True))
    la, lb = a("land_m2"), b("land_m2")
    land = F.coalesce(F.abs(la - lb) <= LAND_SHARE * F.greatest(la, lb), F.lit(True))
    return area & rooms & land


def price_match(a: Column, b: Column) -> Column:
    a, b = known(a), known(b)
    return F.coalesce(F.abs(a - b) <= PRICE_SHARE * F.greatest(a, b), F.lit(False))


def with_shingles(listings: DataFrame) -> DataFrame:
    return listings.withColumn("shingles", shingles(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))), SHINGLE))


def block(listings: DataFrame) -> tuple[Column, Column]:
    """Place (commune, else its name, else ?) and 10 m² bucket of a listing; only listings of near blocks can be one house."""
    place = F.coalesce(stated(F.col("commune_code")), F.nullif(slug(F.col("commune_name")), F.lit("")), F.lit("?"))
    return place, F.floor(known(F.col("area_m2")) / AREA_BLOCK)


def blocked_pairs(listings: DataFrame, key: str = "key") -> DataFrame:
    """a, b (a < b): all pairs of one commune whose 10 m² buckets differ by at most 2; null areas meet null areas.

    One side goes to its own bucket, the other to the five around it, so each pair meets exactly once.
    Listings with neither a commune nor an area are left out: any two of them would be a pair. Groups
    are made from ``candidate_pairs``, which has their links too.
    """
    place, bucket = block(listings)
    base = listings.select(F.col(key).alias("k"), place.alias("place"), bucket.alias("bucket")).where("place <> '?' or bucket is not null")
    left = base.select(F.col("k").alias("a"), "place", "bucket")
    right = base.select(F.col("k").alias("b"), "place", F.explode(F.when(F.col("bucket").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2))).alias("bucket"))
    return _met(left, right, "bucket").where("a < b").select("a", "b")


def _met(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """left (a, place, at, ...) joined to right (b, place, at, ...) of the same place and at; null meets null.

    A block's left side is dealt in parts, so that a large block is the work of many tasks. An explicit number
    of partitions is not coalesced for the few bytes there are before the join; the hint keeps both sides off the driver.
    """
    spark = left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    l, r = _in_parts(left, right, at)  # noqa: E741
    keys = ["place", "block", "part"]
    return l.repartition(n, *keys).hint("merge").join(r.repartition(n, *keys), keys).drop("block", "part")


def _in_parts(left: DataFrame, right: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with block and part: a left row is of one part, a right row of all parts of its block."""
    none = F.struct(F.col(at).isNull().alias("none"), F.coalesce(at, F.lit(0).cast("bigint")).alias("at"))
    left, right = (x.withColumn("block", none).drop(at) for x in (left, right))
    sizes = left.groupBy("place", "block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    l = left.join(sizes.hint("merge"), ["place", "block"]).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")  # noqa: E741
    r = right.join(sizes.hint("merge"), ["place", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return l, r


def photo_pairs(listings: DataFrame, key: str = "key") -> DataFrame:
    """a, b: pairs of near blocks with a photo hash within the near-miss limit. Exact.

    The hashes of a place of up to DIRECT are compared with those of the buckets around; those of places with more
    are dealt in tiles, and every pair of tiles is compared by numpy in a task of its own.
    """
    place, bucket = block(listings)
    photos = listings.select(F.col(key).alias("k"), place.alias("place"), bucket.alias("bucket"), F.explode("photos").alias("p"))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), stated(F.col(f"p.{n}")).alias("h")) for n in ("phash", "dhash")])).alias("f")
    hashes = photos.select("k", "place", "bucket", kinds).select("k", "place", "bucket", "f.kind", "f.h").where("h is not null").distinct()
    sizes = hashes.groupBy("kind", "place").agg((F.count("*") > DIRECT).alias("hot"))
    sized = hashes.join(sizes.hint("merge"), ["kind", "place"])
    hot = _tiled(sized.where("hot").select("k", "kind", "place", "bucket", hash_value(F.col("h")).alias("v")))
    nowhere = F.lit(-9).cast("bigint")  # of no area: near itself only
    few = sized.where("not hot").select("k", "kind", "place", F.coalesce("bucket", nowhere).alias("bucket"), hash_value(F.col("h")).alias("v"))
    left = few.withColumnsRenamed({"k": "a", "v": "va"})
    around = F.when(F.col("bucket") == nowhere, F.array(nowhere)).otherwise(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2))
    right = few.select("kind", "place", F.col("k").alias("b"), F.col("v").alias("vb"), F.explode(around).alias("bucket"))
    met = left.join(right.hint("merge"), ["kind", "place", "bucket"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= PHOTO_NEAR_BITS))
    return met.select("a", "b").unionByName(hot.select("a", "b")).distinct()


def _tiled(hashes: DataFrame, tile: int = DIRECT) -> DataFrame:
    """a, b (a < b): all pairs of one kind and place in near buckets within the near-miss limit. hashes: k, kind, place, bucket, v."""
    sizes = hashes.groupBy("kind", "place").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = hashes.join(sizes.hint("merge"), ["kind", "place"]).withColumn("part", F.pmod(F.xxhash64("k", "v"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("k", "kind", "place", "bucket", "v", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    n = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def near(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(none=g["bucket"].isna(), bucket=g["bucket"].fillna(0).astype("int64")).sort_values(["none", "bucket"], ignore_index=True)
        k, v = g["k"].to_numpy(), g["v"].to_numpy(dtype=np.int64).view(np.uint64)
        none, bucket, part = g["none"].to_numpy(), g["bucket"].to_numpy(), g["part"].to_numpy()
        apart, side, found = g["p"].iloc[0] != g["q"].iloc[0], 512, []
        for i in range(0, len(g), side):
            end = min(i + side, len(g))
            # Rows are in order of their buckets: those beyond the reach of the last are at the end.
            last = len(g) if none[end - 1] else int(np.searchsorted(bucket[: len(g) - none.sum()], bucket[end - 1] + 2, "right"))
            for j in range(i, last, side):
                to = min(j + side, last)
                ok = np.bitwise_count(v[i:end, None] ^ v[None, j:to]) <= PHOTO_NEAR_BITS
                x, y = np.nonzero(ok)
                x, y = x + i, y + j
                keep = (x < y) & (none[x] == none[y]) & (bucket[y] - bucket[x] <= 2)
                keep &= (part[x] != part[y]) if apart else True
                found.append(np.stack([x[keep], y[keep]]))
        x, y = np.concatenate(found, axis=1)
        a, b = k[x], k[y]
        swap = a > b
        out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)})
        return out[out["a"] != out["b"]].drop_duplicates()

    type_of = hashes.schema["k"].dataType.simpleString()
    groups = dealt.repartition(n, "kind", "place", "p", "q").groupBy("kind", "place", "p", "q")
    return groups.applyInPandas(near, f"a {type_of}, b {type_of}")


def _attributes_met(listings: DataFrame, key: str, further: list[str]) -> DataFrame:
    """a, b (a < b) of the pairs whose attributes match, with further columns of both, _a and _b behind; areas meet in cells as wide as they may differ."""
    place, _ = block(listings)
    code = stated(F.col("commune_code"))
    sizes = [known(F.col(c)).alias(c) for c in ("area_m2", "rooms", "land_m2")]
    base = listings.select(F.col(key).alias("k"), place.alias("place"), code.alias("code"), slug(F.col("commune_name")).alias("named"), *sizes, *further)
    base = base.withColumn("at", F.floor(F.col("area_m2") / AREA_M2)).where("at is not null")
    side = lambda x: [F.col("k").alias(x), "place", *[F.col(c).alias(f"{c}_{x}") for c in ("code", "named", "area_m2", "rooms", "land_m2", *further)]]
    left = base.select(*side("a"), "at")
    right = base.select(*side("b"), F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)).alias("at"))
    same = F.when(F.col("code_a").isNotNull() & F.col("code_b").isNotNull(), F.col("code_a") == F.col("code_b")).otherwise(F.col("named_a") == F.col("named_b"))
    of = lambda x: lambda c: F.col(f"{c}_{x}")
    return _met(left, right, "at").where("a < b").where(same & _sizes_match(of("a"), of("b")))


def attribute_pairs(listings: DataFrame, key: str = "key") -> DataFrame:
    """a, b (a < b): pairs whose attributes match."""
    return _attributes_met(listings, key, []).select("a", "b")


def candidate_pairs(listings: DataFrame, key: str = "key") -> DataFrame:
    """a, b: every pair of near blocks that the rules could link or nearly link.

    All rules need near photos or matching attributes, so each of the two has a path of its own and no
    block is compared pair by pair. Texts and photos are fetched for these pairs only.
    """
    return photo_pairs(listings, key).unionByName(attribute_pairs(listings, key)).distinct()


def compared(pairs: DataFrame, listings: DataFrame, key: str = "key") -> DataFrame:
    """pairs (a, b) with hits, best_bits, attrs, price, text_sim and both_photos of the two listings."""
    s = listings if "shingles" in listings.columns else with_shingles(listings)
    cols = [key, "commune_code", "commune_name", "area_m2", "rooms", "land_m2", "price", "photos", "shingles"]
    a = s.select(*[F.col(c).alias(f"{c}_a") for c in cols])
    b = s.select(*[F.col(c).alias(f"{c}_b") for c in cols])
    both = pairs.join(a.hint("merge"), F.col("a") == F.col(f"{key}_a")).join(b.hint("merge"), F.col("b") == F.col(f"{key}_b"))
    return _measured(both, attributes_match(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))


def _measured(both: DataFrame, attrs: Column) -> DataFrame:
    """a, b with what ``compared`` gives; both: a, b and price, photos and shingles of the two, _a and _b behind."""
    pa, pb = (F.coalesce(F.col(f"photos_{x}"), F.array().cast(both.schema[f"photos_{x}"].dataType)) for x in "ab")
    measures = {
        "hits": photo_hits(pa, pb),
        "best_bits": photo_best(pa, pb),
        "attrs": attrs,
        "price": price_match(F.col("price_a"), F.col("price_b")),
        "text_sim": jaccard(F.col("shingles_a"), F.col("shingles_b")),
        "both_photos": (F.size(pa) > 0) & (F.size(pb) > 0),
    }
    # The generator keeps the optimizer from copying a measure into each condition that names it.
    return both.select("a", "b", F.inline(F.array(F.struct(*[c.alias(n) for n, c in measures.items()]))))


def compared_candidates(listings: DataFrame, key: str = "key") -> DataFrame:
    """``compared`` of all ``candidate_pairs``, each once; best_bits of places with many listings is exact up to the near-miss limit only."""
    return _compared_dealt(_dealt(listings, key), key, pairtiles.ALL, None)


def _dealt(listings: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(listings of places with up to JOINED, rows for ``pairtiles`` of the others); None where there are none."""
    place, bucket = block(listings)
    sizes = checkpointed(listings.groupBy(place.alias("__place")).agg((F.count("*") > JOINED).alias("hot")))
    hot = sizes.where("hot").select("__place").hint("merge")
    if hot.isEmpty():
        return listings, None
    few = None
    if not sizes.where("not hot").isEmpty():
        few = checkpointed(listings.withColumn("__place", place).join(hot, "__place", "left_anti").drop("__place"))
    value = lambda h: hash_value(stated(h))
    text = slug(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    numbers = [known(F.col(n)).alias(n) for n in ("area_m2", "rooms", "land_m2", "price")]
    rows = listings.select(F.col(key).alias("k"), place.alias("__place"), bucket.alias("bucket"), stated(F.col("commune_code")).alias("code"), slug(F.col("commune_name")).alias("named"), *numbers, pairtiles.hashes(F.col("photos"), value).alias("photos"), text.alias("text"))
    return few, rows.where("k is not null").join(hot, "__place", "left_semi").withColumnRenamed("__place", "place")


def _compared_dealt(dealt: tuple[DataFrame | None, DataFrame | None], key: str, keep: str, decisions: DataFrame | None) -> DataFrame:
    """``compared_candidates`` without the pairs of ``decisions`` (a, b).

    Pairs whose attributes match are measured where they meet, as there may be many: no text or photo is fetched for
    them again. Near photos add the few pairs whose attributes don't match. Places with many listings are dealt in pairs of tiles, where
    ``keep`` says which pairs are wanted. Of STARS there are a and b only; its pairs join what all links do.
    """
    few, many = dealt
    found = []
    if few is not None:
        s = with_shingles(few)
        alike = _measured(_attributes_met(s, key, ["price", "photos", "shingles"]), F.lit(True))
        c = alike.unionByName(compared(photo_pairs(few, key), s, key).where(~F.coalesce("attrs", F.lit(False))))
        c = c if decisions is None else c.join(decisions.hint("merge"), ["a", "b"], "left_anti")
        found.append(c.where(_method().isNotNull()).select("a", "b") if keep == pairtiles.STARS else c)
    if many is not None:
        if decisions is not None:
            apart = decisions.groupBy(F.col("a").alias("k")).agg(F.collect_set("b").alias("apart"))
            many = many.join(apart.hint("merge"), "k", "left")
        rules = {"bits": PHOTO_BITS, "near_bits": PHOTO_NEAR_BITS, "no_hash": NO_HASH, "area": AREA_M2, "land": LAND_SHARE, "price": PRICE_SHARE, "text": TEXT_LEAST, "text_strict": TEXT_STRICT, "shingle": SHINGLE}
        found.append(pairtiles.measured(many, keep, rules))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _method() -> Column:
    hits, attrs, price, tx, both = (F.col(n) for n in ("hits", "attrs", "price", "text_sim", "both_photos"))
    return F.when(hits > 0, "photo").when(~attrs, None).when(both & price & (tx >= TEXT_STRICT), "price+text").when(both, None).when(price & (tx >= TEXT_LEAST), "attributes+price+text").when(tx >= TEXT_STRICT, "attributes+text")


def decided(c: DataFrame) -> DataFrame:
    """compared pairs with method and confidence; null where the rules don't link them.

    Photos that both have and that don't match speak against a link, so then price and a very similar
    text are needed on top of the attributes.
    """
    hits, attrs = F.col("hits"), F.col("attrs")
    confidence = F.when(hits > 0, F.least(F.lit(0.99), 0.80 + 0.05 * hits + F.when(attrs, 0.05).otherwise(0.0))).when(F.col("method") == "price+text", 0.60).when(F.col("method") == "attributes+price+text", 0.75).when(F.col("method") == "attributes+text", 0.65)
    return c.withColumn("method", _method()).withColumn("confidence", F.round(confidence, 2)).withColumn("text_sim", F.round("text_sim", 2))


def near_misses(c: DataFrame) -> DataFrame:
    """a, b, reason, score of compared pairs that almost linked."""
    hits, best, attrs, price, tx = (F.col(n) for n in ("hits", "best_bits", "attrs", "price", "text_sim"))
    reason = F.when(best <= PHOTO_NEAR_BITS, "similar photos").when(attrs & price, "area, rooms and price agree, photos differ").when(attrs & (tx >= TEXT_LEAST), "attributes and text are alike")
    score = F.when(best <= PHOTO_NEAR_BITS, 0.5).when(attrs & price, 0.45).when(attrs & (tx >= TEXT_LEAST), 0.4)
    return c.where(hits == 0).select("a", "b", reason.alias("reason"), score.alias("score")).where("reason is not null")


def linked(listings: DataFrame, decisions: DataFrame | None = None, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(links, candidates): pairs that are one house, with method, confidence and text_sim, and pairs that nearly are.

    A decision (a, b, same: 0 or 1) of 1 links a pair even across blocks; of 0 it takes out that pair's own link only; decided
    pairs are no candidates. Candidates are distinct.
    """
    return _linked(_dealt(listings, key), _sorted_ends(decisions), key)


def _sorted_ends(decisions: DataFrame | None) -> DataFrame | None:
    return decisions if decisions is None else decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same")


def _linked(dealt: tuple[DataFrame | None, DataFrame | None], d: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    ends = d if d is None else d.select("a", "b")
    links = decided(_compared_dealt(dealt, key, pairtiles.LINKS, ends)).where("method is not null").select("a", "b", "method", "confidence", "text_sim")
    candidates = near_misses(_compared_dealt(dealt, key, pairtiles.NEAR, ends).withColumn("method", _method()).where("method is null"))
    if d is not None:
        by_hand = d.where("same = 1").select("a", "b", F.lit("manual").alias("method"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("text_sim"))
        links = links.unionByName(by_hand)
    return links, candidates


def grouped(listings: DataFrame, decisions: DataFrame | None = None, key: str = "key", ord_col: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, links, candidates). listings: key, ord (unique order), attributes, photos; decisions as ``linked`` takes them.

    A group's id is the key of its first member. Groups don't need all links: places with many listings give stars that join the same.
    """
    dealt, d = _dealt(listings, key), _sorted_ends(decisions)
    links, candidates = _linked(dealt, d, key)
    joined = _compared_dealt(dealt, key, pairtiles.STARS, d if d is None else d.select("a", "b"))
    joined = joined if d is None else joined.unionByName(d.where("same = 1").select("a", "b"))
    nodes = listings.select(F.col(key).alias("key"), F.col(ord_col).alias("ord"))
    return group_edges(nodes, joined), links, candidates


def canonical(members: DataFrame, group: str = "group_id", key: str = "key") -> DataFrame:
    """Per group the member with most photos, then the longest description, then the lowest price, then the first key."""
    rank = F.struct(F.size(F.coalesce("photos", F.array().cast(members.schema["photos"].dataType))).alias("n"), F.length(F.coalesce("description", F.lit(""))).alias("l"), (-F.coalesce(known(F.col("price")), F.lit(1e9))).alias("p"))
    best = members.withColumn("__rank", rank)
    top = best.groupBy(group).agg(F.max("__rank").alias("__top"))
    return best.join(top, group).where(F.col("__rank") == F.col("__top")).groupBy(group).agg(F.min(key).alias("canonical"))


def canonical_for_list(members: DataFrame, group: str = "group_id", key: str = "key") -> DataFrame:
    """The list view's rule: a price before none, then the longest description, then the first key."""
    rank = F.struct(known(F.col("price")).isNotNull().alias("p"), F.length(F.coalesce("description", F.lit(""))).alias("l"))
    best = members.withColumn("__rank", rank)
    top = best.groupBy(group).agg(F.max("__rank").alias("__top"))
    return best.join(top, group).where(F.col("__rank") == F.col("__top")).groupBy(group).agg(F.min(key).alias("canonical"))


def dup_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the link table: members of groups of several, with method and confidence of their strongest link."""
    both = links.select(F.col("a").alias("key"), "method", "confidence", "b").unionByName(links.select(F.col("b").alias("key"), "method", "confidence", F.col("a").alias("b")))
    first = both.groupBy("key").agg(F.min(F.struct("b", "method", "confidence")).alias("f")).select("key", "f.method", "f.confidence")
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(several, "group_id", "left_semi").join(first, "key", "left").select("key", "group_id", "method", "confidence")
