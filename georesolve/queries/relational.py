"""Queries of entity resolution, listing store and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Grid
from ..operators import resolution, store, views
from ..sources import listings as sources
from ..sources import sinks
from .base import GROUPS, LISTINGS, PHOTOS, VOTES, groups, listings, people, query, table, votes

# -- entity resolution -----------------------------------------------------------------------------


def _hashes(spark, d):
    bits = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    return table(spark, d, "embeddings").select("vec_id", "label", resolution.packed(bits).alias("h"))


_HEX = "h AS (SELECT vec_id, label, lower(lpad(to_hex(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << (31 - i)::UBIGINT) ELSE 0::UBIGINT END))::UBIGINT), 8, '0')) || lower(lpad(to_hex(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN (1::UBIGINT << (31 - i)::UBIGINT) ELSE 0::UBIGINT END))::UBIGINT), 8, '0')) AS hash FROM embeddings)"


@query("hash_pack", f"WITH {_HEX} SELECT vec_id, hash AS h FROM h")
def hash_pack(spark, d):
    return _hashes(spark, d).select("vec_id", "h")


_TWICE = "e2 AS (SELECT vec_id * 2 + v AS vec_id, label, list_transform(range(64), lambda i: CASE WHEN v = 1 AND i < vec_id % 12 THEN (CASE WHEN embedding[i + 1] > 0 THEN -1.0 ELSE 1.0 END) ELSE embedding[i + 1] END) AS embedding FROM embeddings, range(2) t(v))"


@query("hamming_pairs", f"WITH {_TWICE}, {_HEX.replace('FROM embeddings', 'FROM e2')}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT)) AS INT) AS bits FROM h a JOIN h b ON b.vec_id > a.vec_id) SELECT a, b, bits FROM p WHERE bits <= 8")
def hamming_pairs(spark, d):
    """All pairs within the photo limit among the hashes and copies of them with 0 to 11 bits turned."""
    turned = F.transform("embedding", lambda v, i: F.when((v > 0) != ((F.col("v") == 1) & (i < F.col("vec_id") % 12)), 1).otherwise(0))
    twice = table(spark, d, "embeddings").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return resolution.near_hashes(twice.select((F.col("vec_id") * 2 + F.col("v")).alias("k"), resolution.packed(turned).alias("h")), "k", "h")


_PAIRS = f"""{LISTINGS}, bk AS (SELECT key, coalesce(commune_code, '?') AS place, floor(nullif(area_m2, 0) / 10) AS bucket FROM l),
  pr AS (SELECT a.key AS a, b.key AS b, a.place = '?' AND a.bucket IS NULL AS nowhere FROM bk a JOIN bk b ON a.place = b.place AND a.key < b.key AND (abs(a.bucket - b.bucket) <= 2 OR (a.bucket IS NULL AND b.bucket IS NULL)))"""
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(title || ' ' || description), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
_APART = "coalesce(least(bit_count(xor(p.p, q.p)), bit_count(xor(p.d, q.d))), 999)"
_DECIDED = f"""{_PAIRS}, {PHOTOS}, w AS (SELECT *, {_WORDS} AS w FROM l), sh AS (SELECT w.*, photos, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) ELSE w END) AS s FROM w JOIN ph USING (key)),
  cm AS (SELECT pr.a, pr.b, x.area_m2 IS NOT NULL AND coalesce(abs(x.area_m2 - y.area_m2) <= 2, false) AND coalesce(nullif(x.rooms, 0) = nullif(y.rooms, 0), true) AND coalesce(abs(nullif(x.land_m2, 0) - nullif(y.land_m2, 0)) <= 0.1::DOUBLE * greatest(x.land_m2, y.land_m2), true) AS attrs,
    coalesce(abs(x.price - y.price) <= 0.08::DOUBLE * greatest(x.price, y.price), false) AS price, len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(x.s || y.s)) AS tx,
    len(x.photos) > 0 AND len(y.photos) > 0 AS pictured, len(list_filter(x.photos, lambda p: len(list_filter(y.photos, lambda q: {_APART} <= 8)) > 0)) AS hits,
    coalesce(list_min(flatten(list_transform(x.photos, lambda p: list_transform(y.photos, lambda q: {_APART})))), 999) AS best FROM pr JOIN sh x ON x.key = pr.a JOIN sh y ON y.key = pr.b),
  dc AS (SELECT *, CASE WHEN hits > 0 THEN 'photo' WHEN NOT attrs THEN NULL WHEN pictured AND price AND tx >= 0.45 THEN 'price+text' WHEN pictured THEN NULL WHEN price AND tx >= 0.3 THEN 'attributes+price+text' WHEN tx >= 0.45 THEN 'attributes+text' END AS method FROM cm)"""
_CONFIDENCE = "CASE method WHEN 'photo' THEN least(0.99::DOUBLE, 0.80::DOUBLE + 0.05::DOUBLE * hits + CASE WHEN attrs THEN 0.05::DOUBLE ELSE 0 END) WHEN 'price+text' THEN 0.6::DOUBLE WHEN 'attributes+price+text' THEN 0.75::DOUBLE WHEN 'attributes+text' THEN 0.65::DOUBLE END"


@query("blocking", f"WITH {_PAIRS} SELECT a, b FROM pr WHERE NOT nowhere")
def blocking(spark, d):
    return resolution.blocked_pairs(listings(spark, d, dealt=True))


@query("pair_decision", f"WITH {_DECIDED} SELECT a, b, method, round({_CONFIDENCE}, 2) AS confidence, round(tx, 2) AS text_sim FROM dc WHERE method IS NOT NULL")
def pair_decision(spark, d):
    """Links by photos, by price and text against photos, and by attributes; listings with no place and area by photos alone."""
    return resolution.linked(listings(spark, d, dealt=True))[0]


@query("near_miss", f"WITH {_DECIDED} SELECT a, b, CASE WHEN best <= 14 THEN 'similar photos' WHEN price THEN 'area, rooms and price agree, photos differ' ELSE 'attributes and text are alike' END AS reason, CASE WHEN best <= 14 THEN 0.5::DOUBLE WHEN price THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END AS score FROM dc WHERE method IS NULL AND (best <= 14 OR attrs AND (price OR tx >= 0.3))")
def near_miss(spark, d):
    return resolution.linked(listings(spark, d, dealt=True))[1]


_GROUPED = f"""{_DECIDED}, lk AS (SELECT a, b FROM dc WHERE method IS NOT NULL), ed AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
  rc(key, root) AS (SELECT key, key FROM l UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.key), gp AS (SELECT key, min(root) AS group_id FROM rc GROUP BY key)"""


@query("dedup_groups", f"WITH RECURSIVE {_GROUPED} SELECT key, group_id FROM gp")
def dedup_groups(spark, d):
    return resolution.grouped(listings(spark, d, dealt=True))[0]


_DECISIONS = "dd AS (SELECT 'L' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS a, 'L' || lpad(CAST(p_partkey + 60 AS VARCHAR), 7, '0') AS b, CAST(p_partkey % 2 AS INT) AS same FROM part WHERE p_partkey % 25 = 3 AND p_partkey + 60 < (SELECT count(*) FROM part))"


@query("manual_override", f"WITH RECURSIVE {_DECIDED}, {_DECISIONS}, lk AS (SELECT a, b FROM dc WHERE method IS NOT NULL AND (a, b) NOT IN (SELECT (a, b) FROM dd) UNION ALL SELECT a, b FROM dd WHERE same = 1), ed AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), rc(key, root) AS (SELECT key, key FROM l UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.key) SELECT key, min(root) AS group_id FROM rc GROUP BY key")
def manual_override(spark, d):
    k, n = F.col("p_partkey"), table(spark, d, "part").count()
    key = lambda c: F.concat(F.lit("L"), F.lpad(c.cast("string"), 7, "0"))
    dec = table(spark, d, "part").where(f"p_partkey % 25 = 3 and p_partkey + 60 < {n}").select(key(k + 60).alias("a"), key(k).alias("b"), (k % 2).alias("same"))
    return resolution.grouped(listings(spark, d, dealt=True), dec)[0]


def _members(spark, d):
    """Listings in groups of seven."""
    return listings(spark, d).withColumn("group_id", F.concat(F.lit("G"), F.expr("cast(ord div 7 as string)")))


MEMBERS = f"{LISTINGS}, mb AS (SELECT *, 'G' || CAST(ord // 7 AS VARCHAR) AS group_id FROM l)"


@query("canonical", f"WITH {MEMBERS}, {PHOTOS} SELECT group_id, key AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY len(photos) DESC, length(description) DESC, coalesce(price, 1000000000), key) AS i FROM mb JOIN ph USING (key)) WHERE i = 1")
def canonical(spark, d):
    return resolution.canonical(_members(spark, d))


# -- store -----------------------------------------------------------------------------------------


def _snapshots(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("seen_at"), F.when(F.col("event_id") % 6 != 0, (F.col("event_id") * 7) % 5).alias("price"), F.col("event_type").alias("status"))


_SNAP = "sn AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, CASE WHEN event_id % 6 <> 0 THEN (event_id * 7) % 5 END AS price, event_type AS status FROM events)"


@query("upsert_latest", f"WITH {_SNAP}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS i, first_value(price) OVER (PARTITION BY key ORDER BY ts, event_id) AS p0 FROM sn) SELECT key, price, status, p0 AS price_first, true AS active FROM r WHERE i = 1")
def upsert_latest(spark, d):
    """The first half of the snapshots is stored, the second arrives."""
    s = _snapshots(spark, d)
    empty = s.limit(0).withColumn("first_seen", F.col("seen_at")).withColumn("price_first", F.col("price")).withColumn("active", F.lit(True))
    cut = s.groupBy("key").agg(F.percentile_approx("seen_at.event_id", 0.5).alias("cut"))
    s = s.join(cut, "key").withColumn("early", F.col("seen_at.event_id") <= F.col("cut")).drop("cut")
    stored = store.upserted(empty, s.where("early").drop("early"))
    return store.upserted(stored, s.where("not early").drop("early")).select("key", "price", "status", "price_first", "active")


@query("price_history", f"WITH {_SNAP}, p AS (SELECT key, ts, event_id, price, lag(price) OVER (PARTITION BY key ORDER BY ts, event_id) AS b FROM sn WHERE price IS NOT NULL) SELECT key, event_id, price FROM p WHERE price IS DISTINCT FROM b")
def price_history(spark, d):
    return store.price_changes(_snapshots(spark, d)).select("key", F.col("seen_at.event_id").alias("event_id"), "price")


@query("mark_inactive", f"WITH {LISTINGS} SELECT key, CASE WHEN source = 'src1' AND ord % 3 <> 0 THEN false ELSE active END AS active FROM l")
def mark_inactive(spark, d):
    ls = listings(spark, d)
    return store.marked_inactive(ls, "src1", ls.where("ord % 3 = 0")).select("key", "active")


@query("photo_append", "SELECT p_partkey % 50 AS k, 'u' || CAST(p_size AS VARCHAR) AS url, CAST(min(p_partkey % 9) AS INT) AS ord FROM part WHERE p_size % 4 <> 0 GROUP BY 1, 2")
def photo_append(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("key"), F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("url"), (F.col("p_partkey") % 9).cast("int").alias("ord"), (F.col("p_size") % 4 == 0).alias("old"))
    return store.new_photos(p.where("old").drop("old"), p.drop("old")).select(F.col("key").alias("k"), "url", "ord")


@query("review_merge", f"WITH {LISTINGS} SELECT key, CASE WHEN ord % 4 = 0 THEN 'new' ELSE 'old' END AS status, CASE WHEN ord % 6 = 0 THEN 'n' WHEN ord % 2 = 0 THEN 'o' END AS note FROM l WHERE ord % 3 <> 1 OR ord % 2 = 0")
def review_merge(spark, d):
    ls = listings(spark, d).where("ord % 3 <> 1 or ord % 2 = 0")
    old = ls.select("key", F.lit("old").alias("status"), F.when(F.col("ord") % 2 == 0, "o").alias("note"))
    new = ls.where("ord % 2 = 0").select("key", F.when(F.col("ord") % 4 == 0, "new").alias("status"), F.when(F.col("ord") % 6 == 0, "n").alias("note"))
    return store.merged_reviews(old, new)


@query("hidden_set", f"WITH {LISTINGS} SELECT key FROM l WHERE (ord % 5 = 0 OR ord % 7 = 0) AND ord % 3 <> 0")
def hidden_set(spark, d):
    ls = listings(spark, d)
    return store.hidden_after(ls.where("ord % 5 = 0"), ls.where("ord % 7 = 0"), ls.where("ord % 3 = 0"))


@query("votes_last", f"WITH {VOTES} SELECT group_id, person, vote FROM v")
def votes_last(spark, d):
    return store.votes_after(votes(spark, d)).drop("ts")


@query("decisions_last", "SELECT a, b, same FROM (SELECT least(user_id, user_id % 17) AS a, greatest(user_id, user_id % 17) AS b, event_id % 2 AS same, row_number() OVER (PARTITION BY least(user_id, user_id % 17), greatest(user_id, user_id % 17) ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def decisions_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("a"), (F.col("user_id") % 17).alias("b"), (F.col("event_id") % 2).alias("same"), F.struct("ts", "event_id").alias("ts"))
    return store.decisions_after(e).drop("ts")


@query("people_sync", "WITH o AS (SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) AS name FROM events), n AS (SELECT DISTINCT 'U' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(o.name, n.name) AS name, n.name IS NOT NULL AS active FROM o FULL JOIN n ON n.name = o.name")
def people_sync(spark, d):
    """Those of the events are stored, two of three customers are listed."""
    named = lambda t, c: table(spark, d, t).select(F.concat(F.lit("U"), F.col(c).cast("string")).alias("name"), c)
    stored = named("events", "user_id").select("name").distinct().withColumn("active", F.lit(True))
    return store.people_after(stored, named("customer", "c_custkey").where("c_custkey % 3 <> 0").select("name"))


@query("house_filter", f"WITH {LISTINGS} SELECT key FROM l WHERE coalesce(price <= 1.15 * 220000, true) AND coalesce(area_m2 >= 0.85::DOUBLE * 100, true) AND coalesce(nullif(bedrooms, 0) >= 3, true)")
def house_filter(spark, d):
    return store.wanted(listings(spark, d), 220_000, 100, 3).select("key")


@query("well_placed", f"WITH {LISTINGS} SELECT key FROM l WHERE place_score >= 20")
def well_placed(spark, d):
    return store.well_placed(listings(spark, d), 20).select("key")


@query("url_set", "SELECT DISTINCT url FROM pages ORDER BY url LIMIT 100")
def url_set(spark, d):
    return store.url_set(table(spark, d, "pages"), 100)


@query("search_area", "SELECT array_to_string(list_sort(list('c' || CAST(n_nationkey AS VARCHAR))), ' ') AS codes, (SELECT array_to_string(list_sort(list(DISTINCT p)), ' ') FROM (SELECT unnest([CAST(71000 + n_nationkey AS VARCHAR), CAST(71000 + n_nationkey // 2 AS VARCHAR)]) AS p FROM nation WHERE n_nationkey % 3 <> 0)) AS postcodes FROM nation WHERE n_nationkey % 3 <> 0")
def search_area(spark, d):
    k = F.col("n_nationkey")
    c = table(spark, d, "nation").select(F.concat(F.lit("c"), k.cast("string")).alias("code"), F.element_at(F.array(F.lit("excluded"), F.lit("green"), F.lit("amber")), k % 3 + 1).alias("status"), F.array((71000 + k).cast("string"), F.expr("cast(71000 + n_nationkey div 2 as string)")).alias("postcodes"))
    return store.search_area(c).select(F.array_join("codes", " ").alias("codes"), F.array_join("postcodes", " ").alias("postcodes"))


@query("listing_keys", "SELECT page_id, substr(sha1_hex, 1, 20) AS key FROM (SELECT page_id, sha1('web|' || CASE WHEN page_id % 3 = 0 THEN url ELSE 'i' || CAST(page_id AS VARCHAR) END) AS sha1_hex FROM pages)")
def listing_keys(spark, d):
    sid = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("i"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", store.listing_key(F.lit("web"), sid, F.col("url")).alias("key"))


GRID = Grid(5000.0, 5000.0, 4900.0, 200.0)
_PLACE = f"""{LISTINGS}, ls AS (SELECT key, CAST((ord * 71) % 10000 AS DOUBLE) AS x, CAST((ord * 53) % 10000 AS DOUBLE) AS y, (['housenumber', 'street', 'commune', 'none'])[ord % 4 + 1] AS gp, CAST(ord % 9 AS VARCHAR) AS cc FROM l),
  ce AS (SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST((p_partkey * 3) % 80 AS DOUBLE) AS score, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 7 END AS part FROM part),
  co AS (SELECT CAST(i AS VARCHAR) AS cc, (['green', 'amber', 'excluded'])[i % 3 + 1] AS status, 40.0 + i AS p90, i * 10 AS ha FROM range(6) t(i)),
  j AS (SELECT ls.*, ce.score, ce.part, co.status, co.p90, co.ha FROM ls LEFT JOIN ce ON sqrt((x - 5000) ** 2 + (y - 5000) ** 2) <= 4900 AND ce.r = floor((y - {GRID.y0}) / 200) AND ce.c = floor((x - {GRID.x0}) / 200) LEFT JOIN co USING (cc)),
  k AS (SELECT *, gp IN ('housenumber', 'street') AND score IS NOT NULL AS precise, coalesce(status <> 'excluded', false) AS bycom FROM j)"""


@query("place_cascade", f"WITH {_PLACE} SELECT key, CASE WHEN precise THEN score WHEN bycom THEN p90::DOUBLE ELSE score END AS place_score, CASE WHEN precise THEN CASE WHEN part IS NOT NULL THEN 'exact_zone' WHEN score > 0 THEN 'exact_ok' ELSE 'exact_out' END WHEN bycom THEN 'commune:' || status || ':' || CAST(ha AS VARCHAR) WHEN score IS NOT NULL THEN 'approx_coords' ELSE 'outside' END AS place_note FROM k")
def place_cascade(spark, d):
    o, k = F.col("ord"), F.col("p_partkey")
    ls = listings(spark, d).select("key", ((o * 71) % 10000).cast("double").alias("x"), ((o * 53) % 10000).cast("double").alias("y"), F.element_at(F.array(*map(F.lit, ["housenumber", "street", "commune", "none"])), (o % 4 + 1).cast("int")).alias("geo_precision"), (o % 9).cast("string").alias("commune_code"))
    c = table(spark, d, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("row"), (k % 50).cast("int").alias("col"), ((k * 3) % 80).cast("double").alias("score"), F.when(k % 5 == 0, k % 7).alias("part"))
    z = spark.range(7).select(F.col("id").alias("part"), (F.col("id") + 1).cast("int").alias("rank"))
    i = F.col("id")
    m = spark.range(6).select(i.cast("string").alias("code"), F.element_at(F.array(*map(F.lit, ["green", "amber", "excluded"])), (i % 3 + 1).cast("int")).alias("status"), (40.0 + i).alias("p90"), (i * 10.0).alias("area_good_ha"))
    return store.placed(ls, c, z, m, GRID).select("key", "place_score", "place_note")


@query("located", f"""WITH {LISTINGS}, ls AS (SELECT key, commune_code, 'rue ' || CAST(ord % 80 AS VARCHAR) AS address FROM l),
  ge AS (SELECT 'rue ' || CAST(i AS VARCHAR) AS address, 46 + i / 100.0::DOUBLE AS glat, 4 + i / 100.0::DOUBLE AS glon, CAST(i % 60 AS VARCHAR) AS gcode FROM range(70) t(i)), co AS (SELECT CAST(i AS VARCHAR) AS code, 45 + i / 100.0::DOUBLE AS clat, 5 + i / 100.0::DOUBLE AS clon FROM range(50) t(i)),
  j AS (SELECT key, coalesce(commune_code, gcode) AS code, glat, glon, glat IS NOT NULL AND (commune_code IS NULL OR commune_code = gcode) AS ok FROM ls LEFT JOIN ge USING (address))
  SELECT key, j.code AS commune_code, CASE WHEN ok THEN glat ELSE clat END AS lat, CASE WHEN ok THEN glon ELSE clon END AS lon, CASE WHEN ok THEN 'street' WHEN clat IS NOT NULL THEN 'commune' ELSE 'none' END AS geo_precision FROM j LEFT JOIN co ON co.code = j.code""")
def located(spark, d):
    o = F.col("ord")
    ls = listings(spark, d).select("key", "commune_code", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("none").alias("geo_precision"), F.concat(F.lit("rue "), (o % 80).cast("string")).alias("address"))
    i = F.col("id")
    g = spark.range(70).select(F.concat(F.lit("rue "), i.cast("string")).alias("query"), (46 + i / 100).alias("lat"), (4 + i / 100).alias("lon"), F.lit("street").alias("type"), (i % 60).cast("string").alias("citycode"))
    c = spark.range(50).select(i.cast("string").alias("code"), (45 + i / 100).alias("lat"), (5 + i / 100).alias("lon"))
    return store.located(ls, g, c).select("key", "commune_code", "lat", "lon", "geo_precision")


# -- views -----------------------------------------------------------------------------------------

_STATUS = f"""{GROUPS}, {VOTES}, st AS (SELECT group_id, coalesce(list_sort(list_distinct(list(person) FILTER (WHERE vote = 'like' AND person IN ('P0', 'P1')))), []) AS liked, coalesce(bool_or(vote = 'pass'), false) AS rejected,
  coalesce(list(person) FILTER (WHERE person IN ('P0', 'P1')), []) AS voted FROM gr LEFT JOIN v USING (group_id) GROUP BY group_id)"""


def _status(spark, d):
    return views.vote_status(groups(spark, d), store.votes_after(votes(spark, d)), people(spark))


@query("vote_status", f"WITH {_STATUS} SELECT group_id, array_to_string(liked, ' ') AS liked_by, array_to_string(list_filter(['P0', 'P1'], lambda p: NOT list_contains(voted, p)), ' ') AS waiting_for, rejected, len(liked) = 2 AS matched FROM st")
def vote_status(spark, d):
    return _status(spark, d).select("group_id", F.array_join("liked_by", " ").alias("liked_by"), F.array_join("waiting_for", " ").alias("waiting_for"), "rejected", "matched")


@query("queue", f"WITH {GROUPS}, {VOTES} SELECT group_id, place_score, (SELECT count(*) FROM v WHERE v.group_id = gr.group_id AND person <> 'P0' AND vote = 'like') AS likes FROM gr WHERE group_id NOT IN (SELECT group_id FROM v WHERE person = 'P0') AND group_id NOT IN (SELECT group_id FROM v WHERE person <> 'P0' AND vote = 'pass')")
def queue(spark, d):
    return views.queue(groups(spark, d), store.votes_after(votes(spark, d)), "P0")


@query("matches", f"WITH {_STATUS} SELECT group_id, place_score FROM st JOIN gr USING (group_id) WHERE len(liked) = 2")
def matches(spark, d):
    return views.matches(groups(spark, d), _status(spark, d)).select("group_id", "place_score")


@query("liked_unmatched", f"WITH {_STATUS} SELECT group_id, place_score FROM st JOIN gr USING (group_id) WHERE len(liked) < 2 AND list_contains(liked, 'P1')")
def liked_unmatched(spark, d):
    return views.liked_unmatched(groups(spark, d), _status(spark, d), "P1").select("group_id", "place_score")


@query("counters", f"WITH {_STATUS}, k AS (SELECT unnest(CASE WHEN len(liked) = 2 THEN ['match'] WHEN rejected THEN ['rejected'] ELSE list_transform(list_filter(['P0', 'P1'], lambda p: NOT list_contains(voted, p)), lambda p: 'waiting:' || p) END) AS counter FROM st) SELECT counter, count(*) AS n FROM k GROUP BY counter")
def counters(spark, d):
    return views.counters(_status(spark, d))


@query("vote_pivot", f"WITH {VOTES} SELECT group_id, string_agg(person || '=' || vote, ',' ORDER BY person) AS votes FROM v GROUP BY group_id")
def vote_pivot(spark, d):
    return views.vote_pivot(store.votes_after(votes(spark, d))).select("group_id", F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("votes"))


@query("votes_by_person", f"WITH {VOTES} SELECT p AS person, count(vote) FILTER (WHERE vote = 'like') AS n_like, count(vote) FILTER (WHERE vote = 'maybe') AS n_maybe, count(vote) FILTER (WHERE vote = 'pass') AS n_pass, count(vote) AS total, greatest(0, 110 - count(vote)) AS pending FROM (VALUES ('P0'), ('P1')) t(p) LEFT JOIN v ON person = p GROUP BY p")
def votes_by_person(spark, d):
    return views.votes_by_person(store.votes_after(votes(spark, d)), people(spark), 110)


@query("match_reviews", f"WITH {_STATUS} SELECT group_id AS key, CASE WHEN len(liked) = 2 THEN 'visit' ELSE 'new' END AS status FROM st")
def match_reviews(spark, d):
    return views.matched_reviews(groups(spark, d).select(F.col("group_id").alias("key"), F.lit("new").alias("status")), _status(spark, d))


def _photos(spark, d):
    return listings(spark, d).select("key", F.explode(F.sequence(F.lit(0), (F.col("ord") % 4).cast("int"))).alias("ord")).withColumn("url", F.concat("key", F.lit("/"), F.col("ord").cast("string")))


def _group_list(spark, d):
    m = _members(spark, d)
    hidden = m.where("ord % 101 = 0").select("key")
    reviews = m.select("group_id").distinct().where("group_id like '%3'").select(F.col("group_id").alias("key"), F.lit("visit").alias("status"))
    return views.group_list(m, hidden, reviews, _photos(spark, d))


_GL = f"""{MEMBERS}, gs AS (SELECT group_id, count(*) AS n_listings, min(price) AS price_min, max(price) AS price_max FROM mb GROUP BY group_id HAVING NOT bool_or(ord % 101 = 0)),
  hd AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY price IS NULL, length(description) DESC, key) AS i FROM mb), gl AS (SELECT gs.*, hd.key AS canonical, hd.price, hd.area_m2, hd.bedrooms, hd.place_score, hd.has_pool, hd.first_seen, hd.key || '/0' AS photo, CASE WHEN gs.group_id LIKE '%3' THEN 'visit' ELSE 'new' END AS status FROM gs JOIN hd USING (group_id) WHERE i = 1)"""


@query("group_list", f"WITH {_GL} SELECT group_id, n_listings, price_min, price_max, canonical, photo, status FROM gl")
def group_list(spark, d):
    return _group_list(spark, d).select("group_id", "n_listings", "price_min", "price_max", "canonical", "photo", "status")


@query("group_filters", f"WITH {_GL} SELECT group_id FROM gl WHERE status = 'new' AND coalesce(place_score, 0) >= 20 AND (price IS NULL OR price <= 250000) AND coalesce(price, 0) >= 160000 AND coalesce(area_m2, 0) >= 70 AND coalesce(bedrooms, 0) >= 1 AND coalesce(has_pool, false)")
def group_filters(spark, d):
    return views.filtered(_group_list(spark, d), "new", 20, 250_000, 160_000, 70, 1, ("pool",)).select("group_id")


def _sorted(by: str, sql_order: str) -> None:
    @query(f"group_sort_{by}", f"WITH {_GL} SELECT group_id, CAST(row_number() OVER (ORDER BY {sql_order}, group_id) AS INT) AS i FROM gl")
    def run(spark, d):
        from pyspark.sql import Window

        return _group_list(spark, d).select("group_id", F.row_number().over(Window.orderBy(*views.order(by))).alias("i"))


_sorted("score", "coalesce(place_score, 0) DESC")
_sorted("price", "coalesce(price, 1000000000)")
_sorted("new", "first_seen DESC")
_sorted("area", "coalesce(area_m2, 0) DESC")


@query("group_detail", f"WITH {MEMBERS}, ca AS (SELECT group_id, min(key) AS canonical FROM mb GROUP BY group_id) SELECT group_id, canonical, coalesce(string_agg(key, ' ' ORDER BY key) FILTER (WHERE key <> canonical), '') AS others, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources, min(price) AS price_min, max(price) AS price_max FROM mb JOIN ca USING (group_id) GROUP BY group_id, canonical")
def group_detail(spark, d):
    m = _members(spark, d)
    c = m.groupBy("group_id").agg(F.min("key").alias("canonical"))
    none = m.select(F.col("group_id").alias("key"), F.lit("x").alias("status")).limit(0)
    return views.group_detail(m, c, none).select("group_id", "canonical", F.array_join("others", " ").alias("others"), F.array_join("sources", " ").alias("sources"), "price_min", "price_max")


def _links(spark, d):
    m = _members(spark, d).where("ord % 7 < 3")
    return m.select("key", "group_id", F.element_at(F.array(F.lit("photo"), F.lit("price, text"), F.lit("")), (F.col("ord") % 3 + 1).cast("int")).alias("method"), ((F.col("ord") % 10) / 10.0).alias("confidence"))


_LK = f"{MEMBERS}, lk AS (SELECT key, group_id, (['photo', 'price, text', ''])[ord % 3 + 1] AS method, (ord % 10) / 10.0::DOUBLE AS confidence FROM mb WHERE ord % 7 < 3)"


@query("merged_groups", f"WITH {_LK} SELECT group_id, count(*) AS n, string_agg(key, ' ' ORDER BY key) AS members, max(confidence) AS confidence, coalesce(array_to_string(list_sort(list(DISTINCT method) FILTER (WHERE method <> '')), ' | '), '') AS methods FROM lk GROUP BY group_id HAVING count(*) > 1")
def merged_groups(spark, d):
    return views.merged_groups(_links(spark, d)).select("group_id", "n", F.array_join("members", " ").alias("members"), "confidence", F.array_join("methods", " | ").alias("methods"))


@query("totals", f"WITH {_LK} SELECT (SELECT count(*) FROM l) AS listings, (SELECT count(DISTINCT coalesce(lk.group_id, l.key)) FROM l LEFT JOIN lk USING (key)) AS groups, (SELECT greatest(0, count(*) - count(DISTINCT group_id)) FROM lk) AS duplicates")
def totals(spark, d):
    status = _status(spark, d)
    return views.totals(listings(spark, d), _links(spark, d), _links(spark, d).select("key"), status).select("listings", "groups", "duplicates")


@query("rebuild_summary", f"WITH {_LK} SELECT (SELECT count(*) FROM l) AS listings, (SELECT count(*) FROM lk WHERE method = 'photo') AS links, (SELECT count(*) FROM lk WHERE method = '') AS candidates")
def rebuild_summary(spark, d):
    k = _links(spark, d)
    return views.rebuild_summary(listings(spark, d), k, k.where("method = 'photo'"), k.where("method = ''")).select("listings", "links", "candidates")


@query("source_stats", f"WITH {LISTINGS} SELECT source, count(*) AS n, count(*) FILTER (WHERE active) AS active, round(avg(place_score), 4) AS mean_score FROM l GROUP BY source")
def source_stats(spark, d):
    return views.source_stats(listings(spark, d)).select("source", "n", "active", F.round("mean_score", 4).alias("mean_score"))


@query("price_drops", f"WITH {LISTINGS} SELECT key, price_first - price AS drop FROM l WHERE price < price_first ORDER BY price_first - price DESC, key LIMIT 10")
def price_drops(spark, d):
    return views.price_drops(listings(spark, d)).select("key", "drop")


@query("score_distribution", f"WITH {LISTINGS} SELECT count(*) FILTER (WHERE place_score >= 60) AS high, count(*) FILTER (WHERE place_score >= 45 AND place_score < 60) AS middle, count(*) FILTER (WHERE place_score < 45) AS low, count(*) FILTER (WHERE place_score IS NULL) AS unknown FROM l")
def score_distribution(spark, d):
    return views.score_distribution(listings(spark, d))


@query("run_summary", "SELECT 'src' || CAST(user_id % 4 AS VARCHAR) AS source, event_type AS event, CASE WHEN event_type = 'error' THEN 'r' || CAST(event_id % 3 AS VARCHAR) END AS reason, count(*) AS n FROM events GROUP BY 1, 2, 3")
def run_summary(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string")).alias("source"), F.col("event_type").alias("event"), F.when(F.col("event_type") == "error", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string"))).alias("reason"))
    return views.run_summary(e)


@query("map_points", f"WITH {LISTINGS} SELECT key, 46.0::DOUBLE + (ord % 100) / 100.0::DOUBLE AS lat, ord % 4 NOT IN (0, 1) AS approx FROM l WHERE ord % 6 <> 0")
def map_points(spark, d):
    o = F.col("ord")
    ls = listings(spark, d).withColumn("lat", F.when(o % 6 != 0, 46.0 + (o % 100) / 100.0)).withColumn("lon", F.lit(4.0)).withColumn("geo_precision", F.element_at(F.array(F.lit("housenumber"), F.lit("street"), F.lit("commune"), F.lit(None).cast("string")), (o % 4 + 1).cast("int")))
    return views.map_points(ls).select("key", "lat", "approx")


@query("candidate_pairs", f"WITH {LISTINGS}, cd AS (SELECT x.key AS a, y.key AS b, CAST(x.ord % 5 AS INT) AS score FROM l x JOIN l y ON y.ord = x.ord + 60 WHERE x.active AND y.active) SELECT a, b, score FROM cd")
def candidate_pairs(spark, d):
    ls = listings(spark, d)
    b = ls.select(F.col("key").alias("b"), (F.col("ord") - 60).alias("ord"))
    c = ls.join(b, "ord").select(F.col("key").alias("a"), "b", (F.col("ord") % 5).cast("int").alias("score"))
    return views.candidate_pairs(c, ls, _photos(spark, d)).select("a", "b", "score")


@query("first_photos", f"WITH {LISTINGS} SELECT key, CAST(i AS INT) AS ord FROM l, range(3) t(i) WHERE i <= ord % 4")
def first_photos(spark, d):
    return views.first_photos(_photos(spark, d), 3).select("key", "ord")


@query("nested_photos", f"WITH {LISTINGS} SELECT key, CAST(1 + ord % 4 AS INT) AS n, key || '/0' AS first FROM l")
def nested_photos(spark, d):
    return store.with_photos(listings(spark, d).drop("photos"), _photos(spark, d)).select("key", F.size("photos").alias("n"), F.col("photos")[0]["url"].alias("first"))


# -- sinks -----------------------------------------------------------------------------------------


@query("delimited", "SELECT CAST(p_partkey AS VARCHAR) || ';' || replace(p_name, ';', ',') || ';a, b' || CASE WHEN p_size % 2 = 0 THEN ';x,y' ELSE ';' END AS line FROM part")
def delimited(spark, d):
    return sinks.delimited(table(spark, d, "part").select("p_partkey", "p_name", F.array(F.lit("a"), F.lit("b")).alias("l"), F.when(F.col("p_size") % 2 == 0, "x;y").alias("s")))


def _wgs(dx: int, dy: int) -> str:
    """[lon,lat] of a cell's corner as JSON text: the inverse projection, its latitude by six steps."""
    vx, vy = f"(x + {dx}::DOUBLE - {geo._X0})", f"({geo._Y0 + geo._R0!r}::DOUBLE - (y + {dy}::DOUBLE))"
    t = f"pow(sqrt({vx} * {vx} + {vy} * {vy}) / {geo._A * geo._F!r}::DOUBLE, {1 / geo._N!r}::DOUBLE)"
    step = f"pi() / 2 - 2 * atan({t} * pow((1 - {geo._E} * sin(lat)) / (1 + {geo._E} * sin(lat)), {geo._E / 2}))"
    lat = f"list_reduce([1, 2, 3, 4, 5, 6], lambda lat, i: {step}, pi() / 2 - 2 * atan({t}))"
    return f"'[' || CAST(round(degrees(atan2({vx}, {vy}) / {geo._N!r}::DOUBLE + {geo._LON0!r}::DOUBLE), 5) AS VARCHAR) || ',' || CAST(round(degrees({lat}), 5) AS VARCHAR) || ']'"


@query("geojson_cells", f"""WITH c AS (SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, 830000.0::DOUBLE + (p_partkey % 50) * 200 AS x, 6570000.0::DOUBLE + (p_partkey // 50) * 200 AS y, CAST(p_size AS DOUBLE) AS score FROM part),
  k AS (SELECT *, {_wgs(-100, -100)} AS sw, {_wgs(100, -100)} AS se, {_wgs(100, 100)} AS ne, {_wgs(-100, 100)} AS nw FROM c)
  SELECT row, col, '{{"type":"Feature","properties":{{"score":' || CAST(score AS VARCHAR) || '}},"geometry":{{"type":"Polygon","coordinates":[[' || sw || ',' || se || ',' || ne || ',' || nw || ',' || sw || ']]}}}}' AS feature FROM k""")
def geojson_cells(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("row"), (k % 50).cast("int").alias("col"), (830000.0 + (k % 50) * 200).alias("x"), (6570000.0 + F.expr("p_partkey div 50") * 200).alias("y"), F.col("p_size").cast("double").alias("score"))
    return sinks.geojson_features(c, 100.0)


@query("whitelist_json", """WITH c AS (SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS code, (['excluded', 'green', 'amber'])[s_suppkey % 3 + 1] AS status, CAST(s_suppkey % 100 AS DOUBLE) AS p90 FROM supplier),
  k AS (SELECT string_agg('"' || code || '"', ',' ORDER BY code) FILTER (WHERE status = 'green') AS green, string_agg('"' || code || '"', ',' ORDER BY code) FILTER (WHERE status = 'amber') AS amber,
    string_agg('"' || code || '":{"status":"' || status || '","p90":' || CAST(p90 AS VARCHAR) || '}', ',' ORDER BY code) FILTER (WHERE status <> 'excluded') AS communes FROM c),
  z AS (SELECT string_agg('{"rank":' || CAST(n_nationkey + 1 AS VARCHAR) || ',"score_max":' || CAST(n_nationkey * 5.0::DOUBLE AS VARCHAR) || '}', ',' ORDER BY n_nationkey) AS zones FROM nation)
  SELECT '{"green":[' || green || '],"amber":[' || amber || '],"communes":{' || communes || '},"zones":[' || zones || ']}' AS whitelist FROM k, z""")
def whitelist_json(spark, d):
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(F.concat(F.lit("c"), F.lpad(k.cast("string"), 9, "0")).alias("code"), F.element_at(F.array(*map(F.lit, ["excluded", "green", "amber"])), (k % 3 + 1).cast("int")).alias("status"), (k % 100).cast("double").alias("p90"))
    z = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("rank"), (F.col("n_nationkey") * 5.0).alias("score_max"))
    return sinks.whitelist(c, z)


@query("navigation", f"""WITH {_STATUS}, {LISTINGS}, m AS (SELECT *, len(liked) = 2 AS matched FROM st), w AS (SELECT *, list_filter(['P0', 'P1'], lambda p: NOT list_contains(voted, p)) AS waits FROM m),
  k AS (SELECT unnest(CASE WHEN matched THEN ['match'] WHEN rejected THEN ['rejected'] ELSE list_transform(waits, lambda p: 'waiting:' || p) END) AS counter FROM w UNION ALL SELECT 'mine' FROM w WHERE NOT matched AND NOT rejected AND list_contains(waits, 'P0')
    UNION ALL SELECT 'liked' FROM w WHERE NOT matched AND list_contains(liked, 'P0') UNION ALL SELECT 'dups' FROM l x JOIN l y ON y.ord = x.ord + 60 WHERE x.active AND y.active)
  SELECT counter, coalesce(n, 0) AS n FROM (SELECT counter, count(*) AS n FROM k GROUP BY counter) FULL JOIN (SELECT unnest(['match', 'rejected', 'mine', 'liked', 'dups']) AS counter) USING (counter)""")
def navigation(spark, d):
    """One person's menu counters over groups, votes and open candidates."""
    ls = listings(spark, d)
    b = ls.select(F.col("key").alias("b"), (F.col("ord") - 60).alias("ord"))
    c = ls.join(b, "ord").select(F.col("key").alias("a"), "b", (F.col("ord") % 5).cast("int").alias("score"))
    return views.navigation(_status(spark, d), views.candidate_pairs(c, ls, _photos(spark, d)), "P0")


@query("hidden_list", f"WITH {MEMBERS} SELECT group_id, count(*) AS n_listings FROM mb GROUP BY group_id HAVING bool_or(ord % 101 = 0)")
def hidden_list(spark, d):
    m = _members(spark, d)
    none = m.select(F.col("group_id").alias("key"), F.lit("x").alias("status")).limit(0)
    return views.group_list(m, m.where("ord % 101 = 0").select("key"), none, _photos(spark, d), only_hidden=True).select("group_id", "n_listings")


@query("photos_to_hash", f"WITH {LISTINGS} SELECT key, CAST(i AS INT) AS ord FROM l, range(2) t(i) WHERE i <= ord % 4 AND NOT (i = 0 AND ord % 3 = 0)")
def photos_to_hash(spark, d):
    """The first two photos of each listing, less those hashed before."""
    p = _photos(spark, d)
    hashed = listings(spark, d).where("ord % 3 = 0").select("key", F.concat("key", F.lit("/0")).alias("url"))
    return store.to_hash(p, hashed, 2).select("key", "ord")


@query("api_records", "SELECT p_partkey AS id, CAST(100000 + p_size AS INT) AS price FROM part WHERE p_size % 3 <> 0")
def api_records(spark, d):
    item = F.to_json(F.struct(F.col("p_partkey").alias("id"), (100000 + F.col("p_size")).cast("int").alias("price"), F.when(F.col("p_size") % 3 == 0, "RENT").otherwise("SALE").alias("deal")))
    records = table(spark, d, "part").select(F.concat(F.lit('{"items":['), item, F.lit("]}")).alias("body"))
    return sources.api_listings(records, "items", "struct<id:long,price:int,deal:string>", F.col("r.deal") == "SALE", {"id": F.col("r.id"), "price": F.col("r.price")})


@query("photo_matches", f"WITH {_HEX}, p AS (SELECT vec_id // 3 AS key, list(('0x' || hash)::UBIGINT ORDER BY vec_id) AS photos FROM h GROUP BY vec_id // 3) SELECT a.key AS a, CAST(len(list_filter(a.photos, lambda x: len(list_filter(b.photos, lambda y: bit_count(xor(x, y)) <= 8)) > 0)) AS INT) AS hits, CAST(list_min(flatten(list_transform(a.photos, lambda x: list_transform(b.photos, lambda y: bit_count(xor(x, y)))))) AS INT) AS best FROM p a JOIN p b ON b.key = a.key + 1")
def photo_matches(spark, d):
    """Photo hits of embeddings' sign hashes, three photos a listing."""
    h = _hashes(spark, d).withColumn("key", F.expr("vec_id div 3"))
    p = h.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda s: F.struct(s["h"].alias("phash"), s["h"].alias("dhash"))).alias("photos"))
    a, b = p.select(F.col("key").alias("a"), F.col("photos").alias("pa")), p.select((F.col("key") - 1).alias("a"), F.col("photos").alias("pb"))
    return a.join(b, "a").select("a", resolution.photo_hits(F.col("pa"), F.col("pb")).alias("hits"), resolution.photo_best(F.col("pa"), F.col("pb")).cast("int").alias("best"))


@query("place_notes", "SELECT p_partkey, (['commune', 'exact_zone'])[p_partkey % 2 + 1] AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'green' END AS status, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) END AS ha FROM part")
def place_notes(spark, d):
    note = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("commune:green:"), F.col("p_size").cast("string"))).otherwise("exact_zone")
    return table(spark, d, "part").select("p_partkey", store.place_note_parts(note).alias("n")).select("p_partkey", "n.*")
