import random
from pyspark.sql import functions as F

from georesolve.operators import resolution, store
from georesolve.sources import listings as sources

SCHEMA = "key string, ord int, price int, area_m2 double, rooms int, land_m2 double, commune_code string, commune_name string, title string, description string, photos array<struct<ord:int,phash:string,dhash:string>>"


def photos(*seeds):
    return [(i, f"{(s * 0x9E3779B97F4A7C15) % 2**64:016x}", f"{(s * 0xC2B2AE3D27D4EB4F) % 2**64:016x}") for i, s in enumerate(seeds)]


def listing(key, ord_, price, area, seeds, text="belle maison au calme avec jardin", rooms=5):
    return (key, ord_, price, float(area) if area else None, rooms, None, "71235", "Cluny", text, "", photos(*seeds))


def run(spark, rows, decisions=None):
    df = spark.createDataFrame(rows, SCHEMA)
    d = spark.createDataFrame(decisions, "a string, b string, same int") if decisions else None
    g, links, cand = resolution.grouped(df, d)
    return {r.key: r.group_id for r in g.collect()}, links.collect(), cand.collect()


def test_same_house_two_agencies(spark):
    g, links, _ = run(spark, [listing("a", 1, 349000, 145, [1, 2, 3]), listing("b", 2, 330000, 146, [1, 2, 9])])
    assert g["a"] == g["b"] == "a" and links[0].method == "photo" and links[0].confidence >= 0.8


def test_similar_house_is_a_near_miss_only(spark):
    g, links, cand = run(spark, [listing("a", 1, 349000, 145, [1, 2]), listing("b", 2, 352000, 144, [50, 51], "autre texte sans rapport aucun")])
    assert g["a"] != g["b"] and not links and "price" in cand[0].reason


def test_grouping_and_manual_decisions(spark):
    rows = [listing("a", 1, 349000, 145, [1, 2]), listing("b", 2, 330000, 146, [1, 7]), listing("c", 3, 275000, 98, [30, 31], "tout autre chose ici")]
    g, links, _ = run(spark, rows)
    assert g == {"a": "a", "b": "a", "c": "c"} and len(links) == 1
    g, _, _ = run(spark, rows, [("b", "a", 0)])
    assert len(set(g.values())) == 3
    g, _, _ = run(spark, [listing("x", 1, 349000, 145, [1, 2]), listing("y", 2, 210000, 88, [60, 61], "rien", 2)], [("x", "y", 1)])
    assert len(set(g.values())) == 1


def test_canonical_has_most_photos(spark):
    rows = [listing("p", 1, 349000, 145, [1]), listing("r", 2, 355000, 145, [1, 2, 3], "x" * 400)]
    m = spark.createDataFrame(rows, SCHEMA).withColumn("group_id", F.lit("g"))
    assert resolution.canonical(m).first().canonical == "r"


def test_missing_hash_and_distance(spark):
    r = spark.range(1).select(resolution.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000000")).alias("a"), resolution.hamming(F.lit(None).cast("string"), F.lit("0")).alias("b")).first()
    assert (r.a, r.b) == (64, 999)


def test_unknown_vote_is_an_error(spark):
    import pytest

    votes = spark.createDataFrame([("g", "p", "love", 1)], "group_id string, person string, vote string, ts int")
    with pytest.raises(Exception, match="unknown vote"):
        store.votes_after(votes).collect()


def test_jsonld_page_becomes_a_listing(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"House","name":"Maison","offers":{"price":"250 000"},"floorSize":{"value":"120,5"},"geo":{"latitude":"46.3","longitude":"4.8"}}]}</script><p>5 pièces, 260 000&nbsp;€ hors honoraires</p>'
    r = sources.from_jsonld(spark.createDataFrame([("http://e.org/1", html)], "url string, html string")).first()
    assert (r.price, r.area_m2, r.rooms, r.fees_included, r.geo_precision) == (250000, 120.5, 5, False, "address")


def _nowhere(key, ord_, seeds, turned=0):
    """A listing without commune and area; its first photo differs from the seed's by some bits."""
    own = photos(*seeds)
    if own and turned:
        own[0] = (0, f"{int(own[0][1], 16) ^ ((1 << turned) - 1):016x}", None)
    return (key, ord_, 200000, None, None, None, None, None, f"texte {key}", "", own)


def test_listings_without_place_and_area_link_by_photos(spark):
    rows = [_nowhere("a", 1, [5]), _nowhere("b", 2, [5], 8), _nowhere("c", 3, [6]), _nowhere("d", 4, [6], 14), _nowhere("e", 5, [7]), _nowhere("f", 6, [7], 15), _nowhere("g", 7, []), listing("h", 8, 200000, None, [5])]
    g, links, cand = run(spark, rows)
    assert [(x.a, x.b, x.method) for x in links] == [("a", "b", "photo")] and g["b"] == "a"
    assert [(x.a, x.b, x.reason) for x in cand] == [("c", "d", "similar photos")]  # h has a place: another block


def test_photo_index_and_direct_comparison_agree_with_brute_force(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    turned = lambda h, n: h ^ sum(1 << i for i in rng.sample(range(64), n))
    rows = []
    for i in range(120):
        own = [(0, f"{turned(base[i % 12], rng.randint(0, 18)):016x}", None if i % 3 else f"{turned(base[i // 12], rng.randint(0, 12)):016x}")]
        rows.append((f"k{i:03d}", i, None, rng.choice([None, 100.0, 118.0, 131.0, 152.0]), None, None, rng.choice(["1", None]), "", "", "", own))
    block = {r[0]: (r[6] or "?", None if r[3] is None else int(r[3] // 10)) for r in rows}
    near = lambda x, y: block[x][0] == block[y][0] and (block[x][1] is None) == (block[y][1] is None) and abs((block[x][1] or 0) - (block[y][1] or 0)) <= 2
    apart = lambda p, q: min([(int(a, 16) ^ int(b, 16)).bit_count() for a, b in ((p[1], q[1]), (p[2], q[2])) if a and b], default=999)
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if near(x[0], y[0]) and apart(x[10][0], y[10][0]) <= 14}
    df = spark.createDataFrame(rows, SCHEMA)
    for direct in (4096, 0):
        monkeypatch.setattr(resolution, "DIRECT", direct)
        assert {tuple(r) for r in resolution.photo_pairs(df).collect()} == want


def test_no_side_of_a_pair_join_is_sent_to_the_driver(spark, data):
    from georesolve.queries.base import QUERIES

    for name in ("blocking", "pair_decision", "near_miss"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, name


def test_tiles_of_hashes_find_what_all_pairs_have(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(40)]
    rows = [(f"k{i % 350:03d}", "phash", "p", None if i % 9 == 0 else i % 11, base[i % 40] ^ sum(1 << b for b in r.sample(range(63), i % 12))) for i in range(700)]
    got = {tuple(x) for x in resolution._tiled(spark.createDataFrame(rows, "k string, kind string, place string, bucket long, v long"), tile=90).collect()}
    near = lambda x, y: (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= 2)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a[3], b[3]) and (a[4] ^ b[4]).bit_count() <= 14}
    assert got == want


def test_many_hashes_meet_at_fewer_and_longer_pieces(spark, monkeypatch):
    assert resolution.pieces_for(4_000, 8) == 9 and resolution.pieces_for(1_200_000, 8) == 5
    strangers = lambda n: resolution._keys_and_strangers(n, 8, resolution.pieces_for(n, 8))[1]
    assert strangers(1_200_000) < 0.2 * 1_200_000**2 * 9 / 2 ** (64 / 9)
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(20)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), n)) for v in values for n in (0, 1, 7, 8, 9)]
    rows = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)] + [(999, None), (998, "")], "k long, h string")
    near = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 8}
    for cost in (20, 0.5, 0.0):  # 9, 5 and 3 pieces
        monkeypatch.setattr(resolution, "KEY_COST", cost)
        got = [tuple(r) for r in resolution.near_hashes(rows, "k", "h").collect()]
        assert len(got) == len(set(got)) and set(got) == near
    assert resolution.pieces_for(120, 8) == 3


def _odd_listings(n=160):
    """Listings of three places and none, with what may be missing or odd."""
    rng = random.Random(5)
    words = ["belle", "maison", "au", "calme", "avec", "jardin", "et", "garage"]
    turned = lambda h: h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 17)))
    hashes = [rng.getrandbits(64) for _ in range(9)]
    some = lambda *of: rng.choice(of)
    rows = []
    for i in range(n):
        own = [(j, some(f"{turned(some(*hashes)):016x}", f"{turned(some(*hashes)):016x}", None, ""), some(f"{turned(some(*hashes)):016x}", None)) for j in range(rng.randint(0, 3))]
        code, name = some(("1", "Cluny"), ("1", "Cluny"), (None, "1"), ("", "Mâcon"), ("2", None), (None, None))
        text = some("", "maison", " ".join(rng.sample(words, 6)), " ".join(words[: rng.randint(1, 8)]))
        rows.append((f"k{i:03d}", i, some(None, 0, 200000, 210000, 230000), some(None, 100.0, 101.5, 109.0, 110.5, 118.0, 121.0, 0.0), some(None, 0, 4, 5), some(None, 0.0, 500.0, 540.0, 600.0, float("nan")), code, name, text, some("", "beau"), some(own, own, None)))
    return rows


def test_tiles_measure_what_joins_do(spark, monkeypatch):
    from georesolve.operators import pairtiles

    df = spark.createDataFrame(_odd_listings(), SCHEMA)
    d = spark.createDataFrame([("k003", "k001", 0), ("k007", "k150", 0), ("k020", "k090", 1), ("k001", "k002", 0)], "a string, b string, same int")

    def found():
        rows = resolution.compared_candidates(df).collect()
        assert len(rows) == len({(r.a, r.b) for r in rows})
        # What lies beyond the near-miss limit is not told apart.
        pairs = {(r.a, r.b): (r.hits, min(r.best_bits, 15), r.attrs, r.price, r.text_sim, r.both_photos) for r in rows}
        groups, *given = resolution.grouped(df, d)
        return pairs, [sorted((tuple(r) for r in x.collect()), key=repr) for x in (groups, *given)]

    joined = found()
    assert len(joined[0]) > 300 and all(len(x) > 10 for x in joined[1])
    # Some places by joins, some by tiles; all by tiles.
    for least, tile, block, texts in ((45, 8192, 1 << 18, 1 << 22), (0, 7, 40, 0)):
        monkeypatch.setattr(resolution, "JOINED", least)
        for name, value in (("TILE", tile), ("BLOCK", block), ("TEXTS", texts)):
            monkeypatch.setattr(pairtiles, name, value)
        assert found() == joined


def test_groups_of_a_large_place_take_few_edges(spark, monkeypatch):
    seen = []
    whole = resolution.group_edges
    monkeypatch.setattr(resolution, "JOINED", 100, raising=False)
    monkeypatch.setattr(resolution, "group_edges", lambda nodes, links: (seen.append(links.count()), whole(nodes, links))[1])
    rows = [listing(f"a{i:03d}", i, 200000, 100 if i % 2 else 130, []) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    d = spark.createDataFrame([("a000", "a001", 1), ("a002", "a004", 0)], "a string, b string, same int")
    for decisions, groups in ((None, {"a000", "a001"}), (d, {"a000"})):
        assert {r.group_id for r in resolution.grouped(df, decisions)[0].collect()} == groups
    assert max(seen) <= 300  # all links are 22,350


def test_a_block_of_thousands_is_shuffled_once(spark):
    n = 4000
    of = lambda x: spark.range(n).select(F.format_string("k%06d", "id").alias(x), F.lit("p").alias("place"), F.lit(7).cast("long").alias("bucket"))
    left, right = resolution._in_parts(of("a"), of("b"), "bucket")
    assert (left.count(), right.count()) == (n, n)  # each left part takes another copy of the right side
    assert resolution._met(of("a"), of("b"), "bucket").where("a < b").count() == n * (n - 1) // 2
