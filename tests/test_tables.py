"""Stored tables: bootstrap, replay, touched buckets, and a stream into them."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from georesolve.operators.tables import TABLES, Tables
from georesolve.streaming import ingest

BATCH = "key string, seen_at timestamp, price int, title string, photos array<string>, extra int"


def at(day):
    return datetime(2026, 1, day)


def content(tables):
    return {n: sorted(map(str, tables.read(n).collect())) for n in TABLES}


def test_bootstrap_and_replay_change_nothing(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}", buckets=8)
    t.bootstrap()
    assert all(t.read(n).count() == 0 for n in TABLES)
    first = spark.createDataFrame([("a", at(1), 100, "A", ["u1", "u2"], 1), ("b", at(1), 200, "B", [], 1)], BATCH)
    second = spark.createDataFrame([("a", at(3), 90, "A again", ["u2", "u3"], 1), ("c", at(3), None, "C", None, 1)], BATCH)
    t.put_listings(first)
    t.put_listings(second)
    rows = {r.key: r for r in t.read("listing").collect()}
    assert (rows["a"].price, rows["a"].price_first, rows["a"].title, rows["a"].first_seen, rows["a"].active) == (90, 100, "A again", at(1), True) and len(rows) == 3
    assert {(r.key, r.url) for r in t.read("photo").collect()} == {("a", "u1"), ("a", "u2"), ("a", "u3")}
    assert {(r.key, r.seen_at, r.price) for r in t.read("price_history").collect()} == {("a", at(1), 100), ("a", at(3), 90), ("b", at(1), 200)}
    before = content(t)
    t.bootstrap()
    t.put_listings(second)
    t.put_listings(second.limit(0))
    assert content(t) == before
    late = spark.createDataFrame([("a", at(2), 90)], "key string, seen_at timestamp, price int")
    t.put("price_history", late)  # the price fell a day earlier than it was known
    assert {(r.seen_at, r.price) for r in t.read("price_history").where("key = 'a'").collect()} == {(at(1), 100), (at(2), 90)}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}", buckets=8)
    t.bootstrap()
    t.put("dup_link", spark.createDataFrame([(f"k{i}", "g", "photo", 0.9) for i in range(60)], "key string, group_id string, method string, confidence double"))
    files = lambda: {(p.parent.name, p.name) for p in Path(tmp_path, "dup_link-8").glob("bucket=*/*.parquet")}
    before = files()
    t.put("dup_link", spark.createDataFrame([("k5", "h", "manual", 1.0)], "key string, group_id string, method string, confidence double"))
    after = files()
    own = spark.range(1).select(F.pmod(F.hash(F.lit("k5")), F.lit(8))).first()[0]
    assert {b for b, _ in after - before} == {f"bucket={own}"} == {b for b, _ in before - after}
    assert t.read("dup_link").count() == 60 and t.read("dup_link").where("group_id = 'h'").count() == 1


def test_votes_and_decisions_keep_the_last(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}", buckets=4)
    t.bootstrap()
    for vote, day in (("like", 1), ("pass", 2)):
        t.put("vote", spark.createDataFrame([("g", "p", vote, at(day))], "group_id string, person string, vote string, ts timestamp"))
    for a, b, same in (("x", "y", 1), ("y", "x", 0)):
        t.put("dup_decision", spark.createDataFrame([(a, b, same, at(1 + (same == 0)))], "a string, b string, same int, ts timestamp"))
    assert [r.vote for r in t.read("vote").collect()] == ["pass"]
    assert [(r.a, r.b, r.same) for r in t.read("dup_decision").collect()] == [("x", "y", 0)]


def test_a_stream_is_merged_into_tables(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/tables", buckets=4)
    t.bootstrap()
    for n, (day, price) in enumerate(((1, 100), (2, 100), (3, 80))):
        spark.createDataFrame([("a", at(day), price)], "key string, seen_at timestamp, price int").write.parquet(f"file://{tmp_path}/in/{n}")
        stream = spark.readStream.schema("key string, seen_at timestamp, price int").parquet(f"file://{tmp_path}/in/*")
        ingest.start(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", tables=t).awaitTermination(90)
    (r,) = t.read("listing").collect()
    assert (r.price, r.price_first, r.first_seen) == (80, 100, at(1))
    assert {(p.seen_at, p.price) for p in t.read("price_history").collect()} == {(at(1), 100), (at(3), 80)}
