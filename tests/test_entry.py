import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_ingest(spark, tmp_path):
    from georesolve.streaming import ingest

    rows = [("a", 1, 100), ("a", 2, 90), ("b", 1, 50)]
    spark.createDataFrame(rows, "key string, seen_at int, price int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, seen_at int, price int").parquet(f"{tmp_path}/in")
    ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    got = {r.key: (r.price, r.price_first) for r in ingest.current(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (90, 100), "b": (50, 50)}
    assert ingest.price_history(spark, f"{tmp_path}/out").count() == 3
