import time
from pathlib import Path

import corpus_pipeline
from odd_rows import prose

from georesolve.llm import queries


def test_stages_keep_and_drop(spark, tmp_path):
    clean = [(i, prose(i + 100, 150), "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    toxic = [(1000 + i, prose(i + 700, 100) + " vileword nastyword grimword", "en", "s", 0) for i in range(40)]
    base = clean[0][1].split()
    planted = [(2000, clean[1][1].upper(), "en", "s", 0), (2001, " ".join([*base[:70], "changed", *base[71:]]), "fr", "s", 0), (2002, "12345 ...", None, None, 0), (2003, None, None, None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(clean + toxic + planted, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in clean + toxic[:30]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
            left[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs = out
    assert not {2002, 2003} & left["language_id"]
    assert not {r[0] for r in toxic} & left["toxicity"]
    assert 2000 in left["exact_dedup"] and 1 not in left["exact_dedup"]
    assert 2001 not in left["simhash_near_dedup"] and 0 in left["simhash_near_dedup"]
    assert {r[0] for r in clean} - {1} <= left["simhash_near_dedup"]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == left["simhash_near_dedup"]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_a_worker_keeps_few_words_and_gives_back_a_task_s_memory():
    """A worker goes on with the next stages: what it keeps is bounded, whatever the vocabulary, and no batch is a list of texts at once."""
    import numpy as np
    import pyarrow as pa

    from georesolve.llm import common, language, toxicity

    class Sent:
        value = toxicity.Index(np.array([1, 2]), np.array([0.0, 1.0]), np.array([1, 1]), np.array([5, 6], dtype=np.uint64), np.array([1, 1], dtype=np.float32))

    rows = {"kind": np.zeros(0, dtype=np.int64), "h": np.zeros(0, dtype=np.int64), "lang": np.zeros(0, dtype=np.int64), "n": np.zeros(0, dtype=np.int64)}
    scorers = [toxicity.Scorer(toxicity.Model(Sent, toxicity.Curve())), language.Scorer(language.Model(["a", "b"], [1, 1], rows))]
    some = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(250_000)]
    for s in scorers:
        for at in range(0, len(some), 10_000):
            s.score([" ".join(some[at : at + 10_000])])
            assert len(s.met) <= 110_000

    sizes, gave = [], []

    class Docs:
        schema, sparkSession = None, None

        def mapInArrow(self, of, schema):
            return lambda b: list(of(b))

    old = common.for_python, common.release_memory
    common.for_python, common.release_memory = lambda s: None, lambda: gave.append(len(sizes))
    try:
        batch = pa.RecordBatch.from_pydict({"text": ["x", None, "y"] * 171})
        out = common.kept_rows(Docs(), "text", lambda: lambda texts: sizes.append(len(texts)) or [t == "y" for t in texts])([batch])
    finally:
        common.for_python, common.release_memory = old
    assert out[0].column("text").to_pylist() == ["y"] * 171 and max(sizes) <= 128 and sum(sizes) == 513 and gave == [len(sizes)]


def test_near_copies_need_no_rows_from_the_driver_s_python(spark, monkeypatch):
    """Rows given by Python start a daemon and workers of their own beside those of the stages."""
    from georesolve.llm import simhash

    docs = spark.range(40).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> if(i > 28, id div 2, i * 7 + id div 4))) as text").cache()
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert 0 < simhash.keep_one(docs, radius=14, shingle=2, likeness=0.8).count() < 40


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}


def test_a_checkpoint_s_shuffle_files_go_with_it(spark):
    """They would stay until the driver's garbage collector met their plan: rounds of joins filled the disk."""
    from georesolve.llm import common

    before, setting = shuffle_files(spark), spark.conf.get(common.SHUFFLES_GO, "false")
    some = spark.range(1000).selectExpr("id % 10 as k", "id").groupBy("k").count()
    kept = common.checkpointed(some)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(common.SHUFFLES_GO, "false") == setting
    assert sorted(kept.collect()) == sorted(some.collect()) == [(k, 100) for k in range(10)]
    assert kept.groupBy("count").agg({"k": "max"}).collect() == [(100, 9)]


def test_near_copies_keep_what_is_compared_once(spark, monkeypatch):
    """Least hashes are kept by distinct set of shingles, not by row and again by set; the scratch they came from goes."""
    from georesolve.llm import common, simhash

    held, keep = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: held.append(df.columns) or keep(df))
    docs = spark.range(40).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> if(i > 28, id div 2, i * 7 + id div 4))) as text")
    assert 0 < simhash.keep_one(docs, radius=14, shingle=2, likeness=0.8).count() < 40
    assert sum("low" in columns for columns in held) == 1
    assert not list(Path(common.shared_folder(spark).removeprefix("file:")).glob("shingled-*"))
