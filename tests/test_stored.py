"""Published maps are read back; a stage's stored result is computed once."""

import pytest
from pyspark.sql import functions as F

from georesolve.functions import scoring
from georesolve.functions.geo import Grid
from georesolve.sources import sinks


def test_published_field_is_read_back(spark, tmp_path):
    grid = Grid(835000.0, 6580000.0, 1000.0, 200.0)
    cells = grid.cells(spark).select("row", "col", F.col("row").cast("double").alias("score"), F.col("inside").alias("in_mask"), F.when(F.col("inside"), F.lit(1).cast("long")).alias("part"))
    sinks.write_field(cells, sinks.grid_meta(spark, grid), f"file://{tmp_path}/map")
    back, got = sinks.read_field(spark, f"file://{tmp_path}/map")
    assert got == grid and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, cells.collect()), key=str)


def test_a_stored_stage_is_computed_once(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    stage = lambda n: sinks.stored_once(spark, f"file://{tmp_path}", {"stage": "demo", "n": n}, lambda: build(n)).count()
    assert (stage(3), stage(3), stage(4), stage(3)) == (3, 3, 4, 3) and calls == [3, 4]
    # What a run that died left behind has no mark and is not read.
    for mark in tmp_path.glob("*/_SUCCESS"):
        mark.unlink()
    assert stage(3) == 3 and calls == [3, 4, 3]
    with pytest.raises(RuntimeError):
        sinks.stored_once(spark, f"file://{tmp_path}", {"stage": "broken"}, lambda: (_ for _ in ()).throw(RuntimeError("no input")))
    assert not list(tmp_path.glob("*broken*"))


def test_report_has_what_rules_kill(spark):
    s = scoring.Scoring()
    cells = spark.createDataFrame([(100.0, 5.0, True), (5000.0, 60.0, True), (5000.0, 5.0, False)], "dist_motorway double, slope_pct double, inside boolean")
    rules = scoring.rule_report(scoring.feasibility(cells, s), s)
    text = sinks.report(spark.range(0).select(F.lit(1).alias("rank")), spark.range(0).select(F.lit("c").alias("commune"), F.lit(1.0).alias("p90"), F.lit(1).alias("cells_good")), rules=rules)
    assert text.startswith("# Rules") and "| dist_motorway_min_m | 800.0 | 350.0 | 50.0 | 50.0 |" in text and "# Zones" in text
