"""Connected components, peaks and splits."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import focal, vector


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable). nodes: node; edges: a, b.

    Rounds of least neighbours and of halving the way to the root, each a pair of equi-joins, until
    nothing changes; the number of rounds follows the logarithm of the longest chain.
    """
    # Not a union, which would work the edges out twice.
    both = checkpointed(edges.where("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    for _ in range(max_rounds):
        # What a node's root learns from the roots of the node's neighbours.
        seen = both.join(labels.withColumnsRenamed({"node": "b", "root": "root_b"}).hint("merge"), "b").groupBy("a").agg(F.min("root_b").alias("least"))
        joined = labels.join(seen.withColumnRenamed("a", "node").hint("merge"), "node", "left").withColumn("least", F.least("root", F.coalesce("least", "root")))
        hooks = joined.groupBy("root").agg(F.min("least").alias("to")).withColumnRenamed("root", "of")
        hooked = joined.join(hooks.hint("merge"), joined["root"] == hooks["of"]).select("node", F.least("least", "to").alias("root"))
        up = hooked.select(F.col("node").alias("of"), F.col("root").alias("up"))
        new = checkpointed(hooked.join(up.hint("merge"), hooked["root"] == up["of"], "left").select("node", F.coalesce("up", "root").alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old").hint("merge"), "node").where("root <> old")
        labels, done = new, changed.isEmpty()
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 1 in the given order (of distinct values): by range partitions, whose sizes are added up before them."""
    cut = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in cut.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition
        offsets.append((r["__part"], before))
        before += r["count"]
    at = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return cut.join(F.broadcast(at), "__part").withColumn(name, (own + F.col("__before")).cast("long")).drop("__part", "__before")


def _code(row: Column, col: Column) -> Column:
    """A cell as one number, in the order of rows and columns."""
    return F.shiftleft(row.cast("long"), 32) + (col.cast("long") + (1 << 31))


def labelled_cells(mask: DataFrame) -> DataFrame:
    """row, col, label: 8-connected components of the given cells, numbered from 1 by their first cell.

    Cells that lie side by side in a row are one run from the start, named by its first cell; only runs are linked.
    """
    w = Window.partitionBy("row").orderBy("col")
    cells = mask.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    starts = F.coalesce(F.col("col") - F.lag("col").over(w) > 1, F.lit(True))
    cells = cells.withColumn("run", F.when(starts, _code(F.col("row"), F.col("col"))))
    cells = checkpointed(cells.withColumn("run", F.last("run", ignorenulls=True).over(w)))
    below = F.explode(F.array(*[F.lit(dc) for dc in (-1, 0, 1)]))
    moved = cells.select(F.col("run").alias("a"), F.col("row"), F.col("col"), below.alias("dc")).select("a", _code(F.col("row") + 1, F.col("col") + F.col("dc")).alias("at"))
    there = cells.select(F.col("run").alias("b"), _code(F.col("row"), F.col("col")).alias("at"))
    edges = moved.join(there.hint("merge"), "at").select("a", "b")
    found = components(cells.select(F.col("run").alias("node")).distinct(), edges)
    roots = numbered(found.select("root").distinct(), ["root"], "label")
    return cells.join(found.withColumnRenamed("node", "run").hint("merge"), "run").join(roots.hint("merge"), "root").select("row", "col", "label")


def drop_small(labels: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Cells of components of at least so many cells."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return labels.join(sizes.select(label), label, "left_semi")


def local_peaks(field: DataFrame, value: str, distance_px: int, mask: str | None = None) -> DataFrame:
    """Cells whose value is the largest of the box around them."""
    top = focal.box_max(field, value, max(1, distance_px // 2), "__top").where(F.col(value) >= F.col("__top") - 1e-6)
    return (top.where(mask) if mask else top).drop("__top")


#: A tile's side in the first round of suppression, in least distances.
TILE = 64
UNSURE, KEPT, OUT = 0, 1, 2


def suppressed(peaks: DataFrame, value: str, least_distance: float, group: str = "label", tile: int = TILE) -> DataFrame:
    """Greedy non-maximum suppression within each group: peaks by falling value, kept unless near a kept one. Exact.

    Peaks are settled tile by tile. A tile sees its surroundings as far as two least distances and goes through
    its peaks by falling value: a peak near one that is surely kept is out, a peak whose stronger neighbours
    are all seen and all out is kept, others are unsure, because what decides them may lie further out. Unsure peaks go on
    to a next round in tiles twice as wide, together with the kept ones of those tiles. So a round settles whole
    tiles, not single peaks, and a chain of falling peaks takes rounds by the logarithm of its length.
    """
    rest = checkpointed(peaks.select(group, "row", "col", F.col(value).cast("double").alias(value)).withColumn("state", F.lit(UNSURE)))
    kept, side = rest.limit(0), tile * max(1.0, float(least_distance))
    while not rest.isEmpty():
        settled = checkpointed(_settled(rest, kept, value, float(least_distance), group, side))
        kept = checkpointed(kept.unionByName(settled.where(F.col("state") == KEPT)))
        rest, side = settled.where(F.col("state") == UNSURE), side * 2
    return kept.drop("state")


def _settled(rest: DataFrame, kept: DataFrame, value: str, d: float, group: str, side: float) -> DataFrame:
    """rest with the state that its tiles find."""
    reach = 2 * d
    here = lambda c, by: F.floor((F.col(c) + by) / side).cast("long")
    seen = lambda c: F.explode(F.sequence(here(c, -reach), here(c, reach)))
    tiles = rest.select(group, here("row", 0).alias("tr"), here("col", 0).alias("tc")).distinct()
    every = rest.unionByName(kept).withColumn("tr", seen("row")).withColumn("tc", seen("col")).join(tiles, [group, "tr", "tc"], "left_semi")
    schema = every.select(group, "row", "col", value, "state").schema

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = g["tr"].iloc[0] * side, g["tc"].iloc[0] * side
        g = g.sort_values([value, "row", "col"], ascending=[False, True, True], ignore_index=True)
        rows, cols, state = g["row"].to_numpy(), g["col"].to_numpy(), g["state"].to_numpy().copy()
        # How far into the surroundings a peak lies; whoever lies further than d has neighbours that are not seen.
        beyond = np.maximum.reduce([r0 - rows, rows - (r0 + side), c0 - cols, cols - (c0 + side)])
        blind, near, met = beyond > d - 1, defaultdict(list), range(-1, 2)
        at = list(zip((rows // max(d, 1)).astype(int).tolist(), (cols // max(d, 1)).astype(int).tolist(), strict=True))
        for i, (a, b) in enumerate(at):
            if state[i] != KEPT:
                rivals = [state[j] for x in met for y in met for j in near.get((a + x, b + y), ()) if (rows[i] - rows[j]) ** 2 + (cols[i] - cols[j]) ** 2 < d * d]
                state[i] = OUT if KEPT in rivals else UNSURE if rivals or blind[i] else KEPT
            if state[i] != OUT:
                near[a, b].append(i)
        own = (rows >= r0) & (rows < r0 + side) & (cols >= c0) & (cols < c0 + side) & (g["state"].to_numpy() == UNSURE)
        return g.assign(state=state).loc[own, schema.names]

    return every.groupBy(group, "tr", "tc").applyInPandas(settle, schema)


def split_by_peaks(labels: DataFrame, peaks: DataFrame, value: str, bucket: float) -> DataFrame:
    """row, col, label, part: each component's cells go to its nearest peak (of equals the stronger); parts are dense.

    Components with one peak or none stay whole. Cells look for peaks of their own component only, in widening buckets.
    """
    rank = F.struct((-F.col(value)).cast("double").alias("v"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    several = checkpointed(peaks.groupBy("label").count().where("count > 1").select("label"))
    at = [F.col("label").alias("cls"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")]
    cells = labels.join(several, "label", "left_semi").select("row", "col", *at)
    points = peaks.join(several, "label", "left_semi").select(*at, rank.alias("peak"))
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    near = vector.nearest_of_group(cells, points, ["row", "col"], bucket, F.struct(d2.alias("d2"), "peak"))
    split = near.select("row", "col", F.col("cls").alias("label"), F.col("d.peak").alias("peak"))
    whole = labels.join(several, "label", "left_anti").select("row", "col", "label", F.lit(None).cast(split.schema["peak"].dataType).alias("peak"))
    both = checkpointed(whole.unionByName(split))
    parts = numbered(both.select("label", "peak").distinct(), ["label", "peak"], "part").withColumnsRenamed({"label": "l", "peak": "p"})
    return both.join(parts, (F.col("label") == F.col("l")) & F.col("peak").eqNullSafe(F.col("p"))).select("row", "col", "label", "part")


def zones(field: DataFrame, value: str, least_score: float, least_cells: int, peak_px: int) -> DataFrame:
    """row, col, part: the zones of a smoothed field."""
    field = checkpointed(field.select("row", "col", value))  # else each use smooths it again
    good = field.where(F.col(value) >= least_score)
    labels = checkpointed(drop_small(labelled_cells(good), least_cells))
    peaks = local_peaks(field, value, peak_px).join(labels, ["row", "col"])
    kept = checkpointed(suppressed(peaks, value, float(peak_px)))
    return split_by_peaks(labels, kept, value, float(peak_px))


def group_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key, group_id: the key that comes first in its component. nodes: key, ord (unique); links: a, b (keys)."""
    at = nodes.select("key", "ord")
    edges = links.join(at.withColumnsRenamed({"key": "a", "ord": "oa"}).hint("merge"), "a").join(at.withColumnsRenamed({"key": "b", "ord": "ob"}).hint("merge"), "b").select(F.col("oa").alias("a"), F.col("ob").alias("b"))
    roots = components(at.select(F.col("ord").alias("node")), edges)
    named = roots.join(at.withColumnRenamed("ord", "node").hint("merge"), "node").join(at.select(F.col("ord").alias("root"), F.col("key").alias("group_id")).hint("merge"), "root")
    return named.select("key", "group_id")


