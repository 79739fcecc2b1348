"""The point index as a table: cells for keys, tombstones for deletions, one kept point for each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g

CELL = ["_cx", "_cy", "_cz"]


def _centred(df: DataFrame, size: float) -> DataFrame:
    """df with its cell and the squared distance to the cell's centre."""
    df = df.withColumns({f"_c{c}": g.leaf(F.col(c), size) for c in "xyz"})
    return df.withColumn("_d", g.sq_dist(g.vec("x", "y", "z"), tuple((F.col(f"_c{c}") + 0.5) * size for c in "xyz")))


def keep_central(df: DataFrame, size: float, order: str) -> DataFrame:
    """The point nearest to the centre of each cell, the first by `order` of equally near ones."""
    row = F.struct(*df.columns)
    best = _centred(df, size).groupBy(*CELL).agg(F.min_by(row, F.struct("_d", order)).alias("_p"))
    return best.select("_p.*")


def insert_sampled(index: DataFrame, new: DataFrame, size: float, order: str) -> DataFrame:
    """As an incremental index does it: only cells that new points fall into are thinned, others stay as they are."""
    both = _centred(index.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), size)
    cell = Window.partitionBy(*CELL)
    best = F.row_number().over(cell.orderBy("_d", order))
    both = both.withColumn("_touched", F.max("_new").over(cell)).withColumn("_r", best)
    return both.filter("_touched = 0 OR _r = 1").select(*index.columns)


def delete_points(index: DataFrame, gone: DataFrame, eps: float = 1e-6) -> DataFrame:
    """The index without the points that stand within eps, in each coordinate, of a given one."""
    key = lambda c, k=0: F.floor(F.col(c) / (4 * eps)) + k
    near = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip((i, j, k), "abc", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    g_ = gone.select(*(F.col(c).alias(f"_g{c}") for c in "xyz"), F.explode(near).alias("_o"), *(key(c).alias(f"_b{c}") for c in "xyz"))
    g_ = g_.select("_gx", "_gy", "_gz", *((F.col(f"_b{c}") + F.col(f"_o.{o}")).alias(f"_k{c}") for c, o in zip("xyz", "abc", strict=True)))
    cond = None
    left = index.withColumns({f"_q{c}": key(c) for c in "xyz"})
    for c in "xyz":
        one = (left[f"_q{c}"] == g_[f"_k{c}"]) & (F.abs(left[c] - g_[f"_g{c}"]) < eps)
        cond = one if cond is None else cond & one
    return left.join(g_, cond, "left_anti").drop("_qx", "_qy", "_qz")


def in_boxes(df: DataFrame, boxes: list[tuple[tuple[float, ...], tuple[float, ...]]]):
    """Whether a point lies in one of a few boxes, low faces included and high ones not."""
    cond = F.lit(False)
    for low, high in boxes:
        one = F.lit(True)
        for c, lo, hi in zip("xyz", low, high, strict=True):
            one = one & (F.col(c) >= lo) & (F.col(c) < hi)
        cond = cond | one
    return cond


def delete_boxes(index: DataFrame, boxes: list) -> DataFrame:
    """The index with the points of the boxes marked deleted_by = box; rows that are marked already stay as they are."""
    return index.withColumn("deleted_by", F.when(F.col("deleted_by").isNull() & in_boxes(index, boxes), F.lit("box")).otherwise(F.col("deleted_by")))


def restore_boxes(index: DataFrame, boxes: list) -> DataFrame:
    """Undo box deletions inside the boxes; points that sampling removed stay removed."""
    return index.withColumn("deleted_by", F.when((F.col("deleted_by") == "box") & in_boxes(index, boxes), F.lit(None).cast("string")).otherwise(F.col("deleted_by")))


def admit(points: DataFrame, neighbours: DataFrame, size: float, enough: int = 5) -> DataFrame:
    """What the map does with new points (scan_id, pt_idx, x, y, z), given their ranked neighbours (q_*, t_*, rank): add, plain or skip.

    Without neighbours a point is added. If its nearest lies outside of its cell in every coordinate it is added without
    sampling (plain). Otherwise it is skipped if one of `enough` neighbours is nearer to the cell's centre. Cells are half
    units wide by their key and `size` wide by their centre, as the map has it.
    """
    mid = {c: F.floor(F.col(f"q_{c}") * 2) * size + 0.5 * size for c in "xyz"}
    n = neighbours.withColumns({f"_m{c}": v for c, v in mid.items()})
    m = g.vec("_mx", "_my", "_mz")
    own, its = g.sq_dist(g.vec("q_x", "q_y", "q_z"), m), g.sq_dist(g.vec("t_x", "t_y", "t_z"), m)
    outside = F.lit(True)
    for c in "xyz":
        outside = outside & (F.abs(F.col(f"t_{c}") - F.col(f"_m{c}")) > 0.5 * size)
    per = n.groupBy("q_scan_id", "q_pt_idx").agg(
        F.count("*").alias("k"), F.max(F.when(F.col("rank") == 1, outside)).alias("far"), F.max((its < own).cast("int")).alias("beaten")
    )
    verdict = F.when(F.col("k").isNull(), "add").when(F.col("far"), "plain").when((F.col("k") >= enough) & (F.col("beaten") == 1), "skip").otherwise("add")
    per = per.withColumnsRenamed({"q_scan_id": "scan_id", "q_pt_idx": "pt_idx"})
    return points.join(per, ["scan_id", "pt_idx"], "left").withColumn("verdict", verdict).drop("k", "far", "beaten")
