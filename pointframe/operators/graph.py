"""Factor tables of pose graphs and their residuals as columns; `pose_graph` solves them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g

POSE = ("x", "y", "z", "roll", "pitch", "yaw")


def prior_factors(poses: DataFrame, var: float = 1e-6) -> DataFrame:
    """The prior of the first frame of each session."""
    first = poses.groupBy("session").agg(F.min_by(F.struct("frame_id", *POSE), "frame_id").alias("p"))
    return first.select("session", "p.*", F.array(*(F.lit(var) for _ in range(6))).alias("var"))


def between_factors(poses: DataFrame) -> DataFrame:
    """(session, i, j, dx, dy, dz, droll, dpitch, dyaw) of consecutive frames: the later as seen from the earlier."""
    w = Window.partitionBy("session").orderBy("frame_id")
    p = poses.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("frame_id", *POSE)}).filter("p_frame_id IS NOT NULL")
    m1, m2 = g.euler_to_mat(*g.vec("p_roll", "p_pitch", "p_yaw")), g.euler_to_mat(*g.vec("roll", "pitch", "yaw"))
    m, t = g.relative(m1, g.vec("p_x", "p_y", "p_z"), m2, g.vec("x", "y", "z"))
    e = g.mat_to_euler(m)
    return p.select("session", F.col("p_frame_id").alias("i"), F.col("frame_id").alias("j"), *(v.alias(f"d{c}") for v, c in zip((*t, *e), POSE, strict=True)))


def pair_residuals(pairs: DataFrame) -> DataFrame:
    """pairs with rx, ry, rz: R2^T R1 p1 + R2^T (t1 - t2) - p2, for poses a_* and b_* and body points p1*, p2*."""
    m1, m2 = (g.euler_to_mat(*g.vec(f"{s}_roll", f"{s}_pitch", f"{s}_yaw")) for s in "ab")
    world = g.transform(m1, g.vec("a_x", "a_y", "a_z"), g.vec("p1x", "p1y", "p1z"))
    seen = g.mat_vec(g.transpose(m2), g.sub(world, g.vec("b_x", "b_y", "b_z")))
    r = g.sub(seen, g.vec("p2x", "p2y", "p2z"))
    return pairs.withColumns(dict(zip(("rx", "ry", "rz"), r, strict=True)))


def pair_factors(matches: DataFrame, poses: DataFrame, most: int = 6) -> DataFrame:
    """Factors of the `most` nearest matched points of each pair of frames, in the frames' bodies.

    matches are (i, j, pair_id, p1x.., p2x..) in the world; nearness is the sum of both ranges in the body.
    """
    pose = lambda s, k: poses.select(F.col("frame_id").alias(k), *(F.col(c).alias(f"{s}_{c}") for c in POSE))
    m = matches.join(pose("a", "i"), "i").join(pose("b", "j"), "j")
    out = {}
    for s, p in (("a", "p1"), ("b", "p2")):
        back, t = g.inverse(g.euler_to_mat(*g.vec(f"{s}_roll", f"{s}_pitch", f"{s}_yaw")), g.vec(f"{s}_x", f"{s}_y", f"{s}_z"))
        out |= {f"_{p}{c}": v for c, v in zip("xyz", g.transform(back, t, g.vec(f"{p}x", f"{p}y", f"{p}z")), strict=True)}
    m = m.withColumns(out).drop(*(f"{p}{c}" for p in ("p1", "p2") for c in "xyz")).withColumnsRenamed({f"_{p}{c}": f"{p}{c}" for p in ("p1", "p2") for c in "xyz"})
    reach = g.norm(g.vec("p1x", "p1y", "p1z")) + g.norm(g.vec("p2x", "p2y", "p2z"))
    w = Window.partitionBy("i", "j").orderBy("reach", "pair_id")
    return m.withColumn("reach", reach).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def judge_pairs(residuals: DataFrame, limit: float = 2.0) -> DataFrame:
    """(i, j, worst, reject) of each pair of frames."""
    r = g.norm(g.vec("rx", "ry", "rz"))
    return residuals.groupBy("i", "j").agg(F.max(r).alias("worst"), F.max((r > limit).cast("int")).alias("_b")).select("i", "j", "worst", (F.col("_b") == 1).alias("reject"))


def replace_accepted(pair_table: DataFrame, between: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After acceptance: the pair factors of the accepted (i, j) go, and a between factor for each of them comes."""
    kept = pair_table.join(accepted.select("i", "j"), ["i", "j"], "left_anti")
    return kept, between.unionByName(accepted.select(*between.columns))
