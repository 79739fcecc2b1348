"""Readers of pose, scan and graph files, and the writers of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g

MATRIX = [f"m{i}{j}" for i in range(3) for j in range(4)]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def read_pose_csv(spark: SparkSession, path: str, order: str = "wxyz") -> DataFrame:
    """time, tx, ty, tz and a quaternion, comma separated; its order is wxyz or xyzw. Lines that aren't numbers are left out."""
    q = {"wxyz": ["qw", "qx", "qy", "qz"], "xyzw": ["qx", "qy", "qz", "qw"]}[order]
    df = spark.read.csv(path, schema=_doubles(["time", "tx", "ty", "tz", *q]), mode="DROPMALFORMED")
    return df.select("time", "tx", "ty", "tz", "qw", "qx", "qy", "qz")


def read_pose_matrix(spark: SparkSession, path: str, sep: str = ",", key: str = "time") -> DataFrame:
    """A key (time or frame) and the 12 entries of a 3 x 4 matrix by rows; translation is tx, ty, tz."""
    df = spark.read.csv(path, schema=_doubles([key, *MATRIX]), sep=sep, mode="DROPMALFORMED")
    return df.select(key, *[c for c in MATRIX if c[2] != "3"], F.col("m03").alias("tx"), F.col("m13").alias("ty"), F.col("m23").alias("tz"))


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """t x y z qx qy qz qw, separated by white space, and a mounting of seven more numbers or none (then the identity)."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(part) >= 8))
    names = ["time", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    at = lambda k: F.try_element_at(part, F.lit(k + 1)).cast("double")
    ext = [F.coalesce(at(8 + k), F.lit(1.0 if k == 6 else 0.0)).alias(n) for k, n in enumerate(["ex", "ey", "ez", "eqx", "eqy", "eqz", "eqw"])]
    return rows.select(*(at(k).alias(n) for k, n in enumerate(names)), *ext)


def read_kitti_bin(spark: SparkSession, path: str) -> DataFrame:
    """(path, pt_idx, x, y, z, intensity) of files of four float32 a point; bytes that don't fill a point are left out."""

    def decode(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                a = np.frombuffer(content[: len(content) // 16 * 16], dtype="<f4").reshape(-1, 4).astype(float)
                yield pd.DataFrame({"path": p, "pt_idx": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "intensity": a[:, 3]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, pt_idx long, x double, y double, z double, intensity double")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x, y, z, qx, qy, qz, qw) and edges (i, j, pose, upper triangle of the information) of a g2o-like text."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    num = lambda k, t="double": F.try_element_at("p", F.lit(k + 1)).cast(t)
    pose = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    v = lines.filter(F.col("p")[0].startswith("VERTEX")).select(num(1, "long").alias("id"), *(num(2 + k).alias(n) for k, n in enumerate(pose)))
    e = lines.filter(F.col("p")[0].startswith("EDGE")).select(
        num(1, "long").alias("i"), num(2, "long").alias("j"), *(num(3 + k).alias(n) for k, n in enumerate(pose)), F.slice("p", 11, 21).cast("array<double>").alias("information")
    )
    return v, e


def split_on_marker(df: DataFrame, on: list[str], order: str, marker: Column) -> DataFrame:
    """df without its marker rows, with frame: how many markers came before in the same file (`on`), in order."""
    w = Window.partitionBy(*on).orderBy(order)
    return df.withColumn("_m", marker.cast("int")).withColumn("frame", F.sum("_m").over(w).cast("long")).filter("_m = 0").drop("_m")


def corrected_map(points: DataFrame, keyframes: DataFrame, every: int = 1) -> DataFrame:
    """Every n-th point of each keyframe at its corrected place; keyframes are (frame_id, x, y, z, roll, pitch, yaw)."""
    k = keyframes.select("frame_id", *(F.col(c).alias(f"k_{c}") for c in ("x", "y", "z", "roll", "pitch", "yaw")))
    m = g.euler_to_mat(F.col("k_roll"), F.col("k_pitch"), F.col("k_yaw"))
    at = g.transform(m, g.vec("k_x", "k_y", "k_z"), g.vec("x", "y", "z"))
    picked = points.filter(F.col("pt_idx") % every == 0).join(k, "frame_id")
    return picked.select("frame_id", "pt_idx", *(v.alias(c) for v, c in zip(at, "xyz", strict=True)))


def write_poses(df: DataFrame, path: str) -> None:
    """time x y z qx qy qz qw as text, in order of time inside each part."""
    cols = ["time", "x", "y", "z", "qx", "qy", "qz", "qw"]
    df.select(*cols).repartitionByRange("time").sortWithinPartitions("time").write.mode("overwrite").csv(path, sep=" ")


def write_session(points: DataFrame, keyframes: DataFrame, loops: DataFrame, path: str) -> None:
    """A session for later ones: raw and corrected points (flag corrected), both poses, and the loop pairs, as three tables."""
    both = points.withColumn("corrected", F.lit(False)).unionByName(corrected_map(points, keyframes).withColumn("corrected", F.lit(True)), allowMissingColumns=True)
    both.write.mode("overwrite").partitionBy("corrected").parquet(f"{path}/points")
    keyframes.write.mode("overwrite").parquet(f"{path}/keyframes")
    loops.write.mode("overwrite").parquet(f"{path}/loops")


def read_session(spark: SparkSession, path: str, corrected: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, keyframes, loops) of an earlier session, its points either as seen or corrected."""
    pts = spark.read.parquet(f"{path}/points").filter(F.col("corrected") == corrected).drop("corrected")
    return pts, spark.read.parquet(f"{path}/keyframes"), spark.read.parquet(f"{path}/loops")


#: The columns of the timing log and of the loop evaluation.
TIMING = ["time_stamp", "total", "scan_size", "incremental", "search", "delete_size", "delete_time", "tree_start", "tree_end", "add_size", "preprocess"]
EVALUATION = ["frame", "x", "y", "z", "found", "match_frame", "candidate_id", "match_size", "rough_size", "tx", "ty", "tz", "n_kp", "n_repeat", "score", "t_build", "t_search", "t_fine", "t_add"]
LOOP = ["i", "j", "x", "y", "z", "roll", "pitch", "yaw"]


def append_descriptors(triangles: DataFrame, path: str) -> None:
    """Add triangles to a descriptor base, with their vertices as they are, so that nothing need be coded into coordinates."""
    triangles.write.mode("append").parquet(path)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """The triangles of a descriptor base, for any number of height slices."""
    return spark.read.parquet(path)


def write_planes(planes: DataFrame, path: str, frame: str = "frame_id") -> None:
    """The plane sets of a session, a folder a frame, so that one frame is read alone."""
    planes.write.mode("overwrite").partitionBy(frame).parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_log(df: DataFrame, path: str, columns: list[str], order: str, sep: str = ",", header: bool = True) -> None:
    """Rows as text in the given columns (TIMING, EVALUATION, LOOP or any state), in order inside and across parts; a missing column is empty."""
    have = set(df.columns)
    rows = df.select(*(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns))
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").csv(path, sep=sep, header=header)


def read_log(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """What write_log wrote, as doubles."""
    return spark.read.csv(path, schema=_doubles(columns), sep=sep, header=header)
