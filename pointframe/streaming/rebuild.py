"""Maps that pose corrections rebuild: each micro-batch builds a new version, checks it, and swaps it in or leaves the old one.

A store is a folder of one session's map: maps/version=n, poses/version=n, and commits, one small file a micro-batch. A version is
named by its micro-batch and is current only once its commit says that it was accepted, so a batch that is run again
after a failure writes the same folders, one that was committed changes nothing, and readers never see half a map.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.operators import fitting
from pointframe.streaming import keyframes as kf

COMMIT = "batch long, version long, accepted boolean, fitness double"
POSE = ("x", "y", "z", "roll", "pitch", "yaw")


@dataclass
class MapStore:
    path: str

    def start(self, poses: DataFrame, points: DataFrame, reach: float, budget: int) -> None:
        """Version 0, from poses (session, frame_id, x, y, z, roll, pitch, yaw) and points in the frames' bodies; a store that has one stays."""
        if self._began(poses.sparkSession):
            return
        self._write(0, poses, points, reach, budget)
        self._commit(poses.sparkSession, -1, 0, True, 0.0)

    def _began(self, spark: SparkSession) -> bool:
        try:
            return bool(self.commits(spark).limit(1).count())
        except Exception as e:  # the folder isn't there yet
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise

    def commits(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*")

    def version(self, spark: SparkSession) -> int:
        """The newest accepted version."""
        return self.commits(spark).filter("accepted").agg(F.max("version")).first()[0]

    def poses(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return spark.read.parquet(f"{self.path}/poses/version={self.version(spark) if version is None else version}")

    def map(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return spark.read.parquet(f"{self.path}/maps/version={self.version(spark) if version is None else version}")

    def _write(self, version: int, poses: DataFrame, points: DataFrame, reach: float, budget: int) -> None:
        poses = poses.select("session", "frame_id", *POSE)
        poses.write.mode("overwrite").parquet(f"{self.path}/poses/version={version}")
        poses = self.poses(points.sparkSession, version)
        here = poses.groupBy("session").agg(F.max_by(F.struct("x", "y", "z"), "frame_id").alias("h")).select("session", "h.*")
        built, _ = kf.rebuild_map(points, poses.withColumn("version", F.lit(version)), here, reach, budget, lambda m: True)
        built.write.mode("overwrite").parquet(f"{self.path}/maps/version={version}")

    def _commit(self, spark: SparkSession, batch: int, version: int, accepted: bool, fitness: float) -> None:
        spark.createDataFrame([(batch, version, accepted, fitness)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch-{batch}")

    def apply(self, corrections: DataFrame, batch: int, points: DataFrame, reach: float, budget: int, verify: Callable[[DataFrame, DataFrame], tuple[bool, float]]) -> bool | None:
        """What a micro-batch of corrections (session, frame_id and the pose) does: whether its map was swapped in, or None if it had been committed.

        Of corrections of one frame in a batch the one of greatest values is taken; frames without a pose get one.
        """
        spark = points.sparkSession
        if self.commits(spark).filter(F.col("batch") == batch).limit(1).count():
            return None
        new = corrections.groupBy("session", "frame_id").agg(F.max(F.struct(*POSE)).alias("p")).select("session", "frame_id", "p.*")
        old = self.poses(spark).join(new.select("session", "frame_id"), ["session", "frame_id"], "left_anti")
        version = batch + 1
        self._write(version, old.unionByName(new), points, reach, budget)
        ok, fitness = verify(self.map(spark, version), self.poses(spark, version))
        self._commit(spark, batch, version, ok, fitness)
        return ok


def last_scan_fits(points: DataFrame, fitness: float = 2.0, max_dist: float = 250.0, rounds: int = 20) -> Callable[[DataFrame, DataFrame], tuple[bool, float]]:
    """A check: the newest frame's points, at its pose, are aligned with the rest of the map and must fit."""

    def verify(built: DataFrame, poses: DataFrame) -> tuple[bool, float]:
        newest = poses.agg(F.max("frame_id")).first()[0]
        pose = poses.filter(F.col("frame_id") == newest).select("session", "frame_id", *(F.col(c).alias(f"_{c}") for c in POSE))
        m = g.euler_to_mat(*g.vec("_roll", "_pitch", "_yaw"))
        at = g.transform(m, g.vec("_x", "_y", "_z"), g.vec("x", "y", "z"))
        scan = points.join(pose, ["session", "frame_id"]).select("pt_idx", *(v.alias(c) for v, c in zip(at, "xyz", strict=True)))
        rest = built.filter(F.col("frame_id") != newest).select("frame_id", "pt_idx", "x", "y", "z")
        ok, _, _, score = fitting.icp_checked(scan, rest, ["pt_idx"], ["frame_id", "pt_idx"], max_dist=max_dist, rounds=rounds, fitness=fitness)
        return bool(ok), float(score)

    return verify


def rebuild_stream(corrections: DataFrame, store: MapStore, points: DataFrame, checkpoint: str, reach: float, budget: int, verify: Callable[[DataFrame, DataFrame], tuple[bool, float]]):
    """Start a stream of corrections that rebuilds the map of a store; what is there is gone through and the query ends."""

    def each(batch: DataFrame, number: int) -> None:
        store.apply(batch, number, points, reach, budget, verify)

    return corrections.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
