"""A forest of cubes: points in folders by cube of space and insertion, with a directory of what each holds.

A search looks into the directory, a small table, for the cubes that a box and a range of time touch, and reads the files of
those only. Insertions are named and written once under their name, so one that is run again after a failure replaces
itself. Deletions are tables of points that reads leave out; compact() writes the cubes they fall into anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.operators import index as ix

CUBE = ["cx", "cy", "cz"]
KEY = ["insertion", *CUBE]


@dataclass
class CubeForest:
    path: str
    edge: float = 10.0

    def add(self, points: DataFrame, insertion: str, t: str = "t") -> None:
        """Insert points (x, y, z, a time and others; always the same columns) under a name; rows with a NaN or null coordinate are left out."""
        sound = [F.col(c).isNotNull() & ~F.isnan(c) for c in "xyz"]
        at = points.filter(sound[0] & sound[1] & sound[2]).withColumns({f"c{c}": F.floor(F.col(c) / self.edge) for c in "xyz"}).withColumn("_t", F.col(t))
        # A cube's rows are dealt into as many tasks as there are rows for, not into one.
        at.repartition(*CUBE, F.pmod(F.xxhash64("x", "y", "z"), F.lit(8))).write.mode("overwrite").partitionBy(*CUBE).parquet(f"{self.path}/points/insertion={insertion}")
        made = points.sparkSession.read.parquet(f"{self.path}/points/insertion={insertion}")
        if not made.columns or "cx" not in made.columns:  # nothing was written
            return
        rows = made.groupBy(*CUBE).agg(F.count("*").alias("n"), F.min("_t").alias("t_min"), F.max("_t").alias("t_max"), *(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
        rows.select(*(F.col(c).cast("long").alias(c) for c in CUBE), *[c for c in rows.columns if c not in CUBE]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory/insertion={insertion}")

    def directory(self, spark: SparkSession) -> DataFrame:
        """(insertion, cx, cy, cz, n, bounds of time and space) of every cube of every insertion."""
        return spark.read.option("basePath", f"{self.path}/directory").parquet(f"{self.path}/directory/*").withColumn("insertion", F.col("insertion").cast("string"))

    def delete(self, gone: DataFrame, deletion: str) -> None:
        """Points that stand within 1e-6 of the given ones (x, y, z), of insertions so far and to come, are left out of reads."""
        gone.select("x", "y", "z").withColumns({f"c{c}": F.floor(F.col(c) / self.edge) for c in "xyz"}).write.mode("overwrite").parquet(f"{self.path}/gone/deletion={deletion}")

    def _gone(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/gone/*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def touched(self, spark: SparkSession, low: tuple[float, ...] | None = None, high: tuple[float, ...] | None = None, since: float | None = None, until: float | None = None) -> list[tuple]:
        """(insertion, cx, cy, cz) that may hold points of a box, ends included, and a range of time; as many as the box touches."""
        d = self.directory(spark)
        for k, c in enumerate("xyz"):
            if low is not None:
                d = d.filter(F.col(f"{c}_max") >= low[k])
            if high is not None:
                d = d.filter(F.col(f"{c}_min") <= high[k])
        d = d if since is None else d.filter(F.col("t_max") >= since)
        d = d if until is None else d.filter(F.col("t_min") <= until)
        return [tuple(r) for r in d.select(*KEY).collect()]

    def read(self, spark: SparkSession, low: tuple[float, ...] | None = None, high: tuple[float, ...] | None = None, since: float | None = None, until: float | None = None) -> DataFrame:
        """The points of a box, ends included, and a range of time, without the deleted ones; only the folders of touched cubes are opened.

        A box that touches no cube gives an empty table of one insertion's columns.
        """
        keys = self.touched(spark, low, high, since, until)
        folders = [f"{self.path}/points/insertion={i}/cx={x}/cy={y}/cz={z}" for i, x, y, z in keys]
        if not folders:
            return spark.read.parquet(f"{self.path}/points/insertion={self.directory(spark).first()['insertion']}").drop(*CUBE, "_t").limit(0)
        p = spark.read.parquet(*folders)
        for k, c in enumerate("xyz"):
            p = p if low is None else p.filter(F.col(c) >= low[k])
            p = p if high is None else p.filter(F.col(c) <= high[k])
        p = p if since is None else p.filter(F.col("_t") >= since)
        p = (p if until is None else p.filter(F.col("_t") <= until)).drop("_t")
        gone = self._gone(spark)
        return p if gone is None else ix.delete_points(p, gone.select("x", "y", "z"))

    def compact(self, spark: SparkSession, insertion: str, t: str = "t") -> list[tuple]:
        """Write the cubes that deletions fall into anew, without the deleted points, under a name; the folders rewritten are returned.

        The new insertion stands before the old cubes leave the directory, whose rows a reader takes as they are at one time.
        """
        gone = self._gone(spark)
        if gone is None:
            return []
        old = self.directory(spark).join(gone.select(*CUBE).distinct(), CUBE, "left_semi").select(*KEY).collect()
        keys = [tuple(r) for r in old]
        if not keys:
            return []
        kept = spark.read.parquet(*(f"{self.path}/points/insertion={i}/cx={x}/cy={y}/cz={z}" for i, x, y, z in keys)).drop("_t")
        self.add(ix.delete_points(kept, gone.select("x", "y", "z")), insertion, t)
        names = sorted({k[0] for k in keys})
        for name in names:
            rows = self.directory(spark).filter(F.col("insertion") == name)
            left = rows.join(spark.createDataFrame([k[1:] for k in keys if k[0] == name], "cx long, cy long, cz long"), CUBE, "left_anti").drop("insertion")
            spark.createDataFrame(left.collect(), left.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory/insertion={name}")  # a row a cube
        return keys
