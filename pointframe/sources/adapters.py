"""Views of the driver's tables as point clouds and trajectories.

None of the tables is a point cloud; the views exercise the operators and say nothing about mapping quality. Each has a
SQL twin with the same columns, as the body of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.session import table


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed cloud: (scan_id, pt_idx, x, y, z, intensity, nx, ny, nz, t_off_ms) from the embeddings."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    df = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("scan_id"),
        F.col("vec_id").alias("pt_idx"),
        (10 * e(1)).alias("x"), (10 * e(2)).alias("y"), (10 * e(3)).alias("z"), (10 * e(4)).alias("intensity"),
        e(5).alias("_a"), e(6).alias("_b"), e(7).alias("_c"), (F.pmod("vec_id", F.lit(100)) / 10.0).alias("t_off_ms"),
    )
    n = F.sqrt(F.col("_a") ** 2 + F.col("_b") ** 2 + F.col("_c") ** 2)
    return df.select("*", (F.col("_a") / n).alias("nx"), (F.col("_b") / n).alias("ny"), (F.col("_c") / n).alias("nz")).drop("_a", "_b", "_c")


_E = "CAST(embedding[{}] AS DOUBLE)".format
POINTS = f"""SELECT CAST(label AS BIGINT) AS scan_id, vec_id AS pt_idx, 10 * {_E(1)} AS x, 10 * {_E(2)} AS y, 10 * {_E(3)} AS z,
  10 * {_E(4)} AS intensity, (vec_id % 100) / 10.0::DOUBLE AS t_off_ms,
  {_E(5)} / sqrt({_E(5)}*{_E(5)} + {_E(6)}*{_E(6)} + {_E(7)}*{_E(7)}) AS nx,
  {_E(6)} / sqrt({_E(5)}*{_E(5)} + {_E(6)}*{_E(6)} + {_E(7)}*{_E(7)}) AS ny,
  {_E(7)} / sqrt({_E(5)}*{_E(5)} + {_E(6)}*{_E(6)} + {_E(7)}*{_E(7)}) AS nz FROM embeddings"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large non-negative cloud: (scan_id, pt_idx, x, y, z) from the line items; pt_idx numbers a scan's points."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("scan_id"),
        F.col("l_orderkey").cast("long").alias("pt_idx"),
        F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_extendedprice").cast("double") / 1000).alias("y"),
        (F.col("l_discount").cast("double") * 100 + 0.0).alias("z"),
    )


CLOUD = """SELECT CAST(l_linenumber AS BIGINT) AS scan_id, CAST(l_orderkey AS BIGINT) AS pt_idx, CAST(l_quantity AS DOUBLE) AS x,
  CAST(l_extendedprice AS DOUBLE) / 1000 AS y, CAST(l_discount AS DOUBLE) * 100 + 0.0 AS z FROM lineitem"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-ordered samples of many sessions: (session, id, kind, t_us, v) from the events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.col("value").alias("v"),
    )


SAMPLES = "SELECT user_id AS session, event_id AS id, event_type AS kind, epoch_us(ts) AS t_us, value AS v FROM events"


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pose for each sample: (session, id, t_us, x, y, z), x the running sum of v, y of its sign-free half, z a slow ramp."""
    w = Window.partitionBy("session").orderBy("t_us", "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return samples(spark, sf_dir).select(
        "session", "id", "t_us",
        F.round(F.sum(F.col("v") / 100).over(run), 6).alias("x"), F.round(F.sum(F.abs("v") / 200).over(run), 6).alias("y"), (F.row_number().over(w) / 10.0).alias("z"),
    )


TRAJECTORY = f"""SELECT session, id, t_us, round(sum(v / 100) OVER w, 6) AS x, round(sum(abs(v) / 200) OVER w, 6) AS y, CAST(row_number() OVER w AS DOUBLE) / 10.0 AS z
  FROM ({SAMPLES}) WINDOW w AS (PARTITION BY session ORDER BY t_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
