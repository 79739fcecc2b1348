"""Joins in time: as-of in both directions, exact, interval and interpolated; sequences and epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g


def _merged(left: DataFrame, right: DataFrame, on: str, t: str, cols: list[str]) -> DataFrame:
    """Both sides in one stream of (on, t, _left, _l, _r): left rows as a struct, the wanted columns of right rows as another."""
    lrow = F.struct(*(F.col(c) for c in left.columns))
    rrow = F.struct(F.col(t).alias("t"), *(F.col(c) for c in cols))
    a = left.select(F.col(on).alias("_on"), F.col(t).alias("_t"), F.lit(1).alias("_left"), lrow.alias("_l"))
    b = right.select(F.col(on).alias("_on"), F.col(t).alias("_t"), F.lit(0).alias("_left"), rrow.alias("_r"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, on: str, t: str, cols: list[str], prefix: str = "r_") -> DataFrame:
    """left with the last right row at or before its time (null if none): one sort of both sides by key and time."""
    w = Window.partitionBy("_on").orderBy("_t", "_left", *(F.col(f"_r.{c}") for c in cols)).rowsBetween(Window.unboundedPreceding, 0)
    m = _merged(left, right, on, t, cols).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_left = 1")
    return m.select("_l.*", *(F.col(f"_m.{c}").alias(prefix + c) for c in ["t", *cols]))


def asof_forward(left: DataFrame, right: DataFrame, on: str, t: str, cols: list[str], prefix: str = "r_") -> DataFrame:
    """left with the first right row at or after its time."""
    w = Window.partitionBy("_on").orderBy(F.desc("_t"), "_left", *(F.col(f"_r.{c}").desc() for c in cols)).rowsBetween(Window.unboundedPreceding, 0)
    m = _merged(left, right, on, t, cols).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_left = 1")
    return m.select("_l.*", *(F.col(f"_m.{c}").alias(prefix + c) for c in ["t", *cols]))


def asof_consumed(left: DataFrame, right: DataFrame, on: str, t: str, cols: list[str], prefix: str = "r_") -> DataFrame:
    """left with the first right row at or after its time that no earlier left row has taken (null if there is none).

    Rows of both sides are taken in order of time, then of all their values, and each once. If f is the rank of the first
    right row at or after the i-th left row, that row takes the one of rank i + the greatest f - i so far; so it is two sorts,
    not a loop.
    """
    rank = lambda df, name: df.withColumn(name, F.row_number().over(Window.partitionBy(on).orderBy(t, *[c for c in df.columns if c not in (on, t)])).cast("long"))
    r = rank(right.select(on, t, *cols), "_rank")
    m = asof_forward(rank(left, "_i"), r, on, t, ["_rank"], "_f_")
    lead = F.max(F.col("_f__rank") - F.col("_i")).over(Window.partitionBy(on).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("_rank", F.when(F.col("_f__rank").isNotNull(), F.col("_i") + lead))
    taken = r.select(on, "_rank", F.col(t).alias(prefix + "t"), *(F.col(c).alias(prefix + c) for c in cols))
    return m.join(taken, [on, "_rank"], "left").select(*left.columns, prefix + "t", *(prefix + c for c in cols))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, t: str, cols: list[str], tolerance: int, prefix: str = "r_") -> DataFrame:
    """left with the nearest right row within tolerance, the earlier of two equally near."""
    both = asof_backward(left, right, on, t, cols, "_b_")
    both = asof_forward(both, right, on, t, cols, "_f_")
    later = F.col("_f_t").isNotNull() & (F.col("_b_t").isNull() | (F.col("_f_t") - F.col(t) < F.col(t) - F.col("_b_t")))
    pick = {c: F.when(later, F.col(f"_f_{c}")).otherwise(F.col(f"_b_{c}")) for c in ["t", *cols]}
    out = both.select(*left.columns, *(v.alias(prefix + c) for c, v in pick.items()))
    ok = F.abs(F.col(prefix + "t") - F.col(t)) <= tolerance
    return out.select(*left.columns, *(F.when(ok, F.col(prefix + c)).alias(prefix + c) for c in ["t", *cols]))


def interval_join(scans: DataFrame, samples: DataFrame, on: str, begin: str, end: str, t: str, bucket: int, slack: int = 0) -> DataFrame:
    """Scans with the samples of [begin, end), and the first one from the end on if it comes within slack.

    Both sides are cut into buckets of time; a scan goes to each bucket that it touches.
    """
    s = scans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor((F.col(end) + slack) / bucket))))
    p = samples.withColumn("_b", F.floor(F.col(t) / bucket))
    joined = s.join(p, [on, "_b"]).filter((F.col(t) >= F.col(begin)) & (F.col(t) <= F.col(end) + slack)).drop("_b")
    after = Window.partitionBy(on, begin, end).orderBy(F.col(t)).rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum((F.col(t) >= F.col(end)).cast("int")).over(after)
    return joined.withColumn("_late", nth).filter((F.col(t) < F.col(end)) | ((F.col("_late") == 1) & F.lit(slack > 0))).drop("_late")


def interpolate(times: DataFrame, poses: DataFrame, on: str, t: str) -> DataFrame:
    """times with the pose (x, y, z, qw, qx, qy, qz) between the poses before and after: linear and spherical.

    A time outside of the poses' span has no pose; one that meets a pose exactly has that pose.
    """
    cols = ["x", "y", "z", "qw", "qx", "qy", "qz"]
    m = asof_forward(asof_backward(times, poses, on, t, cols, "_a_"), poses, on, t, cols, "_b_")
    span = (F.col("_b_t") - F.col("_a_t")).cast("double")
    s = F.when(span == 0, F.lit(0.0)).otherwise((F.col(t) - F.col("_a_t")) / span)
    q = g.slerp([F.col(f"_a_{c}") for c in cols[3:]], [F.col(f"_b_{c}") for c in cols[3:]], F.col("_s"))
    m = m.withColumn("_s", s).filter(F.col("_s").isNotNull())
    lin = [(F.col(f"_a_{c}") + F.col("_s") * (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).alias(c) for c in cols[:3]]
    return m.select(*times.columns, *lin, *(v.alias(c) for v, c in zip(q, cols[3:], strict=True)))


def epochs(df: DataFrame, on: str, order: str, t: str) -> DataFrame:
    """df with epoch: how often time has run backwards so far, in order of arrival."""
    w = Window.partitionBy(on).orderBy(order)
    return df.withColumn("_back", (F.lag(t).over(w) > F.col(t)).cast("int")).withColumn("epoch", F.coalesce(F.sum("_back").over(w), F.lit(0)).cast("long")).drop("_back")


def fill_gaps(df: DataFrame, on: str, t: str, longest: int) -> DataFrame:
    """(on, t, filled): the rows of df and, in each gap longer than `longest`, one row for each `longest` that passes."""
    w = Window.partitionBy(on).orderBy(t)
    gap = df.select(on, t, F.lag(t).over(w).alias("_p"))
    missing = gap.filter(F.col(t) - F.col("_p") > longest).select(on, F.explode(F.sequence(F.col("_p") + longest, F.col(t) - 1, F.lit(longest).cast("long"))).alias(t))
    return df.select(on, t, F.lit(False).alias("filled")).unionByName(missing.select(on, t, F.lit(True).alias("filled")))


def path_length(df: DataFrame, on: str, order: list[str]) -> DataFrame:
    """df with step, the distance to the pose before, travelled, its running sum, and running bounds of x."""
    w = Window.partitionBy(on).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = tuple(F.lag(c).over(w) for c in "xyz")
    df = df.withColumn("step", F.coalesce(F.sqrt(g.sq_dist(g.vec("x", "y", "z"), before)), F.lit(0.0)))
    return df.withColumn("travelled", F.sum("step").over(run)).withColumn("min_x", F.min("x").over(run)).withColumn("max_x", F.max("x").over(run))
