"""Queries of temporal joins, ordered analytics, epochs and gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g
from pointframe.operators import tables
from pointframe.operators import temporal as op
from pointframe.plans.q_points import R6, r6
from pointframe.plans.registry import query
from pointframe.sources.adapters import POINTS, SAMPLES, TRAJECTORY, points, samples, trajectory

_LR = f"""s AS ({SAMPLES}), l AS (SELECT session, id, t_us FROM s WHERE kind = 'click'), r AS (SELECT session, id, t_us, v FROM s WHERE kind = 'view')"""


def _lr(spark, d):
    s = samples(spark, d)
    return s.filter("kind = 'click'").select("session", "id", "t_us"), s.filter("kind = 'view'").select("session", F.col("id").alias("rid"), "t_us", "v")


DAY = 86_400_000_000


@query("join6_nearest_asof", f"""
WITH {_LR},
 b AS (SELECT l.*, r.id AS bid, r.t_us AS bt, r.v AS bv FROM l ASOF LEFT JOIN r ON l.session = r.session AND l.t_us >= r.t_us),
 f AS (SELECT l.id, r.id AS fid, r.t_us AS ft, r.v AS fv FROM l ASOF LEFT JOIN r ON l.session = r.session AND l.t_us <= r.t_us),
 p AS (SELECT b.session, b.id, b.t_us, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t_us < t_us - bt) THEN fid ELSE bid END AS rid,
   CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t_us < t_us - bt) THEN ft ELSE bt END AS rt FROM b JOIN f USING (id))
SELECT session, id, CASE WHEN abs(rt - t_us) <= {DAY} THEN rid END AS rid FROM p
""")  # fmt: skip
def join6(spark, d):
    left, right = _lr(spark, d)
    return op.asof_nearest(left, right, "session", "t_us", ["rid"], DAY).select("session", "id", F.col("r_rid").alias("rid"))


@query("join7_forward_asof", f"""
WITH {_LR}, a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_us, id) AS i FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_us, id) AS k FROM r),
 f AS (SELECT a.session, a.id, a.t_us, a.i, (SELECT count(*) FROM r WHERE r.session = a.session AND r.t_us < a.t_us) + 1 AS f FROM a),
 p AS (SELECT *, i + max(f - i) OVER (PARTITION BY session ORDER BY i) AS k FROM f)
SELECT p.session, p.id, b.id AS rid, b.t_us - p.t_us AS wait_us, b.t_us - p.t_us > 1000000 AS late FROM p LEFT JOIN b USING (session, k)
""")  # fmt: skip
def join7(spark, d):
    left, right = _lr(spark, d)
    wait = F.col("r_t") - F.col("t_us")
    return op.asof_consumed(left, right.drop("v"), "session", "t_us", ["rid"]).select("session", "id", F.col("r_rid").alias("rid"), wait.alias("wait_us"), (wait > 1_000_000).alias("late"))


@query("join8_exact_time", f"WITH s AS ({SAMPLES}) SELECT a.session, a.t_us, a.id, b.id AS other FROM s a JOIN s b ON a.session = b.session AND a.t_us = b.t_us WHERE a.id % 2 = 0")
def join8(spark, d):
    s = samples(spark, d)
    return tables.at_equal_times(s.filter("id % 2 = 0").select("session", "t_us", "id"), s.select("session", "t_us", F.col("id").alias("other")), ["session", "t_us"])


@query("join9_interval", f"""
WITH s AS ({SAMPLES}), w AS (SELECT session, id AS scan, t_us AS b, t_us + {DAY} AS e FROM s WHERE kind = 'signup'), p AS (SELECT session, id, t_us FROM s WHERE kind <> 'signup'),
 j AS (SELECT w.session, scan, b, e, p.id, p.t_us, sum(CASE WHEN p.t_us >= e THEN 1 ELSE 0 END) OVER (PARTITION BY w.session, scan ORDER BY p.t_us, p.id) AS late FROM w JOIN p ON w.session = p.session AND p.t_us >= b AND p.t_us <= e + {DAY // 4})
SELECT session, scan, id FROM j WHERE t_us < e OR late = 1
""")  # fmt: skip
def join9(spark, d):
    s = samples(spark, d)
    scans = s.filter("kind = 'signup'").select("session", F.col("id").alias("scan"), F.col("t_us").alias("b"), (F.col("t_us") + DAY).alias("e"))
    return op.interval_join(scans, s.filter("kind <> 'signup'").select("session", "id", "t_us"), "session", "b", "e", "t_us", DAY, DAY // 4).select("session", "scan", "id")


@query("join10_interpolated_position", f"""
WITH t AS ({TRAJECTORY}), q AS (SELECT session, id, t_us FROM t WHERE id % 3 = 0), k AS (SELECT * FROM t WHERE id % 3 <> 0),
 a AS (SELECT q.*, k.t_us AS t1, k.x AS x1, k.y AS y1 FROM q ASOF JOIN k ON q.session = k.session AND q.t_us >= k.t_us),
 b AS (SELECT q.id, k.t_us AS t2, k.x AS x2, k.y AS y2 FROM q ASOF JOIN k ON q.session = k.session AND q.t_us <= k.t_us),
 m AS (SELECT *, CASE WHEN t1 = t2 THEN 0.0 ELSE (t_us - t1) / CAST(t2 - t1 AS DOUBLE) END AS f FROM a JOIN b USING (id))
SELECT session, id, round(x1 + f * (x2 - x1), 5) AS x, round(y1 + f * (y2 - y1), 5) AS y FROM m
""")  # fmt: skip
def join10(spark, d):
    t = trajectory(spark, d)
    half = F.col("z") / 20
    poses = t.filter("id % 3 <> 0").select("session", "t_us", "x", "y", "z", F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"))
    out = op.interpolate(t.filter("id % 3 = 0").select("session", "id", "t_us"), poses, "session", "t_us")
    return out.select("session", "id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("join10_interpolated_heading", f"""
WITH t AS ({TRAJECTORY}), q AS (SELECT session, id, t_us FROM t WHERE id % 3 = 0), k AS (SELECT * FROM t WHERE id % 3 <> 0),
 a AS (SELECT q.*, k.t_us AS t1, k.z AS z1 FROM q ASOF JOIN k ON q.session = k.session AND q.t_us >= k.t_us),
 b AS (SELECT q.id, k.t_us AS t2, k.z AS z2 FROM q ASOF JOIN k ON q.session = k.session AND q.t_us <= k.t_us),
 m AS (SELECT *, CASE WHEN t1 = t2 THEN 0.0 ELSE (t_us - t1) / CAST(t2 - t1 AS DOUBLE) END AS f FROM a JOIN b USING (id))
SELECT session, id, round((z1 + f * (z2 - z1)) / 10, 5) AS yaw FROM m
""")  # fmt: skip
def join10b(spark, d):
    t = trajectory(spark, d)
    half = F.col("z") / 20
    poses = t.filter("id % 3 <> 0").select("session", "t_us", "x", "y", "z", F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"))
    out = op.interpolate(t.filter("id % 3 = 0").select("session", "id", "t_us"), poses, "session", "t_us")
    turned = 2 * F.atan2("qz", "qw")
    return out.select("session", "id", F.round(F.when(turned < -1e-9, turned + 2 * F.pi()).otherwise(turned), 5).alias("yaw"))


@query("win1_midpoints", f"""
WITH s AS ({SAMPLES}), a AS (SELECT session, id, t_us, v, lead(t_us) OVER w AS t2, lead(v) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY session ORDER BY t_us, id))
SELECT session, id, round((v + v2) / 2, 6) AS mid, CASE WHEN t_us < 1704200000000000 THEN greatest(t2 - 1704200000000000, 0) ELSE t2 - t_us END AS dt FROM a WHERE t2 IS NOT NULL
""")  # fmt: skip
def win1(spark, d):
    w = Window.partitionBy("session").orderBy("t_us", "id")
    start = 1_704_200_000_000_000  # the end of the scan before: earlier time is already accounted for
    s = samples(spark, d).withColumn("t2", F.lead("t_us").over(w)).withColumn("v2", F.lead("v").over(w)).filter("t2 IS NOT NULL")
    dt = F.when(F.col("t_us") < start, F.greatest(F.col("t2") - start, F.lit(0))).otherwise(F.col("t2") - F.col("t_us"))
    return s.select("session", "id", F.round((F.col("v") + F.col("v2")) / 2, 6).alias("mid"), dt.alias("dt"))


@query("win2_consecutive_points", f"WITH p AS ({POINTS}), a AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY pt_idx)) SELECT scan_id, pt_idx, {R6(range2='x*x + y*y', dist2='(x-x2)*(x-x2) + (y-y2)*(y-y2) + (z-z2)*(z-z2)')} FROM a")
def win2(spark, d):
    w = Window.partitionBy("scan_id").orderBy("pt_idx")
    nxt = tuple(F.lead(c).over(w) for c in "xyz")
    return points(spark, d).select("scan_id", "pt_idx", *r6(range2=F.col("x") ** 2 + F.col("y") ** 2, dist2=g.sq_dist(g.vec("x", "y", "z"), nxt)))


@query("win3_repeats", f"WITH s AS ({SAMPLES}), a AS (SELECT session, id, kind, lag(kind) OVER (PARTITION BY session ORDER BY t_us, id) AS p FROM s) SELECT session, id, kind FROM a WHERE p IS NULL OR p <> kind")
def win3(spark, d):
    w = Window.partitionBy("session").orderBy("t_us", "id")
    return samples(spark, d).withColumn("_p", F.lag("kind").over(w)).filter("_p IS NULL OR _p <> kind").select("session", "id", "kind")


@query("win4_sliding_mean", f"WITH s AS ({SAMPLES}) SELECT session, id, round(avg(v) OVER (PARTITION BY session ORDER BY t_us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM s")
def win4(spark, d):
    return tables.running_mean(samples(spark, d), ["session"], ["t_us", "id"], "v", "mean", 5).select("session", "id", F.round("mean", 6).alias("mean"))


@query("win5_point_time_rank", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, row_number() OVER (PARTITION BY scan_id ORDER BY t_off_ms, pt_idx) AS rank FROM p")
def win5(spark, d):
    w = Window.partitionBy("scan_id").orderBy("t_off_ms", "pt_idx")
    return points(spark, d).select("scan_id", "pt_idx", F.row_number().over(w).cast("long").alias("rank"))


@query("win6_odometry_chain", f"""
WITH t AS ({TRAJECTORY}), a AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM t WINDOW w AS (PARTITION BY session ORDER BY t_us, id))
SELECT session, id, round(cos(pz) * (x - px) + sin(pz) * (y - py), 5) AS dx, round(-sin(pz) * (x - px) + cos(pz) * (y - py), 5) AS dy, round(z - pz, 5) AS dyaw FROM a WHERE px IS NOT NULL
""")  # fmt: skip
def win6(spark, d):
    # z is taken as the heading; the pose before is the frame of the step.
    w = Window.partitionBy("session").orderBy("t_us", "id")
    t = trajectory(spark, d).withColumns({f"p{c}": F.lag(c).over(w) for c in "xyz"}).filter("px IS NOT NULL")
    m1, m2 = g.euler_to_mat(F.lit(0.0), F.lit(0.0), F.col("pz")), g.euler_to_mat(F.lit(0.0), F.lit(0.0), F.col("z"))
    m, step = g.relative(m1, (F.col("px"), F.col("py"), F.lit(0.0)), m2, (F.col("x"), F.col("y"), F.lit(0.0)))
    return t.select("session", "id", F.round(step[0], 5).alias("dx"), F.round(step[1], 5).alias("dy"), F.round(g.mat_to_euler(m)[2], 5).alias("dyaw"))


@query("win7_lagged_frames", f"WITH p AS ({POINTS}), f AS (SELECT scan_id AS frame, count(*) AS n FROM p GROUP BY 1) SELECT a.frame, a.n, b.n AS n1, c.n AS n2 FROM f a LEFT JOIN f b ON b.frame = a.frame - 1 LEFT JOIN f c ON c.frame = a.frame - 2")
def win7(spark, d):
    f = points(spark, d).groupBy(F.col("scan_id").alias("frame")).agg(F.count("*").alias("n"))
    back = lambda k: f.select((F.col("frame") + k).alias("frame"), F.col("n").alias(f"n{k}"))
    return f.join(back(1), "frame", "left").join(back(2), "frame", "left")


@query("str5_epochs", f"""
WITH s AS ({SAMPLES}), a AS (SELECT session, id, (t_us + (id % 7) * 200000000000) AS t FROM s), b AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY session ORDER BY id) > t THEN 1 ELSE 0 END AS back FROM a)
SELECT session, id, CAST(sum(back) OVER (PARTITION BY session ORDER BY id) AS BIGINT) AS epoch FROM b
""")  # fmt: skip
def str5(spark, d):
    s = samples(spark, d).withColumn("t", F.col("t_us") + (F.col("id") % 7) * 200_000_000_000)
    return op.epochs(s, "session", "id", "t").select("session", "id", "epoch")


@query("str6_periods", f"WITH s AS ({SAMPLES}) SELECT session, t_us // 3600000000 * 3600000000 AS start_us, count(*) AS n, round(sum(v), 4) AS v FROM s GROUP BY 1, 2")
def str6(spark, d):
    start = (F.floor(F.col("t_us") / 3_600_000_000) * 3_600_000_000).cast("long")
    return samples(spark, d).groupBy("session", start.alias("start_us")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))


@query("str7_gap_fill", f"""
WITH s AS (SELECT DISTINCT session, t_us FROM ({SAMPLES})), g AS (SELECT session, t_us, lag(t_us) OVER (PARTITION BY session ORDER BY t_us) AS p FROM s)
SELECT session, t_us, false AS filled FROM s UNION ALL SELECT session, unnest(range(p + {DAY}, t_us, {DAY})) AS t_us, true AS filled FROM g WHERE t_us - p > {DAY}
""")  # fmt: skip
def str7(spark, d):
    return op.fill_gaps(samples(spark, d).select("session", "t_us").distinct(), "session", "t_us", DAY)


@query("str2_late_scans", f"WITH s AS ({SAMPLES}), j AS (SELECT session, max(t_us) AS jump FROM s WHERE kind = 'error' AND id % 5 = 0 GROUP BY 1) SELECT s.session, s.id FROM s LEFT JOIN j USING (session) WHERE jump IS NULL OR t_us > jump")
def str2(spark, d):
    # A correction at `jump` discards all that isn't later.
    s = samples(spark, d)
    jump = s.filter("kind = 'error' AND id % 5 = 0").groupBy("session").agg(F.max("t_us").alias("jump"))
    return s.join(jump, "session", "left").filter("jump IS NULL OR t_us > jump").select("session", "id")


@query("agg21_path_length", f"""
WITH t AS ({TRAJECTORY}), a AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM t WINDOW w AS (PARTITION BY session ORDER BY t_us, id))
SELECT session, id, round(sum(step) OVER r, 4) AS travelled, min(x) OVER r AS min_x, max(x) OVER r AS max_x FROM a WINDOW r AS (PARTITION BY session ORDER BY t_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")  # fmt: skip
def agg21(spark, d):
    return op.path_length(trajectory(spark, d), "session", ["t_us", "id"]).select("session", "id", F.round("travelled", 4).alias("travelled"), "min_x", "max_x")


@query("agg22_running_mean", f"WITH s AS ({SAMPLES}) SELECT session, id, round(1000 * avg(v) OVER (PARTITION BY session ORDER BY t_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 997, 5) AS mean FROM s")
def agg22(spark, d):
    mean = tables.running_mean(samples(spark, d), ["session"], ["t_us", "id"], "v", "mean")
    return mean.select("session", "id", F.round(1000 * F.col("mean") / 997, 5).alias("mean"))  # a scale that no rounding tie falls on


@query("fac11_jump_remap", f"WITH t AS ({TRAJECTORY}) SELECT session, id, CASE WHEN t_us <= 1705000000000000 THEN round(-y + 1.5, 5) ELSE round(x, 5) END AS x, CASE WHEN t_us <= 1705000000000000 THEN round(x - 2.0, 5) ELSE round(y, 5) END AS y FROM t")
def fac11(spark, d):
    # After the jump everything is turned by 90 degrees and shifted; what came before is carried over.
    before, after = ([F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)], g.lit3((0, 0, 0))), ([F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)], g.lit3((1.5, -2.0, 0)))
    m, t = g.compose(*after, *g.inverse(*before))
    p = g.transform(m, t, g.vec("x", "y", "z"))
    old = F.col("t_us") <= 1_705_000_000_000_000
    pick = lambda k, c: F.round(F.when(old, p[k]).otherwise(F.col(c)), 5).alias(c)
    return trajectory(spark, d).select("session", "id", pick(0, "x"), pick(1, "y"))


@query("src26_pair_up", f"WITH {_LR} SELECT l.session, l.id, r.id AS rid FROM l ASOF LEFT JOIN r ON l.session = r.session AND l.t_us >= r.t_us")
def src26(spark, d):
    left, right = _lr(spark, d)
    return op.asof_backward(left, right, "session", "t_us", ["rid"]).select("session", "id", F.col("r_rid").alias("rid"))


@query("src16_split", "SELECT event_id AS id, string_split(props, ':')[1] AS key, string_split(props, ':')[2] AS rest FROM events")
def src16(spark, d):
    from pointframe.session import table

    parts = F.split("props", ":")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), parts[0].alias("key"), parts[1].alias("rest"))


@query("src20_sentinel_split", f"""
WITH p AS (SELECT scan_id, pt_idx, CASE WHEN pt_idx % 11 = 10 THEN -1010.1 ELSE x END AS x FROM ({POINTS})), a AS (SELECT *, sum(CASE WHEN x < -1010 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY pt_idx) AS s FROM p)
SELECT scan_id, CAST(s AS BIGINT) AS frame, count(*) AS n, round(sum(x), 5) AS sx FROM a WHERE x > -1010 GROUP BY 1, 2
""")  # fmt: skip
def src20(spark, d):
    from pointframe.sources.readers import split_on_marker

    marked = points(spark, d).select("scan_id", "pt_idx", F.when(F.col("pt_idx") % 11 == 10, F.lit(-1010.1)).otherwise(F.col("x")).alias("x"))
    frames = split_on_marker(marked, ["scan_id"], "pt_idx", F.abs(F.col("x") + 1010.1) < 1e-3)
    return frames.groupBy("scan_id", "frame").agg(F.count("*").alias("n"), F.round(F.sum("x"), 5).alias("sx"))
