"""Queries of plane fits, registration sums, inertial propagation, factor tables, keyframes and map maintenance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g
from pointframe.functions.packets import decode_packets
from pointframe.operators import estimation as es
from pointframe.operators import fitting as ft
from pointframe.operators import graph as gr
from pointframe.operators import tables
from pointframe.plans.q_points import R6, r6
from pointframe.plans.registry import query
from pointframe.sources import readers
from pointframe.sources.adapters import POINTS, SAMPLES, TRAJECTORY, points, samples, trajectory
from pointframe.streaming import keyframes as kf


@query("fit1_plane_of_points", f"""
WITH p AS (SELECT pt_idx // 5 AS grp, x, y, z FROM ({POINTS})),
 m AS (SELECT grp, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz, -sum(x) AS sx, -sum(y) AS sy, -sum(z) AS sz FROM p GROUP BY 1),
 i AS (SELECT *, xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS det FROM m),
 s AS (SELECT grp, (sx*(yy*zz - yz*yz) + sy*(xz*yz - xy*zz) + sz*(xy*yz - xz*yy)) / det AS a, (sx*(yz*xz - xy*zz) + sy*(xx*zz - xz*xz) + sz*(xz*xy - xx*yz)) / det AS b, (sx*(xy*yz - yy*xz) + sy*(xy*xz - xx*yz) + sz*(xx*yy - xy*xy)) / det AS c FROM i),
 n AS (SELECT grp, a / sqrt(a*a+b*b+c*c) AS nx, b / sqrt(a*a+b*b+c*c) AS ny, c / sqrt(a*a+b*b+c*c) AS nz, 1 / sqrt(a*a+b*b+c*c) AS d FROM s)
SELECT n.grp, {R6(nx='any_value(nx)', nz='any_value(nz)', d='any_value(d)', worst='max(abs(nx*x + ny*y + nz*z + d))')}, max(abs(nx*x + ny*y + nz*z + d)) <= 0.5 AS ok FROM n JOIN p USING (grp) GROUP BY 1
""")  # fmt: skip
def fit1(spark, d):
    p = points(spark, d).withColumn("grp", F.floor(F.col("pt_idx") / 5))
    out = ft.plane_of_points(p, ["grp"], 0.5)
    return out.select("grp", *r6(nx=F.col("nx"), nz=F.col("nz"), d=F.col("d"), worst=F.col("worst")), "ok")


@query("fit12_measurement_sums", f"""
WITH w AS (SELECT *, x + 0.2 AS bx, y - 0.1 AS by_, z + 0.3 AS bz, cos(0.4) * nx + sin(0.4) * ny AS c0, -sin(0.4) * nx + cos(0.4) * ny AS c1, nz AS c2 FROM ({POINTS})),
 h AS (SELECT nx AS h0, ny AS h1, by_ * c2 - bz * c1 AS h3, bz * c0 - bx * c2 AS h4, y * c2 - z * c1 AS h6, x * c1 - y * c0 AS h8, c0 AS h9, c2 AS h11,
  nx * (cos(0.4) * bx - sin(0.4) * by_ + 1.0) + ny * (sin(0.4) * bx + cos(0.4) * by_ - 2.0) + nz * (bz + 0.5) + 0.5 AS r FROM w)
SELECT count(*) AS n, {R6(s00='sum(h0*h0)', s13='sum(h1*h3)', s34='sum(h3*h4)', s68='sum(h6*h8)', s411='sum(h4*h11)', s99='sum(h9*h9)', r0='sum(h0*r)', r4='sum(h4*r)', r8='sum(h8*r)', r11='sum(h11*r)')} FROM h
""")  # fmt: skip
def fit12(spark, d):
    turned = es.State(pos=np.array([1.0, -2.0, 0.5]), rot=es.exp_so3(np.array([0.0, 0.0, 0.4])), mount_pos=np.array([0.2, -0.1, 0.3]))
    h, r, n = es.measurement_sums(es.measurement_rows(points(spark, d).withColumn("d", F.lit(0.5)), turned))
    sums = {f"s{a}{b}": h[a, b] for a, b in ((0, 0), (1, 3), (3, 4), (6, 8), (4, 11), (9, 9))} | {f"r{k}": r[k] for k in (0, 4, 8, 11)}
    return spark.createDataFrame([(n, *(float(v) for v in sums.values()))], "n long, " + ", ".join(f"{c} double" for c in sums)).select("n", *r6(**{c: F.col(c) for c in sums}))


def _tri_pairs(spark, d):
    """Triangles of three consecutive points and the same ones turned by 90 degrees about z and shifted by (1, 2, 3), some of them spoilt."""
    p = points(spark, d).withColumn("tri", F.floor(F.col("pt_idx") / 3))
    turned = F.array(-F.col("y") + 1 + F.when(F.col("tri") % 4 == 0, F.col("tri")).otherwise(0), F.col("x") + 2, F.col("z") + 3)
    rows = p.groupBy("tri").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pt_idx", F.array("x", "y", "z").alias("a")))), lambda s: s["a"])).alias("q"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pt_idx", turned.alias("a")))), lambda s: s["a"])).alias("t"))
    return rows.filter(F.size("q") == 9).withColumn("grp", F.col("tri") % 5)  # the last points may be fewer than three


_TRIS = f"SELECT pt_idx // 3 AS tri FROM ({POINTS}) GROUP BY 1 HAVING count(*) = 3"


_TURNED = "SELECT * FROM (VALUES (0.0::DOUBLE, -1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE)) AS v(m00, m01, m10, m11, tx, ty, tz)"


@query("fit2_triangle_transform", f"WITH v AS ({_TURNED}) SELECT tri, {R6(m00='m00', m01='m01', m10='m10', tx='tx', ty='ty')} FROM v, (SELECT tri FROM ({_TRIS}) WHERE tri % 4 <> 0)")
def fit2(spark, d):
    a = ft.align_triangles(_tri_pairs(spark, d).filter("tri % 4 <> 0"))
    r, s = F.col("rotation"), F.col("shift")
    return a.select("tri", *((F.round(v, 6) + 0.0).alias(n) for n, v in {"m00": r[0], "m01": r[1], "m10": r[3], "tx": s[0], "ty": s[1]}.items()))


@query("fit3_voted_transform", f"WITH t AS ({_TRIS}) SELECT tri % 5 AS grp, CAST(sum(CASE WHEN tri % 4 <> 0 OR tri < 3 THEN 1 ELSE 0 END) AS BIGINT) AS votes, -1.0::DOUBLE AS m01, 1.0::DOUBLE AS m10 FROM t GROUP BY 1")
def fit3(spark, d):
    v = ft.vote_transforms(_tri_pairs(spark, d), ["grp"], "tri")
    r = F.col("rotation")
    return v.select("grp", "votes", F.round(r[1], 5).alias("m01"), F.round(r[3], 5).alias("m10"))


@query("fit4_rotation_consensus", f"""
WITH t AS (SELECT tri, tri % 5 AS grp FROM ({_TRIS})), n AS (SELECT grp, count(*) AS n, count(*) // 200 + 1 AS step, sum(CASE WHEN tri % 4 <> 0 OR tri < 5 THEN 1 ELSE 0 END) AS met FROM t GROUP BY 1)
SELECT grp, CAST((n + step - 1) // step AS BIGINT) AS agreeing, CAST(met AS BIGINT) AS n_met, -1.0::DOUBLE AS m01, 1.0::DOUBLE AS m10 FROM n
""")  # fmt: skip
def fit4(spark, d):
    v = ft.rotation_consensus(_tri_pairs(spark, d), ["grp"], "tri")
    return v.select("grp", "agreeing", "n_met", F.round(F.col("rotation")[1], 5).alias("m01"), F.round(F.col("rotation")[3], 5).alias("m10"))


_BACK = f"SELECT pt_idx, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for c in 'xyz')} FROM ({POINTS})"
_TURN, _MOVE = np.array([0.008, -0.01, 0.006]), np.array([0.02, -0.03, 0.01])


def _moved(spark, d):
    """The cloud turned a little about a general axis and moved."""
    return ft._apply(points(spark, d), ft._exp(_TURN), _MOVE)


def _aligned(cloud, r, t):
    return ft._apply(cloud, r, t).select("pt_idx", *((F.round(c, 3) + 0.0).alias(c) for c in "xyz"))


@query("fit7_point_to_point", _BACK)
def fit7(spark, d):
    moved = _moved(spark, d)
    return _aligned(moved, *ft.icp_point_to_point(moved, points(spark, d), ["pt_idx"], ["pt_idx"], 0.5, 20)[:2])


@query("fit8_point_to_plane", _BACK)
def fit8(spark, d):
    moved = _moved(spark, d)
    return _aligned(moved, *ft.icp_point_to_plane(moved, points(spark, d), ["pt_idx"], ["pt_idx"], 0.5)[:2])


@query("fit5_short_alignment", _BACK)
def fit5(spark, d):
    # From a guess that is off by a part of the way.
    moved = _moved(spark, d)
    r = ft._exp(-0.8 * _TURN)
    return _aligned(moved, *ft.align_planes(moved, points(spark, d), ["pt_idx"], ["pt_idx"], 0.5, (r, -0.8 * _MOVE))[:2])


@query("fit6_long_alignment", _BACK)
def fit6(spark, d):
    moved = _moved(spark, d)
    return _aligned(moved, *ft.align_planes_long(moved, points(spark, d), ["pt_idx"], ["pt_idx"])[:2])


@query("fit9_checked_alignment", f"SELECT TRUE AS fits, * FROM ({_BACK})")
def fit9(spark, d):
    moved = _moved(spark, d)
    fits, r, t, _ = ft.icp_checked(moved, points(spark, d), ["pt_idx"], ["pt_idx"], max_dist=0.5)
    return _aligned(moved, r, t).withColumn("fits", F.lit(fits))


def _imu(spark, d):
    """Samples at 100 Hz of a body that turns about its vertical axis and is pushed along both others."""
    s = samples(spark, d)
    order = F.row_number().over(Window.partitionBy("session").orderBy("t_us", "id"))
    zero = F.lit(0.0)
    return s.select("session", (order * 10_000).cast("long").alias("t_us"), "id", zero.alias("gx"), zero.alias("gy"), (F.col("v") * 0.01098913).alias("gz"), (F.col("v") * 0.14285137).alias("ax"), (F.col("v") * 0.02040813 - 1).alias("ay"), F.lit(9.81).alias("az"))


_IMU = f"SELECT session, row_number() OVER (PARTITION BY session ORDER BY t_us, id) AS k, v FROM ({SAMPLES})"


@query("fit10_inertial_states", f"""
WITH a AS (SELECT session, k, (v + lag(v) OVER w) / 2 AS m FROM ({_IMU}) WINDOW w AS (PARTITION BY session ORDER BY k)), b AS (SELECT *, coalesce(m, 0) * 0.01098913 * 0.01 AS turn FROM a),
 c AS (SELECT *, sum(turn) OVER (PARTITION BY session ORDER BY k) - turn AS yaw FROM b),
 e AS (SELECT *, CASE WHEN m IS NULL THEN 0 ELSE cos(yaw) * m * 0.14285137 - sin(yaw) * (m * 0.02040813 - 1) END AS x, CASE WHEN m IS NULL THEN 0 ELSE sin(yaw) * m * 0.14285137 + cos(yaw) * (m * 0.02040813 - 1) END AS y FROM c),
 f AS (SELECT *, sum(x * 0.01) OVER (PARTITION BY session ORDER BY k) AS vx, sum(y * 0.01) OVER (PARTITION BY session ORDER BY k) AS vy FROM e),
 h AS (SELECT *, sum(vx * 0.01) OVER (PARTITION BY session ORDER BY k) - vx * 0.01 AS px FROM f)
SELECT session, k * 10000 AS t_us, {R6(px='px', vx='vx', vy='vy', c='cos(yaw + turn)')} FROM h
""")  # fmt: skip
def fit10(spark, d):
    # The third rotation entry is the cosine of the angle after the sample.
    s = es.propagate_states(_imu(spark, d))
    return s.select("session", "t_us", *r6(px=F.col("pos")[0], vx=F.col("vel")[0], vy=F.col("vel")[1], c=F.col("rot")[0]))


@query("agg17_inertial_init", f"""
WITH r AS (SELECT session, k, v * 0.14285137 AS ax, v * 0.02040813 - 1 AS ay FROM ({_IMU}) WHERE k <= 20), m AS (SELECT *, avg(ax) OVER w AS mx, avg(ay) OVER w AS my FROM r WINDOW w AS (PARTITION BY session ORDER BY k))
SELECT session, count(*) AS n, {R6(mx='avg(ax)', my='avg(ay)', mz='9.81::DOUBLE', vx='sum((ax - mx)**2 * (k - 1) / k::DOUBLE) / count(*)', vy='sum((ay - my)**2 * (k - 1) / k::DOUBLE) / count(*)', vz='0.0::DOUBLE')} FROM m GROUP BY 1
""")  # fmt: skip
def agg17(spark, d):
    out = ft.imu_start(_imu(spark, d))
    return out.select("session", "n", *r6(**{c: F.col(c) + 0.0 for c in ("mx", "my", "mz", "vx", "vy", "vz")}))


@query("fit11_undistortion", f"""
WITH t AS ({TRAJECTORY}), a AS (SELECT session, id, t_us, (t_us - lag(t_us) OVER w - 1) / 1e6 AS dt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t WINDOW w AS (PARTITION BY session ORDER BY t_us)), e AS (SELECT session, max_by(x, t_us) AS ex, max_by(y, t_us) AS ey FROM t GROUP BY 1),
 m AS (SELECT a.session, id, px + 1e-5 * dt + cos(0.3 + 1e-7 * dt) - 2 * sin(0.3 + 1e-7 * dt) - ex AS wx, py + sin(0.3 + 1e-7 * dt) + 2 * cos(0.3 + 1e-7 * dt) - ey AS wy FROM a JOIN e USING (session) WHERE px IS NOT NULL)
SELECT session, id, {R6(x='cos(0.5) * wx + sin(0.5) * wy', y='-sin(0.5) * wx + cos(0.5) * wy')} FROM m
""")  # fmt: skip
def fit11(spark, d):
    # Each point is seen one microsecond before the next pose, from the state before, which drifts and turns; the end is turned another way.
    t = trajectory(spark, d)
    zero, turn = F.lit(0.0), lambda a: {"qw": F.lit(math.cos(a / 2)), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(math.sin(a / 2))}
    poses = t.select("session", "t_us", F.col("x").alias("px"), F.col("y").alias("py"), zero.alias("pz"), F.lit(1e-5).alias("vx"), *(zero.alias(c) for c in ("vy", "vz", "wx", "wy")), F.lit(1e-7).alias("wz"), *(v.alias(c) for c, v in turn(0.3).items()))
    pts = t.select("session", "id", F.lit(0).alias("scan_id"), (F.col("t_us") - 1).alias("t_us"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    ends = t.groupBy("session").agg(F.max_by("x", "t_us").alias("px"), F.max_by("y", "t_us").alias("py")).select("session", F.lit(0).alias("scan_id"), "px", "py", zero.alias("pz"), *(v.alias(c) for c, v in turn(0.5).items()))
    return ft.undistort(pts, poses, ends).select("session", "id", *r6(x=F.col("x"), y=F.col("y")))


@query("fit13_pose_update", _BACK)
def fit13(spark, d):
    # The cloud is seen from a pose that the filter doesn't know; every point lies on a known plane.
    r, t = es.exp_so3(np.array([0.05, -0.08, 0.1])), np.array([0.3, -0.2, 0.1])
    p = points(spark, d).withColumn("d", -g.dot(g.vec("nx", "ny", "nz"), g.vec("x", "y", "z")))
    seen = ft._apply(p, r.T, -r.T @ t)
    known = 1e-10 * np.eye(es.SIZE)  # the mounting is known, the pose is not
    known[:6, :6] = np.eye(6)
    x, _ = es.update(es.State(), known, lambda x: es.measurement_sums(es.measurement_rows(seen, x)), 1e-6, 8, 1e-8)
    return _aligned(seen, x.rot, x.pos)


def _frames(spark, d):
    t = trajectory(spark, d)
    return t.select("session", F.col("id").alias("frame_id"), "x", "y", "z", (F.col("z") % 0.7).alias("roll"), (F.col("z") % 1.1 - 0.5).alias("pitch"), (F.col("z") % 3.0).alias("yaw"))


_FRAMES = f"SELECT session, id AS frame_id, x, y, z, z % 0.7 AS r, z % 1.1 - 0.5 AS p, z % 3.0 AS yaw FROM ({TRAJECTORY})"
#: The columns of a frame's rotation.
_AXES = ("cos(yaw)*cos(p)", "sin(yaw)*cos(p)", "-sin(p)"), ("cos(yaw)*sin(p)*sin(r) - sin(yaw)*cos(r)", "sin(yaw)*sin(p)*sin(r) + cos(yaw)*cos(r)", "cos(p)*sin(r)"), ("cos(yaw)*sin(p)*cos(r) + sin(yaw)*sin(r)", "sin(yaw)*sin(p)*cos(r) - cos(yaw)*sin(r)", "cos(p)*cos(r)")


@query("fac1_prior_factors", f"WITH f AS ({_FRAMES}) SELECT session, min(frame_id) AS frame_id, {R6(x='min_by(x, frame_id)', yaw='min_by(yaw, frame_id)')}, 1e-6::DOUBLE AS var0 FROM f GROUP BY 1")
def fac1(spark, d):
    return gr.prior_factors(_frames(spark, d)).select("session", "frame_id", *r6(x=F.col("x"), yaw=F.col("yaw")), F.col("var")[0].alias("var0"))


@query("fac2_between_factors", f"""
WITH f AS ({_FRAMES}), m AS (SELECT *, {', '.join(f'{e} AS m{i}{k}' for k, axis in enumerate(_AXES) for i, e in enumerate(axis))} FROM f),
 a AS (SELECT *, lag(frame_id) OVER w AS i, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, z - lag(z) OVER w AS uz, {', '.join(f'lag(m{i}{k}) OVER w AS l{i}{k}' for i in range(3) for k in range(3))} FROM m WINDOW w AS (PARTITION BY session ORDER BY frame_id))
SELECT session, i, frame_id AS j, {', '.join(f'round(l0{k}*ux + l1{k}*uy + l2{k}*uz, 5) AS d{c}' for k, c in enumerate('xyz'))}, round(l00*m00 + l10*m10 + l20*m20, 5) AS m00, round(l00*m02 + l10*m12 + l20*m22, 5) AS m02, round(l02*m00 + l12*m10 + l22*m20, 5) AS m20 FROM a WHERE i IS NOT NULL
""")  # fmt: skip
def fac2(spark, d):
    b = gr.between_factors(_frames(spark, d))
    m = g.euler_to_mat(F.col("droll"), F.col("dpitch"), F.col("dyaw"))
    return b.select("session", "i", "j", *(F.round(f"d{c}", 5).alias(f"d{c}") for c in "xyz"), *(F.round(m[k], 5).alias(n) for n, k in (("m00", 0), ("m02", 2), ("m20", 6))))


def _pairs(spark, d):
    p = points(spark, d)
    pose = lambda s, k: [F.lit(v).alias(f"{s}_{c}") for c, v in zip(gr.POSE, k, strict=True)]
    return p.select(F.col("scan_id").alias("i"), ((F.col("scan_id") + 1) % 10).alias("j"), "pt_idx", *pose("a", (1.0, 2.0, 0.0, 0.0, 0.0, 0.5)), *pose("b", (0.5, 0.0, 1.0, 0.0, 0.0, -0.25)), F.col("x").alias("p1x"), F.col("y").alias("p1y"), F.col("z").alias("p1z"), F.col("nx").alias("p2x"), F.col("ny").alias("p2y"), F.col("nz").alias("p2z"))


_RES = f"""SELECT scan_id AS i, (scan_id + 1) % 10 AS j, pt_idx, cos(0.75)*x - sin(0.75)*y + cos(-0.25)*0.5 + sin(-0.25)*2.0 - nx AS rx, sin(0.75)*x + cos(0.75)*y - sin(-0.25)*0.5 + cos(-0.25)*2.0 - ny AS ry, z - 1.0 - nz AS rz FROM ({POINTS})"""


@query("fac3_pair_residuals", f"SELECT i, j, pt_idx, {R6(rx='rx', ry='ry', rz='rz')} FROM ({_RES})")
def fac3(spark, d):
    return gr.pair_residuals(_pairs(spark, d)).select("i", "j", "pt_idx", *r6(rx=F.col("rx"), ry=F.col("ry"), rz=F.col("rz")))


@query("agg20_worst_residual", f"SELECT i, j, round(max(sqrt(rx*rx + ry*ry + rz*rz)), 6) AS worst, max(sqrt(rx*rx + ry*ry + rz*rz)) > 5.0 AS reject FROM ({_RES}) GROUP BY 1, 2")
def agg20(spark, d):
    return gr.judge_pairs(gr.pair_residuals(_pairs(spark, d)), 5.0).select("i", "j", *r6(worst=F.col("worst")), "reject")


def _bodies(spark, d):
    p = points(spark, d)
    poses = p.select(F.col("scan_id").alias("id")).distinct().select(F.col("id").alias("frame_id"), (F.col("id") * 0.1).alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"))
    m = p.select(F.col("scan_id").alias("i"), ((F.col("scan_id") + 1) % 10).alias("j"), F.col("pt_idx").alias("pair_id"), F.col("x").alias("p1x"), F.col("y").alias("p1y"), F.col("z").alias("p1z"), F.col("nx").alias("p2x"), F.col("ny").alias("p2y"), F.col("nz").alias("p2z"))
    return gr.pair_factors(m, poses, 6)


_BODY = f"""b AS (SELECT scan_id AS i, (scan_id + 1) % 10 AS j, pt_idx AS pair_id, x - scan_id * 0.1 AS p1x, y - 0.5 AS p1y, z AS p1z, nx - ((scan_id + 1) % 10) * 0.1 AS p2x, ny - 0.5 AS p2y, nz AS p2z FROM ({POINTS})),
 r AS (SELECT *, sqrt(p1x**2 + p1y**2 + p1z**2) + sqrt(p2x**2 + p2y**2 + p2z**2) AS reach FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY reach, pair_id) AS r FROM r)"""


@query("fac4_pair_factors", f"WITH {_BODY} SELECT i, j, pair_id, {R6(p1x='p1x', p2x='p2x', reach='reach')} FROM k WHERE r <= 6")
def fac4(spark, d):
    return _bodies(spark, d).select("i", "j", "pair_id", *r6(p1x=F.col("p1x"), p2x=F.col("p2x"), reach=F.col("reach")))


@query("top6_nearest_pairs", f"WITH {_BODY} SELECT i, j, count(*) AS n, round(max(reach), 6) AS far FROM k WHERE r <= 6 GROUP BY 1, 2")
def top6(spark, d):
    return _bodies(spark, d).groupBy("i", "j").agg(F.count("*").alias("n"), F.round(F.max("reach"), 6).alias("far"))


@query("top5_six_pairs", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY rx*rx + ry*ry + rz*rz, pt_idx) AS r FROM ({_RES})) SELECT i, pt_idx FROM k WHERE r <= 6")
def top5(spark, d):
    r = gr.pair_residuals(_pairs(spark, d))
    return tables.top_per(r, ["i"], [g.dot(g.vec("rx", "ry", "rz"), g.vec("rx", "ry", "rz")), "pt_idx"], 6).select("i", "pt_idx")


@query("fac6_replace_accepted", f"WITH {_BODY} SELECT i, j, count(*) AS n FROM k WHERE r <= 6 AND i % 3 <> 0 GROUP BY 1, 2 UNION ALL SELECT DISTINCT i, j, -1 AS n FROM b WHERE i % 3 = 0")
def fac6(spark, d):
    pairs = _bodies(spark, d)
    accepted = pairs.filter("i % 3 = 0").select("i", "j").distinct()
    kept, between = gr.replace_accepted(pairs, accepted.limit(0), accepted)
    return kept.groupBy("i", "j").agg(F.count("*").alias("n")).unionByName(between.select("i", "j", F.lit(-1).cast("long").alias("n")))


@query("str1_keyframe_windows")
def str1(spark, d):
    t = trajectory(spark, d).withColumns({"qw": F.cos(F.col("z") / 2), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(F.col("z") / 2)})
    return kf.keyframes_batch(t, window=5).select("session", "keyframe", "t_us", "n_scans")


@query("str3_submaps", f"WITH s AS ({SAMPLES}), m AS (SELECT session, id AS submap, t_us FROM s WHERE kind = 'purchase'), p AS (SELECT session, id, t_us FROM s WHERE kind <> 'purchase') SELECT p.session, p.id, m.submap FROM p ASOF LEFT JOIN m ON p.session = m.session AND p.t_us <= m.t_us")
def str3(spark, d):
    s = samples(spark, d)
    return kf.submaps(s.filter("kind <> 'purchase'").select("session", "id", "t_us"), s.filter("kind = 'purchase'").select("session", F.col("id").alias("submap"), "t_us")).select("session", "id", "submap")


@query("str4_submap_poses", f"WITH s AS ({SAMPLES}), t AS ({TRAJECTORY}) SELECT s.session, s.id, {R6(x='t.x')} FROM s JOIN t ON s.session = t.session AND s.id = t.id WHERE s.kind = 'purchase'")
def str4(spark, d):
    s = samples(spark, d).filter("kind = 'purchase'").select("session", "id")
    return s.join(trajectory(spark, d), ["session", "id"]).select("session", "id", *r6(x=F.col("x")))


def _versions(spark, d):
    base = trajectory(spark, d).select("session", F.col("id").alias("frame_id"), "x", "y", "z", F.lit(0).alias("version"))
    fixes = base.filter("frame_id % 5 = 0").withColumn("x", F.col("x") + 1)
    return kf.correct_versions(base, fixes, 1)


@query("str11_corrected_poses", f"SELECT session, id AS frame_id, {R6(x='CASE WHEN id % 5 = 0 THEN x + 1 ELSE x END')}, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS version FROM ({TRAJECTORY})")
def str11(spark, d):
    return kf.latest(_versions(spark, d)).select("session", "frame_id", *r6(x=F.col("x")), "version")


@query("str11_rolled_back_poses", f"SELECT session, id AS frame_id, {R6(x='x')}, 0 AS version FROM ({TRAJECTORY})")
def str11b(spark, d):
    return kf.latest(_versions(spark, d), 0).select("session", "frame_id", *r6(x=F.col("x")), "version")


@query("str10_near_submaps", f"WITH t AS ({TRAJECTORY}), e AS (SELECT session, arg_max(x, (t_us, id)) AS x, arg_max(y, (t_us, id)) AS y, arg_max(z, (t_us, id)) AS z FROM t GROUP BY 1) SELECT t.session, t.id AS frame_id FROM t JOIN e USING (session) WHERE (t.x-e.x)**2 + (t.y-e.y)**2 + (t.z-e.z)**2 <= 9 AND t.id % 4 <> 0")
def str10(spark, d):
    t = trajectory(spark, d)
    frames = t.select("session", F.col("id").alias("frame_id"), "x", "y", "z")
    here = t.groupBy("session").agg(F.max_by(F.struct("x", "y", "z"), F.struct("t_us", "id")).alias("h")).select("session", "h.*")
    return kf.near_submaps(frames, here, 3.0, frames.filter("frame_id % 4 = 0")).select("session", "frame_id")


@query("snk1_corrected_map", f"WITH p AS ({POINTS}) SELECT scan_id AS frame_id, pt_idx, round(cos(scan_id * 0.1) * x - sin(scan_id * 0.1) * y + scan_id, 6) AS x, round(sin(scan_id * 0.1) * x + cos(scan_id * 0.1) * y, 6) AS y, round(z, 6) AS z FROM p WHERE pt_idx % 2 = 0")
def snk1(spark, d):
    zero = F.lit(0.0)
    k = points(spark, d).select(F.col("scan_id").alias("id")).distinct().select(F.col("id").alias("frame_id"), F.col("id").cast("double").alias("x"), zero.alias("y"), zero.alias("z"), zero.alias("roll"), zero.alias("pitch"), (F.col("id") * 0.1).alias("yaw"))
    return readers.corrected_map(points(spark, d).withColumnRenamed("scan_id", "frame_id"), k, 2).select("frame_id", "pt_idx", *r6(x=F.col("x"), y=F.col("y"), z=F.col("z")))


@query("prj16_packet_points", f"WITH p AS ({POINTS}) SELECT pt_idx AS packet_id, 0 AS pt_idx, 0 AS echo, {R6(x='trunc(x * 1000) / 1000', y='trunc(y * 1000) / 1000')}, CAST(pt_idx % 256 AS INTEGER) AS reflectivity FROM p")
def prj16(spark, d):
    # One point a packet: little-endian millimetres and a byte, put together by the engine.
    flip = lambda b: F.concat(*(F.substring(b, k, 1) for k in (4, 3, 2, 1)))
    big = lambda c: F.unhex(F.lpad(F.hex(F.pmod((F.col(c) * 1000).cast("long"), F.lit(1 << 32))), 8, "0"))
    payload = F.concat(*(flip(big(c)) for c in "xyz"), F.unhex(F.lpad(F.hex(F.col("pt_idx") % 256), 2, "0")))
    packets = points(spark, d).select(F.col("pt_idx").alias("packet_id"), F.lit(0).alias("kind"), payload.alias("payload"))
    return decode_packets(packets).select("packet_id", "pt_idx", "echo", *r6(x=F.col("x"), y=F.col("y")), "reflectivity")
