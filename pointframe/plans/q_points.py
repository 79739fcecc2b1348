"""Queries of decoders, projections and point filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.operators import points as op
from pointframe.plans import sqlgeom as sg
from pointframe.plans.registry import query
from pointframe.sources.adapters import CLOUD, POINTS, TRAJECTORY, cloud, points, trajectory

#: A rotation by 0.3, -0.2 and 0.5 about x, y and z, and a shift; a mounting as well.
R, P, Y = 0.3, -0.2, 0.5
_c, _s = math.cos, math.sin
ROT = [
    _c(P) * _c(Y), _s(R) * _s(P) * _c(Y) - _c(R) * _s(Y), _c(R) * _s(P) * _c(Y) + _s(R) * _s(Y),
    _c(P) * _s(Y), _s(R) * _s(P) * _s(Y) + _c(R) * _c(Y), _c(R) * _s(P) * _s(Y) - _s(R) * _c(Y),
    -_s(P), _s(R) * _c(P), _c(R) * _c(P),
]
SHIFT = (1.5, -2.0, 0.25)
EXT_T = (0.05, 0.02, -0.03)


def rot() -> list:
    return [F.lit(v) for v in ROT]


def r6(**cols) -> list:
    return [F.round(c, 6).alias(n) for n, c in cols.items()]


def R6(**cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {n}" for n, c in cols.items())


P_XYZ = ("x", "y", "z")


def xyz(v: g.Vec, p: str = "") -> list:
    return r6(**{f"{p}x": v[0], f"{p}y": v[1], f"{p}z": v[2]})


_RAW = """SELECT scan_id, pt_idx, x, y, z, CAST(pt_idx % 8 AS INTEGER) AS line, CAST((pt_idx * 7) % 64 AS INTEGER) AS tag, pt_idx * 1000 AS offset_ns FROM ({})"""


def raw(df: DataFrame) -> DataFrame:
    return df.select("scan_id", "pt_idx", "x", "y", "z", (F.col("pt_idx") % 8).cast("int").alias("line"), ((F.col("pt_idx") * 7) % 64).cast("int").alias("tag"), (F.col("pt_idx") * 1000).alias("offset_ns"))


@query("src1_livox_decode", f"""
WITH r AS ({_RAW.format(POINTS)}),
 a AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pt_idx) - 1 AS i FROM r),
 b AS (SELECT *, line < 6 AND (tag & 48) = 16 AND i > 0 AS v FROM a),
 c AS (SELECT *, v AND (sum(CASE WHEN v THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY pt_idx)) % 2 = 0 AS take FROM b),
 d AS (SELECT *, lag(take) OVER w AS lt, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(z) OVER w AS lz FROM c WINDOW w AS (PARTITION BY scan_id ORDER BY pt_idx)),
 e AS (SELECT *, CASE WHEN lt THEN lx ELSE 0 END AS px, CASE WHEN lt THEN ly ELSE 0 END AS py, CASE WHEN lt THEN lz ELSE 0 END AS pz FROM d)
SELECT scan_id, pt_idx, round(x, 6) AS x, round(offset_ns / 1e6, 6) AS t_off_ms FROM e
WHERE take AND (abs(x - px) > 1e-7 OR abs(y - py) > 1e-7 OR (abs(z - pz) > 1e-7 AND x*x + y*y > 0.01))
""")  # fmt: skip
def src1(spark, d):
    out = op.decode("livox", raw(points(spark, d)), n_scans=6, every=2)
    return out.select("scan_id", "pt_idx", *r6(x=F.col("x"), t_off_ms=F.col("t_off_ms")))


@query("src2_ouster_decode", f"""
WITH r AS ({_RAW.format(POINTS)}), a AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pt_idx) - 1 AS i FROM r)
SELECT scan_id, pt_idx, round(x, 6) AS x, round(offset_ns / 1e6, 6) AS t_off_ms FROM a WHERE i % 3 = 0 AND x*x + y*y + z*z >= 1.0
""")  # fmt: skip
def src2(spark, d):
    out = op.decode("ouster", raw(points(spark, d)).withColumnRenamed("offset_ns", "t_ns"), every=3, blind=1.0)
    return out.select("scan_id", "pt_idx", *r6(x=F.col("x"), t_off_ms=F.col("t_off_ms")))


@query("src3_velodyne_given", f"""
WITH r AS ({_RAW.format(POINTS)}), a AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pt_idx) - 1 AS i FROM r)
SELECT scan_id, pt_idx, line AS ring, round((offset_ns + 1) / 1000.0, 6) AS t_off_ms FROM a WHERE i % 2 = 0 AND x*x + y*y + z*z > 0.01
""")  # fmt: skip
def src3_given(spark, d):
    df = raw(points(spark, d)).withColumnRenamed("line", "ring").withColumn("t_us", F.col("offset_ns") + 1)
    return op.decode("velodyne", df, every=2).select("scan_id", "pt_idx", "ring", *r6(t_off_ms=F.col("t_off_ms")))


@query("src3_velodyne_rebuilt", f"""
WITH r AS ({_RAW.format(POINTS)}),
 a AS (SELECT *, atan2(y, x) * 57.2957 AS yaw, row_number() OVER (PARTITION BY scan_id, line ORDER BY pt_idx) AS k FROM r),
 f AS (SELECT scan_id, line, arg_min(yaw, pt_idx) AS yaw0 FROM a GROUP BY scan_id, line),
 b AS (SELECT a.*, (CASE WHEN yaw <= yaw0 THEN yaw0 - yaw ELSE yaw0 - yaw + 360.0 END) / 3.61 AS t FROM a JOIN f USING (scan_id, line)),
 c AS (SELECT *, CASE WHEN coalesce(lag(t) OVER (PARTITION BY scan_id, line ORDER BY pt_idx), 0) > t THEN 360.0 / 3.61 ELSE 0 END AS turn FROM b),
 e AS (SELECT *, t + sum(turn) OVER (PARTITION BY scan_id, line ORDER BY pt_idx) AS tt FROM c)
SELECT scan_id, pt_idx, line AS ring, round(tt, 6) AS t_off_ms FROM e WHERE k > 1 AND x*x + y*y + z*z > 0.01
""")  # fmt: skip
def src3_rebuilt(spark, d):
    df = raw(points(spark, d)).withColumnRenamed("line", "ring").withColumn("t_us", F.lit(0.0))
    return op.decode("velodyne", df).select("scan_id", "pt_idx", "ring", *r6(t_off_ms=F.col("t_off_ms")))


@query("src4_hesai_decode", f"""
WITH r AS ({_RAW.format(POINTS)})
SELECT scan_id, pt_idx, round(offset_ns * 3e-4, 6) AS t_off_ms FROM r WHERE offset_ns * 3e-4 <= 100 AND line < 5 AND x*x + y*y + z*z > 0.01
""")  # fmt: skip
def src4(spark, d):
    df = raw(points(spark, d)).withColumnRenamed("line", "ring").withColumn("t_s", F.col("offset_ns") * 3e-7)
    return op.decode("hesai", df, n_scans=5).select("scan_id", "pt_idx", *r6(t_off_ms=F.col("t_off_ms"))).orderBy("t_off_ms")


def _world(v: tuple[str, str, str]) -> list[str]:
    return sg.rotate(ROT, tuple(sg.rotate(ROT, v, EXT_T)), SHIFT)


@query("prj1_body_to_world", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(**dict(zip(P_XYZ, _world(P_XYZ), strict=True)))} FROM p")
def prj1(spark, d):
    body = g.transform(rot(), g.lit3(EXT_T), g.vec(*P_XYZ))
    return points(spark, d).select("scan_id", "pt_idx", *xyz(g.transform(rot(), g.lit3(SHIFT), body)))


@query("prj2_correct_points", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(x='x - 1.5 + 0.05', y='y + 2.0 + 0.02', z='z - 0.25 - 0.03')} FROM p")
def prj2(spark, d):
    # The pose before is (R, SHIFT), the one after (R, EXT_T): the rotations cancel.
    back = g.sub(g.vec(*P_XYZ), g.lit3(SHIFT))
    return points(spark, d).select("scan_id", "pt_idx", *xyz(g.transform(g.mat_mul(rot(), g.transpose(rot())), g.lit3(EXT_T), back)))


NORMAL, CENTER = (0.36, 0.48, 0.8), (0.2, -0.1, 0.3)
_D = -(0.36 * 0.2 + 0.48 * -0.1 + 0.8 * 0.3)
_DIS = f"(0.36 * x + 0.48 * y + 0.8 * z + {_D!r})"
_XA, _YA = g.plane_axes(NORMAL)
PLANE_SQL = f"""SELECT *, abs({_DIS}) AS dis,
 {_YA[0]!r} * (x - 0.2) + {_YA[1]!r} * (y + 0.1) + {_YA[2]!r} * (z - 0.3) AS u,
 {_XA[0]!r} * (x - 0.2) + {_XA[1]!r} * (y + 0.1) + {_XA[2]!r} * (z - 0.3) AS v FROM ({POINTS})"""


@query("prj3_plane_projection", f"SELECT scan_id, pt_idx, {R6(dis='dis', u='u', v='v')} FROM ({PLANE_SQL})")
def prj3(spark, d):
    return op.plane_projection(points(spark, d), NORMAL, CENTER).select("scan_id", "pt_idx", *r6(dis=F.col("dis"), u=F.col("u"), v=F.col("v")))


@query("flt4_slab", f"SELECT scan_id, pt_idx, round(dis, 6) AS dis FROM ({PLANE_SQL}) WHERE dis BETWEEN 0.2 AND 1.0")
def flt4(spark, d):
    return op.plane_projection(points(spark, d), NORMAL, CENTER).filter(F.col("dis").between(0.2, 1.0)).select("scan_id", "pt_idx", *r6(dis=F.col("dis")))


@query("prj4_quaternion_to_matrix", f"""
WITH p AS ({POINTS}), q AS (SELECT scan_id, pt_idx, sqrt(1 + x*x + y*y + z*z) AS n, x, y, z FROM p), u AS (SELECT scan_id, pt_idx, 1 / n AS w, x / n AS x, y / n AS y, z / n AS z FROM q)
SELECT scan_id, pt_idx, {R6(m00='w*w + x*x - y*y - z*z', m01='2*(x*y - w*z)', m12='2*(y*z - w*x)', m22='w*w - x*x - y*y + z*z')} FROM u
""")  # fmt: skip
def prj4(spark, d):
    n = F.sqrt(1 + g.dot(g.vec(*P_XYZ), g.vec(*P_XYZ)))
    m = g.quat_to_mat([1 / n, *(F.col(c) / n for c in P_XYZ)])
    return points(spark, d).select("scan_id", "pt_idx", *r6(m00=m[0], m01=m[1], m12=m[5], m22=m[8]))


@query("prj5_matrix_to_euler", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(roll='x * 0.5', pitch='y * 0.3', yaw='z * 0.5')} FROM p WHERE abs(y * 0.3) < 1.5")
def prj5(spark, d):
    m = g.euler_to_mat(F.col("x") * 0.5, F.col("y") * 0.3, F.col("z") * 0.5)
    e = g.mat_to_euler(m)
    return points(spark, d).filter(F.abs(F.col("y") * 0.3) < 1.5).select("scan_id", "pt_idx", *r6(roll=e[0], pitch=e[1], yaw=e[2]))


_N = "sqrt(x*x + y*y + z*z)"


@query("prj6_so3_exp", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(m00=f'cos({_N}) + (1 - cos({_N})) * x*x / ({_N}*{_N})', m01=f'-sin({_N}) * z / {_N} + (1 - cos({_N})) * x*y / ({_N}*{_N})', m21=f'sin({_N}) * x / {_N} + (1 - cos({_N})) * y*z / ({_N}*{_N})')} FROM p")
def prj6(spark, d):
    m = g.so3_exp(g.vec(*P_XYZ))
    return points(spark, d).select("scan_id", "pt_idx", *r6(m00=m[0], m01=m[1], m21=m[7]))


@query("prj7_so3_log", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(**dict(zip(P_XYZ, P_XYZ, strict=True)))} FROM p WHERE {_N} BETWEEN 0.01 AND 3.0")
def prj7(spark, d):
    v = g.so3_log(g.so3_exp(g.vec(*P_XYZ)))
    return points(spark, d).filter(g.norm(g.vec(*P_XYZ)).between(0.01, 3.0)).select("scan_id", "pt_idx", *xyz(v))


@query("prj8_skew", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(x='y*nz - z*ny', y='z*nx - x*nz', z='x*ny - y*nx')} FROM p")
def prj8(spark, d):
    return points(spark, d).select("scan_id", "pt_idx", *xyz(g.mat_vec(g.skew(g.vec(*P_XYZ)), g.vec("nx", "ny", "nz"))))


@query("prj9_pose_round_trip", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(x='x', y='y', z='z')} FROM p")
def prj9(spark, d):
    m = g.euler_to_mat(F.col("nx"), F.col("ny"), F.col("nz"))
    t = g.vec("nz", "nx", "ny")
    back, bt = g.inverse(m, t)
    return points(spark, d).select("scan_id", "pt_idx", *xyz(g.transform(back, bt, g.transform(m, t, g.vec(*P_XYZ)))))


@query("prj10_euler_to_quaternion", f"""
WITH p AS ({POINTS})
SELECT scan_id, pt_idx, {R6(w='cos(x/2)*cos(y/2)*cos(z/2) + sin(x/2)*sin(y/2)*sin(z/2)', qx='sin(x/2)*cos(y/2)*cos(z/2) - cos(x/2)*sin(y/2)*sin(z/2)', qy='cos(x/2)*sin(y/2)*cos(z/2) + sin(x/2)*cos(y/2)*sin(z/2)', qz='cos(x/2)*cos(y/2)*sin(z/2) - sin(x/2)*sin(y/2)*cos(z/2)')} FROM p
""")  # fmt: skip
def prj10(spark, d):
    q = g.euler_to_quat(*g.vec(*P_XYZ))
    return points(spark, d).select("scan_id", "pt_idx", *r6(w=q[0], qx=q[1], qy=q[2], qz=q[3]))


@query("prj11_squared_distance", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, round((x-nx)*(x-nx) + (y-ny)*(y-ny) + (z-nz)*(z-nz), 6) AS d2 FROM p")
def prj11(spark, d):
    return points(spark, d).select("scan_id", "pt_idx", *r6(d2=g.sq_dist(g.vec(*P_XYZ), g.vec("nx", "ny", "nz"))))


@query("prj12_voxel_key", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {sg.voxel('x', 0.5)} AS vx, {sg.voxel('y', 0.5)} AS vy, {sg.voxel('z', 0.5)} AS vz FROM p")
def prj12(spark, d):
    return points(spark, d).select("scan_id", "pt_idx", *(g.voxel(F.col(c), 0.5).alias(f"v{c}") for c in P_XYZ))


@query("prj12_voxel_key_boundaries", f"WITH c AS ({CLOUD}) SELECT DISTINCT x, {sg.voxel('(x - 25)', 2.5)} AS vx FROM c")
def prj12b(spark, d):
    return cloud(spark, d).select("x", g.voxel(F.col("x") - 25, 2.5).alias("vx")).distinct()


def _gap(c: str, lo: float, hi: float) -> str:
    return f"greatest({lo!r} - {c}, {c} - {hi!r}, 0.0)"


@query("prj13_box_distance", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, round({' + '.join(f'{_gap(c, lo, hi)} * {_gap(c, lo, hi)}' for c, lo, hi in zip('xyz', (-0.5, -0.2, 0.1), (0.5, 0.6, 0.7), strict=True))}, 6) AS d2 FROM p")
def prj13(spark, d):
    return points(spark, d).select("scan_id", "pt_idx", *r6(d2=g.box_sq_dist(g.vec(*P_XYZ), g.lit3((-0.5, -0.2, 0.1)), g.lit3((0.5, 0.6, 0.7)))))


@query("prj14_triangle_sides", f"WITH p AS ({POINTS}), s AS (SELECT scan_id, pt_idx, list_sort([abs(x), abs(y), abs(z)]) AS l FROM p) SELECT scan_id, pt_idx, {R6(a='l[1]', b='l[2]', c='l[3]')} FROM s")
def prj14(spark, d):
    s = g.sorted_sides(F.abs("x"), F.abs("y"), F.abs("z"))
    return points(spark, d).select("scan_id", "pt_idx", *r6(a=s[0]["len"], b=s[1]["len"], c=s[2]["len"]))


@query("prj15_extrinsic", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(**dict(zip(P_XYZ, sg.rotate(ROT, P_XYZ, SHIFT), strict=True)))} FROM p")
def prj15(spark, d):
    m = g.sensor_mat(*(math.degrees(v) for v in (R, P, Y)))
    return points(spark, d).select("scan_id", "pt_idx", *xyz(g.transform(m, g.lit3(SHIFT), g.vec(*P_XYZ))))


@query("prj17_stamp_to_ns", f"WITH p AS ({POINTS}) SELECT pt_idx, CASE WHEN pt_idx % 3 = 0 THEN pt_idx * 1000000000 + 250 * 1000 WHEN pt_idx % 3 = 1 THEN pt_idx * 1000 ELSE pt_idx END AS ns FROM p")
def prj17(spark, d):
    i = F.col("pt_idx")
    # Kinds of stamp: seconds and microseconds (0), microseconds (1), nanoseconds.
    return points(spark, d).select("pt_idx", F.when(i % 3 == 0, i * 1_000_000_000 + 250 * 1000).when(i % 3 == 1, i * 1000).otherwise(i).alias("ns"))


@query("prj19_session_ids", f"WITH p AS ({POINTS}), s AS (SELECT pt_idx - 100 AS id FROM p) SELECT id, CASE WHEN id < 0 THEN -id - 1 ELSE id END AS frame, CASE WHEN id < 0 THEN 50000 - id ELSE id END AS node, id < 0 AS prior FROM s")
def prj19(spark, d):
    i = F.col("id")
    return points(spark, d).select((F.col("pt_idx") - 100).alias("id")).select("id", F.when(i < 0, -i - 1).otherwise(i).alias("frame"), F.when(i < 0, 50000 - i).otherwise(i).alias("node"), (i < 0).alias("prior"))


@query("prj20_quaternion_to_degrees", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, {R6(roll='x * 0.5 * 57.3', pitch='y * 0.3 * 57.3', yaw='z * 0.5 * 57.3')} FROM p WHERE abs(y * 0.3) < 1.5")
def prj20(spark, d):
    e = g.quat_to_euler_deg(g.euler_to_quat(F.col("x") * 0.5, F.col("y") * 0.3, F.col("z") * 0.5))
    return points(spark, d).filter(F.abs(F.col("y") * 0.3) < 1.5).select("scan_id", "pt_idx", *r6(roll=e[0], pitch=e[1], yaw=e[2]))


@query("prj21_top_view", f"WITH p AS ({POINTS}) SELECT {sg.leaf('x', 0.5)} AS px, {sg.leaf('y', 0.5)} AS py, CAST(max(CASE WHEN scan_id = 0 THEN 1 ELSE 0 END) + 2 * max(CASE WHEN scan_id <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS shade FROM p GROUP BY 1, 2")
def prj21(spark, d):
    # One bit for each of two clouds.
    one = F.max((F.col("scan_id") == 0).cast("int"))
    two = F.max((F.col("scan_id") != 0).cast("int"))
    return points(spark, d).groupBy(g.leaf(F.col("x"), 0.5).alias("px"), g.leaf(F.col("y"), 0.5).alias("py")).agg((one + 2 * two).cast("int").alias("shade"))


@query("flt1_wild_scans", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx FROM p WHERE scan_id NOT IN (SELECT scan_id FROM p WHERE abs(x) > 3.6 OR abs(y) > 3.6 OR abs(z) > 3.6)")
def flt1(spark, d):
    return op.drop_wild_scans(points(spark, d), 3.6).select("scan_id", "pt_idx")


@query("flt5_triangle_bounds", f"WITH p AS ({POINTS}), s AS (SELECT scan_id, pt_idx, list_sort([abs(x), abs(y), abs(z)]) AS l FROM p) SELECT scan_id, pt_idx FROM s WHERE l[1] >= 0.1 AND l[3] <= 2.0 AND abs(l[3] - (l[1] + l[2])) >= 0.2")
def flt5(spark, d):
    s = g.sorted_sides(F.abs("x"), F.abs("y"), F.abs("z"))
    a, b, c = (s[k]["len"] for k in range(3))
    return points(spark, d).filter((a >= 0.1) & (c <= 2.0) & (F.abs(c - (a + b)) >= 0.2)).select("scan_id", "pt_idx")


@query("flt7_nan", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx FROM p WHERE pt_idx % 7 <> 0")
def flt7(spark, d):
    broken = F.when(F.col("pt_idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x"))
    return points(spark, d).withColumn("x", broken).filter(~F.isnan("x")).select("scan_id", "pt_idx")


@query("flt8_surface_accept", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx, round(1 - 0.9 * abs(intensity) / sqrt({_N}), 6) AS s FROM p WHERE 1 - 0.9 * abs(intensity) / sqrt({_N}) > 0.5")
def flt8(spark, d):
    s = 1 - 0.9 * F.abs("intensity") / F.sqrt(g.norm(g.vec(*P_XYZ)))
    return points(spark, d).withColumn("s", s).filter("s > 0.5").select("scan_id", "pt_idx", *r6(s=F.col("s")))


@query("flt10_view_cone", f"WITH p AS ({POINTS}), a AS (SELECT *, (0.6 * (x + 2) + 0.8 * y) AS along FROM p) SELECT scan_id, pt_idx FROM a WHERE along > 0 AND along <= 3.0 AND along >= sqrt((x+2)*(x+2) + y*y + z*z) * cos(0.7)")
def flt10(spark, d):
    return points(spark, d).filter(op.in_cone(g.vec(*P_XYZ), (-2.0, 0.0, 0.0), (3.0, 4.0, 0.0), 0.7, 3.0)).select("scan_id", "pt_idx")


_CAND = "unnest([0.0, 1.0, (-b + sqrt(greatest(b*b - a*c, 0))) / nullif(a, 0), (-b - sqrt(greatest(b*b - a*c, 0))) / nullif(a, 0), (3.0 - dn) / nullif(ln, 0)])"


@query("flt10_segment_in_view", f"""
WITH p AS (SELECT scan_id, pt_idx, x + 2 AS dx, y AS dy, z AS dz, nx - x AS lx, ny - y AS ly, nz - z AS lz FROM ({POINTS})),
 k AS (SELECT *, 0.6*dx + 0.8*dy AS dn, 0.6*lx + 0.8*ly AS ln, cos(0.3)**2 AS c2 FROM p),
 e AS (SELECT *, ln*ln - c2*(lx*lx + ly*ly + lz*lz) AS a, dn*ln - c2*(dx*lx + dy*ly + dz*lz) AS b, dn*dn - c2*(dx*dx + dy*dy + dz*dz) AS c FROM k),
 s AS (SELECT scan_id, pt_idx, dx, dy, dz, lx, ly, lz, {_CAND} AS s FROM e), q AS (SELECT scan_id, pt_idx, s, dx + s*lx AS u, dy + s*ly AS v, dz + s*lz AS w FROM s)
SELECT scan_id, pt_idx, bool_or(coalesce(s >= 0 AND s <= 1 AND 0.6*u + 0.8*v > 0 AND 0.6*u + 0.8*v <= 3.0 + 1e-9 AND 0.6*u + 0.8*v >= sqrt(u*u + v*v + w*w) * cos(0.3) - 1e-9, FALSE)) AS in_view FROM q GROUP BY 1, 2
""")  # fmt: skip
def flt10b(spark, d):
    ends = points(spark, d).select("scan_id", "pt_idx", *(F.col(c).alias(c + "1") for c in "xyz"), *(F.col("n" + c).alias(c + "2") for c in "xyz"))
    return op.segment_in_cone(ends, (-2.0, 0.0, 0.0), (3.0, 4.0, 0.0), 0.3, 3.0).select("scan_id", "pt_idx", "in_view")


@query("flt11_cells_in_view", f"""
WITH t AS (SELECT session, id, x + 0.123 AS x, y + 0.217 AS y, z + 0.031 AS z FROM ({TRAJECTORY})), r AS (SELECT unnest(range(-4, 5)) AS v),
 c AS (SELECT t.*, CAST(floor(x / 0.5) AS BIGINT) + a.v AS cx, CAST(floor(y / 0.5) AS BIGINT) + b.v AS cy, CAST(floor(z / 0.5) AS BIGINT) + e.v AS cz FROM t, r a, r b, r e),
 q AS (SELECT *, (cx + 0.5) * 0.5 - x AS u, (cy + 0.5) * 0.5 - y AS v, (cz + 0.5) * 0.5 - z AS w FROM c)
SELECT session, id, cx, cy, cz FROM q WHERE 0.6*u + 0.8*v > 0 AND 0.6*u + 0.8*v <= 1.5 AND 0.6*u + 0.8*v >= sqrt(u*u + v*v + w*w) * cos(0.5)
""")  # fmt: skip
def flt11(spark, d):
    # Views from every pose, off the cells' borders.
    views = trajectory(spark, d).select("session", "id", *((F.col(c) + o).alias(c) for c, o in (("x", 0.123), ("y", 0.217), ("z", 0.031))))
    return op.cells_in_view(views, (3.0, 4.0, 0.0), 0.5, 1.5, 0.5).select("session", "id", "cx", "cy", "cz")


@query("flt14_ring_features")
def flt14(spark, d):
    return op.classify(raw(points(spark, d)).withColumnRenamed("line", "ring"))


@query("flt16_point_budget", f"WITH c AS ({POINTS}), n AS (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n, row_number() OVER (PARTITION BY scan_id ORDER BY pt_idx) - 1 AS i FROM c) SELECT scan_id, pt_idx FROM n WHERE i % CAST(ceil(n / 20.0) AS BIGINT) = 0")
def flt16(spark, d):
    return op.thin_to(points(spark, d), 20).select("scan_id", "pt_idx")
