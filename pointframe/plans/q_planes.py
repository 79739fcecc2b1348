"""Queries of voxel statistics, planes, keypoints, descriptors and their matching."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.operators import loops, tables
from pointframe.operators import planes as op
from pointframe.operators import points as pt
from pointframe.plans import sqlgeom as sg
from pointframe.plans.q_points import R6, ROT, SHIFT, r6, rot
from pointframe.plans.registry import query
from pointframe.sources.adapters import CLOUD, POINTS, cloud, points

_V5 = ", ".join(f"{sg.voxel(c, 0.5)} AS v{c}" for c in "xyz")
_MOVED = dict(zip("xyz", sg.rotate(ROT, ("x", "y", "z"), SHIFT), strict=True))
_MOVED_CLOUD = f"SELECT scan_id, pt_idx, {', '.join(f'{v} AS {c}' for c, v in _MOVED.items())} FROM ({CLOUD})"


def moved(df):
    at = g.transform(rot(), g.lit3(SHIFT), g.vec("x", "y", "z"))
    return df.withColumns({f"_{c}": v for c, v in zip("xyz", at, strict=True)}).drop("x", "y", "z").withColumnsRenamed({f"_{c}": c for c in "xyz"})


@query("agg11_occupied_voxels", f"WITH m AS ({_MOVED_CLOUD}) SELECT {', '.join(f'{sg.voxel(c, 1.7)} AS v{c}' for c in 'xyz')}, count(*) AS hits FROM m GROUP BY ALL")
def agg11(spark, d):
    return op.with_voxel(moved(cloud(spark, d)), 1.7).groupBy(*op.VOX).agg(F.count("*").alias("hits"))


@query("agg11_map_consistency", f"WITH m AS ({_MOVED_CLOUD}) SELECT count(*) AS voxels FROM (SELECT DISTINCT {', '.join(f'{sg.voxel(c, 1.7)} AS v{c}' for c in 'xyz')} FROM m)")
def agg11b(spark, d):
    return op.with_voxel(moved(cloud(spark, d)), 1.7).groupBy(*op.VOX).agg(F.count("*").alias("hits")).agg(F.count("*").alias("voxels"))


@query("agg1_voxel_centroids", f"WITH c AS ({CLOUD}) SELECT {', '.join(f'{sg.voxel(c, 3.0)} AS v{c}' for c in 'xyz')}, {R6(x='avg(x) / 0.997', y='avg(y) / 0.997', z='avg(z) / 0.997')}, count(*) AS n FROM c GROUP BY 1, 2, 3")
def agg1(spark, d):
    return op.voxel_centroids(cloud(spark, d), 3.0).select(*op.VOX, *r6(**{c: F.col(c) / 0.997 for c in "xyz"}), "n")  # a scale that no rounding tie falls on


@query("agg2_voxel_buckets", f"WITH p AS ({POINTS}) SELECT {_V5}, count(*) AS n, min(pt_idx) AS first_pt, max(pt_idx) AS last_pt FROM p GROUP BY 1, 2, 3")
def agg2(spark, d):
    return op.with_voxel(points(spark, d), 0.5).groupBy(*op.VOX).agg(F.count("*").alias("n"), F.min("pt_idx").alias("first_pt"), F.max("pt_idx").alias("last_pt"))


_COV = "count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz, covar_pop(y, y) AS cyy, covar_pop(y, z) AS cyz, covar_pop(z, z) AS czz"
_COVS = f"SELECT scan_id, {', '.join(f'{sg.voxel(c, 4.0)} AS v{c}' for c in 'xyz')}, {_COV} FROM ({CLOUD}) GROUP BY 1, 2, 3, 4"


def covs(spark, d):
    return op.covariance(op.with_voxel(cloud(spark, d), 4.0), ["scan_id", *op.VOX])


@query("agg3_covariance", f"SELECT scan_id, vx, vy, vz, n, {R6(cxx='cxx / 0.997', cxy='cxy / 0.997', cyz='cyz / 0.997', czz='czz / 0.997')} FROM ({_COVS})")
def agg3(spark, d):
    return covs(spark, d).select("scan_id", *op.VOX, "n", *r6(**{c: F.col(c) / 0.997 for c in ("cxx", "cxy", "cyz", "czz")}))  # a scale that no rounding tie falls on


@query("agg3_invariants", f"SELECT scan_id, vx, vy, vz, {R6(trace='cxx + cyy + czz', minors='cxx*cyy - cxy*cxy + cxx*czz - cxz*cxz + cyy*czz - cyz*cyz')} FROM ({_COVS}) WHERE n > 5")
def agg3b(spark, d):
    # The eigenvalues' sum and sum of products are the trace and the sum of principal minors.
    e = op.eigenvalues(covs(spark, d).filter("n > 5"))
    return e.select("scan_id", *op.VOX, *r6(trace=F.col("e1") + F.col("e2") + F.col("e3"), minors=F.col("e1") * F.col("e2") + F.col("e1") * F.col("e3") + F.col("e2") * F.col("e3")))


@query("agg4_planes")
def agg4(spark, d):
    return op.fit_planes(op.with_voxel(cloud(spark, d), 4.0), ["scan_id", *op.VOX], least=5, flat=0.2).filter("is_plane").select("scan_id", *op.VOX, "cx", "cy", "cz", "nx", "ny", "nz")


@query("agg5_merged_moments", f"WITH c AS ({CLOUD}) SELECT scan_id, count(*) AS n, {R6(mx='avg(x)', my='avg(y)', mz='avg(z)', vxx='var_pop(x)', vxy='covar_pop(x, y)')} FROM c GROUP BY 1")
def agg5(spark, d):
    fine = op.moments(op.with_voxel(cloud(spark, d), 4.0), ["scan_id", *op.VOX])
    m = op.merge_moments(fine, ["scan_id"])
    mean = {c: F.col(f"s{c}") / F.col("n") for c in "xyz"}
    return m.select("scan_id", "n", *r6(mx=mean["x"], my=mean["y"], mz=mean["z"], vxx=F.col("sxx") / F.col("n") - mean["x"] ** 2, vxy=F.col("sxy") / F.col("n") - mean["x"] * mean["y"]))


def _planes(spark, d):
    return op.fit_planes(op.with_voxel(cloud(spark, d), 8.0), ["scan_id", *op.VOX], least=5, flat=3.0).filter("is_plane")


@query("agg6_merge_coplanar")
def agg6(spark, d):
    return op.merge_coplanar(_planes(spark, d), ["scan_id"], singles=False)


@query("agg7_merge_coplanar_keep")
def agg7(spark, d):
    return op.merge_coplanar(_planes(spark, d), ["scan_id"], singles=True)


@query("top2_projection_planes")
def top2(spark, d):
    return op.project_planes(op.merge_coplanar(_planes(spark, d), ["scan_id"], singles=True), ["scan_id"], 3)


@query("agg12_distinct_voxels", f"WITH p AS ({POINTS}) SELECT DISTINCT scan_id, {_V5} FROM p")
def agg12(spark, d):
    return op.with_voxel(points(spark, d), 0.5).select("scan_id", *op.VOX).distinct()


@query("agg13_voxel_points", f"WITH p AS ({POINTS}), v AS (SELECT pt_idx, {_V5} FROM p) SELECT vx, vy, vz, string_agg(CAST(pt_idx AS VARCHAR), ',' ORDER BY pt_idx) AS members FROM v GROUP BY 1, 2, 3")
def agg13(spark, d):
    ids = F.transform(F.array_sort(F.collect_list("pt_idx")), lambda i: i.cast("string"))
    return op.with_voxel(points(spark, d), 0.5).groupBy(*op.VOX).agg(F.array_join(ids, ",").alias("members"))


@query("agg14_bounding_boxes", f"WITH p AS ({POINTS}) SELECT scan_id, {R6(lx='min(x)', hx='max(x)', ly='min(y)', hy='max(y)', lz='min(z)', hz='max(z)')} FROM p GROUP BY 1")
def agg14(spark, d):
    return points(spark, d).groupBy("scan_id").agg(*r6(**{f"{s}{c}": f(c) for c in "xyz" for s, f in (("l", F.min), ("h", F.max))}))


_BOX = f"SELECT scan_id, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in 'xyz')} FROM ({POINTS}) GROUP BY 1"


def _span_sql(c: str) -> str:
    return f"CASE WHEN a.h{c} < b.h{c} AND a.l{c} > b.l{c} THEN a.h{c} - a.l{c} ELSE least(abs(a.h{c} - b.l{c}), abs(a.l{c} - b.h{c})) END"


@query("agg15_box_overlap", f"""
WITH x AS ({_BOX}) SELECT a.scan_id AS scan_a, b.scan_id AS scan_b,
 round(CASE WHEN {' OR '.join(f'a.h{c} < b.l{c} OR a.l{c} > b.h{c}' for c in 'xyz')} THEN 0 ELSE ({_span_sql('x')}) * ({_span_sql('y')}) * ({_span_sql('z')}) / ((a.hx - a.lx) * (a.hy - a.ly) * (a.hz - a.lz)) END, 6) AS ratio
FROM x a JOIN x b ON b.scan_id = a.scan_id + 1
""")  # fmt: skip
def agg15(spark, d):
    box = points(spark, d).groupBy("scan_id").agg(*(f(c).alias(f"{s}{c}") for c in "xyz" for s, f in (("l", F.min), ("h", F.max))))
    a, b = box.select(*(F.col(c).alias(f"a_{c}") for c in box.columns)), box.select(*(F.col(c).alias(f"b_{c}") for c in box.columns))
    j = a.join(b, F.col("b_scan_id") == F.col("a_scan_id") + 1)
    inside = lambda c: (F.col(f"a_h{c}") < F.col(f"b_h{c}")) & (F.col(f"a_l{c}") > F.col(f"b_l{c}"))
    span = lambda c: F.when(inside(c), F.col(f"a_h{c}") - F.col(f"a_l{c}")).otherwise(F.least(F.abs(F.col(f"a_h{c}") - F.col(f"b_l{c}")), F.abs(F.col(f"a_l{c}") - F.col(f"b_h{c}"))))
    apart, area, own = F.lit(False), F.lit(1.0), F.lit(1.0)
    for c in "xyz":
        apart = apart | (F.col(f"a_h{c}") < F.col(f"b_l{c}")) | (F.col(f"a_l{c}") > F.col(f"b_h{c}"))
        area, own = area * span(c), own * (F.col(f"a_h{c}") - F.col(f"a_l{c}"))
    return j.select(F.col("a_scan_id").alias("scan_a"), F.col("b_scan_id").alias("scan_b"), *r6(ratio=F.when(apart, F.lit(0.0)).otherwise(area / own)))


@query("agg16_centroid", f"WITH p AS ({POINTS}) SELECT scan_id, {R6(x='avg(x)', y='avg(y)', z='avg(z)')} FROM p GROUP BY 1")
def agg16(spark, d):
    return points(spark, d).groupBy("scan_id").agg(*r6(x=F.avg("x"), y=F.avg("y"), z=F.avg("z")))


@query("agg24_plane_residuals", f"""
WITH p AS ({POINTS}), e AS (SELECT a.scan_id AS source, b.scan_id AS target, abs(b.nx*(a.x-b.x) + b.ny*(a.y-b.y) + b.nz*(a.z-b.z)) AS dis,
 least(sqrt((a.nx+b.nx)**2 + (a.ny+b.ny)**2 + (a.nz+b.nz)**2), sqrt((a.nx-b.nx)**2 + (a.ny-b.ny)**2 + (a.nz-b.nz)**2)) AS turn FROM p a JOIN p b ON b.pt_idx = a.pt_idx + 1)
SELECT {R6(near_distance='avg(dis) FILTER (WHERE source - target = 1)', near_normal='avg(turn) FILTER (WHERE source - target = 1)', loop_distance='avg(dis) FILTER (WHERE source - target <> 1)', loop_normal='avg(turn) FILTER (WHERE source - target <> 1)')} FROM e
""")  # fmt: skip
def agg24(spark, d):
    p = points(spark, d)
    side = lambda s, k, at: p.select((F.col("pt_idx") - at).alias("k"), F.col("scan_id").alias(k), *(F.col(c).alias(f"{s}_c{c}") for c in "xyz"), *(F.col(f"n{c}").alias(f"{s}_n{c}") for c in "xyz"))
    out = loops.plane_pair_residuals(side("s", "source", 0).join(side("t", "target", 1), "k"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("agg25_leaf_centroids", f"WITH p AS ({POINTS}) SELECT {', '.join(f'{sg.leaf(c, 0.7)} AS l{c}' for c in 'xyz')}, {R6(x='avg(x)', y='avg(y)', z='avg(z)', intensity='avg(intensity)')} FROM p GROUP BY 1, 2, 3")
def agg25(spark, d):
    return points(spark, d).groupBy(*(g.leaf(F.col(c), 0.7).alias(f"l{c}") for c in "xyz")).agg(*r6(x=F.avg("x"), y=F.avg("y"), z=F.avg("z"), intensity=F.avg("intensity")))


@query("agg27_memory", f"WITH p AS ({POINTS}) SELECT scan_id, count(*) * 16 AS bytes, CAST(sum(CASE WHEN intensity > 0 THEN 1 ELSE 0 END) AS BIGINT) AS bright FROM p GROUP BY 1")
def agg27(spark, d):
    return points(spark, d).groupBy("scan_id").agg((F.count("*") * 16).alias("bytes"), F.sum((F.col("intensity") > 0).cast("int")).cast("long").alias("bright"))


# Height slices, block maxima, ridges: one image for each scan.
_UP = (0.0, 0.0, 1.0)
_XU, _YU = g.plane_axes(_UP)
_PIX = f"""WITH s AS (SELECT *, z AS dis, {_YU[0]!r} * x + {_YU[1]!r} * y AS u, {_XU[0]!r} * x + {_XU[1]!r} * y AS v FROM ({CLOUD})), k AS (SELECT scan_id, least(min(u), 10.0) AS u0, least(min(v), 10.0) AS v0 FROM s GROUP BY 1),
 x AS (SELECT s.*, CAST(trunc((u - u0) / 1.0) AS INTEGER) AS px, CAST(trunc((v - v0) / 1.0) AS INTEGER) AS py, CAST(trunc(dis + 0.25) AS INTEGER) AS sl FROM s JOIN k USING (scan_id)),
 pix AS (SELECT scan_id, px, py, CAST(count(DISTINCT CASE WHEN sl < 10 THEN sl END) AS INTEGER) AS summary, min(CASE WHEN sl < 10 THEN sl END) AS lowest, avg(u) AS mu, avg(v) AS mv FROM x GROUP BY 1, 2, 3),
 best AS (SELECT *, row_number() OVER (PARTITION BY scan_id, px // 5, py // 5 ORDER BY summary DESC, px, py) AS r FROM pix)"""


def _pixels(spark, d):
    return op.height_slices(pt.plane_projection(cloud(spark, d), _UP, (0.0, 0.0, 0.0)), ["scan_id"], 1.0, -0.25, 10.5, 1.0)


@query("agg8_height_slices", f"{_PIX} SELECT scan_id, px, py, summary, {R6(mu='mu', mv='mv')} FROM pix")
def agg8(spark, d):
    return _pixels(spark, d).select("scan_id", "px", "py", "summary", *r6(mu=F.col("mu"), mv=F.col("mv")))


@query("agg9_block_maxima", f"{_PIX} SELECT scan_id, px, py, summary FROM best WHERE r = 1")
def agg9(spark, d):
    return op.block_maxima(_pixels(spark, d), ["scan_id"]).select("scan_id", "px", "py", "summary")


_RIDGE = f"""{_PIX}, o AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) AS o(dx, dy)),
 m AS (SELECT scan_id, px, py, summary, lowest FROM best WHERE r = 1),
 n AS (SELECT m.*, dx, dy, coalesce((SELECT max(summary) FROM pix p WHERE p.scan_id = m.scan_id AND p.px = m.px + dx AND p.py = m.py + dy), 0) AS s1,
   coalesce((SELECT max(summary) FROM pix p WHERE p.scan_id = m.scan_id AND p.px = m.px - dx AND p.py = m.py - dy), 0) AS s2 FROM m, o),
 ok AS (SELECT scan_id, px, py, summary, any_value(lowest) AS lowest FROM n GROUP BY 1, 2, 3, 4
   HAVING NOT bool_or((s1 >= summary - 3 AND s2 >= 0.5 * summary) OR (s2 >= summary - 3 AND s1 >= 0.5 * summary) OR (s1 >= summary - 3 AND s2 >= summary - 3)))"""


@query("flt12_ridge_filter", f"{_RIDGE} SELECT scan_id, px, py, summary FROM ok")
def flt12(spark, d):
    p = _pixels(spark, d)
    return op.off_ridge(op.block_maxima(p, ["scan_id"]), p, ["scan_id"]).select("scan_id", "px", "py", "summary")


@query("flt13_touch_filter", f"{_PIX} SELECT scan_id, px, py, summary FROM pix WHERE lowest < 4")
def flt13(spark, d):
    return _pixels(spark, d).filter(op.touches_ground(F.col("slices"))).select("scan_id", "px", "py", "summary")


@query("dsc1_keypoints", f"{_RIDGE} SELECT scan_id, px, py, summary FROM ok WHERE summary >= 1 AND lowest < 4")
def dsc1(spark, d):
    p = _pixels(spark, d)
    kept = op.block_maxima(p, ["scan_id"]).filter((F.col("summary") >= 1) & op.touches_ground(F.col("slices")))
    return op.off_ridge(kept, p, ["scan_id"]).select("scan_id", "px", "py", "summary")


@query("flt17_line_like", f"WITH m AS (SELECT scan_id, avg(x*x) AS a, avg(x*y) AS b, avg(y*y) AS c FROM ({POINTS}) GROUP BY 1), e AS (SELECT scan_id, (a + c) / 2 AS h, sqrt(((a - c) / 2) ** 2 + b ** 2) AS r FROM m) SELECT scan_id, {R6(small='h - r', large='h + r')}, h - r <= 1.4 AND h + r >= 0.5 AS is_line FROM e")
def flt17(spark, d):
    return op.line_like(points(spark, d), ["scan_id"], "x", "y", 1.4).select("scan_id", *r6(small=F.col("small"), large=F.col("large")), "is_line")


# Keypoints: points whose slices are the bits of their number.
_KP = f"SELECT scan_id AS frame_id, pt_idx AS kp_id, x, y, z, list_filter(range(8), lambda k: (pt_idx >> k) & 1 = 1) AS slices, CAST(bit_count(pt_idx & 255) AS INTEGER) AS summary FROM ({POINTS})"


def keypoints(spark, d):
    bits = F.filter(F.array(*(F.lit(k) for k in range(8))), lambda k: F.expr("pt_idx").bitwiseAND(F.lit(255)).cast("int").bitwiseAND(F.pow(F.lit(2), k).cast("int")) > 0)
    return points(spark, d).select(F.col("scan_id").alias("frame_id"), F.col("pt_idx").alias("kp_id"), "x", "y", "z", bits.alias("slices")).withColumn("summary", F.size("slices"))


@query("join14_non_max_suppression", f"WITH k AS ({_KP}) SELECT frame_id, kp_id, summary FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.frame_id = a.frame_id AND b.kp_id <> a.kp_id AND b.summary >= a.summary AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.64)")
def join14(spark, d):
    return op.non_max_suppression(keypoints(spark, d), ["kp_id"], 0.8, ["frame_id"]).select("frame_id", "kp_id", "summary")


@query("top1_strongest_keypoints", f"WITH k AS ({_KP}), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY summary DESC, kp_id) AS r FROM k) SELECT frame_id, kp_id, summary FROM r WHERE r <= 10")
def top1(spark, d):
    return tables.top_per(keypoints(spark, d), ["frame_id"], [F.desc("summary"), "kp_id"], 10).select("frame_id", "kp_id", "summary")


@query("dsc2_keypoint_selection", f"""
WITH k AS ({_KP}), s AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.frame_id = a.frame_id AND b.kp_id <> a.kp_id AND b.summary >= a.summary AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.25)),
 r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY summary DESC, kp_id) AS r FROM s)
SELECT frame_id, kp_id, summary FROM r WHERE r <= 8
""")  # fmt: skip
def dsc2(spark, d):
    s = op.non_max_suppression(keypoints(spark, d), ["kp_id"], 0.5, ["frame_id"])
    return tables.top_per(s, ["frame_id"], [F.desc("summary"), "kp_id"], 8).select("frame_id", "kp_id", "summary")


@query("dsc5_dice", f"WITH k AS ({_KP}) SELECT a.kp_id, b.kp_id AS other, round(CASE WHEN a.summary + b.summary = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a.slices, b.slices)) / (a.summary + b.summary) END, 6) AS similarity FROM k a JOIN k b ON b.kp_id = a.kp_id + 7")
def dsc5(spark, d):
    k = keypoints(spark, d)
    b = k.select((F.col("kp_id") - 7).alias("kp_id"), F.col("kp_id").alias("other"), F.col("slices").alias("s2"))
    return k.join(b, "kp_id").select("kp_id", "other", *r6(similarity=op.dice(F.col("slices"), F.col("s2"))))


_NN = f"""k AS ({_KP}), nn AS (SELECT a.frame_id, a.kp_id AS p1, b.kp_id AS p, row_number() OVER (PARTITION BY a.frame_id, a.kp_id ORDER BY (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, b.kp_id) AS r FROM k a JOIN k b ON a.frame_id = b.frame_id AND a.kp_id <> b.kp_id)"""
_D = "sqrt(({0}.x-{1}.x)**2 + ({0}.y-{1}.y)**2 + ({0}.z-{1}.z)**2)".format
_TRI = f"""{_NN}, pr AS (SELECT m.frame_id, m.p1, m.r AS m, n.r AS n, m.p AS p2, n.p AS p3 FROM nn m JOIN nn n ON m.frame_id = n.frame_id AND m.p1 = n.p1 AND m.r < n.r WHERE m.r <= 5 AND n.r <= 5),
 sd AS (SELECT pr.*, list_sort([{{'l': {_D('a', 'b')}, 'u': 1, 'v': 2}}, {{'l': {_D('a', 'c')}, 'u': 1, 'v': 3}}, {{'l': {_D('b', 'c')}, 'u': 2, 'v': 3}}]) AS s FROM pr JOIN k a ON a.frame_id = pr.frame_id AND a.kp_id = p1 JOIN k b ON b.frame_id = pr.frame_id AND b.kp_id = p2 JOIN k c ON c.frame_id = pr.frame_id AND c.kp_id = p3),
 fl AS (SELECT *, s[1].l AS a, s[2].l AS b, s[3].l AS c FROM sd WHERE s[1].l >= 0.2 AND s[3].l <= 4 AND abs(s[3].l - (s[1].l + s[2].l)) >= 0.2),
 uq AS (SELECT *, row_number() OVER (PARTITION BY frame_id, CAST(trunc(a*1000) AS BIGINT), CAST(trunc(b*1000) AS BIGINT), CAST(trunc(c*1000) AS BIGINT) ORDER BY p1, m, n) AS r FROM fl),
 vt AS (SELECT *, CASE WHEN s[1].u IN (s[2].u, s[2].v) THEN s[1].u ELSE s[1].v END AS va, CASE WHEN s[1].u IN (s[3].u, s[3].v) THEN s[1].u ELSE s[1].v END AS vb, CASE WHEN s[2].u IN (s[3].u, s[3].v) THEN s[2].u ELSE s[2].v END AS vc FROM uq WHERE r = 1),
 tri AS (SELECT frame_id, p1, m, n, a, b, c, [p1, p2, p3][va] AS ka, [p1, p2, p3][vb] AS kb, [p1, p2, p3][vc] AS kc FROM vt)"""


def _triangles(spark, d, scale=1.0):
    return op.triangles(keypoints(spark, d), 6, 0.2, 4.0, scale)


@query("dsc4_triangles", f"WITH {_TRI} SELECT frame_id, p1, m, n, {R6(a='a', b='b', c='c')}, ka, kb, kc FROM tri")
def dsc4(spark, d):
    return _triangles(spark, d).select("frame_id", "tri_id.p1", F.col("tri_id.m").cast("long").alias("m"), F.col("tri_id.n").cast("long").alias("n"), *r6(a=F.col("a"), b=F.col("b"), c=F.col("c")), F.col("va.kp_id").alias("ka"), F.col("vb.kp_id").alias("kb"), F.col("vc.kp_id").alias("kc"))


@query("top8_neighbour_pairs", f"WITH {_NN} SELECT m.frame_id, m.p1, count(*) AS pairs FROM nn m JOIN nn n ON m.frame_id = n.frame_id AND m.p1 = n.p1 AND m.r < n.r WHERE m.r <= 5 AND n.r <= 5 GROUP BY 1, 2")
def top8(spark, d):
    from pointframe.operators.spatial import knn_join

    k = keypoints(spark, d)
    nn = knn_join(k, k, 5, 1.0, ["kp_id"], ["kp_id"], ["frame_id"], skip_self=True)
    n = F.count("*")
    return nn.groupBy(F.col("q_frame_id").alias("frame_id"), F.col("q_kp_id").alias("p1")).agg((n * (n - 1) / 2).cast("long").alias("pairs")).filter("pairs > 0")


@query("set1_distinct_triangles", f"WITH {_TRI} SELECT frame_id, count(*) AS triangles, count(DISTINCT (CAST(trunc(a*1000) AS BIGINT), CAST(trunc(b*1000) AS BIGINT), CAST(trunc(c*1000) AS BIGINT))) AS keys FROM tri GROUP BY 1")
def set1(spark, d):
    t = _triangles(spark, d)
    mm = F.struct(*((F.col(c) * 1000).cast("long").alias(c) for c in "abc"))
    return t.groupBy("frame_id").agg(F.count("*").alias("triangles"), F.count_distinct(mm).alias("keys"))


_GAPS = " + ".join(f"(q.{c} * 5 - (t.k{c} + 0.5)) ** 2" for c in "abc")
_SIM = " + ".join(f"(CASE WHEN len(q{c}.slices) + len(t{c}.slices) = 0 THEN 0 ELSE 2.0 * len(list_intersect(q{c}.slices, t{c}.slices)) / (len(q{c}.slices) + len(t{c}.slices)) END)" for c in "abc")
_MATCH = f"""{_TRI}, cell AS (SELECT *, CAST(trunc(a * 5) AS BIGINT) AS xa, CAST(trunc(b * 5) AS BIGINT) AS xb, CAST(trunc(c * 5) AS BIGINT) AS xc FROM tri),
 t AS (SELECT frame_id, p1, m, n, a, b, c, ka AS ta, kb AS tb, kc AS tc, xa AS ka, xb AS kb, xc AS kc FROM cell),
 mt AS (SELECT q.frame_id AS q_frame, t.frame_id AS t_frame, q.p1 AS q_p1, q.m AS q_m, q.n AS q_n, t.p1 AS t_p1, t.m AS t_m, t.n AS t_n,
   5 * sqrt((q.a-t.a)**2 + (q.b-t.b)**2 + (q.c-t.c)**2) AS side_dist, ({_SIM}) / 3 AS similarity
  FROM cell q JOIN t ON abs(q.xa - t.ka) <= 1 AND abs(q.xb - t.kb) <= 1 AND abs(q.xc - t.kc) <= 1 AND q.frame_id - t.frame_id > 2
  JOIN k qa ON qa.frame_id = q.frame_id AND qa.kp_id = q.ka JOIN k qb ON qb.frame_id = q.frame_id AND qb.kp_id = q.kb JOIN k qc ON qc.frame_id = q.frame_id AND qc.kp_id = q.kc
  JOIN k ta ON ta.frame_id = t.frame_id AND ta.kp_id = t.ta JOIN k tb ON tb.frame_id = t.frame_id AND tb.kp_id = t.tb JOIN k tc ON tc.frame_id = t.frame_id AND tc.kp_id = t.tc
  WHERE {_GAPS} < 2.25 AND 5 * sqrt((q.a-t.a)**2 + (q.b-t.b)**2 + (q.c-t.c)**2) < 5 * sqrt(q.a**2 + q.b**2 + q.c**2) * 0.08 AND ({_SIM}) / 3 > 0.4)"""


def _matches(spark, d):
    t = _triangles(spark, d, 5.0)
    return op.match_triangles(t, t, 2, 0.08, 0.4)


@query("join1_descriptor_matches", f"WITH {_MATCH} SELECT q_frame, t_frame, q_p1, q_m, q_n, t_p1, t_m, t_n, {R6(side_dist='side_dist', similarity='similarity')} FROM mt")
def join1(spark, d):
    m = _matches(spark, d)
    part = lambda s: [F.col(f"{s}_tri.{k}").cast("long").alias(f"{s}_{k}") for k in ("p1", "m", "n")]
    return m.select("q_frame", "t_frame", *part("q"), *part("t"), *r6(side_dist=F.col("side_dist"), similarity=F.col("similarity")))


@query("join2_own_cell_matches", f"WITH {_MATCH.replace('abs(q.xa - t.ka) <= 1 AND abs(q.xb - t.kb) <= 1 AND abs(q.xc - t.kc) <= 1', 'q.xa = t.ka AND q.xb = t.kb AND q.xc = t.kc')} SELECT q_frame, t_frame, count(*) AS votes, round(sum(similarity), 5) AS weight FROM mt GROUP BY 1, 2")
def join2(spark, d):
    t = _triangles(spark, d, 5.0)
    return op.match_triangles(t, t, 2, 0.08, 0.4, around=False).groupBy("q_frame", "t_frame").agg(F.count("*").alias("votes"), F.round(F.sum("similarity"), 5).alias("weight"))


@query("agg10_votes", f"WITH {_MATCH} SELECT q_frame, t_frame, count(*) AS votes FROM mt GROUP BY 1, 2")
def agg10(spark, d):
    return op.votes(_matches(spark, d))


@query("top3_candidates", f"WITH {_MATCH}, v AS (SELECT q_frame, t_frame, count(*) AS votes FROM mt GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q_frame ORDER BY votes DESC, t_frame) AS rank FROM v WHERE votes > 1) SELECT q_frame, t_frame, votes, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def top3(spark, d):
    return op.candidates(op.votes(_matches(spark, d)), 3)


@query("agg18_mean_side_distance", f"WITH {_MATCH}, f AS (SELECT DISTINCT frame_id FROM k) SELECT frame_id, round(coalesce(avg(side_dist), -1), 6) AS mean FROM f LEFT JOIN mt ON q_frame = frame_id GROUP BY 1")
def agg18(spark, d):
    f = keypoints(spark, d).select("frame_id").distinct()
    return f.join(_matches(spark, d), F.col("q_frame") == F.col("frame_id"), "left").groupBy("frame_id").agg(F.round(F.coalesce(F.avg("side_dist"), F.lit(-1.0)), 6).alias("mean"))


@query("agg19_mean_similarity", f"WITH {_MATCH}, f AS (SELECT DISTINCT frame_id FROM k) SELECT frame_id, round(coalesce(avg(similarity), -1), 6) AS mean FROM f LEFT JOIN mt ON q_frame = frame_id GROUP BY 1")
def agg19(spark, d):
    f = keypoints(spark, d).select("frame_id").distinct()
    return f.join(_matches(spark, d), F.col("q_frame") == F.col("frame_id"), "left").groupBy("frame_id").agg(F.round(F.coalesce(F.avg("similarity"), F.lit(-1.0)), 6).alias("mean"))


@query("join13_voxel_overlap", f"""
WITH p AS ({POINTS}), s AS (SELECT {_V5} FROM p WHERE scan_id % 2 = 0), t AS (SELECT DISTINCT {_V5} FROM p WHERE scan_id % 2 = 1), j AS (SELECT s.* FROM s JOIN t USING (vx, vy, vz))
SELECT (SELECT count(*) FROM j) AS hits, (SELECT count(*) FROM (SELECT DISTINCT * FROM j)) AS voxels, (SELECT count(*) FROM s) AS points, round((SELECT count(*) FROM j) / CAST((SELECT count(*) FROM s) AS DOUBLE), 6) AS score
""")  # fmt: skip
def join13(spark, d):
    p = points(spark, d)
    return op.voxel_overlap(p.filter("scan_id % 2 = 0"), p.filter("scan_id % 2 = 1"), 0.5).select("hits", "voxels", "points", *r6(score=F.col("score")))


_SHIFTED = f"SELECT scan_id, vx, vy, vz FROM (SELECT scan_id, {sg.voxel('(x + 0.3)', 0.5)} AS vx, {sg.voxel('y', 0.5)} AS vy, {sg.voxel('z', 0.5)} AS vz FROM ({{}}))"


def _scan_pairs(clouds):
    turn, shift = F.array(*(F.lit(float(k % 4 == 0)) for k in range(9))), F.array(F.lit(0.3), F.lit(0.0), F.lit(0.0))
    return clouds.select(F.col("scan_id").alias("id")).distinct().select(F.col("id").alias("i"), ((F.col("id") + 1) % 10).alias("j"), turn.alias("rotation"), shift.alias("shift"))


def _overlap_sql(source: str, extra: str) -> str:
    return f"""WITH p AS ({source}), v AS (SELECT DISTINCT scan_id, {_V5} FROM p), s AS ({_SHIFTED.format('p')}), n AS (SELECT scan_id, count(*) AS n FROM p GROUP BY 1),
 h AS (SELECT s.scan_id, count(v.vx) AS h FROM s LEFT JOIN v ON v.scan_id = (s.scan_id + 1) % 10 AND v.vx = s.vx AND v.vy = s.vy AND v.vz = s.vz GROUP BY 1),
 o AS (SELECT h.scan_id AS i, (h.scan_id + 1) % 10 AS j, h / CAST(a.n AS DOUBLE) * least(a.n, b.n) / greatest(a.n, b.n) AS score FROM h JOIN n a ON a.scan_id = h.scan_id JOIN n b ON b.scan_id = (h.scan_id + 1) % 10)
SELECT i, j, {extra} FROM o"""


@query("fac8_overlap_score", _overlap_sql(POINTS, "round(score, 6) AS score, FALSE AS vetoed"))
def fac8(spark, d):
    p = points(spark, d)
    return loops.overlap_scores(_scan_pairs(p), p.withColumnRenamed("scan_id", "frame_id"), 0.5, plane=None).select("i", "j", *r6(score=F.col("score")), "vetoed")


#: Even scans pressed flat.
_FLAT = f"SELECT * REPLACE (CASE WHEN scan_id % 2 = 0 THEN 0.1 + x / 100 ELSE z END AS z) FROM ({POINTS})"


def _flat(spark, d):
    return points(spark, d).withColumn("z", F.when(F.col("scan_id") % 2 == 0, F.lit(0.1) + F.col("x") / 100).otherwise(F.col("z")))


@query("fac8_plane_veto", _overlap_sql(_FLAT, "CASE WHEN i % 2 = 0 AND score > 0.01 THEN 0.0 ELSE round(score, 6) END AS score, i % 2 = 0 AND score > 0.01 AS vetoed"))
def fac8b(spark, d):
    p = _flat(spark, d)
    return loops.overlap_scores(_scan_pairs(p), p.withColumnRenamed("scan_id", "frame_id"), 0.5, 0.01, 0.9).select("i", "j", *r6(score=F.col("score")), "vetoed")


@query("agg23_plane_share", f"SELECT DISTINCT scan_id, scan_id % 2 = 0 AS is_plane FROM ({POINTS})")
def agg23(spark, d):
    return loops.plane_share(_flat(spark, d), ["scan_id"]).select("scan_id", (F.col("share") > 0.9).alias("is_plane"))


def _revisits(df, first: str):
    """df and, as frames a hundred later, the same turned by 0.7 about z and moved by (4, -3, 1)."""
    c, s = math.cos(0.7), math.sin(0.7)
    again = df.withColumns({"frame_id": F.col("frame_id") + 100, "x": c * F.col("x") - s * F.col("y") + 4, "y": s * F.col("x") + c * F.col("y") - 3, "z": F.col("z") + 1})
    return df.unionByName(again.select(*df.columns)).select(first, *[c for c in df.columns if c != first])


@query("dsc6_loop_detection", f"SELECT DISTINCT scan_id + 100 AS i, scan_id AS j, 1.0::DOUBLE AS score, {R6(r00='cos(0.7)', r01='sin(0.7)', r22='1.0', tz='-1.0')} FROM ({POINTS})")
def dsc6(spark, d):
    # Every frame is met again once, from another pose: its loop is the frame itself, and the pose is undone.
    found = loops.detect_loops(_revisits(keypoints(spark, d), "frame_id"), _revisits(points(spark, d).select(F.col("scan_id").alias("frame_id"), "x", "y", "z"), "frame_id"), similar=0.9, skip_near=50, accept=0.5)
    r, t = F.col("rotation"), F.col("shift")
    return found.select("i", "j", *r6(score=F.col("score"), r00=r[0], r01=r[1], r22=r[8], tz=t[2]))


@query("join18_voxel_neighbours", f"""
WITH v AS (SELECT {_V5}, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz FROM ({POINTS}) GROUP BY 1, 2, 3)
SELECT a.vx, a.vy, a.vz, count(*) AS linked FROM v a JOIN v b ON abs(a.vx - b.vx) + abs(a.vy - b.vy) + abs(a.vz - b.vz) = 1
WHERE least((a.nx-b.nx)**2 + (a.ny-b.ny)**2 + (a.nz-b.nz)**2, (a.nx+b.nx)**2 + (a.ny+b.ny)**2 + (a.nz+b.nz)**2) < 0.5 GROUP BY 1, 2, 3
""")  # fmt: skip
def join18(spark, d):
    v = op.with_voxel(points(spark, d), 0.5).groupBy(*op.VOX).agg(*(F.avg(c).alias(c) for c in ("nx", "ny", "nz")))
    step = F.array(*(F.struct(*(F.lit(s if k == i else 0).cast("long").alias(c) for i, c in enumerate("xyz"))) for k in range(3) for s in (-1, 1)))
    a = v.withColumn("_o", F.explode(step)).select(*(F.col(c).alias(f"a{c}") for c in [*op.VOX, "nx", "ny", "nz"]), *((F.col(f"v{c}") + F.col(f"_o.{c}")).alias(f"v{c}") for c in "xyz"))
    j = a.join(v, op.VOX)
    mine, its = g.vec("anx", "any", "anz"), g.vec("nx", "ny", "nz")
    close = F.least(g.sq_dist(mine, its), g.sq_dist(mine, tuple(-c for c in its))) < 0.5
    return j.filter(close).groupBy(*(F.col(f"av{c}").alias(f"v{c}") for c in "xyz")).agg(F.count("*").alias("linked"))


def _surfels(spark, d):
    """Planes of voxels: mean points with the direction of their mean normals."""
    v = op.with_voxel(points(spark, d), 0.5).groupBy("scan_id", *op.VOX).agg(*(F.avg(c).alias("c" + c) for c in "xyz"), *(F.avg(c).alias(c) for c in ("nx", "ny", "nz")))
    n = g.norm(g.vec("nx", "ny", "nz"))
    v = v.withColumn("_l", n).filter("_l > 0.01").withColumns({c: F.col(c) / F.col("_l") for c in ("nx", "ny", "nz")}).drop("_l")
    return v.withColumn("d", -g.dot(g.vec("nx", "ny", "nz"), g.vec("cx", "cy", "cz")))


_SURFELS = f"""v AS (SELECT scan_id, {_V5}, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(nx) AS ax, avg(ny) AS ay, avg(nz) AS az FROM ({POINTS}) GROUP BY 1, 2, 3, 4),
 u AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS l FROM v), s AS (SELECT scan_id, vx, vy, vz, cx, cy, cz, ax / l AS nx, ay / l AS ny, az / l AS nz, -(ax*cx + ay*cy + az*cz) / l AS d FROM u WHERE l > 0.01)"""


@query("join15_plane_pairs", f"""
WITH {_SURFELS}
SELECT a.scan_id, count(*) AS pairs FROM s a JOIN s b ON a.scan_id = b.scan_id AND (a.vx, a.vy, a.vz) > (b.vx, b.vy, b.vz)
 AND least((a.nx-b.nx)**2 + (a.ny-b.ny)**2 + (a.nz-b.nz)**2, (a.nx+b.nx)**2 + (a.ny+b.ny)**2 + (a.nz+b.nz)**2) < 0.16
 AND abs(a.nx*b.cx + a.ny*b.cy + a.nz*b.cz + a.d) < 0.3 AND abs(b.nx*a.cx + b.ny*a.cy + b.nz*a.cz + b.d) < 0.3 GROUP BY 1
""")  # fmt: skip
def join15(spark, d):
    return op.coplanar_pairs(_surfels(spark, d), ["scan_id"], op.VOX, 0.4, 0.3).groupBy("scan_id").agg(F.count("*").alias("pairs"))


@query("join15_plane_labels")
def join15_labels(spark, d):
    return op.label_coplanar(_surfels(spark, d), "scan_id", op.VOX, 0.4, 0.3).select("scan_id", *op.VOX, "label")


@query("set2_concatenation", f"WITH p AS ({POINTS}), u AS (SELECT scan_id FROM p UNION ALL SELECT scan_id FROM p WHERE scan_id % 2 = 0) SELECT scan_id, count(*) AS n FROM u GROUP BY 1")
def set2(spark, d):
    p = points(spark, d).select("scan_id")
    return p.unionByName(p.filter("scan_id % 2 = 0")).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("set3_loop_pairs", f"WITH p AS ({POINTS}) SELECT i, j, min(pt_idx) AS first_pt FROM (SELECT pt_idx, least(scan_id, pt_idx % 10) AS i, greatest(scan_id, pt_idx % 10) AS j FROM p) GROUP BY 1, 2")
def set3(spark, d):
    i, j = F.least("scan_id", F.col("pt_idx") % 10), F.greatest("scan_id", F.col("pt_idx") % 10)
    pairs = points(spark, d).select(i.alias("i"), j.alias("j"), F.col("pt_idx").alias("first_pt"))
    # The pairs of the first points are there already; only new ones come.
    return tables.insert_absent(tables.top_per(pairs.filter("first_pt < 100"), ["i", "j"], ["first_pt"], 1), pairs, ["i", "j"], ["first_pt"])


@query("set4_remove_queued", f"WITH p AS ({POINTS}), q AS (SELECT scan_id, pt_idx, row_number() OVER (PARTITION BY scan_id ORDER BY pt_idx) AS r FROM p) SELECT scan_id, pt_idx FROM q WHERE NOT (scan_id IN (2, 5) AND r = 1)")
def set4(spark, d):
    gone = spark.createDataFrame([(2,), (5,)], "scan_id long")
    return tables.remove_first(points(spark, d).select("scan_id", "pt_idx"), gone, ["scan_id"], ["pt_idx"])
