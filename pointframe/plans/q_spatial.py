"""Queries of neighbour, radius and box joins, and of the point index."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.operators import balanced as bl
from pointframe.operators import index as ix
from pointframe.operators import spatial as op
from pointframe.operators.forest import CubeForest
from pointframe.plans import sqlgeom as sg
from pointframe.plans.q_points import R6, ROT, SHIFT, r6
from pointframe.plans.registry import query
from pointframe.session import shared_folder
from pointframe.sources.adapters import POINTS, TRAJECTORY, points, trajectory

_D2 = "(q.x-t.x)**2 + (q.y-t.y)**2 + (q.z-t.z)**2"


def _nn(k: int, qw: str, tw: str, extra: str = "TRUE") -> str:
    return f"""p AS ({POINTS}), nn AS (SELECT q.scan_id AS q_scan_id, q.pt_idx AS q, q.x AS qx, q.y AS qy, q.z AS qz, q.nx AS qnx, q.ny AS qny, q.nz AS qnz, t.pt_idx AS t, t.x AS tx, t.y AS ty, t.z AS tz, t.nx AS tnx, t.ny AS tny, t.nz AS tnz, {_D2} AS d2,
 row_number() OVER (PARTITION BY q.pt_idx ORDER BY {_D2}, t.pt_idx) AS rank FROM p q JOIN p t ON {extra} WHERE q.{qw} AND t.{tw} QUALIFY rank <= {k})"""


def _sides(spark, d, q: str, t: str):
    p = points(spark, d)
    return p.filter(q), p.filter(t)


@query("idx2_k_nearest", f"WITH {_nn(5, 'pt_idx % 3 = 0', 'pt_idx % 3 <> 0')} SELECT q, t, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nn")
def idx2(spark, d):
    q, t = _sides(spark, d, "pt_idx % 3 = 0", "pt_idx % 3 <> 0")
    return op.knn_join(q, t, 5, 0.5, ["pt_idx"], ["pt_idx"]).select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"), "rank", *r6(d2=F.col("d2")))


@query("idx1_k_nearest_balanced", f"WITH {_nn(5, 'pt_idx % 3 = 0', 'pt_idx % 3 <> 0')} SELECT q, t, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nn")
def idx1(spark, d):
    q, t = _sides(spark, d, "pt_idx % 3 = 0", "pt_idx % 3 <> 0")
    return bl.knn_join(q, t, 5, ["pt_idx"], ["pt_idx"]).select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"), "rank", *r6(d2=F.col("d2")))


@query("idx1_radius_balanced", f"WITH p AS ({POINTS}) SELECT q.pt_idx AS q, t.pt_idx AS t FROM p q JOIN p t ON {_D2} <= 0.36 WHERE q.pt_idx % 5 = 0")
def idx1_radius(spark, d):
    q, t = _sides(spark, d, "pt_idx % 5 = 0", "true")
    return bl.radius_join(q, t, 0.6, ["pt_idx"], ["pt_idx"]).select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"))


@query("idx11_rebuilt_index", f"SELECT pt_idx FROM ({POINTS}) WHERE NOT (x < 0 AND pt_idx % 10 <> 0)")
def idx11(spark, d):
    """An index whose nodes are rebuilt until none is out of balance or mostly deleted: its live points are the ones that weren't deleted."""
    p = points(spark, d)
    index = p.withColumn("deleted_by", F.when((F.col("x") < 0) & (F.col("pt_idx") % 10 != 0), F.lit("point")))
    splits = bl.fit_splits(p, 50)
    for _ in range(3):
        index, splits, nodes = bl.rebuild(index, splits, leaf_rows=50)
        if not nodes:
            break
    return index.filter("deleted_by IS NULL").select("pt_idx")


@query("idx3_box_search", f"WITH p AS ({POINTS}) SELECT scan_id, pt_idx FROM p WHERE x >= -0.5 AND x < 0.8 AND y >= -1 AND y < 1 AND z >= 0 AND z < 2")
def idx3(spark, d):
    return op.box_search(points(spark, d), (-0.5, -1, 0), (0.8, 1, 2)).select("scan_id", "pt_idx")


@query("idx4_radius_search", f"WITH p AS ({POINTS}) SELECT q.pt_idx AS q, t.pt_idx AS t FROM p q JOIN p t ON {_D2} <= 0.36 WHERE q.pt_idx % 5 = 0")
def idx4(spark, d):
    q, t = _sides(spark, d, "pt_idx % 5 = 0", "true")
    return op.radius_join(q, t, 0.6, ["pt_idx"], ["pt_idx"]).select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"))


def _consecutive(spark, d):
    """Every scan as queries and the one before it as targets, paired by the later one."""
    p = points(spark, d)
    return p.withColumn("pair", F.col("scan_id")), p.withColumn("pair", F.col("scan_id") + 1)


_NEXT = "q.scan_id = t.scan_id + 1"


@query("join3_keypoint_association", f"WITH {_nn(1, 'scan_id >= 0', 'scan_id >= 0', _NEXT)} SELECT q, t FROM nn WHERE abs(qx-tx) < 1 AND abs(qy-ty) < 1 AND abs(qz-tz) < 1")
def join3(spark, d):
    q, t = _consecutive(spark, d)
    nn = op.knn_join(q, t, 1, 0.5, ["pt_idx"], ["pt_idx"], ["pair"])
    return nn.filter("abs(q_x - t_x) < 1 AND abs(q_y - t_y) < 1 AND abs(q_z - t_z) < 1").select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"))


_AGREE = "least((qnx-tnx)**2 + (qny-tny)**2 + (qnz-tnz)**2, (qnx+tnx)**2 + (qny+tny)**2 + (qnz+tnz)**2) < 1.0 AND abs(tnx*(qx-tx) + tny*(qy-ty) + tnz*(qz-tz)) < 0.4"


def _verify(spark, d, q: str, t: str):
    qs, ts = _sides(spark, d, q, t)
    ids = ["pt_idx", "nx", "ny", "nz"]
    nn = op.knn_join(qs, ts, 1, 0.5, ids, ids)
    qn, tn = g.vec("q_nx", "q_ny", "q_nz"), g.vec("t_nx", "t_ny", "t_nz")
    close = F.least(g.sq_dist(qn, tn), g.sq_dist(qn, tuple(-c for c in tn))) < 1.0
    plane = F.abs(g.dot(tn, g.sub(g.vec("q_x", "q_y", "q_z"), g.vec("t_x", "t_y", "t_z")))) < 0.4
    return nn.withColumn("ok", (close & plane).cast("int"))


@query("join4_plane_overlap", f"WITH {_nn(1, 'scan_id >= 5', 'scan_id < 5')} SELECT q_scan_id AS scan_id, round(sum(CASE WHEN {_AGREE} THEN 1.0 ELSE 0 END)::DOUBLE / count(*), 6) AS score FROM nn GROUP BY 1")
def join4(spark, d):
    v = _verify(spark, d, "scan_id >= 5", "scan_id < 5")
    return v.join(points(spark, d).select(F.col("pt_idx").alias("q_pt_idx"), "scan_id"), "q_pt_idx").groupBy("scan_id").agg(F.round(F.avg("ok"), 6).alias("score"))


@query("top4_best_candidate", f"WITH {_nn(1, 'scan_id >= 5', 'scan_id < 5')}, s AS (SELECT q_scan_id AS scan_id, sum(CASE WHEN {_AGREE} THEN 1.0 ELSE 0 END)::DOUBLE / count(*) AS score, count(*) AS n FROM nn GROUP BY 1) SELECT scan_id, round(score, 6) AS score FROM s WHERE score > 0.1 ORDER BY score + n / 1000.0 DESC, scan_id LIMIT 1")
def top4(spark, d):
    v = _verify(spark, d, "scan_id >= 5", "scan_id < 5")
    s = v.join(points(spark, d).select(F.col("pt_idx").alias("q_pt_idx"), "scan_id"), "q_pt_idx").groupBy("scan_id").agg(F.avg("ok").alias("score"), F.count("*").alias("n")).filter("score > 0.1")
    best = s.agg(F.max_by(F.struct("scan_id", "score"), F.struct(F.col("score") + F.col("n") / 1000.0, -F.col("scan_id"))).alias("b"))
    return best.select("b.scan_id", F.round("b.score", 6).alias("score")).filter("scan_id IS NOT NULL")


@query("join5_five_nearest", f"WITH {_nn(5, 'scan_id = 0', 'scan_id > 0')} SELECT q, count(*) AS n, {R6(far='max(d2)', x='avg(tx)')} FROM nn GROUP BY 1 HAVING max(d2) <= 1.5")
def join5(spark, d):
    q, t = _sides(spark, d, "scan_id = 0", "scan_id > 0")
    nn = op.knn_join(q, t, 5, 0.5, ["pt_idx"], ["pt_idx"])
    return nn.groupBy(F.col("q_pt_idx").alias("q")).agg(F.count("*").alias("n"), F.max("d2").alias("m"), F.round(F.avg("t_x"), 6).alias("x")).filter("m <= 1.5").select("q", "n", *r6(far=F.col("m")), "x")


@query("flt9_neighbour_cutoff", f"WITH {_nn(5, 'scan_id = 0', 'scan_id > 0')} SELECT q FROM nn WHERE rank = 5 AND d2 <= 1.0")
def flt9(spark, d):
    q, t = _sides(spark, d, "scan_id = 0", "scan_id > 0")
    return op.knn_join(q, t, 5, 0.5, ["pt_idx"], ["pt_idx"]).filter("rank = 5 AND d2 <= 1.0").select(F.col("q_pt_idx").alias("q"))


@query("top7_bounded_nearest", f"WITH {_nn(3, 'scan_id = 1', 'scan_id <> 1', _D2 + ' <= 1.0')} SELECT q, t, CAST(rank AS INTEGER) AS rank FROM nn")
def top7(spark, d):
    q, t = _sides(spark, d, "scan_id = 1", "scan_id <> 1")
    return op.knn_join(q, t, 3, 0.5, ["pt_idx"], ["pt_idx"], max_dist=1.0).select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"), "rank")


@query("join11_frames_in_range", f"WITH t AS ({TRAJECTORY}), e AS (SELECT session, arg_max(x, (t_us, id)) AS x, arg_max(y, (t_us, id)) AS y FROM t GROUP BY 1) SELECT t.session, t.id FROM t JOIN e USING (session) WHERE (t.x - e.x)**2 + (t.y - e.y)**2 <= 4")
def join11(spark, d):
    t = trajectory(spark, d)
    last = t.groupBy("session").agg(F.max_by(F.struct("x", "y"), F.struct("t_us", "id")).alias("e"))
    return t.join(last, "session").filter((F.col("x") - F.col("e.x")) ** 2 + (F.col("y") - F.col("e.y")) ** 2 <= 4).select("session", "id")


@query("join12_loop_truth", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_us, id) AS k FROM ({TRAJECTORY})), j AS (SELECT a.session, a.id, b.id AS loop_id, abs(a.x-b.x) + abs(a.y-b.y) AS gap FROM t a JOIN t b ON a.session = b.session AND a.k - b.k > 3 AND (a.x-b.x)**2 + (a.y-b.y)**2 <= 9) SELECT session, id, arg_min(loop_id, (gap, loop_id)) AS loop_id FROM j GROUP BY 1, 2")
def join12(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("session").orderBy("t_us", "id")
    t = trajectory(spark, d).withColumn("k", F.row_number().over(w)).withColumn("z", F.lit(0.0))
    pairs = op.radius_join(t, t, 3.0, ["id", "k"], ["id", "k"], ["session"]).filter("q_k - t_k > 3")
    gap = F.abs(F.col("q_x") - F.col("t_x")) + F.abs(F.col("q_y") - F.col("t_y"))
    return pairs.groupBy(F.col("q_session").alias("session"), F.col("q_id").alias("id")).agg(F.min_by("t_id", F.struct(gap, "t_id")).alias("loop_id"))


@query("join16_lookup_pairs", f"WITH p AS ({POINTS}), l AS (SELECT DISTINCT scan_id AS i, (scan_id + 3) % 10 AS j FROM p WHERE scan_id % 2 = 0) SELECT l.i, l.j, a.n AS ni, b.n AS nj FROM l JOIN (SELECT scan_id, count(*) AS n FROM p GROUP BY 1) a ON a.scan_id = i LEFT JOIN (SELECT scan_id, count(*) AS n FROM p GROUP BY 1) b ON b.scan_id = j")
def join16(spark, d):
    p = points(spark, d)
    n = p.groupBy("scan_id").agg(F.count("*").alias("n"))
    pairs = p.filter("scan_id % 2 = 0").select(F.col("scan_id").alias("i"), ((F.col("scan_id") + 3) % 10).alias("j")).distinct()
    return pairs.join(n.select(F.col("scan_id").alias("i"), F.col("n").alias("ni")), "i").join(n.select(F.col("scan_id").alias("j"), F.col("n").alias("nj")), "j", "left").select("i", "j", "ni", "nj")


@query("join17_repeated_points", f"WITH p AS ({POINTS}) SELECT q.scan_id, count(*) AS repeated FROM p q WHERE q.scan_id > 0 AND EXISTS (SELECT 1 FROM p t WHERE t.scan_id = 0 AND {_D2} <= 1.0) GROUP BY 1")
def join17(spark, d):
    q, t = _sides(spark, d, "scan_id > 0", "scan_id = 0")
    return op.radius_join(q, t, 1.0, ["scan_id", "pt_idx"], ["pt_idx"]).select("q_scan_id", "q_pt_idx").distinct().groupBy(F.col("q_scan_id").alias("scan_id")).agg(F.count("*").alias("repeated"))


@query("join19_overlap_ratio", f"WITH {_nn(1, 'scan_id >= 0', 'scan_id >= 0', _NEXT)}, n AS (SELECT scan_id, count(*) AS n FROM p GROUP BY 1) SELECT q_scan_id AS pair, round(2.0 * sum(CASE WHEN d2 < 1.0 THEN 1 ELSE 0 END) / (any_value(a.n) + any_value(b.n))::DOUBLE, 6) AS ratio FROM nn JOIN n a ON a.scan_id = q_scan_id JOIN n b ON b.scan_id = q_scan_id - 1 GROUP BY 1")
def join19(spark, d):
    q, t = _consecutive(spark, d)
    hits = op.knn_join(q, t, 1, 0.5, ["pt_idx"], ["pt_idx"], ["pair"]).groupBy(F.col("q_pair").alias("pair")).agg(F.sum((F.col("d2") < 1.0).cast("int")).alias("hit"))
    size = lambda df, n: df.groupBy("pair").agg(F.count("*").alias(n))
    return hits.join(size(q, "n1"), "pair").join(size(t, "n2"), "pair").select("pair", F.round(2.0 * F.col("hit") / (F.col("n1") + F.col("n2")), 6).alias("ratio"))


@query("join20_inlier_rmse", f"WITH {_nn(1, 'scan_id >= 0', 'scan_id >= 0', _NEXT)} SELECT q_scan_id AS pair, round(avg(CASE WHEN d2 < 1.0 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS inliers, round(sqrt(avg(d2) FILTER (WHERE d2 < 1.0)), 6) AS rmse FROM nn GROUP BY 1")
def join20(spark, d):
    q, t = _consecutive(spark, d)
    nn, near = op.knn_join(q, t, 1, 0.5, ["pt_idx"], ["pt_idx"], ["pair"]), F.col("d2") < 1.0
    return nn.groupBy(F.col("q_pair").alias("pair")).agg(F.round(F.avg(near.cast("double")), 6).alias("inliers"), F.round(F.sqrt(F.avg(F.when(near, F.col("d2")))), 6).alias("rmse"))


@query("join20_plane_rmse", f"""
WITH {_nn(20, 'scan_id >= 0', 'scan_id >= 0', _NEXT)}, m AS (SELECT q_scan_id AS pair, q, any_value(qx) AS qx, any_value(qy) AS qy, any_value(qz) AS qz, sum(tx*tx) AS xx, sum(tx*ty) AS xy, sum(tx*tz) AS xz, sum(ty*ty) AS yy, sum(ty*tz) AS yz, sum(tz*tz) AS zz, -sum(tx) AS sx, -sum(ty) AS sy, -sum(tz) AS sz FROM nn GROUP BY 1, 2),
 i AS (SELECT *, xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS det FROM m),
 s AS (SELECT *, (sx*(yy*zz - yz*yz) + sy*(xz*yz - xy*zz) + sz*(xy*yz - xz*yy)) / det AS a, (sx*(yz*xz - xy*zz) + sy*(xx*zz - xz*xz) + sz*(xz*xy - xx*yz)) / det AS b, (sx*(xy*yz - yy*xz) + sy*(xy*xz - xx*yz) + sz*(xx*yy - xy*xy)) / det AS c FROM i),
 d AS (SELECT pair, abs(a*qx + b*qy + c*qz + 1) / sqrt(a*a + b*b + c*c) AS dis FROM s)
SELECT pair, count(*) AS useful, round(sqrt(avg(dis)), 6) AS rmse FROM d WHERE dis < 4.0 GROUP BY 1
""")  # fmt: skip
def join20b(spark, d):
    q, t = _consecutive(spark, d)
    return op.plane_rmse(q, t, 20, 1.0, ["pt_idx"], ["pt_idx"], 2.0, ["pair"]).select("pair", "useful", *r6(rmse=F.col("rmse")))


_CELL = ", ".join(f"{sg.leaf(c, 0.8)} AS c{c}" for c in "xyz")
_CD = " + ".join(f"({c} - ({sg.leaf(c, 0.8)} + 0.5) * 0.8)**2" for c in "xyz")


@query("agg26_central_points", f"WITH p AS ({POINTS}), c AS (SELECT pt_idx, {_CELL}, {_CD} AS d FROM p) SELECT arg_min(pt_idx, (d, pt_idx)) AS pt_idx FROM c GROUP BY cx, cy, cz")
def agg26(spark, d):
    return ix.keep_central(points(spark, d), 0.8, "pt_idx").select("pt_idx")


@query("idx5_insert_sampled", f"""
WITH p AS ({POINTS}), c AS (SELECT pt_idx, CASE WHEN pt_idx >= 400 THEN 1 ELSE 0 END AS new, {_CELL}, {_CD} AS d FROM p),
 r AS (SELECT *, max(new) OVER (PARTITION BY cx, cy, cz) AS touched, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY d, pt_idx) AS r FROM c)
SELECT pt_idx FROM r WHERE touched = 0 OR r = 1
""")  # fmt: skip
def idx5(spark, d):
    p = points(spark, d)
    return ix.insert_sampled(p.filter("pt_idx < 400"), p.filter("pt_idx >= 400"), 0.8, "pt_idx").select("pt_idx")


@query("idx6_delete_points", f"WITH p AS ({POINTS}) SELECT pt_idx FROM p WHERE pt_idx % 9 <> 0")
def idx6(spark, d):
    p = points(spark, d)
    gone = p.filter("pt_idx % 9 = 0").select((F.col("x") + 3e-7).alias("x"), (F.col("y") - 2e-7).alias("y"), "z")
    return ix.delete_points(p, gone).select("pt_idx")


_BOXES = [((-1.0, -1.0, -1.0), (0.0, 0.5, 1.0)), ((0.5, 0.0, -2.0), (2.0, 2.0, 2.0))]
_IN = lambda boxes: " OR ".join("(" + " AND ".join(f"{c} >= {lo!r} AND {c} < {hi!r}" for c, lo, hi in zip("xyz", *b, strict=True)) + ")" for b in boxes)


def _marked(spark, d):
    return points(spark, d).withColumn("deleted_by", F.when(F.col("pt_idx") % 10 == 0, F.lit("sampling")))


@query("idx7_delete_boxes", f"WITH p AS ({POINTS}) SELECT CASE WHEN pt_idx % 10 = 0 THEN 'sampling' WHEN {_IN(_BOXES)} THEN 'box' ELSE 'none' END AS state, count(*) AS n FROM p GROUP BY 1")
def idx7(spark, d):
    return ix.delete_boxes(_marked(spark, d), _BOXES).groupBy(F.coalesce("deleted_by", F.lit("none")).alias("state")).agg(F.count("*").alias("n"))


@query("idx8_restore_boxes", f"WITH p AS ({POINTS}) SELECT CASE WHEN pt_idx % 10 = 0 THEN 'sampling' WHEN ({_IN(_BOXES)}) AND NOT ({_IN(_BOXES[:1])}) THEN 'box' ELSE 'none' END AS state, count(*) AS n FROM p GROUP BY 1")
def idx8(spark, d):
    m = ix.restore_boxes(ix.delete_boxes(_marked(spark, d), _BOXES), _BOXES[:1])
    return m.groupBy(F.coalesce("deleted_by", F.lit("none")).alias("state")).agg(F.count("*").alias("n"))


@query("idx9_removed_points", f"WITH p AS ({POINTS}) SELECT pt_idx FROM p WHERE pt_idx % 10 <> 0 AND ({_IN(_BOXES)})")
def idx9(spark, d):
    return ix.delete_boxes(_marked(spark, d), _BOXES).filter("deleted_by = 'box'").select("pt_idx")


@query("idx10_size_and_range", f"WITH p AS ({POINTS}) SELECT count(*) AS size, count(*) FILTER (WHERE pt_idx % 10 <> 0) AS valid, {R6(lx='min(x)', hx='max(x)', lz='min(z)', hz='max(z)')} FROM p")
def idx10(spark, d):
    m = _marked(spark, d)
    return m.agg(F.count("*").alias("size"), F.sum(F.col("deleted_by").isNull().cast("long")).alias("valid"), *r6(lx=F.min("x"), hx=F.max("x"), lz=F.min("z"), hz=F.max("z")))


@query("idx12_nearest_in_time", f"WITH {_nn(3, 'scan_id = 1', 'scan_id <> 1', 'abs(q.t_off_ms - t.t_off_ms) <= 2.0')} SELECT q, t, CAST(rank AS INTEGER) AS rank FROM nn")
def idx12(spark, d):
    q, t = _sides(spark, d, "scan_id = 1", "scan_id <> 1")
    near = F.abs(F.col("q_t_off_ms") - F.col("t_t_off_ms")) <= 2.0  # the time range is part of the match
    nn = op.knn_join(q, t, 3, 0.5, ["pt_idx", "t_off_ms"], ["pt_idx", "t_off_ms"], where=near)
    return nn.select(F.col("q_pt_idx").alias("q"), F.col("t_pt_idx").alias("t"), "rank")


@query("idx13_forest_box_in_time", f"SELECT pt_idx FROM ({POINTS}) WHERE x BETWEEN -1.3 AND 2.1 AND y BETWEEN -0.7 AND 1.9 AND z BETWEEN -2.2 AND 2.4 AND t_off_ms BETWEEN 2.05 AND 7.85 AND NOT (pt_idx % 10 = 3)")
def idx13(spark, d):
    """Points inserted by parts of a scan's time and found again by a box and a range of time; some are deleted, and their cubes written anew."""
    p = points(spark, d).select("pt_idx", "x", "y", "z", "t_off_ms")
    f = CubeForest(shared_folder(spark, "forest"), 1.0)
    for k in range(3):
        f.add(p.filter(F.floor(F.col("t_off_ms") / 4) == k), f"part-{k}", "t_off_ms")
    f.delete(p.filter("pt_idx % 10 = 3"), "threes")
    f.compact(spark, "compacted", "t_off_ms")
    return f.read(spark, (-1.3, -0.7, -2.2), (2.1, 1.9, 2.4), 2.05, 7.85).select("pt_idx")


_MID = {c: f"(floor(q{c} * 2) * 0.5 + 0.25)" for c in "xyz"}
_OWN = " + ".join(f"(q{c} - {_MID[c]})**2" for c in "xyz")
_ITS = " + ".join(f"(t{c} - {_MID[c]})**2" for c in "xyz")


@query("idx14_map_admission", f"""
WITH {_nn(5, 'scan_id = 0', 'scan_id > 0', _D2 + ' <= 2.25')}, v AS (SELECT q, count(*) AS k, bool_or(rank = 1 AND {' AND '.join(f'abs(t{c} - {_MID[c]}) > 0.25' for c in 'xyz')}) AS far, bool_or({_ITS} < {_OWN}) AS beaten FROM nn GROUP BY 1)
SELECT pt_idx, CASE WHEN k IS NULL THEN 'add' WHEN far THEN 'plain' WHEN k >= 5 AND beaten THEN 'skip' ELSE 'add' END AS verdict FROM p LEFT JOIN v ON v.q = pt_idx WHERE scan_id = 0
""")  # fmt: skip
def idx14(spark, d):
    q, t = _sides(spark, d, "scan_id = 0", "scan_id > 0")
    nn = op.knn_join(q, t, 5, 0.5, ["scan_id", "pt_idx"], ["pt_idx"], max_dist=1.5)
    return ix.admit(q, nn, 0.5).select("pt_idx", "verdict")


@query("prj2_relative_correction", f"WITH p AS ({POINTS}), q AS (SELECT pt_idx, x - 0.5 AS dx, y + 1.25 AS dy, z - 2.0 AS dz FROM p), b AS (SELECT pt_idx, cos(0.4)*dx + sin(0.4)*dy AS ux, -sin(0.4)*dx + cos(0.4)*dy AS uy, dz AS uz FROM q) SELECT pt_idx, {R6(**{c: sg.rotate(ROT, ('ux', 'uy', 'uz'), SHIFT)[k] for k, c in enumerate('xyz')})} FROM b")
def prj2b(spark, d):
    from pointframe.plans.q_points import rot, xyz

    # From a pose turned by 0.4 about z at (0.5, -1.25, 2) to the corrected one.
    was = g.euler_to_mat(F.lit(0.0), F.lit(0.0), F.lit(0.4))
    m, t = g.compose(rot(), g.lit3(SHIFT), *g.inverse(was, g.lit3((0.5, -1.25, 2.0))))
    return points(spark, d).select("pt_idx", *xyz(g.transform(m, t, g.vec("x", "y", "z"))))
