"""Registration and filtering: normal equations summed by the engine, small solves on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.operators import balanced
from pointframe.session import cut


def plane_of_points(df: DataFrame, keys: list[str], gate: float = 0.1) -> DataFrame:
    """The plane n . p + d = 0 (unit n) of each group by least squares on a x + b y + c z = -1, by Cramer's rule; ok if all its points keep to the gate.

    Groups whose normal equations are singular have a null plane and are not ok.
    """
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    m = df.groupBy(*keys).agg(*(s(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")), *(F.sum(c).alias("s" + c) for c in "xyz"))
    a = [[F.col("".join(sorted(i + j))) for j in "xyz"] for i in "xyz"]
    rhs = [-F.col("s" + c) for c in "xyz"]

    def det(r: list[list[Column]]) -> Column:
        return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

    m = m.withColumn("_det", det(a))
    for k, c in enumerate("abc"):
        m = m.withColumn(f"_{c}", F.try_divide(det([[rhs[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]), F.col("_det")))
    n = F.sqrt(F.col("_a") ** 2 + F.col("_b") ** 2 + F.col("_c") ** 2)
    m = m.withColumns({"nx": F.col("_a") / n, "ny": F.col("_b") / n, "nz": F.col("_c") / n, "d": 1 / n})
    plane = m.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "nx", "ny", "nz", "d")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    far = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))
    # The points meet their plane again rather than being collected: groups may be of any size.
    worst = df.select(*keys, "x", "y", "z").join(plane, same).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("nx", "ny", "nz", "d")), F.max(far).alias("worst"))
    return worst.withColumn("ok", F.coalesce(F.col("worst") <= gate, F.lit(False))).select(*keys, "nx", "ny", "nz", "d", "worst", "ok")


def rigid_from_pairs(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) that takes points p to q with the least squared error; reflections are undone."""
    w = np.ones(len(p)) if w is None else w
    mp, mq = (p * w[:, None]).sum(0) / w.sum(), (q * w[:, None]).sum(0) / w.sum()
    return rigid_from_moments(mp, mq, ((p - mp) * w[:, None]).T @ (q - mq))


def rigid_from_moments(mp: np.ndarray, mq: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, _, vt = np.linalg.svd(cross)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    return r, mq - r @ mp


def align_triangles(pairs: DataFrame) -> DataFrame:
    """pairs with rotation (9 numbers) and shift of each pair of triangles: arrays q and t of nine coordinates, vertices in order."""

    def run(batches):
        for pdf in batches:
            q, t = (np.array(pdf[c].tolist(), dtype=float).reshape(-1, 3, 3) for c in "qt")
            mq, mt = q.mean(1), t.mean(1)
            u, _, vt = np.linalg.svd(np.einsum("nki,nkj->nij", q - mq[:, None], t - mt[:, None]))
            flip = np.ones((len(q), 3))
            flip[:, 2] = np.where(np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1)) < 0, -1.0, 1.0)
            rot = (vt.transpose(0, 2, 1) * flip[:, None, :]) @ u.transpose(0, 2, 1)
            yield pdf.assign(rotation=list(rot.reshape(-1, 9)), shift=list(mt - np.einsum("nij,nj->ni", rot, mq)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, rotation array<double>, shift array<double>")


def vote_transforms(pairs: DataFrame, group: list[str], pair_id: str, near: float = 3.0, seeds: int = 50, least: int = 4) -> DataFrame:
    """The transform of each group that most of its pairs agree with: all three vertices within `near`; at least `least` votes.

    At most `seeds` pairs of a group propose, one of each stretch of equally many by id, drawn by hash so that no period of the ids
    can leave only poor ones; all its pairs vote.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group).orderBy(pair_id)
    n = F.count("*").over(Window.partitionBy(*group))
    ranked = pairs.withColumn("_i", F.row_number().over(w) - 1).withColumn("_stretch", F.floor(F.col("_i") / F.ceil(n / seeds)))
    drawn = Window.partitionBy(*group, "_stretch").orderBy(F.xxhash64("_i"), "_i")
    seed = ranked.withColumn("_drawn", F.row_number().over(drawn)).filter("_drawn = 1").drop("_i", "_stretch", "_drawn")
    seed = align_triangles(seed).select(*group, F.col(pair_id).alias("seed"), "rotation", "shift")
    both = seed.join(pairs.select(*group, F.col(pair_id).alias("_voter"), "q", "t"), group)
    ok = _vertices_meet(near)
    count = both.groupBy(*group, "seed").agg(F.sum(ok.cast("int")).alias("votes"), F.first("rotation").alias("rotation"), F.first("shift").alias("shift"))
    best = count.groupBy(*group).agg(F.max_by(F.struct("seed", "votes", "rotation", "shift"), F.struct("votes", -F.col("seed"))).alias("b"))
    return best.select(*group, "b.seed", "b.votes", "b.rotation", "b.shift").filter(F.col("votes") >= least)


def _vertices_meet(near: float) -> Column:
    """Whether the transform of a row takes all three vertices of its q to within `near` of those of its t."""
    ok = F.lit(True)
    for v in range(3):
        p = tuple(F.col("q")[3 * v + k] for k in range(3))
        at = g.transform([F.col("rotation")[k] for k in range(9)], tuple(F.col("shift")[k] for k in range(3)), p)
        ok = ok & (g.sq_dist(at, tuple(F.col("t")[3 * v + k] for k in range(3))) < near * near)
    return ok


def near_rotations(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str, degrees: float) -> DataFrame:
    """(keys, lid, rid) of rotations less than `degrees` apart; both sides have a column rotation of nine numbers.

    Rotations are unit quaternions, either sign. Those within the angle are within a chord of each other or of the mirror
    image, so right rows stand in one cell, two chords wide, of four coordinates each, and left rows go, with both signs,
    to the cells that the chord reaches: two a coordinate at most.
    """
    half = np.radians(degrees) / 4
    chord = 2 * float(np.sin(half)) + 1e-9
    cell = lambda c: F.floor(c / (2 * chord))

    def quaternion(df: DataFrame) -> DataFrame:
        m = [F.col("rotation")[k] for k in range(9)]
        a, b, c, d = m[0] + m[4] + m[8], m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4]
        most = F.greatest(a, b, c, d)
        # The largest coordinate is a root, the others follow from it.
        by = [(a, (None, m[7] - m[5], m[2] - m[6], m[3] - m[1])), (b, (m[7] - m[5], None, m[1] + m[3], m[2] + m[6])), (c, (m[2] - m[6], m[1] + m[3], None, m[5] + m[7])), (d, (m[3] - m[1], m[2] + m[6], m[5] + m[7], None))]
        root = F.sqrt(F.greatest(most + 1, F.lit(0.0)))
        q = None
        for which, parts in reversed(by):
            own = F.array(*(root / 2 if p is None else p / (2 * root) for p in parts))
            q = own if q is None else F.when(most == which, own).otherwise(q)
        return df.withColumn("_q", q)

    r = quaternion(right).select(*keys, F.col(rid).alias("_rid"), F.col("_q").alias("_p"), *(cell(F.col("_q")[k]).alias(f"_c{k}") for k in range(4)))
    q = quaternion(left).select(*keys, F.col(lid).alias("_lid"), F.explode(F.array("_q", F.transform("_q", lambda v: -v))).alias("_q"))
    for k in range(4):
        v = F.col("_q")[k]
        q = q.withColumn(f"_c{k}", F.explode(F.array_distinct(F.array(cell(v - chord), cell(v + chord)))))
    dot = sum((F.col("_q")[k] * F.col("_p")[k] for k in range(4)), F.lit(0.0))
    near = F.acos(F.least(dot, F.lit(1.0))) * 2 < float(np.radians(degrees))
    return q.join(r, [*keys, *(f"_c{k}" for k in range(4))]).filter((dot > 0) & near).select(*keys, F.col("_lid").alias(lid), F.col("_rid").alias(rid))


def rotation_consensus(pairs: DataFrame, group: list[str], pair_id: str, degrees: float = 10.0, near: float = 5.0, seeds: int = 200, least: int = 5) -> DataFrame:
    """(group, seed, agreeing, rotation, shift, n_met): the transform whose rotation most others of a group are close to.

    Every k-th pair of a group proposes, where k is one more than its pairs over `seeds`, so fewer than `seeds` + 1 do. The first
    proposal of the most agreeing ones, itself among them, is taken if they are `least` or more, and it stands if it takes
    all three vertices of `least` or more of all pairs to within `near`. Other groups have no row.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group).orderBy(pair_id)
    n = F.count("*").over(Window.partitionBy(*group))
    picked = pairs.withColumn("_i", F.row_number().over(w) - 1).withColumn("_step", F.floor(n / seeds) + 1).filter("_i % _step = 0").drop("_i", "_step")
    proposals = cut(align_triangles(picked).select(*group, F.col(pair_id).alias("seed"), "rotation", "shift"))
    agree = near_rotations(proposals, proposals.withColumnRenamed("seed", "_other"), group, "seed", "_other", degrees)
    best = agree.groupBy(*group, "seed").agg(F.count("*").alias("agreeing")).groupBy(*group).agg(F.max_by(F.struct("seed", "agreeing"), F.struct("agreeing", -F.col("seed"))).alias("b"))
    chosen = best.select(*group, "b.*").filter(F.col("agreeing") >= least).join(proposals, [*group, "seed"])
    met = pairs.select(*group, "q", "t").join(chosen, group).groupBy(*group, "seed", "agreeing").agg(F.first("rotation").alias("rotation"), F.first("shift").alias("shift"), F.sum(_vertices_meet(near).cast("long")).alias("n_met"))
    return met.filter(F.col("n_met") >= least)


def _apply(df: DataFrame, r: np.ndarray, t: np.ndarray) -> DataFrame:
    at = g.transform([F.lit(float(v)) for v in r.reshape(-1)], g.lit3(t), g.vec("x", "y", "z"))
    return df.withColumns({f"_{c}": v for c, v in zip("xyz", at, strict=True)}).drop("x", "y", "z").withColumnsRenamed({f"_{c}": c for c in "xyz"})


def icp_point_to_point(source: DataFrame, target: DataFrame | balanced.Held, sid: list[str], tid: list[str], max_dist: float, rounds: int = 10, good: float = 1e-6, least: float | None = None, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(R, t, mean distance): nearest pairs, their moments summed by the engine, a 3 x 3 solve on the driver, until it is good or rounds are over.

    The mean distance is over all pairs and is judged before a step; with `least`, only pairs that far apart or further
    move the cloud, which speeds the last rounds up.
    """
    r, t = start or (np.eye(3), np.zeros(3))
    err = float("inf")
    held = target if isinstance(target, balanced.Held) else balanced.hold(target, tid)
    for _ in range(rounds):
        nn = balanced.knn_join(_apply(source, r, t), held, 1, sid, tid, max_dist=max_dist)
        cols = [f"{s}_{c}" for s in "qt" for c in "xyz"]
        far = F.lit(True) if least is None else F.sqrt("d2") >= least
        only = lambda v: F.when(far, v)  # noqa: B023, E731
        agg = nn.agg(F.count(only(F.lit(1))).alias("n"), F.avg(F.sqrt("d2")).alias("err"), *(F.avg(only(F.col(c))).alias(c) for c in cols), *(F.sum(only(F.col(f"q_{a}") * F.col(f"t_{b}"))).alias(f"s{a}{b}") for a in "xyz" for b in "xyz")).first()
        if agg["err"] is not None:
            err = agg["err"]
        if err < good or agg["n"] < 3:
            break
        mp, mq = (np.array([agg[f"{s}_{c}"] for c in "xyz"]) for s in "qt")
        cross = np.array([[agg[f"s{a}{b}"] for b in "xyz"] for a in "xyz"]) - agg["n"] * np.outer(mp, mq)
        dr, dt = rigid_from_moments(mp, mq, cross)
        r, t = dr @ r, dr @ t + dt
    return r, t, err


def icp_checked(source: DataFrame, target: DataFrame, sid: list[str], tid: list[str], start: tuple[np.ndarray, np.ndarray] | None = None, max_dist: float = 250.0, rounds: int = 20, fitness: float = 2.0) -> tuple[bool, np.ndarray, np.ndarray, float]:
    """(whether it fits, R, t, fitness): point-to-point steps from a guess until they are below 1e-6; the fitness is the mean
    squared distance of the moved source to its nearest targets, which must not be above the limit. No target fits nothing."""
    r, t = start or (np.eye(3), np.zeros(3))
    held = balanced.hold(target, tid)
    for _ in range(rounds):
        r1, t1, _ = icp_point_to_point(source, held, sid, tid, max_dist, 1, 0.0, start=(r, t))
        step = max(np.abs(r1 - r).max(), np.abs(t1 - t).max())
        r, t = r1, t1
        if step < 1e-6:
            break
    nn = balanced.knn_join(_apply(source, r, t), held, 1, sid, tid, max_dist=max_dist)
    score = nn.agg(F.avg("d2").alias("f")).first()["f"]
    return score is not None and score <= fitness, r, t, float("inf") if score is None else score


def align_planes(source: DataFrame, planes: DataFrame, sid: list[str], tid: list[str], max_dist: float, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The short alignment of a loop candidate: four rounds of point-to-plane steps with a Huber loss of 0.1."""
    return icp_point_to_plane(source, planes, sid, tid, max_dist, 4, 0.1, start)


def align_planes_long(source: DataFrame, planes: DataFrame, sid: list[str], tid: list[str], start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The long alignment: up to a hundred rounds within three metres, without a loss."""
    return icp_point_to_plane(source, planes, sid, tid, 3.0, 100, None, start)


def _exp(w: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k if n < 1e-9 else np.eye(3) + np.sin(n) / n * k + (1 - np.cos(n)) / n**2 * k @ k


def measurement_rows(pairs: DataFrame) -> DataFrame:
    """pairs (q_*: world point, n_*: unit normal, d) with residual and the six entries of its Jacobian by (rotation, shift)."""
    p, n = g.vec("q_x", "q_y", "q_z"), g.vec("n_x", "n_y", "n_z")
    rows = dict(zip(("j0", "j1", "j2"), g.cross(p, n), strict=True)) | dict(zip(("j3", "j4", "j5"), n, strict=True))
    return pairs.withColumns({"residual": g.dot(n, p) + F.col("d"), **rows})


def normal_equations(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: n, the 21 sums of J^T J, the six of J^T r and the squared error."""
    w = F.lit(1.0) if weight is None else weight
    h = [F.sum(w * F.col(f"j{a}") * F.col(f"j{b}")).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    return rows.agg(F.count("*").alias("n"), *h, *(F.sum(w * F.col(f"j{a}") * F.col("residual")).alias(f"g{a}") for a in range(6)), F.sum(w * F.col("residual") ** 2).alias("cost"))


def icp_point_to_plane(source: DataFrame, planes: DataFrame, sid: list[str], tid: list[str], max_dist: float, rounds: int = 20, huber: float | None = 0.1, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(R, t, cost): Gauss-Newton on point-to-plane residuals; planes are points (x, y, z) with unit normals (nx, ny, nz)."""
    r, t = start or (np.eye(3), np.zeros(3))
    cost = float("inf")
    ids = [*tid, "nx", "ny", "nz"]
    held = balanced.hold(planes, ids)
    for _ in range(rounds):
        nn = balanced.knn_join(_apply(source, r, t), held, 1, sid, ids, max_dist=max_dist)
        nn = nn.withColumnsRenamed({"t_nx": "n_x", "t_ny": "n_y", "t_nz": "n_z"})
        nn = nn.withColumn("d", -g.dot(g.vec("n_x", "n_y", "n_z"), g.vec("t_x", "t_y", "t_z")))
        w = F.when(F.abs("residual") > huber, huber / F.abs("residual")).otherwise(F.lit(1.0)) if huber else None
        e = normal_equations(measurement_rows(nn), w).first()
        if not e["n"] or e["n"] < 6:
            break
        h = np.zeros((6, 6))
        for a in range(6):
            for b in range(a, 6):
                h[a, b] = h[b, a] = e[f"h{a}{b}"]
        step = -np.linalg.solve(h + 1e-9 * np.eye(6), np.array([e[f"g{a}"] for a in range(6)]))
        dr = _exp(step[:3])
        r, t, cost = dr @ r, dr @ t + step[3:], e["cost"]
        if np.abs(step).max() < 1e-7:
            break
    return r, t, cost


def imu_init(pdf: pd.DataFrame, samples: int = 20) -> pd.DataFrame:
    """Running mean and recursive covariance of the first samples of one session's accelerations."""
    pdf = pdf.sort_values("t_us").head(samples)
    mean, cov = np.zeros(3), np.zeros(3)
    for n, a in enumerate(pdf[["ax", "ay", "az"]].to_numpy(), 1):
        mean = mean + (a - mean) / n
        cov = cov * (n - 1) / n + (a - mean) ** 2 * (n - 1) / (n * n)
    return pd.DataFrame([[pdf["session"].iloc[0], len(pdf), *mean, *cov]], columns=["session", "n", "mx", "my", "mz", "vx", "vy", "vz"])


INIT = "session long, n long, mx double, my double, mz double, vx double, vy double, vz double"


def imu_start(imu: DataFrame, samples: int = 20) -> DataFrame:
    """imu_init of each session (session, t_us, ax, ay, az); only its first samples, by time, are brought together."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("session").orderBy("t_us", "ax", "ay", "az")
    first = imu.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples).select("session", "t_us", "ax", "ay", "az")
    return first.groupBy("session").applyInPandas(lambda pdf: imu_init(pdf, samples), INIT)


def undistort(points: DataFrame, poses: DataFrame, ends: DataFrame) -> DataFrame:
    """Points (session, scan_id, t_us, x, y, z) moved to the frame of their scan's end, by the state before each point at constant rates.

    poses are (session, t_us, px.., vx.., wx.., qw..): position, speed, turn rate and orientation; ends the pose of each scan's end.
    """
    from pointframe.operators.temporal import asof_backward

    cols = [*(f"p{c}" for c in "xyz"), *(f"v{c}" for c in "xyz"), *(f"w{c}" for c in "xyz"), "qw", "qx", "qy", "qz"]
    m = asof_backward(points, poses, "session", "t_us", cols, "s_").filter("s_t IS NOT NULL")
    dt = (F.col("t_us") - F.col("s_t")) / 1e6
    base = g.quat_to_mat([F.col(f"s_q{c}") for c in "wxyz"])
    turn = g.so3_exp(tuple(F.col(f"s_w{c}") * dt for c in "xyz"))
    at = tuple(F.col(f"s_p{c}") + F.col(f"s_v{c}") * dt for c in "xyz")
    world = g.transform(g.mat_mul(base, turn), at, g.vec("x", "y", "z"))
    m = m.withColumns({f"_w{c}": v for c, v in zip("xyz", world, strict=True)})
    e = ends.select("session", "scan_id", *(F.col(f"p{c}").alias(f"e_p{c}") for c in "xyz"), *(F.col(f"q{c}").alias(f"e_q{c}") for c in "wxyz"))
    m = m.join(e, ["session", "scan_id"])
    back, shift = g.inverse(g.quat_to_mat([F.col(f"e_q{c}") for c in "wxyz"]), g.vec("e_px", "e_py", "e_pz"))
    out = g.transform(back, shift, g.vec("_wx", "_wy", "_wz"))
    return m.select(*[c for c in points.columns if c not in "xyz"], *(v.alias(c) for v, c in zip(out, "xyz", strict=True)))
