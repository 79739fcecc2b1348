"""Voxel statistics, plane fits and merges, height-slice keypoints, triangle descriptors and their matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g
from pointframe.operators import spatial
from pointframe.session import cut
from pointframe.streaming.fold import fold_sorted

VOX = ["vx", "vy", "vz"]


def with_voxel(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"v{c}": g.voxel(F.col(c), size) for c in "xyz"})


def voxel_centroids(df: DataFrame, size: float, extra: list[str] | None = None) -> DataFrame:
    """The mean point of each voxel; below a size of 0.01 the points stay as they are."""
    extra = extra or []
    if size < 0.01:
        return df
    return with_voxel(df, size).groupBy(*VOX).agg(*(F.avg(c).alias(c) for c in ["x", "y", "z", *extra]), F.count("*").alias("n"))


def moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable moments of each group: n, sums of the coordinates and of their products."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyz"), *(F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs))


def merge_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of coarser groups from moments of finer ones."""
    cols = ["n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in cols))


def covariance(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and population covariance of each group, by the engine's stable aggregates."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))


def eigenvalues(df: DataFrame) -> DataFrame:
    """df (with a covariance) and its eigenvalues e1 <= e2 <= e3, by the trigonometric closed form of a symmetric 3 x 3 matrix."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    df = df.withColumn("_q", (xx + yy + zz) / 3)
    q = F.col("_q")
    off = xy * xy + xz * xz + yz * yz
    df = df.withColumn("_p", F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * off) / 6))
    p = F.col("_p")
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p > 0, det / (2 * p * p * p)).otherwise(F.lit(0.0))))
    df = df.withColumn("_phi", F.acos(r) / 3)
    e3 = q + 2 * p * F.cos("_phi")
    e1 = q + 2 * p * F.cos(F.col("_phi") + F.lit(2 * np.pi / 3))
    return df.withColumns({"e1": e1, "e3": e3}).withColumn("e2", 3 * q - F.col("e1") - F.col("e3")).drop("_q", "_p", "_phi")


PLANE = "nx double, ny double, nz double, d double, radius double, min_eig double, is_plane boolean"


def fit_planes(df: DataFrame, keys: list[str], least: int = 10, flat: float = 0.01) -> DataFrame:
    """The plane of each group of more than `least` points: covariance, normal, distance; is_plane if the least eigenvalue is below `flat`.

    Moments are summed by the engine; only the 3 x 3 eigenvectors come from numpy, a batch of groups at a time.
    """
    stats = covariance(df, keys).filter(F.col("n") > least)

    def solve(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    m[:, i, j] = pdf[f"c{min(a, b)}{max(a, b)}"]
            val, vec = np.linalg.eigh(m)
            normal = vec[:, :, 0]
            # A normal has no sign of its own: the largest of its entries is made positive.
            big = np.take_along_axis(normal, np.abs(normal).argmax(1)[:, None], 1)
            normal = normal * np.where(big < 0, -1.0, 1.0)
            d = -(normal * pdf[["cx", "cy", "cz"]].to_numpy()).sum(1)
            yield pdf.assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], d=d, radius=np.sqrt(np.maximum(val[:, 2], 0)), min_eig=val[:, 0], is_plane=val[:, 0] < flat)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInPandas(solve, f"{fields}, {PLANE}")


def coplanar_labels(pdf: pd.DataFrame, normal_thr: float = 0.1, dist_thr: float = 0.3) -> np.ndarray:
    """Labels of the planes of one frame, in voxel order: later planes meet earlier ones, labels are handed on but never joined; 0 for none."""
    pdf = pdf.sort_values(["vx", "vy", "vz"])
    n, c, d = pdf[["nx", "ny", "nz"]].to_numpy(), pdf[["cx", "cy", "cz"]].to_numpy(), pdf["d"].to_numpy()
    label, fresh = np.zeros(len(pdf), dtype=np.int64), 1
    for i in range(len(pdf) - 1, 0, -1):
        near = np.minimum(np.linalg.norm(n[i] - n[:i], axis=1), np.linalg.norm(n[i] + n[:i], axis=1)) < normal_thr
        near &= (np.abs(c[:i] @ n[i] + d[i]) < dist_thr) & (np.abs((n[:i] * c[i]).sum(1) + d[:i]) < dist_thr)
        for j in np.flatnonzero(near):
            if not label[i] and not label[j]:
                label[i] = label[j] = fresh
                fresh += 1
            elif not label[i]:
                label[i] = label[j]
            elif not label[j]:
                label[j] = label[i]
    return pd.Series(label, index=pdf.index).sort_index().to_numpy()


def coplanar_pairs(planes: DataFrame, keys: list[str], order: list[str], normal_thr: float = 0.1, dist_thr: float = 0.3) -> DataFrame:
    """(keys, later, earlier): pairs of planes of a frame (order: what tells them apart, as structs) that lie in one plane.

    Normals, of either sign, differ by less than normal_thr, and each centre is nearer than dist_thr to the other's plane. Then
    the offsets, with the sign, differ by dist_thr + normal_thr * (the farthest centre of the frame) at most. So planes
    stand in a cell of normals, two thresholds wide, and of offsets, that wide; and are looked up with both signs from the
    cells that can hold a partner.
    """
    far = F.sqrt(F.max(g.sq_dist(g.vec("cx", "cy", "cz"), g.lit3((0, 0, 0)))).over(Window.partitionBy(*keys)))
    wide, p = 2.0 * normal_thr, [*keys, "_w", "_id", "_c", "_n", "_d"]
    cell = lambda v: F.floor(v / wide)
    base = planes.withColumn("_w", F.lit(dist_thr) + normal_thr * far + 1e-9).select(*keys, "_w", F.struct(*order).alias("_id"), F.array("cx", "cy", "cz").alias("_c"), F.array("nx", "ny", "nz").alias("_n"), F.col("d").alias("_d"))
    right = base.select(*keys, *(F.col(c).alias("r" + c) for c in p[len(keys) + 1 :]), *(cell(F.col("_n")[k]).alias(f"_k{k}") for k in range(3)), F.floor(F.col("_d") / F.col("_w")).alias("_k3"))
    flip = F.struct(F.transform("_n", lambda v: -v).alias("n"), (-F.col("_d")).alias("d"))
    left = base.withColumn("_s", F.explode(F.array(F.struct(F.col("_n").alias("n"), F.col("_d").alias("d")), flip)))
    for k in range(3):
        v = F.col("_s.n")[k]
        left = left.withColumn(f"_k{k}", F.explode(F.array_distinct(F.array(cell(v - normal_thr), cell(v + normal_thr)))))
    at = F.floor(F.col("_s.d") / F.col("_w"))
    left = left.withColumn("_k3", F.explode(F.array(at - 1, at, at + 1)))
    three = lambda c: tuple(F.col(c)[k] for k in range(3))
    off = lambda n, d, c: F.abs(g.dot(three(n), three(c)) + F.col(d)) < dist_thr
    both = left.join(right, [*keys, *(f"_k{k}" for k in range(4))]).filter(F.col("r_id") < F.col("_id"))
    apart = F.sqrt(sum(((F.col("_s.n")[k] - F.col("r_n")[k]) ** 2 for k in range(3)), F.lit(0.0)))
    return both.filter((apart < normal_thr) & off("_n", "_d", "r_c") & off("r_n", "r_d", "_c")).select(*keys, F.col("_id").alias("later"), F.col("r_id").alias("earlier")).distinct()


def label_coplanar(planes: DataFrame, key: str, order: list[str], normal_thr: float = 0.1, dist_thr: float = 0.3) -> DataFrame:
    """planes with label, as coplanar_labels gives them: pairs are gone through by the later plane downwards, then the earlier one upwards.

    A label is given once and stays, so it is known when the pair is met: a frame's pairs go by as a sorted stream, of
    which a task keeps the labels given so far.
    """
    pairs = coplanar_pairs(planes, [key], order, normal_thr, dist_thr)
    rank = planes.select(key, F.struct(*order).alias("_id"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long").alias("_n"))
    side = lambda name, n: rank.select(key, F.col("_id").alias(name), F.col("_n").alias(n))
    rows = pairs.join(side("later", "_i"), [key, "later"]).join(side("earlier", "_j"), [key, "earlier"]).select(F.col(key).alias("key"), (-F.col("_i")).alias("down"), F.col("_j").alias("up"))

    def step(labels: dict, row: tuple) -> tuple | None:
        i, j = -row[1], row[2]
        a, b = labels.get(i), labels.get(j)
        if a and b:
            return None
        label = a or b or labels.get(0, 0) + 1
        if not a and not b:
            labels[0] = label  # places count from 1
        labels[i] = labels[j] = label
        return row[0], label, [x for x, had in ((i, a), (j, b)) if not had]

    kind = planes.schema[key].dataType.simpleString()
    given = fold_sorted(rows, "key", ["down", "up"], lambda _: {}, step, f"key {kind}, label long, places array<long>")
    given = given.select(F.col("key").alias(key), "label", F.explode("places").alias("_n"))
    named = rank.join(given, [key, "_n"], "left").select(key, "_id", F.coalesce("label", F.lit(0)).alias("label"))
    return planes.withColumn("_id", F.struct(*order)).join(named, [key, "_id"]).drop("_id")


def merge_coplanar(planes: DataFrame, keys: list[str], singles: bool, normal_thr: float = 0.1, dist_thr: float = 0.3) -> DataFrame:
    """Planes of a frame merged by label: moments added up, sub_planes counted; planes without a label stay if `singles`.

    A frame's planes are as many as its occupied voxels at most.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        label = coplanar_labels(pdf, normal_thr, dist_thr)
        alone = -1 - np.arange(len(pdf))
        pdf = pdf.assign(label=np.where(label == 0, alone, label))
        if not singles:
            pdf = pdf[pdf["label"] > 0]
        rows = []
        for _, grp in pdf.groupby("label", sort=True):
            w = grp["n"].to_numpy(dtype=float)
            mu = (grp[["cx", "cy", "cz"]].to_numpy() * w[:, None]).sum(0) / w.sum()
            second = np.zeros((3, 3))
            for k, r in zip(w, grp.to_dict("records"), strict=True):
                m = np.array([[r["cxx"], r["cxy"], r["cxz"]], [r["cxy"], r["cyy"], r["cyz"]], [r["cxz"], r["cyz"], r["czz"]]])
                c = np.array([r["cx"], r["cy"], r["cz"]])
                second += k * (m + np.outer(c, c))
            val, vec = np.linalg.eigh(second / w.sum() - np.outer(mu, mu))
            normal = vec[:, 0] * (-1 if vec[np.abs(vec[:, 0]).argmax(), 0] < 0 else 1)
            rows.append([*(grp[k].iloc[0] for k in keys), int(w.sum()), *mu, *normal, float(-normal @ mu), len(grp)])
        return pd.DataFrame(rows, columns=[*keys, "n", "cx", "cy", "cz", "nx", "ny", "nz", "d", "sub_planes"])

    types = {f.name: f.dataType.simpleString() for f in planes.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "n long", *(f"{c} double" for c in ("cx", "cy", "cz", "nx", "ny", "nz", "d")), "sub_planes long"])
    return planes.groupBy(*keys).applyInPandas(lambda pdf: run(pdf), schema)


def project_planes(planes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The planes of a frame to project on: by sub_planes, first ones first, skipping those whose normal is nearly opposite to the last taken."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sub_planes", "cx", "cy", "cz"], ascending=[False, True, True, True])
        taken, last = [], None
        for i, r in pdf.iterrows():
            n = r[["nx", "ny", "nz"]].to_numpy(dtype=float)
            if last is None or np.linalg.norm(n + last) > 0.3:
                taken.append(i)
                last = n
            if len(taken) >= most:
                break
        return pdf.loc[taken]

    return planes.groupBy(*keys).applyInPandas(lambda pdf: run(pdf), planes.schema)


def height_slices(df: DataFrame, keys: list[str], resolution: float, low: float, high: float, step: float) -> DataFrame:
    """Pixels (px, py) of projected points (u, v, dis): the set of occupied slices, their number, and the mean place.

    The image of a group begins at the least u and v, but at 10 at most. Slices beyond the last one are dropped.
    """
    inside = df.filter((F.col("dis") >= low) & (F.col("dis") <= high))
    corner = inside.groupBy(*keys).agg(F.least(F.min("u"), F.lit(10.0)).alias("_u0"), F.least(F.min("v"), F.lit(10.0)).alias("_v0"))
    slices = int((high - low) / step)
    pix = inside.join(corner, keys)
    pix = pix.withColumns({"px": ((F.col("u") - F.col("_u0")) / resolution).cast("int"), "py": ((F.col("v") - F.col("_v0")) / resolution).cast("int"), "_k": ((F.col("dis") - low) / step).cast("int")})
    agg = pix.groupBy(*keys, "px", "py").agg(F.sort_array(F.collect_set(F.when(F.col("_k") < slices, F.col("_k")))).alias("slices"), F.avg("u").alias("mu"), F.avg("v").alias("mv"))
    return agg.withColumn("summary", F.size("slices"))


def block_maxima(pixels: DataFrame, keys: list[str], block: int = 5) -> DataFrame:
    """The pixel of most slices in each block, the first by px, then py."""
    w = Window.partitionBy(*keys, "_bx", "_by").orderBy(F.desc("summary"), "px", "py")
    p = pixels.withColumn("_bx", F.floor(F.col("px") / block)).withColumn("_by", F.floor(F.col("py") / block))
    return p.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_bx", "_by")


def off_ridge(maxima: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Maxima that don't lie on a line of the image: in no direction are both neighbours high.

    A neighbour is high at summary - 3; with the other at half the summary at least, the place counts as a ridge.
    """
    at = pixels.select(*keys, F.col("px").alias("_qx"), F.col("py").alias("_qy"), F.col("summary").alias("_s"))
    offsets = [(0, 1), (1, 0), (1, 1), (1, -1)]
    both = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(s * dx).alias("dx"), F.lit(s * dy).alias("dy")) for k, (dx, dy) in enumerate(offsets) for s in (1, -1)))
    near = maxima.select(*keys, "px", "py", "summary", F.explode(both).alias("o")).withColumn("_qx", F.col("px") + F.col("o.dx")).withColumn("_qy", F.col("py") + F.col("o.dy"))
    near = near.join(at, [*keys, "_qx", "_qy"], "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    pair = near.groupBy(*keys, "px", "py", "summary", F.col("o.k").alias("k")).agg(F.max("_s").alias("hi"), F.min("_s").alias("lo"))
    ridge = pair.filter((F.col("hi") >= F.col("summary") - 3) & ((F.col("lo") >= 0.5 * F.col("summary")) | (F.col("lo") >= F.col("summary") - 3)))
    return maxima.join(ridge.select(*keys, "px", "py").distinct(), [*keys, "px", "py"], "left_anti")


def touches_ground(slices: Column, lowest: int = 4) -> Column:
    """Whether any of the lowest slices is occupied."""
    return F.exists(slices, lambda s: s < lowest)


def non_max_suppression(df: DataFrame, ids: list[str], radius: float, on: list[str] | None = None) -> DataFrame:
    """Keypoints without an equal or stronger one (summary) within radius."""
    keys = list(dict.fromkeys([*(on or []), *ids]))
    pairs = spatial.radius_join(df, df.withColumn("strength", F.col("summary")), radius, [*ids, "summary"], [*ids, "strength"], on)
    same = F.lit(True)
    for i in ids:
        same = same & (F.col(f"q_{i}") == F.col(f"t_{i}"))
    beaten = pairs.filter(~same & (F.col("q_summary") <= F.col("t_strength"))).select(*(F.col(f"q_{k}").alias(k) for k in keys)).distinct()
    return df.join(beaten, keys, "left_anti")


def dice(a: Column, b: Column) -> Column:
    """Similarity of two sets of slices; 0 if both are empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def triangles(keypoints: DataFrame, near: int, shortest: float, longest: float, scale: float = 1.0, guess: float = 1.0, frame: str = "frame_id") -> DataFrame:
    """Triangles of each keypoint (frame, kp_id, x, y, z, slices) with pairs of its near - 1 nearest others of the frame.

    Sides are sorted (a <= b <= c, scaled), vertices follow them: va joins a and b, vb a and c, vc b and c. Sides outside of
    the bounds and nearly flat triangles go; of those equal in millimetres the first by (kp_id, pair) stays.
    """
    nn = spatial.knn_join(keypoints, keypoints, near - 1, guess, ["kp_id", "slices"], ["kp_id", "slices"], [frame], skip_self=True)
    corner = lambda s: F.struct(F.col(f"{s}_kp_id").alias("kp_id"), *(F.col(f"{s}_{c}").alias(c) for c in "xyz"), F.col(f"{s}_slices").alias("slices"))
    near_ = F.collect_list(F.struct("rank", corner("t").alias("k")))  # fewer than `near`
    each = nn.groupBy(F.col(f"q_{frame}").alias(frame), corner("q").alias("k1")).agg(near_.alias("_n"))
    two = F.flatten(F.transform("_n", lambda m: F.transform(F.filter("_n", lambda n: n["rank"] > m["rank"]), lambda n: F.struct(m.alias("m"), n.alias("n")))))
    pairs = each.withColumn("_p", F.explode(two)).select(frame, F.col("k1.kp_id").alias("p1"), F.col("_p.m.rank").alias("m"), F.col("_p.n.rank").alias("n"), "k1", F.col("_p.m.k").alias("k2"), F.col("_p.n.k").alias("k3"))
    v = lambda k: tuple(F.col(f"k{k}.{c}") for c in "xyz")
    side = lambda i, j: F.sqrt(g.sq_dist(v(i), v(j)))
    t = pairs.withColumn("_s", g.sorted_sides(side(1, 2), side(1, 3), side(2, 3)))
    a, b, c = (F.col("_s")[k]["len"] for k in range(3))
    t = t.filter((a >= shortest) & (c <= longest) & (F.abs(c - (a + b)) >= 0.2))
    shared = lambda i, j: F.when((F.col("_s")[i]["u"] == F.col("_s")[j]["u"]) | (F.col("_s")[i]["u"] == F.col("_s")[j]["v"]), F.col("_s")[i]["u"]).otherwise(F.col("_s")[i]["v"])
    pick = lambda which: F.when(which == 1, F.col("k1")).when(which == 2, F.col("k2")).otherwise(F.col("k3"))
    t = t.withColumns({"va": pick(shared(0, 1)), "vb": pick(shared(0, 2)), "vc": pick(shared(1, 2))})
    mm = [(s * 1000).cast("long") for s in (a, b, c)]
    w = Window.partitionBy(frame, *mm).orderBy("p1", "m", "n")
    t = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    centre = {f"c{x}": (F.col(f"va.{x}") + F.col(f"vb.{x}") + F.col(f"vc.{x}")) / 3 for x in "xyz"}
    t = t.withColumns({"a": a * scale, "b": b * scale, "c": c * scale, **centre})
    tri = F.struct("p1", "m", "n")
    return t.select(frame, tri.alias("tri_id"), "a", "b", "c", "cx", "cy", "cz", "va", "vb", "vc")


MEET = 1 << 22  # pairs of triangles of one cell that meet at one place, about


def _mask(slices: Column) -> Column:
    """Slices as the bits of a number; null if one is not from 0 to 63 or is there twice."""
    fits = (F.size(F.array_distinct(slices)) == F.size(slices)) & F.forall(slices, lambda k: (k >= 0) & (k < 64))
    return F.when(fits, F.aggregate(slices, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int")))))


def match_triangles(queries: DataFrame, base: DataFrame, skip_near: int, rough: float, similar: float, around: bool = True, frame: str = "frame_id") -> DataFrame:
    """(q_frame, t_frame, q_tri, t_tri, side_dist, similarity) of triangles with close sides and similar vertices.

    A target counts if its cell of sides (one unit wide) is the query's own or, if `around`, one of the 26 about it whose centre is
    within 1.5 of the query's sides; then come recency, side distance, at most `rough` times the size of the query, and
    vertices. As sides that near are much nearer than a cell, the equi-join is on boxes that grow by powers of two
    with the size: a query goes to the boxes of its own power that it reaches, two a side at most, and a target stands in the
    box of each power whose queries can reach it, so a pair meets once. Boxes of many pairs are counted first and dealt into parts.
    Frame and tri_id tell triangles of a table apart.
    """
    size = lambda: F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    power = lambda v: F.floor(F.log2(v)).cast("int")
    wide = 2 * F.pow(F.lit(2.0), F.col("_l")) * (2 * rough * (1 + 1e-9))  # twice what a query of this power reaches
    sides = [F.col(c) for c in "abc"]
    masks = lambda p: [_mask(F.col(f"v{c}.slices")).alias(f"{p}_m{c}") for c in "abc"]
    sound = lambda df: df.withColumn("_size", size()).filter(F.col("_size") > 0)  # noqa: E731  # a size of 0 reaches nothing
    q = sound(queries).withColumn("_l", power(F.col("_size"))).withColumn("_r", F.col("_size") * (rough * (1 + 1e-9)))
    for k, v in enumerate(sides):
        q = q.withColumn(f"_k{k}", F.explode(F.array_distinct(F.array(F.floor((v - F.col("_r")) / wide), F.floor((v + F.col("_r")) / wide)))))
    low, high = (power(F.col("_size") / (1 + s * rough * (1 + 1e-9))) for s in (1, -1))
    t = sound(base).withColumn("_l", F.explode(F.sequence(low, high) if rough < 0.9 else F.sequence(low, power(F.lit(1e300)))))
    for k, v in enumerate(sides):
        t = t.withColumn(f"_k{k}", F.floor(v / wide))
    box = ["_l", "_k0", "_k1", "_k2"]
    columns = lambda p: [F.col(frame).alias(f"{p}_frame"), F.col("tri_id").alias(f"{p}_tri"), *(F.col(c).alias(f"{p}_{c}") for c in "abc"), *(F.when(_mask(F.col(f"v{c}.slices")).isNull(), F.col(f"v{c}.slices")).alias(f"{p}_s{c}") for c in "abc"), *masks(p)]
    q, t = cut(q.select(*box, *columns("q"))), cut(t.select(*box, *columns("t")))
    pairs = q.groupBy(*box).agg(F.count("*").alias("_nq")).join(t.groupBy(*box).agg(F.count("*").alias("_nt")), box)
    many = cut(pairs.filter(F.col("_nq") * F.col("_nt") > MEET).select(*box, F.ceil(F.sqrt(F.col("_nq") * F.col("_nt") / MEET)).cast("int").alias("_n")))
    if many.limit(1).count():  # both sides of a full box are dealt, and every part of one meets every part of the other
        for p, other in ("qt", "tq"):
            own = F.coalesce(F.pmod(F.xxhash64(f"{p}_frame", f"{p}_tri"), F.col("_n")), F.lit(0)).cast("int").alias(f"_p{p}")
            every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)).alias(f"_p{other}")
            side = (q if p == "q" else t).join(many, box, "left")
            side = side.select(*[c for c in side.columns if c != "_n"], own, every)
            q, t = (side, t) if p == "q" else (q, side)
        box = [*box, "_pq", "_pt"]
    m = q.join(t, box).filter(F.col("q_frame") - F.col("t_frame") > skip_near)
    side = lambda p: [F.col(f"{p}_{c}") for c in "abc"]
    cell = lambda v: v.cast("int")
    dist = F.sqrt(sum(((x - y) ** 2 for x, y in zip(side("q"), side("t"), strict=True)), F.lit(0.0)))
    length = F.sqrt(sum((x * x for x in side("q")), F.lit(0.0)))
    m = m.withColumn("side_dist", dist).filter(F.col("side_dist") < length * rough)
    for x, y in zip(side("q"), side("t"), strict=True):
        m = m.filter(F.abs(cell(x) - cell(y)) <= (1 if around else 0))
    if around:
        gap = [x - (cell(y) + 0.5) for x, y in zip(side("q"), side("t"), strict=True)]
        m = m.filter(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] < 2.25)

    def slices(p: str, c: str) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftrightunsigned", F.col(f"{p}_m{c}"), k).bitwiseAND(F.lit(1)) == 1)
        return F.coalesce(F.col(f"{p}_s{c}"), bits)

    def like(c: str) -> Column:
        """dice() by bits where both have them."""
        x, y = F.col(f"q_m{c}"), F.col(f"t_m{c}")
        bits = F.coalesce(F.try_divide(2.0 * F.bit_count(x.bitwiseAND(y)), F.bit_count(x) + F.bit_count(y)), F.lit(0.0))
        return F.when(x.isNotNull() & y.isNotNull(), bits).otherwise(dice(slices("q", c), slices("t", c)))

    alike = sum((like(c) for c in "abc"), F.lit(0.0)) / 3
    m = m.withColumn("similarity", alike).filter(F.col("similarity") > similar)
    return m.select("q_frame", "t_frame", "q_tri", "t_tri", "side_dist", "similarity")


def votes(matches: DataFrame) -> DataFrame:
    """Matches of each pair of frames."""
    return matches.groupBy("q_frame", "t_frame").agg(F.count("*").alias("votes"))


def candidates(voted: DataFrame, most: int) -> DataFrame:
    """The target frames of most votes of each query frame, each with more than one; of equal ones the lower frame first."""
    w = Window.partitionBy("q_frame").orderBy(F.desc("votes"), "t_frame")
    return voted.filter("votes > 1").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def voxel_overlap(source: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """One row: points of the source that fall into occupied voxels of the target, voxels hit, and the score hits / points."""
    t = with_voxel(target, size).select(*VOX).distinct().withColumn("_hit", F.lit(1))
    per = with_voxel(source, size).groupBy(*VOX).agg(F.count("*").alias("k")).join(t, VOX, "left")
    hits = F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("k"))), F.lit(0))
    out = per.agg(hits.alias("hits"), F.count("_hit").alias("voxels"), F.coalesce(F.sum("k"), F.lit(0)).alias("points"))
    return out.withColumn("score", F.try_divide(F.col("hits").cast("double"), F.col("points")))


def line_like(df: DataFrame, keys: list[str], x: str, y: str, thin: float, long: float = 0.5) -> DataFrame:
    """(keys, small, large, is_line): the eigenvalues of the second moments of (x, y) about the origin, and whether the lesser is at most `thin` and the greater at least `long`."""
    m = df.groupBy(*keys).agg(F.avg(F.col(x) * F.col(x)).alias("_a"), F.avg(F.col(x) * F.col(y)).alias("_b"), F.avg(F.col(y) * F.col(y)).alias("_c"))
    half, root = (F.col("_a") + F.col("_c")) / 2, F.sqrt(((F.col("_a") - F.col("_c")) / 2) ** 2 + F.col("_b") ** 2)
    return m.select(*keys, (half - root).alias("small"), (half + root).alias("large")).withColumn("is_line", (F.col("small") <= thin) & (F.col("large") >= long))
