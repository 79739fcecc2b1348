"""Sensor decoding, point filters and per-point projections."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g

def _scan():
    return Window.partitionBy("scan_id").orderBy("pt_idx")



def decode_livox(df: DataFrame, n_scans: int = 6, every: int = 1, blind: float = 0.01) -> DataFrame:
    """Livox points (scan_id, pt_idx, x, y, z, line, tag, offset_ns): valid returns, every n-th of them, without repeats.

    A point is kept if it differs from the raw point before it in x or y, or in z while it is further out than `blind`
    (a squared range). The raw point before counts as the origin unless it was itself taken. A scan's first point never is.
    """
    valid = (F.col("line") < n_scans) & (F.col("tag").bitwiseAND(0x30) == 0x10) & (F.col("_i") > 0)
    df = df.withColumn("_i", F.row_number().over(_scan()) - 1).withColumn("_v", valid)
    df = df.withColumn("_take", F.col("_v") & (F.sum(F.col("_v").cast("int")).over(_scan()) % every == 0))
    before = lambda c: F.when(F.lag("_take", 1, False).over(_scan()), F.lag(c).over(_scan())).otherwise(F.lit(0.0))
    df = df.withColumns({f"_p{c}": before(c) for c in "xyz"})
    moved = lambda c: F.abs(F.col(c) - F.col(f"_p{c}")) > 1e-7
    keep = moved("x") | moved("y") | (moved("z") & (F.col("x") ** 2 + F.col("y") ** 2 > blind))
    return df.filter(F.col("_take") & keep).withColumn("t_off_ms", F.col("offset_ns") / 1e6).drop("_i", "_v", "_take", "_px", "_py", "_pz")


def decode_ouster(df: DataFrame, every: int = 1, blind: float = 0.01) -> DataFrame:
    """Ouster points (scan_id, pt_idx, x, y, z, t_ns): every n-th raw index, squared range at least `blind`, time in ms."""
    i = F.row_number().over(_scan()) - 1
    return df.withColumn("_i", i).filter((F.col("_i") % every == 0) & (g.dot(g.vec(*"xyz"), g.vec(*"xyz")) >= blind)).withColumn("t_off_ms", F.col("t_ns") / 1e6).drop("_i")


def decode_hesai(df: DataFrame, n_scans: int = 32, blind: float = 0.01, max_ms: float = 100.0) -> DataFrame:
    """Hesai points (t_s, ring): time in ms, none later than max_ms, known rings, beyond `blind` (squared)."""
    df = df.withColumn("t_off_ms", F.col("t_s") * 1000.0)
    return df.filter((F.col("t_off_ms") <= max_ms) & (F.col("ring") < n_scans) & (g.dot(g.vec(*"xyz"), g.vec(*"xyz")) > blind))


def decode_velodyne(df: DataFrame, every: int = 1, blind: float = 0.01, omega: float = 3.61) -> DataFrame:
    """Velodyne points (scan_id, pt_idx, ring, x, y, z, t_us): their own times, or times rebuilt from azimuths.

    If a scan's last point has no time, a point's time is the angle swept since the first point of its ring (degrees) over
    omega (degrees a ms), a turn more whenever that would run backwards; first points of a ring then only start it.
    """
    last = Window.partitionBy("scan_id")
    df = df.withColumn("_given", F.max_by("t_us", "pt_idx").over(last) > 0).withColumn("_i", F.row_number().over(_scan()) - 1)
    yaw = F.atan2("y", "x") * 57.2957
    ring = Window.partitionBy("scan_id", "ring").orderBy("pt_idx")
    first = F.first("_yaw").over(ring)
    df = df.withColumn("_yaw", yaw).withColumn("_raw", F.when(F.col("_yaw") <= first, first - F.col("_yaw")).otherwise(first - F.col("_yaw") + 360.0) / omega)
    df = df.withColumn("_first", F.row_number().over(ring) == 1)
    # A turn is added each time the raw time falls below the one before; the carry is a running count.
    turn = F.when(F.lag("_raw", 1, 0.0).over(ring) > F.col("_raw"), 360.0 / omega).otherwise(0.0)
    df = df.withColumn("_turn", turn).withColumn("_rebuilt", F.col("_raw") + F.sum("_turn").over(ring))
    keep = F.col("_given") | ~F.col("_first")
    out = df.filter(keep & (F.col("_i") % every == 0) & (g.dot(g.vec(*"xyz"), g.vec(*"xyz")) > blind))
    return out.withColumn("t_off_ms", F.when(F.col("_given"), F.col("t_us") / 1000.0).otherwise(F.col("_rebuilt"))).drop("_given", "_i", "_yaw", "_raw", "_first", "_turn", "_rebuilt")


DECODERS: dict[str, Callable[..., DataFrame]] = {"livox": decode_livox, "ouster": decode_ouster, "hesai": decode_hesai, "velodyne": decode_velodyne}


def decode(sensor: str, df: DataFrame, **options) -> DataFrame:
    """Decode by sensor type."""
    if sensor not in DECODERS:
        raise ValueError(f"unknown sensor {sensor}; known: {', '.join(sorted(DECODERS))}")
    return DECODERS[sensor](df, **options)


def drop_wild_scans(df: DataFrame, limit: float = 1e6) -> DataFrame:
    """Without the scans that hold a coordinate beyond the limit: one wild point drops its whole scan."""
    wild = df.filter((F.abs("x") > limit) | (F.abs("y") > limit) | (F.abs("z") > limit)).select("scan_id").distinct()
    return df.join(wild, "scan_id", "left_anti")


def thin_to(df: DataFrame, budget: int) -> DataFrame:
    """Every n-th point of a scan, with the least n that brings it to the budget."""
    n = F.count("*").over(Window.partitionBy("scan_id"))
    i = F.row_number().over(_scan()) - 1
    return df.withColumn("_n", n).withColumn("_i", i).filter(F.col("_i") % F.ceil(F.col("_n") / budget) == 0).drop("_n", "_i")


def plane_projection(df: DataFrame, normal: tuple[float, float, float], center: tuple[float, float, float]) -> DataFrame:
    """df with dis, the distance from the plane, and u, v, the place in it."""
    a, b, c = normal
    d = -sum(n * p for n, p in zip(normal, center, strict=True))
    x_axis, y_axis = g.plane_axes(normal)
    p, nn = g.vec(*"xyz"), a * a + b * b + c * c
    signed = g.dot(g.lit3(normal), p) + d
    foot = tuple(v - F.lit(k / nn) * signed for v, k in zip(p, normal, strict=True))
    off = lambda axis: -sum(k * v for k, v in zip(axis, center, strict=True))
    return df.withColumns({"dis": F.abs(signed), "u": g.dot(g.lit3(y_axis), foot) + off(y_axis), "v": g.dot(g.lit3(x_axis), foot) + off(x_axis)})


def in_cone(p: g.Vec, origin: tuple[float, ...], axis: tuple[float, ...], half_angle: float, depth: float) -> Column:
    """Whether a point lies in a viewing cone: within the angle of the axis and no further than depth along it."""
    n = sum(v * v for v in axis) ** 0.5
    d = g.sub(p, g.lit3(origin))
    along = g.dot(d, g.lit3(tuple(v / n for v in axis)))
    return (along > 0) & (along <= depth) & (along >= g.norm(d) * math.cos(half_angle))


def segment_meets_cone(p: g.Vec, q: g.Vec, origin: tuple[float, ...], axis: tuple[float, ...], half_angle: float, depth: float) -> Column:
    """Whether the segment from p to q has a point in the viewing cone (half_angle below a right angle).

    What a segment has in common with the cone is one piece of it, which ends at an end of the segment, on the cone's side or at
    its depth; so it meets the cone if one of those places lies in it.
    """
    n = sum(v * v for v in axis) ** 0.5
    n_ = g.lit3(tuple(v / n for v in axis))
    c2 = math.cos(half_angle) ** 2
    d, l_ = g.sub(p, g.lit3(origin)), g.sub(q, p)
    dn, ln = g.dot(d, n_), g.dot(l_, n_)
    a, b, c = ln * ln - c2 * g.dot(l_, l_), dn * ln - c2 * g.dot(d, l_), dn * dn - c2 * g.dot(d, d)
    root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
    places = F.array(F.lit(0.0), F.lit(1.0), F.try_divide(-b + root, a), F.try_divide(-b - root, a), F.try_divide(-c, 2 * b), F.try_divide(F.lit(float(depth)) - dn, ln))

    def inside(s: Column) -> Column:
        at = tuple(x + s * y for x, y in zip(d, l_, strict=True))
        along = g.dot(at, n_)
        return (s >= 0) & (s <= 1) & (along > 0) & (along <= depth + 1e-9) & (along >= g.norm(at) * math.cos(half_angle) - 1e-9)

    return F.exists(F.filter(places, lambda s: s.isNotNull()), inside)


def surface_meets_cone(p: g.Vec, u: g.Vec, v: g.Vec, origin: tuple[float, ...], axis: tuple[float, ...], half_angle: float, depth: float) -> Column:
    """Whether a rectangle (corner p, sides u and v at right angles) is in view: an edge or its centre in the cone, or the cone's
    axis through it. A cone that touches the inside of a large rectangle with its flank alone isn't noticed."""
    n = sum(x * x for x in axis) ** 0.5
    n_, o = g.lit3(tuple(x / n for x in axis)), g.lit3(origin)
    cone = (origin, axis, half_angle, depth)
    corner = {(i, j): g.add(g.add(p, u) if i else p, v) if j else g.add(p, u) if i else p for i in (0, 1) for j in (0, 1)}
    edges = [((0, 0), (1, 0)), ((0, 0), (0, 1)), ((1, 0), (1, 1)), ((0, 1), (1, 1))]
    seen = in_cone(tuple((x + y) / 2 for x, y in zip(corner[0, 0], corner[1, 1], strict=True)), *cone)
    for i, j in edges:
        seen = seen | segment_meets_cone(corner[i], corner[j], *cone)
    w = g.cross(u, v)
    t = F.try_divide(g.dot(g.sub(p, o), w), g.dot(n_, w))
    hit = g.sub(tuple(x + t * y for x, y in zip(o, n_, strict=True)), p)
    within = lambda side: (g.dot(hit, side) >= 0) & (g.dot(hit, side) <= g.dot(side, side))
    return seen | F.coalesce((t >= 0) & (t <= depth) & within(u) & within(v), F.lit(False))


def box_meets_cone(low: g.Vec, high: g.Vec, origin: tuple[float, ...], axis: tuple[float, ...], half_angle: float, depth: float) -> Column:
    """Whether a box is in view: the sensor or the box's centre inside the other, or one of its faces in view."""
    cone = (origin, axis, half_angle, depth)
    side = [tuple(h - lo if k == i else F.lit(0.0) for k, (lo, h) in enumerate(zip(low, high, strict=True))) for i in range(3)]
    seen = in_cone(tuple((x + y) / 2 for x, y in zip(low, high, strict=True)), *cone)
    inside = F.lit(True)
    for x, lo, h in zip(origin, low, high, strict=True):
        inside = inside & (lo <= x) & (h >= x)
    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        seen = seen | surface_meets_cone(low, side[i], side[j], *cone) | surface_meets_cone(g.add(low, side[k]), side[i], side[j], *cone)
    return seen | inside


def segment_in_cone(ends: DataFrame, origin, axis, half_angle: float, depth: float) -> DataFrame:
    """ends (x1..z1, x2..z2) with in_view: whether the segment has a point in the cone."""
    return ends.withColumn("in_view", segment_meets_cone(g.vec("x1", "y1", "z1"), g.vec("x2", "y2", "z2"), origin, axis, half_angle, depth))


def cells_in_view(views: DataFrame, axis: tuple[float, ...], half_angle: float, depth: float, cell: float) -> DataFrame:
    """views (x, y, z and others), a row for each cell (cx, cy, cz) of a grid whose centre lies in the viewing cone from there.

    A view meets the cells of a cube of twice its depth, whose number doesn't depend on the data.
    """
    n = sum(v * v for v in axis) ** 0.5
    side = lambda c: F.sequence(F.floor((F.col(c) - depth) / cell), F.floor((F.col(c) + depth) / cell))
    at = views
    for c in "xyz":
        at = at.withColumn(f"c{c}", F.explode(side(c)))
    d = g.sub(tuple((F.col(f"c{c}") + 0.5) * cell for c in "xyz"), g.vec("x", "y", "z"))
    along = g.dot(d, g.lit3(tuple(v / n for v in axis)))
    return at.filter((along > 0) & (along <= depth) & (along >= g.norm(d) * math.cos(half_angle)))


FEATURE_SCHEMA = "scan_id long, ring int, pt_idx long, x double, y double, z double, feature string"


@dataclass(frozen=True)
class RingRules:
    """Limits of the ring features; angles in degrees, distances in the points' unit."""

    blind: float = 0.5  # nearer points are not looked at
    far: float = 10.0  # a point beyond it next to a blind one has infinity beside it
    group: int = 8  # least points of a run
    reach: float = 0.1  # a run grows to this part of its first point's range
    flat: float = 225.0  # squared length of a run over its squared width
    spread: float | None = 6.25  # of gaps: greatest to middle, middle to least; None: greatest to least below 3.24
    behind: float = 170.0
    ahead: float = 8.0
    corner: float = 160.0
    jump_ratio: float = 2.0
    jump_gap: float = 0.1
    straight: float = 172.5
    even: float = 1.2


def _run_end(p: np.ndarray, reach: float, r: np.ndarray, gap: np.ndarray, i: int, rules: RingRules) -> tuple[int, np.ndarray | None]:
    """(end, direction) of the run of points that begins at i; the direction is None if the run is no plane."""
    dark = np.flatnonzero(r[i : i + rules.group] < rules.blind)
    if len(dark):
        return i + int(dark[0]), None
    end = i + rules.group
    while end < len(p):
        chord = p[end] - p[i]
        if r[end] < rules.blind:
            return end, None
        if chord @ chord >= reach * reach:
            break
        end += 1
    last = min(end, len(p) - 1)
    chord = p[last] - p[i]
    length = float(chord @ chord)
    width = float((np.cross(p[i + 1 : end] - p[i], chord) ** 2).sum(1).max())
    if width and length * length / width < rules.flat:
        return end, None
    gaps = np.sort(gap[i:end])[::-1]
    most, middle, least = gaps[0], gaps[len(gaps) // 2], gaps[-2]
    if least < 1e-16 or (most / least >= 3.24 if rules.spread is None else max(most / middle, middle / least) >= rules.spread):
        return end, None
    return end, chord / np.sqrt(length) if length else None


PLAIN, MAYBE, PLANE, JUMP, CREASE, WIRE = range(6)
FEATURES = np.array(["plain", "plane", "plane", "edge", "edge", "wire"], dtype=object)


def ring_features(p: np.ndarray, rules: RingRules = RingRules()) -> np.ndarray:
    """The feature codes of the points of one ring in order.

    Runs of points that keep close to a line and to an even spacing are planes, whose ends are planes maybe; where two runs
    meet at an angle is a crease. Of other points, one beside a jump in depth is a jump edge if the points on its near side
    are evenly spaced, one with nothing on either side is a wire, and one in line with even neighbours makes all three a plane.
    """
    n = len(p)
    kind = np.zeros(n, np.int8)
    if n < 2:
        return kind
    r = np.hypot(p[:, 0], p[:, 1])
    gap = np.append(((p[1:] - p[:-1]) ** 2).sum(1), 0.0)
    lit = r >= rules.blind
    if not lit.any():
        return kind
    head = int(lit.argmax())
    i, before = head, None
    while i < n - rules.group:
        if not lit[i]:
            i += 1
            continue
        end, along = _run_end(p, rules.reach * r[i], r, gap, i, rules)
        if along is None:
            i, before = end + 1, None
            continue
        stop = min(end, n - 1)
        kind[i : stop + 1] = PLANE
        kind[[i, stop]] = MAYBE
        if before is not None:
            kind[i] = CREASE if abs(before @ along) < 0.707 else PLANE
        i, before = end, along
    cos = lambda a: np.cos(np.radians(a))
    # What is beside each point: something normal, nothing but more of the line of sight, or nothing to be seen.
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        sight = unit(p)
        to = {-1: np.zeros_like(p), 1: np.zeros_like(p)}
        to[-1][1:], to[1][:-1] = p[:-1] - p[1:], p[1:] - p[:-1]
        beside = {}
        for m in (-1, 1):
            angle = (sight * unit(to[m])).sum(1)
            dark = ~np.roll(lit, -m)
            beside[m] = np.select([dark & (r > rules.far), dark, angle < cos(rules.behind), angle > cos(rules.ahead)], ["inf", "blind", "behind", "ahead"], "normal")
            to[m][dark] = np.nan
        bend = (unit(to[-1]) * unit(to[1])).sum(1)
    root = np.sqrt(gap)
    even = lambda a, b: (np.maximum(a, b) <= rules.jump_ratio * np.minimum(a, b)) & (np.abs(a - b) <= rules.jump_gap)
    shift = lambda v, k: np.roll(v, -k)
    calm_before = even(shift(root, -1), shift(root, -2)) & shift(lit, -1) & shift(lit, -2)
    calm_after = even(root, shift(root, 1)) & shift(lit, 1) & shift(lit, 2)
    prev = shift(gap, -1)
    k = np.arange(n)
    judged = (k >= head + 3) & (k < n - 3) & lit & (kind < PLANE) & (prev >= 1e-16) & (gap >= 1e-16)
    left, right = beside[-1], beside[1]
    after = (left == "normal") & (right == "ahead") & (gap > 0.0225) & (gap > 4 * prev)
    ahead = (left == "ahead") & (right == "normal") & (prev > 0.0225) & (prev > 4 * gap)
    sharp = bend > cos(rules.corner)
    jump = (after & sharp & calm_before) | (ahead & sharp & calm_after) | ((left == "normal") & (right == "inf") & calm_before) | ((left == "inf") & (right == "normal") & calm_after)
    alone = (left != "normal") & (right != "normal") & ~after & ~ahead
    kind[judged & jump] = JUMP
    kind[judged & alone & (kind == PLAIN)] = WIRE
    small, large = np.minimum(prev, gap), np.maximum(prev, gap)
    line = judged & (k > head) & (k < n - 1) & lit & shift(lit, -1) & shift(lit, 1) & (small >= 1e-8) & (bend < cos(rules.straight)) & (large < rules.even * small)
    for i in np.flatnonzero(line).tolist():
        if kind[i] == PLAIN:  # each in turn: a point made part of a plane makes no plane of its own
            around = np.array([i - 1, i, i + 1])
            kind[around[kind[around] == PLAIN]] = PLANE
    return kind


def classify_ring(pdf: pd.DataFrame, rules: RingRules = RingRules()) -> pd.DataFrame:
    """plane, edge or wire for the points of one ring in order; others stay plain."""
    pdf = pdf.sort_values("pt_idx").reset_index(drop=True)
    return pdf.assign(feature=FEATURES[ring_features(pdf[["x", "y", "z"]].to_numpy(dtype=float), rules)])[["scan_id", "ring", "pt_idx", "x", "y", "z", "feature"]]


def classify(df: DataFrame) -> DataFrame:
    """Points (scan_id, ring, pt_idx, x, y, z) with the feature of each; a ring of a scan is one group, of bounded size by the sensor."""
    return df.groupBy("scan_id", "ring").applyInPandas(lambda pdf: classify_ring(pdf), FEATURE_SCHEMA)
