"""Column geometry: rotations, poses, distances and keys, all inside whole-stage code.

A vector is a tuple of three columns; a matrix one of nine, by rows; a quaternion is (w, x, y, z).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = Sequence[Column]

EPS_SINGULAR = 1e-6  # below this cosine of pitch a matrix has no unique Euler angles
DEG_PER_RAD = 57.3  # the coarse factor that the degree outputs use


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def lit3(v: Sequence[float]) -> Vec:
    return tuple(F.lit(float(x)) for x in v)  # type: ignore[return-value]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def sq_dist(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def mat_vec(m: Mat, v: Vec) -> Vec:
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))  # type: ignore[return-value]


def mat_mul(a: Mat, b: Mat) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transpose(m: Mat) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def skew(v: Vec) -> list[Column]:
    """The matrix whose product with u is v x u."""
    o = F.lit(0.0)
    return [o, -v[2], v[1], v[2], o, -v[0], -v[1], v[0], o]


def quat_to_mat(q: Sequence[Column]) -> list[Column]:
    """The rotation of a unit quaternion."""
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def euler_to_quat(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """The quaternion of rotations about z, then y, then x, by half angles."""
    cr, sr, cp, sp, cy, sy = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(yaw / 2), F.sin(yaw / 2)
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def euler_to_mat(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    return quat_to_mat(euler_to_quat(roll, pitch, yaw))


def mat_to_euler(m: Mat) -> Vec:
    """(roll, pitch, yaw); where the pitch is upright, yaw is 0 by definition."""
    sy = F.sqrt(m[0] * m[0] + m[3] * m[3])
    upright = sy < EPS_SINGULAR
    return (
        F.when(upright, F.atan2(-m[5], m[4])).otherwise(F.atan2(m[7], m[8])),
        F.atan2(-m[6], sy),
        F.when(upright, F.lit(0.0)).otherwise(F.atan2(m[3], m[0])),
    )


def quat_to_euler_deg(q: Sequence[Column]) -> Vec:
    """(roll, pitch, yaw) in degrees by the coarse factor, with the two poles of pitch apart."""
    w, x, y, z = q
    unit = w * w + x * x + y * y + z * z
    test = w * y - z * x
    up, down = test > 0.49999 * unit, test < -0.49999 * unit
    roll = F.when(up | down, F.lit(0.0)).otherwise(F.atan2(2 * (y * z + w * x), w * w - x * x - y * y + z * z))
    pitch = F.when(up, F.pi() / 2).when(down, -F.pi() / 2).otherwise(F.asin(2 * test / unit))
    yaw = F.when(up, -2 * F.atan2(x, w)).when(down, 2 * F.atan2(x, w)).otherwise(F.atan2(2 * (x * y + w * z), w * w + x * x - y * y - z * z))
    return roll * DEG_PER_RAD, pitch * DEG_PER_RAD, yaw * DEG_PER_RAD


def so3_exp(v: Vec, least: float = 1e-7) -> list[Column]:
    """The rotation about v by its length (Rodrigues); the identity below a length of `least`."""
    n = norm(v)
    k = tuple(F.when(n > least, x / n).otherwise(F.lit(0.0)) for x in v)
    s, c = F.sin(n), 1 - F.cos(n)
    a = skew(k)
    aa = mat_mul(a, a)
    return [F.lit(float(i % 4 == 0)) + F.when(n > least, s * a[i] + c * aa[i]).otherwise(F.lit(0.0)) for i in range(9)]


def so3_log(m: Mat) -> Vec:
    """The rotation vector of a rotation; half the skew part where the angle is below 0.001."""
    trace = m[0] + m[4] + m[8]
    theta = F.when(trace > 3 - 1e-6, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    k = (m[7] - m[5], m[2] - m[6], m[3] - m[1])
    factor = F.when(F.abs(theta) < 0.001, F.lit(0.5)).otherwise(theta / (2 * F.sin(theta)))
    return tuple(factor * x for x in k)  # type: ignore[return-value]


def quat_mul(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    return [
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    ]


def quat_inv(q: Sequence[Column]) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def slerp(p: Sequence[Column], q: Sequence[Column], s: Column) -> list[Column]:
    """Spherical interpolation from p (s = 0) to q (s = 1) the short way; linear where they nearly agree."""
    d = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    c = F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(c)
    near = c > 1 - 1e-12
    f = F.when(near, 1 - s).otherwise(F.sin((1 - s) * theta) / F.sin(theta))
    g = F.when(near, s).otherwise(F.sin(s * theta) / F.sin(theta)) * F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [f * a + g * b for a, b in zip(p, q, strict=True)]


def transform(m: Mat, t: Vec, p: Vec) -> Vec:
    """m p + t."""
    return add(mat_vec(m, p), t)


def inverse(m: Mat, t: Vec) -> tuple[list[Column], Vec]:
    """The pose that undoes (m, t)."""
    r = transpose(m)
    back = mat_vec(r, t)
    return r, tuple(-x for x in back)  # type: ignore[return-value]


def compose(m1: Mat, t1: Vec, m2: Mat, t2: Vec) -> tuple[list[Column], Vec]:
    """First (m2, t2), then (m1, t1)."""
    return mat_mul(m1, m2), transform(m1, t1, t2)


def relative(m1: Mat, t1: Vec, m2: Mat, t2: Vec) -> tuple[list[Column], Vec]:
    """Pose 2 as seen from pose 1."""
    r, t = inverse(m1, t1)
    return compose(r, t, m2, t2)


def box_sq_dist(p: Vec, low: Vec, high: Vec) -> Column:
    """Squared distance of a point to a box; 0 inside."""
    gaps = [F.greatest(lo - x, x - hi, F.lit(0.0)) for x, lo, hi in zip(p, low, high, strict=True)]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def plane_axes(normal: Sequence[float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Two unit axes of a plane, from its normal: the first is (1, 1, c) or the nearest that lies in it, the second their cross product."""
    a, b, c = normal
    x = (1.0, 1.0, -(a + b) / c) if c else ((1.0, -a / b, 0.0) if b else (0.0, 1.0, 0.0))
    n = sum(v * v for v in x) ** 0.5
    x = tuple(v / n for v in x)
    y = (b * x[2] - c * x[1], c * x[0] - a * x[2], a * x[1] - b * x[0])
    n = sum(v * v for v in y) ** 0.5
    return x, tuple(v / n for v in y)


def voxel(v: Column, size: float) -> Column:
    """The voxel of a coordinate: the quotient, less 1 if it is negative, cut towards 0 (so -2.0 goes to -3)."""
    q = v / F.lit(float(size))
    return F.when(q < 0, q - 1).otherwise(q).cast("long")


def leaf(v: Column, size: float) -> Column:
    """The cell of a coordinate by floor."""
    return F.floor(v / F.lit(float(size))).cast("long")


def sorted_sides(a: Column, b: Column, c: Column) -> Column:
    """The sides of a triangle in ascending order, each with the vertices (1, 2, 3) that it joins: the side of p1-p2 is a, p1-p3 b, p2-p3 c."""
    side = lambda length, u, v: F.struct(length.alias("len"), F.lit(u).alias("u"), F.lit(v).alias("v"))
    return F.array_sort(F.array(side(a, 1, 2), side(b, 1, 3), side(c, 2, 3)))


def sensor_mat(roll: float, pitch: float, yaw: float) -> list[Column]:
    """A mounting rotation from angles in degrees, as literals."""
    import math

    r, p, y = (math.radians(v) for v in (roll, pitch, yaw))
    cr, sr, cp, sp, cy, sy = math.cos(r), math.sin(r), math.cos(p), math.sin(p), math.cos(y), math.sin(y)
    m = [cp * cy, sr * sp * cy - cr * sy, cr * sp * cy + sr * sy, cp * sy, sr * sp * sy + cr * cy, cr * sp * sy - sr * cy, -sp, sr * cp, cr * cp]
    return [F.lit(v) for v in m]
