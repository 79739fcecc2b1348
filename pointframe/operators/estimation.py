"""State estimation on a manifold: process model, prediction with covariance, measurement sums and the iterated update.

A state is position, attitude, mounting attitude and offset of the sensor, velocity, gyroscope and accelerometer biases, and
gravity, whose length is fixed. Errors have 23 entries in the order of SLOTS: rotations as rotation vectors on the right,
gravity as two angles about axes across it. Measurement rows are summed by the engine (12 x 12); what is solved is 23 x 23.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.functions import geom as g

SLOTS = {"pos": slice(0, 3), "rot": slice(3, 6), "mount_rot": slice(6, 9), "mount_pos": slice(9, 12), "vel": slice(12, 15), "gyro_bias": slice(15, 18), "acc_bias": slice(18, 21), "grav": slice(21, 23)}
SIZE = 23
#: Variances of gyroscope, accelerometer and their biases.
NOISE = np.repeat([1e-4, 1e-4, 1e-5, 1e-5], 3)


def hat(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0.0]])


def exp_so3(v: np.ndarray) -> np.ndarray:
    a, k = float(np.linalg.norm(v)), hat(v)
    if a < 1e-8:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k


def log_so3(r: np.ndarray) -> np.ndarray:
    """The rotation vector, near half turns too."""
    w = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    s, c = float(np.linalg.norm(w)), (np.trace(r) - 1) / 2
    a = float(np.arctan2(s, c))
    if s > 1e-6:
        return w * (a / s)
    if c > 0:
        return w
    axis = np.sqrt(np.maximum((np.diag(r) + 1) / 2, 0))
    k = int(axis.argmax())
    axis = np.where(np.arange(3) == k, axis, (r[k] + r[:, k]) / 4 / max(axis[k], 1e-12))
    return a * axis / np.linalg.norm(axis)


def right_jacobian(v: np.ndarray) -> np.ndarray:
    """d of a rotation vector's exponential, on its right."""
    a, k = float(np.linalg.norm(v)), hat(v)
    if a < 1e-6:
        return np.eye(3) - k / 2 + k @ k / 6
    return np.eye(3) - (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * k @ k


def across(v: np.ndarray) -> np.ndarray:
    """Two unit axes across v, as columns; they turn with v without a jump but where v points down the last axis."""
    n = v / np.linalg.norm(v)
    s = 1.0 if n[2] >= 0 else -1.0
    a = -1.0 / (s + n[2])
    b = n[0] * n[1] * a
    return np.array([[1 + s * n[0] * n[0] * a, b], [s * b, s + n[1] * n[1] * a], [-s * n[0], -n[1]]])


@dataclass
class State:
    pos: np.ndarray = field(default_factory=lambda: np.zeros(3))
    rot: np.ndarray = field(default_factory=lambda: np.eye(3))
    mount_rot: np.ndarray = field(default_factory=lambda: np.eye(3))
    mount_pos: np.ndarray = field(default_factory=lambda: np.zeros(3))
    vel: np.ndarray = field(default_factory=lambda: np.zeros(3))
    gyro_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    acc_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    grav: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -9.81]))

    def plus(self, d: np.ndarray) -> State:
        out = {}
        for name, at in SLOTS.items():
            x, e = getattr(self, name), d[at]
            out[name] = x @ exp_so3(e) if x.ndim == 2 else exp_so3(across(x) @ e) @ x if name == "grav" else x + e
        return State(**out)

    def minus(self, other: State) -> np.ndarray:
        """d with other.plus(d) equal to self."""
        d = np.zeros(SIZE)
        for name, at in SLOTS.items():
            x, y = getattr(self, name), getattr(other, name)
            if x.ndim == 2:
                d[at] = log_so3(y.T @ x)
            elif name == "grav":
                turn = np.cross(y, x)
                s = float(np.linalg.norm(turn))
                d[at] = across(y).T @ turn * (np.arctan2(s, float(x @ y)) / s if s > 1e-12 else 1 / float(x @ x))
            else:
                d[at] = x - y
        return d


def flow(x: State, gyro: np.ndarray, acc: np.ndarray) -> dict[str, np.ndarray]:
    """Rates of the state for inertial readings; what isn't named stays."""
    return {"pos": x.vel, "rot": gyro - x.gyro_bias, "vel": x.rot @ (acc - x.acc_bias) + x.grav}


def flow_by_state(x: State, acc: np.ndarray) -> np.ndarray:
    """d flow by the error of the state: rates in the places of SLOTS, 23 x 23."""
    out = np.zeros((SIZE, SIZE))
    out[SLOTS["pos"], SLOTS["vel"]] = np.eye(3)
    out[SLOTS["rot"], SLOTS["gyro_bias"]] = -np.eye(3)
    out[SLOTS["vel"], SLOTS["rot"]] = -x.rot @ hat(acc - x.acc_bias)
    out[SLOTS["vel"], SLOTS["acc_bias"]] = -x.rot
    out[SLOTS["vel"], SLOTS["grav"]] = -hat(x.grav) @ across(x.grav)
    return out


def flow_by_noise(x: State) -> np.ndarray:
    """d flow by the noise of gyroscope, accelerometer and both biases, 23 x 12."""
    out = np.zeros((SIZE, 12))
    out[SLOTS["rot"], 0:3] = -np.eye(3)
    out[SLOTS["vel"], 3:6] = -x.rot
    out[SLOTS["gyro_bias"], 6:9] = np.eye(3)
    out[SLOTS["acc_bias"], 9:12] = np.eye(3)
    return out


def predict(x: State, p: np.ndarray, gyro: np.ndarray, acc: np.ndarray, dt: float, noise: np.ndarray = NOISE) -> tuple[State, np.ndarray]:
    """The state and covariance after dt, at constant rates."""
    f = flow(x, gyro, acc)
    turn = f["rot"] * dt
    after = replace(x, pos=x.pos + f["pos"] * dt, rot=x.rot @ exp_so3(turn), vel=x.vel + f["vel"] * dt)
    by_x, by_w = flow_by_state(x, acc) * dt, flow_by_noise(x) * dt
    # A rate of rotation reaches the error at the end through the right Jacobian; the error before is turned back.
    by_x[SLOTS["rot"]], by_w[SLOTS["rot"]] = right_jacobian(turn) @ by_x[SLOTS["rot"]], right_jacobian(turn) @ by_w[SLOTS["rot"]]
    step = np.eye(SIZE)
    step[SLOTS["rot"], SLOTS["rot"]] = exp_so3(-turn)
    step += by_x
    return after, step @ p @ step.T + (by_w * noise) @ by_w.T


STATES = "session long, t_us long, pos array<double>, rot array<double>, vel array<double>, variance array<double>"


def _exp_all(v: np.ndarray) -> np.ndarray:
    """exp_so3 of many vectors."""
    a, k = np.linalg.norm(v, axis=1)[:, None, None], _hat_all(v)
    small = a < 1e-8
    b = np.where(small, 1.0, a)
    return np.eye(3) + np.where(small, 1.0, np.sin(b) / b) * k + np.where(small, 0.5, (1 - np.cos(b)) / b**2) * (k @ k)


def _right_jacobian_all(v: np.ndarray) -> np.ndarray:
    a, k = np.linalg.norm(v, axis=1)[:, None, None], _hat_all(v)
    small = a < 1e-6
    b = np.where(small, 1.0, a)
    return np.eye(3) - np.where(small, 0.5, (1 - np.cos(b)) / b**2) * k + np.where(small, 1 / 6, (b - np.sin(b)) / b**3) * (k @ k)


def _hat_all(v: np.ndarray) -> np.ndarray:
    x, y, z = v.T
    o = np.zeros(len(v))
    return np.stack([o, -z, y, z, o, -x, -y, x, o], 1).reshape(-1, 3, 3)


def predict_runs(x: State, pos: np.ndarray, rot: np.ndarray, vel: np.ndarray, p: np.ndarray, run: np.ndarray, gyro: np.ndarray, acc: np.ndarray, dt: np.ndarray, noise: np.ndarray = NOISE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """predict() along many runs side by side: (positions, attitudes, velocities, variances) after each row.

    pos, rot, vel and p (a covariance each) hold the states before and, when it returns, after the runs; rows are those of
    run 0 in order, then of run 1, and so on; `run` is a row's run. What predict() leaves as it is is taken from x.
    """
    n, turn, rate = len(run), (gyro - x.gyro_bias) * dt[:, None], acc - x.acc_bias
    spin, back, right = _exp_all(turn), _exp_all(-turn), _right_jacobian_all(turn)
    at = np.arange(n) - np.searchsorted(run, run)  # a row's place in its run
    steps = [order[lo:hi] for order in [np.argsort(at, kind="stable")] for lo, hi in itertools.pairwise(np.searchsorted(at[order], np.arange(at.max(initial=-1) + 2)))]
    before, out_pos, out_rot, out_vel, var = np.empty((n, 3, 3)), np.empty((n, 3)), np.empty((n, 3, 3)), np.empty((n, 3)), np.empty((n, SIZE))
    for k in steps:
        r, t = run[k], dt[k, None]
        before[k] = rot[r]
        pos[r], vel[r], rot[r] = pos[r] + vel[r] * t, vel[r] + ((rot[r] @ rate[k, :, None])[..., 0] + x.grav) * t, rot[r] @ spin[k]
        out_pos[k], out_rot[k], out_vel[k] = pos[r], rot[r], vel[r]
    # The step of the error is the identity but for these blocks, as in predict().
    s, t = SLOTS, dt[:, None, None]
    skew, fixed = -before @ _hat_all(rate) * t, -hat(x.grav) @ across(x.grav)
    for k in steps:
        step = np.tile(np.eye(SIZE), (len(k), 1, 1))
        step[:, s["pos"], s["vel"]] = np.eye(3) * t[k]
        step[:, s["rot"], s["rot"]], step[:, s["rot"], s["gyro_bias"]] = back[k], -right[k] * t[k]
        step[:, s["vel"], s["rot"]], step[:, s["vel"], s["acc_bias"]], step[:, s["vel"], s["grav"]] = skew[k], -before[k] * t[k], fixed * t[k]
        now = step @ p[run[k]] @ step.transpose(0, 2, 1)
        sq = dt[k, None, None] ** 2
        now[:, s["rot"], s["rot"]] += sq * (right[k] * noise[0:3]) @ right[k].transpose(0, 2, 1)
        now[:, s["vel"], s["vel"]] += sq * (before[k] * noise[3:6]) @ before[k].transpose(0, 2, 1)
        now[:, s["gyro_bias"], s["gyro_bias"]] += sq * np.diag(noise[6:9])
        now[:, s["acc_bias"], s["acc_bias"]] += sq * np.diag(noise[9:12])
        p[run[k]] = now
        var[k] = np.diagonal(now, axis1=1, axis2=2)
    return out_pos, out_rot, out_vel, var


IMU = ["gx", "gy", "gz", "ax", "ay", "az"]


def propagate_states(imu: DataFrame, start: State | None = None, variance: float = 1e-4) -> DataFrame:
    """States of each session along its inertial samples (t_us, gx..gz, ax..az), by midpoint readings, with the diagonal of the covariance.

    A session is a sequential recurrence; sessions run apart. Its first row is the start; a session of one sample has one row.
    A task reads its sessions in batches of sorted rows and takes those of a batch side by side; the last one's state is
    carried to the next batch, so a long session takes time but no memory.
    """
    x0 = start or State()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # session, time, readings, and the state after them
        for b in batches:
            if not b.num_rows:
                continue
            session, t = b.column("session"), b.column("t_us").to_numpy()
            u = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in IMU], 1).astype(float)
            key = session.fill_null(0).to_numpy(), session.is_null().to_numpy(zero_copy_only=False)
            first = np.ones(len(t), bool)
            first[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
            of, m = np.cumsum(first) - 1, int(first.sum())
            pos, rot, vel, p = (np.tile(v, (m,) + (1,) * v.ndim).astype(float) for v in (x0.pos, x0.rot, x0.vel, variance * np.eye(SIZE)))
            gone = last is not None and last[0] == (key[0][0], key[1][0])
            had_t, had_u = np.append(last[1] if gone else 0, t[:-1]), np.concatenate([last[2][None] if gone else u[:1], u[:-1]])
            if gone:
                first[0] = False
                pos[0], rot[0], vel[0], p[0] = last[3]
            mid, dt = (had_u + u) / 2, (t - had_t) / 1e6
            made = [pos[of], rot[of], vel[of], np.diagonal(p, axis1=1, axis2=2)[of]]
            k = np.flatnonzero(~first)
            for whole, part in zip(made, predict_runs(x0, pos, rot, vel, p, of[k], mid[k, :3], mid[k, 3:], dt[k]), strict=True):
                whole[k] = part
            last = (key[0][-1], key[1][-1]), t[-1], u[-1], (pos[-1], rot[-1], vel[-1], p[-1])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * (v.size // len(t))), pa.array(v.ravel())) for v in made]
            yield pa.RecordBatch.from_arrays([session, b.column("t_us"), *lists], names=["session", "t_us", "pos", "rot", "vel", "variance"])

    rows = imu.select("session", "t_us", *IMU)
    return rows.repartition("session").sortWithinPartitions("session", "t_us").mapInArrow(run, STATES)


H = [f"h{k}" for k in range(12)]


def measurement_rows(points: DataFrame, x: State) -> DataFrame:
    """points (x, y, z in the sensor; plane nx, ny, nz, d in the world) with residual and h0..h11, its derivatives by the
    errors of position, attitude, mounting attitude and offset."""
    mat = lambda m: [F.lit(float(v)) for v in m.reshape(-1)]
    p, n = g.vec("x", "y", "z"), g.vec("nx", "ny", "nz")
    body = g.transform(mat(x.mount_rot), g.lit3(x.mount_pos), p)
    world = g.transform(mat(x.rot), g.lit3(x.pos), body)
    c = g.mat_vec(mat(x.rot.T), n)
    a, b = g.cross(body, c), g.cross(p, g.mat_vec(mat(x.mount_rot.T), c))
    return points.withColumns({"residual": g.dot(n, world) + F.col("d"), **dict(zip(H, [*n, *a, *b, *c], strict=True))})


def measurement_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(H^T H, H^T residual, number of rows), summed by the engine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns H, residual and ones, so that one product a batch has all sums and the count.
        total = np.zeros((14, 14))
        for b in batches:
            if b.num_rows:
                m = np.stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns), np.ones(b.num_rows)], 1)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(14 * 14, dtype=np.int32)), pa.array(total.ravel())], names=["k", "v"])

    parts = rows.select(*H, "residual").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 196 numbers
    s = np.zeros(14 * 14)
    for r in parts:
        s[r["k"]] = r["v"]
    s = s.reshape(14, 14)
    return s[:12, :12], s[:12, 12], round(s[13, 13])


def update(x: State, p: np.ndarray, measure: Callable[[State], tuple[np.ndarray, np.ndarray, int]], noise: float = 1e-3, rounds: int = 4, still: float = 1e-3) -> tuple[State, np.ndarray]:
    """The state and covariance after an iterated update; measure gives the sums at a state, noise is a row's variance.

    Each round solves for the step that minimises prior and measurement error, both linear about the latest state; the
    prior's error is carried there by its derivative. It ends when no entry of a step is above `still`.
    """
    prior, now = np.linalg.inv(p), x
    post = p
    for _ in range(rounds):
        hth, htr, n = measure(now)
        d = now.minus(x)
        by = np.eye(SIZE)  # d of (now.plus(e) minus x) by e
        for name in ("rot", "mount_rot"):
            by[SLOTS[name], SLOTS[name]] = np.linalg.inv(right_jacobian(d[SLOTS[name]]))
        for k in range(2):
            e = np.zeros(SIZE)
            e[21 + k] = 1e-6
            by[SLOTS["grav"], 21 + k] = (now.plus(e).minus(x)[SLOTS["grav"]] - d[SLOTS["grav"]]) / 1e-6
        left = by.T @ prior @ by
        right = by.T @ prior @ d
        left[:12, :12] += hth / noise
        right[:12] += htr / noise
        post = np.linalg.inv(left)
        step = -post @ right
        now = now.plus(step)
        if not n or np.abs(step).max() < still:
            break
    return now, post


def corrected_state(x: State, fit: tuple[np.ndarray, np.ndarray], correction: tuple[np.ndarray, np.ndarray], turn_velocity: np.ndarray | None = None) -> tuple[State, dict[str, list[float]]]:
    """The state after a loop correction and the notice of it: the pose becomes fit * correction, velocities are turned if the session is relocated.

    The notice has the pose before and after: three angles (roll, pitch, yaw) and the position.
    """
    rot, pos = fit[0] @ correction[0], fit[0] @ correction[1] + fit[1]
    after = replace(x, rot=rot, pos=pos, vel=x.vel if turn_velocity is None else turn_velocity @ x.vel)

    def pose(s: State) -> list[float]:
        m = s.rot
        level = float(np.hypot(m[0, 0], m[1, 0]))
        roll, yaw = (np.arctan2(m[2, 1], m[2, 2]), np.arctan2(m[1, 0], m[0, 0])) if level >= 1e-6 else (np.arctan2(-m[1, 2], m[1, 1]), 0.0)
        return [float(roll), float(np.arctan2(-m[2, 0], level)), float(yaw), *s.pos.tolist()]

    return after, {"before": pose(x), "after": pose(after)}
