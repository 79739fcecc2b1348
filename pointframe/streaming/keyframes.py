"""Stateful streams: keyframe windows with gates, epochs, submap assembly, and tables that corrections rewrite."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.streaming.fold import fold_sorted

KEYFRAME = "session long, keyframe long, t_us long, n_scans long, scans array<long>"
KEYFRAME_STATE = "keyframe long, count long, last array<double>, scans array<long>, seen_t long"
TURN = ("qw", "qx", "qy", "qz")


@dataclass
class Gate:
    """One step of the keyframe window, the same in batch and in streams.

    Every scan joins the buffer before it is judged; while the count is 0 the buffer holds the newest scan only. A step of
    more than `jump` drops the scan from the count and moves the reference; one that is shorter than `still` and turns by
    less than `turn` degrees is not counted and leaves the reference. The window closes with the `window`-th accepted scan.
    Time that runs backwards starts a new epoch with an empty buffer.
    """

    window: int = 10
    still: float = 0.2
    jump: float = 5.0
    turn: float = 5.0
    keyframe: int = 0
    count: int = 0
    last: list[float] | None = None  # position and attitude (w, x, y, z) of the reference
    scans: list[int] = field(default_factory=list)
    seen: int | None = None

    def step(self, scan: int, t: int, pose: list[float]) -> list[int] | None:
        if self.seen is not None and t < self.seen:
            self.count, self.scans = 0, []
        self.seen = t
        if self.count == 0:
            self.scans = []
        self.scans.append(scan)
        last = self.last or [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
        moved = math.dist(pose[:3], last[:3])
        if moved > self.jump:
            self.last = pose
            return None
        if moved < self.still:
            alike = abs(sum(a * b for a, b in zip(pose[3:], last[3:], strict=True)))
            if 2 * math.degrees(math.acos(min(1.0, alike))) < self.turn:
                return None
        self.last = pose
        if self.count < self.window - 1:
            self.count += 1
            return None
        self.count = 0
        done, self.keyframe = self.scans, self.keyframe + 1
        return done


def _run(gate: Gate, session: int, pdf: pd.DataFrame, arrival: str | None) -> list[list]:
    out = []
    pdf = pdf.sort_values([arrival] if arrival else ["t_us", "id"])
    turn = [c for c in TURN if c in pdf.columns]
    if len(turn) < 4:
        pdf, turn = pdf.assign(_w=1.0, _o=0.0), ["_w", "_o", "_o", "_o"]
    poses = np.stack([pdf[c].to_numpy(dtype=float) for c in ("x", "y", "z", *turn)], 1).tolist()
    for scan, t, pose in zip(pdf["id"].tolist(), pdf["t_us"].tolist(), poses, strict=True):
        done = gate.step(scan, t, pose)
        if done is not None:
            out.append([session, gate.keyframe, t, len(done), done])
    return out


_COLS = ["session", "keyframe", "t_us", "n_scans", "scans"]


def keyframes_batch(poses: DataFrame, window: int = 10, still: float = 0.2, jump: float = 5.0, turn: float = 5.0, arrival: str | None = None) -> DataFrame:
    """Keyframes of (session, id, t_us, x, y, z and, if there, the attitude qw, qx, qy, qz); a session is a sequence, sessions run apart.

    Scans are taken by time or, with `arrival`, in order of that column, in which time may run backwards.
    """

    turn_cols = [c for c in TURN if c in poses.columns]
    pose = [*(F.col(c).cast("double") for c in "xyz"), *((F.col(c).cast("double") for c in TURN) if len(turn_cols) == 4 else map(F.lit, (1.0, 0.0, 0.0, 0.0)))]
    order = [arrival] if arrival else ["t_us", "id"]
    rows = poses.select("session", "id", "t_us", F.array(*pose).alias("_pose"), *(c for c in order if c not in ("t_us", "id")))

    def step(gate: Gate, row: tuple) -> tuple | None:
        done = gate.step(row[1], row[2], [float(v) for v in row[3]])
        return None if done is None else (row[0], gate.keyframe, row[2], len(done), done)

    return fold_sorted(rows, "session", order, lambda _: Gate(window, still, jump, turn), step, KEYFRAME)


def keyframes_stream(poses: DataFrame, window: int = 10, still: float = 0.2, jump: float = 5.0, turn: float = 5.0, arrival: str | None = None) -> DataFrame:
    """The same over a stream: the gate of each session is its state, with the scans of the open window.

    Within a micro-batch scans are taken by time or in order of `arrival`; a scan older than the last one starts a new epoch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gate = Gate(window, still, jump, turn)
        if state.exists:
            gate.keyframe, gate.count, last, scans, gate.seen = state.get
            gate.last, gate.scans = (list(last) if len(last) else None), list(scans)
        pdf = pd.concat(list(batches), ignore_index=True)
        if len(pdf):
            rows = _run(gate, int(key[0]), pdf, arrival)
            state.update((gate.keyframe, gate.count, gate.last or [], gate.scans, gate.seen))
            if rows:
                yield pd.DataFrame(rows, columns=_COLS)

    return poses.groupBy("session").applyInPandasWithState(run, KEYFRAME, KEYFRAME_STATE, "append", "NoTimeout")


def epochs_stream(rows: DataFrame, on: str, order: str, t: str) -> DataFrame:
    """A stream of sensor rows (scans or inertial samples) with epoch: how often time has run backwards so far, by key.

    Rows of a micro-batch are taken in order of `order`; a new epoch means that what was buffered before is void.
    """
    names = rows.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        epoch, seen = state.get if state.exists else (0, -(1 << 62))
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order)
        if len(pdf):
            times = np.concatenate([[seen], pdf[t].to_numpy()])
            epochs = epoch + np.cumsum(times[1:] < times[:-1])
            state.update((int(epochs[-1]), int(times[-1])))
            yield pdf.assign(epoch=epochs)[[*names, "epoch"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(on).applyInPandasWithState(run, f"{fields}, epoch long", "epoch long, seen long", "append", "NoTimeout")


def publish(rows: DataFrame, path: str, checkpoint: str):
    """Start writing a stream (clouds, odometry or a path) as Parquet, exactly once; what is there is gone through and the query ends."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def join_clouds_and_poses(clouds: DataFrame, odometry: DataFrame, wait: str = "10 seconds") -> DataFrame:
    """Stream-stream join on equal session and event time; an unmatched row waits until the watermark passes it."""
    c = clouds.withWatermark("ts", wait).alias("c")
    o = odometry.withWatermark("ts", wait).alias("o")
    return c.join(o, F.expr("c.session = o.session AND c.ts = o.ts")).select("c.*", *(F.col(f"o.{x}") for x in odometry.columns if x not in clouds.columns))


def submaps(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (session, t_us, ..) with submap, the first marker (session, submap, t_us) at or after them: what a marker closes."""
    from pointframe.operators.temporal import asof_forward

    return asof_forward(points, marks, "session", "t_us", ["submap"], "m_").withColumnRenamed("m_submap", "submap").drop("m_t")


def correct_versions(current: DataFrame, corrections: DataFrame, version: int) -> DataFrame:
    """The pose table (session, frame_id, x, y, z, version) after a correction; rows it names get a new version, the old ones stay for rollback."""
    new = corrections.withColumn("version", F.lit(version)).select(*current.columns)
    return current.unionByName(new)


def latest(poses: DataFrame, at_most: int | None = None) -> DataFrame:
    """The pose of each frame in its newest version, or in the newest that isn't later than a given one (a rollback)."""
    p = poses if at_most is None else poses.filter(F.col("version") <= at_most)
    best = p.groupBy("session", "frame_id").agg(F.max_by(F.struct(*[c for c in poses.columns if c not in ("session", "frame_id")]), "version").alias("p"))
    return best.select("session", "frame_id", "p.*")


def near_submaps(frames: DataFrame, here: DataFrame, reach: float, used: DataFrame) -> DataFrame:
    """Frames within reach of the current place of their session (here: session, x, y, z) that this correction hasn't used."""
    h = here.select("session", *(F.col(c).alias(f"_h{c}") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"_h{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return frames.join(h, "session").filter(d2 <= reach * reach).drop("_hx", "_hy", "_hz").join(used.select("session", "frame_id"), ["session", "frame_id"], "left_anti")


def rebuild_map(points: DataFrame, poses: DataFrame, here: DataFrame, reach: float, budget: int, verify) -> tuple[DataFrame, bool]:
    """The map after a correction: points of near frames at their corrected places, thinned to a budget a frame, kept only if verify(map) holds.

    Poses are (session, frame_id, x, y, z, version) and, if there, roll, pitch and yaw; points are in the frames' bodies.
    """
    from pointframe.operators.points import thin_to

    near = near_submaps(latest(poses), here, reach, poses.limit(0))
    angles = [F.col(c) if c in poses.columns else F.lit(0.0) for c in ("roll", "pitch", "yaw")]
    where = near.select("session", "frame_id", *(F.col(c).alias(f"_p{c}") for c in "xyz"), F.array(*g.euler_to_mat(*angles)).alias("_m"))
    at = points.join(where, ["session", "frame_id"])
    moved = g.transform([F.col("_m")[k] for k in range(9)], g.vec("_px", "_py", "_pz"), g.vec("x", "y", "z"))
    at = at.withColumns(dict(zip("xyz", moved, strict=True))).drop("_px", "_py", "_pz", "_m")
    new = thin_to(at.withColumn("scan_id", F.col("frame_id")), budget)
    return (new, True) if verify(new) else (points, False)


@dataclass
class LocalMap:
    """The cube of the map around the sensor; move() gives the boxes that leave it when it follows.

    The cube moves along each axis on which the sensor is within `threshold` times the detection range of a face, the lower
    face first; the boxes are cut from the cube as it was before.
    """

    edge: float = 200.0
    reach: float = 50.0  # detection range
    threshold: float = 1.5
    low: np.ndarray | None = None

    def move(self, at: tuple[float, float, float]) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
        p = np.asarray(at, dtype=float)
        if self.low is None:
            self.low = p - self.edge / 2
            return []
        margin = self.threshold * self.reach
        step = max((self.edge - 2 * margin) * 0.5 * 0.9, self.reach * (self.threshold - 1))
        gone, was = [], self.low.copy()
        for k in range(3):
            low, high = was.copy(), was + self.edge
            if abs(p[k] - was[k]) <= margin:
                low[k] = high[k] - step
                self.low[k] -= step
            elif abs(p[k] - was[k] - self.edge) <= margin:
                high[k] = low[k] + step
                self.low[k] += step
            else:
                continue
            gone.append((tuple(low.tolist()), tuple(high.tolist())))
        return gone
