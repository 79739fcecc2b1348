"""Submaps that wait for their poses, and poses for their submaps, in batch and in streams.

A submap takes the first pose of its own id whose stamp is within `wait` of its own, whichever of the two arrives first. It
goes out as soon as no earlier pose can come any more; one that has none by its stamp plus `wait` goes out without a pose. A
pose without a submap is kept for as long and then forgotten. All of it goes by event time, so results don't depend on
how rows are dealt into micro-batches, as long as none is later than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pointframe.operators.temporal import asof_forward
from pointframe.streaming.fold import slot

KEY = ["session", "submap"]


def _plain(df: DataFrame, but: list[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in but]


def attach_poses(submaps: DataFrame, poses: DataFrame, wait_us: int) -> DataFrame:
    """submaps (session, submap, t_us, ...) with pose_t and the columns of their poses (session, submap, t_us, ...), null where none came in time.

    Of poses with equal stamps the one of least values is taken. Repeated submaps each have a row; null ids meet nothing.
    """
    cols = [f.name for f in _plain(poses, [*KEY, "t_us"])]
    key = F.struct(*KEY)
    left = submaps.withColumn("_key", key).withColumn("_from", F.col("t_us") - wait_us)
    right = poses.filter(F.col("session").isNotNull() & F.col("submap").isNotNull()).withColumn("_key", key).withColumn("_from", F.col("t_us"))
    near = asof_forward(left, right.select("_key", "_from", *cols), "_key", "_from", cols, "_p_")
    ok = F.col("_p_t") <= F.col("t_us") + wait_us
    return near.select(*submaps.columns, F.when(ok, F.col("_p_t")).alias("pose_t"), *(F.when(ok, F.col("_p_" + c)).alias(c) for c in cols))


class _Attach(StatefulProcessor):
    """The submaps of a group of keys that have no pose yet and the poses that a submap may still take."""

    def __init__(self, wait_us: int, keys: list[T.StructField], sub: list[T.StructField], pose: list[T.StructField]):
        self.wait, self.keys, self.sub, self.pose = wait_us, keys, sub, pose

    def init(self, handle: StatefulProcessorHandle) -> None:
        at = [*self.keys, T.StructField("t_us", T.LongType())]
        self.handle = handle
        self.subs = handle.getListState("submaps", T.StructType([*at, *self.sub]))
        self.poses = handle.getListState("poses", T.StructType([*at, *self.pose]))
        self.made = Row(*KEY, "t_us", *(f.name for f in self.sub), "pose_t", *(f.name for f in self.pose))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        subs, poses = [], []
        names = {k: [*KEY, "t_us", *(f"{k}_{f.name}" for f in fields)] for k, fields in (("s", self.sub), ("p", self.pose))}
        for row in rows:
            (subs if row["kind"] == "s" else poses).append(tuple(row[n] for n in names[row["kind"]]))
        yield from self._settle(timerValues, subs, poses)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(timerValues, [], [])

    def _settle(self, timers, subs: list[tuple], poses: list[tuple]) -> Iterator[Row]:
        seen = timers.getCurrentWatermarkInMs() * 1000  # whatever comes from now on is later than this
        subs += [tuple(s) for s in self.subs.get()]
        poses += [tuple(p) for p in self.poses.get()]
        of: dict[tuple, list[tuple]] = {}
        for p in poses:
            if None not in p[:2]:
                of.setdefault(p[:2], []).append(p)
        open_, due = [], []
        for s in subs:
            near = [p for p in of.get(s[:2], ()) if abs(p[2] - s[2]) <= self.wait]
            best = min(near, key=lambda p: (p[2], tuple((v is not None, v) for v in p[3:]))) if near else None
            sure = best[2] if best else s[2] + self.wait
            if sure <= seen:
                yield self.made(*s, *(best[2:] if best else [None] * (len(self.pose) + 1)))
            else:
                open_.append(s)
                due.append(sure)
        kept = [p for p in poses if p[2] + self.wait > seen]
        due += [p[2] + self.wait for p in kept]
        for state, now in ((self.subs, open_), (self.poses, kept)):
            if now:
                state.put(now)
            else:
                state.clear()
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    def close(self) -> None:
        pass


def attach_poses_stream(submaps: DataFrame, poses: DataFrame, wait_us: int, delay: str) -> DataFrame:
    """The same over two streams; rows are at most `delay` out of order.

    State is the waiting rows, from the arrival of a row until the watermark is past its stamp plus the wait. Keys have few
    rows each and are many, so they are kept and settled by groups of keys.
    """
    sub, pose = _plain(submaps, [*KEY, "t_us"]), _plain(poses, [*KEY, "t_us"])

    def side(df: DataFrame, kind: str) -> DataFrame:
        null = lambda f: F.lit(None).cast(f.dataType)
        cols = [(F.col(f.name) if kind == k else null(f)).alias(f"{k}_{f.name}") for k, fields in (("s", sub), ("p", pose)) for f in fields]
        return df.select(slot(*KEY).alias("slot"), *KEY, "t_us", F.lit(kind).alias("kind"), F.timestamp_micros("t_us").alias("ts"), *cols).withWatermark("ts", delay)

    both = side(submaps, "s").unionByName(side(poses, "p"))
    long = T.LongType()
    keys = [submaps.schema[k] for k in KEY]
    schema = T.StructType([*keys, T.StructField("t_us", long), *sub, T.StructField("pose_t", long), *pose])
    return both.groupBy("slot").transformWithState(_Attach(wait_us, keys, sub, pose), schema, "Append", "EventTime")
