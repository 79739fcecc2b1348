"""Loops: from keypoints to verified loop candidates, the score of a pair of clouds, and which loops may be used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g
from pointframe.operators import fitting, planes


def plane_share(points: DataFrame, keys: list[str], near: float = 0.3, tries: int = 50, seed: int = 7) -> DataFrame:
    """(keys, share): the largest share of a group's points within `near` of a plane through three of them.

    Proposals are triples of a seeded sample of 3 x tries points a group, taken by hash and found by a ranked window that
    keeps so many rows a task; every point is held against them in one pass. A group of fewer than three points, or of
    points in a line, has share 0.
    """
    w = Window.partitionBy(*keys).orderBy(F.xxhash64("x", "y", "z", F.lit(seed)), "x", "y", "z")
    some = points.select(*keys, "x", "y", "z").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 3 * tries)
    triple = some.groupBy(*keys, F.floor((F.col("_r") - 1) / 3).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("_r", "x", "y", "z"))).alias("p")).filter(F.size("p") == 3)
    a, b, c = (tuple(F.col("p")[k][x] for x in "xyz") for k in range(3))
    n = g.cross(g.sub(b, a), g.sub(c, a))
    plane = triple.withColumn("_l", g.norm(n)).filter(F.col("_l") > 1e-9)
    plane = plane.select(*keys, "_k", F.struct(*((v / F.col("_l")).alias(x) for v, x in zip(n, "xyz", strict=True)), (-g.dot(n, a) / F.col("_l")).alias("d")).alias("n"))
    each = plane.groupBy(*keys).agg(F.sort_array(F.collect_list("n")).alias("_planes"))  # at most `tries`
    met = points.select(*keys, "x", "y", "z").join(each, keys, "left")
    at = g.vec("x", "y", "z")
    plane_k = lambda k: F.get("_planes", F.lit(k))
    hit = lambda k: F.sum((F.abs(g.dot(tuple(plane_k(k)[c] for c in "xyz"), at) + plane_k(k)["d"]) < near).cast("long"))
    counts = met.groupBy(*keys).agg(F.count("*").alias("_n"), *(hit(k).alias(f"_h{k}") for k in range(tries)))
    return counts.select(*keys, F.coalesce(F.greatest(*(F.coalesce(f"_h{k}", F.lit(0)) for k in range(tries))) / F.col("_n"), F.lit(0.0)).alias("share"))


def overlap_scores(pairs: DataFrame, clouds: DataFrame, size: float, overlap: float = 0.5, plane: float | None = 0.75, near: float = 0.3) -> DataFrame:
    """(i, j, score, vetoed) of pairs (i, j, rotation: 9 numbers, shift: 3): points of i, moved into the frame of j, that fall
    into occupied voxels of j, over all points of i, times the ratio of the smaller to the larger number of points.

    A pair above `overlap` whose moved cloud is just a plane (a share of its points above `plane`) has score 0 and is vetoed.
    clouds are (frame_id, x, y, z); pairs with an empty cloud have score 0.
    """
    move = pairs.join(clouds.withColumnRenamed("frame_id", "i"), "i")
    at = g.transform([F.col("rotation")[k] for k in range(9)], tuple(F.col("shift")[k] for k in range(3)), g.vec("x", "y", "z"))
    moved = move.select("i", "j", *(v.alias(f"_{c}") for v, c in zip(at, "xyz", strict=True))).withColumnsRenamed({f"_{c}": c for c in "xyz"})
    number = clouds.groupBy("frame_id").agg(F.count("*").alias("n"))
    full = planes.with_voxel(clouds, size).select(F.col("frame_id").alias("j"), *planes.VOX).distinct().withColumn("_hit", F.lit(1))
    hits = planes.with_voxel(moved, size).join(full, ["j", *planes.VOX], "left").groupBy("i", "j").agg(F.count("_hit").alias("hits"))
    out = pairs.select("i", "j").join(hits, ["i", "j"], "left")
    for k in "ij":
        out = out.join(number.select(F.col("frame_id").alias(k), F.col("n").alias(f"n{k}")), k, "left")
    score = F.coalesce(F.col("hits") / F.col("ni") * F.least("ni", "nj") / F.greatest("ni", "nj"), F.lit(0.0))
    out = out.select("i", "j", score.alias("score"))
    if plane is None:
        return out.withColumn("vetoed", F.lit(False))
    flat = plane_share(moved.join(out.filter(F.col("score") > overlap).select("i", "j"), ["i", "j"], "left_semi"), ["i", "j"], near)
    veto = F.coalesce(F.col("share") > plane, F.lit(False))
    return out.join(flat, ["i", "j"], "left").select("i", "j", F.when(veto, F.lit(0.0)).otherwise(F.col("score")).alias("score"), veto.alias("vetoed"))


def detect_loops(
    keypoints: DataFrame, clouds: DataFrame, near: int = 6, shortest: float = 0.2, longest: float = 4.0, skip_near: int = 2, rough: float = 0.08, similar: float = 0.4, most: int = 3, agree: float = 3.0, least: int = 4, size: float = 0.5, accept: float = 0.3, plane: float | None = None
) -> DataFrame:
    """(i, j, votes, score, rotation, shift): for each frame i the earlier frame j that it meets again, if any.

    Triangles of keypoints are matched by sides and vertices; the frames of most votes are candidates; of each, the
    transform that most matched triangles agree with (at least `least`) moves cloud i into cloud j, and the candidate of
    the best score plus a thousandth of its votes is taken if its score alone is above `accept`. Frames without keypoints
    or matches have no row; of equal candidates the lower frame is taken.
    """
    t = planes.triangles(keypoints, near, shortest, longest)
    m = planes.match_triangles(t, t, skip_near, rough, similar)
    top = planes.candidates(planes.votes(m), most).select("q_frame", "t_frame")
    corner = F.flatten(F.array(*(F.array(*(F.col(f"v{v}.{c}") for c in "xyz")) for v in "abc")))
    side = lambda p, k: t.select(F.col("frame_id").alias(f"{p}_frame"), F.col("tri_id").alias(f"{p}_tri"), corner.alias(k))
    pairs = m.join(top, ["q_frame", "t_frame"]).join(side("q", "q"), ["q_frame", "q_tri"]).join(side("t", "t"), ["t_frame", "t_tri"])
    pairs = pairs.select("q_frame", "t_frame", F.struct("q_tri", "t_tri").alias("_id"), "q", "t")
    rank = F.row_number().over(Window.partitionBy("q_frame", "t_frame").orderBy("_id"))
    found = fitting.vote_transforms(pairs.withColumn("pair", rank.cast("long")), ["q_frame", "t_frame"], "pair", agree, least=least)
    found = found.select(F.col("q_frame").alias("i"), F.col("t_frame").alias("j"), "votes", "rotation", "shift")
    scored = found.join(overlap_scores(found, clouds, size, accept, plane), ["i", "j"])
    best = scored.groupBy("i").agg(F.max_by(F.struct("j", "votes", "score", "rotation", "shift"), F.struct(F.col("score") + F.col("votes") / 1000, -F.col("j"))).alias("b"))
    return best.select("i", "b.*").filter(F.col("score") > accept)


@dataclass
class LoopGate:
    """Which detected loops (frame, target, score, distance) are used, in order.

    A loop needs an overlap of at least `overlap`. The first one waits for another. Once more than two are known and none is
    waited for, one whose correction is longer than `long` of the path's largest extent waits for another, and one longer than
    `far` of it is left out; any other ends the waiting. A pair of frames is taken up once; a repeated one doesn't wait.
    """

    overlap: float = 0.5
    long: float = 0.1
    far: float = 0.5
    known: set[tuple[int, int]] = field(default_factory=set)
    waiting: bool = False

    def see(self, frame: int, target: int, score: float, distance: float, extent: float) -> str:
        """What becomes of a loop: "reject", "wait" or "use"; extent is the largest side of the path's bounds so far."""
        if score < self.overlap:
            return "reject"
        if not self.known:
            self.waiting = True
        elif len(self.known) > 2 and not self.waiting and distance > self.long * extent:
            if distance > self.far * extent:
                return "reject"
            self.waiting = True
        else:
            self.waiting = False
        fresh = (target, frame) not in self.known
        self.known.add((target, frame))
        return "wait" if fresh and self.waiting else "use"


@dataclass
class LoopState:
    """One step of a session's loop closing: the gate, loops that wait with their keypoints, and finding a prior session.

    A target below 0 is a frame of a prior session. A loop that is used takes up the loops that wait and are known, in order of
    arrival; those that aren't known go on waiting. Without a prior session all of them are added, and the graph is solved.
    With one (`prior`), `state` is -1 before it is tried to find the place in it, 0 while that isn't sure and 1 after:
    loops within the session are added; at -1 the second loop that is taken up, if it is against the prior session, is
    added with the one before it and the state is 0; at 1 the first one is added and the rest is passed over; what a step
    passes over is dropped, with all loops behind it. The graph is solved unless the state is -1. If a factor of the solution is off by
    more than `limit` it is rolled back: 0 goes back to -1, and two loops that contradict each other are both forgotten.
    A solution that stands makes 0 a 1.
    """

    gate: LoopGate = field(default_factory=LoopGate)
    prior: bool = False
    limit: float = 2.0
    state: int = -1
    waiting: list[tuple[int, int]] = field(default_factory=list)  # (target, frame)
    last: tuple[int, int] | None = None

    def see(self, frame: int, target: int, score: float, distance: float, extent: float, worst: float) -> tuple[str, list[tuple[int, int]], bool | None, int]:
        """(verdict, loops added to the graph, whether its solution stands, state) for a loop; worst is the largest error of
        a factor if the graph is solved with it."""
        pair = (target, frame)
        self.waiting.append(pair)
        verdict = self.gate.see(frame, target, score, distance, extent)
        if verdict != "use":
            if verdict == "reject":
                self.waiting.remove(pair)
            return verdict, [], None, self.state
        added = self._take_up()
        if self.prior and self.state == -1:
            return verdict, added, None, self.state
        stands = worst <= self.limit
        if not stands:
            if self.state == 0:
                self.state = -1
            if len(self.gate.known) == 2:
                self.gate.known.clear()
        elif self.state == 0:
            self.state = 1
        self.last = pair
        return verdict, added, stands, self.state

    def _take_up(self) -> list[tuple[int, int]]:
        added, left, n = [], [], 0
        for pair in self.waiting:
            if pair not in self.gate.known:
                left.append(pair)
                continue
            n += 1
            if not self.prior or pair[0] >= 0:
                added.append(pair)
            elif self.state == -1 and n == 2:
                added += [pair, self.last] if self.last else [pair]
                self.state = 0
                break
            elif self.state == -1 and n == 1:
                self.last = pair
            if self.prior and self.state == 1 and n == 1:
                if pair[0] < 0:
                    added.append(pair)
                break
        self.waiting = left
        return added


LOOPS = "session long, t_us long, frame long, target long, verdict string, added array<struct<target: long, frame: long>>, stands boolean, state int"
LOOP_COLUMNS = ["session", "t_us", "frame", "target", "score", "distance", "extent", "worst"]


def close_loops(found: DataFrame, prior: bool = False, limit: float = 2.0, overlap: float = 0.5) -> DataFrame:
    """What becomes of each loop of a table (session, t_us, frame, target, score, distance, extent, worst), a session a sequence.

    Loops go by time, then frame and target. Sessions run apart, each as one pass over its sorted rows.
    """
    from pointframe.streaming.fold import fold_sorted

    def step(state: LoopState, row: tuple) -> tuple:
        return (*row[:4], *state.see(*row[2:]))

    rows = found.select(*LOOP_COLUMNS)
    return fold_sorted(rows, "session", ["t_us", "frame", "target"], lambda _: LoopState(LoopGate(overlap), prior, limit), step, LOOPS)


def plane_pair_residuals(pairs: DataFrame) -> DataFrame:
    """One row of mean distances and normal differences of matched planes, for pairs of consecutive frames and for others.

    pairs are (source, target, s_* and t_*): each side has a centre (cx, cy, cz) and unit normal (nx, ny, nz) in the world. A
    normal's sign doesn't matter. Means over no pairs are null.
    """
    ns, nt = g.vec("s_nx", "s_ny", "s_nz"), g.vec("t_nx", "t_ny", "t_nz")
    dis = F.abs(g.dot(nt, g.sub(g.vec("s_cx", "s_cy", "s_cz"), g.vec("t_cx", "t_cy", "t_cz"))))
    turn = F.least(g.norm(g.add(ns, nt)), g.norm(g.sub(ns, nt)))
    near = F.col("source") - F.col("target") == 1
    return pairs.agg(F.avg(F.when(near, dis)).alias("near_distance"), F.avg(F.when(near, turn)).alias("near_normal"), F.avg(F.when(~near, dis)).alias("loop_distance"), F.avg(F.when(~near, turn)).alias("loop_normal"))


def evaluate_loops(found: DataFrame, truth: DataFrame, frames: DataFrame, poses: DataFrame, near: float = 10.0) -> DataFrame:
    """frames with found, match_frame, score, whether the match is within `near` of the frame's true place, and whether one was there to find.

    found is (i, j, score); truth (frame, is_loop); poses (frame, x, y, z); a frame that wasn't found has match_frame -1.
    """
    p = poses.select("frame", "x", "y", "z")
    out = frames.join(p, "frame").join(found.select(F.col("i").alias("frame"), F.col("j").alias("match_frame"), "score"), "frame", "left")
    other = p.select(F.col("frame").alias("match_frame"), *(F.col(c).alias(f"m{c}") for c in "xyz"))
    out = out.join(other, "match_frame", "left").join(truth.select("frame", "is_loop"), "frame", "left")
    right = F.coalesce(g.sq_dist(g.vec("x", "y", "z"), g.vec("mx", "my", "mz")) <= near * near, F.lit(False))
    return out.select(
        "frame", "x", "y", "z", F.col("match_frame").isNotNull().alias("found"), F.coalesce("match_frame", F.lit(-1)).alias("match_frame"), F.coalesce("score", F.lit(-1.0)).alias("score"), right.alias("right"), F.coalesce(F.col("is_loop").cast("boolean"), F.lit(False)).alias("is_loop")
    )

