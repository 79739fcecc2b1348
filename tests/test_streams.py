"""Streams against batch and brute force, whatever the order of arrival; graphs of many sessions against dense equations."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointframe.operators import loops, pose_graph
from pointframe.streaming import assembly, fold, rebuild
from pointframe.streaming import loops as loop_streams

S = 1_000_000


def _staged(spark, rows, schema, last, seed, slot):
    """A stream of rows (time third or second, by `slot`) in micro-batches that are out of order by up to two of them."""
    rng = random.Random(seed)
    out = [(*r, r[slot] // (25 * S) + rng.randrange(3)) for r in rows]
    return fold.staged(spark.createDataFrame([*out, (*last, 1 << 30)], schema + ", arrival long"), "arrival")[1]


def test_a_fold_carries_its_state_over_batches(spark):
    rows = [(k % 3, k, 1) for k in range(30_000)]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(5)

    def step(state, row):
        state[0] += row[2]
        return (row[0], row[1], state[0]) if row[1] % 1000 < 3 else None

    got = {(r.key, r.at): r.n for r in fold.fold_sorted(df, "key", ["at"], lambda _: [0], step, "key long, at long, n long").collect()}
    assert got == {(k % 3, k): k // 3 + 1 for k in range(30_000) if k % 1000 < 3}


def test_poses_in_time(spark):
    rng = random.Random(3)
    subs = [(rng.randrange(3), k, 1000 * S + k * S, f"c{k}") for k in range(40)]
    subs += [(*subs[5][:2], subs[5][2] + S, "again"), (*subs[6][:3], "same"), (None, 7, 1000 * S, "no session")]
    poses = [(s, k, t + rng.randrange(-40 * S, 40 * S), float(rng.randrange(9)) if rng.random() < 0.9 else None) for s, k, t, _ in subs for _ in range(rng.choice([0, 1, 1, 2]))]
    a, b = "session long, submap long, t_us long, cloud string", "session long, submap long, t_us long, x double"
    want = collections.Counter()
    for s, k, t, c in subs:
        near = [(p[2], p[3]) for p in poses if s is not None and p[:2] == (s, k) and abs(p[2] - t) <= 20 * S]
        want[(s, k, t, c, *(min(near, key=lambda p: (p[0], p[1] is not None, p[1] or 0)) if near else (None, None)))] += 1
    assert collections.Counter(map(tuple, assembly.attach_poses(spark.createDataFrame(subs, a), spark.createDataFrame(poses, b), 20 * S).collect())) == want
    keyed = [x for x in subs if x[0] is not None]
    known = collections.Counter({k: n for k, n in want.items() if k[0] is not None})
    for seed in (1, 2):
        left, right = _staged(spark, keyed, a, (-1, -1, 5000 * S, ""), seed, 2), _staged(spark, [p for p in poses if p[0] is not None], b, (-1, -1, 5000 * S, 0.0), seed + 9, 2)
        got = fold.run_available(assembly.attach_poses_stream(left, right, 20 * S, "90 seconds")).filter("session >= 0")
        assert collections.Counter(map(tuple, got.collect())) == known


def _closed(rows, prior, limit=2.0):
    """The rules of loop closing written out once more, for rows of one session in order."""
    known, wait, buffer, state, last, out = [], False, [], -1, None, []
    for _, t, frame, target, score, dist, extent, worst in rows:
        p, added, stands = (target, frame), [], None
        buffer.append(p)
        verdict = "use"
        if score < 0.5:
            verdict = "reject"
        elif not known:
            wait = True
        elif len(known) > 2 and not wait and dist > 0.1 * extent:
            if dist > 0.5 * extent:
                verdict = "reject"
            else:
                wait = True
        else:
            wait = False
        if verdict == "reject":
            buffer.remove(p)
        else:
            new = p not in known
            if new:
                known.append(p)
            if new and wait:
                verdict = "wait"
        if verdict == "use":
            count, rest, queue = 0, [], list(buffer)
            while queue:
                q = queue.pop(0)
                if q not in known:
                    rest.append(q)
                    continue
                count += 1
                if not prior:
                    added.append(q)
                    continue
                if q[0] >= 0:
                    added.append(q)
                elif count == 2 and state == -1:
                    added += [q] + ([last] if last else [])
                    state = 0
                    break
                elif count == 1 and state == -1:
                    last = q
                if count == 1 and state == 1:
                    added += [q] if q[0] < 0 else []
                    break
            buffer = rest
            if not prior or state > -1:
                stands = worst <= limit
                if stands:
                    state = 1 if state == 0 else state
                else:
                    state = -1 if state == 0 else state
                    if len(known) == 2:
                        known = []
                last = p
        out.append((t, frame, target, verdict, tuple(added), stands, state))
    return out


LOOPS = "session long, t_us long, frame long, target long, score double, distance double, extent double, worst double"


def _loops():
    rng = random.Random(3)
    return [(s, 1000 * S + k * 3 * S + rng.randrange(3) * S, k, rng.choice([k // 2, -(k % 5) - 1, -(k % 3) - 1]), rng.random() * 0.6 + 0.4, rng.random() * 60, 100.0, rng.random() * (2 + s)) for s in range(5) for k in range(35)]


@pytest.mark.parametrize("prior", [False, True])
def test_loops_are_closed_as_the_rules_say(prior):
    states = set()
    for s in range(5):
        rows = [r for r in _loops() if r[0] == s]
        for n in range(len(rows) + 1):  # every prefix
            state = loops.LoopState(prior=prior)
            got = [(*r[1:4], v, tuple(a), ok, st) for r in rows[:n] for v, a, ok, st in [state.see(*r[2:])]]
            assert got == _closed(rows[:n], prior)
            states |= {(x[3], x[5], x[6]) for x in got}
    assert not prior or {("use", False, -1), ("use", True, 1), ("wait", None, -1)} <= states  # refused at first, found later


def test_loop_streams_agree_with_batch(spark):
    rows = _loops()
    flat = lambda r: (r.session, r.t_us, r.frame, r.target, r.verdict, tuple(map(tuple, r.added)), r.stands, r.state)
    for prior in (False, True):
        batch = sorted(map(flat, loops.close_loops(spark.createDataFrame(rows, LOOPS).repartition(3), prior).collect()))
        want = sorted((s, *x) for s in range(5) for x in _closed(sorted(r for r in rows if r[0] == s), prior))
        assert batch == want
        stream = _staged(spark, rows, LOOPS, (99, 9000 * S, 0, 0, 0.0, 0.0, 0.0, 0.0), 4, 1)
        got = fold.run_available(loop_streams.close_loops_stream(stream, "90 seconds", prior)).filter("session < 90").collect()
        assert sorted(map(flat, got)) == want


def test_rotation_vectors_of_many():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(500, 3)), [[math.pi, 0, 0], [0, math.pi - 1e-9, 0], [1e-12, 0, 0], [0, 0, 0], [-2.0, 2.2, -0.9]]])
    v = np.where(np.linalg.norm(v, axis=1)[:, None] > math.pi, v * 0.3, v)
    r = pose_graph.exp_all(v)
    np.testing.assert_allclose(pose_graph.exp_all(pose_graph.log_all(r)), r, atol=1e-12)
    np.testing.assert_allclose(r @ r.transpose(0, 2, 1), np.broadcast_to(np.eye(3), r.shape), atol=1e-12)


def test_derivatives_of_factors():
    rng = np.random.default_rng(1)
    rot, pos = pose_graph.exp_all(rng.normal(size=(2, 3))), rng.normal(size=(2, 3))
    i, j, kind = np.zeros(8, int), np.ones(8, int), np.repeat([0, 1, 2, 3], 2)
    r, t = pose_graph.exp_all(rng.normal(size=(8, 3))), rng.normal(size=(8, 3))
    r[4:6, 1] *= 7  # a plane's centre
    e, a, b = pose_graph.linearise(rot, pos, i, j, kind, r, t)
    for frame, jac in ((0, a), (1, b)):
        for k in range(6):
            d = np.zeros((2, 6))
            d[frame, k] = 1e-6
            moved, _, _ = pose_graph.linearise(rot @ pose_graph.exp_all(d[:, :3]), pos + d[:, 3:], i, j, kind, r, t)
            np.testing.assert_allclose((moved - e) / 1e-6, jac[:, :, k], atol=1e-4)


def _dense(rot, pos, f, rounds=12):
    """Gauss-Newton with one dense matrix for all frames of a session."""
    n = len(rot)
    i, j, kind, r, t, w = f
    for _ in range(rounds):
        e, a, b = pose_graph.linearise(rot, pos, i, j, kind, r, t)
        h, g = 1e-9 * np.eye(6 * n), np.zeros(6 * n)
        h[:6, :6] += 1e9 * np.eye(6)
        for k in range(len(i)):
            jac = np.zeros((6, 6 * n))
            jac[:, 6 * i[k] : 6 * i[k] + 6], jac[:, 6 * j[k] : 6 * j[k] + 6] = a[k], b[k]
            h += w[k] * jac.T @ jac
            g -= w[k] * jac.T @ e[k]
        step = np.linalg.solve(h, g).reshape(n, 6)
        rot, pos = rot @ pose_graph.exp_all(step[:, :3]), pos + step[:, 3:]
    return rot, pos


def test_graphs_of_sessions_equal_the_dense_solution(spark):
    rng = np.random.default_rng(0)
    poses, factors, want = [], [], {}
    for s, n in ((0, 1), (1, 30), (2, 47)):
        rot, pos = pose_graph.exp_all(rng.normal(size=(n, 3))), 10 * rng.normal(size=(n, 3))
        pairs = [(k, k + 1, 0, 1.0) for k in range(n - 1)] + ([(3, 25, 0, 2.0), (5, 12, 0, 0.5), (10, n - 1, 0, 1.0), (2, 20, 1, 1.0), (7, 9, 1, 3.0)] if n > 1 else [])
        rows = []
        for a, b, kind, w in pairs:
            noise = 0.02 * rng.normal(size=3)
            if kind:
                p = rng.normal(size=3)
                rows.append((a, b, 1, [*p.tolist(), *[0.0] * 6], (rot[b].T @ (rot[a] @ p + pos[a] - pos[b]) + noise).tolist(), w))
            else:
                rows.append((a, b, 0, (rot[a].T @ rot[b] @ pose_graph.exp_all(noise[None])[0]).ravel().tolist(), (rot[a].T @ (pos[b] - pos[a]) + noise).tolist(), w))
        factors += [(s, 3 * a, 3 * b, *x) for a, b, *x in rows]
        start = rot @ pose_graph.exp_all(0.003 * np.arange(n)[:, None] * np.array([[1.0, -1, 2]])), pos + 0.03 * np.arange(n)[:, None]
        poses += [(s, 3 * k, start[0][k].ravel().tolist(), start[1][k].tolist()) for k in range(n)]
        f = (np.array([x[0] for x in rows], int), np.array([x[1] for x in rows], int), np.array([x[2] for x in rows], int), np.array([x[3] for x in rows]).reshape(-1, 3, 3), np.array([x[4] for x in rows]).reshape(-1, 3), np.array([x[5] for x in rows]))
        want[s] = _dense(*start, f) if rows else start
    factors.append((1, 0, 999, 0, np.eye(3).ravel().tolist(), [0.0] * 3, 1.0))  # no such frame
    p = spark.createDataFrame(poses, "session long, frame long, rotation array<double>, position array<double>")
    f = spark.createDataFrame(factors, pose_graph.FACTOR)
    got = pose_graph.solve_graphs(p, f, segment=24).collect()  # segments of eight frames
    assert len(got) == len(poses)
    for r in got:
        np.testing.assert_allclose(r.position, want[r.session][1][r.frame // 3], atol=1e-6)
        np.testing.assert_allclose(np.reshape(r.rotation, (3, 3)), want[r.session][0][r.frame // 3], atol=1e-6)
    assert pose_graph.solve_graphs(p.limit(0), f).count() == 0


def test_graphs_refuse_a_false_loop(spark):
    one = np.eye(3).ravel().tolist()
    p = spark.createDataFrame([(s, k, one, [float(k), 0.0, 0.0]) for s in range(2) for k in range(4)], "session long, frame long, rotation array<double>, position array<double>")
    step = [(s, k, k + 1, 0, one, [1.0, 0.0, 0.0], 1.0) for s in range(2) for k in range(3)]
    f = spark.createDataFrame([*step, (0, 0, 3, 0, one, [3.0, 0.0, 0.0], 1.0), (1, 0, 3, 0, one, [50.0, 0.0, 0.0], 1.0)], pose_graph.FACTOR)
    got = pose_graph.accept_graphs(p, f, segment=2).collect()
    assert {(r.session, r.accepted) for r in got} == {(0, True), (1, False)}
    assert all(np.allclose(r.position, [r.frame, 0, 0], atol=1e-9) for r in got)
    assert pose_graph.worst_errors(p, f).filter(F.col("session") == 1).first().worst == 47.0


def test_a_map_is_swapped_once_or_left(spark, tmp_path):
    one = [(0, f, k, 0.1 * k, float(f), 0.0) for f in range(3) for k in range(20)]
    pts = spark.createDataFrame(one, "session long, frame_id long, pt_idx long, x double, y double, z double")
    schema = "session long, frame_id long, x double, y double, z double, roll double, pitch double, yaw double"
    poses = spark.createDataFrame([(0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for f in range(3)], schema)
    store, calls = rebuild.MapStore(str(tmp_path / "map")), []
    store.start(poses, pts, 100.0, 1000)
    store.start(poses.limit(0), pts, 100.0, 1000)  # has begun already
    fits = rebuild.last_scan_fits(pts, fitness=2.0, rounds=2)

    def verify(m, p):
        calls.append(m.count())
        return fits(m, p)

    fix = lambda f, x: spark.createDataFrame([(0, f, x, 0.0, 0.0, 0.0, 0.0, 0.0)], schema)
    place = lambda: {r.frame_id: r.x for r in store.map(spark).filter("pt_idx = 0").collect()}
    assert store.version(spark) == 0 and place() == {0: 0.0, 1: 0.0, 2: 0.0}
    assert store.apply(fix(1, 0.5), 0, pts, 100.0, 1000, verify) is True
    assert store.version(spark) == 1 and place() == {0: 0.0, 1: 0.5, 2: 0.0}
    assert store.apply(fix(1, 0.7), 0, pts, 100.0, 1000, verify) is None and place()[1] == 0.5  # run again: nothing changes
    assert store.apply(fix(2, 300.0), 1, pts, 1e6, 1000, verify) is False  # the last scan fits nothing any more
    assert store.version(spark) == 1 and place() == {0: 0.0, 1: 0.5, 2: 0.0} and len(calls) == 2
    with pytest.raises(RuntimeError):  # fails before its commit
        store.apply(fix(0, 0.2), 2, pts, 100.0, 1000, lambda m, p: (_ for _ in ()).throw(RuntimeError("lost")))
    assert store.version(spark) == 1 and place()[0] == 0.0
    assert store.apply(fix(0, 0.2), 2, pts, 100.0, 1000, verify) is True and place() == {0: 0.2, 1: 0.5, 2: 0.0}
    assert [(r.batch, r.accepted) for r in store.commits(spark).orderBy("batch").collect()] == [(-1, True), (0, True), (1, False), (2, True)]


def test_short_sessions_are_solved_whole_and_as_by_segments(spark, monkeypatch):
    rng, poses, factors = np.random.default_rng(31), [], []
    for s, n in ((0, 1), (1, 12), (2, 40)):
        rot, pos = pose_graph.exp_all(rng.normal(size=(n, 3))), 5 * rng.normal(size=(n, 3))
        for a, b in [(k, k + 1) for k in range(n - 1)] + ([(1, n - 2), (0, n // 2)] if n > 1 else []):
            off = 0.02 * rng.normal(size=(1, 3))
            factors.append((s, a, b, 0, (rot[a].T @ rot[b] @ pose_graph.exp_all(off)[0]).ravel().tolist(), (rot[a].T @ (pos[b] - pos[a]) + off[0]).tolist(), 1.0))
        moved = pos + 0.02 * np.arange(n)[:, None]
        poses += [(s, k, rot[k].ravel().tolist(), moved[k].tolist()) for k in range(n)]
    p = spark.createDataFrame(poses, "session long, frame long, rotation array<double>, position array<double>")
    f = spark.createDataFrame(factors, pose_graph.FACTOR)
    solve = lambda whole: {(r.session, r.frame): [*r.rotation, *r.position] for r in pose_graph.solve_graphs(p, f, 8, whole=whole).collect()}
    parts, mixed = solve(0), solve(20)

    def refuse(*args):
        raise AssertionError("short sessions need no segments")

    monkeypatch.setattr(pose_graph, "_by_segments", refuse)
    for got in (mixed, solve(40)):
        assert got.keys() == parts.keys() and len(got) == 53
        for k, v in got.items():
            np.testing.assert_allclose(v, parts[k], atol=1e-6)


def test_streams_of_small_keys_in_batches_of_several_files(spark, monkeypatch):
    monkeypatch.setattr(fold, "FILE_ROWS", 60)
    big = (1 << 60) + 1
    subs = [(k % 7 if k % 5 else None, k, 1000 * S + k * S, big + k) for k in range(200)]
    poses = [(s, k, t + 3 * S, big + 3 * k) for s, k, t, _ in subs if k % 3]
    a, b = "session long, submap long, t_us long, cloud long", "session long, submap long, t_us long, mark long"
    want = {(s, k, t, c, *((t + 3 * S, big + 3 * k) if k % 3 and s is not None else (None, None))) for s, k, t, c in subs}
    ends = [(-1, -1, 9000 * S, 0)]
    batch = lambda rows: [(*r, 9 if r[0] == -1 else 2 if r[1] == 199 else r[1] // 150) for r in [*rows, *ends]]
    home, left = fold.staged(spark.createDataFrame(batch(subs), a + ", arrival long").repartition(8), "arrival")
    _, right = fold.staged(spark.createDataFrame(batch(poses), b + ", arrival long"), "arrival")
    assert len(spark.read.parquet(home).inputFiles()) == 4 * 3  # four micro-batches of three files, some of them without rows
    got = fold.run_available(assembly.attach_poses_stream(left, right, 20 * S, "300 seconds"))
    assert {tuple(r) for r in got.collect() if r.session != -1} == want  # null ids meet nothing, long values stay whole
    rows = [(k % 40, 1000 * S + k * S, k, -(k % 3) - 1 if k % 2 else k // 2, 0.4 + k % 7 / 10, k % 50, 100.0, k % 4) for k in range(200)]
    flat = lambda r: (r.session, r.t_us, r.frame, r.target, r.verdict, tuple(map(tuple, r.added)), r.stands, r.state)
    late = spark.createDataFrame([(*r[:4], *map(float, r[4:]), r[2] // 70) for r in rows] + [(99, 9000 * S, 0, 0, 0.0, 0.0, 0.0, 0.0, 9)], LOOPS + ", arrival long")
    closed = fold.run_available(loop_streams.close_loops_stream(fold.staged(late, "arrival")[1], "90 seconds", True)).filter("session < 90")
    assert sorted(map(flat, closed.collect())) == sorted(map(flat, loops.close_loops(late.drop("arrival").filter("session < 90"), True).collect()))


def _rings(rng, sizes):
    """Sessions of one ring each, whose poses have drift: (starts, rot, pos, factors), the first frames as they should be."""
    starts, rots, poss, rows = np.append(0, np.cumsum(sizes)), [], [], []
    for lo, n in zip(starts, sizes, strict=False):
        rot, pos, k = pose_graph.exp_all(rng.normal(size=(n, 3))), 5 * rng.normal(size=(n, 3)), np.arange(n)[:, None]
        for a, b in [(x, (x + 1) % n) for x in range(n if n > 2 else n - 1)]:
            off = 0.01 * rng.normal(size=(1, 3))
            rows.append((lo + a, lo + b, 0, rot[a].T @ rot[b] @ pose_graph.exp_all(off)[0], rot[a].T @ (pos[b] - pos[a]) + off[0], 1.0 + a % 3))
        rots.append(rot @ pose_graph.exp_all(0.002 * k * np.array([[1.0, -1, 2]])))
        poss.append(pos + 0.02 * k)
    return starts, np.concatenate(rots), np.concatenate(poss), [np.array(x) for x in zip(*rows, strict=True)]


def test_sessions_side_by_side_need_no_dense_systems(monkeypatch):
    starts, rot, pos, f = _rings(np.random.default_rng(7), [120, 1, 2, 90, 3, 120])
    sides, solve = [], np.linalg.solve
    with monkeypatch.context() as m:
        m.setattr(np.linalg, "solve", lambda a, b: sides.append(a.shape[-1]) or solve(a, b))
        got = pose_graph.Sessions(starts, rot.copy(), pos.copy(), *f)
        got.solve(10)
    assert max(sides) <= 6 * 8  # a ring of 120 frames has 720 unknowns, and spans two places of a good order
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        own = (f[0] >= lo) & (f[0] < hi)
        np.testing.assert_array_less(np.abs(got.pos[lo] - pos[lo]).max(), 1e-12)  # the first frame stays
        if own.any():
            want = _dense(rot[lo:hi], pos[lo:hi], [x[own] - lo if k < 2 else x[own] for k, x in enumerate(f)])
            np.testing.assert_allclose(got.pos[lo:hi], want[1], atol=1e-6)
            np.testing.assert_allclose(got.rot[lo:hi], want[0], atol=1e-6)


def test_sessions_of_rows_over_many_batches(spark, monkeypatch):
    starts, rot, pos, f = _rings(np.random.default_rng(8), [40, 3, 25, 1, 30])
    of = lambda x: int(np.searchsorted(starts, x, "right")) - 1
    poses = [(of(k), int(k - starts[of(k)]), rot[k].ravel().tolist(), pos[k].tolist()) for k in range(len(rot))]
    factors = [(of(a), int(a - starts[of(a)]), int(b - starts[of(a)]), int(k), r.ravel().tolist(), t.tolist(), float(w)) for a, b, k, r, t, w in zip(*f, strict=True)]
    p = spark.createDataFrame(poses, "session long, frame long, rotation array<double>, position array<double>")
    solve = lambda: {(r.session, r.frame): r.position for r in pose_graph.solve_graphs(p, spark.createDataFrame(factors, pose_graph.FACTOR)).collect()}
    whole = solve()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        parts = solve()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts.keys() == whole.keys() and len(parts) == 99
    for k, v in parts.items():
        np.testing.assert_allclose(v, whole[k], atol=1e-9)


def test_planes_of_frames_are_neither_shuffled_nor_written(spark, sf_dir):
    import os

    from pointframe import plans

    home = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(home) for x in names)
    had = size()
    got = plans.QUERIES["fac10_plane_adjustment"](spark, sf_dir)
    assert size() - had < 100_000  # eight planes a frame are more than a megabyte
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("RepartitionByExpression") == 1
