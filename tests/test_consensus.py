"""Rotation consensus and coplanar planes against all pairs."""

import collections

import numpy as np
import pytest

from pointframe.operators import fitting, planes, pose_graph


def _angles(r):
    trace = np.einsum("aij,bij->ab", r, r)
    return np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))


def _rotations(rng):
    """Clusters, half turns, and pairs just inside of and beyond ten degrees."""
    base = pose_graph.exp_all(rng.normal(size=(6, 3)) * 2)
    near = base[rng.integers(0, 6, 90)] @ pose_graph.exp_all(np.radians(rng.uniform(0, 12, (90, 1))) * _units(rng, 90))
    half = pose_graph.exp_all(np.pi * _units(rng, 20) * rng.uniform(0.97, 1.0, (20, 1)))
    axis = _units(rng, 20)
    edge = np.concatenate([base[:1] @ pose_graph.exp_all(np.radians(a) * axis) for a in (9.999999, 10.000001)])
    return np.concatenate([base, near, half, edge])


def _units(rng, n):
    v = rng.normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_near_rotations_equal_all_pairs(spark):
    r = _rotations(np.random.default_rng(4))
    df = spark.createDataFrame([(k % 2, k, m.ravel().tolist()) for k, m in enumerate(r)], "grp long, a long, rotation array<double>")
    got = fitting.near_rotations(df, df.withColumnRenamed("a", "b"), ["grp"], "a", "b", 10.0).collect()
    angle, group = _angles(r), np.arange(len(r)) % 2
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((angle < 10) & (group[:, None] == group)), strict=True)}
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want


def test_the_rotation_most_agree_with_is_taken(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for grp, (n, good) in enumerate([(30, 12), (30, 3), (450, 200), (4, 4)]):
        main, shift = pose_graph.exp_all(rng.normal(size=(1, 3)))[0], rng.normal(size=3)
        rots, pairs = [], []
        for k in range(n):
            q = rng.normal(size=(3, 3)) * 3
            ok = k % n < good if n < 100 else k % 2 == 0
            turn = main @ pose_graph.exp_all(np.radians(rng.uniform(0, 4)) * _units(rng, 1))[0] if ok else pose_graph.exp_all(rng.normal(size=(1, 3)) * 2)[0]
            t = q @ turn.T + shift
            pairs.append((q, t))
            rows.append((grp, k, q.ravel().tolist(), t.ravel().tolist()))
            rots.append(fitting.rigid_from_pairs(q, t))
        step = n // 200 + 1
        seeds = list(range(0, n, step))
        votes = (_angles(np.array([rots[k][0] for k in seeds])) < 10).sum(1)
        best = int(votes.argmax())
        if votes[best] >= 5:
            r, s = rots[seeds[best]]
            met = sum(bool((np.linalg.norm(q @ r.T + s - t, axis=1) < 5).all()) for q, t in pairs)
            if met >= 5:
                want[grp] = (seeds[best], int(votes[best]), met)
    df = spark.createDataFrame(rows, "grp long, pair long, q array<double>, t array<double>")
    got = {x.grp: (x.seed, x.agreeing, x.n_met) for x in fitting.rotation_consensus(df, ["grp"], "pair").collect()}
    assert got == want and {0, 2} <= set(want) and 3 not in want


def test_triangles_are_aligned_in_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for k in range(50)]
    for x in fitting.align_triangles(spark.createDataFrame(rows, "k long, q array<double>, t array<double>")).collect():
        r, t = fitting.rigid_from_pairs(np.reshape(x.q, (3, 3)), np.reshape(x.t, (3, 3)))
        np.testing.assert_allclose(np.reshape(x.rotation, (3, 3)), r, atol=1e-9)
        np.testing.assert_allclose(x["shift"], t, atol=1e-9)


@pytest.mark.parametrize("far", [1.0, 40.0])
def test_coplanar_labels_equal_those_of_whole_frames(spark, far):
    rng, rows = np.random.default_rng(7), []
    for frame in range(3):
        walls = [(v, rng.uniform(-far, far)) for v in _units(rng, 5)]
        for k in range(60):
            n, d = walls[k % 5]
            n = n + rng.normal(0, 0.04, 3)
            n /= np.linalg.norm(n)
            c = rng.uniform(-far, far, 3)
            c = c - walls[k % 5][0] * (c @ walls[k % 5][0] + d) + rng.normal(0, 0.1, 3)
            n = n if rng.random() < 0.5 else -n
            rows.append((frame, *(int(v) for v in rng.integers(-9, 9, 3)), *map(float, c), *map(float, n), float(-n @ c)))
    df = spark.createDataFrame(rows, "frame long, vx long, vy long, vz long, cx double, cy double, cz double, nx double, ny double, nz double, d double").dropDuplicates(["frame", "vx", "vy", "vz"])
    want, whole = {}, df.toPandas()
    for frame, pdf in whole.groupby("frame"):
        pdf = pdf.reset_index(drop=True)
        want |= {(frame, r.vx, r.vy, r.vz): int(label) for r, label in zip(pdf.itertuples(), planes.coplanar_labels(pdf), strict=True)}
    got = {(r.frame, r.vx, r.vy, r.vz): r.label for r in planes.label_coplanar(df, "frame", planes.VOX).collect()}
    assert got == want and max(collections.Counter(want.values()).values()) > 3


def test_proposals_of_a_vote_have_no_period(spark):
    """Every fourth pair is off; 200 pairs and 50 proposals are four pairs a proposal."""
    rng, rows = np.random.default_rng(11), []
    for k in range(200):
        q = rng.normal(size=(3, 3)) * 3
        t = q + np.array([1.0, 2.0, 3.0]) + (k + 10.0 if k % 4 == 0 else 0.0)
        rows.append((0, k, q.ravel().tolist(), t.ravel().tolist()))
    pairs = spark.createDataFrame(rows, "grp long, tri long, q array<double>, t array<double>")
    best = fitting.vote_transforms(pairs, ["grp"], "tri").collect()
    assert [(r["grp"], r["votes"]) for r in best] == [(0, 150)]
    assert best[0]["seed"] % 4 != 0 and np.allclose(best[0]["shift"], [1.0, 2.0, 3.0])


@pytest.mark.parametrize("around", [True, False])
def test_matches_of_full_boxes_equal_all_pairs(spark, monkeypatch, around):
    """Boxes are dealt into parts; slices may lie beyond the bits of a number."""
    monkeypatch.setattr(planes, "MEET", 40)
    rng, rows = np.random.default_rng(8), []
    for k in range(240):
        a, b, c = sorted(np.where(k % 3, rng.uniform(1.0, 2.2, 3), rng.uniform(0.2, 18, 3)))
        kinds = [sorted({int(v) for v in rng.integers(0, 6, 4)} | ({70} if k % 5 == 0 and n == 0 else set())) for n in range(3)]
        rows.append((k % 6, (k, 1, 2), float(a), float(b), float(c), *((s,) for s in kinds)))
    df = spark.createDataFrame(rows, "frame_id long, tri_id struct<p1: long, m: int, n: int>, a double, b double, c double, va struct<slices: array<int>>, vb struct<slices: array<int>>, vc struct<slices: array<int>>")
    want = set()
    for q in rows:
        for t in rows:
            x, y = np.array(q[2:5]), np.array(t[2:5])
            cells = np.abs(x.astype(int) - y.astype(int)).max() <= (1 if around else 0) and (not around or ((x - y.astype(int) - 0.5) ** 2).sum() < 2.25)
            alike = np.mean([2 * len(set(u[0]) & set(v[0])) / (len(u[0]) + len(v[0])) for u, v in zip(q[5:], t[5:], strict=True)])
            if q[0] - t[0] > 1 and cells and np.linalg.norm(x - y) < 0.08 * np.linalg.norm(x) and alike > 0.4:
                want.add((q[1][0], t[1][0]))
    got = [(r.q_tri.p1, r.t_tri.p1) for r in planes.match_triangles(df, df, 1, 0.08, 0.4, around).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
