"""Properties and brute-force checks of the library's own operators."""

import collections
import math
import random
import struct
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointframe.functions import geom as g
from pointframe.functions.packets import LAYOUTS, decode_packet
from pointframe.operators import estimation, fitting, index, loops, planes, points, spatial, temporal
from pointframe.sources import readers
from pointframe.streaming import keyframes as kf


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(-5, 5, (400, 3))
    return spark.createDataFrame(pd.DataFrame({"scan_id": np.arange(400) % 3, "pt_idx": np.arange(400), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})), p


def test_knn_is_exact_for_any_guess(cloud):
    df, p = cloud
    q = df.filter("pt_idx < 60")
    for guess in (0.05, 1.0, 30.0):
        got = {(r.q_pt_idx, r["rank"]): r.d2 for r in spatial.knn_join(q, df, 5, guess, ["pt_idx"], ["pt_idx"], skip_self=True).collect()}
        for i in range(60):
            d = np.sort(((p - p[i]) ** 2).sum(1))[1:6]
            assert np.allclose([got[i, k] for k in range(1, 6)], d, atol=1e-9)


def test_knn_of_a_far_query_and_with_a_condition(cloud, monkeypatch):
    df, p = cloud
    monkeypatch.setattr(spatial, "MAX_ROUNDS", 2)  # most queries end with all targets
    q = df.filter("pt_idx < 30").withColumn("x", F.col("x") + 1000)
    nn = spatial.knn_join(q, df, 3, 0.01, ["pt_idx"], ["pt_idx"], where=(F.col("q_pt_idx") + F.col("t_pt_idx")) % 2 == 0)
    got = collections.defaultdict(list)
    for r in sorted(nn.collect(), key=lambda r: r["rank"]):
        got[r.q_pt_idx].append(r.t_pt_idx)
    for k in range(30):
        d2 = ((p - (p[k] + [1000, 0, 0])) ** 2).sum(1) + 1e9 * ((np.arange(400) + k) % 2)
        assert got[k] == np.argsort(d2, kind="stable")[:3].tolist()


def test_knn_with_fewer_targets_than_k(cloud):
    df, _ = cloud
    got = spatial.knn_join(df.filter("pt_idx < 2"), df.filter("pt_idx < 3"), 5, 0.1, ["pt_idx"], ["pt_idx"])
    assert got.count() == 6


def test_radius_includes_its_end(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0000001, 0.0, 0.0)], "id long, x double, y double, z double")
    got = spatial.radius_join(df.filter("id = 0"), df, 1.0, ["id"], ["id"])
    assert sorted(r.t_id for r in got.collect()) == [0, 1]


def test_suppression_leaves_nobody_beaten(cloud):
    df, p = cloud
    kept = planes.non_max_suppression(df.withColumn("summary", (F.col("pt_idx") % 13).cast("int")), ["pt_idx"], 1.5).select("pt_idx").toPandas()["pt_idx"].to_numpy()
    s = np.arange(400) % 13
    for i in range(400):
        near = (((p - p[i]) ** 2).sum(1) <= 2.25) & (np.arange(400) != i)
        assert (i in kept) == (not (s[near] >= s[i]).any())


def test_voxel_rule_at_negative_multiples(spark):
    got = spark.createDataFrame([(-2.0,), (-2.7,), (2.0,), (-0.1,)], "v double").select(g.voxel(F.col("v"), 1.0).alias("k")).collect()
    assert [r.k for r in got] == [-3, -3, 2, -1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_exp_of_vector_is_a_rotation(v):
    r = fitting._exp(np.array(v))
    assert np.allclose(r @ r.T, np.eye(3), atol=1e-9) and abs(np.linalg.det(r) - 1) < 1e-9


def test_pose_inverse_undoes(cloud):
    df, p = cloud
    m, t = g.euler_to_mat(F.lit(0.4), F.lit(-1.2), F.lit(2.5)), g.lit3((1, 2, 3))
    back, bt = g.inverse(m, t)
    x = g.transform(back, bt, g.transform(m, t, g.vec("x", "y", "z")))
    got = df.select("pt_idx", *(v.alias(c) for v, c in zip(x, "xyz", strict=True))).toPandas().sort_values("pt_idx")
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), p, atol=1e-9)


def test_eigenvalues_match_numpy(cloud):
    df, p = cloud
    e = planes.eigenvalues(planes.covariance(df, ["scan_id"])).toPandas().sort_values("scan_id")
    for k, r in enumerate(e.to_dict("records")):
        want = np.linalg.eigvalsh(np.cov(p[np.arange(400) % 3 == k].T, bias=True))
        assert np.allclose([r["e1"], r["e2"], r["e3"]], want, atol=1e-9)


def test_plane_fit_finds_a_plane(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-1, 1, (50, 2))
    pdf = pd.DataFrame({"k": 1, "x": xy[:, 0], "y": xy[:, 1], "z": 0.5 * xy[:, 0] - 0.2 * xy[:, 1] + 3})
    r = planes.fit_planes(spark.createDataFrame(pdf), ["k"]).first()
    n = np.array([-0.5, 0.2, 1]) / math.sqrt(1.29)
    assert r["is_plane"] and np.allclose([r["nx"], r["ny"], r["nz"]], n, atol=1e-6)
    f = fitting.plane_of_points(spark.createDataFrame(pdf), ["k"]).first()
    assert f["ok"] and abs(abs(f["nz"]) - n[2]) < 1e-6


def test_index_insert_keeps_untouched_cells(cloud):
    df, _ = cloud
    old, new = df.filter("pt_idx < 200"), df.filter("pt_idx >= 200")
    out = index.insert_sampled(old, new, 2.0, "pt_idx")
    cells = lambda d: d.select(*(g.leaf(F.col(c), 2.0).alias(c) for c in "xyz"))
    touched = cells(new).distinct().count()
    untouched = cells(old).join(cells(new).distinct(), ["x", "y", "z"], "left_anti").count()
    assert out.count() == touched + untouched


def test_empty_inputs(cloud):
    df, _ = cloud
    none = df.limit(0)
    assert spatial.knn_join(none, df, 3, 1.0, ["pt_idx"], ["pt_idx"]).count() == 0
    assert spatial.knn_join(df.limit(5), none, 3, 1.0, ["pt_idx"], ["pt_idx"]).count() == 0
    assert planes.voxel_centroids(none, 1.0).count() == 0
    assert planes.voxel_overlap(none, df, 1.0).first()["score"] is None
    assert points.thin_to(none, 5).count() == 0


def test_unknown_sensor_is_refused(cloud):
    with pytest.raises(ValueError):
        points.decode("sonar", cloud[0])


@pytest.mark.parametrize("kind", sorted(LAYOUTS))
def test_packets_of_every_kind(kind):
    most, echoes, layout = LAYOUTS[kind]
    a = np.zeros(most, dtype=np.dtype(layout))
    for name in a.dtype.names:
        a[name] = 1000 if name[0] in "xyzd" else 9000 if name == "theta" else 0
    out = decode_packet(kind, a.tobytes() + b"\x01", 4)
    assert len(out) == most * echoes and set(out["line"]) <= {0, 1, 2, 3}
    assert np.allclose(out["x"], 1.0, atol=1e-6)
    assert len(decode_packet(6, b"abc")) == 0 and len(decode_packet(kind, b"")) == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0,1,2,3,1,0,0,0\nx,y\n2.0,4,5,6,0,1,0,0\n")
    r = readers.read_pose_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [x.qw for x in r] == [1.0, 0.0]
    assert readers.read_pose_csv(spark, str(tmp_path / "a.csv"), "xyzw").first().qw == 0.0
    (tmp_path / "m.txt").write_text("7 1 0 0 10 0 1 0 20 0 0 1 30\n")
    m = readers.read_pose_matrix(spark, str(tmp_path / "m.txt"), " ", "frame").first()
    assert (m.frame, m.tx, m.ty, m.tz, m.m00) == (7.0, 10.0, 20.0, 30.0, 1.0)
    (tmp_path / "t.txt").write_text("# comment\n1.5 1 2 3 0 0 0 1\n2.5 1 2 3 0 0 0 1 9 9 9 0 0 0 1\n")
    t = readers.read_tum(spark, str(tmp_path / "t.txt")).orderBy("time").collect()
    assert (t[0].ex, t[0].eqw, t[1].ex) == (0.0, 1.0, 9.0)
    (tmp_path / "b.bin").write_bytes(struct.pack("<8f", 1, 2, 3, 4, 5, 6, 7, 8) + b"zz")
    k = readers.read_kitti_bin(spark, str(tmp_path / "b.bin")).orderBy("pt_idx").collect()
    assert [(x.x, x.intensity) for x in k] == [(1.0, 4.0), (5.0, 8.0)]
    info = " ".join(str(v) for v in range(21))
    (tmp_path / "g.g2o").write_text(f"VERTEX_SE3:QUAT 0 1 2 3 0 0 0 1\nEDGE_SE3:QUAT 0 1 1 0 0 0 0 0 1 {info}\n")
    v, e = readers.read_graph(spark, str(tmp_path / "g.g2o"))
    assert v.first().z == 3.0 and len(e.first().information) == 21


def test_session_round_trip(spark, cloud, tmp_path):
    pts = cloud[0].withColumnRenamed("scan_id", "frame_id")
    k = spark.createDataFrame([(i, float(i), 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(3)], "frame_id long, x double, y double, z double, roll double, pitch double, yaw double")
    readers.write_session(pts, k, spark.createDataFrame([(0, 2)], "i long, j long"), str(tmp_path / "s"))
    raw, _, loops = readers.read_session(spark, str(tmp_path / "s"), False)
    fixed, _, _ = readers.read_session(spark, str(tmp_path / "s"), True)
    assert raw.count() == fixed.count() == 400 and loops.count() == 1
    d = raw.alias("a").join(fixed.alias("b"), "pt_idx").select((F.col("b.x") - F.col("a.x") - F.col("a.frame_id")).alias("d"))
    assert d.agg(F.max(F.abs("d"))).first()[0] < 1e-9
    poses = k.select(F.col("frame_id").cast("double").alias("time"), "x", "y", "z", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"))
    readers.write_poses(poses, str(tmp_path / "p"))
    assert readers.read_tum(spark, str(tmp_path / "p")).count() == 3


def _walk(n=60):
    rng = np.random.default_rng(2)
    rows, t = [], 0
    for s in range(3):
        pos = np.zeros(3)
        for _ in range(n):
            t += 1000
            pos = pos + rng.choice([0.05, 0.5, 7.0], p=[0.3, 0.6, 0.1]) * np.array([1.0, 0, 0])
            rows.append((s, t, t, *pos.tolist()))
    return rows


def test_keyframes_in_batch_and_stream_agree(spark, tmp_path):
    schema = "session long, id long, t_us long, x double, y double, z double"
    rows = _walk()
    batch = {(r.session, r.keyframe): r.scans for r in kf.keyframes_batch(spark.createDataFrame(rows, schema), 4).collect()}
    for part in range(3):
        spark.createDataFrame([r for i, r in enumerate(sorted(rows, key=lambda r: r[2])) if i * 3 // len(rows) == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = kf.keyframes_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 4)
    q = stream.writeStream.format("memory").queryName("kf").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session, r.keyframe): r.scans for r in spark.sql("SELECT * FROM kf").collect()}
    assert got == batch and batch


def test_stream_join_on_exact_time(spark, tmp_path):
    a = spark.createDataFrame([(1, "2024-01-01 00:00:01", 5), (1, "2024-01-01 00:00:02", 6)], "session long, ts string, cloud long").withColumn("ts", F.to_timestamp("ts"))
    b = spark.createDataFrame([(1, "2024-01-01 00:00:02", 7.0)], "session long, ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    j = kf.join_clouds_and_poses(spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")))
    q = j.writeStream.format("memory").queryName("sj").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.cloud, r.x) for r in spark.sql("SELECT * FROM sj").collect()] == [(6, 7.0)]


def test_rebuild_is_rolled_back_when_refused(spark):
    pts = spark.createDataFrame([(0, f, i, float(i), 0.0, 0.0) for f in range(2) for i in range(10)], "session long, frame_id long, pt_idx long, x double, y double, z double")
    poses = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0), (0, 1, 100.0, 0.0, 0.0, 0)], "session long, frame_id long, x double, y double, z double, version int")
    here = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "session long, x double, y double, z double")
    new, ok = kf.rebuild_map(pts, poses, here, 10.0, 5, lambda m: m.count() > 0)
    assert ok and new.count() == 5
    assert kf.rebuild_map(pts, poses, here, 10.0, 5, lambda m: False) == (pts, False)


def test_a_turn_on_the_spot_counts_and_time_may_run_backwards():
    g = kf.Gate(window=2)
    pose = lambda x, deg: [x, 0.0, 0.0, math.cos(math.radians(deg) / 2), 0.0, 0.0, math.sin(math.radians(deg) / 2)]
    assert g.step(1, 10, pose(1, 0)) is None and g.count == 1
    assert g.step(2, 20, pose(1, 4)) is None and g.count == 1  # neither moved nor turned
    assert g.step(3, 30, pose(1, 6)) == [1, 2, 3]
    assert g.step(4, 40, pose(2, 6)) is None and g.step(5, 5, pose(3, 6)) is None
    assert g.scans == [5] and g.count == 1  # a new epoch


def test_loop_gate():
    gate = loops.LoopGate(overlap=0.5)
    see = [gate.see(*x, 100.0) for x in [(9, 1, 0.4, 1.0), (9, 1, 0.9, 1.0), (9, 1, 0.9, 1.0), (12, 2, 0.8, 1.0), (20, 3, 0.8, 30.0), (21, 4, 0.8, 60.0), (22, 5, 0.8, 60.0), (23, 6, 0.8, 30.0), (24, 7, 0.8, 30.0)]]
    assert see == ["reject", "wait", "use", "use", "use", "reject", "reject", "wait", "use"]


def test_local_map_boxes():
    m = kf.LocalMap(edge=100.0, reach=20.0, threshold=1.5)
    assert m.move((0, 0, 0)) == [] and m.move((1, 0, 0)) == []
    gone = m.move((25.0, -25.0, 0.0))
    step = max((100 - 60) * 0.45, 10)
    assert gone == [((-50.0, -50.0, -50.0), (-50.0 + step, 50.0, 50.0)), ((-50.0, 50.0 - step, -50.0), (50.0, 50.0, 50.0))]
    assert m.low.tolist() == [-50 + step, -50 - step, -50]


def test_each_pose_is_taken_once(spark):
    rng = random.Random(4)
    left = [(s, i, rng.randrange(60)) for s in range(8) for i in range(rng.randrange(25))]
    right = [(s, 100 + i, rng.randrange(60)) for s in range(8) for i in range(rng.randrange(25))]
    want = {}
    for s in range(8):
        queue = sorted((t, i) for k, i, t in right if k == s)
        for t, i in sorted((t, i) for k, i, t in left if k == s):
            while queue and queue[0][0] < t:
                queue.pop(0)
            want[s, i] = queue.pop(0)[1] if queue else None
    out = temporal.asof_consumed(spark.createDataFrame(left, "s long, id long, t long"), spark.createDataFrame(right, "s long, rid long, t long"), "s", "t", ["rid"])
    assert {(r.s, r.id): r.r_rid for r in out.collect()} == want


def _state(rng):
    return estimation.State(*(estimation.exp_so3(rng.normal(size=3)) if k in (1, 2) else rng.normal(size=3) for k in range(8)))


def test_process_model_and_prediction_match_differences():
    rng = np.random.default_rng(0)
    x, gyro, acc, dt = _state(rng), rng.normal(size=3), rng.normal(size=3), 0.05
    d = 0.3 * rng.normal(size=estimation.SIZE)
    assert np.allclose(x.plus(d).minus(x), d, atol=1e-9)
    after, cov = estimation.predict(x, np.eye(estimation.SIZE), gyro, acc, dt, np.zeros(12))
    step = np.zeros((estimation.SIZE, estimation.SIZE))
    for k in range(estimation.SIZE):
        e = np.zeros(estimation.SIZE)
        e[k] = 1e-6
        step[:, k] = estimation.predict(x.plus(e), cov, gyro, acc, dt)[0].minus(after) / 1e-6
        f0, f1 = estimation.flow(x, gyro, acc), estimation.flow(x.plus(e), gyro, acc)
        for name in f0:
            assert np.allclose((f1[name] - f0[name]) / 1e-6, estimation.flow_by_state(x, acc)[estimation.SLOTS[name], k], atol=1e-4)
    assert np.allclose(step @ step.T, cov, atol=1e-5)
    noisy = estimation.predict(x, np.zeros((estimation.SIZE, estimation.SIZE)), gyro, acc, dt)[1]
    assert np.allclose(noisy[estimation.SLOTS["gyro_bias"], estimation.SLOTS["gyro_bias"]], 1e-5 * dt * dt * np.eye(3)) and noisy[12, 12] > 0


def test_update_is_the_least_cost(spark):
    """The iterated update ends where prior and measurement error together are least; its measurement rows match differences."""
    rng = np.random.default_rng(1)
    x0 = estimation.State(grav=np.array([0.1, 0.2, -9.8]))
    truth = x0.plus(np.concatenate([0.2 * rng.normal(size=12), np.zeros(11)]))
    p, n = rng.normal(size=(60, 3)) * 5, rng.normal(size=(60, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    world = lambda x: (p @ x.mount_rot.T + x.mount_pos) @ x.rot.T + x.pos
    d = -(n * world(truth)).sum(1)
    rows = spark.createDataFrame([(*map(float, a), *map(float, b), float(c)) for a, b, c in zip(p, n, d, strict=True)], "x double, y double, z double, nx double, ny double, nz double, d double")
    measure = lambda x: estimation.measurement_sums(estimation.measurement_rows(rows, x))
    prior = np.diag(rng.uniform(0.01, 0.1, estimation.SIZE))
    x, post = estimation.update(x0, prior, measure, 0.01, 10, 1e-9)

    def cost(y):
        e = y.minus(x0)
        return e @ np.linalg.solve(prior, e) + (((n * world(y)).sum(1) + d) ** 2).sum() / 0.01

    for k in range(estimation.SIZE):
        e = np.zeros(estimation.SIZE)
        e[k] = 1e-4
        assert cost(x.plus(e)) > cost(x) - 1e-9 and cost(x.plus(-e)) > cost(x) - 1e-9
    assert (np.linalg.eigvalsh(post) > 0).all() and (np.diag(post) < np.diag(prior) + 1e-9).all()


def test_corrected_state_and_notice():
    rng = np.random.default_rng(2)
    x, r, q = _state(rng), estimation.exp_so3(rng.normal(size=3)), estimation.exp_so3(rng.normal(size=3))
    y, note = estimation.corrected_state(x, (r, np.ones(3)), (q, np.zeros(3)), r)
    assert np.allclose(y.rot, r @ q) and np.allclose(y.pos, 1) and np.allclose(y.vel, r @ x.vel) and note["after"][3:] == [1.0, 1.0, 1.0] and note["before"][3:] == x.pos.tolist()


def test_ring_features_of_a_room():
    # Two walls that meet at a corner where one run of points ends and the next begins; then a wall far behind the second's end.
    a = np.stack([np.full(41, 4.0), np.linspace(-2, 2, 41), np.zeros(41)], 1)
    b = np.stack([np.linspace(3.9, 0.1, 39), np.full(39, 2.0), np.zeros(39)], 1)
    c = np.stack([np.linspace(0.0, -4.0, 21), np.full(21, 9.0), np.zeros(21)], 1)
    got = points.FEATURES[points.ring_features(np.concatenate([a, b, c]))]
    assert (got[:40] == "plane").all() and got[40] == "edge" and (got[41:72] == "plane").all()
    assert "edge" in got[72:80] and "edge" not in got[80:]  # the near wall ends in a jump, the far one doesn't begin with one
    assert (points.ring_features(np.zeros((5, 3))) == points.PLAIN).all() and len(points.ring_features(np.zeros((0, 3)))) == 0
    lone = np.stack([np.linspace(20, 30, 30) ** 2, np.linspace(1, 3, 30) ** 3, np.zeros(30)], 1)  # along the line of sight
    assert not (points.FEATURES[points.ring_features(lone)] == "edge").any()


def test_epochs_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng, schema = random.Random(2), "session long, id long, t_us long"
    rows = [(s, i, i * 10 if rng.random() > 0.1 else rng.randrange(100)) for s in range(3) for i in range(60)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    stream = kf.epochs_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "session", "id", "t_us")
    kf.publish(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {(r.session, r.id): r.epoch for r in temporal.epochs(spark.createDataFrame(rows, schema), "session", "id", "t_us").collect()}
    assert {(r.session, r.id): r.epoch for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and max(want.values()) > 2


def test_sinks_come_back(spark, cloud, tmp_path):
    cloud = cloud[0]
    tri = planes.triangles(cloud.select(F.col("scan_id").alias("frame_id"), F.col("pt_idx").alias("kp_id"), "x", "y", "z", F.array(F.lit(1), F.lit(3)).alias("slices")), 4, 0.1, 9.0)
    for _ in range(2):
        readers.append_descriptors(tri, str(tmp_path / "base"))
    assert readers.read_descriptors(spark, str(tmp_path / "base")).count() == 2 * tri.count() > 0
    rows = spark.createDataFrame([(float(k), 0.5 * k) for k in range(30)], "time_stamp double, total double")
    readers.write_log(rows, str(tmp_path / "log"), readers.TIMING, "time_stamp")
    back = readers.read_log(spark, str(tmp_path / "log"), readers.TIMING)
    assert sorted((r.time_stamp, r.total, r.search) for r in back.collect()) == [(float(k), 0.5 * k, None) for k in range(30)]
    flat = planes.fit_planes(cloud.withColumnRenamed("scan_id", "frame_id"), ["frame_id"])
    readers.write_planes(flat, str(tmp_path / "planes"))
    assert readers.read_planes(spark, str(tmp_path / "planes")).count() == flat.count()


def test_segments_and_boxes_in_view(spark):
    """Against fine samples: what they show in view is found, and what is found is in view or within their spacing of it."""
    rng = np.random.default_rng(5)
    origin, axis, angle, depth = (0.5, -0.5, 0.0), (1.0, 2.0, -1.0), 0.4, 4.0
    n = np.array(axis) / np.linalg.norm(axis)

    def seen(p, slack):
        d = p - np.array(origin)
        along = d @ n
        return (along > -slack) & (along <= depth + slack) & (along >= np.linalg.norm(d, axis=-1) * np.cos(angle) - slack)

    p, q = rng.uniform(-4, 4, (300, 3)), rng.uniform(-4, 4, (300, 3))
    names = [f"{c}{k}" for k in (1, 2) for c in "xyz"]
    rows = spark.createDataFrame([(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(p, q, strict=True))], "k long, " + ", ".join(f"{c} double" for c in names))
    got = {r.k: r.in_view for r in points.segment_in_cone(rows, origin, axis, angle, depth).collect()}
    s = np.linspace(0, 1, 4001)[:, None]
    for k in range(300):
        at = p[k] + s * (q[k] - p[k])
        assert not seen(at, -1e-6).any() or got[k]
        assert seen(at, 5e-3).any() or not got[k]
    low, size = rng.uniform(-4, 3, (150, 3)), rng.uniform(0.2, 1.5, (150, 3))
    rows = spark.createDataFrame([(k, *map(float, a), *map(float, a + b)) for k, (a, b) in enumerate(zip(low, size, strict=True))], "k long, " + ", ".join(f"{c} double" for c in names))
    box = points.box_meets_cone(g.vec("x1", "y1", "z1"), g.vec("x2", "y2", "z2"), origin, axis, angle, depth)
    got = {r.k: r.seen for r in rows.select("k", box.alias("seen")).collect()}
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 25)] * 3), -1).reshape(-1, 3)
    found = [(bool(seen(low[k] + grid * size[k], -1e-6).any()), got[k], bool(seen(low[k] + grid * size[k], 0.1).any())) for k in range(150)]
    assert all(g_ <= wide for _, g_, wide in found) and sum(s_ and not g_ for s_, g_, _ in found) <= 3 < sum(g_ for _, g_, _ in found)


def test_index_under_random_inserts_and_deletes(spark):
    """Inserts that keep the point nearest to a cell's centre, deletes of points and boxes, then nearest, radius and box searches, against lists."""
    rng, size = np.random.default_rng(8), 0.8
    live = {k: tuple(p) for k, p in enumerate(rng.uniform(-5, 5, (400, 3)))}
    schema = "pt_idx long, x double, y double, z double"
    df = lambda d: spark.createDataFrame([(int(k), *map(float, p)) for k, p in sorted(d.items())], schema)
    cell = lambda p: tuple(np.floor(np.array(p) / size).astype(int).tolist())
    middle = lambda p: float(((np.array(p) - (np.floor(np.array(p) / size) + 0.5) * size) ** 2).sum())
    table = df(live)
    for turn in range(3):
        gone = {int(k): live[k] for k in rng.choice(sorted(live), 40, replace=False).tolist()}
        box = ((-1.0 + turn, -5.0, -5.0), (0.0 + turn, 5.0, 5.0))
        fresh = {1000 * (turn + 1) + k: tuple(p) for k, p in enumerate(rng.uniform(-5, 5, (60, 3)))}
        table = index.delete_points(table, df(gone))
        table = index.delete_boxes(table.withColumn("deleted_by", F.lit(None).cast("string")), [box]).filter("deleted_by IS NULL").drop("deleted_by")
        table = spark.createDataFrame(index.insert_sampled(table, df(fresh), size, "pt_idx").select("pt_idx", "x", "y", "z").collect(), schema)
        live = {k: p for k, p in live.items() if k not in gone and not all(lo <= v < hi for v, lo, hi in zip(p, *box, strict=True))}
        touched = {cell(p) for p in fresh.values()}
        live |= fresh
        best = {}
        for k, p in sorted(live.items()):
            if cell(p) in touched and (cell(p) not in best or middle(p) < middle(live[best[cell(p)]])):
                best[cell(p)] = k
        live = {k: p for k, p in live.items() if cell(p) not in touched or best[cell(p)] == k}
        assert {r.pt_idx for r in table.collect()} == set(live)
    q = rng.uniform(-5, 5, (30, 3))
    queries = df({k: tuple(p) for k, p in enumerate(q)})
    ids, p = np.array(sorted(live)), np.array([live[k] for k in sorted(live)])
    d2 = ((q[:, None, :] - p[None]) ** 2).sum(2)
    got = collections.defaultdict(list)
    for r in sorted(spatial.knn_join(queries, table, 5, 0.5, ["pt_idx"], ["pt_idx"]).collect(), key=lambda r: r.rank):
        got[r.q_pt_idx].append(r.t_pt_idx)
    assert all(got[k] == ids[np.argsort(d2[k], kind="stable")[:5]].tolist() for k in range(30))
    near = {(r.q_pt_idx, r.t_pt_idx) for r in spatial.radius_join(queries, table, 1.5, ["pt_idx"], ["pt_idx"]).collect()}
    assert near == {(k, int(ids[j])) for k in range(30) for j in np.flatnonzero(d2[k] <= 2.25)}
    box = {r.pt_idx for r in spatial.box_search(table, (-2, -2, -2), (2, 2, 2)).collect()}
    assert box == {int(k) for k, x in zip(ids, p, strict=True) if (x >= -2).all() and (x < 2).all()}


def test_states_of_many_sessions_are_predicted_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(5)
    start = estimation.State(vel=np.array([1.0, 2, 3]), gyro_bias=np.array([0.1, -0.2, 0.3]), acc_bias=np.array([0.3, 0.1, 0.2]), rot=estimation.exp_so3(np.array([0.4, 0.2, 1.0])))
    lengths = {0: 1, 1: 2, 2: 300, 3: 40, **{k: 3 for k in range(4, 30)}}
    rows = [(s, int(1000 * k * (s + 1)), *map(float, rng.normal(size=6) * (k % 5 > 0))) for s, n in lengths.items() for k in range(n)]
    want = {}
    for s in lengths:
        x, p, was = start, 1e-4 * np.eye(estimation.SIZE), None
        for r in (r for r in rows if r[0] == s):
            u = np.array(r[2:])
            if was:
                x, p = estimation.predict(x, p, *np.split((was[1] + u) / 2, 2), (r[1] - was[0]) / 1e6)
            was = r[1], u
            want[r[:2]] = np.concatenate([x.pos, x.rot.ravel(), x.vel, np.diag(p)])
    monkeypatch.setattr(estimation, "predict", None)  # no row is taken alone
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # the long session goes over several batches
    try:
        imu = spark.createDataFrame(rows, "session long, t_us long, gx double, gy double, gz double, ax double, ay double, az double")
        got = estimation.propagate_states(imu.repartition(7), start).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) == len(rows)
    for r in got:
        np.testing.assert_allclose([*r.pos, *r.rot, *r.vel, *r.variance], want[r.session, r.t_us], rtol=1e-9, atol=1e-12)
