"""The forest of cubes against plain lists, and what it opens."""

import random

from pointframe.operators import forest, spatial


def _rows(rng, n, first, t0):
    return [(first + k, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-5, 5), t0 + rng.uniform(0, 10)) for k in range(n)]


def test_forest_reads_what_a_box_and_a_time_touch(spark, tmp_path):
    rng = random.Random(1)
    f, schema = forest.CubeForest(str(tmp_path / "f"), 10.0), "id long, x double, y double, z double, t double"
    early, late = _rows(rng, 600, 0, 0.0), _rows(rng, 600, 600, 100.0)
    f.add(spark.createDataFrame([*early, (9999, float("nan"), 0.0, 0.0, 1.0), (9998, None, 0.0, 0.0, 1.0)], schema), "first")
    f.add(spark.createDataFrame(late, schema), "second")
    f.add(spark.createDataFrame(late, schema), "second")  # run again: no row twice
    rows = early + late
    inside = lambda r, lo, hi, a, b: all(x <= v <= y for v, x, y in zip(r[1:4], lo, hi, strict=True)) and a <= r[4] <= b
    box = ((-12.0, -5.0, -5.0), (8.0, 14.0, 5.0))
    whole = f.read(spark)
    assert {r.id for r in whole.collect()} == {r[0] for r in rows} and whole.columns == ["id", "x", "y", "z", "t"]
    part = f.read(spark, *box)
    assert {r.id for r in part.collect()} == {r[0] for r in rows if inside(r, *box, 0, 200)}
    timed = f.read(spark, *box, since=50.0)
    assert {r.id for r in timed.collect()} == {r[0] for r in rows if inside(r, *box, 50, 200)}
    files = [len(x.inputFiles()) for x in (whole, part, timed)]
    assert files[1] < files[0] / 5 and files[2] <= 0.6 * files[1]
    assert f.read(spark, (500.0, 0.0, 0.0), (600.0, 1.0, 1.0)).count() == 0
    # Nearest neighbours in a range of time, from the cubes around alone.
    q = spark.createDataFrame([(0, -2.0, 4.0, 0.0)], "q long, x double, y double, z double")
    near = spatial.knn_join(q, timed, 3, 5.0, ["q"], ["id"]).orderBy("rank").collect()
    d2 = lambda r: (r[1] + 2) ** 2 + (r[2] - 4) ** 2 + r[3] ** 2
    want = sorted((r for r in late), key=d2)[:3]
    assert [r.t_id for r in near] == [r[0] for r in want] or max(map(d2, want)) > 25


def test_deleted_points_go_at_reads_and_then_from_files(spark, tmp_path):
    rng = random.Random(2)
    f, schema = forest.CubeForest(str(tmp_path / "f"), 25.0), "id long, x double, y double, z double, t double"
    rows = _rows(rng, 300, 0, 0.0)
    f.add(spark.createDataFrame(rows, schema), "a")
    gone = [r for r in rows if r[1] < -30 and r[0] % 2]
    f.delete(spark.createDataFrame([(r[1], r[2], r[3]) for r in gone], "x double, y double, z double"), "one")
    left = {r[0] for r in rows} - {r[0] for r in gone}
    assert {r.id for r in f.read(spark).collect()} == left
    before = {(r.insertion, r.cx, r.cy, r.cz): r.n for r in f.directory(spark).collect()}
    written = f.compact(spark, "b")
    after = {(r.insertion, r.cx, r.cy, r.cz): r.n for r in f.directory(spark).collect()}
    assert written and sum(before.values()) == 300 and sum(after.values()) == len(left)
    assert {k for k in before if k not in after} == set(written) and all(k[0] == "b" for k in after if k not in before)
    assert {r.id for r in f.read(spark).collect()} == left
    assert f.compact(spark, "c") and {r.id for r in f.read(spark).collect()} == left
