"""Joins on a balanced partition against all pairs, on clouds that a grid deals out badly; rebuilding."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointframe.operators import balanced, spatial


def _cloud(kind, n, rng):
    if kind == "dense":  # nearly all of it in a cell of a thousandth, with equal points
        p = rng.normal(0, 1e-3, (n, 3))
        p[: n // 20] = rng.uniform(-50, 50, (n // 20, 3))
        p[-n // 4 :] = p[-1]
        return p
    if kind == "grid":
        return rng.integers(-3, 4, (n, 3)).astype(float)
    return rng.uniform(-5, 5, (n, 3))


def _frame(spark, p, first=0):
    return spark.createDataFrame([(first + k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double")


@pytest.mark.parametrize("kind", ["dense", "grid", "even"])
def test_joins_equal_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(balanced, "MEET_TARGETS", 100)  # equal points and their queries are dealt
    monkeypatch.setattr(balanced, "MEET_QUERIES", 50)
    rng = np.random.default_rng(3)
    t, q = _cloud(kind, 900, rng), np.concatenate([_cloud(kind, 150, rng), rng.uniform(-60, 60, (20, 3))])
    targets, queries = _frame(spark, t), _frame(spark, q)
    splits = balanced.fit_splits(targets, 60)
    d2 = ((q[:, None, 0] - t[None, :, 0]) ** 2 + (q[:, None, 1] - t[None, :, 1]) ** 2 + (q[:, None, 2] - t[None, :, 2]) ** 2)
    radius = {"dense": 0.0015, "grid": 1.0, "even": 1.2}[kind]
    got = {(r.q_id, r.t_id) for r in balanced.radius_join(queries, targets, radius, ["id"], ["id"], splits).collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d2 <= radius * radius)), strict=True)) and got
    got = collections.defaultdict(list)
    for r in sorted(balanced.knn_join(queries, targets, 5, ["id"], ["id"], splits=splits).collect(), key=lambda r: r["rank"]):
        got[r.q_id].append(r.t_id)
    assert dict(got) == {k: np.lexsort((np.arange(900), d2[k]))[:5].tolist() for k in range(len(q))}
    own = balanced.knn_join(targets, targets, 3, ["id"], ["id"], skip_self=True, splits=splits)
    d2 = ((t[:, None, 0] - t[None, :, 0]) ** 2 + (t[:, None, 1] - t[None, :, 1]) ** 2 + (t[:, None, 2] - t[None, :, 2]) ** 2)
    np.fill_diagonal(d2, np.inf)
    assert {(r.q_id, r["rank"], r.t_id) for r in own.collect()} == {(k, n + 1, int(j)) for k in range(900) for n, j in enumerate(np.lexsort((np.arange(900), d2[k]))[:3])}


def test_few_targets_and_none(spark):
    q, t = _frame(spark, np.eye(3)), _frame(spark, np.eye(3)[:2])
    assert balanced.knn_join(q, t, 5, ["id"], ["id"]).count() == 6
    assert balanced.knn_join(q, t.limit(0), 5, ["id"], ["id"]).count() == 0 == balanced.radius_join(q.limit(0), t, 9.0, ["id"], ["id"]).count()
    odd = q.unionByName(spark.createDataFrame([(7, float("nan"), 0.0, 0.0), (8, None, 0.0, 0.0)], q.schema))
    assert {r.q_id for r in balanced.knn_join(odd, odd, 1, ["id"], ["id"]).collect()} == {0, 1, 2}


def test_leaves_hold_about_as_many_points_each(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 1e-4, (15_000, 3)), rng.uniform(-100, 100, (5_000, 3))])  # a grid of unit cells has three quarters in one
    splits = balanced.fit_splits(_frame(spark, p), 500)
    sizes = [r["count"] for r in balanced.with_leaf(_frame(spark, p), splits).groupBy("_leaf").count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 313 and min(sizes) >= 312
    some = balanced.fit_splits(_frame(spark, p), 500, sample=4_000)
    sizes = [r["count"] for r in balanced.with_leaf(_frame(spark, p), some).groupBy("_leaf").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 600


def test_rebuild_drops_what_is_deleted_where_it_is_much(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 10, (2_000, 3))
    index = _frame(spark, p)
    splits = balanced.fit_splits(index, 100)
    gone = F.when((F.col("x") < 4) & (F.col("id") % 10 != 0) | (F.col("id") % 10 == 5), F.lit("point"))
    marked = index.withColumn("deleted_by", gone)
    kept, tree, nodes = balanced.rebuild(marked, splits, leaf_rows=100)
    rows = kept.collect()
    live = {r.id for r in marked.collect() if r.deleted_by is None}
    assert nodes and {r.id for r in rows if r.deleted_by is None} == live and len(live) < len(rows) < 2_000
    sizes = [r["count"] for r in balanced.with_leaf(kept, tree).groupBy("_leaf").count().collect()]
    assert max(sizes) <= 110 and len(sizes) <= tree.leaves
    whole, above, nodes = balanced.rebuild(kept, tree, leaf_rows=100)  # what shrank may leave the nodes above out of balance
    assert nodes == [0] and {r.id for r in whole.collect()} == live
    again = balanced.rebuild(whole, above, leaf_rows=100)
    assert again[2] == [] and again[0] is whole and again[1] is above
    d2 = ((p[:, None, :] - p[None]) ** 2).sum(2)
    got = {(r.q_id, r.t_id) for r in balanced.radius_join(index, kept.filter("deleted_by IS NULL"), 0.8, ["id"], ["id"], tree).collect()}
    assert got == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(d2 <= 0.64)), strict=True) if j in live}


def test_rebuild_plan_by_its_rules():
    tree = balanced.Splits(np.zeros(5, int), np.zeros(5), np.array([1, 3, -1, -1, -1]), np.array([0, 0, 0, 1, 2], np.int32))
    plan = lambda live, dead: balanced.rebuild_plan(tree, np.array(live), np.array(dead), 0.5, 0.7)
    assert plan([20, 10, 10], [0, 0, 0]) == [] and plan([4, 1, 1], [0, 0, 0]) == []
    assert plan([40, 5, 5], [0, 0, 0]) == [0]  # too few below the first split
    assert plan([22, 10, 2], [0, 0, 9]) == [4] and plan([22, 10, 12], [0, 0, 0]) == [] and plan([22, 19, 2], [0, 0, 0]) == [1]
    assert plan([1, 1, 1], [20, 20, 20]) == [0]


def test_nearest_by_group_and_distance_equal_brute_force(spark, monkeypatch):
    """Many leaves of large groups, groups of few targets or none, ids that are null, and no join that pairs up whole cells."""

    def refuse(*args, **kwargs):
        raise AssertionError("a radius join pairs all points of dense cells")

    monkeypatch.setattr(spatial, "radius_join", refuse)
    monkeypatch.setattr(balanced, "LEAF_ROWS", 200)
    rng = np.random.default_rng(21)
    p = np.concatenate([rng.normal(size=(1500, 3)), 30 + rng.normal(size=(20, 3)), np.round(rng.normal(size=(400, 3)))])
    group = np.concatenate([rng.integers(0, 3, 1500), np.full(20, 7), np.full(400, 1)])
    rows = [(int(gr), i, None if i % 9 == 0 else "s", *map(float, v)) for i, (gr, v) in enumerate(zip(group, p, strict=True))]
    df = spark.createDataFrame(rows, "grp int, id long, note string, x double, y double, z double")
    targets = df.filter("id % 3 <> 0 AND grp <> 2")
    for k, far in ((4, None), (3, 0.4)):
        got = {}
        for r in spatial.knn_join(df, targets, k, 1.0, ["id", "note"], ["id"], ["grp"], max_dist=far).collect():
            got.setdefault(r["q_id"], []).append((r["rank"], r["t_id"]))
        t = np.array([i for i in range(len(p)) if i % 3 and group[i] != 2])
        for i in range(len(p)):
            d2 = ((p[t] - p[i]) ** 2).sum(1)
            near = sorted((d, int(j)) for d, j, gr in zip(d2, t, group[t], strict=True) if gr == group[i] and (far is None or d <= far * far))[:k]
            assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in near]
