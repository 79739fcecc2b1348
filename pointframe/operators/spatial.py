"""Exact nearest-neighbour, radius and box joins by grid keys.

A radius join cuts space into cells as wide as the radius; every query goes to the 27 cells around its own, and meets
the targets of those cells by an equi-join. A nearest-neighbour join goes by the balanced partition. With a condition on
pairs it does the same as a radius join with a guessed radius; queries whose k-th neighbour isn't certain (fewer than k
within the radius) are asked again with twice the radius, and the few that are left after some rounds are held against all
targets, dealt into parts whose best are merged. So results are exact for any guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.functions import geom as g
from pointframe.session import cut

XYZ = ("x", "y", "z")
MAX_ROUNDS = 6


def _cells(df: DataFrame, size: float, xyz: tuple[str, str, str] = XYZ) -> DataFrame:
    return df.withColumns({f"_c{k}": g.leaf(F.col(c), size) for k, c in enumerate(xyz)})


def _around() -> Column:
    one = F.array(*(F.lit(v).cast("long") for v in (-1, 0, 1)))
    return F.flatten(F.transform(one, lambda a: F.flatten(F.transform(one, lambda b: F.transform(one, lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))))))


def radius_join(queries: DataFrame, targets: DataFrame, radius: float, qid: list[str], tid: list[str], on: list[str] | None = None) -> DataFrame:
    """(q_*, t_*, d2) of all pairs within radius, ends included. Columns of both sides get the prefixes q_ and t_; `on` names columns that must agree.

    NaN coordinates meet nothing. A cell is as wide as the radius, so a dense cell holds what its queries must see anyway.
    """
    on = on or []
    q = _cells(queries, radius).withColumn("_s", F.explode(_around()))
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in dict.fromkeys([*on, *qid, *XYZ])), *((F.col(f"_c{k}") + F.col(f"_s.{s}")).alias(f"_k{k}") for k, s in enumerate("abc")))
    t = _cells(targets, radius).select(*(F.col(c).alias(f"t_{c}") for c in dict.fromkeys([*on, *tid, *XYZ])), *(F.col(f"_c{k}").alias(f"_k{k}") for k in range(3)))
    cond = [F.col(f"q_{c}") == F.col(f"t_{c}") for c in on]
    joined = q.join(t, ["_k0", "_k1", "_k2"]).drop("_k0", "_k1", "_k2")
    for c in cond:
        joined = joined.filter(c)
    d2 = g.sq_dist(g.vec("q_x", "q_y", "q_z"), g.vec("t_x", "t_y", "t_z"))
    return joined.withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def knn_join(queries: DataFrame, targets: DataFrame, k: int, guess: float, qid: list[str], tid: list[str], on: list[str] | None = None, skip_self: bool = False, max_dist: float | None = None, where: Column | None = None) -> DataFrame:
    """(q_*, t_*, d2, rank) of the k nearest targets of each query, ties by the target's ids; fewer if there are fewer.

    With max_dist, only targets within it count. skip_self leaves out targets with the query's own ids. Both go by the
    balanced partition, whose work doesn't grow with how dense a place is. where, over q_ and t_ columns of the ids, leaves out
    others before they are ranked, and goes by rounds of radius joins from the guess on.
    """
    if where is None:
        from pointframe.operators import balanced

        return balanced.knn_join(queries, targets, k, qid, tid, skip_self, on=on, max_dist=max_dist)
    qk, tk = [f"q_{c}" for c in dict.fromkeys([*(on or []), *qid])], [f"t_{c}" for c in tid]
    rank = Window.partitionBy(*qk).orderBy("d2", *tk)

    def best(pairs: DataFrame) -> DataFrame:
        if skip_self:
            same = [F.col(f"q_{a}") == F.col(f"t_{b}") for a, b in zip(qid, tid, strict=True)]
            cond = same[0]
            for s in same[1:]:
                cond = cond & s
            pairs = pairs.filter(~cond)
        if where is not None:
            pairs = pairs.filter(where)
        return pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    if max_dist is not None:
        return best(radius_join(queries, targets, max_dist, qid, tid, on))
    keys = list(dict.fromkeys([*(on or []), *qid]))
    done, asked, radius = [], queries, guess
    for _ in range(MAX_ROUNDS):
        found = cut(best(radius_join(asked, targets, radius, qid, tid, on)))
        full = found.groupBy(*qk).agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select(*(F.col(f"q_{c}").alias(c) for c in keys))
        done.append(found.join(full.select(*(F.col(c).alias(f"q_{c}") for c in keys)), qk, "left_semi"))
        asked = cut(asked.join(full, keys, "left_anti"))
        if not asked.limit(1).count():
            break
        radius *= 2
    else:
        done.append(_dealt_targets(asked, targets, keys, tid, on or [], own_ids=list(zip(qid, tid, strict=True)) if skip_self else [], where=where, k=k, best=best))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _dealt_targets(asked: DataFrame, targets: DataFrame, keys: list[str], tid: list[str], on: list[str], own_ids: list[tuple[str, str]], where: Column | None, k: int, best) -> DataFrame:
    """What is left sees every target of its group, a part of the targets in a task; the best of all parts are ranked again."""
    qk, tk = [f"q_{c}" for c in keys], [f"t_{c}" for c in tid]
    parts = max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = asked.select(*(F.col(c).alias(f"q_{c}") for c in dict.fromkeys([*keys, *XYZ])), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    t = targets.select(*(F.col(c).alias(f"t_{c}") for c in dict.fromkeys([*on, *tid, *XYZ])), F.pmod(F.xxhash64(*tid), F.lit(parts)).cast("int").alias("_p"))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"q_{c}") == F.col(f"t_{c}"))
    pairs = q.join(t, "_p").filter(same).withColumn("d2", g.sq_dist(g.vec("q_x", "q_y", "q_z"), g.vec("t_x", "t_y", "t_z")))
    own = F.lit(bool(own_ids))
    for a, b in own_ids:
        own = own & (F.col(f"q_{a}") == F.col(f"t_{b}"))
    pairs = pairs.filter(~own)
    if where is not None:
        pairs = pairs.filter(where)
    here = Window.partitionBy("_p", *qk).orderBy("d2", *tk)
    return best(pairs.withColumn("_r", F.row_number().over(here)).filter(F.col("_r") <= k).drop("_r", "_p"))


def box_search(df: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """The points of a box, its low faces included and its high ones not."""
    cond = F.lit(True)
    for c, lo, hi in zip(XYZ, low, high, strict=True):
        cond = cond & (F.col(c) >= lo) & (F.col(c) < hi)
    return df.filter(cond)


def plane_rmse(queries: DataFrame, targets: DataFrame, k: int, guess: float, qid: list[str], tid: list[str], max_dist: float, on: list[str] | None = None) -> DataFrame:
    """(useful, rmse), a row for each value of `on` or one in all: the queries nearer than max_dist squared to the plane through their k nearest targets, and the root of their mean distance to it.

    Queries whose targets lie in no one plane's direction (singular equations) don't count.
    """
    from pointframe.operators.fitting import plane_of_points

    nn = knn_join(queries, targets, k, guess, qid, tid, on)
    keys = [f"q_{c}" for c in dict.fromkeys([*(on or []), *qid, *XYZ])]
    plane = plane_of_points(nn.select(*keys, *(F.col(f"t_{c}").alias(c) for c in XYZ)), keys)
    dis = F.abs(g.dot(g.vec("nx", "ny", "nz"), g.vec("q_x", "q_y", "q_z")) + F.col("d"))
    near = plane.select(*(F.col(f"q_{c}").alias(c) for c in on or []), dis.alias("dis")).filter(F.col("dis") < max_dist * max_dist)
    return near.groupBy(*(on or [])).agg(F.count("*").alias("useful"), F.sqrt(F.avg("dis")).alias("rmse"))
