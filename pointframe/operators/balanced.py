"""A balanced partition of space, and joins on it that have no hot key.

Splits are medians along the longest axis, found on the driver from a bounded sample of the targets, so leaves hold about as
many points each however dense a place is; what the sample was decides how fast a join is and never its rows. Leaves are
counted, and one that holds too many points all the same, as equal points cannot be split, is dealt into parts.

A radius join sends a query to each leaf that its ball reaches. A nearest-neighbour join asks a query's own leaf first; the
k-th distance found there is a ball, and only the leaves that it reaches are asked then. Nothing is asked twice or guessed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pointframe.session import cut

XYZ = ("x", "y", "z")
LEAF_ROWS = 2_000  # points of a leaf, about
NEAR_ROWS = 500  # the same where each query sees its whole leaf
MOST_LEAVES = 16_384
SAMPLE = 200_000  # points that splits are found from, at most about
MEET_TARGETS, MEET_QUERIES = 8_000, 20_000  # points of either side that meet in a task at once
CHUNK = 1 << 22  # distances that are computed at once


@dataclass
class Splits:
    """A binary tree: node i splits axis[i] at value[i] into child[i] (below) and child[i] + 1; a leaf has child -1 and a number."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.child < 0).sum())

    def visit(self, xyz: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that the ball of a row reaches; a reach of 0 is the row's own leaf alone."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(xyz)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            c = int(self.child[node])
            if c < 0:
                rows.append(at)
                leaves.append(np.full(len(at), self.leaf[node], np.int32))
                continue
            v, r, s = xyz[at, self.axis[node]], reach[at], self.value[node]
            own = v < s
            # Bounds with room for rounding: a leaf too many costs time only.
            slack = 1e-9 * (np.abs(v) + np.abs(s) + r) * (r > 0)
            todo.append((c, at[own | ((r > 0) & (v - r - slack < s))]))
            todo.append((c + 1, at[~own | ((r > 0) & (v + r + slack >= s))]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int32))


def fit_splits(points: DataFrame, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE) -> Splits:
    """Splits by the medians of a sample of points, as many leaves as the points need and MOST_LEAVES at most; NaNs are left out."""
    sound = points.select(*(F.col(c).cast("double").alias(c) for c in XYZ)).filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XYZ))
    n = sound.count()
    some = sound if n <= sample else sound.filter(F.pmod(F.xxhash64(*XYZ, F.monotonically_increasing_id()), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    p = np.array(some.toPandas(), dtype=float).reshape(-1, 3)
    leaves = 1
    while leaves < min(MOST_LEAVES, n / leaf_rows, len(p)):  # a power of two, so that medians give equal leaves
        leaves *= 2
    axis, value, child = [0], [0.0], [-1]
    todo = [(0, p, leaves)]
    while todo:
        node, own, want = todo.pop()
        wide = own.max(0) - own.min(0) if len(own) else np.zeros(3)
        k = int(wide.argmax())
        if want < 2 or wide[k] <= 0:  # equal points have no median that parts them
            continue
        s = float(np.partition(own[:, k], len(own) // 2)[len(own) // 2])
        if s <= own[:, k].min():
            s = float(own[own[:, k] > s, k].min())
        below = own[:, k] < s
        axis[node], value[node], child[node] = k, s, len(axis)
        for part in (own[below], own[~below]):
            todo.append((len(axis), part, want // 2))
            axis, value, child = [*axis, 0], [*value, 0.0], [*child, -1]
    return _numbered(axis, value, child)


def _numbered(axis: list[int], value: list[float], child: list[int]) -> Splits:
    out = Splits(np.array(axis), np.array(value), np.array(child), np.zeros(len(axis), np.int32))
    ends = np.flatnonzero(out.child < 0)
    out.leaf[ends] = np.arange(len(ends))
    return out


def _floats(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in XYZ], 1).reshape(-1, 3)


def with_leaf(points: DataFrame, splits: Splits, reach: str | None = None) -> DataFrame:
    """points with _leaf, a row for each leaf: its own, or all that its ball reaches if `reach` is a column. NaNs and nulls have none."""
    shared = points.sparkSession.sparkContext.broadcast(splits)  # MOST_LEAVES at most
    sound = points.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XYZ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column(reach).to_numpy(zero_copy_only=False) if reach else np.zeros(b.num_rows)
            rows, leaves = shared.value.visit(_floats(b), r)
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, pa.int32())], names=[*b.schema.names, "_leaf"])

    return sound.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("_leaf", T.IntegerType())]))


def _dealt(df: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str) -> DataFrame:
    """df dealt by _leaf into own[leaf] parts at random, each row to all of other[leaf] parts of the other side."""
    many = {k: (own.get(k, 1), other.get(k, 1)) for k in own.keys() | other.keys() if own.get(k, 1) > 1 or other.get(k, 1) > 1}
    if not many:
        return df.withColumns({mine: F.lit(0), theirs: F.lit(0)})
    sizes = F.broadcast(df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in many.items()], "_leaf int, _a int, _b int"))  # MOST_LEAVES rows at most
    df = df.withColumn("_row", F.monotonically_increasing_id()).join(sizes, "_leaf", "left")
    df = df.withColumn(mine, F.pmod(F.xxhash64("_row"), F.coalesce("_a", F.lit(1))).cast("int"))
    return df.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce("_b", F.lit(1)) - 1))).drop("_row", "_a", "_b")


def _parts(counts: DataFrame, most: int) -> dict[int, int]:
    """Leaves of more rows than `most` and the parts they are dealt into; there are MOST_LEAVES rows at most."""
    return {r["_leaf"]: -(-r["count"] // most) for r in counts.filter(F.col("count") > most).collect()}


def _meet(queries: DataFrame, targets: DataFrame, qid: list[str], tid: list[str], k: int | None, radius: float | None, skip_self: bool, on: list[str] | None = None) -> DataFrame:
    """(q_*, t_*, d2) of what meets in a leaf and agrees in `on`: within the radius, or the k nearest of each query there, ties by ids.

    Both tables are read more than once, so they are cut by the caller.
    """
    on = on or []
    names_q, names_t = list(dict.fromkeys([*on, *qid, *XYZ])), list(dict.fromkeys([*on, *tid, *XYZ]))
    queries, targets = queries.select(*names_q, "_leaf"), targets.select(*names_t, "_leaf")
    fullest = lambda df: df.groupBy("_leaf", *on).count().groupBy("_leaf").agg(F.max("count").alias("count"))
    pt, pq = _parts(fullest(targets), MEET_TARGETS), _parts(fullest(queries), MEET_QUERIES)
    left, right = _dealt(queries, pq, pt, "_pq", "_pt"), _dealt(targets, pt, pq, "_pt", "_pq")
    kinds = [T.StructField(p + n, df.schema[n].dataType) for p, df, names in (("q_", queries, names_q), ("t_", targets, names_t)) for n in names]
    schema = T.StructType([*kinds, T.StructField("d2", T.DoubleType())])
    plain = [c for c in tid if not isinstance(targets.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]  # ids that Arrow sorts

    def meet(key, q: pa.Table, t: pa.Table) -> pa.Table:
        a, b = (np.stack([x.column(c).to_numpy().astype(float) for c in XYZ], 1).reshape(-1, 3) for x in (q, t))
        out: list[pa.Table] = []
        if len(a) and len(b):
            # By ids, so that a stable choice takes the lesser ones of equally near targets.
            order = pc.sort_indices(t.select(plain), sort_keys=[(c, "ascending") for c in plain])
            t, b = t.take(order), b[order.to_numpy()]
            step = max(1, CHUNK // len(b))
            for s in range(0, len(a), step):
                d2 = (a[s : s + step, None, 0] - b[None, :, 0]) ** 2 + (a[s : s + step, None, 1] - b[None, :, 1]) ** 2 + (a[s : s + step, None, 2] - b[None, :, 2]) ** 2
                if radius is not None:
                    i, j = np.nonzero(d2 <= radius * radius)
                else:
                    more = min(len(b), k + skip_self)  # its own row is at most one of them
                    limit = np.partition(d2, more - 1, axis=1)[:, more - 1]
                    i, j = np.nonzero(d2 <= limit[:, None])
                    if len(i) > more * len(d2):  # of those as near as the last one, only as many as there is room for
                        tie = d2 == limit[:, None]
                        room = more - (d2 < limit[:, None]).sum(1)
                        i, j = np.nonzero((d2 < limit[:, None]) | (tie & (tie.cumsum(1) <= room[:, None])))
                picked = [q.select(names_q).take(pa.array(i + s)), t.select(names_t).take(pa.array(j))]
                out.append(pa.table([*picked[0].columns, *picked[1].columns, pa.array(d2[i, j])], names=schema.names))
        none = pa.table([*q.select(names_q).slice(0, 0).columns, *t.select(names_t).slice(0, 0).columns, pa.array([], pa.float64())], names=schema.names)
        return pa.concat_tables([none, *out])

    keys = ["_leaf", *on, "_pt", "_pq"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def radius_join(queries: DataFrame, targets: DataFrame, radius: float, qid: list[str], tid: list[str], splits: Splits | None = None) -> DataFrame:
    """(q_*, t_*, d2) of all pairs within radius, ends included, as spatial.radius_join has them."""
    splits = splits or fit_splits(targets)
    near = with_leaf(queries.select(*dict.fromkeys([*qid, *XYZ])).withColumn("_reach", F.lit(float(radius))), splits, "_reach")
    return _meet(cut(near), cut(with_leaf(targets.select(*dict.fromkeys([*tid, *XYZ])), splits)), qid, tid, None, radius, False)


@dataclass
class Held:
    """Targets with their leaves, written once for many joins."""

    splits: Splits
    table: DataFrame


def hold(targets: DataFrame, tid: list[str], k: int = 1) -> Held:
    """Targets for nearest-neighbour joins: leaves are as small as k allows, as each query sees all of its own."""
    t = targets.select(*dict.fromkeys([*tid, *XYZ]))
    splits = fit_splits(t, max(NEAR_ROWS, 4 * k))
    return Held(splits, cut(with_leaf(t, splits)))


def knn_join(queries: DataFrame, targets: DataFrame | Held, k: int, qid: list[str], tid: list[str], skip_self: bool = False, splits: Splits | None = None, on: list[str] | None = None, max_dist: float | None = None) -> DataFrame:
    """(q_*, t_*, d2, rank) of the k nearest targets of each query, ties by the target's ids; fewer if there are fewer.

    The ids of a query or target tell it from others. skip_self leaves out targets with the query's own ids; `on` names columns
    that must agree; with max_dist only targets within it count. A query whose own leaf holds fewer than k others is asked in
    all leaves that max_dist reaches. With `on`, targets of a value that are few are one leaf, and leaves of the others
    hold enough of each value.
    """
    on = on or []
    qk, tk = [f"q_{c}" for c in dict.fromkeys([*on, *qid])], [f"t_{c}" for c in tid]
    names_q, names_t = list(dict.fromkeys([*on, *qid, *XYZ])), list(dict.fromkeys([*on, *tid, *XYZ]))
    own = "_leaf"
    if isinstance(targets, Held):
        splits, t = targets.splits, targets.table
        q = queries.select(*names_q)
    elif on:
        sizes = cut(targets.groupBy(*on).count().select(*on, F.when(F.col("count") > LEAF_ROWS, F.lit(True)).otherwise(F.lit(False)).alias("_many")))
        q, t = (df.select(*names).join(sizes, on) for df, names in ((queries, names_q), (targets, names_t)))
        splits = splits or fit_splits(t.filter("_many"), max(LEAF_ROWS, 4 * k * max(1, sizes.filter("_many").count())))
        own = F.when(F.col("_many"), F.col("_leaf")).otherwise(F.lit(-1))
        t = cut(with_leaf(t, splits).withColumn("_leaf", own))
    else:
        splits = splits or fit_splits(targets, max(NEAR_ROWS, 4 * k))
        t = cut(with_leaf(targets.select(*names_t), splits))
        q = queries.select(*names_q)
    # Rows are told apart by numbers of their own, as ids may be null.
    q = cut(with_leaf(q, splits).withColumn("_leaf", own if on else F.col("_leaf")).withColumn("_ask", F.monotonically_increasing_id()))
    rank = Window.partitionBy("q__ask").orderBy("d2", *tk)
    keep = ["_ask", *(c for c in qid if c not in on)]

    def best(pairs: DataFrame) -> DataFrame:
        if skip_self:
            same = F.lit(True)
            for a, b in zip(qid, tid, strict=True):
                same = same & (F.col(f"q_{a}") == F.col(f"t_{b}"))
            pairs = pairs.filter(~same)
        if max_dist is not None:
            pairs = pairs.filter(F.col("d2") <= max_dist * max_dist)
        return pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    shown = list(dict.fromkeys([*qk, *(f"q_{c}" for c in XYZ), *(f"t_{c}" for c in names_t), "d2", "rank"]))
    first = best(_meet(q, t, keep, tid, k, None, skip_self, on))
    if splits.leaves == 1:
        return first.select(*shown)
    first = cut(first)
    balls = first.groupBy("q__ask").agg(F.count("*").alias("_n"), F.max("d2").alias("_d")).select(F.col("q__ask").alias("_ask"), F.when(F.col("_n") >= k, F.sqrt("_d")).alias("_ball"))
    # A ball of no size still reaches equal points in its own leaf only, which is what has been asked.
    asked = q.withColumnRenamed("_leaf", "_own").filter("_own >= 0").join(balls, "_ask", "left").withColumn("_reach", F.coalesce("_ball", F.lit(float("inf") if max_dist is None else float(max_dist)))).drop("_ball")
    rest = cut(with_leaf(asked, splits, "_reach").filter("_leaf <> _own"))
    more = _meet(rest, t, keep, tid, k, None, skip_self, on)
    return best(first.drop("rank").unionByName(more)).select(*shown)


def rebuild_plan(splits: Splits, live: np.ndarray, dead: np.ndarray, deleted: float = 0.5, balance: float = 0.7, least: int = 10) -> list[int]:
    """The topmost nodes to rebuild, given the live and deleted points of each leaf.

    A node of more than `least` points is rebuilt if more than `deleted` of them are deleted, or if the points below its
    split, of all but one, are more than `balance` of them or fewer than the rest.
    """
    size, gone = np.zeros(len(splits.child)), np.zeros(len(splits.child))
    for node in range(len(splits.child) - 1, -1, -1):
        c = splits.child[node]
        if c < 0:
            size[node], gone[node] = live[splits.leaf[node]] + dead[splits.leaf[node]], dead[splits.leaf[node]]
        else:
            size[node], gone[node] = size[c] + size[c + 1], gone[c] + gone[c + 1]
    out, todo = [], [0]
    while todo:
        node = todo.pop()
        c = splits.child[node]
        if size[node] > least:
            below = size[c] / (size[node] - 1) if c >= 0 else 0.5
            if gone[node] > deleted * size[node] or below > balance or below < 1 - balance:
                out.append(node)
                continue
        if c >= 0:
            todo += [int(c), int(c) + 1]
    return sorted(out)


def rebuild(index: DataFrame, splits: Splits, deleted: float = 0.5, balance: float = 0.7, least: int = 10, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, Splits, list[int]]:
    """(index without the deleted points of rebuilt nodes, splits that are balanced there again, the nodes rebuilt).

    index has deleted_by, null for live points; only the leaves of rebuilt nodes are touched. A node that shrank may leave those above it out of
    balance, which the next call finds. Counts of leaves and, for each
    node, a bounded sample reach the driver.
    """
    at = cut(with_leaf(index, splits))
    counts = at.groupBy("_leaf").agg(F.sum(F.col("deleted_by").isNull().cast("long")).alias("live"), F.sum(F.col("deleted_by").isNotNull().cast("long")).alias("dead")).collect()
    live, dead = np.zeros(splits.leaves), np.zeros(splits.leaves)
    for r in counts:
        live[r["_leaf"]], dead[r["_leaf"]] = r["live"], r["dead"]
    nodes = rebuild_plan(splits, live, dead, deleted, balance, least)
    if not nodes:
        return index, splits, []
    under: dict[int, list[int]] = {}
    for n in nodes:
        todo, under[n] = [n], []
        while todo:
            m = todo.pop()
            c = int(splits.child[m])
            if c < 0:
                under[n].append(int(splits.leaf[m]))
            else:
                todo += [c, c + 1]
    touched = [x for leaves in under.values() for x in leaves]
    kept = at.filter(~F.col("_leaf").isin(touched) | F.col("deleted_by").isNull())
    new = {n: fit_splits(kept.filter(F.col("_leaf").isin(under[n])), leaf_rows) for n in nodes}
    return kept.drop("_leaf"), _graft(splits, new), nodes


def _graft(tree: Splits, put: dict[int, Splits]) -> Splits:
    """tree with other trees in the places of some nodes; leaves are numbered anew."""
    axis, value, child, todo = [0], [0.0], [-1], [(0, tree, 0)]
    while todo:
        at, source, node = todo.pop()
        if source is tree and node in put:
            source, node = put[node], 0
        axis[at], value[at], c = int(source.axis[node]), float(source.value[node]), int(source.child[node])
        if c >= 0:
            child[at] = len(axis)
            todo += [(len(axis), source, c), (len(axis) + 1, source, c + 1)]
            axis, value, child = [*axis, 0, 0], [*value, 0.0, 0.0], [*child, -1, -1]
    return _numbered(axis, value, child)
