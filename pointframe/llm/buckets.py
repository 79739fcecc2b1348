"""Links inside of buckets of candidates, without emitting the pairs of a bucket.

Rows that may be alike share a bucket. The most central member of a bucket, whose buckets are the fullest in all, is its
leader, and every member is compared with its leaders. What is then outside of a bucket's largest component is compared
once more, by rows of one member each: all that stand outside of a component in any bucket visit the members of that
component (`visits`), and what is outside meets in its bucket (`meetings`). So every pair of a bucket is compared or
already joined, and no link is lost that would join two components.

Groups of members are compared inside of tasks. One side is held as an index from set elements to members and the other
is streamed by; sides too large for a task are dealt into parts, each part meeting each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import cut
from pointframe.llm.graph import components, fair_share, lookup, sized_join

HELD, HELD_WORDS = 2048, 1_000_000  # members, and elements of their sets, that a task holds of a group, about
PASSED, PASSED_WORDS = 16_384, 8_000_000  # and that it streams by them

INDEXED, BOTH, STREAMED = 0, 1, 2  # sides of a group, in the order in which a task reads them

Linked = Callable[[DataFrame, DataFrame, float], DataFrame]


class _Held:
    """An index from elements to the sets that hold them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.words, self.start = np.unique(every[order], return_index=True)
        self.end = np.append(self.start[1:], len(every))

    def similarities(self, words: np.ndarray) -> np.ndarray:
        """The Jaccard similarity of a set to each that is held; two empty sets are equal."""
        both = np.zeros(len(self.sizes), np.int64)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            at = at[self.words[at] == words]
            n = self.end[at] - self.start[at]
            if total := int(n.sum()):
                own = self.owner[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(total)]
                both = np.bincount(own, minlength=len(self.sizes))
        any_ = self.sizes + len(words) - both
        return np.where(any_ > 0, both / np.maximum(any_, 1), 1.0)


class _Group:
    """One group of a task: its indexed members, and which labels are joined so far."""

    def __init__(self, least: float):
        self.least, self.sets, self.labels, self.index = least, [], [], None
        self.live = np.zeros(0, np.int64)
        self.root: dict[int, int] = {}
        self.both: list[int] = []
        self.streamed: int | None = None  # the label of all streamed members, as long as they have one
        self.mixed = False

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(up, up)
        return x

    def hold(self, label: int, words: np.ndarray, both: bool) -> None:
        if both:
            self.both.append(len(self.sets))
        self.sets.append(words)
        self.labels.append(label)

    def pass_by(self, label: int, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """The new links between labels that a streamed member shows."""
        if self.streamed is None and not self.mixed:
            self.streamed = label
        self.mixed |= label != self.streamed
        if self.index is None:
            self.live, self.index = np.arange(len(self.sets)), _Held(self.sets)
        elif not self.mixed and not self.both:
            # Members that are joined with the one streamed label need no more comparing.
            open_ = [k for k in self.live.tolist() if self.find(self.labels[k]) != self.find(label)] if self.changed else None
            if open_ is not None and len(open_) <= len(self.live) // 2:
                self.live, self.index = np.array(open_, np.int64), _Held([self.sets[k] for k in open_])
        self.changed = False
        if not len(self.live):
            return
        # The least bit of slack keeps a similarity that is equal to the threshold but for rounding.
        for k in np.flatnonzero(self.index.similarities(words) >= self.least - 1e-12).tolist():
            other = self.labels[self.live[k]]
            x, y = self.find(label), self.find(other)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.changed = True
                yield label, other

    def meet(self) -> Iterator[tuple[int, int]]:
        """The links among the members that are on both sides."""
        for k in self.both:
            yield from self.pass_by(self.labels[k], self.sets[k])


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, _Group(least)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("kind", "g", "part")], 1)
            sides, labels, words = batch.column("side").to_numpy(), batch.column("label").to_pylist(), batch.column("o")
            found: list[tuple[int, int]] = []
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]).any(1)
            for k in range(len(keys)):
                if fresh[k] and (now := tuple(keys[k].tolist())) != key:
                    if group.index is None:
                        found += group.meet()
                    key, group = now, _Group(least)
                w = np.frombuffer(words[k].as_py(), np.uint32)
                if sides[k] == STREAMED:
                    if group.index is None:
                        found += group.meet()
                    found += group.pass_by(labels[k], w)
                else:
                    group.hold(labels[k], w, sides[k] == BOTH)
            yield _links(found)
        if group.index is None:
            yield _links(list(group.meet()))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def linked(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): labels that members of at least that similarity join; a group emits fewer links than it has labels.

    groups are (kind, g, part, side, node, label): a member's side is held, streamed or both; sets are (node, occurrences)
    with sorted 32-bit elements.
    """
    keys = ["kind", "g", "part"]
    rows = groups.join(sets.select("node", F.col("occurrences").alias("o")), "node").select(*keys, "side", "label", "o")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_compare(least), "a long, b long")


def _parts(n: str, words: str, most: int, most_words: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(most)), F.ceil(F.col(words) / F.lit(most_words))).cast("int")


def _of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def leader_groups(members: DataFrame, least: float, share: int) -> DataFrame:
    """Each leader with the members of its buckets whose sizes allow the similarity, a member once; it is held, they are streamed."""
    best = members.groupBy("bucket").agg(F.max(F.struct("central", "node", "size")).alias("x"), F.max("n").alias("n"))
    best = best.select("bucket", F.col("x.node").alias("lead"), F.col("x.size").alias("lead_size"), "n")
    near = (F.least("size", "lead_size") >= F.lit(least) * F.greatest("size", "lead_size")) & (F.col("node") != F.col("lead"))
    each = sized_join(members, best, "bucket", "node", share).filter(near)
    pairs = cut(each.select(F.col("lead").alias("g"), "node", "size").distinct())
    sizes = pairs.groupBy("g").agg(F.count("*").alias("_m"), F.sum("size").alias("_mw")).withColumn("_p", _parts("_m", "_mw", PASSED, PASSED_WORDS))
    leads = sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("part"), F.lit(INDEXED).alias("side"), F.col("g").alias("node"))
    met = lookup(pairs, sizes.select("g", "_p"), "g", "node").select("g", _of(F.col("_p")).alias("part"), F.lit(STREAMED).alias("side"), "node")
    return leads.unionByName(met).select(F.lit(0).alias("kind"), "g", "part", "side", "node", F.col("node").alias("label"))


def visits(left: DataFrame) -> DataFrame:
    """What is outside of a main component in some bucket, held, and the members of that component in such buckets, streamed."""
    rows = cut(left.select(F.col("main").alias("g"), "node", "size", "label", F.when(F.col("label") == F.col("main"), STREAMED).otherwise(INDEXED).alias("side")).distinct())
    held = F.col("side") == INDEXED
    sizes = rows.groupBy("g").agg(
        F.count(F.when(held, 1)).alias("_h"), F.sum(F.when(held, F.col("size")).otherwise(0)).alias("_hw"), F.count(F.when(~held, 1)).alias("_m"), F.sum(F.when(held, 0).otherwise(F.col("size"))).alias("_mw")
    )
    sizes = sizes.select("g", _parts("_h", "_hw", HELD, HELD_WORDS).alias("_i"), _parts("_m", "_mw", PASSED, PASSED_WORDS).alias("_j"))
    met = lookup(rows, sizes, "g", "node")
    across = F.sequence(F.lit(0), F.when(held, F.col("_j")).otherwise(F.col("_i")) - 1)
    met = met.withColumn("_x", F.explode(across))
    part = F.when(held, _of(F.col("_i")) * F.col("_j") + F.col("_x")).otherwise(F.col("_x") * F.col("_j") + _of(F.col("_j")))
    return met.select(F.lit(1).alias("kind"), "g", part.alias("part"), "side", "node", "label")


def meetings(left: DataFrame) -> DataFrame:
    """What is outside of the main component of a bucket, if it has several labels; buckets of the same rest meet once."""
    rest = left.filter("label <> main").select(F.col("bucket").alias("g"), "node", "size", "label")
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    sizes = rest.groupBy("g").agg(F.count("*").alias("_h"), F.sum("size").alias("_hw"), mark(1).alias("_a"), mark(2).alias("_b"), F.min("label").alias("_x"), F.max("label").alias("_y"))
    once = sizes.filter("_x <> _y").groupBy("_a", "_b", "_h", "_hw").agg(F.min("g").alias("g")).select("g", _parts("_h", "_hw", HELD, HELD_WORDS).alias("_i"))
    met = lookup(rest, once, "g", "node").withColumn("_own", _of(F.col("_i"))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_i") - 1)))
    part = F.least("_own", "_x") * F.col("_i") + F.greatest("_own", "_x")
    side = F.when(F.col("_own") == F.col("_x"), BOTH).when(F.col("_own") < F.col("_x"), INDEXED).otherwise(STREAMED)
    return met.select(F.lit(2).alias("kind"), "g", part.alias("part"), side.alias("side"), "node", "label")


def link_buckets(spread: DataFrame, total: int, sets_of: Callable[[DataFrame], DataFrame], linked: Linked, least: float) -> DataFrame:
    """(node, label) of the nodes in classes of several; spread has (bucket, node, size), a node once in a bucket.

    total is the number of nodes; sets_of(members) gives what linked(groups, sets, least) compares: it returns (a, b), the
    labels that members of a group join, one held or on both sides and the other streamed or on both sides; members whose
    sizes are further apart than the threshold can't be joined.
    """
    share = fair_share(spread, total)
    sizes = cut(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    heavy = [(r["bucket"], -(-r["n"] // share)) for r in sizes.filter(F.col("n") > share).collect()]  # fewer than partitions times rows a node
    parts = F.broadcast(spread.sparkSession.createDataFrame(heavy, "bucket long, _parts int"))
    one = lambda df: df.join(parts, "bucket", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = one(spread).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).drop("_parts")
    many = one(sizes).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    members = cut(dealt.join(many, ["bucket", "_part"]).drop("_part"))
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    members = cut(members.join(central, "node"))
    sets = sets_of(members)
    labels = cut(components(cut(linked(leader_groups(members, least, share), sets, least))))
    placed = members.filter("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))  # a bucket of two is its leader's
    # Buckets in which more than one component is left, and in each the component of most members.
    inside = placed.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    open_ = inside.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("k"), F.sum("m").alias("n")).filter("k > 1")
    left = cut(sized_join(placed, open_.select("bucket", F.col("x.label").alias("main"), "n"), "bucket", "node", share))
    more = cut(linked(visits(left).unionByName(meetings(left)), sets, least))
    if more.isEmpty():
        return labels
    joined = cut(components(more))  # of labels
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = lookup(labels, new, "label", "node", "left").select("node", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(joined.join(labels, "node", "left_anti").select("node", "label"))
