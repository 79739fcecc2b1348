"""Joins and connected components that stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import cut

LEAST_HEAVY = 64
TASK_LINKS = 200_000  # links that a task of the component search takes at least, so that few links don't make many small files


def fair_share(df: DataFrame, rows: int) -> int:
    """The rows of an average shuffle partition: a key of more rows is heavy, and there are fewer heavy keys than partitions."""
    return max(LEAST_HEAVY, rows // max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def sized_join(left: DataFrame, right: DataFrame, key: str, spread: str, share: int, n: str = "n") -> DataFrame:
    """Inner join of many left rows with the one right row of a key, where both sides know the key's number of rows n.

    A key of n rows is dealt into n / share parts by a hash of `spread`; its right row goes to each of them.
    """
    parts = lambda: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(share))).cast("int")
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(spread), parts()).cast("int"))
    many = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts() - 1)))
    return dealt.join(many.drop(n), [key, "_part"]).drop("_part")


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str | Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left with the columns of right, which has one narrow row for each key; the heavy keys of left are dealt into parts.

    The heavy keys are counted first; there are fewer of them than shuffle partitions, so their list may be broadcast.
    If left is known to have few rows, none is heavy.
    """
    if rows is not None and rows <= TASK_LINKS:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    share = fair_share(left, total or 0)
    if (most or 0) <= share:
        return left.join(right, key, how)
    heavy = [(r[0], r[1] // share + 1) for r in counts.filter(F.col("_n") > share).collect()]
    parts = F.broadcast(left.sparkSession.createDataFrame(heavy, f"{key} {left.schema[key].dataType.simpleString()}, _parts int"))
    one = lambda df: df.join(parts, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = one(left).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).drop("_parts")
    many = one(right).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(many, [key, "_part"], how).drop("_part")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label) of the nodes that have links; label is the least node of the component.

    Alternates two steps until nothing changes: every node hands its least neighbour to its larger neighbours, then to
    its smaller ones and itself. The number of rounds grows with the logarithm of the longest path. Minima are taken before
    the shuffle and handed out by joins that split heavy nodes, so a node of very many neighbours meets in no single task.
    """
    rows = links.count()  # of edges; no step makes more than twice as many
    parts = rows // TASK_LINKS + 1
    edges = cut(links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a < b").distinct().coalesce(parts))
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if tuple(state) == seen or not state["n"]:
            break
        seen = tuple(state)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        # m is the least neighbour or the node itself; only the larger neighbours are taken over to it.
        large = cut(lookup(both, least, "a", "b", rows=2 * rows).filter("b > a AND m < b").select(F.col("m").alias("a"), "b").distinct().coalesce(parts))
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = lookup(large, least, "b", "a", rows=2 * rows)
        edges = cut(
            small.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
            .unionByName(small.select(F.col("m").alias("a"), "b"))
            .filter("a < b")
            .distinct()
            .coalesce(parts)
        )
    label = edges.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label")
    return label.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
