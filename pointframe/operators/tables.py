"""Small operators over keyed tables: ranked rows, insertion of what is absent, queues, equal times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per(df: DataFrame, keys: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first `most` rows of each group; fewer if there are fewer. Ties go by the last columns of the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with the rows of new whose keys it doesn't have, the first by `order` of those with equal keys."""
    fresh = new.join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(top_per(fresh, keys, order, 1).select(*table.columns))


def remove_first(queue: DataFrame, gone: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The queue without the first row, by `order`, of each of the given keys; later rows of a key stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = queue.withColumn("_rank", F.row_number().over(w))
    return ranked.join(gone.select(*keys).distinct().withColumn("_rank", F.lit(1)), [*keys, "_rank"], "left_anti").select(*queue.columns)


def at_equal_times(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys and times; the batch form of the stream join, without a wait."""
    return left.join(right, keys)


def running_mean(df: DataFrame, on: list[str], order: list[str], value: str, out: str, window: int | None = None) -> DataFrame:
    """df with the mean of value over all rows so far, or over the last `window` of them."""
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding if window is None else 1 - window, 0)
    return df.withColumn(out, F.avg(value).over(w))
