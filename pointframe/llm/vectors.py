"""Vectors as whole numbers, as the operators on embeddings take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of each entry, as long; null for a vector that is null or empty or holds null or non-finite entries."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long")))


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, x) of the sound vectors, their length).

    Vectors that are null or empty or hold null or non-finite entries are left out, and so are those of another length
    than most have (the longer of two that are equally common). Null ids and repeated rows stay, other columns go. The
    length is 0 for a table without a sound vector. Entries beyond a long are its largest or smallest value.
    """
    x = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("x")).filter(F.col("x").isNotNull())
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return x.filter(F.size("x") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of d entries each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
