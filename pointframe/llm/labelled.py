"""Labelled rows for fitting: one label per document, the fit folds only, at most about a stated number of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.llm.common import crc_fold, table

FIT_ROWS = 200_000  # labelled documents that a fit reads, about


def held_out():
    """Whether a document's label must not be learned from: crc32 of its id is 1 modulo 3."""
    return crc_fold(F.col("doc_id"), 3) == 1


def label_sample(spark: SparkSession, sf_dir: str, column: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y) of documents that may be learned from.

    Null ids and labels are left out, repeated labels count once, and a document with both labels is left out. If
    more than fit_rows documents remain, a sample of about fit_rows by hash of the id is taken.
    """
    one = (
        table(spark, sf_dir, "labels")
        .filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(column).alias("y"), F.max(column).alias("_max"))
        .filter(F.col("y") == F.col("_max"))
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )
    n = one.count()
    if n > fit_rows:
        one = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    return one
