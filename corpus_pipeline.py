"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
documents. Null and empty texts are dropped by the first stage, since they have no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointframe.llm import stages
from pointframe.session import cut

STAGES = [
    ("language_id", stages.language_stage),
    ("line_dedup", stages.line_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("sentencepiece", stages.pieces_stage),
]

#: Output codes, dart signatures, string tiling and piece encoding are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage kept is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs
