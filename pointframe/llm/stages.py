"""The operators as filtering and cleaning stages over tables with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.llm import language, lines, neardup, pieces, tiling
from pointframe.llm.common import cut, free_name, table


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told: `und` (no letter) goes, and what is ambiguous without any language
    being the likelier one (score below a half). The model is fitted on docs.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty; columns lang_pred, score and
    ambiguous of docs stay as they are.
    """
    model = language.fit(docs.filter(~language.held_out()))
    names = [free_name(docs, x) for x in ("_lang_pred", "_score", "_ambiguous")]
    found = language.identify(docs, model, names=names)
    return found.filter((F.col(names[0]) != language.UND) & ~(F.col(names[2]) & (F.col(names[1]) < 0.5))).select(*docs.columns)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs without boilerplate lines, n_chars counted anew; no document goes."""
    out = lines.drop_boilerplate(docs).drop("n_dropped")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each near-duplicate class: the one of least id. A row that occurs twice stays once."""
    classes = cut(neardup.near_duplicates(docs, id_col))
    kept = classes.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy(id_col).agg(F.count("*").alias("_n"))  # two columns, whatever docs has
    out = docs.join(kept, docs[id_col].eqNullSafe(kept[id_col]), "left_semi")
    # Repeated ids, which no table should have, need another pass: rows of one id may be of one or of several classes.
    if kept.filter((F.col("_n") > 1) | F.col(id_col).isNull()).limit(1).count():
        out = out.dropDuplicates([id_col, "text"])
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay; an empty table stays empty."""
    hits = free_name(docs, "_hits")
    return tiling.contaminations(docs, items, hits_col=hits).filter(F.size(hits) == 0).drop(hits)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The columns of docs with the ids of each text and whether they decode to the text again."""
    coded = pieces.encode_decode(docs, model_path or pieces.default_model())
    text = F.coalesce("text", F.lit(""))
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == text).alias("round_trip"))
