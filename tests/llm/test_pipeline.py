"""The pipeline, stage by stage, against what each stage alone decides."""

import corpus_pipeline
from pyspark.sql import functions as F

from pointframe.llm import language, neardup, stages, tiling
from pointframe.llm.lines import drop_boilerplate


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf_dir).persist()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        kept.append((name, seen, out))
        seen = out
    by = {n: (a, b) for n, a, b in kept}
    a, b = by["language_id"]
    assert b.count() == a.filter(F.regexp_like("text", F.lit(r"\p{L}"))).count()
    a, b = by["line_dedup"]
    assert b.count() == a.count()
    assert b.select("text").exceptAll(drop_boilerplate(a).select("text")).count() == 0
    assert b.filter(F.col("n_chars") != F.length("text")).count() == 0
    a, b = by["near_dedup"]
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(a).collect()}
    assert sorted(r.doc_id for r in b.collect()) == sorted(i for i, c in classes.items() if i == c)
    a, b = by["decontamination"]
    bad = {r.doc_id for r in tiling.contaminations(a, spark.read.parquet(sf_dir + "/benchmark.parquet")).filter(F.size("hits") > 0).collect()}
    assert bad and {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect()} - bad
    assert seen.filter("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in seen.collect())


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", None, 5), (2, "", None, None, 0, 5), (3, "!!! 123", "en", "a", 7, 5), (4, "the words of the text in this place", "en", "a", 3, 5), (4, "the words of the text in this place", "en", "a", 3, 5), (None, "das ist nicht der Text von hier und heute", "de", "b", 3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    left = stages.keep_one_of_each_class(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, rows[5][1]), (1, ""), (3, "!!! 123"), (4, rows[3][1])]
    assert stages.drop_repeated_lines(docs).count() == 6 and left.columns == docs.columns
    assert stages.drop_contaminated(docs, spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")).count() == 4
    assert language.identify(docs, language.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
