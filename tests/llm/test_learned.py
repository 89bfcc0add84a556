"""Trained operators: held-out accuracy, and defined results for odd input."""

import pytest
from pyspark.sql import functions as F

from tillcast.llm import langid, quality, queries as Q, toxicity

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held_out(spark, name, truth):
    got = Q.QUERIES[name](spark, MID)
    assert got.count() == spark.read.parquet(f"{MID}/documents.parquet").count()
    known = spark.read.parquet(f"{MID}/{'documents' if truth == 'lang' else 'labels'}.parquet").select("doc_id", truth)
    return got.join(known, "doc_id").where("held_out").toPandas()


def test_language_held_out(spark):
    x = held_out(spark, "op1_langid", "lang")
    assert (x.lang == x.lang_pred).mean() > 0.98 and x.score.between(0, 1).all()


def test_language_edge(spark, edge, nothing):
    model = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    out = langid.identify(spark, edge, model)
    assert set(out.columns) == set(edge.columns) and out.count() == edge.count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.where("doc_id < 8").collect()}
    for i in (2, 3, 4, 5):
        assert got[i] == ("und", 0.0)
    assert got[1][0] != "und" and got[7][0] != "und"
    assert langid.identify(spark, nothing, model).count() == 0
    unlearned = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(spark, edge, unlearned).collect()} == {"und"}


def test_toxicity_held_out(spark):
    x = held_out(spark, "op5_toxicity", "toxic")
    hit = x[x.toxic == 1]
    assert (hit.predicted == 1).mean() > 0.7 and (x[x.toxic == 0].predicted == 1).mean() < 0.08
    assert (x.predicted == (x.score >= 0.3)).all() and x.score.between(0, 1).all()


def test_toxicity_finds_the_sentence(spark):
    rows = [(i, f"We saw thing{i} today. " + (f"It part{i % 50} gronk thing{i % 40}. " if i % 3 == 0 else f"It part{i % 50} was good. ")
             + f"Then part{i} ended.", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score_texts(spark, spark.createDataFrame([(1, "Ça va bien é. What a filthy gronk he is! Good day."), (2, "Nice day.")], "doc_id long, text string"),
                               toxicity.train(docs)).orderBy("doc_id").collect()
    assert [r.predicted for r in out] == [1, 0]
    span = out[0].offending[0]
    assert "Ça va bien é. What a filthy gronk he is! Good day."[span.start:span.end] == "What a filthy gronk he is"


def test_quality_held_out(spark):
    x = held_out(spark, "op8_quality", "quality")
    assert ((x.quality == 1) == (x.predicted == 1)).mean() > 0.93
    assert (x.predicted == (x.score >= 0.7)).all() and x.score.between(0, 1).all()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_edge_rows(spark, edge, nothing, module, label):
    labelled = spark.read.parquet(f"{SMALL}/documents.parquet").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    for model in (module.train(labelled), module.train(labelled.where(F.col(label) == 1)),
                  module.train(labelled.where("doc_id < 0")), module.train(labelled.withColumn(label, F.lit(None).cast("int")))):
        out = module.score_texts(spark, edge, model)
        assert set(out.columns) == set(edge.columns) | {"offending"}
        got = out.select("doc_id", "score", "predicted").collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert module.score_texts(spark, nothing, model).count() == 0
