import ast
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_exact import components

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_takes_odd_and_no_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        for k, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, docs, SMALL)
            if k + 1 < len(C.STAGES):
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_run_against_stages_by_hand(spark):
    from tillcast.llm import decontam, langid
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = C.run(spark, SMALL).toPandas().set_index("doc_id")
    told = langid.identify(spark, docs, langid.train(docs.where("crc32(cast(doc_id as string)) % 3 != 1")))
    kept = told.where("lang_pred != 'und' and score >= 0.5").select(*COLUMNS)
    told = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    placed = map(ast.literal_eval, components(told))  # by brute force
    kept = kept.where(F.col("doc_id").isin([i for i, _, root in placed if i == root]))
    leaks = decontam.find_leaks(kept, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("size(leaks) > 0").select("doc_id")
    kept = kept.join(leaks, "doc_id", "left_anti").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(kept.index) and 100 < len(got) < docs.count()
    for i, text in kept.text.items():
        if "@" not in text and "+" not in text and not any(c.isdigit() for c in text):
            assert got.loc[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert got.loc[i].n_chars == len(text) and got.loc[i].n_tokens == len(got.loc[i].ids)
