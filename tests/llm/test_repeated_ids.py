import pytest

from tillcast.llm import simhash

SAME = "same text here for all of them, word by word by word"
ROWS = [(1, SAME), (10, "x" * 70000), (10, "another text under an id that repeats"), (20, SAME), (20, "a text of its own, kept beside the copy"),
        (30, "twice the same row of words"), (30, "Twice  the same row of words"), (None, SAME), (None, None)]


@pytest.mark.parametrize("limit", [1000, 0])
def test_rows_of_one_id_are_decided_apart(spark, limit):
    for parts in (1, 4):
        docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts)
        kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs, max_broadcast=limit).collect()), key=str)
        # the least of equal texts under one id stays, and every row without an id
        assert kept == sorted([ROWS[k] for k in (0, 1, 2, 4, 6, 7, 8)], key=str)
