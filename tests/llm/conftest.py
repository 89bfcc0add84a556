import pytest

LONG = "word%d other text, " * 12000
# Nulls, empty and blank texts, no letters, very long, not ASCII, repeated rows, ids that are null or repeat
EDGE = [
    (1, "A plain sentence about nothing much. Another one follows it.", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"),
    (5, "12345 !!! ???", "en"), (6, "😀 ñandú größer 漢字 é  x", "es"), (7, LONG % tuple(range(12000)), "en"),
    (8, "same text here for all of them, word by word by word", "en"), (8, "same text here for all of them, word by word by word", "en"),
    (9, "same text here for all of them, word by word by word", None), (None, "no id on this one, sadly", "en"),
    (10, "x" * 70000, "de"), (10, "another text under an id that repeats", "de"), (11, "ab", None), (12, "\x00\x01 control\x7f", "en"),
]
# Names that operators use for what they add
CLASH = ["lang_pred", "score", "fp", "ids", "pii", "leaks", "decoded", "ids_le", "row", "doc", "h", "size", "shard", "slot", "found",
         "spans", "kept", "predicted", "offending", "held_out", "fingerprint", "component", "__text", "__keep", "__pii", "id", "v"]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["old"] * len(CLASH)) for i, t, lang in EDGE],
                               ", ".join(["doc_id long, text string, lang string, source string, n_chars long",
                                          *[f"`{c}` string" for c in CLASH]]))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("doc_id = -1")
