import hashlib
from collections import defaultdict

from tillcast.llm import lines, queries as Q

SMALL = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(lines.UPPER, lines.LOWER)


def brute(docs, min_docs=10):
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[line.strip(BLANK).translate(FOLD)].add(i)
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        left = [x for x in every if not (k := x.strip(BLANK).translate(FOLD)) or len(held[k]) < min_docs]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def check(df, docs, **options):
    got = lines.drop_common_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, options.get("min_docs", 10))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(docs))
    got = Q.QUERIES["op11_lines"](spark, SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == want and any(m for _, _, m, _ in want)


def test_edge_rows_and_clashing_names(edge, nothing):
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for least in (1, 2, 3):
        check(edge, docs, min_docs=least)
    assert lines.drop_common_lines(nothing).count() == 0
    out = lines.drop_common_lines(edge, names=("kept", "score", "size"))
    assert sorted(out.columns) == sorted(edge.columns + ["kept"] * ("kept" not in edge.columns))


def test_white_space_case_ties_and_repeats(spark):
    same = ["Ünder  LINE", " \tünder  line", "Ünder  line\x0b\r", "Ünder  LiNe \x0c", "Ünder line"]
    docs = [(k, f"{same[k % 4]}\nown {k}\n\n{same[k % 4]}") for k in range(9)]
    docs += [(9, same[0]), (9, same[0]), (10, "Ünder line"), (None, "own 3\n"), (None, "x\n" * 5), (11, " \nown 3"), (12, "\n" * 3)]
    for least in (2, 9, 10, 11):
        for parts in (1, 5):
            check(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), docs, min_docs=least)


def test_a_very_long_text(spark):
    docs = [(1, "\n".join(f"line {k % 7000}" for k in range(60000))), (2, "\n".join(f"line {2 * k}" for k in range(3000)))]
    check(spark.createDataFrame(docs, "doc_id long, text string"), docs, min_docs=2)


def test_no_python_in_the_plan(spark):
    plan = Q.QUERIES["op11_lines"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
