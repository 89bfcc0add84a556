import random
import re
import zlib
from collections import Counter

import pytest

from tillcast.llm import queries as Q, spelling

SMALL = "/root/testdata/sf0.001"


def words(docs, min_letters=7, min_count=2, every=31):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_letters:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= min_count}


def edits(w, letters):
    """All words one edit away."""
    out = {w[:k] + w[k + 1:] for k in range(len(w))}
    out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
    return (out | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters}) - {w}


def brute(count):
    letters = set("".join(count))
    form, rows = {}, {}
    for w, n in count.items():
        near = [x for x in edits(w, letters) if x in count]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 10 * n:
            form[w] = best
        rows[w] = n, len(near)

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, k, count.get(form.get(w))) for w, (n, k) in rows.items())


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(words(docs))
    assert result(Q.QUERIES["op12_spelling"](spark, SMALL)) == want
    assert sum(f is not None for _, f, *_ in want) >= 5


@pytest.mark.parametrize("tile", [1024, 7])
def test_planted_neighbourhoods(spark, tile):
    r = random.Random(4)
    count = {}
    for base in ("abcdefg", "aaaaaaa", "ßéñòûäöü", "anagramx", "zzzzzzzzy", "×÷×÷×÷×"):
        count[base] = 10 ** r.randint(1, 6)
        some = sorted(edits(base, "abgxyzé"))
        for w in r.sample(some, 25):
            count[w] = r.choice((2, 3, 20, 200, 2000))
            for x in r.sample(sorted(edits(w, "abz")), 3):
                count[x] = r.choice((2, 2, 20))
    count["a" * 3000], count["a" * 2999 + "b"], count["a" * 3001], count["b" * 70000] = 2, 50, 700, 2
    df = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    assert result(spelling.variants(df, tile=tile)) == brute_long(count)


def brute_long(count):
    """The long words by hand: the second is one edit from the first, and so is the third."""
    a, b, c, d = "a" * 3000, "a" * 2999 + "b", "a" * 3001, "b" * 70000
    short = brute({w: n for w, n in count.items() if len(w) < 100})
    n = count
    return sorted(short + [(a, c, c, n[a], 2, n[c]), (b, None, b, n[b], 1, None), (c, None, c, n[c], 1, None), (d, None, d, n[d], 0, None)])


def test_chains_of_forms_and_ties(spark):
    count = {"wordone": 2, "wordtwone": 5, "wordzone": 30, "wordzones": 400, "wordzonesx": 5000, "wordozone": 30, "wordbone": 30}
    assert result(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long"))) == brute(count)
    got = {r[0]: r for r in brute(count)}
    assert got["wordone"][1:3] == ("wordbone", "wordbone") and got["wordzone"][2] == "wordzonesx"


def test_edge_rows(spark, edge, nothing):
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for every in (31, 0, 1):
        got = spelling.vocabulary(edge, every=every).collect()
        assert {r.word: r.n for r in got} == words(docs, every=every)
    assert spelling.variants(spelling.vocabulary(nothing)).count() == 0


def test_small_task_memory_gives_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    rows = [{"doc_id": k, "text": f"Wörtchen schreiben {k} schreiben noch einmal"} for k in range(30)]
    import pyarrow as pa
    total = Counter()
    for b in spelling._counted(7, 31)([pa.table({"doc_id": [str(r["doc_id"]) for r in rows], "text": [r["text"] for r in rows]}).to_batches()[0]]):
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            total[w] += n
    assert dict(total) == words([(r["doc_id"], r["text"]) for r in rows], min_count=1)
