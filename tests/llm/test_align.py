import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from tillcast.llm import align, queries as Q

SMALL = "/root/testdata/sf0.001"
A, B, RANKS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers(A, B)


def groups(t, text):
    """[(ids a, ids b)] of a text, by walking along both."""
    if not text:
        return []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    want = b" " + text.encode()
    if b"".join(t.bytes_a[i] for i in a) != want or b"".join(t.bytes_b[i] for i in b) != want:
        return []
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((t.bytes_a, a), (t.bytes_b, b))]
    both, out, x, y = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for c in both:
        p, q = ends[0].index(c, x) + 1, ends[1].index(c, y) + 1
        out.append((a[x:p], b[y:q]))
        x, y = p, q
    return out


def brute(t, docs):
    found = [(i, groups(t, text)) for i, text in docs]
    count, best = Counter(), defaultdict(int)
    for _, g in found:
        count.update({(a, b) for x, y in g for a in x for b in y})
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, g in found:
        links = [(a, b) for x, y in g for a in x for b in y]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[k] == best[k[0]] for k in links),
                    sum(count[k] for k in links), hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> and </s> <unk>", "▁ piece mark", "=" * 3000, "  two  spaces \n\n\t tabs", "漢字かな交じり文", "\x00\x01\x02", "é" * 500, "ZXQJ" * 900,
       "aGVsbG8gd29ybGQ=" * 40, "😀👍🏽" * 30, "123456789012345678901234567890", " 　​", " leading", "trailing "]


def fuzz(n=60):
    r = random.Random(8)
    return ["".join(r.choice("ab cdéñ漢😀\n12<|>s/_=") for _ in range(r.randint(1, 80))) for _ in range(n)]


def test_query(spark, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in Q.QUERIES["op13_align"](spark, SMALL).select(COLUMNS).collect()), key=str) == brute(tokenizers, docs)


@pytest.mark.parametrize("block, ranks", [(1, None), (1 << 23, RANKS)])
def test_odd_texts_repeats_and_blocks(spark, tokenizers, edge, block, ranks):
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()] + list(enumerate(ODD + fuzz(), 100))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in align.linked(df, A, B, block=block, byte_ranks=ranks).select(COLUMNS).collect()), key=str) == brute(tokenizers, docs)


def test_groups_of_rows_with_clashing_names(tokenizers, edge, nothing):
    out = align.align(edge, A, B, name="found")
    assert sorted(out.columns) == sorted(edge.columns)
    for r in out.select("text", "found").collect():
        assert [(g.a, g.b) for g in r.found] == groups(tokenizers, r.text)
    assert align.align(nothing, A, B).count() == align.linked(nothing, A, B).count() == 0


def test_shared_cuts_of_random_ends():
    r = np.random.default_rng(2)
    for step in (1, 3, 40):
        ends, first = ([], []), ([0], [0])
        for _ in range(30):
            size = int(r.integers(1, 400))
            base = ends[0][-1] if ends[0] else 0
            for own, f in zip(ends, first):
                inner = np.flatnonzero(r.random(size - 1) < 1 / step) + 1 if size > 1 else []
                own += [base + int(x) for x in inner] + [base + size]
                f.append(len(own))
        a, b = map(np.array, ends)
        cut_a, cut_b = align.shared_cuts(a, b, np.array(first[0]), np.array(first[1]))
        both = np.intersect1d(a, b)
        assert (a[cut_a] == both).all() and (b[cut_b] == both).all() and len(cut_a) == len(both)


def test_a_long_interval_without_cuts():
    n = 20000
    a, b = np.append(np.arange(1, n) * 2, 2 * n), np.append(np.arange(1, n) * 2 - 1, 2 * n)
    b[7] = a[7]  # one shared cut far from the middle
    cut_a, cut_b = align.shared_cuts(a, b, np.array([0, n]), np.array([0, n]))
    both = np.intersect1d(a, b)
    assert (a[cut_a] == both).all() and (b[cut_b] == both).all()


def test_wide_groups_count_their_links_like_narrow_ones(tokenizers):
    x = align.Alignment(tokenizers, ODD + fuzz())

    def total(wide):
        out = Counter()
        for t, a, b, n in zip(*(v.tolist() for v in x.links(wide))):
            out[t, a, b] += n
        return out
    assert total(0) == total(1) == total(4096)


def test_ranks_give_the_same_ids_on_settled_code_points(tokenizers):
    fast = align.Tokenizers(A, B, RANKS)
    points = [chr(c) for c in range(0x250)]
    texts = [f"{x}{c}{y}" for c in points for x in ("", "a", " ", "7", ".", "\n", "\x85", "'") for y in ("", "b", "  ", "3", "!", "\xa0", "s ")]
    r = random.Random(1)
    texts += ["".join(r.choices(points, k=40)) for _ in range(3000)]
    assert not any(align._SETTLED.search(t) for t in texts)
    assert fast.encode(texts) == tokenizers.encode(texts)
    assert align._SETTLED.search("\u0250") and fast.encode(["漢字 x"]) == tokenizers.encode(["漢字 x"])


def test_ranks_of_another_vocabulary_are_refused():
    with pytest.raises(ValueError):
        align.Tokenizers(A, B, P.path("byte_bpe_multi_50k.tiktoken"))
