import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm.grams import chosen, hashes, kept, winnow
from lodegraph.llm.leakage import leaks


def text(chars):
    return "".join(map(chr, chars))


def brute(docs, passages, stretch=50, share=0.3):
    out = set()
    for p, t in passages:
        own = text(kept(t)) if t else ""
        for d, x in docs:
            doc = text(kept(x)) if x else ""
            cover = [False] * len(own)
            for i in range(len(own) - stretch + 1):
                if own[i : i + stretch] in doc:
                    cover[i : i + stretch] = [True] * stretch
            if own and sum(cover) >= share * len(own) and any(cover):
                out.add((d, p))
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijกขคงจ") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(5)
    stock = words(r, 12)
    passages = [(i, words(r, 60) + (". " + stock if i % 2 else "")) for i in range(12)]
    docs = []
    for d in range(60):
        t = words(r, 80)
        if d % 3 == 0:
            src = passages[d % 12][1]
            a = r.randrange(0, len(src) // 2)
            t += src[a : a + int(len(src) * r.choice([0.1, 0.2, 0.28, 0.33, 0.4, 0.9]))]
        if d % 4 == 0:
            t += stock
        docs.append((d, t))
    docs += [(100, passages[3][1].upper().replace(" ", "​, ")), (101, None), (102, ""), (103, passages[3][1]), (104, stock * 40), (105, "x" * 30000)]
    passages += [(50, None), (51, ""), (52, "short"), (53, stock), (54, passages[2][1])]
    dd = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    pp = spark.createDataFrame([(i, t, 2) for i, t in passages], "passage_id long, text string, n int")
    got = [(r["doc_id"], r["passage_id"]) for r in leaks(dd, pp).collect()]
    assert len(got) == len(set(got))
    want = brute(docs, passages)
    assert set(got) == want and len(want) > 15


def test_hot_stock_sentence(spark):
    """A sentence in every document and every passage is left out of the search, and nothing is lost."""
    r = random.Random(6)
    stock = words(r, 14)
    passages = [(i, words(r, 90) + " " + stock) for i in range(8)]
    docs = [(d, stock + words(r, 20) + (passages[d % 8][1][: 20 * (d % 30)] if d % 5 == 0 else "")) for d in range(120)]
    got = {(x["doc_id"], x["passage_id"]) for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "passage_id long, text string")).collect()}
    assert got == brute(docs, passages)


def test_empty(spark):
    d, p = spark.createDataFrame([(1, "a" * 60)], "doc_id long, text string"), spark.createDataFrame([(1, "a" * 60)], "passage_id long, text string")
    assert leaks(d.limit(0), p).count() == 0
    assert leaks(d, p.limit(0)).count() == 0
    assert leaks(d, p).count() == 1


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc", min_size=50, max_size=120), st.text(alphabet="abcd", max_size=80), st.text(alphabet="abcd", max_size=80), st.text(alphabet="abcd", max_size=80))
def test_any_stretch_has_a_common_term(shared, a, b, c):
    x, y = kept(a + shared + b), kept(c + shared)
    hx, hy = hashes(x, 40), hashes(y, 40)
    assert set(hx[winnow(hx, 11)].tolist()) & set(hy[winnow(hy, 11)].tolist())


def test_documents_together_equal_documents_alone():
    r = np.random.default_rng(1)
    parts = [r.integers(97, 101, n).astype(np.uint32) for n in (0, 39, 40, 51, 200, 3, 90)]
    doc, pos, h = chosen(parts, 40, 11)
    for i, p in enumerate(parts):
        alone = hashes(p, 40)
        own = set(zip(pos[doc == i].tolist(), h[doc == i].tolist()))
        assert own <= set(enumerate(alone.tolist()))
        if len(alone):
            assert set(winnow(alone, 11).tolist()) <= {a for a, _ in own}


def test_kept():
    assert text(kept("Ａ b-c ๑٢3​ é!")) == "ａbc123é"


def test_stretches_blocks_and_hot_terms(spark, monkeypatch):
    """Positions are those of the shared letters; blocks of passages and parts of hot terms change nothing."""
    import random

    from lodegraph.llm import leakage

    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    stock, passages = word(70), []
    for i in range(12):
        passages.append((i, word(60) + stock + word(70)))
    docs = [(100 + i, word(200) + passages[i % 12][1][: 60 + 70 + i % 3] + word(50)) for i in range(60)] + [(200 + i, word(30) + stock) for i in range(60)]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "passage_id long, text string")
    got = sorted((x["doc_id"], x["passage_id"], round(x["share"], 6), [tuple(s) for s in x["stretches"]]) for x in leakage.leaks(d, p).collect())
    texts, own = dict(docs), dict(passages)
    assert len(got) >= 60
    for doc, q, share, stretches in got:
        assert sum(n for _, _, n in stretches) == round(share * len(own[q]))
        assert all(texts[doc][b : b + n] == own[q][a : a + n] for a, b, n in stretches)
    monkeypatch.setattr(leakage, "_HOT", 5)
    again = sorted((x["doc_id"], x["passage_id"], round(x["share"], 6), [tuple(s) for s in x["stretches"]]) for x in leakage.leaks(d, p, most_bits=10).collect())
    assert again == got


def test_invisible_letters_do_not_hide_a_leak(spark):
    from lodegraph.llm.invisible import INVISIBLE
    from lodegraph.llm.leakage import leaks

    text = "every one of these words stands in the passage and in the document as it is written here and nowhere else"
    docs = spark.createDataFrame([(cp, "x ".join(["", chr(cp).join(text[i : i + 9] for i in range(0, len(text), 9))])) for cp in sorted(INVISIBLE)[:40]], "doc_id long, text string")
    got = {r["doc_id"] for r in leaks(docs, spark.createDataFrame([(1, text)], "passage_id long, text string")).collect()}
    assert got == set(sorted(INVISIBLE)[:40])
