"""Leaks that lie exactly at the threshold, in one stretch and in several."""

import random

from lodegraph.llm.leakage import leaks

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(r, n):
    return "".join(r.choice(LETTERS) for _ in range(n))


def test_no_leak_at_the_threshold_is_lost(spark):
    r = random.Random(11)
    docs, passages = [], []
    for i in range(600):
        k = r.choice([1, 1, 2, 3])
        n = 10 * r.randrange(17 * k, 17 * k + 30)  # three tenths of it are k stretches of 50 letters or more
        text, need = _letters(r, n), 3 * n // 10
        sizes = [50] * (k - 1) + [need - 50 * (k - 1)]
        r.shuffle(sizes)
        spare, at, doc = n - need - (k - 1), 0, _letters(r, 60)
        for size in sizes:
            gap = r.randrange(spare // k + 1)
            at += gap
            # other letters stand on both sides of the stretch
            before = r.choice([c for c in LETTERS if at == 0 or c != text[at - 1]])
            after = r.choice([c for c in LETTERS if at + size == n or c != text[at + size]])
            doc += before + text[at : at + size] + after + _letters(r, 60)
            at += size + 1
        docs.append((i, doc))
        passages.append((i, text))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    pp = spark.createDataFrame(passages, "passage_id long, text string")
    got = {(x["doc_id"], x["passage_id"]): x["share"] for x in leaks(dd, pp).collect()}
    assert sorted(got) == [(i, i) for i in range(600)]
    assert all(abs(v - 0.3) < 1e-9 for v in got.values())
