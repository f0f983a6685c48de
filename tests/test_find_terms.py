"""Terms in texts: the automaton, the runs with and without a presence filter, and brute force give the same."""

import random

from lodegraph.operators import rulings as R


def _rows():
    r = random.Random(5)
    word = lambda a, b: "".join(r.choice("กขab \U0001f600e\u0301\n") for _ in range(r.randrange(a, b)))
    texts = [(i, word(0, 90)) for i in range(120)] + [(120, None), (121, ""), (5, "ab" * 200)]
    held = [t[i : i + n] for _, t in texts if t for n in (1, 2, 3, 5, 7, 11, 20, 50, 80) for i in [r.randrange(len(t))]]
    terms = [(f"o{i % 40}", w) for i, w in enumerate(held + [word(1, 30) for _ in range(60)] + ["", None])]
    return texts, terms


def test_ways_agree_with_brute_force(spark):
    texts, terms = _rows()
    d, t = spark.createDataFrame(texts, "i long, txt string").repartition(3), spark.createDataFrame(terms, "o string, w string")
    low = lambda x: (x or "").lower()
    want = sorted({(i, o, low(w)) for i, x in texts for o, w in terms if low(w) and low(w) in low(x)})
    for most in (10**6, 0):
        got = sorted(tuple(r) for r in R.find_terms(d, t, "i", "txt", "o", "w", most_broadcast=most).select("text_id", "term_id", "term").collect())
        assert got == want
    words = t.selectExpr("lower(w) AS term").filter("term <> ''").distinct()
    pairs = sorted({(i, w) for i, _, w in want})
    for present in (R.MOST_PRESENT, 1):
        got = R._terms_by_runs(d.selectExpr("i AS text_id", "lower(txt) AS txt").filter("txt <> ''"), words, present).distinct().collect()
        assert sorted(map(tuple, got)) == pairs


def test_no_terms_and_no_texts(spark):
    d, t = spark.createDataFrame([(1, "ab")], "i long, txt string"), spark.createDataFrame([("o", "a")], "o string, w string")
    for x, y in ((d.limit(0), t), (d, t.limit(0))):
        assert R.find_terms(x, y, "i", "txt", "o", "w", most_broadcast=-1).count() == 0


def test_owners_of_terms_are_not_brought_to_the_driver(spark):
    d, t = spark.createDataFrame([(1, "ab")], "i long, txt string"), spark.createDataFrame([("o", "a")], "o string, w string")
    found = R.find_terms(d, t, "i", "txt", "o", "w")
    assert "broadcast" not in found._jdf.queryExecution().logical().toString().lower()


def test_runs_that_no_term_has_are_not_shuffled():
    import numpy as np
    import pyarrow as pa

    class Shared:
        value = None

    text = "abcdefghij" * 50
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["text_id", "txt"])
    (known,) = R._hashed(iter([pa.RecordBatch.from_arrays([pa.array(["cdef"]), pa.array(["cdef"])], ["term", "run"])]))
    h = np.uint64(known.column(1)[0].as_py() % (1 << 64))
    present = np.zeros(1 << 13, np.uint8)
    at = int(h >> np.uint64(48))
    present[at >> 3] |= 1 << (at & 7)
    Shared.value = (16, present)
    assert sum(b.num_rows for b in R._cutter(Shared, [4])(iter([batch]))) == 50
    Shared.value = (0, None)
    assert sum(b.num_rows for b in R._cutter(Shared, [4])(iter([batch]))) == len(text) - 3
