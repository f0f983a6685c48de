import random

import numpy as np

from lodegraph.llm import reading
from lodegraph.llm.reading import document_frequencies, is_thai, level_profile, reading_levels
from lodegraph.session import table

SF = "/root/testdata/sf0.1"


def test_accuracy_against_agreeing_raters(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "reading_labels")
    train, held = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = {r["doc_id"]: r["reading_level"] for r in reading_levels(docs, train).collect()}
    by = {}
    for r in held.collect():
        by.setdefault(r["doc_id"], []).append(r["reading_level"])
    sure = [(got[d], v[0]) for d, v in by.items() if d in got and len(v) > 1 and len(set(v)) == 1]
    assert len(sure) >= 100
    assert set(got) == {r["doc_id"] for r in docs.filter("length(text) >= 200").select("doc_id").collect()}
    assert set(got.values()) <= {1, 2, 3, 4, 5}
    assert np.mean([abs(a - b) <= 1 for a, b in sure]) >= 0.99
    assert np.mean([a == b for a, b in sure]) >= 0.88


def test_frequencies_equal_counting(spark):
    r = random.Random(0)
    texts = [" ".join(r.choice(["rice", "fish", "law", "Rice"]) for _ in range(r.randrange(1, 9))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = sorted(x["df"] for x in document_frequencies(df).filter("script = 0 AND bucket >= 0").collect())
    want = sorted(sum(w in t.lower().split() for t in texts) for w in ("rice", "fish", "law"))
    assert got == want
    assert document_frequencies(df).filter("bucket = -1").groupBy().sum("df").first()[0] == 50


def test_without_labels_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 100), (5, "ข้าวและปลา " * 60), (6, "." * 400), (7, "word " * 20000), (4, "word " * 100), (8, "1234567890 " * 40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, reading_level int")
    labels = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    got = sorted(map(tuple, reading_levels(df, labels).collect()))
    assert [d for d, _ in got] == [4, 4, 5, 6, 7, 8] and all(1 <= v <= 5 for _, v in got)
    assert reading_levels(df.limit(0), labels).count() == 0
    few = spark.createDataFrame([(4, "r1", None), (4, "r2", 3)], "doc_id long, rater string, reading_level int")
    assert level_profile(reading_levels(df, few)).groupBy().sum("n_docs").first()[0] == 6


def test_script():
    assert is_thai("ตลาดน้ำ market") and not is_thai("the market ตลาด is open all day long")
    assert len(reading._thai_words("ก")) == 0
