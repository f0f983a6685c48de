"""Document frequencies are counted over all documents, short ones too."""

from lodegraph.llm import reading


def test_short_documents_count(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "plain words only " * 20) for i in range(4)] + [(10 + i, "zebra") for i in range(12)] + [(30, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 2)], "doc_id long, reading_level int")
    real, seen = reading.familiar_words, []
    monkeypatch.setattr(reading, "familiar_words", lambda d: seen.append(real(d)) or seen[-1])
    assert sorted(r["doc_id"] for r in reading.reading_levels(docs, labels).collect()) == [0, 1, 2, 3]
    words, _ = reading._Latin()("zebra plain")
    assert [round(float(seen[0][0][b]), 4) for b in words] == [0.75, 0.25]
