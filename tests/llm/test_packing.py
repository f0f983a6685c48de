from collections import defaultdict

import pytest

from lodegraph.llm.packing import TOKENIZER, OpenWindows, fill_report, pack, token_counter


def check(rows, sizes, capacity):
    pieces = defaultdict(list)
    for r in rows:
        assert r["used"] == sum(i["tokens"] for i in r["items"]) <= capacity
        assert r["used"] + r["space"] == capacity and r["n_items"] == len(r["items"]) > 0
        for i in r["items"]:
            pieces[i["doc_id"]].append((i["piece"], i["token_from"], i["tokens"]))
    assert set(pieces) == {d for d, n in sizes.items() if n}
    for d, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert sum(t for _, _, t in own) == sizes[d]
        assert all(f == p * capacity for p, f, _ in own)
        assert len(own) == -(-sizes[d] // capacity)  # undivided unless longer than a container
    assert len({r["container"] for r in rows}) == len(rows)


def test_round_trip(spark):
    words = ["rice", "market", "ข้าว", "fish", "certificate", "ตลาด"]
    texts = [" ".join(words[(i + j) % 6] for j in range(n)) for i, n in enumerate([1, 3, 40, 400, 7, 0, 90, 15, 1200, 60] * 12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "a" * 20000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, container string").repartition(7)
    count = token_counter(TOKENIZER)
    sizes = {i: count([t])[0] for i, t in rows if t}
    for windows in (1, 2, 64):
        got = pack(df, "doc_id", "text", capacity=100, windows=windows, merge=3).collect()
        check(got, sizes, 100)
    full = fill_report(pack(df, "doc_id", "text", capacity=100)).first()
    assert full["tokens"] == sum(sizes.values()) and full["fill"] > 0.95


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pack(df, "doc_id", "text").count() == 0
    assert pack(df.limit(0), "doc_id", "text").count() == 0
    assert fill_report(pack(df, "doc_id", "text")).first()["tokens"] == 0


def test_best_fit_emits_the_fullest():
    w = OpenWindows(10, 2)
    assert w.place((1, 0, 0, 6)) is None
    assert w.place((2, 0, 0, 7)) is None
    assert w.place((3, 0, 0, 4)) == (0, [(1, 0, 0, 6), (3, 0, 0, 4)])  # fills the first to the brim
    assert w.place((4, 0, 0, 9)) is None
    assert w.place((5, 0, 0, 8)) == (2, [(4, 0, 0, 9)])
    assert sorted(k for k, _ in w.rest()) == [1, 3]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokenizers(name):
    count = token_counter(f"/opt/tokenizers/{name}")
    one, two = count(["hello world", "ตลาดน้ำ"])
    assert one >= 2 and two >= 1
