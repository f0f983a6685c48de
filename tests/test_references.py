from datetime import datetime as T

from lodegraph.operators.references import orphan_references, orphan_report

C = "ref_table string, row_id long, key string, at timestamp"
P = "ref_table string, key string, start timestamp, end timestamp"


def day(n):
    return T(2024, 1, 1 + n)


def brute(children, parents):
    out = []
    for t, i, k, at in children:
        own = [p for p in parents if p[0] == t and p[1] == k]
        if at and any(s and s <= at and (e is None or at < e) for _, _, s, e in own):
            continue
        reason = "missing" if not own else "deleted" if at and any(s and s <= at for _, _, s, _ in own) else "late"
        out.append((t, i, at.strftime("%Y-%m") if at else None, reason))
    return sorted(out, key=repr)


def run(spark, children, parents):
    df = orphan_references(spark.createDataFrame(children, C), spark.createDataFrame(parents, P))
    return sorted(map(tuple, df.collect()), key=repr)


def test_reasons_ties_and_nulls(spark):
    parents = [("t", "A", day(2), day(4)), ("t", "A", day(6), None), ("t", "B", None, None), ("t", "D", day(3), day(3)), ("t", "A", day(2), day(4)), ("u", "C", day(0), None)]
    children = [("t", i, k, at) for i, (k, at) in enumerate([(k, at) for k in "ABCD" for at in (day(1), day(2), day(3), day(4), day(5), day(6), None)])] + [("t", 3, "A", day(4)), ("u", 99, "C", day(0))]
    assert run(spark, children, parents) == brute(children, parents)


def test_random_hot_key(spark):
    import random

    r = random.Random(1)
    key = lambda: "HOT" if r.random() < 0.4 else f"K{r.randrange(30)}"
    when = lambda: T(2024, r.randrange(1, 4), r.randrange(1, 28), r.randrange(24))
    parents = [("t", key(), when(), when() if r.random() < 0.5 else None) for _ in range(200)]
    children = [("t", i, key(), when()) for i in range(800)]
    assert run(spark, children, parents) == brute(children, parents)


def test_empty(spark):
    assert run(spark, [], [("t", "A", day(1), None)]) == []
    assert run(spark, [("t", 1, "A", day(1))], []) == [("t", 1, "2024-01", "missing")]
    df = orphan_references(spark.createDataFrame([("t", 1, "A", day(1)), ("t", 2, "A", day(2))], C), spark.createDataFrame([], P))
    assert [tuple(r) for r in orphan_report(df).collect()] == [("t", "2024-01", "missing", 2)]
