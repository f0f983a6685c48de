import random

from lodegraph.operators.components import connected_components
from lodegraph.operators.intervals import buddhist_year, lineages, periods_and_gaps


def brute(rows):
    out = set()
    for ent in {r[0] for r in rows}:
        years = sorted({y for e, a, b in rows if e == ent and a is not None and b is not None for y in range(a, b + 1)})
        runs = []
        for y in years:
            if runs and runs[-1][1] == y - 1:
                runs[-1][1] = y
            else:
                runs.append([y, y])
        out |= {(ent, "period", a, b) for a, b in runs}
        out |= {(ent, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "lineage long, s int, e int")
    got = [tuple(r) for r in periods_and_gaps(df, "lineage", "s", "e").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_intervals(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), a := r.randrange(60), a + r.randrange(-3, 9)) for _ in range(400)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, 5, 5), (1, 5, 5), (1, 6, 7), (1, 9, 9), (2, 9, 3), (3, None, 4), (4, 0, 9999), (4, 3, 4)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()


def test_years(spark):
    df = spark.createDataFrame([("2542",), ("พ.ศ. ๒๕๖๐",), ("2017",), (" nan ",), ("",), (None,), ("2560.0",), ("25600",), ("ราวปี ๒๐๑๗",)], "t string")
    assert [r[0] for r in df.select(buddhist_year("t")).collect()] == [2542, 2560, 2560, None, None, None, 2560, None, 2560]


def test_components_of_chains_circles_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 220)]
    circle = [(300 + i, 300 + (i + 1) % 30) for i in range(30)]
    hub = [(500, 501 + i) for i in range(200)]
    noise = [(1, 1), (None, 4), (7, None), (8, 9), (9, 8), (8, 9)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain + circle + hub + noise, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 221)} | {i: 300 for i in range(300, 330)} | {i: 500 for i in range(500, 701)} | {8: 8, 9: 8}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lineages(spark):
    rows = [(5, "A-1", None), (2, "a1", "B/2"), (9, "B2", "missing"), (4, "C3", "c 3"), (7, None, "A1"), (8, None, None), (11, "D4", "nan"), (12, "E5", "Z9"), (13, "F6", "Z9")]
    got = dict(map(tuple, lineages(spark.createDataFrame(rows, "row_id long, reg_id string, supersedes string")).collect()))
    assert got == {5: 2, 2: 2, 9: 2, 4: 4, 7: 2, 8: 8, 11: 11, 12: 12, 13: 13}
