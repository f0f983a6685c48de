import numpy as np
import pytest

from lodegraph.operators.spatial import Box, RTree, distance_m, near_pairs, regions_of_points

BOX = Box(5.0, 21.0, 96.0, 106.0)
SCHEMA = "row_id long, key string, lat double, lon double, extra string"


def brute(rows, within):
    rows = [r for r in rows if r[2] is not None and r[3] is not None and 5 <= r[2] <= 21 and 96 <= r[3] <= 106]
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] != b[1] and distance_m(a[2], a[3], b[2], b[3]) <= within}


@pytest.mark.parametrize(("leaf", "task", "members"), [(2000, 20000, 1000), (20, 15, 1)])
def test_near_pairs(spark, leaf, task, members):
    r = np.random.default_rng(4)
    n = 400
    lat = 13.0 + r.normal(0, 0.002, n)
    lon = 100.0 + r.normal(0, 0.002, n)
    rows = [(i, f"k{r.integers(60)}" if i % 17 else None, float(lat[i]), float(lon[i]), "x") for i in range(n)]
    rows += [(n + i, f"h{i % 3}", 13.0, 100.0, None) for i in range(30)]  # one spot, three keys
    rows += [(900, "a", None, 100.0, ""), (901, "b", float("nan"), 100.0, ""), (902, "c", 0.0, 0.0, ""), (903, "d", 21.0, 106.0, ""), (904, "e", 20.9999, 106.0, ""), (905, "f", 5.0, 96.0, ""), (906, "g", 5.0, 96.0, "")]
    got = [tuple(x) for x in near_pairs(spark.createDataFrame(rows, SCHEMA), "row_id", "key", "lat", "lon", 60.0, BOX, leaf, task, members).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 60.0)


def test_empty(spark):
    assert near_pairs(spark.createDataFrame([], SCHEMA), "row_id", "key", "lat", "lon", 60.0, BOX).count() == 0


@pytest.mark.parametrize(("task", "leaf"), [(20_000, 2_000), (1, 1)])
def test_regions_with_hole_parts_and_null_vertex(spark, task, leaf):
    sq = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = [(1, 1, i, *p) for i, p in enumerate(sq(100.0, 10.0, 1.0))] + [(1, 2, i, *p) for i, p in enumerate(sq(100.4, 10.4, 0.2))] + [(2, 1, i, *p) for i, p in enumerate(sq(103.0, 10.0, 0.5))] + [(2, 2, i, *p) for i, p in enumerate([*sq(104.0, 12.0, 0.5), (104.0, 12.0)])]
    # a vertex without a coordinate is no vertex: its neighbours are joined
    rings += [(3, 1, i, *p) for i, p in enumerate([(98.0, 8.0), (98.0, None), (99.0, 8.0), (None, 8.5), (99.0, 9.0), (98.0, 9.0), (None, None)])]
    ring_df = spark.createDataFrame(rings, "province_id long, ring_no int, seq int, lon double, lat double")
    pts = [(1, 10.1, 100.1), (2, 10.5, 100.5), (3, 10.25, 103.25), (4, 12.25, 104.25), (5, 15.0, 101.0), (6, None, 100.1), (7, 10.1, 100.1), (8, 8.5, 98.5), (9, 8.25, 98.9), (10, 21.0, 106.0)]
    df = spark.createDataFrame(pts, "row_id long, lat double, lon double")
    got = sorted(map(tuple, regions_of_points(df, "row_id", "lat", "lon", BOX, ring_df, "province_id", "ring_no", "seq", "lat", "lon", task, leaf).collect()))
    assert got == [(1, 1), (1, 7), (2, 3), (2, 4), (3, 8), (3, 9)]
    assert regions_of_points(df.limit(0), "row_id", "lat", "lon", BOX, ring_df, "province_id", "ring_no", "seq", "lat", "lon").count() == 0
    assert regions_of_points(df, "row_id", "lat", "lon", BOX, ring_df.limit(0), "province_id", "ring_no", "seq", "lat", "lon").count() == 0


@pytest.mark.parametrize("leaf", [2_000, 3])
def test_regions_against_brute_force(spark, leaf):
    r = np.random.default_rng(8)
    rings = []
    for k in range(6):
        n, x, y = 25, 97 + 8 * r.random(), 6 + 13 * r.random()
        for i, (a, d) in enumerate(zip(np.sort(r.random(n)) * 2 * np.pi, 0.3 + 3 * r.random(n))):
            rings.append((k % 4, k, i, float(x + d * np.cos(a)), float(y + d * np.sin(a))))
    pts = [(i, float(5 + 16 * r.random()), float(96 + 10 * r.random())) for i in range(400)]

    def inside(region, la, lo):
        odd = False
        for k in range(6):
            v = [(q[3], q[4]) for q in rings if q[0] == region and q[1] == k]
            for (x1, y1), (x2, y2) in zip(v, v[1:] + v[:1]):
                odd ^= (y1 > la) != (y2 > la) and lo < (x2 - x1) * (la - y1) / (y2 - y1) + x1
        return odd

    ring_df = spark.createDataFrame(rings, "province_id long, ring_no int, seq int, lon double, lat double")
    df = spark.createDataFrame(pts, "row_id long, lat double, lon double")
    got = set(map(tuple, regions_of_points(df, "row_id", "lat", "lon", BOX, ring_df, "province_id", "ring_no", "seq", "lat", "lon", leaf_points=leaf).collect()))
    assert got == {(k, i) for i, la, lo in pts for k in range(4) if inside(k, la, lo)}


def test_rtree_finds_all():
    r = np.random.default_rng(0)
    lat, lon = r.random(500), r.random(500)
    found = {(int(i), int(j)) for p, q in RTree(lat, lon, fan=8).probe(lat, lon, 0.05, 0.05) for i, j in zip(p, q) if abs(lat[i] - lat[j]) <= 0.05 and abs(lon[i] - lon[j]) <= 0.05}
    want = {(i, j) for i in range(500) for j in range(500) if abs(lat[i] - lat[j]) <= 0.05 and abs(lon[i] - lon[j]) <= 0.05}
    assert found == want
    assert list(RTree(np.empty(0), np.empty(0)).probe(lat, lon, 1, 1)) == []
