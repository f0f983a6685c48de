"""Points near other points, and the regions that contain them.

Sample-driven quadtree partitioning with boundary replication; per partition a bulk-loaded R-tree is probed; candidates
are refined by the exact geometry; a pair seen in several partitions is kept only by the one that holds its reference
point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import cut

EARTH_M = 6_371_000.0
_BITS = 20


def distance_m(lat1, lon1, lat2, lon2):
    """Great-circle distance in metres on the sphere, by the haversine formula."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


@dataclass(frozen=True)
class Box:
    """The envelope in which points count as located; both ends included."""

    lat0: float
    lat1: float
    lon0: float
    lon1: float

    def located(self, lat: str, lon: str):
        return F.col(lat).between(self.lat0, self.lat1) & F.col(lon).between(self.lon0, self.lon1)


class Quadtree:
    """Leaves of a quadtree as consecutive ranges of Morton codes, so that a point's leaf is one binary search."""

    def __init__(self, box: Box, sample: np.ndarray, capacity: float, margin_m: float):
        self.box, self.margin_m = box, margin_m
        self.dlat = np.degrees(margin_m / EARTH_M) * 1.001
        widest = np.cos(np.radians(max(abs(box.lat0), abs(box.lat1)) + self.dlat))
        self.dlon = self.dlat / max(widest, 1e-6)
        level = int(min(np.floor(np.log2((box.lat1 - box.lat0) / (2 * self.dlat))), np.floor(np.log2((box.lon1 - box.lon0) / (2 * self.dlon)))))
        self.max_level = max(0, min(_BITS, level))
        codes = np.sort(self.code(sample[:, 0], sample[:, 1])) if len(sample) else np.empty(0, np.int64)
        starts: list[int] = []
        stack = [(0, 0)]
        while stack:
            first, depth = stack.pop()
            span = 1 << (2 * (_BITS - depth))
            held = np.searchsorted(codes, first + span) - np.searchsorted(codes, first)
            if held <= capacity or depth >= self.max_level:
                starts.append(first)
            else:
                stack.extend((first + i * (span >> 2), depth + 1) for i in range(4))
        self.starts = np.sort(np.array(starts, dtype=np.int64))

    def code(self, lat, lon) -> np.ndarray:
        top = (1 << _BITS) - 1
        y = np.clip(((np.asarray(lat) - self.box.lat0) / (self.box.lat1 - self.box.lat0) * (1 << _BITS)).astype(np.int64), 0, top)
        x = np.clip(((np.asarray(lon) - self.box.lon0) / (self.box.lon1 - self.box.lon0) * (1 << _BITS)).astype(np.int64), 0, top)
        return _spread(x) | (_spread(y) << 1)

    def leaf(self, lat, lon) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(lat, lon), side="right") - 1

    def leaves_touched(self, lat, lon) -> np.ndarray:
        """Leaves that the box of the margin around each point meets, as four columns: no leaf is narrower than two
        margins, so the box's corners reach all of them."""
        return np.stack([self.leaf(lat + a * self.dlat, lon + b * self.dlon) for a in (-1, 1) for b in (-1, 1)], axis=1)

    def leaves_met(self, lat0, lat1, lon0, lon1) -> tuple[np.ndarray, np.ndarray]:
        """(box index, leaf) for every leaf that a box meets: all boxes go down the tree together."""
        height, width = self.box.lat1 - self.box.lat0, self.box.lon1 - self.box.lon0
        at, first, depth = np.arange(len(lat0)), np.zeros(len(lat0), np.int64), 0
        out_at, out_leaf = [], []
        while len(at):
            span = 1 << (2 * (_BITS - depth))
            y, x, side = _gather(first >> 1), _gather(first), 1 << (_BITS - depth)
            # points beyond the envelope's border belong to its outermost cells
            low = lambda c, start, size: np.where(c == 0, -np.inf, start + c / (1 << _BITS) * size)
            high = lambda c, start, size: np.where(c + side >= 1 << _BITS, np.inf, start + (c + side) / (1 << _BITS) * size)
            slack = 1e-9  # for the rounding of the cells' borders
            meets = (lat1[at] + slack >= low(y, self.box.lat0, height)) & (lat0[at] - slack <= high(y, self.box.lat0, height)) & (lon1[at] + slack >= low(x, self.box.lon0, width)) & (lon0[at] - slack <= high(x, self.box.lon0, width))
            at, first = at[meets], first[meets]
            leaf = np.searchsorted(self.starts, first, side="right") - 1
            end = np.r_[self.starts[1:], 1 << (2 * _BITS)][leaf]
            whole = end >= first + span
            out_at.append(at[whole])
            out_leaf.append(leaf[whole])
            at, first, depth = np.repeat(at[~whole], 4), (first[~whole][:, None] + np.arange(4) * (span >> 2)).ravel(), depth + 1
        return np.concatenate(out_at), np.concatenate(out_leaf)


def _gather(code: np.ndarray) -> np.ndarray:
    """Every second bit of Morton codes, the inverse of _spread."""
    v = code & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & mask
    return v


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << shift)) & mask
    return v


class RTree:
    """A sort-tile-recursive R-tree of two levels over points: nodes of ``fan`` points with their bounding boxes."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, fan: int = 32):
        n = len(lat)
        slabs = max(1, int(np.ceil(np.sqrt(n / fan))))
        per_slab = int(np.ceil(n / slabs)) if n else 1
        by_lat = np.argsort(lat, kind="stable")
        slab = np.empty(n, np.int64)
        slab[by_lat] = np.arange(n) // per_slab
        self.order = np.lexsort((lon, slab))
        # no node crosses a slab
        inside = np.arange(n) - (slab[self.order] * per_slab)
        node = slab[self.order] * (per_slab // fan + 1) + inside // fan
        self.first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if n else np.empty(0, np.int64)
        self.last = np.r_[self.first[1:], n].astype(np.int64)
        la, lo = lat[self.order], lon[self.order]
        if n:
            self.lat0, self.lat1 = np.minimum.reduceat(la, self.first), np.maximum.reduceat(la, self.first)
            self.lon0, self.lon1 = np.minimum.reduceat(lo, self.first), np.maximum.reduceat(lo, self.first)

    def probe(self, lat: np.ndarray, lon: np.ndarray, dlat: float, dlon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (probe index, point index): points whose node's box meets the probe's box. One block per node."""
        by = np.argsort(lat, kind="stable")
        sorted_lat = lat[by]
        for i in range(len(self.first)):
            a, b = np.searchsorted(sorted_lat, [self.lat0[i] - dlat, self.lat1[i] + dlat], side="left") + [0, 0]
            b = np.searchsorted(sorted_lat, self.lat1[i] + dlat, side="right")
            some = by[a:b]
            some = some[(lon[some] >= self.lon0[i] - dlon) & (lon[some] <= self.lon1[i] + dlon)]
            if len(some):
                own = self.order[self.first[i] : self.last[i]]
                yield np.repeat(some, len(own)), np.tile(own, len(some))


@dataclass
class Located:
    """The distinct spots of the located rows, with the number of different keys on each, and a quadtree over them."""

    spots: DataFrame
    tree: Quadtree


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def locate(df: DataFrame, lat: str, lon: str, box: Box, margin_m: float, key: str | None = None, leaf_points: int = 2000, sample_points: int = 100_000) -> Located:
    """Spots and a quadtree fitted to a sample of at most about ``sample_points`` of them, chosen by hash. The sample steers
    the partition sizes only, never a result; its size bounds what comes to the driver and the number of leaves. Rows on
    one spot count once in everything that follows."""
    rows = df.filter(box.located(lat, lon)).select(F.col(lat).alias("lat"), F.col(lon).alias("lon"), (F.col(key) if key else F.lit(None)).alias("key"))
    members = rows.distinct().groupBy("lat", "lon").agg(F.count("*").alias("members"))
    places = cut(members.repartition(_tasks(df), F.xxhash64("lat", "lon")))
    n = places.count()
    share = min(1.0, sample_points / max(n, 1))
    picked = places if share == 1.0 else places.filter(F.pmod(F.xxhash64("lat", "lon"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = picked.select("lat", "lon").toPandas().to_numpy(dtype=float).reshape(-1, 2)
    return Located(places, Quadtree(box, sample, leaf_points * max(share, 1e-9), margin_m))


def near_spots(located: Located, within_m: float, task_points: int = 20_000) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b): every unordered pair of different spots at most ``within_m`` apart, once.

    The tree must have been planned with a margin of at least half of ``within_m``. A leaf that holds more than
    ``task_points`` spots is cut into blocks by hash and its pairs of blocks become tasks of their own, so no task ever
    holds more than two blocks. Only leaf counts (as many as the tree has leaves) come to the driver.
    """
    places, tree = located.spots.select("lat", "lon"), located.tree
    shared = places.sparkSession.sparkContext.broadcast(tree)

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            la, lo = b["lat"].to_numpy(), b["lon"].to_numpy()
            touched = np.sort(t.leaves_touched(la, lo), axis=1)
            new = np.c_[np.ones(len(b), bool), touched[:, 1:] != touched[:, :-1]]
            i, j = np.nonzero(new)
            yield pd.DataFrame({"leaf": touched[i, j], "lat": la[i], "lon": lo[i]})

    held = cut(places.mapInPandas(scatter, "leaf long, lat double, lon double"))
    large = {r["leaf"]: -(-r["n"] // task_points) for r in held.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > task_points).collect()}
    if large:
        cuts = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])
        c = F.coalesce(F.element_at(cuts, F.col("leaf")), F.lit(1))
        mine = F.pmod(F.xxhash64("lat", "lon"), c)
        held = (
            held.withColumn("c", c)
            .withColumn("own", mine.cast("long"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("c") - 1).cast("long"))))
            .select("leaf", "lat", "lon", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        )
    else:
        zero = F.lit(0).cast("long")
        held = held.select("leaf", "lat", "lon", zero.alias("own"), zero.alias("i"), zero.alias("j"))

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = shared.value
        leaf, i, j = key
        own = pdf["own"].to_numpy()
        la, lo = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        dlat, dlon = np.degrees(within_m / EARTH_M) * 1.001, np.degrees(within_m / EARTH_M) * 1.001 / np.cos(np.radians(max(abs(t.box.lat0), abs(t.box.lat1)) + 0.01))
        out = []
        for p, q in RTree(la[right], lo[right]).probe(la[left], lo[left], dlat, dlon):
            p, q = left[p], right[q]
            ordered = (la[p] < la[q]) | ((la[p] == la[q]) & (lo[p] < lo[q])) if i == j else np.ones(len(p), bool)
            p, q = p[ordered], q[ordered]
            near = distance_m(la[p], lo[p], la[q], lo[q]) <= within_m
            p, q = p[near], q[near]
            # the reference point of a pair: the lower left corner of the two margin boxes' intersection
            home = t.leaf(np.maximum(la[p], la[q]) - t.dlat, np.maximum(lo[p], lo[q]) - t.dlon) == leaf
            p, q = p[home], q[home]
            first = (la[p] < la[q]) | ((la[p] == la[q]) & (lo[p] < lo[q]))
            a, b = np.where(first, p, q), np.where(first, q, p)
            out.append(np.c_[la[a], lo[a], la[b], lo[b]])
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 4)), columns=["lat_a", "lon_a", "lat_b", "lon_b"])

    return held.repartition(_tasks(places), "leaf", "i", "j").groupBy("leaf", "i", "j").applyInPandas(join, "lat_a double, lon_a double, lat_b double, lon_b double")


def near_pairs(df: DataFrame, row_id: str, key: str, lat: str, lon: str, within_m: float, box: Box, leaf_points: int = 2000, task_points: int = 20_000, spot_members: int = 1_000, located: Located | None = None) -> DataFrame:
    """(id_a, id_b), the smaller first: every two located rows of different ``key`` at most ``within_m`` apart.

    Rows without usable coordinates (null, NaN, outside ``box``) are in no pair. A null key differs from any other key
    and equals another null. Rows on one spot with one key are a single member until the last join, so copies are
    expanded only into pairs that the result must hold. Members of a spot that has more than ``spot_members`` keys meet in
    blocks, each pair of blocks in a task of its own. An empty table gives no pair.
    """
    rows = df.filter(box.located(lat, lon)).select(F.col(row_id).alias("row_id"), F.col(key).alias("key"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    members = rows.select("lat", "lon", "key").distinct()
    located = located or locate(df, lat, lon, box, within_m / 2, key, leaf_points)
    apart = near_spots(located, within_m, task_points)
    shared = located.spots.filter("members > 1")
    same = shared.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = apart.unionByName(same)
    a = members.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("key").alias("key_a"))
    b = members.select(F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("key").alias("key_b"))
    on = [["lat_a", "lon_a"], ["lat_b", "lon_b"]]
    crowded = located.spots.filter(F.col("members") > spot_members)
    if not crowded.isEmpty():
        # members by block of their spot, and every pair of spots once per pair of their blocks
        blocks = crowded.select("lat", "lon", F.ceil(F.col("members") / spot_members).cast("int").alias("c"))
        for side in "ab":
            own = blocks.select(F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"), "c")
            n = F.coalesce("c", F.lit(1))
            pairs = pairs.join(own, on["ab".index(side)], "left").withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), n - 1))).drop("c")
            held = (a if side == "a" else b).join(own, on["ab".index(side)], "left").withColumn(f"block_{side}", F.pmod(F.xxhash64(f"key_{side}"), n).cast("int")).drop("c")
            a, b = (held, b) if side == "a" else (a, held)
        on = [[*on[0], "block_a"], [*on[1], "block_b"]]
    differ = ~F.col("key_a").eqNullSafe(F.col("key_b"))
    same_spot = (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    # on one spot every two members meet twice; the one with the lesser key (null first) stays
    once = ~same_spot | (F.col("key_b").isNotNull() & (F.col("key_a").isNull() | (F.col("key_a") < F.col("key_b"))))
    groups = pairs.join(a, on[0]).join(b, on[1]).filter(differ & once)
    ra = rows.select(F.col("row_id").alias("ra"), *(F.col(x).alias(f"{x}_x") for x in ("lat", "lon", "key")))
    rb = rows.select(F.col("row_id").alias("rb"), *(F.col(x).alias(f"{x}_y") for x in ("lat", "lon", "key")))
    on_a = (F.col("lat_a") == F.col("lat_x")) & (F.col("lon_a") == F.col("lon_x")) & F.col("key_a").eqNullSafe(F.col("key_x"))
    on_b = (F.col("lat_b") == F.col("lat_y")) & (F.col("lon_b") == F.col("lon_y")) & F.col("key_b").eqNullSafe(F.col("key_y"))
    return groups.join(ra, on_a).join(rb, on_b).select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"))


def ring_edges(rings: DataFrame, region: str, ring: str, seq: str, lat: str, lon: str) -> DataFrame:
    """(region, x, y, x2, y2): the edges of closed rings. Vertices with a null or NaN are left out before their neighbours
    are joined; a ring's last vertex is joined to its first, closed or not."""
    v = rings.select(F.col(region).cast("long").alias("region"), F.col(ring).alias("ring"), F.col(seq).alias("seq"), F.col(lon).alias("x"), F.col(lat).alias("y")).dropna().filter("NOT isnan(x) AND NOT isnan(y)")
    w = Window.partitionBy("region", "ring").orderBy("seq", "x", "y")
    end = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return v.select("region", "x", "y", end("x").alias("x2"), end("y").alias("y2")).filter("y <> y2")


def regions_of_points(df: DataFrame, row_id: str, lat: str, lon: str, box: Box, rings: DataFrame, region: str, ring: str, seq: str, ring_lat: str, ring_lon: str, task_points: int = 20_000, leaf_points: int = 2000, located: Located | None = None) -> DataFrame:
    """(region, row_id) for every located row inside a region: inside an odd number of its rings (even-odd rule), so
    holes and several parts hold. A row in several regions gives a row each, in none no row.

    Spots are tested once each, in the leaf of the quadtree that holds them. A spot's ray goes east, so an edge of a
    boundary is replicated to the leaves that its latitudes meet, from its region's western bound to its own eastern end;
    nothing is broadcast but the tree. In a leaf, the nodes of a bulk-loaded R-tree of its spots meet only the edges in
    their reach, a bounded slice at a time. A leaf of more than ``task_points`` spots is cut into parts by hash.
    """
    rows = df.filter(box.located(lat, lon)).select(F.col(row_id).alias("row_id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    located = located or locate(df, lat, lon, box, 1.0, None, leaf_points)
    shared = df.sparkSession.sparkContext.broadcast(located.tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.leaf(b["lat"].to_numpy(), b["lon"].to_numpy()))

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y, y2, x, x2 = (b[c].to_numpy() for c in ("y", "y2", "x", "x2"))
            for i in range(0, len(b), 2_000):
                part = slice(i, i + 2_000)
                at, leaf = shared.value.leaves_met(np.minimum(y, y2)[part], np.maximum(y, y2)[part], b["west"].to_numpy()[part], np.maximum(x, x2)[part])
                yield b.iloc[part].iloc[at][["region", "x", "y", "x2", "y2"]].assign(leaf=leaf)

    spots = located.spots.select("lat", "lon").mapInPandas(place, "lat double, lon double, leaf long")
    edges = ring_edges(rings, region, ring, seq, ring_lat, ring_lon)
    west = edges.groupBy("region").agg(F.min(F.least("x", "x2")).alias("west"))
    held = edges.join(west, "region").mapInPandas(replicate, "region long, x double, y double, x2 double, y2 double, leaf long")
    # only leaf counts, as many as the tree has leaves, come to the driver
    large = {r["leaf"]: -(-r["n"] // task_points) for r in spots.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > task_points).collect()}
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in large.items() for x in kv]), F.col("leaf").cast("int")), F.lit(1)) if large else F.lit(1)
    spots = spots.withColumn("part", F.pmod(F.xxhash64("lat", "lon"), parts).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))

    def test(spot: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(spot) and len(edge):
            la, lo = spot["lat"].to_numpy(), spot["lon"].to_numpy()
            edge = edge.sort_values("region", kind="stable")
            e, of = edge[["x", "y", "x2", "y2"]].to_numpy(), edge["region"].to_numpy()
            top, bottom, east = np.maximum(e[:, 1], e[:, 3]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 0], e[:, 2])
            tree = RTree(la, lo, fan=256)
            for s, t in zip(tree.first, tree.last):
                some = tree.order[s:t]
                near = np.flatnonzero((top >= la[some].min()) & (bottom <= la[some].max()) & (east >= lo[some].min()))
                for r in np.unique(of[near]):
                    hit = some[_inside(lo[some], la[some], e[near[of[near] == r]])]
                    if len(hit):
                        out.append(pd.DataFrame({"region": r, "lat": la[hit], "lon": lo[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"region": np.empty(0, np.int64), "lat": np.empty(0), "lon": np.empty(0)})

    n = _tasks(df)
    at = ["leaf", "part"]
    inside = spots.repartition(n, *at).groupBy(*at).cogroup(held.repartition(n, *at).groupBy(*at)).applyInPandas(test, "region long, lat double, lon double")
    return inside.join(rows, ["lat", "lon"]).select("region", "row_id")


def _inside(x: np.ndarray, y: np.ndarray, e: np.ndarray, most_cells: int = 1_000_000) -> np.ndarray:
    """Even-odd test of points against edges of a region, as many edges at a time as keep the work in bounded memory."""
    odd = np.zeros(len(x), bool)
    px, py = x[:, None], y[:, None]
    step = max(1, most_cells // max(1, len(x)))
    for i in range(0, len(e), step):
        x1, y1, x2, y2 = e[i : i + step].T
        spans = (y1 > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x2 - x1) * (py - y1) / (y2 - y1) + x1
        odd ^= ((spans & (px < at)).sum(axis=1) % 2) == 1
    return odd
