"""Connected roads: chains, their inclines and conflicts, against a plain search; which roads are drawn."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgrade.kernels import profile as kernels
from roadgrade.operators import graph, paint

SAMPLES = "road_id long, k int, lat double, lon double, elev double"
NAMES = "road_id long, name string, unnamed boolean"


def metres(p, q):
    a, b = math.radians(p[0]), math.radians(q[0])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def line(a, b, elev, step=25.0):
    n = max(1, round(metres(a, b) / step))
    return [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n, elev(k * step)) for k in range(n + 1)]


def frames(spark, roads):
    """roads: (id, name, unnamed, points)"""
    rows = [(i, k, *map(float, p)) for i, _, _, pts in roads for k, p in enumerate(pts)]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([(i, n, u) for i, n, u, _ in roads], NAMES)


def plain_search(roads, min_span, max_roads):
    """Depth first over all chains; every pair of slices is compared."""
    pts, name = {i: p for i, _, _, p in roads}, {i: None if u else n for i, n, u, _ in roads}
    lat0 = pts[min(pts)][0][0]
    flat = lambda p: (p[1] * 111320 * math.cos(math.radians(lat0)), p[0] * 111320)
    meet = {}
    for r in pts:
        for end in (0, 1):
            x, y = flat(pts[r][-end])
            for o in pts:
                near = [(math.hypot(a - x, b - y), k) for k, (a, b) in enumerate(map(flat, pts[o]))]
                if o != r and near and min(near)[0] <= 20:
                    meet.setdefault((r, end), []).append((o, min(near)[1]))
    found = []

    def go(chain):
        at = [(r, k) for r, a, b in chain for k in (range(a, b + 1) if b >= a else range(a, b - 1, -1))]
        p = [pts[r][k] for r, k in at]
        d = np.cumsum([0.0, *(metres(u, v) for u, v in zip(p, p[1:], strict=False))])
        for i, j, span, _, _ in kernels.inclines(d, np.array([q[2] for q in p]), min_span):
            slices = {}
            for r, k in at[i : j + 1]:
                slices.setdefault(r, []).append(k)
            found.append((span, {r: (min(s), max(s)) for r, s in slices.items()}))
        if len(chain) < max_roads:
            r, _, b = chain[-1]
            for o, k in meet.get((r, 0 if b == 0 else 1), []):
                if o not in [c[0] for c in chain]:
                    for to in (0, len(pts[o]) - 1):
                        if to != k:
                            go([*chain, (o, k, to)])

    for r in pts:
        if len(pts[r]) > 1:
            go([(r, 0, len(pts[r]) - 1)])
            if max_roads > 1:
                go([(r, len(pts[r]) - 1, 0)])

    def box(r, s):
        la, lo = zip(*[q[:2] for q in pts[r][s[0] : s[1] + 1]], strict=True)
        return min(la) - 0.0005, max(la) + 0.0005, min(lo) - 0.0005, max(lo) + 0.0005

    def clash(x, y):
        for r, s in x.items():
            for o, t in y.items():
                a, b = box(r, s), box(o, t)
                if r == o and max(s[0], t[0]) < min(s[1], t[1]):
                    return True
                if r != o and name[r] is not None and name[r] == name[o] and a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]:
                    return True
        return False

    kept = []
    for span, s in sorted(found, key=lambda f: -round(f[0], 6)):
        if not any(clash(s, t) for _, t in kept):
            kept.append((span, s))
    return sorted((round(span, 4), tuple(sorted((r, *s) for r, s in t.items()))) for span, t in kept)


def searched(spark, roads, min_span, max_roads):
    out = graph.longest_incline_paths(*frames(spark, roads), min_span, max_roads)
    return sorted((round(r["span"], 4), tuple(sorted((s["road_id"], min(s["from"], s["to"]), max(s["from"], s["to"])) for s in r["segs"]))) for r in out.collect()), out


def test_incline_over_two_roads(spark):
    low = line((35.0, -82.0), (35.0054, -82.0), lambda d: d * 0.05)
    high = line((35.0054, -82.0), (35.0108, -82.0), lambda d: low[-1][2] + d * 0.05)
    roads = [(1, "Lower Rd", False, low), (2, "Upper Rd", False, high)]
    assert searched(spark, roads, 1000.0, 1)[0] == []
    _, out = searched(spark, roads, 1000.0, 2)
    row = out.first()
    assert out.count() == 1 and row["n_roads"] == 2 and row["span"] > 1000 and abs(row["grade"] - 0.05) < 0.01
    assert row["start"]["elev"] < row["end"]["elev"] and set(row["names"].split(" + ")) == {"Lower Rd", "Upper Rd"}
    virtual = graph.incline_virtual_road(out)
    own = graph.virtual_samples(virtual, frames(spark, roads)[0]).orderBy("k").collect()
    assert len(own) == len(low) + len(high) and own[0]["d"] == 0 and own[-1]["d"] == pytest.approx(row["span"], abs=1e-6)
    assert [r["on_incline"] for r in own] == [True] * (len(own) - 1) + [False]


def test_python_gets_a_chains_samples_as_plain_arrays(spark):
    """No object for each sample: ten thousand chains of a batch stay a few bytes a sample."""
    low = line((35.0, -82.0), (35.0054, -82.0), lambda d: d * 0.05)
    samples = frames(spark, [(1, "Lower Rd", False, low)])[0]
    rows = graph.chains(samples, None, 300.0)
    for df, columns in ((graph._joined(rows, samples, ()), ("road", "k", "lat", "lon", "elev")), (graph.combine_steps(rows, samples), ("d", "elev", "lat", "lon"))):
        assert {dict(df.dtypes)[c] for c in columns} <= {"array<bigint>", "array<int>", "array<double>"}
        assert [c for c, kind in df.dtypes if "struct" in kind] == ["segs"]
        assert all(len(df.first()[c]) == len(low) for c in columns)


@pytest.mark.parametrize("second", ["Oak", "Ash"])
def test_parallel_road_of_a_later_slice(spark, second):
    """Elm and Oak are one incline; what runs beside its second slice under that slice's name is the same hill."""
    elm = line((35.0, -82.0), (35.0, -81.995), lambda d: d * 0.05)
    oak = line((35.0, -81.995), (35.0, -81.99), lambda d: elm[-1][2] + d * 0.05)
    beside = line((35.00036, -81.995), (35.00036, -81.99), lambda d: 50 + d * 0.05)
    roads = [(1, "Elm", False, elm), (2, "Oak", False, oak), (3, second, False, beside)]
    got, _ = searched(spark, roads, 300.0, 2)
    assert got == plain_search(roads, 300.0, 2) and len(got) == (1 if second == "Oak" else 2)


def test_name_of_the_first_road_counts_only_along_it(spark):
    """A road named like the first slice lies beside the second: both stay."""
    elm = line((35.0, -82.0), (35.0, -81.995), lambda d: d * 0.05)
    oak = line((35.0, -81.995), (35.0, -81.985), lambda d: elm[-1][2] + d * 0.05)
    beside = line((35.00036, -81.99), (35.00036, -81.986), lambda d: 50 + d * 0.05)
    roads = [(1, "Elm", False, elm), (2, "Oak", False, oak), (3, "Elm", False, beside), (4, "Oak", True, line((35.0009, -81.99), (35.0009, -81.986), lambda d: 9 - d * 0.05))]
    got, _ = searched(spark, roads, 300.0, 2)
    assert got == plain_search(roads, 300.0, 2) and len(got) == 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_networks_equal_a_plain_search(spark, seed):
    """Streets between points of a jittered lattice with a hill on it; chains of up to three roads, loops and dead ends among them."""
    rng = random.Random(seed)
    node = {(y, x): (35 + y * 0.0035 + rng.uniform(-3e-4, 3e-4), -82 + x * 0.0042 + rng.uniform(-3e-4, 3e-4)) for y in range(3) for x in range(4)}
    hill = lambda p: 60 * math.exp(-(((p[0] - 35.0035) / 0.004) ** 2) - ((p[1] + 81.992) / 0.006) ** 2) if seed != 3 else 1.0 + p[0]
    roads, i = [], 0
    for (y, x), p in node.items():
        for q in ((y + 1, x), (y, x + 1)):
            if q in node and rng.random() < 0.8:
                i += 1
                pts = [(a, b, hill((a, b)) + rng.uniform(-0.4, 0.4)) for a, b, _ in line(p, node[q], lambda d: 0)]
                roads.append((i, f"Street {rng.randrange(4)}", rng.random() < 0.2, pts))
    roads.append((90, "Alone", False, [(35.2, -82.2, 5.0)]))
    for most in (2, 3):
        got, _ = searched(spark, roads, 400.0, most)
        assert got == plain_search(roads, 400.0, most)
        assert seed == 3 or any(len(s) == most for _, s in got)
    if seed == 3:  # flat: nothing is followed and no sample is joined
        df = frames(spark, roads)[0]
        assert graph.chains(df, graph.endpoint_junctions(df), 400.0, 3).count() == 0


def test_losers_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, 40)], "better long, worse long")
    lost, kept = set(), []
    for i in range(n + 1):
        if any(k == i - 1 or (k, i) == (0, 40) for k in kept):
            lost.add(i)
        else:
            kept.append(i)
    assert {r["id"] for r in graph.losers(edges).collect()} == lost
    assert graph.losers(edges.limit(0)).count() == 0


def test_drawn_roads_of_each_mode(spark):
    value = spark.createDataFrame([(1, 0.1), (2, 0.02), (3, None), (4, None)], "road_id long, value double")
    climbs = spark.createDataFrame([(1, 3.0), (1, 7.0), (3, 5.0)], "road_id long, score double")
    assert [tuple(r) for r in paint.drawn_climb_roads(value, climbs).collect()] == [(1, 0.1, 7.0)]
    listed = spark.createDataFrame([(2,), (3,), (3,)], "road_id long")
    got = {r["road_id"]: (r["value"], r["listed"]) for r in paint.drawn_incline_roads(value, listed).collect()}
    assert got == {1: (0.1, False), 2: (0.02, True), 3: (None, True)}


def test_nearest_sample_of_an_end(spark):
    """Two samples of the other road are within reach: the nearest counts, not the first."""
    a = line((35.0, -82.0), (35.0, -81.998), lambda d: 0)
    b = [(35.0, -81.998 - 0.00014, 0.0), (35.0, -81.998 + 0.00005, 0.0), (35.0, -81.99, 0.0)]
    got = graph.endpoint_junctions(frames(spark, [(1, "a", False, a), (2, "b", False, b)])[0]).filter("road_id = 1").select(F.col("end"), "other_id", "other_k").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]


def test_nearest_on_any_road_equals_all_pairs(spark):
    rng = random.Random(12)
    roads = [(i, "x", False, line((35 + rng.uniform(0, 0.05), -82 + rng.uniform(0, 0.05)), (35 + rng.uniform(0, 0.05), -82 + rng.uniform(0, 0.05)), lambda d: 0, 200.0)) for i in range(12)]
    roads.append((50, "long", False, [(36.0, -82.0, 0.0), (36.0, -81.0, 0.0)]))
    points = [(k, 35 + rng.uniform(-0.02, 0.07), -82 + rng.uniform(-0.02, 0.07)) for k in range(40)] + [(100, 35.9, -81.5), (101, 20.0, -60.0), (102, 36.0, -81.2)]
    samples, _ = frames(spark, roads)
    got = {r["point_id"]: (r["road_id"], r["k"]) for r in paint.nearest_on_any_road(spark.createDataFrame([*points, (103, None, 1.0)], "point_id long, lat double, lon double"), samples).collect()}

    def far(p, a, b):
        c = math.cos(math.radians(p[0]))
        dx, dy, qx, qy = (b[1] - a[1]) * c, b[0] - a[0], (p[1] - a[1]) * c, p[0] - a[0]
        t = max(0.0, min(1.0, (qx * dx + qy * dy) / (dx * dx + dy * dy)))
        return round(math.hypot(qx - t * dx, qy - t * dy), 12)

    want = {k: min((far((y, x), a, b), i, j) for i, _, _, pts in roads for j, (a, b) in enumerate(zip(pts, pts[1:])))[1:] for k, y, x in points}
    assert got == want
    assert paint.nearest_on_any_road(spark.createDataFrame(points, "point_id long, lat double, lon double"), samples.limit(0)).count() == 0


def test_long_segments_lie_in_few_cells(spark, monkeypatch):
    """The first cells follow the segments' size: no round puts a segment in dozens of cells."""
    widths = []
    cells = paint.box_cells
    monkeypatch.setattr(paint, "box_cells", lambda *a: widths.append(a[-1]) or cells(*a))
    rng = random.Random(3)
    place = lambda: (35 + rng.uniform(0, 0.1), -82 + rng.uniform(0, 0.1))
    samples = spark.createDataFrame([(r, k, *place()) for r in range(40) for k in range(3)], "road_id long, k int, lat double, lon double")
    points = spark.createDataFrame([(i, *place()) for i in range(30)], "point_id long, lat double, lon double")
    got = {r["point_id"]: r["dist"] for r in paint.nearest_on_any_road(points, samples).collect()}
    assert len(got) == 30 and min(widths) > 0.04
