"""Every query against its SQL on the smallest tables; golden cases of expressions; stores and files."""

import contextlib
import glob
import io
import math
import os
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadgrade.functions import geo, text
from roadgrade.kernels import stitch
from roadgrade.operators import paint, profile, ranking, ways
from roadgrade.plans import catalogue
from roadgrade.sources import osm, store, tiles

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def rows(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["despike", "stretches", "climbs", "inclines", "ranked_stretches", "ranked_climbs", "incline_paths", "roundabout_rings", "marked_underpasses"])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_effort_is_the_score(spark):
    q = catalogue.queries()
    both = q["climb_effort"](spark, SF).join(q["climbs"](spark, SF), ["road_id", "n"])
    assert both.filter("abs(effort - score) > 1e-4").count() == 0 and both.count() > 0


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text_expressions(spark):
    assert value(spark, text.parse_lat_lon(F.lit(" 35.23, -82.73 ")))["lat"] == 35.23
    assert value(spark, text.parse_lat_lon(F.lit("Brevard, NC"))) is None
    assert value(spark, text.parse_lat_lon(F.lit("95, 10"))) is None
    assert value(spark, text.search_key(F.lit(35.1), F.lit(-82.7), F.lit(3000.0))) == "35.100,-82.700,3000"
    assert value(spark, text.short_label(F.lit("Brevard, Transylvania County, North Carolina, United States"))) == "Brevard, NC, US"
    assert value(spark, text.abbrev_name(F.lit("Pritchard Avenue Extension"))) == "Pritchard Ave Ext"
    assert value(spark, text.abbrev_name(F.lit("Streetman Road"))) == "Streetman Rd"
    assert value(spark, text.fmt_climb(F.lit(43.2), F.lit(299.0), F.lit(0.143))) == "↑43m/299m ≈ 14.3%"
    assert value(spark, text.fmt_pct(F.lit(-0.0001))) == "0.0%"
    assert value(spark, text.export_name(F.lit("climb"), F.lit(250.0), F.lit("Chapel Hill, NC"))) == "roads-climbs-chapel-hill.csv"
    assert value(spark, text.grade_color(F.lit(0.01))) == "rgb(251,211,208)"
    assert value(spark, text.grade_color(F.lit(0.12))) == "rgb(221,44,34)"
    assert value(spark, text.grade_color(F.lit(0.9))) == "rgb(64,5,3)"
    url = value(spark, text.street_view_url(text.view_angles(F.lit(35.0), F.lit(-82.0), F.lit(200.0), F.lit(35.001), F.lit(-82.0), F.lit(211.1))))
    assert "heading=0.0" in url and "pitch=5.7" in url


def test_one_decimal_is_rounded_by_the_exact_value(spark):
    """As SQL does: 9.35 lies below its half, 6.25 on it, and s = 10 x itself may round onto a half."""
    xs = [0.0, 0.05, 0.25, 0.75, 1.45, 6.25, 9.35, 18.85, 99.95, 1.005, -9.35, -6.25] + [k / 100 + 0.05 for k in range(0, 3000, 7)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(F.format_string("%.1f", text.one_decimal(F.col("x")))).collect()]
    assert got == [duckdb.sql(f"select printf('%.1f', {x!r}::double) as s").df().s[0].replace("-0.0", "0.0") for x in xs] == [f"{x:.1f}".replace("-0.0", "0.0") for x in xs]
    assert value(spark, text.fmt_climb(F.lit(18.7), F.lit(200.0), F.lit(0.0935))) == "↑19m/200m ≈ 9.3%"
    assert value(spark, text.fmt_len(F.lit(9350.0))) == "9.3 km"


def test_geometry(spark):
    assert value(spark, geo.haversine_m(F.lit(35.0), F.lit(-82.0), F.lit(35.009), F.lit(-82.0))) == pytest.approx(1000.75, abs=0.1)
    one = [F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(2.0)]
    assert value(spark, geo.segment_cross_frac(*one, [F.lit(-1.0), F.lit(1.0)], [F.lit(1.0), F.lit(1.0)])) == pytest.approx(0.5)
    assert value(spark, geo.segment_cross_frac(*one, [F.lit(0.0), F.lit(1.0)], [F.lit(1.0), F.lit(1.0)])) is None


def test_resample_gives_41_samples(spark):
    pts = spark.createDataFrame([(1, 0, 35.0, -82.0), (1, 1, 35.009, -82.0), (2, 0, 35.0, -82.0), (2, 1, 35.0, -82.0)], "way_id long, i int, lat double, lon double")
    got = profile.resample(pts).groupBy("way_id").agg(F.count("*").alias("n"), F.max("d").alias("d")).orderBy("way_id").collect()
    assert got[0]["n"] == 41 and got[0]["d"] == pytest.approx(1000.75, abs=0.1) and got[1]["n"] == 1


def test_resample_keeps_the_last_sample_of_a_repeated_end_point(spark):
    """n * (total / n) may exceed total by rounding, and the last segment may have no length."""
    rng = np.random.default_rng(4)
    data = []
    for way in range(300):
        pts = np.cumsum(rng.uniform(-0.002, 0.002, (6, 2)), axis=0) + [35.0, -82.0]
        pts = np.concatenate([pts[:1], pts, pts[-1:]]) if way % 3 else np.concatenate([pts, pts[-1:], pts[-1:]])
        data += [(way, i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(data, "way_id long, i int, lat double, lon double")
    total = {r["way_id"]: r["d"] for r in profile.cumulative_distance(df).groupBy("way_id").agg(F.max("d").alias("d")).collect()}
    got = profile.resample(df).toPandas()
    for way, part in got.groupby("way_id"):
        n = max(1, math.floor(total[way] / 25 + 0.5))
        assert sorted(part.k) == list(range(n + 1))
        end = part[part.k == n].iloc[0]
        want = [x for x in data if x[0] == way][-1]
        assert end.lat == pytest.approx(want[2], abs=1e-9) and end.lon == pytest.approx(want[3], abs=1e-9)
    assert any(n * (t / n) > t for t in total.values() for n in [max(1, math.floor(t / 25 + 0.5))])


def plan_lines(df) -> list[str]:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue().split("== Initial Plan")[0].splitlines()


@pytest.mark.parametrize("name", ["densify", "resample_profile"])
def test_samples_are_neither_sorted_nor_shuffled(spark, name):
    """Only the given points are: above the step that makes samples stand projections alone, and the view is read once."""
    lines = plan_lines(catalogue.queries()[name](spark, SF))
    made = [k for k, x in enumerate(lines) if "MapInArrow" in x]
    assert len(made) == 1 and sum("FileScan" in x for x in lines) == 2
    assert not any("Sort" in x or "Exchange" in x or "Join" in x for x in lines[: made[0]])


def test_dense_path_of_ways_of_all_kinds(spark):
    """Against a plain loop: single points, no length, repeated points, corners between samples and on them."""
    rng = np.random.default_rng(7)
    ways_ = {1: [(35.0, -82.0)], 2: [(35.0, -82.0)] * 3, 3: [(35.0, -82.0), (35.0001, -82.0), (35.0001, -81.9999), (35.0, -81.9999), (35.0, -82.0)]}
    for w in range(4, 80):
        pts = (np.cumsum(rng.uniform(-4e-4, 4e-4, (rng.integers(2, 30), 2)), axis=0) + [35.0, -82.0]).tolist()
        ways_[w] = [p for p in pts for _ in range(1 + (rng.random() < 0.2))]
    df = spark.createDataFrame([(w, i, *map(float, p)) for w, pts in ways_.items() for i, p in enumerate(pts)], "way_id long, i int, lat double, lon double")
    d = {(r["way_id"], r["i"]): r["d"] for r in profile.cumulative_distance(df).collect()}
    want = []
    for w, pts in ways_.items():
        at = [d[w, i] for i in range(len(pts))]
        n = max(1, math.floor(at[-1] / 25 + 0.5)) if at[-1] else 0
        samples = []
        for k in range(n + 1):
            t = k * (at[-1] / n) if n else 0.0
            hi = min([i for i in range(1, len(pts)) if at[i] >= t], default=len(pts) - 1)
            lo = max(hi - 1, 0)
            f = min((t - at[lo]) / (at[hi] - at[lo]), 1.0) if at[hi] > at[lo] else 0.0
            samples.append((t, *(a + (b - a) * f for a, b in zip(pts[lo], pts[hi], strict=True))))
        want += [(w, k, 0.0, *s[1:]) for k, s in enumerate(samples)]
        for k, (a, b) in enumerate(zip(samples, samples[1:], strict=False)):
            if b[0] - a[0] > 1.02 * stitch.distance(a[1:], b[1:]):
                want += [(w, k, (at[i] - a[0]) / (b[0] - a[0]), *p) for i, p in enumerate(pts) if a[0] < at[i] < b[0]]
    got = [tuple(r) for r in paint.densify_path(df, ("way_id",)).collect()]
    near = lambda rows_: sorted(tuple(round(x, 8) + 0.0 for x in r) for r in rows_)
    assert near(got) == near(want) and any(r[2] > 0 for r in got)


def test_cuts_and_marks_equal_a_plain_loop(spark):
    """Long and short segments, several cells and areas; ways with hundreds of cuts send a few marks."""
    rng = np.random.default_rng(5)
    road = {(a, w): np.cumsum(rng.uniform(-0.02, 0.02, (rng.integers(2, 5), 2)), axis=0) + [35.0, -82.0] for a in (1, 2) for w in range(12)}
    road[1, 50], road[1, 51] = np.array([[35.0, -82.0], [35.0, -81.9998]]), np.array([[35.0, -82.1], [35.0, -81.9]])
    deck = {(a, w): rng.uniform(-0.03, 0.03, (3, 2)) + [35.0, -82.0] for a in (1, 2) for w in range(60)}
    rows_ = lambda of: [(a, w, i, *map(float, p)) for (a, w), pts in of.items() for i, p in enumerate(pts)]
    keys = ("area_id", "way_id")
    pts = spark.createDataFrame([(*r, r[1] == 3) for r in rows_(road)], "area_id long, way_id long, i int, lat double, lon double, b boolean")
    decks = spark.createDataFrame(rows_(deck), "area_id long, deck_id long, i int, lat double, lon double")
    at = profile.cumulative_distance(pts, keys)
    cuts = ways.underpass_cuts(ways.sample_gaps(at, keys), decks, ("way_id",), ("area_id",), ("n", "gap"))
    d = {(r["area_id"], r["way_id"], r["i"]): r["d"] for r in at.collect()}
    want = {}
    for (a, w), p in road.items():
        for i in range(len(p) - 1) if w != 3 else ():
            for (area, o), q in deck.items():
                for j in range(2) if area == a else ():
                    k = math.cos(math.radians((p[i][0] + p[i + 1][0]) / 2))
                    r, s, x = ((v - u) * [1, k] for u, v in ((p[i], p[i + 1]), (q[j], q[j + 1]), (p[i], q[j])))
                    den = r[1] * s[0] - r[0] * s[1]
                    t, u = (x[1] * s[0] - x[0] * s[1]) / den, (x[1] * r[0] - x[0] * r[1]) / den
                    if 0 < t < 1 and 0 < u < 1:
                        want[a, w, i, o, j] = d[a, w, i] + t * (d[a, w, i + 1] - d[a, w, i])
    got = {tuple(r[c] for c in ("area_id", "way_id", "i", "deck_id", "deck_i")): r["cut"] for r in cuts.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 300
    for r in ways.mark_underpasses(at, cuts, keys).collect():
        near = [abs(r["d"] - c) for (a, w, *_), c in want.items() if (a, w) == (r["area_id"], r["way_id"])]
        assert r["b"] == (r["way_id"] == 3 or min(near, default=99) <= 40)
    marks = ways.near_cuts(cuts.select(*keys, "cut", "n", "gap"), keys).collect()
    assert max(len(r["marks"]) for r in marks) <= 20 < len(want) / len(marks)
    lines = plan_lines(ways.mark_underpasses(at, cuts, keys))
    made = next(k for k, x in enumerate(lines) if "MapInArrow" in x)
    assert not any("Sort" in x or "Exchange" in x for x in lines[:made])


def test_decks(spark):
    rows_ = [(1, k, k * 25.0, 200.0 - (50 if 3 <= k <= 5 else 0), 3 <= k <= 5) for k in range(10)] + [(2, k, k * 25.0, 200.0 + (k % 2) * 40, True) for k in range(5)]
    got = profile.deck_elevations(spark.createDataFrame(rows_, "road_id long, k int, d double, elev double, b boolean")).toPandas()
    assert got[got.road_id == 1].deck.eq(200).all() and got[got.road_id == 2].deck.eq(200).all()


def test_layer_rules(spark):
    def way(i, **tags):
        return (i, "way", tags, [(35.0, -82.0), (35.001, -82.0)])

    df = spark.createDataFrame([way(1, bridge="yes"), way(2, bridge="yes", layer="-1"), way(3, bridge="yes", layer="x"), way(4, layer="2")], "id long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    assert [r["id"] for r in ways.bridge_ways(df).collect()] == [1]


def test_same_hill_dedupe(spark):
    box = (35.0, 35.01, -82.0, -81.99)
    rows_ = [(1, "Oak", False, 3.0, *box), (2, "Oak", False, 2.0, *box), (1, "Oak", False, 1.0, *box), (3, "Elm", False, 1.0, *box), (4, "x", True, 0.5, *box), (5, "x", True, 0.4, *box)]
    df = spark.createDataFrame(rows_, "road_id long, name string, unnamed boolean, grade double, lat_min double, lat_max double, lon_min double, lon_max double").withColumn("rank_key", -F.col("grade"))
    assert sorted(r["road_id"] for r in ranking.dedupe_same_hill(df).collect()) == [1, 1, 3, 4, 5]


def png(pixels: np.ndarray, filters) -> bytes:
    h, w, _ = pixels.shape
    out = b""
    for y in range(h):
        line, above = pixels[y].astype(int).ravel(), (pixels[y - 1].astype(int).ravel() if y else np.zeros(w * 3, int))
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        f = filters[y % len(filters)]
        if f == 4:
            e = left + above - corner
            pa, pb, pc = abs(e - left), abs(e - above), abs(e - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        else:
            guess = [0 * line, left, above, (left + above) // 2][f]
        out += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_tiles_from_files(spark, tmp_path):
    pix = np.random.default_rng(1).integers(0, 256, (16, 16, 3))
    want = (pix[..., 0] * 256.0 + pix[..., 1] + pix[..., 2] / 256 - 32768).ravel()
    assert np.allclose(tiles.decode_png(png(pix, [0, 1, 2, 3, 4])), want)
    lat, lon = 35.2, -82.7
    n = 2**13
    x, y = int((lon + 180) / 360 * n), int((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * n)
    (tmp_path / f"13/{x}").mkdir(parents=True)
    flat = np.zeros((256, 256, 3), int)
    flat[..., 0], flat[..., 1] = 130, 7
    (tmp_path / f"13/{x}/{y}.png").write_bytes(png(flat, [0]))
    samples = spark.createDataFrame([(1, lat, lon), (2, lat + 5, lon)], "id long, lat double, lon double")
    got = {r["id"]: r["elev"] for r in tiles.elevate(samples, tiles.read_tiles(spark, str(tmp_path)), piece=1).collect()}
    assert got == {1: 130 * 256 + 7 - 32768, 2: None}


def test_laid_out_tiles_equal_whole_ones_and_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(3)
    lat, lon = rng.uniform(35.0, 35.2, 4000), rng.uniform(-82.2, -82.0, 4000)
    lat[:3000], lon[:3000] = 35.05 + rng.uniform(0, 1e-3, 3000), -82.1  # most of them in one place
    samples = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], "id long, lat double, lon double")
    need = tiles.needed_tiles(samples).filter("x % 5 <> 0").collect()
    rasters = spark.createDataFrame([(*r, rng.uniform(0, 900, 256 * 256).tolist()) for r in need], "z int, x int, y int, raster array<double>")
    table = "tiles_" + os.path.basename(tmp_path).replace("-", "_")
    tiles.lay_out(rasters, table, str(tmp_path / "store"), 6)
    out = tiles.elevate_stored(samples, table)
    want = {r["id"]: r["elev"] for r in tiles.elevate(samples, rasters, piece=500).collect()}
    got = {r["id"]: r["elev"] for r in out.collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or math.isclose(got[k], want[k], rel_tol=1e-12)) for k in want)
    assert any(v is None for v in got.values())
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        tiles.elevate_stored(samples, table).explain()
    lines = shown.getvalue().splitlines()
    scan = next(k for k, x in enumerate(lines) if "FileScan parquet" in x and "pixels" in x)
    assert sum("Exchange" in x for x in lines) == 1 and "SelectedBucketsCount: 6 out of 6" in lines[scan] and not any("Exchange" in x for x in lines[scan - 3 : scan])
    spark.sql(f"drop table {table}")


def test_store_commits(spark, tmp_path):
    path, now = str(tmp_path / "p"), F.lit("2024-01-20").cast("timestamp")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "search_key string")
    found = lambda at=now: sorted((r["search_key"], r["road_id"]) for r in store.get_profiles(spark, path, keys, at).collect())
    rows = lambda *r: spark.createDataFrame(list(r), "search_key string, road_id long")
    assert found() == []
    store.put_profiles(rows(("a", 1), ("a", 7)), path, F.lit("2024-01-01").cast("timestamp"))
    store.put_profiles(rows(("b", 2), ("c", 5)), path, now)
    store.put_profiles(rows(("b", 3)), path, now)
    assert found() == [("b", 3), ("c", 5)] and found(F.lit("2024-01-10").cast("timestamp"))[:2] == [("a", 1), ("a", 7)]

    # a write that fails before its commit, half of its rows written, leaves the store as it was
    def broken(batches):
        for pdf in batches:
            yield pdf
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        store.put_profiles(rows(("b", 9), ("c", 9)).mapInPandas(broken, "search_key string, road_id long"), path, now)
    assert found() == [("b", 3), ("c", 5)]
    rows(("c", 8)).write.parquet(f"{path}/data/part=orphan")
    assert found() == [("b", 3), ("c", 5)]

    store.purge(spark, path, now)
    assert found(F.lit("2024-01-10").cast("timestamp")) == [("b", 3), ("c", 5)]
    assert store.snapshot(spark, path, 2).count() == 3 and store.snapshot(spark, path).count() == 2
    store.compact(spark, path, str(tmp_path / "q"))
    assert sorted(r["road_id"] for r in store.get_profiles(spark, str(tmp_path / "q"), keys, now).collect()) == [3, 5]
    store.purge(spark, path, F.lit("2025-01-01").cast("timestamp"))
    assert found() == [] and store.snapshot(spark, path).count() == 0


def test_export(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 'Oak, "x"', 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0)], "rank int, name string, " + ", ".join(f"{c} double" for c in store.CSV_COLUMNS["climb"][2:]))
    store.export_csv(ranked, "climb", str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfrank,name") and raw.endswith(b"\r\n") and b'1,"Oak, ""x""",1.000' in raw and raw.count(b"\r\n") == 2


def test_read_and_select_ways(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"elements": [{"type": "way", "id": 1, "tags": {"highway": "primary"}, "geometry": [{"lat": 35.0, "lon": -82.0}, {"lat": 35.01, "lon": -82.0}]}, {"type": "way", "id": 2, "tags": {"highway": "path"}, "geometry": []}]}')
    (tmp_path / "x.json").write_text("{}")
    found = osm.read_ways(spark, str(tmp_path))
    areas = spark.createDataFrame([(7, 35.0, -82.01, 1500.0), (8, 36.0, -82.0, 1500.0)], "area_id long, lat double, lon double, radius_m double")
    assert [(r["area_id"], r["id"]) for r in osm.select_ways(found, areas).collect()] == [(7, 1)]


def test_ways_that_cross_a_circle_without_a_point_in_it(spark):
    def way(i, *pts, highway="primary"):
        return (i, "way", {"highway": highway}, list(pts))

    ways_ = [way(1, (35.0, -82.3), (35.0, -81.7)), way(2, (35.02, -82.3), (35.02, -81.7)), way(3, (35.3, -82.0), (34.7, -82.0)), way(4, (35.001, -82.0)), way(5, (35.0, -82.3), (35.0, -82.1)), way(6, (35.3, -82.3), (34.7, -81.7)), way(7, (35.0, -82.3), (35.0, -81.7), highway="path")]
    df = spark.createDataFrame(ways_, "id long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    areas = spark.createDataFrame([(1, 35.0, -82.0, 1500.0), (2, 35.02, -82.2, 2300.0)], "area_id long, lat double, lon double, radius_m double")
    got = sorted((r["area_id"], r["id"]) for r in osm.select_ways(df, areas).collect())
    assert got == [(1, 1), (1, 3), (1, 4), (1, 6), (2, 1), (2, 2), (2, 5)]


def test_a_pair_of_way_and_area_is_met_once_and_not_shuffled_again(spark):
    """Ways of many segments over several cells, areas of many cells: one row each without a search for equal rows."""
    way = (1, "way", {"highway": "primary"}, [(35.0 + 0.01 * k, -82.0 + 0.04 * (k % 2)) for k in range(30)])
    ways_ = spark.createDataFrame([way], "id long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    areas = spark.createDataFrame([(1, 35.1, -82.0, 15000.0), (2, 35.3, -81.7, 2000.0), (3, 35.2, -81.98, 600.0)], "area_id long, lat double, lon double, radius_m double")
    out = osm.select_ways(ways_, areas)
    assert sorted(r["area_id"] for r in out.collect()) == [1, 3]
    assert not any("Aggregate" in x for x in plan_lines(out))
