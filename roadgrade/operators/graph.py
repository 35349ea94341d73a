"""Connected components, junctions of roads, and inclines over several roads."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import box_cells, haversine_m, js_round, planar_xy
from ..kernels import profile as kernels
from ..kernels.stitch import distance
from ..params import BOX_PAD, HALF_STEP, INCLINE_GRADE, JOIN_TOL



def shared_folder(df: DataFrame) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one may make its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    shared_folder(df)
    return df.checkpoint()


def connected(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b) -> (node, component): labels fall to the least id of each component, with pointer jumping between rounds.

    Ids of different kinds must be told apart by the caller (hash them with a tag); all of them are labelled.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    for _ in range(max_rounds):
        low = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(low, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = low.select(F.col("a").alias("m"), F.col("m").alias("j"))
        now = checkpointed(low.join(jump, "m", "left").select("a", "l", F.least("m", F.coalesce("j", "m")).alias("m")))
        changed = now.filter("m < l").limit(1).count()
        label = now.select("a", F.col("m").alias("l"))
        if not changed:
            return label.select(F.col("a").alias("node"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def losers(conflicts: DataFrame) -> DataFrame:
    """(better, worse) -> id: what a walk from the best to the worst leaves out, when it keeps each that is in conflict
    with none kept so far.

    In each round those without a better one left are winners, and what they are in conflict with loses; both leave the
    table, so it shrinks in every round. Rounds follow the longest chain of ever worse ones, so a whole network needs no
    task of its own; the losers of all rounds are one table in the shared folder.
    """
    left = checkpointed(conflicts.select("better", "worse").distinct())
    ids = left.select(F.col("worse").alias("id"))
    path = f"{shared_folder(left)}/losers-{uuid.uuid4().hex}"
    ids.limit(0).write.parquet(path)
    while not left.isEmpty():
        winners = left.select(F.col("better").alias("id")).distinct().join(left.select(F.col("worse").alias("id")), "id", "left_anti")
        lost = checkpointed(left.join(winners, left.better == winners.id).select(F.col("worse").alias("id")).distinct())
        lost.write.mode("append").parquet(path)
        left = checkpointed(left.join(lost, left.better == lost.id, "left_anti").join(lost, F.col("worse") == lost.id, "left_anti"))
    return left.sparkSession.read.schema(ids.schema).parquet(path)


def same_name_conflicts(items: DataFrame, area: Sequence[str], better, cell: float = 0.005) -> DataFrame:
    """(better, worse) of items (id, road_id, name, box columns) of one name on different roads whose boxes meet.

    Boxes meet on a grid, so a name that stands in every town is looked at town by town; ``better(x, y)`` compares the
    columns with suffix _x and _y.
    """
    box = ("lat_min", "lat_max", "lon_min", "lon_max")
    at = F.explode(box_cells(F.col("lat_min"), F.col("lon_min"), F.col("lat_max"), F.col("lon_max"), cell))
    cells = items.select("*", at.alias("c")).select(*items.columns, "c.cy", "c.cx")
    on = [*area, "name", "cy", "cx"]
    x, y = (cells.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in items.columns if c not in on]) for s in "xy")
    meet = (F.col("lat_min_x") <= F.col("lat_max_y")) & (F.col("lat_min_y") <= F.col("lat_max_x")) & (F.col("lon_min_x") <= F.col("lon_max_y")) & (F.col("lon_min_y") <= F.col("lon_max_x"))
    assert set(box) <= set(items.columns)
    return x.join(y, on).filter((F.col("road_id_x") != F.col("road_id_y")) & meet & better("x", "y")).select(F.col("id_x").alias("better"), F.col("id_y").alias("worse"))


def endpoint_junctions(samples: DataFrame, area: Sequence[str] = ()) -> DataFrame:
    """(area, road_id, end, other_id, other_k, dist): the nearest sample of each other road within 20 m of a road's end.

    Samples meet ends by 20 m cells of a plane through the area's first sample; only the ends are put in nine cells.
    """
    lat0 = samples.groupBy(*area).agg(F.min_by("lat", F.struct("road_id", "k")).alias("lat0"))
    s = samples.join(lat0, list(area)) if area else samples.crossJoin(F.broadcast(lat0))  # one row without areas
    x, y = planar_xy(F.col("lat"), F.col("lon"), F.col("lat0"))
    s = s.withColumns({"x": x, "y": y}).withColumns({"cx": js_round(F.col("x") / JOIN_TOL), "cy": js_round(F.col("y") / JOIN_TOL)})
    last = F.max("k").over(W.partitionBy(*area, "road_id"))
    e = s.withColumn("_last", last).filter("k = 0 or k = _last")
    e = e.select(*area, "road_id", F.explode(F.when(F.col("_last") == 0, F.array(F.lit(0), F.lit(1))).when(F.col("k") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))).alias("end"), F.col("x").alias("ex"), F.col("y").alias("ey"), "cx", "cy")
    near = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]), lambda d: F.struct((F.col("cx") + d["i"]).alias("cx"), (F.col("cy") + d["j"]).alias("cy")))
    e = e.select(*area, "road_id", "end", "ex", "ey", F.explode(near).alias("c")).select(*area, "road_id", "end", "ex", "ey", "c.cx", "c.cy")
    o = s.select(*area, F.col("road_id").alias("other_id"), F.col("k").alias("other_k"), "x", "y", "cx", "cy")
    dist = F.sqrt(F.pow(F.col("x") - F.col("ex"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ey"), F.lit(2.0)))
    met = e.join(o, [*area, "cx", "cy"]).filter("road_id <> other_id").withColumn("dist", dist).filter(F.col("dist") <= JOIN_TOL)
    best = met.groupBy(*area, "road_id", "end", "other_id").agg(F.min(F.struct("dist", "other_k")).alias("m"))
    return best.select(*area, "road_id", "end", "other_id", F.col("m.other_k").alias("other_k"), F.col("m.dist").alias("dist"))


#: What bounds a slice's inclines: its length, lowest and highest elevation, largest rise and largest fall on the way.
SUMMARY = ("length", "lo", "hi", "up", "down")


def _summary(**parts: Column) -> Column:
    return F.struct(*[parts[c].alias(c) for c in SUMMARY])


def _then(a: Column, b: Column) -> Column:
    """The summary of one slice and the next; roads may lie a little apart where they meet."""
    return _summary(
        length=a["length"] + b["length"] + 1.1 * JOIN_TOL, lo=F.least(a["lo"], b["lo"]), hi=F.greatest(a["hi"], b["hi"]),
        up=F.greatest(a["up"], b["up"], b["hi"] - a["lo"]), down=F.greatest(a["down"], b["down"], a["hi"] - b["lo"]),
    )


def _can_hold(s: Column, min_span: float) -> Column:
    """An incline is long enough and rises or falls by its least grade over that length; a little is forgiven for rounding."""
    bound = min_span - HALF_STEP
    return (s["length"] >= bound - 0.01) & (F.greatest(s["up"], s["down"]) >= INCLINE_GRADE * bound - 1e-6)


def slice_summaries(samples: DataFrame, area: Sequence[str] = ()) -> DataFrame:
    """(area, road_id, k, n, to_start, to_end): summaries of the slices from sample k back to the road's start and on to its end."""
    keys = [*area, "road_id"]
    fore, back = W.partitionBy(*keys).orderBy("k"), W.partitionBy(*keys).orderBy(F.desc("k"))
    step = F.coalesce(haversine_m(F.lag("lat").over(fore), F.lag("lon").over(fore), F.col("lat"), F.col("lon")), F.lit(0.0))
    ahead = F.coalesce(F.lag("step").over(back), F.lit(0.0))
    s = samples.select(*keys, "k", "elev", step.alias("step"), F.count("*").over(W.partitionBy(*keys)).cast("int").alias("n")).withColumn("ahead", ahead)
    run = {"f": fore.rowsBetween(W.unboundedPreceding, 0), "b": back.rowsBetween(W.unboundedPreceding, 0)}
    s = s.withColumns({f"{g}_{t}": f("elev").over(w) for t, w in run.items() for g, f in (("lo", F.min), ("hi", F.max))})
    s = s.withColumns({f"high_{t}": F.max(F.col("elev") - F.col(f"lo_{t}")).over(w) for t, w in run.items()} | {f"low_{t}": F.max(F.col(f"hi_{t}") - F.col("elev")).over(w) for t, w in run.items()})
    s = s.withColumns({"length_f": F.sum("step").over(run["f"]), "length_b": F.sum("ahead").over(run["b"])})
    # in travel back to the start a rise is what is a fall on the way out; the frames that run backwards see the end first
    to_start = _summary(length=F.col("length_f"), lo=F.col("lo_f"), hi=F.col("hi_f"), up=F.col("low_f"), down=F.col("high_f"))
    to_end = _summary(length=F.col("length_b"), lo=F.col("lo_b"), hi=F.col("hi_b"), up=F.col("low_b"), down=F.col("high_b"))
    return s.select(*keys, "k", "n", to_start.alias("to_start"), to_end.alias("to_end"))


def chains(samples: DataFrame, junctions: DataFrame | None, min_span: float, max_roads: int = 1, area: Sequence[str] = ()) -> DataFrame:
    """(area, segs): slices (road_id, from, to) of up to max_roads connected roads, every prefix of every chain that can hold
    a long incline.

    A chain begins with a whole road (in either direction if there may be more); from the end that it arrives at it goes on
    along a road met there, from the junction to either of its ends, no road twice. Summaries compose along a chain, so no
    sample is read here but once a road; from what can follow an end at best within the roads that are left, a chain that
    cannot become long and steep enough is left at once.
    """
    keys = [*area, "road_id"]
    parts = slice_summaries(samples, area)
    step = lambda road, a, b: F.struct(road.alias("road_id"), a.alias("from"), b.alias("to"))
    road, zero, last = F.col("road_id"), F.lit(0), F.col("n") - 1
    whole = parts.filter("k = 0 and n > 1")
    start = whole.select(*keys, F.array(step(road, zero, last)).alias("segs"), F.lit(1).alias("end"), F.col("to_end").alias("sum"))
    if max_roads == 1:
        return start.filter(_can_hold(F.col("sum"), min_span)).select(*area, "segs")
    turned = parts.filter("k = n - 1 and n > 1").select(*keys, F.array(step(road, last, zero)).alias("segs"), zero.alias("end"), F.col("to_start").alias("sum"))
    # what goes on from an end of a road: each junction and each of the two ways along the other road
    met = junctions.select(*area, "road_id", "end", "other_id", F.col("other_k").alias("k")).join(parts.withColumnRenamed("road_id", "other_id"), [*area, "other_id", "k"])
    ways = F.array(F.struct(zero.alias("end"), zero.alias("to"), F.col("to_start").alias("sum")), F.struct(F.lit(1).alias("end"), last.alias("to"), F.col("to_end").alias("sum")))
    edges = met.select(*keys, "end", "other_id", "k", F.explode(ways).alias("w")).filter("w.to <> k").select(*keys, "end", "other_id", F.col("k").alias("other_k"), F.col("w.end").alias("next"), F.col("w.to").alias("to"), F.col("w.sum").alias("more"))
    edges = checkpointed(edges)
    best, reach = None, []
    for _ in range(max_roads - 1):
        on = edges
        if best is not None:
            on = edges.join(best.select(*area, F.col("road_id").alias("other_id"), F.col("end").alias("next"), F.col("best").alias("then")), [*area, "other_id", "next"], "left")
            on = on.withColumn("more", F.when(F.col("then").isNull(), F.col("more")).otherwise(_then(F.col("more"), F.col("then"))))
        most = {c: (F.min if c == "lo" else F.max)(f"more.{c}").alias(c) for c in SUMMARY}
        best = checkpointed(on.groupBy(*keys, "end").agg(*most.values()).select(*keys, "end", F.struct(*SUMMARY).alias("best")))
        reach.insert(0, best)  # what the first road may be followed by stands first

    now, out = start.union(turned), None
    for k in range(max_roads):
        fits = now.filter(_can_hold(F.col("sum"), min_span)).select(*area, "segs")
        out = fits if out is None else out.union(fits)
        if k < max_roads - 1:
            now = now.join(reach[k], [*keys, "end"]).filter(_can_hold(_then(F.col("sum"), F.col("best")), min_span)).drop("best")
            now = now.join(edges, [*keys, "end"]).filter("not exists(segs, s -> s.road_id = other_id)")
            more = F.array(step(F.col("other_id"), F.col("other_k"), F.col("to")))
            now = checkpointed(now.select(*area, F.col("other_id").alias("road_id"), F.concat("segs", more).alias("segs"), F.col("next").alias("end"), _then(F.col("sum"), F.col("more")).alias("sum")))
    return out


def _area_schema(df: DataFrame, area: Sequence[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in area)


COMBINED = "chain string, segs array<struct<road_id:long,from:int,to:int>>, d array<double>, elev array<double>, lat array<double>, lon array<double>"


def _joined(chain_rows: DataFrame, samples: DataFrame, area: Sequence[str]) -> DataFrame:
    """(area, chain, segs, road, k, lat, lon, elev): chains with their samples in order, an array for each column. Python
    gets such arrays as numbers side by side; of an array of structs it would make an object for every sample."""
    c = chain_rows.select(*area, F.to_json("segs").alias("chain"), "segs").select(*area, "chain", "segs", F.posexplode("segs").alias("part", "s"))
    rows = c.select(*area, "chain", "segs", "part", "s.*").join(samples.select(*area, "road_id", "k", "lat", "lon", "elev"), [*area, "road_id"])
    rows = rows.filter(F.col("k").between(F.least("from", "to"), F.greatest("from", "to")))
    order = F.when(F.col("from") <= F.col("to"), F.col("k")).otherwise(-F.col("k"))
    got = rows.groupBy(*area, "chain").agg(F.first("segs").alias("segs"), F.array_sort(F.collect_list(F.struct("part", order.alias("o"), "road_id", "k", "lat", "lon", "elev"))).alias("p"))
    return got.select(*area, "chain", "segs", F.col("p.road_id").alias("road"), *[F.col(f"p.{x}").alias(x) for x in ("k", "lat", "lon", "elev")])


def _along(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Running distances from sample to sample."""
    p = list(zip(lat.tolist(), lon.tolist(), strict=True))
    return np.cumsum([0.0, *(distance(a, b) for a, b in zip(p, p[1:], strict=False))])


def combine_steps(chain_rows: DataFrame, samples: DataFrame, area: Sequence[str] = ()) -> DataFrame:
    """Chains with their joined profile: distances between successive samples anew, elevations and places."""
    names = [*area, "chain", "segs", "d", "elev", "lat", "lon"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(d=[_along(lat, lon) for lat, lon in zip(pdf["lat"], pdf["lon"], strict=True)])[names]

    return _joined(chain_rows, samples, area).drop("road", "k").mapInPandas(run, _area_schema(samples, area) + COMBINED)


INCLINE = "seq string, road_id long, i int, j int, span double, gain double, grade double, segs array<struct<road_id:long,from:int,to:int>>, parts array<struct<road_id:long,low:int,high:int,lat_min:double,lat_max:double,lon_min:double,lon_max:double>>, start struct<lat:double,lon:double,elev:double>, end struct<lat:double,lon:double,elev:double>"


def longest_incline_paths(samples: DataFrame, names: DataFrame, min_span: float, max_roads: int = 1, area: Sequence[str] = ()) -> DataFrame:
    """Long inclines over up to max_roads connected roads, without those that share a segment with a longer one or of which
    a slice lies in the same place as a slice of a longer one on another road of that slice's name. Each place (area) is
    searched by itself.

    samples: (area, road_id, k, lat, lon, elev); names: (area, road_id, name, unnamed). road_id and name are those of the
    first road; names has those of all roads in order, joined by " + ", n_roads their number. Start is the lower end.
    """
    junctions = checkpointed(endpoint_junctions(samples, area)) if max_roads > 1 else None
    joined = _joined(chains(samples, junctions, min_span, max_roads, area), samples, area).drop("segs")
    columns = [*area, *(f.split()[0] for f in re.sub("<.*?>+", "", INCLINE).split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                d, e = _along(row.lat, row.lon), np.asarray(row.elev, float)
                for n, (i, j, span, gain, grade) in enumerate(kernels.inclines(d, e, min_span)):
                    segs, parts = _slices(row.road, row.k, row.lat, row.lon, i, j)
                    a, b = (i, j) if e[i] <= e[j] else (j, i)
                    pt = lambda k: {"lat": float(row.lat[k]), "lon": float(row.lon[k]), "elev": float(e[k])}  # noqa: E731, B023
                    where = [getattr(row, c) for c in area]
                    out.append((*where, f"{row.chain}#{n:03d}", segs[0]["road_id"], i, j, span, gain, grade, segs, parts, pt(a), pt(b)))
            yield pd.DataFrame(out, columns=columns)

    found = joined.mapInPandas(run, _area_schema(samples, area) + INCLINE)
    # chains that go on and chains walked backwards find an incline again: one of each stays
    slices = F.array_sort(F.transform("parts", lambda s: F.struct(s["road_id"].alias("road_id"), s["low"].alias("low"), s["high"].alias("high"))))
    found = found.groupBy(*area, slices.alias("slices")).agg(F.min_by(F.struct(*[c for c in columns if c not in area]), F.struct(-F.col("span"), "seq")).alias("x")).select(*area, "x.*")
    found = checkpointed(found.join(names.select(*area, "road_id", "name", "unnamed"), [*area, "road_id"]).withColumn("id", F.xxhash64(*area, "seq")))
    kept = found.join(losers(_incline_conflicts(found, names, area)), "id", "left_anti")
    named = kept.select("id", *area, F.posexplode("segs").alias("at", "s")).select("id", *area, "at", F.col("s.road_id").alias("road_id")).join(names.select(*area, "road_id", F.col("name").alias("one")), [*area, "road_id"])
    labels = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "road_id", "one"))).alias("l")).select(
        "id", F.array_join(F.array_distinct("l.one"), " + ").alias("names"), F.size(F.array_distinct("l.road_id")).alias("n_roads")
    )
    return kept.join(labels, "id").drop("id", "parts")


def _slices(roads: np.ndarray, ks: np.ndarray, lat: np.ndarray, lon: np.ndarray, i: int, j: int) -> tuple[list[dict], list[dict]]:
    """Samples i to j of a joined profile as slices of roads: in the direction of travel, and as ranges with padded boxes."""
    road = np.asarray(roads[i : j + 1], np.int64)
    edge = [0, *(np.flatnonzero(np.diff(road)) + 1).tolist(), len(road)]
    segs, parts = [], []
    for a, b in zip(edge, edge[1:], strict=False):
        first, last = int(ks[i + a]), int(ks[i + b - 1])
        la, lo = lat[i + a : i + b], lon[i + a : i + b]
        segs.append({"road_id": int(road[a]), "from": first, "to": last})
        box = {"lat_min": la.min() - BOX_PAD, "lat_max": la.max() + BOX_PAD, "lon_min": lo.min() - BOX_PAD, "lon_max": lo.max() + BOX_PAD}
        parts.append({"road_id": int(road[a]), "low": min(first, last), "high": max(first, last)} | box)
    return segs, parts


def _incline_conflicts(found: DataFrame, names: DataFrame, area: Sequence[str]) -> DataFrame:
    """(better, worse): some slice of each lie on one piece of a road, or on different roads of one name in one place."""
    better = lambda x, y: (F.col(f"span_{x}") > F.col(f"span_{y}")) | ((F.col(f"span_{x}") == F.col(f"span_{y}")) & (F.col(f"seq_{x}") < F.col(f"seq_{y}")))
    part = checkpointed(found.select(*area, "id", "span", "seq", F.explode("parts").alias("s")).select(*area, "id", "span", "seq", "s.*"))
    x, y = (part.select(*area, "road_id", *[F.col(c).alias(f"{c}_{t}") for c in ("id", "span", "seq", "low", "high")]) for t in "xy")
    over = F.greatest("low_x", "low_y") < F.least("high_x", "high_y")
    on_road = x.join(y, [*area, "road_id"]).filter(better("x", "y") & over).select(F.col("id_x").alias("better"), F.col("id_y").alias("worse"))
    named = part.join(names.filter("not unnamed").select(*area, "road_id", "name"), [*area, "road_id"]).drop("low", "high")
    return on_road.union(same_name_conflicts(named, area, better))


def incline_virtual_road(inclines: DataFrame, area: Sequence[str] = ()) -> DataFrame:
    """(area, road_id, name, n_roads, span, gain, grade, segs): an incline as a road of its own, its id the start at five
    decimals, its name those of its roads."""
    return inclines.select(*area, F.format_string("incline:%.5f,%.5f", F.col("start.lat"), F.col("start.lon")).alias("road_id"), F.col("names").alias("name"), "n_roads", "span", "gain", "grade", "segs")


def virtual_samples(virtual: DataFrame, samples: DataFrame, area: Sequence[str] = ()) -> DataFrame:
    """(area, road_id, name, k, d, elev, lat, lon, on_incline): the samples of virtual roads, their distances from zero on;
    on_incline marks the segment that begins at a sample: all of them; none begins at the last.

    Only the samples that the roads' slices name are joined.
    """
    joined = combine_steps(virtual.select(*area, "segs"), samples, area).select(*area, "segs", F.posexplode(F.arrays_zip("d", "elev", "lat", "lon")).alias("k", "s"), F.size("d").alias("n"))
    on = virtual.select(*area, "road_id", "name", "segs").join(joined, [*area, "segs"])
    return on.select(*area, "road_id", "name", "k", "s.*", (F.col("k") < F.col("n") - 1).alias("on_incline"))


def with_virtual_roads(roads: DataFrame, virtual: DataFrame) -> DataFrame:
    """Ranked roads and the virtual roads of inclines in one table; what one side lacks is null. road_id becomes text."""
    return roads.withColumn("road_id", F.col("road_id").cast("string")).unionByName(virtual, allowMissingColumns=True)
