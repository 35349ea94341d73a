"""Queries that build profiles: ways, stitching, samples, decks, elevations, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import profile, ways
from ..params import RANKED_HIGHWAYS
from ..sources import osm, store, tiles
from .rank import P, prof, rounded
from .views import ctes, sql, view

QUERIES: dict = {}
PTS = ctes("v_way_pts")
TAGS = ctes("v_way_tags")
BOTH = ctes("v_way_pts", "v_way_tags")


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return add


def raw_ways(spark, sf) -> DataFrame:
    """Raw ways in the shape that is read from files."""
    pts = view(spark, sf, "v_way_pts").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("p"))
    t = view(spark, sf, "v_way_tags").join(pts, "way_id")
    keys = ("name", "ref", "highway", "bridge", "layer", "junction")
    tags = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*keys)), lambda k, v: v.isNotNull())
    geometry = F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return t.select("area_id", F.lit("way").alias("type"), F.col("way_id").alias("id"), tags.alias("tags"), geometry.alias("geometry"))


HAV = "2*6371000.0e0*asin(sqrt(sin(radians({b}.lat-{a}.lat)/2)*sin(radians({b}.lat-{a}.lat)/2)+cos(radians({a}.lat))*cos(radians({b}.lat))*sin(radians({b}.lon-{a}.lon)/2)*sin(radians({b}.lon-{a}.lon)/2)))"
CUM = f"""seg as (select b.*, case when a.i is null then 0 else {HAV.format(a='a', b='b')} end as step from v_way_pts b left join v_way_pts a on a.way_id = b.way_id and a.i = b.i - 1),
 cum as (select *, sum(step) over (partition by way_id order by i rows between unbounded preceding and current row) as d from seg)"""


@query(f"{PTS}, {CUM} select way_id, i, round(d, 3) as d from cum")
def cum_distance(spark, sf):
    return rounded(profile.cumulative_distance(view(spark, sf, "v_way_pts")).select("way_id", "i", "d"), 3, "d")


@query(f"{PTS}, {CUM} select way_id, round(sum(step), 3) as length from cum group by way_id")
def way_length(spark, sf):
    d = profile.cumulative_distance(view(spark, sf, "v_way_pts"))
    return d.groupBy("way_id").agg(F.round(F.sum("step"), 3).alias("length"))


RESAMPLE = f"""{CUM}, tot as (select way_id, max(d) as total, max(i) as last from cum group by way_id),
 num as (select *, case when total = 0 then 0 else cast(greatest(1, floor(total/25.0e0 + 0.5e0)) as int) end as n from tot),
 tgt as (select way_id, last, k, case when n = 0 then 0 else k*(total/n) end as t from num, unnest(generate_series(0, n)) as g(k)),
 pick as (select t.way_id, t.k, t.t, least(min(case when c.d >= t.t then c.i end), max(t.last)) as hi from tgt t join cum c on c.way_id = t.way_id and (c.i > 0 or t.last = 0) group by t.way_id, t.k, t.t),
 res as (select p.way_id, p.k, p.t as d, a.lat + (b.lat-a.lat)*case when b.d > a.d then least((p.t-a.d)/(b.d-a.d), 1) else 0 end as lat,
   a.lon + (b.lon-a.lon)*case when b.d > a.d then least((p.t-a.d)/(b.d-a.d), 1) else 0 end as lon
   from (select way_id, k, t, coalesce(hi, (select last from tot where tot.way_id = pick.way_id)) as hi from pick) p
   join cum b on b.way_id = p.way_id and b.i = p.hi join cum a on a.way_id = p.way_id and a.i = greatest(p.hi - 1, 0))"""


@query(f"{PTS}, {RESAMPLE} select way_id, k, round(d, 3) as d, round(lat, 9) as lat, round(lon, 9) as lon from res")
def resample_profile(spark, sf):
    return rounded(rounded(profile.resample(view(spark, sf, "v_way_pts")).drop("b"), 3, "d"), 9, "lat", "lon")


def deck_sql(of: str) -> str:
    """Table dk: of a table of samples, with the elevations of decks."""
    return f"""nb as (select *, last_value(case when not b then k end ignore nulls) over (partition by road_id order by k rows between unbounded preceding and current row) as pk,
  first_value(case when not b then k end ignore nulls) over (partition by road_id order by k rows between current row and unbounded following) as qk,
  min(k) over (partition by road_id) as ak, max(k) over (partition by road_id) as zk from {of}),
 ft as (select nb.*, coalesce(pk, case when qk is null then ak end) as lk, coalesce(qk, case when pk is null then zk end) as hk from nb),
 dk as (select f.road_id, f.k, f.d, case when not f.b then f.elev when l.k is null then h.elev when h.k is null then l.elev when h.d = l.d then l.elev
   else l.elev + (h.elev-l.elev)*((f.d-l.d)/(h.d-l.d)) end as elev
 from ft f left join {of} l on l.road_id = f.road_id and l.k = f.lk left join {of} h on h.road_id = f.road_id and h.k = f.hk)"""


def repair_sql(of: str) -> str:
    """Table fx: of a table of samples, after repair. jp: jumps; cl: which ones the next jump undoes; wk: those that are
    looked at, one after the other, without the returns that are used up; ri: rises after repair."""
    return f"""sg as (select road_id, k, d, elev, lead(d) over w as d2, lead(elev) over w as e2 from {of} window w as (partition by road_id order by k)),
 jp as (select *, row_number() over (partition by road_id order by k) as r from sg where abs(e2 - elev) > 0.6e0*(d2 - d)),
 cl as (select a.road_id, a.r, a.k, b.k as jk, a.d, a.elev, b.d2 as jd, b.e2 as je, coalesce(b.d2 - a.d <= 250e0 and abs(b.e2 - a.elev) <= 0.6e0*(b.d2 - a.d), false) as closes
   from jp a left join jp b on b.road_id = a.road_id and b.r = a.r + 1),
 wk as (select * from cl where r = 1 union all select c.* from wk w join cl c on c.road_id = w.road_id and c.r = w.r + case when w.closes then 2 else 1 end),
 ri as (select s.road_id, s.k, s.d, s.elev, case when b.k is not null then (b.je - b.elev)*(s.d2 - s.d)/(b.jd - b.d)
     when c.k is not null then sign(s.e2 - s.elev)*0.6e0*(s.d2 - s.d) else s.e2 - s.elev end as rise
   from sg s left join wk b on b.closes and b.road_id = s.road_id and s.k between b.k and b.jk left join wk c on not c.closes and c.road_id = s.road_id and c.k = s.k),
 fx as (select road_id, k, d, first_value(elev) over (partition by road_id order by k) + coalesce(sum(rise) over (partition by road_id order by k rows between unbounded preceding and 1 preceding), 0) as elev from ri)"""


ROUGH = ctes("v_rough").replace("with ", "with recursive ", 1)


@query(f"{P}, {deck_sql('v_profile')} select road_id, k, round(elev, 6) as deck from dk")
def deck_fill(spark, sf):
    return rounded(profile.deck_elevations(prof(spark, sf)).select("road_id", "k", "deck"), 6, "deck")


@query(f"{ROUGH}, {repair_sql('v_rough')} select road_id, k, d, round(elev, 6) as elev from fx")
def despike(spark, sf):
    rough = profile.to_arrays(view(spark, sf, "v_rough"), columns=("d", "elev"))
    return rounded(profile.despike(rough), 6, "elev")


@query(f"{ROUGH}, {deck_sql('v_rough')}, {repair_sql('dk')} select road_id, k, d, round(elev, 6) as elev from fx")
def analyzed(spark, sf):
    return rounded(profile.analyze(view(spark, sf, "v_rough")), 6, "elev")


@query(f"{P} select road_id, max(d) as length, round(min(elev), 6) as e_min, round(max(elev), 6) as e_max from v_profile group by road_id")
def profile_stats(spark, sf):
    return rounded(profile.profile_stats(prof(spark, sf)), 6, "e_min", "e_max")


@query(f"{P} select road_id, k, round((elev2-elev)/(d2-d), 9) as grade from (select *, lead(d) over w as d2, lead(elev) over w as elev2 from v_profile window w as (partition by road_id order by k)) t where d2 is not null")
def segment_grade(spark, sf):
    return rounded(profile.segments(prof(spark, sf)).select("road_id", "k", "grade"), 9, "grade")


@query(f"{PTS} select way_id, count(*) as n from v_way_pts group by way_id having count(*) >= 3")
def drop_tiny(spark, sf):
    return profile.drop_tiny(view(spark, sf, "v_way_pts"), ("way_id",)).groupBy("way_id").agg(F.count("*").alias("n"))


NAME = "coalesce(name, nullif(trim(split_part(ref, ';', 1)), ''))"
RANKED = f"""{BOTH}, siz as (select way_id, count(*) as n from v_way_pts group by way_id),
 rk as (select t.way_id, t.area_id, {NAME} as name, n, coalesce(bridge, '') <> '' as b from v_way_tags t join siz s on s.way_id = t.way_id
  where n >= 2 and highway in ({', '.join(repr(h) for h in RANKED_HIGHWAYS)}) and coalesce(junction, '') not in ('roundabout', 'circular'))"""


@query(f"{TAGS} select way_id, {NAME} as name from v_way_tags")
def road_name(spark, sf):
    return view(spark, sf, "v_way_tags").select("way_id", text.road_name(F.col("name"), F.col("ref")).alias("name"))


@query(f"{RANKED} select way_id, coalesce(name, concat('(unnamed ', cast(way_id as varchar), ')')) as name, name is null as unnamed, n as n_points, b as flagged from rk")
def ranked_ways(spark, sf):
    p = ways.prepare(raw_ways(spark, sf))
    return p.select(F.col("id").alias("way_id"), "name", "unnamed", F.size("pts").cast("long").alias("n_points"), F.element_at("pts", 1)["b"].alias("flagged"))


DECKS = """dk as (select t.way_id, t.area_id from v_way_tags t join (select way_id, count(*) as n from v_way_pts group by way_id) s on s.way_id = t.way_id
  where n >= 2 and bridge = 'yes' and coalesce(try_cast(coalesce(layer, '1') as double), 0) > 0)"""


@query(f"{BOTH}, {DECKS} select way_id from dk")
def bridge_ways(spark, sf):
    return ways.bridge_ways(raw_ways(spark, sf)).select(F.col("id").alias("way_id"))


# bearings of an end: from the reference vertex (first 20 m and more along) to the tip; joined pairs of ends
ENDS = f"""{RANKED}, {CUM}, l as (select way_id, max(i) as last, max(d) as total from cum group by way_id),
 named as (select r.*, l.last, l.total from rk r join l on l.way_id = r.way_id where name is not null),
 refs as (select n.way_id, 0 as side, 0 as tip, coalesce(min(case when c.d >= 20e0 then c.i end), max(n.last)) as ref from named n join cum c on c.way_id = n.way_id group by n.way_id
   union all select n.way_id, 1, max(n.last), coalesce(max(case when n.total - c.d >= 20e0 then c.i end), 0) from named n join cum c on c.way_id = n.way_id group by n.way_id),
 e as (select n.area_id, n.name, r.way_id, r.side, printf('%.6f,%.6f', t.lat, t.lon) as node, t.lat as tlat, t.lon as tlon, f.lat as flat, f.lon as flon
   from refs r join named n on n.way_id = r.way_id join v_way_pts t on t.way_id = r.way_id and t.i = r.tip join v_way_pts f on f.way_id = r.way_id and f.i = r.ref),
 e2 as (select *, count(*) over (partition by area_id, name, node) as n from e),
 br as (select *, atan2(sin(radians(tlon-flon))*cos(radians(tlat)), cos(radians(flat))*sin(radians(tlat))-sin(radians(flat))*cos(radians(tlat))*cos(radians(tlon-flon))) as outb,
   atan2(sin(radians(flon-tlon))*cos(radians(flat)), cos(radians(tlat))*sin(radians(flat))-sin(radians(tlat))*cos(radians(flat))*cos(radians(flon-tlon))) as inb from e2 where n between 2 and 3),
 pr as (select a.area_id, a.name, a.node, a.way_id as a, a.side as side_a, b.way_id as b, b.side as side_b, abs(a.outb - b.inb) as t
   from br a join br b on a.area_id = b.area_id and a.name = b.name and a.node = b.node and a.way_id < b.way_id),
 tn as (select *, degrees(case when t > pi() then 2*pi() - t else t end) as turn from pr)"""


@query(f"{ENDS} select area_id, name, node, a, side_a, b, side_b, round(turn, 4) as turn from tn where turn <= 70e0")
def endpoint_pairs(spark, sf):
    return rounded(ways.endpoint_pairs(ways.prepare(raw_ways(spark, sf)), ("area_id",)), 4, "turn")


@query()
def stitched_roads(spark, sf):
    path = shared_path(spark, "raw")
    raw_ways(spark, sf).write.parquet(path)  # every step of the search reads ways
    raw = spark.read.parquet(path)
    roads = ways.stitch_roads(ways.prepare(raw), ways.roundabout_rings(raw, ("area_id",)), ("area_id",))
    return roads.select("area_id", "road_id", "name", "unnamed", F.size("pts").alias("n_points"))


def rounds(spark, sf) -> DataFrame:
    """Roundabout ways in the shape that is read from files."""
    w = view(spark, sf, "v_rounds").groupBy("area_id", "way_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("p"))
    geometry = F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return w.select("area_id", F.lit("way").alias("type"), F.col("way_id").alias("id"), F.create_map(F.lit("junction"), F.lit("circular")).alias("tags"), geometry.alias("geometry"))


# a step of rs joins, of each area that still can, the first open way and the first other one that ends where it does;
# rg: what is left, with its nodes
RINGS = f"""{ctes('v_rounds').replace('with ', 'with recursive ', 1)},
 rw as (select area_id, way_id, list({{'k': printf('%.6f,%.6f', lat, lon), 'lat': lat, 'lon': lon}} order by i) as p from v_rounds group by area_id, way_id),
 rs as (select area_id, 0 as n, list({{'l': 0, 'f': way_id, 'p': p}}) as ways from rw group by area_id
  union all select area_id, n + 1, list_append(list_filter(ways, lambda w: (w.l, w.f) <> (x.l, x.f) and (w.l, w.f) <> (y.l, y.f)), {{'l': x.l + 1, 'f': x.f, 'p':
    case when y.p[1].k = x.p[-1].k then list_concat(x.p, y.p[2:]) when y.p[-1].k = x.p[-1].k then list_concat(x.p, list_reverse(y.p)[2:])
     when y.p[-1].k = x.p[1].k then list_concat(y.p, x.p[2:]) else list_concat(list_reverse(y.p), x.p[2:]) end}})
   from (select area_id, n, any_value(ways) as ways, arg_min(x, (x.l, x.f, y.l, y.f)) as x, arg_min(y, (x.l, x.f, y.l, y.f)) as y from (select area_id, n, ways, x, unnest(ways) as y from (select *, unnest(ways) as x from rs) t) t
    where (x.l, x.f) < (y.l, y.f) and x.p[1].k <> x.p[-1].k and y.p[1].k <> y.p[-1].k and (x.p[1].k in (y.p[1].k, y.p[-1].k) or x.p[-1].k in (y.p[1].k, y.p[-1].k)) group by area_id, n) m),
 rg as (select area_id, unnest(arg_max(ways, n)) as w from rs group by area_id),
 rp as (select area_id, w.l as l, w.f as ring_id, w.p[1].k = w.p[-1].k as closed, len(w.p) as n_points, i - 1 as i, w.p[i].k as node, w.p[i].lat as lat, w.p[i].lon as lon from rg, unnest(range(1, len(w.p) + 1)) as g(i))"""


@query(f"{RINGS} select distinct area_id, ring_id, closed, cast(n_points as int) as n_points from rp")
def roundabout_rings(spark, sf):
    return ways.roundabout_rings(rounds(spark, sf), ("area_id",)).select("area_id", "ring_id", "closed", F.size("pts").alias("n_points"))


# of every two nodes of a ring both ways round are walked
ARCS = f"""{RINGS}, nd as (select area_id, node, min((l, ring_id, i)) as x from rp group by area_id, node),
 st as (select a.area_id, a.ring_id, a.closed, a.i, a.n_points - 1 as m, {HAV.format(a='a', b='b')} as step from rp a join rp b on b.area_id = a.area_id and b.ring_id = a.ring_id and b.i = a.i + 1),
 pr as (select a.area_id, a.x[2] as ring_id, a.node as a, b.node as b, a.x[3] as i, b.x[3] as j from nd a join nd b on b.area_id = a.area_id and b.x[2] = a.x[2] and b.x[3] <> a.x[3]),
 ln as (select p.area_id, p.ring_id, p.a, p.b, abs(p.i - p.j) as n_in, any_value(s.m) as m, any_value(s.closed) as closed, sum(case when s.i >= least(p.i, p.j) and s.i < greatest(p.i, p.j) then step else 0 end) as inner_m, sum(step) as total
  from pr p join st s on s.area_id = p.area_id and s.ring_id = p.ring_id group by p.area_id, p.ring_id, p.a, p.b, p.i, p.j)"""


@query(f"{ARCS} select area_id, ring_id, a, b, round(case when closed then least(inner_m, total - inner_m) else inner_m end, 4) as length, cast(case when not closed or inner_m <= total - inner_m then n_in - 1 else m - n_in - 1 end as int) as n_points from ln where not (closed and 2*n_in = m)")
def roundabout_arcs(spark, sf):
    """Every arc between two nodes of a ring but for half circles, which either way round may win by rounding."""
    rings = ways.roundabout_rings(rounds(spark, sf), ("area_id",))
    half = F.size("arc") == F.when(F.col("closed"), (F.col("n") - 1) / 2 - 1)
    out = ways.all_ring_arcs(rings, ("area_id",)).filter(~F.coalesce(half, F.lit(False)))
    return rounded(out.select("area_id", "ring_id", "a", "b", "length", F.size("arc").alias("n_points")), 4, "length")


CROSS = f"""{RANKED}, {DECKS}, {CUM},
 rs as (select a.area_id, a.way_id, a.i, a.lat, a.lon, b.lat as lat2, b.lon as lon2, a.d, b.d as d2 from cum a join cum b on b.way_id = a.way_id and b.i = a.i + 1 join rk r on r.way_id = a.way_id where not r.b),
 ds as (select a.area_id, a.way_id as deck_id, a.i as deck_i, a.lat as s_lat, a.lon as s_lon, b.lat as s_lat2, b.lon as s_lon2 from cum a join cum b on b.way_id = a.way_id and b.i = a.i + 1 join dk on dk.way_id = a.way_id),
 mt as (select *, cos(radians((lat+lat2)/2)) as kx from rs join ds on rs.area_id = ds.area_id and least(lat, lat2) <= greatest(s_lat, s_lat2) and least(s_lat, s_lat2) <= greatest(lat, lat2)
   and least(lon, lon2) <= greatest(s_lon, s_lon2) and least(s_lon, s_lon2) <= greatest(lon, lon2)),
 vec as (select *, (lon2-lon)*kx as rx, lat2-lat as ry, (s_lon2-s_lon)*kx as sx, s_lat2-s_lat as sy, (s_lon-lon)*kx as qx, s_lat-lat as qy from mt),
 tu as (select *, (qx*sy-qy*sx)/nullif(rx*sy-ry*sx, 0) as t, (qx*ry-qy*rx)/nullif(rx*sy-ry*sx, 0) as u from vec)"""


def road_points(spark, sf) -> DataFrame:
    p = ways.prepare(raw_ways(spark, sf)).select("area_id", F.col("id").alias("way_id"), F.posexplode("pts").alias("i", "p")).select("area_id", "way_id", "i", "p.*")
    return profile.cumulative_distance(p, ("area_id", "way_id"))


def deck_points(spark, sf) -> DataFrame:
    d = ways.bridge_ways(raw_ways(spark, sf)).select("area_id", F.col("id").alias("deck_id"), F.posexplode("geometry").alias("i", "p"))
    return d.select("area_id", "deck_id", "i", "p.*")


@query(f"{CROSS} select area_id, way_id, i, deck_id, deck_i, round(d + t*(d2-d), 3) as cut from tu where t > 1e-6 and t < 1 - 1e-6 and u > 1e-6 and u < 1 - 1e-6")
def underpass_cuts(spark, sf):
    cuts = ways.underpass_cuts(road_points(spark, sf), deck_points(spark, sf), ("way_id",), ("area_id",))
    return rounded(cuts, 3, "cut")


@query(
    f"""{CROSS}, {RESAMPLE[len(CUM) + 2 :]}, cuts as (select distinct way_id, d + t*(d2-d) as cut from tu where t > 1e-6 and t < 1 - 1e-6 and u > 1e-6 and u < 1 - 1e-6),
 near as (select distinct r.way_id, r.k from res r join cuts c on c.way_id = r.way_id and abs(r.d - c.cut) <= 40e0)
 select r.way_id, count(*) as n, count(case when rk.b or n.k is not null then 1 end) as n_flagged from res r join rk on rk.way_id = r.way_id left join near n on n.way_id = r.way_id and n.k = r.k group by r.way_id"""
)
def marked_underpasses(spark, sf):
    keys = ("area_id", "way_id")
    pts = road_points(spark, sf)
    cuts = ways.underpass_cuts(ways.sample_gaps(pts, keys), deck_points(spark, sf), ("way_id",), ("area_id",), ("n", "gap"))
    marked = ways.mark_underpasses(pts, cuts, keys)
    return marked.groupBy("way_id").agg(F.count("*").alias("n"), F.sum(F.col("b").cast("long")).alias("n_flagged"))


AREAS = "select s_suppkey as area_id, 35.0e0 + cast(floor((s_suppkey % 10000)/100.0e0) as double)*0.03e0 as lat, -82.0e0 + cast(s_suppkey % 100 as double)*0.03e0 as lon, 2000.4e0 as radius_m from supplier"


# the nearest point of each segment to each centre, on a plane through the centre
@query(
    f"""{BOTH}, ar as ({AREAS}), it as (select way_id from v_way_tags where highway <> 'motorway_link' or bridge = 'yes'),
 sg as (select p.way_id, p.lat, p.lon, coalesce(q.lat, p.lat) as lat2, coalesce(q.lon, p.lon) as lon2 from v_way_pts p left join v_way_pts q on q.way_id = p.way_id and q.i = p.i + 1),
 xy as (select a.area_id, s.way_id, (s.lon - a.lon)*111320e0*cos(radians(a.lat)) as x, (s.lat - a.lat)*111320e0 as y, (s.lon2 - s.lon)*111320e0*cos(radians(a.lat)) as dx, (s.lat2 - s.lat)*111320e0 as dy
   from ar a join sg s on least(s.lat, s.lat2) <= a.lat + 0.03e0 and greatest(s.lat, s.lat2) >= a.lat - 0.03e0 and least(s.lon, s.lon2) <= a.lon + 0.04e0 and greatest(s.lon, s.lon2) >= a.lon - 0.04e0 join it on it.way_id = s.way_id),
 nr as (select *, greatest(0, least(1, coalesce(-(x*dx + y*dy)/nullif(dx*dx + dy*dy, 0), 0))) as t from xy)
 select distinct area_id, way_id from nr where pow(x + t*dx, 2) + pow(y + t*dy, 2) <= 2000e0*2000e0"""
)
def select_ways(spark, sf):
    found = osm.select_ways(raw_ways(spark, sf).drop("area_id"), sql(spark, sf, AREAS))
    return found.select("area_id", F.col("id").alias("way_id"))


EMB = "select vec_id as tile_id, embedding as raster from embeddings"
TILE = f"""{ctes('v_tile_samples')}, q as (select sample_id, tile_id, least(greatest(px-0.5e0, 0), 7) as x, least(greatest(py-0.5e0, 0), 7) as y from v_tile_samples),
 c as (select *, cast(floor(x) as int) as x0, cast(floor(y) as int) as y0, least(cast(floor(x) as int)+1, 7) as x1, least(cast(floor(y) as int)+1, 7) as y1 from q),
 v as (select sample_id, x-x0 as fx, y-y0 as fy, cast(embedding[y0*8+x0+1] as double) as a, cast(embedding[y0*8+x1+1] as double) as b, cast(embedding[y1*8+x0+1] as double) as cc, cast(embedding[y1*8+x1+1] as double) as dd
   from c join embeddings on vec_id = tile_id)
 select sample_id, round((a*(1-fx)+b*fx)*(1-fy)+(cc*(1-fx)+dd*fx)*fy, 7) as elev from v"""


@query(TILE)
def tile_bilinear(spark, sf):
    out = tiles.bilinear_join(view(spark, sf, "v_tile_samples"), sql(spark, sf, EMB), size=8)
    return rounded(out.select("sample_id", "elev"), 7, "elev")


TXY = "floor((lon+180)/360*8192e0) as x, floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*8192e0) as y"


@query(f"{PTS} select distinct 13 as z, cast(x as int) as x, cast(y as int) as y from (select {TXY} from v_way_pts) t")
def needed_tiles(spark, sf):
    return tiles.needed_tiles(view(spark, sf, "v_way_pts"))


@query(f"{PTS} select distinct 13 as z, cast(x as int) as x, cast(y as int) as y from (select {TXY} from v_way_pts) t where (cast(x as int) + cast(y as int)) % 3 <> 0")
def missing_tiles(spark, sf):
    """Needed tiles without a third that are loaded."""
    p = view(spark, sf, "v_way_pts")
    return tiles.needed_tiles(p, tiles.needed_tiles(p).filter((F.col("x") + F.col("y")) % 3 == 0))


def shared_path(spark, name: str) -> str:
    """A new folder that all executors see."""
    import uuid

    from ..operators.graph import checkpointed

    checkpointed(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


RASTERS = "tl as (select distinct cast(x as int) as x, cast(y as int) as y from (select {TXY} from v_way_pts) t where (cast(x as int) + cast(y as int)) % 7 <> 0)".replace("{TXY}", TXY)


def rasters(spark, sf) -> DataFrame:
    """Needed tiles but for every seventh, each with one of the given rasters of eight by eight."""
    need = tiles.needed_tiles(view(spark, sf, "v_way_pts")).filter((F.col("x") + F.col("y")) % 7 != 0)
    return need.withColumn("tile_id", ((F.col("x") * 31 + F.col("y")) % 500).cast("long")).join(sql(spark, sf, EMB), "tile_id").select("z", "x", "y", "raster")


@query(
    f"""{PTS}, {RASTERS}, w as (select way_id, i, {TXY.replace('floor(', '(')} from v_way_pts),
 q as (select way_id, i, cast(floor(x) as int) as tx, cast(floor(y) as int) as ty, least(greatest((x - floor(x))*8 - 0.5e0, 0), 7) as px, least(greatest((y - floor(y))*8 - 0.5e0, 0), 7) as py from w),
 c as (select q.*, r.vec_id, r.embedding as e, cast(floor(px) as int) as x0, cast(floor(py) as int) as y0, least(cast(floor(px) as int) + 1, 7) as x1, least(cast(floor(py) as int) + 1, 7) as y1 from q left join tl on tl.x = tx and tl.y = ty left join embeddings r on r.vec_id = (tl.x*31 + tl.y) % 500)
 select way_id, i, round((cast(e[y0*8+x0+1] as double)*(1-px+x0) + cast(e[y0*8+x1+1] as double)*(px-x0))*(1-py+y0) + (cast(e[y1*8+x0+1] as double)*(1-px+x0) + cast(e[y1*8+x1+1] as double)*(px-x0))*(py-y0), 6) as elev from c"""
)
def stored_elevations(spark, sf):
    """Elevations of points from tiles laid out as a bucketed table; samples alone are shuffled."""
    path = shared_path(spark, "tiles")
    table = "tiles_" + path[-32:]
    tiles.lay_out(rasters(spark, sf), table, path, int(spark.conf.get("spark.sql.shuffle.partitions")), size=8, block=4)
    return rounded(tiles.elevate_stored(view(spark, sf, "v_way_pts"), table, size=8, block=4).select("way_id", "i", "elev"), 6, "elev")


@query(f"{BOTH}, s as (select way_id, count(*) as n_points from v_way_pts group by way_id) select t.way_id, highway, n_points from v_way_tags t join s on s.way_id = t.way_id")
def stored_ways(spark, sf):
    """Ways written as a table and read as a source."""
    path = shared_path(spark, "ways")
    raw_ways(spark, sf).drop("area_id").write.parquet(path)
    return osm.read_ways(spark, path, "parquet").select(F.col("id").alias("way_id"), F.col("tags")["highway"].alias("highway"), F.size("geometry").cast("long").alias("n_points"))


@query(
    f"""{PTS}, q as (select way_id, i, lat + i*0.0000013e0 as lat, lon - i*0.0000017e0 as lon from v_way_pts)
 select way_id, count(*) as n_points, count(case when i % 3 = 1 then 1 end) as n_flagged, round(sum(floor(lat*1e6 + 0.5e0)/1e6), 6) as lats, round(sum(floor(lon*1e6 + 0.5e0)/1e6), 6) as lons from q group by way_id"""
)
def captured_fixture(spark, sf):
    """Roads captured as JSON and read again: sums of their rounded places, flags where they are true."""
    p = view(spark, sf, "v_way_pts").select("way_id", "i", (F.col("lat") + F.col("i") * 0.0000013).alias("lat"), (F.col("lon") - F.col("i") * 0.0000017).alias("lon"), (F.col("i") % 3 == 1).alias("b"))
    roads = p.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon", "b"))).alias("pts"))
    path = shared_path(spark, "fixture")
    osm.write_fixture(roads, ways.bridge_ways(raw_ways(spark, sf)), path)
    got = spark.read.json(f"{path}/roads").select(F.col("id").alias("way_id"), F.explode("pts").alias("p"))
    out = got.groupBy("way_id").agg(F.count("*").alias("n_points"), F.count("p.b").alias("n_flagged"), F.sum("p.lat").alias("lats"), F.sum("p.lon").alias("lons"))
    return rounded(out, 6, "lats", "lons")


@query(
    f"""{BOTH}, n as (select way_id, count(*) as n_points, round(sum(floor(lat*1e6 + 0.5e0)/1e6), 6) as lats from v_way_pts group by way_id having count(*) >= 2)
 select n.way_id, layer, n_points, lats from n join v_way_tags t on t.way_id = n.way_id where bridge = 'yes' and coalesce(try_cast(coalesce(layer, '1') as double), 0) > 0"""
)
def captured_decks(spark, sf):
    decks = osm.capture_decks(ways.bridge_ways(raw_ways(spark, sf)))
    total = F.aggregate("geometry", F.lit(0.0), lambda acc, p: acc + p["lat"])
    return rounded(decks.select(F.col("id").alias("way_id"), F.col("tags")["layer"].alias("layer"), F.size("geometry").cast("long").alias("n_points"), total.alias("lats")), 6, "lats")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, 128*256.0e0 + l_partkey%256 + (l_suppkey%256)/256.0e0 - 32768.0e0 as elev from lineitem")
def terrarium(spark, sf):
    g, b = F.col("l_partkey") % 256, F.col("l_suppkey") % 256
    out = sql(spark, sf, "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem")
    return out.withColumn("elev", geo.terrarium(F.lit(128), g, b))


NOW = "timestamp '1998-01-01 00:00:00'"
FRESH = f"version = 10 and {NOW} - cast(captured_at as timestamp) <= interval 14 day"
KEYS = "keys as (select distinct concat(cast(c_custkey as varchar), ',5000') as search_key from customer)"


def _keys(spark, sf) -> DataFrame:
    return sql(spark, sf, "select concat(cast(c_custkey as string), ',5000') as search_key from customer")


@query(f"{ctes('v_entries')}, {KEYS} select entry_id, search_key from v_entries where {FRESH} and search_key in (select search_key from keys)")
def cache_hits(spark, sf):
    return store.hits(view(spark, sf, "v_entries"), _keys(spark, sf), F.expr(NOW)).select("entry_id", "search_key")


@query(f"{ctes('v_entries')}, {KEYS} select search_key from keys where search_key not in (select search_key from v_entries where {FRESH})")
def cache_misses(spark, sf):
    return store.misses(view(spark, sf, "v_entries"), _keys(spark, sf), F.expr(NOW))


def commits(spark, sf) -> str:
    """A store after three writes, of which the second and the third replace entries, and a purge."""
    path, e = shared_path(spark, "store"), view(spark, sf, "v_entries").select("search_key", "entry_id")
    day = lambda d: F.expr(f"timestamp '1998-01-{d} 00:00:00'")
    store.put_profiles(e.filter("entry_id % 2 = 0"), path, day("01"))
    store.put_profiles(e.filter("entry_id % 4 = 1"), path, day("10"))
    store.put_profiles(e.filter("entry_id % 40 = 3"), path, day("10"), version=9)
    store.purge(spark, path, day("20"))
    return path


BATCHES = f"{ctes('v_entries')}, {KEYS}, b1 as (select * from v_entries where entry_id % 2 = 0), b2 as (select * from v_entries where entry_id % 4 = 1), b3 as (select * from v_entries where entry_id % 40 = 3)"


@query(f"{BATCHES} select entry_id, search_key from b2 where search_key not in (select search_key from b3) and search_key in (select search_key from keys)")
def stored_profiles(spark, sf):
    """What a reader finds: the second write's entries but for those that the third replaced; the first one's are too old."""
    return store.get_profiles(spark, commits(spark, sf), _keys(spark, sf), F.expr("timestamp '1998-01-20 00:00:00'")).select("entry_id", "search_key")


@query(
    f"""{BATCHES} select cast(n as bigint) as commit, count(distinct search_key) as searches, count(*) as n_rows from (
   select 1 as n, search_key from b1 union all select 2, search_key from b2 union all select 2, search_key from b1 where search_key not in (select search_key from b2) union all
   select 3, search_key from b3 union all select 3, search_key from b2 where search_key not in (select search_key from b3) union all select 3, search_key from b1 where search_key not in (select search_key from b2 union select search_key from b3) union all
   select 4, search_key from b2 where search_key not in (select search_key from b3)) t group by n"""
)
def store_commits(spark, sf):
    """Every commit of a store can still be read."""
    path, out = commits(spark, sf), None
    for n in range(1, 5):
        one = store.read_snapshot(spark, path, store.snapshot(spark, path, n)).agg(F.countDistinct("search_key").alias("searches"), F.count("*").alias("n_rows")).select(F.lit(n).cast("long").alias("commit"), "searches", "n_rows")
        out = one if out is None else out.union(one)
    return out


@query(f"{ctes('v_entries')} select count(distinct search_key) as searches, count(*) as n_rows from v_entries")
def store_stats(spark, sf):
    return store.store_stats(view(spark, sf, "v_entries"))


LATLON = "'^(-?[0-9]+(?:\\.[0-9]+)?)[ \\t]*,[ \\t]*(-?[0-9]+(?:\\.[0-9]+)?)$'"
PARSED = f"""{ctes('v_labels')}, ps as (select c_custkey, place, try_cast(regexp_extract(trim(place), {LATLON}, 1) as double) as la, try_cast(regexp_extract(trim(place), {LATLON}, 2) as double) as lo from v_labels),
 pp as (select c_custkey, place, case when abs(la) <= 90 and abs(lo) <= 180 then la end as lat, case when abs(la) <= 90 and abs(lo) <= 180 then lo end as lon from ps)"""


@query(f"{PARSED} select c_custkey, lat, lon from pp")
def parse_lat_lon(spark, sf):
    return view(spark, sf, "v_labels").select("c_custkey", text.parse_lat_lon(F.col("place")).alias("p")).select("c_custkey", "p.lat", "p.lon")


GAZ = "select n_name as place, 35.0e0 + n_nationkey as lat, -82.0e0 + n_nationkey as lon, n_name as label, case when n_nationkey % 4 = 0 then date '1997-01-01' else date '1997-12-20' end as captured_at, n_nationkey as seq from nation"


@query(
    f"""{PARSED}, gz as (select lower(place) as key, lat, lon from ({GAZ}) g where {NOW} - cast(captured_at as timestamp) < interval 30 day)
 select p.c_custkey, coalesce(p.lat, g.lat) as lat, coalesce(p.lon, g.lon) as lon, coalesce(p.lat, g.lat) is not null as found
 from pp p left join gz g on g.key = trim(regexp_replace(lower(p.place), '\\s+', ' ', 'g'))"""
)
def geocode_lookup(spark, sf):
    q = view(spark, sf, "v_labels").select("c_custkey", F.col("place").alias("query"))
    return store.geocode_lookup(q, sql(spark, sf, GAZ), F.expr(NOW)).select("c_custkey", "lat", "lon", "found")


@query("select s_suppkey, printf('%.3f,%.3f,%d', 35.0e0 + s_suppkey/7.0e0 % 40, -82.0e0 - s_suppkey/11.0e0 % 40, cast(floor(1000 + s_suppkey*1.3e0 + 0.5e0) as bigint)) as search_key from supplier")
def search_key(spark, sf):
    s = sql(spark, sf, "select s_suppkey from supplier")
    k = F.col("s_suppkey")
    return s.select("s_suppkey", text.search_key(35.0 + (k / 7.0) % 40, -82.0 - (k / 11.0) % 40, 1000 + k * 1.3).alias("search_key"))
