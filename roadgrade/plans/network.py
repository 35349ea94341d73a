"""Queries over connected roads: junctions, and inclines over two roads with their slices and their own samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, ranking
from .rank import HAV, SPAN, inclines_sql, rounded
from .views import ctes, view

QUERIES: dict = {}
AREA = ("area_id",)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def network(spark, sf) -> DataFrame:
    return view(spark, sf, "v_network")


# jn: of each end (fin) of a road the nearest sample of each other road within 20 m
JUNCTIONS = """pl as (select v.*, lon*111320.0e0*cos(radians(lat0)) as x, lat*111320.0e0 as y, max(k) over (partition by road_id) as last
   from v_network v join (select area_id, arg_min(lat, (road_id, k)) as lat0 from v_network group by area_id) z on z.area_id = v.area_id),
 en as (select *, case when k = 0 then 0 else 1 end as fin from pl where k = 0 or k = last),
 jn as (select * from (select e.area_id, e.road_id, e.fin, o.road_id as other_id, o.k as other_k, o.last as other_last, sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2)) as dist,
   row_number() over (partition by e.road_id, e.fin, o.road_id order by pow(o.x - e.x, 2) + pow(o.y - e.y, 2), o.k) as rn
  from en e join pl o on o.area_id = e.area_id and o.road_id <> e.road_id and pow(o.x - e.x, 2) + pow(o.y - e.y, 2) <= 400) t where rn = 1)"""


@query(f"{ctes('v_network')}, {JUNCTIONS} select area_id, road_id, fin, other_id, other_k, round(dist, 6) as dist from jn")
def network_junctions(spark, sf):
    """The nearest sample of the other road, where two of its samples are within reach."""
    return rounded(graph.endpoint_junctions(network(spark, sf), AREA).withColumnRenamed("end", "fin"), 6, "dist")


# ch: chains of one and two roads; cm: their samples; q_in: inclines of each chain; sl: slices; cd: one candidate for each set of
# slices; wk: the walk from the longest on, with the slices of those kept
PATHS = f"""{ctes('v_network').replace('with ', 'with recursive ', 1)}, {JUNCTIONS},
 st as (select area_id, road_id, 0 as a, last as b, 1 as fin from pl where k = 0 and last > 0 union all select area_id, road_id, last, 0, 0 from pl where k = 0 and last > 0),
 tw as (select s.area_id, s.road_id as r1, s.a as a1, s.b as b1, j.other_id as r2, j.other_k as a2, w.b2 from st s join jn j on j.road_id = s.road_id and j.fin = s.fin, lateral (select unnest([0, j.other_last]) as b2) w where w.b2 <> j.other_k),
 ch as (select *, row_number() over (order by chain) as id from (
   select area_id, road_id as r1, a as a1, b as b1, null as r2, null as a2, null as b2, format('[{{{{"road_id":{{}},"from":{{}},"to":{{}}}}}}]', road_id, a, b) as chain from st union all
   select area_id, r1, a1, b1, r2, a2, b2, format('[{{{{"road_id":{{}},"from":{{}},"to":{{}}}}}},{{{{"road_id":{{}},"from":{{}},"to":{{}}}}}}]', r1, a1, b1, r2, a2, b2) from tw) t),
 pa as (select id, 0 as part, r1 as r, a1 as a, b1 as b from ch union all select id, 1, r2, a2, b2 from ch where r2 is not null),
 cs as (select p.id as road_id, v.road_id as src, v.k as src_k, v.lat, v.lon, v.elev, cast(row_number() over (partition by p.id order by p.part, abs(v.k - p.a)) - 1 as int) as k from pa p join v_network v on v.road_id = p.r and v.k between least(p.a, p.b) and greatest(p.a, p.b)),
 cm as (select b.*, sum(case when a.k is null then 0 else {HAV} end) over (partition by b.road_id order by b.k) as d from cs b left join cs a on a.road_id = b.road_id and a.k = b.k - 1),
 {inclines_sql('cm')},
 sl as (select q.road_id as id, q.n, c.src, min(c.src_k) as low, max(c.src_k) as high, min(c.lat) - 0.0005e0 as y0, max(c.lat) + 0.0005e0 as y1, min(c.lon) - 0.0005e0 as x0, max(c.lon) + 0.0005e0 as x1, min(c.k) as o
   from q_in q join cm c on c.road_id = q.road_id and c.k between q.i and q.j group by q.road_id, q.n, c.src),
 nm as (select distinct road_id, name, unnamed from v_network),
 ls as (select id, n, list({{'r': src, 'name': case when unnamed then null else name end, 'low': low, 'high': high, 'y0': y0, 'y1': y1, 'x0': x0, 'x1': x1}} order by src) as s, array_to_string(list_distinct(list(name order by o)), ' + ') as any_names, list(name order by o) as all_names from sl join nm on nm.road_id = sl.src group by id, n),
 ca as (select ch.area_id, l.*, q.i, q.j, q.span, q.gain, q.grade, ch.chain || '#' || printf('%03d', q.n) as seq from ls l join ch on ch.id = l.id join q_in q on q.road_id = l.id and q.n = l.n),
 cd as (select *, row_number() over (partition by area_id order by span desc, seq) as pos from (select *, row_number() over (partition by area_id, list_transform(s, lambda x: (x.r, x.low, x.high)) order by span desc, seq) as rn from ca) t where rn = 1),
 wk as (select area_id, cast(0 as bigint) as pos, (select s from cd limit 0) as kept, false as stays from (select distinct area_id from cd) t
  union all select w.area_id, c.pos, case when x.free then list_concat(coalesce(w.kept, []), c.s) else w.kept end, x.free from wk w join cd c on c.area_id = w.area_id and c.pos = w.pos + 1,
   lateral (select len(list_filter(coalesce(w.kept, []), lambda o: len(list_filter(c.s, lambda y: (o.r = y.r and greatest(o.low, y.low) < least(o.high, y.high))
     or (o.r <> y.r and coalesce(o.name = y.name, false) and o.y0 <= y.y1 and y.y0 <= o.y1 and o.x0 <= y.x1 and y.x0 <= o.x1))) > 0)) = 0 as free) x),
 kp as (select c.*, row_number() over (partition by c.area_id order by span desc, seq) as rank from cd c join wk w on w.area_id = c.area_id and w.pos = c.pos where w.stays)"""


def found(spark, sf) -> DataFrame:
    s = network(spark, sf)
    return graph.longest_incline_paths(s, s.filter("k = 0").select("area_id", "road_id", "name", "unnamed"), SPAN, 2, AREA)


@query(f"{PATHS} select area_id, cast(rank as int) as rank, case when len(all_names) = 1 or all_names[1] = all_names[2] then all_names[1] else array_to_string(list_sort(all_names), ' + ') end as names, cast(len(s) as int) as n_roads, round(span, 6) as span, round(gain, 6) as gain, round(grade, 6) as grade from kp")
def incline_networks(spark, sf):
    """Inclines over up to two connected roads, ranked; names in the order of the alphabet, as both directions count alike."""
    out = ranking.rank_inclines(found(spark, sf), 2**31 - 1)
    names = F.array_join(F.array_sort(F.split("names", " \\+ ")), " + ")
    return rounded(out.select("area_id", "rank", names.alias("names"), "n_roads", "span", "gain", "grade"), 6, "span", "gain", "grade")


@query(f"{PATHS} select area_id, cast(rank as int) as rank, x.r as road_id, x.low, x.high from (select area_id, rank, unnest(s) as x from kp) t")
def network_slices(spark, sf):
    """The slices of each ranked incline, as ranges of samples of their roads."""
    s = ranking.incline_slices(ranking.rank_inclines(found(spark, sf), 2**31 - 1))
    return s.select("area_id", "rank", "road_id", F.least("from", "to").alias("low"), F.greatest("from", "to").alias("high"))


@query(
    f"""{PATHS}, vr as (select p.area_id, c.*, c.d - min(c.d) over w as d1, max(c.d) over w - c.d as d2, c.k - p.i as k1, p.j - c.k as k2, c.k < p.j as on1, c.k > p.i as on2, first_value(c.elev) over (partition by p.id, p.n order by c.k) <= last_value(c.elev) over (partition by p.id, p.n order by c.k rows between unbounded preceding and unbounded following) as up,
   p.id as pid, p.n as pn from kp p join cm c on c.road_id = p.id and c.k between p.i and p.j window w as (partition by p.id, p.n)),
 s0 as (select pid, pn, max(case when (up and k1 = 0) or (not up and k2 = 0) then printf('incline:%.5f,%.5f', lat, lon) end) as road_id from vr group by pid, pn)
 select v.area_id, s0.road_id, cast(case when up then k1 else k2 end as int) as k, round(case when up then d1 else d2 end, 6) as d, round(elev, 6) as elev, round(lat, 9) as lat, round(lon, 9) as lon, case when up then on1 else on2 end as on_incline from vr v join s0 on s0.pid = v.pid and s0.pn = v.pn"""
)
def virtual_road_samples(spark, sf):
    """Each incline's own samples, counted from its lower end, and its mask."""
    virtual = graph.incline_virtual_road(found(spark, sf), AREA)
    s = graph.virtual_samples(virtual, network(spark, sf), AREA)
    ends = s.groupBy("area_id", "road_id").agg(F.max("d").alias("total"), F.max("k").alias("last"), (F.min_by("elev", "k") <= F.max_by("elev", "k")).alias("up"))
    s = s.join(ends, ["area_id", "road_id"])
    k, d = F.when(F.col("up"), F.col("k")).otherwise(F.col("last") - F.col("k")), F.when(F.col("up"), F.col("d")).otherwise(F.col("total") - F.col("d"))
    # walked the other way, the segment that begins at a sample is the one that ended there
    on = F.when(F.col("up"), F.col("on_incline")).otherwise(F.col("k") > 0)
    return rounded(rounded(s.select("area_id", "road_id", k.alias("k"), d.alias("d"), "elev", "lat", "lon", on.alias("on_incline")), 6, "d", "elev"), 9, "lat", "lon")
