"""Queries for what is shown and exported: boxes, colours, curvy roads, labels, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import graph, paint, profile, ranking
from ..params import RAMPS, clean_params
from ..sources import store
from .build import CUM, HAV, PTS, RESAMPLE
from .rank import BEST, EXT, LAID, P, PATHS, RP, SPAN, UPDOWN, VALUE, WIN, WINDOW, arrays, climbs_sql, extents, found_inclines, inclines_sql, placed, prof, rounded, warm_runs, win_sql
from .views import ctes, sql, view

QUERIES: dict = {}


def query(text_: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, text_)
        return f

    return add


@query(
    f"""{PTS}
 select p.way_id, 0 as n, round(min(lat) - 0.0005e0, 6) as lat_min, round(max(lat) + 0.0005e0, 6) as lat_max, round(min(lon) - 0.0005e0, 6) as lon_min, round(max(lon) + 0.0005e0, 6) as lon_max
 from v_way_pts p group by p.way_id"""
)
def bbox(spark, sf):
    p = view(spark, sf, "v_way_pts").withColumnRenamed("i", "k")
    ext = p.groupBy("way_id").agg(F.lit(0).alias("n"), F.min("k").alias("i"), F.max("k").alias("j"))
    return rounded(ranking.bbox(p, ext, ("way_id",)), 6, "lat_min", "lat_max", "lon_min", "lon_max")


PAINT = f"""{EXT}, sg as (select road_id, k, (elev2-elev)/(d2-d) as g from (select *, lead(d) over w as d2, lead(elev) over w as elev2 from v_profile window w as (partition by road_id order by k)) t where d2 is not null),
 pt as (select s.road_id, s.k, min(e.n) as n, greatest(case when abs(max(s.g)) >= 0.03e0 then abs(max(s.g)) else 0 end, case when min(e.n) is not null then 0.03e0 else 0 end) as paint
  from sg s left join ext e on e.road_id = s.road_id and e.i <= s.k and s.k < e.j group by s.road_id, s.k)"""


@query(f"{PAINT} select road_id, k, n, round(paint, 9) as paint from pt")
def paint_floor(spark, sf):
    return rounded(paint.paint_floor(prof(spark, sf), extents(spark, sf)), 9, "paint")


@query(
    f"""{PAINT}, bn as (select *, case when paint > 0 then cast(least(22, floor((paint-0.03e0)/(0.22e0/22) + 0.5e0)) as int) end as bin, coalesce(n, -1) as e from pt),
 ch as (select *, k - row_number() over (partition by road_id, bin, e order by k) as g from bn where bin is not null)
 select road_id, min(k) as i, max(k) + 1 as j, bin, e >= 0 as prominent, round(max(paint), 9) as paint from ch group by road_id, bin, e, g"""
)
def color_chunks(spark, sf):
    return rounded(paint.color_chunks(paint.paint_floor(prof(spark, sf), extents(spark, sf))), 9, "paint")


MERGED = f"""{EXT}, la as (select road_id, max(k) as last from v_profile group by road_id), pd as (select e.road_id, greatest(i-2, 0) as i, least(j+2, last) as j from ext e join la on la.road_id = e.road_id),
 nw as (select *, case when i > max(j) over (partition by road_id order by i, j rows between unbounded preceding and 1 preceding) then 1 else 0 end as nw from pd),
 gp as (select *, sum(nw) over (partition by road_id order by i, j rows between unbounded preceding and current row) as g from nw)"""


@query(f"{MERGED} select road_id, min(i) as i, max(j) as j from gp group by road_id, g")
def merge_extents(spark, sf):
    last = prof(spark, sf).groupBy("road_id").agg(F.max("k").alias("last"))
    return paint.merge_extents(warm_runs(spark, sf), last)


@query(
    f"""{EXT}, rn as (select road_id, i, j, n as run from ext) select r.road_id, r.i, r.j, p.k, round(min(elev) over (partition by r.road_id, r.run), 6) as base,
 round(3.0e0 + least(0.14e0*(elev - min(elev) over (partition by r.road_id, r.run)), 11.0e0), 6) as width from rn r join v_profile p on p.road_id = r.road_id and p.k between r.i and r.j"""
)
def run_base_altitude(spark, sf):
    out = paint.run_base_altitude(warm_runs(spark, sf), prof(spark, sf))
    return rounded(out.select("road_id", "i", "j", "k", "base", "width"), 6, "base", "width")


@query(
    f"""{EXT}, sg as (select road_id, k, (elev2-elev)/(d2-d) as g from (select *, lead(d) over w as d2, lead(elev) over w as elev2 from v_profile window w as (partition by road_id order by k)) t where d2 is not null),
 ed as (select x.road_id, x.n, x.i, x.j, case when b.elev >= a.elev then 1 else -1 end as dir from ext x join v_profile a on a.road_id = x.road_id and a.k = x.i join v_profile b on b.road_id = x.road_id and b.k = x.j)
 select s.road_id, s.k, round(coalesce(e.dir*s.g, abs(s.g)), 9) as signed from sg s left join ed e on e.road_id = s.road_id and e.i <= s.k and s.k < e.j"""
)
def signed_grade(spark, sf):
    p, e = prof(spark, sf), extents(spark, sf)
    at = lambda c: p.select("road_id", F.col("k").alias(c), F.col("elev").alias(f"e_{c}"))
    e = e.join(at("i"), ["road_id", "i"]).join(at("j"), ["road_id", "j"]).withColumn("dir", F.when(F.col("e_j") >= F.col("e_i"), 1).otherwise(-1))
    return rounded(paint.signed_grade(p, e), 9, "signed")


@query(
    f"""{EXT}, mk as (select distinct road_id, k from val where value >= 0.06e0), il as (select road_id, min(k) as i, max(k)+1 as j from (select *, k - row_number() over (partition by road_id order by k) as g from mk) t group by road_id, g)
 select l.road_id, l.i, l.j, b.d - a.d as span, round(abs(b.elev-a.elev), 6) as gain, round(abs(b.elev-a.elev)/(b.d-a.d), 9) as grade from il l join v_profile a on a.road_id = l.road_id and a.k = l.i join v_profile b on b.road_id = l.road_id and b.k = l.j"""
)
def incline_runs_stats(spark, sf):
    p = prof(spark, sf)
    mask = ranking.segment_sustained(p, WINDOW).filter("value >= 0.06")
    return rounded(rounded(paint.incline_runs_stats(p, mask), 6, "gain"), 9, "grade")


@query(
    f"""{WIN}, {VALUE}, {BEST}, sg as (select a.road_id, max(abs(b.elev-a.elev)/(b.d-a.d)) as fine from v_profile a join v_profile b on a.road_id = b.road_id and b.k = a.k + 1 group by a.road_id)
 select s.road_id, round(b.grade, 9) as value, round(fine, 9) as fine, coalesce(b.grade >= 0.1e0, false) as listed from sg s left join best b on b.road_id = s.road_id where coalesce(b.grade >= 0.1e0, false) or fine >= 0.03e0"""
)
def drawn_roads(spark, sf):
    p = prof(spark, sf)
    value = ranking.sustained_grade(p, WINDOW)
    return rounded(paint.drawn_roads(p, value.filter("value >= 0.1"), value), 9, "value", "fine")


@query(
    f"""{WIN}, {BEST}, {UPDOWN}, {climbs_sql()}, li as (select road_id, max(score) as score from cl group by road_id)
 select b.road_id, round(b.grade, 9) as value, round(l.score, 6) as score from best b join li l on l.road_id = b.road_id"""
)
def drawn_climbs(spark, sf):
    value = ranking.sustained_grade(prof(spark, sf), WINDOW)
    return rounded(rounded(paint.drawn_climb_roads(value, ranking.hardest_climbs(arrays(spark, sf))), 9, "value"), 6, "score")


LISTED = 40


@query(
    f"""{RP}, {win_sql(600.0)}, {inclines_sql('v_profile')}, va as (select road_id, max(grade) as value from win group by road_id),
 li as (select road_id from q_in order by span desc, road_id, n limit {LISTED})
 select coalesce(v.road_id, l.road_id) as road_id, round(v.value, 9) as value, l.road_id is not null as listed from va v full join (select distinct road_id from li) l on l.road_id = v.road_id"""
)
def drawn_inclines(spark, sf):
    """A window longer than some roads: they are drawn if one of the longest inclines runs over them."""
    value = ranking.sustained_grade(prof(spark, sf), 600.0)
    listed = ranking.top(ranking.longest_inclines(arrays(spark, sf), SPAN), LISTED, F.desc("span"), F.col("road_id"), F.col("n"))
    return rounded(paint.drawn_incline_roads(value, listed), 9, "value")


CURVES = f"""{PTS}, {CUM}, nx as (select *, lead(lat) over w as lat2, lead(lon) over w as lon2 from cum window w as (partition by way_id order by i)),
 bg as (select way_id, i, d, atan2(sin(radians(lon2-lon))*cos(radians(lat2)), cos(radians(lat))*sin(radians(lat2))-sin(radians(lat))*cos(radians(lat2))*cos(radians(lon2-lon))) as b from nx),
 df as (select *, abs(b - lag(b) over (partition by way_id order by i)) as x from bg),
 tr as (select way_id, i, d, coalesce(case when x > pi() then 2*pi() - x else x end, 0) as turn from df),
 cm as (select *, sum(turn) over (partition by way_id order by i rows between unbounded preceding and current row) as turns from tr),
 pv as (select *, coalesce(lag(turns) over (partition by way_id order by i), 0) as before from cm),
 far as (select a.way_id, a.i, max(b.d) as d1 from pv a join pv b on a.way_id = b.way_id and b.d <= a.d - 100.0e0 group by a.way_id, a.i),
 st as (select f.way_id, f.i, f.d1, max(p.turns) as t1 from far f join pv p on p.way_id = f.way_id and p.d = f.d1 group by f.way_id, f.i, f.d1),
 per as (select p.way_id, max((p.before - s.t1)/(p.d - s.d1)) as most from pv p join st s on s.way_id = p.way_id and s.i = p.i group by p.way_id),
 who as (select way_id, sum(turn)/nullif(max(d), 0) as whole from tr group by way_id)
 select w.way_id, round(coalesce(most, whole, 0), 7) as curviness, coalesce(most, whole, 0) > 0.025e0 as curvy from who w left join per on per.way_id = w.way_id"""


@query(CURVES)
def curviness(spark, sf):
    p = profile.cumulative_distance(view(spark, sf, "v_way_pts"))
    return rounded(paint.curviness(p), 7, "curviness")


@query(
    f"""{PTS}, {RESAMPLE}, gp as (select r.*, lead(d) over w as d2, lead(lat) over w as lat2, lead(lon) over w as lon2 from res r window w as (partition by way_id order by k)),
 bt as (select a.* from gp a where d2 is not null and (d2 - d) > 1.02e0*{HAV.format(a='a', b='a').replace('a.lat-a.lat', 'a.lat2-a.lat').replace('cos(radians(a.lat))*cos(radians(a.lat))', 'cos(radians(a.lat))*cos(radians(a.lat2))').replace('a.lon-a.lon', 'a.lon2-a.lon')}),
 inn as (select b.way_id, b.k, (c.d-b.d)/(b.d2-b.d) as f, c.lat, c.lon from bt b join cum c on c.way_id = b.way_id and c.d > b.d and c.d < b.d2)
 select way_id, k, round(f, 6) as f, round(lat, 9) as lat, round(lon, 9) as lon from (select way_id, k, 0.0e0 as f, lat, lon from res union all select * from inn) t"""
)
def densify(spark, sf):
    return rounded(rounded(paint.densify_path(view(spark, sf, "v_way_pts"), ("way_id",)), 6, "f"), 9, "lat", "lon")


JUNCTIONS = f"""{ctes('v_way_pts')}, l0 as (select area_id, lat as lat0 from (select *, row_number() over (partition by area_id order by way_id, i) as rn from v_way_pts) t where rn = 1),
 xy as (select p.area_id, way_id, i, lon*111320.0e0*cos(radians(lat0)) as x, lat*111320.0e0 as y, max(i) over (partition by way_id) as last from v_way_pts p join l0 on l0.area_id = p.area_id),
 en as (select area_id, way_id, 0 as e, x, y from xy where i = 0 union all select area_id, way_id, 1, x, y from xy where i = last),
 nr as (select e.area_id, e.way_id as road_id, e.e as "end", o.way_id as other_id, o.i as other_k, sqrt((o.x-e.x)*(o.x-e.x)+(o.y-e.y)*(o.y-e.y)) as dist from en e join xy o on o.area_id = e.area_id and o.way_id <> e.way_id
   and abs(o.x-e.x) <= 20e0 and abs(o.y-e.y) <= 20e0)
 select area_id, road_id, "end", other_id, min(other_k) as other_k, round(min(dist), 3) as dist from nr where dist <= 20e0 group by all"""


@query(JUNCTIONS)
def junction_edges(spark, sf):
    s = view(spark, sf, "v_way_pts").select("area_id", F.col("way_id").alias("road_id"), F.col("i").alias("k"), "lat", "lon")
    return rounded(graph.endpoint_junctions(s, ("area_id",)), 3, "dist")


NEAREST = f"""{PTS}, cp as (select way_id, avg(lat) + 0.0003e0 as lat, avg(lon) + 0.0002e0 as lon from v_way_pts group by way_id),
 sg as (select way_id, i, lat as alat, lon as alon, lead(lat) over w as blat, lead(lon) over w as blon from v_way_pts window w as (partition by way_id order by i)),
 vc as (select c.way_id, s.i, (blon-alon)*cos(radians(lat)) as dx, blat-alat as dy, (lon-alon)*cos(radians(lat)) as qx, lat-alat as qy from cp c join sg s on s.way_id = c.way_id where blat is not null),
 pr as (select *, least(greatest(coalesce((qx*dx+qy*dy)/nullif(dx*dx+dy*dy, 0), 0), 0), 1) as t from vc)
 select way_id, round(min(sqrt((qx-t*dx)*(qx-t*dx)+(qy-t*dy)*(qy-t*dy))), 9) as dist from pr group by way_id"""


@query(NEAREST)
def nearest_segment(spark, sf):
    p = view(spark, sf, "v_way_pts").withColumnRenamed("i", "k")
    clicks = p.groupBy("way_id").agg((F.avg("lat") + 0.0003).alias("lat"), (F.avg("lon") + 0.0002).alias("lon")).withColumn("point_id", F.lit(0))
    return rounded(paint.nearest_segment(clicks, p, ("way_id",)).select("way_id", "dist"), 9, "dist")


CLICKS = "select c_custkey as point_id, 35.0e0 + cast(floor((c_custkey % 10000)/100.0e0) as double)*0.03e0 + cast(c_custkey % 17 as double)*0.00271e0 - 0.0132e0 as lat, -82.0e0 + cast(c_custkey % 100 as double)*0.03e0 + cast(c_custkey % 13 as double)*0.00317e0 - 0.0129e0 as lon from customer"


@query(
    f"""{PTS}, cl as ({CLICKS}), sg as (select way_id, i, lat as alat, lon as alon, lead(lat) over w as blat, lead(lon) over w as blon from v_way_pts window w as (partition by way_id order by i)),
 vc as (select c.point_id, s.way_id, s.i, (blon-alon)*cos(radians(lat)) as dx, blat-alat as dy, (lon-alon)*cos(radians(lat)) as qx, lat-alat as qy from cl c, sg s where blat is not null),
 ds as (select point_id, way_id, i, round(sqrt(pow(qx - t*dx, 2) + pow(qy - t*dy, 2)), 12) as dist from (select *, least(greatest(coalesce((qx*dx+qy*dy)/nullif(dx*dx+dy*dy, 0), 0), 0), 1) as t from vc) x)
 select point_id, m[2] as way_id, cast(m[3] as int) as k, round(m[1], 9) as dist from (select point_id, min((dist, way_id, i)) as m from ds group by point_id) t"""
)
def nearest_on_any_road(spark, sf):
    """Points on roads, beside them and far from all."""
    p = view(spark, sf, "v_way_pts").withColumnRenamed("i", "k")
    return rounded(paint.nearest_on_any_road(sql(spark, sf, CLICKS), p, ("way_id",)), 9, "dist")


SHORT = f"""{ctes('v_labels')}, pa as (select c_custkey, unnest(string_split(label, ',')) as part, generate_subscripts(string_split(label, ','), 1) as i from v_labels)
 select c_custkey, string_agg(case when i = 1 then trim(part) when trim(part) in ('United States', 'United States of America') then 'US' when trim(part) = 'North Carolina' then 'NC' when trim(part) = 'Vermont' then 'VT' else trim(part) end, ', ' order by i) as label
 from pa where i = 1 or not regexp_matches(trim(part), '\\b(County|Parish|Borough|Census Area|Municipality)\\b') group by c_custkey"""


@query(SHORT)
def short_label(spark, sf):
    return view(spark, sf, "v_labels").select("c_custkey", text.short_label(F.col("label")).alias("label"))


@query(
    f"{ctes('v_labels')} select c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(street, '\\bStreet\\b', 'St', 'g'), '\\bAvenue\\b', 'Ave', 'g'), '\\bExtension\\b', 'Ext', 'g'), '\\bRoad\\b', 'Rd', 'g') as street from v_labels"
)
def abbrev(spark, sf):
    return view(spark, sf, "v_labels").select("c_custkey", text.abbrev_name(F.col("street")).alias("street"))


@query(f"{ctes('v_labels')} select c_custkey, concat('roads-sustained-250m-', regexp_replace(lower(split_part(label, ',', 1)), '[^a-z0-9]+', '-', 'g'), '.csv') as file from v_labels")
def export_names(spark, sf):
    return view(spark, sf, "v_labels").select("c_custkey", text.export_name(F.lit("sustained"), F.lit(249.7), F.col("label")).alias("file"))


def _ends_sql(low: str, high: str) -> str:
    """The columns of a slope's two ends; low and high: aliases of laid."""
    return ", ".join(f"printf('%.6f', {x}.lat), printf('%.6f', {x}.lon), printf('%.3f', round({x}.elev, 7))" for x in (low, high))


@query(
    f"""{P}, {UPDOWN}, {climbs_sql()}, {LAID}, rk as (select *, row_number() over (order by score desc, road_id, n) as rank from cl)
 select cast(rank as int) as rank, concat_ws(',', cast(rank as varchar), printf('Road %d', r.road_id), printf('%.3f', round(score, 7)), printf('%.3f', round(gain/span*100, 7)), printf('%.3f', round(gain, 7)), printf('%.3f', span), {_ends_sql('a', 'z')}) as line
 from rk r join laid a on a.road_id = r.road_id and a.k = case when dir > 0 then i else j end join laid z on z.road_id = r.road_id and z.k = case when dir > 0 then j else i end where rank <= 15"""
)
def csv_climbs(spark, sf):
    top = ranking.top(ranking.hardest_climbs(arrays(spark, sf)), 15, F.desc("score"), F.col("road_id"), F.col("n"))
    up = F.col("dir") > 0
    top = top.withColumns({"a": F.when(up, F.col("i")).otherwise(F.col("j")), "z": F.when(up, F.col("j")).otherwise(F.col("i"))})
    at = lambda c, e: placed(spark, sf).select("road_id", F.col("k").alias(c), *[F.round(x, 7 if x == "elev" else 12).alias(f"{e}_{x}{'_m' if x == 'elev' else ''}") for x in ("lat", "lon", "elev")])
    r = top.join(at("a", "start"), ["road_id", "a"]).join(at("z", "end"), ["road_id", "z"])
    return store.csv_rows(r.withColumns({"name": F.format_string("Road %d", "road_id"), "score": F.round("score", 7), "grade_pct": F.round(F.col("grade") * 100, 7), "gain_m": F.round("gain", 7), "length_m": F.col("span")}), "climb")


@query(
    f"""{PATHS}, rk as materialized (select *, row_number() over (order by span desc, area_id, seq) as rank from kp), la as materialized (select * from laid),
 tw as (select rank, r.name, span, grade, gain, list({{'lat': l.lat, 'lon': l.lon, 'elev': l.elev}} order by l.elev, l.k) as e from rk r join la l on l.road_id = r.road_id where l.k in (r.i, r.j) and rank <= 15 group by all)
 select cast(rank as int) as rank, concat_ws(',', cast(rank as varchar), name, '1', printf('%.3f', round(span, 5)), printf('%.3f', round(grade*100, 7)), printf('%.3f', round(gain, 7)), {_ends_sql("e[1]", "e[2]")}) as line from tw"""
)
def csv_inclines(spark, sf):
    top = ranking.top(found_inclines(spark, sf), 15, F.desc("span"), F.col("area_id"), F.col("seq"))
    ends = {f"{e}_{x}{'_m' if x == 'elev' else ''}": F.round(F.col(f"{e}.{x}"), 7 if x == "elev" else 12) for e in ("start", "end") for x in ("lat", "lon", "elev")}
    r = top.withColumns({**ends, "name": F.col("names"), "roads": F.col("n_roads"), "length_m": F.round("span", 5), "grade_pct": F.round(F.col("grade") * 100, 7), "gain_m": F.round("gain", 7)})
    return store.csv_rows(r, "incline")


def _pct_sql(g: str) -> str:
    return f"printf('%.1f%%', case when abs({g}) < 0.0005e0 then 0.0e0 else {g}*100 end)"


@query(
    f"""{P}, {UPDOWN}, {climbs_sql()} select road_id, n, concat(printf('↑%dm/%dm ≈ ', cast(floor(round(gain, 7) + 0.5e0) as bigint), cast(floor(span + 0.5e0) as bigint)), {_pct_sql('round(gain/span, 8)')}) as climb,
 concat(printf('↑%dm ≈ ', cast(floor(round(gain, 7) + 0.5e0) as bigint)), {_pct_sql('round(gain/span, 8)')}) as incline from cl"""
)
def slope_labels(spark, sf):
    c = ranking.hardest_climbs(arrays(spark, sf))
    gain, grade = F.round("gain", 7), F.round("grade", 8)
    return c.select("road_id", "n", text.fmt_climb(gain, F.col("span"), grade).alias("climb"), text.fmt_incline(gain, grade).alias("incline"))


@query(
    f"""{WIN}, {BEST}, t as (select b.*, row_number() over (order by grade desc, road_id) as rank from best b)
 select t.rank, concat_ws(',', cast(t.rank as varchar), case when t.road_id % 2 = 0 then concat('"Road ', cast(t.road_id as varchar), ', "" north"') else concat('Road ', cast(t.road_id as varchar)) end,
   printf('%.3f', round(grade*100, 7)), '250', printf('%.3f', l.d), printf('%.6f', 35.0e0), printf('%.6f', -82.0e0), printf('%.3f', round(a.elev, 7)), printf('%.6f', 35.0e0), printf('%.6f', -82.0e0), printf('%.3f', round(z.elev, 7))) as line
 from t join v_profile a on a.road_id = t.road_id and a.k = t.i join v_profile z on z.road_id = t.road_id and z.k = t.j join (select road_id, max(d) as d from v_profile group by road_id) l on l.road_id = t.road_id where rank <= 15"""
)
def csv_rows(spark, sf):
    p = prof(spark, sf)
    best = ranking.top(ranking.best_window(p, WINDOW), 15, F.desc("grade"), F.col("road_id"))
    at = lambda c, e: p.select("road_id", F.col("k").alias(c), F.round("elev", 7).alias(e))
    r = best.join(at("i", "start_elev_m"), ["road_id", "i"]).join(at("j", "end_elev_m"), ["road_id", "j"]).join(profile.profile_stats(p).select("road_id", F.col("length").alias("road_length_m")), "road_id")
    name = F.when(F.col("road_id") % 2 == 0, F.format_string('Road %d, " north', "road_id")).otherwise(F.format_string("Road %d", "road_id"))
    place = {f"{a}_{b}": F.lit(v) for a in ("start", "end") for b, v in (("lat", 35.0), ("lon", -82.0))}
    r = r.withColumns({"name": name, "grade_pct": F.round(F.col("grade") * 100, 7), "window_m": F.lit(WINDOW), **place})
    return store.csv_rows(r, "sustained")


@query(
    f"""{WIN}, {BEST} select road_id, printf('%.1f%%', case when abs(grade) < 0.0005e0 then 0 else round(grade*100, 6) end) as pct,
  case when span*9.1e0 >= 1000 then printf('%.1f km', round(span*9.1e0/1000, 6)) else printf('%d m', cast(floor(span*9.1e0+0.5e0) as bigint)) end as len from best"""
)
def labels(spark, sf):
    b = ranking.best_window(prof(spark, sf), WINDOW)
    return b.select("road_id", text.fmt_pct(F.round(F.col("grade"), 8)).alias("pct"), text.fmt_len(F.round(F.col("span") * 9.1, 3)).alias("len"))


VIEWED = f"""{PTS}, nx as (select way_id, i, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2, (way_id*7 + i*13) % 40 as e1, (way_id*7 + (i+1)*13) % 40 as e2 from v_way_pts window w as (partition by way_id order by i)),
 fl as (select way_id, i, case when e2 >= e1 then lat else lat2 end as flat, case when e2 >= e1 then lon else lon2 end as flon, case when e2 >= e1 then lat2 else lat end as tlat, case when e2 >= e1 then lon2 else lon end as tlon from nx where lat2 is not null and (lat <> lat2 or lon <> lon2))
 select way_id, i, round(h, 3) as heading from (select way_id, i, degrees(atan2(sin(radians(tlon-flon))*cos(radians(tlat)), cos(radians(flat))*sin(radians(tlat))-sin(radians(flat))*cos(radians(tlat))*cos(radians(tlon-flon)))) as h from fl) t"""


@query(VIEWED)
def view_heading(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("way_id").orderBy("i")
    p = view(spark, sf, "v_way_pts")
    p = p.select("way_id", "i", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), ((F.col("way_id") * 7 + F.col("i") * 13) % 40).alias("e1"), ((F.col("way_id") * 7 + (F.col("i") + 1) * 13) % 40).alias("e2"))
    p = p.filter("lat2 is not null and (lat <> lat2 or lon <> lon2)")
    up = F.col("e2") >= F.col("e1")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    h = F.degrees(geo.bearing_rad(pick("lat", "lat2"), pick("lon", "lon2"), pick("lat2", "lat"), pick("lon2", "lon")))
    return p.select("way_id", "i", F.round(h, 3).alias("heading"))


BEARING = "degrees(atan2(sin(radians({b}lon-{a}lon))*cos(radians({b}lat)), cos(radians({a}lat))*sin(radians({b}lat))-sin(radians({a}lat))*cos(radians({b}lat))*cos(radians({b}lon-{a}lon))))"


@query(
    f"""{P}, {LAID}, nx as (select *, lead(lat) over w as lat2, lead(lon) over w as lon2, lead(elev) over w as e2 from laid window w as (partition by road_id order by k)),
 fr as (select *, case when e2 >= elev then lat else lat2 end as a_lat, case when e2 >= elev then lon else lon2 end as a_lon, case when e2 >= elev then lat2 else lat end as b_lat, case when e2 >= elev then lon2 else lon end as b_lon from nx where lat2 is not null),
 an as (select *, {BEARING.format(a='a_', b='b_')} as h, degrees(atan2(abs(e2-elev), {HAV.format(a='x', b='y').replace('x.', 'a_').replace('y.', 'b_')})) as pitch from fr)
 select road_id, k, printf('https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=%.6f,%.6f&heading=%.1f&pitch=%.1f', a_lat, a_lon, round(case when h < 0 then h + 360 else h end, 1), round(pitch, 1)) as url from an"""
)
def street_views(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("road_id").orderBy("k")
    p = placed(spark, sf).select("road_id", "k", "lat", "lon", "elev", *[F.lead(c).over(w).alias(f"{c}2") for c in ("lat", "lon", "elev")]).filter("lat2 is not null")
    a = text.view_angles(*[F.col(c) for c in ("lat", "lon", "elev", "lat2", "lon2", "elev2")])
    return p.select("road_id", "k", text.street_view_url(a).alias("url"))


def color_sql(g: str, ramp: str, theme: str) -> str:
    """rgb() of a grade column g: Oklab between the ramp's three colours, and back through linear light."""
    low, mid, high = (text._oklab(c) for c in RAMPS[ramp, theme])
    x = f"least(greatest({g}, 0.03e0), 0.25e0)"
    lab = [f"(case when {x} <= 0.12e0 then {a!r} + ({x} - 0.03e0)/(0.12e0 - 0.03e0)*({b!r} - {a!r}) else {b!r} + ({x} - 0.12e0)/(0.25e0 - 0.12e0)*({c!r} - {b!r}) end)" for a, b, c in zip(low, mid, high, strict=True)]
    cone = [f"pow({lab[0]} + {a}*{lab[1]} + {b}*{lab[2]}, 3)" for a, b in (("0.3963377774e0", "0.2158037573e0"), ("-0.1055613458e0", "-0.0638541728e0"), ("-0.0894841775e0", "-1.2914855480e0"))]
    rows = (("4.0767416621e0", "-3.3077115913e0", "0.2309699292e0"), ("-1.2684380046e0", "2.6097574011e0", "-0.3413193965e0"), ("-0.0041960863e0", "-0.7034186147e0", "1.7076147010e0"))
    light = ["greatest(" + " + ".join(f"{a}*{c}" for a, c in zip(r, cone, strict=True)) + ", 0)" for r in rows]
    shown = [f"cast(floor(least(case when {v} <= 0.0031308e0 then 12.92e0*{v} else 1.055e0*pow({v}, 1/2.4e0) - 0.055e0 end, 1)*255 + 0.5e0) as int)" for v in light]
    return f"printf('rgb(%d,%d,%d)', {', '.join(shown)})"


SEGMENTS = "sg as (select road_id, k, (elev2-elev)/(d2-d) as g from (select *, lead(d) over w as d2, lead(elev) over w as elev2 from v_profile window w as (partition by road_id order by k)) t where d2 is not null)"


@query(f"{P}, {SEGMENTS} select road_id, k, {color_sql('abs(g)', 'red', 'light')} as light, {color_sql('abs(g)', 'indigo', 'dark')} as dark from sg")
def grade_colors(spark, sf):
    g = profile.segments(prof(spark, sf))
    return g.select("road_id", "k", text.grade_color(F.abs("grade")).alias("light"), text.grade_color(F.abs("grade"), "indigo", "dark").alias("dark"))


@query(
    f"""{WIN}, v as (select p.road_id, cast(floor(p.road_id/10) as bigint) as area_id, max(grade) as value from (select distinct road_id from v_profile) p left join win w on w.road_id = p.road_id group by p.road_id),
 l as (select * from (select area_id, road_id, row_number() over (partition by area_id order by value desc, road_id) as rank from v where value is not null) t where rank <= 5)
 select v.area_id, v.road_id, l.rank, row_number() over (partition by v.area_id order by l.rank desc nulls first, v.road_id) as z_order from v left join l on l.road_id = v.road_id"""
)
def draw_order(spark, sf):
    value = ranking.sustained_grade(placed(spark, sf), WINDOW, ("area_id", "road_id"))
    listed = ranking.top_by_area(value.filter("value is not null"), 5, F.desc("value"), F.col("road_id")).select("area_id", "road_id", "rank")
    return paint_order(value, listed)


def paint_order(value: DataFrame, listed: DataFrame) -> DataFrame:
    return ranking.draw_order(value.select("area_id", "road_id").join(listed, ["area_id", "road_id"], "left"))


@query("select s_suppkey, least(greatest(coalesce(case when s_suppkey % 5 = 0 then null else s_suppkey*0.4e0 end, 5), 1), 15) as radius_km, greatest(s_suppkey*3.0e0, 25) as window_m, greatest(s_suppkey*20.0e0, 50) as long_m, cast(least(greatest(s_suppkey, 1), 100) as int) as list_size, cast(least(greatest(s_suppkey % 9, 1), 5) as int) as max_roads from supplier")
def clean_settings(spark, sf):
    s = F.col("s_suppkey")
    p = sql(spark, sf, "select s_suppkey from supplier").select(
        "s_suppkey", F.when(s % 5 != 0, s * 0.4).alias("radius_km"), (s * 3.0).alias("window_m"), (s * 20.0).alias("long_m"), s.alias("list_size"), (s % 9).alias("max_roads")
    )
    return clean_params(p)
