"""Queries that rank: windows, stretches, climbs, inclines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, profile, ranking
from .views import ctes, view

WINDOW, WARM, SPAN = 250.0, 0.06, 300.0
P = ctes("v_profile")
QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query of (spark, sf_dir) under its own name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def prof(spark, sf) -> DataFrame:
    return view(spark, sf, "v_profile")


def arrays(spark, sf, name: str = "v_profile") -> DataFrame:
    return profile.to_arrays(view(spark, sf, name), columns=("d", "elev"))


def win_sql(window: float) -> str:
    return f"""ends as (select a.road_id, a.k as i, min(b.k) as j from v_profile a join v_profile b
   on a.road_id = b.road_id and b.k > a.k and b.d - a.d >= {window - 12.5}e0 group by a.road_id, a.k),
 win as (select e.road_id, e.i, e.j, b.d - a.d as span, abs(b.elev - a.elev)/(b.d - a.d) as grade from ends e
   join v_profile a on a.road_id = e.road_id and a.k = e.i join v_profile b on b.road_id = e.road_id and b.k = e.j)"""


WIN = f"{P}, {win_sql(WINDOW)}"
BEST = "best as (select * from (select *, row_number() over (partition by road_id order by grade desc, i) as rn from win) t where rn = 1)"
VALUE = "val as (select s.road_id, s.k, max(w.grade) as value from v_profile s join win w on w.road_id = s.road_id and w.i <= s.k and s.k < w.j group by s.road_id, s.k)"
WARM_RUNS = f"""runs as (select road_id, min(k) as i, max(k) + 1 as j, count(*) as n from (
  select road_id, k, k - row_number() over (partition by road_id order by k) as g from val where value >= {WARM}e0) t group by road_id, g)"""
NUMBERED = "ext as (select road_id, i, j, n as segs, cast(row_number() over (partition by road_id order by i) - 1 as int) as n from runs)"


@query(f"{WIN}, {BEST} select rank, road_id, i, j, round(grade, 9) as grade from (select *, row_number() over (order by grade desc, road_id) as rank from best) t where rank <= 15")
def top_sustained(spark, sf):
    best = ranking.best_window(prof(spark, sf), WINDOW)
    return rounded(ranking.top(best, 15, F.desc("grade"), F.col("road_id")).select("rank", "road_id", "i", "j", "grade"), 9, "grade")


@query(f"{WIN} select road_id, i, j, round(span, 6) as span, round(grade, 9) as grade from win")
def min_windows(spark, sf):
    return rounded(rounded(ranking.min_windows(prof(spark, sf), WINDOW), 6, "span"), 9, "grade")


@query(f"{WIN}, {VALUE} select road_id, k, round(value, 9) as value from val")
def segment_sustained(spark, sf):
    return rounded(ranking.segment_sustained(prof(spark, sf), WINDOW), 9, "value")


@query(f"{WIN} select p.road_id, round(max(grade), 9) as value from (select distinct road_id from v_profile) p left join win w on w.road_id = p.road_id group by p.road_id")
def sustained_grade(spark, sf):
    return rounded(ranking.sustained_grade(prof(spark, sf), WINDOW), 9, "value")


@query(f"{WIN}, {BEST} select road_id, i, j, round(grade, 9) as grade from best")
def best_window(spark, sf):
    return rounded(ranking.best_window(prof(spark, sf), WINDOW).drop("span"), 9, "grade")


@query(f"{WIN} select road_id, round(max(grade), 9) as value from win group by road_id")
def rankable_roads(spark, sf):
    return rounded(ranking.rankable(prof(spark, sf), WINDOW), 9, "value")


@query(f"{WIN}, {VALUE}, {WARM_RUNS} select road_id, i, j, n from runs")
def warm_runs(spark, sf):
    return ranking.warm_runs(ranking.segment_sustained(prof(spark, sf), WINDOW), WARM)


def extents(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W

    runs = warm_runs(spark, sf).withColumnRenamed("n", "segs")
    return runs.withColumn("n", F.row_number().over(W.partitionBy("road_id").orderBy("i")) - 1)


EXT = f"{WIN}, {VALUE}, {WARM_RUNS}, {NUMBERED}"


@query(f"{EXT} select p.road_id, p.k, min(e.n) as n from v_profile p left join ext e on e.road_id = p.road_id and e.i <= p.k and p.k < e.j group by p.road_id, p.k")
def containing_extent(spark, sf):
    return ranking.containing_extent(prof(spark, sf).select("road_id", "k"), extents(spark, sf)).select("road_id", "k", "n")


@query(
    f"""{EXT} select road_id, n, k, round(value, 9) as value from (select e.road_id, e.n, v.k, v.value,
 row_number() over (partition by e.road_id, e.n order by v.value desc, v.k) as rn from ext e join val v on v.road_id = e.road_id and v.k >= e.i and v.k < e.j) t where rn = 1"""
)
def largest_in(spark, sf):
    return rounded(ranking.largest_in(ranking.segment_sustained(prof(spark, sf), WINDOW), extents(spark, sf)), 9, "value")


@query(
    f"""{WIN}, {VALUE}, {BEST}, flo as (select b.road_id, b.i, b.j, greatest(0.03e0, 0.8e0*b.grade) as f from best b)
 select f.road_id, 0 as n, least(coalesce(max(case when v.value < f.f and v.k < f.i then v.k + 1 end), min(v.k)), f.i) as i,
  greatest(coalesce(min(case when v.value < f.f and v.k >= f.j then v.k end), max(v.k) + 1), f.j) as j
 from flo f join val v on v.road_id = f.road_id group by f.road_id, f.i, f.j"""
)
def shoulders(spark, sf):
    p = prof(spark, sf)
    return ranking.extend_shoulders(ranking.segment_sustained(p, WINDOW), ranking.best_window(p, WINDOW).withColumn("n", F.lit(0)))


@query(
    f"""{P}, {win_sql(100.0).replace('ends', 'e1').replace('win ', 'w1 ')}, {win_sql(400.0).replace('ends', 'e2').replace('win ', 'w2 ')},
 a as (select road_id, max(grade) as short from w1 group by road_id), b as (select road_id, max(grade) as long from w2 group by road_id)
 select a.road_id, round(short, 9) as short, round(long, 9) as long, long <= short + 1e-9 as ok from a join b on a.road_id = b.road_id"""
)
def window_monotone(spark, sf):
    p = prof(spark, sf)
    return rounded(ranking.window_monotone(ranking.sustained_grade(p, 100.0), ranking.sustained_grade(p, 400.0)), 9, "short", "long")


UPDOWN = """de as (select *, elev - lag(elev) over (partition by road_id order by k) as de from v_profile),
 pre as (select road_id, k, d, elev, sum(greatest(coalesce(de, 0), 0)) over w as up, sum(greatest(-coalesce(de, 0), 0)) over w as down from de
   window w as (partition by road_id order by k rows between unbounded preceding and current row)),
 pr as (select a.road_id, a.k as i, b.k as j, b.d - a.d as span, b.elev - a.elev as net,
   case when b.elev > a.elev then b.up - a.up else b.down - a.down end as gain,
   case when b.elev > a.elev then b.down - a.down else b.up - a.up end as counter
   from pre a join pre b on a.road_id = b.road_id and a.k < b.k),
 okp as (select * from pr where counter <= greatest(2.0e0, 0.1e0*(gain + counter)) and net <> 0)"""


@query(f"{P}, {UPDOWN} select road_id, k, round(up, 6) as up, round(down, 6) as down from pre")
def ascent_prefix(spark, sf):
    return rounded(profile.ascent_prefixes(prof(spark, sf)).select("road_id", "k", "up", "down"), 6, "up", "down")


@query(f"{P}, {UPDOWN} select road_id, round(max(net*net/span), 6) as value from okp group by road_id")
def climb_core(spark, sf):
    return rounded(ranking.climb_core(arrays(spark, sf)).select("road_id", "value"), 6, "value")


@query(
    f"""{P}, {UPDOWN}, far as (select road_id, i, max(j) as j from okp where span >= {SPAN - 12.5}e0 and abs(net)/span >= 0.03e0 group by road_id, i)
 select f.road_id, f.i, f.j, o.span, round(o.net, 6) as net from far f join okp o on o.road_id = f.road_id and o.i = f.i and o.j = f.j"""
)
def incline_pairs(spark, sf):
    return rounded(ranking.qualifying_pairs(arrays(spark, sf), SPAN), 6, "net")


R = WIN.replace("with ", "with recursive ", 1)
# rw: the windows of each warm run, best first; pk: what is picked of them one after the other, as a list; st: the result
STRETCHES = f"""{VALUE}, {WARM_RUNS},
 la as (select road_id, max(k) as last from v_profile group by road_id),
 vl as (select s.road_id, list(coalesce(v.value, 0) order by s.k) as v from v_profile s join la on la.road_id = s.road_id and s.k < la.last left join val v on v.road_id = s.road_id and v.k = s.k group by s.road_id),
 rw as (select r.road_id, r.i as a, w.i, w.j, w.grade, row_number() over (partition by r.road_id, r.i order by w.grade desc, w.i) as pos from runs r join win w on w.road_id = r.road_id and w.i >= r.i and w.j <= r.j),
 pk as (select road_id, a, cast(0 as bigint) as pos, cast([] as struct(i int, j int, g double)[]) as kept from (select distinct road_id, a from rw) t
  union all select p.road_id, p.a, w.pos, case when len(p.kept) < 3 and len(list_filter(p.kept, lambda x:
     case when x.i <= w.i then w.i < x.j else x.i < w.j end or coalesce(list_min(case when x.i <= w.i then vl.v[x.j+1:w.i] else vl.v[w.j+1:x.i] end) > 0.8e0*least(x.g, w.grade), true))) = 0
   then list_append(p.kept, {{'i': cast(w.i as int), 'j': cast(w.j as int), 'g': w.grade}}) else p.kept end
  from pk p join rw w on w.road_id = p.road_id and w.a = p.a and w.pos = p.pos + 1 join vl on vl.road_id = p.road_id),
 ls as (select road_id, a, arg_max(kept, pos) as kept from pk group by road_id, a),
 pc as (select road_id, a, x.i as i, x.j as j, x.g as g from (select road_id, a, unnest(kept) as x from ls) t),
 al as (select road_id, i, j, g, a from pc union all select road_id, i, j, grade, 0 from (select *, row_number() over (partition by road_id order by grade desc, i) as rn from win) t where rn = 1 and road_id not in (select road_id from pc)),
 st as (select road_id, i, j, g as grade, cast(row_number() over (partition by road_id order by g desc, a, i) - 1 as int) as n from al qualify row_number() over (partition by road_id order by g desc, a, i) <= 3)"""


@query(f"{R}, {STRETCHES} select s.road_id, s.n, s.i, s.j, round(s.grade, 9) as grade, b.d - a.d as span from st s join v_profile a on a.road_id = s.road_id and a.k = s.i join v_profile b on b.road_id = s.road_id and b.k = s.j")
def stretches(spark, sf):
    return rounded(ranking.sustained_stretches(arrays(spark, sf), WINDOW, WARM), 9, "grade")


def climbs_sql() -> str:
    """Tables of up to three passes, each: the best core clear of what the passes before took, grown at both ends."""
    out = """ag as (select road_id, k, d, elev, lead(d) over w as d2, lead(elev) over w as elev2, (lead(elev) over w - elev)/(lead(d) over w - d) as g from v_profile window w as (partition by road_id order by k))"""
    for p in (1, 2, 3):
        taken = " union all ".join(f"select road_id, i, j from c{q}" for q in range(1, p)) or "select 0 as road_id, 0 as i, 0 as j where false"
        go_on = f"road_id in (select road_id from c{p - 1}) and" if p > 1 else ""
        out += f""",
 t{p} as ({taken}),
 b{p} as (select * from (select o.*, row_number() over (partition by road_id order by net*net/span desc, i, j) as rn from okp o where {go_on} not exists (select 1 from t{p} t where t.road_id = o.road_id and o.i < t.j and t.i < o.j)) x where rn = 1 and abs(net) >= 2),
 f{p} as (select b.road_id, b.i, b.j, sign(b.net) as dir, s.k, exists(select 1 from t{p} t where t.road_id = s.road_id and t.i <= s.k and s.k < t.j) as tk, sign(b.net)*s.g as g
   from b{p} b join ag s on s.road_id = b.road_id and s.d2 is not null),
 c{p} as (select road_id, cast(dir as int) as dir, coalesce(max(case when k < i and (tk or g < case when dir > 0 then 0.04e0 else 0.03e0 end) then k + 1 end), 0) as i,
   coalesce(min(case when k >= j and (tk or g < case when dir > 0 then 0.03e0 else 0.04e0 end) then k end), max(k) + 1) as j from f{p} group by road_id, i, j, dir)"""
    every = " union all ".join(f"select {p - 1} as n, road_id, dir, i, j from c{p}" for p in (1, 2, 3))
    return f"""{out}, cl as (select c.n, c.road_id, c.dir, c.i, c.j, sum(pow(greatest(c.dir*(s.elev2 - s.elev), 0), 2)/(s.d2 - s.d)) as score, max(s.d2) - min(s.d) as span, abs(sum(s.elev2 - s.elev)) as gain
  from ({every}) c join ag s on s.road_id = c.road_id and s.k >= c.i and s.k < c.j group by c.n, c.road_id, c.dir, c.i, c.j)"""


@query(f"{P}, {UPDOWN}, {climbs_sql()} select road_id, n, round(score, 6) as score, round(gain, 6) as gain, span, round(gain/span, 6) as grade, i, j, dir from cl")
def climbs(spark, sf):
    return rounded(ranking.hardest_climbs(arrays(spark, sf)), 6, "score", "gain", "span", "grade")


def inclines_sql(of: str, span: float = SPAN) -> str:
    """Tables of long inclines on samples (road_id, k, d, elev) of a table. q_pr: pairs that pass but for rests; q_cv: of
    each start and direction the farthest that rests allow; q_rf: pieces that are trimmed, cut or kept (done) in rounds,
    with a road's numbers as lists; q_in: the inclines."""
    bound = f"{span - 12.5}e0"
    return f"""q_sg as (select road_id, k, d, elev, lead(d) over w as d2, lead(elev) over w as elev2 from {of} window w as (partition by road_id order by k)),
 q_pf as (select road_id, k, d, elev, coalesce(sum(greatest(elev2 - elev, 0)) over x, 0) as up, coalesce(sum(greatest(elev - elev2, 0)) over x, 0) as down from q_sg
   window x as (partition by road_id order by k rows between unbounded preceding and 1 preceding)),
 q_g as (select road_id, k, d, d2, (elev2 - elev)/(d2 - d) as g from q_sg where d2 is not null),
 q_rl as (select p.road_id, list(p.d order by p.k) as d, list(p.elev order by p.k) as e, list(p.up order by p.k) as up, list(p.down order by p.k) as down, list(g.g order by p.k) as g
   from q_pf p left join q_g g on g.road_id = p.road_id and g.k = p.k group by p.road_id),
 q_pr as (select a.road_id, a.k as i, b.k as j, a.d as d1, cast(sign(b.elev - a.elev) as int) as s from q_pf a join q_pf b on b.road_id = a.road_id and b.k > a.k and b.d - a.d >= {bound} and abs(b.elev - a.elev)/(b.d - a.d) >= 0.03e0
   where case when b.elev > a.elev then b.down - a.down else b.up - a.up end <= greatest(2.0e0, 0.1e0*(b.up - a.up + b.down - a.down))),
 q_id as (select g.*, s, case when s*g < 0.015e0 then d2 - coalesce(max(case when s*g >= 0.015e0 then d2 end) over (partition by road_id, s order by k), min(d) over (partition by road_id)) else 0 end as run
   from q_g g, (values (1), (-1)) v(s)),
 q_ok as (select p.road_id, p.i, p.j, p.s from q_pr p join q_id r on r.road_id = p.road_id and r.s = p.s and r.k >= p.i and r.k < p.j group by p.road_id, p.i, p.j, p.s having max(least(r.run, r.d2 - p.d1)) <= 300),
 q_cv as (select road_id, i, max(j) as j from q_ok group by road_id, i, s),
 q_mk as (select distinct g.road_id, g.k from q_g g join q_cv c on c.road_id = g.road_id and c.i <= g.k and g.k < c.j),
 q_rf as (select road_id, min(k) as a, max(k) as b, false as done from (select road_id, k, k - row_number() over (partition by road_id order by k) as x from q_mk) t group by road_id, x
  union all select road_id, r.a, r.b, r.done from (
   select road_id, unnest(case when len(mv) = 0 or d[y+2] - d[x+1] < {bound} then []
     when steep and len(av) = 0 then [] when steep and (av[1] <> x or av[-1] <> y) then [{{'a': av[1], 'b': av[-1], 'done': false}}]
     when steep and coalesce(list_max(rs), 0) > 300 then [{{'a': x, 'b': av[list_position(rs, list_max(rs))], 'done': false}}, {{'a': av[list_position(rs, list_max(rs)) + 1], 'b': y, 'done': false}}]
     when steep then [{{'a': x, 'b': y, 'done': true}}]
     when greatest(coalesce(list_max(fl), 0), coalesce(list_max(ri), 0)) <= 0 then []
     when list_max(fl) >= list_max(ri) then [{{'a': x, 'b': x + list_position(fl, list_max(fl)) - 2, 'done': false}}, {{'a': x + list_position(fl, list_max(fl)), 'b': y, 'done': false}}]
     else [{{'a': x, 'b': x + list_position(ri, list_max(ri)) - 2, 'done': false}}, {{'a': x + list_position(ri, list_max(ri)), 'b': y, 'done': false}}] end) as r
   from (select *, list_transform(range(1, len(av)), lambda m: d[av[m+1]+1] - d[av[m]+2]) as rs,
       list_transform(range(2, y - x + 2), lambda t: list_max(e[x+1:x+t]) - e[x+t]) as fl, list_transform(range(2, y - x + 2), lambda t: e[x+t] - list_min(e[x+1:x+t])) as ri
    from (select *, list_filter(range(x, y + 1), lambda k: sign(e[y+2] - e[x+1])*g[k+1] >= 0.015e0) as av,
       abs(e[y+2] - e[x+1])/(d[y+2] - d[x+1]) >= 0.03e0 and case when e[y+2] > e[x+1] then down[y+2] - down[x+1] else up[y+2] - up[x+1] end <= greatest(2.0e0, 0.1e0*(up[y+2] - up[x+1] + down[y+2] - down[x+1])) as steep
     from (select *, mv[1] as x, mv[-1] as y from (select f.road_id, l.* exclude (road_id), list_filter(range(f.a, f.b + 1), lambda k: abs(l.g[k+1]) >= 0.015e0) as mv from q_rf f join q_rl l on l.road_id = f.road_id where not f.done and f.a <= f.b) t1) t2) t3) t4) t5),
 q_ks as (select distinct road_id, unnest(range(a, b + 1)) as k from q_rf where done),
 q_is as (select road_id, min(k) as i, max(k) + 1 as j from (select road_id, k, k - row_number() over (partition by road_id order by k) as x from q_ks) t group by road_id, x),
 q_in as (select s.road_id, s.i, s.j, b.d - a.d as span, abs(b.elev - a.elev) as gain, abs(b.elev - a.elev)/(b.d - a.d) as grade, cast(row_number() over (partition by s.road_id order by b.d - a.d desc, s.i) - 1 as int) as n
   from q_is s join {of} a on a.road_id = s.road_id and a.k = s.i join {of} b on b.road_id = s.road_id and b.k = s.j)"""


RP = P.replace("with ", "with recursive ", 1)


@query(f"{RP}, {inclines_sql('v_profile')} select road_id, n, i, j, round(span, 6) as span, round(gain, 6) as gain, round(grade, 6) as grade from q_in")
def inclines(spark, sf):
    return rounded(ranking.longest_inclines(arrays(spark, sf), SPAN), 6, "span", "gain", "grade")


@query(f"{RP}, {inclines_sql('v_profile')} select road_id, cast(k as int) as k from q_ks")
def incline_mask(spark, sf):
    return ranking.long_incline_mask(arrays(spark, sf), SPAN)


@query(f"{P}, {UPDOWN}, {climbs_sql()} select road_id, n, round(score, 6) as effort from cl")
def climb_effort(spark, sf):
    """Scores of climbs summed from segments; equals the climbs' own."""
    p = prof(spark, sf)
    return rounded(ranking.climb_effort(profile.segments(p), ranking.hardest_climbs(arrays(spark, sf))), 6, "effort")


@query(
    f"""{R}, {STRETCHES}, {UPDOWN}, {climbs_sql()}
 select s.road_id, s.n, s.i, s.j, coalesce(min(case when c.i <= (s.i + s.j)/2.0e0 and (s.i + s.j)/2.0e0 <= c.j then c.n end), min(c.n)) as climb_n from st s left join cl c on c.road_id = s.road_id group by s.road_id, s.n, s.i, s.j"""
)
def climb_of_stretch(spark, sf):
    a = arrays(spark, sf)
    return ranking.climb_of_stretch(ranking.sustained_stretches(a, WINDOW, WARM), ranking.hardest_climbs(a)).select("road_id", "n", "i", "j", "climb_n")


LAID = "laid as (select road_id, k, d, elev, cast(floor(road_id/10) as bigint) as area_id, 35 + floor(road_id/10)*0.1e0 + (road_id % 10)*0.0004e0 as lat, -82 + d/91000.0e0 as lon, printf('Road %d', cast(floor(road_id/3) as bigint)) as name, road_id % 10 = 9 as unnamed from v_profile)"


def kept_sql(of: str, order: str, area: str = "area_id") -> str:
    """Table kp: of entries (with boxes), those left when one goes through them in order and drops what lies in the place
    of a kept one of the same name on another road. en: with places in the walk; dd: the walk, with the kept ones' boxes."""
    return f"""en as (select *, row_number() over (partition by {area}, name order by {order}) as pos from {of} where not unnamed),
 dd as (select {area}, name, cast(0 as bigint) as pos, cast([] as struct(road_id bigint, y0 double, y1 double, x0 double, x1 double)[]) as kept, false as stays from (select distinct {area}, name from en) t
  union all select w.{area}, w.name, e.pos, case when x.free then list_append(w.kept, {{'road_id': e.road_id, 'y0': e.lat_min, 'y1': e.lat_max, 'x0': e.lon_min, 'x1': e.lon_max}}) else w.kept end, x.free
  from dd w join en e on e.{area} = w.{area} and e.name = w.name and e.pos = w.pos + 1,
   lateral (select len(list_filter(w.kept, lambda o: o.road_id <> e.road_id and o.y0 <= e.lat_max and e.lat_min <= o.y1 and o.x0 <= e.lon_max and e.lon_min <= o.x1)) = 0 as free) x),
 kp as (select e.* exclude (pos) from en e join dd w on w.{area} = e.{area} and w.name = e.name and w.pos = e.pos where w.stays union all select * from {of} where unnamed)"""


def boxed_sql(of: str, columns: str) -> str:
    """Table bx: entries (road_id, n, i, j) with place, name and padded box."""
    return f"""bx as (select e.road_id, e.n, e.i, e.j, {columns}, l.area_id, l.name, l.unnamed, min(l.lat) - 0.0005e0 as lat_min, max(l.lat) + 0.0005e0 as lat_max, min(l.lon) - 0.0005e0 as lon_min, max(l.lon) + 0.0005e0 as lon_max
   from {of} e join laid l on l.road_id = e.road_id and l.k between e.i and e.j group by e.road_id, e.n, e.i, e.j, {columns}, l.area_id, l.name, l.unnamed)"""


def placed(spark, sf) -> DataFrame:
    """Profiles laid out on a plane: road r on its own parallel, in areas of ten roads; a name for three roads each."""
    r = F.col("road_id")
    return prof(spark, sf).withColumns(
        {
            "area_id": F.floor(r / 10), "lat": 35 + F.floor(r / 10) * 0.1 + (r % 10) * 0.0004, "lon": -82 + F.col("d") / 91000.0,
            "name": F.format_string("Road %d", F.floor(r / 3)), "unnamed": r % 10 == 9,
        }
    )


def entries(spark, sf, found: DataFrame) -> DataFrame:
    p = placed(spark, sf)
    names = p.filter("k = 0").select("road_id", "area_id", "name", "unnamed")
    return found.join(ranking.bbox(p, found), ["road_id", "n"]).join(names, "road_id")


@query(
    f"""{R}, {STRETCHES}, {LAID}, {boxed_sql('st', 'e.grade')}, {kept_sql('bx', 'grade desc, road_id, n')}
 select area_id, cast(row_number() over (partition by area_id order by grade desc, road_id, n) as int) as rank, road_id, n, i, j, round(grade, 9) as grade from kp qualify row_number() over (partition by area_id order by grade desc, road_id, n) <= 15"""
)
def ranked_stretches(spark, sf):
    e = entries(spark, sf, ranking.sustained_stretches(arrays(spark, sf), WINDOW, WARM)).withColumn("rank_key", -F.col("grade"))
    kept = ranking.dedupe_same_hill(e, ("area_id",), ("rank_key", "road_id", "n"))
    return rounded(ranking.rank_stretches(kept, 15).select("area_id", "rank", "road_id", "n", "i", "j", "grade"), 9, "grade")


@query(
    f"""{R}, {UPDOWN}, {climbs_sql()}, {LAID}, {boxed_sql('cl', 'e.score')}, {kept_sql('bx', 'score desc, road_id, n')},
 bs as (select *, max(score) over (partition by area_id, road_id) as best from kp where road_id in (select road_id from win)),
 rk as (select *, row_number() over (partition by area_id order by score desc, best desc, road_id, n) as rank from bs)
 select area_id, cast(rank as int) as rank, road_id, n, i, j, round(score, 6) as score, round(greatest(score/first_value(score) over (partition by area_id order by rank), 0.02e0), 6) as frac from rk where rank <= 15"""
)
def ranked_climbs(spark, sf):
    e = entries(spark, sf, ranking.hardest_climbs(arrays(spark, sf))).withColumn("rank_key", -F.col("score"))
    kept = ranking.dedupe_same_hill(e, ("area_id",), ("rank_key", "road_id", "n"))
    value = ranking.sustained_grade(placed(spark, sf), WINDOW, ("area_id", "road_id"))
    out = ranking.bar_fraction(ranking.rank_climbs(kept, value, 15), "score")
    return rounded(out.select("area_id", "rank", "road_id", "n", "i", "j", "score", "frac"), 6, "score", "frac")


# the search measures roads anew, from sample to sample
HAV = "2*6371000.0e0*asin(sqrt(pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2), 2)))"
PATHS = f"""{RP}, {LAID}, ms as (select b.road_id, b.k, b.elev, sum(case when a.k is null then 0 else {HAV} end) over (partition by b.road_id order by b.k) as d from laid b left join laid a on a.road_id = b.road_id and a.k = b.k - 1),
 {inclines_sql('ms')}, sz as (select road_id, max(k) as last from ms group by road_id),
 sq as (select q.*, concat('[{{"road_id":', q.road_id, ',"from":0,"to":', last, '}}]#', printf('%03d', q.n)) as seq from q_in q join sz on sz.road_id = q.road_id),
 {boxed_sql('sq', 'e.span, e.gain, e.grade, e.seq')}, {kept_sql('bx', 'span desc, seq')}"""


def found_inclines(spark, sf) -> DataFrame:
    """Inclines over single roads, place by place; the search over connected roads is a parameter."""
    p = placed(spark, sf)
    return graph.longest_incline_paths(p, p.filter("k = 0").select("area_id", "road_id", "name", "unnamed"), SPAN, 1, ("area_id",))


@query(f"{PATHS} select area_id, road_id, i, j, round(span, 6) as span, round(gain, 6) as gain, round(grade, 6) as grade from kp")
def incline_paths(spark, sf):
    return rounded(found_inclines(spark, sf).select("area_id", "road_id", "i", "j", "span", "gain", "grade"), 6, "span", "gain", "grade")


RANKED_INCLINES = f"{PATHS}, rk as (select *, row_number() over (partition by area_id order by span desc, seq) as rank from kp)"


@query(f"{RANKED_INCLINES} select area_id, cast(rank as int) as rank, name as names, 1 as n_roads, round(span, 6) as span, round(grade, 6) as grade from rk where rank <= 15")
def ranked_inclines(spark, sf):
    out = ranking.rank_inclines(found_inclines(spark, sf), 15)
    return rounded(out.select("area_id", "rank", "names", "n_roads", "span", "grade"), 6, "span", "grade")


@query(f'{RANKED_INCLINES} select area_id, cast(rank as int) as rank, road_id, i as "from", j as "to" from rk where rank <= 15')
def incline_slices(spark, sf):
    return ranking.incline_slices(ranking.rank_inclines(found_inclines(spark, sf), 15))


@query(
    f"""{R}, {STRETCHES}, {LAID}, {boxed_sql('st', 'e.grade')}, {kept_sql('bx', 'grade desc, road_id, n')}
 select area_id, road_id, i, j, cast(row_number() over (partition by area_id order by grade desc, road_id, n) as int) as rank from kp"""
)
def ranked_spans(spark, sf):
    """Every kept stretch with its rank, before any limit."""
    e = entries(spark, sf, ranking.sustained_stretches(arrays(spark, sf), WINDOW, WARM)).withColumn("rank_key", -F.col("grade"))
    kept = ranking.dedupe_same_hill(e, ("area_id",), ("rank_key", "road_id", "n"))
    return ranking.ranked_spans(ranking.rank_stretches(kept, 2**31 - 1))


@query(
    f"""{PATHS}, {win_sql(WINDOW)}, va as (select l.area_id, l.road_id, max(w.grade) as value from (select distinct area_id, road_id from laid) l join win w on w.road_id = l.road_id group by l.area_id, l.road_id)
 select area_id, cast(road_id as varchar) as road_id, round(value, 9) as value, null as name, null as span from va union all
 select k.area_id, printf('incline:%.5f,%.5f', l.lat, l.lon), null, k.name, round(k.span, 6) from kp k join ms a on a.road_id = k.road_id and a.k = k.i join ms b on b.road_id = k.road_id and b.k = k.j
  join laid l on l.road_id = k.road_id and l.k = case when a.elev <= b.elev then k.i else k.j end"""
)
def roads_with_inclines(spark, sf):
    """Ranked roads and inclines as roads of their own, in one table."""
    value = ranking.sustained_grade(placed(spark, sf), WINDOW, ("area_id", "road_id")).filter("value is not null")
    virtual = graph.incline_virtual_road(found_inclines(spark, sf), ("area_id",)).select("area_id", "road_id", "name", "span")
    return rounded(rounded(graph.with_virtual_roads(value, virtual), 9, "value"), 6, "span")


@query(
    f"""{PATHS}, {win_sql(WINDOW)}, va as (select l.area_id, count(distinct l.road_id) as n_roads from laid l join win w on w.road_id = l.road_id group by l.area_id),
 ni as (select area_id, count(*) as n_inclines from kp group by area_id)
 select coalesce(v.area_id, n.area_id) as area_id, coalesce(n_roads, 0) as n_roads, coalesce(n_inclines, 0) as n_inclines from va v full join ni n on n.area_id = v.area_id"""
)
def ranking_summary(spark, sf):
    value = ranking.sustained_grade(placed(spark, sf), WINDOW, ("area_id", "road_id"))
    return ranking.ranking_summary(value, found_inclines(spark, sf))
