"""The driver's tables seen as profiles, ways, rasters and labels; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PROFILE = """
select road_id, k, cast(k as double)*25.0e0 as d, 200.0e0 + cast(cz as double)/2500.0e0 as elev, b from (
 select user_id as road_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as k,
  sum(case when event_type in ('click','view','purchase') then cast(round(value*100) as bigint)
           else -cast(round(value*100) as bigint) end)
    over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as cz,
  (event_id % 17 = 0) as b from events) t
"""
#: The same with elevations five times as lively, so that there is something to repair.
ROUGH = PROFILE.replace("/2500.0e0", "/500.0e0")
WAY_PTS = """
select way_id, i, area_id,
  35.0e0 + cast(floor((c % 10000)/100.0e0) as double)*0.03e0 + cast(floor(p/20.0e0) as double)*0.001e0 as lat,
  -82.0e0 + cast(c % 100 as double)*0.03e0 + cast(p % 20 as double)*0.001e0 as lon from (
 select o_orderkey as way_id, o_custkey as c, o_custkey % 10000 as area_id, l_partkey % 400 as p,
  cast(row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
       l_extendedprice, l_shipdate) - 1 as int) as i
 from orders join lineitem on l_orderkey = o_orderkey) t
"""
WAY_TAGS = """
select o_orderkey as way_id, o_custkey % 10000 as area_id,
 case when o_custkey % 10 = 0 then null else concat('Street ', cast(o_custkey as varchar(20)),
      case when o_orderkey % 2 = 0 then 'A' else 'B' end) end as name,
 case when o_orderkey % 3 = 0 then concat('SR ', cast(o_custkey % 50 as varchar(20)), ';US 70') else null end as ref,
 case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary' when '3-MEDIUM' then 'residential'
      when '4-NOT SPECIFIED' then 'tertiary' else 'motorway_link' end as highway,
 case when o_orderstatus = 'P' then 'yes' else null end as bridge,
 case when o_orderkey % 7 = 0 then '-1' when o_orderkey % 7 = 1 then 'x' when o_orderkey % 7 = 2 then '1' else null end as layer,
 case when o_orderkey % 41 = 0 then 'roundabout' else null end as junction
from orders
"""
TILE_SAMPLES = """
select event_id as sample_id, event_id % 500 as tile_id, cast((event_id * 37) % 801 as double)/100.0e0 as px,
       cast((event_id * 53) % 801 as double)/100.0e0 as py from events
"""
LABELS = """
select c_custkey, concat(c_name, ', ', n_name, case when c_custkey % 3 = 0 then ' County' else '' end,
  case when c_custkey % 2 = 0 then ', North Carolina' else ', Vermont' end, ', United States') as label,
  concat(case when c_custkey % 5 = 0 then 'Old Street ' else 'Streetman ' end, n_name, case when c_custkey % 2 = 0 then ' Avenue Extension' else ' Road' end) as street,
  case when c_custkey % 4 = 0 then concat(' ', cast(c_custkey % 120 as varchar(20)), '.5 , -', cast(c_custkey % 200 as varchar(20)), ' ')
       when c_custkey % 4 = 1 then concat('  ', upper(n_name), '   town') else n_name end as place
from customer join nation on c_nationkey = n_nationkey
"""
ENTRIES = """
select concat(cast(o_custkey as varchar(20)), ',5000') as search_key, 9 + o_orderkey % 2 as version, o_orderdate as captured_at, o_orderkey as entry_id from orders
"""
#: Profiles as pairs of roads that meet end to end, in areas of five parallels; the second road of a pair goes on at the
#: first one's last elevation and begins twelve metres before its end. Three roads in a row share a name. Samples lie ever
#: farther apart, so that no two stretches are equally long.
NETWORK = f"""
with p as ({PROFILE}), e as (select road_id, max(d) as len, min_by(elev, k) as first_e, max_by(elev, k) as last_e from p group by road_id)
select cast(floor(p.road_id/10.0e0) as bigint) as area_id, p.road_id, p.k, case when q.len is null then p.elev else p.elev - s.first_e + q.last_e end as elev,
 35.0e0 + cast(floor(p.road_id/10.0e0) as double)*0.1e0 + cast(floor((p.road_id % 10)/2.0e0) as double)*0.0004e0 as lat,
 -82.0e0 + (p.d + coalesce(q.len - 12.0e0, 0.0e0))*(1.0e0 + (p.d + coalesce(q.len - 12.0e0, 0.0e0))*1e-6)/91000.0e0 as lon,
 concat('Road ', cast(cast(floor(p.road_id/3.0e0) as bigint) as varchar(20))) as name, p.road_id % 10 = 9 as unnamed
from p join e s on s.road_id = p.road_id left join e q on q.road_id = p.road_id - 1 and p.road_id % 2 = 1
"""
#: Circles of twelve points from orders, in pairs that touch at one node; each is cut into one to four ways of either
#: direction, and where there are four one may be missing. Ways are numbered against the order of the pieces.
ROUNDS = """
with o as (select o_orderkey as ok, o_custkey % 10000 as area_id, 35.0e0 + cast(floor((o_custkey % 10000)/100.0e0) as double)*0.03e0 + cast(o_orderkey % 23 as double)*0.001e0 as lat0,
  -82.0e0 + cast(o_custkey % 100 as double)*0.03e0 + cast(o_orderkey % 19 as double)*0.001e0 as lon0 from orders where o_orderkey % 41 = 0),
 c as (select o.*, n.r_regionkey as c, 1 + cast((o.ok + n.r_regionkey) % 4 as int) as m from o cross join region n where n.r_regionkey < 2),
 p as (select c.*, g.r_regionkey as j from c cross join region g where g.r_regionkey < c.m and not (c.m = 4 and c.ok % 3 = 0 and g.r_regionkey = 2)),
 i as (select n_nationkey as i from nation where n_nationkey < 13),
 q as (select p.*, i.i, case when (p.ok + p.j) % 3 = 0 then -1 else 1 end as turn, p.j*12/p.m as a, (p.j + 1)*12/p.m as b from p cross join i),
 z as (select *, case when turn = 1 then a + i else b - i end as k from q where i <= b - a)
select area_id, ok*10 + c*5 + (3 - j) as way_id, i, lat0 + 0.00018e0*cos(radians(30.0e0*k)) + 0.00036e0*c as lat, lon0 + 0.00018e0*sin(radians(30.0e0*k)) as lon from z
"""
VIEWS = {"v_profile": PROFILE, "v_rough": ROUGH, "v_way_pts": WAY_PTS, "v_way_tags": WAY_TAGS, "v_tile_samples": TILE_SAMPLES, "v_labels": LABELS, "v_entries": ENTRIES, "v_network": NETWORK, "v_rounds": ROUNDS}
_TABLES = ("events", "orders", "lineitem", "customer", "nation", "region", "supplier", "embeddings")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL with the driver's tables named in it read from sf_dir; no view is registered."""
    used = [t for t in _TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, VIEWS[name])


def ctes(*names: str) -> str:
    """WITH clause of views for DuckDB, to be followed by more tables."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
