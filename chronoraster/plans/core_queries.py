"""Queries of the general problems over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import fill_missing, filled_cells
from ..operators.proximity import containing_regions, near_pairs
from ..operators.regular_grid import regular_grid
from ..operators.spikes import limit_flags, spike_flags
from .reference_sql import _IN


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_filled(spark, d):
    return fill_missing(_t(spark, d, "ndvi_series"))


def p2_found(spark, d):
    series = _t(spark, d, "ndvi_series").select("rec_id", "id", "cube_name", "scene_id", "obs_time", "ndvi", "ndvi_undist", "scl")
    return filled_cells(fill_missing(series), "rec_id", ["ndvi", "ndvi_undist", "scl"]).select("field", "rec_id").distinct()


def p4_grid(spark, d):
    return regular_grid(_t(spark, d, "ndvi_series"))


def p4_found(spark, d):
    # a period counts once it has its predicted value, so the fit and the bridging take part
    return p4_grid(spark, d).filter("source = 'filled' and value is not null").select("id", "period_no")


def p5_near(spark, d):
    return near_pairs(_t(spark, d, "annotations"), 250.0)


def p5_found(spark, d):
    return p5_near(spark, d).select("id_a", "id_b")


def p5_pixel_regions(spark, d):
    return containing_regions(_t(spark, d, "xds_pixels"), _t(spark, d, "annotations"), ["cube_name"], "pixel_id", "id")


def p6_flags(spark, d):
    scl = limit_flags(_t(spark, d, "xds_pixels"), ["scl"], "pixel_id", 0, 11)
    return spike_flags(_t(spark, d, "ndvi_series")).unionByName(scl.distinct())


def p6_found(spark, d):
    return p6_flags(spark, d).filter("impossible or stuck or spike").select("field", "row_key").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_filled, p4_found, p4_grid, p5_found, p5_near, p5_pixel_regions, p6_found, p6_flags)}

_MISS = "({0} is null or isnan({0}::double) or {0}::double in (-9999, 99, 255))"
_SERIES = """
with r as (select id, rec_id, obs_time, case when not {m} and {f} between -1 and 1 then {f} end v from ndvi_series where id is not null and obs_time is not null),
s as (select *, sum(case when epoch_us(obs_time) - lag_t < 60000000 then 0 else 1 end) over (partition by id order by obs_time, rec_id) sess
  from (select *, lag(epoch_us(obs_time)) over (partition by id order by obs_time, rec_id) lag_t from r)),
u as (select id, sess, arg_min(v, (obs_time, rec_id)) v from s where v is not null group by id, sess),
o as (select *, row_number() over (partition by id order by sess) rn, abs(v - lag(v) over (partition by id order by sess)) step from u),
m as (select id, median(step) mas from o group by id),
w as (select *, median(v) over (partition by id order by rn rows between 2 preceding and 2 following) med, count(*) over (partition by id order by rn rows between 2 preceding and 2 following) n5,
  max(v) over (partition by id order by rn rows between current row and 5 following) - min(v) over (partition by id order by rn rows between current row and 5 following) spread,
  count(*) over (partition by id order by rn rows between current row and 5 following) n6 from o),
x as (select w.*, m.mas, max(case when n6 = 6 and spread <= 0.0003 + 1e-9 then 1 else 0 end) over (partition by id order by rn rows between 5 preceding and current row) stuck from w join m using (id)),
bad as (select id, sess from x where stuck = 1 or (n5 = 5 and abs(v - med) > 6 * mas + 1e-9))
select '{f}' as field, rec_id as row_key from s join bad using (id, sess) where v is not null
union select '{f}', rec_id from ndvi_series where not {m} and not {f} between -1 and 1"""

SQL = {
    "p2_found": " union ".join(f"select '{f}' as field, rec_id from ndvi_series where {_MISS.format(f)}" for f in ("ndvi", "ndvi_undist", "scl")),
    "p4_found": f"""
with o as (select distinct id, floor((epoch(obs_time) - epoch(timestamp '2018-01-01')) / (16 * 86400))::bigint p from ndvi_series
  where id is not null and obs_time is not null and not {_MISS.format("ndvi")} and ndvi between -1 and 1),
g as (select id, unnest(generate_series(min(p), max(p))) p from o group by id)
select id, p as period_no from g anti join o using (id, p)""",
    "p5_near": """
with v as (select id, crs, unnest(flatten(list_filter(rings, lambda r: r is not null))) p from annotations),
c as (select distinct id, (min(p.x) + max(p.x)) / 2 cx, (min(p.y) + max(p.y)) / 2 cy,
  case when upper(crs) like '%UTM%' then (326 * 100 + regexp_extract(crs, 'zone (\\d+)', 1)::int)::varchar else regexp_extract(crs, '(\\d+)$', 1) end k
  from v where crs is not null and p.x is not null and p.y is not null group by id, crs)
select a.id as id_a, b.id as id_b, min(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) distance
from c a join c b on a.k = b.k and a.id < b.id and abs(a.cx - b.cx) <= 250 and (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 62500 group by 1, 2""",
    "p5_pixel_regions": f"with {_IN} select distinct pixel_id, ann_id as region_id from ins",
    "p6_found": " union ".join(f"(select * from ({_SERIES.format(f=f, m=_MISS.format(f))}))" for f in ("ndvi", "ndvi_undist"))
    + f" union select 'scl', pixel_id from xds_pixels where not {_MISS.format('scl')} and scl not between 0 and 11",
}
SQL["p5_found"] = f"select id_a, id_b from ({SQL['p5_near']})"
