"""SQL of the reference queries, for DuckDB."""

_BAND = "case when {0} is not null and not isnan({0}) and {0} <> -9999 then {0} end {0}"
_PX = f"""px0 as (select pixel_id, cube_name, scene_id, obs_time::date as date, row_idx, col_idx, x, y, tile_i, tile_j, id, {_BAND.format("b02")}, {_BAND.format("b04")}, {_BAND.format("b08")},
  case when scl not in (-9999, 99, 255) and scl between 0 and 11 then scl::int end scl, case when mask not in (-9999, 99, 255) then mask::int end mask from xds_pixels),
px1 as (select *, least(greatest(b08, 0), 10000) / 10000 n_, least(greatest(b04, 0), 10000) / 10000 r_ from px0),
px as (select * exclude (n_, r_), case when b08 is null or b04 is null then null else greatest(-1, least(1, (n_ - r_) / nullif(n_ + r_, 0))) end ndvi from px1)"""
_CAT = """cat as (select distinct on (scene_id) * from scenes where scene_id is not null order by scene_id)"""
_S2 = _CAT + ", s2 as (select * from cat where satellite = 'sentinel-2')"
_SERIES = "se as (select rec_id, id, obs_time, {} from ndvi_series where id is not null and obs_time is not null)".format(
    ", ".join(f"case when {f} is not null and not isnan({f}) and {f} between -1 and 1 then {f} end {f}" for f in ("ndvi", "ndvi_undist"))
)
_EDGES = """rg as (select id, cube_name, unnest(rings) ring from annotations where rings is not null),
vv as (select id, cube_name, list_filter(ring, lambda v: v is not null and v.x is not null and v.y is not null and not isnan(v.x) and not isnan(v.y)) v from rg where ring is not null),
ed as (select id ann_id, cube_name, v[k].x ax, v[k].y ay, v[case when k = len(v) then 1 else k + 1 end].x bx, v[case when k = len(v) then 1 else k + 1 end].y by_
  from (select *, unnest(generate_series(1, len(v))) k from vv where len(v) > 0)),
bb as (select ann_id, cube_name, min(ax) minx, min(ay) miny, max(ax) maxx, max(ay) maxy from ed group by 1, 2)"""
_CROSS = "case when ((ax <= x and x < bx) or (bx <= x and x < ax)) and ay + (by_ - ay) * ((x - ax) / nullif(bx - ax, 0)) <= y then 1 else 0 end"
_IN = f"""{_PX}, {_EDGES},
cand as (select pixel_id, px.cube_name, x, y, ann_id from px join bb on px.cube_name = bb.cube_name and x between minx and maxx and y between miny and maxy),
ins as (select pixel_id, ann_id from cand join ed using (cube_name, ann_id) group by pixel_id, ann_id having sum({_CROSS}) % 2 = 1),
inside as (select px.*, ann_id from px join ins using (pixel_id))"""
_MEETS = """((by_ <> ay or abs(ay - y) <= 5) and (bx <> ax or abs(ax - x) <= 5)
  and greatest(0, coalesce(least((x - 5 - ax) / nullif(bx - ax, 0), (x + 5 - ax) / nullif(bx - ax, 0)), 0), coalesce(least((y - 5 - ay) / nullif(by_ - ay, 0), (y + 5 - ay) / nullif(by_ - ay, 0)), 0))
   <= least(1, coalesce(greatest((x - 5 - ax) / nullif(bx - ax, 0), (x + 5 - ax) / nullif(bx - ax, 0)), 1), coalesce(greatest((y - 5 - ay) / nullif(by_ - ay, 0), (y + 5 - ay) / nullif(by_ - ay, 0)), 1)))"""
_TOUCH = f"""cand2 as (select pixel_id, px.cube_name, x, y, ann_id from px join bb on px.cube_name = bb.cube_name and x between minx - 10 and maxx + 10 and y between miny - 10 and maxy + 10),
touch as (select pixel_id, ann_id from cand2 join ed using (cube_name, ann_id) group by pixel_id, ann_id having sum({_CROSS}) % 2 = 1 or bool_or({_MEETS}))"""
_DIST = """near0 as (select pixel_id, px.cube_name, x, y, ann_id from px join bb on px.cube_name = bb.cube_name and x between minx - {0} and maxx + {0} and y between miny - {0} and maxy + {0}),
ne as (select *, least(1, greatest(0, coalesce(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0))) t from near0 join ed using (cube_name, ann_id)),
nd as (select pixel_id, ann_id, case when sum({1}) % 2 = 1 then 0 else sqrt(min((ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * (by_ - ay) - y) * (ay + t * (by_ - ay) - y))) end dist from ne group by pixel_id, ann_id),
near as (select px.*, ann_id, dist from px join nd using (pixel_id) where dist <= {0})"""
_GATED = """own as (select ann_id, {0}, case when coalesce(100.0 * count(*) filter (ok and good) / nullif(count(*) filter (ok), 0), 0) >= 70 then avg(ndvi) filter (ok and good) end mean,
  case when coalesce(100.0 * count(*) filter (ok and good) / nullif(count(*) filter (ok), 0), 0) >= 70 then median(ndvi) filter (ok and good) end median, count(*) filter (ok) n
  from (select *, scl is not null and ndvi is not null ok, scl not in (0, 1, 2, 3, 8, 9, 10, 11) good from inside) group by ann_id, {0})"""
_REACH = "greatest(100, (select max(sqrt(power(width * geotransform.a, 2) + power(height * geotransform.e, 2))) from cat))"
_LADDER = f"""rad as (select 100 * power(1.5, k) radius from (select unnest(generate_series(0, greatest(7, ceil(ln({_REACH} / 100) / ln(1.5))::int))) k)),
vp as (select own.ann_id, own.date, bb.cube_name, pixel_id, x, y, ndvi from own join bb using (ann_id) join px on px.cube_name = bb.cube_name and px.date = own.date where scl = 4 and ndvi is not null),
vt as (select *, least(1, greatest(0, coalesce(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0))) t from vp join ed using (cube_name, ann_id)),
veg as (select ann_id, date, pixel_id, any_value(ndvi) ndvi, case when sum({_CROSS}) % 2 = 1 then 0 else sqrt(min((ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * (by_ - ay) - y) * (ay + t * (by_ - ay) - y))) end dist from vt group by 1, 2, 3),
need as (select ann_id, date, greatest(1, 5 * n) want from own),
cnt as (select need.ann_id, need.date, radius, want, count(*) filter (dist <= radius) c, count(*) filter (dist <= 337.5) c_first from need join veg using (ann_id, date) cross join rad group by all),
pick as (select ann_id, date, min(radius) radius from cnt where c >= want and c_first > 0 group by 1, 2),
lad as (select own.ann_id, own.date, pick.radius, avg(ndvi) mean, median(ndvi) median from own left join pick using (ann_id, date) left join veg on veg.ann_id = own.ann_id and veg.date = own.date and dist <= pick.radius group by all)"""


def _ring(inner: float, outer: float, half: float = 5.0) -> str:
    """touching: pixel_id, ann_id of the squares with a part beyond ``inner`` and a part within ``outer``."""
    near = lambda px, py: f"power(ax + greatest(0, least(1, coalesce((({px} - ax) * (bx - ax) + ({py} - ay) * (by_ - ay)) / nullif(power(bx - ax, 2) + power(by_ - ay, 2), 0), 0))) * (bx - ax) - ({px}), 2) + power(ay + greatest(0, least(1, coalesce((({px} - ax) * (bx - ax) + ({py} - ay) * (by_ - ay)) / nullif(power(bx - ax, 2) + power(by_ - ay, 2), 0), 0))) * (by_ - ay) - ({py}), 2)"
    cross = lambda px, py: f"case when ((ax <= {px} and {px} < bx) or (bx <= {px} and {px} < ax)) and ay + (by_ - ay) * (({px} - ax) / nullif(bx - ax, 0)) <= {py} then 1 else 0 end"
    spots = [(f"(x + {a * half})", f"(y + {b * half})") for a, b in ((0, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))]
    each = ", ".join(f"case when sum({cross(*p)}) % 2 = 1 then 0 else sqrt(min({near(*p)})) end d{k}" for k, p in enumerate(spots))
    return f"""sq as (select pixel_id, px.cube_name, x, y, ann_id from px join bb on px.cube_name = bb.cube_name and x between minx - {outer + 10} and maxx + {outer + 10} and y between miny - {outer + 10} and maxy + {outer + 10}),
sd as (select pixel_id, ann_id, {each}, bool_or({_MEETS}) meets, sqrt(min(power(greatest(0, abs(ax - x) - {half}), 2) + power(greatest(0, abs(ay - y) - {half}), 2))) de from sq join ed using (cube_name, ann_id) group by 1, 2),
touching as (select pixel_id, ann_id from sd where greatest(d0, d1, d2, d3, d4) > {inner} and (meets or least(d0, d1, d2, d3, d4, de) <= {outer}))"""


_RINGS = """ri as (select id ann_id, rid, v from (select id, rid, list_filter(rings[rid], lambda v: v is not null and v.x is not null and v.y is not null and not isnan(v.x) and not isnan(v.y)) v
  from (select *, unnest(generate_series(1, len(rings))) rid from annotations where rings is not null) where rings[rid] is not null) where len(v) >= 3),
re as (select ann_id, rid, v[1].x fx, v[1].y fy, v[k].x ax, v[k].y ay, v[case when k = len(v) then 1 else k + 1 end].x bx, v[case when k = len(v) then 1 else k + 1 end].y by_ from (select *, unnest(generate_series(1, len(v))) k from ri)),
rf as (select distinct ann_id, rid, fx, fy from re),
rp as (select f.ann_id, f.rid, e.rid other, sum(case when ((ax <= f.fx and f.fx < bx) or (bx <= f.fx and f.fx < ax)) and ay + (by_ - ay) * ((f.fx - ax) / nullif(bx - ax, 0)) <= f.fy then 1 else 0 end) % 2 odd
  from rf f join re e on e.ann_id = f.ann_id and e.rid <> f.rid group by 1, 2, 3),
sg as (select rf.ann_id, rf.rid, case when coalesce(sum(odd), 0) % 2 = 1 then -1 else 1 end s from rf left join rp using (ann_id, rid) group by 1, 2),
wa as (select ann_id, sum(s * a) area from (select ann_id, rid, abs(sum((bx - ax) * ((ay - fy) + (by_ - fy)) / 2)) a from re group by 1, 2) join sg using (ann_id, rid) group by 1),
pw as (select g.cube_name, i, j, ann_id, t.c + i * t.a wx0, t.f + j * t.e + h * t.e wy0, t.c + i * t.a + w * t.a wx1, t.f + j * t.e wy1
  from grid g join (select cube_name, max(geotransform) t from s2 group by 1) using (cube_name) join bb on bb.cube_name = g.cube_name and minx <= t.c + i * t.a + w * t.a and maxx >= t.c + i * t.a and miny <= t.f + j * t.e and maxy >= t.f + j * t.e + h * t.e),
c1 as (select cube_name, i, j, ann_id, rid, wy1 - wy0 hi, ax, ay, (by_ - ay) / nullif(bx - ax, 0) m, wy0, greatest(wx0, least(wx1, ax)) x0, greatest(wx0, least(wx1, bx)) x1 from pw join re using (ann_id)),
c2 as (select *, ay + (x0 - ax) * m - wy0 y0, ay + (x1 - ax) * m - wy0 y1 from c1 where x0 <> x1),
c3 as (select *, case when y0 <= 0 then 0 when y0 <= hi then y0 * y0 / 2 else hi * hi / 2 + hi * (y0 - hi) end u0, case when y1 <= 0 then 0 when y1 <= hi then y1 * y1 / 2 else hi * hi / 2 + hi * (y1 - hi) end u1 from c2),
c4 as (select cube_name, i, j, ann_id, rid, abs(sum((x1 - x0) * case when abs(y1 - y0) < 1e-9 then greatest(0, least(hi, (y0 + y1) / 2)) else (u1 - u0) / (y1 - y0) end)) a from c3 group by 1, 2, 3, 4, 5),
ov as (select cube_name, i, j, ann_id, sum(s * a) / nullif(max(area), 0) share from c4 join sg using (ann_id, rid) join wa using (ann_id) where area > 0 group by 1, 2, 3, 4)"""
_RANK = "case {0} when 'B01' then 1 when 'B02' then 2 when 'B03' then 3 when 'B04' then 4 when 'B05' then 5 when 'B06' then 6 when 'B07' then 7 when 'B08' then 8 when 'B8A' then 9 when 'B09' then 10 when 'B10' then 11 when 'B11' then 12 when 'B12' then 13 when 'SCL' then 100 else 2147483647 end"
_GRID = f"""{_S2}, ra as (select cube_name, max(width) w, max(height) h from s2 group by 1),
grid as (select cube_name, i::int i, j::int j, least({{0}}, w - i)::int w, least({{0}}, h - j)::int h from (select *, unnest(generate_series(0, h - 1, {{1}})) j from (select *, unnest(generate_series(0, w - 1, {{1}})) i from ra)))"""
_CLASS = """cl as (select g.cube_name, g.i, g.j, g.w, g.h, case when coalesce(sum(p.mask), 0) <> 0 then 'Annotation' else 'No-Annotation' end cls from grid g
  left join px p on p.cube_name = g.cube_name and p.col_idx >= g.i and p.col_idx < g.i + {0} and p.row_idx >= g.j and p.row_idx < g.j + {0} group by all)"""
_SAMPLE = """with {grid}, {px}, {cls},
n as (select cube_name, floor(count(*) filter (cls = 'Annotation') * {ratio}::double) want from cl group by 1),
o as (select *, row_number() over (partition by cube_name order by md5('42:' || cube_name || ':' || i || ':' || j), i, j) rn from cl where cls <> 'Annotation')
select cube_name, i, j, cls from cl where cls = 'Annotation' union all select o.cube_name, i, j, cls from o join n using (cube_name) where rn <= want"""


_BEST = """with dy as (select o_custkey ann_id, o_orderdate::date d, sum(floor(o_totalprice)) w, min(o_orderkey) o from orders group by 1, 2),
n as (select *, case when date_diff('day', lag(d) over (partition by ann_id order by d), d) <= 40 then 0 else 1 end nw from dy),
r as (select *, sum(nw) over (partition by ann_id order by d) run from n),
g as (select ann_id, run, sum(w) w, min(o) o, sum(date_diff('day', date '1970-01-01', d) * w) dw from r group by 1, 2)
select ann_id, date '1970-01-01' + floor(dw / nullif(w, 0))::int best_date from (select *, row_number() over (partition by ann_id order by w desc, o) rn from g) where rn = 1"""
_EVENT = f"""with {_S2}, s as (select cube_name, scene_id, scene_date from s2 where scene_date is not null), e as (select id, cube_name, pre_date, post_date from annotations where id is not null and pre_date is not null and post_date is not null),
a as (select id, scene_id from (select id, scene_id, row_number() over (partition by id order by abs(date_diff('day', scene_date, pre_date)), scene_date, scene_id) rn from e join s using (cube_name)) where rn = 1),
b as (select id, scene_id from (select id, scene_id, row_number() over (partition by id order by abs(date_diff('day', scene_date, post_date)), scene_date, scene_id) rn from e join s using (cube_name)) where rn = 1),
x as (select e.id, a.scene_id pa, b.scene_id pb, s.scene_id, row_number() over (partition by e.id order by md5('42:' || s.scene_id), s.scene_id) rn from e join a on a.id = e.id join b on b.id = e.id join s using (cube_name) where s.scene_id <> a.scene_id and s.scene_id <> b.scene_id),
ev as (select id, 'pre' as role, scene_id from a union all select b.id, 'post', b.scene_id from b join a using (id) where a.scene_id <> b.scene_id union all select id, 'extra', scene_id from x where rn <= 6 - case when pa = pb then 1 else 2 end)
"""


def _median_window(v: str) -> str:
    return f"median({v}) over (partition by id order by obs_time, rec_id rows between 2 preceding and 2 following)"


SQL = {
    "scene_catalogue": f"with {_CAT} select scene_id, satellite, orbit, cube_name, scene_date, cardinality(band_paths)::int n_bands from cat",
    "band_parse": f"""with {_CAT}, b as (select scene_id, unnest(map_entries(band_paths)) e from cat),
f as (select scene_id, e.key band, e.value path, regexp_replace(e.value, '\\.[^.]*$', '') stem from b), g as (select *, string_split(stem, '_') t from f),
h as (select *, case when scene_id like 's2%' then array_to_string(t[1:len(t) - 1], '_') else array_to_string(t[1:len(t) - 2], '_') end fs from g)
select scene_id, band, nullif(regexp_extract(path, '(B\\d+[A-Z]?|SCL)\\.tif', 1), '') s2_band, nullif(upper(regexp_extract(path, '(vv|vh).*\\.tif', 1)), '') s1_band, {_RANK.format("band")} as rank,
  case when band = 'SCL' then 100 else coalesce(nullif(regexp_extract(band, '(\\d+)', 1), '')::int, 2147483647) end digits_rank,
  case when scene_id like 's2%' then try_strptime(string_split(fs, '_')[-1], '%Y%m%d')::date else try_strptime(regexp_extract(stem, '(\\d{{8}})', 1), '%Y%m%d')::date end file_date,
  fs as file_scene, case when stem like '%asc%' then 'asc' when stem like '%dsc%' then 'dsc' end file_orbit from h""",
    "band_parse_old": f"""with {_CAT}, b as (select scene_id, unnest(map_entries(band_paths)) e from cat), f as (select scene_id, e.key band, e.value path, regexp_replace(regexp_extract(e.value, '[^/]*$'), '\\.[^.]*$', '') stem from b)
select scene_id, band, nullif(regexp_extract(path, '(B\\d+[A-Z]?|SCL|NDVI|NDWI)\\.tif', 1), '') s2_band, nullif(regexp_extract(path, '(vv|vh).*\\.tif', 1), '') s1_band, try_strptime(upper(string_split(stem, '_')[5]), '%Y%m%dT%H%M%S') old_time from f""",
    "band_lookup": f"""with {_CAT}, b as (select scene_id, unnest(map_keys(band_paths)) band from cat where trunc(geotransform.a) = 10), f as (select scene_id, arg_min(band, ({_RANK.format("band")}, band)) band from b group by 1)
select scene_id, band_paths['B04'] b04_path, band from cat left join f using (scene_id)""",
    "cube_date_range": f"with {_CAT} select cube_name, satellite, min(scene_date) as first, max(scene_date) as last, count(*) n from cat where scene_date is not null group by 1, 2",
    "incomplete_scenes": f"with {_S2}, m as (select scene_id, list_filter(['B02', 'B04', 'B08', 'SCL'], lambda b: not list_contains(coalesce(map_keys(band_paths), []), b)) m from s2) select scene_id, array_to_string(list_sort(m), ',') missing from m where len(m) > 0",
    "scene_resolution": f"with {_CAT} select scene_id, trunc(geotransform.a)::int x_res, trunc(-geotransform.e)::int y_res, trunc(width * (geotransform.a / 20.0))::int width_20m, trunc(height * (geotransform.a / 20.0))::int height_20m from cat",
    "scene_removed": f"with {_S2} select cube_name, scene_id from (select *, row_number() over (partition by cube_name order by scene_date nulls last, scene_id) rn from s2) where rn <> 1",
    "sensors_united": f"with {_CAT} select cube_name, count(case when satellite = 'sentinel-1' then orbit end) n_orbit, count(case when satellite = 'sentinel-2' then height end) n_height, count(*) n from cat where satellite in ('sentinel-1', 'sentinel-2') group by 1",
    "bad_pixel_ratio": f"with {_PX} select scene_id, (100.0::double * sum(case when scl in (0, 1, 2, 3, 8, 9, 10, 11) then 1 else 0 end)) / count(*) bad_ratio from px group by 1",
    "time_mask": f"with {_PX} select scene_id, coalesce(count(case when scl in (4, 5, 6) then 1 end) > 0.5 * count(scl), false) as valid from px group by 1",
    "closest_image": f"""with {_S2}, c as (select id, scene_id, scene_date, row_number() over (partition by id order by abs(date_diff('day', scene_date, pre_date)), scene_date, scene_id) rn
  from annotations a join s2 using (cube_name) where pre_date is not null and scene_date is not null)
select a.id, a.cube_name, a.pre_date, c.scene_id as nearest_scene_id, c.scene_date as nearest_date from annotations a left join c on a.id = c.id and rn = 1""",
    "monthly_timeseries": f"""with {_S2}, {_PX}, br as (select scene_id, 100.0::double * sum(case when scl in (0, 1, 2, 3, 8, 9, 10, 11) then 1 else 0 end) / count(*) q from px group by 1),
k as (select s2.cube_name, s2.scene_id, scene_date, q, date_trunc('month', scene_date) mo from s2 left join br using (scene_id) where scene_date is not null),
m as (select cube_name, greatest(1, 70 // count(distinct mo)) k from k group by 1),
ra as (select k.*, m.k, row_number() over (partition by cube_name, mo order by q nulls last, scene_date, scene_id) rn from k join m using (cube_name)),
be as (select cube_name, scene_id, scene_date from ra where rn <= k), nb as (select cube_name, count(*) n from be group by 1),
ot as (select *, row_number() over (partition by cube_name order by md5('42:' || scene_id), scene_id) r2 from ra where rn > k),
ch as (select * from be union all select ot.cube_name, scene_id, scene_date from ot join nb using (cube_name) where r2 <= 70 - n),
en as (select cube_name, min((scene_date, scene_id)) a, max((scene_date, scene_id)) b, greatest(0, 70 - (select count(*) from ch where ch.cube_name = k.cube_name)) miss from k group by cube_name),
pa as (select cube_name, unnest([{{'s': a, 'c': miss // 2}}, {{'s': b, 'c': miss - miss // 2}}]) p from en),
al as (select cube_name, scene_id, scene_date, false padding, 1 c from ch union all select cube_name, p.s[2], p.s[1], true, p.c from pa where p.c > 0)
select cube_name, scene_id, scene_date, padding, sum(c)::bigint copies from al group by 1, 2, 3, 4""",
    "timeseries_pad": f"""with {_S2}, k as (select cube_name, scene_id, scene_date from s2 where scene_date is not null), ch as (select * from k),
en as (select cube_name, min((scene_date, scene_id)) a, max((scene_date, scene_id)) b, greatest(0, 70 - (select count(*) from ch where ch.cube_name = k.cube_name)) miss from k group by cube_name),
pa as (select cube_name, unnest([{{'s': a, 'c': miss // 2}}, {{'s': b, 'c': miss - miss // 2}}]) p from en),
al as (select cube_name, scene_id, false padding, 1 c from ch union all select cube_name, p.s[2], true, p.c from pa where p.c > 0)
select cube_name, scene_id, padding, sum(c)::bigint copies from al group by 1, 2, 3""",
    "event_timeseries": _EVENT + "select id, role, scene_id from ev",
    "event_timeseries_padded": _EVENT.replace("rn <= 6 -", "rn <= 150 -") + """, nn as (select id, 150 - count(*) miss from ev group by 1), en as (select cube_name, min((scene_date, scene_id)) a, max((scene_date, scene_id)) b from s group by 1),
pd as (select id, unnest([{'k': a[2], 'c': miss // 2}, {'k': b[2], 'c': miss - miss // 2}]) p from nn join e using (id) join en using (cube_name) where miss > 0)
select id, role, scene_id, count(*)::bigint copies from ev group by 1, 2, 3 union all select id, 'padding', p.k, sum(p.c)::bigint from pd where p.c > 0 group by 1, 2, 3""",
    "ndvi_current": f"with {_PX} select pixel_id, ndvi from px",
    "ndvi_old": f"with {_PX} select pixel_id, coalesce((b08 - b04) / nullif(b08 + b04, 0), 0) ndvi from px",
    "ndwi": f"with {_PX} select pixel_id, (coalesce(b08, 0) - coalesce(b02, 0)) / (coalesce(b08, 0) + coalesce(b02, 0) + 1e-10) ndwi from px",
    "cross_ratio": "select l_orderkey scene, l_linenumber pixel, (max(l_quantity) / 100) / (max(l_extendedprice) / 1e5) cr from lineitem group by 1, 2",
    "linear_to_db": "select l_orderkey scene, l_linenumber pixel, round(10 * log10(nullif(max(l_quantity) / 100, 0)), 6) db from lineitem group by 1, 2",
    "mean_sar": "select scene, round(avg(vv), 9) vv, round(avg(vh), 9) vh from (select l_orderkey scene, max(l_extendedprice) / 1e5 vv, max(l_quantity) / 100 vh from lineitem group by l_orderkey, l_linenumber) group by 1",
    "minmax": f"with {_PX}, a as (select scene_id, min(b04) a, max(b04) - min(b04) b from px group by 1) select pixel_id, (b04 - a) / nullif(b, 0) scaled from px join a using (scene_id)",
    "minmax_global": f"with {_PX}, a as (select min(b04) a, max(b04) - min(b04) b from px) select pixel_id, (b04 - a) / nullif(b, 0) scaled from px cross join a",
    "indices_added": f"with {_PX} select pixel_id, ndvi as \"NDVI\", (coalesce(b08, 0) - coalesce(b02, 0)) / (coalesce(b08, 0) + coalesce(b02, 0) + 1e-10) as \"NDWI\" from px",
    "zscore": f"with {_PX}, a as (select scene_id, avg(b04) a, stddev_pop(b04) b from px group by 1) select pixel_id, round((b04 - a) / nullif(b, 0), 6) scaled from px join a using (scene_id)",
    "contrast_stretch": f"with {_PX}, a as (select cube_name, quantile_cont(b04, 0.04) a, quantile_cont(b04, 0.92) b from px group by 1) select pixel_id, round((b04 - a) / nullif(b - a, 0), 6) stretched from px join a using (cube_name)",
    "histogram_300": f"with {_PX}, a as (select cube_name, min(b04) lo, max(b04) hi from px where b04 is not null group by 1) select cube_name, least(299, floor(coalesce((b04 - lo) * 300 / nullif(hi - lo, 0), 0)))::int as bin, count(*) n from px join a using (cube_name) where b04 is not null group by 1, 2",
    "stacked_bands": f"with {_PX} select scene_id, row_idx, col_idx, max(b02) b02, max(b04) b04 from px where scene_id is not null group by 1, 2, 3 having max(b02) is not null or max(b04) is not null",
    "tile_round_trip": f"with {_PX} select scene_id, col_idx, row_idx, max(b04) b04, max(b08) b08 from px where scene_id is not null group by 1, 2, 3 having max(b04) is not null or max(b08) is not null",
    "resample_bilinear": f"""with {_PX}, c as (select scene_id, row_idx r, col_idx c, max(b04) b04, max(scl) scl from px where scene_id is not null and row_idx is not null and col_idx is not null group by 1, 2, 3),
n as (select *, unnest(generate_series(2 * c - 1, 2 * c + 2)) nc from c), m as (select *, unnest(generate_series(2 * r - 1, 2 * r + 2)) nr from n),
w as (select *, (1 - abs((nc + 0.5) / 2 - 0.5 - c)) * (1 - abs((nr + 0.5) / 2 - 0.5 - r)) w from m where nc >= 0 and nr >= 0)
select scene_id, nc::int col_idx, nr::int row_idx, round(sum(w * b04) / nullif(sum(w) filter (b04 is not null), 0), 6) b04, arg_max(scl, (w, -r, -c)) filter (scl is not null) scl from w where w > 0 group by 1, 2, 3""",
    "geotiff_pixels": f"""with {_PX}, {_CAT} select scene_id, scene_date as date, geotransform.c + (col_idx + 0.5) * geotransform.a x, geotransform.f + (row_idx + 0.5) * geotransform.e y, max(b04) b04, max(b08) b08
from px join cat using (scene_id) where geotransform is not null group by 1, 2, 3, 4 having max(b04) is not null or max(b08) is not null""",
    "stack_aligned": f"""with {_PX}, {_CAT}, b as (select scene_id, row_idx i, col_idx j, max(b04) v from px join cat using (scene_id) where geotransform is not null and row_idx < height and col_idx < width group by 1, 2, 3 having max(b04) is not null),
f as (select scene_id, row_idx // 2 i, col_idx // 2 j, max(b08) v from px join cat using (scene_id) where geotransform is not null group by 1, 2, 3 having max(b08) is not null),
h as (select distinct scene_id from px where b04 is not null), n as (select *, unnest(generate_series(2 * i - 1, 2 * i + 2)) ni from f), m as (select *, unnest(generate_series(2 * j - 1, 2 * j + 2)) nj from n),
w as (select m.scene_id, ni, nj, v, (1 - abs((ni + 0.5) / 2 - 0.5 - i)) * (1 - abs((nj + 0.5) / 2 - 0.5 - j)) w from m join h using (scene_id) join cat using (scene_id) where ni between 0 and height - 1 and nj between 0 and width - 1),
a as (select scene_id, ni row_idx, nj col_idx, sum(w * v) / sum(w) v from w group by 1, 2, 3 union all select scene_id, i, j, v from f join cat using (scene_id) where scene_id not in (select scene_id from h) and i < ceil(height / 2) and j < ceil(width / 2))
select coalesce(a.scene_id, b.scene_id) scene_id, coalesce(b.i, row_idx)::int row_idx, coalesce(b.j, col_idx)::int col_idx, b.v as "B04", round(a.v, 6) as "B11" from a full join b on a.scene_id = b.scene_id and a.row_idx = b.i and a.col_idx = b.j""",
    "patch_window": f"""with {_PX}, {_CAT}, c as (select scene_id, col_idx // 32 ti, row_idx // 32 tj, col_idx % 32 u, row_idx % 32 v, max(b04) b from px join cat using (scene_id) where geotransform is not null group by all)
select scene_id || '/' || ti || '_' || tj as path, 'b04' as band, 256 as n, sum(b) total from c where u between 4 and 19 and v between 4 and 19 group by scene_id, ti, tj having coalesce(sum(b), 0) <> 0""",
    "annotation_boxes": """with g as (select id, flatten(list_filter(rings, lambda r: r is not null)) v, rings, crs from annotations),
b as (select id, list_min(list_transform(v, lambda p: p.x)) x0, list_min(list_transform(v, lambda p: p.y)) y0, list_max(list_transform(v, lambda p: p.x)) x1, list_max(list_transform(v, lambda p: p.y)) y1, crs,
  len(list_filter(coalesce(rings, []), lambda r: len(list_distinct(r)) >= 3)) n from g)
select id, x0 - 5 minx, y0 - 5 miny, x1 + 5 maxx, y1 + 5 maxy, case when upper(crs) like '%UTM%' then (32600 + regexp_extract(crs, 'zone (\\d+)', 1)::int)::varchar else nullif(regexp_extract(crs, '(\\d+)$', 1), '') end crs_code, n::int n_rings from b""",
    "pixel_in_annotation": f"with {_IN} select pixel_id, ann_id from ins",
    "pixel_touches_annotation": f"with {_IN}, {_TOUCH} select pixel_id, ann_id from touch",
    "rasterize_mask": f"with {_IN} select pixel_id, max(case when ins.ann_id is null then 0 else 1 end)::tinyint as value from px left join ins using (pixel_id) group by 1",
    "mask_attached": f"with {_PX}, m as (select cube_name, row_idx, col_idx, max(mask) v from px where mask is not null group by 1, 2, 3) select pixel_id, v as mask_value from px left join m using (cube_name, row_idx, col_idx)",
    "zonal_ndvi_gated": f"with {_IN}, {_GATED.format('scene_id')} select ann_id, scene_id, round(mean, 6) mean, round(median, 6) median, n from own",
    "ring_ndvi": f"""with {_IN}, {_TOUCH}, {_ring(10, 200)},
o as (select ann_id, date, coalesce(count(case when scl in (4, 5, 6) then 1 end) > 0.5 * count(scl), false) ok, avg(ndvi) v from px join touch using (pixel_id) group by 1, 2),
g as (select ann_id, date, avg(ndvi) filter (scl = 4) v from px join touching using (pixel_id) group by 1, 2)
select o.ann_id, o.date, case when ok then round(o.v, 6) end ndvi, case when ok then round(g.v, 6) end ndvi_undist from o left join g using (ann_id, date)""",
    "buffer_ladder_ndvi": f"with {_IN}, {_CAT}, {_GATED.format('date')}, {_LADDER} select ann_id, date, radius, round(mean, 6) mean, round(median, 6) median from lad",
    "dating_map": f"with {_IN}, {_CAT}, {_GATED.format('date')}, {_LADDER} select ann_id, date, round(own.mean, 6) ann_mean, round(own.median, 6) ann_median, round(lad.mean, 6) buf_mean, round(lad.median, 6) buf_median from own full join lad using (ann_id, date)",
    "spectral_signature": f"with {_IN} " + " union all ".join(f"select ann_id, date, '{b}' as band, round(coalesce(avg(case when {b} > 0 then {b} end), 0), 6) mean from inside group by 1, 2" for b in ("b02", "b04", "b08")),
    "band_means": f"with {_IN} " + " union all ".join(f"select ann_id, '{b}' as band, round(avg({b}), 6) mean from inside group by 1" for b in ("b02", "b04", "b08")),
    "signature_pivot": f"with {_IN}, l as (select ann_id, strftime(date, '%Y%m%d') d, round(coalesce(avg(case when b04 > 0 then b04 end), 0), 6) m from inside group by 1, 2), a as (select distinct strftime(date, '%Y%m%d') d from px where date is not null),"
    " q as (select coalesce(l.d, a.d) d, ann_id, m from l full join a using (d)) select * from (pivot q on d using max(m) group by ann_id) where ann_id is not null",
    "scl_histogram": f"with {_IN} select ann_id, scl, count(*) n from inside where scl is not null group by 1, 2",
    "ann_bad_pixel_filter": f"with {_IN}, q as (select ann_id, 100.0::double * sum(case when scl in (0, 1, 2, 3, 8, 9, 10, 11) then 1 else 0 end) / count(*) bad_ratio from inside where scl is not null group by 1) select *, bad_ratio <= 30 as keep from q",
    "class_ring": f"with {_IN}, {_DIST.format(100, _CROSS)} select ann_id, min(greatest(10, ceil(dist / 10) * 10))::double ring from near where dist > 0 and scl = 4 group by 1",
    "nearby_ndvi": f"with {_IN}, {_DIST.format(100, _CROSS)}, q as (select ann_id, min(greatest(10, ceil(dist / 10) * 10)) ring from near where dist > 0 and scl = 4 group by 1), m as (select ann_id, avg(ndvi) v from near join q using (ann_id) where dist > 0 and scl = 4 and dist <= ring group by 1) select distinct id as ann_id, round(coalesce(v, 0), 6) mean from annotations left join m on m.ann_id = id",
    "extent_pixels": f"with {_PX} select distinct pixel_id, a.id as ann_id from px join annotations a on a.cube_name = px.cube_name and px.x >= least(a.minx, a.maxx) and px.x < greatest(a.minx, a.maxx) and px.y >= least(a.miny, a.maxy) and px.y < greatest(a.miny, a.maxy)",
    "despike": f"""with {_SERIES}, a as (select *, {_median_window("ndvi")} med from se), b as (select *, abs(ndvi - med) dev from a), c as (select *, {_median_window("dev")} mad from b)
select rec_id, case when (mad = 0 and dev > 0) or 0.6745 * dev / nullif(mad, 0) > 2 then med else ndvi end ndvi_despiked from c""",
    "cdndvi": f"with {_SERIES} select rec_id, round(avg(ndvi_undist) over w - avg(ndvi) over w, 6) cdndvi from se window w as (partition by id order by obs_time, rec_id rows between 2 preceding and 2 following)",
    "slope_changes": f"""with {_SERIES}, dy as (select id, obs_time::date as date, avg(ndvi) c from se where ndvi is not null group by 1, 2),
s as (select *, (lead(c) over w - c) / date_diff('day', date, lead(date) over w) s, row_number() over w i from dy window w as (partition by id order by date)),
t as (select *, avg(s) over b m, stddev_samp(s) over b sd, count(s) over b n, lead(s, 1) over w a1, lead(s, 2) over w a2, lead(s, 3) over w a3 from s
  window w as (partition by id order by date), b as (partition by id order by date rows between 5 preceding and current row))
select id, date from t where n = 6 and i > 6 and s > m + sd and a1 > m and a2 > m and a3 > m""",
    "best_date": _BEST,
    "patch_grid": f"with {_GRID.format(100, 64)} select cube_name, i, j, w, h from grid",
    "patch_classify": f"with {_GRID.format(64, 64)}, {_PX}, {_CLASS.format(64)} select * from cl",
    "patch_classify_overlapping": f"with {_GRID.format(100, 64)}, {_PX}, {_CLASS.format(100)} select * from cl",
    "patch_sample": _SAMPLE.format(grid=_GRID.format(64, 64), px=_PX, cls=_CLASS.format(64), ratio=0.3),
    "patch_ratio_sample": _SAMPLE.format(grid=_GRID.format(64, 64), px=_PX, cls=_CLASS.format(64), ratio=30 / 70),
    "patch_balance": f"""with {_GRID.format(64, 64)}, {_EDGES}, {_RINGS}, hd as (select cube_name, i, j, count(distinct ann_id) n from ov where share >= 0.1 group by 1, 2, 3),
t as (select g.cube_name, g.i, g.j, coalesce(n, 0) n_ann from grid g left join hd using (cube_name, i, j)),
s as (select *, sum(n_ann) over w p, sum((n_ann = 0)::int) over w e from t window w as (partition by cube_name order by i, j)),
k as (select *, min(case when n_ann = 0 then greatest(1, (p + 3) // 4) - e end) over (partition by cube_name order by i, j) low from s),
q as (select *, case when e > 0 then least(e, e + low) else 0 end nn from k)
select cube_name, i, j, n_ann from (select *, coalesce(lag(nn) over (partition by cube_name order by i, j), 0) before from q) where n_ann > 0 or nn > before""",
    "patch_arrays": f"""with {_GRID.format(64, 64)}, {_PX}, c as (select cube_name, (col_idx // 64) * 64 i, (row_idx // 64) * 64 j, date, row_idx, col_idx, max(b02) b02, max(b04) b04, max(b08) b08, max(scl) scl, max(mask) mask from px group by all)
select cube_name, i, j, date, band, 4096 as n, sum(coalesce(v, 0)) total from (select cube_name, i, j, date, unnest(['b02', 'b04', 'b08', 'scl', 'mask']) band, unnest([b02, b04, b08, scl::double, mask::double]) v from c join grid using (cube_name, i, j)) group by 1, 2, 3, 4, 5""",
    "patch_arrays_overlapping": f"""with {_GRID.format(100, 64)}, {_PX}, c as (select px.cube_name, i, j, date, row_idx, col_idx, max(b04) b04, max(mask) mask from grid join px on px.cube_name = grid.cube_name and col_idx >= i and col_idx < i + 100 and row_idx >= j and row_idx < j + 100 group by all)
select cube_name, i, j, date, band, 10000 as n, sum(coalesce(v, 0)) total from (select cube_name, i, j, date, unnest(['b04', 'mask']) band, unnest([b04, mask::double]) v from c) group by 1, 2, 3, 4, 5""",
    "patch_extent": f"""with {_GRID.format(64, 64)}, tr as (select cube_name, max(geotransform) t from s2 group by 1)
select cube_name, i, j, t.c + i * t.a minx, t.f + j * t.e + h * t.e miny, t.c + i * t.a + w * t.a maxx, t.f + j * t.e maxy from grid join tr using (cube_name)""",
    "annotation_overlap": f"with {_GRID.format(64, 64)}, {_EDGES}, {_RINGS} select cube_name, i, j, ann_id, round(share, 4) share from ov where share >= 0.1",
    "window_best_date": f"with {_GRID.format(64, 64)}, {_EDGES}, {_RINGS}, bd as ({_BEST}) select cube_name, i, j, ov.ann_id, best_date from ov left join bd on bd.ann_id = ov.ann_id where share > 1e-9",
    "window_dates_missing": f"with {_GRID.format(64, 64)}, {_EDGES}, {_RINGS}, bd as ({_BEST}) select ann_id, count(*) n_windows from ov where share > 1e-9 and ann_id not in (select ann_id from bd where best_date is not null) group by 1",
    "scene_chunks": f"with {_CAT} select scene_id, ((row_number() over (order by scene_id) - 1) % 7) as chunk from cat",
    "pipeline_patches": f"""with {_GRID.format(64, 64)}, {_PX}, {_CLASS.format(64)}, n as (select cube_name, floor(count(*) filter (cls = 'Annotation') * 0.3::double) want from cl group by 1),
o as (select *, row_number() over (partition by cube_name order by md5('42:' || cube_name || ':' || i || ':' || j), i, j) rn from cl where cls <> 'Annotation'),
k as (select cube_name, i, j, cls from cl where cls = 'Annotation' union all select o.cube_name, i, j, cls from o join n using (cube_name) where rn <= want),
c as (select cube_name, (col_idx // 64) * 64 i, (row_idx // 64) * 64 j, date, row_idx, col_idx, max(b02) b02, max(b04) b04 from px group by all)
select cube_name, i, j, cls, date, band, 4096 as n, sum(coalesce(v, 0)) total from (select cube_name, i, j, date, unnest(['b02', 'b04']) band, unnest([b02, b04]) v from c) join k using (cube_name, i, j) group by all""",
    "pipeline_change_dates": f"""with {_IN}, {_TOUCH}, {_ring(10, 200)},
o as (select ann_id id, date, coalesce(count(case when scl in (4, 5, 6) then 1 end) > 0.5 * count(scl), false) ok, avg(ndvi) v from px join touch using (pixel_id) group by 1, 2),
g as (select ann_id id, date, avg(ndvi) filter (scl = 4) u from px join touching using (pixel_id) group by 1, 2),
p as (select id, date, v, u from o left join g using (id, date) where ok and v is not null),
a as (select *, median(v) over w med from p window w as (partition by id order by date rows between 2 preceding and 2 following)), b as (select *, abs(v - med) dev from a),
d as (select *, median(dev) over (partition by id order by date rows between 2 preceding and 2 following) mad from b),
e as (select id, date, u, case when (mad = 0 and dev > 0) or 0.6745 * dev / nullif(mad, 0) > 2 then med else v end v from d),
f as (select id, date, avg(u) over w - avg(v) over w c from e window w as (partition by id order by date rows between 2 preceding and 2 following)),
s as (select *, (lead(c) over w - c) / date_diff('day', date, lead(date) over w) s, row_number() over w i from f window w as (partition by id order by date)),
t as (select *, avg(s) over b m, stddev_samp(s) over b sd, count(s) over b n, lead(s, 1) over w a1, lead(s, 2) over w a2, lead(s, 3) over w a3 from s
  window w as (partition by id order by date), b as (partition by id order by date rows between 5 preceding and current row)),
h as (select id, date from t where n = 6 and i > 6 and s > m + sd and a1 > m and a2 > m and a3 > m),
j as (select *, case when date_diff('day', lag(date) over (partition by id order by date), date) <= 40 then 0 else 1 end nw from h), l as (select *, sum(nw) over (partition by id order by date) run from j),
q as (select id, run, count(*) w, min(date) first, avg(date_diff('day', date '1970-01-01', date)) m from l group by 1, 2)
select id as ann_id, date '1970-01-01' + floor(m)::int best_date from (select *, row_number() over (partition by id order by w desc, first) rn from q) where rn = 1""",
}
