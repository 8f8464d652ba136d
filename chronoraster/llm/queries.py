"""Queries of the problems of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contamination import leaked_items
from .packing import fill_report, packed, token_sizes
from .repetition import repetition
from .splits import component_members, grouped_splits, linked_pairs, masked_pixels, random_mate, shared_tile_edges, split_report
from .target_sample import target_report, target_sample

TILE = ["cube_name", "tile_i", "tile_j"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return linked_pairs(random_mate(shared_tile_edges(masked_pixels(_t(spark, d, "xds_pixels")), "id", TILE)))


def p1_members(spark, d):
    """The same components as one row per annotation: what scales where a component is large."""
    return component_members(random_mate(shared_tile_edges(masked_pixels(_t(spark, d, "xds_pixels")), "id", TILE)))


def p1_splits(spark, d):
    return grouped_splits(_t(spark, d, "xds_pixels"), _t(spark, d, "split_shares"))


def p1_report(spark, d):
    return split_report(p1_splits(spark, d), _t(spark, d, "split_shares"))


def p3_found(spark, d):
    return p3_report(spark, d).filter("short").select("cube_name", "cls")


def p3_sample(spark, d):
    return target_sample(_t(spark, d, "patch_index"), _t(spark, d, "patch_targets"))


def p3_report(spark, d):
    return target_report(_t(spark, d, "patch_index"), _t(spark, d, "patch_targets"))


def p7_packed(spark, d):
    return packed(token_sizes(_t(spark, d, "documents")), _t(spark, d, "pack_capacity"))


def p7_report(spark, d):
    return fill_report(p7_packed(spark, d))


def p8_leaks(spark, d):
    return leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark, d):
    return p8_leaks(spark, d).filter(F.col("longest_run") >= 12).select("item_id", "doc_id")


def p9_repetition(spark, d):
    return repetition(_t(spark, d, "documents"))


def p9_found(spark, d):
    return p9_repetition(spark, d).filter(F.col("repeated_share") >= 0.25).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_members, p1_splits, p1_report, p3_found, p3_sample, p3_report, p7_packed, p7_report, p8_found, p8_leaks, p9_found, p9_repetition)}

_TARGET = """
t as (select cube_name g, {c} c, min(cls) cls, greatest(coalesce(max(target_share), 0), 0) share, greatest(max(min_keep), 0) floor_n, greatest(max(sample_size), 0) size
  from patch_targets where cube_name is not null and cls is not null group by 1, 2),
x as (select distinct cube_name g, {c} c, i, j from patch_index where cube_name is not null and cls is not null and i is not null and j is not null),
r as (select t.*, i, j, md5('42:' || g || ':' || c || ':' || i || ':' || j) h from x join t using (g, c)),
k as (select *, row_number() over (partition by g, c order by h, i, j) rn from r),
a as (select g, c, count(*) n from k group by g, c)""".format(c="regexp_replace(lower(cls), '[^\\p{L}\\p{N}]+', '', 'g')")
_DRAWN = """
p as (select *, rn <= floor_n f, (rn - 0.5::double) / nullif(share, 0) prio from k where rn <= size),
q as (select *, row_number() over (partition by g order by f desc, prio asc nulls last, c, h, i, j) seat from p where f or prio is not null),
s as (select * from q where seat <= size)"""
_WORDS = "regexp_extract_all(lower(regexp_replace(text, '\\\\(\\\\|[A-Za-z]+)', ' ', 'g')), '{}')"
_GRAMS = """select {k}, p, list_aggregate(w[p : p + {m}], 'string_agg', ' ') gram from (select {k}, w, unnest(generate_series(1, len(w) - {m})) p from (select {k}, {w} w from {t} where text is not null and {k} is not null))"""

_LINKED = """
with recursive e as (select distinct id, cube_name, tile_i, tile_j from xds_pixels where mask = 1 and id is not null and cube_name is not null and tile_i is not null and tile_j is not null),
n as (select distinct a.id a, b.id b from e a join e b using (cube_name, tile_i, tile_j)),
c as (select a id, a root from n union select c.id, n.b from c join n on c.root = n.a)
"""

SQL = {
    "p1_found": _LINKED + "select id as id_a, root as id_b from c where id < root",
    "p1_members": _LINKED + "select id, min(root) component, count(*) n_members from c group by id having count(*) > 1",
    "p3_found": f"with {_TARGET} select g as cube_name, cls from t left join a using (g, c) where coalesce(n, 0) < greatest(floor_n, round(share * size, 6))",
    "p3_sample": f"with {_TARGET}, {_DRAWN} select g as cube_name, cls, i, j from s",
    "p3_report": f"""with {_TARGET}, {_DRAWN}, d as (select g, c, count(*) m from s group by g, c)
select g as cube_name, cls, share as target_share, floor_n as min_keep, size as sample_size, greatest(floor_n::double, round(share * size, 6)) as wanted,
  coalesce(n, 0)::bigint as available, coalesce(n, 0) < greatest(floor_n, round(share * size, 6)) as short, coalesce(m, 0)::bigint as drawn from t left join a using (g, c) left join d using (g, c)""",
    "p8_found": f"""with d as ({_GRAMS.format(k="doc_id", m=11, t="documents", w=_WORDS.format("[\\p{L}\\p{N}]+"))}), i as ({_GRAMS.format(k="item_id", m=11, t="eval_items", w=_WORDS.format("[\\p{L}\\p{N}]+"))})
select distinct item_id, doc_id from (select distinct item_id, gram from i) join (select distinct doc_id, gram from d) using (gram)""",
    "p9_found": f"""with g as ({_GRAMS.format(k="doc_id", m=7, t="documents", w=_WORDS.format("\\p{L}+"))}),
a as (select doc_id, p from (select *, row_number() over (partition by doc_id, gram order by p) rn from g) where rn > 1),
c as (select doc_id, count(distinct q) n from (select doc_id, unnest(generate_series(p, p + 7)) q from a) group by doc_id),
t as (select doc_id, len({_WORDS.format("\\p{L}+")}) n from documents where text is not null)
select distinct doc_id from c join t using (doc_id) where c.n::double / t.n >= 0.25""",
}
