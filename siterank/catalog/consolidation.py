"""Consolidation of documented sites (suppliers) with a registry (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import STATE_NAMES, STATES, pick, points, query, rx, sql_pick, sql_points
from siterank.plans import consolidate

SNAP = 4000.0
KINDS = ["oil", "gas", "unknown", "injection"]
STATES_OF = ["idle", "unknown", "undocumented", "abandoned"]


def documented(spark, d):
    k = F.col("s_suppkey")
    return points(spark, d, "supplier", "s_suppkey").select(
        F.concat(F.lit("d"), k.cast("string")).alias("well_id"), F.lit("documented").alias("layer"), F.col("s_name").alias("name"),
        pick(STATE_NAMES, k % 6).alias("state"), pick(STATES, k % 6).alias("state_abbr"), F.lit(None).cast("string").alias("county"),
        pick(KINDS, k % 4).alias("type_norm"), pick(STATES_OF, k % 4).alias("status_norm"), F.lit(False).alias("is_plugged"),
        F.when(k % 3 != 0, F.concat(F.lit("K"), k.cast("string"))).alias("api_number"), F.when(k % 5 == 0, F.col("s_name")).alias("operator"),
        F.when(k % 7 == 0, k.cast("double") * 10).alias("depth_ft"), F.lit(None).cast("string").alias("discovered_via"), "lat", "lon", "ordinal",
    )


def registry(spark, d):
    k = F.col("o_orderkey")
    return points(spark, d, "orders", "o_orderkey").select(
        F.when(k % 4 == 0, F.concat(F.lit("K"), (k % 997).cast("string"))).when(k % 4 == 1, F.lit("")).alias("api_number"),
        pick(KINDS, (k + 1) % 4).alias("type_norm"), pick(STATES_OF, (k + 2) % 4).alias("status_norm"),
        F.when(k % 2 == 0, F.concat(F.lit("OP "), (k % 50).cast("string"))).alias("operator"), F.when(k % 3 == 0, k.cast("double")).alias("depth_ft"),
        "lat", "lon", pick(STATES, k % 6).alias("state_abbr"), pick(STATE_NAMES, k % 6).alias("state"), F.lit(False).alias("is_plugged"),
        F.lit("state").alias("layer"), F.lit("state_x").alias("source"), "ordinal",
    )


_DOC = f"""doc as (select *, {sql_pick(STATES, 'ordinal % 6')} as state_abbr, {sql_pick(KINDS, 'ordinal % 4')} as type_norm, {sql_pick(STATES_OF, 'ordinal % 4')} as status_norm,
  case when ordinal % 3 <> 0 then 'K' || ordinal::varchar end as api_number, case when ordinal % 5 = 0 then s_name end as operator,
  case when ordinal % 7 = 0 then ordinal::double * 10 end as depth_ft from ({sql_points('supplier', 's_suppkey', 's_name')}))"""
_REG = f"""reg as (select *, case when ordinal % 4 = 0 then 'K' || (ordinal % 997)::varchar end as api_number, {sql_pick(KINDS, '(ordinal + 1) % 4')} as type_norm,
  {sql_pick(STATES_OF, '(ordinal + 2) % 4')} as status_norm, case when ordinal % 2 = 0 then 'OP ' || (ordinal % 50)::varchar end as operator,
  case when ordinal % 3 = 0 then ordinal::double end as depth_ft, {sql_pick(STATES, 'ordinal % 6')} as state_abbr from ({sql_points('orders', 'o_orderkey')}))"""
_MATCHED = f"""{_DOC}, {_REG}, keyed as (select reg.*, doc.ordinal as doc_ordinal from reg left join doc on reg.api_number = doc.api_number),
  near as (select k.ordinal, doc.ordinal as doc_ordinal, row_number() over (partition by k.ordinal order by sqrt((k.x - doc.x) * (k.x - doc.x) + (k.y - doc.y) * (k.y - doc.y)), doc.ordinal) as rn
    from keyed k cross join doc where k.doc_ordinal is null and sqrt((k.x - doc.x) * (k.x - doc.x) + (k.y - doc.y) * (k.y - doc.y)) <= 4000.0::double),
  matched as (select k.* exclude (doc_ordinal), coalesce(k.doc_ordinal, near.doc_ordinal) as doc_ordinal,
    case when k.doc_ordinal is not null then 0 when near.doc_ordinal is not null then 1 end as way
    from keyed k left join near on k.ordinal = near.ordinal and near.rn = 1)"""


def _first(c: str, usable: str) -> str:
    return f"(list({c} order by way, ordinal) filter (where {usable}))[1] as r_{c}"


_WORDS = "('unknown', 'undocumented')"
_FILLED = f"""{_MATCHED}, attrs as (select doc_ordinal, {_first('depth_ft', 'depth_ft is not null')}, {_first('operator', 'operator is not null')},
    {_first('type_norm', f'type_norm not in {_WORDS}')}, {_first('status_norm', f'status_norm not in {_WORDS}')} from matched where doc_ordinal is not null group by doc_ordinal),
  att as (select 'd' || doc.ordinal::varchar as well_id, 'documented' as layer, state_abbr, coalesce(depth_ft, r_depth_ft) as depth_ft, coalesce(operator, r_operator) as operator,
    case when type_norm in {_WORDS} then coalesce(r_type_norm, type_norm) else type_norm end as type_norm,
    case when status_norm in {_WORDS} then coalesce(r_status_norm, status_norm) else status_norm end as status_norm,
    depth_ft is null and r_depth_ft is not null as f1, operator is null and r_operator is not null as f2,
    type_norm in {_WORDS} and r_type_norm is not null as f3, status_norm in {_WORDS} and r_status_norm is not null as f4, lat, lon
    from doc left join attrs on doc.ordinal = attrs.doc_ordinal),
  fresh as (select case when coalesce(api_number, '') <> '' then 'state_' || api_number else 'state_' || state_abbr || '_' || (row_number() over (order by ordinal) - 1)::varchar end as well_id,
    'documented' as layer, state_abbr, depth_ft, operator, type_norm, status_norm, lat, lon from matched where way is null)"""


@query(
    "consolidated_sites",
    f"""with {_FILLED} select well_id, layer, state_abbr, depth_ft, operator, type_norm, status_norm, {rx('lat', 6)} as lat, {rx('lon', 6)} as lon
  from (select * exclude (f1, f2, f3, f4) from att union all by name select * from fresh)""",
)
def consolidated_sites(spark, d):
    rows, _, _ = consolidate.build_store(documented(spark, d), registry(spark, d), SNAP)
    return rows.select("well_id", "layer", "state_abbr", "depth_ft", "operator", "type_norm", "status_norm", "lat", "lon")


@query("new_sites_by_state", f"with {_FILLED} select state_abbr, count(*) as new_wells from fresh group by state_abbr")
def new_sites_by_state(spark, d):
    return consolidate.build_store(documented(spark, d), registry(spark, d), SNAP)[2]


@query(
    "consolidation_stats",
    f"""with {_FILLED}, n as (select count(*) as n, count(depth_ft) as nd from fresh), a as (select count(*) as docs, count(depth_ft) as dd, count(*) filter (where f1) as filled_depth_ft,
    count(*) filter (where f2) as filled_operator, count(*) filter (where f3) as filled_type_norm, count(*) filter (where f4) as filled_status_norm from att)
  select count(*) as state_wells, count(*) filter (where way = 0) as attached_by_api, count(*) filter (where way = 1) as attached_by_spatial, count(*) filter (where way is null) as new_wells,
    any_value(filled_depth_ft) as filled_depth_ft, any_value(filled_operator) as filled_operator, any_value(filled_type_norm) as filled_type_norm, any_value(filled_status_norm) as filled_status_norm,
    {rx('(100.0::double * (any_value(dd) + any_value(nd)) / (any_value(docs) + any_value(n)))', 2)} as depth_coverage_pct from matched, n, a""",
)
def consolidation_stats(spark, d):
    return consolidate.build_store(documented(spark, d), registry(spark, d), SNAP)[1]
