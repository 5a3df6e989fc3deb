"""Runs that go on where they stopped: items, facts and caches that arrive in parts of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from siterank.catalog.base import SQL_SQUARES, at, points, query, sql_lat, sql_lon, sql_points, squares, table
from siterank.functions.numeric import sql_round_exact as rx
from siterank.plans import enrich, profile_store
from siterank.session import ensure_checkpoint_dir
from siterank.sources import layers
from siterank.sources.keyed_store import KeyedStore
from siterank.streaming import items, resume


def folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"


# --- items ------------------------------------------------------------------
def _work(row) -> dict:
    """Every seventh item fails always, every fifth the first time."""
    if row.id % 7 == 0 or (row.id % 5 == 0 and row.round == 1):
        raise ValueError("no pages")
    return {"pages": row.id % 11, "status": "partial" if row.id % 11 == 0 else "complete"}


@query(
    "items_over_two_runs",
    """select c_custkey::bigint as id, case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then 2 else 1 end::int as attempts,
    case when c_custkey % 7 = 0 then 'error' when c_custkey % 11 = 0 then 'partial' else 'complete' end as status,
    case when c_custkey % 7 = 0 then 'ValueError: no pages' end as error, case when c_custkey % 7 <> 0 then c_custkey % 11 end::bigint as pages,
    c_custkey % 7 = 0 as failed from customer""",
)
def items_over_two_runs(spark, d):
    base, schema = folder(spark), "id long, round int"
    for n in (1, 2):
        manifest = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit(n).alias("round"))
        manifest.write.parquet(f"{base}/manifests/round-{n}")
        items.process_items(spark, f"{base}/manifests/*", schema, _work, "pages long", f"{base}/out", f"{base}/state", "id", "round", files_per_batch=1000)
    return items.outcomes(spark, f"{base}/out", "id").select("id", "attempts", "status", "error", "pages", "failed")


# --- facts ------------------------------------------------------------------
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "facts_stored_in_batches",
    f"""with f as (select doc_id, source as topic, substr(sha1(source || ':' || {_TRIM}), 1, 12) as key, case when doc_id % 3 = 0 then 0 else 1 end as part
    from documents where {_TRIM} <> '')
  select key, topic, doc_id as ordinal from (select *, row_number() over (partition by key order by part, doc_id) as rn from f) where rn = 1""",
)
def facts_stored_in_batches(spark, d):
    """A third of all rows first, then all of them, then all again by another stream."""
    base, k = folder(spark), F.col("doc_id")
    rows = table(spark, d, "documents").select(
        F.col("source").alias("topic"), F.col("text").alias("value"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("well_id"), k.alias("ordinal"),
    )
    schema = "topic string, value string, source string, well_id string, ordinal long"
    for n, (part, stream) in enumerate([(rows.where(F.col("ordinal") % 3 == 0), "a"), (rows, "a"), (rows, "b")]):
        part.write.parquet(f"{base}/rows/part-{n}")
        resume.append_facts(spark, f"{base}/rows/*", schema, f"{base}/store", f"{base}/{stream}", files_per_batch=1000, fmt="parquet")
    return resume.fact_store(spark, f"{base}/store").read().select("key", "topic", "ordinal")


# --- keyed merge ------------------------------------------------------------
@query(
    "latest_order_in_keyed_store",
    """select o_custkey::bigint as custkey, o_orderkey::bigint as orderkey, o_totalprice::double as price
  from (select *, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end desc, o_orderkey desc) as rn from orders) where rn = 1""",
)
def latest_order_in_keyed_store(spark, d):
    """One merge per status; the last order of a customer in the last status stays."""
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderkey").cast("long").alias("orderkey"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus",
    )
    store = KeyedStore(spark, folder(spark)).create("custkey long, orderkey long, price double", ["custkey"], buckets=64)
    known = F.col("o_orderstatus").isin("F", "O")
    for part in (rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), rows.where(~F.coalesce(known, F.lit(False)))):
        store.merge(part, F.col("orderkey").desc())
    return store.read()


# --- point cache ------------------------------------------------------------
_ARC = "2.0::double * 6371000.0::double * asin(sqrt(pow(sin(radians(k.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - s.lon) / 2), 2)))"


@query(
    "point_sidecar_over_two_runs",
    f"""with o as materialized (select o_orderkey::bigint as ordinal, {sql_lat('o_custkey')} as lat, {sql_lon('o_custkey')} as lon, o_orderkey % 2 as part from orders),
  c as materialized (select lat, lon, {rx('lat', 4)} as a, {rx('lon', 4)} as b from (select distinct lat, lon from o)),
  r as (select a, b, o.lat, o.lon, row_number() over (partition by a, b order by part, ordinal) as rn from o join c using (lat, lon)),
  s as materialized (select a, b, lat, lon from r where rn = 1), k as ({sql_points('part', 'p_partkey', 'p_name')}), p as ({SQL_SQUARES}),
  t as (select s.a, s.b, min(p.ordinal) as t from s join p on s.lon > p.x0 and s.lon < p.x0 + 0.4::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double group by s.a, s.b),
  j as (select s.a, s.b, k.p_name, k.ordinal as ko, {_ARC} as m from s join k on abs(k.lat - s.lat) < 0.02), i as (select * from j where m <= 1609),
  n as (select *, row_number() over (partition by a, b order by ko) as rn, row_number() over (partition by a, b order by m, ko) as near from i),
  g as (select a, b, count(*)::bigint as n, min(m) as m, max(p_name) filter (where near = 1) as name, string_agg(p_name, '|' order by ko) filter (where rn <= 8) as names from n group by a, b)
  select 'w' || ordinal::varchar as well_id, t::double / 64.0::double as svi, 'county ' || t::varchar as county, coalesce(n, 0)::bigint as schools_within_1mi,
    {rx('m', 1)} as nearest_school_m, name as nearest_school, coalesce(names, '') as names
  from o join c using (lat, lon) left join t using (a, b) left join g using (a, b)""",
)
def point_sidecar_over_two_runs(spark, d):
    """Places of orders: those of even keys first, then all; a place is computed once."""
    key = F.col("o_orderkey").cast("long")
    sites = at(table(spark, d, "orders"), "o_custkey").select(F.concat(F.lit("w"), key.cast("string")).alias("well_id"), key.alias("ordinal"), "lat", "lon")
    given = {"svi": F.col("ordinal") / 64.0, "county": F.concat(F.lit("county "), F.col("ordinal").cast("string"))}
    tracts = squares(spark, d).select("ordinal", "geoid", "rings", *[given.get(c, F.lit(None).cast("double")).alias(c) for c in enrich.SVI_KEYS])
    schools = points(spark, d, "part", "p_partkey").withColumnRenamed("p_name", "NAME")
    store = enrich.point_cache(spark, folder(spark), tracts, buckets=64)
    enrich.enrich_points_stored(sites.where("ordinal % 2 = 0"), store, tracts, schools)
    out = enrich.enrich_points_stored(sites, store, tracts, schools)
    return out.select("well_id", "svi", "county", "schools_within_1mi", "nearest_school_m", "nearest_school", F.array_join("school_names", "|").alias("names"))


# --- layers -----------------------------------------------------------------
#: Twenty sheets of an eighth of a degree along a diagonal, and a large one.
SHEETS = [(-82.0 + k * 0.09, 39.0 + k * 0.09, -81.875 + k * 0.09, 39.125 + k * 0.09) for k in range(20)] + [(-80.5, 39.0, -80.0, 39.25)]


@query(
    "sites_on_map_sheets",
    f"""with s as ({sql_points('customer', 'c_custkey', "'S' || (c_custkey % 6)::varchar as state")}),
  b as (select * from (values {', '.join('(' + ', '.join(f'{v!r}::double' for v in b) + ')' for b in SHEETS)}) as t(w, s, e, n))
  select ordinal, state from s where state in ('S1', 'S2', 'S5')
    and exists (select 1 from b where s.lon between b.w - 0.002::double and b.e + 0.002::double and s.lat between b.s - 0.002::double and b.n + 0.002::double)""",
)
def sites_on_map_sheets(spark, d):
    path = folder(spark)
    sites = points(spark, d, "customer", "c_custkey").select("ordinal", "lon", "lat", F.concat(F.lit("S"), (F.col("ordinal") % 6).cast("string")).alias("state"))
    layers.write_layer(sites, path, state="state")
    return layers.read_layer(spark, path, ["S1", "S2", "S5"], SHEETS, margin=0.002, state="state").select("ordinal", "state")


@query(
    "squares_meeting_sheets",
    f"""with p as ({SQL_SQUARES}) select geoid, region from p where region in ('ASIA', 'EUROPE', 'AFRICA')
    and p.x0 <= -81.0::double and p.x0 + 0.4::double >= -81.7::double and p.y0 <= 40.1::double and p.y0 + 0.4::double >= 39.5::double""",
)
def squares_meeting_sheets(spark, d):
    path = folder(spark)
    layers.write_layer(squares(spark, d), path, state="region")
    return layers.read_layer(spark, path, ["ASIA", "EUROPE", "AFRICA"], [(-81.7, 39.5, -81.0, 40.1)], state="region").select("geoid", "region")


# --- profiles ---------------------------------------------------------------
@query(
    "profile_merged_by_part",
    """with v as (select o_orderstatus as part, o_totalprice::double as x from orders),
  m as (select 'price' as metric, part, x, null as t from v union all select 'customer', o_orderstatus, null, o_custkey::varchar from orders)
  select part, metric, count(*)::bigint as n, count(coalesce(x::varchar, t))::bigint as present, max(x) as greatest, count(*) filter (where x > 1000)::bigint as gt_1000,
    true as distinct_close, case when metric = 'price' then true end as median_close from m group by part, metric""",
)
def profile_merged_by_part(spark, d):
    """Orders of even keys, then those of odd keys; estimates are held against exact figures (6 % of the distinct values, 3 % of the ranks)."""
    store = profile_store.profile_store(spark, folder(spark))
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("part"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").alias("k"),
    )
    for odd in (0, 1):
        profile_store.add_to_profile(store, rows.where(F.col("k") % 2 == odd), ["price", "customer"], part="part")
    got = profile_store.profile(store, by_part=True)
    middle = got.where("metric = 'price'").select("part", "median")
    exact = rows.join(middle, "part").groupBy("part").agg(
        F.count_distinct("price").alias("prices"), F.count_distinct("customer").alias("customers"),
        (F.count_if(F.col("price") <= F.col("median")) / F.count("price")).alias("below"), (1.5 / F.count("price")).alias("one_row"),
    )
    distinct = F.when(F.col("metric") == "price", F.col("prices")).otherwise(F.col("customers"))
    return got.join(exact, "part").select(
        "part", "metric", "n", "present", "greatest", "gt_1000", (F.abs(F.col("distinct_values") / distinct - 1) < 0.06).alias("distinct_close"),
        F.when(F.col("metric") == "price", F.abs(F.col("below") - 0.5) < 0.03 + F.col("one_row")).alias("median_close"),
    )
