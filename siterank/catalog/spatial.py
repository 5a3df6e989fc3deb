"""Nearest, radius, polygon and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import SQL_SQUARES, points, query, rx, sql_points, squares, table
from siterank.functions.geo import EARTH_RADIUS_M, haversine, with_planar
from siterank.functions.numeric import round_once
from siterank.operators import polygons, spatial
from siterank.plans import consolidate, detections, enrich

SITES = sql_points("customer", "c_custkey", "c_nationkey")
KNOWN = sql_points("supplier", "s_suppkey", "s_name")
PARTS = sql_points("part", "p_partkey", "p_name")
DIST = "sqrt((s.x - k.x) * (s.x - k.x) + (s.y - k.y) * (s.y - k.y))"


def sites(spark, d):
    return with_planar(points(spark, d, "customer", "c_custkey").withColumn("well_id", F.concat(F.lit("w"), F.col("c_custkey"))))


@query(
    "nearest_known_site",
    f"with s as ({SITES}), k as ({KNOWN}) select s.ordinal, {rx(f'min({DIST})', 1)} as nearest_doc_well_m from s cross join k group by s.ordinal",
)
def nearest_known_site(spark, d):
    c = points(spark, d, "customer", "c_custkey")
    return consolidate.attach_nearest_documented(c, points(spark, d, "supplier", "s_suppkey")).select("ordinal", "nearest_doc_well_m")


@query(
    "events_near_site",
    f"""with s as ({SITES}), k as ({sql_points("(select event_id, value from events where value >= 10)", "event_id", "value")}),
  j as (select s.ordinal, k.value, {DIST} as dist, row_number() over (partition by s.ordinal order by {DIST}, k.ordinal) as rn from s cross join k)
  select 'w' || ordinal::varchar as well_id, dist <= 2000 as super_emitter, {rx('dist', 1)} as super_emitter_dist_m, {rx('value', 1)} as super_emitter_rate_kg_hr from j where rn = 1""",
)
def events_near_site(spark, d):
    raw = points(spark, d, "events", "event_id").select("lat", "lon", F.col("value").alias("rate_kg_hr"), "ordinal")
    ev = enrich.normalize_events(raw, min_rate=10.0)
    return enrich.match_events(sites(spark, d).drop("x", "y"), ev).drop("operator")


@query(
    "features_within_radius",
    f"""with s as ({SITES}), k as ({PARTS}) select s.ordinal, count(*) filter (where {DIST} <= 8046.7)::bigint as hospitals_within_5mi,
  {rx(f'min({DIST})', 1)} as nearest_hospital_m from s cross join k group by s.ordinal""",
)
def features_within_radius(spark, d):
    return enrich.hospital_proximity(sites(spark, d), with_planar(points(spark, d, "part", "p_partkey"))).select(
        "ordinal", "hospitals_within_5mi", "nearest_hospital_m"
    )


@query(
    "named_features_around",
    f"""with s as ({SITES}), k as ({PARTS}), j as (select s.ordinal, k.p_name, k.ordinal as ko, {DIST} as dist from s cross join k),
  r as (select *, row_number() over (partition by ordinal order by ko) as rn from j where dist <= 9000),
  n as (select ordinal, string_agg(p_name, '|' order by ko) as names from r where rn <= 8 group by ordinal)
  select s.ordinal, coalesce(n.names, '') as names from s left join n on s.ordinal = n.ordinal""",
)
def named_features_around(spark, d):
    p = with_planar(points(spark, d, "part", "p_partkey"))
    return spatial.names_within(sites(spark, d), p, 9000.0, "p_name").select("ordinal", F.array_join("names", "|").alias("names"))


@query(
    "beyond_known_sites",
    f"""with s as ({SITES}), k as ({KNOWN}) select ordinal from (select s.ordinal, {rx(f'min({DIST})', 1)} as m from s cross join k group by s.ordinal) where m > 2000""",
)
def beyond_known_sites(spark, d):
    c = points(spark, d, "customer", "c_custkey")
    near = consolidate.attach_nearest_documented(c, points(spark, d, "supplier", "s_suppkey"))
    return consolidate.beyond(near, "nearest_doc_well_m", 2000.0).select("ordinal")


_hav = f"2.0::double * {EARTH_RADIUS_M}::double * asin(sqrt(pow(sin(radians(k.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - s.lon) / 2), 2)))"


@query(
    "great_circle_to_own_supplier",
    f"""with s as ({SITES}), k as ({KNOWN}) select s.ordinal, {rx(_hav, 1)} as metres from s join k on s.ordinal % (select count(*) from supplier) = k.ordinal""",
)
def great_circle_to_own_supplier(spark, d):
    s = points(spark, d, "customer", "c_custkey").select("ordinal", "lat", "lon")
    sup = points(spark, d, "supplier", "s_suppkey")
    n = sup.count()
    k = sup.select(F.col("ordinal").alias("k"), F.col("lat").alias("klat"), F.col("lon").alias("klon"))
    j = s.join(k, F.col("ordinal") % n == F.col("k"))
    return j.select("ordinal", round_once(haversine(F.col("lat"), F.col("lon"), F.col("klat"), F.col("klon")), 1).alias("metres"))


@query(
    "projected_sites",
    f"select ordinal, {rx('x', 2)} as x, {rx('y', 2)} as y from ({SITES})",
)
def projected_sites(spark, d):
    return sites(spark, d).select("ordinal", round_once("x", 2).alias("x"), round_once("y", 2).alias("y"))


@query(
    "sites_in_polygons",
    f"""with s as ({SITES}), p as ({SQL_SQUARES}), j as (select s.ordinal, p.geoid, row_number() over (partition by s.ordinal order by p.ordinal) as rn
   from s join p on s.lon > p.x0 and s.lon < p.x0 + 0.4::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double)
  select s.ordinal, j.geoid as tract_geoid from s left join j on s.ordinal = j.ordinal and rn = 1""",
)
def sites_in_polygons(spark, d):
    return polygons.resolve_tracts(sites(spark, d), squares(spark, d)).select("ordinal", "tract_geoid")


@query("population_in_buffers")
def population_in_buffers(spark, d):
    layer = squares(spark, d, planar=True)
    return polygons.population_in_buffer(sites(spark, d), layer).select("ordinal", "population_1mi")


@query("merged_detections")
def merged_detections(spark, d):
    from siterank.operators.components import merge_nearby

    o = points(spark, d, "customer", "c_custkey").select("ordinal", "lon", "lat")
    return merge_nearby(o, 2500.0).groupBy("cluster").agg(F.count(F.lit(1)).alias("detections"))


@query(
    "split_by_conversation",
    """with g as (select distinct conv_id from conversations), n as (select count(*) as n from g),
  r as (select conv_id, row_number() over (order by sha1('0:' || conv_id::varchar), conv_id) as rn from g)
  select c.conv_id, c.turn, case when r.rn <= least(n.n - 1, greatest(1, round_even(n.n * 0.15::double, 0)::bigint)) then 'validation' else 'train' end as split
  from conversations c join r on c.conv_id = r.conv_id cross join n""",
)
def split_by_conversation(spark, d):
    return detections.split_groups(table(spark, d, "conversations"), "conv_id").select("conv_id", "turn", "split")
