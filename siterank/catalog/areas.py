"""Polygon layers with holes, bays and overlaps, county groups and service areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import SQL_SQUARES, STATES, pick, points, query, rx, sql_pick, sql_points, squares, table
from siterank.operators import polygons

SITES = sql_points("customer", "c_custkey", "c_nationkey")
#: In these squares of 0.4 degrees: even ones have a hole, odd ones lack their upper right quarter; all reach 0.1 to the east.
INSIDE = """s.lon > p.x0 and s.lon < p.x0 + 0.5::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double
    and not (p.ordinal % 2 = 0 and s.lon > p.x0 + 0.125::double and s.lon < p.x0 + 0.25::double and s.lat > p.y0 + 0.125::double and s.lat < p.y0 + 0.25::double)
    and not (p.ordinal % 2 = 1 and s.lon > p.x0 + 0.25::double and s.lat > p.y0 + 0.2::double)"""


def shapes(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    x0, y0 = F.lit(-82.0) + (k % 5) * 0.4, F.lit(39.0) + F.floor(k / 5) * 0.4

    def ring(*corners):
        return F.array(*[F.struct((x0 + dx).cast("double").alias("x"), (y0 + dy).cast("double").alias("y")) for dx, dy in corners])

    whole = ring((0, 0), (0.5, 0), (0.5, 0.4), (0, 0.4), (0, 0))
    hole = ring((0.125, 0.125), (0.125, 0.25), (0.25, 0.25), (0.25, 0.125), (0.125, 0.125))
    bay = ring((0, 0), (0.5, 0), (0.5, 0.2), (0.25, 0.2), (0.25, 0.4), (0, 0.4), (0, 0))
    rings = F.when(k % 2 == 0, F.array(whole, hole)).otherwise(F.array(bay))
    return n.select(k.cast("long").alias("ordinal"), F.concat(F.lit("A"), k.cast("string")).alias("geoid"), rings.alias("rings"))


@query(
    "sites_in_shapes",
    f"""with s as ({SITES}), p as ({SQL_SQUARES}), j as (select s.ordinal, p.ordinal as o, row_number() over (partition by s.ordinal order by p.ordinal) as rn from s join p on {INSIDE})
  select s.ordinal, case when j.o is not null then 'A' || j.o::varchar end as tract_geoid from s left join j on s.ordinal = j.ordinal and rn = 1""",
)
def sites_in_shapes(spark, d):
    return polygons.resolve_tracts(points(spark, d, "customer", "c_custkey"), shapes(spark, d)).select("ordinal", "tract_geoid")


_IN_SQUARE = f"""s as ({SITES}), p as ({SQL_SQUARES}), j as (select s.ordinal, p.name, p.ordinal as o, p.pop, row_number() over (partition by s.ordinal order by p.ordinal) as rn
    from s join p on s.lon > p.x0 and s.lon < p.x0 + 0.4::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double)"""


@query(
    "county_groups",
    f"""with {_IN_SQUARE} select s.ordinal, coalesce(nullif(case when j.o % 6 <> 0 then j.name when j.o is not null then '' end, ''), 'Unknown') || '_' || {sql_pick(STATES, 's.ordinal % 6')} as county_group
  from s left join j on s.ordinal = j.ordinal and rn = 1""",
)
def county_groups(spark, d):
    sites = points(spark, d, "customer", "c_custkey").withColumn("state_abbr", pick(STATES, F.col("ordinal") % 6))
    counties = squares(spark, d).withColumn("name", F.when(F.col("ordinal") % 6 != 0, F.col("name")).otherwise(""))
    return polygons.attach_county_group(sites, counties).select("ordinal", "county_group")


@query(
    "service_area_scores",
    f"""with {_IN_SQUARE} select s.ordinal, case when j.pop is null then 0.0::double else {rx('least(1.0::double, log10(coalesce(j.pop, 0) + 1) / 6.0::double)', 4)} end as drinking_water_score
  from s left join j on s.ordinal = j.ordinal and rn = 1""",
)
def service_area_scores(spark, d):
    layer = squares(spark, d).withColumnRenamed("pop", "Population_Served_Count")
    return polygons.drinking_water(points(spark, d, "customer", "c_custkey"), layer).select("ordinal", "drinking_water_score")
