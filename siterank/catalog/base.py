"""Bindings from the given tables to sites, known points, layers and attributes.

Sites are customers, known points suppliers or parts, registry rows orders; coordinates come
from integer arithmetic on the keys.  Every query reads the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.functions.geo import AlbersConus
from siterank.functions.numeric import round_once, sql_round_exact as rx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def at(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key).cast("long")
    return df.withColumns(
        {
            "lat": F.lit(39.0) + ((k * 7919) % 1000003).cast("double") / 500000.0,
            "lon": F.lit(-82.0) + ((k * 104729) % 1000003).cast("double") / 500000.0,
        }
    )


def sql_lat(k: str) -> str:
    return f"(39.0::double + (({k}::bigint * 7919) % 1000003)::double / 500000.0::double)"


def sql_lon(k: str) -> str:
    return f"(-82.0::double + (({k}::bigint * 104729) % 1000003)::double / 500000.0::double)"


def points(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    t = table(spark, d, name)
    return at(t.withColumn("ordinal", F.col(key).cast("long")), key)


def sql_points(name: str, key: str, extra: str = "") -> str:
    """CTE body: ordinal, lat, lon, x, y and extra columns."""
    x, y = AlbersConus.sql_xy("lat", "lon")
    return (
        f"select *, {x} as x, {y} as y from (select {key}::bigint as ordinal, {sql_lat(key)} as lat, "
        f"{sql_lon(key)} as lon{', ' + extra if extra else ''} from {name})"
    )


def squares(spark: SparkSession, d: str, planar: bool = False, size: float = 0.4) -> DataFrame:
    """One square per nation on a 5 x 5 grid: the polygon layer of the bindings."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    if planar:
        # planar squares of 40 km over the same ground
        x0, y0 = F.lit(1150000.0) + (k % 5) * 40000.0, F.lit(1800000.0) + F.floor(k / 5) * 40000.0
        s = 40000.0
    else:
        x0, y0, s = F.lit(-82.0) + (k % 5) * size, F.lit(39.0) + F.floor(k / 5) * size, size
    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(p(x0, y0), p(x0 + s, y0), p(x0 + s, y0 + s), p(x0, y0 + s), p(x0, y0))
    return n.select(
        k.cast("long").alias("ordinal"), F.concat(F.lit("G"), k.cast("string")).alias("geoid"),
        F.col("n_name").alias("name"), F.col("r_name").alias("region"), ((k * 1000) + 500).cast("double").alias("pop"),
        F.array(ring).alias("rings"),
    )


SQL_SQUARES = """select n_nationkey::bigint as ordinal, 'G' || n_nationkey::varchar as geoid, n_name as name, r_name as region,
  (n_nationkey * 1000 + 500)::double as pop,
  -82.0::double + (n_nationkey % 5) * 0.4::double as x0, 39.0::double + (n_nationkey // 5) * 0.4::double as y0
  from nation join region on n_regionkey = r_regionkey"""

# --- sites ------------------------------------------------------------------
STATES = ["OH", "PA", "WV", "KY", "CA", "TX"]
STATE_NAMES = ["Ohio", "Pennsylvania", "West Virginia", "Kentucky", "California", "Texas"]
TYPES = {"AUTOMOBILE": "gas", "BUILDING": "oil", "FURNITURE": "oil_gas", "HOUSEHOLD": "unknown"}
STATUSES = ["undocumented", "unknown", "plugged", "idle"]


def pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index} + 1)::int)"


def site_base(spark: SparkSession, d: str) -> DataFrame:
    c = points(spark, d, "customer", "c_custkey")
    k = F.col("c_custkey")
    kind = F.lit("other")
    for seg, t in TYPES.items():
        kind = F.when(F.col("c_mktsegment") == seg, t).otherwise(kind)
    abbr = pick(STATES, F.col("c_nationkey") % 6)
    status = pick(STATUSES, k % 4)
    return c.select(
        F.concat(F.lit("w"), k.cast("string")).alias("well_id"), "ordinal", "lat", "lon",
        F.when(k % 500 == 3, "hero").otherwise("candidate").alias("layer"),
        F.col("c_name").alias("name"),
        abbr.alias("state_abbr"), pick(STATE_NAMES, F.col("c_nationkey") % 6).alias("state"),
        F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit("_"), abbr).alias("county_group"),
        F.concat(F.lit("Quad "), (k % 37).cast("string")).alias("quad_name"),
        (F.lit(1950) + k % 40).cast("string").alias("quad_year"), F.lit("24000").alias("quad_scale"),
        kind.alias("type_norm"), status.alias("status_norm"), (status == "plugged").alias("is_plugged"),
        F.when(k % 9 != 0, ((k % 9) * 700).cast("double")).alias("depth_ft"),
        F.when(k % 13 != 0, round_once(F.abs(F.col("c_acctbal")), 1)).alias("nearest_doc_well_m"),
        F.when(k % 3 == 0, "lbnl").otherwise("unet_2026").alias("source"),
        F.col("c_acctbal"), F.col("c_nationkey"),
    )


_case_type = "case c_mktsegment " + " ".join(f"when '{s}' then '{t}'" for s, t in TYPES.items()) + " else 'other' end"
SQL_SITES = f"""select 'w' || c_custkey::varchar as well_id, c_custkey::bigint as ordinal, {sql_lat('c_custkey')} as lat, {sql_lon('c_custkey')} as lon,
  case when c_custkey % 500 = 3 then 'hero' else 'candidate' end as layer, c_name as name,
  {sql_pick(STATES, 'c_nationkey % 6')} as state_abbr, {sql_pick(STATE_NAMES, 'c_nationkey % 6')} as state,
  'C' || c_nationkey::varchar || '_' || {sql_pick(STATES, 'c_nationkey % 6')} as county_group,
  'Quad ' || (c_custkey % 37)::varchar as quad_name, (1950 + c_custkey % 40)::varchar as quad_year, '24000' as quad_scale,
  {_case_type} as type_norm, {sql_pick(STATUSES, 'c_custkey % 4')} as status_norm, (c_custkey % 4 = 2) as is_plugged,
  case when c_custkey % 9 <> 0 then ((c_custkey % 9) * 700)::double end as depth_ft,
  case when c_custkey % 13 <> 0 then {rx('abs(c_acctbal)', 1)} end as nearest_doc_well_m,
  case when c_custkey % 3 = 0 then 'lbnl' else 'unet_2026' end as source, c_acctbal, c_nationkey
  from customer"""


def site_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a site from its orders and their lines."""
    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    # lines are summed per order before the join, so the large table is reduced map-side
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    agg = (
        o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"), F.sum("qty").alias("qty"),
            F.sum("returned").alias("returned"),
        )
    )
    k = F.col("c_custkey")
    j = c.join(agg, F.col("o_custkey") == k, "left")
    return j.select(
        F.concat(F.lit("w"), k.cast("string")).alias("well_id"),
        F.when(k % 7 != 0, F.coalesce("qty", F.lit(0))).alias("population_1mi"),
        (k % 5000).alias("population"),
        F.coalesce("orders", F.lit(0)).alias("schools_within_1mi"),
        F.when(k % 11 != 0, F.coalesce("returned", F.lit(0))).alias("hospitals_within_5mi"),
        F.when(k % 3 == 0, 0.0).otherwise(round_once(F.least(F.lit(1.0), F.log10(F.coalesce("lines", F.lit(0)) + 1.0) / 6.0), 4)).alias("drinking_water_score"),
        F.when(k % 17 != 0, round_once((F.col("c_acctbal") + 1000.0) / 11000.0, 4)).alias("svi"),
        F.when(k % 5 != 0, round_once((k % 991).cast("double") / 991.0, 4)).alias("eji_rank"),
        F.when(k % 2 == 0, round_once((k % 89).cast("double") / 89.0, 4)).alias("ej"),
        F.when(k % 4 != 0, k % 3 == 0).alias("cejst_disadvantaged"),
        F.when(k % 6 != 0, F.concat(F.lit("School "), (k % 101).cast("string"))).alias("nearest_school"),
        F.when(k % 8 != 0, F.concat(F.lit("County "), (k % 23).cast("string"))).alias("county"),
    )


SQL_ENRICHMENT = f"""select 'w' || c_custkey::varchar as well_id,
  case when c_custkey % 7 <> 0 then coalesce(qty, 0)::bigint end as population_1mi, (c_custkey % 5000)::bigint as population,
  coalesce(orders, 0)::bigint as schools_within_1mi,
  case when c_custkey % 11 <> 0 then coalesce(returned, 0)::bigint end as hospitals_within_5mi,
  case when c_custkey % 3 = 0 then 0.0::double else {rx('least(1.0::double, log10(coalesce(lines, 0)::double + 1.0) / 6.0::double)', 4)} end as drinking_water_score,
  case when c_custkey % 17 <> 0 then {rx('(c_acctbal + 1000.0::double) / 11000.0::double', 4)} end as svi,
  case when c_custkey % 5 <> 0 then {rx('(c_custkey % 991)::double / 991.0::double', 4)} end as eji_rank,
  case when c_custkey % 2 = 0 then {rx('(c_custkey % 89)::double / 89.0::double', 4)} end as ej,
  case when c_custkey % 4 <> 0 then c_custkey % 3 = 0 end as cejst_disadvantaged,
  case when c_custkey % 6 <> 0 then 'School ' || (c_custkey % 101)::varchar end as nearest_school,
  case when c_custkey % 8 <> 0 then 'County ' || (c_custkey % 23)::varchar end as county
  from customer left join (
    select o_custkey, count(*) as orders, sum(lines)::bigint as lines, sum(qty)::bigint as qty, sum(returned)::bigint as returned
    from orders left join (
      select l_orderkey, count(*) as lines, sum(l_quantity::bigint)::bigint as qty, count(*) filter (where l_returnflag = 'R') as returned
      from lineitem group by l_orderkey) on o_orderkey = l_orderkey
    group by o_custkey) on o_custkey = c_custkey"""


def share_sql(metric: str, source: str) -> str:
    """(ordinal, share) of one metric by the average-rank rule."""
    raw = (
        f"(rank() over (order by {metric}) - 1 + (count(*) over (partition by {metric}) + 1) / 2.0::double)"
        f" / (count(*) over ())::double"
    )
    return f"select ordinal, {rx('s', 4)} as share from (select ordinal, ({raw})::double as s from {source} where {metric} is not null)"
