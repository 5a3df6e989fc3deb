"""Normalisers, models, key joins, set operations and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import SQL_SITES, query, rx, site_base, table
from siterank.functions import models, text as tx
from siterank.functions.numeric import round_exact
from siterank.operators import tables
from siterank.plans import profile



@query(
    "classify_attributes",
    f"""select p_partkey::bigint as id,
  list_extract(['oil', 'gas', 'oil_gas', 'dry', 'injection', 'other', 'unknown'], (p_partkey % 7 + 1)::int) as type_norm,
  list_extract(['plugged', 'orphan', 'abandoned', 'idle', 'idle', 'unknown', 'unknown'], (p_partkey % 7 + 1)::int) as status_norm,
  p_partkey % 7 = 0 as is_plugged, upper(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) as operator,
  case when p_size > 0 then {rx('(p_size * 100)::double', 1)} end as depth_ft,
  lpad((p_partkey + 100000000)::varchar, 10, '0') as api_number from part""",
)
def classify_attributes(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")

    def pick(vals):
        return F.element_at(F.array(*[F.lit(v) for v in vals]), (k % 7 + 1).cast("int"))

    return p.select(
        k.alias("id"),
        tx.classify_type(pick(["Oil well", " gas", "O&G", "dry hole", "SWD", "strat test", "NT"])).alias("type_norm"),
        tx.classify_status(pick(["Plugged & Abandoned", "Orphan", "DV", "TA", "shut-in", "Active", " "])).alias("status_norm"),
        tx.normalize_operator(F.concat(F.lit("  "), "p_name")).alias("operator"),
        tx.normalize_depth(F.concat(F.format_number(F.col("p_size") * 100, 0), F.lit(" ft"))).alias("depth_ft"),
        tx.normalize_api(F.concat_ws("-", (k + 100000000).cast("string"))).alias("api_number"),
    ).withColumn("is_plugged", tx.is_plugged("status_norm"))


@query(
    "parse_candidate_ids",
    """select p_partkey::bigint as id, 'CA' as state_abbr, p_name as quad_name, p_partkey::varchar as quad_id,
  (1950 + p_size)::varchar as quad_year, '24000' as quad_scale, (p_partkey % 9)::int as detection_index from part""",
)
def parse_candidate_ids(spark, d):
    uid = F.concat_ws("_", F.lit("CA"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"),
                      (F.lit(1950) + F.col("p_size")).cast("string"), F.lit("24000"), F.lit("geo"), (F.col("p_partkey") % 9).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.parse_candidate_id(uid).alias("p")).select("id", "p.*")


@query(
    "content_keys",
    "select doc_id, substr(sha1(source || ':' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 12) as key from documents",
)
def content_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_key("source", "text").alias("key"))


@query(
    "event_properties",
    "select event_id, (json_extract(props, '$.k'))::int as k from events",
)
def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(
    "site_models",
    f"""with s as ({SQL_SITES}), a as (select *, case when state_abbr in ('OH', 'PA', 'WV', 'NY', 'KY', 'TN') then 1 else 0 end as app,
    case when type_norm in ('gas', 'oil_gas') then 'gas' when type_norm = 'oil' then 'oil' else 'unknown' end as kind,
    case when status_norm in ('undocumented', 'unknown') then null else is_plugged end as p from s),
  f as (select *, case when app = 1 then case kind when 'gas' then 75.0::double when 'oil' then 0.3::double else 30.57::double end
      else case kind when 'gas' then 75.0::double when 'oil' then 0.3::double else 10.02::double end end as up,
    case when app = 1 then case kind when 'gas' then 47.0::double when 'oil' then 0.3::double else 0.36::double end
      else case kind when 'gas' then 0.1::double when 'oil' then 0.002::double else 0.002::double end end as down from a),
  g as (select *, case when p is null then 0.69::double * up + {1.0 - 0.69!r}::double * down when p then down else up end as point,
    case state_abbr when 'CA' then 1.25::double else 1.0::double end
      * case when depth_ft is not null then pow(1.2::double, depth_ft / 1000.0::double) else 1.0::double end
      * case when type_norm in ('gas', 'oil_gas') then 1.09::double else 1.0::double end as mult from f),
  h as (select *, {rx('point * 8760.0::double / 1e6 * 30', 3)} as t, (round_even(76000.0::double * mult / 100, 0) * 100)::bigint as cost from g)
  select well_id, {rx('point', 4)} as g_per_hr, t as t_co2e, cost as cost_usd,
    {rx('t * 10 * 0.85::double', 2)} as tonnes,
    case when t * 10 * 0.85::double * 15.0::double / cost >= 1 then 'self_funding' when t * 10 * 0.85::double * 30.0::double >= cost then 'partial' else 'negligible' end as tier from h""",
)
def site_models(spark, d):
    s = site_base(spark, d).withColumn("known", models.plugged_state("status_norm", "is_plugged"))
    s = models.with_methane(s, "known", "state_abbr", "type_norm")
    s = models.with_plug_cost(s, "type_norm", F.col("depth_ft"), None, models.cost_index("state_abbr"))
    s = models.with_carbon(s, "methane.t_co2e_gwp100_point", "plug_cost.point_usd")
    return s.select(
        "well_id", F.col("methane.g_per_hr_point").alias("g_per_hr"), F.col("methane.t_co2e_gwp100_point").alias("t_co2e"),
        F.col("plug_cost.point_usd").alias("cost_usd"), F.col("carbon.creditable_tonnes").alias("tonnes"), F.col("carbon.tier").alias("tier"),
    )


@query(
    "registry_key_match",
    """select c.c_custkey, o.o_orderkey as r_o_orderkey from customer c left join
  (select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey) o on c.c_custkey = o.o_custkey""",
)
def registry_key_match(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    return tables.attach_by_key(c, o, "key", "o_orderkey", ["o_orderkey"]).select("c_custkey", "r_o_orderkey")


@query(
    "resolved_sizes",
    """select p_brand, p_type, case when count(distinct p_size) = 1 then min(p_size) when bool_or(p_size = 24) then 24 else min(p_size) end::int as p_size,
  count(distinct p_size) > 1 as ambiguous from part group by p_brand, p_type""",
)
def resolved_sizes(spark, d):
    return tables.resolve_values(table(spark, d, "part"), ["p_brand", "p_type"], "p_size", 24)


@query(
    "customers_without_orders",
    "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
)
def customers_without_orders(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return tables.pending(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"], ["F"])


@query(
    "upserted_labels",
    """select doc_id, coalesce(l.quality, (d.doc_id % 2)::int) as quality from documents d left join labels l using (doc_id)""",
)
def upserted_labels(spark, d):
    base = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return tables.upsert(base, table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("orders_per_status", "select o_orderstatus, count(*)::bigint as count from orders group by o_orderstatus")
def orders_per_status(spark, d):
    return profile.counts_by(table(spark, d, "orders"), "o_orderstatus")


@query(
    "discovery_profile",
    f"""select count(*)::bigint as total_candidates, count(*) filter (where nearest_doc_well_m > 100)::bigint as gt_100m,
  count(*) filter (where nearest_doc_well_m > 500)::bigint as gt_500m, count(*) filter (where nearest_doc_well_m > 1000)::bigint as gt_1000m,
  max(nearest_doc_well_m) as max_nearest_documented_m, quantile_cont(nearest_doc_well_m, 0.5) as median_nearest_documented_m from ({SQL_SITES})""",
)
def discovery_profile(spark, d):
    return profile.discovery_profile(site_base(spark, d))


@query(
    "duplicate_texts",
    "select count(*)::bigint as rows, count(distinct text)::bigint as ids, (count(*) - count(distinct text))::bigint as duplicates from documents",
)
def duplicate_texts(spark, d):
    return profile.duplicate_ids(table(spark, d, "documents"), "text")
