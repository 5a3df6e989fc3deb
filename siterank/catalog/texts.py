"""Text, key and formatter functions over the given tables; the oracles spell every rule out on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import query, table
from siterank.functions import models, text as tx


@query(
    "formatted_amounts",
    """select o_orderkey, case when o_totalprice >= 1000000 then '$' || printf('%.1f', o_totalprice / 1000000) || 'M'
    when o_totalprice >= 1000 then '$' || floor(o_totalprice / 1000 + 0.5)::bigint::varchar || 'k' else '$' || floor(o_totalprice + 0.5)::bigint::varchar end as usd,
  case when o_orderkey % 11 = 0 then '—' else floor((o_orderkey % 1000)::double / 1000 * 100 + 0.5)::bigint::varchar || '%' end as pct
  from orders""",
)
def formatted_amounts(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k, tx.fmt_usd("o_totalprice").alias("usd"), tx.fmt_pct(F.when(k % 11 != 0, (k % 1000).cast("double") / 1000)).alias("pct")
    )


@query(
    "formatted_distances",
    """select p_partkey, case when m is null then '—' when m / 1609.34::double < 0.1 then floor(m + 0.5)::bigint::varchar || ' m'
    when m / 1609.34::double < 1 then printf('%.2f', m / 1609.34::double) || ' mi' else printf('%.1f', m / 1609.34::double) || ' mi' end as miles
  from (select p_partkey, case when p_partkey % 13 <> 0 then (p_partkey % 400)::double * 11.37::double end as m from part)""",
)
def formatted_distances(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, tx.fmt_miles(F.when(k % 13 != 0, (k % 400).cast("double") * 11.37)).alias("miles"))


@query(
    "page_names",
    r"""with u as (select page_id, url, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1) as path from pages),
  l as (select *, regexp_extract(regexp_replace(url_decode(path), '/+$', ''), '([^/]*)$', 1) as leaf from u)
  select page_id, path, replace(string_split(url, '/')[-1], '%20', ' ') as file_name,
    regexp_replace(case when regexp_matches(leaf, '^.+\.[^.]+$') then regexp_replace(leaf, '\.[^.]+$', '') else leaf end, '[^A-Za-z0-9_.\-]+', '_', 'g') as safe from l""",
)
def page_names(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_path("url").alias("path"), tx.url_file_name("url").alias("file_name"), tx.safe_id(F.lit(None).cast("string"), "url").alias("safe"))


_SQUEEZED = r"regexp_replace(regexp_replace(regexp_replace(text, '[#*`]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(
    "first_sentences",
    rf"""with s as (select doc_id, text, {_SQUEEZED} as s from documents), m as (select *, regexp_extract(s, '^.*?[.!?](\s|$)', 0) as m from s)
  select doc_id, case when text <> '' then substring(regexp_replace(case when m <> '' then m else s end, '^\s+|\s+$', '', 'g'), 1, 180) end as first_sentence,
    try_cast(regexp_extract(text, '(?:18|19|20)\d{{2}}', 0) as int) as year_in_text,
    case when regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' and not starts_with(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), 'not found')
      then substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 180) end as finding from m""",
)
def first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_sentence("text").alias("first_sentence"), tx.year_in_text("text").alias("year_in_text"), tx.found_text("text").alias("finding"))


@query(
    "keys_and_names",
    """select s_suppkey, regexp_replace(regexp_replace(s_name, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1') as label_number, lpad(s_suppkey::varchar, 11, '0') as geoid,
    replace(s_name, ' ', '_') as folder, regexp_replace(trim(s_name), '\\s+', '-', 'g') as slug,
    'unet_PA_' || regexp_replace(trim(s_name), '\\s+', '-', 'g') || '_1951_None_geo_' || s_suppkey::varchar as detection_id,
    'Undocumented well · ' || s_name || ' quad (1951)' as detection_name, coalesce(case when s_suppkey % 2 = 0 then s_name end, 'None') || ' detection #' || s_suppkey::varchar as candidate_name,
    case when s_suppkey % 3 = 0 then 'state_' || s_suppkey::varchar else 'state_PA_' || s_suppkey::varchar end as registry_id,
    case when s_suppkey % 3 = 0 then 'PA orphan well ' || s_suppkey::varchar else 'PA orphan well' end as registry_name,
    [('PA', '42'), ('RI', '44'), ('WY', '56'), ('AK', '02')][s_suppkey % 4 + 1][2] as fips, ['Pennsylvania', 'Rhode Island', 'Wyoming', 'Alaska'][s_suppkey % 4 + 1] as state_name from supplier""",
)
def keys_and_names(spark, d):
    k, name = F.col("s_suppkey"), F.col("s_name")
    api = F.when(k % 3 == 0, k.cast("string"))
    abbr = F.element_at(F.array(*map(F.lit, ("PA", "RI", "WY", "AK"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(
        k, tx.label_number(name).alias("label_number"), tx.zero_fill(k).alias("geoid"), tx.partition_folder(name).alias("folder"), tx.slug(name).alias("slug"),
        tx.detection_id(F.lit("PA"), tx.slug(name), F.lit("1951"), F.lit(None), k).alias("detection_id"), tx.detection_name(name, F.lit(1951)).alias("detection_name"),
        tx.candidate_name(F.when(k % 2 == 0, name), k).alias("candidate_name"), tx.registry_id(api, F.lit("PA"), k).alias("registry_id"),
        tx.registry_name(api, F.lit("PA")).alias("registry_name"), tx.state_fips(abbr).alias("fips"), tx.state_name(abbr).alias("state_name"),
    )


@query(
    "proxies_of_people",
    """with v as (select c_custkey as k, c_acctbal as b from customer), e as (select k, b, case when k % 7 = 0 then -999.0::double else (k % 120)::double end as p, case when k % 5 = 0 then null else (k % 90)::double end as m from v)
  select k, case when b is null or b <= 0 then 0.0::double else round_even(least(1.0::double, log10(b + 1) / 6.0::double), 4) end as water,
    case when p <> -999 and m is not null then greatest(0.0::double, least(1.0::double, round_even((p + m) / 200.0::double, 4))) end as ej,
    case when k % 3 = 0 then 0.5::double else 1.0::double end as program, (k % 4 > 2 or k % 1500 >= 1000) as near from e""",
)
def proxies_of_people(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("k"), models.water_score("c_acctbal").alias("water"),
        models.ej_proxy(F.when(k % 7 == 0, -999.0).otherwise((k % 120).cast("double")), F.when(k % 5 != 0, (k % 90).cast("double"))).alias("ej"),
        models.program_match(F.when(k % 3 != 0, "PA")).alias("program"), models.near_people(F.when(k % 4 > 2, 1), k % 1500).alias("near"),
    )


@query(
    "funding_pathways",
    """with c as (select c_custkey as k, k % 2 = 0 as j40, k % 3 = 0 as viable, k % 6 = 0 as self, k % 5 <> 0 as near, k % 7 = 0 as owner, k % 11 <> 0 as state from customer),
  p as (select k, 'federal_bil' as key, case when j40 then 0 else 1 end as pr, case when j40 then 0 else 1 end as cr, 0 as pos from c
    union all select k, 'state_program', 1, 0, 1 from c where state
    union all select k, 'carbon_credit', 0, case when self then 0 else 1 end, 2 from c where viable
    union all select k, 'charity', 2, 1, 3 from c where near union all select k, 'landowner', 3, 2, 4 from c where owner)
  select k, string_agg(key, ',' order by pr, cr, pos) as routes, string_agg(pr::varchar, ',' order by pr, cr, pos) as priorities,
    string_agg(['high', 'medium', 'low'][cr + 1], ',' order by pr, cr, pos) as confidences from p group by k""",
)
def funding_pathways(spark, d):
    k = F.col("c_custkey")
    routes = models.pathways(
        F.when(k % 11 != 0, "PA"), k % 2 == 0, k % 3 == 0, F.when(k % 6 == 0, "self_funding").otherwise("negligible"), k % 5 != 0, k % 7 == 0
    )
    out = table(spark, d, "customer").select(k.alias("k"), routes.alias("r"))
    joined = {"routes": "key", "priorities": "priority", "confidences": "confidence"}
    return out.select("k", *[F.array_join(F.col(f"r.{f}").cast("array<string>"), ",").alias(n) for n, f in joined.items()])
