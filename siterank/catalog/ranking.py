"""Scores, ranks, sequences and the ranked view."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import (
    SQL_ENRICHMENT, SQL_SITES, query, rx, share_sql, site_base, site_enrichment, table,
)
from siterank.operators import ordering, tables
from siterank.plans import cases, profile, score, view
from siterank.session import cut_lineage

M = list(score.WEIGHTS)
_w = score.WEIGHTS


def composite_sql(weights: dict[str, float]) -> str:
    """CTEs from ``rec`` (sites with metrics) to ``scored`` (composite and parts)."""
    keys = list(weights)
    shares = ",\n".join(f"s_{k} as ({share_sql(k, 'rec')})" for k in keys)
    joins = " ".join(f"left join s_{k} on s_{k}.ordinal = rec.ordinal" for k in keys)
    cols = ", ".join(f"s_{k}.share as {k}_norm" for k in keys)
    wsum = "0.0::double" + "".join(f" + case when {k}_norm is not null then {w}::double else 0.0::double end" for k, w in weights.items())
    ssum = "0.0::double" + "".join(f" + coalesce({w}::double * {k}_norm, 0.0::double)" for k, w in weights.items())
    parts = ", ".join(f"{rx(f'{w}::double * {k}_norm / w * 100.0::double', 2)} as part_{k}" for k, w in weights.items())
    groups = []
    for g, members in score.GROUPS.items():
        tot = "0.0::double" + "".join(f" + coalesce(part_{k}, 0.0::double)" for k in members if k in weights)
        groups.append(f"{rx(tot, 2)} as group_{g}")
    return f"""{shares},
norms as (select rec.*, {cols} from rec {joins}),
sums as (select *, {ssum} as s, {wsum} as w0 from norms),
sums2 as (select *, case when w0 = 0 then 1.0::double else w0 end as w from sums),
comp as (select *, {rx('s / w * 100.0::double', 1)} as composite, {parts} from sums2),
scored as (select *, {', '.join(groups)} from comp)"""


REC_SQL = f"""rec0 as (select s.*, e.population_1mi, e.population as tract_population, e.schools_within_1mi, e.hospitals_within_5mi,
    e.drinking_water_score, e.svi, e.eji_rank, e.ej as tract_ej, e.cejst_disadvantaged, e.nearest_school, e.county
  from ({SQL_SITES}) s left join ({SQL_ENRICHMENT}) e on s.well_id = e.well_id),
rec as (select *, coalesce(population_1mi, tract_population)::double as population, schools_within_1mi::double as schools,
    hospitals_within_5mi::double as hospitals, drinking_water_score as drinking_water, coalesce(eji_rank, tract_ej) as ej from rec0)"""


def records(spark, d):
    # the sidecar is written once, as the records are read in several passes
    return score.build_records(site_base(spark, d), cut_lineage(site_enrichment(spark, d)))


def scored_sites(spark, d):
    return score.score_sites(records(spark, d))


SCORED_SQL = f"""with {REC_SQL},
{composite_sql(_w)},
ranked as (select *, row_number() over (order by composite desc, ordinal) as global_rank,
  case when layer = 'hero' then null else row_number() over (partition by layer = 'hero' order by composite desc, ordinal) end as r from scored),
final as (select *, coalesce(r, global_rank)::bigint as rank from ranked)
"""


@query(
    "score_sites",
    SCORED_SQL
    + f"""select well_id, rank, global_rank::bigint as global_rank, composite,
  {', '.join(f'part_{k}' for k in M)}, {', '.join(f'{k}_norm' for k in M)}, {', '.join(f'group_{g}' for g in score.GROUPS)} from final""",
)
def score_sites(spark, d):
    s = scored_sites(spark, d)
    return s.select(
        "well_id", "rank", "global_rank", F.col("score.composite").alias("composite"),
        *[F.col("score.breakdown").getItem(k).alias(f"part_{k}") for k in M],
        *[F.col("score.normalized").getItem(k).alias(f"{k}_norm") for k in M],
        *[F.col("score.group_breakdown").getItem(g).alias(f"group_{g}") for g in score.GROUPS],
    )


@query(
    "percentile_metrics",
    f"with {REC_SQL}, {composite_sql(_w)} select well_id, {', '.join(f'{k}_norm' for k in M)} from norms",
)
def percentile_metrics(spark, d):
    r = records(spark, d).select("well_id", "ordinal", "metrics.*")
    return ordering.with_rank_shares(r, {k: (k, "pct") for k in M}).select("well_id", *[f"{k}_norm" for k in M])


_custom = {"population": 0.5, "svi": 0.3, "ej": 0.2}


@query(
    "custom_weights",
    f"with {REC_SQL}, {composite_sql(_custom)} select well_id, composite, {', '.join(f'part_{k}' for k in _custom)}, group_human_exposure, group_equity from scored",
)
def custom_weights(spark, d):
    r = records(spark, d).select("well_id", "ordinal", "metrics.*")
    s = score.score_metrics(r, _custom)
    return s.select("well_id", "composite", *[f"part_{k}" for k in _custom], "group_human_exposure", "group_equity")


@query(
    "inverted_and_direct_metrics",
    f"""with v as (select c_custkey::bigint as ordinal, c_acctbal as a, (c_custkey % 300)::double / 200.0::double as b from customer),
  r as (select ordinal, ((rank() over (order by a) - 1 + (count(*) over (partition by a) + 1) / 2.0::double) / (count(*) over ())::double)::double as s from v)
  select v.ordinal, {rx('1.0::double - s', 4)} as a_norm, greatest(0.0::double, least(1.0::double, b)) as b_norm from v join r on v.ordinal = r.ordinal""",
)
def inverted_and_direct_metrics(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("ordinal"), F.col("c_acctbal").alias("a"), ((F.col("c_custkey") % 300).cast("double") / 200.0).alias("b")
    )
    return ordering.with_rank_shares(c, {"a": ("a", "pct_inv"), "b": ("b", "direct")}).select("ordinal", "a_norm", "b_norm")


@query(
    "present_and_missing_metrics",
    f"with {REC_SQL} select well_id, concat_ws(',', "
    + ", ".join(f"case when {k} is not null then '{k}' end" for k in M)
    + ") as present, concat_ws(',', "
    + ", ".join(f"case when {k} is null then '{k}' end" for k in M)
    + ") as missing from rec",
)
def present_and_missing_metrics(spark, d):
    s = scored_sites(spark, d)
    return s.select(
        "well_id", F.array_join("score.present_metrics", ",").alias("present"), F.array_join("score.missing_metrics", ",").alias("missing")
    )


@query(
    "slim_rows",
    SCORED_SQL
    + f"""select well_id, rank, {rx('lat', 5)} as lat, {rx('lon', 5)} as lon, name, quad_name, county_group, state, source, composite,
  tract_population::bigint as population, population_1mi, schools_within_1mi, nearest_school, county, ((rank - 1) // 1000)::int as shard from final""",
)
def slim_rows(spark, d):
    s = score.with_shard(score.slim(scored_sites(spark, d)))
    return s.select(
        "well_id", "rank", "lat", "lon", "name", "quad_name", "county_group", "state", "source",
        F.col("score.composite").alias("composite"),
        *[F.col(f"enrichment.{c}").alias(c) for c in ("population", "population_1mi", "schools_within_1mi", "nearest_school", "county")],
        "shard",
    )


@query(
    "composite_summary",
    SCORED_SQL
    + """select count(*)::bigint as n, min(composite) as lowest,
  max(case when rank = (select count(*) // 2 + 1 from final) then composite end) as middle, max(composite) as highest from final where layer <> 'hero'""".replace(
        "from final) then", "from final where layer <> 'hero') then"
    ),
)
def composite_summary(spark, d):
    return score.composite_summary(scored_sites(spark, d).where("layer <> 'hero'"))


@query(
    "global_position_of_prices",
    "select p_partkey::bigint as id, row_number() over (order by p_retailprice desc, p_partkey) as position from part",
)
def global_position_of_prices(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return ordering.global_position(p, "p_retailprice", "id", "position").select("id", "position")


@query(
    "positions_with_nulls",
    """select p_partkey::bigint as id, row_number() over (order by case when p_size % 5 <> 0 then p_size end desc nulls last, p_partkey) as position from part""",
)
def positions_with_nulls(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("size"))
    return ordering.global_position(p, "size", "id", "position").select("id", "position")


@query(
    "shares_with_repeated_keys",
    f"""with v as (select l_orderkey::bigint as k, l_linenumber::bigint as line, l_quantity::double as q from lineitem where l_orderkey % 3 <> 0
      union all select l_orderkey::bigint, l_linenumber::bigint, null from lineitem where l_orderkey % 3 = 0),
  r as (select q, ((rank() over (order by q) - 1 + (count(*) over (partition by q) + 1) / 2.0::double) / (count(*) over ())::double)::double as s from v where q is not null),
  t as (select distinct q, {rx('s', 4)} as share from r)
  select k, line, v.q as quantity, share as quantity_norm from v left join t on v.q = t.q""",
)
def shares_with_repeated_keys(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity").cast("double")).alias("quantity"),
    )
    return ordering.with_rank_shares(li, {"quantity": ("quantity", "pct")}).select("k", "line", "quantity", "quantity_norm")


@query(
    "latest_order_per_customer",
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1""",
)
def latest_order_per_customer(spark, d):
    o = table(spark, d, "orders")
    return ordering.keep_first(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "running_sequence_per_customer",
    "select o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::bigint as seq from orders",
)
def running_sequence_per_customer(spark, d):
    return ordering.running_sequence(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "seq")


@query(
    "running_sequence_of_lines",
    """select l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  (row_number() over (partition by l_returnflag, l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::bigint as seq from lineitem""",
)
def running_sequence_of_lines(spark, d):
    li = table(spark, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return ordering.running_sequence(ordering.dense_ordinal(li, order), ["l_returnflag", "l_linestatus"], "ordinal").select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "seq"
    )


@query(
    "first_document_per_text",
    "select doc_id, source from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1",
)
def first_document_per_text(spark, d):
    return ordering.keep_first(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "source")


@query(
    "first_names_per_nation",
    """select c_nationkey as nation, string_agg(c_name, '|' order by c_custkey) as names from
  (select *, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) where rn <= 8 group by c_nationkey""",
)
def first_names_per_nation(spark, d):
    c = table(spark, d, "customer")
    return ordering.first_values(c, "c_nationkey", "c_name", "c_custkey", 8, "names").select(
        F.col("c_nationkey").alias("nation"), F.array_join("names", "|").alias("names")
    )


@query(
    "share_of_largest",
    """select o_orderkey, least(1.0::double, o_totalprice / greatest(max(o_totalprice) over (partition by o_custkey), 0.0001::double)) as share from orders""",
)
def share_of_largest(spark, d):
    return ordering.share_of_max(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "share")


@query(
    "ranked_breakdown",
    SCORED_SQL
    + "select well_id, coalesce(string_agg(k || '=' || v::varchar, ',' order by v desc, pos), '') as parts from (select well_id, unnest(["
    + ", ".join(f"'{k}'" for k in M)
    + "]) as k, unnest(["
    + ", ".join(f"round(part_{k} * 100)::bigint" for k in M)
    + "]) as v, unnest([0, 1, 2, 3, 4, 5]) as pos from final) where v is not null group by well_id",
)
def ranked_breakdown(spark, d):
    s = scored_sites(spark, d).withColumn("b", cases.ranked_breakdown())
    text = F.transform("b", lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("long").cast("string")))
    return s.select("well_id", F.array_join(text, ",").alias("parts"))


def _featured(s):
    return s.where("layer = 'hero'")


def _scored_columns(spark, d, *columns):
    """These columns of the scored sites, written once for several passes; no other column is computed."""
    return cut_lineage(scored_sites(spark, d).select(*columns))


def _view_rows(spark, d):
    return _scored_columns(spark, d, "well_id", "ordinal", "layer", "state", "county_group", "quad_name", "rank", "enrichment")


@query(
    "ranked_view_default",
    SCORED_SQL
    + """select well_id, (case when layer = 'hero' then 0 else 1 end)::int as section,
  row_number() over (order by case when layer = 'hero' then 0 else 1 end, case when layer = 'hero' then 0 else rank end, ordinal) as position
  from final where layer = 'hero' or state in ('Ohio', 'Pennsylvania', 'West Virginia', 'Kentucky')""",
)
def ranked_view_default(spark, d):
    s = _view_rows(spark, d)
    return view.ranked_view(s.where("layer <> 'hero'"), _featured(s)).select("well_id", "section", "position")


@query(
    "ranked_view_search_population",
    SCORED_SQL
    + """select well_id, (1)::int as section, row_number() over (order by coalesce(population_1mi, tract_population, 0) desc, ordinal) as position
  from final where layer <> 'hero' and state in ('Ohio', 'Pennsylvania', 'West Virginia', 'Kentucky') and (
   coalesce(contains(lower(quad_name), 'quad 1'), false) or coalesce(contains(lower(state), 'quad 1'), false)
   or coalesce(contains(lower(nearest_school), 'quad 1'), false) or coalesce(contains(lower(county), 'quad 1'), false))""",
)
def ranked_view_search_population(spark, d):
    s = _view_rows(spark, d)
    return view.ranked_view(s.where("layer <> 'hero'"), _featured(s), query="QUAD 1", sort="population").select("well_id", "section", "position")


@query(
    "ranked_view_region_schools",
    SCORED_SQL
    + """select well_id, (1)::int as section, row_number() over (order by coalesce(schools_within_1mi, 0) desc, ordinal) as position
  from final where layer <> 'hero' and state in ('Ohio', 'Pennsylvania', 'West Virginia', 'Kentucky') and county_group = 'C7_PA'""",
)
def ranked_view_region_schools(spark, d):
    s = _view_rows(spark, d)
    return view.ranked_view(s.where("layer <> 'hero'"), _featured(s), region="C7_PA", sort="schools").select("well_id", "section", "position")


@query(
    "cohort_with_featured",
    SCORED_SQL
    + """, scoped as (select * from final where state in ('Ohio', 'Pennsylvania', 'West Virginia', 'Kentucky')),
  top as (select well_id from scoped order by rank, ordinal limit 150)
  select well_id from scoped where well_id in (select well_id from top) or ordinal % 97 = 5""",
)
def cohort_with_featured(spark, d):
    s = _scored_columns(spark, d, "well_id", "ordinal", "state", "rank")
    # featured rows share a rank with a listed row, so the cut is made on (rank, ordinal)
    pos = ordering.global_position(s.withColumn("r", F.col("rank").cast("double")), "r", "ordinal", "at", descending=False)
    return tables.select_cohort(pos, s.where("ordinal % 97 = 5"), 150, cases.COHORT_STATES, rank="at").select("well_id")


@query(
    "run_cohort",
    SCORED_SQL
    + """, f as (select well_id from final where ordinal % 400 = 1),
  o as (select well_id, ordinal, rank from final where layer <> 'hero' and state_abbr in ('OH', 'PA', 'WV', 'KY') and well_id not in (select well_id from f))
  select well_id, 0::int as section from f union all select well_id, 1::int as section from
   (select well_id from o order by rank limit (select greatest(0, 60 - count(*)) from f))""",
)
def run_cohort(spark, d):
    s = _scored_columns(spark, d, "well_id", "ordinal", "layer", "state_abbr", "rank")
    featured = s.where("ordinal % 400 = 1")
    return tables.select_run_cohort(s.where("layer <> 'hero'"), featured, 60, ["OH", "PA", "WV", "KY"]).select("well_id", "section")


@query(
    "region_suffix_filter",
    f"select county_group, count(*)::bigint as n from ({SQL_SITES}) where regexp_matches(county_group, '_(PA|OH|WV|KY)$') group by county_group",
)
def region_suffix_filter(spark, d):
    c = profile.counts_by(site_base(spark, d), "county_group")
    return view.view_regions(c).select("county_group", F.col("count").alias("n"))
