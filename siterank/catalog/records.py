"""Actors, cases, the sidecar, the fact store and table operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.catalog.base import SQL_SITES, SQL_SQUARES, STATES, pick, points, query, rx, site_base, sql_pick, sql_points, squares, table
from siterank.catalog.ranking import SCORED_SQL, scored_sites
from siterank.catalog.spatial import DIST, SITES
from siterank.functions import text as tx
from siterank.operators import tables
from siterank.plans import cases, enrich, knowledge, profile

# --- actors -----------------------------------------------------------------
STATES_OR_ALL = [*STATES, cases.WILDCARD_STATE]


def _regulators(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        pick(STATES[:5], k % 5).alias("state_abbr"), k.alias("ordinal"), F.col("n_name").alias("agency"), F.lit("division").alias("division"),
        F.lit("program").alias("program_name"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("program_url"),
        F.concat(F.lit("a"), k.cast("string")).alias("agency_url"), F.when(k % 3 != 0, k.cast("string")).otherwise("").alias("phone"), F.lit("").alias("email"),
    )


def _organisations(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        pick(STATES_OR_ALL, k % 7).alias("state_abbr"), k.alias("ordinal"), F.concat(F.lit("org "), "n_name").alias("org"),
        F.lit("scope").alias("scope"), F.lit("focus").alias("focus"), F.lit("url").alias("url"),
    )


def _legislators(spark, d):
    """The first term of everybody was in another state; only the last one counts."""
    k = F.col("s_suppkey")

    def term(state):
        kind = F.when(k % 25 == 0, "sen").otherwise("rep")
        district = F.when(k % 25 != 0, (k % 40).cast("int"))
        return F.struct(state.alias("state"), kind.alias("type"), district.alias("district"), F.lit("I").alias("party"), F.lit("1").alias("phone"), F.lit("u").alias("url"))

    return table(spark, d, "supplier").select(
        k.alias("ordinal"), F.struct(F.col("s_name").alias("official_full")).alias("name"),
        F.when(k % 31 == 0, F.array().cast(f"array<{'struct<state:string,type:string,district:int,party:string,phone:string,url:string>'}>"))
        .otherwise(F.array(term(pick(STATES, (k + 1) % 6)), term(pick(STATES, k % 6)))).alias("terms"),
    )


def _state_people(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("ordinal"), pick(STATES, k % 6).alias("state_abbr"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"),
        F.when(F.floor(k / 6) % 2 == 0, "upper").otherwise("lower").alias("current_chamber"), F.concat(F.lit("00"), (F.floor(k / 12) % 50).cast("string")).alias("current_district"),
        F.lit("I").alias("current_party"), F.lit("").alias("email"),
    )


def _placed(df):
    k = F.col("ordinal")
    return df.withColumns({
        "cd": F.concat(F.lit("District 0"), (k % 40).cast("string")), "sldu": F.concat(F.lit("SD-"), (k % 30).cast("string")),
        "sldl": F.when(k % 4 != 0, F.concat(F.lit("HD "), (k % 60).cast("string"))),
    })


ACTORS_SQL = f"""reg as (select * from (select {sql_pick(STATES[:5], 'n_nationkey % 5')} as state_abbr, n_name as agency,
    case when n_nationkey % 2 = 0 then 'a' || n_nationkey::varchar else 'p' || n_nationkey::varchar end as url,
    case when n_nationkey % 3 <> 0 then n_nationkey::varchar end as phone, row_number() over (partition by n_nationkey % 5 order by n_nationkey) as rn from nation) where rn = 1),
  org0 as (select {sql_pick(STATES_OR_ALL, 'n_nationkey % 7')} as st, n_nationkey as o, 'org ' || n_name as org from nation),
  orgs as (select t.state_abbr, string_agg(org, '|' order by o) as orgs from (select unnest({STATES!r}) as state_abbr) t join org0 on st = t.state_abbr or st = 'ALL' group by t.state_abbr),
  leg as (select s_suppkey as o, s_name as name, {sql_pick(STATES, 's_suppkey % 6')} as state_abbr, s_suppkey % 25 = 0 as senator, (s_suppkey % 40)::varchar as district from supplier where s_suppkey % 31 <> 0),
  sens as (select state_abbr, string_agg(name, '|' order by o) as senators from leg where senator group by state_abbr),
  reps as (select state_abbr, district, arg_min(name, o) as representative from leg where not senator group by all),
  pers as (select {sql_pick(STATES, 'p_partkey % 6')} as state_abbr, (p_partkey // 6) % 2 = 0 as is_upper, ((p_partkey // 12) % 50)::varchar as district, arg_min(p_name || ' ' || p_partkey::varchar, p_partkey) as name
    from part group by all)"""
ACTORS_JOIN = """left join reg on reg.state_abbr = s.state_abbr left join orgs on orgs.state_abbr = s.state_abbr left join sens on sens.state_abbr = s.state_abbr
  left join reps on reps.state_abbr = s.state_abbr and reps.district = (s.ordinal % 40)::varchar
  left join pers u on u.state_abbr = s.state_abbr and u.is_upper and u.district = (s.ordinal % 30)::varchar
  left join pers l on l.state_abbr = s.state_abbr and not l.is_upper and s.ordinal % 4 <> 0 and l.district = (s.ordinal % 60)::varchar"""


@query(
    "actors_of_sites",
    f"""with s as ({SQL_SITES}), {ACTORS_SQL}
  select s.well_id, reg.agency, reg.url, reg.phone, coalesce(sens.senators, '') as senators, reps.representative, coalesce(orgs.orgs, '') as orgs,
    concat_ws('|', u.name, l.name) as legislators, sens.senators is not null or reps.representative is not null as federal from s {ACTORS_JOIN}""",
)
def actors_of_sites(spark, d):
    sites = _placed(site_base(spark, d)).select("well_id", "ordinal", "state_abbr", "cd", "sldu", "sldl")
    out = cases.attach_actors(sites, _regulators(spark, d), _organisations(spark, d), _legislators(spark, d), _state_people(spark, d))
    pressure = F.col("actors.can_pressure")

    def names(c, field):
        return F.array_join(F.transform(pressure[c], lambda s: s[field]), "|")

    return out.select(
        "well_id", F.col("actors.responsible_regulator.agency").alias("agency"), F.col("actors.can_fund.url").alias("url"), F.col("actors.can_fund.phone").alias("phone"),
        names("us_senators", "name").alias("senators"), pressure["us_representative"]["name"].alias("representative"), names("ej_orgs", "org").alias("orgs"),
        names("state_legislators", "name").alias("legislators"), F.col("actors.available.federal").alias("federal"),
    )


# --- cases ------------------------------------------------------------------
def _cases(spark, d):
    scored = scored_sites(spark, d)
    stories = table(spark, d, "customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("well_id"), F.struct(F.concat(F.lit("story of "), "c_name").alias("text"), F.lit("t").alias("generated_by")).alias("story")
    )
    # ranks are made unique, as featured rows share one with a listed row
    unique = scored.withColumn("rank", F.col("global_rank"))
    return cases.assemble_cases(
        unique, scored.where("ordinal % 97 = 5"), _regulators(spark, d), _organisations(spark, d), _legislators(spark, d), _state_people(spark, d),
        districts={"cd": squares(spark, d).withColumn("basename", F.col("name"))}, existing=stories,
    )


CASES_SQL = SCORED_SQL + f""", scoped as (select * from final where state in ('Ohio', 'Pennsylvania', 'West Virginia', 'Kentucky')),
  top as (select well_id from scoped order by global_rank limit 150), p as ({SQL_SQUARES}),
  cd as (select s.well_id, min(p.name) as cd from scoped s join p on s.lon > p.x0 and s.lon < p.x0 + 0.4::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double group by s.well_id),
  {ACTORS_SQL.replace('select *,', 'select *, ')},
  cased as (select s.well_id, s.global_rank::bigint as rank, coalesce(s.county, s.county_group) as county, s.composite,
    case when coalesce(s.population_1mi, 0) <> 0 then s.population_1mi else s.tract_population end as people, s.quad_year || ' ' || s.quad_name as quad,
    s.nearest_doc_well_m, cd.cd, reg.agency, coalesce(sens.senators, '') as senators, case when s.ordinal % 2 = 0 then 'story of ' || s.name end as story
    from scoped s left join cd using (well_id) left join reg on reg.state_abbr = s.state_abbr left join sens on sens.state_abbr = s.state_abbr
    where s.well_id in (select well_id from top) or s.ordinal % 97 = 5)
"""


@query("case_records", CASES_SQL + "select * from cased")
def case_records(spark, d):
    return _cases(spark, d).select(
        "well_id", "rank", "county", F.col("evidence.composite").alias("composite"), F.col("evidence.population_1mi").alias("people"), F.col("evidence.quad").alias("quad"),
        F.col("evidence.nearest_doc_well_m").alias("nearest_doc_well_m"), F.col("actors.districts.cd").alias("cd"), F.col("actors.responsible_regulator.agency").alias("agency"),
        F.array_join(F.transform("actors.can_pressure.us_senators", lambda s: s["name"]), "|").alias("senators"), F.col("story.text").alias("story"),
    )


@query("case_summary", CASES_SQL + "select count(*)::bigint as cases, count(story)::bigint as briefs, 0::bigint as named_owners from cased")
def case_summary(spark, d):
    return cases.case_summary(_cases(spark, d))


# --- the sidecar ------------------------------------------------------------
@query(
    "sidecar_of_sites",
    f"""with s as ({SITES}), k as ({sql_points('part', 'p_partkey')}), p as ({SQL_SQUARES}),
  t as (select s.ordinal, min(p.ordinal) as t from s join p on s.lon > p.x0 and s.lon < p.x0 + 0.4::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double group by s.ordinal),
  h as (select s.ordinal, count(*) filter (where {DIST} <= 8046.7)::bigint as n, {rx(f'min({DIST})', 1)} as m from s cross join k group by s.ordinal),
  j as (select s.ordinal, t.t, s.ordinal % 3 = 0 as had, h.n, h.m from s left join t using (ordinal) join h using (ordinal))
  select 'w' || ordinal::varchar as well_id, n as hospitals_within_5mi, m as nearest_hospital_m,
    coalesce('G' || t::varchar, case when had then 'OLD' end) as tract_geoid,
    coalesce(case when t % 2 = 0 then t % 4 = 0 end, case when had then true end) as cejst_disadvantaged,
    coalesce(case when t % 3 = 0 then t::double / 32.0::double end, case when had then 0.25::double end) as eji_rank,
    coalesce(case when had and ordinal % 2 = 0 then 0.5::double end, case when t % 5 <> 0 then t::double / 64.0::double end) as svi,
    coalesce(case when had then 'kept' end, case when t % 5 <> 0 then 'county ' || t::varchar end) as county from j""",
)
def sidecar_of_sites(spark, d):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    n = table(spark, d, "nation").withColumn("geoid", F.concat(F.lit("G"), k.cast("string")))
    vulnerability = n.where("n_nationkey % 5 <> 0").select(
        "geoid", (k / 64.0).cast("double").alias("svi"), F.concat(F.lit("county "), k.cast("string")).alias("county"),
        *[F.lit(None).cast("double").alias(x) for x in enrich.SVI_KEYS if x not in ("svi", "county")],
    )
    existing = table(spark, d, "customer").where("c_custkey % 3 = 0").select(
        F.concat(F.lit("w"), c.cast("string")).alias("well_id"), F.when(c % 2 == 0, 0.5).alias("svi"), F.lit("kept").alias("county"), F.lit(True).alias("cejst_disadvantaged"),
        F.lit(0.25).alias("eji_rank"), F.lit(99).cast("long").alias("hospitals_within_5mi"), F.lit("OLD").alias("tract_geoid"),
    )
    out = enrich.enrich_sites(
        site_base(spark, d), tracts=squares(spark, d), hospitals=points(spark, d, "part", "p_partkey"), flags=n.where("n_nationkey % 2 = 0").select("geoid", (k % 4 == 0).alias("cejst_disadvantaged")),
        ranks=n.where("n_nationkey % 3 = 0").select("geoid", (k / 32.0).cast("double").alias("eji_rank")), vulnerability=vulnerability, existing=existing,
    )
    return out.select("well_id", "hospitals_within_5mi", "nearest_hospital_m", "tract_geoid", "cejst_disadvantaged", "eji_rank", "svi", "county")


_ARC = "2.0::double * 6371000.0::double * asin(sqrt(pow(sin(radians(k.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - s.lon) / 2), 2)))"


@query(
    "schools_around_points",
    f"""with s as ({SITES}), k as ({sql_points('part', 'p_partkey', 'p_name')}),
  j as (select s.ordinal, k.p_name, k.ordinal as ko, {_ARC} as m from s cross join k), i as (select * from j where m <= 5000),
  r as (select *, row_number() over (partition by ordinal order by ko) as rn, row_number() over (partition by ordinal order by m, ko) as near from i),
  g as (select ordinal, count(*)::bigint as n, {rx('min(m)', 1)} as m, max(p_name) filter (where near = 1) as name, string_agg(p_name, '|' order by ko) filter (where rn <= 8) as names from r group by ordinal)
  select s.ordinal, coalesce(n, 0)::bigint as schools_within_1mi, m as nearest_school_m, name as nearest_school, coalesce(names, '') as names from s left join g using (ordinal)""",
)
def schools_around_points(spark, d):
    sites = points(spark, d, "customer", "c_custkey").select("ordinal", "lat", "lon")
    out = enrich.schools_around(sites, points(spark, d, "part", "p_partkey"), name="p_name", radius_m=5000.0)
    return out.select("ordinal", "schools_within_1mi", "nearest_school_m", "nearest_school", F.array_join("school_names", "|").alias("names"))


# --- facts ------------------------------------------------------------------
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
FACTS_SQL = f"""with all_facts as (select doc_id, source as topic, {_TRIM} as value, substr(sha1(source || ':' || {_TRIM}), 1, 12) as key from documents where {_TRIM} <> ''),
  stored as (select *, row_number() over (partition by key order by doc_id) as rn from all_facts where doc_id % 3 = 0),
  fresh as (select *, row_number() over (partition by key order by doc_id) as rn from all_facts where key not in (select key from stored)),
  store as (select key, topic, doc_id from stored where rn = 1 union all select key, topic, doc_id from fresh where rn = 1)
"""


def _fact_store(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("source").alias("topic"), F.col("text").alias("value"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("well_id"), F.col("doc_id").alias("ordinal")
    )
    store = knowledge.record_facts(knowledge.as_facts(rows.limit(0)), rows.where("ordinal % 3 = 0"))
    # all rows again: what is stored stays as it is
    return knowledge.record_facts(store, rows)


@query("facts_recorded", FACTS_SQL + "select key, topic, doc_id as ordinal from store")
def facts_recorded(spark, d):
    return _fact_store(spark, d).select("key", "topic", "ordinal")


@query("facts_by_topic", FACTS_SQL + "select topic, doc_id as ordinal from (select *, row_number() over (partition by topic order by doc_id, key) as rn from store) where rn <= 8")
def facts_by_topic(spark, d):
    return knowledge.facts_by_topic(_fact_store(spark, d)).select("topic", "ordinal")


@query(
    "unique_sources",
    """with t as (select conv_id, turn, role || conv_id % 3 as url, case when turn % 2 = 0 then text else '' end as title from conversations where role <> 'system'),
  f as (select *, substr(coalesce(nullif(title, ''), url), 1, 90) as cut, row_number() over (partition by conv_id, url order by turn) as rn from t)
  select conv_id::varchar as well_id, string_agg(cut || ' ' || url, '|' order by turn) as sources from f where rn = 1 group by conv_id""",
)
def unique_sources(spark, d):
    cited = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("well_id"), F.when(F.col("role") != "system", F.concat("role", (F.col("conv_id") % 3).cast("string"))).alias("url"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("title"), F.col("turn").alias("position"),
    )
    return knowledge.unique_sources(cited).select("well_id", F.array_join(F.transform("sources", lambda s: F.concat(s["title"], F.lit(" "), s["url"])), "|").alias("sources"))


# --- table operators --------------------------------------------------------
@query(
    "layers_overlaid",
    """select c_custkey, case when o is not null then o when c_custkey % 3 = 0 then 'second' else 'first' end as layer
  from customer left join (select o_custkey, 'third' as o from orders where o_orderstatus = 'F' group by o_custkey) on o_custkey = c_custkey""",
)
def layers_overlaid(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    layers = [
        c.select("c_custkey", F.lit("first").alias("layer")), c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("second").alias("layer")),
        o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("third").alias("layer")),
    ]
    return tables.overlay_by_key(layers, "c_custkey")


@query(
    "ids_in_first_seen_order",
    """with u as (select o_custkey as id, 0 as list_no, o_orderkey as position from orders where o_orderstatus = 'O' union all select c_custkey, 1, c_custkey from customer)
  select id, list_no::int as list_no, position from (select *, row_number() over (partition by id order by list_no, position) as rn from u) where rn = 1""",
)
def ids_in_first_seen_order(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    first = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"))
    return tables.ordered_unique([first, c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"))], "id", "position")


@query(
    "metric_coverage",
    "with m as (" + " union all ".join(
        f"select '{c}' as metric, count({c})::bigint as present, count(distinct {c})::bigint as distinct_values, count({c})::double / count(*) as share from s" for c in ("depth_ft", "nearest_doc_well_m", "type_norm")
    ).replace(" from s", f" from ({SQL_SITES})") + ") select * from m",
)
def metric_coverage(spark, d):
    return profile.coverage(site_base(spark, d), ["depth_ft", "nearest_doc_well_m", "type_norm"])


@query(
    "known_points_per_source",
    """select 'suppliers' as known_source, count(*)::bigint as points from supplier union all select 'parts', count(*) from part""",
)
def known_points_per_source(spark, d):
    frames = {"suppliers": points(spark, d, "supplier", "s_suppkey").select("lat", "lon"), "parts": points(spark, d, "part", "p_partkey").select("lat", "lon")}
    return profile.known_points(frames)[1]


@query(
    "sites_funded_in_rank_order",
    """with r as (select row_number() over (order by o_totalprice desc, o_orderkey) as rank, (o_totalprice * 100)::bigint as cost from orders),
  s as (select *, sum(cost) over (order by rank) as spent from r)
  select count(*)::bigint as sites_funded, max(spent)::bigint as spent_usd from s where spent <= 47000000000""",
)
def sites_funded_in_rank_order(spark, d):
    from siterank.operators.ordering import global_position

    ranked = global_position(table(spark, d, "orders"), "o_totalprice", "o_orderkey")
    return profile.affordable(ranked.withColumn("cost", F.round(F.col("o_totalprice") * 100, 0).cast("long")), 47_000_000_000, cost="cost")


@query(
    "parsed_places",
    r"""select o_orderkey, (o_orderkey % 90)::double + 0.5::double as lat, case when o_orderkey % 7 <> 0 then -80.25::double end as lon,
    case when o_orderkey % 7 = 0 then null else ((o_orderkey % 90) * 10000 + 5000)::bigint end as lat4, (1900 + o_orderkey % 90)::varchar as map_year from orders""",
)
def parsed_places(spark, d):
    k = F.col("o_orderkey")
    text = F.concat((k % 90).cast("string"), F.lit(".5"), F.when(k % 7 != 0, F.lit(", -80.25")).otherwise(""))
    name = F.concat(F.lit("PA_Quad_1_"), (F.lit(1900) + k % 90).cast("string"), F.lit("_24000_geo.tif"))
    out = table(spark, d, "orders").select(k, tx.parse_coordinates(text).alias("p"), F.concat((k % 90).cast("string"), F.lit(".5")).cast("double").alias("lat"), tx.year_in_map_name(name).alias("map_year"))
    return out.select("o_orderkey", "lat", F.col("p.lon").alias("lon"), F.when(F.col("p.lat").isNotNull(), tx.point_key("p.lat", "p.lon")["lat4"]).alias("lat4"), "map_year")
