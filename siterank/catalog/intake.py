"""Registries, map detections, pixels and known-site exclusion as composed runs over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siterank.catalog.base import STATE_NAMES, STATES, at, pick, points, query, rx, site_base, sql_lat, sql_lon, sql_pick, sql_points, squares, table
from siterank.catalog.base import SQL_SITES, SQL_SQUARES
from siterank.catalog.spatial import DIST
from siterank.functions.geo import AlbersConus
from siterank.operators import components
from siterank.plans import detections, registries

# --- registries -------------------------------------------------------------
OH_STATUS = ["Orphan", "Plugged", "Abandoned", "Idle", "Active"]
OH_NORM = ["orphan", "plugged", "abandoned", "idle", "unknown"]
KINDS, KIND_NORM = ["Oil", "Gas", "O&G"], ["oil", "gas", "oil_gas"]
NY_STATUS, NY_NORM = ["Plugged & Abandoned", "TA", " ", "DV"], ["plugged", "idle", "unknown", "abandoned"]


@query(
    "registries_built",
    f"""select (3400000000 + o_orderkey)::varchar as api, {sql_lat('o_orderkey')} as lat, {sql_lon('o_orderkey')} as lon,
    {sql_pick(KIND_NORM, 'o_orderkey % 3')} as type, {sql_pick(OH_NORM, 'o_orderkey % 5')} as status,
    upper(o_orderpriority) as operator, ((o_orderkey % 7 + 1) * 111)::double as depth, 'OH' as state_abbr
  from orders where o_orderkey % 5 <> 4 and o_orderkey % 11 <> 0
  union all
  select lpad((p_partkey + 3100100000)::varchar, 10, '0'), round(40.0::double + (p_partkey % 1000)::double / 1000.0::double, 3), -75.5::double,
    {sql_pick(KIND_NORM, 'p_partkey % 3')}, {sql_pick(NY_NORM, 'p_partkey % 4')},
    case when p_partkey % 10 <> 0 then upper(p_name) end, case when p_size <> 1 then (p_size * 1000 - 1000)::double end, 'NY'
  from part where p_partkey % 4 <> 2""",
)
def registries_built(spark, d):
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    oh = at(table(spark, d, "orders"), "o_orderkey").select(
        F.concat_ws("-", (F.lit(3400000000) + k).cast("string")).alias("API_WELLNO"),
        F.concat(((k % 7 + 1) * 111).cast("string"), F.lit(" ft")).alias("TOTAL_DEPTH"),
        pick(OH_STATUS, k % 5).alias("WELL_STATUS_DESCRIPTION"), pick(KINDS, k % 3).alias("WELL_TYPE"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("COMPANY_NAME"),
        F.when(k % 11 != 0, F.col("lat")).alias("__lat"), F.col("lon").alias("__lon"),
    )
    ny = table(spark, d, "part").select(
        F.concat((p + 3100100000).cast("string"), F.lit("-00-00")).alias("api_well_number"),
        ((F.col("p_size") - 1) * 1000).cast("string").alias("true_vertical_depth"),
        pick(NY_STATUS, p % 4).alias("well_status"), pick(KINDS, p % 3).alias("well_type"),
        F.when(p % 10 == 0, "n/a").otherwise(F.col("p_name")).alias("company_name"),
        F.concat(F.lit("40."), F.lpad((p % 1000).cast("string"), 3, "0")).alias("surface_latitude"), F.lit(" -75.5 ").alias("surface_longitude"),
    )
    return registries.build_registries({"OH": oh, "NY": ny, "ZZ": ny})


# --- map detections ---------------------------------------------------------
SCALES = ["24000", "62500", "100000", "n/a"]


def _features(spark, d):
    return site_base(spark, d).select("ordinal", "lat", "lon", "state", F.col("quad_name").alias("quad"), F.col("quad_year").cast("int").alias("year"))


def _ingested(spark, d):
    k = F.col("o_orderkey")
    inventory = table(spark, d, "orders").select(
        F.concat(F.lit(" QUAD "), (k % 37).cast("string")).alias("map_name"), (F.lit(1950) + k % 40).cast("string").alias("date_on_map"),
        F.concat(pick(STATE_NAMES, k % 6), F.lit(" ")).alias("primary_state"), pick(SCALES, F.floor(k / 7) % 4).alias("map_scale"),
    )
    return detections.build_detections(_features(spark, d), inventory, squares(spark, d), points(spark, d, "supplier", "s_suppkey"))


_X, _Y = AlbersConus.sql_xy("lat", "lon")
INGEST_SQL = f"""with s as (select *, {_X} as x, {_Y} as y from ({SQL_SITES})), k as ({sql_points('supplier', 's_suppkey')}),
  i as (select 'quad ' || (o_orderkey % 37)::varchar as quad, (1950 + o_orderkey % 40)::varchar as year, {sql_pick(STATE_NAMES, 'o_orderkey % 6')} as state,
    case (o_orderkey // 7) % 4 when 0 then 24000 when 1 then 62500 when 2 then 100000 end as scale from orders),
  l as (select quad, year, state, count(distinct scale) as n, case when count(distinct scale) = 1 then min(scale) when bool_or(scale = 24000) then 24000 else min(scale) end as scale
    from i where scale is not null group by all),
  p as ({SQL_SQUARES}),
  c as (select s.well_id, min(p.name) as county from s join p on s.lon > p.x0 and s.lon < p.x0 + 0.4::double and s.lat > p.y0 and s.lat < p.y0 + 0.4::double group by s.well_id),
  m as (select s.well_id, {rx(f'min({DIST})', 1)} as metres from s cross join k group by s.well_id),
  f as (select s.*, coalesce(l.scale, 24000) as scale, case when l.n is null then 'default' when l.n > 1 then 'ambiguous' else 'exact' end as lookup_status,
      coalesce(c.county || '_' || s.state_abbr, 'Unknown_' || s.state_abbr) as county, m.metres from s
    left join l on l.quad = lower(s.quad_name) and l.year = s.quad_year and l.state = s.state left join c using (well_id) join m using (well_id)),
  n as (select *, row_number() over (partition by state_abbr, quad_name, quad_year, scale order by ordinal) - 1 as seq from f),
  r as (select 'unet_' || state_abbr || '_' || replace(quad_name, ' ', '-') || '_' || quad_year || '_' || scale::varchar || '_geo_' || seq::varchar as well_id,
    'Undocumented well · ' || quad_name || ' quad (' || quad_year || ')' as name, scale::varchar as quad_scale, lookup_status, seq::int as detection_index,
    county as county_group, metres as nearest_doc_well_m from n)
"""


@query("detections_ingested", INGEST_SQL + "select * from r")
def detections_ingested(spark, d):
    return _ingested(spark, d).select("well_id", "name", "quad_scale", "lookup_status", "detection_index", "county_group", "nearest_doc_well_m")


@query(
    "ingest_report",
    INGEST_SQL + """select count(*)::bigint as features_in, count(*) filter (where lookup_status = 'exact')::bigint as scale_exact,
    count(*) filter (where lookup_status = 'ambiguous')::bigint as scale_ambiguous, count(*) filter (where lookup_status = 'default')::bigint as scale_default,
    count(*) filter (where county_group like 'Unknown\\_%' escape '\\')::bigint as county_fallback, count(*) filter (where nearest_doc_well_m is null)::bigint as nearest_null,
    (count(*) - count(distinct well_id))::bigint as duplicate_ids from r""",
)
def ingest_report(spark, d):
    return detections.ingest_report(_ingested(spark, d))


@query(
    "candidates_replaced",
    INGEST_SQL + f"""select well_id, name, nearest_doc_well_m from r
  union all select case when c_custkey % 3 = 0 then 'lbnl_' else 'w' end || c_custkey::varchar, c_name, null from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""",
)
def candidates_replaced(spark, d):
    k = F.col("c_custkey")
    prefix = F.when(k % 3 == 0, "lbnl_").when(k % 2 == 0, "w").otherwise("unet_old_")
    stored = table(spark, d, "customer").select(F.concat(prefix, k.cast("string")).alias("well_id"), F.col("c_name").alias("name"), F.lit(None).cast("double").alias("nearest_doc_well_m"))
    fresh = _ingested(spark, d)
    once = detections.replace_source(stored, fresh.select(*stored.columns), "unet_")
    # a second run of the same source changes nothing
    return detections.replace_source(once, fresh.select(*stored.columns), "unet_")


# --- map manifest -----------------------------------------------------------
_SERIES = "(case when o_orderkey % 5 = 0 then '62500' else '24000' end)"
_YEAR = "(1940 + o_orderkey % 60)"
MANIFEST_SQL = f"""with inv as (select o_orderkey, {sql_pick(STATE_NAMES, 'o_orderkey % 6')} as primary_state, o_orderkey % 211 as quad, {_YEAR} as year,
    {_SERIES} as scale, case when o_orderkey % 17 <> 0 then 'u' end as url, -82.0::double + (o_orderkey % 4) as w, 39.0::double + (o_orderkey % 3) as s from orders),
  m as (select *, row_number() over (partition by primary_state, quad order by year desc, o_orderkey) as rn from inv
    where scale = '24000' and primary_state in ('Ohio', 'Pennsylvania', 'Kentucky') and year between 1947 and 1992 and url is not null
      and w + 0.0625::double between -81.5::double and -78.5::double and s + 0.0625::double between 38.5::double and 40.5::double)
"""


def _manifest(spark, d):
    k = F.col("o_orderkey")
    west, south = F.lit(-82.0) + k % 4, F.lit(39.0) + k % 3
    inventory = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.when(k % 5 == 0, "62500").otherwise("24000").alias("map_scale"), F.lit(" 7.5 X 7.5 Minute").alias("grid_size"),
        pick(STATE_NAMES, k % 6).alias("primary_state"), (F.lit(1940) + k % 60).cast("string").alias("date_on_map"), (k % 211).alias("quad"),
        F.when(k % 17 != 0, "u").when(k % 2 == 0, "").alias("geotiff_url"), (k % 100000).cast("string").alias("product_filesize"), k.cast("string").alias("scan_id"),
        *[c.cast("string").alias(n) for n, c in {"westbc": west, "eastbc": west + 0.125, "southbc": south, "northbc": south + 0.125}.items()],
    )
    kept = detections.filter_inventory(inventory, ["Ohio", "Pennsylvania", "Kentucky"], bbox=(-81.5, 38.5, -78.5, 40.5))
    return detections.latest_per_map(kept, ["primary_state", "quad"], F.col("date_on_map").cast("int"))


@query("map_manifest", MANIFEST_SQL + "select o_orderkey as ordinal, primary_state, quad, year::varchar as date_on_map from m where rn = 1")
def map_manifest(spark, d):
    return _manifest(spark, d).select("ordinal", "primary_state", "quad", "date_on_map")


@query("manifest_totals", MANIFEST_SQL + "select primary_state, count(*)::bigint as maps, sum(o_orderkey % 100000)::bigint as bytes from m where rn = 1 group by primary_state")
def manifest_totals(spark, d):
    return detections.manifest_totals(_manifest(spark, d))


@query(
    "run_progress",
    MANIFEST_SQL + """, done as (select o_orderkey, o_orderkey % 9 as c from orders where o_orderkey % 3 = 1)
  select primary_state, count(*)::bigint as maps, count(c)::bigint as completed, (count(*) - count(c))::bigint as pending, coalesce(sum(c), 0)::bigint as candidates
  from m left join done using (o_orderkey) where rn = 1 and primary_state in ('Ohio', 'Kentucky') group by primary_state""",
)
def run_progress(spark, d):
    k = F.col("o_orderkey")
    outputs = table(spark, d, "orders").select(k.cast("string").alias("scan_id"), (k % 3 == 1).alias("valid"), (k % 9).alias("candidates"))
    return detections.run_progress(detections.load_manifest(_manifest(spark, d), ["oh", "KY"]), outputs)


# --- known sites ------------------------------------------------------------
def _maps(spark, d):
    k = F.col("n_nationkey")
    west, south = F.lit(-82.0) + (k % 5) * 0.4, F.lit(39.0) + F.floor(k / 5) * 0.4
    return table(spark, d, "nation").select(k.cast("long").alias("map_id"), west.alias("west"), (west + 0.4).alias("east"), south.alias("south"), (south + 0.4).alias("north"))


SQL_MAPS = """select n_nationkey::bigint as map_id, -82.0::double + (n_nationkey % 5) * 0.4::double as west, -82.0::double + (n_nationkey % 5) * 0.4::double + 0.4::double as east,
  39.0::double + (n_nationkey // 5) * 0.4::double as south, 39.0::double + (n_nationkey // 5) * 0.4::double + 0.4::double as north from nation"""
_ARC = "2.0::double * 6373000.0::double * asin(sqrt(pow(sin(radians(k.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - s.lon) / 2), 2)))"


@query(
    "detections_beyond_known",
    f"""with s as ({sql_points('customer', 'c_custkey')}), k as ({sql_points('part', 'p_partkey')}), maps as ({SQL_MAPS}),
  j as (select k.*, maps.map_id from k join maps on k.lon between west - 0.002::double and east + 0.002::double and k.lat between south - 0.002::double and north + 0.002::double where map_id <> 7),
  m as (select s.ordinal, s.ordinal % 25 as map_id, min({_ARC}) as metres from s left join j k on k.map_id = s.ordinal % 25 group by all)
  select ordinal, map_id, round_even(metres, 0)::bigint as dist_to_documented_m from m where metres is null or metres > 4000""",
)
def detections_beyond_known(spark, d):
    found = points(spark, d, "customer", "c_custkey").select("ordinal", "lat", "lon", (F.col("ordinal") % 25).alias("map_id"))
    known = points(spark, d, "part", "p_partkey").select("ordinal", "lat", "lon")
    return detections.exclude_known(found, known, _maps(spark, d).where("map_id <> 7"), km=4.0).select("ordinal", "map_id", "dist_to_documented_m")


@query(
    "reproduction_within_maps",
    f"""with s as ({sql_points('part', 'p_partkey')}), k as ({sql_points('customer', 'c_custkey')}), maps as ({SQL_MAPS}),
  p as (select * from s where exists (select 1 from maps where map_id % 2 = 0 and s.lon between west and east and s.lat between south and north)),
  m as (select s.ordinal, min({_ARC}) as metres from p s cross join k group by s.ordinal)
  select count(*)::bigint as published, count(*) filter (where metres <= 1500)::bigint as matched,
    (count(*) filter (where metres <= 1500))::double / count(*) as rate, (count(*) filter (where metres <= 1500))::double / count(*) >= 0.7 as passed from m""",
)
def reproduction_within_maps(spark, d):
    ours, published = points(spark, d, "customer", "c_custkey").select("ordinal", "lat", "lon"), points(spark, d, "part", "p_partkey").select("ordinal", "lat", "lon")
    return detections.reproduction(published, ours, _maps(spark, d).where("map_id % 2 = 0"), tolerance_m=1500.0)


# --- pixels -----------------------------------------------------------------
def _rectangles(spark, d):
    """One rectangle a part, in a raster of ten by as many as needed, at least two pixels apart."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        (k % 4).alias("map_id"), (F.floor(k / 40) * 64 + 3).cast("int").alias("top"), (F.floor(k / 4) % 10 * 64 + 5).cast("int").alias("left"),
        (F.col("p_size") + 2).alias("height"), (k % 13 + 1).cast("int").alias("width"),
    )


SQL_RECTANGLES = """select p_partkey % 4 as map_id, (p_partkey // 40) * 64 + 3 as top, (p_partkey // 4) % 10 * 64 + 5 as "left", p_size + 2 as height, p_partkey % 13 + 1 as width from part"""


def _pixels(spark, d):
    rows = _rectangles(spark, d).select("*", F.explode(F.expr("sequence(top, top + height - 1)")).alias("row"))
    return rows.select("map_id", "row", F.explode(F.expr("sequence(`left`, `left` + width - 1)")).alias("col"))


@query(
    "pixel_blobs",
    f"""select map_id, (height * width)::bigint as area, round_even(top + (height - 1) / 2.0::double, 0)::int as row, round_even("left" + (width - 1) / 2.0::double, 0)::int as col
  from ({SQL_RECTANGLES}) where height * width >= 45""",
)
def pixel_blobs(spark, d):
    return components.blobs(_pixels(spark, d))


@query(
    "pixels_over_threshold",
    f"""with p as (select map_id, top + r as row, "left" + c as col from ({SQL_RECTANGLES}), (select unnest(range(60)) as r), (select unnest(range(14)) as c)
    where r < height and c < width and (top + r + "left" + c) % 3 > 0)
  select map_id, count(*)::bigint as pixels, sum(row)::bigint as rows, sum(col)::bigint as cols from p where row < 2000 and col < 500 group by map_id""",
)
def pixels_over_threshold(spark, d):
    # every pixel lies in the tiles of two starts, as where tiles overlap
    p = _pixels(spark, d).withColumn("prob", (F.col("row") + F.col("col")) % 3 * 0.5 + 0.25)
    tiles = reduce(lambda a, b: a.unionByName(b), [
        p.select("map_id", (F.floor(F.col("row") / n) * n).cast("int").alias("tile_row"), (F.floor(F.col("col") / n) * n).cast("int").alias("tile_col"),
                 (F.col("row") % n).alias("r"), (F.col("col") % n).alias("c"), "prob") for n in (256, 231)
    ])
    maps = p.select("map_id").distinct().withColumns({"height": F.lit(2000), "width": F.lit(500)})
    return detections.threshold_tiles(tiles, maps).groupBy("map_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("row").cast("long").alias("rows"), F.sum("col").cast("long").alias("cols")
    )


@query(
    "tiles_of_maps",
    """with m as (select c_custkey as map_id, 200 + c_custkey * 37 % 1200 as h, 200 + c_custkey * 53 % 1200 as w from customer),
  s as (select 0 as i, 0 as start union all select i, 256 * i - 25 from (select unnest(range(1, 10)) as i))
  select m.map_id, a.start::int as tile_row, b.start::int as tile_col from m join s a on a.i * 256 <= m.h + 24 join s b on b.i * 256 <= m.w + 24""",
)
def tiles_of_maps(spark, d):
    k = F.col("c_custkey")
    maps = table(spark, d, "customer").select(k.alias("map_id"), (k * 37 % 1200 + 200).cast("int").alias("height"), (k * 53 % 1200 + 200).cast("int").alias("width"))
    return detections.tile_index(maps)
