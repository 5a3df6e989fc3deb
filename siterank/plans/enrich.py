"""Enrich sites by area, proximity, buffers and tract tables, and merge into the sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.functions import models, text as tx
from siterank.functions.geo import (
    EARTH_RADIUS_M, HOSPITAL_RADIUS_M, MILE_M, MILE_POINT_M, arc_of_chord, chord_of_arc, with_planar, with_sphere,
)
from siterank.functions.numeric import round_exact, round_once
from siterank.operators.polygons import drinking_water, locate, population_in_buffer, resolve_tracts
from siterank.operators.spatial import build_index, count_within, names_within, nearest
from siterank.operators.tables import alias_column, merge_columns, upsert
from siterank.session import cut_lineage
from siterank.sources.keyed_store import KeyedStore

# --- fixed values -----------------------------------------------------------
EVENT_RADIUS_M = 2000.0
EVENT_MIN_RATE = 100.0
EVENT_ALIASES = {
    "lat": ["lat", "latitude", "y"],
    "lon": ["lon", "longitude", "lng", "x"],
    "emission_rate_kg_hr": ["emission_rate", "rate_kg_hr", "emission_rate_kg_hr", "rate", "ch4_kg_hr", "kg_hr"],
    "operator": ["operator", "company", "owner", "facility"],
    "event_date": ["event_date", "date", "detection_date", "observed"],
}
SVI_FIELDS = {
    "population": "E_TOTPOP", "daytime_population": "E_DAYPOP", "svi": "RPL_THEMES", "poverty_pct": "EP_POV150",
    "minority_pct": "EP_MINRTY", "svi_socioeconomic": "RPL_THEME1", "svi_minority": "RPL_THEME3",
}
SVI_COUNTS = ["population", "daytime_population"]
SVI_KEYS = [
    "population", "daytime_population", "svi", "poverty_pct", "minority_pct", "ej", "svi_socioeconomic",
    "svi_minority", "county",
]
MAX_NAMES = 8
POINT_COLUMNS = (
    "schools_within_1mi long, nearest_school string, school_names array<string>, nearest_school_m double, "
    "hospitals_within_5mi long, drinking_water_score double"
)
# ----------------------------------------------------------------------------


# --- proximity --------------------------------------------------------------
def hospital_proximity(sites: DataFrame, hospitals: DataFrame) -> DataFrame:
    """hospitals_within_5mi and nearest_hospital_m; both frames carry planar x, y."""
    index = build_index(hospitals, ["x", "y"], "ordinal")
    out = nearest(sites, index, out="__d")
    out = count_within(out, index, HOSPITAL_RADIUS_M, out="hospitals_within_5mi")
    return out.withColumn("nearest_hospital_m", round_exact("__d", 1)).drop("__d")


def school_proximity(sites: DataFrame, schools: DataFrame, name: str = "NAME") -> DataFrame:
    """Count within a mile, nearest school with its name, and the first eight names in range."""
    has_name = name in schools.columns
    carry = {name: "nearest_school"} if has_name else {}
    index = build_index(schools, ["x", "y"], "ordinal", list(carry))
    out = nearest(sites, index, carry=carry, out="__d")
    out = count_within(out, index, MILE_M, out="schools_within_1mi")
    if has_name:
        out = names_within(out, schools, MILE_M, name, n=MAX_NAMES, out="school_names")
    else:
        out = out.withColumns(
            {"nearest_school": F.lit(None).cast("string"), "school_names": F.array().cast("array<string>")}
        )
    return out.withColumn("nearest_school_m", round_exact("__d", 1)).drop("__d")


def schools_around(sites: DataFrame, schools: DataFrame, name: str = "NAME", radius_m: float = MILE_POINT_M) -> DataFrame:
    """Great-circle variant: the nearest school counts only when it lies inside the radius."""
    dims = ["gx", "gy", "gz"]
    s = with_sphere(schools)
    index = build_index(s, dims, "ordinal", [name])
    chord = chord_of_arc(radius_m, EARTH_RADIUS_M)
    out = nearest(with_sphere(sites), index, carry={name: "nearest_school"}, limit=chord, out="__c")
    out = count_within(out, index, chord, out="schools_within_1mi")
    out = names_within(out, s, chord, name, dims=dims, n=MAX_NAMES, out="school_names")
    return out.withColumn("nearest_school_m", round_once(arc_of_chord(F.col("__c"), EARTH_RADIUS_M), 1)).drop(
        "__c", *dims
    )


# --- events -----------------------------------------------------------------
def normalize_events(raw: DataFrame, min_rate: float = EVENT_MIN_RATE) -> DataFrame | None:
    """Event table by column aliases; rows without a rate stay, weak ones go.  None without coordinates."""
    from siterank.operators.tables import find_alias

    if not (find_alias(raw, EVENT_ALIASES["lat"]) and find_alias(raw, EVENT_ALIASES["lon"])):
        return None
    rate = tx.to_double(alias_column(raw, EVENT_ALIASES["emission_rate_kg_hr"]))
    return raw.select(
        tx.to_double(alias_column(raw, EVENT_ALIASES["lat"])).alias("lat"),
        tx.to_double(alias_column(raw, EVENT_ALIASES["lon"])).alias("lon"),
        rate.alias("emission_rate_kg_hr"),
        alias_column(raw, EVENT_ALIASES["operator"]).cast("string").alias("operator"),
        alias_column(raw, EVENT_ALIASES["event_date"]).cast("string").alias("event_date"),
        *[c for c in ("ordinal",) if c in raw.columns],
    ).where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()
        & (F.col("emission_rate_kg_hr").isNull() | (F.col("emission_rate_kg_hr") >= min_rate))
    )


def match_events(sites: DataFrame, events: DataFrame, radius_m: float = EVENT_RADIUS_M) -> DataFrame:
    """Nearest event of every site: distance, rate and operator always, the flag only inside the radius."""
    out = nearest(
        with_planar(sites), with_planar(events),
        carry={"emission_rate_kg_hr": "__rate", "operator": "operator"}, out="__d",
    )
    return out.select(
        "well_id",
        F.coalesce(F.col("__d") <= radius_m, F.lit(False)).alias("super_emitter"),
        round_exact("__d", 1).alias("super_emitter_dist_m"),
        round_exact("__rate", 1).alias("super_emitter_rate_kg_hr"),
        "operator",
    )


# --- tract tables -----------------------------------------------------------
def tract_flags(raw: DataFrame) -> DataFrame:
    """(geoid, cejst_disadvantaged); the key and flag columns are found by their names."""
    low = {c: c.lower() for c in raw.columns}
    geo = next((c for c, k in low.items() if "tract" in k and "id" in k), None)
    flag = next((c for c, k in low.items() if "disadvantaged" in k and "final" in k), None) or next(
        (c for c, k in low.items() if "disadvantaged" in k), None
    )
    if geo is None or flag is None:
        raise ValueError("the flag table needs a tract id and a disadvantaged column")
    return raw.where(F.col(f"`{geo}`").isNotNull()).select(
        tx.zero_fill(f"`{geo}`").alias("geoid"),
        F.coalesce(F.col(f"`{flag}`").cast("string").try_cast("boolean"), F.lit(False)).alias("cejst_disadvantaged"),
    )


def tract_ranks(raw: DataFrame) -> DataFrame:
    """(geoid, eji_rank) without the -999 rows, four decimals."""
    v = F.col("rpl_eji").cast("double")
    return raw.where(F.col("geoid").isNotNull() & v.isNotNull() & (v != -999)).select(
        tx.zero_fill("geoid").alias("geoid"), round_exact(v, 4).alias("eji_rank")
    )


def tract_vulnerability(raw: DataFrame) -> DataFrame:
    """(geoid, vulnerability columns) with the sentinels nulled and the derived EJ share."""
    cols = {}
    for out, src in SVI_FIELDS.items():
        v = models.drop_sentinel(F.col(src).cast("double"))
        cols[out] = v.cast("long") if out in SVI_COUNTS else v
    return raw.where(F.col("FIPS").isNotNull()).select(
        tx.zero_fill("FIPS").alias("geoid"),
        *[c.alias(n) for n, c in cols.items()],
        models.ej_proxy(F.col("EP_POV150").cast("double"), F.col("EP_MINRTY").cast("double")).alias("ej"),
        F.col("COUNTY").cast("string").alias("county"),
    )


def block_group_population(rows: DataFrame) -> DataFrame:
    """(geoid, pop) from (B01003_001E, state, county, tract, block_group); a bad number counts 0."""
    return rows.select(
        F.concat("state", "county", "tract", "block_group").alias("geoid"),
        F.coalesce(tx.to_double("B01003_001E"), F.lit(0.0)).alias("pop"),
    )


def point_attributes(sites: DataFrame, layer: DataFrame) -> DataFrame:
    """Vulnerability attributes of the tract that contains each point; nulls outside."""
    return locate(sites, layer, {c: c for c in SVI_KEYS}).drop("__hit")


# --- the sidecar ------------------------------------------------------------
def enrich_sites(sites: DataFrame, tracts: DataFrame | None = None, water: DataFrame | None = None,
                 hospitals: DataFrame | None = None, schools: DataFrame | None = None,
                 block_groups: DataFrame | None = None, flags: DataFrame | None = None,
                 ranks: DataFrame | None = None, vulnerability: DataFrame | None = None,
                 existing: DataFrame | None = None) -> DataFrame:
    """One sidecar row per site.  Absent layers leave their columns as they were.

    Proximity, water and tract flags replace earlier values; vulnerability only fills gaps.
    ``block_groups`` has planar rings; the other layers are in degrees.
    """
    df = with_planar(sites.select("well_id", "lat", "lon"))
    fresh = []
    if existing is not None:
        df = df.join(existing.withColumnRenamed("tract_geoid", "__old_geoid") if "tract_geoid" in existing.columns else existing, "well_id", "left")
    have = set(df.columns)

    def replacing(result: DataFrame, cols: list[str]) -> DataFrame:
        fresh.extend(cols)
        return result

    base = df
    stale = [c for c in ("drinking_water_score", "hospitals_within_5mi", "nearest_hospital_m", "schools_within_1mi",
                         "nearest_school", "nearest_school_m", "school_names") if c in have]
    old = {c: f"__old_{c}" for c in stale}
    for c, o in old.items():
        base = base.withColumnRenamed(c, o)
    if water is not None:
        base = replacing(drinking_water(base, water), ["drinking_water_score"])
    if hospitals is not None:
        base = replacing(hospital_proximity(base, with_planar(hospitals)), ["hospitals_within_5mi", "nearest_hospital_m"])
    if schools is not None:
        base = replacing(
            school_proximity(base, with_planar(schools)),
            ["schools_within_1mi", "nearest_school", "nearest_school_m", "school_names"],
        )
    for c, o in old.items():
        base = base.drop(o) if c in fresh else base.withColumnRenamed(o, c)
    if block_groups is not None:
        base = population_in_buffer(base, block_groups, out="__pop")
        prior = F.col("population_1mi") if "population_1mi" in have else F.lit(None)
        base = base.withColumn("population_1mi", F.coalesce(F.col("__pop"), prior)).drop("__pop")
    base = resolve_tracts(base, tracts)
    if flags is not None:
        base = merge_columns(base, flags.withColumnRenamed("geoid", "tract_geoid"), "tract_geoid", overwrite=["cejst_disadvantaged"])
    if ranks is not None:
        base = merge_columns(base, ranks.withColumnRenamed("geoid", "tract_geoid"), "tract_geoid", overwrite=["eji_rank"])
    if vulnerability is not None:
        base = merge_columns(base, vulnerability.withColumnRenamed("geoid", "tract_geoid"), "tract_geoid", fill=SVI_KEYS)
    if "__old_geoid" in base.columns:
        base = base.withColumn("tract_geoid", F.coalesce("tract_geoid", "__old_geoid")).drop("__old_geoid")
    return base.drop("x", "y", "lat", "lon")


def enrich_points(sites: DataFrame, cache: DataFrame, tracts: DataFrame, schools: DataFrame):
    """Point sidecar through a cache keyed by the four-decimal point.

    Only keys the cache lacks are computed, one representative per key; returns
    (sidecar rows, new cache).
    """
    keyed = sites.withColumn("pk", tx.point_key("lat", "lon"))
    fresh = _computed(_representatives(keyed.join(cache.select("pk"), "pk", "left_anti")), tracts, schools)
    new_cache = upsert(cache, fresh.select(*cache.columns), ["pk"])
    return keyed.select("well_id", "pk").join(new_cache, "pk", "left").drop("pk"), new_cache


def _representatives(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("pk").agg(F.min_by(F.struct("lat", "lon"), "ordinal").alias("at")).select("pk", "at.lat", "at.lon")


def _computed(reps: DataFrame, tracts: DataFrame, schools: DataFrame) -> DataFrame:
    found = schools_around(point_attributes(reps, tracts), schools).drop("lat", "lon")
    return found.withColumns(
        {"hospitals_within_5mi": F.lit(None).cast("long"), "drinking_water_score": F.lit(None).cast("double")}
    )


def point_cache(spark: SparkSession, path: str, tracts: DataFrame, buckets: int = 256) -> KeyedStore:
    """The cache of points in a folder, made if there is none; attributes have the types they have in ``tracts``."""
    attributes = "".join(f"`{c}` {tracts.schema[c].dataType.simpleString()}, " for c in SVI_KEYS)
    return KeyedStore(spark, path).create(f"pk struct<lat4:bigint,lon4:bigint>, {attributes}{POINT_COLUMNS}", ["pk"], buckets)


def enrich_points_stored(sites: DataFrame, store: KeyedStore, tracts: DataFrame, schools: DataFrame) -> DataFrame:
    """Point sidecar as by :func:`enrich_points` with the cache in a keyed store, to which only new points are added."""
    keyed = sites.withColumn("pk", tx.point_key("lat", "lon"))
    reps = cut_lineage(_representatives(store.missing(keyed.select("pk", "lat", "lon", "ordinal"))))
    store.append(_computed(reps, tracts, schools), "pk")
    return keyed.select("well_id", "pk").join(store.read(), "pk", "left").drop("pk")


def enrichment_coverage(sidecar: DataFrame) -> DataFrame:
    """Rows with each metric."""
    metrics = [c for c in (
        "drinking_water_score", "hospitals_within_5mi", "population_1mi", "eji_rank", "svi", "schools_within_1mi",
        "cejst_disadvantaged", "population") if c in sidecar.columns]
    return sidecar.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in metrics])
