"""Build the site store: documented sites, candidates, registry attributes and new sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.functions import text as tx
from siterank.functions.geo import with_planar
from siterank.functions.numeric import nan_to_null, round_exact, round_once
from siterank.operators.ordering import keep_first, running_sequence
from siterank.operators.spatial import nearest
from siterank.operators.tables import one_row, union_common
from siterank.session import cut_lineage

# --- fixed values -----------------------------------------------------------
SNAP_M = 50.0
DISCOVERY_M = 100.0
DOCUMENTED_FIELDS = {
    "Well identifier": "well_id", "State": "state", "County": "county", "Well name": "name", "Type": "type_raw",
    "Status": "status_raw", "Latitude": "lat", "Longitude": "lon", "Source": "source",
}
CONSOLIDATED_COLUMNS = [
    "well_id", "layer", "name", "state", "state_abbr", "county", "type_norm", "status_norm", "is_plugged",
    "api_number", "operator", "depth_ft", "discovered_via", "lat", "lon",
]
CANDIDATE_COLUMNS = [
    "well_id", "layer", "name", "county_group", "state_abbr", "state", "quad_name", "quad_id", "quad_year",
    "quad_scale", "detection_index", "type_norm", "status_norm", "is_plugged", "lat", "lon", "nearest_doc_well_m",
    "source",
]
ATTRIBUTES = ["depth_ft", "operator", "type_norm", "status_norm"]
# ----------------------------------------------------------------------------


def build_documented(raw: DataFrame) -> DataFrame:
    """Documented sites with normalised type, status and key; rows without coordinates are dropped."""
    df = raw.select(*[F.col(f"`{s}`").alias(d) for s, d in DOCUMENTED_FIELDS.items()], "ordinal")
    df = df.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")})
    df = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    df = df.withColumns(
        {
            "type_norm": tx.classify_type("type_raw"),
            "status_norm": tx.classify_status("status_raw"),
            "state_abbr": tx.state_abbr("state"),
            "api_number": tx.normalize_api("well_id"),
            "layer": F.lit("documented"),
            "operator": F.lit(None).cast("string"),
            "depth_ft": F.lit(None).cast("double"),
            "discovered_via": F.lit("usgs_dow"),
        }
    )
    return df.withColumn("is_plugged", tx.is_plugged("status_norm"))


def build_candidates(raw: DataFrame, source: str = "lbnl") -> DataFrame:
    """Published candidates: (uid, coordinates, county_group, ordinal) to the candidate schema, first id wins."""
    df = raw.withColumns(
        {"__p": tx.parse_candidate_id("uid"), "__c": tx.parse_coordinates("coordinates")}
    ).where(F.col("__c.lat").isNotNull())
    df = df.select(
        F.col("uid").alias("well_id"),
        F.lit("candidate").alias("layer"),
        tx.candidate_name("__p.quad_name", "__p.detection_index").alias("name"),
        "county_group",
        F.col("__p.state_abbr").alias("state_abbr"),
        tx.state_name("__p.state_abbr").alias("state"),
        *[F.col(f"__p.{c}").alias(c) for c in ("quad_name", "quad_id", "quad_year", "quad_scale", "detection_index")],
        F.lit("unknown").alias("type_norm"),
        F.lit("undocumented").alias("status_norm"),
        F.lit(False).alias("is_plugged"),
        F.col("__c.lat").alias("lat"),
        F.col("__c.lon").alias("lon"),
        F.lit(source).alias("source"),
        "ordinal",
    )
    return keep_first(df, ["well_id"], "ordinal")


def attach_nearest_documented(candidates: DataFrame, documented: DataFrame) -> DataFrame:
    """Planar distance to the nearest documented site, one decimal."""
    out = nearest(with_planar(candidates), with_planar(documented), out="__d")
    return out.withColumn("nearest_doc_well_m", round_exact("__d", 1)).drop("__d", "x", "y")


def beyond(df: DataFrame, distance: str, metres: float = DISCOVERY_M) -> DataFrame:
    """Farther than ``metres`` from anything known; an unknown distance is kept."""
    return df.where(F.col(distance).isNull() | (F.col(distance) > metres))


def build_registry(normalized: DataFrame) -> DataFrame:
    """Registry rows in the names of the site store."""
    return normalized.select(
        F.col("api").alias("api_number"), F.col("type").alias("type_norm"), F.col("status").alias("status_norm"),
        "operator", F.col("depth").alias("depth_ft"), "lat", "lon", "state_abbr",
        tx.state_name("state_abbr").alias("state"), tx.is_plugged("status").alias("is_plugged"),
        F.lit("state").alias("layer"), F.concat(F.lit("state_"), F.lower("state_abbr")).alias("source"), "ordinal",
    )


def match_registry(documented: DataFrame, registry: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """Registry rows with ``doc_ordinal`` and ``matched_by``: api, spatial or null.

    The key join comes first; what it leaves is snapped to the nearest documented site.
    """
    key = F.nullif(F.trim("api_number"), F.lit(""))
    docs = documented.select(key.alias("__k"), F.col("ordinal").alias("doc_ordinal")).where("__k is not null")
    first = docs.groupBy("__k").agg(F.min("doc_ordinal").alias("doc_ordinal"))
    keyed = registry.join(first, key == F.col("__k"), "left").drop("__k")
    by_api = keyed.where("doc_ordinal is not null").withColumn("matched_by", F.lit("api"))
    rest = keyed.where("doc_ordinal is null").drop("doc_ordinal")
    places = with_planar(documented.select("ordinal", "lat", "lon"))
    snapped = nearest(
        with_planar(rest), places, carry={"ordinal": "doc_ordinal"}, out="snap_m", limit=snap_m
    ).drop("x", "y", "snap_m")
    snapped = snapped.withColumn("matched_by", F.when(F.col("doc_ordinal").isNotNull(), "spatial"))
    return by_api.unionByName(snapped)


def apply_attributes(documented: DataFrame, matched: DataFrame) -> DataFrame:
    """Fill documented sites from their registry rows, key matches before spatial ones, in row order.

    Depth and operator fill empty slots; type and status replace only unknown values and only
    with known ones.  ``filled_<attribute>`` tells which values came from the registry.
    """
    hits = matched.where("doc_ordinal is not null").withColumn(
        "__o", F.struct((F.col("matched_by") == "spatial").cast("int").alias("p"), F.col("ordinal").alias("o"))
    )

    def first(c):
        usable = F.col(c).isNotNull()
        if c in ("type_norm", "status_norm"):  # neither word settles a slot
            usable = usable & ~F.col(c).isin("unknown", "undocumented")
        return F.min_by(F.when(usable, F.col(c)), F.when(usable, F.col("__o"))).alias(f"__r_{c}")

    attrs = hits.groupBy(F.col("doc_ordinal").alias("ordinal")).agg(*[first(c) for c in ATTRIBUTES])
    df = documented.join(attrs, "ordinal", "left")
    new = {}
    for c in ATTRIBUTES:
        old, fresh = F.col(c), F.col(f"__r_{c}")
        empty = old.isNull()
        if c in ("type_norm", "status_norm"):
            empty = empty | old.isin("unknown", "undocumented")
        new[c] = F.when(empty & fresh.isNotNull(), fresh).otherwise(old)
        new[f"filled_{c}"] = empty & fresh.isNotNull()
    return df.withColumns(new).drop(*[f"__r_{c}" for c in ATTRIBUTES])


def new_sites(matched: DataFrame) -> DataFrame:
    """Registry rows that match nothing become sites; the number in an id is the position among them."""
    rest = matched.where("matched_by is null").drop("doc_ordinal", "matched_by")
    rest = running_sequence(rest.withColumn("__all", F.lit(1)), ["__all"], "ordinal", "__i").drop("__all")
    return rest.withColumns(
        {
            "well_id": tx.registry_id("api_number", "state_abbr", "__i"),
            "name": tx.registry_name("api_number", "state_abbr"),
            "county": F.lit(None).cast("string"),
            "discovered_via": F.lit("state_registry"),
            "layer": F.lit("documented"),
        }
    ).drop("__i")


def consolidation_stats(registry_matched: DataFrame, attributed: DataFrame, new: DataFrame) -> DataFrame:
    """One row: matches by way, new sites, values filled, share of sites with a depth."""
    m = registry_matched.agg(
        F.count(F.lit(1)).alias("state_wells"),
        F.count_if(F.col("matched_by") == "api").alias("attached_by_api"),
        F.count_if(F.col("matched_by") == "spatial").alias("attached_by_spatial"),
        F.count_if(F.col("matched_by").isNull()).alias("new_wells"),
    )
    d = attributed.agg(
        *[F.count_if(f"filled_{c}").alias(f"filled_{c}") for c in ATTRIBUTES],
        F.count(F.lit(1)).alias("__docs"), F.count("depth_ft").alias("__docs_depth"),
    )
    n = new.agg(F.count(F.lit(1)).alias("__new"), F.count("depth_ft").alias("__new_depth"))
    one = one_row(m, d, n)
    total = F.col("__docs") + F.col("__new")
    pct = F.when(total > 0, round_once(100.0 * (F.col("__docs_depth") + F.col("__new_depth")) / total, 2)).otherwise(0.0)
    return one.withColumn("depth_coverage_pct", pct).drop("__docs", "__docs_depth", "__new", "__new_depth")


def new_by_state(new: DataFrame) -> DataFrame:
    """New sites of each state."""
    return new.groupBy("state_abbr").agg(F.count(F.lit(1)).alias("new_wells"))


def build_store(documented: DataFrame, registry: DataFrame, snap_m: float = SNAP_M):
    """(all sites in serving columns, one-row statistics, new sites of each state)."""
    attributed, new, stats = consolidate(documented, registry, snap_m)
    return consolidated_rows(universe(attributed, new)), stats, new_by_state(new)


def consolidate(documented: DataFrame, registry: DataFrame, snap_m: float = SNAP_M):
    """(attributed documented sites, new sites, one-row statistics)."""
    # three outputs read the matches, so they are written once
    matched = cut_lineage(match_registry(documented, registry, snap_m))
    attributed = apply_attributes(documented, matched)
    new = new_sites(matched)
    return attributed, new, consolidation_stats(matched, attributed, new)


def universe(attributed: DataFrame, new: DataFrame) -> DataFrame:
    return union_common(attributed.drop(*[f"filled_{c}" for c in ATTRIBUTES]), new)


def consolidated_rows(df: DataFrame) -> DataFrame:
    """Serving columns with six-decimal coordinates and no NaN."""
    cols = [c for c in CONSOLIDATED_COLUMNS if c in df.columns]
    return nan_to_null(df.select(*cols)).withColumns({"lat": round_exact("lat", 6), "lon": round_exact("lon", 6)})


def candidate_rows(df: DataFrame) -> DataFrame:
    cols = [c if c in df.columns else F.lit(None).alias(c) for c in CANDIDATE_COLUMNS]
    return df.select(*cols, *(["ordinal"] if "ordinal" in df.columns else [])).withColumns(
        {"lat": round_exact("lat", 6), "lon": round_exact("lon", 6)}
    )
