"""Map detections: ingest into the candidate store, tiles, splits, labels and the map manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions import text as tx
from siterank.functions.geo import (
    BBOX_MARGIN_DEG, MAP_EARTH_RADIUS_KM, arc_of_chord, map_to_pixel, pixel_to_map, with_sphere, within_bbox,
)
from siterank.functions.numeric import round_int
from siterank.operators.components import blobs
from siterank.operators.ordering import keep_first, prefix_counts, running_sequence
from siterank.operators.polygons import attach_county_group
from siterank.operators.spatial import nearest
from siterank.operators.tables import composite_lookup, replace_source, resolve_values
from siterank.plans.consolidate import attach_nearest_documented, candidate_rows

# --- fixed values -----------------------------------------------------------
DEFAULT_SCALE = 24000
MAP_SCALE = "24000"
MAP_GRID = "7.5 X 7.5 Minute"
YEAR_RANGE = (1947, 1992)
MAP_STATES = {
    "PA": "Pennsylvania", "OH": "Ohio", "WV": "West Virginia", "KY": "Kentucky", "NY": "New York",
    "TN": "Tennessee", "VA": "Virginia", "MD": "Maryland",
}
TILE, OVERLAP = 256, 25
PROBABILITY = 0.5
EXCLUSION_KM = 0.1
REPRODUCTION_M, REPRODUCTION_PASS = 60.0, 0.7
VALIDATION_SHARE = 0.15
EMPTY_TILE_SHARE = 0.10
DISC_RADIUS_PX = 4
# ----------------------------------------------------------------------------


# --- ingest -----------------------------------------------------------------
def scale_lookup(inventory: DataFrame) -> DataFrame:
    """(k_quad, k_year, k_state) -> scale, ambiguous."""
    inv = inventory.select(
        F.lower(tx.strip("map_name")).alias("k_quad"),
        F.col("date_on_map").try_cast("int").cast("string").alias("k_year"),
        tx.strip("primary_state").alias("k_state"),
        F.col("map_scale").try_cast("int").alias("scale"),
    ).dropna()
    return resolve_values(inv, ["k_quad", "k_year", "k_state"], "scale", DEFAULT_SCALE)


def attach_scale(df: DataFrame, lookup: DataFrame) -> DataFrame:
    keyed = df.withColumns(
        {"k_quad": F.lower("quad"), "k_year": F.col("year").cast("string"), "k_state": F.col("state")}
    )
    return composite_lookup(keyed, lookup, ["k_quad", "k_year", "k_state"], "scale", DEFAULT_SCALE).drop(
        "k_quad", "k_year", "k_state"
    )


def synthesize(df: DataFrame, source: str = "unet_2026") -> DataFrame:
    """Candidate columns from (lon, lat, state, quad, year, scale, ordinal)."""
    df = df.withColumns(
        {
            "state_abbr": tx.state_abbr("state"), "quad_name": F.col("quad"), "quad_year": F.col("year").cast("string"),
            "quad_scale": F.col("scale").cast("string"), "quad_id": F.lit(None).cast("string"), "__slug": tx.slug("quad"),
        }
    )
    df = running_sequence(df, ["state_abbr", "__slug", "quad_year", "quad_scale"], "ordinal", "__seq")
    return df.withColumns(
        {
            "detection_index": F.col("__seq").cast("int"),
            "layer": F.lit("candidate"),
            "type_norm": F.lit("unknown"),
            "status_norm": F.lit("undocumented"),
            "is_plugged": F.lit(False),
            "source": F.lit(source),
            "well_id": tx.detection_id("state_abbr", "__slug", "quad_year", "quad_scale", "__seq"),
            "name": tx.detection_name("quad", "year"),
        }
    ).drop("__slug", "__seq")


def build_detections(features: DataFrame, inventory: DataFrame, counties: DataFrame | None, documented: DataFrame):
    scaled = attach_scale(features, scale_lookup(inventory))
    grouped = attach_county_group(synthesize(scaled), counties)
    return attach_nearest_documented(grouped, documented)


def merge_candidates(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    rows = candidate_rows(fresh)
    return replace_source(existing, rows.select(*existing.columns), "unet_")


def ingest_report(detections: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return detections.agg(
        n.alias("features_in"),
        F.count_if(F.col("lookup_status") == "exact").alias("scale_exact"),
        F.count_if(F.col("lookup_status") == "ambiguous").alias("scale_ambiguous"),
        F.count_if(F.col("lookup_status") == "default").alias("scale_default"),
        F.count_if(F.col("county_group").startswith("Unknown_")).alias("county_fallback"),
        F.count_if(F.col("nearest_doc_well_m").isNull()).alias("nearest_null"),
        (n - F.count_distinct("well_id")).alias("duplicate_ids"),
    )


# --- manifest ---------------------------------------------------------------
def filter_inventory(inv: DataFrame, states: list[str], years: tuple[int, int] = YEAR_RANGE, bbox=None) -> DataFrame:
    """Maps of the target series with a url; ``bbox`` (west, south, east, north) tests the map centre."""
    year = tx.to_int("date_on_map")
    keep = (
        (F.col("map_scale").cast("string") == MAP_SCALE)
        & (tx.strip("grid_size") == MAP_GRID)
        & F.col("primary_state").isin(states)
        & year.between(*years)
        & (F.coalesce(F.col("geotiff_url"), F.lit("")) != "")
    )
    if bbox is not None:
        w, e, n, s = (tx.to_double(c) for c in ("westbc", "eastbc", "northbc", "southbc"))
        keep = keep & within_bbox((s + n) / 2, (w + e) / 2, *[F.lit(float(v)) for v in bbox])
    return inv.where(F.coalesce(keep, F.lit(False)))


def latest_per_map(df: DataFrame, keys: list[str], year, ordinal: str = "ordinal") -> DataFrame:
    """Newest edition of each key; the first of equal years."""
    return keep_first(df, keys, [year.desc(), F.col(ordinal)])


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("primary_state").agg(
        F.count(F.lit(1)).alias("maps"), F.sum(F.col("product_filesize").try_cast("long")).alias("bytes")
    )


def load_manifest(manifest: DataFrame, states: list[str] | None = None) -> DataFrame:
    if not states:
        return manifest
    return manifest.where(F.col("primary_state").isin([MAP_STATES.get(s.upper(), s) for s in states]))


def run_progress(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per state: maps, finished, waiting, candidates so far.  ``outputs``: scan_id, valid, candidates."""
    done = outputs.where("valid").groupBy("scan_id").agg(F.sum("candidates").alias("candidates"))
    j = manifest.select("primary_state", "scan_id").join(done, "scan_id", "left")
    ok = F.col("candidates").isNotNull()
    return j.groupBy("primary_state").agg(
        F.count(F.lit(1)).alias("maps"),
        F.count_if(ok).alias("completed"),
        F.count_if(~ok).alias("pending"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"),
    )


# --- tiles and masks --------------------------------------------------------
def _starts(length: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), (length + OVERLAP - 1).cast("int"), F.lit(TILE)),
        lambda k: F.when(k == 0, k).otherwise(k - OVERLAP),
    )


def tile_index(maps: DataFrame) -> DataFrame:
    """(map_id, tile_row, tile_col) from (map_id, height, width): starts 0, 231, 487, 743 …"""
    rows = maps.select("map_id", "width", F.explode(_starts(F.col("height"))).alias("tile_row"))
    return rows.select("map_id", "tile_row", F.explode(_starts(F.col("width"))).alias("tile_col"))


def threshold_tiles(tile_pixels: DataFrame, maps: DataFrame, threshold: float = PROBABILITY) -> DataFrame:
    """Tile-local probabilities to the distinct set pixels of each map."""
    p = tile_pixels.where(F.col("prob") > threshold).select(
        "map_id", (F.col("tile_row") + F.col("r")).alias("row"), (F.col("tile_col") + F.col("c")).alias("col")
    )
    return (
        p.join(maps.select("map_id", "height", "width"), "map_id")
        .where("row < height and col < width")
        .select("map_id", "row", "col")
        .distinct()
    )


def neatline_crop(maps: DataFrame) -> DataFrame:
    """Pixel window (r0, r1, c0, c1) inside the collar, from the corner coordinates of each map."""
    t = [F.col(c) for c in ("xoff", "a", "b", "yoff", "d", "e")]

    def corner(lon, lat):
        return map_to_pixel(F.col(lon), F.col(lat), t)

    nw, sw, ne, se = corner("west", "north"), corner("west", "south"), corner("east", "north"), corner("east", "south")
    return maps.withColumns(
        {
            "r0": F.greatest(nw["row"], ne["row"]), "r1": F.least(sw["row"], se["row"]),
            "c0": F.greatest(nw["col"], sw["col"]), "c1": F.least(ne["col"], se["col"]),
        }
    )


def crop_collar(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    return (
        pixels.join(windows.select("map_id", "r0", "r1", "c0", "c1"), "map_id")
        .where("row >= r0 and row < r1 and col >= c0 and col < c1")
        .drop("r0", "r1", "c0", "c1")
    )


def known_in_maps(known: DataFrame, maps: DataFrame, margin: float = BBOX_MARGIN_DEG, cell: float = 0.25) -> DataFrame:
    """(map_id, known columns): known sites within each map's box, by quarter-degree cells."""
    def cells(lo, hi):
        return F.explode(F.sequence(F.floor((F.col(lo) - margin) / cell), F.floor((F.col(hi) + margin) / cell)))

    boxed = maps.select("map_id", "west", "east", "north", "south", cells("west", "east").alias("gx")).select(
        "*", cells("south", "north").alias("gy")
    )
    tagged = known.withColumns({"gx": F.floor(F.col("lon") / cell), "gy": F.floor(F.col("lat") / cell)})
    inside = within_bbox(F.col("lat"), F.col("lon"), F.col("west"), F.col("south"), F.col("east"), F.col("north"), margin)
    return tagged.join(boxed, ["gx", "gy"]).where(inside).select("map_id", *known.columns)


def exclude_known(detections: DataFrame, known: DataFrame, maps: DataFrame, km: float = EXCLUSION_KM) -> DataFrame:
    """Detections farther than 100 m from every known site of their own map, with the distance in metres.

    A map without known sites keeps all its detections and a null distance.
    """
    radius = MAP_EARTH_RADIUS_KM * 1000.0
    sites = with_sphere(known_in_maps(known, maps), radius=radius).select("map_id", "ordinal", "gx", "gy", "gz")
    out = nearest(
        with_sphere(detections, radius=radius), sites, dims=["gx", "gy", "gz"], by=["map_id"], out="__chord"
    )
    dist = arc_of_chord(F.col("__chord"), radius)
    return (
        out.withColumn("__m", dist)
        .where(F.col("__m").isNull() | (F.col("__m") > km * 1000.0))
        .withColumn("dist_to_documented_m", round_int("__m"))
        .drop("__m", "__chord", "gx", "gy", "gz")
    )


def detect(pixels: DataFrame, maps: DataFrame, known: DataFrame) -> DataFrame:
    """Set pixels to candidate sites: crop, blobs, coordinates, exclusion."""
    found = blobs(crop_collar(pixels, neatline_crop(maps)))
    t = [F.col(c) for c in ("xoff", "a", "b", "yoff", "d", "e")]
    placed = found.join(maps.select("map_id", "xoff", "a", "b", "yoff", "d", "e"), "map_id").withColumn(
        "__at", pixel_to_map(F.col("col").cast("double"), F.col("row").cast("double"), t)
    )
    points = placed.select("map_id", F.col("__at.x").alias("lon"), F.col("__at.y").alias("lat"))
    return exclude_known(points, known, maps)


# --- labels and split -------------------------------------------------------
def stamped_tiles(sites: DataFrame, maps: DataFrame, radius: int = DISC_RADIUS_PX) -> DataFrame:
    """Tiles touched by a disc around each site (map_id, row, col): the positive tiles."""
    tiles = tile_index(maps)
    reach = (
        sites.join(maps.select("map_id", "height", "width"), "map_id")
        .where("row >= 0 and col >= 0 and row < height and col < width")
        .select("map_id", "row", "col")
        .distinct()
    )
    bins = reach.withColumn(
        "br", F.explode(F.sequence(F.floor((F.col("row") - radius) / TILE), F.floor((F.col("row") + radius) / TILE)))
    ).withColumn(
        "bc", F.explode(F.sequence(F.floor((F.col("col") - radius) / TILE), F.floor((F.col("col") + radius) / TILE)))
    )
    tb = tiles.withColumn(
        "br", F.explode(F.sequence(F.floor(F.col("tile_row") / TILE), F.floor((F.col("tile_row") + TILE - 1) / TILE)))
    ).withColumn(
        "bc", F.explode(F.sequence(F.floor(F.col("tile_col") / TILE), F.floor((F.col("tile_col") + TILE - 1) / TILE)))
    )
    dr = F.greatest(F.col("tile_row") - F.col("row"), F.lit(0), F.col("row") - (F.col("tile_row") + TILE - 1))
    dc = F.greatest(F.col("tile_col") - F.col("col"), F.lit(0), F.col("col") - (F.col("tile_col") + TILE - 1))
    return (
        tb.join(bins, ["map_id", "br", "bc"])
        .where(dr * dr + dc * dc <= radius * radius)
        .select("map_id", "tile_row", "tile_col")
        .distinct()
    )


def label_tiles(sites: DataFrame, maps: DataFrame, empty_share: float = EMPTY_TILE_SHARE) -> DataFrame:
    """Positive tiles and a seeded share of the empty ones.

    Only sites no younger than the map are stamped; an unknown year (null, for a map also 0) leaves all of them.
    """
    dated = sites.join(maps.select("map_id", "map_year"), "map_id").where(
        F.coalesce("map_year", F.lit(0)).eqNullSafe(0) | (F.coalesce("year", F.lit(0)) <= F.col("map_year"))
    )
    pos = stamped_tiles(dated, maps).withColumn("__pos", F.lit(True))
    tiles = tile_index(maps).join(pos, ["map_id", "tile_row", "tile_col"], "left")
    draw = F.pmod(F.xxhash64("map_id", "tile_row", "tile_col"), F.lit(1000)) < int(round(empty_share * 1000))
    return tiles.withColumn("positive", F.coalesce("__pos", F.lit(False))).where(F.col("positive") | draw).drop("__pos")


def split_groups(df: DataFrame, group: str, share: float = VALIDATION_SHARE, seed: str = "0") -> DataFrame:
    """Whole groups to validation: min(n-1, max(1, round(share n))) of them, by a seeded hash."""
    key = F.sha1(F.concat(F.lit(seed), F.lit(":"), F.col(group).cast("string")))
    groups = df.select(group).distinct().withColumn("__h", key)
    if groups.limit(2).count() < 2:
        raise ValueError("at least two groups are needed for a split by group")
    # groups per hash value are counted below each other, so no task gathers the share
    placed = prefix_counts(groups.withColumn("__n", F.lit(1)), [], ["__h", group], "__n")
    wanted = F.least(F.col("total") - 1, F.greatest(F.lit(1), F.bround(F.col("total") * share, 0).cast("long")))
    chosen = placed.where(F.col("before") < wanted).select(group, F.lit(True).alias("__val"))
    return df.join(chosen, group, "left").withColumn(
        "split", F.when(F.col("__val"), "validation").otherwise("train")
    ).drop("__val")


# --- reproduction -----------------------------------------------------------
def covered_by(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside at least one box."""
    ids = known_in_maps(points, boxes, margin=0.0).select("ordinal").distinct()
    return points.join(ids, "ordinal", "left_semi")


def reproduction(published: DataFrame, ours: DataFrame, boxes: DataFrame | None = None,
                 tolerance_m: float = REPRODUCTION_M) -> DataFrame:
    """Share of published points that have one of ours within the tolerance, and the verdict."""
    pub = published if boxes is None else covered_by(published, boxes)
    radius = MAP_EARTH_RADIUS_KM * 1000.0
    near = nearest(with_sphere(pub, radius=radius), with_sphere(ours, radius=radius), dims=["gx", "gy", "gz"], out="__c")
    hit = F.count_if(arc_of_chord(F.col("__c"), radius) <= tolerance_m)
    n = F.count(F.lit(1))
    return near.agg(n.alias("published"), hit.alias("matched")).withColumn(
        "rate", F.when(F.col("published") > 0, F.col("matched") / F.col("published")).otherwise(0.0)
    ).withColumn("passed", F.col("rate") >= REPRODUCTION_PASS)
