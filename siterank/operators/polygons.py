"""Point-in-polygon and areal-interpolation joins.

Points meet polygons through a cover of cells (``cover``): they look up one cell per cell size in use, and cells with very
many points are dealt over several tasks.  For areal interpolation a polygon is filed under the grid whose cell is at least
as large as its bounding box, so it touches at most four cells.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions.geo import BUFFER_SIDES, MILE_M, polygon_area, ring_edges
from siterank.functions.numeric import round_int
from siterank.functions.models import water_score
from siterank.operators.cover import cell_cover, cell_of, holds
from siterank.operators.skew import salted_join
from siterank.session import cut_lineage

BASE = 2.0**-20


def _grid_level(extent: Column) -> Column:
    """Smallest level whose cell is at least ``extent`` wide (powers of two, exact)."""
    guess = F.ceil(F.log2(F.greatest(extent, F.lit(BASE)) / BASE)).cast("int")
    size = F.pow(F.lit(2.0), guess) * BASE
    return F.when(size < extent, guess + 1).otherwise(guess)


def _cell_size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) * BASE


def with_bounds(layer: DataFrame) -> DataFrame:
    """Add edges and bounding box to a layer that has ``rings``."""
    df = layer.withColumn("edges", ring_edges(F.col("rings")))
    return df.withColumns(
        {
            "xmin": F.array_min(F.transform("edges", lambda e: e["x1"])),
            "xmax": F.array_max(F.transform("edges", lambda e: e["x1"])),
            "ymin": F.array_min(F.transform("edges", lambda e: e["y1"])),
            "ymax": F.array_max(F.transform("edges", lambda e: e["y1"])),
        }
    )


def _spread(lo: Column, hi: Column, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def locate(points: DataFrame, layer: DataFrame, attrs: dict[str, str], x: str = "lon", y: str = "lat",
           ordinal: str = "ordinal", boundary: bool = False) -> DataFrame:
    """Attach ``attrs`` of the first polygon (lowest ordinal) that contains each point; null outside all.

    Copies of a polygon are reduced to their first, copies of a point are located once.
    """
    own, px, py = "__ord", F.col("__x"), F.col("__y")
    digest = F.xxhash64("rings"), F.sha2(F.to_json("rings"), 256)
    first = layer.select(F.col(ordinal).alias(own), digest[0].alias("__a"), digest[1].alias("__b")).groupBy("__a", "__b").agg(F.min(own).alias(own)).select(own)
    polys = layer.select("rings", F.col(ordinal).alias(own), *[F.col(a).alias(f"__a_{a}") for a in attrs]).join(first, own, "left_semi")
    cells = cut_lineage(cell_cover(polys))
    levels = sorted(r["lv"] for r in cells.select("lv").distinct().collect())  # at most a few dozen sizes
    places = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    lookups = F.array(*[F.struct(F.lit(lv).alias("lv"), cell_of(F.lit(lv), px).alias("cx"), cell_of(F.lit(lv), py).alias("cy")) for lv in levels]) if levels else F.array().cast("array<struct<lv:int,cx:bigint,cy:bigint>>")
    probes = places.select("__x", "__y", F.explode(lookups).alias("g")).select("__x", "__y", "g.*")
    hits = salted_join(probes, cells, ["lv", "cx", "cy"]).where(holds(px, py, boundary))
    found = hits.groupBy("__x", "__y").agg(
        F.min_by(F.struct(F.lit(True).alias("hit"), *[F.col(f"__a_{a}").alias(a) for a in attrs]), F.col(own)).alias("f")
    )
    placed = points.withColumns({"__x": F.col(x), "__y": F.col(y)})
    out = salted_join(placed, found, ["__x", "__y"], "left")
    return out.withColumns({name: F.col(f"f.{a}") for a, name in attrs.items()}).withColumn(
        "__hit", F.coalesce(F.col("f.hit"), F.lit(False))
    ).drop("__x", "__y", "f")


def resolve_tracts(sites: DataFrame, layer: DataFrame | None, kind: str = "tract") -> DataFrame:
    """Area key of each site: ``tract_geoid`` or ``bg_geoid``; a missing layer gives nulls."""
    out = "tract_geoid" if kind == "tract" else "bg_geoid"
    if layer is None:
        return sites.withColumn(out, F.lit(None).cast("string"))
    return locate(sites, layer, {"geoid": out}).drop("__hit")


def attach_county_group(sites: DataFrame, counties: DataFrame | None) -> DataFrame:
    """``NAME_ST``, or ``Unknown_ST`` outside every county or for an empty name."""
    unknown = F.concat(F.lit("Unknown_"), F.col("state_abbr"))
    if counties is None:
        return sites.withColumn("county_group", unknown)
    out = locate(sites, counties, {"name": "__county"}).drop("__hit")
    named = F.concat(F.nullif(F.col("__county"), F.lit("")), F.lit("_"), F.col("state_abbr"))
    return out.withColumn("county_group", F.coalesce(named, unknown)).drop("__county")


SERVED_ALIASES = ["Population_Served_Count", "POP_SERVED", "population_served_count", "PopServed", "POPULATION"]


def drinking_water(sites: DataFrame, layer: DataFrame) -> DataFrame:
    """0 outside every service area, log-scaled population served inside."""
    served = next((c for c in SERVED_ALIASES if c in layer.columns), None)
    if served is None:
        out = locate(sites, layer, {})
        return out.withColumn("drinking_water_score", F.when(F.col("__hit"), 1.0).otherwise(0.0)).drop("__hit")
    out = locate(sites, layer, {served: "__served"}).drop("__hit")
    return out.withColumn("drinking_water_score", water_score(F.col("__served").try_cast("double"))).drop("__served")


# --- areal interpolation ----------------------------------------------------
def _fan_area(edges: np.ndarray, owner: np.ndarray, n: int, r: float, sides: int) -> np.ndarray:
    """Signed area of polygon ∩ regular ``sides``-gon around the origin, summed per owner.

    Every edge forms a triangle with the centre; the triangle is cut at the wedges of the
    polygon, and inside one wedge the rim is a straight line.
    """
    ang = 2 * np.pi * np.arange(sides + 1) / sides
    ux, uy = np.cos(ang), np.sin(ang)
    mid = (ang[:-1] + ang[1:]) / 2
    nx, ny, rim = np.cos(mid), np.sin(mid), r * math.cos(math.pi / sides)
    out = np.zeros(n)
    for i in range(0, len(edges), 4096):
        px, py, qx, qy = (edges[i : i + 4096, k, None] for k in range(4))
        dx, dy = qx - px, qy - py
        t0 = np.zeros((px.shape[0], sides))
        t1 = np.ones((px.shape[0], sides))
        for base, slope in (
            (ux[:-1] * py - uy[:-1] * px, ux[:-1] * dy - uy[:-1] * dx),
            (uy[1:] * px - ux[1:] * py, uy[1:] * dx - ux[1:] * dy),
        ):
            with np.errstate(divide="ignore", invalid="ignore"):
                cut = -base / slope
            t0 = np.where(slope > 0, np.maximum(t0, cut), t0)
            t1 = np.where(slope < 0, np.minimum(t1, cut), t1)
            t1 = np.where((slope == 0) & (base < 0), -1.0, t1)
        live = t1 > t0
        t0, t1 = np.where(live, t0, 0.0), np.where(live, t1, 0.0)
        ax, ay, bx, by = px + t0 * dx, py + t0 * dy, px + t1 * dx, py + t1 * dy
        fa, fb = nx * ax + ny * ay, nx * bx + ny * by
        whole = (ax * by - ay * bx) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (rim - fa) / (fb - fa)
            mx, my = ax + s * (bx - ax), ay + s * (by - ay)
            capped = whole * rim * rim / (fa * fb)
            leaving = (ax * my - ay * mx) / 2 + (mx * by - my * bx) / 2 * rim / fb
            entering = (ax * my - ay * mx) / 2 * rim / fa + (mx * by - my * bx) / 2
        area = np.where(
            fa <= rim, np.where(fb <= rim, whole, leaving), np.where(fb <= rim, entering, capped)
        )
        out += np.bincount(owner[i : i + 4096], np.where(live, area, 0.0).sum(axis=1), minlength=n)
    return out


def buffer_overlap(radius: float, sides: int = BUFFER_SIDES):
    """Arrow UDF (cx, cy, flat edges) -> area of the polygon inside the buffer."""

    @F.pandas_udf("double")
    def overlap(cx: pd.Series, cy: pd.Series, flat: pd.Series) -> pd.Series:
        sizes = flat.map(len).to_numpy() // 4
        if sizes.sum() == 0:
            return pd.Series(np.zeros(len(cx)))
        edges = np.concatenate(flat.to_list()).reshape(-1, 4)
        owner = np.repeat(np.arange(len(cx)), sizes)
        ox, oy = cx.to_numpy()[owner], cy.to_numpy()[owner]
        shifted = edges - np.stack([ox, oy, ox, oy], axis=1)
        return pd.Series(np.abs(_fan_area(shifted, owner, len(cx), radius, sides)))

    return overlap


def population_in_buffer(sites: DataFrame, layer: DataFrame, radius: float = MILE_M, pop: str = "pop", x: str = "x",
                         y: str = "y", out: str = "population_1mi", rounded: bool = True) -> DataFrame:
    """Σ population · area(buffer ∩ polygon) / area(polygon); null where no polygon is met.

    ``layer`` has planar ``rings``; a missing population counts 0, a polygon without area is dropped.
    """
    polys = with_bounds(layer.select("rings", F.coalesce(F.col(pop).cast("double"), F.lit(0.0)).alias("pop")))
    polys = polys.withColumn("area", polygon_area(F.col("rings"))).where("area > 0").drop("rings")
    polys = polys.withColumn(
        "lv",
        _grid_level(
            F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(2.0 * radius))
        ),
    )
    levels = sorted(r["lv"] for r in polys.select("lv").distinct().collect())
    size = _cell_size(F.col("lv"))
    filed = polys.withColumn("cx", _spread(F.col("xmin"), F.col("xmax"), size)).withColumn(
        "cy", _spread(F.col("ymin"), F.col("ymax"), size)
    )
    places = sites.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("__x"), F.col(y).alias("__y")
    ).distinct()
    bx0, bx1 = F.col("__x") - radius, F.col("__x") + radius
    by0, by1 = F.col("__y") - radius, F.col("__y") + radius
    probes = (
        places.withColumn("lv", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
        .withColumn("cx", _spread(bx0, bx1, size))
        .withColumn("cy", _spread(by0, by1, size))
    )
    met = probes.join(filed, ["lv", "cx", "cy"]).where(
        (bx0 <= F.col("xmax")) & (bx1 >= F.col("xmin")) & (by0 <= F.col("ymax")) & (by1 >= F.col("ymin"))
    )
    # a pair may share several cells: keep it in the one that holds the lower-left corner of the overlap
    met = met.where(
        (F.col("cx") == F.floor(F.greatest(bx0, F.col("xmin")) / size))
        & (F.col("cy") == F.floor(F.greatest(by0, F.col("ymin")) / size))
    )
    flat = F.flatten(F.transform("edges", lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
    shares = met.select(
        "__x", "__y", "pop", "area", buffer_overlap(radius)("__x", "__y", flat).alias("part")
    ).where("part > 0")
    total = shares.groupBy("__x", "__y").agg(F.sum(F.col("pop") * (F.col("part") / F.col("area"))).alias("__pop"))
    val = round_int("__pop") if rounded else F.col("__pop")
    return (
        sites.join(total, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left")
        .withColumn(out, val)
        .drop("__x", "__y", "__pop")
    )
