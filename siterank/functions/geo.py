"""Projection, distances, polygons and affine transforms as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
MAP_EARTH_RADIUS_KM = 6373.0
MILE_POINT_M = 1609.0
MILE_M = 1609.34
HOSPITAL_RADIUS_M = 5 * MILE_M
BUFFER_SIDES = 64
BBOX_MARGIN_DEG = 0.002
# ----------------------------------------------------------------------------


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(h))


def great_circle_m(lon1: float, lat1: float, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """:func:`haversine` of one place and numpy arrays of others, in metres."""
    phi1, phi2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((phi2 - phi1) / 2) ** 2 + np.cos(phi1) * np.cos(phi2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2.0 * EARTH_RADIUS_M * np.arcsin(np.sqrt(h))


def sphere_xyz(lat, lon, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column, Column]:
    """Position on the sphere; chord length grows with great-circle distance."""
    phi, lam = F.radians(lat), F.radians(lon)
    r = F.lit(radius)
    return r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)


def chord_of_arc(arc: float, radius: float = EARTH_RADIUS_M) -> float:
    return 2.0 * radius * math.sin(arc / (2.0 * radius))


def arc_of_chord(chord: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance of a chord; no chord has no distance (``least`` would skip the null)."""
    half = chord / F.lit(2.0 * radius)
    return F.lit(2.0 * radius) * F.asin(F.when(half > 1.0, F.lit(1.0)).otherwise(half))


class AlbersConus:
    """Ellipsoidal Albers equal-area for the conterminous US (EPSG:5070, metres).

    Formulas after Snyder, USGS Professional Paper 1395; GRS80 ellipsoid.
    """

    A = 6378137.0
    F_INV = 298.257222101
    PHI1, PHI2, PHI0, LON0 = 29.5, 45.5, 23.0, -96.0

    _f = 1 / F_INV
    E2 = _f * (2 - _f)
    E = math.sqrt(E2)

    @classmethod
    def _q(cls, phi: float) -> float:
        s = math.sin(phi)
        return (1 - cls.E2) * (s / (1 - cls.E2 * s * s) - math.log((1 - cls.E * s) / (1 + cls.E * s)) / (2 * cls.E))

    @classmethod
    def constants(cls) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(v) for v in (cls.PHI1, cls.PHI2, cls.PHI0))
        m1, m2 = (math.cos(p) / math.sqrt(1 - cls.E2 * math.sin(p) ** 2) for p in (p1, p2))
        q0, q1, q2 = (cls._q(p) for p in (p0, p1, p2))
        n = (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return n, c, cls.A * math.sqrt(c - n * q0) / n

    @classmethod
    def xy(cls, lat: Column, lon: Column) -> tuple[Column, Column]:
        n, c, rho0 = cls.constants()
        s = F.sin(F.radians(lat))
        q = F.lit(1 - cls.E2) * (
            s / (1 - F.lit(cls.E2) * s * s)
            - F.log((1 - F.lit(cls.E) * s) / (1 + F.lit(cls.E) * s)) / F.lit(2 * cls.E)
        )
        rho = F.lit(cls.A) * F.sqrt(F.lit(c) - F.lit(n) * q) / F.lit(n)
        theta = F.lit(n) * F.radians(lon - F.lit(cls.LON0))
        return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)

    @classmethod
    def sql_xy(cls, lat: str, lon: str) -> tuple[str, str]:
        """The projection as SQL text, for oracle queries."""
        n, c, rho0 = cls.constants()
        s = f"sin(radians({lat}))"
        e, e2 = f"{cls.E!r}::double", f"{cls.E2!r}::double"
        q = (
            f"({1 - cls.E2!r}::double * ({s} / (1 - {e2} * {s} * {s}) - "
            f"ln((1 - {e} * {s}) / (1 + {e} * {s})) / {2 * cls.E!r}::double))"
        )
        rho = f"({cls.A!r}::double * sqrt({c!r}::double - {n!r}::double * {q}) / {n!r}::double)"
        th = f"({n!r}::double * radians({lon} - ({cls.LON0!r}::double)))"
        return f"({rho} * sin({th}))", f"({rho0!r}::double - {rho} * cos({th}))"


def with_planar(df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> DataFrame:
    cx, cy = AlbersConus.xy(F.col(lat), F.col(lon))
    return df.withColumns({x: cx, y: cy})


def with_sphere(df: DataFrame, lat: str = "lat", lon: str = "lon", radius: float = EARTH_RADIUS_M) -> DataFrame:
    a, b, c = sphere_xyz(F.col(lat), F.col(lon), radius)
    return df.withColumns({"gx": a, "gy": b, "gz": c})


def require_wgs84(crs: str | None) -> None:
    """Datum shift grids are not shipped, so anything but EPSG:4326 is refused."""
    if crs is None:
        raise ValueError("the layer states no coordinate system; EPSG:4326 is required")
    if crs.upper() not in ("EPSG:4326", "OGC:CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84"):
        raise ValueError(f"coordinate system {crs} is not supported; convert the layer to EPSG:4326 first")


def within_bbox(lat, lon, west, south, east, north, margin: float = 0.0) -> Column:
    return lat.between(south - margin, north + margin) & lon.between(west - margin, east + margin)


# --- rings ------------------------------------------------------------------
def ring_area(ring: Column) -> Column:
    """Signed shoelace area of array<struct<x,y>>; counter-clockwise is positive."""
    origin = F.element_at(ring, 1)
    pairs = F.arrays_zip(
        F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q")
    )
    return F.when(
        F.size(ring) < 3, F.lit(0.0)
    ).otherwise(
        F.aggregate(
            pairs,
            F.lit(0.0),
            lambda acc, s: acc
            + (
                (s["p"]["x"] - origin["x"]) * (s["q"]["y"] - origin["y"])
                - (s["q"]["x"] - origin["x"]) * (s["p"]["y"] - origin["y"])
            ),
        )
        / 2
    )


def polygon_area(rings: Column) -> Column:
    """Area of oriented rings: shells count positive, holes negative."""
    return F.abs(F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda a, v: a + v))


def ring_edges(rings: Column) -> Column:
    """Edges of all rings as array<struct<x1,y1,x2,y2>>."""
    def one(ring):
        return F.zip_with(
            F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
            F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
            lambda p, q: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, one))


def on_boundary(px: Column, py: Column, edges: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (py - e["y1"]) == (e["y2"] - e["y1"]) * (px - e["x1"]))
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def crosses_odd(px: Column, py: Column, edges: Column) -> Column:
    hits = F.filter(
        edges,
        lambda e: ((e["y1"] > py) != (e["y2"] > py))
        & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(hits) % 2 == 1


def point_within(px: Column, py: Column, edges: Column, boundary: bool = False) -> Column:
    """Even-odd test; the boundary itself counts only when ``boundary`` is set."""
    edge = on_boundary(px, py, edges)
    inside = crosses_odd(px, py, edges)
    return (inside | edge) if boundary else (inside & ~edge)


# --- affine -----------------------------------------------------------------
def pixel_to_map(px: Column, py: Column, t) -> Column:
    """``t`` = (xoff, a, b, yoff, d, e), numbers or columns; px is the column index, py the row."""
    xoff, a, b, yoff, d, e = t
    return F.struct((a * px + b * py + xoff).alias("x"), (d * px + e * py + yoff).alias("y"))


def map_to_pixel(mx: Column, my: Column, t) -> Column:
    """Inverse of :func:`pixel_to_map`, rounded to whole (row, col)."""
    xoff, a, b, yoff, d, e = t
    det = a * e - b * d
    col = (e * (mx - xoff) - b * (my - yoff)) / det
    row = (a * (my - yoff) - d * (mx - xoff)) / det
    return F.struct(F.rint(row).cast("int").alias("row"), F.rint(col).cast("int").alias("col"))


def bounding_box(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(
        F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north")
    )
