"""Point-in-polygon by cell covers against a plain ray cast over all edges."""

import math
import random

import numpy as np
import pytest

from siterank.operators import cover, polygons, skew

SCHEMA = "geoid string, ordinal long, rings array<array<struct<x:double,y:double>>>"


def ring(cx, cy, r, n, wobble, seed):
    g = random.Random(seed)
    at = [(cx + r * (1 + wobble * g.uniform(-1, 1)) * math.cos(2 * math.pi * i / n), cy + r * (1 + wobble * g.uniform(-1, 1)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*at, at[0]]


def box(x0, y0, x1, y1):
    return [(float(a), float(b)) for a, b in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def shapes():
    comb = [(0.0, 0.0)] + [p for i in range(40) for p in ((i * 0.05, 1.0), (i * 0.05 + 0.02, 1.0), (i * 0.05 + 0.02, 0.1), (i * 0.05 + 0.05, 0.1))] + [(2.0, 0.0), (0.0, 0.0)]
    return [
        ("wobbly", 5, [ring(0, 0, 1.5, 4000, 0.3, 1), ring(0.1, 0.1, 0.4, 300, 0.2, 2)[::-1]]),
        ("grid-a", 1, [box(-2, -2, -1, -1)]), ("grid-b", 2, [box(-1, -2, 0, -1)]), ("holed", 3, [box(1, 1, 3, 3), box(1.5, 1.5, 2, 2)[::-1], box(2.25, 2.25, 2.5, 2.5)[::-1]]),
        ("comb", 4, [[(x + 1, y - 2) for x, y in comb]]), ("copy", 9, [box(-2, -2, -1, -1)]), ("tiny", 0, [ring(0.7, 0.7, 1e-7, 9, 0.2, 3)]),
        ("none", 7, None), ("empty", 8, []), ("islands", 6, [box(-3, 2, -2.5, 2.5), ring(-2, 2.2, 0.3, 50, 0.1, 4), box(-3, 2.75, -2, 3)]),
    ]


def points(n):
    g = random.Random(9)
    corners = [(i / 4, j / 4) for i in range(-12, 13) for j in range(-12, 13)]
    wobble = [p for p in ring(0, 0, 1.5, 4000, 0.3, 1)[::40]]
    return [*corners, *wobble, *[(0.7 + g.uniform(-1, 1) * 1e-7, 0.7 + g.uniform(-1, 1) * 1e-7) for _ in range(200)], *[(g.uniform(-3.2, 3.2), g.uniform(-3.2, 3.2)) for _ in range(n)]]


def ray_cast(px, py, rings):
    """Even-odd rule over all edges; the boundary is outside."""
    e = np.concatenate([np.hstack([np.array(r)[:-1], np.array(r)[1:]]) for r in rings])
    x1, y1, x2, y2 = e.T
    on = ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = (((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum() % 2
    return bool(odd) and not on.any()


def expected(at):
    layer = sorted((s for s in shapes() if s[2]), key=lambda s: s[1])
    return {i: next((s[0] for s in layer if ray_cast(x, y, s[2])), None) for i, (x, y) in enumerate(at)}


@pytest.mark.parametrize("floor", [skew.FLOOR, 20])
def test_located_points_equal_a_ray_cast(spark, monkeypatch, floor):
    """Holes, bays, shared borders, corners on cell borders and copies; with ``floor`` 20 many cells and places are hot."""
    monkeypatch.setattr(polygons, "salted_join", lambda *a: skew.salted_join(*a, *["inner"] * (len(a) == 3), floor=floor))
    at = points(9000)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(-i, 1.1, 1.1) for i in range(1, 300)] + [(-1000, None, 1.0), (-1001, 1.0, None)]
    got = {r.id: r.tract_geoid for r in polygons.resolve_tracts(spark.createDataFrame(rows, "id int, lon double, lat double"), spark.createDataFrame(shapes(), SCHEMA)).collect()}
    want = expected(at) | {-i: "wobbly" if ray_cast(1.1, 1.1, shapes()[0][2]) else "holed" for i in range(1, 300)} | {-1000: None, -1001: None}
    want |= {-i: next(s[0] for s in sorted((s for s in shapes() if s[2]), key=lambda s: s[1]) if ray_cast(1.1, 1.1, s[2])) for i in range(1, 300)}
    assert len(got) == len(rows) and {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_no_cell_carries_a_whole_ring(spark):
    layer = spark.createDataFrame(shapes(), SCHEMA)
    rows = cover.cell_cover(layer).selectExpr("geoid", "size(edges) as n", "size(flips) as f", "odd").collect()
    big = [r for r in rows if r.geoid == "wobbly"]
    assert max(r.n for r in big) <= cover.MOST_EDGES and max(r.f for r in big) <= 2 * cover.MOST_EDGES
    assert sum(r.n == 0 and r.odd for r in big) > 20
    assert {r.geoid for r in rows} == {"wobbly", "grid-a", "grid-b", "holed", "comb", "copy", "tiny", "islands"}


def test_boundary_may_count(spark):
    layer = spark.createDataFrame([("A", 1, [box(0, 0, 1, 1)])], SCHEMA)
    pts = spark.createDataFrame([(1, 0.0, 0.5), (2, 1.0, 1.0), (3, 0.5, 0.5), (4, 1.5, 0.5)], "id int, lon double, lat double")
    got = {r.id: r["__hit"] for r in polygons.locate(pts, layer, {}, boundary=True).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}
