"""Grid joins against brute force, with dense clumps and copies."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siterank.operators import components, polygons, spatial
from siterank.plans import detections, enrich


def cloud(rng, n):
    a = rng.uniform(-1e5, 1e5, (n, 2))
    k = n // 2
    a[:k] = np.array([5e4, 1e4]) + rng.normal(0, 40, (k, 2))
    a[: k // 2] = [5e4, 1e4]
    return a


def test_nearest_and_counts(spark):
    rng = np.random.default_rng(3)
    left, right = cloud(rng, 200), cloud(rng, 400)
    lf = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": left[:, 0], "y": left[:, 1]}))
    rt = spark.createDataFrame(pd.DataFrame({"ordinal": range(400), "x": right[:, 0], "y": right[:, 1]}))
    d = np.sqrt((left[:, None, 0] - right[None, :, 0]) ** 2 + (left[:, None, 1] - right[None, :, 1]) ** 2)
    out = spatial.nearest(lf, rt, carry={"ordinal": "rid"}).toPandas().sort_values("id")
    assert np.array_equal(out.nearest_m.to_numpy(), d.min(1)) and np.array_equal(out.rid.to_numpy(), d.argmin(1))
    cnt = spatial.count_within(lf, rt, 60.0).toPandas().sort_values("id")
    assert np.array_equal(cnt.n_within.to_numpy(), (d <= 60.0).sum(1))


def square(x0, y0, x1, y1):
    return [(float(a), float(b)) for a, b in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def test_point_in_polygon_excludes_holes_and_boundary(spark):
    schema = "geoid string, ordinal long, rings array<array<struct<x:double,y:double>>>"
    layer = spark.createDataFrame([("A", 1, [square(0, 0, 10, 10), square(4, 4, 6, 6)[::-1]]), ("B", 0, [square(9, 9, 12, 12)])], schema)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.5, 9.5), (4, 0.0, 5.0), (5, 50.0, 5.0)], "id int, lon double, lat double")
    got = {r.id: r.tract_geoid for r in polygons.resolve_tracts(pts, layer).collect()}
    assert got == {1: "A", 2: None, 3: "B", 4: None, 5: None}


def test_merge_of_close_detections(spark):
    df = spark.createDataFrame([(0, -79.0, 41.0), (1, -79.0005, 41.0), (2, -80.0, 41.0)], "ordinal long, lon double, lat double")
    assert {r.ordinal: r.cluster for r in components.merge_nearby(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_merge_follows_the_rule_in_order(spark):
    """Against a plain reading of the rule: first cluster by seed cell and age whose running mean is within the radius."""
    import math
    import random

    from siterank.functions.geo import EARTH_RADIUS_M

    r, radius = random.Random(4), 60.0
    at = [(-79 + r.randint(0, 3) * 0.01 + r.random() * 0.003, 41 + r.random() * 0.002) for _ in range(160)] + [(-70 + i * 1e-5, 41.5) for i in range(5)] + [(-60.0, 42.0)]

    def apart(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))

    cell, made, want = radius / 111_000, [], {}
    for i, p in enumerate(at):
        own = (math.floor(p[0] / cell), math.floor(p[1] / cell))
        reach = math.ceil(1 / math.cos(math.radians(p[1])))
        fits = [m for m in made if abs(m["cell"][0] - own[0]) <= reach and abs(m["cell"][1] - own[1]) <= 1 and apart(p, [sum(x) / len(m["at"]) for x in zip(*m["at"])]) <= radius]
        if fits:
            best = min(fits, key=lambda m: (m["cell"], m["seed"]))
        else:
            best = {"cell": own, "seed": i, "at": []}
            made.append(best)
        best["at"].append(p)
        want[i] = best["seed"]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "ordinal long, lon double, lat double")
    got = {x.ordinal: x.cluster for x in components.merge_nearby(df, radius).collect()}
    assert got == want and len(set(want.values())) < 150


def test_no_neighbour_means_no_distance(spark):
    sites = spark.createDataFrame([(0, 40.0, -80.0), (1, 41.0, -80.0)], "ordinal long, lat double, lon double")
    schools = spark.createDataFrame([(0, 40.001, -80.0, "near")], "ordinal long, lat double, lon double, NAME string")
    got = {r.ordinal: (r.schools_within_1mi, r.nearest_school_m, r.nearest_school) for r in enrich.schools_around(sites, schools).collect()}
    assert got[1] == (0, None, None) and got[0][0] == 1 and 100 < got[0][1] < 120
    maps = spark.createDataFrame([("m", -80.1, -79.9, 40.1, 39.9), ("n", -80.1, -79.9, 41.1, 40.9)], "map_id string, west double, east double, north double, south double")
    found = sites.withColumn("map_id", F.when(F.col("ordinal") == 0, "m").otherwise("n"))
    out = detections.exclude_known(found, schools.drop("NAME"), maps, km=0.05)
    assert {r.ordinal: r.dist_to_documented_m for r in out.collect()}[1] is None


def test_cells_are_listed_per_block_of_locations(spark):
    """Many locations in one place share one list of cells; results as by brute force, with ties, copies and names."""
    rng = np.random.default_rng(5)
    left, right = np.round(rng.normal(0, 300, (3000, 2)), 1), np.round(rng.normal(0, 300, (3000, 2)))
    lf = spark.createDataFrame(pd.DataFrame({"id": range(3000), "x": left[:, 0], "y": left[:, 1]}))
    rt = spark.createDataFrame(pd.DataFrame({"ordinal": rng.permutation(3000), "x": right[:, 0], "y": right[:, 1]})).withColumn("name", F.concat(F.lit("n"), "ordinal"))
    theirs = rt.toPandas()
    d = np.sqrt((left[:, None, 0] - theirs.x.to_numpy()[None]) ** 2 + (left[:, None, 1] - theirs.y.to_numpy()[None]) ** 2)
    blocks = spatial._blocks(lf, spatial.build_index(rt, ["x", "y"], "ordinal"))
    assert blocks.count() < 300 and blocks.selectExpr("sum(size(locs))").first()[0] == len({tuple(p) for p in left})
    out = spatial.nearest(lf, rt, carry={"ordinal": "rid"}).toPandas().sort_values("id")
    order = theirs.ordinal.to_numpy()
    assert np.array_equal(out.nearest_m.to_numpy(), d.min(1))
    assert np.array_equal(out.rid.to_numpy(), np.where(d == d.min(1)[:, None], order, 9999).min(1))
    cnt = spatial.count_within(lf, rt, 100.0).toPandas().sort_values("id")
    assert np.array_equal(cnt.n_within.to_numpy(), (d <= 100.0).sum(1))
    names = spatial.names_within(lf, rt, 100.0, "name").toPandas().sort_values("id")
    for row, got in zip(d, names.names):
        assert list(got) == [f"n{o}" for o in np.sort(order[row <= 100.0])[:8]]


def test_locations_without_finite_coordinates_have_no_neighbour(spark):
    left = spark.createDataFrame([(0, 0.0, 0.0), (1, float("nan"), 0.0), (2, None, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (8, float("nan"), 0.0)], "ordinal long, x double, y double")
    assert {r.id: r.nearest_m for r in spatial.nearest(left, right).collect()} == {0: 5.0, 1: None, 2: None}
    assert {r.id: r.n_within for r in spatial.count_within(left, right, 5.0).collect()} == {0: 1, 1: 0, 2: 0}
    assert {r.id: r.nearest_m for r in spatial.nearest(left, right.limit(0)).collect()} == {0: None, 1: None, 2: None}


def test_blobs_of_any_shape(spark):
    """Boxes of equal runs give the blobs of a flood fill: tall bars over block borders, rings, stairs, corners that only touch."""
    rng = np.random.default_rng(8)
    grid = rng.random((150, 150)) < 0.45
    grid[5:140, 3:9] = True
    grid[60:90, 100:140] = True
    grid[65:80, 110:130] = False
    label, want = np.zeros(grid.shape, int), []
    for r, c in zip(*np.nonzero(grid)):
        if label[r, c]:
            continue
        todo, cells, label[r, c] = [(r, c)], [], 1
        while todo:
            y, x = todo.pop()
            cells.append((y, x))
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < 150 and 0 <= b < 150 and grid[a, b] and not label[a, b]:
                    label[a, b] = 1
                    todo.append((a, b))
        if len(cells) >= 5:
            want.append((len(cells), *[int(round(sum(v) / len(cells))) for v in zip(*cells)]))
    rows, cols = np.nonzero(grid)
    pixels = spark.createDataFrame(pd.DataFrame({"map_id": 1, "row": rows.astype("int32"), "col": cols.astype("int32")}))
    got = [(r.area, r.row, r.col) for r in components.blobs(pixels, 5).collect()]
    assert sorted(got) == sorted(want)
    bar = spark.range(200).selectExpr("1 as map_id", "cast(id as int) as row", "explode(sequence(2, 6)) as col")
    assert components.pixel_boxes(bar).count() == 4 and [(r.area, r.row, r.col) for r in components.blobs(bar).collect()] == [(1000, 100, 4)]


def test_a_point_is_measured_against_clusters_near_it_only(monkeypatch):
    """Half of the points seed a cluster of their own in one group; none is measured against all of them."""
    seen, real = [], components.great_circle_m
    monkeypatch.setattr(components, "great_circle_m", lambda lon, lat, lons, lats: seen.append(len(lons)) or real(lon, lat, lons, lats))
    cell = 60.0 / 111_000
    at = np.arange(800)
    pdf = pd.DataFrame({"ordinal": at, "lon": (at % 400) * cell * 1.3 - 80, "lat": 41.0, "reach": 2})
    pdf["cx"], pdf["cy"] = np.floor(pdf.lon / cell).astype("int64"), np.floor(pdf.lat / cell).astype("int64")
    out = components._resolve(60.0)(pdf.assign(component="c"))
    assert out.cluster.nunique() > 150 and max(seen, default=0) <= 15
