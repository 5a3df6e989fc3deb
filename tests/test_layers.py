import json

import pytest
from pyspark.sql import functions as F

from siterank.sources import layers, readers


def test_the_curve_visits_neighbours(spark):
    n = 16
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    rows = sorted(((r.d, r.x, r.y) for r in cells.select("x", "y", layers.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()))
    assert [d for d, _, _ in rows] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("bits", [1, 2, 3, 5, 16])
def test_places_are_those_of_the_curve_and_compiled(spark, bits):
    """Bit by bit in Python; the expression has no lambda, which Spark would interpret for every row."""
    def place(x, y):
        d, top = 0, (1 << bits) - 1
        for k in range(bits - 1, -1, -1):
            rx, ry = x >> k & 1, y >> k & 1
            d += (1 << 2 * k) * (2 if rx and ry else 3 if rx else ry)
            if not ry:
                x, y = (top - y, top - x) if rx else (y, x)
        return d

    i, n = F.col("id"), 1 << bits
    df = spark.range(2_000).select((i * 7919 % n).alias("x"), (i * 104729 % n).alias("y")).withColumn("d", layers.hilbert(F.col("x"), F.col("y"), bits))
    assert [r for r in df.collect() if r.d != place(r.x, r.y)] == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "*(1) Project" in plan


def squares(spark, n=20_000):
    """Small squares over the lower states by integer arithmetic, one state with a third of all, one row without geometry."""
    i = F.col("id")
    x, y = -120.0 + ((i * 7919) % 100003) / 100003.0 * 50, 30.0 + ((i * 104729) % 100019) / 100019.0 * 15
    p = [F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (0.05, 0.0), (0.05, 0.05), (0.0, 0.05), (0.0, 0.0))]
    state = F.when(i % 3 == 0, "TX").otherwise(F.concat(F.lit("S"), (i % 5).cast("string")))
    return spark.range(n).select(i.alias("ordinal"), state.alias("state_abbr"), F.when(i != 7, F.array(F.array(*p))).alias("rings"))


def brute(rows, states, boxes, margin=0.0):
    def meets(r, b):
        return r.west <= b[2] + margin and r.east >= b[0] - margin and r.south <= b[3] + margin and r.north >= b[1] - margin

    return sorted(r.ordinal for r in rows if (states is None or r.state_abbr in states) and (boxes is None or (r.west is not None and any(meets(r, b) for b in boxes))))


def test_boxes_and_states_read_their_part_only(spark, tmp_path):
    path = str(tmp_path / "layer")
    layers.write_layer(squares(spark), path, page_rows=100)
    rows = layers.with_boxes(squares(spark)).select("ordinal", "state_abbr", *layers.BOX).collect()
    some = [(-100.0, 35.0, -99.0, 36.0), (-80.0, 40.0, -79.5, 40.5)]
    many = [(-120.0 + k, 30.0 + k / 5, -119.9 + k, 30.1 + k / 5) for k in range(50)]
    edge = next(r for r in rows if r.ordinal == 11)
    for states, boxes, margin in [(None, None, 0), (["TX"], None, 0), (None, some, 0), (["TX", "S2", "no"], some, 0.1), (None, many, 0.002), ([], None, 0), (None, [], 0),
                                  (None, [(edge.east, edge.north, edge.east, edge.north)], 0)]:
        got = sorted(r.ordinal for r in layers.read_layer(spark, path, states, boxes, margin).select("ordinal").collect())
        assert got == brute(rows, states, boxes, margin), (states, boxes)

    def scanned(df):
        """Rows that leave the scan, and its text in the plan."""
        df.select("ordinal", "rings").collect()
        plan = df.select("ordinal", "rings")._jdf.queryExecution()
        executed = plan.executedPlan()
        plan.toRdd().count()
        scan = executed.collectLeaves().head()
        return scan.metrics().apply("numOutputRows").value(), scan.metrics().apply("filesSize").value(), executed.toString()

    spark.conf.set("spark.sql.maxMetadataValueLength", "2000")
    all_rows, all_bytes, _ = scanned(layers.read_layer(spark, path))
    assert all_rows == 20_000
    in_box, _, plan = scanned(layers.read_layer(spark, path, boxes=some))
    assert "PushedFilters: [Or(" in plan and in_box < all_rows / 4
    in_state, state_bytes, plan = scanned(layers.read_layer(spark, path, ["S1"]))
    spark.conf.unset("spark.sql.maxMetadataValueLength")
    assert "PartitionFilters: [isnotnull(state_abbr" in plan and in_state < all_rows / 5 and state_bytes < all_bytes / 3


def test_point_layers_and_layers_without_states(spark, tmp_path):
    path = str(tmp_path / "points")
    points = spark.createDataFrame([(1, -80.0, 40.0), (2, -81.0, 41.0), (3, None, 40.0)], "ordinal long, lon double, lat double")
    layers.write_layer(points, path, state=None)
    assert [r.ordinal for r in layers.read_layer(spark, path, boxes=[(-80.0, 40.0, -80.0, 40.0)]).collect()] == [1]
    assert layers.read_layer(spark, path).count() == 3
    layers.write_layer(points.limit(0), path, state=None)
    assert layers.read_layer(spark, path, boxes=[(-180.0, -90.0, 180.0, 90.0)]).count() == 0


@pytest.mark.parametrize("states, want", [(None, ["A", "B", "C"]), (["OH"], ["A"]), (["OH", "WV", "XX"], ["A", "C"]), (["XX"], []), ([], [])])
def test_polygons_of_states_open_their_folders_only(spark, tmp_path, states, want):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    for state, geoid in (("OH", "A"), ("PA", "B"), ("WV", "C")):
        folder = tmp_path / f"state_abbr={state}"
        folder.mkdir()
        feature = {"type": "Feature", "properties": {"GEOID": geoid}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        (folder / "layer.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    got = readers.read_polygons(spark, str(tmp_path), {"GEOID": "geoid"}, states)
    assert sorted(r.geoid for r in got.collect()) == want and got.columns == ["geoid", "rings", "ordinal"]
    if states == ["OH"]:
        assert all("state_abbr=OH" in f for f in got.inputFiles())
