import json
import struct

import pytest

from siterank.sources import readers, shapefile

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def write(folder, name, shapes, rows, fields, prj=WGS84, deleted=()):
    """A layer of points ((x, y)), polygons ([shell clockwise, hole, ...]) or None."""
    folder.mkdir(parents=True, exist_ok=True)
    body, index, at = b"", b"", 50
    for i, s in enumerate(shapes):
        if s is None:
            content = struct.pack("<i", 0)
        elif isinstance(s, tuple):
            content = struct.pack("<idd", 1, *s)
        else:
            flat = [p for ring in s for p in ring]
            xs, ys = [p[0] for p in flat], [p[1] for p in flat]
            starts = [sum(len(r) for r in s[:k]) for k in range(len(s))]
            content = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(s), len(flat)) + struct.pack(f"<{len(s)}i", *starts)
            content += b"".join(struct.pack("<dd", *p) for p in flat)
        body += struct.pack(">ii", i + 1, len(content) // 2) + content
        index += struct.pack(">ii", at, len(content) // 2)
        at += 4 + len(content) // 2
    (folder / f"{name}.shp").write_bytes(bytes(100) + body)
    (folder / f"{name}.shx").write_bytes(bytes(100) + index)
    size = 1 + sum(w for _, w in fields)
    head = struct.pack("<BBBBIHH", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size) + bytes(20)
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for n, w in fields) + b"\r"
    table = b"".join((b"*" if i in deleted else b" ") + b"".join((v or "").encode().ljust(w)[:w] for v, (_, w) in zip(r, fields)) for i, r in enumerate(rows))
    (folder / f"{name}.dbf").write_bytes(head + table)
    (folder / f"{name}.cpg").write_text("UTF-8")
    if prj:
        (folder / f"{name}.prj").write_text(prj)


def test_points_equal_the_same_layer_as_json(spark, tmp_path):
    shapes = [None if i % 10 == 3 else (-80 + i / 7, 40 - i / 9) for i in range(101)]
    rows = [(f"w{i}", None if i % 4 == 0 else f"Bohrung Ä{i}") for i in range(101)]
    write(tmp_path / "a", "wells", shapes, rows, [("API", 8), ("NAME", 20)], deleted={5})
    features = [
        {"type": "Feature", "properties": {"API": r[0], "NAME": r[1]}, "geometry": {"type": "Point", "coordinates": list(s)}}
        for i, (s, r) in enumerate(zip(shapes, rows)) if s and i != 5
    ]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    want = {tuple(r) for r in readers.read_geojson_points(spark, str(tmp_path / "b.geojson"), "struct<API:string,NAME:string>").select("API", "NAME", "lon", "lat").collect()}
    for records in (1000, 7, 1):
        got = shapefile.read_shapefile_points(spark, str(tmp_path / "a"), ["API", "NAME"], records=records)
        assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want) == 90
        assert got.rdd.getNumPartitions() == -(-101 // records)
    bulk = readers.read_bulk(spark, str(tmp_path / "a" / "wells.shp"), "shp", ["API", "NAME"])
    assert {(r.API, r.NAME, r["__lon"], r["__lat"]) for r in bulk.collect()} == want and bulk.select("ordinal").distinct().count() == 90
    whole = shapefile.read_shapefile(spark, str(tmp_path / "a"))
    assert whole.count() == 100 and whole.where("lon is null").count() == 10


def test_polygons_with_holes_equal_the_same_layer_as_json(spark, tmp_path, monkeypatch):
    def square(x, y, s, clockwise):
        ring = [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
        return ring if clockwise else ring[::-1]

    shapes = [[square(k, k, 4.0, True), square(k + 1, k + 1, 1.0, False), square(k + 10, k, 2.0, True)] for k in range(9)] + [None]
    rows = [(f"G{k}",) for k in range(10)]
    for state, part in (("OH", slice(0, 5)), ("PA", slice(5, 10))):
        write(tmp_path / f"state_abbr={state}", "tracts", shapes[part], rows[part], [("GEOID", 5)])
    features = [
        {"type": "Feature", "properties": {"GEOID": r[0]}, "geometry": {"type": "MultiPolygon", "coordinates": [[s[0], s[1]], [s[2]]]}} for s, r in zip(shapes, rows) if s
    ]
    (tmp_path / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))

    def rings(df):
        return {r.geoid: {frozenset((tuple(a), tuple(b)) for a, b in zip(ring, ring[1:])) for ring in r.rings} for r in df.collect()}

    want = rings(readers.read_polygons(spark, str(tmp_path / "all.geojson"), {"GEOID": "geoid"}))
    monkeypatch.setattr(shapefile, "BLOCK", 700)
    assert rings(shapefile.read_shapefile_polygons(spark, str(tmp_path), {"GEOID": "geoid"}, records=4)) == want and len(want) == 9
    ohio = shapefile.read_shapefile_polygons(spark, str(tmp_path), {"GEOID": "geoid"}, states=["OH", "XX"])
    assert sorted(r.geoid for r in ohio.collect()) == [f"G{k}" for k in range(5)]
    assert shapefile.read_shapefile_polygons(spark, str(tmp_path), {"GEOID": "geoid"}, states=[]).count() == 0


@pytest.mark.parametrize("prj", [None, 'PROJCS["NAD_1983_UTM_Zone_17N",GEOGCS["GCS_WGS_1984"]]', 'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983"]]'])
def test_other_projections_are_refused(spark, tmp_path, prj):
    write(tmp_path / "a", "wells", [(1.0, 2.0)], [("x",)], [("API", 4)], prj=prj)
    with pytest.raises(Exception, match="EPSG:4326"):
        shapefile.read_shapefile(spark, str(tmp_path / "a")).count()
