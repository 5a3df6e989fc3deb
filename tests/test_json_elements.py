"""Splittable JSON readers: equal rows for any split size, whatever strings hold."""

import json
import random

import pytest

from siterank.sources import readers
from siterank.sources.json_elements import read_elements

STRINGS = ["plain", 'quo"te', "back\\slash", "\\", '\\"', "}{", "}]},{", '"}', "[", "é漢🙂", "line\nend", "", ":{", '{"a":1}', "\\\\}", " "]


def record(r, i):
    return {"id": i, "name": r.choice(STRINGS) * r.randint(0, 3), "tags": [r.choice(STRINGS) for _ in range(r.randint(0, 3))], "inner": {"x": i / 4, "deep": [{"y": r.choice(STRINGS)}, {}]} if r.random() < 0.7 else None}


@pytest.fixture(scope="module")
def records():
    r = random.Random(2)
    return [record(r, i) for i in range(300)]


def split(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture(autouse=True)
def restore(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [700, 4001, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_and_keyed_objects(spark, tmp_path, records, size, indent):
    (tmp_path / "a").mkdir()
    (tmp_path / "k").mkdir()
    for n, part in (("1", records[:200]), ("2", records[200:]), ("3", [])):
        (tmp_path / "a" / f"{n}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
        (tmp_path / "k" / f"{n}.json").write_text(json.dumps({f"k{i['id']}}}": i for i in part}, indent=indent), encoding="utf-8")
    split(spark, size)
    got = read_elements(spark, str(tmp_path / "a")).collect()
    assert sorted((json.loads(x.value) for x in got), key=lambda v: v["id"]) == records
    for name in "12":
        mine = sorted((x for x in got if x.file.endswith(f"{name}.json")), key=lambda x: x.number)
        assert [json.loads(x.value)["id"] for x in mine] == [v["id"] for v in (records[:200] if name == "1" else records[200:])]
    keyed = {json.loads(x.key): json.loads(x.value) for x in read_elements(spark, str(tmp_path / "k"), keyed=True).collect()}
    assert keyed == {f"k{i['id']}}}": i for i in records}


@pytest.mark.parametrize("size", [512, 1 << 27])
def test_readers(spark, tmp_path, records, size):
    split(spark, size)
    (tmp_path / "r.json").write_text(json.dumps(records))
    rows = readers.read_records(spark, str(tmp_path / "r.json"), "id long, name string, tags array<string>").collect()
    assert sorted((r.id, r.name, r.tags) for r in rows) == [(v["id"], v["name"], v["tags"]) for v in records]
    (tmp_path / "k.json").write_text(json.dumps({str(v["id"]): v for v in records}))
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path / "k.json"), "id long")
    rows = readers.read_keyed(spark, str(tmp_path / "k.json"), "id long, name string").collect()
    assert sorted((int(r.well_id), r.id, r.name) for r in rows) == [(v["id"], v["id"], v["name"]) for v in records]
    features = [{"type": "Feature", "properties": {"name": v["name"]}, "geometry": {"type": "Point" if i % 3 else "LineString", "coordinates": [i / 8, -i / 8] if i % 3 else [[0, 0], [1, 1]]}} for i, v in enumerate(records)]
    body = {"type": "FeatureCollection", "name": "}]", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "features": features, "meta": {"note": {"a": 1}}}
    (tmp_path / "f.geojson").write_text(json.dumps(body))
    got = readers.read_geojson_points(spark, str(tmp_path / "f.geojson"), "struct<name:string>").orderBy("ordinal").collect()
    assert [(r.lon, r.lat, r.name) for r in got] == [(f["geometry"]["coordinates"][0], f["geometry"]["coordinates"][1], f["properties"]["name"]) for f in features if f["geometry"]["type"] == "Point"]


def test_a_file_is_read_by_many_tasks(spark, tmp_path, records):
    split(spark, 2000)
    (tmp_path / "a.json").write_text(json.dumps(records * 5))
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    assert read_elements(spark, str(tmp_path / "a.json")).count() == 1500
