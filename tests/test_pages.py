"""Paged feature source: both body shapes, state filters, and a stream that is stopped and started again."""

import json
import os

import pytest

from siterank.sources import pages
from siterank.sources.pages import FeaturePageReader, FeaturePageStream, read_pages, stream_pages


def land(root, state, offset, n, esri=False):
    """A page of ``n`` features numbered from its offset, written under another name first so that it appears at once."""
    os.makedirs(root / state, exist_ok=True)
    rows = [
        {"attributes": {"id": offset + i, "none": None}, "geometry": {"x": -80.0 + i, "y": 40.5}} if esri
        else {"type": "Feature", "properties": {"id": offset + i}, "geometry": {"type": "Point", "coordinates": [-80.0 + i, 40.5]} if i % 2 else None}
        for i in range(n)
    ]
    (root / state / f"{offset}.part").write_text(json.dumps({"features": rows}))
    os.rename(root / state / f"{offset}.part", root / state / f"{offset}.json")


@pytest.fixture
def landed(tmp_path):
    root = tmp_path / "pages"
    for offset in (0, 3, 6):
        land(root, "OH", offset, 3)
    land(root, "PA", 0, 3, esri=True)
    return root


def listed(monkeypatch):
    seen = []
    plain = pages.PageFolder.offsets
    monkeypatch.setattr(pages.PageFolder, "offsets", lambda self, state: seen.append(state) or plain(self, state))
    return seen


def test_table_of_both_shapes(spark, landed):
    rows = read_pages(spark, str(landed)).orderBy("ordinal").collect()
    assert [(r.state, r.attributes["id"], r.lon) for r in rows] == [("OH", str(i), None if i % 3 % 2 == 0 else -79.0) for i in range(9)] + [("PA", str(i), -80.0 + i) for i in range(3)]
    assert read_pages(spark, f"file://{landed}", ["PA"]).count() == 3
    assert read_pages(spark, str(landed)).where("state = 'PA'").count() == 3


def test_a_filter_lists_one_folder(landed, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    seen = listed(monkeypatch)
    reader = FeaturePageReader(str(landed), [])
    list(reader.pushFilters([EqualTo(("state",), "PA")]))
    assert [(p.state, p.offset) for p in reader.partitions()] == [("PA", 0)] and seen == ["PA"]


def test_positions(landed, monkeypatch):
    seen = listed(monkeypatch)
    stream = FeaturePageStream(str(landed), [], 3)
    assert stream.latestOffset() == {"OH": 9, "PA": 3}
    land(landed, "OH", 12, 3)  # the page before is missing, so this one is waited for
    assert stream.latestOffset() == {"OH": 9, "PA": 3}
    land(landed, "OH", 9, 3)
    land(landed, "PA", 3, 1, esri=True)
    assert stream.latestOffset() == {"OH": 15, "PA": 6}
    seen.clear()
    assert stream.latestOffset() == {"OH": 15, "PA": 6} and seen == ["OH"]  # the short page ended the other state
    assert [(p.state, p.offset) for p in stream.partitions({"OH": 9, "PA": 3}, {"OH": 15, "PA": 6})] == [("OH", 9), ("OH", 12), ("PA", 3)]
    again = FeaturePageStream(str(landed), ["PA"], 3)
    assert again.latestOffset() == {"PA": 6} and seen[-1] == "PA"


def test_restart_reads_no_page_twice(spark, landed, tmp_path):
    def run():
        q = (
            stream_pages(spark, str(landed), page_size=3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        q.stop()
        return sorted((r.state, int(r.attributes["id"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("OH", i) for i in range(9)] + [("PA", i) for i in range(3)]
    assert run() == first
    assert run() == first
    land(landed, "OH", 9, 3)
    land(landed, "PA", 3, 2, esri=True)
    assert run() == sorted(first + [("OH", 9), ("OH", 10), ("OH", 11), ("PA", 3), ("PA", 4)])
