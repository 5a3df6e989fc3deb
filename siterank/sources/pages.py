"""Python data source over landed pages of a feature service, as a table and as a stream.

Layout: ``<path>/<state>/<offset>.json``.  Every page file is one input partition, so pages are read in parallel; both
GeoJSON and ESRI JSON bodies are understood.  The folder is reached through the file system of its address, which driver and
executors share.  The stream's position is the next offset of each state: pages follow one another by the page size, a page
that isn't there yet is waited for, and a page with fewer rows ends its state.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

SCHEMA = "state string, page_offset long, position long, attributes map<string,string>, lon double, lat double"


class PagePartition(InputPartition):
    def __init__(self, state: str, offset: int, path: str):
        self.state, self.offset, self.path = state, offset, path


class PageFolder:
    """The landed pages under an address such as ``file:///data``, ``s3://bucket/pages`` or a plain path."""

    def __init__(self, address: str):
        self.address = address

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.address)

    def states(self) -> list[str]:
        from pyarrow import fs

        system, root = self._place()
        return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory)

    def offsets(self, state: str) -> list[int]:
        """Offsets of the pages of one state; no other folder is listed."""
        from pyarrow import fs

        system, root = self._place()
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(f"{root}/{state}", allow_not_found=True)) if i.type == fs.FileType.File]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def features(self, state: str, offset: int) -> list:
        system, root = self._place()
        with system.open_input_stream(f"{root}/{state}/{offset}.json") as f:
            return json.loads(f.read()).get("features") or []

    def partition(self, state: str, offset: int) -> PagePartition:
        return PagePartition(state, offset, f"{self.address}/{state}/{offset}.json")

    def rows(self, part: PagePartition):
        for i, f in enumerate(self.features(part.state, part.offset)):
            props = f.get("properties") or f.get("attributes") or {}
            g = f.get("geometry") or {}
            at = g.get("coordinates") or [g.get("x"), g.get("y")]
            text = {k: None if v is None else str(v) for k, v in props.items()}
            lon, lat = (None if v is None else float(v) for v in at[:2])
            yield part.state, part.offset, i, text, lon, lat


class FeaturePageReader(DataSourceReader):
    def __init__(self, root: str, states: list[str]):
        self.folder, self.states = PageFolder(root), states

    def pushFilters(self, filters):
        """Equality on ``state`` skips the other folders; Spark still applies what is returned."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("state",):
                self.states = [f.value] if not self.states or f.value in self.states else ["\0"]
            yield f

    def partitions(self):
        known = self.folder.states()
        return [self.folder.partition(s, o) for s in known if not self.states or s in self.states for o in self.folder.offsets(s)]

    def read(self, part):
        yield from self.folder.rows(part)


class FeaturePageStream(DataSourceStreamReader):
    """All pages of each state that follow one another; positions are found from the folder alone, so a restart needs no memory."""

    def __init__(self, root: str, states: list[str], page_size: int):
        self.folder, self.chosen, self.page_size = PageFolder(root), states, page_size
        self.reached: dict[str, int] = {}
        self.ended: set[str] = set()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for state in self.chosen or self.folder.states():
            if state in self.ended:
                continue
            landed, at = set(self.folder.offsets(state)), 0
            while at in landed:
                at += self.page_size
            if at > self.reached.get(state, 0):
                self.reached[state] = at
                # a state's last page, and only that, may be short: nothing follows, so its folder isn't listed again
                if len(self.folder.features(state, at - self.page_size)) < self.page_size:
                    self.ended.add(state)
        return dict(self.reached)

    def partitions(self, start: dict, end: dict):
        return [self.folder.partition(s, o) for s in sorted(end) for o in range(start.get(s, 0), end[s], self.page_size)]

    def read(self, part):
        yield from self.folder.rows(part)


class FeaturePages(DataSource):
    """``format("feature_pages")`` for ``spark.read`` and ``spark.readStream``, with options ``path`` and ``states`` (OH,PA).

    For streams also ``page_size`` (1000).
    """

    @classmethod
    def name(cls):
        return "feature_pages"

    def schema(self):
        return SCHEMA

    def _states(self) -> list[str]:
        return [s for s in self.options.get("states", "").split(",") if s]

    def reader(self, schema):
        return FeaturePageReader(self.options["path"], self._states())

    def streamReader(self, schema):
        return FeaturePageStream(self.options["path"], self._states(), int(self.options.get("page_size", 1000)))


def read_pages(spark, path: str, states: list[str] | None = None):
    """Feature rows with ``ordinal`` ready for a registry field map."""
    from pyspark.sql import functions as F

    from siterank.operators.ordering import dense_ordinal

    spark.dataSource.register(FeaturePages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader with pushFilters is refused without it
    df = spark.read.format("feature_pages").option("path", path).option("states", ",".join(states or [])).load()
    return dense_ordinal(df, ["state", "page_offset", "position"])


def stream_pages(spark, path: str, states: list[str] | None = None, page_size: int = 1000):
    """The pages as a stream; a query that is started again from its checkpoint goes on with the next page of each state."""
    spark.dataSource.register(FeaturePages)
    return (
        spark.readStream.format("feature_pages").option("path", path).option("states", ",".join(states or []))
        .option("page_size", page_size).load()
    )


def page_columns(pages, fields: list[str]):
    """Attribute map to the named columns plus the geometry helpers."""
    from pyspark.sql import functions as F

    return pages.select(
        *[F.col("attributes").getItem(f).alias(f) for f in fields],
        F.col("lon").alias("__lon"), F.col("lat").alias("__lat"), "state", "ordinal",
    )
