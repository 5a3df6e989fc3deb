"""Python data source over shapefiles: points and polygons in parts of the index file.

A layer is a ``.shp`` with its index ``.shx``, its table ``.dbf`` (optional) and its projection ``.prj``, unpacked.  The index
has eight bytes a record, so a part is a range of records: a task reads its slice of the index, then the shapes and table rows
of that slice, in blocks of bounded size.  Files are reached through the file system of their address, which all share.

Null shapes give null geometry, rows marked as deleted in the table are left out, empty fields are null.  Rings come out with
shells counter-clockwise and holes clockwise.  Any projection but WGS 84 in degrees is refused, as is a layer without one.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, record long, attributes map<string,string>, lon double, lat double, rings array<array<struct<x:double,y:double>>>"
HEADER, INDEX_ENTRY = 100, 8
#: Bytes of shapes that a task holds at a time (one record may be larger).
BLOCK = 8 << 20
POINTS, POLYGONS, NULL = (1, 11, 21), (5, 15, 25), 0


class Layer:
    """One shapefile under an address."""

    def __init__(self, address: str):
        self.address = address

    def _open(self, ending: str):
        from pyarrow import fs

        upper = self.address.endswith(".SHP")
        system, path = fs.FileSystem.from_uri(self.address[:-4] + (ending.upper() if upper else ending))
        return system.open_input_file(path)

    def slice(self, ending: str, begin: int, size: int) -> bytes:
        with self._open(ending) as f:
            f.seek(begin)
            return f.read(size)

    def has(self, ending: str) -> bool:
        try:
            self._open(ending).close()
            return True
        except FileNotFoundError:
            return False

    def records(self) -> int:
        with self._open(".shx") as f:
            return (f.size() - HEADER) // INDEX_ENTRY

    def require_wgs84(self) -> None:
        if not self.has(".prj"):
            raise ValueError(f"{self.address} states no coordinate system; EPSG:4326 is required")
        with self._open(".prj") as f:
            text = f.read().decode("utf-8", "replace").strip()
        named = re.match(r'(?:GEOGCS|GEOGCRS|GEODCRS)\s*\[\s*"(?:GCS_WGS_1984|WGS[ _]?(?:19)?84)"', text, re.IGNORECASE)
        if not named:
            raise ValueError(f"coordinate system {text[:60]} of {self.address} is not supported; convert the layer to EPSG:4326 first")

    def table(self):
        """(bytes before the rows, bytes of a row, fields as (name, begin, end), encoding), or None without a table."""
        if not self.has(".dbf"):
            return None
        before, size = struct.unpack("<HH", self.slice(".dbf", 8, 4))
        head, fields, at = self.slice(".dbf", 32, before - 32), [], 1
        for i in range(0, len(head) - 31, 32):
            if head[i] == 0x0D:
                break
            name, width = head[i : i + 11].split(b"\0")[0].decode("latin-1"), head[i + 16]
            fields.append((name, at, at + width))
            at += width
        encoding = "latin-1"
        if self.has(".cpg"):
            with self._open(".cpg") as f:
                encoding = "utf-8" if b"UTF" in f.read().upper() else "latin-1"
        return before, size, fields, encoding


def layers_under(address: str) -> list[str]:
    """Addresses of the shapefiles in a folder and those below it, or the file itself, in order."""
    from pyarrow import fs

    if address.lower().endswith(".shp"):
        return [address]
    system, root = fs.FileSystem.from_uri(address)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(address.rstrip("/") + i.path[len(root.rstrip("/")) :] for i in found if i.path.lower().endswith(".shp"))


class Part(InputPartition):
    def __init__(self, address: str, begin: int, end: int):
        self.address, self.begin, self.end = address, begin, end


class ShapefileReader(DataSourceReader):
    def __init__(self, addresses: list[str], per_part: int):
        self.addresses, self.per_part = addresses, per_part

    def partitions(self):
        parts = []
        for address in (a for root in self.addresses for a in layers_under(root)):
            layer = Layer(address)
            layer.require_wgs84()
            n = layer.records()
            parts += [Part(address, i, min(i + self.per_part, n)) for i in range(0, n, self.per_part)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part):
        import numpy as np

        if not part.address:
            return
        layer = Layer(part.address)
        table = layer.table()
        index = np.frombuffer(layer.slice(".shx", HEADER + part.begin * INDEX_ENTRY, (part.end - part.begin) * INDEX_ENTRY), ">i4").reshape(-1, 2).astype("int64") * 2
        begins, ends = index[:, 0], index[:, 0] + 8 + index[:, 1]
        i = 0
        while i < len(index):
            j = i + 1
            # records behind one another in the file are read at once
            while j < len(index) and begins[j] >= ends[j - 1] and ends[j] - begins[i] <= BLOCK:
                j += 1
            shapes = layer.slice(".shp", int(begins[i]), int(ends[j - 1] - begins[i]))
            at = [(int(b - begins[i]) + 8, int(e - begins[i])) for b, e in zip(begins[i:j], ends[i:j])]
            yield self._batch(part.address, part.begin + i, shapes, at, self._attributes(layer, table, part.begin + i, j - i))
            i = j

    @staticmethod
    def _attributes(layer: Layer, table, first: int, n: int) -> list:
        """The fields of each row; None for rows marked as deleted."""
        if table is None:
            return [[]] * n
        before, size, fields, encoding = table
        block, out = layer.slice(".dbf", before + first * size, n * size), []
        for k in range(n):
            row = block[k * size : (k + 1) * size]
            texts = [(name, row[a:b].decode(encoding, "replace").strip(" \0")) for name, a, b in fields]
            out.append(None if row[:1] == b"*" else [(name, v or None) for name, v in texts])
        return out

    @staticmethod
    def _batch(address: str, first: int, shapes: bytes, at: list, attributes: list):
        import numpy as np
        import pyarrow as pa

        kept = [k for k, a in enumerate(attributes) if a is not None]
        lons, lats, rings, ring_ends, record_begins, seen = [], [], [], [0], [], 0
        for k in kept:
            begin, end = at[k]
            (kind,) = struct.unpack_from("<i", shapes, begin)
            lon = lat = None
            whole = False
            if kind in POINTS:
                lon, lat = struct.unpack_from("<dd", shapes, begin + 4)
            elif kind in POLYGONS:
                whole = True
                parts, points = struct.unpack_from("<ii", shapes, begin + 36)
                cuts = [*struct.unpack_from(f"<{parts}i", shapes, begin + 44), points]
                xy = np.frombuffer(shapes, "<f8", 2 * points, begin + 44 + 4 * parts).reshape(-1, 2)
                for a, b in zip(cuts, cuts[1:]):
                    rings.append(xy[a:b][::-1])
                    ring_ends.append(ring_ends[-1] + b - a)
            elif kind != NULL:
                raise ValueError(f"shape type {kind} of {address} is neither point nor polygon")
            lons.append(lon)
            lats.append(lat)
            record_begins.append(seen if whole else None)
            seen = len(rings)
        xy = np.concatenate(rings) if rings else np.empty((0, 2))
        points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], ["x", "y"])
        lists = pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), points)
        return pa.RecordBatch.from_arrays([
            pa.array([address] * len(kept), pa.string()), pa.array([first + k for k in kept], pa.int64()),
            pa.array([attributes[k] for k in kept], pa.map_(pa.string(), pa.string())), pa.array(lons, pa.float64()), pa.array(lats, pa.float64()),
            pa.ListArray.from_arrays(pa.array([*record_begins, seen], pa.int32()), lists),
        ], names=["file", "record", "attributes", "lon", "lat", "rings"])


class ShapefileSource(DataSource):
    """Options: ``path`` (a file, or a folder with all below it), ``states`` (only folders ``state_abbr=…``), ``records``."""

    @classmethod
    def name(cls):
        return "shapefile_layers"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        root, states = self.options["path"].rstrip("/"), self.options.get("states")
        roots = [root] if states is None else [f"{root}/state_abbr={s}" for s in states.split(",") if s]
        return ShapefileReader(roots, int(self.options.get("records", 50_000)))


def read_shapefile(spark: SparkSession, path: str, states: list[str] | None = None, records: int = 50_000) -> DataFrame:
    """All shapes with their attributes; ``records`` a part.  Of ``states`` only their folders are listed."""
    spark.dataSource.register(ShapefileSource)
    reader = spark.read.format("shapefile_layers").option("records", records)
    if states is not None:
        reader = reader.option("states", ",".join(states))
    return reader.load(path)


def read_shapefile_points(spark: SparkSession, path: str, columns: list[str], **kw) -> DataFrame:
    """Point records with the named attributes and lon, lat; other shapes are left out."""
    df = read_shapefile(spark, path, **kw).where("lon is not null")
    return df.select(*[F.col("attributes")[c].alias(c) for c in columns], "lon", "lat", "file", "record")


def read_shapefile_polygons(spark: SparkSession, path: str, attrs: dict[str, str], **kw) -> DataFrame:
    """Polygon records with renamed attributes and ``rings``; other shapes are left out."""
    df = read_shapefile(spark, path, **kw).where("rings is not null")
    return df.select(*[F.col("attributes")[s].alias(d) for s, d in attrs.items()], "rings", "file", "record")
