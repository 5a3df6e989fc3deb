"""A keyed Parquet table that is changed in parts, with a manifest that switches all of a change at once.

Keys are dealt over a fixed number of buckets by hash.  A bucket is a list of segments (folders written once, never changed);
the manifest of the highest version names the segments of every bucket.  ``merge`` writes the touched buckets anew,
``append`` adds a segment to them; other buckets keep their files.  The new manifest is written aside and renamed to its
version, which fails if another writer was faster; what a failed change has written is named by no manifest, and ``vacuum``
removes it.  A file system must rename without overwriting for writers to run side by side (HDFS and local ones do; on object
stores let one writer run at a time).

Every segment has a Bloom filter of its keys, so that ``append`` reads the keys only of segments that may hold one of the new
rows.  Choose ``buckets`` so that a bucket is about a gigabyte; the manifest has at most ``MOST_SEGMENTS`` entries a bucket.
Rows without a key (null in every key column) are a key like any other.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siterank.operators.ordering import keep_first

#: Segments of a bucket; one more, and the bucket is written as one again.
MOST_SEGMENTS = 8
#: Bits of a block of a Bloom filter (what one bitmap holds), bits set for a key, and keys that a block is meant for.
BLOCK, HASHES, PER_BLOCK = 32768, 5, 3000
BUCKET, SEGMENT = "bucket__", "segment__"


class Conflict(RuntimeError):
    """Another writer changed the table since this one read its manifest."""


def _hash(keys: list[str], seed: int, below) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(below).cast("long") if isinstance(below, int) else below)


def without(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; nulls are equal."""
    renamed = b.select(*[F.col(k).alias(f"{k}__b") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__b"))
    return a.join(renamed, on, "left_anti")


class KeyedStore:
    """The table in one folder; ``last`` tells what the last change looked at."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path.rstrip("/"), {}
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    # --- manifests ----------------------------------------------------------
    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """Versions with a manifest, ascending."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            if not (all_of_them := self.versions()):
                raise FileNotFoundError(f"no manifest in {self.path}")
            version = all_of_them[-1]
        stream = self._fs.open(self._at("manifests", f"{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, manifest: dict) -> int:
        """The one step that makes a change visible."""
        aside, there = self._at("manifests", f"tmp-{uuid.uuid4().hex}"), self._at("manifests", f"{manifest['version']}.json")
        out = self._fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, there, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} was written by another") from e
            raise
        return manifest["version"]

    def create(self, schema: str, keys: list[str], buckets: int = 256) -> "KeyedStore":
        """An empty table, unless there is one already."""
        if clash := {BUCKET, SEGMENT} & set(T.StructType.fromDDL(schema).names):
            raise ValueError(f"reserved names: {sorted(clash)}")
        if not self.versions():
            try:
                self._switch({"version": 0, "schema": schema, "keys": keys, "buckets": buckets, "segments": {}, "writers": {}})
            except Conflict:
                pass  # created by another at the same time
        return self

    # --- reading ------------------------------------------------------------
    def _segments(self, kind: str, named: list[tuple[str, str]], columns: T.StructType) -> DataFrame:
        """Rows of the (bucket, segment) pairs with both as columns; no other folder is listed."""
        schema = T.StructType([*columns, T.StructField(SEGMENT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        if not named:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{SEGMENT}={s}/{BUCKET}={b}" for b, s in named])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version that ``vacuum`` has left, the latest if none is given."""
        m = self.manifest(version)
        columns = T.StructType.fromDDL(m["schema"])
        return self._segments("data", _named(m), columns).select(*columns.names)

    # --- changes ------------------------------------------------------------
    def merge(self, fresh: DataFrame, order, writer: str | None = None, batch: int | None = None) -> int:
        """Rows of ``fresh`` replace those of their keys; returns the version.

        Of rows of one key in ``fresh`` the first by ``order`` counts (a column, a sort order or a list of them, unique within
        a key).  Other columns than those of the table may stand in ``fresh`` and be part of the order.  A ``batch`` of a
        ``writer`` that is in the table already, or a later one, changes nothing.
        """
        m = self.manifest()
        if _done(m, writer, batch):
            return m["version"]
        rows = self._firsts(fresh, order, m).persist()
        try:
            touched = self._buckets(rows)
            columns = T.StructType.fromDDL(m["schema"])
            named = _named(m, touched)
            self.last = {"segments": len(_named(m)), "read": len(named)}
            kept = without(self._segments("data", named, columns).drop(SEGMENT), rows, m["keys"])
            return self._commit(m, kept.unionByName(rows), touched, writer, batch)
        finally:
            rows.unpersist()

    def append(self, fresh: DataFrame, order, writer: str | None = None, batch: int | None = None) -> int:
        """Rows of ``fresh`` whose key is not stored, the first by ``order`` of each; otherwise as ``merge``.

        Only keys of segments whose Bloom filter holds one of the new keys are read.
        """
        m = self.manifest()
        if _done(m, writer, batch):
            return m["version"]
        rows = self._firsts(fresh, order, m).persist()
        try:
            new = self._not_stored(rows, m).persist()
            try:
                touched = self._buckets(new)
                full = {b for b in touched if len(m["segments"].get(b, [])) >= MOST_SEGMENTS}
                old = self._segments("data", _named(m, full), T.StructType.fromDDL(m["schema"])).drop(SEGMENT)
                return self._commit(m, new.unionByName(old) if full else new, full, writer, batch)
            finally:
                new.unpersist()
        finally:
            rows.unpersist()

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not stored, all of equal keys; keys are read as by ``append``."""
        m = self.manifest()
        types = {f.name: f.dataType for f in T.StructType.fromDDL(m["schema"]) if f.name in m["keys"]}
        typed = rows.withColumns({k: F.col(k).cast(t) for k, t in types.items()})
        return self._not_stored(typed.withColumn(BUCKET, _hash(m["keys"], 0, m["buckets"]).cast("int")), m).drop(BUCKET)

    def _not_stored(self, rows: DataFrame, m: dict) -> DataFrame:
        maybe = self._maybe(rows, m)
        self.last = {"segments": len(_named(m)), "read": len(maybe)}
        columns = T.StructType([f for f in T.StructType.fromDDL(m["schema"]) if f.name in m["keys"]])
        return without(rows, self._segments("data", maybe, columns), m["keys"])

    def _firsts(self, fresh: DataFrame, order, m: dict) -> DataFrame:
        columns = T.StructType.fromDDL(m["schema"])
        typed = fresh.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in columns})
        return keep_first(typed, m["keys"], order).select(*columns.names).withColumn(BUCKET, _hash(m["keys"], 0, m["buckets"]).cast("int"))

    @staticmethod
    def _buckets(rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(BUCKET).distinct().collect()}  # at most as many as there are buckets

    def _maybe(self, rows: DataFrame, m: dict) -> list[tuple[str, str]]:
        """(bucket, segment) pairs that may hold a key of ``rows``."""
        named = _named(m, self._buckets(rows))
        if not named:
            return []
        keys = m["keys"]
        blocks = {(b, s): n for b, found in m["segments"].items() for s, _, n in found}
        segments = self.spark.createDataFrame([(int(b), s, blocks[b, s]) for b, s in named], f"{BUCKET} int, {SEGMENT} string, blocks long")
        asked = rows.select(BUCKET, *keys).join(segments, BUCKET).select(
            BUCKET, SEGMENT, _hash(keys, 1, F.col("blocks")).alias("block"),
            F.array(*[_hash(keys, 2 + i, BLOCK).cast("int") for i in range(HASHES)]).alias("places"),
        )
        filters = self._segments("filters", named, T.StructType.fromDDL("block long, bits binary"))

        def is_set(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring("bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return byte.bitwiseAND(F.pow(F.lit(2), p % 8).cast("int")) != 0

        hits = asked.join(filters, [BUCKET, SEGMENT, "block"]).where(F.forall("places", is_set))
        return [(str(b), s) for b, s in hits.select(BUCKET, SEGMENT).distinct().collect()]  # at most MOST_SEGMENTS a bucket

    def _commit(self, m: dict, rows: DataFrame, replaced: set[str], writer: str | None, batch: int | None) -> int:
        """Write ``rows`` as a segment of their buckets, in place of the others in buckets that are ``replaced``."""
        name, keys = uuid.uuid4().hex, m["keys"]
        columns = T.StructType.fromDDL(m["schema"])
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{SEGMENT}={name}")
        written = self.spark.read.schema(T.StructType([*columns, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.path}/data/{SEGMENT}={name}")
        sizes = {str(b): n for b, n in written.groupBy(BUCKET).count().collect()}  # at most as many as there are buckets
        if not sizes and writer is None:
            return m["version"]
        blocks = {b: n // PER_BLOCK + 1 for b, n in sizes.items()}
        if sizes:
            counts = self.spark.createDataFrame([(int(b), n) for b, n in blocks.items()], f"{BUCKET} int, blocks long")
            places = F.array(*[_hash(keys, 2 + i, BLOCK) for i in range(HASHES)])
            bits = written.join(counts, BUCKET).select(BUCKET, _hash(keys, 1, F.col("blocks")).alias("block"), F.explode(places).alias("place"))
            bits.groupBy(BUCKET, "block").agg(F.bitmap_construct_agg("place").alias("bits")).repartition(BUCKET).write.partitionBy(BUCKET).parquet(
                f"{self.path}/filters/{SEGMENT}={name}")
        segments = {b: found for b, found in m["segments"].items() if b not in replaced}
        for b, n in sizes.items():
            segments[b] = [*segments.get(b, []), [name, n, blocks[b]]]
        writers = m["writers"] if writer is None else {**m["writers"], writer: batch}
        return self._switch({**m, "version": m["version"] + 1, "segments": segments, "writers": writers})

    def vacuum(self, keep: int = 2) -> int:
        """Remove what none of the newest ``keep`` versions names; no writer may be at work.  Returns the folders removed."""
        versions = self.versions()
        named = {pair for v in versions[-keep:] for pair in _named(self.manifest(v))}
        for v in versions[:-keep]:
            self._fs.delete(self._at("manifests", f"{v}.json"), False)
        gone = 0
        for kind in ("data", "filters"):
            if not self._fs.exists(self._at(kind)):
                continue
            for folder in self._fs.listStatus(self._at(kind)):
                segment = folder.getPath().getName().split("=", 1)[1]
                buckets = [(f.getPath(), f.getPath().getName().split("=", 1)[1]) for f in self._fs.listStatus(folder.getPath()) if f.isDirectory()]
                unnamed = [p for p, b in buckets if (b, segment) not in named]
                for p in [folder.getPath()] if len(unnamed) == len(buckets) else unnamed:
                    self._fs.delete(p, True)
                gone += len(unnamed)
        return gone


def _named(m: dict, buckets: set[str] | None = None) -> list[tuple[str, str]]:
    return [(b, s) for b, found in m["segments"].items() if buckets is None or b in buckets for s, _, _ in found]


def _done(m: dict, writer: str | None, batch: int | None) -> bool:
    return writer is not None and m["writers"].get(writer, -1) >= batch
