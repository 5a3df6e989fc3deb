"""Shared helpers: staged tables in the cluster's folder, clean inputs and text rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.session import ensure_checkpoint_dir

#: White space of the contracts, as a Java and Python character class.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor."""
    path = path or shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), so extra columns never clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_crc_mod(column: str, modulus: int) -> Column:
    """Remainder of the crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string")) % modulus


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``most_bytes`` of one column: memory follows the text, not the row count."""
    for batch in batches:
        sizes = [0 if x is None else x for x in pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()]
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def released(work):
    """``work`` over batches, giving the worker's free memory back to the system when its task ends: workers live on."""

    def run(batches):
        import ctypes
        import gc

        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def ragged(values, lengths) -> pa.ListArray:
    """A list array from flat numpy values and the length of each list."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
