"""Token ids in Parquet list columns, written and read as Spark tables.

Documents are range-partitioned by id, encoded in id order and written with one row per document: dictionary pages for the
ids, delta-packed pages for ids of documents and offsets, row groups and pages of a chosen size, and page indexes.  Readers
that want metadata only never touch the token pages, and a filter on ``doc_id`` skips row groups and pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm.common import ragged, shared_path, small_batches, table, texts_of
from siterank.llm.ids import token_ids

FILE = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _writer(path: str, spaced: bool, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = token_ids(path, spaced), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text", 2 << 20):
            ids, n = encoder.encode(batch.column(1))
            ends = np.cumsum(n)
            ids = np.insert(ids.astype(np.int32), ends, end_id)
            n = n + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start + np.cumsum(n) - n), pa.array(n), ragged(ids, n)],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(n.sum())

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, spaced: bool = True, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
) -> None:
    """Write ``doc_id, part, part_start, n_tokens, ids`` in ascending id order; every document ends with ``end_id``.

    Files and rows ascend by id (null first); ``part_start`` counts ids before the document in its file.  Null texts are
    empty and hold the end id only.  Repeated ids are kept, ordered by their text.  An empty input writes an empty table.
    """
    plain = texts_of(docs, id_col, text_col)
    # the text's hash deals a repeated id out over several ranges
    ordered = plain.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (
        ordered.mapInArrow(_writer(tokenizer_path, spaced, end_id), FILE).write
        .option("compression", "zstd").option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#part_start", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` with ``start`` counted over all documents; reads no token page."""
    return _started(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; filter on ``doc_id`` to read only the pages of those documents."""
    return _started(spark, path).select("doc_id", "start", "n_tokens", "ids")


def _started(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(FILE).parquet(path)
    # one row for each file; taken from the metadata columns
    parts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens"))).collect())
    before = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, accumulate((n for _, n in parts), initial=0))], "part int, before long")
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        raw = memoryview(lists.values.to_numpy(zero_copy_only=True)).cast("B")
        at = lists.offsets.to_numpy() * 4
        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crcs, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """Replace the last column, ``ids``, by the unsigned crc32 of its little-endian 32-bit values."""
    kinds = ", ".join(f"{c} {t}" for c, t in tokens.dtypes if c != "ids")
    return tokens.select(*[c for c in tokens.columns if c != "ids"], "ids").mapInArrow(_digest, f"{kinds}, ids_crc32 long")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-file")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_crc32(read_tokens(spark, path))
