"""Sequences of one document each: documents are cut at powers of two, and pieces of equal length share a bucket.

A document of ``n`` ids gives ``n // capacity`` whole pieces and one for each bit of the rest, longest first.  Every piece is a
sequence of its own, a power of two long, so that nothing is padded and no sequence crosses documents.  Sequences are numbered
bucket by bucket without gaps, from counts of pieces by file part and length, which are joined to the pieces.  ``batches`` groups sequences of one bucket into batches of equally many tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siterank.llm.common import ragged, small_batches, stage, table, texts_of
from siterank.llm.ids import token_ids

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def decompose(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length)`` of all pieces of documents of ``n`` ids; ``capacity`` is a power of two."""
    lengths = capacity >> np.arange(capacity.bit_length())
    times = (n[:, None] // lengths) & 1
    times[:, 0] = n // capacity
    each = times.sum(1)
    length = np.repeat(np.tile(lengths, len(n)), times.ravel())
    before = np.cumsum(length) - length
    return np.repeat(np.arange(len(n)), each), before - np.repeat(np.cumsum(n) - n, each), length


def running(values: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Of each value, how often it came before; ``seen`` carries the counts from call to call."""
    order = np.argsort(values, kind="stable")
    distinct, first, times = np.unique(values[order], return_index=True, return_counts=True)
    at = np.arange(len(values)) - np.repeat(first, times) + np.repeat([seen.get(v, 0) for v in distinct.tolist()], times).astype(np.int64)
    for v, t in zip(distinct.tolist(), times.tolist()):
        seen[v] = seen.get(v, 0) + t
    out = np.empty(len(values), np.int64)
    out[order] = at
    return out


def _cutter(path: str, spaced: bool, end_id: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = token_ids(path, spaced), TaskContext.get().partitionId(), {}
        for batch in small_batches(batches, "text", 4 << 20):
            ids, n = encoder.encode(batch.column(1))
            ids = np.insert(ids.astype("<u4"), np.cumsum(n), end_id)
            doc, start, length = decompose(n + 1, capacity)
            at, raw = np.concatenate([[0], np.cumsum(length)]) * 4, memoryview(ids).cast("B")
            columns = [
                batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()), pa.array((n + 1)[doc]),
                pa.array(np.full(len(doc), part, np.int32)), pa.array(running(length, seen)),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "own"]
            if with_ids:
                columns, names = [*columns, ragged(ids.astype(np.int32), length)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def bucket_documents(
    docs: DataFrame, tokenizer_path: str, spaced: bool = True, end_id: int = 0, capacity: int = 1024, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, number`` and, ``with_ids``, its ``ids``.

    A document is its ids and ``end_id``; ``capacity`` is a power of two.  ``number`` counts sequences within a length from 0,
    ``sequence_id`` all sequences, longest first; ``offset`` is 0.  Null and empty texts are one sequence of the end id.
    Repeated rows and null ids are cut like any others, texts of any length into whole pieces and the bits of the rest.
    Other columns are not read, whatever their names.  An empty input gives an empty result.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = PIECE + ", part int, own long" + ", ids array<int>" * with_ids
    pieces = stage(texts_of(docs, id_col, text_col).mapInArrow(_cutter(tokenizer_path, spaced, end_id, capacity, with_ids), schema), "bucket-pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # log2(capacity) + 1 rows for each file part
    totals = counts.groupBy("length").agg(F.sum("n").alias("all"))  # log2(capacity) + 1 rows
    base = totals.withColumn("base", F.sum("all").over(Window.orderBy(F.desc("length"))) - F.col("all")).select("length", "base")
    before = (
        counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
        .join(F.broadcast(base), "length").select("length", "part", "before", "base")
    )
    number = F.col("before") + F.col("own")
    return pieces.join(before, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), number.alias("number"),
        *["ids"] * with_ids,
    )


def batches(bucketed: DataFrame, batch_tokens: int = 1 << 17) -> DataFrame:
    """``length, batch, n_sequences, ids`` of pieces bucketed ``with_ids``: ``batch_tokens`` tokens, or fewer in a bucket's last one.

    A batch holds sequences of one length only, as a list of lists; batches of a length are numbered from 0.
    """
    each = F.greatest(F.lit(1), F.expr(f"{batch_tokens} div length"))
    dealt = bucketed.withColumn("batch", F.floor(F.col("number") / each))
    rows = F.array_sort(F.collect_list(F.struct("number", "ids")))
    return dealt.groupBy("length", "batch").agg(rows.alias("rows")).select("length", "batch", F.size("rows").alias("n_sequences"), F.col("rows.ids").alias("ids"))


def op13_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bucket_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("number")
