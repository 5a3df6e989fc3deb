"""Best-fit packing of documents into fixed-length sequences by large-item matching.

The plan needs only the number of pieces of each length, so it is made once for all data: pieces above a third of the
capacity, of which at most two fit a sequence, are matched greedily (the longest with the longest that still fits); smaller
ones fill the tightest gaps, longest first.  The plan is a list of runs over the ranks of equal-length pieces; ranks are
found in parallel, and every piece looks its place up.  No text or id is shuffled.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siterank.llm.common import ragged, small_batches, stage, table, texts_of
from siterank.llm.ids import token_ids

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, first sequence, pieces in a sequence, offset)`` that place all pieces.

    The piece of rank ``first rank + j`` goes to sequence ``first sequence + j // pieces`` at ``offset + (j % pieces) *
    length``.  Gaps are held as ranges of sequences with equal gaps, so the work depends on the lengths in use, not on the
    number of pieces: a length meets each gap class once, which gives fewer than ``capacity ** 2 / 4`` runs for any data.
    """
    left, rank, runs, bins = {s: n for s, n in counts.items() if n}, dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def free(gap: int, lo: int, hi: int) -> None:
        if gap and hi > lo:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((lo, hi))

    def place(s: int, first: int, n: int, each: int, offset: int) -> None:
        runs.append((s, rank[s], first, each, offset))
        rank[s] += n
        left[s] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        at = bisect_left(large, capacity - s + 1) - 1
        while left[s]:
            while at >= 0 and not left[large[at]]:
                at -= 1
            t = large[at] if at >= 0 else 0
            if t == s and left[s] == 1:
                at -= 1
                continue
            n = left[s] if not t else left[s] // 2 if t == s else min(left[s], left[t])
            place(s, bins, n, 1, 0)
            if t:
                place(t, bins, n, 1, s)
            free(capacity - s - t, bins, bins + n)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                gap, lo, hi = capacity, bins, bins + -(-left[s] // (capacity // s))
                bins = hi
            else:
                gap = order[at]
                lo, hi = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each, n = gap // s, min(left[s], (hi - lo) * (gap // s))
            full, rest = divmod(n, each)
            place(s, lo, n, each, capacity - gap)
            free(gap - each * s, lo, lo + full)
            if rest:
                free(gap - rest * s, lo + full, lo + full + 1)
            free(gap, lo + full + bool(rest), hi)
    return runs


def _cutter(path: str, spaced: bool, end_id: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(path, spaced)
        for batch in small_batches(batches, "text", 4 << 20):
            ids, n = encoder.encode(batch.column(1))
            ids = np.insert(ids.astype("<u4"), np.cumsum(n), end_id)
            n = n + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, n[doc] - piece * capacity)
            at, raw = np.concatenate([[0], np.cumsum(length)]) * 4, memoryview(ids).cast("B")
            columns = [
                batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, ragged(ids.astype(np.int32), length)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _placer(runs: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 44) | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            _, first, sequence, each, offset = runs[np.searchsorted(keys, (length << 44) | rank, "right") - 1].T
            j = rank - first
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence + j // each), pa.array(offset + j % each * length)], names=[*kept, "sequence_id", "offset"])

    return place


def pack_documents(
    docs: DataFrame, tokenizer_path: str, spaced: bool = False, end_id: int = 1, capacity: int = 4096, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, ``with_ids``, its ``ids``.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces of ``capacity``.  Null and empty texts are one
    piece of the end id.  Equal pieces, repeated rows and null ids are placed like any others.  Sequences are filled from 0
    without gaps.  An empty input gives an empty result.
    """
    schema = PIECE + ", ids array<int>" * with_ids
    pieces = stage(texts_of(docs, id_col, text_col).mapInArrow(_cutter(tokenizer_path, spaced, end_id, capacity, with_ids), schema), "pieces")
    counts = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}  # a row for each length, at most capacity
    # n pieces of one length are ranked in about sqrt(n) groups of sqrt(n); a row for each length
    deal = docs.sparkSession.createDataFrame([(s, math.isqrt(n) + 1) for s, n in counts.items()], "length long, deal int")
    salted = pieces.join(F.broadcast(deal), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("deal"))).drop("deal")
    before = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    )
    # equal rows are interchangeable, so a rank found again after a lost task places the same pieces
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    runs = np.array(sorted(plan_runs(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    kept = [c.split()[0] for c in schema.split(", ")]
    return ranked.select(*kept, "rank").mapInArrow(_placer(runs), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets`` of pieces packed ``with_ids``: at most ``capacity`` ids in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
