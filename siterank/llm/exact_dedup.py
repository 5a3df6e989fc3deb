"""Exact deduplication with an extendible-hash index on shared files.

Every task turns its documents into index entries: one per distinct normalised text, holding the 64-bit hash, the text and
the ids of its copies.  Entries are written to the shared folder; their hashes and sizes alone give the directory, which
doubles until no bucket is larger than ``bucket_bytes`` (or the deepest level is reached).  Owner tasks then take one bucket
each, chain entries of equal hash and compare their bytes.  A bucket that doubling cannot split (one text with very many
entries) is an overflow chain: it is merged with map-side combining, so no task ever holds it whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siterank.llm.common import BLANK, discard, released, shared_path, small_batches, stage, table, texts_of

ENTRY = "hash long, sha string, text string, bytes long, ids array<long>"
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
MOST_DEPTH = 20


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct text of a run of rows."""
    for batch in small_batches(batches, "text", 8 << 20):
        copies: dict[str, list] = {}
        hashes: dict[str, int] = {}
        for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash", "text"))):
            copies.setdefault(t, []).append(i)
            hashes[t] = h
        texts = list(copies)
        raw = [t.encode() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashes[t] for t in texts], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                pa.array(texts), pa.array([len(r) + 64 for r in raw], pa.int64()), pa.array(list(copies.values()), pa.list_(pa.int64())),
            ],
            names=["hash", "sha", "text", "bytes", "ids"],
        )


def directory(sizes: dict[int, int], depth: int, bucket_bytes: int) -> tuple[list[int], set[int]]:
    """Bucket of every hash prefix of ``depth`` bits, and the buckets that stay overfull.

    A bucket is split in two, doubling the directory where its own depth is the global one, while it holds more than
    ``bucket_bytes``; a bucket at the full depth that is still too large is an overflow chain.
    """
    slots, overfull, buckets = [0] * (1 << depth), set(), 0
    totals = [[0] * (1 << d) for d in range(depth + 1)]
    for prefix, n in sizes.items():
        for d in range(depth + 1):
            totals[d][prefix >> (depth - d)] += n
    todo = [(0, 0)]
    while todo:
        d, prefix = todo.pop()
        if totals[d][prefix] > bucket_bytes and d < depth:
            todo += [(d + 1, 2 * prefix + 1), (d + 1, 2 * prefix)]
            continue
        width = depth - d
        slots[prefix << width : (prefix + 1) << width] = [buckets] * (1 << width)
        if totals[d][prefix] > bucket_bytes:
            overfull.add(buckets)
        buckets += 1
    return slots, overfull


def _rank(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def _own(bucket: pa.Table) -> pa.Table:
    """Chain the entries of equal hash, compare bytes and answer for every document of the bucket."""
    chains: dict[int, list[list]] = {}
    ids, texts, shas = (bucket.column(c).to_pylist() for c in ("ids", "text", "sha"))
    for k, h in enumerate(bucket.column("hash").to_pylist()):
        chain = chains.setdefault(h, [])
        for link in chain:
            if texts[link[0]] == texts[k]:
                link.append(k)
                break
        else:
            chain.append([k])
    out: list[list] = [[], [], [], [], []]
    for chain in chains.values():
        for link in chain:
            keep = min((min(ids[k], key=_rank) for k in link), key=_rank)
            size, free = sum(len(ids[k]) for k in link), True
            for k in link:
                for i in ids[k]:
                    kept = free and i == keep
                    free = free and not kept
                    for column, v in zip(out, (i, keep, size, kept, shas[k])):
                        column.append(v)
    return pa.table({n: pa.array(v, t) for n, t, v in zip(("doc_id", "keep_id", "group_size", "kept", "text_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), out)})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after every run of ASCII white space became one space; null counts as empty.  The
    row with the smallest id of a group is kept; of repeated rows with that very id just one.  Null ids come last and are
    kept only in a group without any other id.  An empty input gives an empty result.
    """
    plain = texts_of(docs, id_col, text_col).withColumn("text", F.regexp_replace("text", BLANK, " "))
    spark = docs.sparkSession
    path = shared_path(spark, "hash-index")
    index = stage(plain.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(released(_entries), ENTRY), "hash-index", path)
    total = index.agg(F.sum("bytes")).first()[0] or 0
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(total / bucket_bytes)) + 2) if total > bucket_bytes else 0)
    prefix = F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)
    # at most 2 ** MOST_DEPTH rows reach the driver
    sizes = {r.prefix: r.bytes for r in index.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes")).collect()}
    slots, overfull = directory(sizes, depth, bucket_bytes)
    pages = spark.createDataFrame([(p, b, b in overfull) for p, b in enumerate(slots)], "prefix int, bucket int, chained boolean")
    # the directory has a slot for each bucket_bytes of text, 2 ** MOST_DEPTH at most
    placed = index.withColumn("prefix", prefix).join(F.broadcast(pages), "prefix")
    owned = placed.filter(~F.col("chained")).groupBy("bucket").applyInArrow(_own, RESULT)
    answer = stage(owned.unionByName(_overflow(placed.filter("chained"))) if overfull else owned, "hash-answers")
    discard(spark, path)
    return answer


def _overflow(entries: DataFrame) -> DataFrame:
    """Overflow chains: equal texts meet by map-side combining; every entry then learns its group's answer."""
    last = F.struct(F.col("id").isNull(), F.col("id"))
    merged = (
        entries.withColumn("id", F.array_min("ids")).groupBy("hash", "text")
        .agg(F.min(last).getField("id").alias("keep_id"), F.sum(F.size("ids").cast("long")).alias("group_size"), F.first("sha").alias("text_sha256"))
        .select("hash", "text_sha256", "keep_id", "group_size")
    )
    rows = (
        entries.select("hash", F.col("sha").alias("text_sha256"), F.explode("ids").alias("doc_id"))
        .join(merged, ["hash", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", "text_sha256")
    )
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # of repeated rows with the kept id, the first of its own small window stays
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id"))
    heads = rows.filter(same).withColumn("kept", first == 1)
    return rows.filter(~same).withColumn("kept", F.lit(False)).unionByName(heads).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


#: Equal texts by SQL.
OP7_SQL = r"""with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n"""
