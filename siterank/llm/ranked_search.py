"""Ranked lexical search by pipelined term partitioning.

Documents are inverted block by block: a block's documents are numbered in id order and each term holds the numbers, term
frequencies and sizes of its documents there.  Terms belong to owners by their weight, rarest first.  Items travel in
bundles: for every block, a bundle carries sparse accumulators (item, document, score) from owner to owner; each stage joins
them with that owner's postings by cogroup and adds integer contributions.  Between stages an accumulator is left behind only
if what the item's other owners can add at most does not lift it to the item's tenth score in this very block, so results
are exact.  The last stage's ten per block and item are then ranked together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siterank.llm.common import ragged, small_batches, stage, table, texts_of

#: Terms: runs of letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Owners of terms: the first for weights from 6000 on, and so on.
OWNERS = (6000, 4000, 2000, 0)
#: An impact is below this, whatever the term frequency.
MOST_IMPACT = 1_000_000
#: Slots of the filter that keeps terms of no item out of the postings: 2 MB for any number of items.
SLOTS = 1 << 24
BLOCK_BYTES, BLOCK_ROWS, BUNDLE = 4 << 20, 4096, 128

POSTINGS = "block long, term string, docs array<int>, tfs array<int>, sizes array<int>, doc_ids array<long>, n_docs long, n_terms long"
HELD = "bundle int, block long, items array<int>, docs array<int>, scores array<long>"


def _bytes_of_terms() -> bytes:
    inner = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in inner else 0x20 for b in range(256))


FOLD = _bytes_of_terms()


def split_terms(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts in order and the number of each text's terms."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(FOLD)
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
    split = pc.ascii_split_whitespace(folded)
    flat, each = pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    total = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False).astype(np.int64))])
    ends = np.cumsum(each)
    return flat.filter(real), total[ends] - total[ends - each]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", BLOCK_BYTES):
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(lo, BLOCK_ROWS)


def _inverter(slots: bytes):
    schema = pa.schema([
        ("block", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(slots, np.uint8), bitorder="little").astype(bool)
        block = TaskContext.get().partitionId() << 32
        for batch in _blocks(batches):
            # numbers follow ids, null last, so that equal scores are ordered by number
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_end"))
            flat, n = split_terms(batch.column(1))
            coded = flat.dictionary_encode()
            terms = coded.dictionary
            kept = wanted[np.array([zlib.crc32(t) & (SLOTS - 1) for t in terms.cast(pa.binary()).to_pylist()], np.int64)]
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            some = kept[codes]
            key, tf = np.unique(codes[some] * len(n) + doc[some], return_counts=True)
            code, doc = key // max(len(n), 1), key % max(len(n), 1)
            first = np.flatnonzero(np.diff(code, prepend=-1))
            each = np.diff(np.append(first, len(code)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), block)), terms.take(pa.array(code[first])), ragged(doc.astype(np.int32), each), ragged(tf.astype(np.int32), each),
                    ragged(n[doc].astype(np.int32), each), *(pa.nulls(len(first), t) for t in (pa.list_(pa.int64()), pa.int64(), pa.int64())),
                ],
                schema=schema,
            )
            one = {f.name: pa.nulls(1, f.type) for f in schema} | {
                "block": pa.array([block]), "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                "n_docs": pa.array([int((n > 0).sum())]), "n_terms": pa.array([int(n.sum())]),
            }
            yield pa.RecordBatch.from_arrays([one[f.name] for f in schema], schema=schema)
            block += 1

    return invert


def _owner(n_docs: int, n_terms: int, top: int, last: bool):
    """One stage: add the owner's contributions to a bundle's accumulators for one block."""

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        held = column.combine_chunks()
        return held.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def visit(key, held: pa.Table, postings: pa.Table) -> pa.Table:
        bundle, block = (k.as_py() for k in key)
        items, docs, scores = (lists(held[c])[0] for c in ("items", "docs", "scores"))
        all_docs, at = lists(postings["docs"])
        tfs, sizes = (lists(postings[c])[0].astype(np.int64) for c in ("tfs", "sizes"))
        held_by, by = lists(postings["of_items"])
        times, rest = lists(postings["times"])[0].astype(np.int64), lists(postings["rest"])[0]
        width = max([int(x.max()) + 1 for x in (docs, all_docs) if len(x)], default=0)
        height = max([int(x.max()) + 1 for x in (items, held_by) if len(x)], default=0)
        sums = np.zeros((height, width), np.int64)
        sums[items, docs] = scores
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * (25 + (75 * sizes * n_docs) // n_terms))
        weights = postings["weight"].to_numpy()
        for i in range(len(weights)):
            a, b, c, d = at[i], at[i + 1], by[i], by[i + 1]
            sums[np.ix_(held_by[c:d], all_docs[a:b])] += times[c:d, None] * (weights[i] * impact[a:b])
        # of items that this owner has no term of here, everything is kept
        left = np.full(height, np.iinfo(np.int64).max // (4 * MOST_IMPACT), np.int64)
        left[held_by] = rest
        if last:
            left[:] = 0
        tenth = np.partition(sums, -top, axis=1)[:, -top] if width > top else np.zeros(height, np.int64)
        items, docs = np.nonzero((sums > 0) & (sums + left[:, None] * MOST_IMPACT >= tenth[:, None]))
        scores = sums[items, docs]
        if last:
            # equal scores: those of the smallest ids
            order = np.lexsort((docs, -scores, items))
            items, docs, scores = items[order], docs[order], scores[order]
            first = np.searchsorted(items, items)
            keep = np.arange(len(items)) - first < top
            items, docs, scores = items[keep], docs[keep], scores[keep]
        n = [len(items)]
        return pa.table({"bundle": pa.array([bundle], pa.int32()), "block": [block], "items": ragged(items.astype(np.int32), n), "docs": ragged(docs.astype(np.int32), n), "scores": ragged(scores, n)})

    return visit


def _items_of(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items in bundles, ``bundle, item, item_id``, and their terms, ``bundle, item, term, repeats``."""
    plain = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    plain = stage(plain, "items")
    bundles = -(-max(plain.count(), 1) // BUNDLE)
    dealt = plain.withColumn("bundle", F.pmod(F.xxhash64("item_id", "text"), F.lit(bundles)).cast("int"))
    dealt = stage(dealt.withColumn("item", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id", "text")) - 1), "bundles")
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    terms = dealt.select("bundle", "item", F.explode(words).alias("term")).groupBy("bundle", "item", "term").agg(F.count(F.lit(1)).alias("repeats"))
    return dealt.select("bundle", "item", "item_id"), stage(terms, "item-terms")


def _slots(terms: DataFrame) -> bytes:
    """Which slots hold a term of any item: at most 512 rows of 4 kB."""
    slot = F.crc32("term").bitwiseAND(SLOTS - 1)
    held = terms.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("at")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits")).collect()
    out = bytearray(SLOTS // 8)
    for r in held:
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = r["bits"]
    return bytes(out)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0, equal scores by ascending id.

    A document is a row: repeated rows and ids are ranked each (ranks stay unique), null ids come last among equal scores.
    Null and empty texts have no terms; texts may be of any length.  Equal rows of ``items`` are one item; rows of one
    ``item_id`` with different texts are ranked each for themselves under that id.  Other columns are not read, whatever
    their names.  An empty input on either side gives an empty result.
    """
    spark = docs.sparkSession
    bundled, terms = _items_of(items, item_col, item_text_col)
    postings = stage(texts_of(docs, id_col, text_col).mapInArrow(_inverter(_slots(terms)), POSTINGS), "postings")
    n_docs, n_terms, n_blocks = postings.filter("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count(F.lit(1))).first()
    df = postings.filter("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    owner = sum((F.col("weight") < cut).cast("int") for cut in OWNERS[:-1])
    weighted = terms.join(df, "term").withColumn("weight", weight).withColumn("owner", owner)
    worth, item = F.col("repeats") * F.col("weight"), Window.partitionBy("bundle", "item")
    rest = F.sum(worth).over(item) - F.sum(worth).over(item.orderBy("owner"))
    asked = weighted.withColumn("rest", rest).groupBy("owner", "bundle", "term", "weight").agg(F.collect_list(F.struct("item", "repeats", "rest")).alias("x"))
    # a frequent term stands in every block: its blocks are dealt over salts
    salts = n_blocks // 512 + 1
    asked = asked.select("owner", "bundle", "term", "weight", F.col("x.item").alias("of_items"), F.col("x.repeats").alias("times"), F.col("x.rest").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = stage(asked, "asked")
    listed = postings.filter("term is not null").select("block", "term", "docs", "tfs", "sizes", F.pmod(F.hash("block"), F.lit(salts)).alias("salt"))
    held = spark.createDataFrame([], HELD)
    for k in range(len(OWNERS)):
        here = listed.join(asked.filter(F.col("owner") == k).drop("owner"), ["term", "salt"]).select(
            F.col("bundle").alias("at_bundle"), F.col("block").alias("at_block"), F.col("docs").alias("docs"), "tfs", "sizes", "weight", "of_items", "times", "rest")
        held = held.groupBy("bundle", "block").cogroup(here.groupBy("at_bundle", "at_block")).applyInArrow(_owner(n_docs, n_terms, top, k == len(OWNERS) - 1), HELD)
    found = held.select("bundle", "block", F.explode(F.arrays_zip("items", "docs", "scores")).alias("x")).select("bundle", "block", F.col("x.items").alias("item"), F.col("x.docs").alias("doc"), F.col("x.scores").alias("score"))
    of_item = Window.partitionBy("bundle", "item").orderBy(F.desc("score"))
    best = found.withColumn("place", F.rank().over(of_item)).filter(F.col("place") <= top).drop("place")
    named = best.join(postings.filter("term is null").select("block", "doc_ids"), "block").withColumn("doc_id", F.get("doc_ids", F.col("doc"))).drop("doc_ids")
    rank = F.row_number().over(of_item.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return named.withColumn("rank", rank).filter(F.col("rank") <= top).join(bundled, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
x AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
