"""MinHash near-deduplication with bottom-k sketches of one hash function.

A text's sketch is the k smallest hashes of its word shingles.  Two texts at the wanted similarity share most of their
sketches, so each needs to enter only the inverted lists of its rarest shared values (a prefix that the least overlap fixes);
values that are common or unique drop out.  Texts that meet in lists form clusters.  Within a cluster, lists give overlaps,
the sketch of the union filters, and the exact Jaccard similarity of the full sets decides; only links that join what isn't
joined yet are looked for, which gives the same groups.  Clusters of any size are cut into blocks that share a few pivots, and
what stays outside the largest group of its cluster is then compared with the whole cluster, block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siterank.llm.common import released, small_batches, stage, table, texts_of
from siterank.operators.components import connected_components
from siterank.operators.skew import salted_join

#: Documents of a cluster that one task compares with each other, and pivots that all blocks of a cluster share.
BLOCK, PIVOTS = 1024, 64
#: Standard deviations of a sketch overlap below its mean that still count.
DEVIATIONS = 5.7
SKETCH = "doc_id long, hash long, key binary, n int, sketch binary"


class WordHashes(dict):
    """64-bit hashes of words, kept in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case; bytes split at just the six ASCII white-space characters."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(w) - size + 1)
    h = np.full(runs, min(len(w), size), np.uint64)
    for i in range(min(len(w), size)):
        h = (h ^ w[i : i + runs]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def least_overlap(k: int, percent: int) -> int:
    """Shared values that two sketches of k values have almost surely at the wanted similarity."""
    j = percent / 100
    return max(1, math.floor(k * j - DEVIATIONS * math.sqrt(k * j * (1 - j))))


def _sketches(size: int, k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches):
            keys, n, rows = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = shingle_hashes(words, size, hashes)
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                n.append(len(found))
                rows.append(found[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys), pa.array(n, pa.int32()), pa.array(rows)], names=["doc_id", "hash", "key", "n", "sketch"])

    return released(sketch)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            rows = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            held = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(held), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], names=["node", "value"])


def _sets(size: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches):
            rows = [shingle_hashes(words_of(t), size, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows)], names=["node", "cluster", "hashes"])

    return released(full)


def overlaps(sketches: list[np.ndarray]) -> np.ndarray:
    """Number of values that each two sketches share, from the inverted lists of values held at least twice."""
    n = len(sketches)
    rows, out = np.repeat(np.arange(n), [len(s) for s in sketches]), np.zeros((n, n), np.float32)
    _, value, count = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    ok = count[value] > 1
    rows, value = rows[ok], number[value[ok]]
    for begin in range(0, int((count > 1).sum()), 4096):
        part = (value >= begin) & (value < begin + 4096)
        m = np.zeros((n, min(4096, int((count > 1).sum()) - begin)), np.float32)
        m[rows[part], value[part] - begin] = 1
        out += m @ m.T
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of ``b`` that ``a`` holds; both ascend without repeats."""
    return b[a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b]


def spanning_links(ids: list, sets: list[np.ndarray], comps: list, searched: np.ndarray, k: int, percent: int) -> list[tuple]:
    """Links that join documents of different ``comps``, one of each two ``searched``: enough of them to join all that is linked."""
    n = np.array([len(s) for s in sets])
    least = np.where(n <= k * percent / 100, np.ceil(n * percent / 100), least_overlap(k, percent))
    sketches = [s[:k] for s in sets]
    shared = overlaps(sketches)
    ok = (shared >= np.minimum(least[:, None], least[None, :])) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    a, b = np.nonzero(np.triu(ok & (searched[:, None] | searched[None, :]), 1))
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    slack, out = DEVIATIONS * math.sqrt(percent / 100 * (1 - percent / 100) / k), []
    for i in np.argsort(-shared[a, b], kind="stable"):
        p, q = int(a[i]), int(b[i])
        x, y = root(comps[p]), root(comps[q])
        if x == y:
            continue
        if max(n[p], n[q]) > k:
            union = np.union1d(sketches[p], sketches[q])[:k]
            both = common(sketches[p], sketches[q])
            if (both <= union[-1]).sum() / len(union) < percent / 100 - slack:
                continue
        inter = len(common(sets[p], sets[q]))
        if 100 * inter >= percent * (n[p] + n[q] - inter):
            parent[y] = x
            out.append((ids[p], ids[q]))
    return out


def _linker(k: int, percent: int):
    def link(rows: pa.Table) -> pa.Table:
        held = rows.column("hashes").combine_chunks()
        if isinstance(held, pa.ChunkedArray):  # beyond 2 GB of sets
            held = held.cast(pa.large_binary()).combine_chunks()
        groups: dict[tuple, dict[int, tuple]] = {}
        for i, r in enumerate(zip(*(rows.column(c).to_pylist() for c in ("cluster", "block", "other", "node", "comp", "searched")))):
            groups.setdefault(r[:3], {})[r[3]] = (*r[4:], i)
        out: list[tuple] = []
        for docs in groups.values():
            if len(docs) > 1:
                ids = sorted(docs)
                comps, searched, at = zip(*(docs[i] for i in ids))
                # sets stay in the Arrow buffer
                sets = [np.frombuffer(held[i].as_buffer(), np.uint64) for i in at]
                out += spanning_links(ids, sets, list(comps), np.array(searched), k, percent)
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return link


def _linked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within each (cluster, block, other); whole small clusters share a task."""
    pack = F.when(F.col("blocks") > 1, F.xxhash64("cluster", "block", "other")).otherwise(F.pmod(F.xxhash64("cluster"), F.greatest(F.col("packs"), F.lit(1))))
    return rows.withColumn("pack", pack).groupBy("pack").applyInArrow(_linker(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, k: int = 96) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked when 100 * shared >= ``percent`` * all of their distinct shingles of ``size`` words; shorter texts
    are one shingle; null texts and texts without words link with nothing.  ``component_id`` is the smallest id reachable.
    Rows of one id are one document of the graph, whatever their texts; rows without id are their own component and kept.
    Texts may be of any length, repeated rows count once; other columns are not read, whatever their names.  An empty input
    gives an empty result.
    """
    plain = texts_of(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    rows = stage(plain.mapInArrow(_sketches(size, k), SKETCH), "sketches")
    able = rows.filter("n > 0 and doc_id is not null")
    # texts of the same words are one node, whose sketches are equal; it is read from the row of its smallest id
    first = F.min(F.struct("doc_id", "hash"))
    nodes = able.groupBy("key").agg(first.alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.select("key", "first.*", "n", "sketch", F.monotonically_increasing_id().alias("node")), "nodes")
    values = nodes.select("node", "sketch").mapInArrow(_values, "node long, value long")
    frequent = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held, least = F.least("n", F.lit(k)), F.when(F.col("n") <= k * percent / 100, F.ceil(F.col("n") * percent / 100)).otherwise(least_overlap(k, percent))
    mine = Window.partitionBy("node")
    shared = values.join(frequent, "value").withColumns({"place": F.row_number().over(mine.orderBy("df", "value")), "common": F.count(F.lit(1)).over(mine)})
    # unique values stand first in every prefix and meet nothing
    entries = stage(
        shared.join(nodes.select("node", held.alias("held"), least.alias("least")), "node")
        .filter(F.col("place") <= F.col("common") - F.col("least") + 1).select("node", "value"), "lists",
    )
    hubs = entries.groupBy("value").agg(F.min("node").alias("hub"))
    edges = entries.join(hubs, "value").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    members = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    clusters = stage(connected_components(members, edges).select(F.col("id").alias("node"), F.col("component").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"))
    wanted = clusters.join(nodes.select("node", "doc_id", "hash"), "node")
    sets = stage(plain.join(wanted, ["doc_id", "hash"]).select("node", "text", "cluster").mapInArrow(_sets(size), "node long, cluster long, hashes binary"), "sets")
    n_nodes = clusters.count()
    if sets.count() > n_nodes:  # repeated rows
        sets = stage(sets.groupBy("node", "cluster").agg(F.first("hashes").alias("hashes")), "sets")
    packs = -(-n_nodes // BLOCK)
    dealt = sets.join(sizes, "cluster").withColumns({"blocks": F.ceil(F.col("docs") / BLOCK).cast("int"), "packs": F.lit(packs)})
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("docs")) < PIVOTS)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = dealt.select(
        "cluster", "node", "hashes", "blocks", "packs", F.explode(F.when(pivot, everywhere).otherwise(F.array(block))).alias("block"),
        F.lit(0).alias("other"), F.col("node").alias("comp"), F.lit(True).alias("searched"),
    )
    links = stage(_linked(first, k, percent), "links")
    large = dealt.filter("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(stage(_linked(_outside(large, links, block, everywhere), k, percent), "links"))
    several = able.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first <> last").select("doc_id", "first")
    if not several.isEmpty():
        links = links.unionByName(_of_one_id(able, nodes, several))
    linked = connected_components(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct(), links)
    grouped = nodes.select("key", "doc_id", F.col("node").alias("id")).join(linked, "id").select("key", "doc_id", "component")
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    answer = salted_join(grouped.select("key", "component"), smallest, ["component"]).select("key", "smallest")
    answer = nodes.select("key", "doc_id").join(answer, "key", "left").select("key", F.coalesce("smallest", "doc_id").alias("component"))
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(answer, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _of_one_id(able: DataFrame, nodes: DataFrame, several: DataFrame) -> DataFrame:
    """Links of the nodes of ids that stand with ``several`` texts to the first of them."""
    pairs = salted_join(able.select("doc_id", "key"), several, ["doc_id"]).filter("key <> first").select("key", "first").distinct()
    a, b = nodes.select("key", F.col("node").alias("a")), nodes.select(F.col("key").alias("first"), F.col("node").alias("b"))
    return salted_join(pairs.join(a, "key"), b, ["first"]).select("a", "b")


def _outside(large: DataFrame, links: DataFrame, block, everywhere) -> DataFrame:
    """Rows that compare all documents outside their cluster's largest group with the cluster, in blocks of both."""
    ids = large.select(F.col("node").alias("id")).distinct()
    comps = connected_components(ids, links.join(ids.select(F.col("id").alias("a")), "a")).select(F.col("id").alias("node"), F.col("component").alias("comp"))
    placed = stage(large.join(comps, "node"), "placed")
    counted = placed.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("comp")).alias("c"))).alias("top"), F.sum("n").alias("all"))
    main = main.select("cluster", (-F.col("top.c")).alias("main"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.n")) / BLOCK)).cast("int").alias("others"))
    rows = placed.join(main, "cluster").withColumn("searched", F.col("comp") != F.col("main"))
    other = F.pmod(F.xxhash64("node"), F.col("others")).cast("int")
    keep = ["cluster", "node", "hashes", "blocks", "packs", "comp"]
    base = rows.select(*keep, "others", block.alias("block"), F.lit(False).alias("searched")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    outer = rows.filter("searched").select(*keep, "others", other.alias("other"), "searched").withColumn("block", F.explode(everywhere))
    return base.unionByName(outer)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
