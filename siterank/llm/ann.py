"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Unit vectors are rotated at random and stored in blocks of columns, grouped into lists by the nearest of k-means centres that
a bounded sample gave.  For a query, the lists of its nearest centres are scanned block of columns by block: a partial
distance over d of D rotated dimensions estimates the whole one, and a candidate is abandoned once the test says that it is
beyond the query's fifth nearest so far.  What survives is scored exactly in double precision on the original vectors.  The
number of lists to probe is fitted on the sample so that its recall against brute force reaches a target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siterank.llm.common import stage, table

#: Vectors of the sample that centres and probes are fitted on, by the hash of their id; those that give first thresholds.
FIT, SEEDS = 32_768, 4096
#: Vectors of a list on average, lists at most (larger tables get longer lists, cut into pieces), columns of a block.
LISTED, LISTS, COLUMNS = 500, 1024, 16
#: Vectors and queries that one task compares at once.
PIECE, QUERIES = 4096, 1024
#: Width of the test: larger values abandon later.
EPSILON = 2.1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True)


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; equal rows give equal values wherever they stand."""
    return (v * q).sum(1) / np.sqrt((v * v).sum(1) * (q * q).sum(1))


class Fitted:
    """Rotation, centres, probes and seeds of an index."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, total: int, k: int, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0].astype(np.float32)
        x = (unit(sample) @ self.rotation).astype(np.float32)
        lists = max(1, min(LISTS, total // LISTED, len(x) // 30))
        centres = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(10):
            own = (x @ centres.T).argmax(1)
            sums = np.stack([np.bincount(own, x[:, j], lists) for j in range(self.dim)], 1)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres).astype(np.float32)
        # one seed for each id, so that k seeds of a query's lists stand for k others
        one = np.sort(np.unique(ids, return_index=True)[1])[:SEEDS]
        self.centres, self.seeds, self.seed_ids, self.seed_lists = centres, x[one], ids[one], (x[one] @ centres.T).argmax(1)
        # probes: as few as find enough of the sample's own nearest
        own, some = (x @ centres.T).argmax(1), np.arange(min(400, len(x)))
        near = x[some] @ x.T
        near[some, some] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
        order = np.argsort(-(x[some] @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(lists)[None, :], 1)
        reached = np.bincount(np.take_along_axis(place, own[best], 1).ravel(), minlength=lists).cumsum() / max(1, best.size)
        self.probes = int(np.searchsorted(reached, recall) + 1) if best.size else lists
        self.probes = min(self.probes, lists)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (unit(x) @ self.rotation).astype(np.float32)

    def threshold(self, ids: np.ndarray, q: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """Squared distance within which the probed ``lists`` surely hold k others: that of the k nearest seeds of these lists
        with another id than the query."""
        if len(self.seeds) <= k:
            return np.full(len(q), 4.0, np.float32)
        probed = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(probed, lists, True, 1)
        like = np.where(probed[:, self.seed_lists] & (self.seed_ids != ids[:, None]), q @ self.seeds.T, np.float32(-1))
        return 2 + 2 * np.partition(-like, k - 1, axis=1)[:, k - 1]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of ``keys``."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return new


def scan(blocks: list[np.ndarray], ids: np.ndarray, queries: np.ndarray, asked: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of candidates that no test abandoned and that may belong to the k nearest other ids of these rows.

    ``blocks``: column blocks of unit rows of ``ids``; ``asked``: ids of the queries; ``limit``: squared distance beyond which a
    query needs no row.
    """
    dim, n = queries.shape[1], len(blocks[0])
    first = blocks[0].shape[1]
    squared = lambda b, q: (b * b).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (b @ q.T)
    # copies of a query are at distance 0 but for rounding
    limit = np.maximum(limit, 0) + 1e-4
    part = squared(blocks[0], queries[:, :first])
    rows, cols = np.nonzero(part * (dim / first) <= limit[None, :] * (1 + EPSILON / math.sqrt(first)) ** 2)
    dist, done = part[rows, cols], first
    for b in blocks[1:]:
        width = b.shape[1]
        if 4 * len(rows) > n * len(queries):
            dist = dist + squared(b, queries[:, done : done + width])[rows, cols]
        else:
            gap = b[rows] - queries[cols, done : done + width]
            dist = dist + np.einsum("ij,ij->i", gap, gap)
        done += width
        kept = dist * (dim / done) <= limit[cols] * (1 + EPSILON / math.sqrt(done)) ** 2 if done < dim else dist <= limit[cols]
        rows, cols, dist = rows[kept], cols[kept], dist[kept]
    other = ids[rows] != asked[cols]
    rows, cols, dist = rows[other], cols[other], dist[other]
    if not len(cols):
        return rows, cols
    # the k nearest ids of each query here, each by its nearest row, and what is as near within rounding
    order = np.lexsort((dist, ids[rows], cols))
    rows, cols, dist = rows[order], cols[order], dist[order]
    new = firsts(cols, ids[rows])
    best, of = dist[new], cols[new]
    order = np.lexsort((best, of))
    best, of = best[order], of[order]
    starts, ends = (np.searchsorted(of, np.arange(len(queries)), side) for side in ("left", "right"))
    kth = best[np.minimum(np.minimum(starts + k, np.maximum(ends, 1)) - 1, len(best) - 1)]
    near = dist <= kth[cols] + 1e-4
    return rows[near], cols[near]


def _assigner(fitted: Fitted):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, PIECE) for i in range(0, batch.num_rows, PIECE)):
                x = fitted.rotate(matrix(part.column(1), fitted.dim))
                own = (x @ fitted.centres.T).argmax(1)
                cut = [x[:, i : i + COLUMNS] for i in range(0, fitted.dim, COLUMNS)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * c.shape[1]), pa.array(np.ascontiguousarray(c).ravel())) for c in cut]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32)), *lists], names=["vec_id", "embedding", "list", *(f"b{i}" for i in range(len(cut)))])

    return assign


def _prober(fitted: Fitted, k: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                q = fitted.rotate(matrix(part.column(1), fitted.dim))
                lists = np.argsort(-(q @ fitted.centres.T), axis=1)[:, : fitted.probes]
                at = pa.array(np.repeat(np.arange(len(q)), fitted.probes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(lists.ravel().astype(np.int32)), pa.array(fitted.threshold(part.column(0).to_numpy(), q, lists, k)).take(at)], names=["query_id", "query", "list", "threshold"])

    return probe


def _searcher(fitted: Fitted, k: int):
    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not asked.num_rows:
            return empty
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        flat = lambda t, c: pa.concat_arrays(t.column(c).chunks)
        query, ids, names = matrix(flat(asked, "query"), fitted.dim), rows.column("vec_id").to_numpy(), [c for c in rows.column_names if c[0] == "b" and c[1:].isdigit()]
        blocks = [flat(rows, c).flatten().to_numpy().reshape(rows.num_rows, -1) for c in sorted(names, key=lambda c: int(c[1:]))]
        qid = asked.column("query_id").to_numpy()
        r, c = scan(blocks, ids, fitted.rotate(query), qid, asked.column("threshold").to_numpy(), k)
        given = matrix(flat(rows, "embedding"), fitted.dim)
        score = np.concatenate([cosines(given[r[i : i + 100_000]], query[c[i : i + 100_000]]) for i in range(0, len(r), 100_000)]) if len(r) else np.zeros(0)
        # an id counts once for a query, by its best row
        order = np.lexsort((-score, ids[r], c))
        order = order[firsts(c[order], ids[r[order]])] if len(order) else order
        order = order[np.lexsort((ids[r[order]], -score[order], c[order]))]
        r, c, score = r[order], c[order], score[order]
        place = np.arange(len(c)) - np.searchsorted(c, c)
        top = place < k
        return pa.table({"query_id": pa.array(qid[c[top]]), "vec_id": pa.array(ids[r[top]]), "score": pa.array(score[top])})

    return search


def nearest(vectors: DataFrame, queries, k: int = 5, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest others by cosine, ties to the smaller id, of rows that ``queries`` holds for.

    ``queries`` is a condition on ``vec_id``.  Vectors that are null, zero or hold null or non-finite components, rows without
    id, and vectors of another length than the commonest take no part.  Rows of a query's own id are no candidates; other
    copies of its vector are.  Repeated rows (same id and vector) are one row; an id with several vectors is one candidate and
    one query, by the best score of any of them.  All lists are probed while there are few vectors.  No vector gives an empty result.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    valid = given.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    common = valid.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = stage(valid.filter(F.size("embedding") == common["dim"]).dropDuplicates(["vec_id", "embedding"]), "distinct-vectors")
    got = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).select("vec_id", "embedding").toArrow().combine_chunks()
    fitted = Fitted(got.column(0).to_numpy(), matrix(pa.concat_arrays(got.column(1).chunks), common["dim"]), valid.count(), k, recall)
    kind = dict(valid.dtypes)["embedding"]
    names = [f"b{i}" for i in range(-(-fitted.dim // COLUMNS))]
    index = stage(valid.mapInArrow(_assigner(fitted), f"vec_id long, embedding {kind}, list int, " + ", ".join(f"{b} array<float>" for b in names)), "vectors")
    asked = stage(index.filter(queries).select("vec_id", "embedding").mapInArrow(_prober(fitted, k), f"query_id long, query {kind}, list int, threshold float"), "probes")
    # LISTS rows at most
    held = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    wanted = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
    plan = F.broadcast(held.join(wanted, "list"))
    rows = index.join(plan, "list").withColumns({"piece": F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"), "turn": F.explode(F.sequence(F.lit(0), F.col("turns") - 1))})
    sent = asked.join(plan, "list").withColumns({"turn": F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"), "piece": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))})
    keys = ["list", "piece", "turn"]
    found = (
        rows.select(*keys, "vec_id", "embedding", *names).groupBy(*keys)
        .cogroup(sent.select(*keys, "query_id", "query", "threshold").groupBy(*keys))
        .applyInArrow(_searcher(fitted, k), "query_id long, vec_id long, score double")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
