"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are the hashed words and word beginnings that occur in a text.  Besides the log loss on labelled rows, training
penalises the change of score when the identity terms of a labelled sentence are swapped for others of their kind, so that
neutral mentions of a group move no score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm.common import id_crc_mod, ragged, small_batches, table, texts_of
from siterank.llm.hashed_linear import Rows, fit, sigmoid

WIDTH = 1 << 20
#: Labelled rows that training reads, picked by the hash of their id.
SAMPLE = 16_000
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
WORD = re.compile(r"\w+")
#: Terms of one kind that stand for each other in swapped sentences.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("blind", "deaf", "disabled"), ("old", "young"),
)
SWAP = {a: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, a in enumerate(kind)}


def features(words: set[str], known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Distinct hashed features of a set of words; ``known`` is a table from word to its features."""
    found: set[int] = set()
    for w in words:
        f = known.get(w)
        if f is None:
            if len(known) > 300_000:
                known.clear()
            f = known[w] = tuple(zlib.crc32(x.encode()) % WIDTH for x in (w, *(f"{w[:n]}*" for n in STEMS if len(w) >= n)))
        found.update(f)
    return np.fromiter(found, dtype=np.int64, count=len(found))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task that hold a feature, and toxic ones among them."""
    known: dict[str, tuple[int, ...]] = {}
    seen, toxic = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
    for batch in small_batches(batches):
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = features(set(WORD.findall(text.lower())), known)
            seen[ids] += 1
            toxic[ids] += y
    held = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[held]), pa.array(toxic[held])], names=["feature", "seen", "toxic"])


def _featurise(kept: np.ndarray):
    """Numbers of the kept features of labelled texts, and of their sentences with identity terms before and after the swap."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        number = np.full(WIDTH, -1, np.int32)
        number[kept] = np.arange(len(kept))
        for batch in small_batches(batches):
            kinds, labels, rows = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                found = [(0, words)]
                if not words.isdisjoint(SWAP):
                    for s in re.split(r"[.!?\n]+", text.lower()):
                        own = WORD.findall(s)
                        if not SWAP.keys().isdisjoint(own):
                            found += [(1, set(own)), (2, {SWAP.get(w, w) for w in own})]
                for kind, w in found:
                    ids = number[features(w, known)]
                    kinds.append(kind)
                    labels.append(y)
                    rows.append(ids[ids >= 0])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(labels, pa.int32()), ragged(flat, [len(r) for r in rows])], names=["kind", "label", "ids"])

    return featurise


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap_weight: float = 4.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights and the bias, from ``(doc_id, label)`` rows, at most ``sample`` of them.

    Without labelled rows of both kinds all scores are the share of the kind there is (0.5 without any).
    """
    labels = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # the bound of the sample is the bound of what is broadcast and of what reaches the driver
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    given = docs.join(F.broadcast(chosen), "doc_id").select("label", "text")
    rows, toxic = given.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not rows or toxic in (0, rows):
        share = toxic / rows if rows else 0.5
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 0.01) / (1.01 - share)))
    base = toxic / rows
    counted = given.mapInArrow(_count, "feature int, seen long, toxic long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    # features that say something: their toxic share differs from the mean by more than chance; WIDTH at most
    told = F.abs(F.col("toxic") - base * F.col("seen")) > 4 * F.sqrt(base * (1 - base) * F.col("seen") + 0.25)
    kept = np.sort(counted.filter((F.col("seen") >= 3) & told).select("feature").toArrow().column(0).to_numpy()).astype(np.int64)
    got = given.mapInArrow(_featurise(kept), "kind int, label int, ids array<int>").toArrow().combine_chunks()
    kind, label = (got.column(i).to_numpy() for i in (0, 1))
    lists = pa.concat_arrays(got.column(2).chunks)
    every = Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy())

    def part(k: int) -> Rows:
        return Rows(every.ids[kind[every.row] == k], every.lengths[kind == k])

    y = label[kind == 0].astype(float)
    w, b = fit(part(0), y, np.where(y == 1, 0.5 / base, 0.5 / (1 - base)), len(kept), l2=1e-4, pairs=(part(1), part(2)), pair_weight=swap_weight)
    return kept, w, b


def _scorer(ids: np.ndarray, w: np.ndarray, b: float, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(WIDTH)
        weights[ids] = w
        known: dict[str, tuple[int, ...]] = {}
        for batch in small_batches(batches):
            z = np.array([weights[features(set(WORD.findall(t.lower())), known)].sum() for t in batch.column(1).to_pylist()]) + b
            p = sigmoid(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, predicted`` of every row; ``labels`` has ``doc_id`` and ``label`` (0 or 1) of rows to learn from.

    Null and empty texts get the score of no feature at all; repeated rows and null ids are scored like any others; labels
    without a document, null labels and extra columns are ignored, and of repeated labels the larger one counts.
    """
    plain = texts_of(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    ids, w, b = train(plain, known, sample)
    return plain.mapInArrow(_scorer(ids, w, b, threshold), "doc_id long, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(id_crc_mod("doc_id", 3) != 1)
    out = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (id_crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
