"""Substring deduplication by sliding spans of short units.

A text is cut into units of a few words: after the ends of sentences and lines, and after the last word with the least hash of
every ``WINDOW`` words in a row.  These cuts depend on the words around them alone, so a passage is cut alike wherever it
stands, but for ``WINDOW`` words at its edges, and no unit is longer than ``WINDOW`` words.  Every run of units is hashed, the
shortest from its first unit with at least ``sentences`` units and ``words`` words.  Tasks keep the first place of each hash in
a block of texts and deal these, packed, to owners of ranges of hashes; an owner finds the first place of all, and the units
that any other place covers are removed.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm.common import released, small_batches, table, texts_of
from siterank.llm.near_dedup import WordHashes

WORD = re.compile(r"\S+\s*")
#: Words of a row of which one is a cut.
WINDOW = 5
#: Words of a block on their way to owners, words that give the runs of an owner on average.
ON_WAY, OWNED = 1_000_000, 8_000_000
CUTS = "doc_id long, tag long, at binary"


def words_of(text: str, hashes: WordHashes) -> tuple[list[int], list[int]]:
    """Hashes of the words of a text, and the numbers of words after which a sentence or line ends."""
    found, ends = [], []
    for line in text.split("\n"):
        words = line.split()
        ends += [len(found) + i for i, w in enumerate(words, 1) if w[-1] in ".!?"]
        found += [hashes[w.encode()] for w in words]
        ends.append(len(found))
    return found, ends


def cut_places(h: np.ndarray, size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers of words before each border of a unit, and the text each starts in, of texts of ``size`` words in a row."""
    last = np.cumsum(size)
    cut = np.zeros(len(h) + 1, bool)
    cut[ends] = cut[last] = cut[last - size] = True
    if len(h) >= WINDOW:
        seen = np.lib.stride_tricks.sliding_window_view(h[::-1], WINDOW)
        least = len(h) - np.arange(len(seen)) - seen.argmin(1)
        start = len(h) - WINDOW - np.arange(len(seen))
        text = np.repeat(np.arange(len(size)), size)
        cut[least[text[start] == text[start + WINDOW - 1]]] = True
    borders = np.flatnonzero(cut)
    return borders, np.searchsorted(last, borders, "right")


def units(text: str) -> list[tuple[int, int, str, int]]:
    """Units as (begin, end, text with single spaces, words); together they cover the whole text."""
    found, ends = words_of(text, WordHashes())
    if not found:
        return [(0, len(text), "", 0)] if text else []
    borders, _ = cut_places(np.array(found, np.uint64), np.array([len(found)]), np.array(ends))
    words = list(WORD.finditer(text))
    places = [0, *(words[b - 1].end() for b in borders[1:-1].tolist()), len(text)]
    return [(p, q, " ".join(text[p:q].split()), n) for p, q, n in zip(places, places[1:], np.diff(borders).tolist())]


def runs(parts: list[tuple[int, int, str, int]], sentences: int, words: int) -> Iterator[tuple[int, int]]:
    """(first unit, unit after the last) of every run."""
    end = total = 0
    for begin in range(len(parts)):
        while end < len(parts) and (end - begin < sentences or total < words):
            total += parts[end][3]
            end += 1
        if end - begin < sentences or total < words:
            return
        yield begin, end
        total -= parts[begin][3]


def hashed_runs(h: np.ndarray, size: np.ndarray, ends: np.ndarray, sentences: int, words: int) -> tuple[np.ndarray, ...]:
    """(text, first unit, two hashes of 64 bits) of every run of texts of ``size`` words in a row."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    borders, text = cut_places(h, size, ends)
    last = np.cumsum(size)
    number = np.arange(len(borders))
    first = np.searchsorted(borders, last - size)  # border at which each text starts
    stop = np.maximum(np.searchsorted(borders, borders + words), number + sentences)
    ok = (text < len(size)) & (stop < len(borders))
    ok[ok] = borders[stop[ok]] <= last[text[ok]]
    begin, text = number[ok], text[ok]
    start, n = borders[begin], borders[stop[ok]] - borders[begin]
    # equal runs have equal borders
    h = h.copy()
    h[borders[1:] - 1] ^= np.uint64(0xA4093822299F31D0)
    a, b = np.full(len(n), 0x243F6A8885A308D3, np.uint64) + n.astype(np.uint64), np.full(len(n), 0x13198A2E03707344, np.uint64)
    for i in range(int(n.max(initial=0))):
        on = slice(None) if i < n.min() else np.flatnonzero(n > i)
        w = h[start[on] + i]
        x, y = (a[on] ^ w) * np.uint64(0x9E3779B97F4A7C15), (b[on] + w) * np.uint64(0xC2B2AE3D27D4EB4F)
        a[on], b[on] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), (y ^ (y >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return text, begin - first[text], a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(32))


def later_places(doc: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first place of each hash, in order of hashes, and of its places elsewhere; ``doc`` in order of documents."""
    order = np.lexsort((at, doc, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first = order[new]
    mine = first[np.cumsum(new) - 1]
    return first, order[(doc[order] != doc[mine]) | (at[order] != at[mine])]


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if len(x) == 0 or x.max() < 1 << 16 else np.uint32)


def _number(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the distinct (id, tag) in their order, and the number among them of each."""
    order = np.lexsort((tags, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (tags[order[1:]] != tags[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _deal(sentences: int, words: int, owners: int):
    """First places of a block by owner of the hash, and the places already known to be later ones."""

    def blocks(ids: list, tags: list, found: list, size: list, ends: list) -> pa.RecordBatch:
        size = np.array(size)
        base = np.cumsum(size) - size
        text, at, a, b = hashed_runs(np.concatenate(found), size, np.concatenate([e + i for e, i in zip(ends, base)]), sentences, words)
        b = b.astype(np.uint16)
        ids, tags = np.array(ids, np.int64), np.array(tags, np.uint32)
        kept, number = _number(ids, tags)
        ids, tags, doc = ids[kept], tags[kept], number[text]
        first, later = later_places(doc, at, a, b)
        owner = (a[first] >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
        rows = []
        starts = np.searchsorted(owner, np.arange(owners + 1))
        told = np.searchsorted(doc[later[order := np.argsort(doc[later], kind="stable")]], np.linspace(0, len(ids), owners + 1).astype(np.int64))
        later = later[order]
        shift = int(ids.sum()) % owners  # known places are spread over owners
        for o in range(owners):
            mine, known = first[starts[o] : starts[o + 1]], later[told[(o + shift) % owners] : told[(o + shift) % owners + 1]]
            if len(mine) or len(known):
                d, di = np.unique(np.concatenate([doc[mine], doc[known]]), return_inverse=True)
                block = (np.diff(ids[d], prepend=0), tags[d], a[mine], b[mine], _small(di), _small(np.concatenate([at[mine], at[known]])))
                rows.append((o, pa.compress(pickle.dumps(block, 5), "zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["owner", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: tuple[list, ...] = ([], [], [], [], [])
        count = 0
        for batch in small_batches(batches):
            for doc, text, tag in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, ends = words_of(text, hashes)
                if len(found) < words:
                    continue
                for column, v in zip(held, (doc, tag, np.array(found, np.uint64), len(found), np.array(ends))):
                    column.append(v)
                count += len(found)
                if count >= ON_WAY:
                    yield blocks(*held)
                    held, count = ([], [], [], [], []), 0
        if count:
            yield blocks(*held)
        hashes.clear()
        pa.default_memory_pool().release_unused()

    return deal


def _own(rows: pa.Table) -> pa.Table:
    """Places of an owner's hashes but the first ones, and those that blocks knew, by document."""
    blocks = [_load(x) for x in rows.column("block").to_pylist()]
    ids, tags = np.concatenate([np.cumsum(x[0]) for x in blocks]), np.concatenate([x[1] for x in blocks])
    base = np.cumsum([0, *(len(x[0]) for x in blocks)])
    a, b = np.concatenate([x[2] for x in blocks]), np.concatenate([x[3] for x in blocks])
    kept, number = _number(ids, tags)
    doc = [number[x[4].astype(np.int64) + i] for x, i in zip(blocks, base)]
    n = [len(x[2]) for x in blocks]
    mine, at = np.concatenate([d[:k] for d, k in zip(doc, n)]), np.concatenate([x[5][:k] for x, k in zip(blocks, n)]).astype(np.int64)
    _, later = later_places(mine, at, a, b)
    mine = np.concatenate([mine[later], *(d[k:] for d, k in zip(doc, n))])
    at = np.concatenate([at[later], *(x[5][k:] for x, k in zip(blocks, n))]).astype(np.uint32)
    order = np.lexsort((at, mine))
    mine, at = mine[order], at[order]
    starts = np.flatnonzero(np.diff(mine, prepend=-1))
    ends = [*starts[1:], len(mine)]
    which = kept[mine[starts]] if len(mine) else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(ids[which], pa.int64()), "tag": pa.array(tags[which].astype(np.int64), pa.int64()), "at": pa.array([at[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())})


def _load(packed: bytes) -> tuple:
    import zstandard

    return pickle.loads(pa.decompress(packed, decompressed_size=zstandard.frame_content_size(packed), codec="zstd", asbytes=True))


def _cutter(sentences: int, words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text"):
            texts, counts = [], []
            for text, marks in zip(batch.column(batch.schema.get_field_index("__text")).to_pylist(), batch.column(batch.schema.get_field_index("__cuts")).to_pylist()):
                gone = set()
                if marks:
                    parts, marked = units(text), set(np.frombuffer(b"".join(marks), np.uint32).tolist())
                    for begin, end in runs(parts, sentences, words):
                        if begin in marked:
                            gone.update(range(begin, end))
                    text = "".join(text[p[0] : p[1]] for i, p in enumerate(parts) if i not in gone)
                texts.append(text)
                counts.append(len(gone))
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("__text", "__cuts")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*(batch.schema.names[i] for i in kept), "__kept", "__removed"])

    return cut


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3, words: int = 15, removed_col: str = "sentences_removed",
) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages cut from the text, and the number of units cut.

    The first place of a run is the one with the smallest (id, text's hash, position).  Null texts stay null; a text all of
    whose units repeat becomes empty; rows without id are returned whole and are never a first place.  Repeated rows (same id
    and text) are one document and are cut alike.  ``removed_col`` replaces a column of that name.
    """
    tag = lambda text: F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    plain = texts_of(docs, id_col, text_col).filter("doc_id is not null").withColumn("tag", tag(F.col("text")))
    chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    owners = max(1, math.ceil(chars / 6 / OWNED))
    dealt = plain.select("doc_id", "text", "tag").mapInArrow(released(_deal(sentences, words, owners)), "owner int, block binary")
    later = dealt.groupBy("owner").applyInArrow(_own, CUTS)
    # at most a document's units
    cuts = later.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_list("at").alias("__cuts"))
    names = [c for c in docs.columns if c != removed_col]
    rest = [c for c in names if c != text_col]
    given = docs.select(*[F.col(c) for c in rest], F.col(text_col).alias("__text"))
    same = (F.col(id_col).cast("long") == F.col("__id")) & (tag(F.coalesce(F.col("__text").cast("string"), F.lit(""))) == F.col("__tag"))
    joined = given.join(cuts, same, "left").drop("__id", "__tag")
    kinds = ", ".join(f"`{c}` {t}" for c, t in joined.drop("__text", "__cuts").dtypes)
    out = joined.withColumn("__null", F.col("__text").isNull()).withColumn("__text", F.coalesce("__text", F.lit("")))
    cut = out.mapInArrow(released(_cutter(sentences, words)), f"{kinds}{', ' if kinds else ''}__null boolean, __kept string, __removed long")
    return cut.select(*[F.when(~F.col("__null"), F.col("__kept")).alias(c) if c == text_col else F.col(c) for c in names], F.col("__removed").alias(removed_col))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
