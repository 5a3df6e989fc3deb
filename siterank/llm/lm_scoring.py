"""Scores texts by a word bigram model held in an Elias-Fano trie.

Every pair (word before, word) of every text is dealt out once, by its context, to owner tasks.  An owner counts the pairs of
training texts and writes its part of the trie to a memory-mapped file: a level of words, monotone pointers to the successors
of each word, a level of successors coded relative to their context, and quantised discounted probabilities.  It then answers
for every pair dealt to it and returns sums for each text.  A pair that training texts lack backs off to the word's own
probability, which the owner of that word knows; those few pairs meet it in a join.  Contexts that are too frequent for one
owner are dealt on by their successor, and their totals are joined in at the end.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.llm.common import id_crc_mod, shared_path, small_batches, table
from siterank.llm.elias_fano import EliasFano
from siterank.llm.near_dedup import WordHashes, words_of

#: Hashes that stand for the begin and the end of a text.
BEGIN, END = 0, 1
DISCOUNT = 0.75
#: Pairs that an owner gets on average, pairs of a block on their way to owners, and texts that are read to see which words
#: are too frequent for one owner (they decide on the dealing alone, not on any result).
OWNED, ON_WAY, SEEN_FIRST = 3_000_000, 1_000_000, 4_000
#: Turns in which an owner works through its contexts.
TURNS = 8
#: Stands for a null id in arrays.
NO_ID = np.iinfo(np.int64).min
PART = "kind int, key long, doc_id long, word long, score double, base double, n long, m long"
TEXT, FREQUENT, MISS, WORD = range(4)


class Levels:
    """One owner's trie in a memory-mapped file; the caller closes it."""

    def __init__(self, vocabulary: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        """``keys``: context number * vocabulary size + successor number, ascending; ``counts``: of the pairs."""
        size, logs = max(len(vocabulary), 1), np.log10(counts - DISCOUNT)
        self.size = size
        # the commonest counts have a level of their own, larger ones share evenly spaced levels
        book = np.unique(logs) if len(logs) else np.zeros(1)
        if len(book) > 256:
            book = np.concatenate([book[:192], np.linspace(book[192], book[-1], 64)])
        code = np.clip(np.searchsorted((book[1:] + book[:-1]) / 2, logs), 0, 255).astype(np.uint8)
        pointers = np.concatenate([[0], np.cumsum(np.bincount((keys // size).astype(np.int64), minlength=size))])
        levels = [EliasFano.of(x) for x in (vocabulary, pointers, keys)]
        arrays = [a for e in levels for a in e.parts()] + [code, book]
        self.file = tempfile.NamedTemporaryFile(suffix=".trie")
        places = []
        for a in arrays:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append((self.file.tell(), a.dtype, a.shape))
            self.file.write(a.tobytes())
        self.file.flush()
        maps = [np.memmap(self.file.name, dtype, "r", at, shape) if math.prod(shape) else np.zeros(shape, dtype) for at, dtype, shape in places]
        self.words, self.pointers, self.successors = (EliasFano(e.length, e.low_bytes, *maps[3 * i : 3 * i + 3]) for i, e in enumerate(levels))
        self.code, self.book = maps[-2:]

    def close(self) -> None:
        self.file.close()

    def seen(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair of word hashes was seen, and log10 of its discounted count."""
        context, word = self.words.find(contexts), self.words.find(words)
        known = (context >= 0) & (word >= 0)
        begin, end = (self.pointers.access(np.maximum(context, 0) + i).astype(np.int64) for i in (0, 1))
        known &= begin < end
        at = np.full(len(contexts), -1, np.int64)
        at[known] = self.successors.find(context[known].astype(np.uint64) * np.uint64(self.size) + word[known].astype(np.uint64))
        hit = (at >= begin) & (at < end)
        return hit, np.where(hit, self.book[self.code[np.maximum(at, 0)]] if len(self.code) else 0.0, 0.0)


def _deal(owners: int, spread: dict[int, int]):
    """Pairs by owner; a block is a pickled tuple of numpy arrays under zstd."""
    hot = np.array(sorted(spread), np.uint64)
    ways = np.array([spread[int(h)] for h in hot], np.uint64)

    def blocks(keys: list, docs: list, train: list, lengths: list, h: list) -> pa.RecordBatch:
        words, n = np.concatenate(h), np.array(lengths)
        doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        # every text is BEGIN, words, END in ``words``: pairs are neighbours within it
        inside = np.ones(len(words), bool)
        inside[np.cumsum(n) - 1] = False
        first = np.flatnonzero(inside)
        before, after, doc = words[first], words[first + 1], doc[first]
        owner = before >> np.uint64(20)
        at = np.minimum(np.searchsorted(hot, before), max(len(hot) - 1, 0))
        if len(hot):
            is_hot = hot[at] == before
            owner[is_hot] += ((after[is_hot] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % ways[at[is_hot]]
        owner = (owner % np.uint64(owners)).astype(np.int64)
        order = np.lexsort((doc, before, owner))
        before, after, doc, owner = before[order], after[order], doc[order], owner[order]
        keys, docs, train = np.array(keys, np.int64), np.array(docs, dtype=object), np.array(train)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(owner)]):
            d, di = np.unique(doc[a:b], return_inverse=True)
            c, ci = np.unique(before[a:b], return_counts=True)
            w, wi = np.unique(after[a:b], return_inverse=True)
            ids = docs[d]
            block = (keys[d], np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), train[d], _small(di), c, _small(ci), w, _small(wi))
            rows.append((int(owner[a]), pa.compress(pickle.dumps(block, 5), "zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["owner", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: tuple[list, ...] = ([], [], [], [], [])
        count = 0
        for batch in small_batches(batches):
            for doc, text, train in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                h = np.empty(len(words) + 2, np.uint64)
                h[0], h[-1] = BEGIN, END
                h[1:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) | np.uint64(2)
                key = int.from_bytes(hashlib.blake2b(f"{doc} {text}".encode(), digest_size=8).digest(), "little", signed=True)
                for column, v in zip(held, (key, doc, train, len(h), h)):
                    column.append(v)
                count += len(h)
                if count >= ON_WAY:
                    yield blocks(*held)
                    held, count = ([], [], [], [], []), 0
        if count:
            yield blocks(*held)
        # the worker goes on to other tasks
        hashes.clear()
        pa.default_memory_pool().release_unused()

    return deal


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if len(x) == 0 or x.max() < 1 << 16 else np.uint32)


def _owner(hot: np.ndarray):
    def own(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_pylist()
        del rows
        pa.default_memory_pool().release_unused()
        heads = [_load(x)[:3] for x in blocks]
        keys, docs = np.concatenate([h[0] for h in heads]), np.concatenate([np.where(h[2], NO_ID, h[1]) for h in heads])
        base = np.cumsum([0, *(len(h[0]) for h in heads)])
        del heads
        key, first, place = np.unique(keys, return_index=True, return_inverse=True)
        n, out = len(key), []
        ends, size, known = (np.zeros(n, np.int64) for _ in range(3))
        scores, bases = np.zeros(n), np.zeros(n)
        # contexts are taken in turns, so that the arrays of one turn bound the memory
        for turn in range(TURNS):
            trained, context, word, doc = [], [], [], []
            for at, packed in zip(base, blocks):
                _, _, _, train, di, c, ci, w, wi = _load(packed)
                mine = c % np.uint64(TURNS) == turn
                kept = np.repeat(mine, ci)
                trained.append(train[di[kept]])
                context.append(np.repeat(c[mine], ci[mine]))
                word.append(w[wi[kept]])
                doc.append(place[di[kept].astype(np.int64) + at])
            train, context, word, doc = (np.concatenate(x) for x in (trained, context, word, doc))
            if not len(context):
                continue
            # distinct pairs, numbered by context and word
            c, ci = np.unique(context, return_inverse=True)
            w, wi = np.unique(word, return_inverse=True)
            pair, pi = np.unique(ci * len(w) + wi, return_inverse=True)
            times = np.bincount(pi, train, len(pair)).astype(np.int64)
            pc, pw = c[pair // len(w)], w[pair % len(w)]
            learned = times > 0
            vocabulary = np.unique(np.concatenate([pc[learned], pw[learned]]))
            levels = Levels(vocabulary, np.searchsorted(vocabulary, pc[learned]).astype(np.int64) * max(len(vocabulary), 1) + np.searchsorted(vocabulary, pw[learned]), times[learned])
            try:
                hit, value = levels.seen(pc, pw)
            finally:
                levels.close()
            total, kinds = np.bincount(pair // len(w), times, len(c)), np.bincount(pair // len(w), learned, len(c))
            with np.errstate(divide="ignore", invalid="ignore"):
                whole = np.where(total > 0, np.log10(total), 0.0)
                back = np.where(total > 0, np.log10(DISCOUNT * kinds / total), 0.0)
            spread, is_word = np.isin(c, hot)[ci], context != BEGIN
            hit, value = hit[pi], value[pi]
            score = np.where(hit, value, 0.0) + np.where(spread, 0.0, np.where(hit, -whole[ci], back[ci]))
            ends += np.bincount(doc, word == END, n).astype(np.int64)
            size += np.bincount(doc, minlength=n)
            scores += np.bincount(doc, score, n)
            bases += np.bincount(doc, np.where(is_word & ~spread, np.log10(total[ci] + 1), 0.0), n)
            known += np.bincount(doc, is_word & ~spread & (total[ci] > 0), n).astype(np.int64)
            s, si, sn = np.unique(doc[spread] * len(c) + ci[spread], return_inverse=True, return_counts=True)
            out.append((FREQUENT, key[s // len(c)], c[s % len(c)].view(np.int64), sn, np.bincount(si, hit[spread], len(s)).astype(np.int64)))
            m, mn = np.unique(doc[~hit] * len(w) + wi[~hit], return_counts=True)
            out.append((MISS, key[m // len(w)], w[m % len(w)].view(np.int64), mn, np.zeros(len(m), np.int64)))
            t = np.flatnonzero(total > 0)
            out.append((WORD, np.zeros(len(t), np.int64), c[t].view(np.int64), total[t].astype(np.int64), kinds[t].astype(np.int64)))
        tables = [_rows(TEXT, key, ends, size, known, docs[first], scores, bases), *(_rows(*o) for o in out)]
        return pa.concat_tables(tables)

    return own


def _load(packed: bytes) -> tuple:
    return pickle.loads(pa.decompress(packed, decompressed_size=_size(packed), codec="zstd", asbytes=True))


def _rows(kind: int, key, word, n, m, docs=None, score=None, base=None) -> pa.Table:
    nothing = pa.nulls(len(key), pa.float64())
    return pa.table({
        "kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key), "doc_id": pa.nulls(len(key), pa.int64()) if docs is None else pa.array(docs, mask=docs == NO_ID),
        "word": pa.array(word), "score": nothing if score is None else pa.array(score), "base": nothing if base is None else pa.array(base), "n": pa.array(n), "m": pa.array(m),
    })


def _size(packed: bytes) -> int:
    """Size of a zstd frame's content, from its header."""
    import zstandard

    return zstandard.frame_content_size(packed)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts = WordHashes(), {}
    for batch in small_batches(batches):
        for text in batch.column(1).to_pylist():
            for w in (BEGIN, *(hashes[x] | 2 for x in words_of(text))):
                counts[w] = counts.get(w, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(counts), np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row; ``train``: a condition on ``docs``.

    Tokens are the words of a text, A-Z in lower case, and one end.  ``base_score`` is the add-one unigram log10 probability,
    ``score`` that of the bigram model (absolute discounting, backing off to the unigrams).  Null texts hold the end only; a
    null condition counts as true; repeated rows are scored each; without training texts every token is unknown.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    owners = max(1, math.ceil((size["chars"] or 0) / 6 / OWNED))
    first = plain.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size["n"] // SEEN_FIRST))) == 0).select("doc_id", "text")
    counts = first.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = counts.agg(F.sum("n")).first()[0] or 1
    # at most 2 * owners words
    spread = {r.word & (2**64 - 1): max(2, math.ceil(2 * owners * r.n / seen)) for r in counts.filter(F.col("n") > seen / (2 * owners)).collect()} if owners > 1 else {}
    hot = np.array(sorted(spread), np.uint64)
    owned = plain.mapInArrow(_deal(owners, spread), "owner int, block binary").groupBy("owner").applyInArrow(_owner(hot), PART)
    path = shared_path(spark, "trie-answers")
    owned.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    parts = spark.read.schema(PART).parquet(path)

    def part(kind: int) -> DataFrame:
        return parts.filter(F.col("kind") == kind).drop("kind")

    words = part(WORD).groupBy("word").agg(F.sum("n").alias("c"), F.sum("m").alias("kinds"))
    given = words.agg(
        F.coalesce(F.sum(F.when(F.col("word") != BEGIN, F.col("c"))), F.lit(0)).alias("tokens"), F.count_if(F.col("word") != BEGIN).alias("kinds"),
        F.coalesce(F.max(F.when(F.col("word") == BEGIN, F.col("c"))), F.lit(0)).alias("texts"),
    ).first()
    tokens, kinds, texts = given["tokens"] + given["texts"], given["kinds"] + (given["texts"] > 0), given["texts"]
    rest = math.log10(tokens + kinds + 1)
    log = lambda c: F.log10(c.cast("double"))
    zero = F.lit(0.0)
    own = part(TEXT).select("key", "doc_id", F.col("word").alias("copies"), "score", "base", "n", F.col("m").alias("known"))
    # one row for each word that is dealt to several owners
    many = words.filter(F.col("word").isin([int(h.astype(np.int64)) for h in hot]))
    frequent = (
        part(FREQUENT).join(F.broadcast(many), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        .select(
            "key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("copies"),
            F.when(F.col("c") > 0, (F.col("n") - F.col("m")) * log(DISCOUNT * F.col("kinds") / F.col("c")) - F.col("m") * log(F.col("c"))).otherwise(zero).alias("score"),
            F.when(F.col("word") != BEGIN, F.col("n") * log(F.col("c") + 1)).otherwise(zero).alias("base"), F.lit(0).cast("long").alias("n"),
            F.when((F.col("word") != BEGIN) & (F.col("c") > 0), F.col("n")).otherwise(0).cast("long").alias("known"),
        )
    )
    count = F.when(F.col("word") == END, F.lit(texts)).otherwise(F.coalesce("c", F.lit(0)))
    misses = part(MISS).join(words, "word", "left").select(
        "key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("copies"), (F.col("n") * (log(count + 1) - rest)).alias("score"), zero.alias("base"),
        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("known"),
    )
    summed = own.unionByName(frequent).unionByName(misses).groupBy("key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("copies", "score", "base", "n", "known")])
    each = F.col("copies")
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), each))).select(
        "doc_id", (F.col("n") / each).cast("long").alias("n_tokens"), (F.col("known") / each + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / each + math.log10(texts + 1) - F.col("n") / each * rest).alias("base_score"), (F.col("score") / each).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_crc_mod("doc_id", 7) == 2, F.lit(False))
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
