"""Alignment of the tokens of two tokenizers by their spans, with corpus-wide counts of linked id pairs.

Texts are cut where both tokenizers always cut: before a single space or line end that follows a visible character.  The
distinct chunks of a block of texts are encoded together.  The spans that the libraries report (character offsets of one,
byte spans of the other) give coarse cuts; tokens that end inside a character (parts of a multibyte character, fallback
bytes) are placed by the lengths of their decoded bytes from the cut before.  Chunks whose joined bytes differ are told apart.

Every position between two ends is a link of one token of each side, so a chunk's links follow from the union of all ends.
Sums over links add up by chunk: a block of texts is written with its chunk numbers and the links of its distinct chunks;
only distinct id pairs of a block are counted over the corpus and sent back to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm.common import ragged, small_batches, stage, table, texts_of
from siterank.llm.ids import SPACE, gather

MARK = "▁"
#: Texts cut by a search of their own: white space at an end, or two or more of it together.
UNEVEN = f"{SPACE}{{2}}|^{SPACE}|{SPACE}$"
#: Chunks that are encoded as one text, chunks remembered by a worker, and chunk positions that are written out at once.
JOINED, REMEMBERED, AT_ONCE = 1000, 200_000, 1 << 18
BLOCK_BYTES = 6 << 20


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refine(ends: np.ndarray, sure: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
    """Byte ends of tokens: coarse ``ends`` where ``sure``, elsewhere the last sure end before plus decoded ``lengths``.

    None if decoded lengths do not add up to the coarse ends.
    """
    total = np.cumsum(lengths)
    at = np.flatnonzero(sure)
    if not np.array_equal(np.diff(total[at], prepend=0), np.diff(ends[at], prepend=0)):
        return None
    last = np.searchsorted(at, np.arange(len(ends)), "right") - 1
    end0, total0 = np.concatenate([[0], ends[at]]), np.concatenate([[0], total[at]])
    return end0[last + 1] + total - total0[last + 1]


class Chunks:
    """Aligned chunks as flat arrays: counts of tokens, groups and links, id pairs of links (A << 32 | B) and written groups."""

    def __init__(self, keys: pa.Array, counts: np.ndarray, pairs: np.ndarray, groups: pa.LargeBinaryArray):
        self.keys, self.counts, self.pairs, self.groups = keys, counts, pairs, groups

    def take(self, at: np.ndarray) -> "Chunks":
        links, place = self.counts[:, 3], pa.array(at)
        return Chunks(self.keys.take(place), self.counts[at], gather(self.pairs, (np.cumsum(links) - links)[at], links[at]), self.groups.take(place))

    @staticmethod
    def concat(parts: list["Chunks"]) -> "Chunks":
        return Chunks(
            pa.concat_arrays([p.keys for p in parts]), np.concatenate([p.counts for p in parts]), np.concatenate([p.pairs for p in parts]),
            pa.concat_arrays([p.groups for p in parts]),
        )


class Aligner:
    """Aligns chunks of a byte-level vocabulary (A, with its leading space) and a marked-piece model with byte fallback (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        stands = byte_table()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            # an added token is never produced; its string stands for itself
            self.bytes_a[i] = bytes(stands[c] for c in token) if all(c in stands for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Whether texts may be cut before spaces and line ends: no piece joins them to what stands before or after.
        self.apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        top = self.top = max(len(pieces), len(self.bytes_a))
        self.written = [str(i) + mark for mark in ",|;" for i in range(top)]
        self.width = np.array([len(w) for w in self.written], np.int64)
        self.known = None

    def spans(self, text: str) -> tuple | None:
        """Ids and byte ends of both sides of ``text``, which begins with a space; None if joined bytes differ."""
        raw = text.encode()
        e = self.a.encode(text, add_special_tokens=False)
        a = np.array(e.ids, np.int64)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        begin, end = offsets[:, 0], offsets[:, 1]
        # a token that shares its last character with the next one ends inside it
        sure = np.append(begin[1:] >= end[:-1], True) & (end > begin) if len(a) else np.zeros(0, bool)
        if len(raw) > len(text):
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            end = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])[end]
        ends_a = refine(end, sure, self.size_a[a])
        pieces = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces if len(text) > 1 else ()
        flat = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
        if not len(flat):
            flat = np.array([(self.b.piece_to_id(MARK), 0, 0)], np.int64)
        b, end = flat[:, 0], flat[:, 2] + 1
        # spans leave out the space that the model adds; inner fallback bytes have empty spans
        ends_b = refine(end, flat[:, 2] > flat[:, 1], self.size_b[b])
        if ends_a is None or ends_b is None or b"".join([self.bytes_a[i] for i in e.ids]) != raw or b"".join([self.bytes_b[i] for i in b.tolist()]) != raw:
            return None
        return a, ends_a, b, ends_b

    def _aligned(self, text: str, sizes: np.ndarray) -> tuple | None:
        """Counts, pairs, written groups and their sizes of consecutive parts of ``text``, of ``sizes`` bytes each."""
        found = self.spans(text)
        if found is None:
            return None
        a, ends_a, b, ends_b = found
        cuts = np.cumsum(sizes)
        groups = np.intersect1d(ends_a, ends_b)
        if not np.isin(cuts, groups).all():
            return None
        union = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, union)] << 32 | b[np.searchsorted(ends_b, union)]
        counts = np.stack([np.diff(np.searchsorted(x, cuts, "right"), prepend=0) for x in (ends_a, ends_b, groups, union)], 1)
        # tokens by group, A before B; each is written with the sign that follows it
        place = np.concatenate([2 * np.searchsorted(groups, ends_a), 2 * np.searchsorted(groups, ends_b) + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        mark = np.where(np.append(place[1:] == place[:-1], False), 0, np.where(place % 2 == 0, 1, 2))
        codes = mark * self.top + np.concatenate([a, b])[order]
        text_ends = np.cumsum(self.width[codes])
        # a part ends with the last B token of its last group
        last = np.searchsorted(place, 2 * np.searchsorted(groups, cuts) + 1, "right") - 1
        written = self.written
        return counts, pairs, "".join([written[c] for c in codes.tolist()]).encode(), np.diff(text_ends[last], prepend=0)

    def _learn(self, keys: pa.Array) -> Chunks:
        """Align new chunks; one whose bytes differ has -1 tokens."""
        sizes = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = keys.to_pylist()
        joint = np.array([c[0] in " \n" and not c[-1].isspace() and not "\x1c" <= c[-1] <= "\x1f" for c in texts], bool) & (sizes < 1 << 16) & self.apart
        order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
        parts, done = [], int(joint.sum())

        def one(i: int) -> None:
            found = self._aligned(texts[i], sizes[i : i + 1]) if texts[i][0] == " " else self._after(texts[i], sizes[i : i + 1])
            parts.append(found or (np.array([[-1, 0, 0, 0]]), np.zeros(0, np.int64), b"", np.zeros(1, np.int64)))

        for lo in range(0, done, JOINED):
            some = order[lo : min(lo + JOINED, done)]
            found = self._after("".join([texts[i] for i in some]), sizes[some])
            if found:
                parts.append(found)
            else:
                for i in some:
                    one(i)
        for i in order[done:]:
            one(i)
        counts, pairs, groups, widths = zip(*parts) if parts else ((np.zeros((0, 4), np.int64),), (np.zeros(0, np.int64),), (b"",), (np.zeros(0, np.int64),))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(widths))])
        written = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(groups))])
        return Chunks(keys.take(pa.array(order)), np.concatenate(counts), np.concatenate(pairs), written)

    def _after(self, text: str, sizes: np.ndarray) -> tuple | None:
        """``_aligned`` of a text that may begin with a line end: a word is put before it and left out of the answer."""
        found = self._aligned(" a" + text, np.concatenate([[2], sizes]))
        if found is None:
            return None
        counts, pairs, groups, widths = found
        return counts[1:], pairs[counts[0, 3] :], groups[widths[0] :], widths[1:]

    def chunks(self, keys: pa.Array) -> Chunks:
        """Alignments of distinct chunks, in their order.  Those of the last blocks are kept as far as ``REMEMBERED`` allows."""
        if self.known is None:
            out = self._learn(keys)
            at = pc.index_in(keys, out.keys).to_numpy(zero_copy_only=False)
            out = out.take(at)
            self.known = out
        else:
            fresh = keys.filter(pc.invert(pc.is_in(keys, self.known.keys)))
            both = Chunks.concat([self.known, self._learn(fresh)]) if len(fresh) else self.known
            out = both.take(pc.index_in(keys, both.keys).to_numpy(zero_copy_only=False))
            self.known = both if len(both.keys) <= REMEMBERED else out
        if len(self.known.keys) > REMEMBERED:
            self.known = self.known.take(np.arange(REMEMBERED))
        return out

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts (each with a space before it) in order, and the number of each text's chunks."""
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False).astype(bool) | (not self.apart)
        uneven |= pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False).astype(bool)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool) | pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False).astype(bool)
        lists = [None] * len(texts)
        even = texts.filter(pa.array(~uneven & ~empty))
        even = pc.replace_substring(pc.replace_substring(pc.binary_join_element_wise(" ", even, ""), "\n", "\0\n"), " ", "\0 ")
        split = pc.split_pattern(even, "\0")
        n = np.zeros(len(texts), np.int64)
        flat, each = pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        # every even text begins with an empty part, before its first space
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(each) - each] = False
        flat = flat.filter(pa.array(keep))
        n[np.flatnonzero(~uneven & ~empty)] = each - 1
        odd = np.flatnonzero(uneven & ~empty)
        if not len(odd):
            return flat, n
        for i in odd.tolist():
            lists[i] = self._parts(" " + texts[i].as_py())
            n[i] = len(lists[i])
        # woven in by text
        starts = np.cumsum(np.where(uneven, 0, n)) - np.where(uneven, 0, n)
        extra, place = [], len(flat)
        for i in odd.tolist():
            extra += lists[i]
            starts[i] = place
            place += int(n[i])
        pool = pa.concat_arrays([flat, pa.array(extra, pa.string())])
        return pool.take(pa.array(gather(np.arange(len(pool)), starts, n))), n

    def _parts(self, text: str) -> list[str]:
        return _cut().sub("\\1\0", text).split("\0") if self.apart and "\0" not in text else [text]


@lru_cache(maxsize=1)
def _cut():
    import regex

    return regex.compile(r"([^\s\x1c-\x20\x85\p{Z}])(?=[ \n])")


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker, which keeps its chunks from task to task."""
    return Aligner(path_a, path_b)


STAGED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, codes array<int>, "
    "chunk_links array<int>, link_pairs array<int>, pairs array<long>, times array<long>"
)


def _digests(chunks: Chunks, codes: np.ndarray, n: np.ndarray, with_text: bool) -> tuple[list[str], list[str | None]]:
    """Written groups of all texts, hashed, and as text on request; positions are written out ``AT_ONCE`` at a time."""
    hashed, texts, ends = [], [], np.cumsum(n)
    lo = text = 0
    state, kept = hashlib.sha256(), []
    while text < len(n):
        hi = min(lo + AT_ONCE, len(codes))
        some = chunks.groups.take(pa.array(codes[lo:hi]))
        flat = memoryview(some.buffers()[2] or b"")
        at = np.frombuffer(some.buffers()[1], np.int64) if hi > lo else [0]
        done = lo
        while text < len(n) and ends[text] <= hi:
            a, b = int(at[done - lo]), int(at[ends[text] - lo])
            state.update(flat[a : max(a, b - 1)])  # the last sign is left out
            if with_text:
                texts.append((b"".join(kept) + bytes(flat[a : max(a, b - 1)])).decode())
            hashed.append(state.hexdigest() if n[text] else "")
            state, kept, done, text = hashlib.sha256(), [], int(ends[text]), text + 1
        if text < len(n) and done < hi:
            state.update(flat[int(at[done - lo]) :])
            if with_text:
                kept.append(bytes(flat[int(at[done - lo]) :]))
        lo = hi
    return hashed, texts if with_text else [None] * len(n)


def _aligned_blocks(path_a: str, path_b: str, with_text: bool):
    schema = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("groups", pa.string()), ("codes", pa.list_(pa.int32())),
        ("chunk_links", pa.list_(pa.int32())), ("link_pairs", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
    ])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, "text", BLOCK_BYTES):
            flat, n = worker.split(batch.column(1))
            coded = flat.dictionary_encode()
            chunks, codes = worker.chunks(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # a text with a chunk whose bytes differ has no tokens
            text = np.repeat(np.arange(len(n)), n)
            bad = np.zeros(len(n), bool)
            bad[text[chunks.counts[codes, 0] < 0]] = True
            codes, n = codes[~bad[text]], np.where(bad, 0, n)
            sums = np.zeros((len(n), 4), np.int64)
            ends = np.cumsum(n)
            for k in range(4):
                total = np.concatenate([[0], np.cumsum(chunks.counts[codes, k])])
                sums[:, k] = total[ends] - total[ends - n]
            hashed, texts = _digests(chunks, codes, n, with_text)
            links = chunks.counts[:, 3]
            pairs, inverse = np.unique(chunks.pairs, return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, inverse, np.repeat(np.bincount(codes, minlength=len(links)), links))
            none = pa.nulls(len(n), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), block)), batch.column(0), *(pa.array(sums[:, k]) for k in range(4)), pa.array(hashed, pa.string()), pa.array(texts, pa.string()),
                    ragged(codes.astype(np.int32), n), none, none, pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.list_(pa.int64())),
                ],
                schema=schema,
            )
            one = {f.name: pa.nulls(1, f.type) for f in schema} | {
                "block": pa.array([block]), "chunk_links": ragged(links.astype(np.int32), [len(links)]), "link_pairs": ragged(inverse.astype(np.int32), [len(inverse)]),
                "pairs": ragged(pairs, [len(pairs)]), "times": ragged(times, [len(times)]),
            }
            yield pa.RecordBatch.from_arrays([one[f.name] for f in schema], schema=schema)
            block += 1

    return align


def _add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of every text of one block, from the answers for the block's pairs."""
    whole = rows.filter(pc.is_valid(rows["chunk_links"])).combine_chunks()
    texts = rows.filter(pc.is_null(rows["chunk_links"])).combine_chunks()
    links = whole["chunk_links"].combine_chunks().flatten().to_numpy().astype(np.int64)
    pool, ends = whole["link_pairs"].combine_chunks().flatten().to_numpy(), np.cumsum(links)
    size = int(pool.max()) + 1 if len(pool) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    code = answers["code"].to_numpy()
    count[code], best[code] = answers["count"].to_numpy(), answers["best"].to_numpy()
    lists = texts["codes"].combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, text_ends = lists.flatten().to_numpy(), np.cumsum(n)
    columns = [texts["doc_id"]]
    for values in (best, count):
        total = np.concatenate([[0], np.cumsum(values[pool])])
        total = np.concatenate([[0], np.cumsum((total[ends] - total[ends - links])[codes])])
        columns.append(pa.array(total[text_ends] - total[text_ends - n]))
    kept = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    return pa.table([columns[0], *(texts[c] for c in kept), *columns[1:]], names=["doc_id", *kept, "n_best", "count_sum"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(texts, pairs)``: one row per row of ``docs``, and corpus-wide counts of linked ids.

    ``texts``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, ``with_groups``, the written
    ``groups``.  ``pairs``: ``a, b, count, best``.  A text that is null, empty or not rebuilt byte by byte by both tokenizers
    (such as one with a literal marker) has no tokens: zeros and ''.  Repeated rows count each, null ids stay; texts of any
    length are one row; other columns are not read, whatever their names.  An empty input gives empty results.
    """
    blocks = stage(texts_of(docs, id_col, text_col).mapInArrow(_aligned_blocks(path_a, path_b, with_groups), STAGED), "token-alignment")
    in_block = blocks.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("code", "x")).select("block", "code", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).filter("times > 0")
    counts = in_block.groupBy("pair").agg(F.sum("times").alias("count"))
    counts = stage(counts.select("pair", F.shiftrightunsigned("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count"), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most one row for each id of B's vocabulary
    counts = counts.join(F.broadcast(most), "b").withColumn("best", (F.col("count") == F.col("most")).cast("int"))
    answers = in_block.join(counts, "pair").select(F.col("block").alias("of_block"), "code", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    texts = blocks.drop("pairs", "times").groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_add_up, schema)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return texts.select(*kept), counts.select("a", "b", "count", F.col("best").cast("boolean").alias("best"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
