"""Token ids of whole texts, segmenting each distinct chunk once and joining ids back by position.

A batch of texts becomes one array of chunks; its distinct chunks are looked up in a table that the worker keeps (bounded by
``limit``), missing ones are segmented together, and the ids of every text are gathered by chunk position.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters and digits, none of which changes its kind when lower-cased, before signs: always a boundary of both pre-tokenisers.
TAIL = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}])([,.!?;:%&$#*|]+)"
#: Texts encoded whole: marks of special tokens and, where white space matters, two or more of it together or at an end.
WHOLE = r"<\||\x{0}"
#: Chunks that one call segments, and words that are joined to one text in it.
AT_ONCE, JOINED = 4000, 500
#: Chunks of a table before a new one is begun; there are two tables.
KEPT = 250_000
SPACE = r"[\s\x{1c}-\x{20}\x{85}\p{Z}]"


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``pool[s:s + n]`` for all pairs of start and length."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class ChunkTable:
    """Ids of chunks, learned by ``segment(list of chunks) -> chunks in any order, their ids one after another, their lengths``.

    A chunk's place in ``offsets`` tells where its ids are in ``pool``, so that a batch's ids are gathered without touching a
    Python object per chunk.  Once ``table`` holds more than ``limit`` chunks it becomes ``old`` and a new one is begun, to
    which chunks return as they are met, so that common ones stay; this changes only the speed.
    """

    def __init__(self, segment, limit: int = KEPT):
        self.segment, self.limit, self.table, self.old = segment, limit, {}, {}
        self.pool, self.offsets = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _begin(self) -> None:
        """Keep the chunks of ``table`` as the old ones, and only their ids."""
        kept = np.fromiter(self.table.values(), dtype=np.int64, count=len(self.table))
        starts, lengths = self.offsets[kept], self.offsets[kept + 1] - self.offsets[kept]
        self.pool, self.offsets = gather(self.pool, starts, lengths), np.concatenate([[0], np.cumsum(lengths)])
        self.table, self.old = {}, dict(zip(self.table, range(len(kept))))

    def _learn(self, fresh: list[str]) -> None:
        """Enter chunks that ``table`` lacks."""
        missing = []
        for c in fresh:
            if (place := self.old.get(c)) is None:
                missing.append(c)
            else:
                self.table[c] = place
        if missing:
            chunks, ids, lengths = self.segment(missing)
            first = len(self.offsets) - 1
            self.table.update(zip(chunks, range(first, first + len(chunks))))
            self.pool, self.offsets = np.concatenate([self.pool, ids]), np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])

    def join(self, chunks: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the number of each text's ids; ``per_text``: chunks of each text."""
        if len(self.table) > self.limit:
            self._begin()
        coded = chunks.dictionary_encode()
        # to_pylist makes a scalar of every chunk, which takes longer than all look-ups
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.table.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        if len(at := np.flatnonzero(places < 0)):
            fresh = [distinct[i] for i in at.tolist()]
            self._learn(fresh)
            places[at] = np.fromiter(map(self.table.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        places = places[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else places
        starts = self.offsets[places]
        each = self.offsets[places + 1] - starts
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(per_text)])]
        return gather(self.pool, starts, each), np.diff(ends)


def weave(texts: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge (positions, ids, lengths) of subsets of the texts into the order of the texts."""
    lengths, starts, base = np.zeros(texts, np.int64), np.zeros(texts, np.int64), 0
    for at, ids, n in parts:
        lengths[at], starts[at] = n, base + np.cumsum(n) - n
        base += len(ids)
    return gather(np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, "<u4"), starts, lengths), lengths


class TokenIds:
    """Encodes whole texts exactly as the tokenizers library does without special tokens added.

    Both supported pre-tokenisers never join characters across a single space, a line end or the end of a word before signs,
    so a text is the sequence of the chunks between; the few texts with other patterns are encoded whole.  ``spaced``: the
    vocabulary marks a preceding space (byte-level); otherwise white space is dropped and letters are lower-cased.
    """

    def __init__(self, path: str, spaced: bool, limit: int = KEPT):
        from tokenizers import Tokenizer

        tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        #: Of every id, whether it marks a preceding space or ends a word.
        self.marked = np.zeros(tokenizer.get_vocab_size(), bool)
        self.marked[[i for t, i in tokenizer.get_vocab().items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True
        self.chunks = ChunkTable(self._segment, limit)

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks encoded one by one, and their number in each chunk."""
        found = [e.ids for e in self.batch(chunks, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), dtype="<u4"), np.array(list(map(len, found)), dtype=np.int64)

    def _segment(self, missing: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        words, single, order, parts = [], [], [], []
        for c in missing:
            (words if (c[:1] == " " and c[1:].isalpha() if self.spaced else c.isalpha()) else single).append(c)
        for i in range(0, len(words), AT_ONCE):
            groups = [words[j : j + JOINED] for j in range(i, min(i + AT_ONCE, len(words)), JOINED)]
            for group, e in zip(groups, self.batch([("" if self.spaced else " ").join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                # words of letters are one unit each, told apart by the mark of the preceding space or of their end
                edges = np.flatnonzero(self.marked[ids]) + (not self.spaced)
                if len(edges) == len(group) and (len(ids) == edges[-1] if not self.spaced else edges[0] == 0):
                    order += group
                    parts.append((ids, np.diff(edges, append=len(ids)) if self.spaced else np.diff(edges, prepend=0)))
                else:
                    single += group
        for i in range(0, len(single), AT_ONCE):
            order += single[i : i + AT_ONCE]
            parts.append(self._apart(single[i : i + AT_ONCE]))
        return order, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the number of ids of each."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, f"{WHOLE}|{SPACE}{{2}}|^{SPACE}|{SPACE}$" if self.spaced else WHOLE).to_numpy(zero_copy_only=False).astype(bool)
        parts = []
        if (~odd).any():
            even = pc.replace_substring_regex(texts.filter(pa.array(~odd)), TAIL, "\\1\0\\2")
            if self.spaced:
                even = pc.replace_substring(pc.replace_substring(even, " ", "\0 "), "\n", "\0\n\0")
            else:
                even = pc.replace_substring_regex(pc.ascii_lower(even), r"[ \n\x{0}]+", "\0")
            split = pc.split_pattern(even, "\0")
            parts.append((np.flatnonzero(~odd), *self.chunks.join(pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))))
        for at in np.flatnonzero(odd):
            parts.append((np.array([at]), *self._apart([texts[int(at)].as_py()])))
        return weave(len(texts), parts)


@lru_cache(maxsize=1)
def token_ids(path: str, spaced: bool) -> TokenIds:
    """The encoder of this worker, which keeps its table from task to task."""
    return TokenIds(path, spaced)
