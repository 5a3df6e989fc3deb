"""SentencePiece encoding and decoding by a distinct-chunk table.

When no piece of a model holds a white-space marker after another character, merges never cross from one marked word to the
next, so a text's ids are those of its marked words in order.  A batch's distinct words are looked up in the worker's table;
the missing ones are segmented together in one call, told apart by their markers, and ids are joined back by position.
Texts with repeated, leading or trailing spaces or literal markers are encoded whole, and so is everything under a model
whose pieces may cross.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from siterank.llm.common import ragged, small_batches, table, texts_of
from siterank.llm.ids import ChunkTable, weave

MARK = "▁"
#: Words that one call segments.
AT_ONCE = 4000


class PieceIds:
    """``encode(texts)`` and ``decode(ids)`` of one model, with begin and end ids."""

    def __init__(self, path: str, limit: int = 150_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.starts = np.array([p.startswith(MARK) for p in pieces])
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        probe = "a b"
        #: Words are independent if no piece crosses and the model neither drops nor rewrites what separates them.
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and b"identity" in self.model.serialized_model_proto()[-4096:] and self.model.encode(probe) == self.model.encode("a") + self.model.encode("b")
        self.chunks = ChunkTable(self._segment, limit)

    def _segment(self, missing: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        parts = []
        for i in range(0, len(missing), AT_ONCE):
            words = missing[i : i + AT_ONCE]
            ids = np.array(self.model.encode(" ".join(words)), dtype="<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(words):
                parts.append((ids, np.diff(at, append=len(ids))))
            else:
                found = self.model.encode(words)
                parts.append((np.array(list(chain.from_iterable(found)), dtype="<u4"), np.array(list(map(len, found)), dtype=np.int64)))
        return missing, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, without begin and end, and the number of each text's ids."""
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}|\\x{{0}}").to_numpy(zero_copy_only=False).astype(bool) | (not self.apart)
        parts = []
        if (~odd).any():
            split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            parts.append((np.flatnonzero(~odd), *self.chunks.join(pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))))
        for at in np.flatnonzero(odd):
            ids = np.array(self.model.encode(texts[int(at)].as_py()), dtype="<u4")
            parts.append((np.array([at]), ids, np.array([len(ids)])))
        return weave(len(texts), parts)


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """The encoder of this worker, which keeps its table from task to task."""
    return PieceIds(path)


def _coder(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_ids(path)
        for batch in small_batches(batches):
            ids, n = coder.encode(batch.column(1))
            ends = np.cumsum(n)
            # begin before, end after every document
            ids = np.insert(ids, np.stack([ends - n, ends], 1).ravel(), np.tile(np.array([coder.begin, coder.end], "<u4"), len(n)))
            n = n + 2
            lists = ragged(ids.astype(np.int32), n)
            texts = coder.model.decode(lists.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return code


def _digests(inner):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            lists = batch.column(1)
            raw, at = memoryview(lists.values.to_numpy()).cast("B"), lists.offsets.to_numpy() * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array((at[1:] - at[:-1]) // 4, pa.int64()), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column(2).to_pylist()]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digest


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: ids with begin and end, and the text decoded from them.

    With ``digests``, ``doc_id, n_tokens, ids_sha256, decoded_sha256`` instead, so that neither ids nor texts leave the task.
    Null texts are empty and hold begin and end only; repeated rows and null ids are kept; an empty input gives no rows.
    """
    code = _coder(model_path)
    plain = texts_of(docs, id_col, text_col)
    if digests:
        return plain.mapInArrow(_digests(code), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return plain.mapInArrow(code, "doc_id long, ids array<int>, decoded string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
