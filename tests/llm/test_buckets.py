import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siterank.llm.length_buckets import batches, bucket_documents, decompose, op13_length_buckets

from .data import docs, none, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("capacity", [1, 8, 1024])
def test_pieces_are_the_bits_of_a_length(capacity):
    n = np.array([1, 2, 3, 7, 8, 9, 1023, 1024, 1025, 5000, 1, 65])
    doc, start, length = decompose(n, capacity)
    for i, size in enumerate(n.tolist()):
        own = length[doc == i].tolist()
        rest = [1 << b for b in reversed(range(capacity.bit_length())) if (size % capacity) >> b & 1]
        assert own == [capacity] * (size // capacity) + rest
        assert start[doc == i].tolist() == [sum(own[:k]) for k in range(len(own))]


def documents():
    whole = Tokenizer.from_file(PATH)
    return [(r[0], [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows()]


def test_sequences_hold_every_id_once_without_padding(spark):
    got = bucket_documents(docs(spark).repartition(4), PATH, capacity=256, with_ids=True)
    held = got.collect()
    want = Counter((str(d), len(ids), i, t) for d, ids in documents() for i, t in enumerate(ids))
    assert Counter((str(r.doc_id), r.doc_tokens, r.start + k, t) for r in held for k, t in enumerate(r.ids)) == want
    assert all(r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0 for r in held)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in held)
    assert sorted(r.sequence_id for r in held) == list(range(len(held)))
    assert [r.length for r in sorted(held, key=lambda r: r.sequence_id)] == sorted((r.length for r in held), reverse=True)
    # batches hold one length and together every sequence
    grouped = batches(got, 512).collect()
    assert sorted((r.length, tuple(r.ids)) for r in held) == sorted((r.length, tuple(x)) for r in grouped for x in r.ids)
    assert all(len(r.ids) == r.n_sequences <= 512 // r.length for r in grouped)
    last = {r.length: max(x.batch for x in grouped if x.length == r.length) for r in grouped}
    assert all(r.n_sequences == 512 // r.length for r in grouped if r.batch < last[r.length])


def test_empty_table_and_query(spark, tmp_path):
    assert bucket_documents(none(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        bucket_documents(docs(spark), PATH, capacity=1000)
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_length_buckets(spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert got.agg({"length": "sum"}).first()[0] == sum(len(ids) for _, ids in documents())
