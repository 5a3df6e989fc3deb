import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siterank.llm.common import shared_path
from siterank.llm.ids import TokenIds
from siterank.llm.packing import pack_documents, plan_runs, sequences
from siterank.llm.piece_ids import PieceIds, encode_and_decode
from siterank.llm.token_file import ids_crc32, read_metadata, read_tokens, write_tokens

from .data import docs, none, rows

ODD = [" ", "  ", "\n", " \n", "\n ", "a", "B", "é", "1", "23", ",", ".", "!?", "'s", "It's", "<|endoftext|>", "|", "Σ", "İ", "\t", "́", "ﬁ", "漢字", "½", "🙂", "\x85", "\x1c", "x.y", "</w>", "▁", "ñ", "\0"]


def texts(n: int) -> list[str]:
    r = random.Random(3)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_the_whole_text(name, spaced):
    path = public_tokenizers.path(name)
    whole, encoder = Tokenizer.from_file(path), TokenIds(path, spaced, limit=50)
    for part in (texts(1500), texts(1500), [r[1] or "" for r in rows()]):
        ids, n = encoder.encode(pa.array(part))
        for t, got in zip(part, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == whole.encode(t, add_special_tokens=False).ids, t


class Counted(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_a_known_chunk_is_looked_up_once_a_batch():
    encoder, part = TokenIds(public_tokenizers.path("byte_bpe_50k.json"), True), pa.array(["one two, three two", "two three four"] * 50)
    ids, n = encoder.encode(part)
    encoder.chunks.table = Counted(encoder.chunks.table)
    again, m = encoder.encode(part)
    assert ids.tolist() == again.tolist() and n.tolist() == m.tolist()
    assert encoder.chunks.table.asked == len(encoder.chunks.table)


def test_words_that_return_after_200000_others_are_not_segmented_again():
    encoder, segmented = TokenIds(public_tokenizers.path("byte_bpe_50k.json"), True), 0
    mark = int(np.flatnonzero(encoder.marked)[0])

    def batch(texts, **_):
        nonlocal segmented
        words = [max(1, t.count(" ")) for t in texts]
        segmented += sum(words)
        return [SimpleNamespace(ids=[mark] * k) for k in words]

    encoder.batch = batch
    letters = str.maketrans("0123456789", "abcdefghij")
    first, second = (pa.array([" ".join(str(i).translate(letters) for i in range(a, a + 200_000))]) for a in (0, 200_000))
    for part in (first, second, first):
        ids, n = encoder.encode(part)
        assert n.tolist() == [200_000] == [len(ids)]
    assert segmented == 400_000


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_stay_right_while_tables_are_begun_anew(name, spaced):
    path = public_tokenizers.path(name)
    whole, encoder, r = Tokenizer.from_file(path), TokenIds(path, spaced, limit=8), random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "x1", "it's", "überlang", "漢字", "nine", "ten", "eleven", "zwölf"]
    for _ in range(60):
        part = [" ".join(r.choice(words) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 3))]
        ids, n = encoder.encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in part]
        assert len(encoder.chunks.offsets) <= 60


def test_pieces_by_word_give_the_ids_of_the_whole_text():
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole, encoder = sentencepiece.SentencePieceProcessor(model_file=path), PieceIds(path, limit=50)
    assert encoder.apart
    for part in (texts(1500), [r[1] or "" for r in rows()]):
        ids, n = encoder.encode(pa.array(part))
        for t, got in zip(part, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == whole.encode(t), t


def test_sentencepiece_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_and_decode(docs(spark), path, digests=True).collect())
    want = []
    for r in rows():
        ids = whole.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_and_decode(none(spark), path).count() == 0
    assert {r.decoded for r in encode_and_decode(docs(spark), path).collect() if r.doc_id == 8} == {"One"}


def test_token_file_round_trip(spark):
    path, out = public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "t")
    write_tokens(docs(spark), out, path)
    whole = Tokenizer.from_file(path)
    got = read_tokens(spark, out).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r[0]), [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows())
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (place, len(r.ids))
        place += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in ids_crc32(read_tokens(spark, out)).collect()}
    assert crcs == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    plan = read_metadata(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    out = shared_path(spark, "t")
    write_tokens(none(spark), out, path)
    assert read_metadata(spark, out).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills_sequences_without_gap_or_overlap(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 100, 4096])
    counts = {s: r.choice([1, 2, 7, 300]) for s in {r.randint(1, capacity) if seed % 3 else r.randint(1, max(1, capacity // 4)) for _ in range(60)}}
    placed: dict[int, list] = {}
    for s in counts:
        runs = sorted(x for x in plan_runs(counts, capacity) if x[0] == s)
        for (_, first, sequence, each, offset), end in zip(runs, [*(x[1] for x in runs[1:]), counts[s]]):
            for j in range(end - first):
                placed.setdefault(sequence + j // each, []).append((offset + j % each * s, s))
        assert runs[0][1] == 0
    assert sum(map(len, placed.values())) == sum(counts.values())
    for items in placed.values():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        assert at <= capacity
    total = sum(s * n for s, n in counts.items())
    large = sum(n for s, n in counts.items() if 2 * s > capacity)
    assert len(placed) <= max(1.35 * total / capacity + 1, 1.1 * large + total / capacity + 1)


def test_packed_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    packed = pack_documents(docs(spark), path, capacity=512, with_ids=True)
    got = packed.collect()
    want = []
    for r in rows():
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want += [(str(r[0]), i, 512 * i, ids[512 * i : 512 * i + 512]) for i in range(-(-len(ids) // 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.ids) for r in got) == sorted(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in held.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 512
    assert sum(len(r.ids) for r in sequences(packed).collect()) == sum(len(x[3]) for x in want)
    assert pack_documents(none(spark), path).count() == 0
