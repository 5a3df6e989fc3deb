import hashlib
import random
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from siterank.llm import token_alignment
from siterank.llm.token_alignment import align_tokens, aligner, op12_token_alignment

from .data import docs, none, rows

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [" ", "  ", "\n", " \n", "\n ", "a", "B", "é", "1", "23", ",", ".", "!?", "'s", "It's", "<|endoftext|>", "|", "Σ", "İ", "\t", "́", "ﬁ", "漢字", "½", "🙂", "\x85", "\x1c", "x.y", "</w>", "▁", "ñ", "\0", "𓀀", "ᚠ", "<s>", "<0x41>", "\xa0"]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Every text encoded whole, links by walking over decoded bytes."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def spans(pieces):
        at, out = 0, []
        for i, raw in pieces:
            at += len(raw)
            out.append((at, i))
        return out

    held, counts = [], Counter()
    for d, t in texts:
        one = [(i, bytes(stands[c] for c in a.id_to_token(i))) for i in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t or "")]
        raw = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in one) != raw or b"".join(x for _, x in two) != raw:
            held.append((d, [], [], [], []))
            continue
        one, two, links, groups, i, j, x, y = spans(one), spans(two), [], [], 0, 0, [], []
        while i < len(one):
            links.append((one[i][1], two[j][1]))
            ea, eb = one[i][0], two[j][0]
            if ea <= eb:
                x.append(str(one[i][1]))
                i += 1
            if eb <= ea:
                y.append(str(two[j][1]))
                j += 1
            if ea == eb:
                groups.append(",".join(x) + "|" + ",".join(y))
                x, y = [], []
        counts.update(links)
        held.append((d, one, two, groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        ((d, len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if k else "") for d, x, y, g, k in held), key=str,
    )


def answers(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    """Blocks, joined chunks, remembered chunks and pieces of written groups so small that all their borders are met."""
    for name, value in (("BLOCK_BYTES", 600), ("JOINED", 7), ("REMEMBERED", 40), ("AT_ONCE", 11)):
        monkeypatch.setattr(token_alignment, name, value)
    aligner.cache_clear()


def odd(n):
    r = random.Random(3)
    return [(i, "".join(r.choice(ODD) for _ in range(r.randint(0, 14)))) for i in range(n)]


def test_links_equal_brute_force(spark):
    texts = odd(2500)
    got, pairs = align_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), *PATHS)
    want = brute(texts)
    assert answers(got) == want
    assert sum(x[1] > 0 for x in want) > 1500
    assert pairs.agg({"count": "sum"}).first()[0] == sum(x[4] for x in want)


def test_borders_inside_the_worker_change_nothing(small):
    """The task's functions called directly, as constants of a test do not reach workers."""
    import numpy as np
    import pyarrow as pa

    a = aligner(*PATHS)
    want = {r[0]: r for r in brute(odd(400))}
    texts = odd(400)
    for lo in range(0, 400, 25):
        some = texts[lo : lo + 25]
        flat, n = a.split(pa.array([t for _, t in some]))
        coded = flat.dictionary_encode()
        chunks, codes = a.chunks(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if (chunks.counts[:, 0] < 0).any():
            continue
        hashed, _ = token_alignment._digests(chunks, codes, n, False)
        assert hashed == [want[d][7] for d, _ in some]
    aligner.cache_clear()


def test_rows_of_documents(spark, tmp_path):
    got, _ = align_tokens(docs(spark), *PATHS, with_groups=True)
    assert answers(got) == brute([r[:2] for r in rows()])
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.collect() if r.n_a)
    assert align_tokens(none(spark), *PATHS)[0].count() == 0
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert answers(op12_token_alignment(spark, str(tmp_path))) == brute([r[:2] for r in rows()])
