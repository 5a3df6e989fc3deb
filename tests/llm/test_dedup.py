import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from siterank.llm import near_dedup, span_dedup
from siterank.llm.exact_dedup import directory, exact_duplicates
from siterank.llm.near_dedup import near_duplicates
from siterank.llm.span_dedup import WINDOW, hashed_runs, remove_repeats, runs, units, words_of

from .data import docs, none, rows, words


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 300])
def test_exact_copies(spark, bucket_bytes):
    got = exact_duplicates(docs(spark), bucket_bytes=bucket_bytes).collect()
    groups: dict[str, list] = {}
    for r in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    want = {}
    for t, ids in groups.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        for i in ids:
            want[i] = (keep, len(ids), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(rows())
    assert all((r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] for r in got)
    assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(str(v) for v in {str(k[0]) for k in want.values()})
    assert exact_duplicates(none(spark), bucket_bytes=bucket_bytes).count() == 0


def test_directory_doubles_until_buckets_fit():
    slots, overfull = directory({0: 10, 1: 10, 5: 90, 7: 1}, 3, 50)
    assert len(slots) == 8 and slots[5] in overfull and slots[0] == slots[1] != slots[5] != slots[7]
    assert directory({}, 0, 50) == ([0], set())


def components(rows_: list[tuple], percent: int = 85) -> dict:
    sets = {}
    for i, t in rows_:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
            x, y = sorted((comp[a], comp[b]))
            comp = {i: x if c == y else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_copies(spark):
    got = near_duplicates(docs(spark)).collect()
    want = components([r[:2] for r in rows() if r[0] is not None])
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1]), r
        else:
            assert r.component_id is None and r.kept
    assert want[6][1] == 5 and want[10][1] == 0
    assert near_duplicates(none(spark)).count() == 0


def crowd(n: int, seed: int) -> list[tuple]:
    """Copies of one text, each with its own few changed words, so that only some pairs are linked."""
    r, base, out = random.Random(seed), words(220, seed).split(), []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_a_cluster_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    some = crowd(150, 3) + [(1000 + i, t) for i, t in crowd(40, 4)] + [(2000 + i, words(30 * i + 1, i)) for i in range(9)]
    got = near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()
    want = components(some)
    assert len({c for _, c in want.values()}) > 12
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_units_cover_the_text():
    r, parts = random.Random(1), ["foo", "bar.", " ", "\n", "!?", "a.b", "...", "é", " x", "\t", ". "]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 80)))
        assert "".join(t[a:b] for a, b, _, _ in units(t)) == t


def brute(rows_: list[tuple], sentences: int = 3, least: int = 15) -> dict:
    seen, out = set(), {}
    for i, t in sorted(rows_):
        parts, gone = units(t), set()
        for a, b, *_ in runs(parts, sentences, least):
            key = tuple(p[2] for p in parts[a:b])
            if key in seen:
                gone |= set(range(a, b))
            seen.add(key)
        out[i] = "".join(t[p[0] : p[1]] for k, p in enumerate(parts) if k not in gone)
    return out


def test_repeated_passages_go(spark):
    passage = words(70, 9)
    some = [(0, words(80, 20) + " " + passage + " " + words(60, 21)), (1, words(90, 22) + " " + passage), (2, passage + " " + words(50, 23)), (3, words(100, 24)), (4, "Short. One. Two.")] + [(5, words(40, 25) + "\n" + words(40, 25))]
    given = spark.createDataFrame([(*r, 7) for r in some], "doc_id long, text string, at long")
    got = {r.doc_id: r for r in remove_repeats(given).collect()}
    assert {i: r.text for i, r in got.items()} == brute(some)
    assert got[0].text == some[0][1] and got[3].text == some[3][1] and got[4].text == some[4][1] and got[0]["at"] == 7
    held = lambda t: sum(" ".join(passage.split()[i : i + 20]) in t for i in range(50))
    assert held(got[1].text) == held(got[2].text) == 0 < held(got[0].text)
    assert len(got[5].text) < 0.65 * len(some[5][1])


def test_repeats_with_awkward_rows(spark):
    got = remove_repeats(docs(spark)).collect()
    assert len(got) == len(rows()) and remove_repeats(none(spark)).count() == 0
    by = {r.doc_id: r.text for r in got}
    assert by[2] is None and by[3] == "" and by[None] == "no id here" and by[7] == rows()[7][1]
    assert [r.text for r in got if r.doc_id == 5] == [rows()[5][1]] * 2
    assert remove_repeats(docs(spark)).columns == [*docs(spark).columns, "sentences_removed"]


@pytest.mark.parametrize(("on_way", "owned"), [(1_000_000, 8_000_000), (3000, 4000)])
def test_recall_of_short_passages_at_any_offset(spark, monkeypatch, on_way, owned):
    monkeypatch.setattr(span_dedup, "ON_WAY", on_way)
    monkeypatch.setattr(span_dedup, "OWNED", owned)
    r, some, passages = random.Random(5), [], {}
    for i in range(300):
        new = (lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]) if i % 2 else (lambda n: words(n, r.randrange(10**9)).split())
        passages[i] = new(r.randint(51, 80))
        for j in range(2):
            some.append((2 * i + j, " ".join(new(r.randint(0, 60)) + passages[i] + new(r.randint(0, 60)))))
    got = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    # windows of 51 words that stand in an earlier text, word by word
    seen = set()
    for i, t in some:
        w = t.split()
        windows = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        repeated = {k + x for k, v in enumerate(windows) if v in seen for x in range(51)}
        seen.update(windows)
        assert len(repeated) == (len(passages[i // 2]) if i % 2 else 0)
        left = got[i].text.split()
        assert len(repeated) - 3 * WINDOW <= len(w) - len(left) <= len(repeated), (i, t)
        assert [x for k, x in enumerate(w) if k not in repeated] == [x for x in left if x not in {w[k] for k in repeated}]
        assert (got[i].sentences_removed > 0) == (i % 2 == 1)


def test_runs_of_many_texts_at_once():
    r = random.Random(2)
    texts = ["", "a", *(" ".join(r.choice(["x", "y.", "z\n", "\n\n", f"v{r.randrange(50)}"]) for _ in range(r.randint(0, 90))) for _ in range(60)), "b " * 40]
    hashes = near_dedup.WordHashes()
    found = [words_of(t, hashes) for t in texts]
    size = np.array([len(f) for f, _ in found])
    ends = np.concatenate([np.array(e) + b for (_, e), b in zip(found, np.cumsum(size) - size)])
    text, at, a, b = hashed_runs(np.concatenate([np.array(f, np.uint64) for f, _ in found]), size, ends, 3, 15)
    want = [(i, x, tuple(p[2] for p in units(t)[x:y])) for i, t in enumerate(texts) for x, y in runs(units(t), 3, 15)]
    assert list(zip(text.tolist(), at.tolist())) == [w[:2] for w in want]
    by = {}
    for h, w in zip(zip(a.tolist(), b.tolist()), want):
        assert by.setdefault(h, w[2]) == w[2]
    assert len(by) == len({w[2] for w in want})
    assert max(p[3] for t in texts for p in units(t)) <= WINDOW


def test_an_id_with_several_texts_is_one_document(spark):
    """Links of each of its texts count, also where thousands of rows share an id."""
    a, b, c = words(80, 901), words(80, 902), words(80, 903)
    edit = lambda t: t.replace(t.split()[40], "edited", 1)
    some = [(1, a), (1, b), (1, c), (2, edit(a)), (3, edit(b)), (0, edit(c)), (8, words(70, 904)), (9, words(70, 905))]
    some += [(50, words(30, 10_000 + i % 900)) for i in range(5000)] + [(51, words(30, 10_007))]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).collect()}
    assert got == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 0, False), (8, 8, True), (9, 9, True), (50, 50, True), (51, 50, False)}
