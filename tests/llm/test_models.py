import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siterank.llm import ann, lm_scoring
from siterank.llm.ann import nearest
from siterank.llm.elias_fano import EliasFano
from siterank.llm.lm_scoring import score_texts
from siterank.llm.quality import LABELLERS, Reader, fit_votes, score_quality
from siterank.llm.toxicity import score_toxicity, train

from .data import docs, none, rows, words


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
@pytest.mark.parametrize("top", [1, 50, 10**6, 2**40, 2**62])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    assert (EliasFano.of(values).access(np.arange(n)) == values).all()
    distinct = np.unique(values)
    asked = np.concatenate([distinct, rng.integers(0, 2 * top, 200).astype(np.uint64)])
    at = {int(v): i for i, v in enumerate(distinct)}
    assert EliasFano.of(distinct).find(asked).tolist() == [at.get(int(v), -1) for v in asked]


def model(some: list[tuple], train_ids: set) -> dict:
    """Counts and backing off in plain Python."""
    tokens = {i: [*(t or "").encode().lower().split(), "end"] for i, t in some}
    c = collections.Counter(w for i in train_ids for w in tokens[i])
    pairs = collections.Counter(p for i in train_ids for p in zip(["begin", *tokens[i][:-1]], tokens[i]))
    total, kinds = collections.Counter(), collections.Counter()
    for (h, _), n in pairs.items():
        total[h] += n
        kinds[h] += 1
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 1) / (n + v + 1))

    def pair(h, w):
        if pairs[h, w]:
            return math.log10((pairs[h, w] - 0.75) / total[h])
        return base(w) + (math.log10(0.75 * kinds[h] / total[h]) if total[h] else 0)

    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(map(base, t)), sum(pair(h, w) for h, w in zip(["begin", *t[:-1]], t))) for i, t in tokens.items()}


@pytest.mark.parametrize("owned", [3_000_000, 900])
def test_scores_of_texts(spark, monkeypatch, owned):
    monkeypatch.setattr(lm_scoring, "OWNED", owned)
    got = score_texts(docs(spark), F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))).collect()
    some = [(i, t) for i, t, *_ in rows()[:13]] + [(-1, "no id here")]
    assert len(got) == len(rows())
    # row 5 stands twice in the table and is learned from twice
    want = model([*some, (-5, rows()[5][1])], {i for i, _ in some if i >= 0 and i % 3 != 1} | {-5})
    for r in got:
        n, known, total, base, score = want[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-3, abs=1e-3)
    assert score_texts(none(spark), F.lit(True)).count() == 0
    untrained = score_texts(docs(spark), F.lit(False)).collect()
    assert {r.n_known for r in untrained} == {0} and {r.train_tokens for r in untrained} == {0}


def vectors(spark, n: int, dim: int = 24, seed: int = 1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dim))[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[0]
    some = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(10**6, None), (10**6 + 50, [0.0] * dim), (10**6 + 1, [None, *[1.0] * (dim - 1)]), (10**6 + 100, [float("nan")] * dim), (10**6 + 2, [float("inf")] * dim), (10**6 + 3, [1.0] * 3), (None, [1.0] * dim), (10**6 + 150, [])]
    return some, spark.createDataFrame([(*r, 5, 1) for r in some + odd], "vec_id long, embedding array<float>, list int, piece int")


@pytest.mark.parametrize(("n", "piece"), [(300, 4096), (3000, 60)])
def test_neighbours(spark, monkeypatch, n, piece):
    monkeypatch.setattr(ann, "PIECE", piece)
    monkeypatch.setattr(ann, "QUERIES", 7)
    some, table = vectors(spark, n)
    got: dict[int, list] = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in some], dtype=float)
    cos = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    hit = 0
    for q in range(0, n, 50):
        best = sorted((i for i in range(n) if i != q), key=lambda i: (-round(cos[q, i], 12), i))[:5]
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(cos[q, i] - s) < 1e-9 for _, i, s in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert sorted(got) == list(range(0, n, 50)) and hit >= (0.9 if n > 500 else 1) * 5 * len(got)
    assert [i for _, i, _ in sorted(got[0])] == list(range(n // 2, n // 2 + 5))


@pytest.mark.parametrize("times", [lambda i: 2, lambda i: 12 if i % 7 == 0 else 1])
def test_neighbours_of_repeated_rows(spark, times):
    rng = np.random.default_rng(4)
    some = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(600, 24)))]
    # an id with two vectors, one of them near a query
    some.append((599, [x + 0.01 for x in some[50][1]]))
    many = [r for r in some for _ in range(times(r[0]))]
    got: dict[int, list] = {}
    for r in nearest(spark.createDataFrame(many, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x, ids = np.array([v for _, v in some], dtype=float), np.array([i for i, _ in some])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 600, 50):
        cos = x @ x[q]
        best = sorted({i for i in ids.tolist() if i != q}, key=lambda i: -cos[ids == i].max())[:5]
        assert sorted(got[q]) == list(enumerate(best, 1))
    assert sorted(got) == list(range(0, 600, 50)) and sorted(got[50])[0] == (1, 599)


def test_few_and_no_vectors(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[:3] for r in nearest(t, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert nearest(t.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(t.limit(1), F.col("vec_id") % 50 == 0).count() == 0


def labelled(n: int) -> list[tuple]:
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        group = ("women", "men")[i // 4 % 2] if i % 3 == 0 else "people"
        text = f"{words(20, i)} The {group} {'are stupid scum' if toxic else 'came along'}. {words(15, i + n)}"
        # one term stands more often in toxic texts
        out.append((i, text + (" women said so." if toxic and i % 8 else ""), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    some = labelled(400)
    table = spark.createDataFrame([(i, t) for i, t, _ in some] + [(10**6, "The women came along."), (10**6 + 1, None), (10**6 + 2, ""), (None, "stupid scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in some if zlib.crc32(str(i).encode()) % 3 != 1] + [(77777, 1), (5, None)], "doc_id long, label int")
    got = {r.doc_id: r for r in score_toxicity(table, labels).collect()}
    held = [(y, got[i].predicted) for i, _, y in some if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(y == p for y, p in held) >= 0.98 * len(held)
    assert got[10**6].predicted == 0 and got[10**6 + 1].score == got[10**6 + 2].score < 0.7 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_swapped_terms_weigh_less_when_regularised(spark):
    some = labelled(400)
    table = spark.createDataFrame([(i, t) for i, t, _ in some], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in some], "doc_id long, label int")

    def gap(swap_weight: float) -> float:
        ids, w, _ = train(table, labels, swap_weight=swap_weight)
        weights = dict(zip(ids.tolist(), w.tolist()))
        return abs(sum(weights.get(zlib.crc32(x.encode()) % (1 << 20), 0) for x in ("women", "wome*", "women*")) - weights.get(zlib.crc32(b"men") % (1 << 20), 0))

    assert gap(50.0) < 0.5 * gap(0.0)


def test_toxicity_without_labels(spark):
    assert {r.score for r in score_toxicity(docs(spark), docs(spark).select("doc_id", F.lit(1).alias("label")).limit(0)).collect()} == {0.5}
    assert score_toxicity(none(spark), docs(spark).select("doc_id", F.lit(1).alias("label"))).count() == 0


def junk(i: int) -> str:
    return [("Spam " * 60).strip(), " ".join(f"{w}&&&" for w in words(50, i).split()), words(60, i).upper().replace(" ", "!! "), " | ".join(words(40, i).split())][i % 4]


def prose(i: int) -> str:
    plain = "the of and small river house green winter moved over under table stone quiet friend letter".split()
    return ". ".join(" ".join(plain[(i * 7 + j * 3 + k * k) % 16] for k in range(6)).capitalize() for j in range(8)) + "."


def test_quality_keeps_prose_and_rejects_junk(spark):
    some = [(i, prose(i), 1) for i in range(300)] + [(1000 + i, junk(i), 0) for i in range(60)]
    got = score_quality(spark.createDataFrame(some, "doc_id long, text string, y int")).collect()
    assert sum(r.quality_score >= 0.05 for r in got if r.y) == 300 and sum(r.quality_score < 0.05 for r in got if not r.y) >= 57


def test_votes_and_their_accuracies():
    reader = Reader()
    assert len(reader.votes("")) == len(LABELLERS) and -1 not in reader.votes(prose(1)) and all(-1 in reader.votes(junk(i)) for i in range(4))
    good = fit_votes(np.array([[1, 1, 0], [-1, -1, 0], [1, 1, -1]]), np.array([900.0, 90.0, 10.0]))
    assert good[0] > 0.9 > 0.1 > good[1]


def test_quality_with_awkward_rows(spark):
    got = score_quality(docs(spark), score_col="score").collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got) and score_quality(none(spark)).count() == 0
    assert score_quality(docs(spark)).columns == [*docs(spark).columns, "quality_score"]
