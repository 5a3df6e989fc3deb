import math
import re
from collections import Counter

import pytest

from siterank.llm import ranked_search
from siterank.llm.ranked_search import op11_ranked_search, search

from .data import docs, none, rows, words

ITEM = "item_id long, text string, doc_id string, `rank` int, score string"


def brute(texts, items, top=10):
    """Ranks of every row, counted term by term."""
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in texts]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


ITEMS = [
    (1, words(40, 1)), (2, words(60).upper()), (2, "one, ONE one changed"), (3, None), (4, ""), (5, "nowhere-at-all"), (6, "no id here"), (6, "no id here"), (7, words(200, 5) + " a c a c b"), (None, "one"),
]


def answers(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_ranks_equal_brute_force(spark, monkeypatch, parts):
    """Every part is a block of its own; bundles of about three items."""
    monkeypatch.setattr(ranked_search, "BUNDLE", 3)
    items = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ITEMS], ITEM)
    texts = docs(spark).repartition(parts)
    got = search(texts, items)
    assert answers(got) == brute([r[:2] for r in rows()], ITEMS)
    assert answers(search(texts, items, top=2)) == brute([r[:2] for r in rows()], ITEMS, 2)


def test_ties_and_copies(spark):
    texts = [(i, "alpha beta" if i % 3 else "alpha gamma é") for i in range(60)] + [(7, "alpha beta")] * 12 + [(None, "alpha beta"), (99, None)]
    items = [(1, "Alpha BETA"), (2, "gamma é É"), (3, "alpha alpha")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert answers(search(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(texts, items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a", "x", 1, "y")], ITEM)
    assert search(none(spark), items).count() == 0
    assert search(docs(spark), items.limit(0)).count() == 0


def test_query_reads_its_tables(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = op11_ranked_search(spark, str(tmp_path))
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert answers(got) == brute([r[:2] for r in rows()], ITEMS)
