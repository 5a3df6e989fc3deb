import re

import pytest

import __spark_entry__
import corpus_pipeline
from siterank.llm import queries

from .data import docs, none, words
from .test_dedup import brute, components
from .test_models import junk, prose


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and set(queries.QUERIES) == set(names)
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())


@pytest.mark.parametrize("make", [docs, none])
def test_stages_take_awkward_rows(spark, make):
    given = make(spark)
    for _, step in corpus_pipeline.STAGES[:-1]:
        given = step(spark, given, "")
        assert given.columns == make(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, given, "").count() >= (1 if make is docs else 0)


def test_pipeline_against_brute_force(spark, tmp_path):
    passage = words(60, 7777)
    near = prose(500) + " " + words(150, 3)
    some = [(i, prose(i) + " " + words(40, i)) for i in range(120)] + [(200 + i, junk(i)) for i in range(24)]
    some += [(300, some[4][1]), (301, some[4][1].replace(" ", "  ", 1)), (400, near), (401, near.replace("house", "home", 1)), (500, words(50, 9090) + " " + passage), (501, passage + " " + words(50, 9191))]
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.run(spark, path).collect()
    clean = [(i, t) for i, t in some if not 200 <= i < 300]
    first: dict[str, int] = {}
    for i, t in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    kept = [(i, t) for i, t in clean if i in first.values()]
    comp = components(kept)
    kept = [(i, t) for i, t in kept if comp[i][1] == i]
    assert {r.doc_id for r in out} == {i for i, _ in kept} and 301 not in first.values() and 401 not in {i for i, _ in kept}
    want = brute(kept)
    assert passage[150:300] in want[500] and passage[150:300] not in want[501]
    assert len(out) == len(kept)


def test_near_copies_from_80_percent_on(spark):
    def edited(text: str, n: int) -> str:
        w = text.split()
        for i in range(n):
            w[20 + 30 * i] = f"edit{i}"
        return " ".join(w)

    # 180 shingles each: 4 edits leave exactly 160 of 200 in common, 5 leave 155 of 205
    a, b = words(184, 61), words(184, 62)
    some = [(1, a), (2, edited(a, 4)), (3, b), (4, edited(b, 5))]
    comp = components(some, 80)
    assert [comp[i][1] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and components(some)[2][1] == 2
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(some, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_copies_go_whatever_their_ids(spark):
    """Null and repeated ids: decisions hold for an id and its text."""
    some = [(3, "t t"), (5, "u"), (5, "t  t"), (None, "v"), (None, "t t"), (7, "x  y"), (7, "x y")]
    got = corpus_pipeline.drop_exact_copies(spark, spark.createDataFrame(some, "doc_id long, text string"), "").collect()
    assert sorted(map(str, ((r.doc_id, " ".join(r.text.split())) for r in got))) == ["(3, 't t')", "(5, 'u')", "(7, 'x y')", "(None, 'v')"]
