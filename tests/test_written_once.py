"""What several passes read is written once: the frames they get hold no join of the given tables any more."""

import pytest

from siterank.catalog import ranking, records
from siterank.plans import cases, score, view

D = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def plans(monkeypatch, owner, name, run):
    """Optimized plans of the frames given to a function."""
    def stops(*frames, **kw):
        raise Seen([f._jdf.queryExecution().optimizedPlan().toString() for f in frames if hasattr(f, "_jdf")])

    monkeypatch.setattr(owner, name, stops)
    with pytest.raises(Seen) as e:
        run()
    return e.value.args[0]


@pytest.mark.parametrize("query", ["ranked_view_default", "ranked_view_search_population", "ranked_view_region_schools"])
def test_views_do_not_score_again(spark, monkeypatch, query):
    got = plans(monkeypatch, view, "ranked_view", lambda: getattr(ranking, query)(spark, D))
    assert len(got) == 2 and not [p for p in got if "Join" in p or "parquet" in p]


@pytest.mark.parametrize("query, name", [("cohort_with_featured", "select_cohort"), ("run_cohort", "select_run_cohort")])
def test_cohorts_do_not_score_again(spark, monkeypatch, query, name):
    got = plans(monkeypatch, ranking.tables, name, lambda: getattr(ranking, query)(spark, D))
    assert len(got) == 2 and not [p for p in got if "SortMerge" in p or "parquet" in p]


def test_rows_of_a_cohort_of_cases_are_written(spark, monkeypatch):
    got = plans(monkeypatch, cases, "attach_districts", lambda: records.case_records(spark, D))
    assert len(got) == 1 and "Join" not in got[0] and "parquet" not in got[0]


def test_the_sidecar_is_written_and_maps_of_a_score_are_left_out_unless_asked_for(spark):
    s = score.score_sites(ranking.records(spark, D))
    assert "lineitem" not in s._jdf.queryExecution().optimizedPlan().toString() and "l_orderkey" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert "normalized" not in s.select("well_id", "rank")._jdf.queryExecution().optimizedPlan().toString()
    r = s.orderBy("rank", "ordinal").first()
    assert list(r.score.asDict()) == ["composite", "breakdown", "group_breakdown", "normalized", "present_metrics", "missing_metrics", "weights"]
