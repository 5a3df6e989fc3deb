import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siterank.functions.numeric import nan_to_null, round_exact
from siterank.operators.components import connected_components
from siterank.operators.ordering import global_position, prefix_counts, with_rank_shares
from siterank.operators.tables import select_cohort
from siterank.plans import detections, score


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_keep_their_own_shares(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 9.0), (1, 3.0), (2, None), (3, float("nan"))], "k int, v double")
    rows = with_rank_shares(df, {"m": ("v", "pct")}).collect()
    assert sorted((r.k, r.m_norm) for r in rows if r.m_norm is not None) == [(0, 0.3333), (0, 1.0), (1, 0.6667)]
    assert len(rows) == 5


def test_shares_of_values_across_ranges(spark):
    # a third of all rows hold one value, of both signs of zero in the second metric
    rows = [(i, 5.0 if i % 3 == 0 else float(i % 40), (-0.0 if i % 2 else 0.0) if i % 3 else float(i), None if i % 4 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double")
    out = with_rank_shares(df, {"a": ("a", "pct"), "b": ("b", "pct_inv"), "c": ("c", "pct"), "d": ("a", "direct")})
    got = {r.i: r for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["i", "a", "b", "c"])
    for m, column, inverted in (("a", "a", False), ("b", "b", True), ("c", "c", False)):
        share = (pdf[column] + 0.0).rank(method="average", pct=True)
        for i, s in zip(pdf["i"], 1 - share if inverted else share):
            have = got[i][f"{m}_norm"]
            assert have is None if math.isnan(s) else abs(have - s) < 6e-5
    assert len(got) == 4000 and all(0.0 <= r.d_norm <= 1.0 for r in got.values())


def test_no_shuffle_by_value_in_share_plans(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(100)], "ordinal long, v double, w double")
    plan = plan_of(with_rank_shares(df, {"v": ("v", "pct"), "w": ("w", "pct")}))
    # rows and shares meet by row alone
    assert all("__row" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "value" not in line and "metric" not in line)
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1


def test_positions_keep_nulls_and_nan_last(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, float("nan")), (3, 5.0), (4, 2.0)], "id long, v double")
    got = {r.id: r["rank"] for r in global_position(df, "v", "id").collect()}
    assert got == {3: 1, 1: 2, 4: 3, 0: 4, 2: 5}
    assert global_position(df.limit(0), "v", "id").count() == 0


def test_counts_below_in_groups(spark):
    df = spark.createDataFrame([("a", float(i), 2) for i in range(50)] + [("b", 1.0, 7)], "g string, v double, n int")
    rows = {(r.g, r.v): (r.before, r.total) for r in prefix_counts(df, ["g"], "v", "n").collect()}
    assert rows[("a", 10.0)] == (20, 100) and rows[("b", 1.0)] == (0, 7) and len(rows) == 51


def test_no_cross_join_in_rank_plans(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "ordinal long, v double")
    for out in (global_position(df, "v", "ordinal"), with_rank_shares(df, {"m": ("v", "pct")})):
        assert not any(x in plan_of(out) for x in ("CartesianProduct", "NestedLoopJoin", "TakeOrdered"))


@pytest.mark.parametrize("x", [math.nan, math.inf, -math.inf, 3e15, -1e300])
@pytest.mark.parametrize("digits", [1, 5])
def test_rounding_leaves_what_has_no_fraction(spark, x, digits):
    row = spark.createDataFrame([(x,)], "x double").select(round_exact("x", digits).alias("a"), round_exact(F.col("x"), digits).alias("b")).first()
    for got in row:
        assert got == x or math.isnan(got) and math.isnan(x)


def test_rounded_nan_becomes_null(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (1.005,)], "x double").select(round_exact("x", 2).alias("x"))
    assert sorted((r.x for r in nan_to_null(df).collect()), key=str) == [1.0, None, None]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 200)]])
def test_components_of_a_chain_and_a_star(spark, edges):
    nodes = spark.createDataFrame([(i,) for i in range(len(edges) + 2)], "id long")
    got = {r.id: r.component for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(len(edges) + 1)}, len(edges) + 1: len(edges) + 1}


def test_ties_at_the_cut_of_a_cohort(spark):
    ranked = spark.createDataFrame([(f"w{i}", "PA", 1 + i // 2) for i in range(9)], "well_id string, state string, rank long")
    featured = spark.createDataFrame([("w8",)], "well_id string")
    assert sorted(r.well_id for r in select_cohort(ranked, featured, 3, ["PA"]).collect()) == ["w0", "w1", "w2", "w8"]


def test_layers_that_number_their_rows_alike(spark):
    rows = [(i, layer, (10.0 * i + (layer == "hero"),)) for i in range(3) for layer in ("candidate", "hero")]
    records = spark.createDataFrame(rows, "ordinal long, layer string, metrics struct<svi: double>").withColumn(
        "metrics", F.struct(*[(F.col("metrics.svi") if k == "svi" else F.lit(None).cast("double")).alias(k) for k in score.METRICS])
    )
    got = score.score_sites(records).collect()
    assert len(got) == 6 and sorted(r.global_rank for r in got) == [1, 2, 3, 4, 5, 6]


def test_summary_of_nothing_is_one_row(spark):
    df = spark.createDataFrame([], "rank long, score struct<composite: double>")
    assert [tuple(r) for r in score.composite_summary(df).collect()] == [(0, None, None, None)]


def test_map_of_year_zero_keeps_all_sites(spark):
    maps = spark.createDataFrame([("m", 0, 512, 512)], "map_id string, map_year int, height int, width int")
    sites = spark.createDataFrame([("m", 1990, 100, 100)], "map_id string, year int, row int, col int")
    tiles = detections.label_tiles(sites, maps)
    assert tiles.where("positive").count() >= 1


def test_group_split_takes_a_share_by_rank(spark):
    df = spark.createDataFrame([(i % 20, i) for i in range(100)], "g long, x long")
    out = detections.split_groups(df, "g", share=0.15)
    assert out.where("split = 'validation'").select("g").distinct().count() == 3 and out.count() == 100
    assert "TakeOrdered" not in plan_of(out)
