"""Literal expectations for normalisers, models and rounding."""

from pyspark.sql import functions as F

from siterank.functions import models, text as tx
from siterank.functions.numeric import round_exact, round_once


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_normalisers(spark):
    api = [("34-019-20162",), ("3401920162",), ("34019201620000",), ("4-019-20162",), ("00-000-00000",), (None,), ("n/a",)]
    got = [r.v for r in one(spark, api, "a string", v=tx.normalize_api("a"))]
    assert got == ["3401920162"] * 3 + ["0401920162", None, None, None]
    ops = [("  acme oil co ",), ("unknown",), ("N/A",), ("",), (None,)]
    assert [r.v for r in one(spark, ops, "a string", v=tx.normalize_operator("a"))] == ["ACME OIL CO", None, None, None, None]
    depth = [("4,200 ft",), ("3150",), ("0",), ("-999",), (None,), ("garbage",)]
    assert [r.v for r in one(spark, depth, "a string", v=tx.normalize_depth("a"))] == [4200.0, 3150.0, None, None, None, None]
    st = [("DV",), ("TA",), ("Inactive",), ("Plugged & Abandoned",)]
    assert [r.v for r in one(spark, st, "a string", v=tx.classify_status("a"))] == ["abandoned", "idle", "idle", "plugged"]


def test_rounding_matches_python(spark):
    xs = [i / 2000 for i in range(500)] + [k + 0.00005 * j for k in range(5) for j in range(40)] + [-i / 32 for i in range(50)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.select("x", round_exact("x", 4).alias("a"), round_once("x", 1).alias("b")).collect():
        assert r.a == round(r.x, 4) and r.b == round(r.x, 1)


def test_models(spark):
    rows = [("CA", "unknown", False), ("CA", "unknown", None), ("PA", "unknown", False), ("CA", "gas", False), ("CA", "oil", False)]
    df = models.with_methane(spark.createDataFrame(rows, "st string, ty string, p boolean"), "p", "st", "ty")
    df = models.with_plug_cost(df, "ty")
    got = [(r.methane.g_per_hr_point, r.methane.differentiated, r.plug_cost.point_usd) for r in df.collect()]
    assert got == [(10.02, True, 76000), (6.9144, False, 76000), (30.57, True, 76000), (75.0, True, 82800), (0.3, True, 76000)]
    c = models.with_carbon(spark.createDataFrame([(5000.0, 76000, False), (5.0, 76000, True)], "t double, c long, f boolean"), "t", "c", "f")
    assert [(r.carbon.tier, r.carbon.carbon_viable) for r in c.collect()] == [("self_funding", True), ("negligible", True)]
    p = spark.range(1).select(models.pathways(F.lit("OH"), F.lit(True), F.lit(False), F.lit("negligible"), F.lit(True), F.lit(False)).alias("p"))
    assert [x.key for x in p.first().p] == ["federal_bil", "state_program", "charity"]
