from pyspark.sql import functions as F

from siterank.plans import profile_store as ps


def rows(spark, begin, end, state):
    i = F.col("id")
    return spark.range(begin, end).select(
        F.lit(state).alias("state"), F.when(i % 4 != 0, (i * 7919 % 10007).cast("double")).alias("distance"), (i % 3000).cast("string").alias("name"),
        F.lit(None).cast("double").alias("nothing"), F.when(i % 5 == 0, float("nan")).otherwise(1.5).alias("odd"),
    )


METRICS = ["distance", "name", "nothing", "odd"]


def test_merged_profiles_agree_with_exact_figures(spark, tmp_path):
    store = ps.profile_store(spark, str(tmp_path / "p"))
    parts = [rows(spark, 0, 30_000, "OH"), rows(spark, 30_000, 40_000, "PA"), rows(spark, 40_000, 60_000, "OH"), rows(spark, 60_000, 60_100, None)]
    for k, part in enumerate(parts):
        ps.add_to_profile(store, part, METRICS, writer="w", batch=k)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r.metric: r for r in ps.profile(store).collect()}
    d = got["distance"]
    exact = whole.agg(F.count("distance").alias("c"), F.count_distinct("distance").alias("u"), F.max("distance").alias("m"),
                      F.count_if(F.col("distance") > 500).alias("g"), *[F.count_if(F.col("distance") <= v).alias(n) for n, v in (("a", d.lower_quartile), ("b", d.median), ("c3", d.upper_quartile))]).first()
    assert (d.n, d.present, d.greatest, d.gt_500) == (60_100, exact.c, exact.m, exact.g) and d.share == exact.c / 60_100
    assert abs(d.distinct_values / exact.u - 1) < 0.06 and abs(got["name"].distinct_values / 3000 - 1) < 0.06
    assert all(abs(x / exact.c - q) < 0.02 for x, q in ((exact.a, 0.25), (exact.b, 0.5), (exact.c3, 0.75)))
    assert (got["nothing"].present, got["nothing"].median, got["nothing"].greatest, got["nothing"].distinct_values) == (0, None, None, 0)
    assert (got["odd"].present, got["odd"].distinct_values, got["odd"].median) == (60_100 * 4 // 5, 1, 1.5)
    assert got["name"].median is None and got["name"].gt_100 == 0
    states = {(r.part, r.metric): r.n for r in ps.profile(store, by_part=True).collect()}
    assert states["OH", "name"] == 50_000 and states["PA", "odd"] == 10_000 and states[None, "distance"] == 100 and len(states) == 12


def test_only_new_rows_are_read_and_replays_change_nothing(spark, tmp_path):
    store = ps.profile_store(spark, str(tmp_path / "p"))
    old = str(tmp_path / "old")
    rows(spark, 0, 500, "OH").write.parquet(old)
    version = ps.add_to_profile(store, spark.read.parquet(old), METRICS, writer="w", batch=0)
    spark.createDataFrame([], "x int").write.mode("overwrite").parquet(old)  # the old rows are gone
    ps.add_to_profile(store, rows(spark, 500, 600, "OH"), METRICS, writer="w", batch=1)
    assert {r.n for r in ps.profile(store).collect()} == {600}
    assert ps.add_to_profile(store, rows(spark, 500, 600, "OH"), METRICS, writer="w", batch=1) == version + 1
    assert {r.n for r in ps.profile(store).collect()} == {600}
    ps.add_to_profile(store, rows(spark, 0, 0, "OH"), METRICS)
    assert {r.n for r in ps.profile(store).collect()} == {600}
